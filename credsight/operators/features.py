"""Credit-history aggregates and application feature engineering.

A1-A5  per-applicant aggregates of the five history tables
J1     all five in one frame (full outer by applicant)
J2     left merge onto applications with zero fill
P2-P9  cleaning, ratios, tenure/age, row-wise stats, missing counts,
       document flags, projection and coercion

Scale notes: every aggregate is a single ``groupBy`` on the applicant id, so
Spark runs a map-side partial aggregate before the shuffle and a hot applicant
costs one row per map task, not one task holding all its rows.  ``aux_features``
computes all 25 columns in ONE pass over the union of the five sources (one
shuffle) instead of five aggregates plus four full outer joins (five shuffles
plus re-shuffles of the coalesced key).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import safe_ratio

ID = "SK_ID_CURR"

# Fixed values that must equal the reference's (feature names and sentinel).
DAYS_EMPLOYED_SENTINEL = 365243
PROTECTED_EXCLUDED_FEATURES = ["CODE_GENDER", "DAYS_BIRTH", "AGE_YEARS"]
AUX_FEATURES = [
    "BUREAU_LOAN_COUNT", "BUREAU_ACTIVE_COUNT", "BUREAU_AMT_CREDIT_SUM_MEAN",
    "BUREAU_AMT_CREDIT_SUM_DEBT_SUM", "BUREAU_CREDIT_DAY_OVERDUE_MEAN", "BUREAU_CREDIT_DAY_OVERDUE_MAX",
    "BUREAU_DAYS_CREDIT_MEAN",
    "PREV_APP_COUNT", "PREV_APP_APPROVED_RATIO", "PREV_APP_REFUSED_COUNT", "PREV_AMT_APPLICATION_MEAN",
    "PREV_AMT_CREDIT_MEAN", "PREV_DAYS_DECISION_MAX",
    "INST_COUNT", "INST_DPD_MEAN", "INST_DPD_MAX", "INST_LATE_COUNT", "INST_PAYMENT_RATIO_MEAN",
    "POS_COUNT", "POS_SK_DPD_MEAN", "POS_SK_DPD_MAX",
    "CC_COUNT", "CC_AMT_BALANCE_MEAN", "CC_UTILIZATION_MEAN", "CC_SK_DPD_MAX",
]
BASE_NUMERICAL_FEATURES = [
    "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_EMPLOYED", "EXT_SOURCE_1", "EXT_SOURCE_2",
    "EXT_SOURCE_3", "CNT_FAM_MEMBERS", "AMT_GOODS_PRICE", "CNT_CHILDREN",
    "CREDIT_INCOME_RATIO", "ANNUITY_INCOME_RATIO", "CREDIT_ANNUITY_RATIO", "CREDIT_GOODS_RATIO",
    "EMPLOYMENT_YEARS", "CHILDREN_RATIO", "INCOME_PER_PERSON",
    "EXT_SOURCE_MEAN", "EXT_SOURCE_STD", "EXT_SOURCE_MAX", "EXT_SOURCE_MIN",
    "TOTAL_MISSING_VALUES", "MISSING_PERCENTAGE", "TOTAL_DOCUMENT_FLAGS",
]
NUMERICAL_FEATURES = BASE_NUMERICAL_FEATURES + AUX_FEATURES
CATEGORICAL_FEATURES = ["NAME_CONTRACT_TYPE", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_INCOME_TYPE",
                        "NAME_EDUCATION_TYPE"]
NUMERIC_RAW_INPUTS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "AMT_GOODS_PRICE", "DAYS_BIRTH",
                      "DAYS_EMPLOYED", "CNT_FAM_MEMBERS", "CNT_CHILDREN", "EXT_SOURCE_1", "EXT_SOURCE_2",
                      "EXT_SOURCE_3"]
CATEGORICAL_RAW_INPUTS = ["NAME_CONTRACT_TYPE", "CODE_GENDER", "FLAG_OWN_CAR", "FLAG_OWN_REALTY",
                          "NAME_INCOME_TYPE", "NAME_EDUCATION_TYPE"]
EXT_SOURCES = ["EXT_SOURCE_1", "EXT_SOURCE_2", "EXT_SOURCE_3"]


# ---------------------------------------------------------------- A1-A5
# Each builder takes ``c`` (name -> Column) and ``w`` (wraps a value so it only
# counts for rows of this source); J1 reuses them over the tagged union.

def _plain(name: str) -> Column:
    return F.col(name)


def _all(x: Column) -> Column:
    return x


def _bureau_aggs(c=_plain, w=_all) -> dict[str, Column]:
    return {
        "BUREAU_LOAN_COUNT": F.count(w(F.lit(1))),
        "BUREAU_ACTIVE_COUNT": F.count(w(F.when(c("CREDIT_ACTIVE") == "Active", 1))),
        "BUREAU_AMT_CREDIT_SUM_MEAN": F.avg(w(c("AMT_CREDIT_SUM"))),
        # pandas sums an all-NULL group to 0; Spark gives NULL.
        "BUREAU_AMT_CREDIT_SUM_DEBT_SUM": F.coalesce(F.sum(w(c("AMT_CREDIT_SUM_DEBT"))), F.lit(0.0)),
        "BUREAU_CREDIT_DAY_OVERDUE_MEAN": F.avg(w(c("CREDIT_DAY_OVERDUE"))),
        "BUREAU_CREDIT_DAY_OVERDUE_MAX": F.max(w(c("CREDIT_DAY_OVERDUE"))),
        "BUREAU_DAYS_CREDIT_MEAN": F.avg(w(c("DAYS_CREDIT"))),
    }


def _prev_aggs(c=_plain, w=_all) -> dict[str, Column]:
    status = c("NAME_CONTRACT_STATUS")
    return {
        "PREV_APP_COUNT": F.count(w(F.lit(1))),
        "PREV_APP_APPROVED_RATIO": F.avg(w(F.coalesce((status == "Approved").cast("double"), F.lit(0.0)))),
        "PREV_APP_REFUSED_COUNT": F.count(w(F.when(status == "Refused", 1))),
        "PREV_AMT_APPLICATION_MEAN": F.avg(w(c("AMT_APPLICATION"))),
        "PREV_AMT_CREDIT_MEAN": F.avg(w(c("AMT_CREDIT"))),
        "PREV_DAYS_DECISION_MAX": F.max(w(c("DAYS_DECISION"))),
    }


def _inst_cols(c=_plain) -> dict[str, Column]:
    diff = c("DAYS_ENTRY_PAYMENT") - c("DAYS_INSTALMENT")
    dpd = F.when(diff < 0, F.lit(0)).otherwise(diff)          # clip at 0, NULL stays NULL
    return {
        "_dpd": dpd,
        "_late": F.coalesce((dpd > 0).cast("int"), F.lit(0)),  # NULL compares as 0
        "_pay_ratio": F.try_divide(c("AMT_PAYMENT"), F.nullif(c("AMT_INSTALMENT"), F.lit(0.0))),
    }


def _inst_aggs(c=_plain, w=_all) -> dict[str, Column]:
    return {
        "INST_COUNT": F.count(w(F.lit(1))),
        "INST_DPD_MEAN": F.avg(w(c("_dpd"))),
        "INST_DPD_MAX": F.max(w(c("_dpd"))),
        "INST_LATE_COUNT": F.coalesce(F.sum(w(c("_late"))), F.lit(0)).cast("bigint"),
        "INST_PAYMENT_RATIO_MEAN": F.avg(w(c("_pay_ratio"))),
    }


def _pos_aggs(c=_plain, w=_all) -> dict[str, Column]:
    return {
        "POS_COUNT": F.count(w(F.lit(1))),
        "POS_SK_DPD_MEAN": F.avg(w(c("SK_DPD"))),
        "POS_SK_DPD_MAX": F.max(w(c("SK_DPD"))),
    }


def _card_cols(c=_plain) -> dict[str, Column]:
    return {"_util": F.try_divide(c("AMT_BALANCE"), F.nullif(c("AMT_CREDIT_LIMIT_ACTUAL"), F.lit(0.0)))}


def _card_aggs(c=_plain, w=_all) -> dict[str, Column]:
    return {
        "CC_COUNT": F.count(w(F.lit(1))),
        "CC_AMT_BALANCE_MEAN": F.avg(w(c("AMT_BALANCE"))),
        "CC_UTILIZATION_MEAN": F.avg(w(c("_util"))),
        "CC_SK_DPD_MAX": F.max(w(c("SK_DPD"))),
    }


def _named(aggs: dict[str, Column]) -> list[Column]:
    return [a.alias(n) for n, a in aggs.items()]


def _keyed(df: DataFrame) -> DataFrame:
    # pandas groupby drops NULL keys; Spark would keep a NULL group.
    return df.filter(F.col(ID).isNotNull())


def bureau_agg(bureau: DataFrame) -> DataFrame:
    """A1."""
    return _keyed(bureau).groupBy(ID).agg(*_named(_bureau_aggs()))


def prev_app_agg(prev: DataFrame) -> DataFrame:
    """A2."""
    return _keyed(prev).groupBy(ID).agg(*_named(_prev_aggs()))


def installment_agg(inst: DataFrame) -> DataFrame:
    """A3."""
    return _keyed(inst).withColumns(_inst_cols()).groupBy(ID).agg(*_named(_inst_aggs()))


def pos_agg(pos: DataFrame) -> DataFrame:
    """A4."""
    return _keyed(pos).groupBy(ID).agg(*_named(_pos_aggs()))


def card_agg(card: DataFrame) -> DataFrame:
    """A5."""
    return _keyed(card).withColumns(_card_cols()).groupBy(ID).agg(*_named(_card_aggs()))


# ---------------------------------------------------------------- J1 / J2

# source tag -> (input columns, derived-column builder, aggregate builder)
_SOURCES = {
    "bureau": (["CREDIT_ACTIVE", "AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "CREDIT_DAY_OVERDUE", "DAYS_CREDIT"],
               None, _bureau_aggs),
    "prev": (["NAME_CONTRACT_STATUS", "AMT_APPLICATION", "AMT_CREDIT", "DAYS_DECISION"], None, _prev_aggs),
    "inst": (["DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "AMT_INSTALMENT", "AMT_PAYMENT"], _inst_cols, _inst_aggs),
    "pos": (["SK_DPD"], None, _pos_aggs),
    "card": (["AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "SK_DPD"], _card_cols, _card_aggs),
}


def aux_features(bureau: DataFrame, prev: DataFrame, inst: DataFrame, pos: DataFrame,
                 card: DataFrame) -> DataFrame:
    """The five aggregates side by side, one row per applicant present in any
    source; the columns of a source the applicant is absent from are NULL.

    One shuffle: the sources are tagged, qualified, unioned and aggregated once
    with per-source conditional aggregates (same result as five aggregates
    chained by full outer joins).
    """
    frames = []
    for tag, df in zip(_SOURCES, (bureau, prev, inst, pos, card)):
        cols, derive, _ = _SOURCES[tag]
        d = _keyed(df).select(ID, *cols)
        if derive is not None:
            d = d.withColumns(derive())
        frames.append(d.select(F.col(ID), F.lit(tag).alias("_src"),
                               *[F.col(x).alias(f"{tag}__{x}") for x in d.columns if x != ID]))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    out = []
    for tag, (_, _, builder) in _SOURCES.items():
        present = F.col("_src") == tag
        n = F.count(F.when(present, 1))

        def c(name, tag=tag):
            return F.col(f"{tag}__{name}")

        def w(x, present=present):
            return F.when(present, x)

        for name, a in builder(c, w).items():
            out.append(F.when(n > 0, a).alias(name))
    return union.groupBy(ID).agg(*out).select(ID, *AUX_FEATURES)


def merge_aux(apps: DataFrame, aux: DataFrame, key: str = ID) -> DataFrame:
    """Left join applications to the aggregates; every aggregate is filled
    with 0.0 (also the NULL aggregates of applicants that do have history).
    No-op when the aggregates are already present or the key is absent."""
    aux_cols = [c for c in aux.columns if c != ID]
    if all(c in apps.columns for c in aux_cols) or key not in apps.columns:
        return apps
    a = aux.withColumnRenamed(ID, "_aux_id") if key != ID else aux
    joined = apps.join(a, apps[key] == a["_aux_id"], "left").drop("_aux_id") if key != ID \
        else apps.join(a, ID, "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in aux_cols})


# ---------------------------------------------------------------- P2-P9

def model_frame(apps: DataFrame) -> DataFrame:
    """Map the applications view onto the Home Credit column names the model
    features are defined on; applicant id is ``SK_ID_CURR``."""
    return apps.select(
        F.col("application_id"), F.col("applicant_id").alias(ID),
        F.col("amt_income_total").alias("AMT_INCOME_TOTAL"), F.col("amt_credit").alias("AMT_CREDIT"),
        F.col("amt_annuity").alias("AMT_ANNUITY"), F.col("days_employed").alias("DAYS_EMPLOYED"),
        F.col("days_birth").alias("DAYS_BIRTH"), F.col("code_gender").alias("CODE_GENDER"),
        F.col("name_education_type").alias("NAME_EDUCATION_TYPE"),
        F.col("name_family_status").alias("NAME_FAMILY_STATUS"),
        F.col("region_rating_client").alias("REGION_RATING_CLIENT"),
        F.col("occupation_type").alias("OCCUPATION_TYPE"))


def coerce_features(df: DataFrame, numeric=NUMERIC_RAW_INPUTS, categorical=CATEGORICAL_RAW_INPUTS,
                    key: str = ID) -> DataFrame:
    """Add every expected raw column that is absent as NULL and coerce the
    numeric ones to double (unparseable -> NULL)."""
    cols = {}
    if key not in df.columns:
        cols[key] = F.lit(None).cast("bigint")
    for c in numeric:
        cols[c] = F.col(c).cast("string").try_cast("double") if c in df.columns else F.lit(None).cast("double")
    for c in categorical:
        if c not in df.columns:
            cols[c] = F.lit(None).cast("string")
    return df.withColumns(cols)


def clean_dedupe_sentinel(df: DataFrame, col: str = "DAYS_EMPLOYED") -> DataFrame:
    """Drop exact duplicate rows, then DAYS_EMPLOYED 365243 -> NULL."""
    out = df.dropDuplicates()
    if col in df.columns:
        out = out.withColumn(col, F.when(F.col(col) != DAYS_EMPLOYED_SENTINEL, F.col(col)))
    return out


def financial_ratios(df: DataFrame) -> dict[str, Column]:
    """Safe ratios (0, NULL and +-inf -> 0.0)."""
    c = F.col
    return {
        "CREDIT_INCOME_RATIO": safe_ratio(c("AMT_CREDIT"), c("AMT_INCOME_TOTAL")),
        "ANNUITY_INCOME_RATIO": safe_ratio(c("AMT_ANNUITY"), c("AMT_INCOME_TOTAL")),
        "CREDIT_ANNUITY_RATIO": safe_ratio(c("AMT_CREDIT"), c("AMT_ANNUITY")),
        "CREDIT_GOODS_RATIO": safe_ratio(c("AMT_CREDIT"), c("AMT_GOODS_PRICE")),
        "CHILDREN_RATIO": safe_ratio(c("CNT_CHILDREN"), c("CNT_FAM_MEMBERS")),
        "INCOME_PER_PERSON": safe_ratio(c("AMT_INCOME_TOTAL"), c("CNT_FAM_MEMBERS")),
    }


def tenure_age(df: DataFrame) -> dict[str, Column]:
    """P4."""
    return {"AGE_YEARS": F.col("DAYS_BIRTH").cast("double") / F.lit(-365.25),
            "EMPLOYMENT_YEARS": F.col("DAYS_EMPLOYED").cast("double") / F.lit(-365.25)}


def row_stats(cols: list[str], prefix: str = "EXT_SOURCE") -> dict[str, Column]:
    """P5: row-wise mean, sample std (NULL -> 0.0), max and min, skipping NULLs."""
    if not cols:
        return {f"{prefix}_MEAN": F.lit(None).cast("double"), f"{prefix}_STD": F.lit(0.0),
                f"{prefix}_MAX": F.lit(None).cast("double"), f"{prefix}_MIN": F.lit(None).cast("double")}
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    n = F.size(arr).cast("double")
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.when(n > 0, total / n)
    sq = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    std = F.when(n > 1, F.sqrt(sq / (n - 1)))
    return {f"{prefix}_MEAN": mean, f"{prefix}_STD": F.coalesce(std, F.lit(0.0)),
            f"{prefix}_MAX": F.array_max(arr), f"{prefix}_MIN": F.array_min(arr)}


def missing_counts(cols: list[str]) -> dict[str, Column]:
    """P6 over an explicit column list.  The share divides by len(cols) + 1: the
    reference's denominator is the frame width after the count column is added."""
    total = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in cols]).cast("double")
    return {"TOTAL_MISSING_VALUES": total, "MISSING_PERCENTAGE": total / F.lit(float(len(cols) + 1))}


def document_flag_sum(df: DataFrame, prefix: str = "FLAG_DOCUMENT_") -> dict[str, Column]:
    """Schema-driven sum of the document flags (NULL counts as 0)."""
    flags = [c for c in df.columns if c.startswith(prefix)]
    if not flags:
        return {"TOTAL_DOCUMENT_FLAGS": F.lit(0.0)}
    return {"TOTAL_DOCUMENT_FLAGS": reduce(lambda a, b: a + b,
                                           [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in flags])}


def engineer_features(df: DataFrame, missing_cols: list[str] | None = None) -> DataFrame:
    """P3-P7 in one projection (a single codegen stage)."""
    out = df.withColumns({**financial_ratios(df), **tenure_age(df)})
    out = out.withColumns(row_stats([c for c in EXT_SOURCES if c in df.columns]))
    mc = missing_cols if missing_cols is not None else out.columns
    out = out.withColumns(missing_counts(mc))
    return out.withColumns(document_flag_sum(out))


def feature_projection(df: DataFrame, numeric=NUMERICAL_FEATURES, categorical=CATEGORICAL_FEATURES,
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """Configured features that exist, in configured order; protected columns
    can never pass (checked on the analysed plan's output)."""
    wanted = [c for c in list(numeric) + list(categorical) if c in df.columns]
    out = df.select(*keep, *wanted)
    leaked = [c for c in out.columns if c in PROTECTED_EXCLUDED_FEATURES]
    if leaked:
        raise AssertionError(f"protected attributes in feature set: {leaked}")
    return out
