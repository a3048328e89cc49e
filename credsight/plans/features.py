"""Queries for history aggregates and feature engineering: A1-A5, J1, J2, P2-P9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as FT
from .catalog import register, rounded
from .views import cte

_HIST = ("v_bureau", "v_previous_application", "v_installments", "v_pos_cash", "v_credit_card")

# Independent SQL of each aggregate (oracle side).
SQL_BUREAU = """SELECT SK_ID_CURR, count(*) AS BUREAU_LOAN_COUNT,
  count_if(CREDIT_ACTIVE = 'Active') AS BUREAU_ACTIVE_COUNT,
  round(avg(AMT_CREDIT_SUM), 6) AS BUREAU_AMT_CREDIT_SUM_MEAN,
  round(coalesce(sum(AMT_CREDIT_SUM_DEBT), 0.0), 6) AS BUREAU_AMT_CREDIT_SUM_DEBT_SUM,
  round(avg(CREDIT_DAY_OVERDUE), 6) AS BUREAU_CREDIT_DAY_OVERDUE_MEAN,
  round(max(CREDIT_DAY_OVERDUE), 6) AS BUREAU_CREDIT_DAY_OVERDUE_MAX,
  round(avg(DAYS_CREDIT), 6) AS BUREAU_DAYS_CREDIT_MEAN
FROM v_bureau WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"""

SQL_PREV = """SELECT SK_ID_CURR, count(*) AS PREV_APP_COUNT,
  round(avg(CASE WHEN NAME_CONTRACT_STATUS = 'Approved' THEN 1.0 ELSE 0.0 END), 6) AS PREV_APP_APPROVED_RATIO,
  count_if(NAME_CONTRACT_STATUS = 'Refused') AS PREV_APP_REFUSED_COUNT,
  round(avg(AMT_APPLICATION), 6) AS PREV_AMT_APPLICATION_MEAN,
  round(avg(AMT_CREDIT), 6) AS PREV_AMT_CREDIT_MEAN,
  CAST(max(DAYS_DECISION) AS BIGINT) AS PREV_DAYS_DECISION_MAX
FROM v_previous_application WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"""

SQL_INST = """SELECT SK_ID_CURR, count(*) AS INST_COUNT,
  round(avg(dpd), 6) AS INST_DPD_MEAN, CAST(max(dpd) AS BIGINT) AS INST_DPD_MAX,
  count_if(dpd > 0) AS INST_LATE_COUNT,
  round(avg(CASE WHEN AMT_INSTALMENT <> 0 THEN AMT_PAYMENT / AMT_INSTALMENT END), 6) AS INST_PAYMENT_RATIO_MEAN
FROM (SELECT *, CASE WHEN DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT < 0 THEN 0
                     ELSE DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT END AS dpd FROM v_installments) i
WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"""

SQL_POS = """SELECT SK_ID_CURR, count(*) AS POS_COUNT, round(avg(SK_DPD), 6) AS POS_SK_DPD_MEAN,
  round(max(SK_DPD), 6) AS POS_SK_DPD_MAX
FROM v_pos_cash WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"""

SQL_CARD = """SELECT SK_ID_CURR, count(*) AS CC_COUNT, round(avg(AMT_BALANCE), 6) AS CC_AMT_BALANCE_MEAN,
  round(avg(CASE WHEN AMT_CREDIT_LIMIT_ACTUAL <> 0 THEN AMT_BALANCE / AMT_CREDIT_LIMIT_ACTUAL END), 6)
    AS CC_UTILIZATION_MEAN,
  round(max(SK_DPD), 6) AS CC_SK_DPD_MAX
FROM v_credit_card WHERE SK_ID_CURR IS NOT NULL GROUP BY SK_ID_CURR"""

SQL_AUX_CTES = f"""a1 AS ({SQL_BUREAU}), a2 AS ({SQL_PREV}), a3 AS ({SQL_INST}), a4 AS ({SQL_POS}),
a5 AS ({SQL_CARD}),
aux AS (
  SELECT coalesce(a1.SK_ID_CURR, a2.SK_ID_CURR, a3.SK_ID_CURR, a4.SK_ID_CURR, a5.SK_ID_CURR) AS SK_ID_CURR,
    a1.* EXCLUDE (SK_ID_CURR), a2.* EXCLUDE (SK_ID_CURR), a3.* EXCLUDE (SK_ID_CURR),
    a4.* EXCLUDE (SK_ID_CURR), a5.* EXCLUDE (SK_ID_CURR)
  FROM a1 FULL OUTER JOIN a2 ON a1.SK_ID_CURR = a2.SK_ID_CURR
  FULL OUTER JOIN a3 ON coalesce(a1.SK_ID_CURR, a2.SK_ID_CURR) = a3.SK_ID_CURR
  FULL OUTER JOIN a4 ON coalesce(a1.SK_ID_CURR, a2.SK_ID_CURR, a3.SK_ID_CURR) = a4.SK_ID_CURR
  FULL OUTER JOIN a5 ON coalesce(a1.SK_ID_CURR, a2.SK_ID_CURR, a3.SK_ID_CURR, a4.SK_ID_CURR) = a5.SK_ID_CURR)
"""


def _hist(t):
    return [t.view(v) for v in _HIST]


@register("A1_bureau_agg", cte("v_bureau") + SQL_BUREAU)
def a1(t):
    return rounded(FT.bureau_agg(t.view("v_bureau")))


@register("A2_prev_app_agg", cte("v_previous_application") + SQL_PREV)
def a2(t):
    return rounded(FT.prev_app_agg(t.view("v_previous_application")))


@register("A3_installment_agg", cte("v_installments") + SQL_INST)
def a3(t):
    return rounded(FT.installment_agg(t.view("v_installments")))


@register("A4_pos_agg", cte("v_pos_cash") + SQL_POS)
def a4(t):
    return rounded(FT.pos_agg(t.view("v_pos_cash")))


@register("A5_card_agg", cte("v_credit_card") + SQL_CARD)
def a5(t):
    return rounded(FT.card_agg(t.view("v_credit_card")))


@register("J1_aux_full_outer", cte(*_HIST) + ", " + SQL_AUX_CTES + "SELECT * FROM aux")
def j1(t):
    """One row per applicant in any history table, 25 aggregates."""
    return rounded(FT.aux_features(*_hist(t)))


_AUX_FILLED = ", ".join(f"round(coalesce(CAST(x.{c} AS DOUBLE), 0.0), 6) AS {c}" for c in FT.AUX_FEATURES)


@register("J2_aux_left_merge", cte("v_applications", *_HIST) + ", " + SQL_AUX_CTES + f"""
SELECT a.application_id, a.applicant_id, {_AUX_FILLED}
FROM v_applications a LEFT JOIN aux x ON a.applicant_id = x.SK_ID_CURR""")
def j2(t):
    """Every application with its applicant's aggregates, 0.0 where absent."""
    apps = t.view("v_applications").select("application_id", "applicant_id")
    merged = FT.merge_aux(apps, FT.aux_features(*_hist(t)), key="applicant_id")
    return rounded(merged.select("application_id", "applicant_id", *FT.AUX_FEATURES))


# ------------------------------------------------------------ P2-P9

_MODEL_FRAME_SQL = """mf AS (
  SELECT application_id, applicant_id AS SK_ID_CURR, amt_income_total AS AMT_INCOME_TOTAL,
    amt_credit AS AMT_CREDIT, amt_annuity AS AMT_ANNUITY, days_employed AS DAYS_EMPLOYED,
    days_birth AS DAYS_BIRTH, code_gender AS CODE_GENDER, name_education_type AS NAME_EDUCATION_TYPE,
    name_family_status AS NAME_FAMILY_STATUS, region_rating_client AS REGION_RATING_CLIENT,
    occupation_type AS OCCUPATION_TYPE
  FROM v_applications),
clean AS (
  SELECT * REPLACE (CASE WHEN DAYS_EMPLOYED <> 365243 THEN DAYS_EMPLOYED END AS DAYS_EMPLOYED)
  FROM (SELECT DISTINCT * FROM mf) d)
"""


def _clean(t):
    return FT.clean_dedupe_sentinel(FT.model_frame(t.view("v_applications")))


@register("P2_clean_dedupe_sentinel", cte("v_applications") + ", " + _MODEL_FRAME_SQL + "SELECT * FROM clean")
def p2(t):
    return rounded(_clean(t))


def _sdiv(n: str, d: str) -> str:
    return f"round(coalesce(CASE WHEN {d} <> 0 THEN CAST({n} AS DOUBLE) / {d} END, 0.0), 6)"


@register("P3_financial_ratios", cte("v_applications") + ", " + _MODEL_FRAME_SQL + f"""
SELECT application_id, {_sdiv('AMT_CREDIT', 'AMT_INCOME_TOTAL')} AS CREDIT_INCOME_RATIO,
  {_sdiv('AMT_ANNUITY', 'AMT_INCOME_TOTAL')} AS ANNUITY_INCOME_RATIO,
  {_sdiv('AMT_CREDIT', 'AMT_ANNUITY')} AS CREDIT_ANNUITY_RATIO,
  0.0 AS CREDIT_GOODS_RATIO, 0.0 AS CHILDREN_RATIO, 0.0 AS INCOME_PER_PERSON
FROM clean""")
def p3(t):
    """P3 (goods price, children and family size are absent here, so their ratios are 0.0)."""
    df = FT.coerce_features(_clean(t))
    return rounded(df.select("application_id", *[v.alias(k) for k, v in FT.financial_ratios(df).items()]))


@register("P4_tenure_age", cte("v_applications") + ", " + _MODEL_FRAME_SQL + """
SELECT application_id, round(DAYS_BIRTH / -365.25, 6) AS AGE_YEARS,
  round(DAYS_EMPLOYED / -365.25, 6) AS EMPLOYMENT_YEARS FROM clean""")
def p4(t):
    df = _clean(t)
    return rounded(df.select("application_id", *[v.alias(k) for k, v in FT.tenure_age(df).items()]))


# P5 over three nullable application columns (the view carries no external scores).
_P5_COLS = ["AMT_ANNUITY", "DAYS_EMPLOYED", "REGION_RATING_CLIENT"]


@register("P5_row_stats", cte("v_applications") + ", " + _MODEL_FRAME_SQL + """,
vals AS (SELECT application_id, list_filter([CAST(AMT_ANNUITY AS DOUBLE), CAST(DAYS_EMPLOYED AS DOUBLE),
                                 CAST(REGION_RATING_CLIENT AS DOUBLE)], lambda x: x IS NOT NULL) AS v FROM clean)
SELECT application_id,
  round(CASE WHEN len(v) > 0 THEN list_sum(v) / len(v) END, 6) AS EXT_SOURCE_MEAN,
  round(coalesce(CASE WHEN len(v) > 1 THEN list_stddev_samp(v) END, 0.0), 6) AS EXT_SOURCE_STD,
  round(list_max(v), 6) AS EXT_SOURCE_MAX, round(list_min(v), 6) AS EXT_SOURCE_MIN
FROM vals""")
def p5(t):
    df = _clean(t)
    return rounded(df.select("application_id", *[v.alias(k) for k, v in FT.row_stats(_P5_COLS).items()]))


_P6_COLS = ["AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_EMPLOYED", "DAYS_BIRTH", "CODE_GENDER",
            "NAME_EDUCATION_TYPE", "NAME_FAMILY_STATUS", "REGION_RATING_CLIENT", "OCCUPATION_TYPE"]
_P6_SUM = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in _P6_COLS)


@register("P6_missing_counts", cte("v_applications") + ", " + _MODEL_FRAME_SQL + f"""
SELECT application_id, CAST({_P6_SUM} AS DOUBLE) AS TOTAL_MISSING_VALUES,
  round(CAST({_P6_SUM} AS DOUBLE) / {len(_P6_COLS) + 1}, 6) AS MISSING_PERCENTAGE FROM clean""")
def p6(t):
    df = _clean(t)
    return rounded(df.select("application_id", *[v.alias(k) for k, v in FT.missing_counts(_P6_COLS).items()]))


def feature_matrix(t):
    """P9 -> P2 -> P3..P7 -> J2 -> P8: the model input for every application."""
    apps = FT.coerce_features(FT.model_frame(t.view("v_applications")))
    clean = FT.clean_dedupe_sentinel(apps)
    eng = FT.engineer_features(clean, missing_cols=_P6_COLS)
    merged = FT.merge_aux(eng, FT.aux_features(*_hist(t)))
    return FT.feature_projection(merged, keep=("application_id",))


def _fm_sql() -> str:
    cols = {
        "AMT_INCOME_TOTAL": "AMT_INCOME_TOTAL", "AMT_CREDIT": "AMT_CREDIT", "AMT_ANNUITY": "AMT_ANNUITY",
        "DAYS_EMPLOYED": "CAST(DAYS_EMPLOYED AS DOUBLE)", "EXT_SOURCE_1": "CAST(NULL AS DOUBLE)",
        "EXT_SOURCE_2": "CAST(NULL AS DOUBLE)", "EXT_SOURCE_3": "CAST(NULL AS DOUBLE)",
        "CNT_FAM_MEMBERS": "CAST(NULL AS DOUBLE)", "AMT_GOODS_PRICE": "CAST(NULL AS DOUBLE)",
        "CNT_CHILDREN": "CAST(NULL AS DOUBLE)",
        "CREDIT_INCOME_RATIO": "coalesce(CASE WHEN AMT_INCOME_TOTAL <> 0 THEN AMT_CREDIT / AMT_INCOME_TOTAL END, 0.0)",
        "ANNUITY_INCOME_RATIO": "coalesce(CASE WHEN AMT_INCOME_TOTAL <> 0 THEN AMT_ANNUITY / AMT_INCOME_TOTAL END, 0.0)",
        "CREDIT_ANNUITY_RATIO": "coalesce(CASE WHEN AMT_ANNUITY <> 0 THEN AMT_CREDIT / AMT_ANNUITY END, 0.0)",
        "CREDIT_GOODS_RATIO": "0.0", "EMPLOYMENT_YEARS": "DAYS_EMPLOYED / -365.25", "CHILDREN_RATIO": "0.0",
        "INCOME_PER_PERSON": "0.0", "EXT_SOURCE_MEAN": "CAST(NULL AS DOUBLE)", "EXT_SOURCE_STD": "0.0",
        "EXT_SOURCE_MAX": "CAST(NULL AS DOUBLE)", "EXT_SOURCE_MIN": "CAST(NULL AS DOUBLE)",
        "TOTAL_MISSING_VALUES": f"CAST({_P6_SUM} AS DOUBLE)",
        "MISSING_PERCENTAGE": f"CAST({_P6_SUM} AS DOUBLE) / {len(_P6_COLS) + 1}",
        "TOTAL_DOCUMENT_FLAGS": "0.0",
    }
    parts = [f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in cols.items()]
    parts += [f"round(coalesce(CAST(x.{c} AS DOUBLE), 0.0), 6) AS {c}" for c in FT.AUX_FEATURES]
    parts += ["CAST(NULL AS VARCHAR) AS NAME_CONTRACT_TYPE", "CAST(NULL AS VARCHAR) AS FLAG_OWN_CAR",
              "CAST(NULL AS VARCHAR) AS FLAG_OWN_REALTY", "CAST(NULL AS VARCHAR) AS NAME_INCOME_TYPE",
              "NAME_EDUCATION_TYPE"]
    return ("SELECT application_id, " + ", ".join(parts)
            + " FROM clean c LEFT JOIN aux x ON c.SK_ID_CURR = x.SK_ID_CURR")


@register("P8_feature_matrix", cte("v_applications", *_HIST) + ", " + _MODEL_FRAME_SQL + ", " + SQL_AUX_CTES
          + _fm_sql())
def p8(t):
    """P8 + P9 + P7: the full configured feature set (54 columns), protected columns excluded."""
    return rounded(feature_matrix(t))


@register("P9_coerce_features", cte("v_applications") + ", " + _MODEL_FRAME_SQL + """
SELECT application_id, SK_ID_CURR, AMT_INCOME_TOTAL, AMT_CREDIT, AMT_ANNUITY,
  CAST(NULL AS DOUBLE) AS AMT_GOODS_PRICE, CAST(DAYS_BIRTH AS DOUBLE) AS DAYS_BIRTH,
  CAST(DAYS_EMPLOYED AS DOUBLE) AS DAYS_EMPLOYED, CAST(NULL AS DOUBLE) AS CNT_FAM_MEMBERS,
  CAST(NULL AS DOUBLE) AS CNT_CHILDREN, CAST(NULL AS DOUBLE) AS EXT_SOURCE_1,
  CAST(NULL AS DOUBLE) AS EXT_SOURCE_2, CAST(NULL AS DOUBLE) AS EXT_SOURCE_3,
  CAST(NULL AS VARCHAR) AS NAME_CONTRACT_TYPE, CODE_GENDER, CAST(NULL AS VARCHAR) AS FLAG_OWN_CAR,
  CAST(NULL AS VARCHAR) AS FLAG_OWN_REALTY, CAST(NULL AS VARCHAR) AS NAME_INCOME_TYPE, NAME_EDUCATION_TYPE
FROM mf""")
def p9(t):
    df = FT.coerce_features(FT.model_frame(t.view("v_applications")))
    return rounded(df.select("application_id", FT.ID, *FT.NUMERIC_RAW_INPUTS, *FT.CATEGORICAL_RAW_INPUTS)
                   )
