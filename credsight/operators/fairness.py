"""Fairness: model-level group audit (A13), decision-level segment deltas (A14),
the scheme monitor with pauses (A15, J7, D8), the decision/application join
(J4) and proxy-leakage measures (A16-A18).

All attributes are unpivoted once (``inline`` of a fixed, small array) and
aggregated by (attribute, subgroup) in one ``groupBy``: one shuffle for any
number of attributes, map-side partial aggregation bounds hot subgroups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import age_band

# Fixed values that must equal the reference's.
HARD_BLOCK_DELTA_PP = 5.0
MIN_SUBGROUP_SIZE = 3
AUDIT_MIN_GROUP = 10
AUDIT_THRESHOLD = 0.66
SEGMENT_ATTRIBUTES = ["code_gender", "age_band", "name_education_type", "name_family_status",
                      "region_rating_client"]
AUDIT_ATTRIBUTES = ["CODE_GENDER", "NAME_EDUCATION_TYPE", "NAME_INCOME_TYPE", "REGION_RATING_CLIENT"]
PROXY_FEATURES = ["OCCUPATION_TYPE", "REGION_RATING_CLIENT"]
MATERIAL_THRESHOLD = 0.20
DEFAULT_SCHEME = "Personal Loan"


def _str(c: Column) -> Column:
    """Subgroup label as the reference prints it (str(value))."""
    return c.cast("string")


def unpivot(df: DataFrame, attrs: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per (input row, attribute) with the attribute's value as text."""
    arr = F.array(*[F.struct(F.lit(a).alias("attribute"), _str(v).alias("subgroup")) for a, v in attrs.items()])
    return df.select(*keep, F.inline(arr))


def group_fairness_audit(pred: DataFrame, attributes: list[str] | None = None, y: str = "y_true",
                         p: str = "y_prob", threshold: float = AUDIT_THRESHOLD,
                         min_size: int = AUDIT_MIN_GROUP) -> DataFrame:
    """Per attribute x subgroup size, approval/high-risk rate, precision,
    recall, fpr, fnr (rounded half-even to 4); groups < 10 and absent
    attributes are skipped; NULL subgroups dropped."""
    attrs = [a for a in (attributes or AUDIT_ATTRIBUTES) if a in pred.columns]
    if not attrs:
        return pred.sparkSession.createDataFrame([], "attribute string, subgroup string, sample_size bigint")
    base = pred.select(F.col(y).alias("_y"), (F.col(p) >= F.lit(threshold)).cast("int").alias("_pred"), *attrs)
    long = unpivot(base, {a: F.col(a) for a in attrs}, ["_y", "_pred"]).filter(F.col("subgroup").isNotNull())
    pos, pr = F.col("_y") == 1, F.col("_pred") == 1
    g = long.groupBy("attribute", "subgroup").agg(
        F.count(F.lit(1)).alias("sample_size"), F.count_if(pr).alias("hr"),
        F.count_if(pos & pr).alias("tp"), F.count_if(~pos & pr).alias("fp"),
        F.count_if(pos & ~pr).alias("fn"), F.count_if(~pos & ~pr).alias("tn"))
    g = g.filter(F.col("sample_size") >= min_size)

    def d(n, den):
        return F.bround(F.when(den > 0, n / den).otherwise(F.lit(0.0)), 4)

    c = F.col
    return g.select("attribute", "subgroup", "sample_size",
                    d(c("sample_size") - c("hr"), c("sample_size")).alias("approval_rate"),
                    d(c("hr"), c("sample_size")).alias("high_risk_rate"),
                    d(c("tp"), c("tp") + c("fp")).alias("precision"), d(c("tp"), c("tp") + c("fn")).alias("recall"),
                    d(c("fp"), c("fp") + c("tn")).alias("false_positive_rate"),
                    d(c("fn"), c("fn") + c("tp")).alias("false_negative_rate"))


def decision_application_join(decisions: DataFrame, apps: DataFrame) -> DataFrame:
    """Inner join on application id; scheme = first non-empty of the decision's,
    the application's, else the default.  Segment attributes are derived here."""
    d = decisions.alias("d")
    a = apps.alias("a")
    dec_scheme = F.col("d.loan_scheme") if "loan_scheme" in decisions.columns else F.lit(None).cast("string")
    j = d.join(a, F.col("d.application_id") == F.col("a.application_id"), "inner")
    scheme = F.coalesce(F.nullif(dec_scheme, F.lit("")), F.nullif(F.col("a.loan_scheme"), F.lit("")),
                        F.lit(DEFAULT_SCHEME))
    return j.select(F.col("d.decision_id"), F.col("d.application_id"), scheme.alias("scheme"),
                    F.col("d.recommendation"), F.col("a.code_gender"),
                    age_band(F.col("a.days_birth")).alias("age_band"), F.col("a.name_education_type"),
                    F.col("a.name_family_status"), F.col("a.region_rating_client"))


def segment_rates(joined: DataFrame, attributes: list[str] = SEGMENT_ATTRIBUTES) -> DataFrame:
    """Per scheme x attribute x subgroup: n and approval rate (half-even, 4 places),
    subgroups with n >= 3 only."""
    long = unpivot(joined, {a: F.col(a) for a in attributes},
                   ["scheme", (F.col("recommendation") == "Approve").cast("int").alias("_ok")])
    long = long.filter(F.col("subgroup").isNotNull())
    g = long.groupBy("scheme", "attribute", "subgroup").agg(F.count(F.lit(1)).alias("n"), F.sum("_ok").alias("ok"))
    g = g.filter(F.col("n") >= MIN_SUBGROUP_SIZE)
    return g.select("scheme", "attribute", "subgroup", "n", F.bround(F.col("ok") / F.col("n"), 4).alias("approval_rate"))


def segment_deltas(joined: DataFrame, attributes: list[str] = SEGMENT_ATTRIBUTES) -> DataFrame:
    """Per scheme x attribute with >= 2 qualifying subgroups: delta in
    percentage points, round((max - min) * 100, 2)."""
    r = segment_rates(joined, attributes)
    order = F.create_map(*[x for i, a in enumerate(attributes) for x in (F.lit(a), F.lit(i))])
    g = r.groupBy("scheme", "attribute").agg(F.count(F.lit(1)).alias("n_subgroups"),
                                             F.min("approval_rate").alias("min_rate"),
                                             F.max("approval_rate").alias("max_rate"))
    g = g.filter(F.col("n_subgroups") >= 2)
    return g.select("scheme", "attribute", order[F.col("attribute")].alias("attribute_pos"), "n_subgroups",
                    "min_rate", "max_rate",
                    F.bround((F.col("max_rate") - F.col("min_rate")) * 100, 2).alias("delta_pp"))


def fairness_monitor(joined: DataFrame, open_pauses: DataFrame | None = None, enforce: bool = True,
                     attributes: list[str] = SEGMENT_ATTRIBUTES) -> DataFrame:
    """Per scheme decision_count, max_delta_pp (0.0 when none), worst
    attribute (first in list order among the maximal, none when 0), hard_block
    (> 5.0 pp), alert reason, and whether this run newly pauses the scheme
    (breached, enforcing, and no open pause for it)."""
    counts = joined.groupBy("scheme").agg(F.count(F.lit(1)).alias("decision_count"))
    deltas = segment_deltas(joined, attributes)
    worst = deltas.groupBy("scheme").agg(
        F.max("delta_pp").alias("max_delta_pp"),
        F.min_by("attribute", F.struct(-F.col("delta_pp"), F.col("attribute_pos"))).alias("worst"))
    out = counts.join(worst, "scheme", "left")
    mx = F.coalesce(F.col("max_delta_pp"), F.lit(0.0))
    out = out.select("scheme", "decision_count", mx.alias("max_delta_pp"),
                     F.when(mx > 0, F.col("worst")).alias("worst_attribute"))
    breached = F.col("max_delta_pp") > HARD_BLOCK_DELTA_PP
    out = out.withColumn("hard_block", breached).withColumn(
        "alert_reason", F.when(breached, F.format_string("Fairness gap %spp on %s exceeds %spp",
                                                          F.col("max_delta_pp").cast("string"),
                                                          F.col("worst_attribute"),
                                                          F.lit(str(HARD_BLOCK_DELTA_PP)))))
    if open_pauses is None:
        paused = F.lit(False)
        out = out.withColumn("already_paused", paused)
    else:
        op = open_pauses.filter(F.col("released_at").isNull()).select("scheme").distinct() \
            .withColumn("already_paused", F.lit(True))
        out = out.join(op, "scheme", "left").withColumn("already_paused",
                                                        F.coalesce(F.col("already_paused"), F.lit(False)))
    return out.withColumn("newly_paused", breached & F.lit(enforce) & ~F.col("already_paused"))


def pauses_from_monitor(monitor: DataFrame, now: Column) -> DataFrame:
    """The scheme_pause rows a monitor run appends (open: released_at NULL)."""
    return monitor.filter("newly_paused").select(
        "scheme", F.col("alert_reason").alias("reason"), F.col("max_delta_pp").alias("gap_pp"),
        now.alias("created_at"), F.lit(None).cast("timestamp").alias("released_at"))


def pause_semi(df: DataFrame, pauses: DataFrame, scheme_col: str = "loan_scheme") -> DataFrame:
    """Flag rows whose scheme has an open pause (pauses is a small control
    table; it is deduplicated to one row per scheme before the join)."""
    open_ = pauses.filter(F.col("released_at").isNull()).select(F.col("scheme").alias("_ps")).distinct()
    j = df.join(F.broadcast(open_), df[scheme_col] == F.col("_ps"), "left")
    return j.withColumn("scheme_paused", F.col("_ps").isNotNull()).drop("_ps")


def pause_release(pauses: DataFrame, scheme: str, now: Column) -> DataFrame:
    """Close every open pause of ``scheme``; returns the rewritten control
    table plus how many rows were released."""
    hit = (F.col("scheme") == scheme) & F.col("released_at").isNull()
    return pauses.withColumn("released_now", hit).withColumn(
        "released_at", F.when(hit, now).otherwise(F.col("released_at")))


# ------------------------------------------------------------ A16-A18

def cramers_v(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Bias-corrected Cramer's V per group ``by`` (NULL pairs dropped).
    The association is the sum of seen^2 / (row total * column total) over the observed cells, less 1."""
    by = list(by or [])
    cells = (df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
             .groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count(F.lit(1)).alias("_seen")))
    ra = Window.partitionBy(*by, "_a")
    cells = cells.withColumns({"_row": F.sum("_seen").over(Window.partitionBy(*by, "_a")),
                               "_col": F.sum("_seen").over(Window.partitionBy(*by, "_b"))})
    table = cells.groupBy(*by).agg(
        F.sum("_seen").cast("double").alias("pairs"),
        (F.sum(F.col("_seen") * F.col("_seen") / (F.col("_row") * F.col("_col"))) - 1).alias("association"),
        (F.count_distinct("_a") - 1).cast("double").alias("free_a"), (F.count_distinct("_b") - 1).cast("double").alias("free_b"))
    free_a, free_b, dof = F.col("free_a"), F.col("free_b"), F.nullif(F.col("pairs") - 1, F.lit(0.0))
    # what independent columns show by chance is taken off the association and off both sides' levels
    beyond_chance = F.greatest(F.col("association") - free_a * free_b / dof, F.lit(0.0))
    room = F.least(free_a - free_a * free_a / dof, free_b - free_b * free_b / dof)
    strength = F.when((free_a >= 1) & (free_b >= 1) & (room > 0), F.sqrt(beyond_chance / room)).otherwise(F.lit(0.0))
    return table.select(*by, strength.alias("cramers_v"))


def correlation_ratio(df: DataFrame, cat: str, val: str, by: list[str] | None = None) -> DataFrame:
    """eta = sqrt(SS_between / SS_total) with pair-wise NULL drop.
    SS_total = sum of within-group n*var_pop plus SS_between (stable form)."""
    by = list(by or [])
    g = (df.filter(F.col(cat).isNotNull() & F.col(val).isNotNull())
         .groupBy(*by, F.col(cat).alias("_c"))
         .agg(F.count(F.lit(1)).alias("n"), F.avg(val).alias("m"), F.var_pop(val).alias("v")))
    w = Window.partitionBy(*by)
    g = g.withColumn("grand", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    agg = g.groupBy(*by).agg(
        F.sum(F.col("n") * (F.col("m") - F.col("grand")) * (F.col("m") - F.col("grand"))).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"))
    sst = F.col("ssb") + F.col("ssw")
    return agg.select(*by, F.when(sst > 0, F.sqrt(F.col("ssb") / sst)).otherwise(F.lit(0.0)).alias("corr_ratio"))


def proxy_leakage(df: DataFrame, proxies: list[str] | None = None, gender: str = "CODE_GENDER",
                  days_birth: str = "DAYS_BIRTH") -> DataFrame:
    """Cramer's V of each proxy vs gender and eta vs age; material if the
    larger is >= 0.20 (both rounded half-even to 4 places first in the report)."""
    proxies = [p for p in (proxies or PROXY_FEATURES) if p in df.columns]
    base = df.select(F.col(gender).cast("string").alias("_g"),
                     (F.abs(F.col(days_birth)) / F.lit(365.25)).alias("_age"), *proxies)
    long = base.select("_g", "_age", F.inline(F.array(*[
        F.struct(F.lit(p).alias("proxy_feature"), F.col(p).cast("string").alias("_v")) for p in proxies])))
    v = cramers_v(long, "_v", "_g", by=["proxy_feature"])
    e = correlation_ratio(long, "_v", "_age", by=["proxy_feature"])
    out = v.join(e, "proxy_feature", "full_outer")
    vv = F.coalesce(F.col("cramers_v"), F.lit(0.0))
    ee = F.coalesce(F.col("corr_ratio"), F.lit(0.0))
    return out.select("proxy_feature", F.bround(vv, 4).alias("cramers_v_vs_gender"),
                      F.bround(ee, 4).alias("corr_ratio_vs_age"),
                      (F.greatest(vv, ee) >= MATERIAL_THRESHOLD).alias("material_leakage"))
