"""Operations reporting: latest decision status (W1, J9), review queue (W2),
visibility (P16), override validation (P18), KPIs (A22, A23), exact
percentiles (A24), pilot summary (A25) and the missing-field profile (A29).

Latest-per-key uses ``max_by`` aggregates (partial aggregation map-side), not
a window per key, so a key holding a third of the rows never lands whole in
one task.  Exact percentiles reuse the two-level prefix over distinct values
(range-partitioned; see ``evaluate.score_counts``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Fixed values that must equal the reference's.
KPI_THRESHOLDS = {"p95_latency_s": 20.0, "cost_per_app_usd": 0.08, "fairness_gap_pp": 5.0,
                  "acceptance_rate_min": 0.75}
OVERRIDE_REASON_CODES = ["compensating_factors", "policy_exception_approved", "additional_documentation",
                         "data_quality_issue", "risk_appetite", "regulatory_clarification", "other"]


def latest_decision(decisions: DataFrame, key: str = "application_id", ts: str = "created_at",
                    tie: str = "decision_id") -> DataFrame:
    """The newest decision per key (ties by id) and the applicant-facing status:
    accept keeps Approve/Decline, override inverts them, else Pending."""
    cols = [c for c in decisions.columns if c != key]
    latest = decisions.groupBy(key).agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(ts), F.col(tie))).alias("d"))
    latest = latest.select(key, "d.*")
    act, rec = F.col("underwriter_action"), F.col("recommendation")
    status = (F.when(act.isNull(), "Pending")
              .when(act == "accept", F.when(rec == "Approve", "Approved").when(rec == "Decline", "Denied")
                    .otherwise("Pending"))
              .otherwise(F.when(rec == "Approve", "Denied").when(rec == "Decline", "Approved").otherwise("Pending")))
    return latest.withColumn("decision_status", status)


def applicant_status(apps: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every application with the status of its latest decision (Pending if none)."""
    st = latest_decision(decisions).select(F.col("application_id").alias("_aid"), "decision_status")
    j = apps.join(st, apps["application_id"] == F.col("_aid"), "left").drop("_aid")
    return j.withColumn("decision_status", F.coalesce(F.col("decision_status"), F.lit("Pending")))


def visible_applications(apps: DataFrame, viewer_id: int | None, is_ops: bool,
                         owner: str = "applicant_id") -> DataFrame:
    """Reviewers see all, applicants only their own; newest first."""
    out = apps if is_ops else apps.filter(F.col(owner) == F.lit(viewer_id))
    return out.orderBy(F.desc("created_at"))


def human_review_queue(decisions: DataFrame) -> DataFrame:
    """Escalated decisions without an underwriter action, newest first."""
    return decisions.filter(F.col("escalation_flag") & F.col("underwriter_action").isNull()) \
        .orderBy(F.desc("created_at"))


def validate_actions(actions: DataFrame, key: str = "assessment_id", ts: str = "action_at",
                     tie: str = "action_id") -> DataFrame:
    """Check an underwriter action feed.  An override needs a reason and an
    allowed reason code; only the first action per assessment is accepted, any
    later one is ``already_decided``."""
    first = actions.groupBy(key).agg(F.min_by(tie, F.struct(F.col(ts), F.col(tie))).alias("_first"))
    j = actions.join(first, key)
    codes = F.array(*[F.lit(c) for c in OVERRIDE_REASON_CODES])
    reason_blank = F.col("reason").isNull() | (F.trim(F.col("reason")) == "")
    code_blank = F.col("reason_code").isNull() | (F.col("reason_code") == "")
    err = (F.when(F.col(tie) != F.col("_first"), "already_decided")
           .when(~F.col("action").isin("accept", "override"), "invalid_action")
           .when((F.col("action") == "override") & reason_blank, "reason_required")
           .when((F.col("action") == "override") & code_blank, "reason_code_required")
           .when((F.col("action") == "override") & ~F.array_contains(codes, F.col("reason_code")),
                 "invalid_reason_code"))
    return j.withColumn("error_code", err).drop("_first").withColumn("valid", F.col("error_code").isNull())


def window_start(now: Column, days: int) -> Column:
    return now - F.make_interval(days=F.lit(days))


def ops_kpis(decisions: DataFrame, fairness_gap: DataFrame, now: Column, window_days: int = 7,
             p95_latency_s: float | None = None) -> DataFrame:
    """Trailing-window KPIs and alerts.  ``fairness_gap`` is a one-column
    frame of per-scheme max deltas (read-only monitor over all decisions)."""
    d = decisions.withColumn("_now", now).filter(F.col("created_at") >= window_start(F.col("_now"), window_days))
    act = F.col("underwriter_action")
    k = d.agg(F.count(F.lit(1)).alias("throughput_decisions"),
              F.count(act).alias("actioned"), F.count_if(act == "override").alias("overrides"),
              F.count_if(act == "accept").alias("accepts"),
              F.avg("estimated_cost_usd").alias("avg_cost"))
    gap = fairness_gap.agg(F.coalesce(F.max("max_delta_pp"), F.lit(0.0))).scalar()
    k = k.withColumn("fairness_gap_pp", gap)
    cost = F.coalesce(F.round(F.col("avg_cost"), 6), F.lit(0.0))
    acc = F.when(F.col("actioned") > 0, F.bround(F.col("accepts") / F.col("actioned"), 4))
    ovr = F.when(F.col("actioned") > 0, F.bround(F.col("overrides") / F.col("actioned"), 4))
    t = KPI_THRESHOLDS
    p95 = F.lit(p95_latency_s).cast("double")
    alerts = F.array_compact(F.array(
        F.when(p95 > t["p95_latency_s"], F.format_string("P95 latency %ss exceeds %ss", p95.cast("string"),
                                                          F.lit(str(t["p95_latency_s"])))),
        F.when(F.col("cost_per_app_usd") > t["cost_per_app_usd"],
               F.format_string("cost/app $%s exceeds $%s", F.col("cost_per_app_usd").cast("string"),
                               F.lit(str(t["cost_per_app_usd"])))),
        F.when(F.col("fairness_gap_pp") > t["fairness_gap_pp"],
               F.format_string("fairness gap %spp exceeds %spp", F.col("fairness_gap_pp").cast("string"),
                               F.lit(str(t["fairness_gap_pp"])))),
        F.when(F.col("acceptance_rate") < t["acceptance_rate_min"],
               F.format_string("acceptance rate %s%% below %s%%",
                               F.round(F.col("acceptance_rate") * 100, 0).cast("bigint").cast("string"),
                               F.lit(str(round(t["acceptance_rate_min"] * 100))))),
    ))
    out = k.select("throughput_decisions", F.lit(window_days).alias("window_days"), p95.alias("p95_latency_s"),
                   cost.alias("cost_per_app_usd"), acc.alias("acceptance_rate"), ovr.alias("override_rate"),
                   "fairness_gap_pp")
    out = out.withColumn("alerts", alerts)
    return out.withColumn("healthy", F.size("alerts") == 0)


def override_rate(decisions: DataFrame, now: Column, days: int = 7, action_ts: str = "underwriter_action_at") \
        -> DataFrame:
    """Actioned / overrides in the trailing window; 0.0 when nothing was actioned."""
    d = decisions.withColumn("_now", now).filter(
        F.col("underwriter_action").isNotNull() & (F.col(action_ts) >= window_start(F.col("_now"), days)))
    k = d.agg(F.count(F.lit(1)).alias("actioned_count"),
              F.count_if(F.col("underwriter_action") == "override").alias("override_count"))
    return k.select(F.lit(days).alias("window_days"), "actioned_count", "override_count",
                    F.when(F.col("actioned_count") > 0,
                           F.bround(F.col("override_count") / F.col("actioned_count"), 4))
                    .otherwise(F.lit(0.0)).alias("override_rate"))


def value_prefix(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Per (group, distinct value): cnt, rows below it in the group, group total.
    Range-partitioned two-level prefix: no group is sorted in a single task."""
    by = list(by or [])
    g = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
    g = g.repartitionByRange("v").withColumn("slice", F.spark_partition_id())
    ensure_checkpoint_dir(df.sparkSession)
    g = g.checkpoint(eager=True)          # one scan, stable slices for both passes
    win = Window.partitionBy(*by, "slice").orderBy("v")
    g = g.withColumns({"in_below": F.coalesce(F.sum("cnt").over(win.rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0)),
                       "s_cnt": F.sum("cnt").over(Window.partitionBy(*by, "slice"))})
    per = g.groupBy(*by, "slice").agg(F.first("s_cnt").alias("s_cnt"))
    ws = Window.partitionBy(*by).orderBy("slice")
    per = per.select(*by, "slice",
                     F.coalesce(F.sum("s_cnt").over(ws.rowsBetween(Window.unboundedPreceding, -1)),
                                F.lit(0)).alias("pre"),
                     F.sum("s_cnt").over(Window.partitionBy(*by)).alias("total"))
    out = g.join(F.broadcast(per), [*by, "slice"])
    return out.select(*by, "v", "cnt", (F.col("pre") + F.col("in_below")).alias("below"), "total")


def nearest_rank_percentiles(df: DataFrame, value: str, pcts: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact nearest-rank percentile, value at sorted index round(p/100 * (n-1))
    (half-even, clamped to n-1), for every requested p, per group."""
    by = list(by or [])
    vp = value_prefix(df, value, by)
    arr = F.array(*[F.lit(float(p)) for p in pcts])
    e = vp.select(*by, "v", "cnt", "below", "total", F.explode(arr).alias("pct"))
    idx = F.least(F.col("total") - 1, F.bround(F.col("pct") / 100.0 * (F.col("total") - 1), 0).cast("bigint"))
    hit = e.filter((F.col("below") <= idx) & (idx < F.col("below") + F.col("cnt")))
    return hit.select(*by, "pct", F.col("v").alias("value"), F.col("total").alias("n"))


def median_exact(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Exact median per group (mean of the two middle values for even n)."""
    by = list(by or [])
    vp = value_prefix(df, value, by)
    lo = F.floor((F.col("total") - 1) / 2).cast("bigint")
    hi = F.floor(F.col("total") / 2).cast("bigint")

    def covers(i):
        return (F.col("below") <= i) & (i < F.col("below") + F.col("cnt"))

    m = vp.groupBy(*by).agg(F.max(F.when(covers(lo), F.col("v"))).alias("lo_v"),
                            F.max(F.when(covers(hi), F.col("v"))).alias("hi_v"))
    return m.select(*by, ((F.col("lo_v") + F.col("hi_v")) / 2).alias("median"))


def pilot_summary(reviews: DataFrame, value: str = "review_min") -> DataFrame:
    """Acceptance rate (4 places), median review (1 place) and the override
    reasons ranked by count (ties by first appearance is not defined: by reason)."""
    k = reviews.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("action") == "accept").alias("accepts"))
    med = median_exact(reviews, value).select("median").scalar()
    # One entry per distinct reason code (a short, closed list): bounded.
    reasons = (reviews.filter(F.col("action") == "override").groupBy("reason_code").agg(F.count(F.lit(1)).alias("n"))
               .agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("neg_n"),
                                                             F.col("reason_code").isNull().alias("_null"),
                                                             F.col("reason_code"))))
                    .alias("r"))
               .select(F.transform("r", lambda s: F.struct(s["reason_code"].alias("reason_code"),
                                                           (-s["neg_n"]).alias("count")))).scalar())
    return k.select("total", F.bround(F.col("accepts") / F.col("total"), 4).alias("acceptance_rate"),
                    F.bround(med, 1).alias("median_review"), reasons.alias("override_reasons"))


# ------------------------------------------------------------ P1 / A29

REQUIRED_FIELDS = ["SK_ID_CURR", "AMT_INCOME_TOTAL", "AMT_CREDIT", "AMT_ANNUITY", "DAYS_EMPLOYED"]


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def normalize_application(raw: DataFrame) -> DataFrame:
    """Raw all-string rows -> profile.  Trimmed id (blank -> NULL), default
    scheme, blanks -> NULL, amounts as double, day counts as int(float(x)),
    required fields listed in order, COMPLETE / INCOMPLETE."""
    def s(name):
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    def nz(name):
        c = s(name)
        return F.when(c != "", c)

    missing = F.array_compact(F.array(*[F.when(_blank(s(f)), F.lit(f)) for f in REQUIRED_FIELDS]))
    num = {k: F.when(~_blank(s(f)), s(f).try_cast("double"))
           for f, k in [("AMT_INCOME_TOTAL", "amt_income_total"), ("AMT_CREDIT", "amt_credit"),
                        ("AMT_ANNUITY", "amt_annuity")]}
    days = {k: F.when(~_blank(s(f)), s(f).try_cast("double").cast("int"))
            for f, k in [("DAYS_EMPLOYED", "days_employed"), ("DAYS_BIRTH", "days_birth"),
                         ("REGION_RATING_CLIENT", "region_rating_client")]}
    out = raw.select(
        F.nullif(F.trim(F.coalesce(s("SK_ID_CURR"), F.lit(""))), F.lit("")).alias("external_id"),
        nz("NAME_CONTRACT_TYPE").alias("name_contract_type"),
        F.coalesce(nz("loan_scheme"), F.lit("Personal Loan")).alias("loan_scheme"),
        nz("NAME_EDUCATION_TYPE").alias("name_education_type"),
        nz("NAME_FAMILY_STATUS").alias("name_family_status"),
        nz("OCCUPATION_TYPE").alias("occupation_type"), nz("CODE_GENDER").alias("code_gender"),
        *[v.alias(k) for k, v in num.items()], *[v.alias(k) for k, v in days.items()],
        missing.alias("_missing"),
        F.to_json(F.struct(*[F.col(c) for c in raw.columns]), {"ignoreNullFields": "false"}).alias("raw_row_json"))
    return out.select("*", F.when(F.size("_missing") > 0, "INCOMPLETE").otherwise("COMPLETE").alias("status"),
                      F.when(F.size("_missing") > 0, F.array_join("_missing", ",")).alias("missing_fields")) \
        .drop("_missing")


def missing_profile(profiles: DataFrame) -> DataFrame:
    """Incomplete share of a load and how often each field is missing."""
    total = profiles.agg(F.count(F.lit(1)).alias("n_rows"),
                         F.count_if(F.col("status") == "INCOMPLETE").alias("n_incomplete"))
    fields = (profiles.filter(F.col("missing_fields").isNotNull())
              .select(F.explode(F.split("missing_fields", ",")).alias("field"))
              .groupBy("field").agg(F.count(F.lit(1)).alias("n_missing")))
    n_rows = total.select("n_rows").scalar()
    n_inc = total.select("n_incomplete").scalar()
    return fields.select("field", "n_missing", n_rows.alias("n_rows"), n_inc.alias("n_incomplete"),
                         F.round(n_inc / n_rows, 6).alias("incomplete_share"))
