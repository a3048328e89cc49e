"""Queries for operations reporting: W1, J9, W2, P16, P18, A22-A25, P1, A29."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fairness as FA
from ..operators import ops as OP
from .catalog import register, rounded
from .fairness import _SEG_SQL, _joined
from .views import cte

_D = cte("v_decisions")
_DA = cte("v_decisions", "v_applications")


@register("W1_latest_decision_status", _D + """
SELECT application_id, d.decision_id, d.recommendation, d.underwriter_action,
  CASE WHEN d.underwriter_action IS NULL THEN 'Pending'
       WHEN d.underwriter_action = 'accept' THEN CASE d.recommendation WHEN 'Approve' THEN 'Approved'
            WHEN 'Decline' THEN 'Denied' ELSE 'Pending' END
       ELSE CASE d.recommendation WHEN 'Approve' THEN 'Denied' WHEN 'Decline' THEN 'Approved' ELSE 'Pending' END
  END AS decision_status
FROM (SELECT application_id, arg_max({'decision_id': decision_id, 'recommendation': recommendation,
                                      'underwriter_action': underwriter_action}, (created_at, decision_id)) AS d
      FROM v_decisions GROUP BY application_id) x""")
def w1(t):
    d = t.view("v_decisions").select("application_id", "decision_id", "recommendation", "underwriter_action",
                                     "created_at")
    out = OP.latest_decision(d)
    return rounded(out.select("application_id", "decision_id", "recommendation", "underwriter_action",
                              "decision_status"))


@register("J9_applicant_status", _DA + """,
latest AS (SELECT application_id, arg_max({'r': recommendation, 'a': underwriter_action}, (created_at, decision_id))
             AS d FROM v_decisions GROUP BY application_id)
SELECT a.application_id, a.external_id, a.loan_scheme, a.amt_credit, a.amt_income_total,
  CASE WHEN l.application_id IS NULL OR l.d.a IS NULL THEN 'Pending'
       WHEN l.d.a = 'accept' THEN CASE l.d.r WHEN 'Approve' THEN 'Approved' WHEN 'Decline' THEN 'Denied'
            ELSE 'Pending' END
       ELSE CASE l.d.r WHEN 'Approve' THEN 'Denied' WHEN 'Decline' THEN 'Approved' ELSE 'Pending' END
  END AS decision_status
FROM v_applications a LEFT JOIN latest l ON a.application_id = l.application_id""")
def j9(t):
    apps = t.view("v_applications").select("application_id", "external_id", "loan_scheme", "amt_credit",
                                           "amt_income_total")
    d = t.view("v_decisions").select("application_id", "decision_id", "recommendation", "underwriter_action",
                                     "created_at")
    return rounded(OP.applicant_status(apps, d))


@register("W2_human_review_queue", _DA + """
SELECT d.decision_id, d.application_id, d.recommendation, a.loan_scheme, d.created_at
FROM v_decisions d LEFT JOIN v_applications a ON d.application_id = a.application_id
WHERE d.escalation_flag AND d.underwriter_action IS NULL""")
def w2(t):
    d = t.view("v_decisions")
    a = t.view("v_applications").select(F.col("application_id").alias("_aid"), "loan_scheme")
    q = OP.human_review_queue(d.join(a, d["application_id"] == a["_aid"], "left"))
    return rounded(q.select("decision_id", "application_id", "recommendation", "loan_scheme", "created_at"))


@register("P16_visibility_filter", cte("v_applications") + """
SELECT application_id, applicant_id, loan_scheme, created_at FROM v_applications""")
def p16(t):
    """P16 for a reviewer (sees every application, newest first)."""
    apps = t.view("v_applications").select("application_id", "applicant_id", "loan_scheme", "created_at")
    return rounded(OP.visible_applications(apps, None, is_ops=True))


@register("P16_visibility_own", cte("v_applications") + """
SELECT application_id, applicant_id, loan_scheme, created_at FROM v_applications
WHERE applicant_id = (SELECT max(applicant_id) FROM v_applications)""")
def p16_own(t):
    """P16 for an applicant (the one of the largest id): only their own applications."""
    apps = t.view("v_applications").select("application_id", "applicant_id", "loan_scheme", "created_at")
    viewer = apps.agg(F.max("applicant_id")).first()[0]
    return rounded(OP.visible_applications(apps, viewer, is_ops=False))


# Action feed derived from the decisions: assessment = application, the action
# is the underwriter action, reason and reason code follow the decision id.
_FEED_SQL = """feed AS (
  SELECT decision_id AS action_id, application_id AS assessment_id, created_at AS action_at,
    underwriter_action AS action, CASE WHEN decision_id % 3 = 0 THEN NULL ELSE 'reviewed' END AS reason,
    CASE decision_id % 9 WHEN 0 THEN 'compensating_factors' WHEN 1 THEN 'policy_exception_approved'
      WHEN 2 THEN 'additional_documentation' WHEN 3 THEN 'data_quality_issue' WHEN 4 THEN 'risk_appetite'
      WHEN 5 THEN 'regulatory_clarification' WHEN 6 THEN 'other' WHEN 7 THEN 'bogus' ELSE NULL END AS reason_code
  FROM v_decisions WHERE underwriter_action IS NOT NULL)
"""


def _feed(t):
    d = t.view("v_decisions").filter(F.col("underwriter_action").isNotNull())
    codes = OP.OVERRIDE_REASON_CODES + ["bogus"]
    code = F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("decision_id") % 9 + 1).cast("int"))
    return d.select(F.col("decision_id").alias("action_id"), F.col("application_id").alias("assessment_id"),
                    F.col("created_at").alias("action_at"), F.col("underwriter_action").alias("action"),
                    F.when(F.col("decision_id") % 3 != 0, F.lit("reviewed")).alias("reason"),
                    F.when(F.col("decision_id") % 9 != 8, code).alias("reason_code"))


@register("P18_override_validation", _D + ", " + _FEED_SQL + """,
first_ AS (SELECT assessment_id, arg_min(action_id, (action_at, action_id)) AS first_id FROM feed GROUP BY assessment_id)
SELECT f.* EXCLUDE (err), err AS error_code, err IS NULL AS valid FROM (
  SELECT f.*, CASE WHEN f.action_id <> fi.first_id THEN 'already_decided'
    WHEN f.action NOT IN ('accept', 'override') THEN 'invalid_action'
    WHEN f.action = 'override' AND (f.reason IS NULL OR trim(f.reason) = '') THEN 'reason_required'
    WHEN f.action = 'override' AND (f.reason_code IS NULL OR f.reason_code = '') THEN 'reason_code_required'
    WHEN f.action = 'override' AND f.reason_code NOT IN ('compensating_factors', 'policy_exception_approved',
      'additional_documentation', 'data_quality_issue', 'risk_appetite', 'regulatory_clarification', 'other')
      THEN 'invalid_reason_code' END AS err
  FROM feed f JOIN first_ fi ON f.assessment_id = fi.assessment_id) f""")
def p18(t):
    return rounded(OP.validate_actions(_feed(t)))


def _now(t):
    return t.view("v_decisions").agg(F.max("created_at")).scalar()


@register("A22_ops_kpis", _DA + ", " + _SEG_SQL + """,
w AS (SELECT * FROM v_decisions WHERE created_at >= (SELECT max(created_at) FROM v_decisions) - INTERVAL 7 DAY),
k AS (SELECT count(*) AS n, count(underwriter_action) AS actioned, count_if(underwriter_action = 'override') AS ovr,
        count_if(underwriter_action = 'accept') AS acc, avg(estimated_cost_usd) AS avg_cost FROM w),
kk AS (SELECT n AS throughput_decisions, CAST(7 AS BIGINT) AS window_days, CAST(NULL AS DOUBLE) AS p95_latency_s,
         coalesce(round(avg_cost, 6), 0.0) AS cost_per_app_usd,
         CASE WHEN actioned > 0 THEN round_even(acc / actioned, 4) END AS acceptance_rate,
         CASE WHEN actioned > 0 THEN round_even(ovr / actioned, 4) END AS override_rate,
         (SELECT coalesce(max(max_delta_pp), 0.0) FROM mon) AS fairness_gap_pp FROM k)
SELECT *, len(alerts) = 0 AS healthy FROM (
  SELECT *, list_filter([
    CASE WHEN cost_per_app_usd > 0.08 THEN 'cost/app $' || CAST(cost_per_app_usd AS VARCHAR) || ' exceeds $0.08' END,
    CASE WHEN fairness_gap_pp > 5.0 THEN 'fairness gap ' || CAST(fairness_gap_pp AS VARCHAR) || 'pp exceeds 5.0pp' END,
    CASE WHEN acceptance_rate < 0.75 THEN 'acceptance rate ' || CAST(CAST(round(acceptance_rate * 100) AS BIGINT)
      AS VARCHAR) || '% below 75%' END], lambda x: x IS NOT NULL) AS alerts FROM kk) z""")
def a22(t):
    """A22 over the trailing 7 days before the newest decision; gap from the read-only monitor."""
    mon = FA.fairness_monitor(_joined(t), enforce=False)
    return rounded(OP.ops_kpis(t.view("v_decisions"), mon, _now(t)))


@register("A23_override_rate", _D + """
SELECT CAST(7 AS BIGINT) AS window_days, count(*) AS actioned_count,
  count_if(underwriter_action = 'override') AS override_count,
  CASE WHEN count(*) > 0 THEN round_even(count_if(underwriter_action = 'override') / count(*), 4) ELSE 0.0 END
    AS override_rate
FROM v_decisions WHERE underwriter_action IS NOT NULL
  AND created_at >= (SELECT max(created_at) FROM v_decisions) - INTERVAL 7 DAY""")
def a23(t):
    """A23 with the decision time standing in for the action time."""
    d = t.view("v_decisions").withColumn("underwriter_action_at", F.col("created_at"))
    return rounded(OP.override_rate(d, _now(t)))


_PCTS = [50.0, 95.0, 99.0]


@register("A24_latency_percentile", _D + """,
s AS (SELECT recommendation, estimated_cost_usd AS v,
        row_number() OVER (PARTITION BY recommendation ORDER BY estimated_cost_usd) - 1 AS idx,
        count(*) OVER (PARTITION BY recommendation) AS n
      FROM v_decisions WHERE estimated_cost_usd IS NOT NULL),
p AS (SELECT * FROM (VALUES (50.0), (95.0), (99.0)) AS t(pct))
SELECT s.recommendation, CAST(p.pct AS DOUBLE) AS pct, s.v AS value, s.n
FROM s JOIN p ON s.idx = least(s.n - 1, CAST(round_even(p.pct / 100.0 * (s.n - 1), 0) AS BIGINT))""")
def a24(t):
    """Exact nearest-rank p50/p95/p99 of the per-decision cost, per recommendation."""
    d = t.view("v_decisions")
    return rounded(OP.nearest_rank_percentiles(d, "estimated_cost_usd", _PCTS, by=["recommendation"]))


@register("A25_pilot_summary", _D + ", " + _FEED_SQL + """,
rv AS (SELECT action, reason_code, a.estimated_cost_usd * 100 AS review_min FROM feed
       JOIN v_decisions a ON a.decision_id = feed.action_id),
reasons AS (SELECT list({'reason_code': reason_code, 'count': n} ORDER BY n DESC, reason_code) AS override_reasons
            FROM (SELECT reason_code, count(*) AS n FROM rv WHERE action = 'override' GROUP BY reason_code) r)
SELECT count(*) AS total, round_even(count_if(action = 'accept') / count(*), 4) AS acceptance_rate,
  round_even(median(review_min), 1) AS median_review, (SELECT override_reasons FROM reasons) AS override_reasons
FROM rv""")
def a25(t):
    """A25 over the actioned decisions: review time stands in as cost x 100."""
    f = _feed(t).join(t.view("v_decisions").select(F.col("decision_id").alias("action_id"), "estimated_cost_usd"),
                      "action_id")
    f = f.withColumn("review_min", F.col("estimated_cost_usd") * 100)
    return rounded(OP.pilot_summary(f))


_RAW_SQL = """raw AS (
  SELECT coalesce(external_id, '') AS SK_ID_CURR, coalesce(CAST(CAST(amt_income_total AS DECIMAL(18, 2)) AS VARCHAR), '')
      AS AMT_INCOME_TOTAL,
    coalesce(CAST(CAST(amt_credit AS DECIMAL(18, 2)) AS VARCHAR), '') AS AMT_CREDIT,
    coalesce(CAST(CAST(amt_annuity AS DECIMAL(18, 2)) AS VARCHAR), '') AS AMT_ANNUITY,
    coalesce(CAST(days_employed AS VARCHAR), '') AS DAYS_EMPLOYED, coalesce(CAST(days_birth AS VARCHAR), '') AS DAYS_BIRTH,
    coalesce(code_gender, '') AS CODE_GENDER, coalesce(name_education_type, '') AS NAME_EDUCATION_TYPE,
    coalesce(name_family_status, '') AS NAME_FAMILY_STATUS,
    coalesce(CAST(region_rating_client AS VARCHAR), '') AS REGION_RATING_CLIENT,
    coalesce(occupation_type, '') AS OCCUPATION_TYPE, loan_scheme
  FROM v_applications)
"""

_P1_SQL = _RAW_SQL + """,
norm AS (
  SELECT nullif(trim(SK_ID_CURR), '') AS external_id, nullif(loan_scheme, '') AS lsch,
    nullif(NAME_EDUCATION_TYPE, '') AS name_education_type, nullif(NAME_FAMILY_STATUS, '') AS name_family_status,
    nullif(OCCUPATION_TYPE, '') AS occupation_type, nullif(CODE_GENDER, '') AS code_gender,
    CASE WHEN trim(AMT_INCOME_TOTAL) <> '' THEN TRY_CAST(AMT_INCOME_TOTAL AS DOUBLE) END AS amt_income_total,
    CASE WHEN trim(AMT_CREDIT) <> '' THEN TRY_CAST(AMT_CREDIT AS DOUBLE) END AS amt_credit,
    CASE WHEN trim(AMT_ANNUITY) <> '' THEN TRY_CAST(AMT_ANNUITY AS DOUBLE) END AS amt_annuity,
    CASE WHEN trim(DAYS_EMPLOYED) <> '' THEN CAST(trunc(TRY_CAST(DAYS_EMPLOYED AS DOUBLE)) AS INTEGER) END AS days_employed,
    CASE WHEN trim(DAYS_BIRTH) <> '' THEN CAST(trunc(TRY_CAST(DAYS_BIRTH AS DOUBLE)) AS INTEGER) END AS days_birth,
    CASE WHEN trim(REGION_RATING_CLIENT) <> '' THEN CAST(trunc(TRY_CAST(REGION_RATING_CLIENT AS DOUBLE)) AS INTEGER) END
      AS region_rating_client,
    list_filter([CASE WHEN trim(SK_ID_CURR) = '' THEN 'SK_ID_CURR' END,
                 CASE WHEN trim(AMT_INCOME_TOTAL) = '' THEN 'AMT_INCOME_TOTAL' END,
                 CASE WHEN trim(AMT_CREDIT) = '' THEN 'AMT_CREDIT' END,
                 CASE WHEN trim(AMT_ANNUITY) = '' THEN 'AMT_ANNUITY' END,
                 CASE WHEN trim(DAYS_EMPLOYED) = '' THEN 'DAYS_EMPLOYED' END], lambda x: x IS NOT NULL) AS miss
  FROM raw),
prof AS (
  SELECT external_id, coalesce(lsch, 'Personal Loan') AS loan_scheme, name_education_type, name_family_status,
    occupation_type, code_gender, amt_income_total, amt_credit, amt_annuity, days_employed, days_birth,
    region_rating_client, CASE WHEN len(miss) > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status,
    CASE WHEN len(miss) > 0 THEN array_to_string(miss, ',') END AS missing_fields
  FROM norm)
"""


def _raw(t):
    a = t.view("v_applications")

    def dec(c):
        return F.coalesce(F.col(c).cast("decimal(18,2)").cast("string"), F.lit(""))

    def s(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return a.select(s("external_id").alias("SK_ID_CURR"), dec("amt_income_total").alias("AMT_INCOME_TOTAL"),
                    dec("amt_credit").alias("AMT_CREDIT"), dec("amt_annuity").alias("AMT_ANNUITY"),
                    s("days_employed").alias("DAYS_EMPLOYED"), s("days_birth").alias("DAYS_BIRTH"),
                    s("code_gender").alias("CODE_GENDER"), s("name_education_type").alias("NAME_EDUCATION_TYPE"),
                    s("name_family_status").alias("NAME_FAMILY_STATUS"),
                    s("region_rating_client").alias("REGION_RATING_CLIENT"),
                    s("occupation_type").alias("OCCUPATION_TYPE"), "loan_scheme")


_P1_COLS = ["external_id", "loan_scheme", "name_education_type", "name_family_status", "occupation_type",
            "code_gender", "amt_income_total", "amt_credit", "amt_annuity", "days_employed", "days_birth",
            "region_rating_client", "status", "missing_fields"]


@register("P1_normalize_application", cte("v_applications") + ", " + _P1_SQL + "SELECT * FROM prof")
def p1(t):
    """P1 over every application rendered as a raw all-string row (blank = missing)."""
    return rounded(OP.normalize_application(_raw(t)).select(*_P1_COLS))


@register("A29_missing_profile", cte("v_applications") + ", " + _P1_SQL + """
SELECT field, count(*) AS n_missing, (SELECT count(*) FROM prof) AS n_rows,
  (SELECT count_if(status = 'INCOMPLETE') FROM prof) AS n_incomplete,
  round((SELECT count_if(status = 'INCOMPLETE') FROM prof) / (SELECT count(*) FROM prof), 6) AS incomplete_share
FROM (SELECT unnest(string_split(missing_fields, ',')) AS field FROM prof WHERE missing_fields IS NOT NULL) f
GROUP BY field""")
def a29(t):
    return rounded(OP.missing_profile(OP.normalize_application(_raw(t))))
