"""Queries for fairness: J4, A13-A18, J7, D8."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fairness as FA
from .catalog import register, rounded
from .views import cte

_DA = cte("v_decisions", "v_applications")

_J4_SQL = """j4 AS (
  SELECT d.decision_id, d.application_id, coalesce(nullif(a.loan_scheme, ''), 'Personal Loan') AS scheme,
    d.recommendation, a.code_gender,
    CASE WHEN a.days_birth IS NULL THEN NULL WHEN abs(a.days_birth) / 365.25 < 30 THEN 'under_30'
         WHEN abs(a.days_birth) / 365.25 < 45 THEN '30_44' WHEN abs(a.days_birth) / 365.25 < 60 THEN '45_59'
         ELSE '60_plus' END AS age_band,
    a.name_education_type, a.name_family_status, a.region_rating_client
  FROM v_decisions d JOIN v_applications a ON d.application_id = a.application_id)
"""

_SEG_SQL = _J4_SQL + """,
long AS (
  SELECT scheme, recommendation, 'code_gender' AS attribute, 0 AS pos, CAST(code_gender AS VARCHAR) AS subgroup FROM j4
  UNION ALL SELECT scheme, recommendation, 'age_band', 1, age_band FROM j4
  UNION ALL SELECT scheme, recommendation, 'name_education_type', 2, name_education_type FROM j4
  UNION ALL SELECT scheme, recommendation, 'name_family_status', 3, name_family_status FROM j4
  UNION ALL SELECT scheme, recommendation, 'region_rating_client', 4, CAST(region_rating_client AS VARCHAR) FROM j4),
rates AS (
  SELECT scheme, attribute, pos, subgroup, count(*) AS n,
    round_even(count_if(recommendation = 'Approve') / count(*), 4) AS approval_rate
  FROM long WHERE subgroup IS NOT NULL GROUP BY scheme, attribute, pos, subgroup HAVING count(*) >= 3),
deltas AS (
  SELECT scheme, attribute, pos AS attribute_pos, count(*) AS n_subgroups, min(approval_rate) AS min_rate,
    max(approval_rate) AS max_rate, round_even((max(approval_rate) - min(approval_rate)) * 100, 2) AS delta_pp
  FROM rates GROUP BY scheme, attribute, pos HAVING count(*) >= 2),
mon AS (
  SELECT c.scheme, c.decision_count, coalesce(w.max_delta_pp, 0.0) AS max_delta_pp,
    CASE WHEN coalesce(w.max_delta_pp, 0.0) > 0 THEN w.worst END AS worst_attribute
  FROM (SELECT scheme, count(*) AS decision_count FROM j4 GROUP BY scheme) c
  LEFT JOIN (SELECT scheme, max(delta_pp) AS max_delta_pp,
                    arg_min(attribute, (-delta_pp, attribute_pos)) AS worst FROM deltas GROUP BY scheme) w
    ON c.scheme = w.scheme)
"""


def _joined(t):
    return FA.decision_application_join(t.view("v_decisions"), t.view("v_applications"))


@register("J4_decision_application_join", _DA + ", " + _J4_SQL + "SELECT * FROM j4")
def j4(t):
    return rounded(_joined(t))


@register("A14_segment_delta", _DA + ", " + _SEG_SQL + "SELECT * FROM deltas")
def a14(t):
    """Approval-rate delta per scheme x attribute (subgroups n >= 3, >= 2 subgroups)."""
    return rounded(FA.segment_deltas(_joined(t)))


@register("A15_fairness_monitor", _DA + ", " + _SEG_SQL + """
SELECT scheme, decision_count, max_delta_pp, worst_attribute, max_delta_pp > 5.0 AS hard_block,
  CASE WHEN max_delta_pp > 5.0 THEN 'Fairness gap ' || CAST(max_delta_pp AS VARCHAR) || 'pp on '
       || worst_attribute || ' exceeds 5.0pp' END AS alert_reason,
  false AS already_paused, max_delta_pp > 5.0 AS newly_paused
FROM mon""")
def a15(t):
    """Per-scheme monitor; no pause is open before the run, enforcement on."""
    return rounded(FA.fairness_monitor(_joined(t)))


def _now(t):
    return t.view("v_decisions").agg(F.max("created_at")).scalar()


def _pauses(t):
    return FA.pauses_from_monitor(FA.fairness_monitor(_joined(t)), _now(t))


@register("J7_pause_semi", _DA + ", " + _SEG_SQL + """
SELECT a.application_id, a.loan_scheme, (m.scheme IS NOT NULL) AS scheme_paused
FROM v_applications a LEFT JOIN (SELECT scheme FROM mon WHERE max_delta_pp > 5.0) m ON a.loan_scheme = m.scheme""")
def j7(t):
    """Every application flagged when its scheme has an open pause (pauses = A15's new ones)."""
    apps = t.view("v_applications").select("application_id", "loan_scheme")
    return rounded(FA.pause_semi(apps, _pauses(t)))


@register("D8_pause_release", _DA + ", " + _SEG_SQL + """
SELECT scheme, alert_reason AS reason, max_delta_pp AS gap_pp,
  (scheme = 'Personal Loan') AS released_now,
  CASE WHEN scheme = 'Personal Loan' THEN (SELECT max(created_at) FROM v_decisions) END AS released_at
FROM (SELECT *, 'Fairness gap ' || CAST(max_delta_pp AS VARCHAR) || 'pp on ' || worst_attribute
        || ' exceeds 5.0pp' AS alert_reason FROM mon WHERE max_delta_pp > 5.0) p""")
def d8(t):
    """Release the open Personal Loan pause in the pause table A15 produced."""
    p = FA.pause_release(_pauses(t), "Personal Loan", _now(t))
    return rounded(p.select("scheme", "reason", "gap_pp", "released_now", "released_at"))


@register("A13_group_fairness_audit", cte("v_predictions") + """,
long AS (SELECT y_true, CAST(y_prob >= 0.66 AS INTEGER) AS pred, 'CODE_GENDER' AS attribute, code_gender AS subgroup
         FROM v_predictions
         UNION ALL SELECT y_true, CAST(y_prob >= 0.66 AS INTEGER), 'NAME_EDUCATION_TYPE', name_education_type
         FROM v_predictions),
g AS (SELECT attribute, subgroup, count(*) AS n, count_if(pred = 1) AS hr,
        count_if(y_true = 1 AND pred = 1) AS tp, count_if(y_true <> 1 AND pred = 1) AS fp,
        count_if(y_true = 1 AND pred = 0) AS fn, count_if(y_true <> 1 AND pred = 0) AS tn
      FROM long WHERE subgroup IS NOT NULL GROUP BY attribute, subgroup HAVING count(*) >= 10)
SELECT attribute, subgroup, n AS sample_size, round_even((n - hr) / n, 4) AS approval_rate,
  round_even(hr / n, 4) AS high_risk_rate,
  round_even(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision,
  round_even(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall,
  round_even(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 4) AS false_positive_rate,
  round_even(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0.0 END, 4) AS false_negative_rate
FROM g""")
def a13(t):
    """A13 at the balanced 0.66 threshold; income type and region are absent from
    the prediction rows, so those attributes are skipped."""
    p = t.view("v_predictions").select("y_true", "y_prob", F.col("code_gender").alias("CODE_GENDER"),
                                       F.col("name_education_type").alias("NAME_EDUCATION_TYPE"))
    return rounded(FA.group_fairness_audit(p))


# Oracle: chi-square over the full level grid (absent cells count with O = 0).
_CV_SQL = """cells AS (SELECT a, b, count(*) AS o FROM src WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY a, b),
ra AS (SELECT a, sum(o) AS r_i FROM cells GROUP BY a), cb AS (SELECT b, sum(o) AS c_j FROM cells GROUP BY b),
tot AS (SELECT sum(o) AS n, (SELECT count(*) FROM ra) AS r, (SELECT count(*) FROM cb) AS k FROM cells),
grid AS (SELECT ra.a, cb.b, r_i * c_j / (SELECT n FROM tot) AS e, coalesce(cells.o, 0) AS o
         FROM ra CROSS JOIN cb LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b),
chi AS (SELECT sum((o - e) * (o - e) / e) AS chi2 FROM grid),
cv AS (SELECT CASE WHEN r < 2 OR k < 2 THEN 0.0 ELSE
         CASE WHEN least(k - (k - 1) * (k - 1) / (n - 1.0), r - (r - 1) * (r - 1) / (n - 1.0)) - 1 > 0
              THEN sqrt(greatest(0.0, chi2 / n - (k - 1) * (r - 1) / (n - 1.0))
                        / (least(k - (k - 1) * (k - 1) / (n - 1.0), r - (r - 1) * (r - 1) / (n - 1.0)) - 1))
              ELSE 0.0 END END AS v FROM tot, chi)
"""

_ETA_SQL = """ev AS (SELECT c, x FROM esrc WHERE c IS NOT NULL AND x IS NOT NULL),
gm AS (SELECT avg(x) AS m FROM ev),
eta AS (SELECT CASE WHEN sst > 0 THEN sqrt(ssb / sst) ELSE 0.0 END AS e FROM
  (SELECT (SELECT sum((x - m) * (x - m)) FROM ev, gm) AS sst,
          (SELECT sum(n * (gmean - m) * (gmean - m)) FROM (SELECT c, count(*) AS n, avg(x) AS gmean FROM ev GROUP BY c) g, gm)
            AS ssb))
"""


@register("A16_cramers_v", cte("v_applications") + """,
src AS (SELECT occupation_type AS a, code_gender AS b FROM v_applications), """ + _CV_SQL + """
SELECT round(v, 6) AS cramers_v FROM cv""")
def a16(t):
    """Cramer's V of occupation vs gender over all applications."""
    return rounded(FA.cramers_v(t.view("v_applications"), "occupation_type", "code_gender"))


@register("A17_correlation_ratio", cte("v_applications") + """,
esrc AS (SELECT occupation_type AS c, abs(days_birth) / 365.25 AS x FROM v_applications), """ + _ETA_SQL + """
SELECT round(e, 6) AS corr_ratio FROM eta""")
def a17(t):
    """Correlation ratio of occupation vs age in years."""
    a = t.view("v_applications").withColumn("age", F.abs(F.col("days_birth")) / F.lit(365.25))
    return rounded(FA.correlation_ratio(a, "occupation_type", "age"))


def _proxy_sql(proxy: str, col: str) -> str:
    return f"""SELECT '{proxy}' AS proxy_feature, cramers_v_vs_gender, corr_ratio_vs_age,
  greatest(cv_raw, eta_raw) >= 0.20 AS material_leakage FROM (
  WITH src AS (SELECT CAST({col} AS VARCHAR) AS a, code_gender AS b FROM v_applications),
  esrc AS (SELECT CAST({col} AS VARCHAR) AS c, abs(days_birth) / 365.25 AS x FROM v_applications),
  {_CV_SQL}, {_ETA_SQL}
  SELECT round_even(v, 4) AS cramers_v_vs_gender, round_even(e, 4) AS corr_ratio_vs_age, v AS cv_raw, e AS eta_raw
  FROM cv, eta) q"""


@register("A18_proxy_leakage_report", cte("v_applications") + _proxy_sql("OCCUPATION_TYPE", "occupation_type")
          + "\nUNION ALL\n" + _proxy_sql("REGION_RATING_CLIENT", "region_rating_client"))
def a18(t):
    a = t.view("v_applications").select(
        F.col("occupation_type").alias("OCCUPATION_TYPE"), F.col("region_rating_client").alias("REGION_RATING_CLIENT"),
        F.col("code_gender").alias("CODE_GENDER"), F.col("days_birth").alias("DAYS_BIRTH"))
    return rounded(FA.proxy_leakage(a))
