"""Queries for the row-level scorers: F2, P13, W11, F3, P10-P15, P17."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from .catalog import register
from .views import cte

_APPS = cte("v_applications")

# Oracle forms of the rule score (independent SQL text of the same formula).
_ORACLE_SCORE = """
scored AS (
  SELECT *, CASE WHEN amt_income_total > 0 AND amt_credit IS NOT NULL AND amt_annuity IS NOT NULL
                  AND days_employed IS NOT NULL THEN 1 ELSE 0 END AS ok,
    0.45 * greatest(0.0, least(1.0, amt_annuity / amt_income_total / 0.5)) AS c_dti,
    0.35 * greatest(0.0, least(1.0, amt_credit / amt_income_total / 6.0)) AS c_lti,
    0.20 * greatest(0.0, least(1.0, 1 - (CASE WHEN days_employed IS NULL OR days_employed >= 0 THEN 0.0
                                         ELSE abs(days_employed) / 365.25 END) / 5.0)) AS c_ten
  FROM v_applications),
banded AS (
  SELECT *, CASE WHEN ok = 1 THEN round_even(greatest(0.0, least(1.0, c_dti + c_lti + c_ten)), 4) END AS risk_score
  FROM scored),
final AS (
  SELECT *, CASE WHEN risk_score IS NULL THEN NULL WHEN risk_score < 0.33 THEN 'Low'
                 WHEN risk_score < 0.66 THEN 'Medium' ELSE 'High' END AS risk_band FROM banded)
"""


@register("F2_rule_score", _APPS + "," + _ORACLE_SCORE + """
SELECT application_id, loan_scheme, risk_score, risk_band FROM final""")
def rule_score_per_application(t):
    """F2 + P13: rule score and band of every application."""
    apps = t.view("v_applications")
    return S.with_rule_score(apps).select("application_id", "loan_scheme", "risk_score", "risk_band")


@register("F2_rule_score_by_scheme", _APPS + "," + _ORACLE_SCORE + """
SELECT loan_scheme, risk_band, count(*) AS n_applications, round(avg(risk_score), 6) AS mean_score
FROM final GROUP BY loan_scheme, risk_band""")
def rule_score_by_scheme(t):
    """Flagship: rule-score every application, count and mean score per (scheme, band)."""
    apps = S.with_rule_score(t.view("v_applications"))
    return (apps.groupBy("loan_scheme", "risk_band")
            .agg(F.count(F.lit(1)).alias("n_applications"),
                 F.round(F.avg("risk_score"), 6).alias("mean_score")))
