"""Queries for model evaluation: A6-A12, P12, P14, P15, P17, W4-W6, W8, M9."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..operators import evaluate as EV
from .catalog import register, rounded
from .views import cte

_PRED = cte("v_predictions")


def _lit(t: float) -> str:
    return f"CAST('{t!r}' AS DOUBLE)"


def _grid_sql(ths: list[float]) -> str:
    return "(VALUES " + ", ".join(f"({i + 1}, {_lit(t)})" for i, t in enumerate(ths)) + ") AS g(k, threshold)"


def _metrics_sql(tp="tp", fp="fp", fn="fn", tn="tn") -> str:
    def d(n, den):
        return f"round(CASE WHEN ({den}) > 0 THEN CAST({n} AS DOUBLE) / ({den}) ELSE 0.0 END, 6)"
    return ", ".join([
        f"{d(f'{tp} + {tn}', f'{tp} + {fp} + {fn} + {tn}')} AS accuracy",
        f"{d(tp, f'{tp} + {fp}')} AS precision", f"{d(tp, f'{tp} + {fn}')} AS recall",
        f"{d(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1_score",
        f"{d(tn, f'{tn} + {fp}')} AS specificity", f"{d(fp, f'{tn} + {fp}')} AS false_positive_rate",
        f"{d(fn, f'{fn} + {tp}')} AS false_negative_rate",
        f"CAST({fn} * 15000 + {fp} * 1500 AS DOUBLE) AS estimated_business_loss"])


def _sweep_sql(ths: list[float]) -> str:
    """Brute-force sweep (every threshold x every row) as the oracle."""
    return f"""sweep AS (
  SELECT k, threshold, tp, fp, fn, tn, {_metrics_sql()} FROM (
    SELECT g.k, g.threshold,
      CAST(count_if(p.y_true = 1 AND p.y_prob >= g.threshold) AS BIGINT) AS tp,
      CAST(count_if(p.y_true <> 1 AND p.y_prob >= g.threshold) AS BIGINT) AS fp,
      CAST(count_if(p.y_true = 1 AND p.y_prob < g.threshold) AS BIGINT) AS fn,
      CAST(count_if(p.y_true <> 1 AND p.y_prob < g.threshold) AS BIGINT) AS tn
    FROM {_grid_sql(ths)} CROSS JOIN v_predictions p GROUP BY g.k, g.threshold) c)
"""


@register("A6_confusion_metrics", _PRED + f"""
SELECT tp, fp, fn, tn, {_metrics_sql()} FROM (
  SELECT count_if(y_true = 1 AND y_prob >= 0.5) AS tp, count_if(y_true <> 1 AND y_prob >= 0.5) AS fp,
         count_if(y_true = 1 AND y_prob < 0.5) AS fn, count_if(y_true <> 1 AND y_prob < 0.5) AS tn
  FROM v_predictions) c""")
def a6(t):
    """A6 + A11 at the default 0.5 cut-off."""
    return rounded(EV.confusion_metrics(t.view("v_predictions"), threshold=0.5))


_AUC_SQL = _PRED + """,
c AS (SELECT y_prob AS s, count_if(y_true = 1) AS pos, count(*) AS n FROM v_predictions
      WHERE y_prob IS NOT NULL GROUP BY y_prob),
r AS (SELECT s, pos, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS below, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_ge,
        sum(n) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_ge FROM c),
t AS (SELECT sum(pos) AS tot_p, sum(n) - sum(pos) AS tot_n FROM c)
"""


@register("A7_roc_auc", _AUC_SQL + """
SELECT round((sum(pos * (below + (n + 1) / 2.0)) - max(tot_p) * (max(tot_p) + 1) / 2.0) / (max(tot_p) * max(tot_n)), 6) AS roc_auc,
  CAST(max(tot_p) AS BIGINT) AS n_pos, CAST(max(tot_n) AS BIGINT) AS n_neg
FROM r, t""")
def a7(t):
    """Exact rank-statistic AUC (ties count one half)."""
    return rounded(EV.roc_auc(t.view("v_predictions")).select("roc_auc", "n_pos", "n_neg"))


@register("A8_average_precision", _AUC_SQL + """
SELECT round(sum(CASE WHEN pos > 0 THEN pos * (CAST(tp_ge AS DOUBLE) / n_ge) END) / max(tot_p), 6) AS average_precision
FROM r, t""")
def a8(t):
    """Step-wise average precision, sum of (delta recall x precision)."""
    return rounded(EV.roc_auc(t.view("v_predictions")).select("average_precision"))


@register("A9_roc_pr_points", _AUC_SQL + """
SELECT s AS threshold, CAST(tp_ge AS BIGINT) AS tp, CAST(n_ge - tp_ge AS BIGINT) AS fp,
  round(CAST(tp_ge AS DOUBLE) / tot_p, 6) AS tpr, round(CAST(n_ge - tp_ge AS DOUBLE) / tot_n, 6) AS fpr,
  round(CAST(tp_ge AS DOUBLE) / n_ge, 6) AS precision, round(CAST(tp_ge AS DOUBLE) / tot_p, 6) AS recall
FROM r, t""")
def a9(t):
    return rounded(EV.curve_points(t.view("v_predictions")))


_G81 = EV.sweep_grid_rounded()
_G76 = EV.sweep_grid_raw()
_G91 = EV.best_f1_grid()


@register("A10_threshold_sweep", _PRED + ", " + _sweep_sql(_G81) + "SELECT * FROM sweep")
def a10(t):
    """A10: 81 thresholds 0.10..0.90 in one pass."""
    return rounded(EV.threshold_sweep(t.view("v_predictions"), _G81))


@register("A11_business_loss_sweep", _PRED + ", " + _sweep_sql(_G76) + "SELECT * FROM sweep")
def a11(t):
    """76 raw thresholds 0.05..0.80 with fpr, fnr and business loss."""
    return rounded(EV.threshold_sweep(t.view("v_predictions"), _G76))


@register("A12_class_distribution", _PRED + """
SELECT CAST(y_true AS BIGINT) AS target, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS pct,
  min(count(*)) OVER () / sum(count(*)) OVER () < 0.15 AS is_imbalanced
FROM v_predictions GROUP BY y_true""")
def a12(t):
    return rounded(EV.class_distribution(t.view("v_predictions")))


_POLICY_COLS = "k, threshold, tp, fp, fn, tn, accuracy, precision, recall, f1_score, specificity, " \
               "false_positive_rate, false_negative_rate, estimated_business_loss"


@register("W4_threshold_policies", _PRED + ", " + _sweep_sql(_G81) + f"""
SELECT * FROM (SELECT 'balanced' AS policy, {_POLICY_COLS} FROM sweep ORDER BY f1_score DESC, k LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'conservative', {_POLICY_COLS} FROM sweep
  ORDER BY CASE WHEN EXISTS (SELECT 1 FROM sweep WHERE recall >= 0.85) THEN (recall >= 0.85)::INT ELSE 0 END DESC,
           CASE WHEN EXISTS (SELECT 1 FROM sweep WHERE recall >= 0.85) THEN k ELSE 0 END DESC, recall DESC, k
  LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'revenue_friendly', {_POLICY_COLS} FROM sweep
  ORDER BY abs(recall - 0.25), k LIMIT 1)""")
def w4(t):
    """W4 over the A10 sweep (policy values are taken from the unrounded sweep)."""
    return rounded(EV.threshold_policies(EV.threshold_sweep(t.view("v_predictions"), _G81)))


@register("W5_loss_policies", _PRED + ", " + _sweep_sql(_G76) + f""",
hr AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM sweep WHERE recall >= 0.75) THEN 0.75
                   WHEN EXISTS (SELECT 1 FROM sweep WHERE recall >= 0.70) THEN 0.70 END AS floor_)
SELECT * FROM (SELECT 'max_f1' AS policy, {_POLICY_COLS} FROM sweep ORDER BY f1_score DESC, k LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'min_loss', {_POLICY_COLS} FROM sweep ORDER BY estimated_business_loss, k LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'high_recall', {_POLICY_COLS} FROM sweep, hr
  WHERE hr.floor_ IS NULL OR recall >= hr.floor_
  ORDER BY CASE WHEN hr.floor_ IS NULL THEN -recall ELSE estimated_business_loss END, k LIMIT 1)""")
def w5(t):
    return rounded(EV.loss_policies(EV.threshold_sweep(t.view("v_predictions"), _G76)))


@register("W6_best_f1_threshold", _PRED + ", " + _sweep_sql(_G91) + """
SELECT CASE WHEN f1_score > 0 THEN threshold ELSE 0.5 END AS threshold,
       CASE WHEN f1_score > 0 THEN f1_score ELSE 0.0 END AS f1_score
FROM (SELECT * FROM sweep ORDER BY f1_score DESC, k LIMIT 1) b""")
def w6(t):
    return rounded(EV.best_f1_threshold(EV.threshold_sweep(t.view("v_predictions"), _G91)))


_POLICY_TH = EV.NAMED_POLICIES


@register("P15_threshold_class", _PRED + f"""
SELECT l_orderkey, l_linenumber, y_prob, credit_score, risk_band, decision_support,
  CAST(y_prob >= {_POLICY_TH['conservative']} AS BIGINT) AS pred_conservative,
  CAST(y_prob >= {_POLICY_TH['balanced']} AS BIGINT) AS pred_balanced,
  CAST(y_prob >= {_POLICY_TH['revenue_friendly']} AS BIGINT) AS pred_revenue_friendly
FROM (SELECT *, CAST(round_even(850.0 - y_prob * 550.0, 0) AS BIGINT) AS credit_score,
        CASE WHEN y_prob < 0.36 THEN 'LOW' WHEN y_prob < 0.66 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_band,
        CASE WHEN y_prob < 0.36 THEN 'Eligible for approval if policy checks pass'
             WHEN y_prob < 0.66 THEN 'Refer to human underwriter'
             ELSE 'High risk; refer to human underwriter with decline consideration' END AS decision_support
      FROM v_predictions) p""")
def p15(t):
    """P12 + P14 + P15 + P17: band, 300-850 score, class at the three named policies, guidance."""
    p = t.view("v_predictions")
    band = S.model_band(F.col("y_prob"))
    out = p.select("l_orderkey", "l_linenumber", "y_prob", S.credit_score(F.col("y_prob")).alias("credit_score"),
                   band.alias("risk_band"), S.decision_support(band).alias("decision_support"),
                   *[S.threshold_class(F.col("y_prob"), th).alias(f"pred_{n}") for n, th in _POLICY_TH.items()])
    return rounded(out)


# Three scorers over the same rows form the metrics table that W8 and M9 rank and compare.
_MODELS_SQL = """models AS (
  SELECT 'blend' AS model, y_true, y_prob AS p FROM v_predictions
  UNION ALL SELECT 'inverse', y_true, 1.0 - y_prob FROM v_predictions
  UNION ALL SELECT 'line_shift', y_true, CAST(0.5 AS DOUBLE) * y_prob + CAST(0.5 AS DOUBLE) * (l_linenumber / CAST(7.0 AS DOUBLE)) FROM v_predictions),
mc AS (SELECT model, p AS s, count_if(y_true = 1) AS pos, count(*) AS n FROM models GROUP BY model, p),
mr AS (SELECT model, s, pos, n, coalesce(sum(n) OVER (PARTITION BY model ORDER BY s
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM mc),
mt AS (SELECT model, sum(pos) AS tot_p, sum(n) - sum(pos) AS tot_n FROM mc GROUP BY model),
auc AS (SELECT mr.model, (sum(pos * (below + (n + 1) / 2.0)) - max(tot_p) * (max(tot_p) + 1) / 2.0) / (max(tot_p) * max(tot_n))
          AS roc_auc FROM mr JOIN mt ON mr.model = mt.model GROUP BY mr.model),
cm AS (SELECT model, count_if(y_true = 1 AND p >= 0.5) AS tp, count_if(y_true <> 1 AND p >= 0.5) AS fp,
         count_if(y_true = 1 AND p < 0.5) AS fn, count_if(y_true <> 1 AND p < 0.5) AS tn FROM models GROUP BY model),
metrics AS (SELECT cm.model, round(auc.roc_auc, 6) AS roc_auc, tp, fp, fn, tn, """ + _metrics_sql() + """
  FROM cm JOIN auc ON cm.model = auc.model)
"""


def model_metrics(t):
    p = t.view("v_predictions")
    models = p.select(F.inline(F.array(
        F.struct(F.lit("blend").alias("model"), F.col("y_true"), F.col("y_prob").alias("p")),
        F.struct(F.lit("inverse").alias("model"), F.col("y_true"), (F.lit(1.0) - F.col("y_prob")).alias("p")),
        F.struct(F.lit("line_shift").alias("model"), F.col("y_true"),
                 (F.lit(0.5) * F.col("y_prob") + F.lit(0.5) * (F.col("l_linenumber") / F.lit(7.0))).alias("p")))))
    auc = EV.roc_auc(models, p="p", by=["model"]).select("model", F.round("roc_auc", 6).alias("roc_auc"))
    cm = EV.confusion_metrics(models, p="p", threshold=0.5, by=["model"])
    return rounded(cm.join(auc, "model"))


@register("W8_rank_models", _PRED + ", " + _MODELS_SQL + """
SELECT model, roc_auc, recall, f1_score,
  row_number() OVER (ORDER BY roc_auc DESC, recall DESC, f1_score DESC, model) AS rank,
  row_number() OVER (ORDER BY roc_auc DESC, recall DESC, f1_score DESC, model) = 1
    AND roc_auc > coalesce((SELECT max(m2.roc_auc) FROM metrics m2 WHERE m2.model <> metrics.model), -1.0)
    AS is_champion
FROM metrics""")
def w8(t):
    ranked = EV.rank_models(model_metrics(t))
    return ranked.select("model", "roc_auc", "recall", "f1_score", F.col("rank").cast("bigint").alias("rank"),
                         "is_champion")


@register("M9_model_compare", _PRED + ", " + _MODELS_SQL + """
SELECT m.model, b.model AS baseline, round(m.roc_auc - b.roc_auc, 6) AS d_roc_auc,
  round(m.recall - b.recall, 6) AS d_recall, round(m.f1_score - b.f1_score, 6) AS d_f1_score,
  round(m.accuracy - b.accuracy, 6) AS d_accuracy, round(m.precision - b.precision, 6) AS d_precision,
  round(m.estimated_business_loss - b.estimated_business_loss, 6) AS d_estimated_business_loss,
  CAST(m.fp - b.fp AS BIGINT) AS d_fp, CAST(m.fn - b.fn AS BIGINT) AS d_fn,
  (m.roc_auc - b.roc_auc > 0.001 OR m.estimated_business_loss - b.estimated_business_loss < -50000.0
   OR m.f1_score - b.f1_score > 0.005) AS is_meaningful
FROM metrics m JOIN metrics b ON b.model = 'blend' AND m.model <> 'blend'""")
def m9(t):
    return rounded(EV.model_compare(model_metrics(t), baseline="blend"))
