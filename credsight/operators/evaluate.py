"""Model evaluation as aggregates: confusion metrics (A6), exact ROC-AUC
and average precision (A8), curve tables (A9), one-pass threshold sweeps (A10,
A11), class balance (A12), policy pickers (W4-W6), model ranking (W8) and
model comparison (M9).

Scale notes
-----------
* The sweep never multiplies rows by thresholds: each score is mapped to the
  number of thresholds at or below it (an arithmetic guess corrected by two
  exact comparisons, all codegen'd), the rows are counted per bucket (map-side
  partial aggregation, at most K+1 groups), and the suffix sums run on a table
  of at most K+1 rows.
* AUC/AP need cumulative counts over the score order.  Scores are first
  reduced to one row per distinct score; that table is range-partitioned by
  score (sampled bounds keep slices balanced even when scores crowd into a
  narrow band), each slice is a contiguous score range, slice totals form a
  tiny table whose exclusive prefix is broadcast back, and the in-slice prefix
  is a window partitioned by slice.  No single-partition window over data.
  The slice-annotated table is checkpointed once, so both passes read the
  same slices and the input is scanned once.
  The numerators are exact decimals, so the result does not depend on the
  partitioning.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Fixed values that must equal the reference's.
COST_FN = 15000
COST_FP = 1500
IMBALANCE_SHARE = 0.15
CONSERVATIVE_RECALL = 0.85
REVENUE_TARGET_RECALL = 0.25
HIGH_RECALL_FLOORS = (0.75, 0.70)
MEANINGFUL_AUC = 0.001
MEANINGFUL_LOSS = -50000.0
MEANINGFUL_F1 = 0.005
NAMED_POLICIES = {"conservative": 0.36, "balanced": 0.66, "revenue_friendly": 0.75}


def sweep_grid_rounded() -> list[float]:
    """0.10 ... 0.90 step 0.01, each rounded to 2 places (81 thresholds)."""
    return [float(np.round(t, 2)) for t in np.arange(0.10, 0.91, 0.01)]


def sweep_grid_raw() -> list[float]:
    """0.05 ... 0.80 step 0.01 as produced by arange, unrounded (76 thresholds)."""
    return [float(t) for t in np.arange(0.05, 0.81, 0.01)]


def best_f1_grid() -> list[float]:
    """91 evenly spaced thresholds 0.05 ... 0.95."""
    return [float(t) for t in np.linspace(0.05, 0.95, 91)]


def _div0(n: Column, d: Column) -> Column:
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def metric_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1, accuracy, specificity, fpr, fnr, loss (zero-division -> 0)."""
    return {
        "accuracy": _div0(tp + tn, tp + fp + fn + tn),
        "precision": _div0(tp, tp + fp),
        "recall": _div0(tp, tp + fn),
        "f1_score": _div0(2 * tp, 2 * tp + fp + fn),
        "specificity": _div0(tn, tn + fp),
        "false_positive_rate": _div0(fp, tn + fp),
        "false_negative_rate": _div0(fn, fn + tp),
        "estimated_business_loss": (fn * COST_FN + fp * COST_FP).cast("double"),
    }


def confusion_metrics(df: DataFrame, y: str = "y_true", p: str = "y_prob", threshold: float = 0.5,
                      by: list[str] | None = None) -> DataFrame:
    """A6 + A11: one aggregate of conditional counts."""
    pred = F.col(p) >= F.lit(float(threshold))
    pos = F.col(y) == 1
    counts = [F.count_if(pos & pred).alias("tp"), F.count_if(~pos & pred).alias("fp"),
              F.count_if(pos & ~pred).alias("fn"), F.count_if(~pos & ~pred).alias("tn")]
    g = df.groupBy(*(by or [])).agg(*counts)
    m = metric_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return g.withColumns(m)


def threshold_bucket(p: Column, thresholds: list[float]) -> Column:
    """Number of thresholds <= p for an ascending, near-uniform grid.

    An arithmetic guess from the grid step, corrected by one exact comparison
    on each side; all of it compiles into the scan's codegen stage.
    """
    k = len(thresholds)
    t0 = thresholds[0]
    step = (thresholds[-1] - thresholds[0]) / (k - 1) if k > 1 else 1.0
    arr = F.array(*[F.lit(float(t)) for t in thresholds])
    guess = F.floor((p - F.lit(t0)) / F.lit(step)).cast("int") + 1
    c = F.greatest(F.lit(0), F.least(F.lit(k), guess))
    up = F.when((c < k) & (F.try_element_at(arr, c + 1) <= p), 1).otherwise(0)
    down = F.when((c >= 1) & (F.try_element_at(arr, F.greatest(c, F.lit(1))) > p), 1).otherwise(0)
    return c + up - down


def threshold_sweep(df: DataFrame, thresholds: list[float], y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """A10: metrics at every threshold in one pass over the data.

    Returns one row per threshold: k (1-based), threshold, tp, fp, fn, tn and
    the metric columns.  Assumes the thresholds ascend.  The data is scanned
    once; everything after the bucket count runs on at most K+1 rows (the
    suffix sums are windows over that dense bucket table).
    """
    spark = df.sparkSession
    k = len(thresholds)
    assert k > 0
    b = (df.select(threshold_bucket(F.col(p), thresholds).alias("bucket"), (F.col(y) == 1).alias("pos"))
         .groupBy("bucket").agg(F.count_if("pos").alias("pos"), F.count_if(~F.col("pos")).alias("neg")))
    grid = spark.createDataFrame([(i, float(thresholds[i - 1]) if i > 0 else None) for i in range(k + 1)],
                                 "bucket int, threshold double")
    dense = grid.join(b, "bucket", "left").select(
        "bucket", "threshold", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    # K+1 rows: these single-partition windows are bounded by the grid, not the data.
    suffix = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = dense.select(
        F.col("bucket").alias("k"), "threshold",
        F.sum("pos").over(suffix).cast("bigint").alias("tp"), F.sum("neg").over(suffix).cast("bigint").alias("fp"),
        (F.sum("pos").over(whole) - F.sum("pos").over(suffix)).cast("bigint").alias("fn"),
        (F.sum("neg").over(whole) - F.sum("neg").over(suffix)).cast("bigint").alias("tn")).filter(F.col("k") >= 1)
    return out.withColumns(metric_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def score_counts(df: DataFrame, y: str = "y_true", p: str = "y_prob", slices: int | None = None,
                 by: list[str] | None = None) -> DataFrame:
    """Per (group, distinct score): pos, neg, the exact counts of rows of the
    group with a lower score (pos_below, neg_below) and group totals P, N.
    See the module notes for the two-level prefix."""
    by = list(by or [])
    g = (df.filter(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("score"))
         .agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg")))
    g = g.repartitionByRange(*([slices] if slices else []), "score").withColumn("slice", F.spark_partition_id())
    # Both passes below must see the same slices, and the scan must not run twice:
    # materialise the (distinct-score) table once in the shared checkpoint folder.
    ensure_checkpoint_dir(df.sparkSession)
    g = g.checkpoint(eager=True)
    # In-slice running sums plus each slice's totals, in one window pass.
    win = Window.partitionBy(*by, "slice").orderBy("score")
    before = win.rowsBetween(Window.unboundedPreceding, -1)
    whole = win.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    g = g.withColumns({"in_pos": F.coalesce(F.sum("pos").over(before), F.lit(0)),
                       "in_neg": F.coalesce(F.sum("neg").over(before), F.lit(0)),
                       "s_pos": F.sum("pos").over(whole), "s_neg": F.sum("neg").over(whole)})
    # At most groups x slices rows: the prefix over slices is bounded by construction.
    per_slice = g.groupBy(*by, "slice").agg(F.first("s_pos").alias("s_pos"), F.first("s_neg").alias("s_neg"))
    ws = Window.partitionBy(*by).orderBy("slice")
    per_slice = per_slice.select(
        *by, "slice",
        F.coalesce(F.sum("s_pos").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("pre_pos"),
        F.coalesce(F.sum("s_neg").over(ws.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("pre_neg"),
        F.sum("s_pos").over(Window.partitionBy(*by)).alias("P"),
        F.sum("s_neg").over(Window.partitionBy(*by)).alias("N"))
    out = g.join(F.broadcast(per_slice), [*by, "slice"])
    return out.select(*by, "score", "pos", "neg", (F.col("pre_pos") + F.col("in_pos")).alias("pos_below"),
                      (F.col("pre_neg") + F.col("in_neg")).alias("neg_below"), "P", "N")


def roc_auc(df: DataFrame, y: str = "y_true", p: str = "y_prob", slices: int | None = None,
            by: list[str] | None = None) -> DataFrame:
    """A7 + A8: exact ROC-AUC (ties count one half) and step-wise average precision.

    AUC = sum_s pos(s) * (neg_below(s) + neg(s)/2) / (P*N), numerator kept as an
    exact decimal.  AP = sum_s pos(s)/P * precision at threshold s.
    """
    by = list(by or [])
    sc = score_counts(df, y, p, slices, by)
    dec = "decimal(38,0)"
    num = (F.col("pos").cast(dec) * (F.lit(2).cast(dec) * F.col("neg_below").cast(dec) + F.col("neg").cast(dec)))
    tp_ge = F.col("P") - F.col("pos_below")
    fp_ge = F.col("N") - F.col("neg_below")
    ap_term = F.when(F.col("pos") > 0, F.col("pos").cast("double") * tp_ge.cast("double")
                     / (tp_ge + fp_ge).cast("double"))
    agg = sc.groupBy(*by).agg(F.sum(num).alias("num"), F.first("P").alias("P"), F.first("N").alias("N"),
                              F.sum(ap_term).alias("ap_num"))
    return agg.select(
        *by,
        F.when((F.col("P") > 0) & (F.col("N") > 0),
               (F.col("num").cast("double") / (F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double"))))
        .alias("roc_auc"),
        F.when(F.col("P") > 0, F.col("ap_num") / F.col("P").cast("double")).alias("average_precision"),
        F.col("P").cast("bigint").alias("n_pos"), F.col("N").cast("bigint").alias("n_neg"))


def curve_points(df: DataFrame, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """One row per distinct score used as threshold (predict positive iff
    score >= threshold): tp, fp, tpr, fpr, precision, recall."""
    sc = score_counts(df, y, p)
    tp = F.col("P") - F.col("pos_below")
    fp = F.col("N") - F.col("neg_below")
    return sc.select(F.col("score").alias("threshold"), tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
                     _div0(tp, F.col("P")).alias("tpr"), _div0(fp, F.col("N")).alias("fpr"),
                     _div0(tp, tp + fp).alias("precision"), _div0(tp, F.col("P")).alias("recall"))


def class_distribution(df: DataFrame, y: str = "y_true") -> DataFrame:
    """Count and percent per class, imbalanced if the minority share < 0.15."""
    g = df.groupBy(F.col(y).alias("target")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # <= #classes rows
    return g.select("target", "n", (F.col("n") * 100.0 / F.sum("n").over(w)).alias("pct"),
                    ((F.min("n").over(w) / F.sum("n").over(w)) < IMBALANCE_SHARE).alias("is_imbalanced"))


def _as_rows(agg: DataFrame, picks: dict[str, Column]) -> DataFrame:
    """Turn one row of named struct picks into one row per policy."""
    arr = F.array(*[F.struct(F.lit(n).alias("policy"), c.alias("r")) for n, c in picks.items()])
    return agg.select(F.inline(arr)).select("policy", "r.*")


def _row(sweep: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in sweep.columns])


def threshold_policies(sweep: DataFrame) -> DataFrame:
    """balanced = first max F1; conservative = last threshold with recall >= 0.85
    (else first max recall); revenue_friendly = first recall nearest 0.25.
    One aggregate over the (<= 81-row) sweep, no driver round trip."""
    k = F.col("k")
    r = _row(sweep)
    agg = sweep.agg(
        F.max_by(r, F.struct(F.col("f1_score"), -k)).alias("balanced"),
        F.coalesce(F.max_by(r, F.when(F.col("recall") >= CONSERVATIVE_RECALL, k)),
                   F.max_by(r, F.struct(F.col("recall"), -k))).alias("conservative"),
        F.max_by(r, F.struct(-F.abs(F.col("recall") - REVENUE_TARGET_RECALL), -k)).alias("revenue_friendly"))
    return _as_rows(agg, {n: F.col(n) for n in ["balanced", "conservative", "revenue_friendly"]})


def loss_policies(sweep: DataFrame) -> DataFrame:
    """Max F1, min loss, min loss with recall >= 0.75 (else >= 0.70, else max recall)."""
    k = F.col("k")
    loss = F.col("estimated_business_loss")
    r = _row(sweep)
    high = [F.max_by(r, F.when(F.col("recall") >= f, F.struct(-loss, -k))) for f in HIGH_RECALL_FLOORS]
    agg = sweep.agg(
        F.max_by(r, F.struct(F.col("f1_score"), -k)).alias("max_f1"),
        F.max_by(r, F.struct(-loss, -k)).alias("min_loss"),
        F.coalesce(*high, F.max_by(r, F.struct(F.col("recall"), -k))).alias("high_recall"))
    return _as_rows(agg, {n: F.col(n) for n in ["max_f1", "min_loss", "high_recall"]})


def best_f1_threshold(sweep: DataFrame) -> DataFrame:
    """First threshold of the maximal F1 (strict improvement); 0.5 when F1 is 0."""
    r = sweep.agg(F.max_by(F.struct("threshold", "f1_score"), F.struct(F.col("f1_score"), -F.col("k"))).alias("r"))
    return r.select(F.when(F.col("r.f1_score") > 0, F.col("r.threshold")).otherwise(F.lit(0.5)).alias("threshold"),
                    F.when(F.col("r.f1_score") > 0, F.col("r.f1_score")).otherwise(F.lit(0.0)).alias("f1_score"))


def rank_models(metrics: DataFrame) -> DataFrame:
    """Models ordered by auc, recall, f1 (descending) with rank; the champion
    is the first, and only if its AUC is strictly above every other model's."""
    w = Window.orderBy(F.desc("roc_auc"), F.desc("recall"), F.desc("f1_score"), F.asc("model"))  # few rows
    ranked = metrics.withColumn("rank", F.row_number().over(w))
    second = Window.orderBy(F.desc("roc_auc")).rowsBetween(1, 1)
    ranked = ranked.withColumn("next_auc", F.lead("roc_auc").over(Window.orderBy(F.desc("roc_auc"), F.asc("model"))))
    return ranked.withColumn("is_champion", (F.col("rank") == 1) &
                             (F.col("next_auc").isNull() | (F.col("roc_auc") > F.col("next_auc")))) \
        .drop("next_auc")


def model_compare(metrics: DataFrame, baseline: str) -> DataFrame:
    """M9: deltas of every model against a baseline model and the meaningful flag."""
    b = metrics.filter(F.col("model") == baseline).select(
        *[F.col(c).alias(f"b_{c}") for c in metrics.columns])
    # The baseline side is exactly one row (one model): a bounded broadcast.
    j = metrics.filter(F.col("model") != baseline).withColumn("_one", F.lit(1)).join(
        F.broadcast(b.withColumn("_one", F.lit(1))), "_one").drop("_one")
    d = {f"d_{c}": F.col(c) - F.col(f"b_{c}") for c in
         ["roc_auc", "recall", "f1_score", "accuracy", "precision", "estimated_business_loss"]}
    d["d_fp"] = F.col("fp") - F.col("b_fp")
    d["d_fn"] = F.col("fn") - F.col("b_fn")
    out = j.select("model", F.col("b_model").alias("baseline"), *[v.alias(k) for k, v in d.items()])
    return out.withColumn("is_meaningful", (F.col("d_roc_auc") > MEANINGFUL_AUC)
                          | (F.col("d_estimated_business_loss") < MEANINGFUL_LOSS)
                          | (F.col("d_f1_score") > MEANINGFUL_F1))
