"""Mixing sources to target weights by subset-sum budget fitting.

Sources, ordered by code point (null last), take the given weights in turn and
share a word budget in proportion; a target stops at ``cap`` times its source's
size and the excess is shared again by weight until no target is above.  A
source then takes every document ``floor(target / size)`` times, and the rest
of its budget is fitted as a subset sum: documents are counted by exact length,
a share of each length is taken, and a bounded-knapsack dynamic program over
the remaining lengths meets what is left of the budget as closely as it can
from below.  Which documents of a length are taken is decided by a seeded hash.

Defined cases: a null text has size 0 and is never an extra pick; a null source
is a source of its own; rows equal in id, source and text are separate rows in
the counts; ties of the hash are broken by the id; an empty table gives an
empty table; a source without words has target 0.

Scale: text is read once to count words; after that only (id, source, size)
rows move.  The histogram of a source has one row per distinct length, at most
the square root of twice its words, and is fitted in one group.  A hot source
or length is ranked in slices of ``SLICE_ROWS`` documents by hash, never as one
group.  The water level of the targets takes a few scalars per round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP, SEED = 1.5, 2.0, 20240901
SLICE_ROWS = 10_000
DP_WORDS = 1 << 14            # budget left to the dynamic program


def n_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(C.WORD), 0)).cast("bigint")


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Columns source, source_size -> also source_id (position) and target."""
    order = [F.col("source").asc_nulls_last()]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("source_id") % len(weights) + 1).cast("int"))
    s = (C.ranked(per_source, order, "source_id").withColumn("w", weight)
         .withColumn("most", F.col("source_size") * F.lit(float(cap))))
    s = materialize(s, "sources")
    budget = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, -1
    while True:                                  # a few rounds; each one caps at least one more source
        full = F.col("most") <= F.col("w") * F.lit(level)
        r = s.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("most"))).alias("used"),
                  F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if r.n == held or not r.w:
            break
        held, level = r.n, (budget - (r.used or 0.0)) / r.w
    if r.n and not r.w:
        level = float("inf")
    return s.withColumn("target", F.least("most", F.col("w") * F.lit(level))).drop("w", "most")


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come as close to
    ``budget`` from below as the lengths allow; at most ``counts`` of each."""
    use = lengths > 0
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return np.where(use, counts, 0)
    part = counts * (budget / total)
    taken = np.where(use, np.floor(part), 0).astype(np.int64)
    rest = budget - int((taken * lengths).sum())
    # one more of the lengths with the largest fractions, as far as the budget goes
    for i in np.argsort(np.floor(part) - part, kind="stable"):
        if use[i] and taken[i] < counts[i] and rest - lengths[i] >= dp_words:
            taken[i] += 1
            rest -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):
        if use[i] and rest > dp_words:
            more = min(int(counts[i] - taken[i]), (rest - dp_words) // int(lengths[i]))
            if more > 0:
                taken[i] += more
                rest -= more * int(lengths[i])
    # bounded knapsack over the sums up to rest, as bits of an integer; counts in binary parts
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    for i in np.argsort(-lengths, kind="stable"):
        length, left, part_n = int(lengths[i]), int(counts[i] - taken[i]), 1
        if not use[i] or length > rest:
            continue
        left = min(left, rest // length)
        while left > 0 and not reach >> rest & 1:
            n = min(part_n, left)
            steps.append((i, n, reach))
            reach |= reach << (n * length) & mask
            left, part_n = left - n, part_n * 2
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= n * int(lengths[i])
    return taken


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size")
    size, target = int(rows.source_size.iloc[0]), float(rows.target.iloc[0])
    whole = int(target // size) if size else 0
    extra = fit_budget(rows["size"].to_numpy(), rows.n_docs.to_numpy(), int(round(target - whole * size)))
    return pd.DataFrame({"source_id": rows.source_id, "size": rows["size"], "source_size": size, "target": target,
                         "whole": whole, "extra": extra, "n_docs": rows.n_docs})


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, row_key, size, source_size, target, copies, taken."""
    sized = materialize(docs.select("doc_id", "source", C.row_key("doc_id", "source", "text").alias("row_key"),
                                    n_words(F.col("text")).alias("size")), "sizes")
    hist = sized.groupBy("source", "size").agg(F.count("*").alias("n_docs"))
    per = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n_docs")).cast("bigint").alias("source_size"))
    goal = targets(per, weights, share, cap)
    known = materialize(goal, "targets")
    h = hist.join(known, hist.source.eqNullSafe(known.source)).select("source_id", "size", "n_docs", "source_size", "target")
    plan = h.groupBy("source_id").applyInPandas(
        _fit, "source_id bigint, size bigint, source_size bigint, target double, whole bigint, extra bigint, n_docs bigint")
    plan = materialize(plan, "plan")
    by_id = known.select(F.col("source").alias("_source"), "source_id")
    u = F.xxhash64(F.lit(seed), "doc_id", "row_key")
    d = (sized.join(by_id, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
         .join(plan, ["source_id", "size"])
         .withColumn("u", u)
         .withColumn("slice", F.floor((F.shiftrightunsigned("u", 11) / F.lit(float(1 << 53)))
                                      * F.ceil(F.col("n_docs") / SLICE_ROWS))))
    key = ["source_id", "size", "slice"]
    per_slice = d.groupBy(*key).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_id", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.select(*key, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy(*key).orderBy("u", "doc_id"))
    picked = d.withColumn("at", at).join(per_slice, key)
    copies = F.col("whole") + (F.col("before") + F.col("at") <= F.col("extra")).cast("bigint")
    return (picked.withColumn("copies", copies)
            .select("doc_id", "row_key", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.  Rows equal in id, source
    and text are one document whose copies add up."""
    keyed = C.packed(docs, _rk=C.row_key("doc_id", "source", "text"))
    n = mixed.where("copies > 0").groupBy(F.col("row_key").alias("_rk")).agg(F.sum("copies").cast("int").alias("_copies"))
    taken = keyed.join(n, "_rk").dropDuplicates(["_rk"]).select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return C.unpacked(taken, docs.columns)


def op9_source_mix(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents: sizes, targets and words taken."""
    return mix(C.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
