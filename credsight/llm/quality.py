"""Quality rules: rule counts of a text, and a hashed n-gram log-likelihood ratio
between trusted-target and raw-corpus multinomials.

Byte n-grams (``GRAM`` bytes) are hashed into ``BUCKETS`` buckets.  The raw
multinomial counts every document, the target multinomial the documents trusted
by their label; both are smoothed by ``SMOOTH`` per bucket.  A document's score
is the mean over its n-grams of ``log p_target - log p_raw``.  The threshold is the cut
between the scores of documents labelled good and bad with the least error (share of
good ones lost plus share of bad ones kept; ties to the lower cut), in the middle of its gap.  For this
cut each labelled document is scored by counts without its own, so that a few wrong labels move
it little.  Without bad labels it is the ``LOST`` quantile of the trusted documents.  Every
document is judged by this one number, which follows from the tables alone.

The target model and the threshold are fitted on all labels; the raw counts and the
scores cover all documents.

Defined cases: a null text has no words, lines or n-grams; a text without
n-grams scores 0 and fails the base rules (too few words); without any trusted document
there is no ratio (score null) and the base rules decide alone; repeated rows
count as often as they occur and get equal verdicts; an empty table gives an
empty table.

Scale: each task pre-aggregates its counts into at most ``BUCKETS`` rows.  The bucket
table (``BUCKETS`` rows, whatever the input) is the only thing broadcast by force;
up to ``SENT_IDS`` label ids are sent to the texts; where there are more, the texts are shuffled
to them, so all labels count either way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from ..session import materialize
from . import common as C

GRAM, BUCKETS, SMOOTH = 4, 1 << 16, 1.0
LOST = 0.002
SENT_IDS = 2_000_000                       # label ids that are broadcast: about 70 bytes each in a task's memory
SCORE_STEP = 1e-4                          # scores are counted in steps of this to place the threshold
MIN_WORDS, MOST_REPEATED = 50, 50          # base rules: fewest words, most percent of repeated words
SYMBOLS = "#*$%&|<>"
_FIND = re.compile(r"[^\x20\x09-\x0D]+").findall


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = _FIND(text)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if not x.isascii() or x.strip(" \t\n\v\f\r")]
    dup = len(lines) - len(set(lines))
    if dup:                                 # a line of other white space only has words, one of these six has none
        lines = [x for x in lines if _FIND(x)]
        dup = len(lines) - len(set(lines))
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        until = 0                           # words before this position are counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(until, i)
                until = i + 3
    return len(words), sum(map(len, words)), symbols, dup, repeated


def base_failed(n_words: int, repeated: int) -> bool:
    return n_words < MIN_WORDS or 100 * repeated > MOST_REPEATED * n_words


def gram_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of a batch of texts, and ``first[i]:first[i + 1]`` as those of text i."""
    col = pa.concat_arrays([column.cast(pa.large_string())])
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[:len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[:off[-1]] if raw is not None else np.zeros(0, np.uint8)
    n = max(0, len(data) - GRAM + 1)
    h = np.zeros(n, dtype=np.uint32)
    for i in range(GRAM):
        h = h << np.uint32(8) | data[i:i + n]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    sizes = np.diff(off)
    ends = np.repeat(off[1:], sizes)[:n]
    whole = np.arange(n) + GRAM <= ends     # n-grams inside one text
    first = np.concatenate(([0], np.cumsum(np.maximum(sizes - GRAM + 1, 0))))
    return h[whole], first


def _counts(docs: DataFrame) -> DataFrame:
    """Per bucket: n_raw over all documents, n_target over the trusted ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for b in C.pieces(whole):
                h, first = gram_buckets(b.column(0))
                raw += np.bincount(h, minlength=BUCKETS)
                good = np.repeat(np.asarray(b.column(1).to_numpy(zero_copy_only=False), bool), np.diff(first))
                target += np.bincount(h[good], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])],
                                         names=["bucket", "n_raw", "n_target"])

    C.small_batches(docs.sparkSession)
    per_task = docs.select("text", "trusted").mapInArrow(run, "bucket int, n_raw bigint, n_target bigint")
    return per_task.groupBy("bucket").agg(F.sum("n_raw").alias("n_raw"), F.sum("n_target").alias("n_target"))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and trusted of every labelled id; an id with both labels isn't trusted."""
    return (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
            .groupBy("doc_id").agg(F.min(F.col("quality") == 1).alias("trusted")))


class Ratio:
    """The fitted log ratio per bucket and the threshold of the scores."""

    def __init__(self, log_ratio: np.ndarray | None, threshold: float | None = None):
        self.log_ratio, self.threshold = log_ratio, threshold

    def scores(self, column: pa.Array) -> np.ndarray:
        h, first = gram_buckets(column)
        n = np.diff(first)
        some, out = n > 0, np.zeros(len(n))
        if some.any():                      # summed text by text: a score doesn't depend on its batch
            out[some] = np.add.reduceat(self.log_ratio[h], first[:-1][some]) / n[some]
        return out


def least_error(values: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the least share of good rows below plus bad rows above it; ``values`` ascend,
    ``good`` and ``bad`` count the rows of each."""
    lost = np.concatenate(([0], np.cumsum(good))) * int(bad.sum())          # whole numbers: ties are exact
    kept = (int(bad.sum()) - np.concatenate(([0], np.cumsum(bad)))) * int(good.sum())
    at = int(np.argmin(lost + kept))
    return float(values[0] if at == 0 else (values[at - 1] + values[at]) / 2)


def log_ratio(raw: np.ndarray, target: np.ndarray, n_raw: float, n_target: float) -> np.ndarray:
    """log p_target - log p_raw of buckets counted ``target`` and ``raw`` times, of ``n_target`` and ``n_raw`` in all."""
    return np.log((target + SMOOTH) / (n_target + SMOOTH * BUCKETS)) - np.log((raw + SMOOTH) / (n_raw + SMOOTH * BUCKETS))


def _held_out(marked: DataFrame, raw: np.ndarray, target: np.ndarray) -> DataFrame:
    """trusted, base_failed and score of labelled documents, each scored without its own counts."""
    shared = marked.sparkSession.sparkContext.broadcast((raw, target))
    fields = [StructField("base_failed", BooleanType()), StructField("score", DoubleType())]

    def fn(b: pa.RecordBatch) -> list[pa.Array]:
        raw, target = shared.value
        n_raw, n_target = raw.sum(), target.sum()
        h, first = gram_buckets(b.column(b.schema.get_field_index("text")))
        failed, scores = [], []
        for i, (text, own) in enumerate(zip(C.texts_of(b), b.column(b.schema.get_field_index("trusted")).to_pylist())):
            words, _, _, _, repeated = rule_counts(text)
            failed.append(base_failed(words, repeated))
            at, k = np.unique(h[first[i]:first[i + 1]], return_counts=True)
            n, mine = k.sum(), k * bool(own)
            rest = log_ratio(raw[at] - k, target[at] - mine, n_raw - n, n_target - mine.sum())
            scores.append(float((rest * k).sum() / n) if n else 0.0)
        return [pa.array(failed, pa.bool_()), pa.array(scores, pa.float64())]

    return C.map_rows(marked.select("trusted", "text"), ["trusted"], fields, fn)


def fit(docs: DataFrame, labels: DataFrame, lost: float = LOST) -> Ratio:
    """Fit both multinomials and the threshold; what comes to the driver is the bucket
    table (at most BUCKETS rows) and the scores of the labelled documents, counted by ``SCORE_STEP``."""
    ids = materialize(labelled(labels), "quality-labels")
    marked = docs.select("doc_id", "text").join(F.broadcast(ids) if ids.count() <= SENT_IDS else ids, "doc_id", "left")
    rows = _counts(marked.withColumn("trusted", F.coalesce("trusted", F.lit(False)))).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r.bucket], target[r.bucket] = r.n_raw, r.n_target
    if not target.sum():
        return Ratio(None)
    made = Ratio(log_ratio(raw, target, raw.sum(), target.sum()))
    own = _held_out(marked.where("trusted IS NOT NULL"), raw, target).where("NOT base_failed")
    step = F.round(F.col("score") / SCORE_STEP).cast("bigint")
    seen = own.groupBy(step.alias("step")).agg(F.count_if("trusted").alias("good"), F.count_if(~F.col("trusted")).alias("bad")).orderBy("step").collect()
    values, good, bad = (np.array([r[i] for r in seen], dtype=np.int64) for i in range(3))
    if good.sum() and bad.sum():
        made.threshold = least_error(values * SCORE_STEP, good, bad)
    elif good.sum():
        made.threshold = float(values[np.searchsorted(np.cumsum(good), lost * good.sum(), side="right")] * SCORE_STEP) - SCORE_STEP / 2
    return made


def score(docs: DataFrame, ratio: Ratio, keep: list[str]) -> DataFrame:
    """Rule counts, score and verdict of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [StructField(n, LongType()) for n in names]
    fields += [StructField("base_failed", BooleanType()), StructField("score", DoubleType()), StructField("kept", BooleanType())]

    def fn(b: pa.RecordBatch) -> list[pa.Array]:
        r = shared.value
        column = b.column(b.schema.get_field_index("text"))
        counts = [rule_counts(t) for t in C.texts_of(b)]
        failed = [base_failed(c[0], c[4]) for c in counts]
        scores = [None] * len(counts) if r.log_ratio is None else r.scores(column).tolist()
        kept = [not f and (s is None or r.threshold is None or s >= r.threshold) for f, s in zip(failed, scores)]
        cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
        return cols + [pa.array(failed, pa.bool_()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())]

    source = docs if "text" in keep else docs.select(*keep, "text")
    return C.map_rows(source, keep, fields, fn)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, C.read(spark, sf_dir, "labels")), keep=["doc_id"])
