"""Periodic runs: maximal stretches of words that repeat with a period.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends with that period, at least ``min_length`` words and
``min_exponent`` periods long.  Runs are found per text by a descending-LCP
Kruskal pass:

* suffixes of the word sequence are ordered by prefix doubling; only classes that
  still hold two positions are refined;
* neighbours in that order are edges weighted by their longest common prefix; the
  classes are united by decreasing weight with union-find, the smaller set of
  positions going into the larger one, both kept in text order;
* two positions x < y that become neighbours at weight l are words of equal prefix l;
  where y - x <= l this seeds a stretch x .. y + l of period y - x.

A run (s, q, length) shows exactly once, as the pair (s, s + q) at weight length - q:
a position of the same class between the two would give the run a smaller period.
Other seeds of that run start later, so a seed counts only if the words before its two
positions differ.  A pair needs a common prefix of ``min_length * (1 - 1/exponent)``
words at least, so classes that split below that are never united.

Defined cases: a null or empty text has no words, no runs and collapses to the
empty text; every row is judged alone, so repeated rows give equal rows; extra
columns are ignored unless kept; an empty table gives an empty table.

Scale: no shuffle.  A text is one record; its memory is about 100 bytes and 4 bytes per
doubling round a word, whatever its runs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from . import common as C

MIN_LENGTH, MIN_EXPONENT = 24, 3
RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])


class Places:
    """Set of text positions in order, in blocks of bounded size."""

    MOST = 512

    def __init__(self, x: int):
        self.blocks, self.lows, self.n = [[x]], [x], 1

    def __iter__(self):
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """Add ``x``; its neighbours before and after, -1 where there is none."""
        blocks, lows = self.blocks, self.lows
        b = max(bisect_right(lows, x) - 1, 0)
        block = blocks[b]
        at = bisect_left(block, x)
        before = block[at - 1] if at else -1             # only the first block can begin after x
        after = block[at] if at < len(block) else (lows[b + 1] if b + 1 < len(lows) else -1)
        block.insert(at, x)
        self.n += 1
        if not at:
            lows[b] = x
        if len(block) > self.MOST:
            half = len(block) // 2
            blocks.insert(b + 1, block[half:])
            lows.insert(b + 1, block[half])
            del block[half:]
        return before, after


def suffix_levels(ids: np.ndarray, end: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until no two suffixes of a
    text share a rank.  ``end`` is the end of each word's text, ``text`` its number.  A
    rank is the number of suffixes in smaller classes, so refining a class moves no other."""
    n = len(ids)
    order = np.lexsort((ids, text))
    rank = np.zeros(n, np.int32)
    new = np.ones(n, bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (ids[order][1:] != ids[order][:-1])
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, k, at = [rank], 1, order
    while True:
        size = np.bincount(rank, minlength=n)
        at = at[size[rank[at]] > 1]
        if not len(at):
            return levels
        inside = at + k < end[at]
        second = np.where(inside, rank[np.where(inside, at + k, 0)], -1)
        by = np.lexsort((second, rank[at]))
        at, second = at[by], second[by]
        old = rank[at]
        starts = np.ones(len(at), bool)                  # of a class, of a class after refining
        starts[1:] = old[1:] != old[:-1]
        parts = starts.copy()
        parts[1:] |= second[1:] != second[:-1]
        places = np.arange(len(at))
        moved = places[parts][np.cumsum(parts) - 1] - places[starts][np.cumsum(starts) - 1]
        rank = rank.copy()
        rank[at] = old + moved.astype(np.int32)
        levels.append(rank)
        k *= 2


def common_prefix(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of equal words from positions ``x`` and ``y`` on, pair by pair."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    stop_x, stop_y = end[x], end[y]
    got = np.zeros(len(x), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        # suffixes shorter than a level's prefix never share a rank there, so equal ranks mean equal words
        inside = (x < stop_x) & (y < stop_y)
        same = inside & (levels[level][np.where(inside, x, 0)] == levels[level][np.where(inside, y, 0)])
        step = same.astype(np.int64) << level
        x, y, got = x + step, y + step, got + step
    return got


def find_runs(ids: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH,
              min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of the texts ``ids[first[i]:first[i + 1]]``, starts
    counted over all texts, in order of start, then period."""
    least = -(-min_length * (min_exponent - 1) // min_exponent)
    sizes = np.diff(first)
    if not len(ids) or sizes.max() < min_length:
        return []
    text = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(first[1:], sizes)
    levels = suffix_levels(ids, end, text)
    known = min(len(levels) - 1, least.bit_length() - 1)
    order = np.argsort(levels[-1], kind="stable")
    shared = levels[known][order]
    near = np.flatnonzero(shared[1:] == shared[:-1])
    lcp = common_prefix(levels, order[near], order[near + 1], end)
    enough = lcp >= least
    near, lcp = near[enough], lcp[enough]
    del levels
    descending = np.argsort(-lcp, kind="stable")
    return _unite(ids, first[:-1], text, order, near[descending], lcp[descending], min_length, min_exponent)


def _unite(ids, begin, text, order, edges, weights, min_length, min_exponent) -> list[tuple[int, int, int]]:
    members = np.union1d(edges, edges + 1)
    left = np.searchsorted(members, edges).tolist()      # an edge joins a member and the next one
    positions = order[members].tolist()
    parent = list(range(len(positions)))
    places: list = [None] * len(positions)
    runs = []

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def seed(x: int, y: int, l: int) -> None:
        q = y - x
        if q <= l and q + l >= min_length and q + l >= min_exponent * q:
            if x == begin[text[x]] or ids[x - 1] != ids[y - 1]:
                runs.append((x, q + l, q))

    for at, l in zip(left, weights.tolist()):
        a, b = find(at), find(at + 1)
        big = places[a] or Places(positions[a])
        small = places[b] or Places(positions[b])
        if big.n < small.n:
            a, b, big, small = b, a, small, big
        parent[b] = a
        places[a], places[b] = big, None
        moved = sorted(small, reverse=True)              # descending: what lies inside a period goes in first
        own = set(moved) if len(moved) > 1 else ()
        for x in moved:
            before, after = big.add(x)
            if before >= 0 and before not in own:
                seed(before, x, l)
            if after >= 0 and after not in own:
                seed(x, after, l)
    runs.sort(key=lambda r: (r[0], r[2]))
    return runs


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT,
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keep``, n_words, runs (array of start, length and
    period in words, by start, then period) and collapsed: the words, joined by one
    space, without those that any run holds after its first period."""
    if min_exponent < 2 or min_length < 2:
        raise ValueError("a run holds two periods and two words at least")

    def judge(batch: pa.RecordBatch) -> list[pa.Array]:
        split = [t.encode().split() for t in C.texts_of(batch)]
        first = np.zeros(len(split) + 1, np.int64)
        np.cumsum([len(w) for w in split], out=first[1:])
        flat = np.empty(first[-1], object)
        flat[:] = [w for words in split for w in words]
        found = find_runs(pd.factorize(flat)[0], first, min_length, min_exponent) if len(flat) else []
        of = np.searchsorted(first, [r[0] for r in found], side="right") - 1 if found else []
        runs: list[list] = [[] for _ in split]
        for i, (start, length, period) in zip(of, found):
            runs[i].append((start - first[i], length, period))
        for i in {int(i) for i in of}:
            edge = np.zeros(len(split[i]) + 1, np.int64)
            for start, length, period in runs[i]:
                edge[start + period] += 1
                edge[start + length] -= 1
            split[i] = [w for w, covered in zip(split[i], np.cumsum(edge).tolist()) if not covered]
        listed = [[{"start": int(s), "length": int(n), "period": int(q)} for s, n, q in r] for r in runs]
        run = pa.struct([(f.name, pa.int64()) for f in RUN])
        return [pa.array(np.diff(first)), pa.array(listed, pa.list_(run)),
                pa.array([b" ".join(w) for w in split], pa.large_binary()).cast(pa.large_string())]

    fields = [StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]
    kept = [c for c in keep if c != "text"]
    return C.map_rows(docs.select(*kept, "text"), kept, fields, judge)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; the first of equal ones."""
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best))


def with_repeats(docs: DataFrame) -> DataFrame:
    """The query's input: a tenth of the texts, chosen by the checksum h of the id, repeat a
    stretch of words to their end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def edited(words: Column) -> Column:
        n = F.size(words).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        turned = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(
            F.element_at(words, (a + (i - a) % p + 1).cast("int"))))
        return F.when(n > 0, F.array_join(turned, " ")).otherwise(F.lit(""))

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, C.let(words, edited)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents."""
    found = periodic_runs(with_repeats(C.read(spark, sf_dir, "documents").select("doc_id", "text")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(
        r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))), "")
    best = F.col("best")
    return (found.withColumn("best", strongest(F.col("runs")))
            .select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.start.alias("start"),
                    best.length.alias("length"), best.period.alias("period"),
                    F.floor(1000 * best.length / best.period).alias("exponent_milli"),
                    F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


# Runs stated by equal 16-word stretches: for one distance q, consecutive positions whose 16 words
# come again q words later form a stretch of period q; a stretch inside one of smaller period goes.
OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
sums AS (
  SELECT doc_id, text, 1 AS pos, 4294967295::BIGINT AS c FROM documents
  UNION ALL
  SELECT doc_id, text, pos + 1, xor(c >> 8, v) FROM sums
  JOIN bits ON k = 8 AND i = xor(c, ord(substring(doc_id::VARCHAR, pos, 1))) & 255
  WHERE pos <= length(doc_id::VARCHAR)),
docs AS (
  SELECT doc_id, xor(c, 4294967295) AS h,
    [w FOR w IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF w <> ''] AS w0
  FROM sums WHERE pos = length(doc_id::VARCHAR) + 1),
marked AS (
  SELECT doc_id, w0, len(w0) AS n, h % 10 = 0 AND len(w0) > 0 AS edit,
    CASE WHEN len(w0) > 0 THEN (h // 10) % len(w0) END AS a, 3 + (h // 10) % 8 AS parts FROM docs),
words AS (
  SELECT doc_id, i, w0[1 + CASE WHEN edit AND i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END] AS w
  FROM marked, unnest(range(n)) r(i)),
grams AS (
  SELECT doc_id, i, list(w) OVER ahead AS gram, count(*) OVER ahead AS m FROM words
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING)),
hashed AS (SELECT doc_id, i, sha256(array_to_string(gram, ' ')) AS gram FROM grams WHERE m = 16),
pairs AS (
  SELECT doc_id, x.i, y.i - x.i AS q FROM hashed x JOIN hashed y USING (doc_id, gram) WHERE y.i > x.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
stretches AS (
  SELECT doc_id, q, min(i) AS s, max(i) - min(i) + 16 + q AS l FROM islands GROUP BY doc_id, q, island),
runs AS (
  SELECT * FROM stretches r WHERE l >= 24 AND l >= 3 * q AND NOT EXISTS (
    SELECT 1 FROM stretches o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.l >= r.s + r.l)),
dropped AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
best AS (
  SELECT x.* FROM runs x WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = x.doc_id AND (o.l * x.q > x.l * o.q
    OR o.l * x.q = x.l * o.q AND (o.s < x.s OR o.s = x.s AND o.q < x.q))))
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period,
  (1000 * l // q)::BIGINT AS exponent_milli, sha256(coalesce(told.t, '')) AS runs_sha256,
  sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM documents LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN best USING (doc_id)
"""
