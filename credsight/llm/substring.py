"""Substring dedup: repeated word windows found by backward search in FM-indexes.

A window of ``WINDOW`` words is repeated if its word sequence also starts in a
document of smaller id.  Equal windows share their smallest hash of ``ANCHOR``
words, so the windows of a document are cut into runs of one such hash, and only
runs whose hash occurs in two documents can hold a repeat.  These are
gathered by hash into shards.  Each shard builds a compressed FM-index (wavelet
matrix over the Burrows-Wheeler transform) of the passages that a document has
before the last one of their hash, and streams all its passages through it: the matching
statistics tell which windows reach the threshold of ``WINDOW`` words, and the interval
of such a match holds the smallest id.  Words covered by a repeated window are removed.

Defined cases: a null text has no words; texts of fewer than ``WINDOW`` words are
kept; rows of equal id repeat nothing of one another; a row without id is kept
whole and is no earlier document; repeated rows get equal results; windows are
judged on the input, not on what is left; an empty table gives an empty table.

Scale: what is shuffled for all documents is one short row per run (about one per
20 words) and twice the texts (to fetch passages, to remove words); passages
(with their words) only for hashes of two documents, each distinct one once.  The
number of shards follows the number of passages.  A hash with more than
``HOT_PASSAGES`` different passages would fill a shard of its own: its passages are cut
finer, into single windows with a key each, and go through the same indexes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from ..session import materialize
from . import common as C
from .fmindex import FMIndex

WINDOW, ANCHOR = 50, 8
RUN_WINDOWS = 64               # longer runs of windows are cut
SHARD_PASSAGES, HOT_PASSAGES = 8_000, 20_000
_FIND = re.compile(r"[^\x20\x09-\x0D]+").findall


def anchors(words: np.ndarray) -> np.ndarray:
    """Smallest hash of ANCHOR words in the window that starts at each word (windows may cross texts)."""
    m = C.gram_hashes(words, ANCHOR)
    width, need = 1, WINDOW - ANCHOR + 1
    while width * 2 <= need:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = need - width
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def runs(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, start, n (windows), key (their anchor) and content (hash of their words) of every run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.pieces(whole):
                w = C.Words(b.column(2))
                n = np.diff(w.first)
                windows = np.maximum(n - WINDOW + 1, 0)
                if not windows.sum():
                    continue
                text = np.repeat(np.arange(len(n)), windows)
                inside = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                at = w.first[text] + inside
                key = anchors(w.hash)[at]
                new = np.concatenate(([True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])))
                head = np.flatnonzero(new)
                since = np.arange(len(key)) - np.repeat(head, np.diff(np.append(head, len(key))))
                head = np.flatnonzero(since % RUN_WINDOWS == 0)
                size = np.diff(np.append(head, len(key)))
                p, q = C.powers(len(w.hash))
                pref = np.concatenate((np.zeros(1, C.U64), np.cumsum(w.hash * p[:len(w.hash)], dtype=C.U64)))
                a = at[head]
                content = C.mix((pref[a + size + WINDOW - 1] - pref[a]) * q[a] + size.astype(C.U64))
                t = text[head]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(t)), b.column(1).take(pa.array(t)), pa.array(inside[head].astype(np.int32)),
                     pa.array(size.astype(np.int32)), pa.array(key[head].view(np.int64)), pa.array(content.view(np.int64))],
                    names=["row_key", "doc_id", "start", "n", "key", "content"])

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(C.row_key("doc_id", "text").alias("row_key"), "doc_id", "text")
    return rows.mapInArrow(run, "row_key binary, doc_id bigint, start int, n int, key bigint, content bigint")


def passages(providers: DataFrame, docs: DataFrame) -> DataFrame:
    """key, content, doc_id, provider, hot, n and words (joined by one space) of each passage, cut out of its first text."""
    wanted = providers.groupBy("row_key").agg(F.collect_list(F.struct("key", "content", "doc_id", "provider", "hot", "start", "n")).alias("cuts"))
    texts = docs.select(C.row_key("doc_id", "text").alias("row_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.pieces(whole):
                out = []
                for cuts, text in zip(b.column(0).to_pylist(), C.texts_of(b)):
                    words = _FIND(text)
                    out += [(c["key"], c["content"], c["doc_id"], c["provider"], c["hot"], c["n"], " ".join(words[c["start"]:c["start"] + c["n"] + WINDOW - 1]))
                            for c in cuts]
                cols = list(zip(*out)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=["key", "content", "doc_id", "provider", "hot", "n", "words"])

    return texts.join(wanted, "row_key").select("cuts", "text").mapInArrow(
        run, "key bigint, content bigint, doc_id bigint, provider boolean, hot boolean, n int, words string")


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """Streams the passages of a shard through the index of its providers: stretches of windows
    (off, len) that reach the threshold, and the smallest id that holds them."""
    rows = rows.sort_values("provider", ascending=False, kind="stable")     # symbols of the index come first
    names: dict[str, int] = {}
    sequences = [np.array([names.setdefault(w, len(names) + 1) for w in t.split(" ")], dtype=np.int64) for t in rows.words]
    held = int(rows.provider.sum())
    index = FMIndex(sequences[:held], rows.doc_id.to_numpy()[:held], WINDOW)
    length, row, first = index.matching_statistics(sequences)
    n = rows.n.to_numpy().astype(np.int64)
    passage = np.repeat(np.arange(len(n)), n)
    off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = first[passage] + off
    found = length[at] >= WINDOW
    passage, off = passage[found], off[found]
    low = index.group_owner[index.group[row[at[found]]]]
    return _stretches(rows, passage, off, low)


def _stretches(rows: pd.DataFrame, passage: np.ndarray, off: np.ndarray, low: np.ndarray) -> pd.DataFrame:
    new = (passage[1:] != passage[:-1]) | (low[1:] != low[:-1]) | (off[1:] != off[:-1] + 1)
    head = np.flatnonzero(np.concatenate(([True], new))[:len(low)])
    size = np.diff(np.append(head, len(low)))
    p = passage[head]
    return pd.DataFrame({"key": rows.key.to_numpy()[p], "content": rows.content.to_numpy()[p], "fine": rows.fine.to_numpy()[p],
                         "off": off[head].astype(np.int32), "len": size.astype(np.int32), "low": low[head]})


FOUND = "key bigint, content bigint, fine boolean, off int, len int, low bigint"


def _windows(hot: DataFrame) -> DataFrame:
    """Each window of the passages of hot keys as a passage of its own: its words, its digest as
    (fine_key, fine_content), and where it is (key, content, off)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.pieces(whole, "words", 20_000):              # a passage becomes up to WINDOW times as long
                out = []
                for r in b.to_pylist():
                    words = r["words"].split(" ")
                    for i in range(r["n"]):
                        window = " ".join(words[i:i + WINDOW])
                        out.append((*struct.unpack("<qq", hashlib.blake2b(window.encode(), digest_size=16).digest()),
                                    r["key"], r["content"], i, r["doc_id"], r["provider"], window))
                cols = list(zip(*out)) or [[]] * 8
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 names=["fine_key", "fine_content", "key", "content", "off", "doc_id", "provider", "words"])

    return hot.mapInArrow(run, "fine_key bigint, fine_content bigint, key bigint, content bigint, off int, doc_id bigint, "
                               "provider boolean, words string")


def _found(cut: DataFrame) -> DataFrame:
    """key, content, off, len and low of every stretch of windows found in an index."""
    windows = _windows(cut.where("hot"))
    fine = (windows.groupBy(F.col("fine_key").alias("key"), F.col("fine_content").alias("content"))
            .agg(F.min("doc_id").alias("doc_id"), F.max("provider").alias("provider"), F.first("words").alias("words")))
    names = ["key", "content", "doc_id", "provider", "n", "words", "fine"]
    every = (cut.where("NOT hot").withColumn("fine", F.lit(False)).select(*names)
             .unionByName(fine.withColumns({"n": F.lit(1), "fine": F.lit(True)}).select(*names)))
    most = cut.agg(F.coalesce(F.sum(F.when(F.col("hot"), F.col("n")).otherwise(1)), F.lit(0))).first()[0]
    shards = max(1, -(-most // SHARD_PASSAGES))
    found = materialize(every.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).groupBy("shard").applyInPandas(_search, FOUND), "found")
    of_windows = found.where("fine").select(F.col("key").alias("fine_key"), F.col("content").alias("fine_content"), "low")
    back = windows.select("fine_key", "fine_content", "key", "content", "off").join(of_windows, ["fine_key", "fine_content"])
    return found.where("NOT fine").select("key", "content", "off", "len", "low").unionByName(
        back.select("key", "content", "off", F.lit(1).alias("len"), "low"))


def repeats(docs: DataFrame) -> DataFrame:
    """row_key and spans (first word and end of the words to remove) of every document that has any."""
    C.small_batches(docs.sparkSession)
    every = runs(docs)
    shared = every.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    some = materialize(every.join(shared, "key"), "runs")
    distinct = some.groupBy("key", "content").agg(F.min(F.struct("doc_id", "row_key", "start", "n")).alias("p"), F.max("doc_id").alias("last"))
    distinct = materialize(distinct.select("key", "content", "p.*", "last"), "passage-places")
    of_key = distinct.groupBy("key").agg((F.count("*") > HOT_PASSAGES).alias("hot"), F.max("last").alias("hi"))
    places = distinct.join(of_key, "key").withColumn("provider", F.col("doc_id") < F.col("hi"))
    found = _found(materialize(passages(places, docs), "passages"))
    spans = (some.join(found, ["key", "content"]).where("low < doc_id")
             .select("row_key", F.struct((F.col("start") + F.col("off")).alias("first"),
                                         (F.col("start") + F.col("off") + F.col("len") + WINDOW - 1).alias("end")).alias("span")))
    return spans.groupBy("row_key").agg(F.collect_set("span").alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every document."""
    rows = docs.select(C.row_key("doc_id", "text").alias("row_key"), "doc_id", "text").join(repeats(docs), "row_key", "left")
    fields = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())]

    def fn(b: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for text, spans in zip(C.texts_of(b), b.column(b.schema.get_field_index("spans")).to_pylist()):
            words = _FIND(text)
            kept = words
            if spans:
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for s in spans:
                    gone[s["first"]] += 1
                    gone[s["end"]] -= 1
                kept = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
            out.append((len(words), len(words) - len(kept), " ".join(kept)))
        cols = list(zip(*out)) or [[], [], []]
        return [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]

    return C.map_rows(rows, ["row_key", "doc_id"], fields, fn)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words, removed words and the digest of what is kept, per document."""
    out = remove_repeats(C.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


# The plain statement: every window as text, its smallest id, the covered positions taken away.
OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
low AS (SELECT h, min(doc_id) AS m FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM windows JOIN low USING (h) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t
  FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
