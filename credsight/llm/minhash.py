"""Near-duplicate components by a multi-index Hamming join over b-bit MinHash signatures.

A document's set is its distinct word shingles.  ``HASHES`` minimum hashes, cut
to ``BITS`` bits, form its signature; the distance of two signatures is the
number of values that differ.  Signatures are split into ``CHUNKS`` chunks.  Two
signatures at distance ``ERRORS`` or less differ in at most
``ERRORS // CHUNKS`` values of some chunk (pigeonhole), so every chunk is
indexed once for each way to leave that many of its values out, and all pairs
under the threshold share an index key.  At a Jaccard similarity of 0.8 the
distance is 9.6 of 48 on average with a deviation of 2.8; ``ERRORS`` = 23 lies
4.8 deviations above it.  Links are confirmed on the full sets.

Documents with equal sets are one node.  Links only matter for components, so no
list of pairs is made; every step emits at most one edge per node and group:

1. In every index key, nodes near the key's hub (its smallest node) are tied to it.
   Only keys with other nodes are searched further: those nodes against all nodes
   of the key, in blocks.  Components of these ties are families: all pairs under
   the threshold lie inside one.
2. A family's full sets meet in blocks of ``BLOCK_SHINGLES``, each with the family's
   hub, and the linked components of the block are found exactly.  Where a family
   has more than one block, nodes not connected to the hub are held against all
   its other blocks.

Defined cases: a null text, or one without words, has an empty set and is linked
with nothing; fewer than ``WORDS`` words form one shingle; repeated rows are
documents of their own in one component; a null id never is the smallest unless
its component has no other; an empty table gives an empty table.

Scale: texts are read once for signatures and once to confirm links; only those of family
members are shuffled, to their keys and to their groups, unless there are more than
``SENT_KEYS`` members: then all texts are shuffled to the keys once.  A key that holds a third of all
nodes is pre-aggregated to its hub and joined by a join that Spark can split, and
costs one comparison per node if its nodes are near the hub.  Inside a group a node
is only compared with those not yet connected, so that a group of near copies costs
little more than its size.  Intermediate tables are written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from ..session import materialize
from . import common as C

WORDS, PERCENT = 4, 80
HASHES, CHUNKS, BITS, ERRORS = 48, 12, 16, 23
BLOCK_ROWS, BLOCK_SHINGLES = 2000, 500_000
SENT_KEYS = 2_000_000        # up to this many family members, their keys are sent to the texts
_SALT = C.mix(np.arange(1, HASHES + 1, dtype=C.U64))
_ODD = C.mix(np.arange(1001, HASHES + 1001, dtype=C.U64)) | C.U64(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a batch."""
    w = C.Words(column, lower=True)
    grams = C.gram_hashes(w.hash, words)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= words:
            yield np.unique(grams[a:b - words + 1])
        elif b > a:
            yield C.gram_hashes(w.hash[a:b], b - a)
        else:
            yield np.zeros(0, dtype=C.U64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Signature (HASHES values of BITS bits) of each non-empty set."""
    out = np.zeros((len(sets), HASHES), dtype=np.uint16)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 1 << 15):
            size += len(sets[last])
            last += 1
        block = np.concatenate(sets[first:last])
        at = np.cumsum([0] + [len(x) for x in sets[first:last - 1]])
        for j in range(HASHES):
            out[first:last, j] = np.minimum.reduceat((block ^ _SALT[j]) * _ODD[j], at) & C.U64((1 << BITS) - 1)
        first = last
    return out


def index_keys(sig: np.ndarray) -> np.ndarray:
    """Keys of each signature: every chunk, once for each choice of values left out."""
    size, off = HASHES // CHUNKS, ERRORS // CHUNKS
    keys = []
    for c in range(CHUNKS):
        part = sig[:, c * size:(c + 1) * size].astype(C.U64)
        for n, kept in enumerate(combinations(range(size), size - off)):
            h = np.full(len(sig), c * 64 + n + 1, dtype=C.U64)
            for i in kept:
                h = C.mix(h * C.U64(0xD6E8FEB86659FD93) + part[:, i])
            keys.append(h)
    return np.stack(keys, axis=1).view(np.int64)


def sketch(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, n_shingles, set_key and signature of every document."""
    rows = docs.select(C.row_key("doc_id", "text").alias("row_key"), "doc_id", "text")
    fields = [StructField("n_shingles", LongType()), StructField("set_key", BinaryType()), StructField("sig", BinaryType())]

    def fn(b: pa.RecordBatch) -> list[pa.Array]:
        sets = list(shingle_sets(b.column(b.schema.get_field_index("text"))))
        some = [i for i, s in enumerate(sets) if len(s)]
        sig = [None] * len(sets)
        if some:
            for i, row in zip(some, signatures([sets[i] for i in some])):
                sig[i] = row.tobytes()
        keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sig, pa.binary())]

    return C.map_rows(rows, ["row_key", "doc_id"], fields, fn)


def _keys(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
                keys = index_keys(sig)
                node = np.repeat(b.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key bigint, node bigint")


def connect(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """First node of each node's component; ``near(i, js)`` tells which of ``js`` node i touches."""
    label, left = np.arange(n), np.arange(n)
    while len(left):
        first, left = left[0], left[1:]
        queue = [first]
        while queue and len(left):
            hit = near(queue.pop(), left)
            if hit.any():
                label[left[hit]] = first
                queue.extend(left[hit].tolist())
                left = left[~hit]
    return label


def near_by_signature(sig: np.ndarray) -> Callable[[int, np.ndarray], np.ndarray]:
    return lambda i, js: (sig[js] != sig[i]).sum(axis=1) <= ERRORS


def linked_sets(sets: list[np.ndarray], percent: int = PERCENT) -> Callable[[int, np.ndarray], np.ndarray]:
    """Whether the Jaccard similarity of set i and each set of js is percent / 100 or more, exactly."""
    sizes = np.array([len(x) for x in sets])
    first = np.concatenate(([0], np.cumsum(sizes)))
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(names), dtype=np.int64)

    def near(i: int, js: np.ndarray) -> np.ndarray:
        out = (100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i]))
        some = js[out]
        if len(some):
            own = ids[first[i]:first[i + 1]]
            mark[own] = 1
            n = sizes[some]
            at = np.repeat(first[some] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            both = np.add.reduceat(mark[ids[at]], np.concatenate(([0], np.cumsum(n)[:-1])))
            mark[own] = 0
            out[out] = 100 * both >= percent * (n + sizes[i] - both)
        return out

    return near


def _edges(node: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    tied = np.flatnonzero(label != np.arange(len(node)))
    return pd.DataFrame({"a": node[tied], "b": node[label[tied]]})


def _near_edges(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates("node").sort_values("node")
    sig = np.frombuffer(b"".join(rows.sig), dtype=np.uint16).reshape(-1, HASHES)
    return _edges(rows.node.to_numpy(), connect(len(rows), near_by_signature(sig)))


def _linked_edges(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates("node").sort_values("node")
    sets = list(shingle_sets(pa.array(rows.text, pa.large_string())))
    return _edges(rows.node.to_numpy(), connect(len(rows), linked_sets(sets)))


def _hub_distance(rows: DataFrame) -> DataFrame:
    """node, hub and whether the node is near the hub, from both signatures."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, hub = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint16).reshape(-1, HASHES) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((own != hub).sum(axis=1) <= ERRORS)],
                                                 names=["node", "hub", "near"])

    return rows.select("node", "hub", "sig", "hub_sig").mapInArrow(run, "node bigint, hub bigint, near boolean")


def _meet(rest: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """Rows (key, r, e, node): each block of ``rest`` beside each block of ``every``.  Both have the key,
    node, and n_rest and n_every, the numbers of blocks of that key."""
    zero = F.lit(0).cast("bigint")
    r = rest.select(key, F.pmod(F.xxhash64("node"), F.col("n_rest")).alias("r"),
                    F.explode(F.sequence(zero, F.col("n_every") - 1)).alias("e"), "node")
    e = every.select(key, F.explode(F.sequence(zero, F.col("n_rest") - 1)).alias("r"),
                     F.pmod(F.xxhash64("node"), F.col("n_every")).alias("e"), "node")
    return r.unionByName(e)


def families(nodes: DataFrame) -> DataFrame:
    """node -> family for every node under the distance threshold of another."""
    keys = _keys(nodes)
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub < other").drop("other")
    shared = materialize(keys.join(hubs, "key"), "shared")    # only keys of two nodes or more
    sig = nodes.select("node", "sig")
    pairs = shared.where("node <> hub").select("node", "hub").distinct()      # many keys share a pair: one distance each
    both = pairs.join(sig, "node").join(sig.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    distance = materialize(_hub_distance(both), "distances")
    ties = distance.where("near").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    judged = shared.join(distance, ["node", "hub"], "left").select("key", "node", F.coalesce("near", F.lit(True)).alias("near"))
    judged = materialize(judged, "judged")
    sizes = (judged.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("far")).where("far > 0")
             .select("key", F.ceil(F.col("far") / BLOCK_ROWS).alias("n_rest"), F.ceil(F.col("n") / BLOCK_ROWS).alias("n_every")))
    every = judged.join(sizes, "key")
    groups = _meet(every.where("NOT near"), every, "key").join(sig, "node")
    more = groups.groupBy("key", "r", "e").applyInPandas(_near_edges, "a bigint, b bigint")
    # a node has one smaller neighbour per key at most: tie it to the least, and the others to that one
    stars = ties.unionByName(more).groupBy("a").agg(F.collect_set("b").alias("all")).withColumn("b", F.array_min("all"))
    stars = materialize(stars, "stars")
    others = stars.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()
    return components(stars.select("a", "b").unionByName(others)).withColumnRenamed("root", "family")


def links(family: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what is linked inside the families, confirmed on full sets."""
    texts = docs.select(C.row_key("doc_id", "text").alias("row_key"), "text")
    members = materialize(family.join(nodes.select("node", "row_key", "n_shingles"), "node"), "members")
    if members.count() <= SENT_KEYS:              # texts of no family stay where they are; the joins below compare whole keys
        sent = members.select(F.xxhash64("row_key").alias("_hash")).distinct()
        texts = texts.join(F.broadcast(sent), F.xxhash64("row_key") == F.col("_hash"), "left_semi")
    blocks = F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)
    sizes = members.groupBy("family").agg(F.min("node").alias("hub"), blocks.alias("blocks"))
    zero = F.lit(0).cast("bigint")

    def confirmed(groups: DataFrame, *by: str) -> DataFrame:
        rows = texts.join(groups.join(nodes.select("node", "row_key"), "node"), "row_key")
        return materialize(rows.groupBy(*by).applyInPandas(_linked_edges, "a bigint, b bigint"), "links")

    own = members.join(sizes, "family").select("family", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), "node")
    hubs = sizes.where("blocks > 1").select("family", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.col("hub").alias("node"))
    edges = confirmed(own.unionByName(hubs), "family", "block")

    large = members.join(sizes.where("blocks > 1"), "family")
    root = components(edges)
    large = large.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    at_hub = large.where("node = hub").select("family", F.col("root").alias("hub_root"))
    large = materialize(large.join(at_hub, "family"), "large")
    rest = large.where("root <> hub_root")
    n_rest = rest.groupBy("family").agg(blocks.alias("n_rest"))
    if n_rest.isEmpty():                          # no family has more than one block, or its hub holds all of it
        return edges
    rest = rest.join(n_rest, "family").withColumnRenamed("blocks", "n_every")
    every = large.join(n_rest, "family").withColumnRenamed("blocks", "n_every")
    return edges.unionByName(confirmed(_meet(rest, every, "family"), "family", "r", "e"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable over the undirected edges (a, b), for every node of an edge."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    now = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        near = both.join(now, both.b == now.node).groupBy("a").agg(F.min("root").alias("low"))
        step = now.join(near, now.node == near.a).select("node", "root", F.least("root", "low").alias("new"))
        up = now.select(F.col("node").alias("new"), F.col("root").alias("above"))
        now = materialize(step.join(up, "new", "left").select("node", F.least("new", "above").alias("root"),
                                                              (F.least("new", "above") < F.col("root")).alias("moved")), "labels")
        if now.where("moved").isEmpty():
            return now.select("node", "root")
        now = now.select("node", "root")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """row_key, doc_id, n_shingles, component (a number; null for an empty set), component_id and kept
    of every document."""
    C.small_batches(docs.sparkSession)
    sketches = materialize(sketch(docs), "sketches")
    nodes = (sketches.where("n_shingles > 0").groupBy("set_key")
             .agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("lowest"),
                  F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
             .withColumn("node", F.monotonically_increasing_id()))
    nodes = materialize(nodes, "nodes")                       # from here on the numbers are fixed

    root = components(links(materialize(families(nodes), "families"), nodes, docs))
    node_root = materialize(nodes.select("node", "set_key", "lowest").join(root, "node", "left")
                            .select("set_key", "lowest", F.coalesce("root", "node").alias("top")), "roots")
    lowest = node_root.groupBy("top").agg(F.min("lowest").alias("component_id"))
    found = materialize(node_root.join(lowest, "top").select("set_key", "component_id", F.col("top").alias("component")), "components")
    out = sketches.select("row_key", "doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    return out.select("row_key", "doc_id", "n_shingles", "component",
                      F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
                      ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """One row of ``docs`` per component, that of the smallest id (null last; of several rows of that id
    the one of the smallest key), and one of rows that are equal and have an empty set."""
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    grouped = judged.where("component IS NOT NULL").groupBy("component").agg(F.min_by("row_key", first).alias("_kept_key"))
    empty = judged.where("component IS NULL").select(F.col("row_key").alias("_kept_key")).distinct()
    named = C.packed(docs, _kept_key=C.row_key("doc_id", "text"))
    kept = named.join(grouped.select("_kept_key").unionByName(empty), "_kept_key").dropDuplicates(["_kept_key"])
    return C.unpacked(kept, docs.columns)


def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Set size, component and verdict of every document."""
    return near_duplicates(C.read(spark, sf_dir, "documents").select("doc_id", "text")).drop("row_key", "component")


# The plain statement: all pairs that share a shingle, counted; components by closure.
OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4
      THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * n_both >= 80 * (p.n + q.n - n_both)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN low ON doc_id = a
"""
