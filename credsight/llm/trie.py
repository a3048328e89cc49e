"""Prefix trie of conversations by whole-sequence collapse.

A conversation is a sequence of turns; a prefix is named by 128 bits, the xor of the
tagged hashes of its turns (a tag is the turn's depth, a turn is its SHA-256).  Then

* identical conversations collapse into one weighted sequence with its list of ends;
* sequences that are a proper prefix of another drop out by an anti-join: what stays are
  the leaves;
* the prefixes of the weighted sequences are aggregated, one row a distinct prefix.

Sums over subtrees need no walk: the part that counts members is a sum over the sequences
below a node, and the part that counts each node once is a sum over leaves, every node
being owned by the smallest leaf below it (what one leaf owns is a stretch of its path).

Defined cases: rows without a conv_id belong to no conversation and are left out; a null
role or text is empty; turns are ordered by turn (null first), ties by role, then text;
repeated rows are repeated turns; extra columns are ignored; an empty table gives an empty
table (no member, no root).

Scale: texts are shuffled once, into range slices; everything after that works on digests.
Positions and prefixes are running totals inside a slice plus a carry for conversations
that cross slices (at most two rows a slice), so one very long conversation is spread.
Joins on a key that may be hot go through ``common.join_unique``.  The digest of an end list is
sequential by definition: its ids are sorted and written out in chunks before one task
streams the chunks of a sequence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C

CHUNK_BITS = 13             # ends written out together: 8192


def in_slices(rows: DataFrame, by: list[Column], order: list[Column], *columns: str | Column) -> DataFrame:
    """``columns`` of ``rows`` as a written table in the order ``order`` (rows equal in ``by``
    share a slice): ``_at`` counts rows inside a slice, ``_slice`` numbers the slices in order."""
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    written = materialize(dealt.select(*columns, at.alias("_at")), "trie-slices")
    return written.withColumn("_slice", F.shiftright("_at", 33))


def running(sliced: DataFrame, key: str, sums: dict[str, Column], xors: dict[str, Column]) -> DataFrame:
    """Inclusive running totals per ``key`` in the order of the slices, as new columns."""
    add = {n: (F.sum(c), lambda a, b: a + b) for n, c in sums.items()}
    add |= {n: (F.bit_xor(c), lambda a, b: a.bitwiseXOR(b)) for n, c in xors.items()}
    totals = sliced.groupBy("_slice", key).agg(*[total.alias(n) for n, (total, _) in add.items()])
    across = Window.partitionBy(key)
    before = across.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = (totals.withColumn("_parts", F.count(F.lit(1)).over(across)).where("_parts > 1")
             .select("_slice", key, *[(F.sum(n) if n in sums else F.bit_xor(n)).over(before).alias(f"_c_{n}") for n in add]))
    inside = Window.partitionBy("_slice", key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    made = sliced.select("*", *[total.over(inside).alias(f"_r_{n}") for n, (total, _) in add.items()])
    made = made.join(F.broadcast(carry), ["_slice", key], "left")        # two rows a slice at most
    named = [both(F.col(f"_r_{n}"), F.coalesce(f"_c_{n}", F.lit(0))).cast("bigint").alias(n) for n, (_, both) in add.items()]
    return made.select(*sliced.columns, *named)


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), digest and words of every turn, in order."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    first = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    sliced = in_slices(rows, [*first, F.substring("text", 1, 40)], [*first, F.col("text")], "conv_id", digest.alias("digest"),
                       F.regexp_count("text", F.lit(C.WORD)).cast("bigint").alias("words"))
    return running(sliced, "conv_id", {"depth": F.lit(1)}, {}).select("conv_id", "depth", "digest", "words")


def end_digests(ends: DataFrame) -> DataFrame:
    """p1, p2 and ends_sha256: the digest of the ids of each sequence, ascending, comma-joined."""
    order = [F.col("p1"), F.col("p2"), F.col("conv_id")]
    at = F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS).alias("chunk")
    sliced = ends.repartitionByRange(*order).sortWithinPartitions(*order).select("p1", "p2", "conv_id", at)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = sliced.groupBy("p1", "p2", "chunk").agg(listed.alias("ids"))        # 2**CHUNK_BITS ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, digest = None, None
        for batch in batches:
            done = []
            for p1, p2, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (p1, p2) != open_key:
                    if open_key is not None:
                        done.append((*open_key, digest.hexdigest()))
                    open_key, digest = (p1, p2), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield _rows(done)
        if open_key is not None:
            yield _rows([(*open_key, digest.hexdigest())])

    dealt = chunks.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "chunk").select("p1", "p2", "ids")
    return dealt.mapInArrow(run, "p1 bigint, p2 bigint, ends_sha256 string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))],
                                      names=["p1", "p2", "ends_sha256"])


def prefix_paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation of ``convs`` and depth, 0 included: the prefix (p1, p2), the prefix
    before it (q1, q2), words of its last turn and of all its turns."""
    tagged = turns.select("conv_id", "depth", "words", *[F.xxhash64(F.lit(i), "depth", "digest").alias(f"x{i}") for i in (1, 2)])
    sliced = in_slices(tagged, [F.col("conv_id"), F.col("depth")], [F.col("conv_id"), F.col("depth")],
                       "conv_id", "depth", "words", "x1", "x2")
    paths = running(sliced, "conv_id", {"total": F.col("words")}, {"p1": F.col("x1"), "p2": F.col("x2")}).select(
        "conv_id", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"),
        F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "words", "total")
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv_id", *[zero.alias(c) for c in paths.columns[1:]])
    return materialize(paths.unionByName(roots), "trie-paths")


def weighted_sequences(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sequences, ends).  A sequence: p1, p2, weight, rep (its smallest conversation), n
    (depth), n_rows (of rep in ``paths``) and total words; ends: p1, p2, conv_id."""
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2", "total")).alias("l")).select("conv_id", "l.*")
    last = materialize(last, "trie-ends")
    sequences = last.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("rep"),
                                             F.max("depth").alias("n"), F.max("total").alias("all_words"))
    return (materialize(sequences.withColumn("n_rows", F.col("n") + 1), "trie-sequences"), last.select("p1", "p2", "conv_id"))


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of the conversations ``convs`` (conv_id) with turns
    ``turns`` (conv_id, depth from 1 without gaps, digest, words): the node's prefix
    (p1, p2), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    paths = prefix_paths(turns, convs)
    sequences, ends = weighted_sequences(paths)
    key = ["p1", "p2"]
    of_rep = sequences.select(F.col("rep").alias("conv_id"), "weight", "n", "all_words", "n_rows")
    kept = materialize(C.join_unique(paths, of_rep, ["conv_id"], "n_rows"), "trie-prefixes")

    inner = kept.where("depth < n").select(*key).distinct()
    leaves = sequences.join(inner, key, "left_anti").select(F.col("rep").alias("conv_id"), "n_rows")
    leaves = materialize(leaves, "trie-leaves")
    leafy = materialize(C.join_unique(kept, leaves, ["conv_id"], "n_rows"), "trie-leaf-prefixes")
    below = leafy.groupBy(*key).agg(F.count(F.lit(1)).alias("n_leaves"), F.min("conv_id").alias("owner"))
    nodes = kept.groupBy(*key).agg(
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("weight") * F.col("all_words")).alias("counted"),
        *[F.max(c).alias(c) for c in ("depth", "q1", "q2", "words", "total")])
    nodes = materialize(nodes.join(below, key).withColumn("before", F.col("total") - F.col("words")), "trie-nodes")

    # words of the nodes that a leaf owns: from the first such node to its end
    start = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("before").alias("start"))
    start = start.join(leaves, "conv_id")
    shares = C.join_unique(leafy, start, ["conv_id"], "n_rows").withColumn("owned", F.col("all_words") - F.col("start"))
    shares = shares.groupBy(*key).agg(F.sum("owned").alias("owned"),
                                      F.min(F.struct("conv_id", "all_words", F.col("owned").alias("owned"))).alias("own"))

    inner_nodes = nodes.where("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = nodes.join(inner_nodes, key).select(F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                                                  F.col("conv_id").alias("parent_conv_id"), "n_children")
    with_parent = C.join_unique(nodes.where("depth > 0"), parents, ["q1", "q2"], "n_children")
    root = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))

    once = (F.col("own.all_words") - F.col("before")) + F.col("owned") - F.col("own.owned")
    members = F.col("counted") - F.col("n_convs") * F.col("before")
    return (with_parent.unionByName(root.select(*with_parent.columns))
            .join(shares, key).join(inner_nodes, key, "left").join(end_digests(ends), key, "left")
            .select(*key, "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                    "n_leaves", (members - once).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def rebuild(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of the rebuilt conversations: the first h turns of conversation
    ``c - c % group``, then c's own turns after its first h; h is the checksum of c, modulo ``most``."""
    n = turns.groupBy("conv_id").agg(F.max("depth").alias("n_rows"))
    heads = turns.where((F.col("conv_id") % group == 0) & (F.col("depth") < most)).groupBy(F.col("conv_id").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "digest", "words"))).alias("head"))          # most - 1 turns at most
    convs = (n.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
             .withColumn("h", F.crc32(F.col("conv_id").cast("string")) % most).join(heads, "base", "left")
             .select("conv_id", "n_rows", "h", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h").cast("int")).alias("head")))
    convs = materialize(convs, "trie-convs")
    own = C.join_unique(turns, convs.select("conv_id", "n_rows", "h", F.size("head").alias("k")), ["conv_id"], "n_rows")
    own = own.where(F.col("depth") > F.col("h")).select("conv_id", (F.col("depth") - F.col("h") + F.col("k")).alias("depth"),
                                                        "digest", "words")
    taken = convs.select("conv_id", F.inline("head")).select("conv_id", "depth", "digest", "words")
    return own.unionByName(taken), convs.select("conv_id")


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt over shared beginnings."""
    turns = materialize(number_turns(C.read(spark, sf_dir, "conversations")), "trie-turns")
    return prefix_trie(*rebuild(turns)).drop("p1", "p2")


# The plain statement: every prefix spelled out as a string, every (ancestor, node) pair listed.
OP12_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i AS v FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
sums AS (
  SELECT DISTINCT conv_id, 1 AS pos, 4294967295::BIGINT AS c FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT conv_id, pos + 1, xor(c >> 8, v) FROM sums
  JOIN bits ON k = 8 AND i = xor(c, ord(substring(conv_id::VARCHAR, pos, 1))) & 255
  WHERE pos <= length(conv_id::VARCHAR)),
convs AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM sums WHERE pos = length(conv_id::VARCHAR) + 1),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h),
steps AS (
  SELECT conv_id, row_number() OVER one AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    string_agg(sha256(concat(length(role), ':', role, text)), '') OVER (
      PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING) AS path
  FROM rebuilt WINDOW one AS (PARTITION BY conv_id ORDER BY part, pos)),
members AS (SELECT conv_id, depth, words, path FROM steps UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    CASE WHEN path <> '' THEN left(path, length(path) - 64) END AS up FROM members GROUP BY path),
children AS (SELECT up AS path, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
pairs AS (SELECT DISTINCT a.path AS top, b.path FROM members a JOIN members b USING (conv_id) WHERE a.depth <= b.depth),
below AS (
  SELECT top AS path, sum((n_convs - 1) * words) AS saved, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM pairs JOIN nodes USING (path) LEFT JOIN children USING (path) GROUP BY top),
ends AS (
  SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (
    SELECT conv_id, arg_max(path, depth) AS path FROM members GROUP BY conv_id) GROUP BY path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN below USING (path) LEFT JOIN children USING (path) LEFT JOIN ends USING (path) LEFT JOIN nodes p ON p.path = n.up
"""
