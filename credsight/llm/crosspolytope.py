"""Approximate nearest neighbours by cross-polytope hashing.

A table hashes a unit vector by pseudo-rotations (three rounds of random signs and a fast
Hadamard transform); one rotation gives the nearest signed axis, the largest coordinate by
absolute value.  A table's code strings together as many axes as it takes to reach about
``OCCUPANCY`` distinct vectors a bucket (the last rotation full, the first over as many
coordinates as bits are left), so buckets grow with the input, not their contents.

A query probes, per table, the ``T`` codes whose axes have the largest sum of coordinates,
the likeliest buckets of its neighbours.  ``T`` follows from the share of the buckets probed
over all ``TABLES`` tables, ``min(1, PROBED * n ** (-1/3))``: candidates grow as n ** (2/3) a query.
All candidates are scored by the exact cosine in double precision; none is cut off.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components,
take no part, neither do rows without an id; vectors of different length never meet;
identical vectors are hashed once and share their bucket; a repeated row counts once, and
an id with several vectors is asked and found with each; ties go to the smaller id; extra
columns are ignored; an empty table, or one without queries, gives an empty table.

Scale: every row is indexed.  Codes of equal leading bits are a cell; cells, not candidate
pairs, are shuffled: vectors go to one cell a table, a query to the cells that hold its probes,
and each cell hands on its nearest only.  A cell of more than ``BLOCK`` rows (and more than
1/100 000 of all) is split into blocks that all its queries visit; the split list has at most
100 000 rows.  Hashing runs twice, for the cells' sizes and for the search, which costs less
than writing every vector once a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StructField, StructType

from ..session import materialize
from . import common as C

TABLES, OCCUPANCY, PROBED, SEED = 8, 4, 8.0, 20_240_613
CELL_BITS = 12                       # a cell is 4096 neighbouring codes: about 16 000 vectors
BLOCK, SPLITS = 65_536, 100_000
ROOM = 1 << 20                       # codes held at a time while a batch is hashed: 8 MB an array


class Hasher:
    """Codes and probes for vectors of one length in an index of ``n`` distinct vectors."""

    def __init__(self, dim: int, n: int, tables: int = TABLES, probed: float = PROBED, seed: int = SEED):
        self.width = 1 << max(dim - 1, 0).bit_length()
        axis_bits = self.width.bit_length()                       # 2 * width signed axes
        bits = max(1, round(math.log2(max(n / OCCUPANCY, 2))))
        self.bits = [min(axis_bits, bits - at) for at in range(0, bits, axis_bits)][::-1]
        share = min(1.0, probed * max(n, 1) ** (-1 / 3))
        self.probes = min(1 << bits, math.ceil((1 << bits) * share / tables)) if share < 1 else 1 << bits
        self.tables = tables if share < 1 else 1                  # one table that is probed whole has them all
        rng = np.random.default_rng([seed, dim])
        self.signs = rng.choice([-1.0, 1.0], (tables, len(self.bits), 3, self.width))
        self.cell = min(bits, CELL_BITS)
        # most codes that one vector has at a time; as many vectors are hashed together as fit into ROOM codes
        widest = max(min(self.probes, 1 << sum(self.bits[:i])) << b for i, b in enumerate(self.bits))
        self.filed_rows, self.probed_rows = max(1, ROOM // (2 * self.width)), max(1, ROOM // widest)

    def sides(self, unit: np.ndarray, table: int, level: int) -> np.ndarray:
        """Coordinates along every signed axis of one rotation."""
        x = np.zeros((len(unit), self.width))
        x[:, :unit.shape[1]] = unit
        for signs in self.signs[table, level]:
            x = hadamard(x * signs)
        x = x[:, :1 << (self.bits[level] - 1)]
        return np.concatenate([x, -x], axis=1)

    def codes(self, unit: np.ndarray, table: int) -> np.ndarray:
        code = np.zeros(len(unit), np.int64)
        for level in range(len(self.bits)):
            code = (code << self.bits[level]) | self.sides(unit, table, level).argmax(axis=1)
        return code

    def best_codes(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The ``probes`` codes of the largest sums of coordinates, one row a vector."""
        codes, sums = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for level in range(len(self.bits)):
            side = self.sides(unit, table, level)
            codes = ((codes << self.bits[level])[:, :, None] | np.arange(side.shape[1])).reshape(len(unit), -1)
            sums = (sums[:, :, None] + side[:, None, :]).reshape(len(unit), -1)
            if codes.shape[1] > self.probes:                      # a code cut off here is beaten by as many in every extension
                at = np.argpartition(-sums, self.probes - 1, axis=1)[:, :self.probes]
                codes, sums = np.take_along_axis(codes, at, 1), np.take_along_axis(sums, at, 1)
        return codes


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows (their length is a power of two)."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and vec (floats stay floats, other numbers are doubles) of the vectors that can have a cosine."""
    is_float = vectors.schema[embedding].dataType == ArrayType(FloatType())
    vec = F.col(embedding).cast("array<float>" if is_float else "array<double>")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), vec.alias("vec"))
            .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
            .where(F.coalesce(fine, F.lit(False)) & F.exists("vec", lambda x: x != 0)).distinct())


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """One row per distinct vector: gid (its smallest id), vec and its ``most`` smallest ids (copies
    have equal scores, so no more of them can be among the nearest)."""
    key = ["vec", "part"]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for by in (key, key[:1]):                                     # copies of one vector: first in 64 parts
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))
        dealt = dealt.withColumn("rank", rank).where(F.col("rank") <= most)
    ids = F.sort_array(F.collect_list("vec_id"))
    return dealt.groupBy("vec").agg(F.min("vec_id").alias("gid"), ids.alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, which is exact, so that no square overflows or vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with the same row of ``b``; a pair's value doesn't depend on its batch."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _cells(rows: DataFrame, n: int, hashed) -> DataFrame:
    """Rows spread over cells by ``hashed(Hasher, units, table)``: (row, cell, codes) arrays."""
    schema = StructType([StructField("dim", IntegerType()), StructField("tab", IntegerType()), StructField("cell", LongType()),
                         StructField("codes", ArrayType(LongType())), StructField("gid", LongType()), rows.schema["vec"]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(sizes).tolist():
                same = batch.take(pa.array(np.flatnonzero(sizes == dim)))
                if dim not in hashers:
                    hashers[dim] = Hasher(dim, n)
                hasher = hashers[dim]
                step = hasher.probed_rows if hashed is _probed else hasher.filed_rows
                for start in range(0, len(same), step):
                    some = same.slice(start, step)
                    units = unit(_matrix(some.column(1)))
                    for table in range(hasher.tables):
                        row, cell, codes = hashed(hasher, units, table)
                        at = pa.array(row)
                        yield pa.RecordBatch.from_arrays(
                            [c.cast(f.type) for c, f in zip(
                                [pa.array(np.full(len(row), dim)), pa.array(np.full(len(row), table)), pa.array(cell), codes,
                                 some.column(0).take(at), some.column(1).take(at)], arrow)], schema=arrow)

    return rows.select("gid", "vec").mapInArrow(run, schema)


def _filed(hasher: Hasher, units: np.ndarray, table: int):
    code = hasher.codes(units, table)
    single = pa.ListArray.from_arrays(pa.array(np.arange(len(code) + 1, dtype=np.int32)), pa.array(code))
    return np.arange(len(code)), code >> hasher.cell, single


def _probed(hasher: Hasher, units: np.ndarray, table: int):
    codes = np.sort(hasher.best_codes(units, table), axis=1)
    cell = codes >> hasher.cell
    new = np.ones(codes.shape, bool)
    new[:, 1:] = cell[:, 1:] != cell[:, :-1]
    starts = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, codes.size).astype(np.int32)), pa.array(codes.reshape(-1)))
    return starts // codes.shape[1], cell.reshape(-1)[starts], lists


CELL = ["dim", "tab", "cell"]
FOUND = "qid bigint, gid bigint, score double"


def _nearest(k: int):
    """The ``k`` nearest vectors of a block for each query that visits it, by exact cosine
    (ties to the smaller id), among those in the buckets it probes."""
    def search(queries: pd.DataFrame, filed: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qid": [], "gid": [], "score": []})
        if not len(queries) or not len(filed):
            return none
        code = np.array([c[0] for c in filed["codes"]])
        order = np.argsort(code, kind="stable")
        code, gid = code[order], filed["gid"].to_numpy()[order]
        vec = np.stack(filed["vec"].to_numpy()).astype(np.float64)[order]
        units = unit(vec)
        out: list[tuple] = []                             # three arrays a query: frames of a few rows each weigh kilobytes
        for qid, q, codes in zip(queries["gid"], queries["vec"], queries["codes"]):
            q = np.asarray(q, dtype=np.float64)[None, :]
            low, high = np.searchsorted(code, codes), np.searchsorted(code, codes, side="right")
            held = high > low
            if not held.any():
                continue
            at = np.concatenate([np.arange(a, b) for a, b in zip(low[held], high[held])])
            near = units[at] @ unit(q)[0]
            if len(at) > k:                               # the bound leaves room for the rounding of this first product
                at = at[near >= np.partition(near, len(at) - k)[len(at) - k] - 1e-9]
            score = cosines(vec[at], np.broadcast_to(q, (len(at), q.shape[1])))
            best = np.lexsort((gid[at], -score))[:k]
            out.append((np.full(len(best), qid), gid[at][best], score[best]))
        return pd.DataFrame(dict(zip(("qid", "gid", "score"), map(np.concatenate, zip(*out))))) if out else none

    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found for each row where
    ``is_query`` (an expression over ``vec_id``), itself left out."""
    rows = materialize(usable(vectors, vec_id, embedding), "cp-vectors")
    base = materialize(distinct_vectors(rows, k + 1), "cp-distinct")
    n = base.count()
    wanted = rows.where(is_query)
    with_gid = base.select("vec", "gid").join(wanted.groupBy("vec").agg(F.count(F.lit(1)).alias("n")), "vec")
    asked = materialize(C.join_unique(wanted, with_gid, ["vec"], "n"), "cp-queries")
    # dealt out: probing costs far more a row than its few bytes suggest
    cores = rows.sparkSession.sparkContext.defaultParallelism
    probes = _cells(asked.select("gid", "vec").dropDuplicates(["gid"]).repartition(2 * cores), n, _probed)

    filed = _cells(base, n, _filed)
    sizes = materialize(filed.groupBy(*CELL).count(), "cp-sizes")
    most = max(BLOCK, n * TABLES // SPLITS)
    sizes = sizes.where(F.col("count") > most)
    split = F.broadcast(sizes.select(*CELL, F.ceil(F.col("count") / most).cast("int").alias("blocks")))   # SPLITS rows at most
    filed = filed.join(split, CELL, "left").withColumn(
        "block", F.pmod(F.xxhash64("gid"), F.coalesce("blocks", F.lit(1)).cast("bigint")).cast("int")).drop("blocks")
    probes = probes.join(split, CELL, "left").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    by = [*CELL, "block"]
    found = probes.groupBy(*by).cogroup(filed.groupBy(*by)).applyInPandas(_nearest(k + 1), FOUND)
    found = materialize(found.groupBy("qid", "gid").agg(F.max("score").alias("score")), "cp-found")

    order = [F.col("score").desc(), F.col("gid")]
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rank") <= k + 1)
    lists = best.join(base.select("gid", "ids"), "gid").groupBy("qid").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("gid").alias("qid"))
    lists = lists.join(asked.groupBy("qid").agg(F.count(F.lit(1)).alias("n")), "qid")
    pairs = (C.join_unique(asked, lists, ["qid"], "n")
             .select("query_id", F.inline("found")).select("query_id", "score", F.explode("ids").alias("vec_id"))
             .where("vec_id <> query_id"))
    ranks = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return (pairs.withColumn("rank", ranks).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def op13_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    return nearest(C.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
