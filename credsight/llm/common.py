"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* Input columns other than the ones an operator names are ignored or passed
  through; an input column that carries the name of a result column is
  replaced by the result.
* A null text is treated as stated by each operator (empty, or no words).
* Words are maximal runs of bytes other than space and ``\\t..\\r``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..session import materialize

WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
_MULT = 0xD6E8FEB86659FD93                      # odd multiplier of the rolling hashes


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(*cols: str) -> Column:
    """128-bit key of a row from its identifying columns; equal rows share it.  Every value goes
    in with its length and a null with a mark of its own, so no value moves over to its neighbour."""
    def told(c: str) -> Column:
        value = F.col(c).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("n"))

    return F.unhex(F.md5(F.concat(*map(told, cols))))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """The rows of ``df`` as one struct ``_row`` and the columns ``more``, whatever names the columns of ``df`` have."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in more.items()])


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the struct ``_row``."""
    return df.select(*[F.col("_row")[c].alias(c) for c in columns])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it for every element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def map_rows(df: DataFrame, keep: list[str], fields: list[StructField],
             fn: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """Add ``fields``, computed batch by batch in Python by ``fn``, to the columns
    ``keep`` of ``df``.  Every partition is independent, one output row per input row."""
    names = {f.name for f in fields}
    kept = [c for c in keep if c not in names]
    schema = StructType([df.schema[c] for c in kept] + list(fields))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                made = [a.cast(arrow.field(len(kept) + i).type) for i, a in enumerate(fn(b))]
                old = [b.column(b.schema.get_field_index(c)).cast(arrow.field(i).type) for i, c in enumerate(kept)]
                yield pa.RecordBatch.from_arrays(old + made, schema=arrow)
        pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python in batches of at most ``rows`` rows: a batch of long texts must
    fit in a worker beside the arrays made of it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a piece hold about ``most`` bytes (one row at least)."""
    at = batch.schema.get_field_index(text)
    if at < 0 or batch.num_rows < 2:
        yield batch
        return
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(at)), 0), dtype=np.int64))
    first = 0
    while first < batch.num_rows:
        base = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch as Python strings, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


HOT_SHARE = 10_000          # a key with more than 1/10 000 of all rows is hot: fewer than 10 000 keys are


def join_unique(rows: DataFrame, one: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which holds one row a key and in ``count`` how many
    rows have it.  Hot keys are joined by broadcast, the rest by shuffle."""
    total = one.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    is_hot = F.col(count) * HOT_SHARE > total
    hot = F.broadcast(one.where(is_hot).drop(count))                     # fewer than HOT_SHARE rows
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(one.where(~is_hot).drop(count), keys))


def ranked(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with the 0-based position of each row in the total order ``order``: range
    slices, a count per slice, and a position inside the slice."""
    sliced = materialize(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "slices")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy("_slice").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) - 1
    return (sliced.withColumn("_at", inside).join(F.broadcast(counts.select("_slice", "_before")), "_slice")
            .withColumn(out, (F.col("_before") + F.col("_at")).cast("bigint")).drop("_slice", "_before", "_at"))


# ---------------------------------------------------------------- hashing of words

def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of ``h`` over 64 bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _byte_values(lower: bool) -> np.ndarray:
    t = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
    if lower:
        t[65:91] = t[97:123]
    return t


_VALUES = {False: _byte_values(False), True: _byte_values(True)}
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, 0 to n."""
    have = _POWERS.get("p")
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        p = np.full(size, _MULT, dtype=U64)
        q = np.full(size, pow(_MULT, -1, 1 << 64), dtype=U64)
        p[0] = q[0] = 1
        _POWERS["p"], _POWERS["q"] = np.cumprod(p, dtype=U64), np.cumprod(q, dtype=U64)
    return _POWERS["p"], _POWERS["q"]


class Words:
    """Words of a batch of texts as arrays: byte ``start`` and ``end`` of each word in
    ``data``, its 64-bit ``hash``, and ``first[i]:first[i + 1]`` as the words of text ``i``."""

    def __init__(self, column: pa.Array, lower: bool = False):
        col = column.cast(pa.large_string())
        col = pa.concat_arrays([col])            # drops the offset of a sliced array
        n = len(col)
        off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1]
        raw = col.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[off[0]:off[n]] if raw is not None and n else np.zeros(0, np.uint8)
        off = off - off[0] if n else np.zeros(1, np.int64)
        self.data, self.offsets, self.rows = data, off, n
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        cut = off[1:-1]
        cut = cut[cut < len(data)]
        begins[cut] = inside[cut]                # a text's first byte never continues the text before
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        cut = cut[cut > 0]
        ends[cut - 1] = inside[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off, side="left")
        p, q = powers(len(data))
        pref = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(_VALUES[lower][data] * p[:len(data)], out=pref[1:])
        self.hash = mix((pref[self.end] - pref[self.start]) * q[self.start]
                        ^ (self.end - self.start).astype(U64) * U64(0x9E3779B97F4A7C15))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (positions that have n words)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    h = np.full(m, n, dtype=U64)
    for i in range(n):
        h = h * U64(_MULT) + words[i:i + m]
    return mix(h)
