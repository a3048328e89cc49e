"""Upserts into a stored table: touched buckets only, old table after a crash, rejects, repeated loads."""

import pytest
from pyspark.sql import functions as F

from credsight.session import fresh_scratch
from credsight.sources.keyed_table import KeyedTable


def rows(table):
    return sorted((r.k, r.v) for r in table.read().collect())


def test_second_load_rewrites_its_buckets_only(spark):
    table = KeyedTable(spark, fresh_scratch(spark, "keyed"), "k", "seq", buckets=16)
    with pytest.raises(LookupError):
        table.read()
    first = spark.range(200).select(F.col("id").cast("string").alias("k"), (F.col("id") * 1.0).alias("v"), F.lit(1).alias("seq"))
    assert table.upsert(first).count() == 0 and len(rows(table)) == 200
    before = table.manifest()
    again = spark.createDataFrame([("7", 70.0, 2), ("new", 1.0, 2), (None, 5.0, 2), ("9", 0.0, 0)], "k string, v double, seq int")
    assert [r.v for r in table.upsert(again).collect()] == [5.0]
    after = table.manifest()
    touched = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(touched) <= 3 and set(before) <= set(after)
    got = dict(rows(table))
    assert got["7"] == 70.0 and got["new"] == 1.0 and got["9"] == 9.0 and len(got) == 201      # an older row loses
    table.upsert(again)
    assert dict(rows(table)) == got                                                            # a repeated load changes nothing
    assert table.clean() > 0 and dict(rows(table)) == got and table.clean() == 0


def test_crash_between_stage_and_publish_leaves_the_old_table(spark):
    table = KeyedTable(spark, fresh_scratch(spark, "keyed"), "k", "seq", buckets=4)
    table.upsert(spark.createDataFrame([("a", 1.0, 1), ("b", 2.0, 1)], "k string, v double, seq int"))
    second = spark.createDataFrame([("a", 10.0, 2)], "k string, v double, seq int")
    entries, _ = table.stage(second)
    assert rows(table) == [("a", 1.0), ("b", 2.0)]
    table.clean()
    table.upsert(second)
    assert rows(table) == [("a", 10.0), ("b", 2.0)]
    table.upsert(second.limit(0))
    assert rows(table) == [("a", 10.0), ("b", 2.0)]
    wider = spark.createDataFrame([("c", 3.0, 3, "x")], "k string, v double, seq int, note string")
    table.upsert(wider)
    assert {r.k: r.note for r in table.read().collect()} == {"a": None, "b": None, "c": "x"}
