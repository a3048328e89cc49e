"""Streams: late, repeated, out-of-order and null-keyed rows; retried batches; live control state."""

import datetime as dt
import hashlib
import random

from pyspark.sql import functions as F

from credsight.operators.audit import GENESIS_HASH
from credsight.plans import streaming as PS
from credsight.plans.views import Tables
from credsight.streaming import streams as ST

from .conftest import SF_SMALL

DAY = dt.datetime(2024, 1, 1)


def replay(spark, rows, schema, n):
    return ST.Replay(spark.createDataFrame(rows, f"{schema}, {ST.ARRIVAL} int"), n)


def test_arrivals_keep_every_row(spark):
    df = spark.range(100).select(F.when(F.col("id") % 10 != 0, F.col("id")).cast("string").alias("k"), "id")
    numbered = ST.arrival_by_range(df, "k", 4)
    counts = {r[ST.ARRIVAL]: r["count"] for r in numbered.groupBy(ST.ARRIVAL).count().collect()}
    assert sum(counts.values()) == 100 and set(counts) == {0, 1, 2, 3}
    assert numbered.where("k is null").agg(F.max(ST.ARRIVAL)).first()[0] == 0
    assert ST.arrival_by_range(df, "k", 1).agg(F.max(ST.ARRIVAL)).first()[0] == 0


def test_an_arrival_is_more_than_one_file(spark):
    r = ST.Replay(spark.range(1000).repartition(4).withColumn(ST.ARRIVAL, (F.col("id") % 2).cast("int")), 2)
    r._write(1, "append")
    assert len(spark.read.parquet(r.source).where("id % 2 = 1").select(F.input_file_name()).distinct().collect()) > 1


def test_bounded_landing(spark):
    at = lambda d: DAY + dt.timedelta(days=d)
    rows = [("a", at(0), 0), ("a", at(0), 1), ("b", at(1), 1), ("n", None, 0), ("n", None, 1),
            ("c", at(20), 2), ("old", at(2), 3), ("c", at(20), 3)]
    out, progress = ST.stream_landing_bounded(replay(spark, rows, "id string, at timestamp", 4), "at", "5 days", "f")
    assert sorted(r.id for r in out.collect()) == ["a", "b", "c", "n", "n"]       # "old" comes after the watermark
    assert ST.dropped_rows(progress) >= 1
    assert ST.state_rows(progress)[-1] <= 2                                        # a and b are forgotten


def test_late_decisions_are_dropped_and_counted(spark):
    t = Tables(spark, SF_SMALL)
    out, progress = ST.stream_kpis(PS.late_decisions(t))
    whole, none = ST.stream_kpis(PS._replay(t.view("v_decisions"), "created_at"))
    assert ST.dropped_rows(progress) > 0 and ST.dropped_rows(none) == 0
    total = lambda df: df.agg(F.sum("throughput_decisions")).first()[0]
    assert 0 < total(out) < total(whole) == 7 * t.events.count()


def test_retried_fairness_batch_changes_nothing(spark):
    t = Tables(spark, SF_SMALL)
    stream = ST.FairnessStream(spark, t.view("v_applications"))
    first = spark.createDataFrame([("s", "code_gender", "F", 10, 10), ("s", "code_gender", "M", 10, 1), ("q", "code_gender", "F", 9, 9)],
                                  stream.STATE)
    second = spark.createDataFrame([("q", "code_gender", "M", 9, 0)], stream.STATE)
    stream.sink(first, 0)
    stream.sink(second, 1)
    before = sorted(map(tuple, stream.pauses().collect()))
    assert [(p[0], p[3]) for p in before] == [("q", 1), ("s", 0)]
    for batch_id, batch in ((1, second), (0, first), (1, second)):
        stream.sink(batch, batch_id)
    assert sorted(map(tuple, stream.pauses().collect())) == before
    assert {r.scheme for r in stream.deltas().collect()} == {"s", "q"}


def test_gate_reads_the_newest_control_version(spark):
    rows = [(i, s, i // 2) for i, s in enumerate(["A", "B"] * 3)] + [(6, None, 0)]
    control = ST.ControlFolder(spark)
    pauses = spark.createDataFrame([("A", None), ("A", None), ("B", DAY)], "scheme string, released_at timestamp")

    def change(i):
        control.publish(None if i == 0 else pauses, kill_switch=i == 2)

    out = ST.stream_gate(replay(spark, rows, "id bigint, loan_scheme string", 3), control, change)
    got = {r.id: (r.scheme_paused, r.kill_switch_active, r.gated) for r in out.collect()}
    assert got == {0: (False, False, False), 1: (False, False, False), 6: (False, False, False), 2: (True, False, True),
                   3: (False, False, False), 4: (True, True, True), 5: (False, True, True)}


def test_chain_of_shuffled_events(spark):
    rng = random.Random(4)
    events = [(k, turn, f"t{turn}", f"p{k}", DAY + dt.timedelta(seconds=turn), rng.randrange(5)) for k in range(6) for turn in range(30)]
    events += [(9, None, None, None, DAY, 0)]
    rng.shuffle(events)
    df = spark.createDataFrame(events, f"k bigint, turn bigint, event_type string, payload_json string, at timestamp, {ST.ARRIVAL} int")
    out = ST.stream_audit_chain(ST.Replay(ST.with_closing_row(df, "at", 5, days=2), 6), "k", "turn", "at", watermark="1 day")
    got = {}
    for r in out.collect():
        got.setdefault(r.k, {})[r.turn] = (r.prev_hash, r.entry_hash)
    assert len(got.pop(9)) == 1
    for k, chain in got.items():
        last = GENESIS_HASH
        for turn in range(30):
            entry = hashlib.sha256(f"{last}|t{turn}|p{k}".encode()).hexdigest()
            assert chain[turn] == (last, entry)
            last = entry
    assert len(got) == 6
