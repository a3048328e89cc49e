"""The periodic jobs as Structured Streaming queries.

T1 landing      file source -> foreachBatch: hash + metadata, anti-join on the
                target's hashes, append (exactly-once per batch via the sink
                checkpoint and an idempotent batch folder); or, with bounded state,
                ``dropDuplicatesWithinWatermark`` on the row hash.
T2 KPIs         watermark + 7-day windows sliding by a day, update mode; the
                sink keeps the newest version of every window.  Rows later than the
                watermark are dropped; the query's progress counts them.
T3 fairness     stream-static join to applications, running subgroup counts
                (stateful aggregate, update mode); in foreachBatch the second level
                (max over subgroup rates per scheme) runs on the complete state
                table, which is bounded by schemes x attributes x values, and newly
                breached schemes are written to the pause table, one folder a batch.
T4 gate         each micro-batch re-reads the versioned control folder (it changes
                while the stream runs) and flags rows.
T5 audit chain  state per chain id: the last hash and the events that the watermark
                hasn't passed; once it has, they are chained in order.

An input is replayed as arrivals: all files of one arrival are written in parallel,
then a stream with ``trigger(availableNow=True)`` and a kept checkpoint works
through them and stops.  Checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegralType, TimestampNTZType

from ..operators import fairness as FA
from ..operators.audit import GENESIS_HASH
from ..session import fresh_scratch, materialize
from ..sources import landing as L

ARRIVAL = "_arrival"


# ------------------------------------------------------------------ arrivals

def arrival_by_range(df: DataFrame, order: str, n: int) -> DataFrame:
    """``df`` with an arrival number 0 .. n - 1 by ranges of ``order`` of about equal size
    (bounds: n - 1 numbers to the driver); rows without a value arrive first."""
    is_ts = dict(df.dtypes)[order].startswith("timestamp")
    key = (F.unix_micros(F.col(order).cast("timestamp")) if is_ts else F.col(order).try_cast("double")).cast("double")
    bounds = sorted(set(df.select(key.alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.01))) if n > 1 else []
    passed = [F.when(key >= b, 1).otherwise(0) for b in bounds]
    return df.withColumn(ARRIVAL, sum(passed, F.lit(0)).cast("int"))


class Replay:
    """Rows with an arrival number, handed to a file source one arrival after the other."""

    def __init__(self, rows: DataFrame, n: int, fmt: str = "parquet"):
        self.spark, self.n, self.fmt = rows.sparkSession, n, fmt
        rows = rows.select(*[F.col(f.name).cast("timestamp") if isinstance(f.dataType, TimestampNTZType) else F.col(f.name)
                             for f in rows.schema])                          # watermarks want an instant
        self.staged = fresh_scratch(self.spark, "arrivals-staged")
        rows.write.partitionBy(ARRIVAL).parquet(self.staged)                 # one pass, every task writes its part
        self.schema = rows.drop(ARRIVAL).schema
        self.source = fresh_scratch(self.spark, "arrivals")
        self._write(0, "overwrite", empty=True)                             # the folder exists before the stream starts

    def _write(self, i: int, mode: str, empty: bool = False) -> None:
        rows = self.spark.read.parquet(self.staged).where(F.lit(False) if empty else F.col(ARRIVAL) == i).drop(ARRIVAL)
        rows.write.mode(mode).option("header", True).format(self.fmt).save(self.source)

    def stream(self, schema=None) -> DataFrame:
        return (self.spark.readStream.schema(schema or self.schema).option("header", True).option("escape", '"')
                .format(self.fmt).load(self.source))

    def run(self, start: Callable[[], StreamingQuery], before: Callable[[int], None] | None = None) -> list[dict]:
        """Deliver every arrival and let the stream catch up; the progress of all micro-batches."""
        progress = []
        for i in range(self.n):
            if before is not None:
                before(i)
            self._write(i, "append")
            query = start()
            query.awaitTermination()
            if query.exception() is not None:
                raise query.exception()
            progress += [json.loads(p.json) for p in query.recentProgress]
        return progress


def _starter(spark: SparkSession, writer, name: str) -> Callable[[], StreamingQuery]:
    """Starts the same query again and again: the checkpoint is kept."""
    checkpoint = fresh_scratch(spark, f"ckpt-{name}")
    return lambda: writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dropped_rows(progress: list[dict]) -> int:
    """Rows the state operators dropped as later than the watermark (after partial aggregation)."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in progress for op in p.get("stateOperators", []))


def state_rows(progress: list[dict]) -> list[int]:
    """State size after each micro-batch."""
    return [sum(op.get("numRowsTotal", 0) for op in p.get("stateOperators", [])) for p in progress]


# ------------------------------------------------------------------ T1

def stream_landing(replay: Replay, target: str, columns: list[str], source_file: str) -> DataFrame:
    """Land CSV files as they arrive; a row whose hash is already in the
    target is skipped (exact anti-join against the whole target)."""
    spark = replay.spark
    stream = replay.stream(", ".join(f"`{c}` string" for c in columns))
    stream = stream.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])

    def land(batch: DataFrame, batch_id: int):
        staged = L.add_metadata(batch, source_file)
        try:
            fresh = L.new_rows(staged, spark.read.parquet(target).select("_row_hash"))
        except AnalysisException as e:          # first batch: no target yet; any other failure is one
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            fresh = staged
        # Stage into a folder named by batch id, then append: a retried batch
        # rewrites its own folder instead of appending twice.
        stage = f"{target}__batch={batch_id}"
        fresh.write.mode("overwrite").parquet(stage)
        spark.read.parquet(stage).write.mode("append").parquet(target)

    replay.run(_starter(spark, stream.writeStream.foreachBatch(land), "landing"))
    return spark.read.parquet(target)


def stream_landing_bounded(replay: Replay, event_time: str, watermark: str, source_file: str) -> tuple[DataFrame, list[dict]]:
    """T1 with bounded state: of the copies of a row that arrive within the watermark one is
    landed.  The state holds a hash only until the watermark passes its event time plus the
    delay, so it doesn't grow with the target.  Rows without an event time are landed as they
    come, rows later than the watermark aren't.  Returns (landed rows, progress)."""
    spark = replay.spark
    columns = replay.schema.names
    hashed = replay.stream().withColumn("_row_hash", F.md5(F.concat_ws("|", *[
        F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))).withColumn("_source_file", F.lit(source_file))
    timed = hashed.where(F.col(event_time).isNotNull()).withWatermark(event_time, watermark)
    once = timed.dropDuplicatesWithinWatermark(["_row_hash"]).union(hashed.where(F.col(event_time).isNull()))
    out = fresh_scratch(spark, "landed-once")
    writer = once.writeStream.outputMode("append").format("parquet").option("path", out)
    progress = replay.run(_starter(spark, writer, "landing-bounded"))
    return spark.read.schema(once.schema).parquet(out), progress


# ------------------------------------------------------------------ T2

def stream_kpis(replay: Replay, watermark: str = "1 day") -> tuple[DataFrame, list[dict]]:
    """Per 7-day window sliding by one day: decisions, actioned, overrides, accepts and mean
    cost.  A row counts in the windows that the watermark (the newest event time of earlier
    micro-batches, less the delay) hasn't passed.  Returns (windows, progress)."""
    spark = replay.spark
    act = F.col("underwriter_action")
    agg = (replay.stream().withWatermark("created_at", watermark)
           .groupBy(F.window("created_at", "7 days", "1 day").alias("w"))
           .agg(F.count(F.lit(1)).alias("throughput_decisions"), F.count(act).alias("actioned"),
                F.count_if(act == "override").alias("overrides"), F.count_if(act == "accept").alias("accepts"),
                F.avg("estimated_cost_usd").alias("cost_per_app_usd")))       # over rows that have a cost
    out = fresh_scratch(spark, "stream-kpis")

    def sink(batch: DataFrame, batch_id: int):                # a retried batch rewrites its own folder
        batch.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")

    progress = replay.run(_starter(spark, agg.writeStream.outputMode("update").foreachBatch(sink), "kpis"))
    res = spark.read.option("basePath", out).parquet(f"{out}/_batch=*")
    # update mode: the newest emitted version of each window is its value
    latest = res.groupBy("w").agg(F.max_by(F.struct(*[c for c in res.columns if c not in ("w",)]),
                                           F.col("_batch")).alias("r")).select("w", "r.*").drop("_batch")
    return latest.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                         "throughput_decisions", "actioned", "overrides", "accepts",
                         "cost_per_app_usd"), progress


# ------------------------------------------------------------------ T3

class FairnessStream:
    """Running (scheme, attribute, subgroup) counts; after every micro-batch the complete,
    small state table gives the segment deltas, and a scheme whose gap breaches the limit and
    has no open pause gets one.  ``state``: one folder a batch with the whole table; ``pauses``:
    one folder a batch with the pauses it opened.  A retried batch rewrites its own folders."""

    def __init__(self, spark: SparkSession, apps: DataFrame):
        self.spark, self.apps = spark, apps
        self.folder = fresh_scratch(spark, "stream-fairness")

    def _read(self, table: str, schema: str, below: int | None = None) -> DataFrame:
        """Folders of the batches before ``below``, with their batch number."""
        try:
            rows = self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.folder}/{table}")
        except AnalysisException as e:          # no batch has written yet
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], f"{schema}, batch bigint")
        return rows if below is None else rows.where(F.col("batch") < below)

    STATE = "scheme string, attribute string, subgroup string, n bigint, ok bigint"
    PAUSES = "scheme string, reason string, gap_pp double"

    def sink(self, batch: DataFrame, batch_id: int) -> None:
        before = self._read("state", self.STATE, batch_id)
        last = before.agg(F.max("batch")).first()[0]
        keys = ["scheme", "attribute", "subgroup"]
        kept = before.where(F.col("batch") == last).drop("batch").join(batch.select(*keys), keys, "left_anti")
        state = f"{self.folder}/state/batch={batch_id}"
        kept.unionByName(batch.select(*keys, "n", "ok")).coalesce(1).write.mode("overwrite").parquet(state)
        open_now = self._read("pauses", self.PAUSES, batch_id).select("scheme")
        breached = breaches(deltas_from_counts(self.spark.read.parquet(state)))
        breached.join(open_now, "scheme", "left_anti").write.mode("overwrite").parquet(f"{self.folder}/pauses/batch={batch_id}")

    def run(self, replay: Replay) -> list[dict]:
        joined = FA.decision_application_join(replay.stream(), self.apps)                     # stream-static join
        long = FA.unpivot(joined, {a: F.col(a) for a in FA.SEGMENT_ATTRIBUTES},
                          ["scheme", (F.col("recommendation") == "Approve").cast("int").alias("_ok")])
        counts = long.filter(F.col("subgroup").isNotNull()).groupBy("scheme", "attribute", "subgroup") \
            .agg(F.count(F.lit(1)).alias("n"), F.sum("_ok").alias("ok"))
        writer = counts.writeStream.outputMode("update").foreachBatch(self.sink)
        return replay.run(_starter(self.spark, writer, "fairness"))

    def deltas(self) -> DataFrame:
        """Segment deltas of the last state."""
        state = self._read("state", self.STATE)
        return deltas_from_counts(state.where(F.col("batch") == state.agg(F.max("batch")).first()[0]).drop("batch"))

    def pauses(self) -> DataFrame:
        """Every pause with the micro-batch that opened it."""
        return self._read("pauses", self.PAUSES)


def deltas_from_counts(state: DataFrame) -> DataFrame:
    """A14's second level on running counts (same rules: n >= 3, >= 2 subgroups)."""
    r = state.filter(F.col("n") >= FA.MIN_SUBGROUP_SIZE).select(
        "scheme", "attribute", "subgroup", "n", F.bround(F.col("ok") / F.col("n"), 4).alias("approval_rate"))
    order = F.create_map(*[x for i, a in enumerate(FA.SEGMENT_ATTRIBUTES) for x in (F.lit(a), F.lit(i))])
    g = r.groupBy("scheme", "attribute").agg(F.count(F.lit(1)).alias("n_subgroups"),
                                             F.min("approval_rate").alias("min_rate"),
                                             F.max("approval_rate").alias("max_rate")).filter(F.col("n_subgroups") >= 2)
    return g.select("scheme", "attribute", order[F.col("attribute")].cast("bigint").alias("attribute_pos"),
                    "n_subgroups", "min_rate", "max_rate",
                    F.bround((F.col("max_rate") - F.col("min_rate")) * 100, 2).alias("delta_pp"))


def breaches(deltas: DataFrame) -> DataFrame:
    """Schemes over the limit with A15's reason: its largest gap, on the first attribute that has it."""
    worst = deltas.groupBy("scheme").agg(
        F.max("delta_pp").alias("gap_pp"), F.min_by("attribute", F.struct(-F.col("delta_pp"), "attribute_pos")).alias("worst"))
    reason = F.format_string("Fairness gap %spp on %s exceeds %spp", F.col("gap_pp").cast("string"), F.col("worst"),
                             F.lit(str(FA.HARD_BLOCK_DELTA_PP)))
    return worst.where(F.col("gap_pp") > FA.HARD_BLOCK_DELTA_PP).select("scheme", reason.alias("reason"), "gap_pp")


# ------------------------------------------------------------------ T4

class ControlFolder:
    """Versioned control state of the gate: the open pauses and the kill switch.  A version is
    written whole and never changed; readers take the newest complete one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.version = spark, fresh_scratch(spark, "control"), 0

    def publish(self, paused: DataFrame | None = None, kill_switch: bool = False) -> int:
        """``paused``: pause rows (scheme, released_at); the version's number."""
        schemes = (paused.where(F.col("released_at").isNull()).select("scheme").distinct() if paused is not None
                   else self.spark.createDataFrame([], "scheme string"))
        listed = schemes.agg(F.sort_array(F.collect_list("scheme")).alias("paused"))        # one row; schemes are a closed set
        self.version += 1
        listed.select("paused", F.lit(kill_switch).alias("kill_switch")).write.parquet(f"{self.folder}/version={self.version}")
        return self.version

    def read(self) -> DataFrame:
        """paused (array) and kill_switch of the newest version: one row."""
        rows = self.spark.read.parquet(self.folder)
        return rows.groupBy().agg(F.max_by(F.struct("paused", "kill_switch"), "version").alias("c")).select("c.*")


def stream_gate(replay: Replay, control: ControlFolder, change: Callable[[int], None] | None = None,
                scheme: str = "loan_scheme") -> DataFrame:
    """T4: incoming applications flagged against the control state as it is at each
    micro-batch; ``change(i)`` runs before arrival ``i`` and may publish a new version."""
    spark = replay.spark
    out = fresh_scratch(spark, "stream-gate")

    def gate(batch: DataFrame, batch_id: int):
        flagged = batch.join(F.broadcast(control.read()))                   # one row
        paused = F.coalesce(F.array_contains("paused", F.col(scheme)), F.lit(False))
        flagged = flagged.select(*batch.columns, paused.alias("scheme_paused"), F.col("kill_switch").alias("kill_switch_active"))
        flagged = flagged.withColumn("gated", F.col("scheme_paused") | F.col("kill_switch_active"))
        flagged.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")  # a retried batch rewrites its own folder

    replay.run(_starter(spark, replay.stream().writeStream.foreachBatch(gate), "gate"), before=change)
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")


# ------------------------------------------------------------------ T5

CHAIN_STATE = "last_hash string, pending string"


def stream_audit_chain(replay: Replay, key: str, order: str, event_time: str, watermark: str = "1 hour",
                       event_type: str = "event_type", payload: str = "payload_json") -> DataFrame:
    """T5: keyed chains of events that may arrive in any order within the watermark.  An event
    waits in its key's state until the watermark passes its time; then the waiting events
    up to there are chained by (event time, ``order``) after the key's last hash.  A key's
    state holds the events of one watermark delay.  Events later than the watermark, and
    events without a time, are dropped by it."""
    spark, schema = replay.spark, replay.schema
    names = [f for f in schema.names if f != event_time]
    whole = [isinstance(f.dataType, IntegralType) for f in schema if f.name != event_time]
    out_schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != event_time]
                           + ["prev_hash string", "entry_hash string"])

    def step(k, batches: Iterator[pd.DataFrame], state):
        last, pending = state.get if state.exists else (GENESIS_HASH, "[]")
        waiting = json.loads(pending)
        for pdf in batches:
            rows = pdf[names].astype(object).where(pdf[names].notna(), None).itertuples(index=False, name=None)
            waiting += [[t, *(int(v) if i and v is not None else v for v, i in zip(row, whole))]
                        for t, row in zip(pdf["_ms"].tolist(), rows)]
        at = 1 + names.index(order)
        passed = state.getCurrentWatermarkMs()
        waiting.sort(key=lambda r: (r[0], r[at] is not None, r[at] if r[at] is not None else 0))
        due = [r for r in waiting if r[0] <= passed]
        waiting = waiting[len(due):]
        entries = []
        for row in due:
            values = dict(zip(names, row[1:]))
            prev = last
            last = hashlib.sha256(f"{prev}|{values[event_type]}|{values[payload]}".encode("utf-8")).hexdigest()
            entries.append((*row[1:], prev, last))
        state.update((last, json.dumps(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0], passed + 1))
        yield pd.DataFrame(entries, columns=[*names, "prev_hash", "entry_hash"])

    stream = replay.stream().where(F.col(event_time).isNotNull()).withWatermark(event_time, watermark)
    stream = stream.withColumn("_ms", F.unix_millis(F.col(event_time).cast("timestamp")))
    chained = stream.groupBy(key).applyInPandasWithState(step, out_schema, CHAIN_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    out = fresh_scratch(spark, "stream-chain-out")
    writer = chained.writeStream.outputMode("append").format("parquet").option("path", out)
    replay.run(_starter(spark, writer, "chain"))
    return spark.read.schema(out_schema).parquet(out)


def with_closing_row(events: DataFrame, event_time: str, n: int, days: int = 1) -> DataFrame:
    """``events`` plus one heartbeat row (all else null) in arrival ``n``, ``days`` after the last event,
    that lets the watermark pass every event."""
    end = materialize(events.agg((F.max(event_time) + F.expr(f"INTERVAL {days} DAYS")).alias(event_time)), "closing")
    cols: list[Column] = [F.col(event_time) if f.name == event_time else F.lit(n).cast("int").alias(ARRIVAL) if f.name == ARRIVAL
                          else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema]
    return events.unionByName(end.select(*cols))
