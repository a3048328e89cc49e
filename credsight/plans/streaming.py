"""Queries for the streaming jobs T1-T5.  Each replays its input as a sequence of
arrivals and returns what the stream left behind.  Where nothing arrives late the
final state equals the batch operator's result, so the batch oracles apply; where
the arrival matters, the oracle states each row's arrival by the same rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fairness as FA
from ..session import fresh_scratch
from ..sources import landing as L
from ..streaming import streams as ST
from .catalog import ORACLES, register, rounded
from .fairness import _DA, _J4_SQL, _joined, _now, _pauses, _SEG_SQL
from .privacy_audit import events
from .views import cte

N_ARRIVALS = 4


def _replay(df, order: str, fmt: str = "parquet") -> ST.Replay:
    return ST.Replay(ST.arrival_by_range(df, order, N_ARRIVALS), N_ARRIVALS, fmt)


def _timed_arrival(df, ts: str):
    """Four arrivals by equal stretches of time (null: the first), a rule SQL can state as well."""
    us = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    ends = us.agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))                        # one row
    part = F.expr(f"coalesce((_us - _lo) * {N_ARRIVALS} div (_hi - _lo + 1), 0)").cast("int")
    return us.join(F.broadcast(ends)).withColumn(ST.ARRIVAL, part).drop("_us", "_lo", "_hi")


def _timed_arrival_sql(table: str, ts: str) -> str:
    return f"""SELECT *, coalesce((epoch_us({ts}::TIMESTAMP) - lo) * {N_ARRIVALS} // (hi - lo + 1), 0) AS part
  FROM {table}, (SELECT min(epoch_us({ts}::TIMESTAMP)) AS lo, max(epoch_us({ts}::TIMESTAMP)) AS hi FROM {table}) ends"""


@register("T1_stream_landing", cte("v_raw_customer") + """
SELECT *, 'customer.csv' AS _source_file, md5(concat_ws('|', coalesce(c_custkey, ''), coalesce(c_name, ''),
  coalesce(c_nationkey, ''), coalesce(c_mktsegment, ''))) AS _row_hash FROM v_raw_customer""")
def t1(t):
    """The target starts with the rows c_custkey % 3 <> 0; the whole table then
    arrives as CSV files; every row ends up landed exactly once."""
    raw = t.view("v_raw_customer")
    target = fresh_scratch(t.spark, "stream-bronze")
    L.land_full_refresh(raw.filter(F.col("c_custkey").cast("bigint") % 3 != 0), target, "customer.csv")
    return ST.stream_landing(_replay(raw, "c_custkey", "csv"), target, raw.columns, "customer.csv").drop("_ingested_at")


@register("T1_stream_landing_bounded", """SELECT event_id, user_id, event_type, 'events' AS _source_file FROM events""")
def t1_bounded(t):
    """All events; every fifth comes again with the next arrival, and again with the one
    after that.  The copies are inside the watermark: each event is landed once."""
    rows = _timed_arrival(t.events.select("event_id", "ts", "user_id", "event_type"), "ts")
    again = [rows.where("event_id % 5 = 0").withColumn(ST.ARRIVAL, F.col(ST.ARRIVAL) + k) for k in (1, 2)]
    replay = ST.Replay(rows.unionByName(again[0]).unionByName(again[1]), N_ARRIVALS + 2)
    landed, _ = ST.stream_landing_bounded(replay, "ts", "24 days", "events")
    return landed.select("event_id", "user_id", "event_type", "_source_file")


_KPI_COLUMNS = """window_start + INTERVAL 7 DAY AS window_end, count(*) AS throughput_decisions,
  count(underwriter_action) AS actioned, count_if(underwriter_action = 'override') AS overrides,
  count_if(underwriter_action = 'accept') AS accepts, round(avg(estimated_cost_usd), 6) AS cost_per_app_usd"""


@register("T2_stream_kpis", cte("v_decisions") + f""",
w AS (SELECT d.*, date_trunc('day', created_at) - k * INTERVAL 1 DAY AS window_start
      FROM v_decisions d, (SELECT unnest(range(0, 7)) AS k) ks)
SELECT window_start, {_KPI_COLUMNS} FROM w GROUP BY window_start""")
def t2(t):
    """7-day KPIs sliding by a day over the decision stream (watermark 1 day), in order."""
    return rounded(ST.stream_kpis(_replay(t.view("v_decisions"), "created_at"))[0])


def late_decisions(t):
    """Decisions by equal stretches of time; every seventh comes one arrival late, every thirteenth two."""
    d = _timed_arrival(t.view("v_decisions"), "created_at")
    late = F.when(F.col("decision_id") % 13 == 0, 2).when(F.col("decision_id") % 7 == 0, 1).otherwise(0)
    return ST.Replay(d.withColumn(ST.ARRIVAL, F.col(ST.ARRIVAL) + late), N_ARRIVALS + 2)


@register("T2_stream_kpis_late", cte("v_decisions") + ", p AS (" + _timed_arrival_sql("v_decisions", "created_at") + f"""),
d AS (SELECT * EXCLUDE (lo, hi, part), part + CASE WHEN decision_id % 13 = 0 THEN 2 WHEN decision_id % 7 = 0 THEN 1 ELSE 0 END AS arrival FROM p),
marks AS (SELECT k, max(epoch_us(created_at)) // 1000 * 1000 - 86400000000 AS mark
          FROM d, range({N_ARRIVALS + 2}) r(k) WHERE arrival < k GROUP BY k),
w AS (SELECT d.*, date_trunc('day', created_at) - k * INTERVAL 1 DAY AS window_start
      FROM d, (SELECT unnest(range(0, 7)) AS k) ks)
SELECT window_start, {_KPI_COLUMNS} FROM w LEFT JOIN marks ON marks.k = arrival
WHERE mark IS NULL OR epoch_us(window_start + INTERVAL 7 DAY) > mark GROUP BY window_start""")
def t2_late(t):
    """T2 with late rows: a row counts only in windows that the watermark hasn't passed when it arrives."""
    return rounded(ST.stream_kpis(late_decisions(t))[0])


@register("T3_stream_fairness")
def t3(t):
    """Running subgroup counts and segment deltas; final state = A14."""
    stream = ST.FairnessStream(t.spark, t.view("v_applications"))
    stream.run(_replay(t.view("v_decisions"), "created_at"))
    return rounded(stream.deltas())


@register("T3_stream_pauses", _DA + ", p AS (" + _timed_arrival_sql("v_decisions", "created_at") + "), " + _J4_SQL + f""",
cum AS (SELECT k, j4.* FROM j4 JOIN p USING (decision_id), range({N_ARRIVALS}) r(k) WHERE part <= k),
long AS (
  SELECT k, scheme, recommendation, unnest(['code_gender', 'age_band', 'name_education_type', 'name_family_status',
    'region_rating_client']) AS attribute, unnest([0, 1, 2, 3, 4]) AS pos, unnest([CAST(code_gender AS VARCHAR), age_band,
    name_education_type, name_family_status, CAST(region_rating_client AS VARCHAR)]) AS subgroup FROM cum),
rates AS (
  SELECT k, scheme, attribute, pos, subgroup, round_even(count_if(recommendation = 'Approve') / count(*), 4) AS rate
  FROM long WHERE subgroup IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
deltas AS (
  SELECT k, scheme, attribute, pos, round_even((max(rate) - min(rate)) * 100, 2) AS delta FROM rates
  GROUP BY ALL HAVING count(*) >= 2),
worst AS (SELECT k, scheme, max(delta) AS gap_pp, arg_min(attribute, (-delta, pos)) AS attribute FROM deltas GROUP BY k, scheme)
SELECT k AS batch, scheme, gap_pp,
  'Fairness gap ' || CAST(gap_pp AS VARCHAR) || 'pp on ' || attribute || ' exceeds 5.0pp' AS reason
FROM worst WHERE gap_pp > 5.0
QUALIFY row_number() OVER (PARTITION BY scheme ORDER BY k) = 1""")
def t3_pauses(t):
    """The pauses the stream opens: a scheme's first breach over the rows so far, and when."""
    stream = ST.FairnessStream(t.spark, t.view("v_applications"))
    stream.run(ST.Replay(_timed_arrival(t.view("v_decisions"), "created_at"), N_ARRIVALS))
    return rounded(stream.pauses())


def _apps(t):
    return t.view("v_applications").select("application_id", "loan_scheme", "created_at")


@register("T4_stream_gate")
def t4(t):
    """T4: arriving applications gated by the pauses A15 opened (kill switch off)."""
    control = ST.ControlFolder(t.spark)
    control.publish(_pauses(t))
    out = ST.stream_gate(_replay(_apps(t), "created_at"), control)
    return rounded(out.select("application_id", "loan_scheme", "scheme_paused"))


@register("T4_stream_gate_live", _DA + ", " + _SEG_SQL + ", a AS (" + _timed_arrival_sql("v_applications", "created_at") + """)
SELECT application_id, loan_scheme, part AS batch, part >= 1 AND m.scheme IS NOT NULL AND NOT (part >= 2 AND loan_scheme = 'Personal Loan')
  AS scheme_paused, part = 3 AS kill_switch_active,
  part = 3 OR part >= 1 AND m.scheme IS NOT NULL AND NOT (part >= 2 AND loan_scheme = 'Personal Loan') AS gated
FROM a LEFT JOIN (SELECT scheme FROM mon WHERE max_delta_pp > 5.0) m ON a.loan_scheme = m.scheme""")
def t4_live(t):
    """T4: the control state changes while applications arrive: A15's pauses open before the second
    arrival, the Personal Loan one is released before the third, the kill switch is on for the last."""
    control = ST.ControlFolder(t.spark)
    pauses = _pauses(t)
    released = FA.pause_release(pauses, "Personal Loan", _now(t))

    def change(i: int) -> None:
        control.publish([None, pauses, released, released][i], kill_switch=i == 3)

    out = ST.stream_gate(ST.Replay(_timed_arrival(_apps(t), "created_at"), N_ARRIVALS), control, change)
    return rounded(out.select("application_id", "loan_scheme", "batch", "scheme_paused", "kill_switch_active", "gated"))


@register("T5_stream_audit_chain")
def t5(t):
    """T5: chains per conversation from events that arrive in shuffled order (a turn's time: a second a turn)."""
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.coalesce("turn", F.lit(-1)))
    ev = events(t).withColumn("event_time", at).withColumn(ST.ARRIVAL, F.pmod(F.xxhash64("conv_id", "turn"), F.lit(N_ARRIVALS)).cast("int"))
    replay = ST.Replay(ST.with_closing_row(ev, "event_time", N_ARRIVALS, days=8), N_ARRIVALS + 1)
    out = ST.stream_audit_chain(replay, "conv_id", "turn", "event_time", watermark="7 days")
    return out.select("conv_id", "turn", "event_type", "prev_hash", "entry_hash")


ORACLES["T3_stream_fairness"] = ORACLES["A14_segment_delta"]
ORACLES["T4_stream_gate"] = ORACLES["J7_pause_semi"]
ORACLES["T5_stream_audit_chain"] = ORACLES["F12_build_hash_chain"]
