"""Queries for the landing layer: F1, S2-S9, S11, S12."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import features as FT
from ..operators import ops as OP
from ..session import fresh_scratch, materialize
from ..sources import landing as L
from ..sources.keyed_table import KeyedTable
from .catalog import ORACLES, register, rounded
from .evaluate import _G81, _PRED, _sweep_sql
from .features import SQL_AUX_CTES, _HIST
from .ops import _P1_SQL, _raw
from .views import cte

_RAW = cte("v_raw_customer")
_HASH_SQL = "md5(concat_ws('|', coalesce(c_custkey, ''), coalesce(c_name, ''), coalesce(c_nationkey, ''), " \
            "coalesce(c_mktsegment, '')))"


@register("F1_row_hash", _RAW + f"SELECT c_custkey, {_HASH_SQL} AS _row_hash FROM v_raw_customer")
def f1(t):
    raw = t.view("v_raw_customer")
    return raw.select("c_custkey", L.row_hash(raw).alias("_row_hash"))


@register("S2_csv_scan_raw", _RAW + "SELECT * FROM v_raw_customer")
def s2(t):
    """The raw customer rows written as CSV (blank = missing) and scanned back as text."""
    path = fresh_scratch(t.spark, "raw-customer-csv")
    L.write_csv(t.view("v_raw_customer"), path)
    return L.csv_scan_raw(t.spark, path)


@register("S3_schema_sniff", _RAW + """,
cols AS (SELECT 1 AS position, 'c_custkey' AS column_name, c_custkey AS v FROM v_raw_customer
         UNION ALL SELECT 2, 'c_name', c_name FROM v_raw_customer
         UNION ALL SELECT 3, 'c_nationkey', c_nationkey FROM v_raw_customer
         UNION ALL SELECT 4, 'c_mktsegment', c_mktsegment FROM v_raw_customer),
st AS (SELECT position, column_name, count(*) AS n, count(v) AS nn,
         count_if(v IS NOT NULL AND NOT regexp_matches(v, '^\\s*[+-]?\\d+\\s*$')) AS ni,
         count_if(v IS NOT NULL AND TRY_CAST(v AS DOUBLE) IS NULL) AS nd,
         count_if(v IS NOT NULL AND v NOT IN ('True', 'False', 'TRUE', 'FALSE', 'true', 'false')) AS nb
       FROM cols GROUP BY position, column_name)
SELECT CAST(position AS BIGINT) AS position, column_name,
  CASE WHEN nn = 0 THEN 'DOUBLE PRECISION' WHEN ni = 0 AND nn = n THEN 'BIGINT' WHEN nd = 0 THEN 'DOUBLE PRECISION'
       WHEN nb = 0 AND nn = n THEN 'BOOLEAN' ELSE 'TEXT' END AS pg_type
FROM st""")
def s3(t):
    return rounded(L.schema_sniff(t.view("v_raw_customer")))


@register("S4_generate_ddl", _RAW + """,
st AS (SELECT count(*) AS n, count(c_mktsegment) AS nn_seg,
         count_if(NOT regexp_matches(c_custkey, '^\\s*[+-]?\\d+\\s*$')) AS ni_key,
         count_if(NOT regexp_matches(c_nationkey, '^\\s*[+-]?\\d+\\s*$')) AS ni_nat FROM v_raw_customer)
SELECT '-- Generated by the landing sniffer; review before applying.' || chr(10) || '-- Source table: bronze.raw_customer'
  || chr(10) || chr(10) || 'CREATE TABLE IF NOT EXISTS `bronze`.`raw_customer` (' || chr(10)
  || '    `c_custkey` ' || CASE WHEN ni_key = 0 THEN 'BIGINT' ELSE 'STRING' END || ',' || chr(10)
  || '    `c_name` STRING,' || chr(10)
  || '    `c_nationkey` ' || CASE WHEN ni_nat = 0 THEN 'BIGINT' ELSE 'STRING' END || ',' || chr(10)
  || '    `c_mktsegment` STRING,' || chr(10)
  || '    _ingested_at TIMESTAMP NOT NULL,' || chr(10) || '    _source_file STRING NOT NULL,' || chr(10)
  || '    _row_hash STRING NOT NULL' || chr(10) || ') USING parquet;' || chr(10) AS ddl
FROM st""")
def s4(t):
    return L.generate_ddl(L.schema_sniff(t.view("v_raw_customer")), "bronze", "raw_customer")


@register("S5_schema_drift", _RAW + """,
src AS (SELECT column_name FROM (DESCRIBE SELECT *, upper(c_name) AS c_name_upper FROM v_raw_customer)),
tab AS (SELECT column_name FROM (DESCRIBE SELECT * EXCLUDE (c_mktsegment), now() AS _ingested_at FROM v_raw_customer) WHERE NOT starts_with(column_name, '_')),
d AS (SELECT 'new_columns' AS kind, list(column_name ORDER BY column_name) AS columns, 'raw_customer lacks: ' AS said
        FROM src WHERE column_name NOT IN (SELECT column_name FROM tab)
      UNION ALL SELECT 'dropped_columns', list(column_name ORDER BY column_name), 'raw_customer alone has: '
        FROM tab WHERE column_name NOT IN (SELECT column_name FROM src))
SELECT kind, columns, said || array_to_string(columns, ', ') AS warning FROM d WHERE len(columns) > 0""")
def s5(t):
    """A table landed without the segment column against the current source
    that carries an extra derived column."""
    raw = t.view("v_raw_customer")
    existing = [c for c in raw.columns if c != "c_mktsegment"] + L.META_COLUMNS
    incoming = raw.withColumn("c_name_upper", F.upper("c_name")).columns
    return L.schema_drift(t.spark, existing, incoming, "raw_customer")


@register("S6_land_full_refresh", _RAW + f"""
SELECT *, 'customer.csv' AS _source_file, {_HASH_SQL} AS _row_hash FROM v_raw_customer""")
def s6(t):
    path = fresh_scratch(t.spark, "bronze-raw-customer")
    L.land_full_refresh(t.view("v_raw_customer"), path, "customer.csv")
    return t.spark.read.parquet(path).drop("_ingested_at")


@register("S7_land_incremental", _RAW + f"""
SELECT b.*, 'customer.csv' AS _source_file, {_HASH_SQL} AS _row_hash FROM v_raw_customer b
WHERE NOT EXISTS (SELECT 1 FROM v_raw_customer tt WHERE CAST(tt.c_custkey AS BIGINT) % 3 <> 0
  AND md5(concat_ws('|', coalesce(tt.c_custkey, ''), coalesce(tt.c_name, ''), coalesce(tt.c_nationkey, ''),
      coalesce(tt.c_mktsegment, ''))) = md5(concat_ws('|', coalesce(b.c_custkey, ''), coalesce(b.c_name, ''),
      coalesce(b.c_nationkey, ''), coalesce(b.c_mktsegment, ''))))""")
def s7(t):
    """Target landed from the rows with c_custkey % 3 <> 0, then the whole
    table arrives as a batch; the result is what the incremental load appends."""
    raw = t.view("v_raw_customer")
    path = fresh_scratch(t.spark, "bronze-incremental")
    L.land_full_refresh(raw.filter(F.col("c_custkey").cast("bigint") % 3 != 0), path, "customer.csv")
    before = t.spark.read.parquet(path).select("_row_hash").distinct()
    first = materialize(before, "landed-before")
    L.land_incremental(raw, path, "customer.csv")
    return t.spark.read.parquet(path).join(first, "_row_hash", "left_anti").select(
        *raw.columns, "_source_file", "_row_hash")


# Raw balance text in accounting style: negatives as "(12.34)", which the
# declared DOUBLE column rejects row by row.
_BAL_SQL = """bal AS (
  SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
    CASE WHEN c_acctbal < 0 THEN '(' || CAST(CAST(-c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) || ')'
         ELSE CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) END AS c_acctbal
  FROM customer)
"""


def _bal(t):
    c = t.customer
    text = F.col("c_acctbal").cast("decimal(12,2)").cast("string")
    neg = F.concat(F.lit("("), (-F.col("c_acctbal")).cast("decimal(12,2)").cast("string"), F.lit(")"))
    return c.select(F.col("c_custkey").cast("string").alias("c_custkey"),
                    F.when(F.col("c_acctbal") < 0, neg).otherwise(text).alias("c_acctbal"))


@register("S8_reject_sink", "WITH " + _BAL_SQL + """
SELECT c_custkey, c_acctbal, 'rejected' AS status, 'cast_failed: c_acctbal' AS reject_reason FROM bal
WHERE TRY_CAST(c_acctbal AS DOUBLE) IS NULL
UNION ALL
SELECT c_custkey, c_acctbal, 'loaded', NULL FROM bal WHERE TRY_CAST(c_acctbal AS DOUBLE) IS NOT NULL""")
def s8(t):
    """Row-level rejects against declared types (key BIGINT, balance DOUBLE)."""
    types = {"c_custkey": "BIGINT", "c_acctbal": "DOUBLE PRECISION"}
    raw = _bal(t)
    ok, rej = L.cast_or_reject(raw, types)
    okk = raw.join(ok.select("c_custkey"), raw["c_custkey"] == ok["c_custkey"].cast("string"), "left_semi")
    return L.union_rejects([
        okk.select("c_custkey", "c_acctbal", F.lit("loaded").alias("status"),
                   F.lit(None).cast("string").alias("reject_reason")),
        rej.select("c_custkey", "c_acctbal", F.lit("rejected").alias("status"),
                   F.col("_reject_reason").alias("reject_reason"))])


@register("S8_load_stats", "WITH " + _BAL_SQL + """
SELECT count(*) AS rows_attempted, count_if(TRY_CAST(c_acctbal AS DOUBLE) IS NOT NULL) AS rows_loaded,
  count_if(TRY_CAST(c_acctbal AS DOUBLE) IS NULL) AS rows_rejected FROM bal""")
def s8_stats(t):
    return L.load_stats(_bal(t), {"c_custkey": "BIGINT", "c_acctbal": "DOUBLE PRECISION"})


@register("S9_parquet_feature_cache", cte(*_HIST) + ", " + SQL_AUX_CTES + "SELECT * FROM aux")
def s9(t):
    """The applicant aggregates built once into the shared folder, then reused."""
    path = fresh_scratch(t.spark, "aux-features")
    hist = [t.view(v) for v in _HIST]
    L.cached_parquet(t.spark, path, lambda: FT.aux_features(*hist), force=True)
    again = L.cached_parquet(t.spark, path, lambda: FT.aux_features(*hist))  # reused, not rebuilt
    return rounded(again)


@register("S11_results_csv_sink", _PRED + ", " + _sweep_sql(_G81) + "SELECT * FROM sweep")
def s11(t):
    """The threshold table written as CSV with a header and read back."""
    sweep = rounded(EV.threshold_sweep(t.view("v_predictions"), _G81))
    path = fresh_scratch(t.spark, "threshold-csv")
    L.write_csv(sweep, path)
    back = t.spark.read.schema(sweep.schema).option("header", True).csv(path)
    return back


@register("S12_application_upsert", cte("v_applications") + ", " + _P1_SQL + """,
b2 AS (SELECT p.* REPLACE (p.amt_credit * 1.1 AS amt_credit), 2 AS ingest_seq FROM prof p
       JOIN v_applications a ON p.external_id = a.external_id
       WHERE a.created_at >= (SELECT max(created_at) FROM v_applications) - INTERVAL 365 DAY),
b1 AS (SELECT p.*, 1 AS ingest_seq FROM prof p)
SELECT external_id, round(arg_max(amt_credit, ingest_seq), 6) AS amt_credit,
  CAST(max(ingest_seq) AS BIGINT) AS ingest_seq
FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2) u WHERE external_id IS NOT NULL GROUP BY external_id""")
def s12(t):
    """Every application loaded, then the last year's applications re-sent with a
    revised credit amount; the later load wins per external id."""
    prof = OP.normalize_application(_raw(t))
    first = prof.withColumn("ingest_seq", F.lit(1))
    apps = t.view("v_applications")
    recent = apps.filter(F.col("created_at") >= apps.agg(F.max("created_at")).scalar() - F.expr("INTERVAL 365 DAYS"))
    second = prof.join(recent.select("external_id"), "external_id", "left_semi") \
        .withColumn("amt_credit", F.col("amt_credit") * 1.1).withColumn("ingest_seq", F.lit(2))
    merged, _ = L.upsert_last_write_wins(first, second)
    return rounded(merged.select("external_id", "amt_credit", "ingest_seq"))


@register("S12_stored_upsert")
def s12_stored(t):
    """S12 into a stored table: all applications, then the last year's again with a revised amount; the second
    load rewrites the buckets of its keys only."""
    prof = OP.normalize_application(_raw(t)).select("external_id", "amt_credit")
    apps = t.view("v_applications")
    recent = apps.filter(F.col("created_at") >= apps.agg(F.max("created_at")).scalar() - F.expr("INTERVAL 365 DAYS"))
    second = prof.join(recent.select("external_id"), "external_id", "left_semi").withColumn("amt_credit", F.col("amt_credit") * 1.1)
    table = KeyedTable(t.spark, fresh_scratch(t.spark, "applications"), "external_id", "ingest_seq")
    table.upsert(prof.withColumn("ingest_seq", F.lit(1)))
    table.upsert(second.withColumn("ingest_seq", F.lit(2)))
    return rounded(table.read().select("external_id", "amt_credit", "ingest_seq"))


ORACLES["S12_stored_upsert"] = ORACLES["S12_application_upsert"]
