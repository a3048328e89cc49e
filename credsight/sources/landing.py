"""Bronze landing: source catalog (S1), raw CSV scan (S2), schema sniffing (S3),
DDL (S4), drift (S5), full refresh (S6), incremental load by row hash (S7, J3),
row-level rejects (S8, X2), feature cache (S9), CSV sink (S11), last-write-wins
upsert (S12) and version registration (S13); row hash (F1).

Every step is one lazy plan per source: scan -> hash + metadata -> typed/
reject split -> anti-join on the hash -> write.  The anti-join needs only the
target's ``_row_hash`` column (pruned at the scan); hot hash values (many
identical rows in a batch) are split by AQE's skew-join handling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import materialize

META_COLUMNS = ["_ingested_at", "_source_file", "_row_hash"]
BOOL_WORDS = ["True", "False", "TRUE", "FALSE", "true", "false"]
SQL_TYPE = {"BIGINT": "BIGINT", "DOUBLE PRECISION": "DOUBLE", "BOOLEAN": "BOOLEAN", "TEXT": "STRING"}


# ------------------------------------------------------------------ S1

def load_source_catalog(spark: SparkSession, config_path: str) -> DataFrame:
    """The configured (file, table, description, enabled) rows; ``enabled``
    defaults to true.  The config is a small YAML file read on the driver."""
    import yaml

    with open(config_path, encoding="utf-8") as fh:
        cfg = yaml.safe_load(fh) or {}
    rows = [(s["file"], s["table"], s.get("description"), bool(s.get("enabled", True)))
            for s in cfg.get("sources", [])]
    return spark.createDataFrame(rows, "file string, table string, description string, enabled boolean")


def select_sources(catalog: DataFrame, tables: list[str] | None = None) -> DataFrame:
    """S1 filter: enabled sources, optionally restricted to an allow-list of tables."""
    out = catalog.filter(F.col("enabled"))
    if tables:
        out = out.filter(F.col("table").isin(list(tables)))
    return out


# ------------------------------------------------------------------ S2 / F1

def csv_scan_raw(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Every column as text, only blank cells NULL, quotes escaped by doubling,
    undecodable bytes replaced.  ``multiLine`` only when values span lines (it
    stops Spark from splitting files)."""
    df = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
          .option("multiLine", multiline).option("mode", "PERMISSIVE").option("encoding", "UTF-8")
          .option("inferSchema", False).csv(path))
    return df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def data_columns(df: DataFrame) -> list[str]:
    cols = [c for c in df.columns if not c.startswith("_")]
    if not cols:
        raise ValueError(f"nothing to hash: every column is metadata ({df.columns})")
    return cols


def row_hash(df: DataFrame) -> Column:
    """md5 of the data columns joined with '|', NULL as ''.  (concat_ws would
    drop NULLs, so each value is coalesced first.)"""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in data_columns(df)]))


def add_metadata(df: DataFrame, source_file: str | Column) -> DataFrame:
    src = source_file if isinstance(source_file, Column) else F.lit(source_file)
    return df.withColumns({"_ingested_at": F.current_timestamp(), "_source_file": src, "_row_hash": row_hash(df)})


# ------------------------------------------------------------------ S3 / S4 / S5

def schema_sniff(df: DataFrame) -> DataFrame:
    """S3: conservative type per column from all rows: integers without NULLs ->
    BIGINT; numbers (or integers with NULLs, or an all-NULL column) -> DOUBLE
    PRECISION; true/false without NULLs -> BOOLEAN; anything else -> TEXT.
    One aggregate, partial on the map side."""
    cols = list(df.columns)
    aggs = []
    for c in cols:
        v = F.col(f"`{c}`")
        aggs += [F.count(F.lit(1)).alias(f"n__{c}"), F.count(v).alias(f"nn__{c}"),
                 F.count_if(v.isNotNull() & ~v.rlike(r"^\s*[+-]?\d+\s*$")).alias(f"ni__{c}"),
                 F.count_if(v.isNotNull() & v.try_cast("double").isNull()).alias(f"nd__{c}"),
                 F.count_if(v.isNotNull() & ~v.isin(BOOL_WORDS)).alias(f"nb__{c}")]
    stats = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        n, nn, ni, nd, nb = (F.col(f"{p}__{c}") for p in ("n", "nn", "ni", "nd", "nb"))
        t = (F.when(nn == 0, "DOUBLE PRECISION")
             .when((ni == 0) & (nn == n), "BIGINT")
             .when(nd == 0, "DOUBLE PRECISION")
             .when((nb == 0) & (nn == n), "BOOLEAN")
             .otherwise("TEXT"))
        rows.append(F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"), t.alias("pg_type")))
    return stats.select(F.inline(F.array(*rows)))


def generate_ddl(sniffed: DataFrame, schema: str, table: str) -> DataFrame:
    """One CREATE TABLE statement (Spark SQL types) with the metadata columns."""
    mapping = F.create_map(*[x for k, v in SQL_TYPE.items() for x in (F.lit(k), F.lit(v))])
    defs = sniffed.select("position", F.format_string("    `%s` %s", F.col("column_name"),
                                                      mapping[F.col("pg_type")]).alias("d"))
    body = defs.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "d"))),
                                             lambda s: s["d"]), ",\n").alias("cols"))
    meta = ",\n".join(["    _ingested_at TIMESTAMP NOT NULL", "    _source_file STRING NOT NULL",
                       "    _row_hash STRING NOT NULL"])
    head = (f"-- Generated by the landing sniffer; review before applying.\n"
            f"-- Source table: {schema}.{table}\n\nCREATE TABLE IF NOT EXISTS `{schema}`.`{table}` (\n")
    return body.select(F.concat(F.lit(head), F.col("cols"), F.lit(",\n" + meta + "\n) USING parquet;\n"))
                       .alias("ddl"))


def schema_drift(spark: SparkSession, existing: list[str], incoming: list[str], table: str) -> DataFrame:
    """Columns new in the source and columns the table has but the source
    lacks (metadata columns excluded), each sorted; one warning row per kind."""
    meta = F.array(*[F.lit(m) for m in META_COLUMNS])
    df = spark.createDataFrame([(list(existing), list(incoming))], "existing array<string>, incoming array<string>")
    db = F.array_except(F.col("existing"), meta)
    src = F.array_distinct(F.col("incoming"))
    new_cols = F.sort_array(F.array_except(src, db))
    dropped = F.sort_array(F.array_except(db, src))
    kinds = F.array(
        F.struct(F.lit("new_columns").alias("kind"), new_cols.alias("columns"),
                 F.format_string("%s lacks: %s", F.lit(table), F.array_join(new_cols, ", ")).alias("warning")),
        F.struct(F.lit("dropped_columns").alias("kind"), dropped.alias("columns"),
                 F.format_string("%s alone has: %s", F.lit(table), F.array_join(dropped, ", ")).alias("warning")))
    return df.select(F.inline(kinds)).filter(F.size("columns") > 0)


# ------------------------------------------------------------------ S6 / S7 / S8

def land_full_refresh(df: DataFrame, path: str, source_file: str) -> dict:
    """Overwrite the target with the batch plus metadata."""
    out = add_metadata(df, source_file)
    out.write.mode("overwrite").parquet(path)
    n = out.sparkSession.read.parquet(path).count()
    return {"rows_attempted": n, "rows_loaded": n, "rows_rejected": 0}


def new_rows(batch: DataFrame, target: DataFrame, dedupe_batch: bool = False) -> DataFrame:
    """Batch rows whose ``_row_hash`` is not in the target (anti-join).
    Copies inside one batch all survive, as in a single chunk of the reference,
    unless ``dedupe_batch``."""
    b = batch.dropDuplicates(["_row_hash"]) if dedupe_batch else batch
    return b.join(target.select("_row_hash"), "_row_hash", "left_anti").select(*batch.columns)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None where there is none yet; any other failure to read it is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def land_incremental(batch: DataFrame, path: str, source_file: str, dedupe_batch: bool = False) -> dict:
    """Append only unseen rows.  The new rows are staged to a separate folder
    first (the target is also an input of the plan), then appended."""
    spark = batch.sparkSession
    staged = add_metadata(batch, source_file)
    target = stored(spark, path)
    fresh = staged if target is None else new_rows(staged, target, dedupe_batch)
    stage = materialize(fresh, "landing-stage")     # a folder per load: two loads never share one
    loaded, attempted = stage.count(), batch.count()
    stage.write.mode("append").parquet(path)
    return {"rows_attempted": attempted, "rows_loaded": loaded, "rows_skipped": attempted - loaded, "rows_rejected": 0}


_SPARK_TYPES = {"BIGINT": "bigint", "DOUBLE PRECISION": "double", "BOOLEAN": "boolean", "TEXT": "string"}


def _typed(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, dict[str, Column]]:
    """Tag each row with the columns whose non-NULL value fails its declared type."""
    casts, bad = {}, []
    for c in df.columns:
        t = types.get(c)
        if t is None or t == "TEXT" or c.startswith("_"):
            continue
        v = F.col(f"`{c}`")
        cast = v.try_cast(_SPARK_TYPES[t]) if t != "BOOLEAN" else F.when(v.isin(BOOL_WORDS), F.lower(v) == "true")
        casts[c] = cast
        bad.append(F.when(v.isNotNull() & cast.isNull(), F.lit(c)))
    reason = F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")
    return df.withColumn("_reject_columns", reason), casts


def cast_or_reject(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Row-level reject split (instead of the reference's whole-chunk reject).
    A row is rejected when a non-NULL source value does not cast to its declared
    type; the reason lists the failing columns.  Loading continues."""
    tagged, casts = _typed(df, types)
    ok = tagged.filter(F.size("_reject_columns") == 0).drop("_reject_columns").withColumns(casts)
    rej = tagged.filter(F.size("_reject_columns") > 0).withColumn(
        "_reject_reason", F.concat(F.lit("cast_failed: "), F.array_join("_reject_columns", ", "))) \
        .drop("_reject_columns")
    return ok, rej


def load_stats(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """S8 counts in one aggregate: attempted, loaded, rejected."""
    tagged, _ = _typed(df, types)
    n_bad = F.size("_reject_columns")
    return tagged.agg(F.count(F.lit(1)).alias("rows_attempted"), F.count_if(n_bad == 0).alias("rows_loaded"),
                      F.count_if(n_bad > 0).alias("rows_rejected"))


def union_rejects(parts: list[DataFrame]) -> DataFrame:
    """Concatenation of reject sets with possibly different columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


# ------------------------------------------------------------------ S9 / S11

def cached_parquet(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """Read the table at ``path``; (re)build it with ``build()`` when absent or forced.  A
    table that is there but can't be read is an error, never rebuilt over."""
    found = None if force else stored(spark, path)
    if found is not None:
        return found
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Evaluation tables as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


# ------------------------------------------------------------------ S12 / S13

def upsert_last_write_wins(target: DataFrame, batch: DataFrame, key: str = "external_id",
                           seq: str = "ingest_seq") -> tuple[DataFrame, DataFrame]:
    """Insert or overwrite by key; the highest ``seq`` wins.  Rows without a
    key are returned as rejects.  ``max_by`` keeps the per-key work in partial
    aggregates, so a hot key never collects into one task."""
    rejects = batch.filter(F.col(key).isNull())
    both = target.unionByName(batch.filter(F.col(key).isNotNull()), allowMissingColumns=True)
    cols = [c for c in both.columns if c != key]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(seq)).alias("r"))
    return latest.select(key, "r.*"), rejects


def register_versions(existing: DataFrame, incoming: DataFrame,
                      keys: tuple[str, ...] = ("corpus_version", "source_file")) -> DataFrame:
    """Version rows not yet registered (anti-join on version + source file)."""
    return incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
