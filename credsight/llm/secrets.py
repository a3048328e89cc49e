"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is a blob, named by the SHA-256 of its bytes.  The ledger
is a Parquet table of (blob, rules scanned, findings); a run scans only pairs of
blob and rule version that the ledger doesn't hold, appends them, and joins the
findings back to every row that carries the blob.  A rule whose version is
raised is scanned anew, the others are not.

Rules are regular expressions matched from the left without overlap; a match
that fails the rule's minimum length is dropped.  Spans are code points, end
exclusive.  All work is DataFrame expressions.

Defined cases: a null text is empty and has no findings; copies share one blob
and are scanned once; rows may repeat; an empty table gives an empty table; a
text of any length is scanned whole.

Scale: one shuffle of the distinct texts; copies collapse before it.  Findings
come back by a join on the blob whose other side holds ids only, so a blob that a
third of all rows share is split by the join.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_scratch
from . import common as C


def _either_case(word: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))

# kind, version, pattern, group whose length counts, fewest characters of it
RULES = [
    ("assign", 1, f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", 1, "AKIA[A-Z0-9]+", 0, 20),
    ("hex", 1, "[0-9a-f]{24,}", 0, 24),
    ("private_key", 1, "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 1),
    ("host_token", 1, "gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("signed_token", 1, "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}", 0, 1),
]
BASE = ("assign", "access", "hex")
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"
MASK = "<secret>"


def rule_id(rule: tuple) -> str:
    return f"{rule[0]}@{rule[1]}"


def spans_of(text: Column, rule: tuple, rank: int) -> Column:
    """Spans of one rule: the matches and what lies between them, added up."""
    kind, _, pattern, group, least = rule
    none = F.array().cast(f"array<{SPAN}>")
    p = F.lit(pattern)
    found = F.regexp_extract_all(text, p, F.lit(0))
    sized = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"),
                                     F.regexp_extract_all(text, p, F.lit(group)).alias("part")),
                        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"),
                                           F.length(x["part"]).alias("part")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc.at + x.gap
        span = F.struct(first.alias("start"), F.lit(rank).alias("rank"), (first + x.hit).alias("end"), F.lit(kind).alias("kind"))
        return F.struct((first + F.coalesce(x.hit, F.lit(0))).alias("at"),
                        F.when(x.part >= least, F.concat(acc.out, F.array(span))).otherwise(acc.out).alias("out"))

    return F.when(F.rlike(text, p), F.aggregate(sized, start, step, lambda acc: acc.out)).otherwise(none)


class BlobLedger:
    """The ledger under one path in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, rules: list[tuple] | None = None):
        self.spark, self.path, self.rules = spark, path, RULES if rules is None else rules

    def read(self) -> DataFrame | None:
        """The ledger's rows; None before the first run."""
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def scan(self, texts: DataFrame) -> None:
        """Scan the blobs (columns blob, text) that the ledger doesn't hold for every rule version."""
        wanted = F.array(*[F.lit(rule_id(r)) for r in self.rules])
        blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
        known = self.read()
        if known is None:
            todo = blobs.withColumn("rules", wanted)
        else:
            seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
            left = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
            todo = blobs.join(seen, "blob", "left").withColumn("rules", left).where(F.size("rules") > 0)
        none = F.array().cast(f"array<{SPAN}>")
        found = [F.when(F.array_contains("rules", rule_id(r)), spans_of(F.col("text"), r, i)).otherwise(none)
                 for i, r in enumerate(self.rules)]
        todo.select("blob", "rules", F.concat(*found).alias("found")).write.mode("append").parquet(self.path)

    def findings(self) -> DataFrame:
        """blob and spans (sorted by start, then rule) for the current rule versions; a pair that two
        runs scanned at once counts once."""
        rows = self.read()
        current = F.array(*[F.lit(rule_id(r)) for r in self.rules])
        by_kind = F.filter("found", lambda s: F.exists(F.array_intersect("rules", current),
                                                       lambda r: F.startswith(r, F.concat(s.kind, F.lit("@")))))
        return rows.groupBy("blob").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list(by_kind)))).alias("spans"))

    def run(self, docs: DataFrame, keep: list[str]) -> DataFrame:
        """The columns ``keep`` of every row of ``docs``, its blob, and the blob's spans."""
        rows = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("blob", F.sha2("text", 256))
        self.scan(rows.select("blob", "text"))
        none = F.array().cast(f"array<{SPAN}>")
        return (rows.select("blob", *[c for c in keep if c != "blob"]).join(self.findings(), "blob", "left")
                .withColumn("spans", F.coalesce("spans", none)))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every stretch covered by spans replaced by the mask."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, (acc.at + 1).cast("int"), (s.start - acc.at).cast("int"))
        return F.struct(F.when(s.start >= acc.at, F.concat(acc.out, before, F.lit(MASK))).otherwise(acc.out).alias("out"),
                        F.greatest(acc.at, s.end).alias("at"))

    def rest(acc: Column) -> Column:
        return F.concat(acc.out, F.substring(text, (acc.at + 1).cast("int"), F.lit(2**31 - 1)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Findings of every document, through a ledger that starts empty."""
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = BlobLedger(spark, fresh_scratch(spark, "secret-ledger")).run(docs, keep=["doc_id"])
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, BASE), F.sha2(span_list(base), 256).alias("base_sha256"),
                      span_list(F.col("spans")).alias("spans"))


def _rule_sql(rule: tuple, rank: int) -> str:
    kind, _, pattern, group, least = rule
    p = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, unnest(list_transform(range(1, len(hit) + 1), lambda i: struct_pack(
    s := list_sum(list_transform(gap[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda h: length(h))), 0),
    n := length(hit[i]), ok := length(part[i]) >= {least}))) AS x
  FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS hit, regexp_extract_all(text, '{p}', {group}) AS part,
    string_split_regex(text, '{p}') AS gap FROM docs)"""


# Written apart: matches and gaps per rule, unnested and joined as text.
OP5_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(_rule_sql(r, i) for i, r in enumerate(RULES))}),
spans AS (SELECT doc_id, rank, kind, x.s::BIGINT AS s, kind || ':' || x.s::BIGINT || ':' || (x.s + x.n)::BIGINT AS told
  FROM found WHERE x.ok),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(told, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
    string_agg(told, ',' ORDER BY s, rank) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN per USING (doc_id)
"""
