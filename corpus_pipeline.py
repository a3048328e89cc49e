"""From raw documents to token ids: quality rules, near-duplicate removal, secret
redaction, mixing to target weights, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of ``docs``.  ``run`` writes each stage's result
as Parquet in the shared folder and reads it back, so a lost executor costs at most
the stage that runs.

* quality_rules: documents that the rules reject go.
* near_dedup: of every component of near-duplicates, and of repeated rows, one row stays.
* secret_scan: stretches that hold a secret are replaced by a mask, ``n_chars`` follows.
* source_mix: every document appears as often as the mix takes it.
* byte_bpe: ids, their number and the digest of the decoded bytes.

A null text fails the quality rules (no words); an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsight.llm import bpe, common, minhash, mixing, quality, secrets
from credsight.session import fresh_scratch, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", F.struct(*others).alias("_others")) if others else docs
    ratio = quality.fit(docs, common.read(spark, sf_dir, "labels"))
    kept = quality.score(packed, ratio, keep=packed.columns).where("kept")
    return kept.select(*[F.col("_others")[c].alias(c) if c in others else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, minhash.near_duplicates(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = secrets.BlobLedger(spark, fresh_scratch(spark, "secret-ledger"))
    keyed = common.packed(docs, blob=F.sha2(F.coalesce("text", F.lit("")), 256))
    ledger.scan(keyed.select("blob", F.coalesce("_row.text", F.lit("")).alias("text")))
    found = ledger.findings().where(F.size("spans") > 0)
    old = F.col("_row.text")
    text = F.when(F.col("spans").isNull(), old).otherwise(secrets.redact(old, F.col("spans")))
    out = keyed.join(found, "blob", "left").withColumn("text", text)
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        made["n_chars"] = F.when(F.col("spans").isNull(), F.col("_row")["n_chars"]).otherwise(changed)
    return out.select(*[made.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs, mixing.mix(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    path, pattern = tokenizers.path(bpe.VOCABULARY), tokenizers.PATTERN
    ids = bpe.round_trip(docs, path, pattern, keep=["doc_id", "lang", "source"])
    return (ids.withColumn("decoded_sha256", F.sha2("decoded", 256))
            .select("doc_id", "lang", "source", "n_tokens", "token_ids", "decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

# A fitted threshold, a seeded choice and the merges can't be said in SQL; the tests hold each
# stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
