"""Language identification by Bayesian fusion of evidence.

Four pieces of evidence are multiplied: the likelihood of the text under one
multinomial of hashed byte n-grams per language, the declared markup language,
the address suffix, and the prior of the host.  Text models count all declared
documents; every declared language (trimmed, in lower case) has one.  The other
tables are grouped aggregates over all rows, of the language that the text
alone gives: declared given language, suffix given language, and host counts,
smoothed towards the registered domain, that towards the suffix, and that
towards all rows (``PRIOR_ROWS`` rows' worth at each step).

N-grams overlap, so their log-likelihood counts ``1 / GRAM`` each.

Defined cases: a null or empty text says nothing about the language (the other
evidence decides); missing declarations and addresses are neutral; a posterior
under ``CONFIDENT`` gives language ``und`` and ``kept`` false; ties go to the
first language by name; repeated rows count as often as they occur; an empty
table gives an empty table; without any declared document all is ``und``.

Scale: texts are read where they lie and leave only one number per language.
Host, suffix and declaration tables are pre-aggregated and joined by key, so that
a host of a third of all rows is split by the join.  Fitting is one more scan: a task
adds up its n-grams per language (``HELD`` languages at a time).  The text models
(languages x ``BUCKETS`` numbers, 0.5 MB a language) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField

from ..session import materialize
from . import common as C
from .quality import BUCKETS, GRAM, gram_buckets

HELD, SMOOTH = 64, 0.5
PRIOR_ROWS, CONFIDENT, FLOOR = 20.0, 0.5, 0.5
UNKNOWN = "und"


def declared_language() -> Column:
    """The declared language of a document: trimmed, in lower case, null for none."""
    return F.lower(F.nullif(F.trim("lang"), F.lit("")))


def fit_text(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log probability per bucket (languages x BUCKETS), counted over all
    declared documents.  Only the aggregated counts come to the driver."""
    declared = docs.select("text", declared_language().alias("lang")).where("lang IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, n in sums.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])],
                                                 names=["lang", "bucket", "n"])
            sums.clear()

        for whole in batches:
            for b in C.pieces(whole):
                b = b.sort_by("lang")              # the n-grams of a language lie side by side
                h, first = gram_buckets(b.column(0))
                runs = b.column(1).to_pylist()
                starts = [i for i, x in enumerate(runs) if not i or x != runs[i - 1]]
                for i, j in zip(starts, [*starts[1:], len(runs)]):
                    if runs[i] not in sums and len(sums) == HELD:
                        yield from told()          # part of the counts; they are added up below
                    n = np.bincount(h[first[i]:first[j]], minlength=BUCKETS)
                    sums[runs[i]] = sums[runs[i]] + n if runs[i] in sums else n
        yield from told()

    C.small_batches(docs.sparkSession)
    counts = (declared.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket")
              .agg(F.sum("n").alias("n")).toArrow())
    codes = counts.column("lang").combine_chunks().dictionary_encode()
    names = codes.dictionary.to_pylist()
    languages = sorted(names)
    place = np.array([languages.index(x) for x in names], dtype=np.int64)
    sums = np.full((len(languages), BUCKETS), SMOOTH)
    if languages:
        sums[place[codes.indices.to_numpy()], counts.column("bucket").to_numpy()] += counts.column("n").to_numpy()
    sums /= sums.sum(axis=1, keepdims=True)
    return languages, np.log(sums, out=sums)


def text_scores(rows: DataFrame, languages: list[str], model: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``scores`` (log-likelihood per language) and ``text_lang`` (the best
    one; null for a text without n-grams)."""
    shared = rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model.T))
    fields = [StructField("scores", ArrayType(DoubleType())), StructField("text_lang", StringType())]

    def fn(b: pa.RecordBatch) -> list[pa.Array]:
        h, first = gram_buckets(b.column(b.schema.get_field_index("text")))
        table, n = shared.value, np.diff(first)
        out = np.zeros((len(n), table.shape[1]))
        some = np.flatnonzero(n)
        if len(some):
            for k in range(table.shape[1]):
                out[some, k] = np.add.reduceat(table[h, k], first[some]) / GRAM
        out = np.round(out, 6)
        best = [languages[i] if m else None for i, m in zip(out.argmax(axis=1), n)] if languages else [None] * len(n)
        return [pa.array(out.tolist(), pa.list_(pa.float64())), pa.array(best, pa.string())]

    return C.map_rows(rows.select(*[c for c in keep if c != "text"], "text"), keep, fields, fn)


def _counts(rows: DataFrame, keys: list[str], languages: list[str], out: str) -> DataFrame:
    """Per key: rows of each language (by text), as an array."""
    per = rows.where("text_lang IS NOT NULL").groupBy(*keys, "text_lang").agg(F.count("*").cast("double").alias("_n"))
    per = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("text_lang", "_n"))).alias("_per"))
    return per.select(*keys, F.transform(F.lit(languages), lambda x: F.coalesce(F.try_element_at("_per", x), F.lit(0.0))).alias(out))


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """Adds lang, confidence and kept to rows with scores, text_lang, declared, host, domain, suffix
    (null where there is none)."""
    n = len(languages)
    if not n:
        return rows.withColumns({"lang": F.lit(UNKNOWN), "confidence": F.lit(0.0), "kept": F.lit(False)})
    rows = materialize(rows, "scores")
    total = _counts(rows, [], languages, "n").first().n
    share = (np.array(total) + 1.0) / (sum(total) + n)
    everywhere = F.array(*[F.lit(float(x)) for x in share])

    def smoothed(own: Column, towards: Column) -> Column:
        size = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, towards, lambda c, p: (c + PRIOR_ROWS * p) / (size + PRIOR_ROWS))

    def given(own: Column, n_values: Column) -> Column:
        """P(value | language) with FLOOR rows added to each value."""
        all_rows = F.array(*[F.lit(float(x)) for x in total])
        return F.zip_with(own, all_rows, lambda c, t: (c + FLOOR) / (t + FLOOR * n_values))

    known = rows.where("text_lang IS NOT NULL")
    suffix = materialize(_counts(known.where("suffix IS NOT NULL"), ["suffix"], languages, "n_suffix"), "suffixes")
    domain = _counts(known.where("domain IS NOT NULL"), ["suffix", "domain"], languages, "n_domain")
    host = _counts(known.where("host IS NOT NULL"), ["suffix", "domain", "host"], languages, "n_host")
    declared = materialize(_counts(known.where("declared IS NOT NULL"), ["declared"], languages, "n_declared"), "declared")
    n_suffix, n_declared = F.lit(suffix.count() + 1), F.lit(declared.count() + 1)

    prior = (host.join(domain, [host.suffix.eqNullSafe(domain.suffix), host.domain.eqNullSafe(domain.domain)], "left")
             .select(host.suffix, host.domain, host.host, "n_host", "n_domain"))
    prior = (prior.join(suffix, "suffix", "left")
             .select(F.col("suffix").alias("_s"), F.col("domain").alias("_d"), F.col("host").alias("_h"), "n_host", "n_domain", "n_suffix"))
    flat = F.array(*[F.lit(1.0)] * n)
    nothing = F.array(*[F.lit(0.0)] * n)
    level = smoothed(F.coalesce("n_suffix", nothing), everywhere)
    level = smoothed(F.coalesce("n_domain", nothing), level)
    prior = prior.withColumn("prior", smoothed(F.col("n_host"), level)).select("_s", "_d", "_h", "prior")
    joined = rows.join(prior, rows.suffix.eqNullSafe(prior._s) & rows.domain.eqNullSafe(prior._d) & rows.host.eqNullSafe(prior._h), "left")
    joined = joined.drop("_s", "_d", "_h").join(declared, "declared", "left").join(
        suffix.select("suffix", given(F.col("n_suffix"), n_suffix).alias("p_suffix")), "suffix", "left")
    joined = joined.withColumn("p_declared", F.when(F.col("declared").isNull(), flat).otherwise(
        given(F.coalesce("n_declared", nothing), n_declared)))

    def log(x: Column) -> Column:
        return F.transform(x, lambda v: F.log(v))

    def plus(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    joined = joined.withColumn("sums", plus(plus(F.col("scores"), log(F.coalesce("prior", everywhere))),
                                            plus(log(F.col("p_declared")), log(F.coalesce("p_suffix", flat)))))
    joined = joined.withColumn("best", F.array_max("sums"))
    joined = joined.withColumn("confidence", 1.0 / F.aggregate("sums", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best"))))
    names = F.array(*[F.lit(x) for x in languages])
    lang = F.element_at(names, F.array_position("sums", F.col("best")).cast("int"))
    joined = joined.withColumn("kept", F.col("confidence") >= CONFIDENT)
    return (joined.withColumn("lang", F.when(F.col("kept"), lang).otherwise(UNKNOWN))
            .withColumn("confidence", F.round("confidence", 6))
            .drop("sums", "best", "prior", "p_suffix", "p_declared", "n_declared"))


BLOCKS = r"(?is)<(script|style|nav|footer|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"


def page_evidence(pages: DataFrame) -> DataFrame:
    """text, declared, host, domain and suffix of web pages (columns page_id, url, html)."""
    address = F.lower(F.coalesce("url", F.lit("")))
    host = F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)
    parts = F.split("host", r"\.")
    pages = pages.select("page_id", F.regexp_replace(F.coalesce("html", F.lit("")), BLOCKS, " ").alias("text"),
                         F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1).alias("declared"),
                         F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)", 1).alias("path"), host.alias("host"))
    pages = pages.withColumn("host", F.nullif("host", F.lit("")))
    return pages.select("page_id", "text", F.nullif(F.lower("declared"), F.lit("")).alias("declared"), "host",
                        F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), ".").alias("domain"),
                        F.concat_ws("/", F.element_at(parts, -1), F.nullif("path", F.lit(""))).alias("suffix"))


def identify(docs: DataFrame, pages: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """doc_id, page_id, lang, confidence and kept of all documents and pages.  A document's host
    is its source; it has no address."""
    none = F.lit(None).cast("string")
    d = docs.select("doc_id", F.lit(None).cast("bigint").alias("page_id"), "text", declared_language().alias("declared"),
                    F.col("source").alias("host"), F.col("source").alias("domain"), none.alias("suffix"))
    p = page_evidence(pages).select(F.lit(None).cast("bigint").alias("doc_id"), "page_id", "text", "declared", "host", "domain", "suffix")
    keep = ["doc_id", "page_id", "declared", "host", "domain", "suffix"]
    return fuse(text_scores(d.unionByName(p), languages, model, keep), languages).select(
        "doc_id", "page_id", "declared", "text_lang", "lang", "confidence", "kept")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every document and page; text models fitted on declared documents.  Every row
    carries an integer doc_id: a page's is -1 - page_id, apart from all documents."""
    docs, pages = C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "pages")
    languages, model = fit_text(docs)
    out = identify(docs, pages, languages, model)
    return out.withColumn("doc_id", F.when(F.col("page_id").isNull(), F.col("doc_id")).otherwise(-1 - F.col("page_id")))
