"""Document fingerprints by order MinHash.

A text is cut into tokens (words, in parts of at most ``TOKEN_CHARS``), its
k-mers are runs of ``K`` tokens, and every k-mer is numbered by its occurrence, so
that repeats differ.  The hash of (k-mer, occurrence) puts each into one of
``2**BIN_BITS`` bins; the ``SELECT`` smallest of a bin are put back into text
order and hashed as a tuple.  The tuples of all bins are the fingerprint; moving
a passage changes the order inside tuples, which plain MinHash doesn't see.

The likeness of two fingerprints is the share of equal tuples among the bins
that either fills; two empty fingerprints are alike (1.0).

Defined cases: a null text is empty; an empty text, or one of white space, has
an empty fingerprint; fewer than ``K`` tokens form one k-mer; equal texts have
equal fingerprints; repeated rows are one document of the order by id and are
given back as often as they came; a null id comes last; after the last document
comes the first; an empty table gives an empty table.

Scale: no explode and no Python.  Texts are shuffled once, by row key, and the
first half of each follower's text once more; fingerprints (at most 64 numbers)
and ids are all that moves besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import common as C

K, BIN_BITS, SELECT, TOKEN_CHARS = 3, 6, 2, 16


def _kmers(tokens: Column) -> Column:
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(K)]))
    return F.when(n >= K, runs).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", tokens)))).otherwise(F.array().cast("array<bigint>"))


def _numbered(kmers: Column) -> Column:
    """(hash of k-mer and occurrence, position) of every k-mer."""
    def item(kmer: Column, occurrence: Column, pos: Column) -> Column:
        return F.struct(F.xxhash64(kmer, occurrence).alias("key"), pos.cast("int").alias("pos"))

    def with_repeats(s: Column) -> Column:
        # sorted by k-mer and position: a k-mer's occurrences are a run of s
        n = F.size(s)
        first = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(s, i).kmer != F.get(s, i - 1).kmer))

        def runs(f: Column) -> Column:
            return F.flatten(F.transform(f, lambda a, r: F.sequence(F.lit(0), F.coalesce(F.get(f, r + 1), n) - a - 1)))

        return F.zip_with(s, C.let(first, runs), lambda x, o: item(x.kmer, o.cast("int"), x.pos))

    spread = F.transform(kmers, lambda x, i: item(x, F.lit(0), i))
    ordered = F.sort_array(F.transform(kmers, lambda x, i: F.struct(x.alias("kmer"), i.alias("pos"))))
    return F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), spread).otherwise(C.let(ordered, with_repeats))


def _bin(x: Column) -> Column:
    return F.shiftright(x.key, 64 - BIN_BITS)


def _tuples(items: Column) -> Column:
    """One number per filled bin: the bin in its high bits, the hash of its tuple in the others."""
    def smallest(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(_bin(F.get(s, i - SELECT)) != _bin(x), F.lit(True)))

    def tuples(m: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(m) - 1),
                         lambda i: F.coalesce(_bin(F.get(m, i - 1)) != _bin(F.get(m, i)), F.lit(True)))

        def told(i: Column) -> Column:
            own = F.filter(F.slice(m, i + 1, SELECT), lambda x: _bin(x) == _bin(F.get(m, i)))
            text_order = F.array_sort(F.transform(own, lambda x: F.struct(x.pos.alias("pos"), x.key.alias("key"))))
            h = F.xxhash64(F.transform(text_order, lambda x: x.key))
            low = 32 - BIN_BITS
            return (F.pmod(_bin(F.get(m, i)), F.lit(1 << BIN_BITS)) * F.lit(1 << low) + F.pmod(h, F.lit(1 << low)))

        return F.when(F.size(m) > 0, F.transform(heads, told)).otherwise(F.array().cast("array<bigint>"))

    return C.let(C.let(F.sort_array(items), smallest), tuples)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text: array of up to 2**BIN_BITS numbers of 32 bits, by bin."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(C.WORD[:-1] + f"{{1,{TOKEN_CHARS}}}"), F.lit(0))
    return C.let(C.let(C.let(tokens, _kmers), _numbered), _tuples)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins filled in either fingerprint, 0 to 1."""
    def bins(x: Column) -> Column:
        return F.transform(x, lambda v: F.shiftright(v, 32 - BIN_BITS))

    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def told(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda v: F.lpad(F.lower(F.hex(v)), 8, "0")), "")


def followers(docs: DataFrame) -> DataFrame:
    """row_key -> next_key: the next document by ascending id, the first after the last."""
    rows = docs.select("row_key", "doc_id").distinct()
    placed = materialize(C.ranked(rows, [F.col("doc_id").asc_nulls_last(), F.col("row_key")], "place"), "places")
    n = placed.count()
    nexts = placed.select(F.col("row_key").alias("next_key"), F.pmod(F.col("place") - 1, F.lit(max(n, 1))).alias("place"))
    return placed.join(nexts, "place").select("row_key", "next_key")


def edited_prints(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likeness.  The edit
    replaces the last half of the code points by the start of the next document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", C.row_key("doc_id", "text"))
    texts = rows.groupBy("row_key").agg(F.first("text").alias("text"))
    after = materialize(followers(rows).join(rows.select("row_key", F.length("text").alias("n")).distinct(), "row_key"), "followers")
    starts = (texts.join(after.select(F.col("next_key").alias("row_key"), F.col("row_key").alias("for_key"), F.floor(F.col("n") / 2)
                                      .cast("int").alias("half")), "row_key")
              .select(F.col("for_key").alias("row_key"), F.expr("left(text, half)").alias("start"), "half"))
    both = texts.join(starts, "row_key").withColumn(
        "edited", F.concat(F.expr("left(text, length(text) - half)"), "start"))
    prints = materialize(both.select("row_key", F.length("text").cast("bigint").alias("n_chars"),
                                     F.sha2("edited", 256).alias("edited_sha256"),
                                     fingerprint(F.col("text")).alias("fp"), fingerprint(F.col("edited")).alias("edited_fp")), "prints")
    nexts = after.select("row_key", "next_key").join(prints.select(F.col("row_key").alias("next_key"), F.col("fp").alias("next_fp")), "next_key")
    judged = prints.join(nexts, "row_key").select(
        "row_key", "n_chars", "edited_sha256", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
    return rows.select("doc_id", "row_key").join(judged, "row_key")


def op8_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    out = edited_prints(C.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", told(F.col("fp")).alias("fingerprint"),
                      told(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
