from pyspark.sql import functions as F

import corpus_pipeline as CP
from credsight.llm import common as C
from credsight.llm import minhash, mixing


def test_row_keys(spark):
    """Equal rows share a key of 16 bytes; a null is no value, and no value moves over to its neighbour."""
    rows = [(5, None, "a"), (5, "a", None), (5, "", "a"), (None, "5", "a"), (5, "a", "1:b"), (5, "a1:b", ""), (5, "a", "b"), (51, "a", "b"), (5, "n", "a"), (5, None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    keys = [bytes(r.k) for r in df.select(C.row_key("doc_id", "source", "text").alias("k")).collect()]
    assert all(len(k) == 16 for k in keys)
    assert keys[0] == keys[-1] and len(set(keys)) == len(rows) - 1


def test_clashing_columns(spark, docs_of):
    """Columns that carry names used inside come back as they were."""
    extra = ["_rk", "_copies", "_copy", "_blob", "_spans", "_row", "_kept_key", "blob", "spans", "row_key", "component"]
    docs = docs_of([(i, f"password=abcdef{i:02d} " + "w " * i, "en", f"s{i % 2}") for i in range(12)])
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in extra})

    def check(out):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)
        return rows

    check(mixing.apply_mix(docs, mixing.mix(docs)))
    check(minhash.keep_one(docs, minhash.near_duplicates(docs)))
    assert all("abcdef" not in r.text for r in check(CP.secret_scan(spark, docs, "")))
