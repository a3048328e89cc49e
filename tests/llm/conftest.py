import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOC = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                  StructField("source", StringType()), StructField("n_chars", LongType()),
                  StructField("key", StringType()), StructField("n", StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of([(doc_id, text) or (doc_id, text, lang, source)]) with two extra columns of common names."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0",
                 None if r[1] is None else len(r[1]), "k", "x") for r in rows]
        return spark.createDataFrame(full, DOC).repartition(parts)

    return make


ODD_TEXTS = ["", " ", "\n\n", "one", "  lead and trail  ", "tab\tnew\nline\r\x0b\x0c end", "日本語 テキスト ▁▁ <unk> \x00\x01",
             "é́ 👩‍👩‍👧 x", "a" * 5000, "x y " * 20000, "\x1c\x1d 1²३  nbsp em", "it's we'll 'S 12 3.5 !!"]
