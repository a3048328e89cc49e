"""Both ways to known terms agree; a text scored once serves every scheme; landing never hides a broken table."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from credsight.operators import fairness as FA
from credsight.operators import retrieval as RT
from credsight.sources import landing as L

CLAUSES = [(1, "a", "income income proof of salary"), (2, "a", "loan amount limit"), (3, "b", "income limit for vehicle"),
           (4, None, "salary slip and income proof"), (5, "b", None)]
ASKED = [("q1", "a", "income proof income"), ("q2", "b", "income proof income"), ("q3", None, "income proof income"),
         ("q4", "a", "unknown words"), ("q5", "a", None), ("q6", "zz", "income"), ("q7", None, "")]


@pytest.fixture(scope="module")
def parts(spark):
    c = spark.createDataFrame(CLAUSES, "clause_id int, scheme string, text string") \
        .withColumns({"clause_pos": F.col("clause_id"), "corpus_version": F.lit("v")})
    return RT.tfidf_parts(c, extra=["scheme", "clause_pos"])


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "query_id string, scheme string, query string").withColumn("corpus_version", F.lit("v"))


def rows(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "clause_id", "clause_scheme", "score", "retrieval_failed").collect()), key=repr)


def test_known_terms_broadcast_or_joined(parts, asked, monkeypatch):
    by_broadcast = rows(RT.retrieve_small_corpus(asked, parts))
    monkeypatch.setattr(RT, "VOCABULARY_ROWS", 0)
    assert rows(RT.retrieve_small_corpus(asked, parts)) == by_broadcast


def test_text_scored_once_for_all_schemes(parts, asked):
    got = rows(RT.retrieve(asked, parts))
    assert got == rows(RT.retrieve_small_corpus(asked, parts))
    of = {q: [r[2] for r in sorted(r for r in got if r[0] == q and not r[5])] for q, _, _ in ASKED}
    assert 3 not in of["q1"] and set(of["q1"]) == {1} and of["q2"] == [3]
    assert set(of["q3"]) == {1, 3, 4} and not (of["q4"] or of["q5"] or of["q6"] or of["q7"])
    assert len([r for r in got if r[5]]) == 4


def test_broken_table_is_not_rebuilt_over(spark, tmp_path):
    path = tmp_path / "cache"
    path.mkdir()
    (path / "part.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception) as e:
        L.cached_parquet(spark, str(path), lambda: spark.range(3)).count()
    assert not (isinstance(e.value, AnalysisException) and e.value.getCondition() == "PATH_NOT_FOUND")
    assert (path / "part.parquet").read_bytes() == b"not a table"
    assert L.cached_parquet(spark, str(tmp_path / "new"), lambda: spark.range(3)).count() == 3


def test_loads_side_by_side_and_again(spark, tmp_path):
    path = str(tmp_path / "t")
    batch = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    assert L.land_incremental(batch, path, "f")["rows_loaded"] == 3
    assert L.land_incremental(batch, path, "f")["rows_loaded"] == 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_association_of_few_pairs(spark):
    df = spark.createDataFrame([("p", "q", 1), (None, "q", 2), ("p", None, 2)] + [("p", "q", 3), ("r", "s", 3)] * 20, "x string, y string, g int")
    v = {r.g: r.cramers_v for r in FA.cramers_v(df, "x", "y", by=["g"]).collect()}
    assert v[1] == 0.0 and abs(v[3] - 1.0) < 0.05 and 2 not in v


def test_index_moves_occurrences_once_and_packed(spark):
    """Equal terms share a bucket, no occurrence is lost, and postings are divided by their clause's norm only when read."""
    docs = spark.createDataFrame([(i, [f"w{j}" for j in range(i, i + 40)] + ["w1", "a b"]) for i in range(300)]
                                 + [(None, ["w1", "w1"]), (7, []), (8, None)], "clause_id int, _terms array<string>")
    got = RT.bucketed(docs, ["clause_id"], 5).withColumn("part", F.spark_partition_id())
    want = docs.select("clause_id", F.explode("_terms").alias("term"))
    assert got.select("clause_id", "term").exceptAll(want).count() == 0 and got.count() == want.count()
    assert got.groupBy("term").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0

    c = spark.createDataFrame(CLAUSES + [(None, "a", "income proof"), (None, "b", "income proof"), (1, "a", "more income")],
                              "clause_id int, scheme string, text string")
    index = RT.tfidf_parts(c.withColumns({"clause_pos": F.col("clause_id"), "corpus_version": F.lit("v")}), extra=["scheme", "clause_pos"])
    assert index.raw.where("head").count() == index.raw.select("term").distinct().count() == index[1].count()
    per = {r.clause_id: r for r in index.summary().collect()}
    read = index[0].groupBy("clause_id").agg(F.count("*").alias("n"), F.sum(F.col("weight") ** 2).alias("sq"), F.max("weight").alias("top")).collect()
    assert {r.clause_id for r in read} == set(per) == {1, 2, 3, 4, None}
    for r in read:
        assert (r.n, round(r.sq, 9), round(r.top, 9)) == (per[r.clause_id].n_terms, 1.0, round(per[r.clause_id].max_weight, 9))
