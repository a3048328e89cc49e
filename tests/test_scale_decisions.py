"""Work of the decisions that is done once: metric maps, vocabulary look-ups, JSON texts."""

import re

from pyspark.sql import functions as F

from credsight.operators import audit as AU
from credsight.operators import policy as PO
from credsight.operators import retrieval as RT


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_metrics_of_an_application_are_made_once(spark):
    apps = spark.createDataFrame([(1, "Personal Loan", 1000.0, 9000.0, 600.0, -400, 2), (1, "Personal Loan", 1000.0, 9000.0, 600.0, -400, 2),
                                  (None, None, None, None, None, None, None)],
                                 "application_id long, loan_scheme string, amt_income_total double, amt_credit double, "
                                 "amt_annuity double, days_employed int, region_rating_client int")
    got = PO.policy_rollup(PO.evaluate_rules(apps, PO.rule_table(spark)))
    assert plan(got).count("thin_file") == 1
    rows = got.select("application_id", "passed_rules", "failed_rules", "required_action").collect()
    assert sorted(rows, key=str) == sorted([(1, [], ["PL-1:refer:threshold_violated", "PL-2:refer:threshold_violated",
                                                     "PL-3:escalate:threshold_violated"], "refer")] * 2 + [(None, [], [], None)], key=str)


def test_lists_of_queries_are_made_once_a_key(spark):
    book = spark.createDataFrame([("v", "A", "x", 1, "red loan"), ("v", "B", "x", 2, "loan blue"), ("v", "C", "y", 3, "green")],
                                 "corpus_version string, clause_id string, scheme string, clause_pos int, text string")
    parts = RT.tfidf_parts(book, extra=["scheme", "clause_pos"])
    asked = spark.createDataFrame([(7, "q1", "v", "x", "a loan of 12"), (7, "q2", "v", "x", "loan 99 red"), (8, "q3", "v", "y", "red"),
                                   (None, "q4", "v", "x", None)], "id long, query_id string, corpus_version string, scheme string, query string")
    rows = RT.retrieve_small_corpus(asked, parts).collect()
    got = RT.retrieve_small_lists(asked.withColumn("same", F.col("query_id")), parts, keep=["same"]).collect()
    for r in got:
        mine = sorted((x["rank"], x["clause_id"], x["score"]) for x in rows if x["query_id"] == r["same"] and not x["retrieval_failed"])
        assert [tuple(h) for h in r["hits"]] == mine and r["failed"] == (not mine)
    assert len(got) == 4 and "array_intersect" not in plan(RT._known_terms(asked, parts[1], "query_id", "corpus_version", "scheme", []))


def test_canonical_json_is_written_once(spark):
    df = spark.createDataFrame([("é\U0001F600", 1), ("a", None)], "t string, n int")
    got = df.select(AU.canonical_json({"t": F.col("t"), "n": F.col("n")}).alias("j"))
    assert [r[0] for r in got.collect()] == ['{"n":1,"t":"\\u00e9\\ud83d\\ude00"}', '{"n":null,"t":"a"}']
    assert len(re.findall("to_json|structstojson", plan(got).lower())) == 1, plan(got)


def test_chains_return_the_hashes_without_the_payloads(spark):
    """The walk over bytes gives the links of the text form; payloads come back only where they are asked for."""
    import hashlib

    rows = [(1, 1, "t", "é{}"), (1, 2, None, "x" * 5000), (2, 1, "u", None), (None, 1, "n", "a"), (None, 2, "n", "b")]
    ev = spark.createDataFrame(rows, "k bigint, seq int, event_type string, payload_json string").repartition(3)
    got = AU.build_chains(ev, "k", ["seq"], returned=["k", "seq"])
    assert got.columns == ["k", "seq", "prev_hash", "entry_hash"]
    links = {(r.k, r.seq): (r.prev_hash, r.entry_hash) for r in got.collect()}
    last = {}
    for k, seq, et, pl in rows:
        prev = last.get(k, AU.GENESIS_HASH) if k is not None else AU.GENESIS_HASH
        last[k] = hashlib.sha256(f"{prev}|{et}|{pl}".encode()).hexdigest()
        assert links[k, seq] == (prev, last[k])
    whole = AU.build_chains(ev, "k", ["seq"])
    assert whole.columns == [*ev.columns, "prev_hash", "entry_hash"]
    assert {(r.k, r.seq): (r.prev_hash, r.entry_hash) for r in whole.collect()} == links
    assert "rlike" not in plan(ev.select(AU.canonical_json({"p": F.col("payload_json")}))).lower()
