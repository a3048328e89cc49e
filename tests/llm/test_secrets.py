import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from check_oracles import rows_of
from credsight.llm import secrets as S
from credsight.session import fresh_scratch

from ..conftest import SF_SMALL
from .conftest import ODD_TEXTS

TEXTS = ["password=abc", "PassWord = 'abcdef' token: token: abcdefg", "x AKIA" + "Z9" * 8 + " AKIAAKIA" + "Q" * 12, "é日 " + "0a" * 12 + "g",
         "api_key=\"" + "ab12" * 8 + "\" ApiKey:zzzzzz", "ſecret=abcdef toKen=abcdef", "-----BEGIN RSA PRIVATE KEY-----\nx",
         "ghp_" + "a1B2" * 9 + " eyJhbGciOiJI.eyJhbGciOiJI.abcdefghij-k", "secret:=abcdef", "a" * 24 + " " + "f" * 23, "deadbeef " * 300,
         "hex " + " ".join(["0123456789abcdef01234567"] * 50)] + ODD_TEXTS


def brute(t):
    out = []
    for rank, (kind, _, pattern, group, least) in enumerate(S.RULES):
        for m in re.finditer(pattern, t or ""):
            if len(m[group]) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def told(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def ledger(spark, **more):
    return S.BlobLedger(spark, fresh_scratch(spark, "test-ledger"), **more)


def test_spans_as_brute_force(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(90, None), (None, TEXTS[1]), (1, TEXTS[1]), (91, TEXTS[1])]
    out = ledger(spark).run(docs_of(rows), keep=["doc_id", "text"]).collect()
    assert len(out) == len(rows)
    for r in out:
        assert [tuple(s) for s in r.spans] == brute(r.text)
    assert ledger(spark).run(docs_of(rows).limit(0), keep=["doc_id"]).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("apikey_=: \"token0AKI日"))), min_size=5, max_size=20))
def test_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [S.spans_of(F.col("text"), r, i) for i, r in enumerate(S.RULES)]
    for r in df.select("text", F.sort_array(F.concat(*found)).alias("spans")).collect():
        assert [tuple(s) for s in r.spans] == brute(r.text)


def test_only_unseen_pairs_are_scanned(spark, docs_of):
    book = ledger(spark)
    first = docs_of([(1, TEXTS[1]), (2, TEXTS[2]), (3, TEXTS[2])])
    book.run(first, keep=["doc_id"]).collect()
    assert book.read().count() == 2
    more = docs_of([(1, TEXTS[1]), (1, TEXTS[4]), (4, TEXTS[2])])           # a new version of row 1
    out = {(r.doc_id, r.blob): [tuple(s) for s in r.spans] for r in book.run(more, keep=["doc_id"]).collect()}
    assert book.read().count() == 3
    for d, t in ((1, TEXTS[1]), (1, TEXTS[4]), (4, TEXTS[2])):
        assert out[d, hashlib.sha256(t.encode()).hexdigest()] == brute(t)
    raised = [(k, v + (k == "access"), p, g, 20 if k == "access" else n) for k, v, p, g, n in S.RULES]
    raised[1] = ("access", 2, "AKIA[A-Z0-9]+", 0, 8)
    newer = S.BlobLedger(spark, book.path, raised)
    got = newer.run(docs_of([(7, TEXTS[2]), (8, "AKIAAAAA")]), keep=["doc_id"]).collect()
    rows = book.read().where(F.array_contains("rules", "access@2")).collect()
    assert sorted(len(r.rules) for r in rows) == [1, len(S.RULES)]          # the old blob for one rule, the new one for all
    assert {r.doc_id: len(r.spans) for r in got} == {7: 2, 8: 1}
    assert book.run(docs_of([(7, TEXTS[2])]), keep=[]).first().spans == [s for s in out[4, hashlib.sha256(TEXTS[2].encode()).hexdigest()]]


def test_redact(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    found = [S.spans_of(F.col("text"), r, i) for i, r in enumerate(S.RULES)]
    df = df.withColumn("spans", F.sort_array(F.concat(*found)))
    for r in df.select("text", "spans", S.redact(F.col("text"), F.col("spans")).alias("out")).collect():
        want, at = "", 0
        for a, _, b, _ in r.spans:
            if a >= at:
                want += r.text[at:a] + S.MASK
            at = max(at, b)
        assert r.out == want + r.text[at:]


def test_query_as_sql_and_native(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    df = S.op5_secret_scan(spark, SF_SMALL)
    rel = con.execute(S.OP5_SQL)
    cols = [x[0] for x in rel.description]
    assert sorted(rows_of(df.columns, [tuple(r) for r in df.collect()])) == sorted(rows_of(cols, rel.fetchall()))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_failing_read_is_not_an_empty_ledger(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        S.BlobLedger(spark, str(tmp_path)).read().count()
