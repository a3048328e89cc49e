import hashlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from check_oracles import rows_of
from credsight.llm import chat

from ..conftest import SF_SMALL

SCHEMA = "conv_id bigint, turn bigint, role string, text string, segments string, formatted string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


NASTY = ["\\### Assistant: </turn> ok", "\\\\h\\t###</turn>\n", "####", "</turn", "a\n### User: b</turn>\n", "", None, "\\", "é\u2028"]


def test_round_trip(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "to:ol ###", "x: y"), (2, 1, None, "z"), (2, None, "user", "first"), (None, 0, "user", "q"), (3, 0, "user", "a"),
             (3, 0, "user", "a"), (4, 0, "assistant", "b" * 100_000)]
    out = (chat.format_chats(frame(spark, rows)).withColumn("t", chat.read_back(F.col("formatted")))
           .withColumn("l", chat.loss_text(F.col("segments"))).collect())
    got = {r.conv_id: r for r in out}
    for conv in (1, 2, 3, 4, None):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in got[conv].t] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv].l == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert "".join(s.text for s in got[conv].segments) == got[conv].formatted
        assert got[conv].formatted.count("</turn>") == len(own)
    assert (got[3].valid, got[3].n_read) == (False, 1) and got[4].n_read == 0
    assert chat.format_chats(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("roles,valid,read", [("ua", True, 2), ("sua", True, 3), ("uaua", True, 4), ("u", False, 1), ("sa", False, 1),
                                              ("uu", False, 1), ("us", False, 1), ("uau", False, 3)])
def test_machine(spark, roles, valid, read):
    full = {"u": "user", "a": "assistant", "s": "system"}
    r = chat.format_chats(frame(spark, [(1, i, full[x], "t") for i, x in enumerate(roles)])).first()
    assert (r.valid, r.n_read) == (valid, read)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("\\bht#</turn>\n :c"))))
def test_escapes_are_reversible(t):
    marked = t
    for raw, mark in chat.TEMPLATE["escapes"].items():
        marked = marked.replace(raw, mark)
    assert "###" not in marked and "</turn>" not in marked
    for raw, mark in reversed(list(chat.TEMPLATE["escapes"].items())):
        marked = marked.replace(mark, raw)
    assert marked == t


def test_query_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF_SMALL}/conversations.parquet'")
    df = chat.op6_chat_format(spark, SF_SMALL)
    rel = con.execute(chat.OP6_SQL)
    cols = [x[0] for x in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(rows_of(df.columns, [tuple(r) for r in df.collect()])) == sorted(rows_of(cols, rel.fetchall()))
    probe = df.where("conv_id = -7").first()
    assert (probe.n_turns, probe.loss_chars) == (2, len(chat.PROBE))
    assert probe.loss_sha256 == hashlib.sha256(chat.PROBE.encode()).hexdigest()


def test_plan_is_native(spark):
    plan = chat.op6_chat_format(spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
