import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from credsight.llm import bpe

from .conftest import ODD_TEXTS

PATH = P.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def both():
    ranks = bpe.read_ranks(PATH)
    return (bpe.Codec(ranks, P.PATTERN),
            tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))


def test_odd_texts_as_the_library(both):
    codec, lib = both
    decoder = bpe.Decoder(bpe.read_ranks(PATH))
    for t in ODD_TEXTS + ["  a   b \n c", "  x", "end ", "a \n", "<|endoftext|> x"]:
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        assert ids == lib.encode_ordinary(t)
        assert decoder.decode(codec.encode(t)) == t.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z'sé日\n\t \r.!1²")), max_size=40))
def test_any_text_as_the_library(both, t):
    codec, lib = both
    assert np.frombuffer(codec.encode(t), "<u4").tolist() == lib.encode_ordinary(t)


def test_cache_generations(both, monkeypatch):
    codec, lib = both
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    t = "one two three four five six seven one two one eight nine ten one"
    assert np.frombuffer(codec.encode(t), "<u4").tolist() == lib.encode_ordinary(t)


def test_table(docs_of, both):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, None), (3, "one"), (3, "one")]
    df = docs_of(rows)
    out = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert set(df.columns) < set(out.columns)
    for r in out.collect():
        assert bytes(r.decoded) == (r.text or "").encode()
        assert np.frombuffer(bytes(r.token_ids), "<u4").tolist() == both[1].encode_ordinary(r.text or "")
        assert r.n_tokens * 4 == len(r.token_ids)
    both_ways = bpe.round_trip(df, PATH, P.PATTERN, keep=["doc_id", "text"])
    assert sorted(bytes(r.token_ids) for r in both_ways.collect()) == sorted(bytes(r.token_ids) for r in out.collect())
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in both_ways.collect())
    assert bpe.encode(docs_of(rows).limit(0), PATH, P.PATTERN).count() == 0


def test_query(spark, both):
    from .. import conftest

    out = {r.doc_id: r for r in bpe.op2_byte_bpe(spark, conftest.SF_SMALL).collect()}
    rows = spark.read.parquet(conftest.SF_SMALL + "/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(rows)
    for r in rows:
        ids = both[1].encode_ordinary(r.text or "")
        got = out[r.doc_id]
        assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
