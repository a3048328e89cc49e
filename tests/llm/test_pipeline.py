"""Every stage against a brute-force version of its own input."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline as CP
from credsight.llm import bpe

from ..conftest import SF_SMALL
from . import test_minhash as brute_minhash
from . import test_mixing as brute_mixing
from . import test_quality as brute_quality
from . import test_secrets as brute_secrets
from .conftest import ODD_TEXTS

SF = SF_SMALL


@pytest.fixture(scope="module")
def steps(spark):
    """Rows of the input and of every stage's result on the smallest tables, one extra row of each kind."""
    docs = spark.read.parquet(SF + "/documents.parquet")
    extra = [(-1, None, "en", "src0", None), (-2, "", "en", None, 0), (-3, "secret = abcdefgh " + " ".join(f"w{i}" for i in range(70)), "en", "src1", 1),
             (-3, "secret = abcdefgh " + " ".join(f"w{i}" for i in range(70)), "en", "src1", 1), (None, " ".join(f"v{i}" for i in range(90)), "en", "src1", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs = docs.withColumn("score", docs.lang).withColumn("kept", docs.source).withColumn("node", docs.doc_id)
    out = [docs.collect()]
    for _, stage in CP.STAGES:
        made = stage(spark, docs, SF)
        if stage is not CP.byte_bpe:
            assert made.columns == docs.columns and made.dtypes == docs.dtypes
        rows = made.collect()
        docs = spark.createDataFrame(rows, made.schema)
        out.append(rows)
    return out


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "")


def test_quality(steps):
    before, after = steps[0], steps[1]
    kept = {key(r) for r in after}
    for r in before:
        n_words, _, _, _, repeated = brute_quality.brute(r.text or "")
        if n_words < 50 or 100 * repeated > 50 * n_words:
            assert key(r) not in kept
    assert len(kept) > 0.8 * sum(brute_quality.brute(r.text or "")[0] >= 50 for r in before)


def test_near_dedup(steps):
    before, after = steps[1], steps[2]
    want = {d for d, _, low in brute_minhash.brute([(r.doc_id, r.text) for r in before]) if d == low}
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in after) == sorted(want)


def test_secrets(steps):
    before, after = {key(r)[:2]: r for r in steps[2]}, {key(r)[:2]: r for r in steps[3]}
    assert before.keys() == after.keys()
    n = 0
    for k, r in before.items():
        want, at = "", 0
        for a, _, b, _ in brute_secrets.brute(r.text):
            if a >= at:
                want += r.text[at:a] + "<secret>"
            at = max(at, b)
            n += 1
        want += r.text[at:]
        assert after[k].text == want and after[k].n_chars == (r.n_chars if want == r.text else len(want))
    assert n > 0


def test_mix(steps):
    before, after = steps[3], steps[4]
    size, taken, longest = {}, {}, {}
    for r in before:
        size[r.source] = size.get(r.source, 0) + brute_mixing.brute_size(r.text)
        longest[r.source] = max(longest.get(r.source, 0), brute_mixing.brute_size(r.text))
    count = {}
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + brute_mixing.brute_size(r.text)
        count[key(r)] = count.get(key(r), 0) + 1
    assert max(count.values()) <= 2 and count.keys() <= {key(r) for r in before}
    for s, t in brute_mixing.brute_targets(size).items():
        assert t - longest[s] - 8 <= taken.get(s, 0) <= t + 1


def test_bpe(steps):
    ranks = bpe.read_ranks(P.path(bpe.VOCABULARY))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id or 0, np.array(lib.encode_ordinary(r.text), "<u4").tobytes(), hashlib.sha256(r.text.encode()).hexdigest()) for r in steps[4])
    assert sorted((r.doc_id or 0, bytes(r.token_ids), r.decoded_sha256) for r in steps[5]) == want
    assert all(4 * r.n_tokens == len(r.token_ids) for r in steps[5])


def test_run_and_empty(spark, docs_of):
    assert CP.run(spark, SF).count() > 50
    docs = spark.read.parquet(SF + "/documents.parquet").limit(0)
    for _, stage in CP.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_texts_pass(spark, docs_of):
    docs = docs_of([(i, t) for i, t in enumerate(ODD_TEXTS)] + [(i, t) for i, t in enumerate(ODD_TEXTS)])
    for _, stage in CP.STAGES:
        made = stage(spark, docs, SF)
        docs = spark.createDataFrame(made.collect(), made.schema)
    assert {r.doc_id for r in docs.collect()} <= set(range(len(ODD_TEXTS)))
