import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from credsight.llm import common, runs

from ..conftest import SF_SMALL
from .conftest import ODD_TEXTS


def slow_runs(words, min_length, min_exponent):
    """Every period, every maximal stretch of it; stretches of a smaller period left out."""
    found = []
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(min_length, min_exponent * q):
                if not any(p < q and s <= i and s + n >= i + length for s, n, p in found):
                    found.append((i, length, q))
            i = max(j, i) + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def fast_runs(texts, min_length, min_exponent):
    first = np.cumsum([0] + [len(t) for t in texts])
    got = runs.find_runs(np.array([w for t in texts for w in t], np.int64), first, min_length, min_exponent)
    return [[(s - a, n, q) for s, n, q in got if a <= s < b] for a, b in zip(first, first[1:])]


periodic = st.tuples(st.lists(st.integers(0, 3), max_size=5), st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 60))
text = st.lists(periodic, min_size=1, max_size=4).map(
    lambda parts: [w for head, unit, n in parts for w in head + (unit * n)[:n]])


@settings(max_examples=300, deadline=None)
@given(st.lists(text, min_size=1, max_size=3), st.sampled_from([(24, 3), (4, 2), (6, 3), (2, 2), (9, 4)]))
@example([[0] * 1200], (24, 3))
@example([[0, 1] * 600 + [2] + [0, 1] * 600], (24, 3))
def test_against_all_periods(texts, bounds):
    assert fast_runs(texts, *bounds) == [slow_runs(t, *bounds) for t in texts]


def test_random_small_alphabets():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3):
        texts = [rng.integers(0, size, rng.integers(0, 200)).tolist() for _ in range(40)]
        for bounds in ((4, 2), (8, 3)):
            assert fast_runs(texts, *bounds) == [slow_runs(t, *bounds) for t in texts]


def test_one_long_run_is_not_quadratic():
    got = fast_runs([[7] * 300_000 + [1] + [3, 4, 5] * 50_000], 24, 3)
    assert got == [[(0, 300_000, 1), (300_001, 150_000, 3)]]


def digests(doc_id, words):
    found = slow_runs(words, 24, 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for s, n, q in found:
        if best is None or n * best[2] > best[1] * q:
            best = (s, n, q)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), None if best is None else 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def expected(doc_id, body):
    words = re.findall(r"[^\x20\x09-\x0D]+", body or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return digests(doc_id, words)


def chosen(many, of):
    return [i for i in range(-5, 4000) if (zlib.crc32(str(i).encode()) % 10 == 0) == of][:many]


def contract(spark, frame, monkeypatch):
    monkeypatch.setattr(common, "read", lambda *_: frame)
    return sorted((tuple(r) for r in runs.op11_periodic_runs(spark, "").collect()), key=repr)


def test_query_on_odd_texts(spark, docs_of, monkeypatch):
    bodies = [*ODD_TEXTS[:-1], None, "a b c " * 30, " ".join(f"w{i}" for i in range(700)), "x\n" * 24, "x\n" * 23, "ab cd " * 12 + "ab",
              "p q r s t u v w " * 3, "p q r s t u v w " * 3 + "p q", "a a b " * 9 + "a a c " * 9]
    bodies = [b for b in bodies if b is None or len(b) < 30_000]
    rows = [(i, b) for ids in (chosen(len(bodies), True), chosen(len(bodies), False)) for i, b in zip(ids, bodies)]
    rows += [rows[0], (None, "a " * 30), (None, None)]
    assert contract(spark, docs_of(rows), monkeypatch) == sorted((expected(*r) for r in rows), key=repr)
    assert contract(spark, docs_of(rows).limit(0), monkeypatch) == []


def test_operator_keeps_real_outputs(spark, docs_of):
    got = {r.doc_id: r for r in runs.periodic_runs(docs_of([(1, "go " + "left right " * 12 + "stop"), (2, "x " * 30), (3, None)])).collect()}
    assert [tuple(r) for r in got[1].runs] == [(1, 24, 2)] and got[1].collapsed == "go left right stop" and got[1].n_words == 26
    assert got[2].collapsed == "x" and got[3].collapsed == "" and got[3].runs == []
    looser = runs.periodic_runs(docs_of([(1, "a b a b a b")]), 4, 2, keep=("key", "doc_id")).first()
    assert looser.key == "k" and looser.collapsed == "a b"
    with pytest.raises(ValueError):
        runs.periodic_runs(docs_of([(1, "a")]), 24, 1)


def test_all_documents(spark):
    rows = {tuple(r) for r in runs.op11_periodic_runs(spark, SF_SMALL).collect()}
    for r in common.read(spark, SF_SMALL, "documents").where("length(text) < 8000").limit(60).collect():
        assert expected(r.doc_id, r.text) in rows
