import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from credsight.llm import common as C
from credsight.llm import mixing

from ..conftest import SF_SMALL
from .conftest import ODD_TEXTS


def brute_targets(size_of):
    names = sorted((s for s in size_of if s is not None), key=lambda s: s.encode()) + ([None] if None in size_of else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, free, target = 1.5 * sum(size_of.values()), set(names), {}
    while free:
        w = sum(weight[s] for s in free)
        above = {s for s in free if budget * weight[s] / w >= 2 * size_of[s]}
        if not above:
            target.update({s: budget * weight[s] / w for s in free})
            break
        target.update({s: 2.0 * size_of[s] for s in above})
        budget -= sum(2.0 * size_of[s] for s in above)
        free -= above
    return target


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(0, 60), st.integers(1, 9), min_size=1, max_size=12), st.integers(0, 2000), st.sampled_from([5, 50, 10_000]))
def test_fit_never_overspends(hist, budget, dp):
    lengths, counts = np.array(list(hist)), np.array(list(hist.values()))
    taken = mixing.fit_budget(lengths, counts, budget, dp)
    assert (taken >= 0).all() and (taken <= counts).all() and (taken[lengths == 0] == 0).all()
    spent = int((taken * lengths).sum())
    assert spent <= budget
    if budget >= (lengths * counts).sum():
        assert spent == (lengths * counts).sum()


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=7), st.integers(0, 300))
def test_dynamic_program_is_exact(hist, budget):
    """With no proportional share taken first, the program finds the best sum there is."""
    lengths, counts = np.array(list(hist)), np.array(list(hist.values()))
    sums = {0}
    for length, n in hist.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    base = mixing.fit_budget(lengths, counts, budget)
    part = np.floor(counts * min(1.0, budget / (lengths * counts).sum())).astype(int)
    left = {0}
    for length, n, p in zip(lengths, counts, part):
        left = {s + k * length for s in left for k in range(n - p + 1)}
    rest = budget - int((part * lengths).sum())
    assert int((base * lengths).sum()) == budget - rest + max(s for s in left if s <= rest)


def brute_size(t):
    return len(re.findall(C.WORD, t or ""))


@pytest.mark.parametrize("slice_rows", [10_000, 7])
def test_mix(spark, docs_of, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    rows = [(i, "w " * (i % 7 + 1), "en", f"s{i % 5}") for i in range(200)]
    rows += [(1000 + i, "hot " * 5, "en", "hot") for i in range(100)] + [(2000 + i, t, "en", None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3000, None, "en", "s1"), (None, "a b c", "en", "s2"), (5, "w " * 6, "en", "s0"), (5, "w " * 6, "en", "s0"), (4000, "", "en", "void")]
    df = docs_of(rows)
    size_of = defaultdict(int)
    for r in rows:
        size_of[r[3]] += brute_size(r[1])
    want = brute_targets(dict(size_of))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    by_source = defaultdict(int)
    text_of = {(r[0], brute_size(r[1])): r[3] for r in rows}
    for r in out:
        s = text_of[r.doc_id, r["size"]]
        assert r.source_size == size_of[s] and abs(r.target - want[s]) < 1e-6
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        by_source[s] += r.taken
    for s, taken in by_source.items():
        longest = max(brute_size(r[1]) for r in rows if r[3] == s)      # one long document can't be split
        assert want[s] - max(8, longest) <= taken <= want[s] + 1
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((r.row_key, r.copies) for r in out) == sorted((r.row_key, r.copies) for r in again)
    mixed = mixing.apply_mix(df, mixing.mix(df))
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in out)


def test_empty_and_query(spark, docs_of):
    assert mixing.mix(docs_of([(1, "a")]).limit(0)).count() == 0
    assert mixing.mix(docs_of([(1, None), (2, "")])).where("taken > 0").count() == 0
    out = mixing.op9_source_mix(spark, SF_SMALL)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert out.count() == spark.read.parquet(SF_SMALL + "/documents.parquet").count()
