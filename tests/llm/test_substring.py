import re
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from check_oracles import rows_of
from credsight.llm import common as C
from credsight.llm import substring as S
from credsight.llm.fmindex import FMIndex, WaveletMatrix

from ..conftest import SF_SMALL
from .conftest import ODD_TEXTS


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    low = defaultdict(lambda: float("inf"))
    for (d, _), w in zip(rows, words):
        if d is not None:
            for i in range(len(w) - 49):
                k = tuple(w[i:i + 50])
                low[k] = min(low[k], d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        if d is not None:
            for i in range(len(w) - 49):
                if low[tuple(w[i:i + 50])] < d:
                    gone.update(range(i, i + 50))
        out.append((-1 if d is None else d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def corpus(seed=5):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    def text(n):
        return " ".join(rng.choice(vocabulary, n))
    passage, other = text(70), text(50)
    rows = [(100 - i, f"{text(int(rng.integers(0, 40)))} {passage}\n{text(int(rng.integers(0, 90)))}") for i in range(25)]
    rows += [(200 + i, f"{text(5)} {other} {text(60)} {passage} {other}") for i in range(5)]
    base = text(300)
    rows += [(300 + i, base) for i in range(4)]
    for i in range(8):
        w = base.split()
        w[int(rng.integers(0, 300))] = "changed"
        rows.append((400 + i, " ".join(w)))
    rows += [(500, "x " * 500), (501, "x " * 120), (502, "x y " * 200), (503, "y x " * 100), (504, "x " * 49), (505, "x " * 50)]
    rows += [(600 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(700 + i, t) for i, t in enumerate(ODD_TEXTS)]
    return rows + [(None, passage), (None, None), (800, None), (801, base), (801, base), (801, passage), (-3, other + " tail")]


@pytest.mark.parametrize("hot,shard", [(20_000, 8_000), (2, 3), (0, 8_000), (20_000, 5)])
def test_as_brute_force(docs_of, monkeypatch, hot, shard):
    monkeypatch.setattr(S, "HOT_PASSAGES", hot)
    monkeypatch.setattr(S, "SHARD_PASSAGES", shard)
    rows = corpus()
    out = S.remove_repeats(docs_of(rows)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == brute(rows)


def shard(*rows):
    return pd.DataFrame([(i, i + 100, d, provider, t, len(t.split(" ")) - 49, False) for i, (d, provider, t) in enumerate(rows)],
                        columns=["key", "content", "doc_id", "provider", "words", "n", "fine"])


def test_the_index_decides(monkeypatch):
    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words[:60]), " ".join(words[5:70])
    rows = shard((9, False, b), (1, True, a), (4, True, " ".join(words[100:150])))
    got = S._search(rows)                           # windows 0-5 of b are windows 5-10 of a, the other ten are its own
    assert {(r.key, r.off, r.len, r.low) for r in got.itertuples()} == {(0, 0, 6, 1), (1, 0, 11, 1), (2, 0, 1, 4)}
    seen = []

    class Silent(FMIndex):
        def matching_statistics(self, queries):
            seen.append((self.n, len(queries)))
            length, row, first = super().matching_statistics(queries)
            return np.minimum(length, 49), row, first

    monkeypatch.setattr(S, "FMIndex", Silent)
    assert len(S._search(rows)) == 0 and seen == [(61 + 51, 3)]     # only providers are indexed, all are streamed


def test_empty(docs_of):
    assert S.remove_repeats(docs_of([(1, "a")]).limit(0)).count() == 0


def test_wavelet_rank():
    v = np.random.default_rng(2).integers(0, 37, 1000)
    m = WaveletMatrix(v, 6)
    for at in (0, 1, 63, 64, 65, 500, 1000):
        s = np.arange(40)
        assert m.rank(s, np.full(40, at)).tolist() == [int((v[:at] == x).sum()) for x in s]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=90), min_size=1, max_size=5), st.lists(st.lists(st.integers(1, 4), max_size=90), max_size=4))
def test_matching_statistics(sequences, queries):
    owner = np.arange(len(sequences)) + 10
    index = FMIndex([np.array(s, dtype=np.int64) for s in sequences], owner, 50)
    queries = queries + sequences                   # some known whole, some not
    length, row, first = index.matching_statistics([np.array(q, dtype=np.int64) for q in queries])

    def places(p):
        return {owner[i] for i, s in enumerate(sequences) for j in range(len(s)) if s[j:j + len(p)] == p}

    for k, q in enumerate(queries):
        for i in range(len(q)):
            n = int(length[first[k] + i])
            assert n == 50 or i + n == len(q) or not places(q[i:i + n + 1])
            assert n == 0 or places(q[i:i + n])
            if n == 50:
                assert index.group_owner[index.group[row[first[k] + i]]] == min(places(q[i:i + 50]))


def test_runs_cover_all_windows():
    words = C.Words(pa.array(["a b c " * 60, None, "d", " ".join(map(str, range(200)))]))
    got = S.anchors(words.hash)
    grams = C.gram_hashes(words.hash, S.ANCHOR)
    for i in range(len(words.hash) - 49):
        assert got[i] == grams[i:i + 43].min()


def test_query_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    df = S.op1_substring_dedup(spark, SF_SMALL)
    rel = con.execute(S.OP1_SQL)
    cols = [x[0] for x in rel.description]
    assert sorted(rows_of(df.columns, [tuple(r) for r in df.collect()])) == sorted(rows_of(cols, rel.fetchall()))
