import re
from itertools import combinations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from check_oracles import rows_of
from credsight.llm import minhash as M

from ..conftest import SF_SMALL
from .conftest import ODD_TEXTS


def brute_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        both = len(a & b)
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            top[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d if d is not None else -1, len(s), low.get(find(i), -1) if low.get(find(i)) is not None else -1)
                  for i, ((d, _), s) in enumerate(zip(rows, sets)))


def families(seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for family in range(12):
        words = list(rng.choice(vocabulary, 120))
        for _ in range(12):                      # steps away from the one before: chains whose ends aren't linked
            words = list(words)
            for k in rng.integers(0, len(words), 1 + family % 4):
                words[k] = str(rng.choice(vocabulary))
            rows.append((1000 - n, " ".join(words) + (" TAIL" if family % 2 else " tail")))
            n += 1
    passage = " ".join(rng.choice(vocabulary, 60))
    for _ in range(60):                          # a passage shared by texts that aren't alike
        rows.append((2000 + n, " ".join(rng.choice(vocabulary, 50)) + " " + passage + " " + " ".join(rng.choice(vocabulary, 40))))
        n += 1
    return rows + [(3000 + i, rows[5][1]) for i in range(30)] + [(4000 + i, t) for i, t in enumerate(ODD_TEXTS)]


@pytest.mark.parametrize("small", [False, True])
def test_as_brute_force(docs_of, monkeypatch, small):
    if small:                                    # many blocks
        monkeypatch.setattr(M, "BLOCK_ROWS", 4)
        monkeypatch.setattr(M, "BLOCK_SHINGLES", 400)
    rows = families() + [(None, "a b c d e f"), (9, None), (8, ""), (7, "x y"), (6, "X Y"), (6, "X Y"), (5, "a b c d e f")]
    out = M.near_duplicates(docs_of(rows)).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in out)
    assert got == brute(rows)
    for r in out:
        assert r.kept == (r.doc_id == r.component_id)


def test_keys_find_all_pairs_under_the_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (400, M.HASHES)).astype(np.uint16)
    b = a.copy()
    for i, row in enumerate(b):
        at = rng.permutation(M.HASHES)[:M.ERRORS if i % 2 else i % (M.ERRORS + 1)]
        row[at] ^= rng.integers(1, 1 << 16, len(at)).astype(np.uint16)
    assert (M.index_keys(a) == M.index_keys(b)).any(axis=1).all()
    assert len(np.unique(M.index_keys(a))) == M.index_keys(a).size


def test_signatures_estimate_similarity():
    base = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 4000).astype(np.uint64))
    one, two = base[:2000], base[200:2200]
    sig = M.signatures([one, two, one[:1]])
    want = 1 - 1800 / 2200
    assert abs((sig[0] != sig[1]).mean() - want) < 0.2
    again = M.signatures([two])
    assert (again[0] == sig[1]).all()


def test_shingles_of_a_batch():
    texts = ODD_TEXTS + [None, "A b C d E", "É b c d", "a b c d a b c d"]
    for arr in (pa.array(texts), pa.array(["zz"] + texts)[1:]):
        assert [len(s) for s in M.shingle_sets(arr)] == [len(brute_set(t)) for t in texts]


def test_empty_and_keep_one(docs_of):
    df = docs_of([(1, "a b c d e"), (1, "a b c d e"), (2, "A b c d e"), (3, None), (4, "other words stand here now")])
    assert M.near_duplicates(df.limit(0)).count() == 0
    kept = M.keep_one(df, M.near_duplicates(df))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_query_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    df = M.op7_minhash_near_dedup(spark, SF_SMALL)
    rel = con.execute(M.OP7_SQL)
    cols = [x[0] for x in rel.description]
    assert sorted(rows_of(df.columns, [tuple(r) for r in df.collect()])) == sorted(rows_of(cols, rel.fetchall()))


def test_keep_one_per_component_whatever_the_ids(docs_of):
    """Near copies that share an id, or have none, leave one row; clashing column names pass through."""
    from pyspark.sql import functions as F

    body = " ".join(f"w{i}" for i in range(200))
    near = body + " tail"
    docs = docs_of([(1, body), (1, near), (None, "x " + body), (None, "a b c"), (None, "a b c d"), (5, ""), (5, ""), (6, None)])
    docs = docs.withColumn("_rk", F.lit("own")).withColumn("_kept_key", F.lit("k")).withColumn("component", F.lit("c"))
    rows = M.keep_one(docs, M.near_duplicates(docs)).collect()
    assert {r._rk for r in rows} == {"own"} and {r.component for r in rows} == {"c"} and {r._kept_key for r in rows} == {"k"}
    texts = sorted((r.text or "")[:5] for r in rows)
    assert texts == sorted(["w0 w1", "a b c", "a b c", "", ""]) and [r.doc_id for r in rows if (r.text or "").startswith("w0")] == [1]
    lost = M.keep_one(docs.where("doc_id IS NULL"), M.near_duplicates(docs.where("doc_id IS NULL")))
    assert lost.count() == 3


@pytest.mark.parametrize("most", [M.SENT_KEYS, 0])
def test_only_texts_of_families_are_shuffled(docs_of, monkeypatch, most):
    """The keys of the members go to the texts, whatever their number the components are the same."""
    plans = []

    def kept(df, name, **options):
        if name == "links":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df, name, **options)

    materialize = M.materialize
    monkeypatch.setattr(M, "materialize", kept)
    monkeypatch.setattr(M, "SENT_KEYS", most)
    rows = families() + [(9, None), (8, "")]
    out = M.near_duplicates(docs_of(rows)).collect()
    got = sorted((r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in out)
    assert got == brute(rows)
    assert plans and all(("LeftSemi" in p) == (most > 0) for p in plans)
