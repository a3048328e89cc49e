import numpy as np
import pytest
from pyspark.sql import functions as F

from credsight.llm import common, crosspolytope as cp

SCHEMA = "vec_id bigint, embedding array<double>, vec string, gid string, label int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 0, 1) for i, v in rows], SCHEMA).repartition(3)


def exact(rows, k=5, step=50):
    """All cosines; {query: [(vec_id, score)]}."""
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for qid, q in fine:
        if qid % step == 0:
            scored = []
            for i, v in fine:
                if i != qid and len(v) == len(q):
                    a, b = np.array(q), np.array(v)
                    a, b = a / np.abs(a).max(), b / np.abs(b).max()
                    scored.append((-(a @ b) / np.sqrt((a @ a) * (b @ b)), i))
            if scored:
                out[qid] = [(i, -s) for s, i in sorted(scored, key=lambda p: (round(p[0], 12), p[1]))[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def same(got, want):
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    for q, pairs in want.items():
        assert np.allclose([s for _, s in got[q]], [s for _, s in pairs], atol=1e-12)


def test_odd_vectors(spark):
    """Few vectors: every bucket is probed, so the answer is exact."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(-60, 60)]
    rows += [(100, None), (150, []), (200, [0.0] * 6), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (300, [float("nan")] + [1.0] * 5),
             (350, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (400, [1e200] * 6), (401, [1e-200] * 6), (450, [3.0]),
             (451, [-2.0]), (500, [1.0, 2.0]), rows[0], rows[60]]
    same(found(cp.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0)), exact(rows))
    assert cp.nearest(frame(spark, rows).limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert cp.nearest(frame(spark, [(1, [1.0]), (2, [1.0])]), F.col("vec_id") % 50 == 0).count() == 0


def test_copies_and_ties(spark):
    """A third of all rows are one vector, a third are its multiples by powers of two."""
    rng = np.random.default_rng(2)
    one = rng.normal(size=8)
    rows = [(i, one.tolist()) for i in range(0, 120)] + [(i, (one * 2.0 ** (i % 9 - 4)).tolist()) for i in range(120, 240)]
    rows += [(i, rng.normal(size=8).tolist()) for i in range(240, 360)]
    rng.shuffle(rows)
    rows = [(int(i), list(v)) for i, v in rows]
    same(found(cp.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0)), exact(rows))


def test_split_cells_lose_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(3000)]
    whole = found(cp.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0))
    monkeypatch.setattr(cp, "BLOCK", 64)
    assert found(cp.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0)) == whole
    want = exact(rows)
    hits = sum(len({i for i, _ in whole[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(len(v) for v in want.values())


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, table):
    """Random directions, the hardest case: few near neighbours stand out."""
    data = common.read(spark, f"/root/testdata/{table}", "embeddings").toPandas()
    want = exact([(int(i), [float(x) for x in v]) for i, v in zip(data.vec_id, data.embedding)])
    got = found(cp.op13_nearest_neighbours(spark, f"/root/testdata/{table}"))
    assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(len(v) for v in want.values())
    scores = {q: dict(v) for q, v in want.items()}
    assert all(abs(s - scores[q][i]) < 1e-12 for q, v in got.items() for i, s in v if i in scores[q])


@pytest.mark.parametrize("n", [40, 3000, 100_000, 5_000_000])
def test_codes_and_probes(n):
    hasher = cp.Hasher(12, n, probed=2.0)
    x = cp.unit(np.random.default_rng(n).normal(size=(7, 12)))
    rotated = hasher.sides(x, 0, len(hasher.bits) - 1)
    if hasher.bits[-1] == 5:                             # a full rotation keeps lengths
        assert np.allclose((rotated[:, :16] ** 2).sum(axis=1), 1)
    for table in range(hasher.tables):
        probes = hasher.best_codes(x, table)
        assert all(code in row for code, row in zip(hasher.codes(x, table), probes))     # a vector's own bucket comes first
        assert all(len(set(row)) == hasher.probes for row in probes)
    if len(hasher.bits) == 2:
        sums = (hasher.sides(x, 0, 0)[:, :, None] + hasher.sides(x, 0, 1)[:, None, :]).reshape(len(x), -1)
        best = np.sort(sums, axis=1)[:, ::-1][:, :hasher.probes]
        assert np.allclose(np.sort(np.take_along_axis(sums, hasher.best_codes(x, 0), 1), axis=1)[:, ::-1], best)


def test_transform_is_orthonormal():
    eye = cp.hadamard(np.eye(8))
    assert np.allclose(eye @ eye.T, np.eye(8)) and np.allclose(np.abs(eye), 8 ** -0.5)


def test_a_batch_is_hashed_in_slices(spark, monkeypatch):
    """A whole batch of queries is never probed at once: an array of codes holds ROOM of them at most, with the same answer."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(3000)]
    whole = found(cp.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0))
    for n in (3000, 615_000, 20_000_000):
        h = cp.Hasher(64, n)
        widest = max(min(h.probes, 1 << sum(h.bits[:i])) << b for i, b in enumerate(h.bits))
        assert h.probed_rows == max(1, cp.ROOM // widest) and h.probed_rows * widest <= max(cp.ROOM, widest)
    monkeypatch.setattr(cp, "ROOM", 1 << 12)
    assert cp.Hasher(16, 3000).probed_rows < 60
    assert found(cp.nearest(frame(spark, rows), F.col("vec_id") % 50 == 0)) == whole
