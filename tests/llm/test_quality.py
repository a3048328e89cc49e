import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credsight.llm import quality as Q

from ..conftest import SF_SMALL
from .conftest import ODD_TEXTS


def brute(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    tri = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n, covered = Counter(tri), set()
    for i, w in enumerate(tri):
        if n[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_odd_texts():
    for t in ODD_TEXTS + ["a b c a b c", "a a a a", "x\nx\n \n \n\t\n\t\nx", "\xa0\n\xa0\n", "\x1c\n\x1c"]:
        assert Q.rule_counts(t) == brute(t), t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n\t#é\xa0")), max_size=60))
def test_any_text(t):
    assert Q.rule_counts(t) == brute(t)


def brute_buckets(t):
    b = t.encode()
    return [((int.from_bytes(b[i:i + 4], "big") * 0x9E3779B1) % 2**32) >> 16 for i in range(len(b) - 3)]


def test_grams_stay_inside_a_text():
    texts = ["abcdef", "", None, "xyz", "ééééé", "1234"]
    h, first = Q.gram_buckets(pa.array(texts))
    for i, t in enumerate(texts):
        assert h[first[i]:first[i + 1]].tolist() == brute_buckets(t or "")


def test_counts_and_scores_by_brute_force(spark, docs_of):
    rng = np.random.default_rng(1)
    good = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 60))) for i in range(30)]
    bad = [(100 + i, " ".join(rng.choice(["zx!!", "qq##", "$$v"], 60))) for i in range(30)]
    rows = good + bad + [(200 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "alpha beta"), (7, good[7][1]), (300, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(100 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (5, None, 0)],
                                   "doc_id bigint, quality int, toxic int")
    df = docs_of(rows)
    ratio = Q.fit(df, labels)
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(brute_buckets(t or ""))
        if i is not None and i < 20:
            target.update(brute_buckets(t or ""))
    want = np.array([np.log((target[b] + 1) / (target.total() + Q.BUCKETS)) - np.log((raw[b] + 1) / (raw.total() + Q.BUCKETS))
                     for b in range(Q.BUCKETS)])
    assert np.allclose(ratio.log_ratio, want)
    out = Q.score(df, ratio, keep=["doc_id", "text", "n"])
    for r in out.collect():
        n = brute_buckets(r.text or "")
        assert abs(r.score - (want[n].mean() if n else 0)) < 1e-6
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text or "")
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and (r.score >= ratio.threshold))
    kept = {r.doc_id for r in out.where(~F.col("base_failed") & F.col("kept")).collect()}
    assert not kept & set(range(100, 130))


def test_without_labels_and_empty(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    df = docs_of([(1, "a " * 60), (2, " ".join(map(str, range(80))))])
    out = {r.doc_id: r for r in Q.score(df, Q.fit(df, none), keep=["doc_id"]).collect()}
    assert not out[1].kept and out[2].kept and out[2].score is None
    assert Q.score(df.limit(0), Q.fit(df.limit(0), none), keep=["doc_id"]).count() == 0


def test_held_out_accuracy(spark):
    """Fitted on the labels of even ids, judged on those of odd ids."""
    sf = SF_SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(sf + "/documents.parquet"), spark.read.parquet(sf + "/labels.parquet")
    ratio = Q.fit(docs, labels.where("doc_id % 2 = 0"))
    out = Q.score(docs.select("doc_id", "text"), ratio, keep=["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id")
    r = out.where("NOT base_failed").agg(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert r.n > 50 and r.right > 0.98
    assert Q.op3_quality_rules(spark, sf).count() == docs.count()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1, max_size=12))
def test_least_error_by_brute_force(counts):
    good, bad = (np.array([c[i] for c in counts]) for i in (0, 1))
    if not good.sum() or not bad.sum():
        return
    values = np.arange(len(counts)) * 0.5
    cut = Q.least_error(values, good, bad)

    def error(t):
        return good[values < t].sum() * bad.sum() + bad[values >= t].sum() * good.sum()

    tries = [values[0], *(values[1:] - 0.25)]
    assert error(cut) == min(map(error, tries)) and cut == next(t for t in tries if error(t) == error(cut))


def test_scores_do_not_depend_on_the_batch():
    texts = ["abcdefgh" * 40, "", None, "xyz", "the quick brown fox " * 30, "abc", "q" * 4]
    ratio = Q.Ratio(np.random.default_rng(3).normal(size=Q.BUCKETS))
    together = ratio.scores(pa.array(texts))
    assert together.tolist() == [ratio.scores(pa.array([t], pa.string()))[0] for t in texts]
    assert ratio.scores(pa.array([None, ""], pa.string())).tolist() == [0, 0]


def test_wrong_labels_move_the_threshold_little(spark, docs_of):
    rng = np.random.default_rng(4)
    good = [(i, " ".join(rng.choice([f"w{k}" for k in range(80)], 70))) for i in range(200)]
    bad = [(1000 + i, " ".join(rng.choice([f"{k}!#" for k in range(80)], 70))) for i in range(200)]
    wrong = set(range(1000, 1012)) | set(range(12))                 # 6 % on each side
    labels = [(i, int((i < 1000) != (i in wrong)), 0) for i in [*range(100), *range(1000, 1100)]]
    df = docs_of(good + bad)
    ratio = Q.fit(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert {r.doc_id for r in Q.score(df, ratio, keep=["doc_id"]).where("kept").collect()} == {i for i, _ in good}


def test_only_trusted_labels(spark, docs_of):
    rng = np.random.default_rng(6)
    df = docs_of([(i, " ".join(rng.choice([f"w{k}" for k in range(80)], 70))) for i in range(40)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    assert Q.score(df, Q.fit(df, labels), keep=["doc_id"]).where("kept").count() == 40


def test_every_label_counts(spark):
    """More labels than any sample would hold: all are used, whatever their number."""
    n = 50_000
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    both = spark.createDataFrame([(1, 0), (None, 1), (n + 1, None)], "doc_id bigint, quality int")
    got = Q.labelled(labels.unionByName(both)).groupBy("trusted").count().collect()
    assert {r.trusted: r["count"] for r in got} == {True: n // 2 - 1, False: n // 2 + 1}


def test_labels_sent_or_joined_agree(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("noise " * 60)).otherwise(
        F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: F.concat(F.lit("word"), i + F.col("id"))))).alias("text"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 3 != 0).cast("int").alias("quality"))
    sent = Q.fit(docs, labels)
    monkeypatch.setattr(Q, "SENT_IDS", 0)
    joined = Q.fit(docs, labels)
    assert sent.threshold == joined.threshold and (sent.log_ratio == joined.log_ratio).all()
