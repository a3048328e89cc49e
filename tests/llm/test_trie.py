import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from credsight.llm import common, trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, p1 string, words bigint, _at string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", 5, "z") for r in rows], SCHEMA).repartition(parts)


def expected(rows):
    """Every prefix as a tuple of turns, every subtree walked."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(f"{abs(c) % 20}") * (1 if c >= 0 else -1)
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def words(node):
        return len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0

    out = {}
    for node in sorted(members, key=len, reverse=True):
        kids = [out[k] for k in children.get(node, [])]
        out[node] = (min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids),
                     sum(k[5] for k in kids) or 1, (len(members[node]) - 1) * words(node) + sum(k[6] for k in kids),
                     hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
    return sorted(out.values(), key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def contract(spark, monkeypatch, rows, parts=3):
    monkeypatch.setattr(common, "read", lambda *_: frame(spark, rows, parts))
    return sorted((tuple(r) for r in trie.op12_conversation_trie(spark, "").select(*COLUMNS).collect()), key=repr)


def test_small_alphabet_of_turns(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(c, t, rng.choice("ua"), rng.choice(["x", "x y", ""])) for c in range(-45, 160) for t in range(rng.choice([0, 1, 1, 2, 3, 5]))]
    rng.shuffle(rows)
    assert contract(spark, monkeypatch, rows) == expected(rows)


def test_odd_rows(spark, monkeypatch):
    rows = [(1, None, None, None), (1, 0, "u", "a b"), (1, 0, "a", "a"), (1, 0, "a", "a"), (1, 0, "a", "a c"), (1, 7, "", "u"),
            (2, 0, "u", "long " * 50_000), (3, 0, "u", "long " * 50_000), (None, 0, "u", "lost"), (None, None, None, None),
            (20, 5, "u:", "a"), (20, 6, "u", ":a"), (21, 0, "u", ":a"), (33, 9, "u", "only base"), (9_000_000_000, 1, "u", "a")]
    assert contract(spark, monkeypatch, rows) == expected(rows)
    assert contract(spark, monkeypatch, rows[8:10]) == []


def test_one_conversation_and_one_sequence_hold_most_rows(spark, monkeypatch):
    """A conversation over many slices, and many conversations of one sequence."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(40, t, "u", f"t{t % 7}") for t in range(700)] + [(c, 0, "u", "same words here") for c in range(1000, 1300)]
        rows += [(41, t, "u", f"t{t % 7}") for t in range(640)]
        assert contract(spark, monkeypatch, rows, 8) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_hot_keys_meet_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    rows = spark.range(100).select(F.when(F.col("id") < 60, 0).otherwise(F.col("id")).alias("k"), "id")
    one = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = common.join_unique(rows, one, ["k"], "n")
    assert sorted((r.id, r.top) for r in got.collect()) == [(i, 59 if i < 60 else i) for i in range(100)]


def test_real_outputs(spark):
    rows = [(100, t, r, x) for t, (r, x) in enumerate([("u", "hi"), ("a", "hello you")])] + [(103, 0, "u", "hi"), (104, 0, "u", "hi")]
    turns = trie.number_turns(frame(spark, rows))
    paths = trie.prefix_paths(turns, turns.select("conv_id").distinct())
    sequences, ends = trie.weighted_sequences(paths)
    assert sorted((r.rep, r.weight, r.n, r.all_words) for r in sequences.collect()) == [(100, 1, 2, 3), (103, 2, 1, 1)]
    assert ends.count() == 3
    nodes = trie.prefix_trie(turns, turns.select("conv_id").distinct()).orderBy("depth").collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in nodes] == [
        (100, 0, 3, 1, 1, 2), (100, 1, 3, 1, 1, 2), (100, 2, 1, 0, 1, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_shapes(spark, monkeypatch, seed):
    rng = random.Random(seed)
    rows = [(c, rng.choice([None, t]), "u", str(rng.randrange(2))) for c in range(0, 60) for t in range(rng.randrange(6))]
    assert contract(spark, monkeypatch, rows, 2) == expected(rows)
