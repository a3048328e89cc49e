import hashlib
import re
import struct
from collections import defaultdict

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credsight.llm import fingerprint as P

from ..conftest import SF_SMALL
from .conftest import ODD_TEXTS


def xx(parts, seed=42):
    h = seed
    for p in parts:
        raw = p.encode() if isinstance(p, str) else struct.pack("<q", p) if abs(p) > 2**31 else struct.pack("<i", p)
        h = xxhash.xxh64_intdigest(raw, h)
    return h


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def brute(t):
    tok = re.findall(r"[^\x20\x09-\x0D]{1,16}", t or "")
    if len(tok) >= 3:
        kmers = [xx(tok[i:i + 3]) for i in range(len(tok) - 2)]
    else:
        kmers = [xx([" ".join(tok)])] if tok else []
    seen, bins = defaultdict(int), defaultdict(list)
    for pos, k in enumerate(kmers):
        h = xxhash.xxh64_intdigest(struct.pack("<q", signed(k)), 42)
        key = signed(xxhash.xxh64_intdigest(struct.pack("<i", seen[k]), h))
        seen[k] += 1
        bins[key >> (64 - P.BIN_BITS)].append((key, pos))
    out = []
    for b in sorted(bins):
        few = sorted(sorted(bins[b])[:P.SELECT], key=lambda x: x[1])
        h = 42
        for key, _ in few:
            h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        low = 32 - P.BIN_BITS
        out.append((b % (1 << P.BIN_BITS) << low) + signed(h) % (1 << low))
    return out


def like(a, b):
    low = 32 - P.BIN_BITS
    either = {x >> low for x in a} | {x >> low for x in b}
    return len(set(a) & set(b)) / len(either) if either else 1.0


def edit(t, n):
    half = len(t) // 2
    return t[:len(t) - half] + n[:half]


def test_as_brute_force(spark, docs_of):
    texts = ODD_TEXTS + ["a b c a b c a b c d", "x " * 500, "one two", " ".join(map(str, range(400)))]
    rows = [(3 * i - 5, t) for i, t in enumerate(texts)] + [(2, None), (None, "last of all"), (7, "q r s t"), (7, "q r s t")]
    out = P.edited_prints(docs_of(rows)).collect()
    assert len(out) == len(rows)
    keyed = sorted({(r.doc_id is None, r.doc_id, r.row_key) for r in out}, key=lambda x: (x[0], x[1] or 0, x[2]))
    text_of = {}
    for d, t in rows:
        text_of.setdefault((d, len(t or ""), tuple(brute(t))), t or "")
    by_key = {r.row_key: text_of[r.doc_id, r.n_chars, tuple(r.fp)] for r in out}
    order = [k for _, _, k in keyed]
    for r in out:
        t, n = by_key[r.row_key], by_key[order[(order.index(r.row_key) + 1) % len(order)]]
        e = edit(t, n)
        assert r.fp == brute(t) and r.edited_fp == brute(e)
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(r.near_edited - like(brute(t), brute(e))) < 1e-12 and abs(r.near_next - like(brute(t), brute(n))) < 1e-12


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab \n日"))), min_size=8, max_size=30))
def test_any_text(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", P.fingerprint(F.col("text")).alias("fp")).collect():
        assert r.fp == brute(r.text)


def test_order_matters(spark):
    words = [f"w{i}" for i in range(300)]
    moved = words[150:] + words[:150]
    df = spark.createDataFrame([(" ".join(words), " ".join(moved), " ".join(words[:-3]))], "a string, b string, c string")
    r = df.select(P.likeness(P.fingerprint(F.col("a")), P.fingerprint(F.col("b"))).alias("moved"),
                  P.likeness(P.fingerprint(F.col("a")), P.fingerprint(F.col("c"))).alias("cut")).first()
    assert r.cut > 0.9 and r.moved < 0.75                # both share nearly all k-mers


def test_one_document_and_none(docs_of):
    r = P.edited_prints(docs_of([(1, "abcd")])).first()
    assert r.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and r.near_next == 1.0
    assert P.edited_prints(docs_of([(1, "a")]).limit(0)).count() == 0


def test_query(spark):
    df = P.op8_order_minhash(spark, SF_SMALL)
    docs = sorted(spark.read.parquet(SF_SMALL + "/documents.parquet").select("doc_id", "text").collect())
    text, nexts = {}, {}
    for i, (d, t) in enumerate(docs):
        text[d], nexts[d] = t or "", docs[(i + 1) % len(docs)][1] or ""
    rows = df.collect()
    assert len(rows) == len(docs)
    for r in rows:
        e = edit(text[r.doc_id], nexts[r.doc_id])
        assert (r.n_chars, r.edited_sha256) == (len(text[r.doc_id]), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:08x}" for x in brute(text[r.doc_id]))
        assert r.edited_fingerprint == "".join(f"{x:08x}" for x in brute(e))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
