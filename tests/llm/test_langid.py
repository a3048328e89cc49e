import numpy as np
from pyspark.sql import functions as F

from credsight.llm import langid as G
from credsight.llm.quality import BUCKETS

from ..conftest import SF_SMALL
from .conftest import ODD_TEXTS
from .test_quality import brute_buckets

PAGES = "page_id bigint, url string, html string, lang string"
TEXTS = "doc_id bigint, text string, lang string, source string"


def page(i, url, html):
    return (i, url, html, "x")


def test_page_evidence(spark):
    rows = [page(1, "https://me@Blog.Example.co.uk:80/de/x?y", "<!DOCTYPE html><HTML Lang='EN-us'><head><title>t</title></head><p>a<script>var x='<p>'</script>b<!-- c --></p>"),
            page(2, None, None), page(3, "no address", "<p>x"), page(4, "http://h/", "plain")]
    got = {r.page_id: r for r in G.page_evidence(spark.createDataFrame(rows, PAGES)).collect()}
    r = got[1]
    assert (r.declared, r.host, r.domain, r.suffix, r.text.split()) == ("en", "blog.example.co.uk", "co.uk", "uk/de", ["a", "b"])
    assert (got[2].declared, got[2].host, got[2].text) == (None, None, "") and got[3].host is None and got[4].host == "h"


def brute_fuse(rows, languages):
    """rows: (scores, text_lang, declared, host, domain, suffix) -> (lang, confidence)"""
    n = len(languages)
    known = [r for r in rows if r[1] is not None]

    def count(f):
        return np.array([sum(f(r) and r[1] == x for r in known) for x in languages], dtype=float)

    total = count(lambda r: True)
    everywhere = (total + 1) / (total.sum() + n)
    n_suffix = len({r[5] for r in known if r[5] is not None}) + 1
    n_declared = len({r[2] for r in known if r[2] is not None}) + 1

    def smooth(own, towards):
        return (own + G.PRIOR_ROWS * towards) / (own.sum() + G.PRIOR_ROWS)

    out = []
    for scores, _, declared, host, domain, suffix in rows:
        sums = np.array(scores, dtype=float)
        seen = any(r[3] == host and r[4] == domain and r[5] == suffix for r in known) and host is not None
        if seen:
            level = smooth(count(lambda r: r[5] == suffix) if suffix is not None else np.zeros(n), everywhere)
            level = smooth(count(lambda r: (r[4], r[5]) == (domain, suffix)) if domain is not None else np.zeros(n), level)
            sums += np.log(smooth(count(lambda r: (r[3], r[4], r[5]) == (host, domain, suffix)), level))
        else:
            sums += np.log(everywhere)
        if declared is not None:
            sums += np.log((count(lambda r: r[2] == declared) + G.FLOOR) / (total + G.FLOOR * n_declared))
        if suffix is not None and any(r[5] == suffix for r in known):
            sums += np.log((count(lambda r: r[5] == suffix) + G.FLOOR) / (total + G.FLOOR * n_suffix))
        p = np.exp(sums - sums.max())
        p /= p.sum()
        out.append((languages[int(sums.argmax())] if p.max() >= G.CONFIDENT else G.UNKNOWN, round(float(p.max()), 6)))
    return out


def test_fusion_as_brute_force(spark):
    rng = np.random.default_rng(4)
    languages = ["de", "en", "fr"]
    rows = []
    for i in range(200):
        scores = rng.normal(0, 2, 3).round(3).tolist()
        empty = i % 17 == 0
        rows.append(([0.0] * 3 if empty else scores, None if empty else languages[int(np.argmax(scores))],
                     [None, "de", "en", "xx"][i % 4], [None, "a.x.org", "b.x.org", "c.com"][i % 4 if i < 150 else 1],
                     None, None))
    rows = [(s, t, d, h, None if h is None else ".".join(h.split(".")[-2:]), None if h is None or i % 5 == 0 else h.split(".")[-1])
            for i, (s, t, d, h, _, _) in enumerate(rows)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "id int, scores array<double>, text_lang string, declared string, host string, domain string, suffix string")
    got = {r.id: (r.lang, r.confidence) for r in G.fuse(df, languages).collect()}
    for i, (lang, p) in enumerate(brute_fuse(rows, languages)):
        assert got[i][0] == lang and abs(got[i][1] - p) < 1e-5


def test_text_scores_as_brute_force(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(50, None)]
    model = np.log(np.random.default_rng(0).dirichlet(np.ones(BUCKETS), 2))
    out = G.text_scores(docs_of(rows), ["a", "b"], model, ["doc_id", "text"]).collect()
    for r in out:
        b = brute_buckets(r.text or "")
        want = model[:, b].sum(axis=1) / 4 if b else np.zeros(2)
        assert np.allclose(r.scores, want, atol=1e-5) and r.text_lang == ("ab"[int(np.argmax(want))] if b else None)


def test_held_out_accuracy_and_query(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    docs, pages = spark.read.parquet(sf + "/documents.parquet"), spark.read.parquet(sf + "/pages.parquet")
    languages, model = G.fit_text(docs.where("doc_id % 2 = 0"))
    out = G.identify(docs.where("doc_id % 2 = 1").withColumn("lang", F.when(F.col("doc_id") % 4 == 1, F.col("lang"))), pages, languages, model)
    r = out.where("doc_id IS NOT NULL").join(docs.select("doc_id", F.col("lang").alias("want")), "doc_id").agg(
        F.avg((F.col("lang") == F.col("want")).cast("int")).alias("right"), F.avg(F.col("kept").cast("int")).alias("kept")).first()
    assert r.right > 0.98 and r.kept > 0.98
    rows = G.op10_language_id(spark, sf)
    assert rows.count() == docs.count() + pages.count() == rows.select("doc_id").distinct().count()
    assert rows.where("doc_id IS NULL OR (doc_id < 0) <> (page_id IS NOT NULL)").count() == 0


def test_nothing_declared_and_empty(spark, docs_of):
    docs = docs_of([(1, "abc def", None, None), (2, None, " ", "s")])
    pages = spark.createDataFrame([], PAGES)
    languages, model = G.fit_text(docs)
    assert languages == []
    assert {(r.doc_id, r.lang, r.kept) for r in G.identify(docs, pages, languages, model).collect()} == {(1, "und", False), (2, "und", False)}
    one = docs_of([(1, "abc def", "en", "s"), (1, "abc def", "en", "s"), (2, "", None, None)])
    languages, model = G.fit_text(one)
    assert G.identify(one, pages, languages, model).count() == 3
    assert G.identify(one.limit(0), pages, languages, model).count() == 0


def test_rare_language_beside_a_hot_one(spark):
    """Every declared row counts: the model of a rare language doesn't depend on how many others there are."""
    hot = spark.range(30_000).selectExpr("id AS doc_id", "concat('the river and the town ', id) AS text", "'en' AS lang", "'s' AS source")
    rare = spark.createDataFrame([(100_000 + i, "zyx wvu tsr qpo " * 3, "Zz " if i % 2 else "zz", "s") for i in range(4)], TEXTS)
    languages, model = G.fit_text(hot.unionByName(rare))
    want = np.bincount(brute_buckets("zyx wvu tsr qpo " * 3), minlength=BUCKETS) * 4 + G.SMOOTH
    assert languages == ["en", "zz"] and np.allclose(model[1], np.log(want / want.sum()))
    asked = spark.createDataFrame([(1, "zyx wvu tsr", None, None), (2, "the town and the river", None, None)], TEXTS)
    got = G.identify(asked, spark.createDataFrame([], PAGES), languages, model).collect()
    assert {r.doc_id: r.lang for r in got} == {1: "zz", 2: "en"}


def test_many_languages(spark, docs_of):
    """No cap: each of 130 languages is found, also from upper-case declarations; tasks hold 64 at a time."""
    rng = np.random.default_rng(5)
    words = {f"l{k:03}": " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(12)) for k in range(130)}
    docs = docs_of([(i, t, x.upper() if i % 2 else x, f"s{i % 3}") for i, (x, t) in enumerate([*words.items()] * 2)], 1)
    languages, model = G.fit_text(docs)
    assert languages == sorted(words)
    got = G.identify(docs.withColumn("lang", F.lit(None).cast("string")), spark.createDataFrame([], PAGES), languages, model).collect()
    assert len(got) == 260 and {r.doc_id: r.lang for r in got} == {i: x for i, x in enumerate([*words] * 2)}
