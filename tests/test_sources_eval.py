"""Sources (S1, S10), exact evaluation against brute force, split invariance."""

import json
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from credsight.operators import evaluate as EV
from credsight.operators import model as MD
from credsight.sources import corpus as CO
from credsight.sources import landing as L


def test_source_catalog(spark):
    d = tempfile.mkdtemp(prefix="cfg-", dir="/tmp")
    p = os.path.join(d, "sources.yaml")
    with open(p, "w") as fh:
        fh.write("sources:\n  - file: a.csv\n    table: raw_a\n  - file: b.csv\n    table: raw_b\n    enabled: false\n"
                 "  - file: c.csv\n    table: raw_c\n")
    cat = L.load_source_catalog(spark, p)
    assert [r.table for r in L.select_sources(cat).collect()] == ["raw_a", "raw_c"]
    assert [r.table for r in L.select_sources(cat, ["raw_c"]).collect()] == ["raw_c"]


def test_json_corpus_both_shapes(spark):
    d = tempfile.mkdtemp(prefix="corpus-", dir="/tmp")
    new = {"corpus_version": "v1.0", "effective_date": "2026-01-01",
           "clauses": [{"clause_id": "A-1", "scheme": "Personal Loan", "title": "t", "text": "x", "tags": ["a"],
                        "rule": {"metric": "dti", "operator": "<=", "threshold": 0.5, "on_violation": "refer"}},
                       {"clause_id": "A-2", "scheme": "Vehicle Loan", "title": "t2", "text": "y", "tags": []}]}
    old = {"version": "v0.1", "scheme": "Personal Loan",
           "clauses": [{"clause_id": "O-1", "title": "o", "text": "z"}]}
    for name, doc in [("new.json", new), ("old.json", old)]:
        with open(os.path.join(d, name), "w") as fh:
            json.dump(doc, fh, indent=2)
    rows = {r.clause_id: r for r in CO.json_corpus_scan(spark, d).collect()}
    assert rows["O-1"].corpus_version == "v0.1" and rows["O-1"].scheme == "Personal Loan"
    assert rows["A-2"].scheme == "Vehicle Loan" and rows["A-1"].corpus_version == "v1.0"


def _preds(spark, n=2000, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    p = np.round(np.clip(rng.normal(0.35 + 0.3 * y, 0.2), 0, 1), 2)      # many ties
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y_true int, y_prob double"), y, p


def test_auc_and_ap_match_brute_force(spark):
    df, y, p = _preds(spark)
    pos, neg = p[y == 1], p[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    order = np.argsort(-p, kind="stable")
    ap, tp, seen = 0.0, 0, 0
    for s in np.unique(p)[::-1]:
        m = p == s
        tp += int(y[m].sum())
        seen += int(m.sum())
        ap += y[m].sum() / y.sum() * (tp / seen)
    r = EV.roc_auc(df, slices=7).first()
    assert r.roc_auc == pytest.approx(auc, abs=1e-12) and r.average_precision == pytest.approx(ap, abs=1e-12)
    assert order is not None


def test_threshold_sweep_matches_brute_force(spark):
    df, y, p = _preds(spark)
    ths = EV.sweep_grid_raw()
    got = {r.k: (r.tp, r.fp) for r in EV.threshold_sweep(df, ths).collect()}
    for k, t in enumerate(ths, start=1):
        pred = p >= t
        assert got[k] == (int((pred & (y == 1)).sum()), int((pred & (y == 0)).sum()))


def test_split_is_partition_invariant(spark):
    df = spark.range(5000).withColumnRenamed("id", "application_id").withColumn("label", (F.col("application_id") % 7 == 0).cast("int"))
    a = MD.stratified_split(df.repartition(3)).filter("is_test").select("application_id")
    b = MD.stratified_split(df.repartition(11)).filter("is_test").select("application_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    share = a.count() / 5000
    assert 0.17 < share < 0.23
