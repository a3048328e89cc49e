"""The approximate vector search: recall, folders read, odd vectors."""

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from credsight.operators import retrieval as RT
from credsight.operators import vector_index as VX

from .conftest import SF_SMALL


def test_recall_on_the_given_table(spark):
    rows = E.queries()["R4_vector_topk_approx"](spark, SF_SMALL).collect()
    assert rows and rows[0].recall >= 0.9 and len({r.recall for r in rows}) == 1
    assert all(r.score == 1.0 and r.item_id == r.query_id for r in rows if r["rank"] == 1)      # a vector is nearest to itself


def test_only_probed_folders_and_payload(spark):
    rng = np.random.default_rng(2)
    data = [(i, int(i % 3), rng.normal(size=16).tolist()) for i in range(600)]
    data += [(1000, 0, None), (1001, 0, [0.0] * 16), (1002, None, [1.0] * 16)]
    items = spark.createDataFrame(data, "item_id bigint, label int, embedding array<double>")
    index = VX.VectorIndex(spark)
    index.build(items)
    asked = spark.createDataFrame([(1, 0, data[0][2]), (2, 0, None), (3, 9, data[0][2]), (4, 0, [0.0] * 16)],
                                  "query_id bigint, label int, embedding array<double>")
    got = sorted(map(tuple, index.search(asked).collect()), key=repr)
    assert got[0][:4] == (1, 1, 0, 1.0) and {g[0] for g in got if g[4]} == {2, 3, 4}
    exact = {(r.query_id, r.item_id): r.score for r in RT.vector_topk(asked, items).collect()}
    assert all(exact.get((g[0], g[2]), g[3]) == g[3] for g in got if not g[4])
    probed = index.probes(asked.where("query_id = 1"), "query_id", "embedding", "label").where("tab = 0")
    few = index.candidates(probed)
    plan = few._jdf.queryExecution().toString()
    assert "PartitionFilters: [part#" in plan
    assert 0 < few.count() < 200 and few.join(items, "item_id").where(F.col("label") != 0).count() == 0
