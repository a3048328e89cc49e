"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from check_oracles import rows_of
from credsight.plans import ORACLES, QUERIES
from credsight.plans.views import BASE_TABLES

from .conftest import SF_SMALL

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    from collections import Counter

    sdf = E.queries()[name](spark, SF_SMALL)
    srows = rows_of(sdf.columns, [tuple(r) for r in sdf.collect()])
    rel = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert Counter(srows) == Counter(rows_of(dcols, rel.fetchall()))


def test_entry_smoke(spark):
    assert E.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_oracle_has_rows(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_scratch_tables_can_be_dropped(spark):
    import os

    from credsight.session import drop_scratch, materialize

    path = materialize(spark.range(3), "probe").inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path) and drop_scratch(spark) >= 1 and not os.path.isdir(path)
