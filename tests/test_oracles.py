"""Every query against its SQL in DuckDB, by value."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from hexfeat.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as from '{p}'")
    return c


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, bool):
        return int(x)
    return round(float(x), 5) + 0.0 if isinstance(x, float) or type(x).__name__ == "Decimal" else x


def rows(records, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(value(r[i]) for i in order) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in catalog.ORACLES:
        found = con.execute(catalog.ORACLES[name])
        names = [d[0] for d in found.description]
        assert got == rows(found.fetchall(), names)
    else:
        assert got[1]


def test_no_python_worker_in_batch_queries(spark):
    for name in ("aggregate_fire", "nearest_fire", "fuse_features", "priority_override", "emergency_fsm", "kl_divergence"):
        plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "EvalPython" not in plan and "CartesianProduct" not in plan


WHOLE = ("asof_cycle", "backfill_pending", "gate4_industrial", "nws_parse", "openmeteo_explode", "priority_override", "trigger_priority")


def test_whole_tables_are_taken(spark):
    """No query takes a subset of ids; both names of a query give the same rows."""
    assert all(catalog.QUERIES[f"{n}_all"] is catalog.QUERIES[n] for n in WHOLE)
    assert not [n for n, sql in catalog.ORACLES.items() if re.search(r"where[^()]*(event_id|seq|suppkey) ?% ?\d+ ?= ?\d", sql)]
    n = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert catalog.QUERIES["openmeteo_explode"](spark, DATA).count() == 3 * n
    assert catalog.QUERIES["nws_parse"](spark, DATA).count() == 2 * n
