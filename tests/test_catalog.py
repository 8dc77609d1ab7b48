"""Every registered query of the engine's own operators against its SQL, on the smallest tables."""

import math
import os

import pytest

from chronoweave import catalog, catalog_media, catalog_models, catalog_plans, catalog_records

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or type(v).__name__ in ("NAType", "NaTType") or v != v:
            return "null"
        if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
            return str(v)
        return f"{float(v):.6f}" if math.isfinite(float(v)) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def test_all_are_registered():
    assert {f.__name__ for f in (catalog_records.prediction_audit, catalog_models.scenario_evaluation, catalog_media.frame_timing, catalog_plans.view_losses)} <= set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    if name in catalog.oracle_sql():
        want = duck.sql(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        left, right = rows(got), rows(want)
        assert len(left) == len(right)
        assert left == right
    else:
        assert len(got) > 0
