"""Every query with SQL gives DuckDB's answer."""

import pytest

from ledgersight.catalog import ORACLE, QUERIES
from tests.conftest import BASE
from tests.oracle import connect, difference


@pytest.fixture(scope="module")
def duck():
    return connect(BASE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, BASE), duck, ORACLE[name]) is None


@pytest.mark.parametrize("name", ["smp_1_native_hash", "fn_26_native_hash", "job_class_report",
                                  "job_disagreement_report"])
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, BASE).count() > 0


def test_inventory_is_covered():
    """Every inventory id has a query (ORD-1 is part of every window)."""
    want = {"src": 11, "snk": 4, "prj": 17, "flt": 8, "jn": 13, "agg": 15, "win": 33, "ord": 6,
            "set": 5, "fn": 26, "smp": 5, "ml": 18}
    inside = {("ord", 1), ("win", 25), ("fn", 18), ("fn", 19), ("fn", 20)}
    have = {tuple(n.split("_")[:2]) for n in QUERIES}
    for kind, last in want.items():
        for i in range(1, last + 1):
            assert (kind, str(i)) in have or (kind, i) in inside, f"{kind}_{i}"
