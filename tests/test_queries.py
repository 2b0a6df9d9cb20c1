"""Every query of the engine against its SQL on the smallest tables."""

import pytest

from krysalis.plans import fixtures
from krysalis.plans.queries import ORACLES, QUERIES
from tests.conftest import canonical


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    expected = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})")
    assert sorted(duck.sql(ORACLES[name]).columns) == columns
    assert canonical(rows) == canonical(expected.fetchall())


def test_flow_matrices_are_joined_once(spark, sf_dir, monkeypatch):
    """What reads the matrices reads a table of entries: no line item is scanned again, however often they are used."""
    scanned = []
    monkeypatch.setattr(fixtures, "table", lambda s, d, name, table=fixtures.table: scanned.append(name) or table(s, d, name))
    a = fixtures.flow(spark, sf_dir)
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert not any("lineitem" in f for f in a.inputFiles())
    assert scanned.count("lineitem") == 1


def test_queries_without_sql_are_tested_against_numpy():
    from tests import test_dense

    assert set(QUERIES) - set(ORACLES) == set(test_dense.COVERED)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
