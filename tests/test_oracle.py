"""Every registered query against its SQL counterpart, and the plans of all of them."""

from __future__ import annotations

import pytest

import __spark_entry__
from cargolens.plans.oracle import ORACLE_SQL
from cargolens.plans.queries import QUERIES
from compare import differences, digest, duck

ROWS_ONLY = sorted(set(QUERIES) - set(ORACLE_SQL))


@pytest.fixture(scope="module")
def connection(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, sf, connection, name):
    frame = QUERIES[name](spark, sf)
    assert differences(frame, connection, ORACLE_SQL[name]) is None
    if name not in ("rule_metrics",):
        types = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN"}
        sql_types = {c[0]: str(c[1]) for c in connection.execute(ORACLE_SQL[name]).description}
        assert {c: types[t] for c, t in frame.dtypes} == sql_types


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_repeat(spark, sf, name):
    first = digest(QUERIES[name](spark, sf))
    assert first == digest(QUERIES[name](spark, sf))


def test_comparison_sees_a_difference(spark, sf, connection):
    frame = QUERIES["risk_score"](spark, sf)
    changed = ORACLE_SQL["risk_score"].replace("supplier_id, risk_score", "supplier_id, "
                                               "risk_score + 0.1 AS risk_score", 1)
    assert changed != ORACLE_SQL["risk_score"]
    assert differences(frame, connection, changed) is not None


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_pairing_joins(spark, sf, name, capsys):
    QUERIES[name](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan
