"""Every report against its SQL equivalent, and the flagship against known numbers."""

import pytest
from compare import differences, duck
from conftest import MEDIUM, values

import __spark_entry__ as entry_points

QUERIES = entry_points.queries()
ORACLE = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(MEDIUM)


def test_every_oracle_has_a_report():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_report_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, MEDIUM), con, ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_report_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, MEDIUM).count() > 0


def test_flagship(spark):
    assert values(QUERIES["risk_band_summary"](spark, MEDIUM)) == [
        ("Riesgo Alto", 60, 2219.79, 64.6, "$2,219.79"),
        ("Riesgo Medio", 125, 8703.34, 61.0, "$8,703.34"),
        ("Riesgo Bajo", 1315, 90874.51, 62.5, "$90,874.51"),
    ]
    assert [r[1] for r in entry_points.entry(spark).collect()] == [6, 12, 132]
