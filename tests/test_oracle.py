"""Every registered query against its DuckDB twin (rows-only where no twin exists)."""

import pytest

import __spark_entry__ as E
from sitelens.plans.queries import QUERIES
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare

NAMES = sorted(QUERIES)


def test_every_query_is_covered():
    missing = [n for n in NAMES if n not in E.oracle_sql()]
    assert set(missing) <= {"a2_prompt", "s9_report_json"}, missing


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    r = compare(spark, duck, name, E.queries()[name], E.oracle_sql().get(name), SF_SMALL)
    assert r.get("ok") is not False, r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"overall", "seo", "security"} <= set(df.columns)
