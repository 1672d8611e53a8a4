"""Every registered query against its DuckDB oracle (sf0.001)."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.conftest import SF_SMALL
from tests.oracle_check import compare

SQL = oracle_sql()
NAMES = sorted(n for n in queries() if n in SQL)


def test_every_query_is_named_and_callable():
    qs = queries()
    assert len(qs) >= 70
    assert set(SQL) <= set(qs)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    problems, n, _, _ = compare(spark, con, name, queries()[name], SQL[name], SF_SMALL)
    assert not problems, problems


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 4
    assert df.columns == ["run_id", "model_name", "actual_class", "predicted_class", "count"]


@pytest.mark.parametrize("name", sorted(n for n in queries() if n not in SQL))
def test_rows_only_queries_run(spark, name):
    assert queries()[name](spark, SF_SMALL).count() >= 0
