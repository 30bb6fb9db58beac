"""Rule queries against DuckDB at the smallest scale."""

import pytest

from oracle_check import canonical, connect
from saidso.plans.rule_queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, name):
    df = QUERIES[name](spark, SF)
    cur = connect(SF).execute(ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), names)
