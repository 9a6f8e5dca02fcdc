"""Every query with SQL gives the same rows as DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from corpusloom.plans import oracles, planted, planted_oracles, queries, rule_oracles, rules

from .conftest import SF

QUERIES, ORACLE_SQL = queries.QUERIES | rules.QUERIES | planted.QUERIES, oracles.ORACLE_SQL | rule_oracles.ORACLE_SQL | planted_oracles.ORACLE_SQL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 8) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(repr(tuple(plain(v[i]) for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    ours = rows(df.columns, df.collect())
    if name not in ORACLE_SQL:
        assert ours[1]
        return
    result = con.execute(ORACLE_SQL[name])
    theirs = rows([d[0] for d in result.description], result.fetchall())
    assert ours == theirs
