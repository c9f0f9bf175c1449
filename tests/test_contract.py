"""Contract queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from evidentia.plans import contract

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(f"{v:.9g}") if isinstance(v, float) else v

    names = sorted(frame.columns)
    return names, sorted((tuple(map(plain, r)) for r in frame[names].astype(object).where(frame[names].notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(contract.ORACLE_SQL))
def test_query_is_its_sql(spark, duck, sf, name):
    assert rows(contract.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(contract.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(contract.QUERIES) - set(contract.ORACLE_SQL)))
def test_query_runs(spark, sf, name):
    assert contract.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_extra_sql_of_other_queries(spark, duck, sf):
    for name in sorted(set(entry.oracle_sql()) - set(contract.ORACLE_SQL)):
        assert rows(entry.queries()[name](spark, sf).toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).df()), name
