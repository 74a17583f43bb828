"""Every registered query against its SQL on the smallest data set."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tesserine.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "-"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.8g}"
    return str(value)


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in table)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, duck, name):
    mine = QUERIES[name](spark, data)
    theirs = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(mine.columns) == sorted(columns)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(columns, theirs.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_of_the_engine_is_registered():
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE_SQL) == set(QUERIES)
