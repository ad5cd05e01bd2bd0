"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tarnwork.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v) if v % 1 else int(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, data, duck, name):
    got = catalog.queries()[name](spark, data)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())
    cursor = duck.execute(catalog.oracle_sql()[name])
    at = [x[0] for x in cursor.description]
    assert sorted(at) == columns
    assert rows == sorted(repr(tuple(plain(r[at.index(c)]) for c in columns)) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_queries_without_an_oracle_give_rows(spark, data, name):
    assert catalog.queries()[name](spark, data).count() > 0


def test_entry_has_every_catalog_query():
    assert set(catalog.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_llm_import_outside():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "tarnwork")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "tarnwork.llm" not in open(os.path.join(folder, f)).read(), f
