"""Every registered query runs, and equals its SQL on the smallest tables."""

import datetime
import decimal
import os

import pytest

import __spark_entry__ as entry
from tillsight.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(found, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        return
    c = duck.execute(ORACLES[name])
    want = c.fetchall()
    order = sorted(df.columns)
    assert order == sorted(d[0] for d in c.description)
    assert rows(got, df.columns, order) == rows(want, [d[0] for d in c.description], order)


def test_entry(spark):
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_without_the_corpus_subpackage():
    """Nothing outside ``llm`` and the guarded entry names it."""
    import pathlib

    for p in pathlib.Path(entry.__file__).parent.joinpath("tillsight").rglob("*.py"):
        if "llm" not in p.parts:
            assert "tillsight.llm" not in p.read_text(), p
