"""Neighbouring orders of one day, the second of which bears the first one's fiscal code: each copy stays with its own order."""

import pytest

import __spark_entry__ as entry
from tests.test_registry import SF, TABLES, rows

#: The findings that differed from their SQL.
TIED = (
    "a12_last_snapshot", "a17_operator_stats", "a18_edge_scores", "u2_timeline", "u5_dedup_union", "w2_latest_occurrence", "d14_reused_codes", "d14_transactions", "d15_fingerprints",
    "d18_order_events", "d19_chain", "d21_evidence", "d25_reclassified", "d30_alert_view",
)


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """The smallest tables; every fiftieth order and the one before it are closed on one day, some by one customer."""
    import duckdb

    path = tmp_path_factory.mktemp("tied")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        sql = f"SELECT * FROM '{SF}/{t}.parquet'"
        if t == "orders":
            after = f"(SELECT o_orderkey - 1 AS k, o_orderdate AS d, o_custkey AS c FROM '{SF}/orders.parquet' WHERE o_orderkey % 50 = 0)"
            sql = f"SELECT * EXCLUDE (k, d, c) REPLACE (CASE WHEN o_orderkey % 50 IN (0, 49) THEN 'F' ELSE o_orderstatus END AS o_orderstatus, coalesce(d, o_orderdate) AS o_orderdate, CASE WHEN o_orderkey % 150 = 49 THEN coalesce(c, o_custkey) ELSE o_custkey END AS o_custkey) FROM ({sql}) LEFT JOIN {after} ON o_orderkey = k"
        con.execute(f"COPY ({sql}) TO '{path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return str(path), con


@pytest.mark.parametrize("name", TIED)
def test_copies_of_one_code(spark, tied, name):
    path, con = tied
    df = entry.queries()[name](spark, path)
    c = con.execute(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns, order) == rows(c.fetchall(), [d[0] for d in c.description], order)
