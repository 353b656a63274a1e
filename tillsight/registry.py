"""Named queries with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.plans.shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Results as other engines print them: decimals as doubles, times as seconds since 1970, lists as text."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind.startswith("timestamp"):
            c = F.unix_timestamp(c.cast("timestamp"))
        elif kind == "date":
            c = c.cast("string")
        elif kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ",")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir), and the SQL for the same rows."""
    def add(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return plain(f(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add
