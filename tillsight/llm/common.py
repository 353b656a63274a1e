"""Helpers shared by the corpus operators: table access, materialising, skew-safe joins, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.plans.shipping import ship

#: A word: a run of code points other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``, read by Spark so that any store works."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a session on a cluster without it gets an error, one that runs in a single process a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tillsight-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Lineage ends there: a lost executor costs a re-read, not a recomputation, and values that depend
    on partitioning (row numbers, sampled range bounds) can no longer change.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tillsight/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, as a lambda's parameter."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spaced(text: Column) -> Column:
    """``text`` with every white-space character as a blank, by plain replacement."""
    text = F.coalesce(text, F.lit(""))
    for c in "\t\n\v\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def words_of(text: Column) -> Column:
    return F.filter(F.split(spaced(text), " "), lambda w: w != "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores in front as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def row_key(*cols: Column) -> list[Column]:
    """128 bits that identify a row by its content; equal rows share them, and share every verdict."""
    return [F.xxhash64(*cols).alias("_k1"), F.xxhash64(F.lit("second"), *cols).alias("_k2")]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (bigint ids): rows ``(node, root)``, root the least node.

    Alternating large-star and small-star rounds. Every round is a pair of aggregations whose minima are
    taken map-side and joins that Spark may split where a node is hot; each is written to the shared
    folder. No node's neighbourhood is ever gathered in one place. Stops when a round changes nothing.
    """
    cur = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("b"), F.col("a")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        # Large star: each neighbour above the node is hung on the least member of its neighbourhood.
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        # Small star: lower neighbours, and the node itself, are hung on the least lower neighbour.
        small = large.join(low, F.col("a") == F.col("n")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        cur = materialise(small.where("a <> b").distinct(), label)
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == (now.n, now.h):
            break
        before = (now.n, now.h)
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
