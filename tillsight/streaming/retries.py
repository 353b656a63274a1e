"""Failing rows are tried again when due and end in quarantine; they hold up nothing.

A folder holds what each run wrote: ``out`` (results), ``log`` (key, attempt, due time, state, the row itself as JSON) and
``quarantine`` (one row a key that failed too often). A run takes new rows and the rows whose time has come, by one pass of the
log; its three writes replace what the same run wrote before, so a run that is repeated changes nothing.

    stream.writeStream.foreachBatch(lambda rows, n: attempt(root, f"{n:08d}", rows, step, "job_id")).start()
    attempt(root, "20240101T0300", None, step, "job_id", spark)      # due rows alone, between batches
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillsight.functions import values
from tillsight.plans.tables import written


def table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """All rows of ``out``, ``log`` or ``quarantine`` with the run that wrote them; None before the first."""
    try:
        return spark.read.parquet(f"{root}/{name}").withColumn("run", F.col("run").cast("string"))
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def waiting(spark: SparkSession, root: str, key: str, run: str | None = None) -> DataFrame | None:
    """The last entry of each key that is to be tried again, as of before ``run`` where one is named."""
    log = table(spark, root, "log")
    if log is None:
        return None
    log = log if run is None else log.where(F.col("run") != run)
    w = Window.partitionBy(key).orderBy(F.desc("attempt"), F.desc("run"))
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1 AND state = 'WAITING'").drop("_n", "run")


def attempt(root: str, run: str, rows: DataFrame | None, step: Callable[[DataFrame], DataFrame], key: str, spark: SparkSession | None = None, now: Column | None = None, most: int = 5, schema: str | None = None) -> None:
    """Tries new ``rows`` and those that are due. ``step`` returns their columns and results with ``error``, null where all went well.

    After a failure a row waits five seconds, each time twice as long (``values.backoff_seconds``); after ``most`` it is quarantined.
    """
    spark = rows.sparkSession if rows is not None else spark
    now = F.current_timestamp() if now is None else now
    held = waiting(spark, root, key, run)
    due = None if held is None else held.where(F.col("due_at") <= now)
    if rows is not None:
        schema, fresh = rows.schema.simpleString(), rows.dropDuplicates([key]).withColumn("_attempt", F.lit(0))
    if due is not None:
        again = due.select(F.from_json("body", schema).alias("b"), F.col("attempt").alias("_attempt")).select("b.*", "_attempt")
        todo = again if rows is None else fresh.join(held.select(key), key, "left_anti").select(*again.columns).unionByName(again)
    elif rows is None:
        return
    else:
        todo = fresh
    columns = [c for c in todo.columns if c != "_attempt"]
    todo = written(todo.withColumn("_body", F.to_json(F.struct(*columns))), "attempts")
    done = written(step(todo), "attempted")
    failed = done.where("error IS NOT NULL").withColumn("attempt", F.col("_attempt") + 1)
    dead = F.col("attempt") >= most
    wait = F.make_dt_interval(secs=values.backoff_seconds(F.col("attempt")))
    entry = failed.select(key, "attempt", F.when(~dead, now + wait).alias("due_at"), F.when(dead, "DEAD").otherwise("WAITING").alias("state"), F.col("_body").alias("body"), "error")
    good = done.where("error IS NULL")
    solved = good.where("_attempt > 0").select(key, (F.col("_attempt") + 1).alias("attempt"), F.lit(None).cast("timestamp").alias("due_at"), F.lit("DONE").alias("state"), F.col("_body").alias("body"), F.lit(None).cast("string").alias("error"))
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{root}/{name}/run={run}")
    put(good.drop("_attempt", "_body", "error"), "out")
    put(entry.where("state = 'DEAD'").select(key, "attempt", "body", "error"), "quarantine")
    put(entry.unionByName(solved), "log")
