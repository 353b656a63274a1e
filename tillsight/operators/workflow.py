"""Append-only logs: effective state, transitions, batches, keyset cursors and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.functions import values


def effective(log: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last entry of each key; earlier ones stay in the log."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def illegal_transitions(log: DataFrame, legal: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """The log with ``illegal``: the step from the state before isn't among ``legal(before, state)``."""
    w = Window.partitionBy(by).orderBy(*order)
    steps = log.withColumn("before", F.lag(state).over(w))
    known = legal.withColumn("_ok", F.lit(True))
    return steps.join(known, ["before", state], "left").withColumn("illegal", F.col("before").isNotNull() & F.col("_ok").isNull()).drop("_ok")


def batches(items: DataFrame, by: str, duplicate: Column) -> DataFrame:
    """Counts of imported and repeated items of each batch; batches of repeats alone are left out."""
    d = F.coalesce(duplicate, F.lit(False))
    return items.groupBy(by).agg(F.count_if(~d).alias("imported"), F.count_if(d).alias("duplicates")).where("imported > 0")


def after_cursor(df: DataFrame, time: str, key: str, at: str | None, last: str | None, lookback_seconds: int, done: DataFrame | None = None) -> DataFrame:
    """Rows within the lookback that are newer than the cursor, or not yet in ``done``."""
    if at is None:
        return df
    cursor = F.lit(at).cast("timestamp")
    recent = df.where(F.col(time) >= cursor - F.make_dt_interval(secs=F.lit(lookback_seconds)))
    newer = recent.where((F.col(time) > cursor) | ((F.col(time) == cursor) & (F.col(key) > last)))
    if done is None:
        return newer
    late = recent.where((F.col(time) < cursor) | ((F.col(time) == cursor) & (F.col(key) <= last))).join(done.select(key).distinct(), key, "left_anti")
    return newer.unionByName(late)


def neighbourhood(documents: DataFrame, seeds: DataFrame, keys: list[str], time: str, window_seconds: int) -> DataFrame:
    """Documents that share a key with a seed within the window; seeds included."""
    out = seeds.select("document_id")
    for k in keys:
        s = seeds.where(F.col(k).isNotNull()).select(k, F.floor(F.unix_timestamp(time) / window_seconds).alias("_b"), F.unix_timestamp(time).alias("_s"))
        s = s.select(k, "_s", F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("_b"))
        d = documents.where(F.col(k).isNotNull()).withColumn("_b", F.floor(F.unix_timestamp(time) / window_seconds))
        near = d.alias("d").join(s.alias("s"), (F.col(f"d.{k}") == F.col(f"s.{k}")) & (F.col("d._b") == F.col("s._b")) & (F.abs(F.unix_timestamp(F.col(f"d.{time}")) - F.col("s._s")) <= window_seconds), "left_semi")
        out = out.unionByName(near.select("document_id"))
    return documents.join(out.distinct(), "document_id", "left_semi")


def pending(jobs: DataFrame, raw: DataFrame, done: DataFrame, failures: DataFrame, build: str, now: Column, states: tuple[str, ...], asked: DataFrame | None = None) -> DataFrame:
    """``jobs(job_id, status)`` to parse now, with ``attempts`` and ``last_failure``.

    A job has one of ``states``, has bytes (``raw``), and this ``build`` hasn't done it (``done(job_id, build)``). After a failure
    (``failures(job_id, failed_at)``) it waits, each time twice as long; jobs that are ``asked`` for by name don't wait.
    """
    open_ = jobs.where(F.col("status").isin(*states)).join(raw.select("job_id"), "job_id", "left_semi").join(done.where(F.col("build") == build).select("job_id"), "job_id", "left_anti")
    tried = failures.groupBy("job_id").agg(F.count("*").alias("attempts"), F.max("failed_at").alias("last_failure"))
    named = jobs.select("job_id").limit(0).withColumn("_asked", F.lit(True)) if asked is None else asked.select("job_id").distinct().withColumn("_asked", F.lit(True))
    x = open_.join(tried, "job_id", "left").join(named, "job_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)))
    rested = F.unix_seconds(now) - F.unix_seconds("last_failure") >= values.backoff_seconds(F.col("attempts"))
    return x.where(F.coalesce("_asked", F.lit(False)) | (F.col("attempts") == 0) | rested).drop("_asked")
