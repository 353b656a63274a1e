"""The same operators over streams: sessions, late data, deduplication and incremental episodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def published(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """A folder of published files as a stream; seen files are in the checkpoint, a trigger takes a bounded number."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def sessions(events: DataFrame, by: str, time: str = "ts", gap: str = "300 seconds", late: str = "7200 seconds") -> DataFrame:
    """Captures closed by a pause; data later than the watermark is no longer waited for."""
    s = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(by, F.session_window(time, gap)).agg(F.count("*").alias("n"))
    return s.select(by, F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "n")


def once(events: DataFrame, key: list[str], time: str = "ts", late: str = "7200 seconds") -> DataFrame:
    """The first of equal events within the watermark."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def paired(left: DataFrame, right: DataFrame, key: str, seconds: int, late: str = "7200 seconds") -> DataFrame:
    """``right`` follows ``left`` of the same key within ``seconds``; state is bounded by watermark and interval."""
    a = left.select(F.col(key).alias("k"), F.col("ts").cast("timestamp").alias("a_ts"), F.col("event_id").alias("a_id")).withWatermark("a_ts", late)
    b = right.select(F.col(key).alias("k2"), F.col("ts").cast("timestamp").alias("b_ts"), F.col("event_id").alias("b_id")).withWatermark("b_ts", late)
    near = F.expr(f"k = k2 AND b_ts >= a_ts AND b_ts <= a_ts + INTERVAL {int(seconds)} SECONDS")
    return a.join(b, near).select("k", "a_id", "b_id", "a_ts", "b_ts")


def incremental(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, key: list[str], checkpoint: str):
    """Each micro-batch is transformed and appended without keys that are there; reruns add nothing.

    The checkpoint holds the source's offsets; a new version of ``step`` starts from a new checkpoint, which
    replays the source.
    """
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = step(batch).dropDuplicates(key)
        try:
            known = spark.read.parquet(out).select(*key).distinct()
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            known = None
        (new if known is None else new.join(known, key, "left_anti")).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retried(action: Callable[[], None], attempts: int = 5, first: float = 0.05, most: float = 5.0, sleep: Callable[[float], None] | None = None) -> int:
    """Runs ``action`` with doubled pauses; the number of attempts used, or the last error."""
    import time

    for n in range(1, attempts + 1):
        try:
            action()
            return n
        except OSError:
            if n == attempts:
                raise
            (sleep or time.sleep)(min(most, first * 2 ** (n - 1)))
    raise AssertionError
