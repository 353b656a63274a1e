"""Failing keys wait, come again when due and end in quarantine; the others go on."""

from pyspark.sql import functions as F

from tillsight.streaming import retries

SHAPE = "struct<job_id:string,n:int>"


def step(fails):
    return lambda df: df.withColumn("double", F.col("n") * 2).withColumn("error", F.when(F.col("job_id").isin(*fails), "bad bytes"))


def rows(spark, *ids):
    return spark.createDataFrame([(i, len(i)) for i in ids], "job_id string, n int")


def at(seconds):
    return F.timestamp_seconds(F.lit(1_700_000_000 + seconds))


def held(spark, root, name):
    return sorted((r.job_id, r.run) for r in retries.table(spark, root, name).collect())


def test_failures_wait_and_end_in_quarantine_once(spark, tmp_path):
    root = f"file://{tmp_path}/r"
    run = lambda name, t, fails, *ids: retries.attempt(root, name, rows(spark, *ids) if ids else None, step(fails), "job_id", spark, at(t), most=3, schema=SHAPE)
    run("a0", 0, ["b", "c"], "a", "b", "c", "a")
    assert held(spark, root, "out") == [("a", "a0")] and {r.job_id for r in retries.waiting(spark, root, "job_id").collect()} == {"b", "c"}
    run("a1", 3, ["c"], "d", "b")  # nothing is due yet, and b is waiting, not new
    assert held(spark, root, "out") == [("a", "a0"), ("d", "a1")]
    run("a2", 6, ["c"])  # both are due: b is well now
    for _ in range(2):  # a run that is repeated changes nothing
        run("a3", 100, ["c"], "e")
    assert held(spark, root, "out") == [("a", "a0"), ("b", "a2"), ("d", "a1"), ("e", "a3")]
    (dead,) = retries.table(spark, root, "quarantine").collect()
    assert (dead.job_id, dead.attempt, dead.error, dead.body) == ("c", 3, "bad bytes", '{"job_id":"c","n":1}')
    run("a4", 9_999, ["c"])
    assert retries.waiting(spark, root, "job_id").count() == 0 and retries.table(spark, root, "quarantine").count() == 1
    assert {r.double for r in retries.table(spark, root, "out").collect()} == {2}


def test_a_stream_goes_on_past_failures(spark, tmp_path):
    for n, ids in enumerate((("a", "b"), ("c",))):
        rows(spark, *ids).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = spark.readStream.schema("job_id string, n int").parquet(f"{tmp_path}/in")
        q = s.writeStream.foreachBatch(lambda df, k: retries.attempt(f"{tmp_path}/r", f"b{k}", df, step(["b"]), "job_id", now=at(10 * k))).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        assert n < 2
    assert {r[0] for r in held(spark, f"{tmp_path}/r", "out")} == {"a", "c"}
    assert [(r.job_id, r.attempt) for r in retries.waiting(spark, f"{tmp_path}/r", "job_id").collect()] == [("b", 2)]
