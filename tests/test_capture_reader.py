"""The capture data source against the folder reader, as a batch and as a stream."""

import os

from tests.test_sources_and_streams import job
from tillsight.sources import capture, reader


def rows(df):
    return sorted((r.job_id, r.device_id, r.status, r.captured_bytes, bytes(r.client_raw), bytes(r.device_raw), r.manifest_sha256, tuple(r.failures)) for r in df.collect())


def test_batch_and_stream_read_what_the_folder_reader_reads(spark, tmp_path):
    root = tmp_path / "spool"
    job(root, "j1")
    job(root, "j2", lambda raw, ev: raw.update({"client.raw": b"ordina"}))
    job(root, "j3", device="rch_1")
    job(root, "hidden", ready=False)
    want = rows(capture.jobs(spark, str(root)))
    assert len(want) == 3
    reader.register(spark)
    read = lambda **o: spark.read.format("captures").options(path=str(root), **o).load()
    assert rows(read()) == want and rows(read(slices=1)) == want and rows(spark.read.format("captures").option("path", f"file://{root}").load()) == want

    def taken():
        s = spark.readStream.format("captures").options(path=str(root), settle=0).load()
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/out"))

    assert taken() == want
    job(root, "j4", device="rch_1")
    (root / "pos_1" / "hidden" / ".ready").write_text("{}")
    now = taken()
    assert now == rows(read()) and len(now) == 5 and set(want) < set(now)
    assert taken() == now


def test_odd_files_are_named_and_not_read(spark, tmp_path):
    root = tmp_path / "spool"
    job(root, "j1")
    job(root, "j2")
    os.replace(root / "pos_1" / "j1" / "client.raw", tmp_path / "elsewhere")
    os.symlink(tmp_path / "elsewhere", root / "pos_1" / "j1" / "client.raw")
    os.replace(root / "pos_1" / "j2" / ".ready", tmp_path / "ready")
    os.symlink(tmp_path / "ready", root / "pos_1" / "j2" / ".ready")
    reader.register(spark)
    (r,) = spark.read.format("captures").options(path=str(root)).load().collect()
    assert {"link:client.raw", "file:client.raw"} <= set(r.failures) and bytes(r.client_raw) == b""
    (r,) = spark.read.format("captures").options(path=str(root), maxfile=3).load().collect()
    assert "large:timeline.jsonl" in r.failures
    assert spark.read.format("captures").options(path=f"{tmp_path}/none").load().collect() == []
