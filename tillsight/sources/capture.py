"""Captured print jobs: committed job folders, their timelines, ledgers and strict JSON.

A job folder is visible once its ``.ready`` file is there. Files are read by Spark's binary source, so any
store works and a job's bytes go to the task that checks them. The driver lists names, as for any table, and
reads the markers alone (``ready``): Spark's readers skip names that start with a dot.
"""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE = 128 * 1024 * 1024
ROLES = ("client.raw", "device.raw", "timeline.jsonl", "session.json", "manifest.json", ".ready")

JOBS = "job_path string, job_id string, device_id string, session_id string, status string, captured_bytes bigint, client_raw binary, device_raw binary, manifest_sha256 string, failures array<string>"
EVENTS = "job_path string, sequence bigint, direction string, kind string, offset bigint, length bigint, payload_sha256 string, previous_event_sha256 string, event_sha256 string"


def strict_json(data: bytes):
    """UTF-8 JSON without repeated keys or non-finite numbers."""
    def once(pairs):
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key is there twice")
        return dict(pairs)

    def number(x):
        raise ValueError(f"{x} is no JSON number")

    return json.loads(data.decode("utf-8"), object_pairs_hook=once, parse_constant=number)


def canonical(record: dict) -> bytes:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def files(spark: SparkSession, root: str, most: int = MAX_FILE) -> DataFrame:
    """The files of all job folders below ``root/<device>/<job>``, too large ones without content."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split("path", "/")
    return df.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("job_path"), F.element_at(parts, -2).alias("folder"), F.element_at(parts, -3).alias("device_folder"), F.element_at(parts, -1).alias("role"), "length", F.when(F.col("length") <= most, F.col("content")).alias("content"))


def ready(spark: SparkSession, root: str, pattern: str = "/*/*/.ready") -> DataFrame:
    """``(job_path, ready)``: committed job folders and their markers' text.

    Spark's readers skip names that start with a dot, so the markers, a few bytes each, come from the store's
    own listing, as a file index does.
    """
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + pattern)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    for status in fs.globStatus(fs_path) or []:
        stream = fs.open(status.getPath())
        try:
            body = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        rows.append((status.getPath().getParent().toString(), body))
    return spark.createDataFrame(rows, "job_path string, ready string")


def timeline(data: bytes, raw: dict[str, bytes]) -> tuple[list[dict], list[str]]:
    """Events in order, and what is wrong: gaps in sequence or offset, broken chain, other payload."""
    events, wrong, last, at = [], [], "0" * 64, {}
    for i, line in enumerate(x for x in data.split(b"\n") if x.strip()):
        try:
            e = strict_json(line)
        except ValueError:
            wrong.append(f"timeline_json:{i}")
            break
        body = {k: v for k, v in e.items() if k != "event_sha256"}
        if e.get("sequence") != i + 1:
            wrong.append(f"sequence:{i}")
        if e.get("previous_event_sha256", "0" * 64) != last or hashlib.sha256(bytes.fromhex(last) + canonical(body)).hexdigest() != e.get("event_sha256"):
            wrong.append(f"chain:{i}")
        last = e.get("event_sha256") or last
        if e.get("kind") == "data":
            d = e.get("direction")
            if e.get("offset") != at.get(d, 0):
                wrong.append(f"offset:{i}")
            part = raw.get(d, b"")[at.get(d, 0) : at.get(d, 0) + e.get("length", 0)]
            if len(part) != e.get("length") or hashlib.sha256(part).hexdigest() != e.get("payload_sha256"):
                wrong.append(f"payload:{i}")
            at[d] = at.get(d, 0) + e.get("length", 0)
        events.append(e)
    for d, data_ in raw.items():
        if at.get(d, 0) != len(data_):
            wrong.append(f"trailing:{d}")
    return events, wrong


def checked(path: str, device: str, have: dict[str, bytes | None], marker: str, wrong: list[str] | None = None) -> tuple:
    """A job's row from its files and its marker: what contradicts its manifest is named, nothing is mended."""
    wrong, manifest, session = list(wrong or ()), {}, {}
    try:
        manifest, session = strict_json(have.get("manifest.json") or b""), strict_json(have.get("session.json") or b"")
        if strict_json(marker.encode()).get("manifest_sha256") != hashlib.sha256(have["manifest.json"]).hexdigest():
            wrong.append("ready_manifest")
    except ValueError:
        wrong.append("json")
    for name, meta in (manifest.get("files") or {}).items():
        body = have.get(name, b"" if meta.get("size") == 0 else None)  # Spark's readers pass over empty files
        if body is None or len(body) != meta.get("size") or hashlib.sha256(body).hexdigest() != meta.get("sha256"):
            wrong.append(f"file:{name}")
    about = session.get("session") or {}
    if manifest.get("session") not in (None, about):
        wrong.append("session")
    if about.get("device_id") != device:
        wrong.append("device")
    raw = {"client_to_device": have.get("client.raw") or b"", "device_to_client": have.get("device.raw") or b""}
    wrong += timeline(have.get("timeline.jsonl") or b"", raw)[1]
    status = manifest.get("status")
    if status == "COMPLETE" and (manifest.get("errors") or not manifest.get("transport_complete", True)):
        wrong.append("status")
    return (path, about.get("job_id"), about.get("device_id"), about.get("session_id"), status, sum(map(len, raw.values())), raw["client_to_device"], raw["device_to_client"], hashlib.sha256(have.get("manifest.json") or b"").hexdigest(), wrong)


def jobs(spark: SparkSession, root: str) -> DataFrame:
    """One checked row a committed job; ``failures`` names what contradicts its manifest."""
    found = files(spark, root)
    found = found.withColumn("job_path", F.regexp_replace("job_path", "^file:/+", "file:/"))
    grouped = found.groupBy("job_path", "device_folder").agg(F.map_from_entries(F.collect_list(F.struct("role", "content"))).alias("files"))
    grouped = grouped.join(ready(spark, root).withColumn("job_path", F.regexp_replace("job_path", "^file:/+", "file:/")), "job_path")

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [checked(path, device, dict(data), marker) for path, device, data, marker in zip(part["job_path"], part["device_folder"], part["files"], part["ready"], strict=True)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in JOBS.split(", ")])

    return grouped.mapInPandas(check, JOBS)


def fair_batch(markers: DataFrame, most: int, cursor: str | None, column: str = "job_path") -> DataFrame:
    """S3: the next ``most`` jobs after the cursor in path order, going round at the end."""
    turn = F.when(F.lit(cursor).isNull() | (F.col(column) > cursor), 0).otherwise(1)
    return markers.orderBy(turn, column).limit(most)


def ledger(lines: DataFrame, by: str = "route", text: str = "line", key: bytes | None = None) -> DataFrame:
    """Ledger records in order with ``chain_ok``: SHA-256 over the length-prefixed record and the last hash, and HMAC if keyed.

    A route's records are one chain, checked in order as rows stream by; only the last hash is held.
    """
    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        route, last = None, "0" * 64
        for part in parts:
            rows = []
            for r, line in zip(part[by], part[text], strict=True):
                if r != route:
                    route, last = r, "0" * 64
                try:
                    e = strict_json(line.encode())
                    body = canonical({k: v for k, v in e.items() if k not in ("chain_hash", "hmac_sha256")})
                    own = hashlib.sha256(bytes.fromhex(last) + len(body).to_bytes(8, "big") + body).hexdigest()
                    ok = e.get("previous_chain_hash") == last and e.get("chain_hash") == own
                    if key is not None:
                        ok = ok and hmac.compare_digest(hmac.new(key, body, hashlib.sha256).hexdigest(), str(e.get("hmac_sha256")))
                    rows.append((r, int(e.get("sequence", -1)), e.get("event"), e.get("job_id"), bool(ok)))
                    last = e.get("chain_hash") or own
                except ValueError:
                    rows.append((r, -1, None, None, False))
            yield pd.DataFrame(rows, columns=["route", "sequence", "event", "job_id", "chain_ok"])

    ordered = lines.repartition(by).sortWithinPartitions(by, "position")
    return ordered.mapInPandas(check, "route string, sequence bigint, event string, job_id string, chain_ok boolean")
