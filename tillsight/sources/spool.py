"""K1: job folders written from rows, and the protocols that sources and repositories follow."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.sources import capture


class Source(Protocol):
    """What an import reads: the jobs that are committed, and each with its bytes and what is wrong with it."""

    def discover(self, spark: SparkSession, most: int, cursor: str | None) -> DataFrame: ...

    def load(self, spark: SparkSession, jobs: DataFrame) -> DataFrame: ...


class Repository(Protocol):
    """Where rows are kept: a named table, and an append that a second run doesn't repeat."""

    def table(self, spark: SparkSession, name: str) -> DataFrame: ...

    def append(self, rows: DataFrame, name: str, key: list[str]) -> DataFrame: ...


FILES = "job_id string, device_id string, role string, content binary"


def job_files(jobs: DataFrame) -> DataFrame:
    """The files of each job's folder, the ready marker last: ``(job_id, device_id, role, content)``.

    ``jobs(job_id, device_id, session_id, chunks)``, chunks an array of ``(sequence, direction, payload)``. Timelines
    are chained by hash, the manifest names every file's size and hash, the marker the manifest's.
    """

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for job, device, session, chunks in zip(part["job_id"], part["device_id"], part["session_id"], part["chunks"], strict=True):
                raw, lines, last = {"client_to_device": b"", "device_to_client": b""}, [], "0" * 64
                for k, c in enumerate(sorted((dict(c.asDict() if hasattr(c, "asDict") else c) for c in chunks), key=lambda c: c["sequence"])):
                    d, data = c["direction"], bytes(c["payload"])
                    e = {"sequence": k + 1, "direction": d, "kind": "data", "offset": len(raw[d]), "length": len(data), "payload_sha256": hashlib.sha256(data).hexdigest(), "previous_event_sha256": last}
                    last = hashlib.sha256(bytes.fromhex(last) + capture.canonical(e)).hexdigest()
                    lines.append(capture.canonical(e | {"event_sha256": last}))
                    raw[d] += data
                about = {"job_id": job, "device_id": device, "session_id": session}
                files = {"client.raw": raw["client_to_device"], "device.raw": raw["device_to_client"], "timeline.jsonl": b"\n".join(lines) + b"\n", "session.json": capture.canonical({"session": about})}
                manifest = capture.canonical({"status": "COMPLETE", "errors": [], "transport_complete": True, "session": about, "files": {n: {"size": len(b), "sha256": hashlib.sha256(b).hexdigest()} for n, b in files.items()}})
                files |= {"manifest.json": manifest, ".ready": capture.canonical({"manifest_sha256": hashlib.sha256(manifest).hexdigest()})}
                out += [(job, device, role, body) for role, body in files.items()]
            yield pd.DataFrame(out, columns=["job_id", "device_id", "role", "content"])

    return jobs.select("job_id", "device_id", "session_id", "chunks").mapInPandas(build, FILES)


def contiguous_chunks(events: DataFrame) -> DataFrame:
    """``jobs`` for ``job_files`` from rows ``(job_id, device_id, session_id, sequence, direction, payload)``."""
    return events.groupBy("job_id", "device_id", "session_id").agg(F.collect_list(F.struct("sequence", "direction", "payload")).alias("chunks"))
