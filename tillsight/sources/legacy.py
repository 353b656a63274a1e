"""Older capture layouts: a folder a job with its own manifest (S5), documents parsed by an earlier program (S6), and the choice of sources.

The schema name that a layout states is a parameter. Files come from Spark's binary source; a job's files meet in one
row and are checked there, and a job that contradicts its manifest is a row with what is wrong, not an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.sources import capture

JOBS = "job_path string, code string, job_id string, session_id string, status string, complete boolean, target string, client_raw binary, device_raw binary, manifest_sha256 string, failures array<string>"
EVENTS = {"CLIENT": "client_to_device", "DEVICE": "device_to_client"}
PARSED = "job_path string, document_id string, ordinal int, type string, subtype string, complete boolean, evidence string, start_offset bigint, end_offset bigint, frame_ids array<int>, semantic string, issues array<string>, failures array<string>"
#: Letters and names of the two kinds of parsed documents.
KINDS = {("C", "commerciale"): "COMMERCIAL_DOCUMENT", ("G", "gestionale"): "MANAGEMENT_DOCUMENT"}
STATES = ("ready", "ready_capture_incomplete")


def _folders(spark: SparkSession, root: str, marker: str) -> DataFrame:
    """A row a job folder below ``root``: its files by their path within it, and the marker's text where there is one."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    tail = F.element_at(F.split("path", F.lit(root.rstrip("/").split("/")[-1] + "/"), 2), 2)
    parts = F.split(tail, "/")
    role = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    path = F.regexp_replace(F.substring("path", F.lit(1), F.length("path") - F.length(role) - 1), "^file:/+", "file:/")
    named = df.select(path.alias("job_path"), parts[0].alias("code"), role.alias("role"), "content").where("role <> ''")
    grouped = named.groupBy("job_path", "code").agg(F.map_from_entries(F.collect_list(F.struct("role", "content"))).alias("files"))
    ready = capture.ready(spark, root, f"/*/{marker}").withColumn("job_path", F.regexp_replace("job_path", "^file:/+", "file:/"))
    return grouped.join(ready, "job_path")


def _digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _timeline(data: bytes, raw: dict[str, bytes], whole: bool) -> list[str]:
    wrong, last, at = [], 0, {}
    for i, line in enumerate(data.splitlines()):
        try:
            e = capture.strict_json(line)
            d = EVENTS.get("CLIENT" if str(e["direction"]).startswith("CLIENT") else "DEVICE")
            sequence, start, length = int(e["sequence"]), int(e["job_offset"]), int(e["byte_count"])
        except (ValueError, KeyError, TypeError):
            return [*wrong, f"timeline_json:{i}"]
        if sequence <= last or (whole and sequence != last + 1):
            wrong.append(f"sequence:{i}")
        if start + length > len(raw[d]) or (whole and start != at.get(d, 0)):
            wrong.append(f"offset:{i}")
        last, at[d] = sequence, start + length
    return wrong


def _checked(code: str, files: dict, marker: str, schema: str) -> tuple[dict, list[str]]:
    """A job's manifest, and what contradicts it."""
    wrong, manifest = [], {}
    body = files.get("manifest.json") or b""
    try:
        ready, manifest = capture.strict_json(marker.encode()), capture.strict_json(body)
    except ValueError:
        return {}, ["json"]
    for name, about in (("ready", ready), ("manifest", manifest)):
        if about.get("schema") != schema:
            wrong.append(f"{name}_schema")
        if about.get("codice_doc") != code:
            wrong.append(f"{name}_code")
    if ready.get("manifest_sha256") != _digest(body):
        wrong.append("ready_manifest")
    if manifest.get("status") not in STATES:
        wrong.append("status")
    for key, name in (manifest.get("files") or {}).items():
        if _digest(files.get(name) or b"") != (manifest.get("sha256") or {}).get(key):  # empty files aren't listed
            wrong.append(f"file:{key}")
    return manifest, wrong


def legacy_jobs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One checked row a committed job below ``root/<code>/``."""

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, code, files, marker in zip(part["job_path"], part["code"], part["files"], part["ready"], strict=True):
                files = dict(files)
                m, wrong = _checked(code, files, marker, schema)
                named = m.get("files") or {}
                raw = {"client_to_device": files.get(named.get("request_raw")) or b"", "device_to_client": files.get(named.get("response_raw")) or b""}
                for key, d in (("request_size", "client_to_device"), ("response_size", "device_to_client")):
                    if m.get(key) != len(raw[d]):
                        wrong.append(key)
                wrong += _timeline(files.get(named.get("timeline")) or b"", raw, bool(m.get("timeline_complete")))
                target = f"{m.get('printer_ip')}:{m.get('printer_port')}"
                out.append((path, code, m.get("job_id"), m.get("session_id"), m.get("status"), bool(m.get("raw_complete") and m.get("timeline_complete")), target, raw["client_to_device"], raw["device_to_client"], _digest(files.get("manifest.json") or b""), wrong))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in JOBS.split(", ")])

    return _folders(spark, root, ".ready").mapInPandas(check, JOBS)


def parsed_documents(spark: SparkSession, root: str, schema: str, folder: str = "PHARSED") -> DataFrame:
    """One row a document that an earlier parser wrote beside the capture, with what contradicts its marker or its source range."""

    def check(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, code, files, marker in zip(part["job_path"], part["code"], part["files"], part["ready"], strict=True):
                files = dict(files)
                body, wrong = files.get(f"{folder}/parsed.json") or b"", []
                try:
                    ready, parsed, manifest = capture.strict_json(marker.encode()), capture.strict_json(body), capture.strict_json(files.get("manifest.json") or b"")
                except ValueError:
                    out.append((path, *[None] * 11, ["json"]))
                    continue
                documents = parsed.get("documents") or []
                for bad, what in (
                    (ready.get("schema") != schema or parsed.get("schema") != schema, "schema"), (ready.get("status") != "parsed", "status"), (ready.get("codice_doc") != code or parsed.get("codice_doc") != code, "code"),
                    (ready.get("metadata_sha256") != _digest(body), "metadata"), (ready.get("document_count") != len(documents), "count"),
                ):
                    if bad:
                        wrong.append(what)
                seen: set = set()
                for i, d in enumerate(documents):
                    source, semantic, own = d.get("source") or {}, d.get("semantic") or {}, list(wrong)
                    kind = KINDS.get((d.get("type"), d.get("canonical_type")))
                    start, end = source.get("start_offset"), source.get("end_offset")
                    ranged = isinstance(start, int) and isinstance(end, int) and start < end <= manifest.get("request_size", -1)
                    for bad, what in ((kind is None, "type"), (d.get("document_id") in seen, "repeated"), (d.get("ordinal") != i + 1, "ordinal"), (not ranged, "range"), (not source.get("frame_ids"), "frames")):
                        if bad:
                            own.append(what)
                    seen.add(d.get("document_id"))
                    told = [x["code"] for x in semantic.get("issues") or [] if isinstance(x, dict) and isinstance(x.get("code"), str)]
                    out.append((path, d.get("document_id"), d.get("ordinal"), kind, d.get("subtype"), d.get("complete"), d.get("classification_evidence"), start, end, source.get("frame_ids"), capture.canonical(semantic).decode(), told, own))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.replace("array<", "array ").split(", ")])
            yield frame.astype({"ordinal": "Int32", "start_offset": "Int64", "end_offset": "Int64"})

    return _folders(spark, root, ".parsed").mapInPandas(check, PARSED)


def chosen(roots: dict[str, str | None], readers: dict[str, Callable[[str], DataFrame]], exclusive: tuple[tuple[str, str], ...] = (("legacy", "parsed"),)) -> dict[str, DataFrame]:
    """The readers of the sources that have a root; two that tell the same captures can't be read in one run."""
    named = {k: r for k, r in roots.items() if r}
    if not named:
        raise ValueError("no source has a root")
    for a, b in exclusive:
        if a in named and b in named:
            raise ValueError(f"{a} and {b} tell the same captures; name one of them")
    if unknown := set(named) - set(readers):
        raise ValueError(f"no reader for {', '.join(sorted(unknown))}")
    return {k: readers[k](r) for k, r in named.items()}
