"""Byte-stream parsers as table functions: till tickets and framed fiscal printer traffic."""

from __future__ import annotations

import hashlib
import inspect
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.plans.tables import written
from tillsight.sources import fiscal, tickets
from tillsight.sources.fiscal import frames

FRAMES = "job_id string, frame_id int, offset bigint, address string, frame_class string, data string, sequence string, bcc_valid boolean, issue string"
DOCS = "job_id string, ordinal int, type string, complete boolean, external_code string, suffix string, table_code string, order_code string, total string, text string, items array<struct<quantity:int,description:string,total:string>>, warnings array<string>"


def version(*modules) -> str:
    """A parser's version: the hash of the source files that make it up."""
    return hashlib.sha256(b"".join(inspect.getsource(m).encode() for m in modules)).hexdigest()


def _fiscal_jobs(jobs: DataFrame) -> DataFrame:
    timed = jobs if "captured_at" in jobs.columns else jobs.withColumn("captured_at", F.lit(None).cast("timestamp"))
    d = fiscal.documents(timed)
    items = F.transform("lines", lambda x: F.struct(x["quantity"].cast("int").alias("quantity"), x["description"].alias("description"), x["total"].cast("string").alias("total")))
    return d.select("job_id", "ordinal", "type", "complete", "external_code", "suffix", "table_code", "order_code", F.col("total").cast("string").alias("total"), "text", items.alias("items"), "warnings")


def _ticket_jobs(jobs: DataFrame) -> DataFrame:
    lines = written(tickets.ticket_lines(jobs), "ticket-lines")
    items = tickets.ticket_items(lines)
    listed = items.groupBy("job_id", "ordinal").agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence", F.col("quantity").cast("int").alias("quantity"), "description", F.col("amount").cast("decimal(19,2)").cast("string").alias("total")))), lambda x: F.struct(x["quantity"].alias("quantity"), x["description"].alias("description"), x["total"].alias("total"))).alias("items"))
    captured = jobs.select("job_id", "captured_at") if "captured_at" in jobs.columns else None
    d = tickets.ticket_documents(lines, items, captured=captured).join(listed, ["job_id", "ordinal"], "left").join(tickets.input_warnings(jobs), "job_id")
    return d.select("job_id", "ordinal", "type", "complete", "external_code", F.lit(None).cast("string").alias("suffix"), "table_code", "order_code", F.col("total").cast("decimal(19,2)").cast("string").alias("total"), "text", F.coalesce("items", F.array().cast("array<struct<quantity:int,description:string,total:string>>")).alias("items"), "warnings")


#: Parsers by kind, each over a table of jobs, with what its version is made of.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {"pos": _ticket_jobs, "rch": _fiscal_jobs}
SOURCES = {"pos": (tickets,), "rch": (fiscal,)}


def parse(jobs: DataFrame, kind: str = "kind") -> DataFrame:
    """Documents of ``jobs(job_id, kind, client_raw, device_raw)`` with the parser and its version; an unknown kind yields none."""
    out = None
    for name, parser in REGISTRY.items():
        own = version(*SOURCES.get(name, (sys.modules[parser.__module__],)))
        found = parser(jobs.where(F.col(kind) == name)).withColumns({"parser": F.lit(name), "parser_version": F.lit(own)})
        out = found if out is None else out.unionByName(found)
    return out


def frame_rows(jobs: DataFrame, column: str = "client_raw") -> DataFrame:
    """Frames of each job as rows; what isn't a frame is a row with an issue."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for job, data in zip(part["job_id"], part["data"], strict=True):
                found, issues, _ = frames(bytes(data or b""))
                rows += [(job, i + 1, *f, None) for i, f in enumerate(found)] + [(job, None, None, None, None, None, None, None, x) for x in issues]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FRAMES.split(", ")]).astype({"frame_id": "Int32", "offset": "Int64"})

    return jobs.select("job_id", F.col(column).alias("data")).mapInPandas(run, FRAMES)


def paired_frames(requests: DataFrame, shift: int = 8) -> DataFrame:
    """Requests with ``response_at``: the first answer after them whose sequence digit lies ``shift`` further.

    ``requests(job_id, at, sequence, request)`` in the order ``at``. An answer belongs to the last request of its digit before
    it, so requests and answers of a digit are read in one order and no pair is ever formed to be thrown away.
    """
    digit = F.when(F.col("request"), F.col("sequence")).otherwise(F.pmod(F.col("sequence") - shift, F.lit(10)))
    w = Window.partitionBy("job_id", "_digit").orderBy("at", F.desc("request"))
    asked = requests.withColumn("_digit", digit).withColumn("_asked", F.last(F.when(F.col("request"), F.col("at")), True).over(w))
    answered = asked.where(~F.col("request") & F.col("_asked").isNotNull()).groupBy("job_id", "_digit", F.col("_asked").alias("at")).agg(F.min("at").alias("response_at"))
    return answered.select("job_id", "at", "response_at")
