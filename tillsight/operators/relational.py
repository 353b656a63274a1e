"""Selection, paging, search, union and version operators that read models share."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal_filters(df: DataFrame, filters: dict) -> DataFrame:
    """Equality on each named column; empty values are no filter."""
    for name, value in filters.items():
        if value:
            df = df.where(F.col(name) == value)
    return df


def period(column: str, start: str | None, end: str | None) -> Column:
    """From (inclusive) to (exclusive); the end must lie after the start."""
    if start and end and not end > start:
        raise ValueError("a period must end after it starts")
    c = F.lit(True)
    if start:
        c = c & (F.col(column) >= F.lit(start).cast("timestamp"))
    if end:
        c = c & (F.col(column) < F.lit(end).cast("timestamp"))
    return c


def complete_job() -> Column:
    """The job's capture and timeline are whole and nothing failed."""
    return F.col("capture_complete") & F.col("timeline_complete") & ~F.col("status").isin("FAILED", "INCOMPLETE", "MALFORMED") & ~F.col("import_status").isin("FAILED", "QUARANTINED", "PARSE_RETRY", "PARSE_FAILED")


def document_scope(kind: str | None = None, exclude: str | None = None, technical: bool = False) -> Column:
    """P25: an asked type wins over an excluded one, that over hiding device responses."""
    c = F.col("type") == kind if kind else F.col("type") != exclude if exclude else F.col("type") != "DEVICE_RESPONSE"
    return c if technical else c & (F.col("complete") | F.col("has_content"))


def has_content(payments: DataFrame, lines: DataFrame, documents: DataFrame) -> DataFrame:
    """P5: documents with a flag for business content: a code, an amount, a line or a payment."""
    l = lines.select("document_id").distinct().withColumn("_l", F.lit(True))
    p = payments.select("document_id").distinct().withColumn("_p", F.lit(True))
    own = F.coalesce("order_code", "external_code", "external_suffix", "commercial_reference").isNotNull() | F.coalesce("gross_total", "net_total", "discount_total").isNotNull()
    return documents.join(l, "document_id", "left").join(p, "document_id", "left").withColumn("has_content", own | F.coalesce("_l", F.lit(False)) | F.coalesce("_p", F.lit(False))).drop("_l", "_p")


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """O1: one page of a total order (the caller ends it with a unique key)."""
    if not 1 <= limit <= 10_000 or offset < 0:
        raise ValueError("invalid page")
    return df.orderBy(*order).offset(offset).limit(limit)


def contains(columns: list[str], needle: str, amounts: list[str] = ()) -> Column:
    """Case-insensitive substring of any column, or an exact amount; under two characters nothing matches."""
    needle = needle.strip()
    if len(needle) < 2:
        return F.lit(False)
    like = "%" + needle.replace("%", r"\%").replace("_", r"\_") + "%"
    c = F.lit(False)
    for name in columns:
        c = c | F.coalesce(F.col(name).ilike(like), F.lit(False))
    try:
        amount = Decimal(needle.replace(",", "."))
    except InvalidOperation:
        return c
    for name in amounts:
        c = c | F.coalesce(F.col(name) == F.lit(amount), F.lit(False))
    return c


def latest(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each ``by`` in ``order``."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def active_versions(versions: DataFrame, active: DataFrame) -> DataFrame:
    """The parser's active version of a document, else the latest; ``active`` has one row a parser."""
    a = active.select("parser_name", F.col("version_id").alias("active_version"))
    v = versions.join(a, "parser_name", "left").withColumn("active", F.col("parser_version") == F.col("active_version"))
    return latest(v, ["document_id"], [F.desc("active"), F.desc("sequence"), F.desc("version_id")]).drop("active", "active_version")


def versioned(version: list[str], legacy: list[str]) -> list[Column]:
    """The version's value, unless all its columns are null: then the whole row is the legacy one."""
    none = F.coalesce(*[F.col(c).cast("string") for c in version]).isNull()
    return [F.when(none, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(version, legacy, strict=True)]


def contiguous(chunks: DataFrame, by: str) -> DataFrame:
    """Chunks with the expected offset and whether sequence and offset follow on."""
    w = Window.partitionBy(by).orderBy("sequence")
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumns({"expected_offset": before, "expected_sequence": F.row_number().over(w)}).withColumn("follows", (F.col("offset") == F.col("expected_offset")) & (F.col("sequence") == F.col("expected_sequence")))


def valid_prefix(chunks: DataFrame, by: str) -> DataFrame:
    """K2: bytes and chunks of the longest valid beginning of each stream."""
    w = Window.partitionBy(by).orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    good = contiguous(chunks, by).withColumn("_ok", F.min(F.col("follows")).over(w))
    return good.groupBy(by).agg(F.count_if("_ok").alias("chunks"), F.coalesce(F.sum(F.when(F.col("_ok"), F.col("length"))), F.lit(0)).alias("bytes"), F.min("_ok").alias("complete"))


def reassemble(chunks: DataFrame, by: str) -> DataFrame:
    """A stream's bytes in order; null if a chunk is missing, short or altered."""
    good = contiguous(chunks, by).withColumn("_ok", F.col("follows") & (F.octet_length("payload") == F.col("length")) & (F.sha2("payload", 256) == F.col("payload_sha256")))
    parts = good.groupBy(by).agg(F.min("_ok").alias("ok"), F.array_sort(F.collect_list(F.struct("sequence", "payload"))).alias("parts"))
    return parts.select(by, F.when(F.col("ok"), F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["payload"]))).alias("data"))


def split_valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """K9: rows that pass every check, and the others with the names of the checks they fail."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    tagged = df.withColumn("failed", failed)
    return tagged.where(F.size("failed") == 0).drop("failed"), tagged.where(F.size("failed") > 0)


def idempotent_append(existing: DataFrame, incoming: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """K3: new rows, repeats, and conflicts (same key, other content)."""
    e = existing.select(key, F.col(digest).alias("_known"))
    both = incoming.join(e, key, "left")
    return both.where("_known IS NULL").drop("_known"), both.where(F.col("_known") == F.col(digest)).drop("_known"), both.where(F.col("_known") != F.col(digest)).drop("_known")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are there more than once."""
    return df.groupBy(*key).count().where("count > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose parent is missing."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def endpoint_devices(seen: DataFrame, devices: DataFrame) -> DataFrame:
    """``seen(endpoint)`` with ``device_id`` of the configured device at that host and port, null if there is none.

    ``devices(device_id, host, port)``; hosts are compared in lower case. Two devices at one endpoint are none.
    """
    at = lambda host, port: F.concat(F.lower(F.trim(host)), F.lit(":"), port.cast("string"))
    known = devices.groupBy(at(F.col("host"), F.col("port")).alias("_at")).agg(F.count("*").alias("_n"), F.min("device_id").alias("device_id")).where("_n = 1").drop("_n")
    return seen.withColumn("_at", F.lower(F.trim("endpoint"))).join(known, "_at", "left").drop("_at")


def synchronised(stored: DataFrame, wanted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """M6: rows after a configuration was read, with ``action``: INSERTED, UPDATED, UNCHANGED, or DISABLED if it names them no more."""
    a = stored.select(key, F.struct(*columns).alias("_old"))
    b = wanted.select(key, F.struct(*columns).alias("_new"))
    both = a.join(b, key, "full_outer")
    action = F.when(F.col("_old").isNull(), "INSERTED").when(F.col("_new").isNull(), "DISABLED").when(F.col("_old") == F.col("_new"), "UNCHANGED").otherwise("UPDATED")
    now = F.coalesce("_new", "_old")
    return both.select(key, *[now[c].alias(c) for c in columns], action.alias("action"))
