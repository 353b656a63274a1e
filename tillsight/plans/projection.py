"""Canonical tables derived from the generic star-schema tables.

Each order yields the papers a till would print for it: kitchen ticket, pre-bill, change, fiscal document, device
response, copies, cancellation or room charge. Money is rounded to cents once, here. The DuckDB text repeats the
same arithmetic for result checks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillsight.schema import names, DOCUMENTS, LINES

#: prefix, type, condition, seconds, gross cents, complete, external, reference, job prefix, device, economic close
_PAPERS = [
    ("K", "KITCHEN_ORDER", "k % 4 = 0", -20, "NULL", "TRUE", "NULL", "NULL", "K", "pos"),
    ("P", "PRE_BILL", "TRUE", 0, "pc", "TRUE", "'PB-' || k", "NULL", "P", "pos"),
    ("H", "ORDER_CHANGE", "k % 12 = 0", 60, "NULL", "TRUE", "NULL", "NULL", "H", "pos"),
    ("C", "COMMERCIAL_DOCUMENT", "st = 'F'", 120, "fc", "k % 11 <> 0", "'CM-' || code", "NULL", "C", "fis"),
    ("R", "DEVICE_RESPONSE", "st = 'F' AND k % 6 = 0", 121, "NULL", "TRUE", "NULL", "NULL", "C", "fis"),
    ("A", "CONFORMING_COPY", "st = 'F' AND k % 10 = 0", 201, "fc", "TRUE", "'CP-' || k", "'CM-' || code", "A", "fis"),
    ("B", "CONFORMING_COPY", "st = 'F' AND k % 10 = 0", 202, "fc", "TRUE", "'CP-' || k", "'CM-' || code", "B", "fis"),
    ("D", "REPRINT", "st = 'F' AND k % 10 = 0", 203, "fc", "TRUE", "'CP-' || k", "'CM-' || code", "D", "fis"),
    ("X", "CANCELLATION", "st = 'P' AND k % 3 = 0", 180, "pc", "TRUE", "NULL", "NULL", "X", "pos"),
    ("M", "MANAGEMENT_DOCUMENT", "st = 'O' AND k % 5 = 0", 240, "pc // 2", "TRUE", "'MG-' || k", "NULL", "M", "fis"),
]


def _columns(p: tuple) -> str:
    """One paper's canonical columns over the order row (k, cust, st, t, pc, fc, code), in portable SQL."""
    prefix, kind, _, seconds, gross, complete, external, reference, job, device = p
    dev = "'dev_' || CAST(1 + cust % 5 AS STRING)" if device == "pos" else "'dev_' || CAST(6 + cust % 4 AS STRING)"
    net = prefix == "P"
    cents = gross.replace("pc // 2", "CAST(floor(pc / 2) AS BIGINT)")
    money = f"CAST(CAST({cents} AS DECIMAL(17,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(19,4))"
    shift = f"t + INTERVAL '{seconds}' SECOND"
    s = lambda x: x.replace("|| k", "|| CAST(k AS STRING)").replace("|| code", "|| CAST(code AS STRING)")
    time = f"CASE WHEN k % 13 = 0 THEN NULL ELSE {shift} END" if prefix == "K" else shift
    return ", ".join([
        f"'{prefix}' || CAST(k AS STRING) AS document_id", f"'{kind}' AS type", f"{dev} AS device_id", "'S' || CAST(cust AS STRING) AS session_id",
        f"'J{job}' || CAST(k AS STRING) AS job_id", "CAST(NULL AS STRING) AS order_code" if prefix in "RABD" else "CAST(k AS STRING) AS order_code",
        "'T' || CAST(cust % 40 AS STRING) AS table_code", "'OP' || CAST(cust % 7 AS STRING) AS operator_code", "CAST(NULL AS STRING) AS terminal_code",
        f"CAST({s(external)} AS STRING) AS external_code", "CAST(code % 10000 AS STRING) AS external_suffix" if prefix == "C" else "CAST(NULL AS STRING) AS external_suffix",
        "CAST(NULL AS STRING) AS suffix_evidence", f"CAST({s(reference)} AS STRING) AS commercial_reference", f"{time} AS document_time",
        f"{shift} + INTERVAL '1' SECOND AS captured_at",
        f"CASE WHEN k % 17 = 0 THEN NULL ELSE {money} END AS gross_total" if net else f"{money} AS gross_total",
        f"CASE WHEN k % 17 = 0 THEN {money} ELSE NULL END AS net_total" if net else "CAST(NULL AS DECIMAL(19,4)) AS net_total",
        "CAST(NULL AS DECIMAL(19,4)) AS discount_total", f"{complete} AS complete", f"{'TRUE' if prefix == 'M' else 'FALSE'} AS economic_close",
        "'ROOM_CHARGE' AS settlement_kind" if prefix == "M" else "CAST(NULL AS STRING) AS settlement_kind",
        "'REF-' || CAST(k AS STRING) AS order_reference" if prefix in "PCXM" else "CAST(NULL AS STRING) AS order_reference",
        f"sha_of('{kind}' || CAST(k - (CASE WHEN k % 50 = 0 THEN 1 ELSE 0 END) AS STRING)) AS payload_sha256",
    ])


_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
_LINE = {
    "cents": "CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT)",
    "unit": "CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT)",
}


@dataclass(frozen=True)
class Canonical:
    devices: DataFrame
    documents: DataFrame
    lines: DataFrame
    payments: DataFrame


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.concat(F.lit("dev_"), F.col("s_suppkey")).alias("device_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 4 == 0, "rch").otherwise("pos").alias("device_type"), F.col("n_name").alias("department"), F.col("s_suppkey").alias("ordinal"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale lines by order: sequence, item, cents. Partitioned by order once; nothing else shuffles."""
    items = _read(spark, sf_dir, "lineitem").select("l_orderkey", *[c.strip() for c in _ORDER.split(",")])
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name")
    w = Window.partitionBy("l_orderkey").orderBy(*[F.col(c.strip()) for c in _ORDER.split(",")])
    seq = items.withColumn("sequence", F.row_number().over(w)).withColumn("cents", F.expr(_LINE["cents"])).withColumn("unit", F.expr(_LINE["unit"]))
    return seq.join(part, seq.l_partkey == part.p_partkey, "left").select(
        F.col("l_orderkey").alias("k"), "sequence", F.when(F.col("sequence") % 3 != 0, F.col("l_partkey").cast("string")).alias("item_code"),
        F.col("p_name").alias("description"), F.col("l_quantity").cast("bigint").alias("q"), "cents", "unit",
    )


def sold_cents(lines: DataFrame) -> DataFrame:
    """Cents on the fiscal document: the first line of every ninth order is gone, prices of every seventh halved."""
    sold = lines.where(~((F.col("k") % 9 == 0) & (F.col("sequence") == 1)))
    half = F.when(F.col("k") % 7 == 0, F.floor(F.col("cents") / 2)).otherwise(F.col("cents"))
    return sold.groupBy("k").agg(F.sum(half).cast("bigint").alias("fc"))


def documents(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS cust", "o_orderstatus AS st", "CAST(o_orderdate AS TIMESTAMP) AS t", "CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS pc")
    base = orders.join(sold_cents(lines if lines is not None else raw_lines(spark, sf_dir)), "k", "left")
    base = base.withColumn("fc", F.coalesce("fc", F.lit(0).cast("bigint"))).withColumn("code", F.expr("k - CASE WHEN k % 50 = 0 THEN 1 ELSE 0 END"))
    # One pass: an order's papers are an array of structs, exploded, rather than a union of ten scans.
    papers = []
    for p in _PAPERS:
        fields = _columns(p).replace("sha_of(", "sha2(").replace("AS STRING)) AS payload_sha256", "AS STRING), 256) AS payload_sha256")
        papers.append(f"CASE WHEN {p[2]} THEN struct({fields}) END")
    return base.select(F.explode(F.expr(f"filter(array({', '.join(papers)}), x -> x IS NOT NULL)")).alias("d")).select("d.*").select(*names(DOCUMENTS))


def document_lines(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    lines = lines if lines is not None else raw_lines(spark, sf_dir)
    status = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("st"))
    money = lambda c: f"CAST(CAST({c} AS DECIMAL(17,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(19,4))"
    none = "CAST(NULL AS DECIMAL(19,4))"
    kinds = [
        ("P", "TRUE", "q", money("unit"), none, money("cents")),
        ("C", "st = 'F' AND NOT (k % 9 = 0 AND sequence = 1)", "q", money("unit"), f"CASE WHEN k % 7 = 0 THEN {money('CAST(floor(unit / 2) AS BIGINT)')} END", money("CASE WHEN k % 7 = 0 THEN CAST(floor(cents / 2) AS BIGINT) ELSE cents END")),
        ("K", "k % 4 = 0", "q", none, none, none),
        ("H", "k % 12 = 0 AND sequence = 1", "-1", none, none, none),
    ]
    rows = [f"CASE WHEN {cond} THEN struct('{p}' || CAST(k AS STRING) AS document_id, CAST(sequence AS INT) AS sequence, item_code, description, CAST({q} AS DECIMAL(19,4)) AS quantity, {unit} AS unit_price, {mod} AS modified_unit_price, {none} AS discount, {total} AS line_total, FALSE AS removed) END" for p, cond, q, unit, mod, total in kinds]
    return lines.join(status, "k").select(F.explode(F.expr(f"filter(array({', '.join(rows)}), x -> x IS NOT NULL)")).alias("x")).select("x.*").select(*names(LINES))


def payments(docs: DataFrame) -> DataFrame:
    """One payment a fiscal document; every fifteenth order's is one unit short."""
    paid = docs.where((F.col("type") == "COMMERCIAL_DOCUMENT") & F.col("gross_total").isNotNull())
    short = F.when(F.col("order_code").cast("bigint") % 15 == 0, F.lit(1)).otherwise(F.lit(0))
    return paid.select("document_id", F.lit("CASH").alias("method"), (F.col("gross_total") - short).cast("decimal(19,4)").alias("amount"))


def canonical(spark: SparkSession, sf_dir: str) -> Canonical:
    lines = raw_lines(spark, sf_dir)
    docs = documents(spark, sf_dir, lines)
    return Canonical(devices(spark, sf_dir), docs, document_lines(spark, sf_dir, lines), payments(docs))


def duckdb_prelude() -> str:
    """``WITH`` clause that gives DuckDB the same tables: devices, documents_, lines_, payments_."""
    papers = "\nUNION ALL ".join(f"SELECT {_columns(p).replace('sha_of(', 'sha256(').replace('AS STRING', 'AS VARCHAR')} FROM b WHERE {p[2]}" for p in _PAPERS)
    money = lambda c: f"CAST(CAST({c} AS DECIMAL(17,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(19,4))"
    none = "CAST(NULL AS DECIMAL(19,4))"
    line = lambda p, cond, q, unit, mod, total: f"SELECT '{p}' || k AS document_id, sequence, item_code, description, CAST({q} AS DECIMAL(19,4)) AS quantity, {unit} AS unit_price, {mod} AS modified_unit_price, {none} AS discount, {total} AS line_total, FALSE AS removed FROM rl JOIN (SELECT o_orderkey, o_orderstatus AS st FROM orders) ON o_orderkey = k WHERE {cond}"
    rows = "\nUNION ALL ".join([
        line("P", "TRUE", "q", money("unit"), none, money("cents")),
        line("C", "st = 'F' AND NOT (k % 9 = 0 AND sequence = 1)", "q", money("unit"), f"CASE WHEN k % 7 = 0 THEN {money('unit // 2')} END", money("CASE WHEN k % 7 = 0 THEN cents // 2 ELSE cents END")),
        line("K", "k % 4 = 0", "q", none, none, none),
        line("H", "k % 12 = 0 AND sequence = 1", "-1", none, none, none),
    ])
    return f"""WITH devices AS MATERIALIZED (SELECT 'dev_' || s_suppkey AS device_id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'rch' ELSE 'pos' END AS device_type, n_name AS department, s_suppkey AS ordinal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
rl AS MATERIALIZED (SELECT l_orderkey AS k, CAST(seq AS INTEGER) AS sequence, CASE WHEN seq % 3 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS item_code, p_name AS description, CAST(l_quantity AS BIGINT) AS q, {_LINE['cents']} AS cents, {_LINE['unit']} AS unit
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS seq FROM lineitem) LEFT JOIN part ON l_partkey = p_partkey),
sc AS (SELECT k, CAST(sum(CASE WHEN k % 7 = 0 THEN cents // 2 ELSE cents END) AS BIGINT) AS fc FROM rl WHERE NOT (k % 9 = 0 AND sequence = 1) GROUP BY k),
b AS MATERIALIZED (SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS st, o_orderdate AS t, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS pc, coalesce(fc, 0) AS fc, o_orderkey - CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS code FROM orders LEFT JOIN sc ON o_orderkey = k),
documents_ AS MATERIALIZED ({papers}),
lines_ AS MATERIALIZED ({rows}),
payments_ AS (SELECT document_id, 'CASH' AS method, CAST(gross_total - CASE WHEN CAST(order_code AS BIGINT) % 15 = 0 THEN 1 ELSE 0 END AS DECIMAL(19,4)) AS amount FROM documents_ WHERE type = 'COMMERCIAL_DOCUMENT' AND gross_total IS NOT NULL)
"""
