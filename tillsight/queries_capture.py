"""Queries from bytes and captures to documents."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.operators import incremental, lifecycle
from tillsight.operators import workflow as W
from tillsight.plans.tables import shared_folder
from tillsight.queries_functions import read
from tillsight.queries_sales import PRE, sales
from tillsight.registry import query
from tillsight.sources import fiscal


def framed(data: Column, sequence: Column, address: str = "00", kind: str = "z", broken: Column | None = None) -> Column:
    """A printer frame as text of single bytes; a broken one has another checksum."""
    body = F.concat(F.lit(f"\x02{address}"), F.lpad(F.length(data).cast("string"), 3, "0"), F.lit(kind), data, sequence.cast("string"))
    seal = F.aggregate(F.split(body, ""), F.lit(0), lambda a, c: a.bitwiseXOR(F.ascii(c)))  # all characters are single bytes
    if broken is not None:
        seal = F.when(broken, seal.bitwiseXOR(F.lit(1))).otherwise(seal)
    return F.concat(body, F.lpad(F.hex(seal), 2, "0"), F.lit("\x03"))


def fiscal_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job for each order: a receipt of its lines, some of which have a wrong checksum, a pre-bill with a footer, the answers; every fifth is cancelled, every fourth receipt has no end."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", F.floor("o_totalprice").cast("bigint").alias("c"), F.col("o_orderdate").cast("timestamp").alias("t"))
    i = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").cast("string").alias("q"))
    sold = F.struct(F.concat(F.lit("=R1/$"), (F.col("l_partkey") + 100).cast("string"), F.lit("/*"), F.col("q"), F.lit("/(Voce "), F.col("l_partkey").cast("string"), F.lit(")")).alias("d"), (F.col("l_partkey") % 11 == 0).alias("broken"))
    listed = i.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "q", sold.alias("s")))), lambda x: x["s"]).alias("items"))
    k, plain = F.col("k").cast("string"), lambda x: F.struct(x.alias("d"), F.lit(False).alias("broken"))
    said = lambda *parts: plain(F.concat(F.lit('="/('), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(")")))
    receipt = F.concat(F.array(plain(F.lit("=K"))), F.coalesce("items", F.array().cast("array<struct<d:string,broken:boolean>>")), F.array(plain(F.concat(F.lit("=T1/$"), F.col("c").cast("string"))), plain(F.lit("<</?s"))), F.when(F.col("k") % 4 != 3, F.array(plain(F.lit("<</?1")))).otherwise(F.array().cast("array<struct<d:string,broken:boolean>>")))
    paper = F.array(
        plain(F.lit("=o")), said("PRECONTO"), said("Tavolo: T", (F.col("o_custkey") % 40).cast("string")), said("# ORDINE: O-", k), said("Coperto 2,00"), said("Totale ", F.col("c").cast("string"), ",00 1,50"),
        said(F.when(F.col("k") % 2 == 0, F.concat(F.lit("RIF. DOCUMENTO N. 0042-"), k)).otherwise("grazie")), said(F.date_format("t", "dd/MM/yy"), " 12:30"), said("DOC. GESTIONALE N. 0001/", k), said("RT sn", F.lpad(k, 10, "0")), plain(F.lit("=o")),
    )
    commands = F.concat(receipt, paper, F.when(F.col("k") % 5 == 0, F.array(plain(F.lit("=k")))).otherwise(F.array().cast("array<struct<d:string,broken:boolean>>")))
    a = F.array_join(F.transform(commands, lambda c, n: framed(c["d"], n % 10, broken=c["broken"])), "")
    asked = F.coalesce(F.size("items"), F.lit(0)) + 2
    b = F.when(F.col("k") % 3 != 0, framed(F.concat(F.lit("s000000RE"), F.lpad((F.col("k") % 10000).cast("string"), 4, "0")), (asked + 8) % 10, "01", "N")).otherwise(framed(F.lit("ES00000016"), F.lit(5), "01", "N"))
    raw = lambda x: F.encode(x, "ISO-8859-1")
    return o.join(listed, "k", "left").select(k.alias("job_id"), F.col("t").alias("captured_at"), raw(a).alias("client_raw"), raw(F.concat(F.lit("\x06"), b)).alias("device_raw"))


_X2 = """WITH i AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_partkey % 11 <> 0) AS good, sum(CASE WHEN l_partkey % 11 <> 0 THEN (l_partkey + 100) * l_quantity END) AS cents FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS k, o_custkey, floor(o_totalprice)::BIGINT AS c, o_orderdate, coalesce(n, 0) AS n, coalesce(good, 0) AS good, cents, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS x FROM orders LEFT JOIN i ON o_orderkey = i.k)
SELECT k::VARCHAR AS job_id, 1 + x AS ordinal, 'COMMERCIAL_DOCUMENT' AS type, k % 4 <> 3 AS complete, CASE WHEN k % 4 <> 3 THEN 72 ELSE 52 END AS confidence, c / 100.0::DOUBLE AS total, CASE WHEN k % 3 <> 0 THEN lpad((k % 10000)::VARCHAR, 4, '0') END AS suffix, NULL AS external_code, NULL AS commercial_reference,
  NULL AS table_code, NULL AS order_code, NULL AS serial, good AS n_lines, cents / 100.0::DOUBLE AS lines_total, c / 100.0::DOUBLE AS paid, NULL::BIGINT AS document_at, n - good + CASE WHEN k % 4 = 3 THEN 1 ELSE 0 END AS n_warnings FROM o
UNION ALL SELECT k::VARCHAR, 2 + x, 'PRE_BILL', TRUE, 90, c::DOUBLE, NULL, '0001-' || k, CASE WHEN k % 2 = 0 THEN '0042-' || k END, 'T' || o_custkey % 40, 'O-' || k, 'SN' || lpad(k::VARCHAR, 10, '0'), 9, 3.5, NULL,
  CAST(epoch(((CAST(o_orderdate AS DATE) + TIME '12:30') AT TIME ZONE 'Europe/Rome') AT TIME ZONE 'UTC') AS BIGINT), n - good FROM o
UNION ALL SELECT k::VARCHAR, 1, 'CANCELLATION', TRUE, 80, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, NULL, NULL, NULL, 0 FROM o WHERE x = 1
UNION ALL SELECT k::VARCHAR, 3 + x, 'DEVICE_RESPONSE', TRUE, 100, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1, NULL, NULL, NULL, CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END FROM o"""


@query("x2_documents", _X2)
def x2_documents(spark, sf):
    """Receipts, pre-bills, cancellations and answers from fiscal printer bytes."""
    d = fiscal.documents(fiscal_jobs(spark, sf))
    added = lambda c, of: F.aggregate(F.filter(c, lambda x: x[of].isNotNull()), F.lit(None).cast("decimal(19,2)"), lambda a, x: (F.coalesce(a, F.lit(0)) + x[of]).cast("decimal(19,2)"))
    return d.select(
        "job_id", "ordinal", "type", "complete", "confidence", "total", "suffix", "external_code", "commercial_reference", "table_code", "order_code", "serial", F.greatest(F.size("lines"), F.lit(0)).alias("n_lines"),
        added("lines", "total").alias("lines_total"), added("payments", "amount").alias("paid"), "document_at", F.size("warnings").alias("n_warnings"),
    )


_LEDGER = (
    "ARCHIVED>QUEUED>SEND_ARMED>SENDING>SENT_UNCONFIRMED", "ARCHIVED>SENT_UNCONFIRMED>RETENTION_DELETE_STARTED>RETENTION_DELETED", "ARCHIVED>SENDING", "ARCHIVED>ARCHIVED",
    "DUPLEX_ACTIVE>ARCHIVED>QUEUED", "ARCHIVED>QUARANTINED", "ARCHIVED>LOST", "QUEUED",
)


@query("s8_ledger_jobs", """SELECT o_orderkey AS job_id, (['SENT_UNCONFIRMED', 'RETENTION_DELETED', 'SENDING', 'SEALED', 'ODD', 'QUARANTINED', 'ODD', 'QUEUED'])[1 + o_orderkey % 8] AS state,
CASE WHEN o_orderkey % 8 = 3 THEN '10.0.0.2' WHEN o_orderkey % 8 <> 7 THEN '10.0.0.1' END AS destination, o_orderkey % 8 IN (0, 5) AND o_orderkey % 16 <> 0 AS importable,
CASE WHEN o_orderkey % 16 = 0 THEN 'destinations' ELSE (['', '', 'step', 'archives,destinations,step', 'status', '', 'event', 'step'])[1 + o_orderkey % 8] END AS violations FROM orders""")
def s8_ledger_jobs(spark, sf):
    """A ledger of every order: whole runs, deletions, illegal steps, a second archive, another destination, a wrong status, an unknown event."""
    k = F.col("o_orderkey")
    e = read(spark, sf, "orders").select(k.alias("job_id"), F.posexplode(F.split(F.element_at(F.array(*map(F.lit, _LEDGER)), (k % 8 + 1).cast("int")), ">")).alias("sequence", "event"))
    status = F.create_map(*[F.lit(x) for kv in lifecycle.EVENT_STATUS.items() for x in kv])
    own = F.coalesce(F.try_element_at(status, F.col("event")), F.lit("ODD"))
    other = ((F.col("job_id") % 16 == 0) & (F.col("sequence") == 2)) | ((F.col("job_id") % 8 == 3) & (F.col("sequence") == 1))
    log = e.withColumns({"status": F.when((F.col("job_id") % 8 == 4) & (F.col("event") == "QUEUED"), "ODD").otherwise(own), "destination": F.concat(F.lit("10.0.0."), F.when(other, "2").otherwise("1"))})
    return lifecycle.ledger_jobs(log)


@query("t3_increments", PRE + "SELECT document_id, min(document_id) OVER (PARTITION BY transaction_key) AS cluster FROM m")
def t3_increments(spark, sf):
    """The clusters of all papers, taken in by two versions, the second of which holds late papers of all hours."""
    c, _, _ = sales(spark, sf)
    root = f"{shared_folder(spark)}/stores/{uuid.uuid4().hex}"
    turn = F.pmod(F.xxhash64("document_id"), F.lit(10))
    for version, part in enumerate((turn < 8, turn >= 8)):
        incremental.add(spark, root, version, c.documents.where(part), c.lines)
    return incremental.labels(spark, root, 1).select("document_id", "cluster")


@query("p24_pending_jobs", """WITH a AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 AS tries, DATE_DIFF('second', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 97) SECOND) AS ago FROM orders)
SELECT o_orderkey AS job_id FROM a WHERE o_orderkey % 3 <> 0 AND o_orderkey % 4 <> 0 AND (o_orderkey % 7 = 0 OR tries = 0 OR ago >= least(3600, 5 * power(2, tries - 1))) AND o_orderkey % 11 <> 0""")
def p24_pending_jobs(spark, sf):
    """Jobs of the right status with bytes, not yet done by this build, whose last failure lies far enough back."""
    k = F.col("o_orderkey")
    o = read(spark, sf, "orders").select(k.alias("job_id"), F.when(k % 3 == 0, "PARSED").otherwise("IMPORTED").alias("status"))
    j = F.col("job_id")
    raw = o.where(j % 4 != 0).select("job_id")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    fails = o.where(j % 5 > 0).select("job_id", F.explode(F.sequence(F.lit(1), (j % 5).cast("int"))).alias("n")).select("job_id", (now - F.make_dt_interval(secs=(j % 97) + (j % 5) - F.col("n"))).alias("failed_at"))
    done = o.where(j % 11 == 0).select("job_id", F.lit("b2").alias("build")).unionByName(o.where(j % 2 == 0).select("job_id", F.lit("b1").alias("build")))
    return W.pending(o, raw, done, fails, "b2", now, ("IMPORTED",), o.where(j % 7 == 0).select("job_id")).select("job_id")
