"""Registered queries over sale papers: projections, joins, diffs, pairs, transactions, rules, read models."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillsight import schema
from tillsight.functions import text, values
from tillsight.operators import lines as L
from tillsight.operators import pairs as P
from tillsight.operators import relational as R
from tillsight.operators import rules as U
from tillsight.operators import transactions as T
from tillsight.plans.projection import canonical, duckdb_prelude, payments
from tillsight.plans.tables import written
from tillsight.registry import query

EVALUATED = "2030-01-01 00:00:00"
_VF = "(type = 'COMMERCIAL_DOCUMENT' AND complete AND total IS NOT NULL)"
_RC = "(type = 'MANAGEMENT_DOCUMENT' AND (economic_close OR coalesce(settlement_kind = 'ROOM_CHARGE', FALSE)))"
_KEY = "CASE WHEN item_code IS NOT NULL THEN 'CODE:' || item_code WHEN description IS NOT NULL THEN 'DESC:' || upper(description) ELSE 'POSITION:' || (sequence - 1) END"
_D = "::DOUBLE"

DOCS = duckdb_prelude()
PRE = DOCS + f""",
m AS MATERIALIZED (SELECT *, substr(document_id, 2) AS transaction_key, coalesce(document_time, captured_at) AS time, coalesce(gross_total, net_total) AS total FROM documents_),
f1 AS (SELECT transaction_key, min(time) AS ff FROM m WHERE {_VF} GROUP BY 1),
bill AS (SELECT m.transaction_key, arg_max(document_id, strftime(time, '%Y%m%d%H%M%S') || document_id) AS prebill_id, arg_max(total, strftime(time, '%Y%m%d%H%M%S') || document_id) AS prebill_total FROM m LEFT JOIN f1 USING (transaction_key) WHERE type = 'PRE_BILL' AND (ff IS NULL OR time <= ff) GROUP BY 1),
agg AS (SELECT transaction_key, count(*) AS documents, min(time) AS opened_at, max(time) AS last_at, coalesce(sum(total) FILTER ({_VF}), 0) AS fiscal_total, count(*) FILTER ({_VF}) AS fiscals,
  coalesce(sum(total) FILTER ({_RC} AND total IS NOT NULL), 0) AS closing_total, count(*) FILTER ({_RC} AND total IS NOT NULL) AS closings, count(*) FILTER (type = 'CANCELLATION') AS cancellations, min(operator_code) AS operator_code FROM m GROUP BY 1),
pay AS (SELECT transaction_key, coalesce(sum(amount) FILTER ({_VF}), sum(amount)) AS paid, count(*) AS payment_records FROM payments_ JOIN m USING (document_id) GROUP BY 1),
tx AS MATERIALIZED (SELECT agg.*, ff AS first_fiscal_at, prebill_id, prebill_total, coalesce(paid, 0) AS payment_total, coalesce(payment_records, 0) AS payment_records, CASE WHEN fiscals > 0 THEN fiscal_total ELSE closing_total END AS final_total,
  prebill_total - CASE WHEN fiscals > 0 THEN fiscal_total ELSE closing_total END AS difference,
  round_even((prebill_total - CASE WHEN fiscals > 0 THEN fiscal_total ELSE closing_total END){_D} / nullif(prebill_total, 0){_D} * 100, 4) AS percent
  FROM agg LEFT JOIN bill USING (transaction_key) LEFT JOIN pay USING (transaction_key) LEFT JOIN f1 USING (transaction_key)),
kl AS MATERIALIZED (SELECT l.*, {_KEY} AS item_key FROM lines_ l),
fin AS (SELECT m.transaction_key, document_id, time FROM m JOIN agg USING (transaction_key) WHERE {_VF} OR (fiscals = 0 AND {_RC} AND total IS NOT NULL)),
bl AS (SELECT transaction_key, item_key, arg_min(description, sequence) AS description, sum(quantity) AS quantity, arg_max(coalesce(modified_unit_price, unit_price), sequence) AS unit_price, sum(line_total) AS total FROM kl JOIN bill ON document_id = prebill_id GROUP BY 1, 2),
al AS (SELECT transaction_key, item_key, sum(quantity) AS quantity, arg_max(coalesce(modified_unit_price, unit_price), strftime(time, '%Y%m%d%H%M%S') || document_id || lpad(sequence::VARCHAR, 6, '0')) AS unit_price, sum(line_total) AS total FROM kl JOIN fin USING (document_id) GROUP BY 1, 2),
bothk AS (SELECT DISTINCT transaction_key FROM bl WHERE transaction_key IN (SELECT transaction_key FROM al)),
ch AS MATERIALIZED (SELECT coalesce(b.transaction_key, a.transaction_key) AS transaction_key, coalesce(b.item_key, a.item_key) AS item_key, CASE WHEN b.item_key IS NULL THEN 'ADDED' WHEN a.item_key IS NULL THEN 'REMOVED' WHEN b.quantity IS DISTINCT FROM a.quantity THEN 'QUANTITY_CHANGED'
  WHEN b.unit_price IS DISTINCT FROM a.unit_price THEN 'PRICE_CHANGED' ELSE 'UNCHANGED' END AS change_type, b.quantity AS before_quantity, a.quantity AS after_quantity, b.unit_price AS before_unit_price, a.unit_price AS after_unit_price, b.total AS before_total, a.total AS after_total
  FROM (SELECT * FROM bl WHERE transaction_key IN (FROM bothk)) b FULL JOIN (SELECT * FROM al WHERE transaction_key IN (FROM bothk)) a ON b.transaction_key = a.transaction_key AND b.item_key = a.item_key)
"""


def sales(spark: SparkSession, sf_dir: str):
    """Canonical tables, members and transactions; the documents are written once, since every branch reads them."""
    c = canonical(spark, sf_dir)
    docs = written(c.documents, "documents")
    c = replace(c, documents=docs, payments=payments(docs))
    members = T.episodes(c.documents)
    return c, members, T.transactions(members, c.payments)


def context(spark: SparkSession, sf_dir: str, changes: bool = False, events: bool = False, stats: bool = False) -> U.Context:
    c, members, tx = sales(spark, sf_dir)
    ch = T.outcome_changes(members, tx, c.lines) if changes or events else None
    ev = T.events(members, c.payments, ch) if events else None
    st = U.operator_stats(tx, tx.where("percent >= 20").select("transaction_key", F.lit("X").alias("rule_code"))) if stats else None
    return U.Context(members, tx, ch, c.lines, ev, st, EVALUATED)


@query("s12_documents", PRE + "SELECT document_id, type, device_id, order_code, table_code, external_code, commercial_reference, gross_total::DOUBLE AS gross_total, net_total::DOUBLE AS net_total, complete, CAST(epoch(captured_at) AS BIGINT) AS captured_at, payload_sha256 FROM documents_")
def s12_documents(spark, sf):
    return canonical(spark, sf).documents.select("document_id", "type", "device_id", "order_code", "table_code", "external_code", "commercial_reference", "gross_total", "net_total", "complete", "captured_at", "payload_sha256")


@query("s12_lines", PRE + "SELECT document_id, sequence::BIGINT AS sequence, item_code, description, quantity::DOUBLE AS quantity, unit_price::DOUBLE AS unit_price, modified_unit_price::DOUBLE AS modified_unit_price, line_total::DOUBLE AS line_total FROM lines_")
def s12_lines(spark, sf):
    return canonical(spark, sf).lines.select("document_id", "sequence", "item_code", "description", "quantity", "unit_price", "modified_unit_price", "line_total")


@query("s13_latest_documents", PRE + "SELECT d.document_id, d.type, v.name AS device_name, v.device_type, coalesce(n, 0) AS n_lines, keys, coalesce(paid, 0)::DOUBLE AS paid FROM documents_ d JOIN devices v USING (device_id) LEFT JOIN (SELECT document_id, count(*) AS n, string_agg(coalesce(item_code, '-'), ',' ORDER BY sequence) AS keys FROM lines_ GROUP BY 1) USING (document_id) LEFT JOIN (SELECT document_id, sum(amount) AS paid FROM payments_ GROUP BY 1) USING (document_id)")
def s13_latest_documents(spark, sf):
    """Nested lines and payments beside the device, by joins instead of a query a document."""
    c = canonical(spark, sf)
    nested = c.lines.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("sequence", F.coalesce("item_code", F.lit("-")).alias("code")))).alias("l"))
    paid = c.payments.groupBy("document_id").agg(F.sum("amount").alias("p"))
    d = c.documents.join(c.devices, "device_id").join(nested, "document_id", "left").join(paid, "document_id", "left")
    return d.select("document_id", "type", F.col("name").alias("device_name"), "device_type", F.coalesce(F.size("l"), F.lit(0)).alias("n_lines"), F.transform("l", lambda x: x["code"]).alias("keys"), F.coalesce("p", F.lit(0)).alias("paid"))


@query("p1_equality_filters", PRE + "SELECT document_id FROM documents_ WHERE type = 'PRE_BILL' AND table_code = 'T7'")
def p1_equality_filters(spark, sf):
    return R.equal_filters(canonical(spark, sf).documents, {"type": "PRE_BILL", "table_code": "T7", "operator_code": "", "order_code": None}).select("document_id")


@query("p2_period", PRE + "SELECT type, count(*) AS n FROM documents_ WHERE captured_at >= TIMESTAMP '1995-01-01' AND captured_at < TIMESTAMP '1996-01-01' GROUP BY 1")
def p2_period(spark, sf):
    return canonical(spark, sf).documents.where(R.period("captured_at", "1995-01-01", "1996-01-01")).groupBy("type").agg(F.count("*").alias("n"))


_JOBS = """j AS (SELECT 'J' || event_id AS job_id, user_id AS session_id, ts AS captured_at, event_type <> 'error' AS capture_complete, event_id % 19 <> 0 AS timeline_complete, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status,
 CASE event_id % 7 WHEN 0 THEN 'PARSE_FAILED' WHEN 1 THEN 'PARSED' ELSE 'IMPORTED' END AS import_status, CASE event_id % 23 WHEN 0 THEN 'VERIFIED_USABLE' ELSE 'PENDING' END AS review_state, event_id % 29 = 0 AS excluded, value, event_type, event_id FROM events)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Print jobs derived from the event log."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.concat(F.lit("J"), "event_id").alias("job_id"), F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("captured_at"), (F.col("event_type") != "error").alias("capture_complete"), (F.col("event_id") % 19 != 0).alias("timeline_complete"),
        F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "view", "INCOMPLETE").otherwise("COMPLETE").alias("status"), F.when(F.col("event_id") % 7 == 0, "PARSE_FAILED").when(F.col("event_id") % 7 == 1, "PARSED").otherwise("IMPORTED").alias("import_status"),
        F.when(F.col("event_id") % 23 == 0, "VERIFIED_USABLE").otherwise("PENDING").alias("review_state"), (F.col("event_id") % 29 == 0).alias("excluded"), "value", "event_type", "event_id",
    )


_P3 = "(capture_complete AND timeline_complete AND status NOT IN ('FAILED', 'INCOMPLETE', 'MALFORMED') AND import_status NOT IN ('FAILED', 'QUARANTINED', 'PARSE_RETRY', 'PARSE_FAILED'))"


@query("p3_complete_jobs", f"WITH {_JOBS} SELECT status, import_status, count(*) FILTER ({_P3}) AS complete, count(*) FILTER (NOT {_P3}) AS incomplete FROM j GROUP BY 1, 2")
def p3_complete_jobs(spark, sf):
    return jobs(spark, sf).groupBy("status", "import_status").agg(F.count_if(R.complete_job()).alias("complete"), F.count_if(~R.complete_job()).alias("incomplete"))


@query("p4_analysable", f"WITH {_JOBS} SELECT job_id FROM j WHERE NOT excluded AND ({_P3} OR review_state = 'VERIFIED_USABLE')")
def p4_analysable(spark, sf):
    return jobs(spark, sf).where(~F.col("excluded") & (R.complete_job() | (F.col("review_state") == "VERIFIED_USABLE"))).select("job_id")


_CONTENT = "(order_code IS NOT NULL OR external_code IS NOT NULL OR external_suffix IS NOT NULL OR commercial_reference IS NOT NULL OR gross_total IS NOT NULL OR net_total IS NOT NULL OR document_id IN (SELECT document_id FROM lines_) OR document_id IN (SELECT document_id FROM payments_))"


@query("p6_operator_visible", PRE + f"SELECT type, count(*) AS n, count(*) FILTER (has) AS with_content, count(*) FILTER (type <> 'DEVICE_RESPONSE' AND (complete OR has)) AS visible FROM (SELECT *, {_CONTENT} AS has FROM documents_) GROUP BY 1")
def p6_operator_visible(spark, sf):
    """P5, P6."""
    c = canonical(spark, sf)
    d = R.has_content(c.payments, c.lines, c.documents)
    return d.groupBy("type").agg(F.count("*").alias("n"), F.count_if("has_content").alias("with_content"), F.count_if((F.col("type") != "DEVICE_RESPONSE") & (F.col("complete") | F.col("has_content"))).alias("visible"))


@query("p8_orders_with_correlation", PRE + "SELECT DISTINCT order_code FROM documents_ WHERE order_code IS NOT NULL AND substr(document_id, 2) IN (SELECT transaction_key FROM agg WHERE documents > 1)")
def p8_orders_with_correlation(spark, sf):
    """Left semi join."""
    _, members, tx = sales(spark, sf)
    return members.where("order_code IS NOT NULL").join(tx.where("documents > 1"), "transaction_key", "left_semi").select("order_code").distinct()


@query("p11_version_fallback", "SELECT o_orderkey, CASE WHEN a IS NULL AND b IS NULL THEN o_orderstatus ELSE a END AS a, CASE WHEN a IS NULL AND b IS NULL THEN o_orderpriority ELSE b END AS b FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'V' END AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'W' END AS b FROM orders)")
def p11_version_fallback(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").withColumns({"a": F.when(F.col("o_orderkey") % 3 == 0, "V"), "b": F.when(F.col("o_orderkey") % 2 == 0, "W")})
    return o.select("o_orderkey", *R.versioned(["a", "b"], ["o_orderstatus", "o_orderpriority"]))


@query("p13_search", PRE + r"SELECT 'document' AS kind, document_id AS id FROM documents_ WHERE document_id ILIKE '%77%' OR coalesce(external_code ILIKE '%77%', FALSE) OR coalesce(table_code ILIKE '%77%', FALSE) OR coalesce(gross_total = 77, FALSE) UNION ALL SELECT 'order', order_code FROM (SELECT DISTINCT order_code FROM documents_ WHERE order_code ILIKE '%77%') UNION ALL SELECT 'device', device_id FROM devices WHERE device_id ILIKE '%77%' OR name ILIKE '%77%'")
def p13_search(spark, sf):
    """Hits of three kinds in one list."""
    c = canonical(spark, sf)
    docs = c.documents.where(R.contains(["document_id", "external_code", "table_code"], "77", ["gross_total"])).select(F.lit("document").alias("kind"), F.col("document_id").alias("id"))
    orders = c.documents.where(R.contains(["order_code"], "77")).select(F.lit("order").alias("kind"), F.col("order_code").alias("id")).distinct()
    dev = c.devices.where(R.contains(["device_id", "name"], "77")).select(F.lit("device").alias("kind"), F.col("device_id").alias("id"))
    return docs.unionByName(orders).unionByName(dev)


@query("p16_economic_close", PRE + f"SELECT document_id, {_RC} AS room_close, {_VF} AS valid_fiscal, (type IN ('CONFORMING_COPY', 'REPRINT', 'DEVICE_RESPONSE')) AS auxiliary, (type = 'PRE_BILL') AS prebill_source FROM m")
def p16_economic_close(spark, sf):
    """P16 to P19."""
    c, members, _ = sales(spark, sf)
    d = P.described(members.select(*c.documents.columns), c.lines)
    return d.select("document_id", T.room_close().alias("room_close"), T.valid_fiscal().alias("valid_fiscal"), F.col("auxiliary"), F.col("baseline").alias("prebill_source"))


@query("p22_reductions", PRE + "SELECT transaction_key, difference::DOUBLE AS difference, percent::DOUBLE AS percent FROM tx WHERE prebill_total > 0 AND (fiscals > 0 OR cancellations > 0 OR closings > 0) AND difference >= 1 AND percent >= 20 ORDER BY difference DESC, transaction_key LIMIT 100")
def p22_reductions(spark, sf):
    """The flagship: largest reductions after the pre-bill."""
    _, _, tx = sales(spark, sf)
    hit = tx.where("prebill_total > 0 AND (fiscals > 0 OR cancellations > 0 OR closings > 0) AND difference >= 1 AND percent >= 20")
    return R.page(hit.select("transaction_key", "difference", "percent"), [F.desc("difference"), "transaction_key"], 100)


@query("p25_document_scope", DOCS + ", held AS MATERIALIZED (SELECT document_id FROM lines_ UNION SELECT document_id FROM payments_), d AS MATERIALIZED (SELECT document_id, complete OR coalesce(order_code, external_code, external_suffix, commercial_reference, gross_total::VARCHAR, net_total::VARCHAR) IS NOT NULL AS seen FROM documents_ WHERE type <> 'PRE_BILL') SELECT d.document_id FROM d LEFT JOIN held h ON d.document_id = h.document_id WHERE seen OR h.document_id IS NOT NULL")
def p25_document_scope(spark, sf):
    c = canonical(spark, sf)
    return R.has_content(c.payments, c.lines, c.documents).where(R.document_scope(exclude="PRE_BILL")).select("document_id")


@query("j4_latest_status", "SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def j4_latest_status(spark, sf):
    return R.latest(spark.read.parquet(f"{sf}/events.parquet"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "ts")


@query("j9_unprocessed", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def j9_unprocessed(spark, sf):
    return R.orphans(spark.read.parquet(f"{sf}/customer.parquet"), spark.read.parquet(f"{sf}/orders.parquet").where("o_totalprice > 250000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


_PAIR_KEYS = "dk AS MATERIALIZED (SELECT document_id, coalesce(document_time, captured_at) AS time, unnest([{'n': 'order', 'v': order_code}, {'n': 'external', 'v': external_code}, {'n': 'table', 'v': table_code}, {'n': 'job', 'v': job_id}, {'n': 'commercial', 'v': coalesce(commercial_reference, CASE WHEN type = 'COMMERCIAL_DOCUMENT' THEN external_code END)}, {'n': 'suffix', 'v': CASE WHEN commercial_reference IS NOT NULL THEN nullif(regexp_extract(commercial_reference, '(?:^|[-/])([0-9]{1,8})$', 1), '') ELSE external_suffix END}]) AS k FROM documents_), cand AS MATERIALIZED (SELECT DISTINCT a.document_id AS a, b.document_id AS b FROM (SELECT * FROM dk WHERE k.v IS NOT NULL) a JOIN (SELECT * FROM dk WHERE k.v IS NOT NULL) b ON a.k = b.k AND a.document_id < b.document_id AND abs(epoch(a.time) - epoch(b.time)) <= 7200)"


@query("j10_candidate_pairs", PRE + ", " + _PAIR_KEYS + " SELECT a, b FROM cand")
def j10_candidate_pairs(spark, sf):
    c = canonical(spark, sf)
    return P.candidates(P.described(c.documents, c.lines.where("false")))  # no key is of lines


@query("j17_same_code_within_a_day", DOCS + ", k AS MATERIALIZED (SELECT document_id, device_id, external_code, epoch(captured_at) AS t FROM documents_ WHERE external_code IS NOT NULL), two AS MATERIALIZED (SELECT a.document_id AS a, b.document_id AS b, a.t AS ta, b.t AS tb FROM k a JOIN k b USING (device_id, external_code)) SELECT a, b FROM two WHERE a < b AND abs(ta - tb) <= 86400")
def j17_same_code_within_a_day(spark, sf):
    """A range join as an equal join: the day bucket and its neighbours."""
    d = canonical(spark, sf).documents.where("external_code IS NOT NULL").select("document_id", "device_id", "external_code", F.unix_timestamp("captured_at").alias("s"))
    left = d.withColumn("day", F.floor(F.col("s") / 86400))
    right = d.select(F.col("document_id").alias("b"), "device_id", "external_code", F.col("s").alias("sb"), F.explode(F.array(*[F.floor(F.col("s") / 86400) + k for k in (-1, 0, 1)])).alias("day"))
    return left.join(right, ["device_id", "external_code", "day"]).where((F.col("document_id") < F.col("b")) & (F.abs(F.col("s") - F.col("sb")) <= 86400)).select(F.col("document_id").alias("a"), "b").distinct()


@query("d1_line_changes", PRE + "SELECT transaction_key, item_key, change_type, before_quantity::DOUBLE AS before_quantity, after_quantity::DOUBLE AS after_quantity, before_unit_price::DOUBLE AS before_unit_price, after_unit_price::DOUBLE AS after_unit_price, before_total::DOUBLE AS before_total, after_total::DOUBLE AS after_total FROM ch")
def d1_line_changes(spark, sf):
    """D1, A15, J15, U4."""
    c = context(spark, sf, changes=True)
    return c.changes.select("transaction_key", "item_key", "change_type", "before_quantity", "after_quantity", "before_unit_price", "after_unit_price", "before_total", "after_total")


@query("a15_engine_lines", PRE + "SELECT document_id, item_key, arg_min(description, sequence) AS description, sum(quantity)::DOUBLE AS quantity, arg_max(coalesce(modified_unit_price, unit_price), sequence)::DOUBLE AS unit_price, sum(line_total)::DOUBLE AS total FROM kl GROUP BY 1, 2")
def a15_engine_lines(spark, sf):
    return L.engine_lines(canonical(spark, sf).lines, ["document_id"], ["sequence"]).select("document_id", "item_key", "description", "quantity", "unit_price", "total")


_VK = "CASE WHEN coalesce(item_code, '') <> '' THEN 'CODE:' || upper(item_code) WHEN coalesce(description, '') <> '' THEN 'DESC:' || upper(description) ELSE 'SEQUENCE:' || sequence END"


@query("a16_view_lines", PRE + f"SELECT document_id, {_VK} AS item_key, arg_min(description, sequence) AS description, sum(quantity)::DOUBLE AS quantity, arg_min(coalesce(modified_unit_price, unit_price), sequence)::DOUBLE AS unit_price, CASE WHEN arg_min(line_total IS NOT NULL, sequence) THEN sum(line_total) END::DOUBLE AS line_total FROM lines_ GROUP BY 1, 2")
def a16_view_lines(spark, sf):
    return L.view_lines(canonical(spark, sf).lines, ["document_id"]).select("document_id", "item_key", "description", "quantity", "unit_price", "line_total")


@query("d2_apply_deltas", PRE + """, s0 AS (SELECT 'H' || substr(document_id, 2) AS document_id, item_key, arg_min(description, sequence) AS description, sum(quantity) AS quantity, arg_max(sequence * 1.5, sequence) AS unit_price, sum(sequence * 2) AS total FROM kl WHERE document_id[1] = 'K' AND 'H' || substr(document_id, 2) IN (SELECT document_id FROM documents_) GROUP BY 1, 2),
dl AS (SELECT document_id, item_key, sum(quantity) AS q FROM kl WHERE document_id[1] = 'H' GROUP BY 1, 2)
SELECT document_id, item_key, description, (quantity + coalesce(q, 0))::DOUBLE AS quantity, unit_price::DOUBLE AS unit_price, (CASE WHEN q IS NULL THEN total ELSE unit_price * (quantity + q) END)::DOUBLE AS line_total, -1::BIGINT AS position FROM s0 LEFT JOIN dl USING (document_id, item_key) WHERE quantity + coalesce(q, 0) > 0
UNION ALL SELECT DISTINCT document_id, 'CODE:NEW', 'Aggiunta', 5, 3.5, 17.5, 2 FROM lines_ WHERE document_id[1] = 'H'""")
def d2_apply_deltas(spark, sf):
    """Kitchen lines after the change ticket's signed quantities, a new line changed at once, and changes of unknown lines."""
    c = canonical(spark, sf)
    key = lambda p: F.concat(F.lit(p), F.substring("document_id", 2, 99))
    change = c.lines.where("document_id LIKE 'H%'")
    kitchen = c.lines.where("document_id LIKE 'K%'").withColumn("document_id", key("H")).join(change.select("document_id").distinct(), "document_id", "left_semi")
    kitchen = kitchen.withColumns({"unit_price": (F.col("sequence") * 1.5).cast(values.MONEY), "line_total": (F.col("sequence") * 2).cast(values.MONEY)})
    state = L.engine_lines(kitchen, ["document_id"], ["sequence"])
    money = lambda x: F.lit(x).cast(values.MONEY)
    deltas = L.engine_lines(change, ["document_id"], ["sequence"]).select("document_id", "item_key", F.lit(1).alias("ordinal"), "description", "quantity", "unit_price", F.col("total").alias("line_total"), F.lit(False).alias("removed"))
    for n, item, q, price in ((2, "CODE:NEW", 3, 3.5), (3, "CODE:NEW", 2, 9), (4, "CODE:UNKNOWN", -1, 1)):
        deltas = deltas.unionByName(change.select("document_id").distinct().select("document_id", F.lit(item).alias("item_key"), F.lit(n).alias("ordinal"), F.lit("Aggiunta").alias("description"), money(q).alias("quantity"), money(price).alias("unit_price"), money(q * price).alias("line_total"), F.lit(False).alias("removed")))
    return L.apply_deltas(state, deltas, ["document_id"])


_SCORES = _PAIR_KEYS + """, f AS MATERIALIZED (SELECT d.*, coalesce(document_time, captured_at) AS time, coalesce(gross_total, net_total) AS total, coalesce(keys, []) AS keys, type IN ('COMMERCIAL_DOCUMENT') OR (type = 'MANAGEMENT_DOCUMENT' AND economic_close) AS closes,
 type IN ('ORDER', 'ORDER_CHANGE', 'KITCHEN_ORDER', 'PRE_BILL', 'MANAGEMENT_DOCUMENT') AS src, type IN ('COMMERCIAL_DOCUMENT', 'REFUND', 'PAYMENT', 'CANCELLATION') AS fol, type IN ('CONFORMING_COPY', 'REPRINT') AS cop, type = 'COMMERCIAL_DOCUMENT' AS fis, type IN ('ORDER', 'KITCHEN_ORDER', 'PRE_BILL') AS opens,
 CASE WHEN type IN ('PRE_BILL', 'MANAGEMENT_DOCUMENT') THEN 'M' WHEN type = 'COMMERCIAL_DOCUMENT' THEN 'C' END AS space FROM documents_ d LEFT JOIN (SELECT document_id, list_distinct(list(item_key)) AS keys FROM kl GROUP BY 1) USING (document_id)),
pr AS (SELECT fa.document_id AS a, fb.document_id AS b, fa AS x, fb AS y, abs(epoch(fb.time) - epoch(fa.time))::BIGINT AS delta, (epoch(fb.time) - epoch(fa.time))::BIGINT AS d, list_has_any(fa.keys, fb.keys) AS shared, coalesce(fa.order_code = fb.order_code, FALSE) AS so, coalesce(fa.table_code = fb.table_code, FALSE) AS st, coalesce(fa.order_reference = fb.order_reference, FALSE) AS sr
 FROM cand JOIN f fa ON cand.a = fa.document_id JOIN f fb ON cand.b = fb.document_id),
cp AS (SELECT *, CASE WHEN x.cop OR y.cop THEN x.fis OR y.fis WHEN x.fis AND y.fis THEN FALSE ELSE (x.src AND y.src) OR (x.src AND y.fol) OR (y.src AND x.fol) END AS fit FROM pr),
gs AS (SELECT *, CASE WHEN fit AND delta <= 7200 THEN least(100, 35 * so::INT + 15 * coalesce(x.space = y.space AND x.external_code = y.external_code, FALSE)::INT + 12 * st::INT + 5 * coalesce(x.operator_code = y.operator_code, FALSE)::INT + 20 * sr::INT
 + CASE WHEN delta <= 120 THEN 12 WHEN delta <= 900 THEN 8 ELSE 4 END + 3 * (CAST(x.time AS DATE) = CAST(y.time AS DATE))::INT + CASE WHEN x.total = y.total THEN 8 WHEN least(x.total, y.total) >= 0 AND x.total IS NOT NULL AND y.total IS NOT NULL AND x.total <> y.total THEN 3 ELSE 0 END
 + CASE WHEN len(x.keys) > 0 AND len(y.keys) > 0 THEN round_even(len(list_intersect(x.keys, y.keys)) * 12.0 / len(list_distinct(list_concat(x.keys, y.keys))), 0)::INT ELSE 0 END + 8 + 2 * (x.device_id = y.device_id)::INT) ELSE 0 END AS general FROM cp),
rl_ AS (SELECT *, CASE WHEN x.type = 'DEVICE_RESPONSE' OR y.type = 'DEVICE_RESPONSE' THEN 'response' WHEN (x.closes AND y.opens AND x.time < y.time) OR (y.closes AND x.opens AND y.time < x.time) THEN 'boundary'
 WHEN coalesce(x.order_code <> y.order_code, FALSE) OR coalesce(x.table_code <> y.table_code, FALSE) OR coalesce(x.order_reference <> y.order_reference, FALSE) THEN 'conflict'
 WHEN delta <= 7200 AND coalesce((x.fis AND (y.cop OR y.type = 'MANAGEMENT_DOCUMENT') AND y.commercial_reference = x.external_code) OR (y.fis AND (x.cop OR x.type = 'MANAGEMENT_DOCUMENT') AND x.commercial_reference = y.external_code), FALSE) THEN 'commercial_reference'
 WHEN st AND shared AND ((x.type = 'PRE_BILL' AND y.fis AND d BETWEEN 0 AND 300) OR (y.type = 'PRE_BILL' AND x.fis AND -d BETWEEN 0 AND 300)) THEN 'table_sale' WHEN x.fis AND y.fis AND delta <= 7200 AND (so OR sr) THEN 'fiscal_siblings'
 WHEN x.device_id = y.device_id AND st AND shared AND ((x.type = 'KITCHEN_ORDER' AND y.type = 'ORDER_CHANGE' AND d BETWEEN 0 AND 300) OR (y.type = 'KITCHEN_ORDER' AND x.type = 'ORDER_CHANGE' AND -d BETWEEN 0 AND 300)) THEN 'table_change'
 WHEN x.type = 'KITCHEN_ORDER' AND y.type = 'KITCHEN_ORDER' AND x.device_id <> y.device_id AND st AND delta <= 30 THEN 'dispatch' ELSE 'general' END AS rule FROM gs),
scored AS MATERIALIZED (SELECT a, b, rule, delta, (CASE rule WHEN 'response' THEN CASE WHEN delta <= 7200 AND x.job_id = y.job_id THEN 90 ELSE 0 END WHEN 'boundary' THEN 0 WHEN 'conflict' THEN 0 WHEN 'commercial_reference' THEN 95 WHEN 'table_sale' THEN 100 WHEN 'fiscal_siblings' THEN 80 WHEN 'table_change' THEN 100 WHEN 'dispatch' THEN 85 ELSE general END)::BIGINT AS score FROM rl_)"""


@query("d3_pair_scores", PRE + ", " + _SCORES + " SELECT a, b, score, rule, delta FROM scored WHERE score > 0")
def d3_pair_scores(spark, sf):
    """D3 to D12 over all candidate pairs, with the rule that decides each."""
    c = canonical(spark, sf)
    d = P.described(c.documents, c.lines)
    return P.scored(d).select("a", "b", "score", "rule", "delta")


@query("d5_reference_links", DOCS + ", c AS MATERIALIZED (SELECT document_id, external_code AS code, table_code, epoch(coalesce(document_time, captured_at)) AS t FROM documents_ WHERE type = 'COMMERCIAL_DOCUMENT' AND external_code IS NOT NULL), k AS MATERIALIZED (SELECT document_id, commercial_reference AS code, table_code, epoch(coalesce(document_time, captured_at)) AS t FROM documents_ WHERE type IN ('CONFORMING_COPY', 'REPRINT') AND commercial_reference IS NOT NULL), two AS MATERIALIZED (SELECT k.document_id AS k, c.document_id AS c, k.t AS tk, c.t AS tc FROM k JOIN c USING (code, table_code)) SELECT least(k, c) AS a, greatest(k, c) AS b FROM two WHERE abs(tk - tc) <= 7200")
def d5_reference_links(spark, sf):
    """A copy and the fiscal document it names."""
    c = canonical(spark, sf)
    d = P.described(c.documents, c.lines)
    return P.scored(d, types=("COMMERCIAL_DOCUMENT", "MANAGEMENT_DOCUMENT", *schema.COPY_TYPES), by=("commercial",), rule="commercial_reference").select("a", "b")


@query("d6_table_sales", PRE + "SELECT least(p.document_id, c.document_id) AS a, greatest(p.document_id, c.document_id) AS b FROM documents_ p JOIN documents_ c ON p.type = 'PRE_BILL' AND c.type = 'COMMERCIAL_DOCUMENT' AND p.order_code = c.order_code AND epoch(c.document_time) - epoch(p.document_time) BETWEEN 0 AND 300 WHERE EXISTS (SELECT 1 FROM kl x JOIN kl y USING (item_key) WHERE x.document_id = p.document_id AND y.document_id = c.document_id)")
def d6_table_sales(spark, sf):
    """D6, J18."""
    c = canonical(spark, sf)
    d = P.described(c.documents, c.lines)
    return P.scored(d, types=("PRE_BILL", "MANAGEMENT_DOCUMENT", "COMMERCIAL_DOCUMENT"), by=("table",), rule="table_sale").select("a", "b")


@query("d11_response_links", DOCS + ", r AS MATERIALIZED (SELECT document_id, job_id FROM documents_ WHERE type = 'DEVICE_RESPONSE'), o AS MATERIALIZED (SELECT document_id, job_id FROM documents_ WHERE type <> 'DEVICE_RESPONSE') SELECT least(r.document_id, o.document_id) AS a, greatest(r.document_id, o.document_id) AS b, 90::BIGINT AS score FROM r JOIN o USING (job_id)")
def d11_response_links(spark, sf):
    c = canonical(spark, sf)
    d = P.described(c.documents, c.lines)
    return P.scored(d, by=("job",), rule="response").select("a", "b", "score")


@query("d13_clusters", PRE + "SELECT document_id, min(document_id) OVER (PARTITION BY transaction_key) AS cluster FROM m")
def d13_clusters(spark, sf):
    """Constrained clusters of all documents."""
    c = canonical(spark, sf)
    d = P.described(c.documents, c.lines)
    return P.clusters(d, P.scored(d, P.MINIMUM))


@query("d14_transactions", PRE + "SELECT transaction_key, documents, CAST(epoch(opened_at) AS BIGINT) AS opened_at, prebill_id, prebill_total::DOUBLE AS prebill_total, fiscal_total::DOUBLE AS fiscal_total, final_total::DOUBLE AS final_total, payment_total::DOUBLE AS payment_total, difference::DOUBLE AS difference, percent::DOUBLE AS percent FROM tx")
def d14_transactions(spark, sf):
    """D14, A18 to A21, F7, F8, F12."""
    return sales(spark, sf)[2].select("transaction_key", "documents", "opened_at", "prebill_id", "prebill_total", "fiscal_total", "final_total", "payment_total", "difference", "percent")


@query("d15_fingerprints", PRE + """SELECT transaction_key, sha256('[' || string_agg(j, ',' ORDER BY j) || ']') AS input_fingerprint FROM (SELECT transaction_key, '{"id":"' || document_id || '","record":"' || payload_sha256 || '"}' AS j FROM m) GROUP BY 1""")
def d15_fingerprints(spark, sf):
    """D15, F28."""
    return T.fingerprint(sales(spark, sf)[1])


@query("d16_member_roles", PRE + "SELECT document_id, CASE WHEN type IN ('ORDER', 'ORDER_CHANGE', 'KITCHEN_ORDER', 'PRE_BILL', 'MANAGEMENT_DOCUMENT') THEN 'SOURCE' WHEN type = 'COMMERCIAL_DOCUMENT' THEN 'FISCAL' WHEN type = 'PAYMENT' THEN 'PAYMENT' WHEN type = 'DEVICE_RESPONSE' THEN 'RESPONSE' ELSE 'AUXILIARY' END AS role FROM documents_")
def d16_member_roles(spark, sf):
    return canonical(spark, sf).documents.select("document_id", T.member_role().alias("role"))


_SRC = "type IN ('ORDER', 'ORDER_CHANGE', 'KITCHEN_ORDER', 'PRE_BILL', 'MANAGEMENT_DOCUMENT')"


@query("d17_orders", PRE + f"SELECT transaction_key, transaction_key AS order_code, o.order_device, strftime((o.st AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome', '%Y-%m-%d') AS business_date, CASE WHEN nf > 0 OR nr > 0 THEN 'CLOSED' WHEN cancellations > 0 THEN 'VOIDED' ELSE 'OPEN' END AS status, CASE WHEN nf > 0 THEN fiscal_total WHEN nr > 0 THEN final_total ELSE prebill_total END::DOUBLE AS gross_total FROM tx JOIN (SELECT transaction_key, arg_min(device_id, strftime(time, '%Y%m%d%H%M%S') || document_id) FILTER ({_SRC}) AS order_device, min(time) FILTER ({_SRC}) AS st, count(*) FILTER (type = 'COMMERCIAL_DOCUMENT') AS nf, count(*) FILTER ({_RC}) AS nr FROM m GROUP BY 1) o USING (transaction_key)")
def d17_orders(spark, sf):
    c, members, tx = sales(spark, sf)
    return T.orders(members, tx).select("transaction_key", "order_code", "order_device", "business_date", "status", "gross_total")


_EV = f"""ev AS (SELECT transaction_key, min(time) AS time, 'ORDER_CREATED' AS event_type, arg_min(document_id, strftime(time, '%Y%m%d%H%M%S') || document_id) AS document_id, '' AS detail FROM m WHERE {_SRC} AND type <> 'ORDER_CHANGE' GROUP BY 1
UNION ALL SELECT transaction_key, time, CASE type WHEN 'PRE_BILL' THEN 'PRE_BILL_PRINTED' WHEN 'COMMERCIAL_DOCUMENT' THEN 'FISCAL_DOCUMENT_ISSUED' WHEN 'CANCELLATION' THEN 'ORDER_VOIDED' ELSE 'COPY_PRINTED' END, document_id, '' FROM m WHERE type IN ('PRE_BILL', 'COMMERCIAL_DOCUMENT', 'CANCELLATION', 'CONFORMING_COPY', 'REPRINT')
UNION ALL SELECT transaction_key, time, 'PAYMENT_RECORDED', document_id, 'payments' FROM m WHERE document_id IN (SELECT document_id FROM payments_)
UNION ALL SELECT transaction_key, time, 'ORDER_CLOSED', document_id, '' FROM m JOIN (SELECT transaction_key, max(document_id) FILTER (type = 'COMMERCIAL_DOCUMENT' AND complete) AS c, max(document_id) FILTER ({_RC}) AS r FROM m GROUP BY 1) USING (transaction_key) WHERE document_id = coalesce(c, r)
UNION ALL SELECT ch.transaction_key, m.time, CASE change_type WHEN 'ADDED' THEN 'ITEM_ADDED' WHEN 'REMOVED' THEN 'ITEM_REMOVED' ELSE change_type END, m.document_id, item_key FROM ch JOIN m USING (transaction_key) JOIN (SELECT transaction_key, max(document_id) FILTER (type = 'COMMERCIAL_DOCUMENT' AND complete) AS c, max(document_id) FILTER ({_RC}) AS r FROM m GROUP BY 1) z USING (transaction_key) WHERE m.document_id = coalesce(z.c, z.r) AND change_type <> 'UNCHANGED')"""


@query("d18_order_events", PRE + ", " + _EV + " SELECT transaction_key, CAST(epoch(time) AS BIGINT) AS time, event_type, document_id, detail, row_number() OVER (PARTITION BY transaction_key ORDER BY time, event_type, document_id, detail) AS sequence FROM ev")
def d18_order_events(spark, sf):
    """The events of every order, numbered."""
    return T.numbered(context(spark, sf, events=True).events).select("transaction_key", "time", "event_type", "document_id", "detail", "sequence")


@query("d20_price_attribution", PRE + """, t AS (SELECT substr(document_id, 2) AS tk, document_id || ':' || sequence AS target, item_code AS code, lower(description) AS descr, quantity AS tq FROM lines_ WHERE document_id[1] IN ('K', 'H')),
s AS (SELECT substr(document_id, 2) AS tk, document_id || ':' || sequence AS source, document_id AS sd, item_code AS code, lower(description) AS descr, quantity AS sq, unit_price AS unit, line_total AS total FROM lines_ WHERE document_id[1] IN ('P', 'C') AND document_id IN (SELECT document_id FROM documents_ WHERE complete)),
c AS (SELECT t.tk, target, source, sd, unit, total, 0 AS basis FROM t JOIN s ON t.tk = s.tk AND t.code = s.code AND abs(tq) = abs(sq) UNION ALL SELECT t.tk, target, source, sd, unit, total, 1 FROM t JOIN s ON t.tk = s.tk AND t.descr = s.descr AND abs(tq) = abs(sq)),
bb AS (SELECT * FROM c QUALIFY basis = min(basis) OVER (PARTITION BY tk, target, sd)),
g AS (SELECT *, count(*) OVER w AS n, (SELECT 1) AS one FROM bb WINDOW w AS (PARTITION BY tk, target, sd)),
h AS (SELECT tk, target, sd, count(DISTINCT unit) AS u, count(DISTINCT total) AS tt FROM bb GROUP BY 1, 2, 3)
SELECT g.tk AS transaction_key, g.target, source, CASE basis WHEN 0 THEN 'ITEM_CODE_EXACT' ELSE 'DESCRIPTION_NORMALIZED_EXACT' END AS basis, unit::DOUBLE AS unit_price, CASE WHEN n = 1 THEN 'RESOLVED' WHEN u = 1 AND tt <= 1 THEN 'AGREED' ELSE 'AMBIGUOUS' END AS status,
(CASE WHEN n = 1 THEN CASE basis WHEN 0 THEN 98 ELSE 90 END WHEN u = 1 AND tt <= 1 THEN CASE basis WHEN 0 THEN 99 ELSE 91 END ELSE 49 END)::BIGINT AS confidence_points FROM g JOIN h ON g.tk = h.tk AND g.target = h.target AND g.sd = h.sd""")
def d20_price_attribution(spark, sf):
    """Prices of kitchen lines from pre-bill and fiscal lines."""
    c = canonical(spark, sf)
    ln = c.lines.withColumns({"transaction_id": F.substring("document_id", 2, 99), "line_id": F.concat_ws(":", "document_id", "sequence")})
    targets = ln.where(F.col("document_id").substr(1, 1).isin("K", "H") & F.col("unit_price").isNull())
    sources = ln.where(F.col("document_id").substr(1, 1).isin("P", "C")).join(c.documents.where("complete").select("document_id"), "document_id", "left_semi")
    return L.attribute_prices(targets, sources).select(F.col("transaction_id").alias("transaction_key"), "target", "source", "basis", "unit_price", "status", "confidence_points")


@query("d27_evidence_roles", PRE + f"SELECT document_id, CASE WHEN document_id = prebill_id THEN 'PRE_BILL' WHEN {_VF} THEN 'COMMERCIAL_CLOSE' WHEN {_RC} THEN 'NON_FISCAL_CLOSE' ELSE 'SUPPORTING' END AS role FROM m JOIN (SELECT transaction_key, prebill_id FROM tx) USING (transaction_key)")
def d27_evidence_roles(spark, sf):
    _, members, tx = sales(spark, sf)
    return members.join(tx.select("transaction_key", "prebill_id"), "transaction_key").select("document_id", T.evidence_role().alias("role"))


def _rule(code: str, **need):
    def run(spark, sf):
        return U.finding(context(spark, sf, **need), U.registry()[code]).select("transaction_key", "rule_code", "severity", "score", "confidence", "hits")

    return run


def _sql(code: str, severity: str, score: str, confidence: str, hits: str, source: str) -> str:
    return PRE + f" SELECT transaction_key, '{code}' AS rule_code, '{severity}' AS severity, least(100, {score})::BIGINT AS score, ({confidence})::BIGINT AS confidence, ({hits})::BIGINT AS hits FROM {source}"


_PCT = "CAST(percent AS DECIMAL(15,4))"
query("r1_modifica_post_preconto", _sql("MODIFICA_POST_PRECONTO", "HIGH", f"70 + CAST(floor({_PCT} * 0.3) AS INTEGER)", "CASE WHEN documents > 1 THEN 95 ELSE 70 END", "1", "tx WHERE prebill_total > 0 AND (fiscals > 0 OR cancellations > 0 OR closings > 0) AND difference >= 1 AND percent >= 20"))(_rule("MODIFICA_POST_PRECONTO"))
query("r2_prebill_fiscal_amount_drop", _sql("PREBILL_FISCAL_AMOUNT_DROP", "HIGH", f"60 + CAST(floor({_PCT} * 0.6) AS INTEGER)", "CASE WHEN documents > 1 THEN 95 ELSE 65 END", "1", "tx WHERE prebill_total > 0 AND fiscals > 0 AND difference >= 1 AND percent >= 20"))(_rule("PREBILL_FISCAL_AMOUNT_DROP"))
query("r3_item_removed", _sql("ITEM_REMOVED_AFTER_PREBILL", "HIGH", "65 + 8 * n", "90", "n", "(SELECT transaction_key, count(*) AS n FROM ch WHERE change_type = 'REMOVED' GROUP BY 1)"))(_rule("ITEM_REMOVED_AFTER_PREBILL", changes=True))
query("r4_price_reduced", _sql("PRICE_REDUCED_AFTER_PREBILL", "HIGH", "65 + 10 * n", "90", "n", "(SELECT transaction_key, count(*) AS n FROM ch WHERE change_type NOT IN ('ADDED', 'REMOVED') AND after_unit_price < before_unit_price GROUP BY 1)"))(_rule("PRICE_REDUCED_AFTER_PREBILL", changes=True))


@query("r5_extreme_price_change", PRE + " SELECT transaction_key, 'EXTREME_PRICE_CHANGE' AS rule_code, least(100, 75 + CAST(floor(CAST(d AS DECIMAL(15,4)) / 5) AS INTEGER))::BIGINT AS score FROM (SELECT transaction_key, max(round_even((before_unit_price - after_unit_price)::DOUBLE / before_unit_price::DOUBLE * 100, 4)) AS d FROM ch WHERE before_unit_price > 0 AND after_unit_price < before_unit_price GROUP BY 1) WHERE d >= 50")
def r5_extreme_price_change(spark, sf):
    """With the threshold at 50 percent, so that halved prices count."""
    return U.finding(context(spark, sf, changes=True), U.configured("EXTREME_PRICE_CHANGE", minimum_percent=50)).select("transaction_key", "rule_code", "score")


query("r6_same_reference", _sql("SAME_REFERENCE_DIFFERENT_AMOUNT", "HIGH", "65 + CAST(floor(abs(difference)) AS INTEGER)", "90", "1", "tx WHERE prebill_total IS NOT NULL AND fiscals > 0 AND abs(difference) >= 1"))(_rule("SAME_REFERENCE_DIFFERENT_AMOUNT"))
query("r7_order_without_close", _sql("ORDER_WITHOUT_FISCAL_CLOSE", "MEDIUM", "70", "75", "1", "tx WHERE prebill_id IS NOT NULL AND fiscals = 0 AND closings = 0"))(_rule("ORDER_WITHOUT_FISCAL_CLOSE"))


@query("r8_fiscal_without_source", PRE + "SELECT substr(document_id, 2) AS transaction_key, 'FISCAL_WITHOUT_SOURCE_ORDER' AS rule_code, 65::BIGINT AS score FROM documents_ WHERE type = 'COMMERCIAL_DOCUMENT' AND CAST(order_code AS BIGINT) % 8 = 1")
def r8_fiscal_without_source(spark, sf):
    """Over documents of which every eighth order's sources were lost."""
    c = context(spark, sf)
    lost = F.col("transaction_key").cast("bigint") % 8 == 1
    left = U.Context(c.members.where(~(lost & F.col("type").isin(*schema.SOURCE_TYPES))), c.transactions, None, c.lines, None)
    return U.finding(left, U.registry()["FISCAL_WITHOUT_SOURCE_ORDER"]).select("transaction_key", "rule_code", "score")


@query("r9_excessive_void", PRE + ", " + _EV + " SELECT transaction_key, 'EXCESSIVE_VOID_OR_CANCELLATION' AS rule_code, least(100, 60 + 8 * n)::BIGINT AS score, n AS hits FROM (SELECT transaction_key, count(*) FILTER (event_type IN ('ITEM_REMOVED', 'ORDER_VOIDED')) AS n FROM ev GROUP BY 1) WHERE n >= 1")
def r9_excessive_void(spark, sf):
    """A24 with the least count at one."""
    return U.finding(context(spark, sf, events=True), U.configured("EXCESSIVE_VOID_OR_CANCELLATION", minimum_count=1)).select("transaction_key", "rule_code", "score", "hits")


query("r10_copies", _sql("REPRINT_OR_COPY_ANOMALY", "MEDIUM", "55 + 8 * n", "90", "n", "(SELECT transaction_key, count(*) AS n FROM m WHERE type IN ('CONFORMING_COPY', 'REPRINT') GROUP BY 1) WHERE n > 2"))(_rule("REPRINT_OR_COPY_ANOMALY"))


@query("r11_sequence_gap", PRE + ", g AS (SELECT *, lead(n) OVER w AS after, lead(document_id) OVER w AS after_id, lead(transaction_key) OVER w AS after_key FROM (SELECT *, CAST(regexp_extract(external_code, '(\\d+)$', 1) AS BIGINT) AS n, regexp_extract(external_code, '^(.*?)(\\d+)$', 1) AS pfx FROM m WHERE regexp_matches(external_code, '\\d$')) WINDOW w AS (PARTITION BY device_id, type, CAST(time AS DATE), pfx ORDER BY n, document_id)), e AS (SELECT unnest(list_distinct([transaction_key, after_key])) AS key, least(document_id, after_id) AS least FROM g WHERE after - n > 1), p AS (SELECT key, count(*) AS hits, min(least) AS least FROM e GROUP BY 1) SELECT key AS transaction_key, least(100, 65 + 10 * hits)::BIGINT AS score, hits FROM p WHERE substr(least, 2) = key")
def r11_sequence_gap(spark, sf):
    """W3, F13."""
    return U.finding(context(spark, sf), U.registry()["DOCUMENT_SEQUENCE_GAP"]).select("transaction_key", "score", "hits")


@query("r12_duplicates", PRE + "SELECT transaction_key, 80::BIGINT AS score, 1::BIGINT AS hits FROM m WHERE type = 'COMMERCIAL_DOCUMENT' AND CAST(transaction_key AS BIGINT) % 40 = 0")
def r12_duplicates(spark, sf):
    """A25, with the fiscal document of every fortieth order sent again by another job."""
    c = context(spark, sf)
    twins = c.members.where((F.col("type") == "COMMERCIAL_DOCUMENT") & (F.col("transaction_key").cast("bigint") % 40 == 0)).withColumns({"document_id": F.concat(F.lit("Z"), "transaction_key"), "job_id": F.concat(F.lit("JZ"), "transaction_key")})
    return U.finding(U.Context(c.members.unionByName(twins), c.transactions, None, c.lines, None), U.registry()["DUPLICATE_DOCUMENT"]).select("transaction_key", "score", "hits")


@query("r13_late_modification", PRE + "SELECT transaction_key, least(100, 65 + 8)::BIGINT AS score, 1::BIGINT AS hits FROM tx WHERE CAST(transaction_key AS BIGINT) % 12 = 0 AND fiscals > 0")
def r13_late_modification(spark, sf):
    """With a change event one minute after the fiscal document for every change ticket."""
    c = context(spark, sf, events=True)
    late = c.members.where("type = 'ORDER_CHANGE'").join(c.transactions.select("transaction_key", "first_fiscal_at"), "transaction_key").select("transaction_key", (F.coalesce("first_fiscal_at", "time") + F.make_dt_interval(mins=F.lit(1))).alias("time"), F.lit("QUANTITY_CHANGED").alias("event_type"), "document_id", F.lit("late").alias("detail"))
    more = U.Context(c.members, c.transactions, c.changes, c.lines, c.events.unionByName(late))
    return U.finding(more, U.registry()["LATE_ORDER_MODIFICATION"]).select("transaction_key", "score", "hits")


@query("r14_non_positive_item", PRE + "SELECT transaction_key, least(100, 65 + 8 * n)::BIGINT AS score, n AS hits FROM (SELECT transaction_key, count(*) AS n FROM lines_ JOIN m USING (document_id) WHERE type IN ('PRE_BILL', 'COMMERCIAL_DOCUMENT') AND sequence = 2 AND (CAST(transaction_key AS BIGINT)) % 5 = 0 GROUP BY 1)")
def r14_non_positive_item(spark, sf):
    """With the second line of every fifth order given away."""
    c = context(spark, sf)
    free = (F.col("sequence") == 2) & (F.substring("document_id", 2, 99).cast("bigint") % 5 == 0)
    ln = c.lines.withColumn("line_total", F.when(free, F.lit(0).cast(values.MONEY)).otherwise(F.col("line_total")))
    return U.finding(U.Context(c.members, c.transactions, None, ln, None), U.registry()["NEGATIVE_OR_ZERO_VALUE_ITEM"]).select("transaction_key", "score", "hits")


@query("r15_total_line_mismatch", PRE + "SELECT transaction_key, least(100, 65 + 10 * n)::BIGINT AS score, n AS hits FROM (SELECT transaction_key, count(*) AS n FROM m JOIN (SELECT document_id, sum(line_total) AS s, count(*) FILTER (line_total IS NULL) AS gaps FROM lines_ GROUP BY 1) USING (document_id) WHERE gaps = 0 AND complete AND total IS NOT NULL AND type IN ('PRE_BILL', 'COMMERCIAL_DOCUMENT') AND abs(total - s) > 0.01 GROUP BY 1)")
def r15_total_line_mismatch(spark, sf):
    return U.finding(context(spark, sf), U.registry()["TOTAL_LINE_MISMATCH"]).select("transaction_key", "score", "hits")


@query("r16_payment_mismatch", PRE + "SELECT transaction_key, least(100, 70 + CAST(floor(abs(fiscal_total - payment_total)) AS INTEGER))::BIGINT AS score FROM tx WHERE payment_records > 0 AND transaction_key IN (SELECT transaction_key FROM m WHERE type = 'COMMERCIAL_DOCUMENT') AND abs(fiscal_total - payment_total) > 0.01")
def r16_payment_mismatch(spark, sf):
    return U.finding(context(spark, sf), U.registry()["PAYMENT_TOTAL_MISMATCH"]).select("transaction_key", "score")


@query("r17_operator_pattern", PRE + ", st AS (SELECT operator_code, count(*) AS n, count(*) FILTER (percent >= 20) AS bad FROM tx GROUP BY 1) SELECT transaction_key, least(100, 50 + CAST(floor(bad::DOUBLE / n * 100) AS INTEGER))::BIGINT AS score FROM tx JOIN st USING (operator_code) WHERE n >= 20 AND bad::DOUBLE / n >= 0.3")
def r17_operator_pattern(spark, sf):
    return U.finding(context(spark, sf, stats=True), U.registry()["UNUSUAL_OPERATOR_PATTERN"]).select("transaction_key", "score")


@query("a17_operator_stats", PRE + "SELECT operator_code, count(*) AS transactions_, count(*) FILTER (percent >= 20) AS anomalous, sum(cancellations)::BIGINT AS voids FROM tx GROUP BY 1")
def a17_operator_stats(spark, sf):
    return context(spark, sf, stats=True).operator_stats.select("operator_code", "transactions_", "anomalous", F.col("voids").cast("bigint").alias("voids"))


_R1 = "prebill_total > 0 AND (fiscals > 0 OR cancellations > 0 OR closings > 0) AND difference >= 1 AND percent >= 20"


@query("d21_primary_hides_symptoms", PRE + f"SELECT rule_code, count(*) AS n FROM (SELECT 'MODIFICA_POST_PRECONTO' AS rule_code FROM tx WHERE {_R1} UNION ALL SELECT 'REPRINT_OR_COPY_ANOMALY' FROM (SELECT transaction_key FROM m WHERE type IN ('CONFORMING_COPY', 'REPRINT') GROUP BY 1 HAVING count(*) > 2) UNION ALL SELECT 'ORDER_WITHOUT_FISCAL_CLOSE' FROM tx WHERE prebill_id IS NOT NULL AND fiscals = 0 AND closings = 0) GROUP BY 1")
def d21_primary_hides_symptoms(spark, sf):
    """Four rules together; the amount drop gives way to the primary rule."""
    keep = [U.registry()[x] for x in ("MODIFICA_POST_PRECONTO", "PREBILL_FISCAL_AMOUNT_DROP", "REPRINT_OR_COPY_ANOMALY", "ORDER_WITHOUT_FISCAL_CLOSE")]
    return U.evaluate(U.pinned(context(spark, sf)), tuple(keep)).groupBy("rule_code").agg(F.count("*").alias("n"))


_ALL = f"""p AS (SELECT transaction_key, prebill_total FROM tx), one AS (
SELECT transaction_key, 'MODIFICA_POST_PRECONTO' AS rule_code, least(100, 70 + CAST(floor({_PCT} * 0.3) AS INTEGER))::BIGINT AS score, 1::BIGINT AS hits FROM tx WHERE prebill_total > 0 AND (fiscals > 0 OR cancellations > 0 OR closings > 0) AND difference >= 1 AND percent >= 20
UNION ALL SELECT transaction_key, 'ORDER_WITHOUT_FISCAL_CLOSE', 70, 1 FROM tx WHERE prebill_id IS NOT NULL AND fiscals = 0 AND closings = 0
UNION ALL SELECT transaction_key, 'EXCESSIVE_VOID_OR_CANCELLATION', least(100, 60 + 8 * n), n FROM (SELECT transaction_key, count(*) FILTER (event_type IN ('ITEM_REMOVED', 'ORDER_VOIDED')) AS n FROM ev GROUP BY 1) WHERE n >= 3
UNION ALL SELECT transaction_key, 'REPRINT_OR_COPY_ANOMALY', 55 + 8 * n, n FROM (SELECT transaction_key, count(*) AS n FROM m WHERE type IN ('CONFORMING_COPY', 'REPRINT') GROUP BY 1) WHERE n > 2
UNION ALL SELECT transaction_key, 'TOTAL_LINE_MISMATCH', least(100, 65 + 10 * n), n FROM (SELECT transaction_key, count(*) AS n FROM m JOIN (SELECT document_id, sum(line_total) AS s, count(*) FILTER (line_total IS NULL) AS gaps FROM lines_ GROUP BY 1) USING (document_id) WHERE gaps = 0 AND complete AND total IS NOT NULL AND type IN ('PRE_BILL', 'COMMERCIAL_DOCUMENT') AND abs(total - s) > 0.01 GROUP BY 1)
UNION ALL SELECT transaction_key, 'PAYMENT_TOTAL_MISMATCH', least(100, 70 + CAST(floor(abs(fiscal_total - payment_total)) AS INTEGER)), 1 FROM tx WHERE payment_records > 0 AND transaction_key IN (SELECT transaction_key FROM m WHERE type = 'COMMERCIAL_DOCUMENT') AND abs(fiscal_total - payment_total) > 0.01
UNION ALL SELECT transaction_key, 'UNUSUAL_OPERATOR_PATTERN', least(100, 50 + CAST(floor(bad::DOUBLE / n * 100) AS INTEGER)), 1 FROM tx JOIN (SELECT operator_code, count(*) AS n, count(*) FILTER (percent >= 20) AS bad FROM tx GROUP BY 1) USING (operator_code) WHERE n >= 20 AND bad::DOUBLE / n >= 0.3
UNION ALL SELECT key, 'DOCUMENT_SEQUENCE_GAP', least(100, 65 + 10 * hits), hits FROM (SELECT key, count(*) AS hits, min(least) AS least FROM (SELECT unnest(list_distinct([transaction_key, after_key])) AS key, least(document_id, after_id) AS least FROM (SELECT *, lead(n) OVER w AS after, lead(document_id) OVER w AS after_id, lead(transaction_key) OVER w AS after_key FROM (SELECT *, CAST(regexp_extract(external_code, '(\\d+)$', 1) AS BIGINT) AS n, regexp_extract(external_code, '^(.*?)(\\d+)$', 1) AS pfx FROM m WHERE regexp_matches(external_code, '\\d$')) WINDOW w AS (PARTITION BY device_id, type, CAST(time AS DATE), pfx ORDER BY n, document_id)) WHERE after - n > 1) GROUP BY 1) WHERE substr(least, 2) = key
UNION ALL SELECT transaction_key, 'DUPLICATE_DOCUMENT', least(100, 70 + 10 * hits), hits FROM (SELECT transaction_key, count(DISTINCT g) AS hits, min(lo) AS lo, list(document_id) AS mine FROM (SELECT *, count(DISTINCT job_id) OVER (PARTITION BY g) AS jobs, min(document_id) OVER (PARTITION BY g) AS lo FROM (SELECT *, (device_id, type, CAST(time AS DATE), coalesce('CODE:' || external_code, 'HASH:' || payload_sha256)) AS g FROM m WHERE type NOT IN ('CONFORMING_COPY', 'REPRINT', 'DEVICE_RESPONSE'))) WHERE jobs > 1 GROUP BY 1) WHERE list_contains(mine, lo))"""


@query("d21_all_rules", PRE + ", " + _EV + ", " + _ALL + " SELECT transaction_key, rule_code, score, hits FROM one")
def d21_all_rules(spark, sf):
    """All seventeen rules at once."""
    return U.evaluate(U.pinned(context(spark, sf, changes=True, events=True, stats=True))).select("transaction_key", "rule_code", "score", "hits")


@query("j11_whitelist", PRE + f"SELECT transaction_key, CASE WHEN operator_code = 'OP3' THEN 'w1' WHEN CAST(transaction_key AS BIGINT) % 7 = 0 THEN 'w2' END AS whitelist_id FROM tx WHERE {_R1}")
def j11_whitelist(spark, sf):
    """The first matching entry by id."""
    c = context(spark, sf)
    found = U.finding(c, U.registry()[U.PRIMARY])
    entries = spark.createDataFrame([("w1", None, "OPERATOR", " op3 ", "2020-01-01", None), ("w3", "OTHER", "GLOBAL", "*", "2020-01-01", None), ("w0", None, "GLOBAL", "*", "2020-01-01", "2021-01-01")], "id string, rule_code string, scope string, scope_value string, valid_from string, valid_until string")
    some = c.transactions.where(F.col("transaction_key").cast("bigint") % 7 == 0).select(F.lit("w2").alias("id"), F.lit(U.PRIMARY).alias("rule_code"), F.lit("TRANSACTION").alias("scope"), F.col("transaction_key").alias("scope_value"), F.lit("2020-01-01").alias("valid_from"), F.lit(None).cast("string").alias("valid_until"))
    white = entries.unionByName(some).withColumns({"valid_from": F.to_timestamp("valid_from"), "valid_until": F.to_timestamp("valid_until")})
    return U.suppress(found, white, c.members, EVALUATED).select("transaction_key", "whitelist_id")


_AL = f"alr AS (SELECT 'A' || transaction_key AS alert_id, transaction_key, 'MODIFICA_POST_PRECONTO' AS rule_code, 'HIGH' AS severity, difference, opened_at, CASE CAST(transaction_key AS BIGINT) % 6 WHEN 0 THEN 'FALSE_POSITIVE' WHEN 1 THEN 'JUSTIFIED' WHEN 2 THEN 'CONFIRMED' ELSE 'OPEN' END AS status FROM tx WHERE {_R1} UNION ALL SELECT 'B' || transaction_key, transaction_key, 'PREBILL_FISCAL_AMOUNT_DROP', 'CRITICAL', difference, opened_at, CASE CAST(transaction_key AS BIGINT) % 6 WHEN 0 THEN 'FALSE_POSITIVE' WHEN 1 THEN 'JUSTIFIED' WHEN 2 THEN 'CONFIRMED' ELSE 'OPEN' END FROM tx WHERE prebill_total > 0 AND fiscals > 0 AND difference >= 1 AND percent >= 20)"


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored alerts of the two economic rules, with a status by order."""
    c = context(spark, sf_dir)
    found = U.finding(c, U.registry()[U.PRIMARY]).withColumn("p", F.lit("A")).unionByName(U.finding(c, U.configured(U.COMPAT)).withColumn("severity", F.lit("CRITICAL")).withColumn("p", F.lit("B")))
    k = F.col("transaction_key").cast("bigint") % 6
    status = F.when(k == 0, "FALSE_POSITIVE").when(k == 1, "JUSTIFIED").when(k == 2, "CONFIRMED").otherwise("OPEN")
    return found.join(c.transactions.select("transaction_key", "difference", "opened_at"), "transaction_key").select(F.concat("p", "transaction_key").alias("alert_id"), "transaction_key", "rule_code", "severity", "difference", "opened_at", status.alias("status"))


@query("a5_economic_episodes", PRE + ", " + _AL + ", e AS (SELECT transaction_key, max(difference) FILTER (rule_code = 'MODIFICA_POST_PRECONTO') AS p, max(difference) FILTER (rule_code = 'PREBILL_FISCAL_AMOUNT_DROP') AS c FROM alr WHERE status IN ('OPEN', 'UNDER_REVIEW', 'CONFIRMED') GROUP BY 1) SELECT count(*) AS episodes, sum(coalesce(p, c))::DOUBLE AS difference FROM e WHERE coalesce(p, c) > 0")
def a5_economic_episodes(spark, sf):
    """A4, A5: one episode counts once, by the primary rule if it has it."""
    a = alerts(spark, sf).where(F.col("status").isin(*schema.OPERATIONAL_STATES))
    e = a.groupBy("transaction_key").agg(F.max(F.when(F.col("rule_code") == U.PRIMARY, F.col("difference"))).alias("p"), F.max(F.when(F.col("rule_code") == U.COMPAT, F.col("difference"))).alias("c")).withColumn("d", F.coalesce("p", "c"))
    return e.where("d > 0").agg(F.count("*").alias("episodes"), F.sum("d").alias("difference"))


@query("a10_alert_trend", PRE + ", " + _AL + " SELECT strftime(opened_at, '%Y-%m-%d') AS day, count(*) AS n FROM alr WHERE status IN ('OPEN', 'UNDER_REVIEW', 'CONFIRMED') GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def a10_alert_trend(spark, sf):
    a = alerts(spark, sf).where(F.col("status").isin(*schema.OPERATIONAL_STATES))
    return a.groupBy(F.to_date("opened_at").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(30)


@query("p10_alert_scopes", PRE + ", " + _AL + " SELECT status, CASE WHEN status IN ('OPEN', 'UNDER_REVIEW', 'CONFIRMED') THEN 'operational' ELSE 'archive' END AS view, count(*) AS n FROM alr GROUP BY 1, 2")
def p10_alert_scopes(spark, sf):
    view = F.when(F.col("status").isin(*schema.OPERATIONAL_STATES), "operational").when(F.col("status").isin(*schema.ARCHIVE_STATES), "archive")
    return alerts(spark, sf).groupBy("status", view.alias("view")).agg(F.count("*").alias("n"))


@query("d33_canonical_alerts", PRE + ", " + _AL + " SELECT alert_id, row_number() OVER w = 1 AS is_canonical, first_value(alert_id) OVER w AS canonical_id FROM alr WINDOW w AS (PARTITION BY transaction_key ORDER BY opened_at, alert_id)")
def d33_canonical_alerts(spark, sf):
    return U.canonical_alerts(alerts(spark, sf), ["transaction_key"], ["opened_at", "alert_id"]).select("alert_id", "is_canonical", "canonical_id")


@query("p9_alert_device", PRE + ", " + _AL + " SELECT alert_id FROM alr WHERE transaction_key IN (SELECT transaction_key FROM m WHERE device_id = 'dev_3') AND transaction_key IN (SELECT transaction_key FROM m WHERE operator_code = 'OP2')")
def p9_alert_device(spark, sf):
    """Alerts with a paper of the device and one, maybe another, of the operator."""
    _, members, _ = sales(spark, sf)
    a = alerts(spark, sf)
    for name, value in (("device_id", "dev_3"), ("operator_code", "OP2")):
        a = a.join(members.where(F.col(name) == value), "transaction_key", "left_semi")
    return a.select("alert_id")


@query("d28_transaction_view", DOCS + f""", w AS MATERIALIZED (SELECT substr(document_id, 2) AS transaction_key, document_id, type, gross_total, coalesce(document_time, captured_at) AS time, {_VF.replace("total", "coalesce(gross_total, net_total)")} AS vf, {_RC} AS rc FROM documents_),
ff AS MATERIALIZED (SELECT transaction_key, min(time) FILTER (vf) AS ff, sum(gross_total) FILTER (vf) AS fiscal_gross, count(*) FILTER (vf) AS nf, sum(gross_total) FILTER (rc AND gross_total IS NOT NULL) AS room_gross, count(*) FILTER (rc AND gross_total IS NOT NULL) AS nr, count(*) FILTER (type = 'CANCELLATION') AS nv FROM w GROUP BY 1),
p AS MATERIALIZED (SELECT w.transaction_key, arg_max(gross_total, strftime(time, '%Y%m%d%H%M%S') || document_id) AS prebill_gross FROM w JOIN ff USING (transaction_key) WHERE type = 'PRE_BILL' AND (ff IS NULL OR time <= ff) GROUP BY 1),
v AS (SELECT transaction_key, prebill_gross, CASE WHEN nf > 0 THEN 'COMMERCIAL_DOCUMENT' WHEN nr > 0 THEN 'ROOM_CHARGE' WHEN nv > 0 THEN 'CANCELLATION' END AS basis, CASE WHEN nf > 0 THEN fiscal_gross WHEN nr > 0 THEN room_gross WHEN nv > 0 THEN 0 END AS final_gross FROM ff LEFT JOIN p USING (transaction_key))
SELECT transaction_key, basis, prebill_gross::DOUBLE AS prebill_gross, final_gross::DOUBLE AS final_gross, (prebill_gross - final_gross)::DOUBLE AS difference FROM v""")
def d28_transaction_view(spark, sf):
    """Gross amounts only; no close means no difference, a cancelled sale ends at zero."""
    _, members, tx = sales(spark, sf)
    room = T.room_close() & F.col("gross_total").isNotNull()
    g = members.groupBy("transaction_key").agg(F.sum(F.when(T.valid_fiscal(), F.col("gross_total"))).alias("fg"), F.count_if(T.valid_fiscal()).alias("nf"), F.sum(F.when(room, F.col("gross_total"))).alias("rg"), F.count_if(room).alias("nr"), F.count_if(F.col("type") == "CANCELLATION").alias("nv"))
    bill = members.select(F.col("document_id").alias("prebill_id"), F.col("gross_total").alias("prebill_gross"))
    v = tx.select("transaction_key", "prebill_id").join(g, "transaction_key").join(bill, "prebill_id", "left")
    final = F.when(F.col("nf") > 0, F.col("fg")).when(F.col("nr") > 0, F.col("rg")).when(F.col("nv") > 0, F.lit(0))
    basis = F.when(F.col("nf") > 0, "COMMERCIAL_DOCUMENT").when(F.col("nr") > 0, "ROOM_CHARGE").when(F.col("nv") > 0, "CANCELLATION")
    return v.select("transaction_key", basis.alias("basis"), "prebill_gross", final.alias("final_gross"), (F.col("prebill_gross") - final).alias("difference"))


@query("d28_view_changes", PRE + f", vb AS (SELECT substr(document_id, 2) AS k, {_VK} AS item_key, sum(quantity) AS q, arg_min(coalesce(modified_unit_price, unit_price), sequence) AS p FROM lines_ WHERE document_id[1] = 'P' AND 'C' || substr(document_id, 2) IN (SELECT document_id FROM lines_) GROUP BY 1, 2), va AS (SELECT substr(document_id, 2) AS k, {_VK} AS item_key, sum(quantity) AS q, arg_min(coalesce(modified_unit_price, unit_price), sequence) AS p FROM lines_ WHERE document_id[1] = 'C' GROUP BY 1, 2) SELECT coalesce(b.k, a.k) AS k, coalesce(b.item_key, a.item_key) AS item_key, b.k IS NULL AS added, a.k IS NULL AS removed, (b.k IS NOT NULL AND a.k IS NOT NULL AND b.q IS DISTINCT FROM a.q) AS quantity_changed, (b.k IS NOT NULL AND a.k IS NOT NULL AND b.p IS DISTINCT FROM a.p) AS price_changed FROM vb b FULL JOIN va a ON b.k = a.k AND b.item_key = a.item_key")
def d28_view_changes(spark, sf):
    ln = canonical(spark, sf).lines.withColumn("k", F.substring("document_id", 2, 99))
    after = ln.where("document_id LIKE 'C%'")
    before = ln.where("document_id LIKE 'P%'").join(after.select("k").distinct(), "k", "left_semi")
    return L.view_changes(L.view_lines(before, ["k"]), L.view_lines(after, ["k"]), ["k"]).drop("discount_changed")


@query("o1_page", PRE + "SELECT document_id, CAST(epoch(captured_at) AS BIGINT) AS captured_at FROM documents_ ORDER BY captured_at DESC, document_id LIMIT 50 OFFSET 100")
def o1_page(spark, sf):
    """O1, O4."""
    return R.page(canonical(spark, sf).documents.select("document_id", "captured_at"), [F.desc("captured_at"), "document_id"], 50, 100)


@query("w4_snapshots", PRE + "SELECT document_id, lag(document_id) OVER w AS before, (total - lag(total) OVER w)::DOUBLE AS moved FROM m WHERE type IN ('PRE_BILL', 'MANAGEMENT_DOCUMENT') WINDOW w AS (PARTITION BY transaction_key ORDER BY time, document_id)")
def w4_snapshots(spark, sf):
    _, members, _ = sales(spark, sf)
    w = Window.partitionBy("transaction_key").orderBy("time", "document_id")
    return members.where(F.col("type").isin("PRE_BILL", "MANAGEMENT_DOCUMENT")).select("document_id", F.lag("document_id").over(w).alias("before"), (F.col("total") - F.lag("total").over(w)).alias("moved"))


@query("a1_type_counts", PRE + "SELECT type, count(*) AS n FROM documents_ GROUP BY 1")
def a1_type_counts(spark, sf):
    return canonical(spark, sf).documents.groupBy("type").agg(F.count("*").alias("n"))


@query("q_duplicate_keys", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_duplicate_keys(spark, sf):
    """Uniqueness check as a query."""
    return R.duplicates(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])
