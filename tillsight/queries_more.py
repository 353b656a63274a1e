"""Further registered queries: labels and provenance, alert life cycle, price display, remaining joins and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillsight import schema
from tillsight.functions import labels, text, values
from tillsight.operators import pairs as P
from tillsight.operators import relational as R
from tillsight.operators import rules as U
from tillsight.operators import transactions as T
from tillsight.operators import views as V
from tillsight.operators import workflow as W
from tillsight.plans.projection import canonical
from tillsight.queries_functions import read
from tillsight.queries_sales import _AL, _SCORES, EVALUATED, PRE, alerts, sales
from tillsight.registry import query


@query("f16_namespaces", PRE + "SELECT document_id, CASE WHEN type IN ('PRE_BILL', 'MANAGEMENT_DOCUMENT') THEN 'MANAGEMENT' WHEN type IN ('COMMERCIAL_DOCUMENT', 'REFUND') THEN 'COMMERCIAL' END AS namespace, CASE WHEN st IS NOT NULL THEN st WHEN external_code IS NOT NULL THEN 'FULL_CODE_OBSERVED_IN_CAPTURE' WHEN external_suffix IS NOT NULL THEN 'SUFFIX_ONLY_OBSERVED_IN_CAPTURE' WHEN type IN ('PRE_BILL', 'MANAGEMENT_DOCUMENT', 'CONFORMING_COPY', 'COMMERCIAL_DOCUMENT') THEN 'NOT_OBSERVED_IN_CAPTURE' ELSE 'NOT_APPLICABLE' END AS progressive FROM (SELECT document_id, type, external_suffix, CASE WHEN length(document_id) % 2 = 0 THEN external_code END AS external_code, CASE WHEN document_id LIKE '%7' THEN 'NOT_APPLICABLE' END AS st FROM documents_)")
def f16_namespaces(spark, sf):
    """With unread codes, stated statuses and statuses that mean nothing."""
    d = canonical(spark, sf).documents
    code = F.when(F.length("document_id") % 2 == 0, F.col("external_code"))
    stated = F.when(F.col("document_id").like("%7"), "NOT_APPLICABLE").when(F.col("document_id").like("%8"), "OBSERVED").when(F.col("document_id").like("%9"), "")
    return d.select("document_id", labels.namespace(F.col("type")).alias("namespace"), labels.progressive_status(stated, code, F.col("external_suffix"), F.col("type")).alias("progressive"))


@query("f17_references", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'DOC' || user_id || ',' ELSE '' END || 'REF ' || event_id % 9 || ',T-' || user_id AS refs, CASE WHEN event_id % 3 = 0 THEN 'T-' || user_id ELSE 'REF ' || event_id % 9 END AS strong FROM events")
def f17_references(spark, sf):
    """accents and blanks are folded; the order's reference comes before the transaction's."""
    k = F.col("event_id")
    ref = F.concat(F.lit(" réf  "), (k % 9).cast("string"))
    j = F.to_json(F.struct(F.when(k % 3 == 0, ref).alias("reference"), F.when(k % 3 != 0, ref).alias("order_reference"), F.when(k % 4 == 0, F.concat(F.lit("döc"), F.col("user_id").cast("string"))).alias("document_reference"), F.concat(F.lit("t-"), F.col("user_id").cast("string")).alias("transaction_reference")))
    return read(spark, sf, "events").select("event_id", labels.references(j).alias("refs"), labels.strong_reference(j).alias("strong"))


@query("f37_serials", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'AB12' || lpad(s_suppkey::VARCHAR, 4, '0') WHEN s_suppkey % 4 = 0 THEN 'CF99' || lpad(s_suppkey::VARCHAR, 4, '0') END AS serial, CASE WHEN s_suppkey % 3 = 0 THEN 'PRINTED' WHEN s_suppkey % 4 = 0 THEN 'CONFIGURED' END AS origin FROM supplier")
def f37_serials(spark, sf):
    k = F.col("s_suppkey")
    n = F.lpad(k.cast("string"), 4, "0")
    s = labels.serial(F.when(k % 3 == 0, F.concat(F.lit(" ab12"), n)).otherwise("?"), F.concat(F.lit("CF99"), n), F.when(k % 4 == 0, "rch").otherwise("pos"))
    return read(spark, sf, "supplier").select("s_suppkey", s["serial"].alias("serial"), s["origin"].alias("origin"))


@query("f39_resolved_codes", PRE + """, x AS MATERIALIZED (SELECT transaction_key AS cid, substr(document_id, 2)::BIGINT AS k, document_id, CASE WHEN document_id[1] = 'B' AND substr(document_id, 2)::BIGINT % 20 = 0 THEN 'MANAGEMENT_DOCUMENT' ELSE type END AS type, CASE WHEN type = 'COMMERCIAL_DOCUMENT' AND substr(document_id, 2)::BIGINT % 4 = 1 THEN external_code END AS external_code, external_suffix,
CASE WHEN document_id[1] = 'B' AND substr(document_id, 2)::BIGINT % 40 = 0 THEN 'ZZ/' || string_split(commercial_reference, '-')[-1] ELSE commercial_reference END AS ref FROM m),
ok AS (SELECT DISTINCT cid FROM x WHERE cid::BIGINT % 7 <> 0 AND cid::BIGINT % 3 <> 0 AND cid::BIGINT % 11 <> 0), r AS (SELECT document_id, cid, external_suffix AS e FROM x WHERE type = 'COMMERCIAL_DOCUMENT' AND external_code IS NULL AND external_suffix IS NOT NULL),
c AS (SELECT r.document_id, count(DISTINCT ref) AS n, min(ref) AS code FROM r JOIN ok USING (cid) JOIN x ON x.cid = r.cid AND x.document_id <> r.document_id AND x.type IN ('MANAGEMENT_DOCUMENT', 'CONFORMING_COPY') AND ref IS NOT NULL AND string_split(replace(ref, '/', '-'), '-')[-1] = e GROUP BY 1)
SELECT r.document_id, CASE WHEN n = 1 THEN code END AS resolved, CASE WHEN n = 1 THEN 'CORRELATED_MANAGEMENT_REFERENCE' END AS provenance, coalesce(n > 1, FALSE) AS conflict FROM r LEFT JOIN c USING (document_id)""")
def f39_resolved_codes(spark, sf):
    """numbers of receipts that show four digits only, where one witness, none, several alike or several that differ speak for them."""
    _, members, _ = sales(spark, sf)
    k = F.substring("document_id", 2, 20).cast("bigint")
    copy = F.col("document_id").startswith("B")
    last = F.element_at(F.split("commercial_reference", "-"), -1)
    m = members.select(
        F.col("transaction_key").alias("correlation_id"), "document_id", F.when(copy & (k % 20 == 0), "MANAGEMENT_DOCUMENT").otherwise(F.col("type")).alias("type"), F.when((F.col("type") == "COMMERCIAL_DOCUMENT") & (k % 4 == 1), F.col("external_code")).alias("external_code"),
        "external_suffix", F.when(copy & (k % 40 == 0), F.concat(F.lit("ZZ/"), last)).otherwise(F.col("commercial_reference")).alias("commercial_reference"),
    )
    c = F.col("correlation_id").cast("bigint")
    four = F.array(*map(F.lit, V.WITNESS_CRITERIA))
    correlations = m.select("correlation_id").distinct().select("correlation_id", F.when(c % 7 == 0, "SUPERSEDED").otherwise("AUTOMATIC").alias("status"), F.when(c % 3 == 0, 95).otherwise(100).alias("score"), F.when(c % 11 == 0, F.slice(four, 1, 3)).otherwise(four).alias("matched"))
    return V.resolved_codes(m, correlations)


@query("d14_management_bills", PRE + """, mm AS MATERIALIZED (SELECT transaction_key, document_id, CASE WHEN type = 'PRE_BILL' AND transaction_key::BIGINT % 3 = 0 THEN 'MANAGEMENT_DOCUMENT' ELSE type END AS type, CASE WHEN type = 'PRE_BILL' AND transaction_key::BIGINT % 6 = 0 THEN 'X' ELSE table_code END AS table_code, time, total, complete, commercial_reference, economic_close, settlement_kind FROM m),
ff AS MATERIALIZED (SELECT transaction_key, arg_min(document_id, strftime(time, '%Y%m%d%H%M%S') || document_id) AS fid, min(time) AS ft FROM mm WHERE type = 'COMMERCIAL_DOCUMENT' AND complete AND total IS NOT NULL GROUP BY 1),
own AS MATERIALIZED (SELECT mm.transaction_key, arg_max(document_id, strftime(time, '%Y%m%d%H%M%S') || document_id) AS id, arg_max(total, strftime(time, '%Y%m%d%H%M%S') || document_id) AS total FROM mm LEFT JOIN ff USING (transaction_key) WHERE type = 'PRE_BILL' AND (ft IS NULL OR time <= ft) GROUP BY 1),
fk AS MATERIALIZED (SELECT DISTINCT ff.transaction_key, item_key, table_code FROM ff JOIN kl ON kl.document_id = fid JOIN mm ON mm.document_id = fid),
cand AS MATERIALIZED (SELECT DISTINCT mm.transaction_key, mm.document_id, time, total FROM mm JOIN ff USING (transaction_key) JOIN kl ON kl.document_id = mm.document_id JOIN fk ON fk.transaction_key = mm.transaction_key AND fk.item_key = kl.item_key AND upper(fk.table_code) = upper(mm.table_code)
  WHERE type = 'MANAGEMENT_DOCUMENT' AND complete AND total IS NOT NULL AND commercial_reference IS NULL AND NOT (economic_close OR coalesce(settlement_kind = 'ROOM_CHARGE', FALSE)) AND time <= ft),
alt AS MATERIALIZED (SELECT transaction_key, arg_max(document_id, strftime(time, '%Y%m%d%H%M%S') || document_id) AS id, arg_max(total, strftime(time, '%Y%m%d%H%M%S') || document_id) AS total FROM cand WHERE transaction_key NOT IN (SELECT transaction_key FROM own) GROUP BY 1)
SELECT tx.transaction_key, coalesce(own.id, alt.id) AS prebill_id, coalesce(own.total, alt.total)::DOUBLE AS prebill_total, (coalesce(own.total, alt.total) - tx.final_total)::DOUBLE AS difference FROM tx LEFT JOIN own USING (transaction_key) LEFT JOIN alt USING (transaction_key)""")
def d14_management_bills(spark, sf):
    """Episodes whose pre-bill is a management paper, at the receipt's table or at another."""
    c, members, _ = sales(spark, sf)
    k, bill = F.col("transaction_key").cast("bigint"), F.col("type") == "PRE_BILL"
    m = members.withColumns({"table_code": F.when(bill & (k % 6 == 0), "X").otherwise(F.col("table_code")), "type": F.when(bill & (k % 3 == 0), "MANAGEMENT_DOCUMENT").otherwise(F.col("type"))})
    return T.transactions(m, c.payments, c.lines).select("transaction_key", "prebill_id", "prebill_total", "difference")


_ADJUSTED = ("NULL", """'{"surcharge_total": "5.00"}'""", "'{}'", """'{"adjustments": [1, {"amount": "2.50"}]}'""", """'{"adjustments": [{"amount": null}]}'""", """'{"rounding_adjustment": null}'""", """'{"adjustment_total": 1}'""", """'{"adjustments": "x"}'""", """'{"surcharge_total": "abc"}'""")


@query("r15_adjusted_totals", PRE + "SELECT substr(document_id, 2) AS transaction_key, 75::BIGINT AS score, 1::BIGINT AS hits FROM (SELECT DISTINCT document_id FROM lines_ WHERE document_id[1] = 'P') WHERE substr(document_id, 2)::BIGINT % 9 = 2")
def r15_adjusted_totals(spark, sf):
    """Totals that surcharges, roundings and lists of adjustments explain, that nothing explains, or that can't be judged."""
    c, members, tx = sales(spark, sf)
    k = F.col("transaction_key").cast("bigint") % 9
    s = c.lines.groupBy("document_id").agg(F.sum("line_total").alias("s"))
    off = F.element_at(F.array(*map(F.lit, (0.0, 5.0, 5.0, 3.5, 9.0, 9.0, -1.0, 9.0, 9.0))), (k + 1).cast("int")).cast(values.MONEY)
    m = members.where("type = 'PRE_BILL'").join(s, "document_id").withColumns({
        "total": (F.col("s") + off).cast(values.MONEY), "discount_total": F.when(k == 6, F.lit(2)).cast(values.MONEY), "raw_metadata": F.element_at(F.array(*[F.expr(x).cast("string") for x in _ADJUSTED]), (k + 1).cast("int")),
    }).drop("s")
    found = U.r15(U.Context(m, tx, None, c.lines, None, None, EVALUATED), {"tolerance": 0.01})
    return found.select("transaction_key", "score", "hits")


@query("f42_rule_fingerprints", """SELECT p_partkey, sha256('{"code":"' || p_brand || '","parameters":"{}","severity":"HIGH","weight":"1"}') AS f FROM part""")
def f42_rule_fingerprints(spark, sf):
    return read(spark, sf, "part").select("p_partkey", U.rule_fingerprint(F.col("p_brand"), F.lit("HIGH"), F.lit("1"), F.lit("{}")).alias("f"))


@query("f44_wrapped_names", "SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_name || ' al forno' WHEN 1 THEN p_name || 'e' WHEN 2 THEN p_name || ' e pane' WHEN 3 THEN p_name || ' KG' WHEN 4 THEN p_name || 'ata Mista' WHEN 5 THEN p_name WHEN 6 THEN p_name || ' di Mare' ELSE p_name || 'Kg 2' END AS name FROM part")
def f44_wrapped_names(spark, sf):
    """function words, a lone vowel, units, plain rests and blanks."""
    k, name = F.col("p_partkey") % 8, F.col("p_name")
    first = F.when(k == 6, F.concat(name, F.lit(" di"))).otherwise(name)
    rest = F.element_at(F.array(*map(F.lit, ("al  forno", " e", "e pane ", "KG", "ata  Mista", "  ", "Mare", "Kg 2"))), (k + 1).cast("int"))
    return read(spark, sf, "part").select("p_partkey", labels.join_wrapped(first, rest).alias("name"))


@query("f46_management_class", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'SHIFT_END_REPORT' WHEN doc_id % 5 = 1 THEN 'INVOICE' WHEN doc_id % 5 = 2 THEN 'INVOICE' END AS kind FROM documents")
def f46_management_class(spark, sf):
    """shift reports and invoices by whole lines, around whole texts."""
    k, t = F.col("doc_id") % 5, F.coalesce("text", F.lit(""))
    body = F.when(k == 0, F.concat(F.lit("\n Report di fine turno 3\nFatture 42,35\n"), t)).when(k == 1, F.concat(t, F.lit("\nFattura n. 12/A\n"), t)).when(k == 2, F.concat(t, F.lit("\n fattura  elettronica \n"), t)).when(k == 3, F.concat(F.lit("Ditta\nReport di fine turno\n"), t)).otherwise(F.concat(F.lit("Fatture 42,35\nla fattura n. 12\n"), t))
    return read(spark, sf, "documents").select("doc_id", labels.management_class(body).alias("kind"))


@query("f48_presets", "SELECT CAST(epoch(((date_trunc('day', (max(ts) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome')) AT TIME ZONE 'Europe/Rome') AT TIME ZONE 'UTC') AS BIGINT) AS today FROM events")
def f48_presets(spark, sf):
    return read(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("now")).select(labels.preset("today", F.col("now"))[0].alias("today"))


@query("f52_zoned_times", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(floor(epoch(date_trunc('second', ts))) AS BIGINT) END AS t FROM events")
def f52_zoned_times(spark, sf):
    shown = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return read(spark, sf, "events").select("event_id", labels.zoned_time(F.concat(shown, F.when(F.col("event_id") % 2 == 0, "Z").otherwise(""))).alias("t"))


@query("f53_labels", "SELECT event_id, round(CASE WHEN event_id % 200 <= 100 THEN event_id % 200 ELSE (event_id % 200) / 100.0 END, 1)::DOUBLE AS pct FROM events")
def f53_labels(spark, sf):
    return read(spark, sf, "events").select("event_id", labels.confidence_label((F.col("event_id") % 200).cast("decimal(9,4)") / 100).alias("pct"))


@query("f51_field_checks", "SELECT doc_id, doc_id % 4 <> 1 AS valid FROM documents")
def f51_field_checks(spark, sf):
    d = read(spark, sf, "documents")
    good = F.sha2("text", 256)
    return d.select("doc_id", labels.valid_fields(F.col("source"), F.col("n_chars"), F.when(F.col("doc_id") % 4 == 1, F.upper(good)).otherwise(good), values.name_uuid(F.col("source"))).alias("valid"))


@query("j5_alert_rules", PRE + ", " + _AL + " SELECT alert_id, rule_code, severity, 1::BIGINT AS version FROM alr")
def j5_alert_rules(spark, sf):
    """Alerts beside their rule's version."""
    r = spark.createDataFrame([(x.code, x.version) for x in U.RULES], "rule_code string, version int")
    return alerts(spark, sf).join(F.broadcast(r), "rule_code").select("alert_id", "rule_code", "severity", "version")


@query("j20_order_of_document", PRE + "SELECT document_id, transaction_key AS order_code FROM m WHERE type IN ('CONFORMING_COPY', 'REPRINT', 'DEVICE_RESPONSE')")
def j20_order_of_document(spark, sf):
    """The order of papers that carry no order code."""
    _, members, _ = sales(spark, sf)
    return members.where(F.col("type").isin("CONFORMING_COPY", "REPRINT", "DEVICE_RESPONSE")).select("document_id", F.col("transaction_key").alias("order_code"))


@query("a18_edge_scores", PRE + ", " + _SCORES + ", k AS (SELECT substr(x.document_id, 2) AS tk, e.a, e.b, score FROM scored e JOIN documents_ x ON e.a = x.document_id WHERE score >= 60 AND substr(e.a, 2) = substr(e.b, 2)), best AS (SELECT id, max(score) AS score FROM (SELECT a AS id, score FROM k UNION ALL SELECT b, score FROM k) GROUP BY 1) SELECT transaction_key AS cluster, min(coalesce(score, 0))::BIGINT AS score FROM m LEFT JOIN best ON document_id = id GROUP BY 1 HAVING count(*) > 1")
def a18_edge_scores(spark, sf):
    """The best edge of each document within its episode, then the least over the episode."""
    c, members, _ = sales(spark, sf)
    d = P.described(c.documents, c.lines)
    of = members.select("document_id", F.col("transaction_key").alias("cluster"))
    return P.correlations(P.scored(d, P.MINIMUM), of).select("cluster", "score")


@query("a23_price_display", PRE + ", k AS (SELECT substr(document_id, 2) AS tk, item_code AS code, unit_price AS u FROM lines_ WHERE document_id[1] = 'P' AND item_code IS NOT NULL) SELECT tk, code, CASE WHEN count(DISTINCT u) > 1 THEN 'CONFLICTING_SOURCES' ELSE 'RESOLVED' END AS status, CASE WHEN count(DISTINCT u) = 1 THEN max(u) END::DOUBLE AS price FROM k GROUP BY 1, 2")
def a23_price_display(spark, sf):
    ln = canonical(spark, sf).lines.where("document_id LIKE 'P%' AND item_code IS NOT NULL").select(F.substring("document_id", 2, 99).alias("tk"), F.col("item_code").alias("code"), F.col("unit_price").alias("u"))
    g = ln.groupBy("tk", "code").agg(F.count_distinct("u").alias("n"), F.max("u").alias("m"))
    return g.select("tk", "code", F.when(F.col("n") > 1, "CONFLICTING_SOURCES").otherwise("RESOLVED").alias("status"), F.when(F.col("n") == 1, F.col("m")).alias("price"))


@query("a27_page_total", PRE + "SELECT count(*) AS total FROM documents_ WHERE type = 'PRE_BILL'")
def a27_page_total(spark, sf):
    return canonical(spark, sf).documents.where("type = 'PRE_BILL'").agg(F.count("*").alias("total"))


@query("a30_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def a30_distinct(spark, sf):
    return read(spark, sf, "events").select("user_id", "event_type").distinct()


@query("o3_bounded_hits", "(SELECT 'order' AS kind, o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 500) UNION ALL (SELECT 'customer', c_custkey FROM customer ORDER BY c_custkey LIMIT 100)")
def o3_bounded_hits(spark, sf):
    """O3, Q18: each kind's hits are bounded, as the search page shows them."""
    a = R.page(read(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")), ["id"], 500)
    return a.unionByName(R.page(read(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")), ["id"], 100))


@query("d8_dispatches", PRE + "SELECT document_id AS a, 'Q' || transaction_key AS b, 85::BIGINT AS score FROM m WHERE type = 'KITCHEN_ORDER'")
def d8_dispatches(spark, sf):
    """With every kitchen ticket printed in a second department twenty seconds later."""
    c = canonical(spark, sf)
    k = c.documents.where("type = 'KITCHEN_ORDER'").withColumn("document_time", F.coalesce("document_time", "captured_at"))
    twin = k.withColumns({"document_id": F.concat(F.lit("Q"), "order_code"), "device_id": F.lit("dev_bar"), "document_time": F.col("document_time") + F.expr("INTERVAL 20 SECONDS")})
    d = P.described(k.unionByName(twin), c.lines)
    return P.scored(d, types=("KITCHEN_ORDER",), by=("table",), rule="dispatch").select("a", "b", "score")


@query("d9_table_changes", PRE + "SELECT least(k.document_id, h.document_id) AS a, greatest(k.document_id, h.document_id) AS b FROM documents_ k JOIN documents_ h ON k.type = 'KITCHEN_ORDER' AND h.type = 'ORDER_CHANGE' AND k.order_code = h.order_code AND k.device_id = h.device_id AND epoch(h.document_time) - epoch(coalesce(k.document_time, k.captured_at)) BETWEEN 0 AND 300 WHERE EXISTS (SELECT 1 FROM kl x JOIN kl y USING (item_key) WHERE x.document_id = k.document_id AND y.document_id = h.document_id)")
def d9_table_changes(spark, sf):
    c = canonical(spark, sf)
    d = P.described(c.documents, c.lines)
    return P.scored(d, types=("KITCHEN_ORDER", "ORDER_CHANGE"), by=("table",), rule="table_change").select("a", "b")


@query("d4_boundaries", PRE + "SELECT a.document_id AS a, 'Q' || b.transaction_key AS b, 0::BIGINT AS score FROM m a JOIN m b ON a.type = 'COMMERCIAL_DOCUMENT' AND b.type = 'COMMERCIAL_DOCUMENT' AND (a.table_code = b.table_code OR a.external_suffix = b.external_suffix) AND epoch(b.time) + 600 - epoch(a.time) > 0 AND epoch(b.time) + 600 - epoch(a.time) <= 7200")
def d4_boundaries(spark, sf):
    """With a new pre-bill on the table ten minutes after every fiscal document."""
    c = canonical(spark, sf)
    f = c.documents.where("type = 'COMMERCIAL_DOCUMENT'")
    bill = f.withColumns({"document_id": F.concat(F.lit("Q"), "order_code"), "type": F.lit("PRE_BILL"), "external_code": F.lit(None).cast("string"), "document_time": F.col("document_time") + F.expr("INTERVAL 10 MINUTES")})
    d = P.described(f.unionByName(bill), c.lines)
    return P.boundaries(d)


def _incoming(spark, sf):
    """A second run's alerts: the same keys for half of the orders."""
    return alerts(spark, sf).where(F.col("transaction_key").cast("bigint") % 2 == 0)


@query("d23_idempotent_alerts", PRE + ", " + _AL + " SELECT count(*) FILTER (CAST(transaction_key AS BIGINT) % 2 = 1) AS inserted, count(*) FILTER (CAST(transaction_key AS BIGINT) % 2 = 0) AS known FROM alr")
def d23_idempotent_alerts(spark, sf):
    """Alerts of a second run are inserted only where their key is new."""
    a = alerts(spark, sf)
    new = a.join(_incoming(spark, sf).select("alert_id"), "alert_id", "left_anti").agg(F.count("*").alias("inserted"))
    old = a.join(_incoming(spark, sf).select("alert_id"), "alert_id", "left_semi").agg(F.count("*").alias("known"))
    return new.join(old)  # two single rows


@query("m2_alert_history", PRE + ", " + _AL + " SELECT alert_id, CASE WHEN status = 'OPEN' THEN 1 ELSE 2 END::BIGINT AS entries, status FROM alr")
def m2_alert_history(spark, sf):
    """M2: an append-only history; the current status is its last entry."""
    a = alerts(spark, sf)
    log = a.select("alert_id", F.lit(1).alias("sequence"), F.lit("OPEN").alias("status")).unionByName(a.where("status <> 'OPEN'").select("alert_id", F.lit(2).alias("sequence"), "status"))
    n = log.groupBy("alert_id").agg(F.count("*").alias("entries"))
    return W.effective(log, "alert_id", ["sequence"]).join(n, "alert_id").select("alert_id", "entries", "status")


@query("k7_integrity", "SELECT doc_id, doc_id % 50 <> 0 AS intact FROM documents")
def k7_integrity(spark, sf):
    """K7: a digest recomputed before release."""
    d = read(spark, sf, "documents").withColumn("stored", F.sha2(F.concat("text", F.when(F.col("doc_id") % 50 == 0, "!").otherwise("")), 256))
    return d.select("doc_id", (F.sha2("text", 256) == F.col("stored")).alias("intact"))


@query("k4_chunk_slices", "SELECT doc_id, len(range(0, strlen(text), 4096)) AS chunks FROM documents")
def k4_chunk_slices(spark, sf):
    """K4: a payload in slices that give it back, each with its hash."""
    d = read(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    n = F.octet_length("raw")
    parts = d.select("doc_id", "raw", F.posexplode(F.sequence(F.lit(0), n - 1, F.lit(4096))).alias("i", "offset"))
    slices = parts.select(F.col("doc_id").alias("stream"), (F.col("i") + 1).alias("sequence"), "offset", F.substring("raw", F.col("offset") + 1, F.lit(4096)).alias("payload")).withColumns({"length": F.octet_length("payload"), "payload_sha256": F.sha2("payload", 256)})
    whole = R.reassemble(slices, "stream")
    n_chunks = slices.groupBy("stream").agg(F.count("*").alias("chunks"))
    return whole.join(d, whole.stream == d.doc_id).where(F.sha2("data", 256) == F.sha2("raw", 256)).select("doc_id", "stream").join(n_chunks, "stream").select("doc_id", "chunks")


@query("d10_fiscal_siblings", PRE + "SELECT document_id AS a, 'Z' || transaction_key AS b, 80::BIGINT AS score FROM m WHERE type = 'COMMERCIAL_DOCUMENT'")
def d10_fiscal_siblings(spark, sf):
    """With a second fiscal document a minute after every first."""
    c = canonical(spark, sf)
    f = c.documents.where("type = 'COMMERCIAL_DOCUMENT'")
    twin = f.withColumns({"document_id": F.concat(F.lit("Z"), "order_code"), "job_id": F.concat(F.lit("JZ"), "order_code"), "document_time": F.col("document_time") + F.expr("INTERVAL 1 MINUTE")})
    d = P.described(f.unionByName(twin), c.lines)
    return P.scored(d, types=schema.SIBLING_TYPES, rule="fiscal_siblings").select("a", "b", "score")


@query("d7_kitchen_baselines", PRE + "SELECT document_id AS a, 'Q' || transaction_key AS b FROM m WHERE type = 'KITCHEN_ORDER' AND document_id IN (SELECT document_id FROM lines_)")
def d7_kitchen_baselines(spark, sf):
    """With a priced management ticket ten seconds after every kitchen ticket."""
    c = canonical(spark, sf)
    k = c.documents.where("type = 'KITCHEN_ORDER'").withColumn("document_time", F.coalesce("document_time", "captured_at"))
    q = F.concat(F.lit("Q"), F.substring("document_id", 2, 99))
    mg = k.withColumns({"document_id": q, "type": F.lit("MANAGEMENT_DOCUMENT"), "gross_total": F.lit(10).cast(values.MONEY), "document_time": F.col("document_time") + F.expr("INTERVAL 10 SECONDS")})
    ln = c.lines.where("document_id LIKE 'K%'")
    d = P.described(k.unionByName(mg), ln.unionByName(ln.withColumn("document_id", q)))
    return P.scored(d, types=("KITCHEN_ORDER", "MANAGEMENT_DOCUMENT"), by=("table",), rule="kitchen_baseline").select("a", "b")
