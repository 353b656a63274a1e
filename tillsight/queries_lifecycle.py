"""Registered queries: reused codes, clusters to transactions, criteria, life of correlations and alerts, read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillsight import schema
from tillsight.functions import exports, labels, values
from tillsight.operators import lifecycle as C
from tillsight.operators import lines as L
from tillsight.operators import pairs as P
from tillsight.operators import relational as R
from tillsight.operators import rules as U
from tillsight.operators import transactions as T
from tillsight.operators import views as V
from tillsight.plans.projection import canonical, payments
from tillsight.plans.tables import written
from tillsight.queries_functions import read
from tillsight.queries_sales import _AL, _CONTENT, _EV, _JOBS, _P3, _RC, _VF, PRE, alerts, context, jobs, sales
from tillsight.registry import query

def reused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents and lines in which every closed order's code is used again half an hour after its fiscal document."""
    c = canonical(spark, sf_dir)
    closed = c.documents.where("type = 'COMMERCIAL_DOCUMENT'").select("order_code").distinct()
    bill = c.documents.where(F.col("type").isin("PRE_BILL", "COMMERCIAL_DOCUMENT")).join(closed, "order_code", "left_semi")
    late = lambda c: F.col(c) + F.expr("INTERVAL 30 MINUTES")
    again = bill.withColumns({"document_id": F.concat(F.lit("2"), "document_id"), "job_id": F.concat(F.lit("2"), "job_id"), "external_code": F.concat("external_code", F.lit("-II")), "external_suffix": F.lit(None).cast("string"), "order_reference": F.concat(F.lit("II-"), "order_reference"), "document_time": late("document_time"), "captured_at": late("captured_at")})
    lines = c.lines.where(F.col("document_id").substr(1, 1).isin("P", "C")).join(bill.select("document_id"), "document_id", "left_semi").withColumn("document_id", F.concat(F.lit("2"), "document_id"))
    return written(c.documents.unionByName(again.select(*c.documents.columns)), "reused"), c.lines.unionByName(lines)


_TWICE = """, cl AS (SELECT DISTINCT substr(document_id, 2) AS k FROM documents_ WHERE type = 'COMMERCIAL_DOCUMENT'),
b1 AS (SELECT transaction_key, count(*) AS documents, max(total) FILTER (type = 'PRE_BILL') AS prebill_total, sum(total) FILTER (""" + _VF + """) AS fiscal_total FROM m GROUP BY 1),
b2 AS (SELECT transaction_key, count(*) AS documents, max(total) FILTER (type = 'PRE_BILL') AS prebill_total, sum(total) FILTER (""" + _VF + """) AS fiscal_total FROM m WHERE type IN ('PRE_BILL', 'COMMERCIAL_DOCUMENT') AND transaction_key IN (FROM cl) GROUP BY 1)"""


@query("d14_reused_codes", PRE + _TWICE + " SELECT transaction_key, documents, prebill_total::DOUBLE AS prebill_total, coalesce(fiscal_total, 0)::DOUBLE AS fiscal_total FROM b1 UNION ALL SELECT transaction_key || '#2', documents, prebill_total::DOUBLE, coalesce(fiscal_total, 0)::DOUBLE FROM b2")
def d14_reused_codes(spark, sf):
    """A code that is used again after a close opens a second episode."""
    docs, _ = reused(spark, sf)
    return T.transactions(T.episodes(docs), payments(docs)).select("transaction_key", "documents", "prebill_total", "fiscal_total")


@query("d14_from_clusters", PRE + _TWICE + " SELECT k AS documents, count(*) AS n, sum(prebill_total)::DOUBLE AS prebill_total, sum(fiscal_total)::DOUBLE AS fiscal_total FROM (SELECT documents AS k, prebill_total, coalesce(fiscal_total, 0) AS fiscal_total FROM b1 UNION ALL SELECT documents, prebill_total, coalesce(fiscal_total, 0) FROM b2) GROUP BY 1")
def d14_from_clusters(spark, sf):
    """Transactions built from the clusters of scored pairs, over documents whose codes are used twice."""
    docs, lines = reused(spark, sf)
    d = P.described(docs, lines)
    found = P.clusters(d, P.scored(d, P.MINIMUM))
    t = T.transactions(T.members_of(docs, found), payments(docs))
    return t.groupBy("documents").agg(F.count("*").alias("n"), F.sum("prebill_total").alias("prebill_total"), F.sum("fiscal_total").alias("fiscal_total"))


@query("a19_criteria", PRE + ", g AS (SELECT transaction_key, count(*) AS n, count(*) FILTER (type = 'KITCHEN_ORDER') AS k, count(*) FILTER (type = 'DEVICE_RESPONSE') AS r, count(*) FILTER (type IN ('CONFORMING_COPY', 'REPRINT')) AS c FROM m GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS clusters, sum(r)::BIGINT AS with_response, count(*) FILTER (c > 0) AS with_reference FROM g")
def a19_criteria(spark, sf):
    """The criteria that some edge of a cluster meets."""
    c = canonical(spark, sf)
    d = P.described(c.documents, c.lines)
    scored = written(P.scored(d, P.MINIMUM), "scored")
    x = P.correlations(scored, P.clusters(d, scored)).where(F.size(F.array_intersect("matched", "unmatched")) == 0)
    has = lambda n: F.count_if(F.array_contains("matched", n))
    return x.where("score >= 60").agg(F.count("*").alias("clusters"), has("response_job_context").alias("with_response"), has("commercial_reference_to_fiscal_progressive").alias("with_reference"))


@query("d22_finding_keys", PRE + r""", f AS (SELECT transaction_key, min(document_id) FILTER (type = 'PRE_BILL') AS d, max(time) FILTER (type = 'PRE_BILL') AS t FROM m GROUP BY 1 HAVING count(*) FILTER (""" + _VF + " OR (" + _RC + r""" AND total IS NOT NULL)) = 0)
SELECT transaction_key, sha256('{"confidence":"75","description":"Ordine senza chiusura fiscale","document_ids":"[' || d || ']","evidence":"[{\"kind\":\"missing_fiscal_close\",\"last_source_at\":\"' || strftime(t, '%Y-%m-%d %H:%M:%S') || '\",\"threshold_minutes\":\"120\"}]","rule_code":"ORDER_WITHOUT_FISCAL_CLOSE","rule_version":"1","score":"70","severity":"MEDIUM","transaction_key":"' || transaction_key || '"}') AS finding_key FROM f""")
def d22_finding_keys(spark, sf):
    """Keys over all that a finding says, but for the time of its evaluation."""
    return U.explained(context(spark, sf), U.registry()["ORDER_WITHOUT_FISCAL_CLOSE"]).select("transaction_key", U.finding_key().alias("finding_key"))


@query("d21_evidence", PRE + ", " + _EV + """, e AS (SELECT transaction_key, 'ITEM_REMOVED_AFTER_PREBILL' AS rule_code, count(*) AS n, '' AS named FROM ch WHERE change_type = 'REMOVED' GROUP BY 1 UNION ALL SELECT transaction_key, 'REPRINT_OR_COPY_ANOMALY', count(*), string_agg(document_id, ',' ORDER BY document_id) FROM m WHERE type IN ('CONFORMING_COPY', 'REPRINT') GROUP BY 1 HAVING count(*) > 2
UNION ALL SELECT transaction_key, 'MODIFICA_POST_PRECONTO', 1 + coalesce(n, 0), '' FROM tx LEFT JOIN (SELECT transaction_key, count(*) AS n FROM ch WHERE change_type <> 'UNCHANGED' GROUP BY 1) USING (transaction_key) WHERE prebill_total > 0 AND (fiscals > 0 OR cancellations > 0 OR closings > 0) AND difference >= 1 AND percent >= 20)
SELECT e.transaction_key, rule_code, n AS pieces, CASE WHEN named <> '' THEN named ELSE ids END AS document_ids FROM e JOIN (SELECT transaction_key, string_agg(document_id, ',' ORDER BY document_id) AS ids FROM m GROUP BY 1) USING (transaction_key)""")
def d21_evidence(spark, sf):
    """Pieces of evidence and documents of findings."""
    c = context(spark, sf, changes=True)
    found = None
    for code in ("MODIFICA_POST_PRECONTO", "ITEM_REMOVED_AFTER_PREBILL", "REPRINT_OR_COPY_ANOMALY"):
        f = U.explained(c, U.registry()[code])
        found = f if found is None else found.unionByName(f)
    return found.select("transaction_key", "rule_code", F.size("evidence").alias("pieces"), "document_ids")


def _correlations(spark, sf):
    """Stored correlations of the last run: of every episode; with another input for a seventh, superseded for an eleventh."""
    _, members, _ = sales(spark, sf)
    f = T.fingerprint(members).select(F.col("transaction_key").alias("transaction_id"), F.lit("v1").alias("algorithm"), F.col("input_fingerprint").alias("fingerprint"))
    k = F.col("transaction_id").cast("bigint")
    stored = f.withColumns({"fingerprint": F.when(k % 7 == 0, "old").otherwise(F.col("fingerprint")), "status": F.when(k % 11 == 0, C.SUPERSEDED).otherwise(C.AUTOMATIC), "correlation_id": F.concat(F.lit("c"), "transaction_id")})
    ids = members.select(F.col("transaction_key").alias("transaction_id"), "document_id")
    return stored, ids.select(F.concat(F.lit("c"), "transaction_id").alias("correlation_id"), "document_id"), f, ids


@query("d15_persistence", PRE + ", k AS (SELECT CAST(transaction_key AS BIGINT) AS k, documents FROM agg) SELECT action, status, count(*) AS n FROM (SELECT CASE WHEN k % 7 <> 0 THEN 'REUSED' WHEN k % 11 = 0 THEN 'KEPT' ELSE 'SUPERSEDED' END AS action, CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 11 = 0 AND documents = 1 THEN 'UNCORRELATED' ELSE 'AUTOMATIC' END ELSE 'SUPERSEDED' END AS status FROM k UNION ALL SELECT 'INSERTED', CASE WHEN documents > 1 THEN 'AUTOMATIC' ELSE 'UNCORRELATED' END FROM k WHERE k % 7 = 0) GROUP BY 1, 2")
def d15_persistence(spark, sf):
    """Correlations of a second run beside those of the first."""
    return C.persist_correlations(*_correlations(spark, sf)).groupBy("action", "status").agg(F.count("*").alias("n"))


@query("d16_retire_non_sale", PRE + "SELECT 'c' || transaction_key AS correlation_id, CASE WHEN CAST(transaction_key AS BIGINT) % 11 = 0 OR n > 0 THEN 'SUPERSEDED' ELSE 'AUTOMATIC' END AS status, CASE WHEN CAST(transaction_key AS BIGINT) % 11 <> 0 AND n > 0 THEN documents ELSE 0 END AS again FROM agg JOIN (SELECT transaction_key, count(*) FILTER (type = 'MANAGEMENT_DOCUMENT') AS n FROM m GROUP BY 1) USING (transaction_key)")
def d16_retire_non_sale(spark, sf):
    """Management documents turn out to be shift reports; their correlations retire and the other members come again."""
    stored, members, _, _ = _correlations(spark, sf)
    docs = canonical(spark, sf).documents.select("document_id", F.when(F.col("type") == "MANAGEMENT_DOCUMENT", "SHIFT_END_REPORT").otherwise(F.col("type")).alias("type"))
    now, again = C.retire_non_sale(stored, members, docs)
    n = members.join(again, "document_id", "left_semi").groupBy("correlation_id").agg(F.count("*").alias("again"))
    return now.join(n, "correlation_id", "left").select("correlation_id", "status", F.coalesce("again", F.lit(0)).alias("again"))


def _stored_alerts(spark, sf) -> DataFrame:
    a = alerts(spark, sf)
    return a.select("alert_id", "rule_code", F.col("transaction_key").alias("transaction_id"), F.concat(F.lit("c"), "transaction_key").alias("correlation_id"), F.concat("rule_code", F.lit(":"), "transaction_key").alias("finding_key"), "status", F.lit(True).alias("is_canonical"), "opened_at", "severity", "difference")


@query("d23_alert_life", PRE + ", " + _AL + """ SELECT rule_code, action, count(*) AS n FROM (SELECT rule_code, CASE WHEN k % 5 = 0 AND rule_code <> 'MODIFICA_POST_PRECONTO' THEN 'INSERT' WHEN k % 10 = 9 THEN 'INSERT' WHEN status = 'JUSTIFIED' AND k % 4 = 3 AND k % 9 <> 0 THEN 'REOPEN' ELSE 'KEEP' END AS action FROM (SELECT *, CAST(transaction_key AS BIGINT) AS k FROM alr)) GROUP BY 1, 2""")
def d23_alert_life(spark, sf):
    """A second run's findings: known, new (another key, or another correlation too), excluded before and confirmed again, suppressed."""
    stored = written(_stored_alerts(spark, sf), "alerts")
    k = F.col("transaction_id").cast("bigint")
    history = stored.select("alert_id", F.lit(1).alias("sequence"), F.lit("ALERT_OPENED").alias("event_type")).unionByName(stored.where("status = 'JUSTIFIED'").select("alert_id", F.lit(2).alias("sequence"), F.when(k % 4 == 3, "ALERT_JOB_EXCLUDED").otherwise("ALERT_JUSTIFIED").alias("event_type")))
    other = (k % 5 == 0) | (k % 10 == 9)
    found = stored.select("rule_code", "transaction_id", F.when(k % 10 == 9, F.concat(F.lit("n"), "correlation_id")).otherwise(F.col("correlation_id")).alias("correlation_id"), F.when(other, F.concat(F.lit("new:"), "finding_key")).otherwise(F.col("finding_key")).alias("finding_key"), (k % 9 == 0).alias("suppressed"))
    return C.merge_alerts(found, stored, history).groupBy("rule_code", "action").agg(F.count("*").alias("n"))


@query("d24_stale_alerts", PRE + ", " + _AL + " SELECT alert_id, 'JUSTIFIED' AS status, CASE WHEN CAST(transaction_key AS BIGINT) % 2 = 0 THEN 'REPLACED' ELSE 'RETIRED_NON_SALE' END AS reason FROM alr WHERE status IN ('OPEN', 'UNDER_REVIEW', 'CONFIRMED') AND CAST(transaction_key AS BIGINT) % 11 = 0 AND CAST(transaction_key AS BIGINT) % 3 <> 0")
def d24_stale_alerts(spark, sf):
    """Superseded episodes: replaced by a live one (even keys), without a sale now (odd ones), or neither (every third)."""
    stored, members, _, _ = _correlations(spark, sf)
    k = F.substring("correlation_id", 2, 99).cast("bigint")
    gone = members.where((k % 11 == 0) & (k % 3 != 0))
    new = gone.where(k % 2 == 0).withColumn("correlation_id", F.concat(F.lit("n"), "correlation_id"))
    both = stored.select("correlation_id", "status").unionByName(new.select("correlation_id").distinct().withColumn("status", F.lit(C.AUTOMATIC)))
    odd = gone.where(k % 2 == 1).select("document_id").withColumn("_odd", F.lit(True))
    docs = canonical(spark, sf).documents.join(odd, "document_id", "left").select("document_id", F.when(F.col("_odd"), "INVOICE").otherwise(F.col("type")).alias("type"))
    return C.justify_stale(_stored_alerts(spark, sf), both, members.unionByName(new), docs)


@query("d25_reclassified", PRE + """, a AS (SELECT 'N' || document_id AS id, CAST(transaction_key AS BIGINT) % 6 AS k, type, commercial_reference IS NOT NULL AS ref FROM m) SELECT id AS alert_id, 'FALSE_POSITIVE' AS status, d AS defect FROM (SELECT id, CASE k WHEN 0 THEN 'operator_rate_self_amplification' WHEN 1 THEN 'auxiliary_post_prebill_alert_noise' WHEN 2 THEN CASE WHEN type IN ('COMMERCIAL_DOCUMENT', 'MANAGEMENT_DOCUMENT', 'CONFORMING_COPY', 'REPRINT', 'DEVICE_RESPONSE') THEN 'printed_output_treated_as_late_action' END WHEN 3 THEN CASE WHEN type = 'PRE_BILL' THEN 'zero_value_technical_line_noise' END WHEN 4 THEN CASE WHEN type IN ('CONFORMING_COPY', 'REPRINT', 'DEVICE_RESPONSE') THEN 'output_artifact_duplicate_noise' END END AS d FROM a) WHERE d IS NOT NULL""")
def d25_reclassified(spark, sf):
    """An earlier engine's open alert on every document; a sixth of another rule, which stays."""
    _, members, _ = sales(spark, sf)
    k = F.col("transaction_key").cast("bigint") % 6
    rule = F.element_at(F.array(*map(F.lit, ("UNUSUAL_OPERATOR_PATTERN", "EXTREME_PRICE_CHANGE", "LATE_ORDER_MODIFICATION", "NEGATIVE_OR_ZERO_VALUE_ITEM", "DUPLICATE_DOCUMENT", "TOTAL_LINE_MISMATCH"))), (k + 1).cast("int"))
    old = members.select(F.concat(F.lit("N"), "document_id").alias("alert_id"), rule.alias("rule_code"), F.lit("OPEN").alias("status"), F.lit("engine-1").alias("implementation"), F.lit(1).alias("original_amount"))
    kind = F.element_at(F.array(*map(F.lit, ("-", "-", "late_order_event", "non_positive_item", "duplicate_document", "-"))), (k + 1).cast("int"))
    proof = members.select(F.concat(F.lit("N"), "document_id").alias("alert_id"), kind.alias("kind"), "document_id", F.when(F.col("type") == "PRE_BILL", "Totale").otherwise("Pane").alias("description"), F.lit(0).cast(values.MONEY).alias("unit_price"), F.lit(None).cast(values.MONEY).alias("line_total"))
    return C.reclassify(old, proof, members, ("engine-1", "engine-2"), "engine-1")


@query("s8_ledger_states", "WITH l AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'ARCHIVED' WHEN 'error' THEN 'odd' ELSE event_type END AS status FROM events) SELECT user_id, CASE last WHEN 'click' THEN 'QUEUED' WHEN 'view' THEN 'ACTIVE' WHEN 'signup' THEN 'DONE' WHEN 'ARCHIVED' THEN 'ARCHIVED' ELSE 'UNKNOWN' END AS state, n AS entries, last = 'ARCHIVED' AS hidden FROM (SELECT user_id, arg_max(status, event_id) AS last, count(*) AS n FROM l GROUP BY 1)")
def s8_ledger_states(spark, sf):
    """Each key's state after its whole ledger, by the status map; archived keys are out of sight."""
    e = read(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "ARCHIVED").when(F.col("event_type") == "error", "odd").otherwise(F.col("event_type")).alias("status"))
    return C.effective_state(e, "user_id", ["event_id"], {"click": "QUEUED", "view": "ACTIVE", "signup": "DONE", "ARCHIVED": "ARCHIVED"})


_ST = "st AS (SELECT user_id, event_type, ts, CAST(floor(value) AS BIGINT) AS spool FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)"
_NOW = "2024-01-30 00:00:00"


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest status of each device, from the event log."""
    e = R.latest(read(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return e.select(F.col("user_id").alias("device_id"), F.when(F.col("event_type").isin("click", "view"), "ONLINE").otherwise("OFFLINE").alias("status"), F.col("ts").cast("timestamp").alias("seen_at"), F.floor("value").cast("bigint").alias("spool_bytes"))


@query("d31_dashboard", PRE + ", " + _AL + ", " + _ST + ", " + _JOBS + f""", v AS (SELECT type FROM (SELECT *, {_CONTENT} AS has FROM documents_) WHERE type <> 'DEVICE_RESPONSE' AND (complete OR has)), live AS (SELECT * FROM alr WHERE status IN ('OPEN', 'UNDER_REVIEW', 'CONFIRMED')),
e AS (SELECT coalesce(max(difference) FILTER (rule_code = 'MODIFICA_POST_PRECONTO'), max(difference) FILTER (rule_code = 'PREBILL_FISCAL_AMOUNT_DROP')) AS d FROM live WHERE difference > 0 GROUP BY transaction_key),
days AS (SELECT strftime(opened_at, '%Y-%m-%d') AS day, count(*) AS n FROM live GROUP BY 1 ORDER BY 1 DESC LIMIT 30)
SELECT (SELECT count(*) FROM v) AS documents, (SELECT count(*) FROM v WHERE type IN ('ORDER', 'ORDER_CHANGE', 'KITCHEN_ORDER')) AS orders, (SELECT count(*) FROM v WHERE type = 'PRE_BILL') AS pre_bills, (SELECT count(*) FROM v WHERE type = 'MANAGEMENT_DOCUMENT') AS management_documents, (SELECT count(*) FROM v WHERE type = 'COMMERCIAL_DOCUMENT') AS commercial_documents, 0::BIGINT AS shift_end_reports, 0::BIGINT AS invoices,
(SELECT count(*) FROM live) AS open_alerts, (SELECT count(*) FROM live WHERE severity = 'CRITICAL') AS critical_alerts, (SELECT count(*) FROM live) AS operational_alerts, (SELECT count(*) FROM alr WHERE status = 'FALSE_POSITIVE') AS false_positive_alerts, (SELECT count(*) FROM alr WHERE status = 'JUSTIFIED') AS justified_alerts,
(SELECT coalesce(sum(d), 0)::DOUBLE FROM e WHERE d > 0) AS economic_difference, (SELECT coalesce(sum(d), 0)::DOUBLE FROM e WHERE d > 0) AS operational_economic_difference, (SELECT count(*) FROM e WHERE d > 0) AS economic_reduction_episodes,
(SELECT count(*) FROM j WHERE NOT {_P3} AND value >= 5 AND review_state = 'PENDING') AS incomplete_jobs, (SELECT count(*) FROM st WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '{_NOW}' - INTERVAL 10 MINUTE) AS devices_online, (SELECT sum(spool)::BIGINT FROM st) AS spool_bytes,
(SELECT count(*) FROM documents_ WHERE length(document_id) % 3 = 0) AS parse_errors, (SELECT '[' || string_agg('{{"date":"' || day || '","count":' || n || '}}', ',' ORDER BY day DESC) || ']' FROM days) AS alert_trend,
(SELECT count(*) FROM devices) - (SELECT count(*) FROM st WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '{_NOW}' - INTERVAL 10 MINUTE) AS devices_offline""")
def d31_dashboard(spark, sf):
    """All figures of the dashboard."""
    c, _, _ = sales(spark, sf)
    docs = R.has_content(c.payments, c.lines, c.documents)
    visible = docs.where((F.col("type") != "DEVICE_RESPONSE") & (F.col("complete") | F.col("has_content")))
    versions = c.documents.select("document_id", F.when(F.length("document_id") % 3 == 0, '["x"]').otherwise("[]").alias("errors"))
    return V.dashboard(visible, versions, written(alerts(spark, sf), "alerts"), jobs(spark, sf).withColumn("relevant", F.col("value") >= 5), statuses(spark, sf), c.devices.agg(F.count("*").alias("n")), _NOW)


@query("d29_document_view", PRE + "SELECT document_id, type, CASE type WHEN 'PRE_BILL' THEN 'Preconto' WHEN 'COMMERCIAL_DOCUMENT' THEN 'Documento commerciale' WHEN 'MANAGEMENT_DOCUMENT' THEN 'Documento gestionale' WHEN 'KITCHEN_ORDER' THEN 'Comanda' WHEN 'ORDER_CHANGE' THEN 'Variazione' WHEN 'CANCELLATION' THEN 'Annullo' WHEN 'CONFORMING_COPY' THEN 'Copia conforme' WHEN 'REPRINT' THEN 'Ristampa' ELSE 'Risposta dispositivo' END AS type_label, d.name AS device, d.department, external_code AS code, CASE WHEN external_code IS NOT NULL THEN 'FULL_CODE_OBSERVED_IN_CAPTURE' WHEN external_suffix IS NOT NULL THEN 'SUFFIX_ONLY_OBSERVED_IN_CAPTURE' WHEN type IN ('PRE_BILL', 'MANAGEMENT_DOCUMENT', 'CONFORMING_COPY', 'COMMERCIAL_DOCUMENT') THEN 'NOT_OBSERVED_IN_CAPTURE' ELSE 'NOT_APPLICABLE' END AS code_status, coalesce(n, 0) AS n_lines, lines_total::DOUBLE AS lines_total, first, coalesce(np, 0) AS n_payments, paid::DOUBLE AS paid FROM documents_ LEFT JOIN devices d USING (device_id) LEFT JOIN (SELECT document_id, count(*) AS n, sum(line_total) AS lines_total, arg_min(description, sequence) AS first FROM lines_ GROUP BY 1) USING (document_id) LEFT JOIN (SELECT document_id, count(*) AS np, sum(amount) AS paid FROM payments_ GROUP BY 1) USING (document_id)")
def d29_document_view(spark, sf):
    """The page of a document."""
    c = canonical(spark, sf)
    none = c.documents.select("document_id", F.lit(None).cast("string").alias("resolved")).where("false")
    v = V.document_view(c.documents, c.devices, c.lines, c.payments, none)
    return v.select("document_id", "type", "type_label", "device", "department", "code", "code_status", "n_lines", "lines_total", F.get("lines", F.lit(0))["description"].alias("first"), "n_payments", "paid")


@query("d30_alert_view", PRE + ", " + _AL + " SELECT alert_id, n_docs, devices, operators, 2::BIGINT AS pieces, 'ALERT_OPENED:OPEN' || CASE WHEN status <> 'OPEN' THEN ',ALERT_UPDATED:' || status ELSE '' END AS history FROM alr JOIN (SELECT transaction_key, count(*) AS n_docs, string_agg(DISTINCT device_id, ',' ORDER BY device_id) AS devices, string_agg(DISTINCT operator_code, ',' ORDER BY operator_code) AS operators FROM m GROUP BY 1) USING (transaction_key)")
def d30_alert_view(spark, sf):
    """Documents, devices, evidence and history beside each alert."""
    _, members, _ = sales(spark, sf)
    a = written(alerts(spark, sf), "alerts")
    evidence = a.select("alert_id", F.explode(F.array(F.struct(F.lit(1).alias("sequence"), F.lit("{}").alias("evidence")), F.struct(F.lit(2).alias("sequence"), F.lit("[]").alias("evidence")))).alias("e")).select("alert_id", "e.*")
    history = a.select("alert_id", F.lit(1).alias("sequence"), F.lit("ALERT_OPENED").alias("event_type"), F.lit("OPEN").alias("status")).unionByName(a.where("status <> 'OPEN'").select("alert_id", F.lit(2).alias("sequence"), F.lit("ALERT_UPDATED").alias("event_type"), "status"))
    v = V.alert_view(a, members, evidence, history)
    return v.select("alert_id", "n_docs", "devices", "operators", F.size("evidence").alias("pieces"), "history")


@query("u2_timeline", PRE + ", " + _AL + ", " + _EV + " SELECT transaction_key, string_agg(kind || ' ' || id, ',' ORDER BY wh, kind, id) AS timeline FROM (SELECT transaction_key, strftime(time, '%Y-%m-%d %H:%M:%S') AS wh, 'DOCUMENT' AS kind, document_id AS id FROM m UNION ALL SELECT transaction_key, strftime(time, '%Y-%m-%d %H:%M:%S'), 'EVENT', event_type || ':' || document_id || ':' || detail FROM ev UNION ALL SELECT transaction_key, strftime(opened_at, '%Y-%m-%d %H:%M:%S'), 'ALERT', alert_id FROM alr) GROUP BY 1")
def u2_timeline(spark, sf):
    """Documents, events and alerts of every episode in one list."""
    c = context(spark, sf, events=True)
    return V.timeline(c.members, c.events, alerts(spark, sf))


@query("j7_history", PRE + ", " + _AL + " SELECT alert_id, CAST(epoch(first) AS BIGINT) AS occurred FROM alr JOIN (SELECT transaction_key, min(time) AS first FROM m GROUP BY 1) USING (transaction_key) WHERE status IN ('FALSE_POSITIVE', 'JUSTIFIED')")
def j7_history(spark, sf):
    """Archived alerts beside the first paper of the correlation they were raised on, live or superseded."""
    _, members, _, ids = _correlations(spark, sf)
    when = canonical(spark, sf).documents.select("document_id", F.coalesce("document_time", "captured_at").alias("at"))
    first = members.join(when, "document_id").groupBy("correlation_id").agg(F.min("at").alias("occurred"))
    a = _stored_alerts(spark, sf).where(F.col("status").isin("FALSE_POSITIVE", "JUSTIFIED"))
    return a.join(first, "correlation_id").select("alert_id", "occurred")


@query("w2_latest_occurrence", PRE + ", " + _AL + " SELECT alert_id, CAST(epoch(last_at) AS BIGINT) AS occurred, d AS document_id FROM alr JOIN (SELECT transaction_key, max(time) AS last_at, max(document_id) FILTER (time = mx) AS d FROM (SELECT *, max(time) OVER (PARTITION BY transaction_key) AS mx FROM m) GROUP BY 1) USING (transaction_key) WHERE status IN ('OPEN', 'UNDER_REVIEW', 'CONFIRMED')")
def w2_latest_occurrence(spark, sf):
    """Live alerts beside the latest paper of their transaction."""
    _, members, _ = sales(spark, sf)
    last = R.latest(members.select("transaction_key", "document_id", "time"), ["transaction_key"], [F.desc("time"), F.desc("document_id")])
    a = alerts(spark, sf).where(F.col("status").isin(*schema.OPERATIONAL_STATES))
    return a.join(last, "transaction_key").select("alert_id", F.col("time").alias("occurred"), "document_id")


@query("a12_last_snapshot", PRE + ", " + _EV + " SELECT transaction_key, count(*) AS last FROM ev GROUP BY 1")
def a12_last_snapshot(spark, sf):
    """The last sequence of every order's numbered events."""
    return T.numbered(context(spark, sf, events=True).events).groupBy("transaction_key").agg(F.max("sequence").alias("last"))


@query("p7_relevant_jobs", PRE + ", " + _JOBS + ", d AS (SELECT 'J' || CAST(regexp_extract(job_id, '([0-9]+)$', 1) AS BIGINT) AS job_id FROM (SELECT *, " + _CONTENT + " AS has FROM documents_) WHERE type <> 'DEVICE_RESPONSE' AND (complete OR has)) SELECT job_id FROM j WHERE import_status NOT IN ('PARSED', 'PARSE_EMPTY') OR job_id IN (FROM d)")
def p7_relevant_jobs(spark, sf):
    """Jobs not parsed yet, or with an operator-visible document."""
    c = canonical(spark, sf)
    d = R.has_content(c.payments, c.lines, c.documents).where((F.col("type") != "DEVICE_RESPONSE") & (F.col("complete") | F.col("has_content")))
    seen = d.select(F.concat(F.lit("J"), F.regexp_extract("job_id", "([0-9]+)$", 1).cast("bigint").cast("string")).alias("job_id")).distinct().withColumn("_seen", F.lit(True))
    return jobs(spark, sf).join(seen, "job_id", "left").where(~F.col("import_status").isin("PARSED", "PARSE_EMPTY") | F.col("_seen").isNotNull()).select("job_id")


@query("u5_dedup_union", PRE + "SELECT transaction_key, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM (SELECT transaction_key, document_id AS id FROM m UNION ALL SELECT a.transaction_key, b.document_id FROM m a JOIN m b ON a.type = 'COMMERCIAL_DOCUMENT' AND b.type = 'COMMERCIAL_DOCUMENT' AND a.device_id = b.device_id AND CAST(a.time AS DATE) = CAST(b.time AS DATE)) GROUP BY 1")
def u5_dedup_union(spark, sf):
    """An episode's members and, for its fiscal documents, those of the same device and day to compare with; each once."""
    _, members, _ = sales(spark, sf)
    f = members.where("type = 'COMMERCIAL_DOCUMENT'").select("transaction_key", "device_id", F.to_date("time").alias("day"), "document_id")
    near = f.select("transaction_key", "device_id", "day").join(f.select("device_id", "day", "document_id"), ["device_id", "day"]).select("transaction_key", "document_id")
    both = members.select("transaction_key", "document_id").unionByName(near).dropDuplicates(["transaction_key", "document_id"])
    return both.groupBy("transaction_key").agg(F.array_sort(F.collect_list("document_id")).alias("ids"))


@query("w5_running_state", PRE + """, s AS (SELECT CASE WHEN document_id[1] = 'H' THEN 2 ELSE 1 END AS ord, substr(l.document_id, 2) AS tk, item_key, quantity FROM kl l WHERE document_id[1] IN ('K', 'H') AND substr(document_id, 2) IN (SELECT substr(document_id, 2) FROM documents_ WHERE type = 'ORDER_CHANGE')),
a AS (SELECT tk, item_key, sum(quantity) FILTER (ord = 1) AS q1, sum(quantity) AS q2 FROM s GROUP BY 1, 2) SELECT tk AS transaction_key, count(*) FILTER (q1 > 0) AS before_lines, count(*) FILTER (q2 > 0 AND q1 IS NOT NULL) AS after_lines, (sum(q2) FILTER (q2 > 0 AND q1 IS NOT NULL))::DOUBLE AS quantity FROM a GROUP BY 1""")
def w5_running_state(spark, sf):
    """The state of a table's kitchen lines before and after its change ticket."""
    c = canonical(spark, sf)
    tk = F.substring("document_id", 2, 99)
    change = c.lines.where("document_id LIKE 'H%'").withColumn("tk", tk)
    changed = c.documents.where("type = 'ORDER_CHANGE'").select(tk.alias("tk"))
    kitchen = c.lines.where("document_id LIKE 'K%'").withColumn("tk", tk).join(changed, "tk", "left_semi")
    state = L.engine_lines(kitchen, ["tk"], ["sequence"])
    deltas = L.engine_lines(change, ["tk"], ["sequence"]).select("tk", "item_key", F.lit(1).alias("ordinal"), "quantity", F.lit(False).alias("removed"))
    after = L.apply_deltas(state, deltas, ["tk"]).groupBy("tk").agg(F.count("*").alias("after_lines"), F.sum("quantity").alias("quantity"))
    return state.groupBy("tk").agg(F.count("*").alias("before_lines")).join(after, "tk", "left").select(F.col("tk").alias("transaction_key"), "before_lines", F.coalesce("after_lines", F.lit(0)).alias("after_lines"), "quantity")


@query("a31_latest_after_limit", PRE + ", " + _AL + ", h AS (SELECT *, row_number() OVER (ORDER BY opened_at DESC, alert_id DESC) AS n FROM alr) SELECT transaction_key, arg_min(alert_id, n) AS alert_id FROM h WHERE n <= 500 GROUP BY 1")
def a31_latest_after_limit(spark, sf):
    """Of the newest 500 alerts (as the page loads them), the first seen of each transaction."""
    a = R.page(alerts(spark, sf).select("transaction_key", "alert_id", "opened_at"), [F.desc("opened_at"), F.desc("alert_id")], 500)
    return R.latest(a, ["transaction_key"], [F.desc("opened_at"), F.desc("alert_id")]).select("transaction_key", "alert_id")


@query("m5_spool_health", "WITH " + _ST + " SELECT user_id AS device_id, spool AS bytes, CASE WHEN event_type NOT IN ('click', 'view') THEN 'offline' WHEN spool > 50 THEN 'degraded' ELSE 'ok' END AS health FROM st")
def m5_spool_health(spark, sf):
    """The spool's health by the latest status of each device."""
    s = statuses(spark, sf)
    return s.select("device_id", F.col("spool_bytes").alias("bytes"), F.when(F.col("status") != "ONLINE", "offline").when(F.col("spool_bytes") > 50, "degraded").otherwise("ok").alias("health"))


@query("j21_responses", "WITH q AS (SELECT event_id, user_id, ts, event_type, event_id % 10 AS seq FROM events WHERE event_type IN ('click', 'view')) SELECT a.event_id AS request, min(b.event_id) AS response FROM q a JOIN q b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'view' AND b.seq = (a.seq + 8) % 10 AND b.event_id > a.event_id WHERE NOT EXISTS (SELECT 1 FROM q c WHERE c.user_id = a.user_id AND c.event_type = 'click' AND c.seq = a.seq AND c.event_id > a.event_id AND c.event_id < b.event_id) GROUP BY 1")
def j21_responses(spark, sf):
    """A request and the first answer after it whose sequence digit is eight further, before the digit is asked again."""
    from tillsight.sources.parsers import paired_frames

    e = read(spark, sf, "events").where(F.col("event_type").isin("click", "view"))
    frames = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("at"), (F.col("event_id") % 10).cast("int").alias("sequence"), (F.col("event_type") == "click").alias("request"))
    return paired_frames(frames).select(F.col("at").alias("request"), F.col("response_at").alias("response"))


@query("s18_endpoint_device", "SELECT s_suppkey, CASE WHEN s_nationkey < 20 AND s_suppkey % 5 <> 0 THEN 'dev_' || s_nationkey END AS device_id FROM supplier")
def s18_endpoint_device(spark, sf):
    """Endpoints ``host:port`` of configured devices, case and blanks aside; unknown ones and other ports have none."""
    s = read(spark, sf, "supplier")
    port = F.when(F.col("s_suppkey") % 5 == 0, "9101").otherwise("9100")
    seen = s.select("s_suppkey", F.concat(F.lit(" POS-"), F.col("s_nationkey").cast("string"), F.lit(".LOCAL:"), port).alias("endpoint"))
    known = read(spark, sf, "nation").where("n_nationkey < 20").select(F.concat(F.lit("dev_"), F.col("n_nationkey").cast("string")).alias("device_id"), F.concat(F.lit("pos-"), F.col("n_nationkey").cast("string"), F.lit(".local")).alias("host"), F.lit(9100).alias("port"))
    return R.endpoint_devices(seen, known).select("s_suppkey", "device_id")


@query("m6_device_sync", "SELECT coalesce('dev_' || s_suppkey, 'dev_' || k) AS device_id, CASE WHEN s_suppkey IS NULL THEN 'INSERTED' WHEN k IS NULL THEN 'DISABLED' WHEN s_suppkey % 4 = 0 THEN 'UPDATED' ELSE 'UNCHANGED' END AS action FROM supplier FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 <> 0) ON s_suppkey = k")
def m6_device_sync(spark, sf):
    """M6: stored devices after the configuration was read again."""
    stored = canonical(spark, sf).devices.select("device_id", F.concat(F.lit("n"), "ordinal").alias("name"))
    wanted = read(spark, sf, "part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("dev_"), "p_partkey").alias("device_id"), F.concat(F.when(F.col("p_partkey") % 4 == 0, "x").otherwise("n"), "p_partkey").alias("name"))
    return R.synchronised(stored, wanted, "device_id", ["name"]).select("device_id", "action")


_VS = """vs AS MATERIALIZED (SELECT document_id, CASE WHEN device_id IN ('dev_1', 'dev_2', 'dev_3', 'dev_4', 'dev_5') THEN 'pos' ELSE 'rch' END AS parser_name, unnest(range(1, 2 + length(document_id) % 3)) AS sequence, type, order_code, table_code FROM documents_),
act AS (SELECT 'pos' AS parser_name, 'pos-1' AS version_id)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parsed versions of every document, one to three; the till parser's first version was made active again."""
    d = canonical(spark, sf_dir).documents
    parser = F.when(F.col("device_id").isin(*[f"dev_{i}" for i in range(1, 6)]), "pos").otherwise("rch")
    v = d.select("document_id", parser.alias("parser_name"), F.explode(F.sequence(F.lit(1), 1 + F.length("document_id") % 3)).alias("sequence"), "type", "order_code", "table_code")
    v = v.withColumns({"parser_version": F.concat_ws("-", "parser_name", "sequence"), "version_id": F.concat_ws(":", "document_id", "sequence")})
    return v, spark.createDataFrame([("pos", "pos-1")], "parser_name string, version_id string")


@query("w1_active_versions", PRE + ", " + _VS + " SELECT document_id, parser_name || '-' || sequence AS parser_version FROM vs LEFT JOIN act USING (parser_name) QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY (parser_name || '-' || sequence = version_id) DESC NULLS LAST, sequence DESC) = 1")
def w1_active_versions(spark, sf):
    """The active version of a document, else the latest."""
    return R.active_versions(*versions(spark, sf)).select("document_id", "parser_version")


@query("j2_left_active", PRE + ", " + _VS + " SELECT parser_name || '-' || sequence AS parser_version, count(*) AS n, coalesce(parser_name || '-' || sequence = version_id, FALSE) AS active FROM vs LEFT JOIN act USING (parser_name) GROUP BY 1, 3")
def j2_left_active(spark, sf):
    """Parser versions beside what is active; a parser without an active version stays."""
    v, a = versions(spark, sf)
    joined = v.join(F.broadcast(a.withColumnRenamed("version_id", "active_version")), "parser_name", "left")  # one row a parser
    return joined.groupBy("parser_version", F.coalesce(F.col("parser_version") == F.col("active_version"), F.lit(False)).alias("active")).agg(F.count("*").alias("n"))


@query("d34_backfill", PRE + ", " + _VS + " SELECT document_id || ':' || sequence AS version_id, type, order_code, table_code FROM vs")
def d34_backfill(spark, sf):
    """Versions without meaning of their own take their document's, as a whole row."""
    v, _ = versions(spark, sf)
    cols = ["type", "order_code", "table_code"]
    bare = v.select("document_id", "version_id", *[F.when(F.col("sequence") > 1, F.col(c)).alias(c) for c in cols])
    parent = canonical(spark, sf).documents.select("document_id", *[F.col(c).alias(f"d_{c}") for c in cols])
    return bare.join(parent, "document_id", "left").select("version_id", *R.versioned(cols, [f"d_{c}" for c in cols]))


@query("a29_ocr_lines", "SELECT l_orderkey, string_agg('W' || l_partkey, ' ' ORDER BY l_linenumber, 'W' || l_partkey) AS text, round(sum(l_quantity * (1 + length(l_partkey::VARCHAR))) / sum(1 + length(l_partkey::VARCHAR)), 6) AS confidence, min(l_partkey % 100)::BIGINT AS left, min(l_suppkey % 50)::BIGINT AS top, max(l_partkey % 100 + 10)::BIGINT AS right, max(l_suppkey % 50 + 4)::BIGINT AS bottom FROM lineitem WHERE l_quantity > 5 AND l_partkey % 9 <> 0 GROUP BY 1")
def a29_ocr_lines(spark, sf):
    """Words of a line with weighted confidence and the box around them; bad ones and blanks are none."""
    from tillsight.sources.tickets import ocr_lines

    i = read(spark, sf, "lineitem")
    w = i.select("l_orderkey", F.col("l_linenumber").alias("place"), F.when(F.col("l_partkey") % 9 == 0, " ").otherwise(F.concat(F.lit(" W"), F.col("l_partkey").cast("string"))).alias("text"), F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("double")).otherwise(-1.0).alias("confidence"), (F.col("l_partkey") % 100).alias("left"), (F.col("l_suppkey") % 50).alias("top"), F.lit(10).alias("width"), F.lit(4).alias("height"))
    return ocr_lines(w, ["l_orderkey"]).withColumn("confidence", F.round("confidence", 6))


@query("u6_ordered_unique", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'parser_input_limit_exceeded,' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'odd_' || lang || ',' ELSE '' END || 'document_timestamp_invalid' || CASE WHEN doc_id % 3 <> 0 THEN ',odd_' || lang ELSE '' END AS warnings FROM documents")
def u6_ordered_unique(spark, sf):
    """Warnings of the stages of a parse, in order, each once."""
    k, odd = F.col("doc_id"), F.concat(F.lit("odd_"), "lang")
    lists = F.when(k % 2 == 0, F.array(F.lit("parser_input_limit_exceeded"))), F.when(k % 3 == 0, F.array(odd, odd)), F.array(F.lit("document_timestamp_invalid"), F.lit(None).cast("string")), F.array(odd, F.lit("document_timestamp_invalid"))
    return read(spark, sf, "documents").select("doc_id", labels.merged_warnings(*lists).alias("warnings"))


@query("f49_alert_defaults", PRE + ", " + _AL + " SELECT 'default' AS asked, count(*) AS n FROM alr WHERE status IN ('OPEN', 'UNDER_REVIEW', 'CONFIRMED') AND difference >= 0.01 UNION ALL SELECT 'archive', count(*) FROM alr WHERE status IN ('FALSE_POSITIVE', 'JUSTIFIED', 'CLOSED') AND difference >= 0.01 UNION ALL SELECT 'critical', count(*) FROM alr WHERE severity = 'CRITICAL' AND difference >= 5000")
def f49_alert_defaults(spark, sf):
    """alert lists with nothing asked for, and with more."""
    a = written(alerts(spark, sf), "alerts")
    out = None
    for name, asked in (("default", {"view": "", "severity": None}), ("archive", {"view": "archive"}), ("critical", {"view": "all", "severity": "CRITICAL", "minimum_difference": 5000})):
        n = a.where(labels.alert_filter(asked)).agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("d18_snapshot_stream", PRE + ", f AS (SELECT transaction_key, min(sequence) AS s FROM kl JOIN m USING (document_id) WHERE type = 'PRE_BILL' GROUP BY 1), g AS (SELECT 'V' || document_id AS document_id, item_key, count(*) FILTER (kl.sequence <> f.s) AS others FROM kl JOIN m USING (document_id) JOIN f USING (transaction_key) WHERE type = 'PRE_BILL' GROUP BY 1, 2 HAVING count(*) FILTER (kl.sequence = f.s) > 0) SELECT document_id, item_key, CASE WHEN others > 0 THEN 'QUANTITY_CHANGED' ELSE 'REMOVED' END AS change_type FROM g")
def d18_snapshot_stream(spark, sf):
    """A second pre-bill a minute later without the first line."""
    c, members, _ = sales(spark, sf)
    bill = members.where("type = 'PRE_BILL'")
    again = bill.withColumns({"document_id": F.concat(F.lit("V"), "document_id"), "time": F.col("time") + F.expr("INTERVAL 1 MINUTE")})
    own = c.lines.join(bill.select("document_id"), "document_id", "left_semi")
    w = Window.partitionBy("document_id")
    rest = own.withColumn("_least", F.min("sequence").over(w)).where("sequence <> _least").drop("_least").withColumn("document_id", F.concat(F.lit("V"), "document_id"))
    # A bill of one line has no second snapshot with lines, so such pairs are told by the others.
    rest = rest.unionByName(own.withColumn("_n", F.count("*").over(w)).where("_n = 1").drop("_n").withColumns({"document_id": F.concat(F.lit("V"), "document_id"), "item_code": F.lit("OTHER")}))
    found = T.snapshot_changes(members.unionByName(again), c.lines.unionByName(rest), ("PRE_BILL",))
    return found.where("change_type <> 'ADDED'").select("document_id", "item_key", "change_type")


@query("d18_kitchen_stream", PRE + ", s AS (SELECT substr(document_id, 2) AS tk, item_key, sum(quantity) FILTER (document_id[1] = 'K') AS q0, sum(quantity) FILTER (document_id[1] = 'H') AS q1 FROM kl WHERE document_id[1] IN ('K', 'H') GROUP BY 1, 2) SELECT 'H' || tk AS document_id, item_key, CASE WHEN q0 + q1 <= 0 THEN 'REMOVED' ELSE 'QUANTITY_CHANGED' END AS change_type FROM s WHERE q0 IS NOT NULL AND q1 IS NOT NULL")
def d18_kitchen_stream(spark, sf):
    """What change tickets do to the kitchen lines before them."""
    c, members, _ = sales(spark, sf)
    return T.kitchen_changes(members, c.lines).select("document_id", "item_key", "change_type")


_ZERO = "0" * 64


@query("d19_chain", PRE.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _EV + f""", n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY transaction_key ORDER BY time, event_type, document_id, detail) AS sequence FROM ev),
c AS (SELECT transaction_key, sequence, '{_ZERO}' AS previous_hash, sha256(from_hex('{_ZERO}') || encode('{{"document_id":"' || document_id || '","event_type":"' || event_type || '"}}')) AS record_hash FROM n WHERE sequence = 1
UNION ALL SELECT n.transaction_key, n.sequence, c.record_hash, sha256(from_hex(c.record_hash) || encode('{{"document_id":"' || n.document_id || '","event_type":"' || n.event_type || '"}}')) FROM c JOIN n ON n.transaction_key = c.transaction_key AND n.sequence = c.sequence + 1)
SELECT transaction_key, sequence, previous_hash, record_hash FROM c""")
def d19_chain(spark, sf):
    """The hash chain over every order's events."""
    log = T.numbered(context(spark, sf, events=True).events)
    payload = values.canonical_json({"event_type": F.col("event_type"), "document_id": F.col("document_id")})
    return T.hash_chain(log, "transaction_key", "sequence", payload)


@query("f35_offset_label", "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'Non calcolabile: uno o entrambi gli orari non sono stati osservati nel flusso' WHEN event_id % 13 = 0 THEN 'Scarto non valido' WHEN s = 0 THEN '0 s (orologi allineati al minuto/secondo osservato)' ELSE CASE WHEN s < 0 THEN '' ELSE '+' END || s || ' s (footer RCH ' || CASE WHEN s < 0 THEN 'indietro' ELSE 'avanti' END || ' di ' || CASE WHEN abs(s) >= 60 THEN abs(s) // 60 || ' min' ELSE '' END || CASE WHEN abs(s) >= 60 AND abs(s) % 60 > 0 THEN ' ' ELSE '' END || CASE WHEN abs(s) % 60 > 0 THEN abs(s) % 60 || ' s' ELSE '' END || ' rispetto all''ora applicativa)' END AS label FROM (SELECT event_id, event_id % 400 - 200 AS s FROM events)")
def f35_offset_label(spark, sf):
    k = F.col("event_id")
    return read(spark, sf, "events").select("event_id", exports.offset_label(F.when(k % 11 == 0, None).when(k % 13 == 0, "soon").otherwise((k % 400 - 200).cast("string"))).alias("label"))


@query("f34_text_export", r"SELECT doc_id, sha256('VISTA' || chr(10) || 'Il RAW immutabile resta autoritativo.' || chr(10) || chr(10) || CASE WHEN k = 0 THEN 'INTESTAZIONE DOCUMENTO' || chr(10) || 'Insegna: Bar ' || lang || chr(10) || 'Indirizzo: Via 1' || chr(10) || 'Indirizzo 3: ' || source || chr(10) || 'Partita IVA: 0' || doc_id || chr(10) || 'Provenienza intestazione: Configurata sul dispositivo (non osservata nel flusso)' || chr(10) || chr(10) ELSE '' END || 'TESTO DOCUMENTO' || chr(10) || coalesce(nullif(b, ''), 'Nessun testo documento disponibile.') || CASE k WHEN 0 THEN '' WHEN 1 THEN chr(10) || chr(10) || 'PROVENIENZA INTESTAZIONE' || chr(10) || 'Non osservata nel flusso e non configurata' ELSE chr(10) || chr(10) || 'PROVENIENZA INTESTAZIONE' || chr(10) || 'Osservata nel blocco iniziale stampato dalla RCH' END || chr(10)) AS h FROM (SELECT *, doc_id % 3 AS k, CASE WHEN doc_id % 7 = 0 THEN '' ELSE trim(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) END AS b FROM documents)")
def f34_text_export(spark, sf):
    """The text view of whole documents with a configured, a printed or no header."""
    k, none = F.col("doc_id") % 3, F.lit(None).cast("string")
    evidence = F.when(k == 0, "DEVICE_METADATA_CONFIGURED").otherwise("RCH_PRINTED_HEADER")
    header = F.struct(F.concat(F.lit(" Bar "), "lang").alias("merchant_name"), F.lit(" \x07").alias("legal_name"), F.array(F.lit("Via 1"), F.lit("  "), F.col("source")).alias("address_lines"), none.alias("phone"), none.alias("tax_code"), F.concat(F.lit("0"), F.col("doc_id").cast("string")).alias("vat_number"), evidence.alias("evidence"))
    return read(spark, sf, "documents").select("doc_id", F.sha2(exports.text_export(F.when(F.col("doc_id") % 7 == 0, " \n").otherwise(F.col("text")), F.when(k != 1, header), "VISTA"), 256).alias("h"))


@query("f34_identity_lines", "SELECT event_id, 'Ora applicativa RCH: ' || CASE WHEN k = 0 THEN 'Non osservato nel flusso' WHEN k = 1 THEN strftime(r, '%d/%m/%Y %H:%M') ELSE strftime(r, '%d/%m/%Y %H:%M:%S') END || '|  Provenienza: ' || CASE WHEN k = 0 THEN 'Non osservato nel flusso' ELSE 'testo applicativo stampato dalla RCH' END || '|Acquisizione server: ' || strftime(r, '%d/%m/%Y %H:%M:%S') || '|  Provenienza: timestamp registrato dal server; non e'' un orario stampato dalla RCH|Ora footer RCH: Non osservato nel flusso|  Provenienza: Non osservato nel flusso|Scarto orologio (footer - applicativa): Non calcolabile: uno o entrambi gli orari non sono stati osservati nel flusso|Seriale RCH: ' || CASE WHEN k = 2 THEN 'Non osservato nel flusso|  Provenienza: Non osservato nel flusso' ELSE 'RT' || user_id || '|  Provenienza: evidenza dichiarata: ' || event_type END AS lines FROM (SELECT *, event_id % 3 AS k, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome' AS r FROM events)")
def f34_identity_lines(spark, sf):
    """times and serial of a document with where each comes from."""
    k, none, ts = F.col("event_id") % 3, F.lit(None).cast("string"), F.col("ts").cast("timestamp")
    d = {
        "application_time": F.when(k != 0, ts), "application_precision": F.when(k == 1, "MINUTE").otherwise("SECOND"), "application_evidence": F.lit("RCH_APPLICATION_PRINTED_TEXT"), "footer_time": none.cast("timestamp"), "footer_precision": none, "footer_evidence": none,
        "captured_at": ts, "offset": none, "serial": F.when(k != 2, F.concat(F.lit(" RT"), F.col("user_id").cast("string"))), "serial_evidence": F.col("event_type"),
    }
    return read(spark, sf, "events").select("event_id", F.array_join(exports.identity_lines(d), "|").alias("lines"))


_CSV = """ SELECT 0::BIGINT AS n, 'id,regola,severita,punteggio,stato,aperto_il,descrizione' AS line UNION ALL SELECT n, line FROM (SELECT row_number() OVER (ORDER BY opened_at DESC, alert_id) AS n, alert_id || ',' || rule_code || ',' || severity || ',' || CASE WHEN CAST(transaction_key AS BIGINT) % 2 = 0 THEN '' ELSE '''-' || transaction_key END || ',' || status || ',' || strftime(opened_at, '%Y-%m-%dT%H:%M:%S') || ',"Una ""riga"", ' || transaction_key || '"' AS line FROM alr) WHERE n <= 10000"""


@query("k6_alert_csv", PRE + ", " + _AL + _CSV)
def k6_alert_csv(spark, sf):
    """The alert list as CSV records, ten thousand at most as the page offers them, after a header."""
    a, key = alerts(spark, sf), F.col("transaction_key")
    points = F.when(key.cast("bigint") % 2 != 0, F.concat(F.lit("-"), key))
    line = exports.csv_line(F.col("alert_id"), F.col("rule_code"), F.col("severity"), points, F.col("status"), F.date_format("opened_at", "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.lit('Una "riga", '), key))
    first = R.page(a.select("opened_at", "alert_id", line.alias("line")), [F.desc("opened_at"), "alert_id"], 10_000)
    rows = first.withColumn("n", F.row_number().over(Window.orderBy(F.desc("opened_at"), "alert_id")).cast("bigint")).select("n", "line")  # a page of bounded size
    return rows.unionByName(spark.createDataFrame([(0, ",".join(exports.CSV_HEADER))], "n bigint, line string"))
