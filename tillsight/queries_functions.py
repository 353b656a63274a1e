"""Registered queries over the scalar library, jobs, captures, chains and workflow logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillsight.functions import text, values
from tillsight.operators import relational as R
from tillsight.operators import rules as U
from tillsight.operators import workflow as W
from tillsight.queries_sales import _JOBS, jobs
from tillsight.registry import query


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("f1_identity_key", r"SELECT doc_id, sha256(nullif(trim(regexp_replace(upper(replace(strip_accents(text), 'ß', 'SS')), '[\s\x{00a0}]+', ' ', 'g')), '')) AS key FROM documents")
def f1_identity_key(spark, sf):
    """F1 of whole texts."""
    return read(spark, sf, "documents").select("doc_id", F.sha2(text.identity(F.col("text")), 256).alias("key"))


@query("f2_scope_value", "SELECT doc_id, nullif(trim(regexp_replace(upper(lang || '  ' || source || ' '), '\\s+', ' ', 'g')), '') AS v FROM documents")
def f2_scope_value(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.scope_value(F.concat("lang", F.lit("  "), "source", F.lit(" "))).alias("v"))


@query("f3_price_description", "SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS v, nullif(trim(p_brand), '') AS code FROM part")
def f3_price_description(spark, sf):
    """F3, F4."""
    return read(spark, sf, "part").select("p_partkey", text.price_description(F.col("p_name")).alias("v"), text.price_code(F.col("p_brand")).alias("code"))


@query("q_line_groups", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL")
def q_line_groups(spark, sf):
    return read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("f10_unit_price", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, ((200 * round(l_extendedprice * 100)::BIGINT + l_quantity::BIGINT) // (2 * l_quantity::BIGINT)) / 10000.0 AS price, CASE WHEN l_partkey % 3 = 0 THEN 'OBSERVED_UNIT_PRICE' ELSE 'DERIVED_FROM_OBSERVED_LINE_TOTAL' END AS origin FROM lineitem")
def f10_unit_price(spark, sf):
    """price and its origin; a third of the lines have a printed price, the others their total alone."""
    total, quantity = F.round("l_extendedprice", 2).cast("decimal(19,2)"), F.col("l_quantity").cast("decimal(19,0)")
    printed = F.when(F.col("l_partkey") % 3 == 0, values.half_up(total / quantity))
    p = values.unit_price(printed, total, quantity)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", p["price"].alias("price"), p["origin"].alias("origin"))


@query("f11_half_up", "SELECT e, CAST(e AS DECIMAL(19,6)) / 1000000 AS x, (CASE WHEN e % 100 >= 50 THEN e // 100 + 1 ELSE e // 100 END)::DOUBLE / 10000 AS up FROM (SELECT event_id AS e FROM events)")
def f11_half_up(spark, sf):
    x = (F.col("event_id").cast("decimal(19,0)") / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(19,6)")
    return read(spark, sf, "events").select(F.col("event_id").alias("e"), x.alias("x"), values.half_up(x).alias("up"))


@query("f12_percent", "SELECT o_orderkey, round_even((o_orderkey % 97)::DOUBLE / (o_orderkey % 89 + 1)::DOUBLE * 100, 4) AS p FROM orders")
def f12_percent(spark, sf):
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select("o_orderkey", values.percent((k % 97).cast("decimal(19,4)"), (k % 89 + 1).cast("decimal(19,4)")).alias("p"))


@query("f13_suffixes", "SELECT p_partkey, regexp_extract(p_name, '^(.*?)([0-9]+)$', 1) AS prefix, TRY_CAST(regexp_extract(p_brand, '^(.*?)([0-9]+)$', 2) AS DOUBLE) AS number, nullif(regexp_extract('AB-' || p_partkey, '(?:^|[-/])([0-9]{1,8})$', 1), '') AS counter, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR END AS worker FROM part")
def f13_suffixes(spark, sf):
    """F13 to F15."""
    p = read(spark, sf, "part")
    code = F.concat(F.lit("AB-"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("x"))
    return p.select("p_partkey", F.regexp_extract("p_name", r"^(.*?)(\d+)$", 1).alias("prefix"), text.numeric_suffix(F.col("p_brand"))["number"].alias("number"), text.counter_suffix(F.concat(F.lit("AB-"), F.col("p_partkey").cast("string"))).alias("counter"), text.worker_suffix(code).alias("worker"))


@query("f19_jaccard", "WITH s AS (SELECT o_orderkey, list_distinct(list(l_partkey % 20)) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) SELECT a.o_orderkey, len(list_intersect(a.k, b.k))::DOUBLE / len(list_distinct(list_concat(a.k, b.k))) AS j FROM s a JOIN s b ON b.o_orderkey = a.o_orderkey + 1")
def f19_jaccard(spark, sf):
    s = read(spark, sf, "lineitem").join(read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 20).alias("k"))
    b = s.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("k").alias("kb"))
    return s.join(b, "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), (F.size(F.array_intersect("k", "kb")) / F.size(F.array_union("k", "kb"))).alias("j"))


@query("f20_tolerant_cast", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS n, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS alias FROM events")
def f20_tolerant_cast(spark, sf):
    """F20, F21."""
    return read(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("n"), F.coalesce(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k")).alias("alias"))


@query("f22_confidence", "SELECT event_id, (CASE WHEN event_id % 300 <= 100 THEN event_id % 300 ELSE (event_id % 300) // 100 END)::BIGINT AS c, (CASE WHEN event_type = 'view' THEN 100 WHEN event_type = 'click' THEN 65 ELSE 25 END)::BIGINT AS w FROM events")
def f22_confidence(spark, sf):
    v = (F.col("event_id") % 300).cast("decimal(9,0)") / F.lit(100).cast("decimal(3,0)")
    word = F.when(F.col("event_type") == "view", "confirmed by print").when(F.col("event_type") == "click", "inferred").otherwise("UNCONFIRMED")
    return read(spark, sf, "events").select("event_id", values.confidence(v, word).alias("c"), values.confidence(F.lit(None).cast("string"), word).alias("w"))


@query("f23_printed_money", "SELECT event_id, event_id / 100.0 AS m, event_id / 100.0 AS c, replace(printf('%.2f', event_id / 100.0), '.', ',') || ' EUR' AS label FROM events")
def f23_printed_money(spark, sf):
    """F23, F24, F36."""
    e = F.col("event_id")
    shown = F.translate(F.format_number((e / 100).cast("double"), 2), ",.", ".,")
    return read(spark, sf, "events").select("event_id", values.printed_money(shown).alias("m"), values.cents(e).alias("c"), values.money_label(e / 100).alias("label"))


@query("f25_codes", r"SELECT p_partkey, upper(replace(trim(p_brand || '/' || p_partkey), '/', '-')) AS code, CASE WHEN regexp_matches(p_name, '^[=+\-@]') THEN '''' || p_name ELSE p_name END AS csv, (regexp_matches(p_brand, '[A-Za-z]') AND regexp_matches(p_brand, '[0-9]')) AS serial FROM part")
def f25_codes(spark, sf):
    """F25, F31, F47."""
    return read(spark, sf, "part").select("p_partkey", text.document_code(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string"))).alias("code"), text.csv_safe(F.col("p_name")).alias("csv"), text.has_letter_and_digit(F.col("p_brand")).alias("serial"))


@query("f26_local_time", "SELECT event_id, CAST(floor(epoch((ts AT TIME ZONE 'Europe/Rome') AT TIME ZONE 'UTC')) AS BIGINT) AS utc, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Rome', '%Y-%m-%d') AS day FROM events")
def f26_local_time(spark, sf):
    """Printed Rome time as UTC, and the civil day of a UTC time."""
    t = F.col("ts").cast("timestamp")
    return read(spark, sf, "events").select("event_id", values.local_to_utc(t, "Europe/Rome", t).alias("utc"), values.business_date(t).alias("day"))


@query("f27_hashes", "SELECT doc_id, sha256(text) AS h, sha256(from_hex(sha256(source)) || encode(lang)) AS chained, 'sha-256=:' || base64(from_hex(sha256(text))) || ':' AS digest FROM documents")
def f27_hashes(spark, sf):
    """F29, F41."""
    return read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), values.chained_hash(F.sha2("source", 256), F.col("lang")).alias("chained"), values.content_digest(F.encode("text", "UTF-8")).alias("digest"))


@query("f28_canonical_json", """SELECT doc_id, '{"lang":"' || lang || '","n":' || n_chars || ',"none":null,"source":"' || source || '"}' AS j FROM documents""")
def f28_canonical_json(spark, sf):
    return read(spark, sf, "documents").select("doc_id", values.canonical_json({"source": F.col("source"), "lang": F.col("lang"), "n": F.col("n_chars"), "none": F.lit(None).cast("string")}).alias("j"))


@query("f30_name_uuid", "WITH h AS (SELECT doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc:' || doc_id)) AS h FROM documents) SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', (('0x' || h[17:18])::INTEGER & 63) | 128) || h[19:20] || '-' || h[21:32] AS uuid FROM h")
def f30_name_uuid(spark, sf):
    return read(spark, sf, "documents").select("doc_id", values.name_uuid(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("uuid"))


@query("f32_redaction", r"SELECT event_id, (['password', 'Passwd', 'passphrase', 'TOKEN', 'secret', 'Authorization', 'api-key', 'api_key', 'apikey'])[1 + event_id % 9] || CASE WHEN event_id % 2 = 0 THEN '=' ELSE ' : ' END || '<redacted>' || CASE WHEN event_id % 3 = 0 THEN ', by ' ELSE '; by ' END || user_id || ' ' || props AS a, 'db+x://u:<redacted>@h/' || event_id || ' Bearer <redacted>, bearing x' AS b FROM events")
def f32_redaction(spark, sf):
    """F32: every secret name, both separators, URIs and bearer tokens."""
    k = F.col("event_id")
    name = F.element_at(F.array(*map(F.lit, ("password", "Passwd", "passphrase", "TOKEN", "secret", "Authorization", "api-key", "api_key", "apikey"))), (k % 9 + 1).cast("int"))
    a = F.concat(name, F.when(k % 2 == 0, "=").otherwise(" : "), F.lit("v"), k.cast("string"), F.when(k % 3 == 0, ", by ").otherwise("; by "), F.col("user_id").cast("string"), F.lit(" "), "props")
    b = F.concat(F.lit("db+x://u:pw"), k.cast("string"), F.lit("@h/"), k.cast("string"), F.lit(" Bearer a.b-"), k.cast("string"), F.lit("==, bearing x"))
    return read(spark, sf, "events").select("event_id", text.redact(a).alias("a"), text.redact(b).alias("b"))


@query("f33_receipt_text", r"WITH t AS (SELECT doc_id, replace(replace('READ ' || lang || chr(10) || text || chr(10) || ' ' || chr(10) || source, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents), u AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+(\n|$)', '\1', 'g') AS t FROM t) SELECT doc_id, sha256(trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS h FROM u")
def f33_receipt_text(spark, sf):
    """whole texts between annotations, text read from a picture, and blank lines."""
    shown = F.concat(F.lit("\r\n<ESC/POS:INIT><OCR:1>READ "), "lang", F.lit("</OCR:1>\r\n"), "text", F.lit("\r<BYTE:0x07>\r "), F.lit("\x07\n"), "source", F.lit("\x1b \n\n"))
    return read(spark, sf, "documents").select("doc_id", F.sha2(text.receipt_text(shown), 256).alias("h"))


@query("f40_safe_name", "SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(text || '.txt', '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')[1:191], ''), 'evidence.bin') AS name FROM documents")
def f40_safe_name(spark, sf):
    return read(spark, sf, "documents").select("doc_id", text.safe_name(F.concat("text", F.lit(".txt"))).alias("name"))


@query("f43_table_code", "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN '0' || n || '-R' WHEN 1 THEN 'OVEST-' || n WHEN 2 THEN '100' || n WHEN 3 THEN 'LAB-2' || n WHEN 4 THEN 'O1234567' || n WHEN 5 THEN 'OO' ELSE upper(trim(p_brand)) || n || '-' END AS code FROM (SELECT p_partkey, p_brand, p_partkey % 10 AS n FROM part)")
def f43_table_code(spark, sf):
    """numeric codes with and without a suffix, names, too many digits, no digit at all."""
    k, n = F.col("p_partkey") % 7, (F.col("p_partkey") % 10).cast("string")
    seen = F.when(k == 0, F.concat(F.lit(" o"), n, F.lit("-r "))).when(k == 1, F.concat(F.lit("ovest-"), n)).when(k == 2, F.concat(F.lit("1Oo"), n)).when(k == 3, F.concat(F.lit("LAB-2"), n)).when(k == 4, F.concat(F.lit("O1234567"), n)).when(k == 5, "oO").otherwise(F.concat("p_brand", n, F.lit("- ")))
    return read(spark, sf, "part").select("p_partkey", text.table_code(seen).alias("code"))


@query("f45_ticket_class", "SELECT doc_id, (['CONFORMING_COPY', 'REPRINT', 'CANCELLATION', 'CANCELLATION', 'PRE_BILL', 'PRE_BILL', 'ORDER_CHANGE', 'KITCHEN_ORDER', 'KITCHEN_ORDER', 'ORDER', 'KITCHEN_ORDER', 'KITCHEN_ORDER', 'MANAGEMENT_DOCUMENT', 'UNKNOWN', 'UNKNOWN'])[1 + doc_id % 15] AS kind FROM documents")
def f45_ticket_class(spark, sf):
    """each wording before a whole text that holds none of them; of two wordings the first rule's wins."""
    shown = ("Copia conforme n. 3 storno", "RISTAMPA COMANDA 4", "PRECONTO ANNULLATO", "storno riga", "Preconto n. 7", "pre-conto comanda", "COMANDA\n -1,5 x Voce", "COMANDA tavolo 4", "cucina", "ordine 5", "PORTATA: 2", "coperti: 2\n3x Pane", "Documento gestionale", "coperti: 2", "saldo")
    t = F.element_at(F.array(*map(F.lit, shown)), (F.col("doc_id") % 15 + 1).cast("int"))
    plain = F.translate("text", "oaOA0123456789", "")  # no wording is left without its vowels
    return read(spark, sf, "documents").select("doc_id", text.pos_class(F.concat(t, F.lit("\n"), plain)).alias("kind"))


@query("p14_device_online", "SELECT user_id, count(*) FILTER (event_type = 'click' AND ts >= TIMESTAMP '2024-01-29 23:50:00') AS online FROM events GROUP BY 1")
def p14_device_online(spark, sf):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    status = F.when(F.col("event_type") == "click", "ONLINE").otherwise("OFFLINE")
    return read(spark, sf, "events").groupBy("user_id").agg(F.count_if(values.device_online(status, F.col("ts").cast("timestamp"), now)).alias("online"))


@query("p20_non_sale_lines", "SELECT p_partkey, (p_partkey % 9 IN (0, 1, 3, 5, 7)) AS technical FROM part")
def p20_non_sale_lines(spark, sf):
    k = F.col("p_partkey") % 9
    d = F.when(k == 0, "Totale  complessivo:").when(k == 1, F.concat(F.lit("IVA "), "p_partkey", F.lit("%"))).when(k == 2, F.concat(F.lit("TOTANI "), "p_name")).when(k == 3, F.concat(F.lit("* resto *"), "p_name")).when(k == 4, F.concat(F.lit("IVANA "), "p_name")).when(k == 5, "pagamento contante").when(k == 6, "RESTOCK").when(k == 7, F.concat(F.lit("Importo-pagato "), "p_partkey")).otherwise(F.concat(F.lit("x "), "p_name"))
    return read(spark, sf, "part").select("p_partkey", text.non_sale_line(d).alias("technical"))


@query("p24_backoff", f"WITH {_JOBS}, f AS (SELECT session_id, count(*) AS attempts, max(captured_at) AS last FROM j WHERE import_status = 'PARSE_FAILED' GROUP BY 1) SELECT session_id, attempts, least(3600, 5 * power(2, least(attempts - 1, 10)))::BIGINT AS wait, CAST(floor(epoch(last)) AS BIGINT) AS last FROM f")
def p24_backoff(spark, sf):
    """P24, A26."""
    f = jobs(spark, sf).where("import_status = 'PARSE_FAILED'").groupBy("session_id").agg(F.count("*").alias("attempts"), F.max("captured_at").alias("last"))
    return f.select("session_id", "attempts", values.backoff_seconds(F.col("attempts")).alias("wait"), "last")


@query("a9_diagnostics", f"WITH {_JOBS} SELECT event_type, count(*) AS jobs, count(*) FILTER (json_extract_string('[' || CASE WHEN event_id % 3 = 0 THEN '\"x\"' ELSE '' END || ']', '$[0]') IS NOT NULL) AS with_errors FROM j GROUP BY 1")
def a9_diagnostics(spark, sf):
    """Lengths of JSON lists."""
    j = jobs(spark, sf).withColumn("errors", F.when(F.col("event_id") % 3 == 0, '["x"]').otherwise("[]"))
    return j.groupBy("event_type").agg(F.count("*").alias("jobs"), F.count_if(F.json_array_length("errors") > 0).alias("with_errors"))


@query("a13_bytes_by_direction", "SELECT user_id, sum(CAST(floor(value) AS BIGINT)) FILTER (event_id % 2 = 0)::BIGINT AS client_to_device, sum(CAST(floor(value) AS BIGINT)) FILTER (event_id % 2 = 1)::BIGINT AS device_to_client FROM events GROUP BY 1")
def a13_bytes_by_direction(spark, sf):
    e = read(spark, sf, "events").withColumn("direction", F.when(F.col("event_id") % 2 == 0, "client_to_device").otherwise("device_to_client"))
    return e.groupBy("user_id").pivot("direction", ["client_to_device", "device_to_client"]).agg(F.sum(F.floor("value").cast("bigint")))


_CH = "ch AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, length(props) AS length, props FROM events)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream chunks from the event log: one stream a user; every seventh user's third chunk has a wrong offset."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), F.row_number().over(w).alias("sequence"), F.length("props").alias("length"), F.encode("props", "UTF-8").alias("payload"))
    before = F.coalesce(F.sum("length").over(Window.partitionBy("stream").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return e.withColumn("offset", before + F.when((F.col("stream") % 7 == 0) & (F.col("sequence") == 3), 1).otherwise(0)).withColumn("payload_sha256", F.sha2("payload", 256))


@query("w6_contiguity", f"WITH {_CH} SELECT stream, count(*) FILTER (NOT (stream % 7 = 0 AND sequence = 3)) AS follow, count(*) AS n FROM ch GROUP BY 1")
def w6_contiguity(spark, sf):
    """W6, S4."""
    return R.contiguous(chunks(spark, sf), "stream").groupBy("stream").agg(F.count_if("follows").alias("follow"), F.count("*").alias("n"))


@query("k2_valid_prefix", f"WITH {_CH} SELECT stream, count(*) FILTER (NOT bad)::BIGINT AS chunks, coalesce(sum(length) FILTER (NOT bad), 0)::BIGINT AS bytes, bool_and(NOT bad) AS complete FROM (SELECT *, stream % 7 = 0 AND sequence >= 3 AS bad FROM ch) GROUP BY 1")
def k2_valid_prefix(spark, sf):
    return R.valid_prefix(chunks(spark, sf), "stream")


@query("k10_reassembly", f"WITH {_CH} SELECT stream, CASE WHEN stream % 7 <> 0 OR count(*) < 3 THEN sha256(string_agg(props, '' ORDER BY sequence)) END AS sha FROM ch GROUP BY 1")
def k10_reassembly(spark, sf):
    return R.reassemble(chunks(spark, sf), "stream").select("stream", F.sha2("data", 256).alias("sha"))


@query("k3_idempotent_import", "SELECT 'new' AS kind, count(*) FILTER (o_orderkey % 3 = 0) AS n FROM orders UNION ALL SELECT 'duplicate', count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0) FROM orders UNION ALL SELECT 'conflict', count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0) FROM orders")
def k3_idempotent_import(spark, sf):
    """K3, K5, T5: new, repeated and conflicting imports."""
    o = read(spark, sf, "orders").select("o_orderkey", F.sha2(F.col("o_orderstatus"), 256).alias("manifest"))
    known = o.where("o_orderkey % 3 <> 0").withColumn("manifest", F.when(F.col("o_orderkey") % 5 == 0, "old").otherwise(F.col("manifest")))
    parts = zip(("new", "duplicate", "conflict"), R.idempotent_append(known, o, "o_orderkey", "manifest"), strict=True)
    a, b, c = (df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in parts)
    return a.unionByName(b).unionByName(c)


@query("k9_quarantine", "SELECT event_id, CASE WHEN value < 5 AND event_type = 'error' THEN 'value,type' WHEN value < 5 THEN 'value' ELSE 'type' END AS failed FROM events WHERE value < 5 OR event_type = 'error'")
def k9_quarantine(spark, sf):
    """Rejected rows with the checks they fail."""
    return R.split_valid(read(spark, sf, "events"), {"value": F.col("value") >= 5, "type": F.col("event_type") != "error"})[1].select("event_id", "failed")


@query("d26_rule_versions", "WITH h AS (SELECT user_id AS code, event_type AS fingerprint, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS rn FROM events) WHERE rn = 1), v AS (SELECT * FROM h WHERE before IS NULL OR before <> fingerprint) SELECT code, fingerprint, row_number() OVER w AS version, CAST(floor(epoch(ts)) AS BIGINT) AS effective_from, CAST(floor(epoch(lead(ts) OVER w)) AS BIGINT) AS effective_to FROM v WINDOW w AS (PARTITION BY code ORDER BY ts)")
def d26_rule_versions(spark, sf):
    e = R.latest(read(spark, sf, "events"), ["user_id", "ts"], ["event_id"])
    return U.versions(e.select(F.col("user_id").alias("code"), F.col("ts").cast("timestamp").alias("changed_at"), F.col("event_type").alias("fingerprint"))).select("code", "fingerprint", "version", "effective_from", "effective_to")


@query("m1_job_reviews", "SELECT user_id AS job, arg_max(event_type, strftime(ts, '%Y%m%d%H%M%S%f') || lpad(event_id::VARCHAR, 12, '0')) AS action FROM events WHERE event_type IN ('click', 'view', 'signup') GROUP BY 1")
def m1_job_reviews(spark, sf):
    """M1, M2: the effective decision is the last one."""
    return W.effective(read(spark, sf, "events").where(F.col("event_type").isin("click", "view", "signup")), "user_id", ["ts", "event_id"]).select(F.col("user_id").alias("job"), F.col("event_type").alias("action"))


@query("m4_import_batches", "SELECT user_id AS batch, count(*) FILTER (event_type <> 'view') AS imported, count(*) FILTER (event_type = 'view') AS duplicates FROM events GROUP BY 1 HAVING count(*) FILTER (event_type <> 'view') > 0")
def m4_import_batches(spark, sf):
    """Batches with more than repeats."""
    return W.batches(read(spark, sf, "events"), "user_id", F.col("event_type") == "view").withColumnRenamed("user_id", "batch")


@query("m3_chain_audit", "SELECT 0::BIGINT AS broken, count(*) AS records FROM events")
def m3_chain_audit(spark, sf):
    """A chain an actor, written and verified."""
    from tillsight.operators import transactions as T

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    log = read(spark, sf, "events").withColumn("sequence", F.row_number().over(w))
    payload = values.canonical_json({"id": F.col("event_id"), "type": F.col("event_type")})
    chain = T.hash_chain(log, "user_id", "sequence", payload)
    whole = log.join(chain, ["user_id", "sequence"])
    bad = T.verify_chain(whole, "user_id", "sequence", payload).agg(F.count("*").alias("broken"))
    return bad.join(chain.agg(F.count("*").alias("records")))  # two single rows


@query("t7_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS start FROM events), s AS (SELECT user_id, ts, sum(start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS opened, count(*) AS n FROM s GROUP BY user_id, sid")
def t7_sessions(spark, sf):
    """Captures closed by an hour without data."""
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("opened"), "n")


@query("t8_follow_ups", "SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 900 SECOND")
def t8_follow_ups(spark, sf):
    """One-sided interval join, the same expression as on streams."""
    from tillsight.streaming.live import paired

    e = read(spark, sf, "events")
    return paired(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", 900).select("a_id", "b_id")


@query("t2_keyset_cursor", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7200 SECOND AND (ts > TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id > 5) OR event_id % 2 = 0)")
def t2_keyset_cursor(spark, sf):
    """Newer than the cursor, or late and not yet done."""
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return W.after_cursor(e, "ts", "event_id", "2024-01-20 00:00:00", 5, 7200, e.where("event_id % 2 = 1")).select("event_id")


@query("j12_neighbourhood", "WITH s AS (SELECT * FROM events WHERE event_id % 500 = 0) SELECT DISTINCT e.event_id AS document_id FROM events e JOIN s ON e.user_id = s.user_id AND abs(floor(epoch(e.ts)) - floor(epoch(s.ts))) <= 7200")
def j12_neighbourhood(spark, sf):
    e = read(spark, sf, "events").select(F.col("event_id").alias("document_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"))
    return W.neighbourhood(e, e.where("document_id % 500 = 0"), ["user_id"], "ts", 7200).select("document_id")


_TICKET = ("PRECONTO N. PB-{k}", "COMANDA K-{k}", "PRECONTO N. PB-{k}\nANNULLATO", "RISTAMPA K-{k}", "ORDINE O-{k}")


def ticket_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of one or two tickets of every order and its lines: control sequences, a picture, a bar code, code pages, wrapped names."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("t"))
    i = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("int").alias("q"), "l_linenumber", "l_suppkey", F.floor("l_extendedprice").cast("bigint").alias("c"))
    name = F.concat(F.lit("Voce "), F.col("p").cast("string"))
    line = F.concat(F.col("q").cast("string"), F.lit("x "), name, F.when(F.col("p") % 3 == 0, "\n   ata mista").when(F.col("p") % 3 == 1, "\n   con pane").otherwise(""), F.lit(""))
    line = F.when(F.col("p") % 5 == 0, F.concat(name, F.lit("  "), F.col("c").cast("string"), F.lit(",00"))).otherwise(line)
    body = i.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p", "l_suppkey", "q", line.alias("l")))), lambda x: x["l"]), "\n").alias("items"))
    k = F.col("k").cast("string")
    head = F.element_at(F.array(*[F.replace(F.lit(h), F.lit("{k}"), k) for h in _TICKET]), (F.col("k") % 5 + 1).cast("int"))
    who = F.concat(F.lit("OPERATORE: Anna "), (F.col("o_custkey") % 7).cast("string"), F.lit(" "), F.date_format("t", "dd/MM/yy"), F.lit(" 12:30"))
    total = F.concat(F.lit("TOTALE EUR "), F.floor("o_totalprice").cast("string"), F.lit(",00"))
    raw = lambda x: F.encode(x, "ISO-8859-1")
    first = F.concat(raw(F.lit("\x1b@\x1bE\x01")), raw(head), raw(F.lit("\x1bE\x00\n\x1dv0\x00\x02\x00\x02\x00AB\nC")), raw(F.concat(F.lit("TAVOLO T"), (F.col("o_custkey") % 40).cast("string"), F.lit("\nCOPERTI: 2\n---------\nPORTATA: 1\n"))), raw(F.coalesce("items", F.lit(""))), raw(F.concat(F.lit("\n"), total, F.lit("\n"), who, F.lit("\n\x1dk\x04T99\x00\x1bt\x10caff"))), F.lit(bytearray(b"\xe8")), F.lit(bytearray(b"\n\x1dV\x00")))
    second = F.when(F.col("k") % 4 == 0, raw(F.concat(F.lit("-1x Voce tolta\nTAVOLO T9")))).otherwise(raw(F.lit("")))
    return o.join(body, "k", "left").select(k.alias("job_id"), F.concat(first, second).alias("client_raw"))


@query("x1_ticket_bytes", "WITH i AS (SELECT l_orderkey AS k, count(*) AS n, sum(CASE WHEN l_partkey % 5 = 0 THEN floor(l_extendedprice) END)::DOUBLE AS s, sum(CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE l_quantity END)::DOUBLE AS q FROM lineitem GROUP BY 1) SELECT o_orderkey::VARCHAR AS job_id, 1::BIGINT AS ordinal, TRUE AS complete, (['PRE_BILL', 'KITCHEN_ORDER', 'CANCELLATION', 'REPRINT', 'ORDER'])[1 + o_orderkey % 5] AS type, CASE o_orderkey % 5 WHEN 1 THEN 'K-' || o_orderkey WHEN 0 THEN 'PB-' || o_orderkey WHEN 2 THEN 'PB-' || o_orderkey END AS external_code, 'T' || o_custkey % 40 AS table_code, 'Anna ' || o_custkey % 7 AS operator_code, floor(o_totalprice)::DOUBLE AS total, 2::BIGINT AS covers, coalesce(n, 0) AS n_items, s AS items_total, CAST(epoch(((CAST(o_orderdate AS DATE) + TIME '12:30') AT TIME ZONE 'Europe/Rome') AT TIME ZONE 'UTC') AS BIGINT) AS document_time FROM orders LEFT JOIN i ON o_orderkey = k UNION ALL SELECT o_orderkey::VARCHAR, 2, FALSE, 'ORDER_CHANGE', NULL, 'T9', NULL, NULL, NULL, 1, NULL, NULL FROM orders WHERE o_orderkey % 4 = 0")
def x1_ticket_bytes(spark, sf):
    """Till tickets from their bytes."""
    from tillsight.sources import tickets

    return tickets.ticket_documents(tickets.ticket_lines(ticket_jobs(spark, sf))).select("job_id", "ordinal", "complete", "type", "external_code", "table_code", "operator_code", "total", "covers", "n_items", "items_total", "document_time")


@query("x1_ticket_items", "SELECT l_orderkey::VARCHAR AS job_id, 'Voce ' || l_partkey || CASE WHEN l_partkey % 5 = 0 THEN CASE l_partkey % 3 WHEN 9 THEN '' ELSE '' END WHEN l_partkey % 3 = 0 THEN 'ata mista' WHEN l_partkey % 3 = 1 THEN ' con pane' ELSE '' END AS description, sum(CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE l_quantity END)::DOUBLE AS quantity, count(*) AS n, '1' AS course FROM lineitem GROUP BY 1, 2 UNION ALL SELECT o_orderkey::VARCHAR, 'Voce tolta', -1, 1, NULL FROM orders WHERE o_orderkey % 4 = 0")
def x1_ticket_items(spark, sf):
    """Items of the tickets with wrapped names, signed quantities and courses."""
    from tillsight.sources import tickets

    i = tickets.ticket_items(tickets.ticket_lines(ticket_jobs(spark, sf)))
    return i.groupBy("job_id", "description", "course").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n"))


@query("x2_frame_bytes", "SELECT event_id::VARCHAR AS job_id, 1::BIGINT AS frame_id, '=K' || lpad((event_id % 1000)::VARCHAR, 3, '0') AS data, TRUE AS bcc_valid FROM events")
def x2_frame_bytes(spark, sf):
    """Framed printer traffic, with the checksum computed by the engine."""
    from tillsight.sources import parsers

    head = F.concat(F.lit("\x0201005N=K"), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("1"))
    sealed = F.concat(head, F.lpad(F.hex(values.xor_checksum(F.encode(head, "UTF-8"))), 2, "0"), F.lit("\x03"))
    j = read(spark, sf, "events").select(F.col("event_id").cast("string").alias("job_id"), F.encode(sealed, "UTF-8").alias("client_raw"))
    return parsers.frame_rows(j).select("job_id", "frame_id", "data", "bcc_valid")
