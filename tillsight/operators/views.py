"""Read models: the dashboard's figures, and a document, a transaction and an alert as their pages show them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight import schema
from tillsight.functions import labels, values
from tillsight.operators import relational as R
from tillsight.operators import rules as U


def dashboard(visible: DataFrame, versions: DataFrame, alerts: DataFrame, jobs: DataFrame, statuses: DataFrame, n_devices: DataFrame, now: str) -> DataFrame:
    """One row of 21 figures, each from one aggregation over its own table.

    ``visible`` are operator-visible documents, ``versions(document_id, errors)`` their latest versions with a JSON list,
    ``alerts`` the canonical ones with difference and time, ``statuses(device_id, status, seen_at, spool_bytes)`` the latest
    of each device and ``n_devices(n)`` the number of known ones. A difference counts once an episode, by the primary
    rule where it has one. The parts are single rows, so joining them costs nothing.
    """
    kind = F.col("type")
    of = lambda *t: F.count_if(kind.isin(*t))
    docs = visible.agg(
        F.count_if(kind != "DEVICE_RESPONSE").alias("documents"), of("ORDER", "ORDER_CHANGE", "KITCHEN_ORDER").alias("orders"), of("PRE_BILL").alias("pre_bills"), of("MANAGEMENT_DOCUMENT").alias("management_documents"),
        of("COMMERCIAL_DOCUMENT").alias("commercial_documents"), of("SHIFT_END_REPORT").alias("shift_end_reports"), of("INVOICE").alias("invoices"),
    )
    live = F.col("status").isin(*schema.OPERATIONAL_STATES)
    told = alerts.agg(
        F.count_if(live).alias("open_alerts"), F.count_if(live & (F.col("severity") == "CRITICAL")).alias("critical_alerts"), F.count_if(live).alias("operational_alerts"),
        F.count_if(F.col("status") == "FALSE_POSITIVE").alias("false_positive_alerts"), F.count_if(F.col("status") == "JUSTIFIED").alias("justified_alerts"),
    )
    by_rule = lambda code: F.max(F.when(F.col("rule_code") == code, F.col("difference")))
    episodes = alerts.where(live & (F.col("difference") > 0)).groupBy("transaction_key").agg(by_rule(U.PRIMARY).alias("p"), by_rule(U.COMPAT).alias("c")).select(F.coalesce("p", "c").alias("d"))
    lost = F.coalesce(F.sum("d"), F.lit(0)).cast(values.MONEY)
    money = episodes.where("d > 0").agg(lost.alias("economic_difference"), lost.alias("operational_economic_difference"), F.count("*").alias("economic_reduction_episodes"))
    open_jobs = jobs.where(~R.complete_job() & F.col("relevant") & (F.col("review_state") == "PENDING")).agg(F.count("*").alias("incomplete_jobs"))
    online = statuses.agg(F.count_if(values.device_online(F.col("status"), F.col("seen_at"), F.lit(now).cast("timestamp"))).alias("devices_online"), F.coalesce(F.sum("spool_bytes"), F.lit(0)).alias("spool_bytes"))
    errors = versions.agg(F.count_if(F.coalesce(F.json_array_length("errors"), F.lit(0)) > 0).alias("parse_errors"))
    days = alerts.where(live).groupBy(F.to_date("opened_at").alias("date")).agg(F.count("*").alias("count")).orderBy(F.desc("date")).limit(30)
    trend = days.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct(F.col("date").cast("string").alias("date"), "count")), False), lambda x: x)).alias("alert_trend"))
    out = docs
    for part in (told, money, open_jobs, online, errors, trend):
        out = out.join(part)
    return out.join(n_devices.select((F.col("n") - 0).alias("_n"))).withColumn("devices_offline", F.greatest(F.lit(0), F.col("_n") - F.col("devices_online"))).drop("_n")


def document_view(documents: DataFrame, devices: DataFrame, lines: DataFrame, payments: DataFrame, resolved: DataFrame) -> DataFrame:
    """A document with its device, labelled type, number and how it is known, and its lines and payments in order."""
    n = lines.groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("sequence", "item_code", "description", "quantity", F.coalesce("modified_unit_price", "unit_price").alias("unit_price"), "line_total"))).alias("lines"), F.sum("line_total").alias("lines_total"),
    )
    paid = payments.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("method", "amount"))).alias("payments"), F.sum("amount").alias("paid"))
    d = documents.join(devices, "device_id", "left").join(n, "document_id", "left").join(paid, "document_id", "left").join(resolved, "document_id", "left")
    none = F.lit(None).cast("string")
    return d.select(
        "document_id", "type", labels.type_label(F.col("type")).alias("type_label"), F.col("name").alias("device"), "department", "table_code", "operator_code", "document_time", "captured_at", "gross_total", "net_total",
        F.coalesce("resolved", "external_code").alias("code"), labels.progressive_status(none, F.col("external_code"), F.col("external_suffix"), F.col("type")).alias("code_status"), labels.namespace(F.col("type")).alias("namespace"),
        F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), "lines", "lines_total", F.coalesce(F.size("payments"), F.lit(0)).alias("n_payments"), "payments", "paid", "complete",
    )


def alert_view(alerts: DataFrame, members: DataFrame, evidence: DataFrame, history: DataFrame) -> DataFrame:
    """An alert with the documents and devices of its episode, its evidence and its history in order."""
    side = members.groupBy("transaction_key").agg(F.count("*").alias("n_docs"), F.array_sort(F.collect_set("device_id")).alias("devices"), F.array_sort(F.collect_set("operator_code")).alias("operators"))
    proof = evidence.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "evidence"))).alias("proof"))
    past = history.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "event_type", "status"))).alias("past"))
    out = alerts.join(side, "transaction_key", "left").join(proof, "alert_id", "left").join(past, "alert_id", "left")
    return out.withColumns({"evidence": F.transform("proof", lambda x: x["evidence"]), "history": F.transform("past", lambda x: F.concat_ws(":", x["event_type"], x["status"]))}).drop("proof", "past")


def timeline(members: DataFrame, events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Documents, order events and alerts of each episode in one list, by time as text, kind and id."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    rows = members.select("transaction_key", at("time").alias("at"), F.lit("DOCUMENT").alias("kind"), F.col("document_id").alias("id"))
    rows = rows.unionByName(events.select("transaction_key", at("time").alias("at"), F.lit("EVENT").alias("kind"), F.concat_ws(":", "event_type", "document_id", "detail").alias("id")))
    rows = rows.unionByName(alerts.select("transaction_key", at("opened_at").alias("at"), F.lit("ALERT").alias("kind"), F.col("alert_id").alias("id")))
    return rows.groupBy("transaction_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind", "id"))), lambda x: F.concat_ws(" ", x["kind"], x["id"])).alias("timeline"))


#: What a correlation must have met before a number is taken over from another paper, and how that is told.
WITNESS_CRITERIA = ("commercial_reference_to_observed_fiscal_suffix", "table_code", "line_identity_overlap", "time_proximity")
WITNESS, WITNESS_TYPES = "CORRELATED_MANAGEMENT_REFERENCE", ("MANAGEMENT_DOCUMENT", "CONFORMING_COPY")


def resolved_codes(members: DataFrame, correlations: DataFrame) -> DataFrame:
    """``(document_id, resolved, provenance, conflict)`` of receipts that show the end of their number only.

    ``members(correlation_id, document_id, type, external_code, external_suffix, commercial_reference)``,
    ``correlations(correlation_id, status, score, matched)``. A number is taken over where exactly one reference of the papers
    correlated with full score and all four criteria ends in the receipt's digits; two that differ are a conflict, not a choice.
    """
    trusted = correlations.where((F.col("status") == "AUTOMATIC") & (F.col("score") == 100) & (F.size(F.array_except(F.array(*map(F.lit, WITNESS_CRITERIA)), "matched")) == 0)).select("correlation_id")
    known = members.join(trusted, "correlation_id", "left_semi")
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    receipts = members.where((F.col("type") == "COMMERCIAL_DOCUMENT") & ~some("external_code") & some("external_suffix")).select("document_id", F.col("external_suffix").alias("_end"))
    last = F.element_at(F.split(F.replace("commercial_reference", F.lit("/"), F.lit("-")), "-"), -1)
    told = known.where(F.col("type").isin(*WITNESS_TYPES) & some("commercial_reference")).select("correlation_id", F.col("document_id").alias("_by"), last.alias("_end"), "commercial_reference")
    seen = known.join(receipts, "document_id").select("document_id", "correlation_id", "_end").join(told, ["correlation_id", "_end"]).where("document_id <> _by")
    found = seen.groupBy("document_id").agg(F.count_distinct("commercial_reference").alias("n"), F.min("commercial_reference").alias("code"))
    one = F.col("n") == 1
    return receipts.select("document_id").distinct().join(found, "document_id", "left").select("document_id", F.when(one, F.col("code")).alias("resolved"), F.when(one, WITNESS).alias("provenance"), F.coalesce(F.col("n") > 1, F.lit(False)).alias("conflict"))
