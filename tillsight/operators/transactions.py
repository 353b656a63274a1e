"""Sale episodes: membership, totals, line outcome, order state, events and evidence roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight import schema
from tillsight.functions import text, values
from tillsight.operators import lines as L

MONEY = values.MONEY


def room_close() -> Column:
    """A management document that settles the sale."""
    return (F.col("type") == "MANAGEMENT_DOCUMENT") & (F.col("economic_close") | F.coalesce(F.col("settlement_kind") == "ROOM_CHARGE", F.lit(False)))


def valid_fiscal() -> Column:
    """P17."""
    return F.col("type").isin(*schema.FISCAL_TYPES) & F.col("complete") & F.coalesce("gross_total", "net_total").isNotNull()


#: What tells fiscal documents of one code apart, beside their time: the table before it, the others after it.
_ALIKE = ("table_code", "session_id", "device_id", "total")


def episodes(documents: DataFrame) -> DataFrame:
    """Documents with ``transaction_key``: own order code, else that of the same job, else of the fiscal document they name.

    A code that is used again opens a new episode: an opening paper that comes after a close of the code starts
    the next one, whose key is the code and its number. Papers without an order code are few, so only
    they take the two joins; of several fiscal documents with the named code those of another table come last, then the
    nearest in time counts, and of equally near ones that of the same session, device and total.
    """
    d = documents.withColumn("time", F.coalesce("document_time", "captured_at")).withColumn("total", F.coalesce("gross_total", "net_total"))
    opens = F.col("type").isin("ORDER", "KITCHEN_ORDER", "PRE_BILL")
    closes = F.col("type").isin(*schema.FISCAL_TYPES) | room_close()
    w = Window.partitionBy("order_code").orderBy("time", "document_id")
    last = F.last(F.when(opens | closes, F.struct(closes.alias("closes"), F.col("time").alias("at"))), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = d.where(F.col("order_code").isNotNull()).withColumn("_starts", (opens & F.coalesce(last["closes"] & (last["at"] < F.col("time")), F.lit(False))).cast("int"))
    own = own.withColumn("_n", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("transaction_key", F.when(F.col("_n") == 0, F.col("order_code")).otherwise(F.concat("order_code", F.lit("#"), (F.col("_n") + 1).cast("string")))).drop("_starts", "_n")
    rest = d.where(F.col("order_code").isNull())
    jobs = own.groupBy("job_id").agg(F.min("transaction_key").alias("by_job"))
    fiscal = own.where((F.col("type") == "COMMERCIAL_DOCUMENT") & F.col("external_code").isNotNull()).select(F.col("external_code").alias("commercial_reference"), F.col("transaction_key").alias("by_code"), F.col("time").alias("ft"), *[F.col(c).alias(f"f_{c}") for c in _ALIKE])
    other = [F.coalesce(F.col(c) != F.col(f"f_{c}"), F.lit(False)) for c in _ALIKE]
    away = F.struct(other[0], F.abs(F.unix_micros("time") - F.unix_micros("ft")), *other[1:], "by_code")
    named = rest.select("document_id", "commercial_reference", "time", *_ALIKE).join(fiscal, "commercial_reference").groupBy("document_id").agg(F.min_by("by_code", away).alias("by_code"))
    rest = rest.join(jobs, "job_id", "left").join(named, "document_id", "left").withColumn("transaction_key", F.coalesce("by_job", "by_code", "document_id")).select(*own.columns)
    return own.unionByName(rest)


def members_of(documents: DataFrame, clusters: DataFrame) -> DataFrame:
    """Documents with ``transaction_key`` from a clustering."""
    d = documents.withColumn("time", F.coalesce("document_time", "captured_at")).withColumn("total", F.coalesce("gross_total", "net_total"))
    return d.join(clusters.withColumnRenamed("cluster", "transaction_key"), "document_id")


def management_bills(members: DataFrame, lines: DataFrame) -> DataFrame:
    """``(transaction_key, document_id, total)``: the management paper that stands for a pre-bill where an episode has none.

    It is complete, priced, names no receipt and closes nothing; it comes no later than the first valid receipt and shares its
    table and a line with it; of several the last counts. Only the papers in question have their texts folded.
    """
    w = Window.partitionBy("transaction_key")
    key = F.struct("time", "document_id")
    bill = (F.col("type") == "PRE_BILL") & (F.col("time") <= F.col("_at"))
    baseline = (F.col("type") == "MANAGEMENT_DOCUMENT") & F.col("complete") & F.col("total").isNotNull() & F.col("commercial_reference").isNull() & ~room_close()
    m = members.withColumn("_first", F.min(F.when(valid_fiscal(), key)).over(w)).withColumn("_at", F.col("_first.time"))
    m = m.where("_first IS NOT NULL").withColumn("_billed", F.max(bill).over(w))
    m = m.where(~F.col("_billed") & ((baseline & (F.col("time") <= F.col("_at"))) | (F.col("document_id") == F.col("_first.document_id"))))
    m = m.select("transaction_key", "document_id", "time", "total", "table_code", (F.col("document_id") == F.col("_first.document_id")).alias("_fiscal")).withColumn("_two", F.count("*").over(w)).where("_two > 1")
    m = text.identities(m, "table_code").where("table_code IS NOT NULL")
    named = text.identities(lines.join(m.select("document_id"), "document_id", "left_semi").select("document_id", "sequence", "item_code", "description"), "item_code", "description")
    keys = named.select("document_id", text.line_key(F.col("item_code"), F.col("description"), F.col("sequence") - 1).alias("_key"))
    keyed = m.join(keys, "document_id")
    of_receipt = keyed.where("_fiscal").select("transaction_key", "table_code", "_key")
    fit = keyed.where("NOT _fiscal").join(of_receipt, ["transaction_key", "table_code", "_key"], "left_semi")
    return fit.groupBy("transaction_key").agg(F.max_by(F.struct("document_id", "total"), key).alias("b")).select("transaction_key", "b.document_id", "b.total")


def transactions(members: DataFrame, payments: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Totals, difference and half-even percent of each episode.

    With ``lines``, an episode without a pre-bill takes the management paper that stands for one (``management_bills``).
    """
    paid = payments.groupBy("document_id").agg(F.sum("amount").cast(MONEY).alias("paid"))
    m = members.join(paid, "document_id", "left")
    w = Window.partitionBy("transaction_key")
    m = m.withColumn("first_fiscal", F.min(F.when(valid_fiscal(), F.col("time"))).over(w))
    is_bill = (F.col("type") == "PRE_BILL") & (F.col("first_fiscal").isNull() | (F.col("time") <= F.col("first_fiscal")))
    key = F.struct("time", "document_id")
    closing = room_close() & F.col("total").isNotNull()
    # Payments of fiscal documents count; else of payment documents; else of all.
    rank = F.when(valid_fiscal(), 3).when(F.col("type") == "PAYMENT", 2).otherwise(1)
    sum_at = lambda level: F.sum(F.when(F.col("paid").isNotNull() & (rank == level), F.col("paid"))) if level > 1 else F.sum("paid")
    t = m.groupBy("transaction_key").agg(
        F.array_sort(F.collect_list("document_id")).alias("document_ids"), F.count("*").alias("documents"), F.min("time").alias("opened_at"), F.max("time").alias("last_at"),
        F.max_by(F.when(is_bill, F.col("document_id")), F.when(is_bill, key)).alias("prebill_id"), F.max_by(F.when(is_bill, F.col("total")), F.when(is_bill, key)).alias("prebill_total"),
        F.coalesce(F.sum(F.when(valid_fiscal(), F.col("total"))), F.lit(0)).cast(MONEY).alias("fiscal_total"), F.count_if(valid_fiscal()).alias("fiscals"),
        F.coalesce(F.sum(F.when(closing, F.col("total"))), F.lit(0)).cast(MONEY).alias("closing_total"), F.count_if(closing).alias("closings"),
        F.coalesce(sum_at(3), sum_at(2), sum_at(1), F.lit(0)).cast(MONEY).alias("payment_total"), F.count("paid").alias("payment_records"),
        F.count_if(F.col("type") == "CANCELLATION").alias("cancellations"), F.min("first_fiscal").alias("first_fiscal_at"), F.min("operator_code").alias("operator_code"), F.min("device_id").alias("device_id"),
    )
    if lines is not None:
        stand_in = management_bills(members, lines).select("transaction_key", F.col("document_id").alias("_bill"), F.col("total").alias("_billed"))
        t = t.join(stand_in, "transaction_key", "left").withColumns({"prebill_id": F.coalesce("prebill_id", "_bill"), "prebill_total": F.coalesce("prebill_total", "_billed")}).drop("_bill", "_billed")
    final = F.when(F.col("fiscals") > 0, F.col("fiscal_total")).otherwise(F.col("closing_total")).cast(MONEY)
    t = t.withColumn("final_total", final).withColumn("difference", (F.col("prebill_total") - F.col("final_total")).cast(MONEY))
    return t.withColumn("percent", values.percent(F.col("difference"), F.col("prebill_total"))).withColumn("split_payment", (F.col("fiscals") > 1) & (F.col("fiscal_total") > 0))


def outcome_changes(members: DataFrame, tx: DataFrame, lines: DataFrame) -> DataFrame:
    """Line changes between each episode's pre-bill and all its closing documents, for episodes that have both."""
    bill = tx.where(F.col("prebill_id").isNotNull()).select("transaction_key", F.col("prebill_id").alias("document_id"))
    flagged = members.withColumn("_fiscal", valid_fiscal()).withColumn("_room", room_close() & F.col("total").isNotNull())
    w = Window.partitionBy("transaction_key")
    closing = flagged.withColumn("_any", F.max("_fiscal").over(w)).where(F.col("_fiscal") | (~F.col("_any") & F.col("_room"))).select("transaction_key", "document_id", "time")
    before = lines.join(bill, "document_id").withColumn("at", F.col("sequence").cast("bigint"))
    after = lines.join(closing, "document_id")
    both = before.select("transaction_key").distinct().join(after.select("transaction_key").distinct(), "transaction_key")
    a = L.engine_lines(before.join(both, "transaction_key", "left_semi"), ["transaction_key"], ["at"])
    b = L.engine_lines(after.join(both, "transaction_key", "left_semi"), ["transaction_key"], ["time", "document_id", "sequence"])
    return L.line_changes(a, b, ["transaction_key"])


def member_role() -> Column:
    return F.when(F.col("type").isin(*schema.SOURCE_TYPES), "SOURCE").when(F.col("type").isin(*schema.FISCAL_TYPES), "FISCAL").when(F.col("type") == "PAYMENT", "PAYMENT").when(F.col("type") == "DEVICE_RESPONSE", "RESPONSE").otherwise("AUXILIARY")


def evidence_role(prebill_id: str = "prebill_id") -> Column:
    """What a document proves about a reduction."""
    mgmt = F.col("type") == "MANAGEMENT_DOCUMENT"
    return (
        F.when(F.col("document_id") == F.col(prebill_id), F.when(mgmt, "MANAGEMENT_PREBILL").otherwise("PRE_BILL")).when(valid_fiscal(), "COMMERCIAL_CLOSE").when(room_close(), "NON_FISCAL_CLOSE")
        .when(mgmt & F.col("commercial_reference").isNotNull(), "MANAGEMENT_COPY").otherwise("SUPPORTING")
    )


def fingerprint(members: DataFrame, by: str = "transaction_key") -> DataFrame:
    """Hash over the canonical list of member ids and contents."""
    item = values.canonical_json({"id": F.col("document_id"), "record": F.col("payload_sha256")})
    return members.groupBy(by).agg(F.sha2(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(item)), ","), F.lit("]")), 256).alias("input_fingerprint"))


def orders(members: DataFrame, tx: DataFrame, zone: str = "Europe/Rome") -> DataFrame:
    """One order an episode, from its first source document."""
    source = F.col("type").isin(*schema.SOURCE_TYPES)
    key = F.struct("time", "document_id")
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), key))
    fiscal = F.col("type").isin(*schema.FISCAL_TYPES)
    o = members.groupBy("transaction_key").agg(
        F.min_by("device_id", F.when(source, key)).alias("order_device"), F.min_by("time", F.when(source, key)).alias("source_time"), first("order_code").alias("code"), first("table_code").alias("table_code"), first("operator_code").alias("operator"),
        F.count_if(fiscal).alias("n_fiscal"), F.count_if(room_close()).alias("n_room"), F.count_if(F.col("type") == "CANCELLATION").alias("n_void"), F.max(F.when(fiscal | room_close(), F.col("time"))).alias("closed_at"), F.min("document_id").alias("least_id"),
    )
    o = o.where(F.col("source_time").isNotNull()).join(tx.select("transaction_key", "fiscal_total", "final_total", "prebill_total"), "transaction_key")
    return o.select(
        "transaction_key", F.coalesce("code", F.concat(F.lit("AUTO:"), "least_id")).alias("order_code"), "order_device", values.business_date(F.col("source_time"), zone).alias("business_date"), "table_code", "operator",
        F.when((F.col("n_fiscal") > 0) | (F.col("n_room") > 0), "CLOSED").when(F.col("n_void") > 0, "VOIDED").otherwise("OPEN").alias("status"), "closed_at",
        F.when(F.col("n_fiscal") > 0, F.col("fiscal_total")).when(F.col("n_room") > 0, F.col("final_total")).otherwise(F.col("prebill_total")).alias("gross_total"),
    )


_EVENT = {"PRE_BILL": "PRE_BILL_PRINTED", "COMMERCIAL_DOCUMENT": "FISCAL_DOCUMENT_ISSUED", "PAYMENT": "PAYMENT_RECORDED", "CONFORMING_COPY": "COPY_PRINTED", "REPRINT": "COPY_PRINTED", "CANCELLATION": "ORDER_VOIDED"}
_CHANGE = {"ADDED": "ITEM_ADDED", "REMOVED": "ITEM_REMOVED", "QUANTITY_CHANGED": "QUANTITY_CHANGED", "PRICE_CHANGED": "PRICE_CHANGED"}


def events(members: DataFrame, payments: DataFrame, changes: DataFrame, delta_changes: DataFrame | None = None) -> DataFrame:
    """``(transaction_key, time, event_type, document_id, detail)``, without repeats of a change."""
    key = F.struct("time", "document_id")
    opening = members.where(F.col("type").isin(*schema.SOURCE_TYPES) & (F.col("type") != "ORDER_CHANGE"))
    created = opening.groupBy("transaction_key").agg(F.min_by("document_id", key).alias("document_id"), F.min("time").alias("time")).select("transaction_key", "time", F.lit("ORDER_CREATED").alias("event_type"), "document_id", F.lit("").alias("detail"))
    kind = F.create_map(*[F.lit(x) for kv in _EVENT.items() for x in kv])
    printed = members.where(F.col("type").isin(*_EVENT)).select("transaction_key", "time", kind[F.col("type")].alias("event_type"), "document_id", F.lit("").alias("detail"))
    paid = members.where(F.col("type") != "PAYMENT").join(payments.select("document_id").distinct(), "document_id", "left_semi").select("transaction_key", "time", F.lit("PAYMENT_RECORDED").alias("event_type"), "document_id", F.lit("payments").alias("detail"))
    finals = members.withColumn("_f", (F.col("type").isin(*schema.FISCAL_TYPES)) & F.col("complete")).withColumn("_r", room_close())
    finals = finals.withColumn("_any", F.max("_f").over(Window.partitionBy("transaction_key"))).where(F.col("_f") | (~F.col("_any") & F.col("_r")))
    last = finals.groupBy("transaction_key").agg(F.max_by("document_id", key).alias("document_id"), F.max("time").alias("time"))
    closed = last.select("transaction_key", "time", F.lit("ORDER_CLOSED").alias("event_type"), "document_id", F.lit("").alias("detail"))
    name = F.create_map(*[F.lit(x) for kv in _CHANGE.items() for x in kv])
    named = F.when(F.col("change_type") == "DISCOUNT_CHANGED", F.when(F.coalesce("after_discount", F.lit(0)) <= 0, "DISCOUNT_REMOVED").otherwise("DISCOUNT_APPLIED")).otherwise(F.try_element_at(name, F.col("change_type")))
    changed = changes.withColumn("event_type", named).where(F.col("event_type").isNotNull()).join(last, "transaction_key").select("transaction_key", "time", "event_type", "document_id", F.col("item_key").alias("detail"))
    out = created.unionByName(printed).unionByName(paid).unionByName(closed).unionByName(changed)
    if delta_changes is not None:
        out = out.unionByName(delta_changes.select(*out.columns))
    return out.dropDuplicates(["transaction_key", "event_type", "document_id", "detail"])


def snapshot_changes(members: DataFrame, lines: DataFrame, types: tuple[str, ...] = ("ORDER", "PRE_BILL", "MANAGEMENT_DOCUMENT")) -> DataFrame:
    """What changed between each two consecutive sources of an episode that list lines: ``(transaction_key, time,
    document_id, item_key, change_type, ...)``."""
    listed = members.where(F.col("type").isin(*types)).join(lines.select("document_id").distinct(), "document_id", "left_semi")
    before = F.lag("document_id").over(Window.partitionBy("transaction_key").orderBy("time", "document_id"))
    pairs = listed.withColumn("_before", before).where("_before IS NOT NULL").select("transaction_key", "time", "document_id", "_before")
    old = lines.withColumnRenamed("document_id", "_before").join(pairs.select("_before", "document_id"), "_before")
    new = lines.join(pairs.select("document_id"), "document_id")
    changes = L.line_changes(L.engine_lines(old, ["document_id"], ["sequence"]), L.engine_lines(new, ["document_id"], ["sequence"]), ["document_id"])
    return pairs.drop("_before").join(changes.where("change_type <> 'UNCHANGED'"), "document_id")


def kitchen_changes(members: DataFrame, lines: DataFrame) -> DataFrame:
    """What each change ticket does to its episode's kitchen lines before it: ``(transaction_key, time, document_id, item_key, change_type)``."""
    own = members.select("transaction_key", "document_id", "type", "time")
    change = own.where("type = 'ORDER_CHANGE'").select("transaction_key", F.col("document_id").alias("change_id"), F.col("time").alias("changed_at"))
    earlier = own.where("type = 'KITCHEN_ORDER'").join(change, "transaction_key").where("time <= changed_at").select("document_id", "change_id")
    state = L.engine_lines(lines.join(earlier, "document_id"), ["change_id"], ["document_id", "sequence"])
    printed = L.engine_lines(lines.join(change.select(F.col("change_id").alias("document_id")), "document_id"), ["document_id"], ["sequence"]).withColumnRenamed("document_id", "change_id")
    after = L.apply_deltas(state, printed.select("change_id", "item_key", F.lit(1).alias("ordinal"), "description", "quantity", "unit_price", F.col("total").alias("line_total"), F.lit(False).alias("removed")), ["change_id"])
    both = state.select("change_id", "item_key", F.col("quantity").alias("q0")).join(after.select("change_id", "item_key", F.col("quantity").alias("q1")), ["change_id", "item_key"], "full_outer")
    kind = F.when(F.col("q0").isNull(), "ADDED").when(F.col("q1").isNull(), "REMOVED").when(F.col("q0") != F.col("q1"), "QUANTITY_CHANGED")
    return both.withColumn("change_type", kind).where("change_type IS NOT NULL").join(change, "change_id").select("transaction_key", F.col("changed_at").alias("time"), F.col("change_id").alias("document_id"), "item_key", "change_type")


def numbered(log: DataFrame) -> DataFrame:
    """Sequence of events within each episode."""
    return log.withColumn("sequence", F.row_number().over(Window.partitionBy("transaction_key").orderBy("time", "event_type", "document_id", "detail")))


def hash_chain(log: DataFrame, by: str, order: str, payload: Column) -> DataFrame:
    """Each event's previous and own hash. A key's events pass in order through one task, which holds the last hash only."""
    zero = "0" * 64
    rows = log.select(by, order, payload.alias("_payload")).repartition(by).sortWithinPartitions(by, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = object(), zero
        for batch in batches:
            before, own = [], []
            for k, p in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != key:
                    key, last = k, zero
                before.append(last)
                last = hashlib.sha256(bytes.fromhex(last) + p.encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.string()), pa.array(own, pa.string())], [by, order, "previous_hash", "record_hash"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"{by} {kinds[by]}, {order} {kinds[order]}, previous_hash string, record_hash string")


def verify_chain(chain: DataFrame, by: str, order: str, payload: Column) -> DataFrame:
    """Rows whose previous hash isn't the last record's, or whose own hash doesn't follow."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.coalesce(F.lag("record_hash").over(w), F.lit("0" * 64))
    return chain.withColumn("_before", before).withColumn("_own", values.chained_hash(F.col("previous_hash"), payload)).where((F.col("previous_hash") != F.col("_before")) | (F.col("record_hash") != F.col("_own"))).drop("_before", "_own")
