"""The seventeen anomaly rules, their registry, suppression, weighting and versions.

Every rule is one DataFrame ``(transaction_key, score, confidence, hits)`` over shared inputs; ``evaluate`` joins
them by union. No clock is read: the time of evaluation is an input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight import schema
from tillsight.functions import text, values
from tillsight.plans.tables import written
from tillsight.operators.transactions import room_close, valid_fiscal


@dataclass(frozen=True)
class Context:
    members: DataFrame
    transactions: DataFrame
    changes: DataFrame
    lines: DataFrame
    events: DataFrame
    operator_stats: DataFrame | None = None
    evaluated_at: str = "2030-01-01 00:00:00"


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    handler: Callable[[Context, dict], DataFrame]
    parameters: dict = field(default_factory=dict)
    enabled: bool = True
    weight: float = 1.0
    version: int = 1


def pinned(c: Context) -> Context:
    """The context with its inputs written once, so that seventeen rules read tables and not each other's lineage."""
    keep = lambda df, name: None if df is None else written(df, name)
    return replace(c, members=keep(c.members, "members"), transactions=keep(c.transactions, "transactions"), changes=keep(c.changes, "changes"), lines=keep(c.lines, "lines"), events=keep(c.events, "events"), operator_stats=keep(c.operator_stats, "stats"))


def _cap(x: Column) -> Column:
    return F.least(F.lit(100), x.cast("int"))


def _proof(kind: str, **fields: Column) -> Column:
    """One piece of evidence as canonical JSON; amounts and times as text."""
    return values.canonical_json({"kind": F.lit(kind)} | {k: c.cast("string") for k, c in fields.items()})


def _none() -> Column:
    return F.lit(None).cast("array<string>")


def _per(df: DataFrame, base: int, step: int, confidence: int, proof: Column, least: int = 1, document: str | None = None) -> DataFrame:
    """Findings from one row a hit: ``base + step * hits``; each hit is a piece of evidence and may name its document."""
    documents = F.array_sort(F.collect_set(document)) if document else F.max(_none())
    n = df.withColumn("_proof", proof).groupBy("transaction_key").agg(F.count("*").alias("hits"), F.array_sort(F.collect_list("_proof")).alias("evidence"), documents.alias("document_ids")).where(F.col("hits") >= least)
    return n.select("transaction_key", _cap(base + step * F.col("hits")).alias("score"), F.lit(confidence).alias("confidence"), "hits", "evidence", "document_ids")


def _one(df: DataFrame, score: Column, confidence: Column | int, evidence: Column, documents: Column | None = None) -> DataFrame:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return df.select("transaction_key", _cap(score).alias("score"), c.cast("int").alias("confidence"), F.lit(1).cast("bigint").alias("hits"), evidence.alias("evidence"), (_none() if documents is None else documents).alias("document_ids"))


def _amounts(**more: Column) -> Column:
    """The totals that a difference is told from."""
    return _proof("amount_comparison", prebill_total=F.col("prebill_total"), fiscal_aggregate=F.col("fiscal_total"), difference_amount=F.col("difference"), difference_percent=F.col("percent"), split_payment=F.col("split_payment"), **more)


def _change(kind: str, **more: Column) -> Column:
    return _proof(kind, item_key=F.col("item_key"), description=F.col("description"), **more)


def _truncated(x: Column) -> Column:
    """Towards zero, as money and percentages enter scores."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("int")


def _dropped(c: Context, p: dict, closed: Column) -> DataFrame:
    return c.transactions.where((F.col("prebill_total") > 0) & closed & (F.col("difference") >= p["minimum_amount"]) & (F.col("percent") >= p["minimum_percent"]))


def r1(c: Context, p: dict) -> DataFrame:
    t = _dropped(c, p, (F.col("fiscals") > 0) | (F.col("cancellations") > 0) | (F.col("closings") > 0))
    outcome = _proof(
        "post_prebill_economic_outcome", prebill_total=F.col("prebill_total"), observed_final_total=F.col("final_total"), fiscal_aggregate=F.col("fiscal_total"), difference_amount=F.col("difference"),
        difference_percent=F.col("percent"), fiscal_conclusive=F.col("fiscals") > 0, cancelled_or_partial=F.col("cancellations") > 0, room_settlement=F.col("closings") > 0,
    )
    evidence = F.array(outcome)
    if c.changes is not None:
        moved = _change("post_prebill_line_change", change_type=F.col("change_type"), quantity_before=F.col("before_quantity"), quantity_after=F.col("after_quantity"), unit_price_before=F.col("before_unit_price"), unit_price_after=F.col("after_unit_price"))
        lines = c.changes.where("change_type <> 'UNCHANGED'").groupBy("transaction_key").agg(F.array_sort(F.collect_list(moved)).alias("_lines"))
        t = t.join(lines, "transaction_key", "left")
        evidence = F.concat(evidence, F.coalesce("_lines", F.array().cast("array<string>")))
    return _one(t, 70 + _truncated(F.col("percent") * F.lit(0.3).cast("decimal(2,1)")), F.when(F.col("documents") > 1, 95).otherwise(70), evidence, F.col("document_ids"))


def r2(c: Context, p: dict) -> DataFrame:
    return _one(_dropped(c, p, F.col("fiscals") > 0), 60 + _truncated(F.col("percent") * F.lit(0.6).cast("decimal(2,1)")), F.when(F.col("documents") > 1, 95).otherwise(65), F.array(_amounts()))


def r3(c: Context, p: dict) -> DataFrame:
    return _per(c.changes.where("change_type = 'REMOVED'"), 65, 8, 90, _change("line_removed", quantity_before=F.col("before_quantity"), total_before=F.col("before_total")))


def r4(c: Context, p: dict) -> DataFrame:
    before, after = F.col("before_unit_price"), F.col("after_unit_price")
    return _per(c.changes.where("change_type NOT IN ('ADDED', 'REMOVED') AND after_unit_price < before_unit_price"), 65, 10, 90, _change("price_reduction", before=before, after=after, difference=before - after))


def r5(c: Context, p: dict) -> DataFrame:
    before, after = F.col("before_unit_price"), F.col("after_unit_price")
    drop = c.changes.where("before_unit_price > 0 AND after_unit_price < before_unit_price").withColumn("drop", values.percent(before - after, before)).where(F.col("drop") >= p["minimum_percent"])
    proof = _change("extreme_price_reduction", before=before, after=after, reduction_percent=F.col("drop"))
    worst = drop.withColumn("_proof", proof).groupBy("transaction_key").agg(F.max("drop").alias("drop"), F.array_sort(F.collect_list("_proof")).alias("_proofs"))
    return _one(worst, 75 + _truncated(F.col("drop") / 5), 92, F.col("_proofs"))


def r6(c: Context, p: dict) -> DataFrame:
    own = [text.scope_value(F.col(x)) for x in ("order_code", "external_code", "order_reference")]
    more = F.transform(F.col("references"), text.scope_value) if "references" in c.members.columns else F.array().cast("array<string>")
    refs = c.members.select("transaction_key", "document_id", F.explode(F.array_distinct(F.array_compact(F.concat(F.array(*own), more)))).alias("ref"))
    shared = refs.groupBy("transaction_key", "ref").agg(F.array_sort(F.collect_set("document_id")).alias("ids")).where(F.size("ids") >= 2)
    shared = shared.groupBy("transaction_key").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ref", "ids"))))).alias("_shared"))
    t = c.transactions.where(F.col("prebill_total").isNotNull() & (F.col("fiscals") > 0) & (F.abs("difference") >= p["minimum_amount"])).join(shared, "transaction_key")
    return _one(t, 65 + _truncated(F.abs("difference")), 90, F.array(_amounts(shared_references=F.col("_shared"))))


def r7(c: Context, p: dict) -> DataFrame:
    opening = F.col("type").isin(*schema.OPENING_TYPES)
    m = c.members.groupBy("transaction_key").agg(F.max(F.when(opening, F.col("time"))).alias("latest"), F.count_if(valid_fiscal() | (room_close() & F.col("total").isNotNull())).alias("closed"), F.array_sort(F.collect_set(F.when(opening, F.col("document_id")))).alias("_ids"))
    age = F.unix_timestamp(F.lit(c.evaluated_at).cast("timestamp")) - F.unix_timestamp("latest")
    # The time of evaluation is no evidence: the finding stays the same while the order stays open.
    proof = _proof("missing_fiscal_close", last_source_at=F.col("latest"), threshold_minutes=F.lit(p["close_minutes"]))
    return _one(m.where((F.col("closed") == 0) & F.col("latest").isNotNull() & (age >= 60 * p["close_minutes"])), F.lit(70), 75, F.array(proof), F.col("_ids"))


def r8(c: Context, p: dict) -> DataFrame:
    fiscal = F.col("type").isin(*schema.FISCAL_TYPES)
    proof = _proof("orphan_fiscal_document", document_id=F.col("document_id"), external_code=F.col("external_code"), total=F.col("total"))
    m = c.members.groupBy("transaction_key").agg(F.count_if(fiscal).alias("f"), F.count_if(F.col("type").isin(*schema.SOURCE_TYPES)).alias("s"), F.array_sort(F.collect_list(F.when(fiscal, proof))).alias("_proofs"), F.array_sort(F.collect_set(F.when(fiscal, F.col("document_id")))).alias("_ids"))
    return _one(m.where("f > 0 AND s = 0"), F.lit(65), 70, F.col("_proofs"), F.col("_ids"))


def void_counts(c: Context) -> DataFrame:
    """Removals and voids, none counted both as document and as event."""
    void = c.members.where(F.col("type").isin("CANCELLATION", "REFUND")).groupBy("transaction_key").agg(F.collect_set("document_id").alias("docs"))
    e = c.events.join(void, "transaction_key", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<string>")))
    counted = e.groupBy("transaction_key").agg(
        F.count_if((F.col("event_type") == "ITEM_REMOVED") & ~F.coalesce(F.array_contains("docs", F.col("document_id")), F.lit(False))).alias("removals"),
        F.collect_set(F.when(F.col("event_type") == "ORDER_VOIDED", F.col("document_id"))).alias("voids"), F.count_if((F.col("event_type") == "ORDER_VOIDED") & F.col("document_id").isNull()).alias("anonymous"), F.first("docs").alias("docs"),
    )
    return counted.select("transaction_key", F.array_join(F.array_sort("docs"), ",").alias("cancelled"), (F.col("removals") + F.size("voids") + F.col("anonymous") + F.size(F.array_except("docs", "voids"))).alias("voids"))


def r9(c: Context, p: dict) -> DataFrame:
    v = void_counts(c).where(F.col("voids") >= p["minimum_count"])
    proof = _proof("void_frequency", count=F.col("voids"), threshold=F.lit(p["minimum_count"]), cancellation_document_ids=F.col("cancelled"))
    return v.select("transaction_key", _cap(60 + 8 * F.col("voids")).alias("score"), F.lit(85).alias("confidence"), F.col("voids").alias("hits"), F.array(proof).alias("evidence"), _none().alias("document_ids"))


def r10(c: Context, p: dict) -> DataFrame:
    proof = _proof("copy_or_reprint", document_id=F.col("document_id"), type=F.col("type"), captured_at=F.col("captured_at"))
    return _per(c.members.where(F.col("type").isin(*schema.COPY_TYPES)), 55, 8, 90, proof, p["maximum_count"] + 1, "document_id")


def r11(c: Context, p: dict) -> DataFrame:
    """Gaps between neighbours of one device, type, day and prefix; told once, at the least document involved."""
    m = c.members.withColumn("n", text.numeric_suffix(F.col("external_code"))).where("n IS NOT NULL")
    w = Window.partitionBy("device_id", "type", F.to_date("time"), "n.prefix").orderBy("n.number", "document_id")
    gaps = m.withColumns({"after": F.lead("n.number").over(w), "after_id": F.lead("document_id").over(w), "after_key": F.lead("transaction_key").over(w)}).where(F.col("after") - F.col("n.number") > 1)
    proof = _proof("sequence_gap", source_device_id=F.col("device_id"), document_type=F.col("type"), business_date=F.to_date("time"), prefix=F.col("n.prefix"), before=F.col("n.number"), after=F.col("after"), missing_count=F.col("after") - F.col("n.number") - 1)
    each = gaps.withColumn("_proof", proof).select(F.explode(F.array_distinct(F.array("transaction_key", "after_key"))).alias("key"), F.least("document_id", "after_id").alias("least"), F.array("document_id", "after_id").alias("ids"), "_proof")
    per = each.groupBy("key").agg(F.count("*").alias("hits"), F.min("least").alias("least"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("document_ids"), F.array_sort(F.collect_list("_proof")).alias("evidence"))
    mine = per.join(c.members.select(F.col("transaction_key").alias("key"), F.col("document_id").alias("least")), ["key", "least"], "left_semi")
    return mine.select(F.col("key").alias("transaction_key"), _cap(65 + 10 * F.col("hits")).alias("score"), F.lit(80).alias("confidence"), "hits", "evidence", "document_ids")


def r12(c: Context, p: dict) -> DataFrame:
    """Same code, or same content where there is none, from two jobs or more; told once."""
    apart = ~F.col("type").isin(*schema.COPY_TYPES, "DEVICE_RESPONSE") & ~((F.col("type") == "MANAGEMENT_DOCUMENT") & F.col("commercial_reference").isNotNull())
    same = F.when(F.col("external_code").isNotNull() & (F.col("external_code") != ""), F.concat(F.lit("CODE:"), "external_code")).otherwise(F.concat(F.lit("HASH:"), "payload_sha256"))
    m = c.members.where(apart).withColumn("same", same).withColumn("day", F.to_date("time"))
    by = ["device_id", "type", "day", "same"]
    groups = m.groupBy(*by).agg(F.count_distinct("job_id").alias("jobs"), F.min("document_id").alias("least"), F.array_sort(F.collect_set("document_id")).alias("ids")).where("jobs > 1")
    proof = _proof("duplicate_document", source_device_id=F.col("device_id"), document_type=F.col("type"), business_date=F.col("day"), identity=F.col("same"), document_ids=F.array_join("ids", ","))
    hit = m.join(groups, by).groupBy("transaction_key").agg(F.count_distinct(F.struct(*by)).alias("hits"), F.min("least").alias("least"), F.collect_set("document_id").alias("mine"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("document_ids"), F.array_sort(F.collect_set(proof)).alias("evidence"))
    return hit.where(F.array_contains("mine", F.col("least"))).select("transaction_key", _cap(70 + 10 * F.col("hits")).alias("score"), F.lit(90).alias("confidence"), "hits", "evidence", "document_ids")


_MODIFIES = ("ITEM_ADDED", "ITEM_REMOVED", "QUANTITY_CHANGED", "PRICE_CHANGED", "DISCOUNT_APPLIED", "DISCOUNT_REMOVED")


def r13(c: Context, p: dict) -> DataFrame:
    output = c.members.where(F.col("type").isin("COMMERCIAL_DOCUMENT", "MANAGEMENT_DOCUMENT", "DEVICE_RESPONSE", *schema.COPY_TYPES)).select("transaction_key", "document_id")
    late = c.events.where(F.col("event_type").isin(*_MODIFIES)).join(c.transactions.select("transaction_key", "first_fiscal_at"), "transaction_key")
    late = late.where((F.col("time") > F.col("first_fiscal_at")) & (F.col("time") <= F.col("first_fiscal_at") + F.make_dt_interval(mins=F.lit(p["window_minutes"])))).join(output, ["transaction_key", "document_id"], "left_anti")
    return _per(late, 65, 8, 90, _proof("late_order_event", event_type=F.col("event_type"), occurred_at=F.col("time"), first_fiscal_at=F.col("first_fiscal_at"), document_id=F.col("document_id"), detail=F.col("detail")))


def r14(c: Context, p: dict) -> DataFrame:
    m = c.members.where(F.col("type").isin("ORDER", "PRE_BILL", "MANAGEMENT_DOCUMENT", "COMMERCIAL_DOCUMENT")).select("transaction_key", "document_id")
    v = F.filter(F.array(F.coalesce("modified_unit_price", "unit_price"), F.col("line_total")), lambda x: x.isNotNull())
    bad = F.exists(v, lambda x: x <= 0) & ~(F.forall(v, lambda x: x >= 0) & F.coalesce(text.non_sale_line(F.col("description")), F.lit(False)))
    proof = _proof("non_positive_item", document_id=F.col("document_id"), sequence=F.col("sequence"), item_code=F.col("item_code"), description=F.col("description"), unit_price=F.coalesce("modified_unit_price", "unit_price"), line_total=F.col("line_total"))
    return _per(c.lines.where(bad).join(m, "document_id"), 65, 8, 90, proof, document="document_id")


#: Metadata keys whose amounts change a document's total, and the one that lists several.
ADJUSTMENT_KEYS, ADJUSTMENT_LIST = ("adjustment_total", "surcharge_total", "rounding_adjustment"), "adjustments"


def total_candidates(line_sum: Column, discount: Column, metadata: Column) -> Column:
    """Totals that a document's lines, discount and known adjustments can explain, or null where an adjustment can't be used.

    An adjustment is a number, or in a list a number or an object with an ``amount``. A stated one that is no amount leaves
    nothing to check against, since what it would have changed isn't known.
    """
    said = F.from_json(F.coalesce(metadata, F.lit("{}")), "map<string,string>")
    amount = lambda c: c.try_cast("decimal(19,4)")
    there = [F.map_contains_key(said, F.lit(k)) for k in ADJUSTMENT_KEYS]
    single = F.filter(F.array(*[F.struct(h.alias("there"), amount(F.try_element_at(said, F.lit(k))).alias("v")) for h, k in zip(there, ADJUSTMENT_KEYS, strict=True)]), lambda x: x["there"])
    raw = F.try_element_at(said, F.lit(ADJUSTMENT_LIST))
    listed = F.from_json(raw, "array<string>")
    several = F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda x: F.struct(F.lit(True).alias("there"), amount(F.when(x.startswith("{"), F.get_json_object(x, "$.amount")).otherwise(x)).alias("v")))
    no_list = F.map_contains_key(said, F.lit(ADJUSTMENT_LIST)) & ~F.coalesce(raw.startswith("["), F.lit(False))
    every = F.concat(single, several)
    unusable = no_list | F.exists(every, lambda x: x["v"].isNull())
    more = F.when(F.size(every) > 0, F.aggregate(every, F.lit(0).cast("decimal(19,4)"), lambda acc, x: (acc + x["v"]).cast("decimal(19,4)")))
    ways = F.array(line_sum, line_sum - discount, line_sum + more, line_sum - discount + more)
    return F.when(~F.coalesce(unusable, F.lit(False)), F.array_sort(F.array_distinct(F.array_compact(F.transform(ways, lambda x: x.cast("decimal(19,4)"))))))


def r15(c: Context, p: dict) -> DataFrame:
    m = c.members.where(~F.col("type").isin("ORDER_CHANGE", "KITCHEN_ORDER", "CANCELLATION", "REFUND", "DEVICE_RESPONSE", *schema.COPY_TYPES) & F.col("complete") & F.col("total").isNotNull())
    sums = c.lines.groupBy("document_id").agg(F.sum("line_total").alias("s"), F.count_if(F.col("line_total").isNull()).alias("gaps")).where("gaps = 0")
    metadata = F.col("raw_metadata") if "raw_metadata" in c.members.columns else F.lit(None).cast("string")
    x = m.join(sums, "document_id").withColumn("_ways", total_candidates(F.col("s"), F.col("discount_total"), metadata))
    off = F.array_min(F.transform("_ways", lambda w: F.abs(F.col("total") - w)))
    proof = _proof("total_line_mismatch", document_id=F.col("document_id"), document_total=F.col("total"), line_sum=F.col("s"), discount_total=F.col("discount_total"), reconstructible_totals=F.col("_ways").cast("array<string>"), difference=off)
    return _per(x.where(off > p["tolerance"]), 65, 10, 92, proof, document="document_id")


def r16(c: Context, p: dict) -> DataFrame:
    fiscal = c.members.where(F.col("type").isin(*schema.FISCAL_TYPES)).select("transaction_key").distinct()
    t = c.transactions.where(F.col("payment_records") > 0).join(fiscal, "transaction_key", "left_semi").withColumn("off", F.abs(F.col("fiscal_total") - F.col("payment_total"))).where(F.col("off") > p["tolerance"])
    return _one(t, 70 + _truncated(F.col("off")), 95, F.array(_proof("payment_total_mismatch", fiscal_total=F.col("fiscal_total"), payment_total=F.col("payment_total"), difference=F.col("off"))))


def r17(c: Context, p: dict) -> DataFrame:
    if c.operator_stats is None:
        return _one(c.transactions.where("false"), F.lit(0), 0, _none())
    rate = F.col("anomalous").cast("decimal(18,0)") / F.col("transactions_")
    s = c.operator_stats.withColumn("rate", rate).where((F.col("transactions_") >= p["minimum_transactions"]) & (F.col("rate") >= p["minimum_anomaly_rate"]))
    proof = _proof("operator_pattern", operator_code=F.col("operator_code"), transactions=F.col("transactions_"), anomalous=F.col("anomalous"), voids=F.col("voids"), rate=F.col("rate"))
    return _one(c.transactions.select("transaction_key", "operator_code").join(s, "operator_code"), 50 + _truncated(F.col("rate") * 100), 80, F.array(proof))


RULES: tuple[Rule, ...] = (
    Rule("MODIFICA_POST_PRECONTO", "HIGH", r1, {"minimum_percent": 20, "minimum_amount": 1}),
    Rule("PREBILL_FISCAL_AMOUNT_DROP", "HIGH", r2, {"minimum_percent": 20, "minimum_amount": 1}),
    Rule("ITEM_REMOVED_AFTER_PREBILL", "HIGH", r3),
    Rule("PRICE_REDUCED_AFTER_PREBILL", "HIGH", r4),
    Rule("EXTREME_PRICE_CHANGE", "CRITICAL", r5, {"minimum_percent": 70}),
    Rule("SAME_REFERENCE_DIFFERENT_AMOUNT", "HIGH", r6, {"minimum_amount": 1}),
    Rule("ORDER_WITHOUT_FISCAL_CLOSE", "MEDIUM", r7, {"close_minutes": 120}),
    Rule("FISCAL_WITHOUT_SOURCE_ORDER", "MEDIUM", r8),
    Rule("EXCESSIVE_VOID_OR_CANCELLATION", "HIGH", r9, {"minimum_count": 3}),
    Rule("REPRINT_OR_COPY_ANOMALY", "MEDIUM", r10, {"maximum_count": 2}),
    Rule("DOCUMENT_SEQUENCE_GAP", "HIGH", r11),
    Rule("DUPLICATE_DOCUMENT", "HIGH", r12),
    Rule("LATE_ORDER_MODIFICATION", "HIGH", r13, {"window_minutes": 5}),
    Rule("NEGATIVE_OR_ZERO_VALUE_ITEM", "HIGH", r14),
    Rule("TOTAL_LINE_MISMATCH", "HIGH", r15, {"tolerance": 0.01}),
    Rule("PAYMENT_TOTAL_MISMATCH", "CRITICAL", r16, {"tolerance": 0.01}),
    Rule("UNUSUAL_OPERATOR_PATTERN", "MEDIUM", r17, {"minimum_transactions": 20, "minimum_anomaly_rate": 0.3}),
)
PRIMARY, COMPAT = "MODIFICA_POST_PRECONTO", "PREBILL_FISCAL_AMOUNT_DROP"
SECONDARY = ("PREBILL_FISCAL_AMOUNT_DROP", "ITEM_REMOVED_AFTER_PREBILL", "PRICE_REDUCED_AFTER_PREBILL", "EXTREME_PRICE_CHANGE", "SAME_REFERENCE_DIFFERENT_AMOUNT")


def registry(rules: tuple[Rule, ...] = RULES) -> dict[str, Rule]:
    """Rules by code; a code used twice is an error."""
    out: dict[str, Rule] = {}
    for r in rules:
        if r.code in out:
            raise ValueError(f"rule {r.code} is there twice")
        out[r.code] = r
    return out


def configured(code: str, **parameters) -> Rule:
    r = registry()[code]
    return replace(r, parameters=r.parameters | parameters)


#: What each rule's finding is called.
DESCRIPTIONS = {
    "MODIFICA_POST_PRECONTO": "Riduzione del valore di vendita dopo il preconto",
    "PREBILL_FISCAL_AMOUNT_DROP": "Riduzione significativa tra preconto e totale fiscale",
    "ITEM_REMOVED_AFTER_PREBILL": "Articoli rimossi dopo il preconto",
    "PRICE_REDUCED_AFTER_PREBILL": "Prezzo ridotto dopo il preconto",
    "EXTREME_PRICE_CHANGE": "Variazione estrema del prezzo",
    "SAME_REFERENCE_DIFFERENT_AMOUNT": "Stesso riferimento con importi differenti",
    "ORDER_WITHOUT_FISCAL_CLOSE": "Ordine senza chiusura fiscale",
    "FISCAL_WITHOUT_SOURCE_ORDER": "Documento fiscale senza ordine sorgente",
    "EXCESSIVE_VOID_OR_CANCELLATION": "Frequenza elevata di annulli o rimozioni",
    "REPRINT_OR_COPY_ANOMALY": "Numero anomalo di ristampe o copie conformi",
    "DOCUMENT_SEQUENCE_GAP": "Discontinuità nella sequenza dei documenti",
    "DUPLICATE_DOCUMENT": "Identificativo o contenuto documento duplicato",
    "LATE_ORDER_MODIFICATION": "Modifica tardiva dell'ordine",
    "NEGATIVE_OR_ZERO_VALUE_ITEM": "Articolo con valore nullo o negativo",
    "TOTAL_LINE_MISMATCH": "Totale incompatibile con la somma delle righe",
    "PAYMENT_TOTAL_MISMATCH": "Pagamenti incompatibili con il totale fiscale",
    "UNUSUAL_OPERATOR_PATTERN": "Concentrazione anomala su un operatore identificato",
}


def _weighed(c: Context, r: Rule) -> DataFrame:
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.bround(F.col("score").cast("decimal(9,0)") * F.lit(r.weight).cast("decimal(8,4)"), 0).cast("int")))
    return r.handler(c, r.parameters).withColumns({"rule_code": F.lit(r.code), "rule_version": F.lit(r.version), "severity": F.lit(r.severity), "score": score})


def finding(c: Context, r: Rule) -> DataFrame:
    """One rule's findings, weighted half-even and kept within 0..100, without their evidence (which is then never gathered)."""
    return _weighed(c, r).select("transaction_key", "rule_code", "severity", "score", "confidence", "hits")


def explained(c: Context, r: Rule) -> DataFrame:
    """One rule's findings with description, explanation, evidence and documents (all of the episode where the rule names none)."""
    f = _weighed(c, r).withColumnRenamed("document_ids", "_named").join(c.transactions.select("transaction_key", "document_ids"), "transaction_key")
    told = F.concat(F.lit(DESCRIPTIONS[r.code] + ": "), F.size("evidence").cast("string"), F.lit(" "), F.when(F.size("evidence") == 1, "elemento").otherwise("elementi"), F.lit(" di prova"))
    return f.select("transaction_key", "rule_code", "rule_version", "severity", "score", "confidence", "hits", F.coalesce("_named", "document_ids").alias("document_ids"), F.lit(DESCRIPTIONS[r.code]).alias("description"), told.alias("explanation"), "evidence")


def finding_key() -> Column:
    """Hash of all that an explained finding says; the time of its evaluation is no part of it."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(c, ","), F.lit("]"))
    plain = {c: F.col(c).cast("string") for c in ("transaction_key", "rule_code", "rule_version", "severity", "score", "confidence", "description")}
    return F.sha2(values.canonical_json(plain | {"document_ids": listed(F.col("document_ids")), "evidence": listed(F.col("evidence"))}), 256)


def evaluate(c: Context, rules: tuple[Rule, ...] = RULES, find: Callable[[Context, Rule], DataFrame] = finding) -> DataFrame:
    """All findings; symptoms of a reduction give way to the primary rule where a pre-bill is known.

    ``find`` is ``finding`` or, for evidence and documents too, ``explained``.
    """
    used = [r for r in registry(rules).values() if r.enabled]
    sales = c.members.groupBy("transaction_key").agg(F.min(F.col("type").isin(*schema.NON_SALE_TYPES)).alias("none")).where("NOT none").select("transaction_key")
    out = None
    for r in used:
        f = find(c, r)
        out = f if out is None else out.unionByName(f)
    out = out.join(sales, "transaction_key", "left_semi")
    if any(r.code == PRIMARY for r in used):
        known = c.transactions.where(F.col("prebill_total").isNotNull()).select("transaction_key")
        out = out.where(~F.col("rule_code").isin(*SECONDARY)).unionByName(out.where(F.col("rule_code").isin(*SECONDARY)).join(known, "transaction_key", "left_anti"))
    return out


def suppress(findings: DataFrame, whitelist: DataFrame, members: DataFrame, evaluated_at: str) -> DataFrame:
    """Findings with ``whitelist_id`` of the first matching entry by id, null if none matches.

    Scopes become equal-key joins on (scope, value); only the validity window is a range.
    """
    now = F.lit(evaluated_at).cast("timestamp")
    live = whitelist.where((F.col("valid_from") <= now) & (F.col("valid_until").isNull() | (F.col("valid_until") >= now))).select(F.col("id").alias("whitelist_id"), F.col("rule_code").alias("w_rule"), "scope", text.scope_value(F.col("scope_value")).alias("value"))
    keys = [("DEVICE", "device_id"), ("OPERATOR", "operator_code"), ("DOCUMENT", "document_id"), ("REFERENCE", "order_code"), ("REFERENCE", "external_code"), ("TRANSACTION", "transaction_key")]
    held = members.select("transaction_key", F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), text.scope_value(F.col(c)).alias("value")) for s, c in keys])).alias("k")).select("transaction_key", "k.scope", "k.value").distinct()
    by_key = held.join(live, ["scope", "value"]).select("transaction_key", "w_rule", "whitelist_id")
    everywhere = live.where("scope = 'GLOBAL'").select("w_rule", "whitelist_id")
    keyed = findings.select("transaction_key", "rule_code")
    # Global entries: one row a rule code at most after the minimum, so this join is bounded by the rules.
    first = everywhere.groupBy(F.coalesce("w_rule", F.lit("*")).alias("_rule")).agg(F.min("whitelist_id").alias("whitelist_id"))
    wide = keyed.withColumn("_rule", F.explode(F.array(F.lit("*"), F.col("rule_code")))).join(first, "_rule").select("transaction_key", "rule_code", F.lit(None).cast("string").alias("w_rule"), "whitelist_id")
    hit = keyed.join(by_key, "transaction_key").unionByName(wide)
    hit = hit.where(F.col("w_rule").isNull() | (F.col("w_rule") == F.col("rule_code"))).groupBy("transaction_key", "rule_code").agg(F.min("whitelist_id").alias("whitelist_id"))
    return findings.join(hit, ["transaction_key", "rule_code"], "left")


def operator_stats(transactions: DataFrame, alerts: DataFrame, own: str = "UNUSUAL_OPERATOR_PATTERN") -> DataFrame:
    """Transactions, anomalous ones and cancellations of each operator, from alerts of earlier runs."""
    bad = alerts.where(F.col("rule_code") != own).select("transaction_key").distinct().withColumn("bad", F.lit(1))
    t = transactions.where(F.col("operator_code").isNotNull()).join(bad, "transaction_key", "left")
    return t.groupBy("operator_code").agg(F.count_distinct("transaction_key").alias("transactions_"), F.count("bad").alias("anomalous"), F.sum("cancellations").alias("voids"))


def rule_fingerprint(code: Column, severity: Column, weight: Column, parameters: Column) -> Column:
    """F42."""
    return F.sha2(values.canonical_json({"code": code, "parameters": parameters, "severity": severity, "weight": weight}), 256)


def versions(history: DataFrame) -> DataFrame:
    """Effective intervals from ``history(code, changed_at, fingerprint)``; a return to an old setting is a new version."""
    w = Window.partitionBy("code").orderBy("changed_at")
    new = history.withColumn("_last", F.lag("fingerprint").over(w)).where(~F.col("_last").eqNullSafe(F.col("fingerprint"))).drop("_last")
    return new.withColumns({"version": F.row_number().over(w), "effective_to": F.lead("changed_at").over(w)}).withColumnRenamed("changed_at", "effective_from")


def canonical_alerts(alerts: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first alert of each group is canonical, later ones name it."""
    w = Window.partitionBy(*by).orderBy(*order)
    return alerts.withColumns({"is_canonical": F.row_number().over(w) == 1, "canonical_id": F.first("alert_id").over(w)})
