"""Labels, presets and provenance rules of the read models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillsight import schema
from tillsight.functions import text

#: What the pages call a document type.
TYPE_LABELS = {"PRE_BILL": "Preconto", "COMMERCIAL_DOCUMENT": "Documento commerciale", "MANAGEMENT_DOCUMENT": "Documento gestionale", "KITCHEN_ORDER": "Comanda", "ORDER_CHANGE": "Variazione", "CANCELLATION": "Annullo", "CONFORMING_COPY": "Copia conforme", "REPRINT": "Ristampa", "DEVICE_RESPONSE": "Risposta dispositivo"}


def type_label(kind: Column) -> Column:
    """the label, or the code itself."""
    table = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), kind)


def confidence_label(x: Column) -> Column:
    """shares up to one are percentages; one decimal."""
    return F.round(F.when(x <= 1, x * 100).otherwise(x), 1)


def namespace(kind: Column) -> Column:
    """F16: which counter numbers a document."""
    return F.when(kind.isin("PRE_BILL", "MANAGEMENT_DOCUMENT"), "MANAGEMENT").when(kind.isin("COMMERCIAL_DOCUMENT", "REFUND"), "COMMERCIAL")


#: The metadata keys that may hold a reference; the second and last are the strong ones.
REFERENCE_KEYS = ("reference", "order_reference", "document_reference", "transaction_reference")


def references(metadata: Column) -> Column:
    """folded references in a JSON object, sorted, without repeats."""
    found = F.array(*[text.identity(F.get_json_object(metadata, f"$.{k}")) for k in REFERENCE_KEYS])
    return F.array_sort(F.array_distinct(F.array_compact(found)))


def strong_reference(metadata: Column) -> Column:
    """the order's, else the transaction's."""
    return F.coalesce(*[text.identity(F.get_json_object(metadata, f"$.{k}")) for k in REFERENCE_KEYS[1::2]])


def serial(printed: Column, configured: Column, device_type: Column) -> Column:
    """struct(serial, origin): the printed serial, else a well-formed configured one of a fiscal device."""
    good = lambda x: x.rlike("^[A-Z0-9]{6,20}$") & text.has_letter_and_digit(x)
    p, c = F.upper(F.trim(printed)), F.upper(F.trim(configured))
    own = F.coalesce(good(p), F.lit(False))
    given = F.coalesce(good(c) & (device_type == "rch"), F.lit(False))
    return F.struct(F.when(own, p).when(given, c).alias("serial"), F.when(own, "PRINTED").when(given, "CONFIGURED").alias("origin"))


#: How much of a document's number a capture shows, and the types that carry one.
FULL, SUFFIX, NOT_SEEN, NO_NUMBER = "FULL_CODE_OBSERVED_IN_CAPTURE", "SUFFIX_ONLY_OBSERVED_IN_CAPTURE", "NOT_OBSERVED_IN_CAPTURE", "NOT_APPLICABLE"
NUMBERED_TYPES = ("PRE_BILL", "MANAGEMENT_DOCUMENT", "CONFORMING_COPY", "COMMERCIAL_DOCUMENT")


def progressive_status(explicit: Column, code: Column, suffix: Column, kind: Column) -> Column:
    """a known stated status, else whether code or suffix was seen, else whether the type has a number at all."""
    seen = lambda c: F.coalesce(c != "", F.lit(False))
    return F.when(explicit.isin(FULL, SUFFIX, NOT_SEEN, NO_NUMBER), explicit).when(seen(code), FULL).when(seen(suffix), SUFFIX).when(kind.isin(*NUMBERED_TYPES), NOT_SEEN).otherwise(NO_NUMBER)


#: Headings of management papers that sell nothing.
SHIFT_HEADING, INVOICE_HEADINGS, NUMBER_WORDS = "REPORT DI FINE TURNO", ("FATTURA", "FATTURA ELETTRONICA"), ("N", "NR", "NUMERO")


def management_class(body: Column) -> Column:
    """a shift report by its first line, an invoice by a line that is its heading or its number."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.upper(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))), lambda x: x != "")
    number = f"(?:{'|'.join(NUMBER_WORDS)})[.°º]?"
    value = r"\s*[:#-]?\s*(?=[A-Z0-9./-]*[0-9])[A-Z0-9][A-Z0-9./-]{0,63}"
    invoice = F.exists(lines, lambda x: x.isin(*INVOICE_HEADINGS) | x.rlike(f"^(?:(?:{'|'.join(reversed(INVOICE_HEADINGS))}) {number}|{number} {INVOICE_HEADINGS[0]}){value}$"))
    return F.when(F.get(lines, F.lit(0)).rlike(rf"^{SHIFT_HEADING}\b"), "SHIFT_END_REPORT").when(invoice, "INVOICE")


def zoned_time(x: Column) -> Column:
    """an ISO time with its zone as UTC; without a zone it is rejected (null)."""
    return F.when(x.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(x))


def preset(name: str, now: Column, zone: str = "Europe/Rome") -> tuple[Column, Column]:
    """start and end of a period preset in site time, as UTC."""
    day = F.date_trunc("day", F.from_utc_timestamp(now, zone))
    start = {"today": day, "yesterday": day - F.expr("INTERVAL 1 DAY"), "last_7_days": day - F.expr("INTERVAL 6 DAYS")}[name]
    end = {"today": day + F.expr("INTERVAL 1 DAY"), "yesterday": day, "last_7_days": day + F.expr("INTERVAL 1 DAY")}[name]
    return F.to_utc_timestamp(start, zone), F.to_utc_timestamp(end, zone)


#: Words before and after which a wrapped name goes on with a blank, and units.
FUNCTION_WORDS = ("a", "ai", "al", "alla", "alle", "agli", "con", "da", "dal", "dalla", "delle", "di", "e", "in", "per", "senza", "su")
UNITS = ("cl", "dl", "g", "gr", "kg", "l", "ml")


def join_wrapped(first: Column, rest: Column, force_space: bool = False) -> Column:
    """a wrapped item name; its rest goes on within the word unless a function word or a unit is at the joint."""
    part = F.trim(F.regexp_replace(rest, r"\s+", " "))
    low = F.lower(part)
    next_, last = F.split(low, " ")[0], F.element_at(F.split(F.lower(F.trim(first)), r"\s+"), -1)
    starts = next_.isin(*FUNCTION_WORDS) & ((F.length(next_) > 1) | low.contains(" "))
    space = F.lit(force_space) | starts | low.isin(*UNITS) | last.isin(*FUNCTION_WORDS)
    return F.when(F.coalesce(part, F.lit("")) == "", first).otherwise(F.concat(first, F.when(space, " ").otherwise(""), part))


def valid_fields(name: Column, count: Column, digest: Column, uid: Column) -> Column:
    """a bounded text, a bounded number, a lower-case SHA-256 and a UUID."""
    return F.coalesce((F.length(F.trim(name)) > 0) & (F.length(name) <= 191) & count.between(0, 10_000_000) & digest.rlike("^[0-9a-f]{64}$") & uid.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False))


def merged_warnings(*lists: Column) -> Column:
    """All warnings in order, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(x, none) for x in lists])))


#: What an alert list shows if nothing is asked for.
ALERT_DEFAULTS = {"view": "operational", "minimum_difference": 0.01}


def alert_filter(asked: dict) -> Column:
    """The alerts of a view (operational, archive, all) from a least difference on, with the defaults where nothing is asked."""
    want = ALERT_DEFAULTS | {k: v for k, v in asked.items() if v not in (None, "")}
    states = {"operational": schema.OPERATIONAL_STATES, "archive": schema.ARCHIVE_STATES}.get(want["view"])
    c = F.col("difference") >= F.lit(want["minimum_difference"])
    for name in ("severity", "rule_code"):
        if name in want:
            c = c & (F.col(name) == want[name])
    return c if states is None else c & F.col("status").isin(*states)
