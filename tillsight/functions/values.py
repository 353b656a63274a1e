"""Money, time, hashes and other scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(19,4)"
#: The URL namespace of name-based UUIDs.
_NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def half_up(x: Column) -> Column:
    """four decimals, halves away from zero."""
    return F.round(x, 4).cast(MONEY)


def percent(part: Column, whole: Column) -> Column:
    """share in percent, four decimals, halves to even; null where the whole is null or zero."""
    return F.bround(F.try_divide(part.cast("decimal(25,6)"), whole.cast("decimal(19,4)")) * 100, 4).cast("decimal(15,4)")


def unit_price(unit: Column, total: Column, quantity: Column) -> Column:
    """struct(price, origin)."""
    derived = F.when(total.isNotNull() & (quantity != 0), half_up(F.try_divide(total, F.abs(quantity))))
    origin = F.when(unit.isNotNull(), "OBSERVED_UNIT_PRICE").when(derived.isNotNull(), "DERIVED_FROM_OBSERVED_LINE_TOTAL").otherwise("UNAVAILABLE")
    return F.struct(F.coalesce(half_up(unit), derived).alias("price"), origin.alias("origin"))


def printed_money(x: Column) -> Column:
    """1.234,56 to 1234.56; null if it is no number."""
    return F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast(MONEY)


def cents(x: Column) -> Column:
    """F24."""
    return (x.cast("decimal(17,0)") * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(19,2)")


def money_label(x: Column) -> Column:
    """12,50 EUR."""
    return F.concat(F.translate(F.format_string("%.2f", x.cast("double")), ".", ","), F.lit(" EUR"))


def quantity_label(x: Column) -> Column:
    """whole numbers plain, others with a decimal comma and no trailing zeros."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(F.translate(F.regexp_replace(x.cast("string"), "0+$", ""), ".", ","))


def confidence(value: Column, evidence: Column) -> Column:
    """0..1 in percent, clamped; else by the evidence's wording."""
    v = value.try_cast("decimal(19,6)")
    scaled = F.when(v.between(0, 1), v * 100).otherwise(v)
    e = F.upper(evidence)
    word = F.when(e.contains("CONFIRMED") & ~e.contains("UNCONFIRMED"), 100).when(e.contains("INFERRED"), 65).otherwise(25)
    return F.when(v.isNotNull(), F.least(F.lit(100), F.greatest(F.lit(0), scaled.cast("int")))).otherwise(word)


def local_to_utc(local: Column, zone: str, captured: Column | None = None) -> Column:
    """a printed local time as UTC; null where the zone skips it, and of two the one nearer to the capture."""
    first = F.to_utc_timestamp(local, zone)
    known = F.from_utc_timestamp(first, zone) == local
    if captured is None:
        return F.when(known, first)
    ways = [first + F.make_dt_interval(hours=F.lit(h)) for h in (-1, 0, 1)]
    fits = F.filter(F.array(*ways), lambda t: F.from_utc_timestamp(t, zone) == local)
    ranked = F.array_sort(F.transform(fits, lambda t: F.struct(F.abs(F.unix_micros(t) - F.unix_micros(captured)).alias("d"), t.alias("t"))))
    return F.get(ranked, F.lit(0))["t"]


def year_near(two_digits: Column, year: Column) -> Column:
    """the century that brings a two-digit year nearest."""
    century = F.floor(year / 100) * 100
    ways = [(century - 100 + two_digits), (century + two_digits), (century + 100 + two_digits)]
    ranked = F.array_sort(F.array(*[F.struct(F.abs(w - year).alias("d"), F.lit(i).alias("i"), w.cast("int").alias("y")) for i, w in enumerate(ways)]))
    return F.get(ranked, F.lit(0))["y"]


def business_date(t: Column, zone: str = "Europe/Rome") -> Column:
    return F.to_date(F.from_utc_timestamp(t, zone))


def xor_checksum(data: Column) -> Column:
    """exclusive or of a binary's bytes."""
    text = F.hex(data)
    byte = lambda i: F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.aggregate(F.when(F.octet_length(data) > 0, F.sequence(F.lit(0), F.octet_length(data) - 1)).otherwise(F.array().cast("array<int>")), F.lit(0), lambda a, i: a.bitwiseXOR(byte(i)))


def canonical_json(fields: dict[str, Column]) -> Column:
    """keys sorted, no blanks, nulls kept, control characters as \\u with lower-case digits."""
    text = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    for code in [*range(11, 12), *range(14, 32)]:
        if (upper := f"\\u{code:04X}") != upper.lower():
            text = F.replace(text, F.lit(upper), F.lit(upper.lower().replace("\\U", "\\u")))
    return text


def chained_hash(previous: Column, payload: Column) -> Column:
    """SHA-256 of the previous hash's bytes and the payload."""
    return F.sha2(F.concat(F.unhex(previous), F.encode(payload, "UTF-8")), 256)


def content_digest(data: Column) -> Column:
    """F41."""
    return F.concat(F.lit("sha-256=:"), F.base64(F.unhex(F.sha2(data, 256))), F.lit(":"))


def name_uuid(name: Column) -> Column:
    """version 5 UUID in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63))).bitwiseOR(F.lit(128)).cast("string"), 10, 16))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12))


def device_online(status: Column, seen: Column, now: Column) -> Column:
    """P14."""
    return F.coalesce((status == "ONLINE") & (seen >= now - F.make_dt_interval(mins=F.lit(10))), F.lit(False))


def backoff_seconds(attempt: Column) -> Column:
    """Five seconds, doubled each time, an hour at most."""
    return F.least(F.lit(3600), F.lit(5) * F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(10)))).cast("bigint")
