"""Text and CSV views of documents and alerts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillsight.functions import text

#: Wording of the text views.
NOT_SEEN = "Non osservato nel flusso"
NO_OFFSET = "Non calcolabile: uno o entrambi gli orari non sono stati osservati nel flusso"
NO_HEADER = "Non osservata nel flusso e non configurata"
HEADER_SOURCES = {"RCH_PRINTED_HEADER": "Osservata nel blocco iniziale stampato dalla RCH", "DEVICE_METADATA_CONFIGURED": "Configurata sul dispositivo (non osservata nel flusso)"}
TIME_SOURCES = {
    "RCH_APPLICATION_PRINTED_TEXT": "testo applicativo stampato dalla RCH", "RCH_FOOTER_PRINTED_TEXT": "footer stampato dalla RCH",
    "ESC_POS_PRINTED_OPERATOR_LINE": "riga operatore stampata dal gestionale POS", "DEVICE_METADATA_CONFIGURED": "metadato dispositivo configurato (non osservato nel flusso)",
}
SERIAL_SOURCES = {
    "RCH_PRINTED_RT_PREFIX": "prefisso RT stampato dalla RCH", "RCH_PRINTED_BARE_SERIAL_AFTER_FOOTER": "seriale stampato dopo il footer RCH",
    "DEVICE_METADATA_CONFIGURED": "metadato dispositivo configurato (non osservato nel flusso)",
}
HEADER_FIELDS = (("Insegna", "merchant_name"), ("Ragione sociale", "legal_name"))
HEADER_CODES = (("Telefono", "phone"), ("Codice fiscale", "tax_code"), ("Partita IVA", "vat_number"))
CSV_HEADER = ("id", "regola", "severita", "punteggio", "stato", "aperto_il", "descrizione")
_CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"


def _named(value: Column, names: dict[str, str], other: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), F.concat(F.lit(other), value))


def offset_label(seconds: Column) -> Column:
    """how far the printer's footer is from the application's time; ``seconds`` may be text."""
    n = seconds.cast("string").try_cast("int")
    size = F.abs(n)
    minutes, rest = F.floor(size / 60).cast("string"), size % 60
    long = F.concat_ws(" ", F.when(size >= 60, F.concat(minutes, F.lit(" min"))), F.when(rest > 0, F.concat(rest.cast("string"), F.lit(" s"))))
    told = F.concat(F.when(n < 0, "").otherwise("+"), n.cast("string"), F.lit(" s (footer RCH "), F.when(n < 0, "indietro").otherwise("avanti"), F.lit(" di "), long, F.lit(" rispetto all'ora applicativa)"))
    return F.when(seconds.isNull(), NO_OFFSET).when(n.isNull(), "Scarto non valido").when(n == 0, "0 s (orologi allineati al minuto/secondo osservato)").otherwise(told)


def printed_time(t: Column, precision: Column, zone: str = "Europe/Rome") -> Column:
    """A UTC time as the site prints it, to the minute or second."""
    local = F.from_utc_timestamp(t, zone)
    return F.when(t.isNull(), NOT_SEEN).when(precision == "MINUTE", F.date_format(local, "dd/MM/yyyy HH:mm")).otherwise(F.date_format(local, "dd/MM/yyyy HH:mm:ss"))


def identity_lines(d: dict[str, Column]) -> Column:
    """times and serial of a fiscal document, each with where it comes from.

    ``d`` has application_time, application_precision, application_evidence, footer_time, footer_precision,
    footer_evidence, captured_at, offset, serial and serial_evidence.
    """
    second = F.lit("SECOND")
    said = lambda value, evidence, names: F.concat(F.lit("  Provenienza: "), F.when(value.isNull() | evidence.isNull(), NOT_SEEN).otherwise(_named(evidence, names, "evidenza dichiarata: ")))
    line = lambda label, value: F.concat(F.lit(label), value)
    serial = F.coalesce(F.nullif(F.trim(F.regexp_replace(d["serial"], _CONTROL, "")), F.lit("")), F.lit(NOT_SEEN))
    return F.array(
        line("Ora applicativa RCH: ", printed_time(d["application_time"], d["application_precision"])), said(d["application_time"], d["application_evidence"], TIME_SOURCES),
        line("Acquisizione server: ", F.when(d["captured_at"].isNull(), "Non disponibile").otherwise(printed_time(d["captured_at"], second))), F.lit("  Provenienza: timestamp registrato dal server; non e' un orario stampato dalla RCH"),
        line("Ora footer RCH: ", printed_time(d["footer_time"], d["footer_precision"])), said(d["footer_time"], d["footer_evidence"], TIME_SOURCES),
        line("Scarto orologio (footer - applicativa): ", offset_label(d["offset"])), line("Seriale RCH: ", serial), said(d["serial"], d["serial_evidence"], SERIAL_SOURCES),
    )


def header_source(evidence: Column) -> Column:
    return F.when(evidence.isNull(), NO_HEADER).otherwise(_named(evidence, HEADER_SOURCES, "Provenienza non riconosciuta: "))


def header_lines(header: Column, most: int = 240) -> Column:
    """a receipt's header struct (merchant_name, legal_name, address_lines, phone, tax_code, vat_number, evidence) as lines."""
    clean = lambda x: F.substring(F.nullif(F.trim(F.regexp_replace(x, _CONTROL, "")), F.lit("")), 1, most)
    one = lambda label, name: F.concat(F.lit(label + ": "), clean(header[name]))
    where = F.transform(header["address_lines"], lambda x, i: F.concat(F.when(i == 0, "Indirizzo").otherwise(F.concat(F.lit("Indirizzo "), (i + 1).cast("string"))), F.lit(": "), clean(x)))
    lines = F.concat(F.array(F.lit("INTESTAZIONE DOCUMENTO"), *[one(*f) for f in HEADER_FIELDS]), F.coalesce(where, F.array().cast("array<string>")), F.array(*[one(*f) for f in HEADER_CODES], F.concat(F.lit("Provenienza intestazione: "), header_source(header["evidence"]))))
    return F.when(header.isNull(), F.array(F.lit("INTESTAZIONE DOCUMENTO"), F.lit("Stato: " + NO_HEADER))).otherwise(F.array_compact(lines))


def text_export(body: Column, header: Column, title: str) -> Column:
    """The text view of a document; a configured header comes before the text, the source of any other after it."""
    configured = F.coalesce(header["evidence"] == "DEVICE_METADATA_CONFIGURED", F.lit(False))
    shown = F.coalesce(F.nullif(text.receipt_text(body), F.lit("")), F.lit("Nessun testo documento disponibile."))
    top = F.array(F.lit(title), F.lit("Il RAW immutabile resta autoritativo."), F.lit(""))
    before = F.when(configured, F.concat(header_lines(header), F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
    after = F.when(configured, F.array().cast("array<string>")).otherwise(F.array(F.lit(""), F.lit("PROVENIENZA INTESTAZIONE"), header_source(header["evidence"])))
    return F.concat(F.array_join(F.concat(top, before, F.array(F.lit("TESTO DOCUMENTO"), shown), after), "\n"), F.lit("\n"))


def csv_line(*cells: Column) -> Column:
    """K6: one CSV record: cells that a spreadsheet would run are made text, commas, quotes and breaks are quoted."""
    def cell(x: Column) -> Column:
        safe = F.coalesce(text.csv_safe(x.cast("string")), F.lit(""))
        return F.when(safe.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)

    return F.concat_ws(",", *[cell(x) for x in cells])
