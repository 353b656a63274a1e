"""Text normalisations. Each caller has its own rule; they are deliberately not shared."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def collapse(x: Column) -> Column:
    """White-space runs to one blank, ends trimmed, empty to null."""
    return F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit(""))


@lru_cache(maxsize=100_000)
def folded(x: str | None) -> str | None:
    """F1 of one value; codes and item names recur, so a worker remembers them."""
    if x is None:
        return None
    plain = x if x.isascii() else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))
    return " ".join(plain.upper().split()) or None


@pandas_udf(StringType())
def _fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(folded)


@pandas_udf(StringType())
def _casefold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(x):
        return None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()) or None

    for part in parts:
        yield part.map(one)


def identity(x: Column) -> Column:
    """compatibility-decomposed, without marks, upper case, collapsed. Needs Unicode tables, hence Arrow."""
    return _fold(x)


def identities(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with F1 of each of ``columns`` in its place, all in one pass over the workers."""
    names = list(df.columns)
    at = [names.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(batch.columns)
            for i in at:
                cols[i] = pa.array([folded(x) for x in cols[i].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(run, df.schema)


def scope_value(x: Column) -> Column:
    """upper case and collapsed; accents stay."""
    return collapse(F.upper(x))


def price_description(x: Column) -> Column:
    """compatibility-composed, case-folded, collapsed."""
    return _casefold(x)


def price_code(x: Column) -> Column:
    """trimmed, case kept."""
    return F.nullif(F.trim(x), F.lit(""))


def view_line_key(code: Column, description: Column, sequence: Column) -> Column:
    """key of a line in read models."""
    some = lambda c: c.isNotNull() & (c != "")
    return F.when(some(code), F.concat(F.lit("CODE:"), F.coalesce(scope_value(code), F.lit("")))).when(some(description), F.concat(F.lit("DESC:"), F.coalesce(scope_value(description), F.lit("")))).otherwise(F.concat(F.lit("SEQUENCE:"), sequence.cast("string")))


def line_key(code: Column, description: Column, ordinal: Column) -> Column:
    """key of a line in the engine, over already folded code and description."""
    return F.coalesce(F.concat(F.lit("CODE:"), code), F.concat(F.lit("DESC:"), description), F.concat(F.lit("POSITION:"), ordinal.cast("string")))


def numeric_suffix(x: Column) -> Column:
    """struct(prefix, number), null without trailing digits."""
    t = F.trim(x)
    return F.when(t.rlike(r"\d$"), F.struct(F.regexp_extract(t, r"^(.*?)(\d+)$", 1).alias("prefix"), F.regexp_extract(t, r"^(.*?)(\d+)$", 2).cast("decimal(38,0)").alias("number")))


def counter_suffix(x: Column) -> Column:
    """one to eight digits at the end, alone or after - or /."""
    return F.nullif(F.regexp_extract(x, r"(?:^|[-/])(\d{1,8})$", 1), F.lit(""))


def worker_suffix(x: Column) -> Column:
    """the part after the last dash if it is all digits, of any length."""
    last = F.element_at(F.split(x, "-"), -1)
    return F.when(last.rlike(r"^\d+$"), last)


def document_code(x: Column) -> Column:
    """F25."""
    return F.upper(F.replace(F.trim(x), F.lit("/"), F.lit("-")))


def csv_safe(x: Column) -> Column:
    """cells that a spreadsheet would run are quoted."""
    return F.when(x.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), x)).otherwise(x)


#: Names whose values are secrets, and what stands in for them.
SECRET_NAMES = ("password", "passwd", "passphrase", "token", "secret", "authorization", "api-key", "api_key", "apikey")
HIDDEN = "<redacted>"


def _behind(*parts: str) -> str:
    """A place that these parts stand directly before."""
    return "(?i)(?<=" + "".join(parts) + ")"


def redact(x: Column, most: int = 16_384) -> Column:
    """F32: what stands behind a user name in an address, behind a secret's name and its sign, or behind ``bearer``; bounded in length."""
    x = F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("…<truncated>"))).otherwise(x)
    gap, no_end = r"\s{0,64}", r"[^\s,;]+"
    secrets = (
        _behind("[a-z0-9.+-]", "://", r"[^\s:@/]{1,255}", ":") + r"[^\s@/]+(?=@)",
        _behind(r"\b(?:", "|".join(SECRET_NAMES), ")", gap, "[:=]", gap) + rf"(?!\s){no_end}",
        _behind(r"\bbearer\s{1,64}") + r"[\w~+/=.\-]+",
    )
    for secret in secrets:
        x = F.regexp_replace(x, secret, HIDDEN)
    return x


def safe_name(x: Column) -> Column:
    """a file name of plain characters, 191 at most."""
    plain = F.regexp_replace(F.regexp_replace(x, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, 191), F.lit("")), F.lit("evidence.bin"))


#: How pictures that were read, control sequences and line ends are written in stored texts.
READ_PICTURE, ANNOTATION, LINE_END = "<OCR:[^>]+>(.*?)</OCR:[^>]+>", "<(?:ESC/POS|BYTE):[^>]*>", "\r\n?"


def receipt_text(x: Column, most: int = 250_000) -> Column:
    """readable lines: text that was read from pictures stays, annotations and control characters go, one blank line at most in a row."""
    x = F.regexp_replace(F.substring(x, 1, most), LINE_END, "\n")
    x = F.regexp_replace(x, f"(?s){READ_PICTURE}", "$1")
    x = F.regexp_replace(x, ANNOTATION, "")
    x = F.regexp_replace(x, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    lines = F.transform(F.split(x, "\n", -1), lambda line: F.regexp_replace(line, r"(?U)\s+$", ""))
    one = F.filter(F.transform(lines, lambda line, i: F.struct(line.alias("l"), F.coalesce(F.get(lines, i - 1), F.lit("")).alias("before"))), lambda p: (p["l"] != "") | (p["before"] != ""))
    return F.regexp_replace(F.array_join(F.transform(one, lambda p: p["l"]), "\n"), r"\n+\z", "")


def has_letter_and_digit(x: Column) -> Column:
    """F47."""
    return x.rlike("[A-Za-z]") & x.rlike("[0-9]")


def table_code(x: Column) -> Column:
    """trimmed and upper case; the letter O in a wholly numeric code, before a suffix at most, is a zero."""
    code = F.substring(F.upper(F.trim(x)), 1, 128)
    head = F.regexp_extract(code, r"^([O0-9]{1,8})((?:[-/][A-Z0-9]{1,16})?)$", 1)
    rest = F.regexp_extract(code, r"^([O0-9]{1,8})((?:[-/][A-Z0-9]{1,16})?)$", 2)
    return F.when(head.contains("O") & head.rlike("[0-9]"), F.concat(F.translate(head, "O", "0"), rest)).otherwise(code)


#: The words that name a till ticket's class, first match wins; a signed quantity comes after the first four.
TICKET_WORDS = (
    ("CONFORMING_COPY", ("COPIA CONFORME",)),
    ("REPRINT", ("RISTAMPA",)),
    ("CANCELLATION", ("ANNULL", "STORNO")),
    ("PRE_BILL", ("PRECONTO", "PRE-CONTO")),
    ("ORDER_CHANGE", ()),
    ("KITCHEN_ORDER", ("COMANDA", "CUCINA")),
    ("ORDER", ("ORDINE",)),
)


def pos_class(x: Column) -> Column:
    """class of a till ticket by its wording."""
    words, out = F.upper(x), None
    minus = x.rlike(r"(?m)^[ \t]*-[0-9]+(?:[.,][0-9]+)?[ \t]*[xX][ \t]+")
    for kind, any_of in TICKET_WORDS:
        hit = minus if not any_of else words.rlike("|".join(any_of))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    covers = words.contains("COPERTI:") & x.rlike(r"\b[0-9]+\s*[xX]\s+")
    return out.when(words.contains("PORTATA:") | covers, "KITCHEN_ORDER").when(words.contains("DOCUMENTO GESTIONALE"), "MANAGEMENT_DOCUMENT").otherwise("UNKNOWN")


#: Rows printed among the items that sell nothing: whole names, and beginnings of names.
NON_SALE_NAMES = ("PAGAMENTO CONTANTE",)
NON_SALE_STARTS = ("IVA", "TOT", "TOTALE", "RESTO", "CONTANTI", "IMPORTO PAGATO", "IMPONIBILE", "ALIQUOTA IVA", "PAGAMENTO")


def non_sale_line(description: Column) -> Column:
    """P20: tax, total, change and payment rows printed among the items."""
    words = F.trim(F.regexp_replace(F.upper(description), r"[^\p{L}\p{N}]+", " "))
    return words.isin(*NON_SALE_NAMES) | words.rlike(f"^({'|'.join(NON_SALE_STARTS)})( |$)")
