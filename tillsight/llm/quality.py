"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, digit runs to 0, white space collapsed) and hashed. For each host the
number of distinct documents that hold a line is counted over all documents. A line is removed from every document of
the host if it is held by more than ``max(min_docs, share * documents of the host)`` documents, or by more than
``most_docs`` whatever the host's size. With ``min_texts`` it must also be in more than so many different texts, so that copies
of a few texts deplete nobody (for callers whose next stage finds copies). A document that loses more than half its words is depleted and rejected. Only DataFrame
functions run.

Hot hosts and lines: counts are reduced map-side before each shuffle, and the join that marks removable
lines lets Spark split a hot key. No line is dropped from the counts.

Defined cases: a null or empty text has no words and fails the base rule; a null host counts as the empty one;
equal rows (same id and text) are one document and get equal verdicts; one id with two texts is two documents; an empty
table gives an empty result; extra columns are carried through, but those named in ``ADDED`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import SPACE, fresh, let, row_key, spaced, words_of

MIN_WORDS, REPEAT_SHARE, WINDOW = 20, 30, 8
MIN_DOCS, SHARE, MOST_DOCS, MIN_TEXTS, KEEP_SHARE = 10, 0.1, 10_000, 0, 0.5
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept", "clean_text")


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE, " "))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(_normal(line))


def _pairs(step: int):
    """Hash of each element of an array with the one ``step`` places on; null where there is none."""
    return lambda a: F.transform(a, lambda h, i: F.when(i + step < F.size(a), F.xxhash64(h, F.get(a, i + step))))


def _again(sorted_windows: Column) -> Column:
    """Places of the windows whose hash occurs twice or more."""
    same = lambda x, i: F.coalesce(x["h"] == F.get(sorted_windows, i)["h"], F.lit(False))
    return F.transform(F.filter(sorted_windows, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"])


def repeat_words(words: Column) -> Column:
    """Words within windows of eight words that occur twice or more.

    Windows are hashed by doubling (words, pairs, fours, eights) and sorted, so that equal ones meet. All
    intermediate arrays are lambda parameters: whatever the optimiser moves, they are computed once a row.
    """
    eights = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        eights = let(eights, _pairs(step))
    full = let(eights, lambda a: F.slice(a, F.lit(1), F.greatest(F.size(a) - (WINDOW - 1), F.lit(0))))
    windows = F.sort_array(F.transform(full, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    # Union of [p, p + 8): each window adds what reaches beyond the last one's end.
    return F.aggregate(
        F.sort_array(let(windows, _again)), F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["sum"] + (p + WINDOW - F.greatest(acc["end"], p))).alias("sum"), (p + WINDOW).alias("end")), lambda acc: acc["sum"],
    )


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = words_of(F.col(text_col))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    unsigned = text
    for c in "#*$%&|<>":
        unsigned = F.replace(unsigned, F.lit(c), F.lit(""))
    df = docs.withColumns({
        "n_words": F.size(words).cast("bigint"),
        "word_chars": F.length(F.replace(spaced(text), F.lit(" "), F.lit(""))).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(unsigned)).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
        "n_repeat_words": repeat_words(words),
    })
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_SHARE * F.col("n_words")))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, most_docs: int = MOST_DOCS, min_texts: int = MIN_TEXTS, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``(_host, _h)`` of the lines above the host's limit."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.coalesce(F.col(host_col), F.lit("")).alias("_host"), F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text).alias("_d"), F.xxhash64(text).alias("_t"), text.alias("_text"))
    hosts = slim.select("_host", "_d").distinct().groupBy("_host").agg(F.count("*").alias("_docs"))
    normal = F.filter(F.transform(F.split("_text", "\n", -1), _normal), lambda x: x != "")
    hashes = F.array_distinct(F.transform(normal, lambda x: F.xxhash64(x)))
    # A document's lines are distinct, so equal rows alone could count twice: documents are counted by text first.
    docs_of = slim.select("_host", "_t", "_d").distinct().groupBy("_host", "_t").agg(F.count("*").alias("_n"))
    by_text = slim.select("_host", "_t", F.explode(hashes).alias("_h")).distinct().join(docs_of, ["_host", "_t"])
    found = by_text.groupBy("_host", "_h").agg(F.sum("_n").alias("_n"), F.count("*").alias("_m"))
    found = found.where((F.col("_n") > min_docs) & (F.col("_m") > min_texts)).join(hosts, "_host")
    return found.where((F.col("_n") > share * F.col("_docs")) | (F.col("_n") > most_docs)).select("_host", "_h")


def line_quality(docs: DataFrame, min_docs: int = MIN_DOCS, share: float = SHARE, most_docs: int = MOST_DOCS, min_texts: int = MIN_TEXTS, keep_share: float = KEEP_SHARE, text_col: str = "text", host_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the base columns, removed_words, clean_text and kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    host = F.coalesce(F.col(host_col), F.lit(""))
    frequent = frequent_lines(docs, min_docs, share, most_docs, min_texts, text_col, host_col, id_col)
    # A normal line's words are those of the line itself: one blank between each two.
    line = lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("n"))
    normal = F.filter(F.transform(F.split(text, "\n", -1), _normal), lambda x: x != "")
    lines = docs.select(*row_key(host, text), host.alias("_host"), F.posexplode(F.transform(normal, line)).alias("_at", "_l"))
    # Copies share one key, so a line of theirs is one row.
    lines = lines.select("_k1", "_k2", "_host", "_at", F.col("_l.h").alias("_h"), F.col("_l.n").alias("_n"))
    removed = lines.join(frequent, ["_host", "_h"]).distinct().groupBy("_k1", "_k2").agg(F.sum("_n").alias("_gone"), F.collect_set("_h").alias("_out"))
    k1, k2, gone, out = fresh(docs, "_k1", "_k2", "_gone", "_out")
    removed = removed.select(F.col("_k1").alias(k1), F.col("_k2").alias(k2), F.col("_gone").alias(gone), F.col("_out").alias(out))
    df = base_rules(docs, text_col).withColumns(dict(zip((k1, k2), row_key(host, text), strict=True)))
    df = df.join(removed, [k1, k2], "left").withColumn("removed_words", F.coalesce(F.col(gone), F.lit(0)).cast("bigint"))
    rest = F.col("n_words") - F.col("removed_words")
    kept = ~F.col("base_failed") & (rest >= keep_share * F.col("n_words"))
    clean = F.when(F.col(out).isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains(F.col(out), _line_hash(x)) | (_normal(x) == "")), "\n"))
    return df.withColumn("kept", kept).withColumn("clean_text", clean).drop(k1, k2, gone, out)


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
words AS (SELECT rid, doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM docs),
wins AS (SELECT rid, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM words WHERE len(w) >= 8)),
twice AS (SELECT rid, p FROM wins QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS q FROM twice) GROUP BY rid),
lines AS (SELECT rid, doc_id, host, t, l, trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS nl,
  len(list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS lw FROM (SELECT rid, doc_id, host, t, unnest(string_split(t, chr(10))) AS l FROM docs)),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM lines WHERE lw > 0 GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT (doc_id, t)) AS n FROM docs GROUP BY host),
freq AS (SELECT l.host, nl FROM lines l JOIN hosts h ON l.host = h.host WHERE nl <> '' GROUP BY l.host, nl, n
  HAVING count(DISTINCT (doc_id, t)) > 10 AND (count(DISTINCT (doc_id, t)) > 0.1 * n OR count(DISTINCT (doc_id, t)) > 10000)),
gone AS (SELECT rid, sum(lw) AS n FROM lines JOIN freq USING (host, nl) GROUP BY rid),
base AS (SELECT w.rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM words w LEFT JOIN dup ON w.rid = dup.rid LEFT JOIN rep ON w.rid = rep.rid LEFT JOIN gone ON w.rid = gone.rid),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words
FROM judged"""
