"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources in code-point order, the null source last, take the weights 5, 2, 1 in turn and share all words of the corpus. A target
stops at ``most`` times its source's size, and what is over is shared again by weight until none is above: the water level
``(all - capped sizes) / (all weights - capped weights)`` is found in rounds, each one aggregate over the table of sources.

Each document draws ``u`` from a hash of seed and id; its key is the exponential variate ``-ln(u) / weight``, whose weight is
the text's quality. Documents sorted by key within their source form a weighted order without replacement. A budget of whole
words first buys complete epochs of the source; what is left goes to documents in that order, by the prefix sum of their
sizes, and the document that crosses the budget gives its first words only. So a source's taken words are its target
rounded down, and no document gives more than ``most`` times its size.

A hot source is no group: rows are dealt by ranges of (source, key), sums are taken a range at a time, and the offsets of the
ranges (one row a range and source) are added afterwards. Nothing but scalars of a round reaches the driver.

Defined cases: a null or empty text has size 0 and gives nothing; the null source is a source of its own, apart from the
empty one; equal ids draw the same ``u``, then the smaller size comes first, and equal rows are interchangeable; a null id
draws like the id ``null``; a source without words has target 0; an empty table gives an empty result; extra columns can be
carried, whatever their names, but those named in ``ADDED`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import fresh, materialise, shuffle_partitions, spaced, words_of
from tillsight.llm.feistel import number_rows

WEIGHTS, MOST, SEED = (5, 2, 1), 3, 20240611
ADDED = ("size", "source_size", "target", "taken")
#: The least quality of a text, so that every document can be drawn.
LEAST_QUALITY = 0.05


def quality(text: Column) -> Column:
    """Share of the characters of words that are no ASCII digits, signs or punctuation, squared; at least LEAST_QUALITY."""
    plain = F.replace(spaced(text), F.lit(" "), F.lit(""))
    letters = F.length(F.regexp_replace(plain, "[!-@\\[-`{-~]+", "")) / F.greatest(F.length(plain), F.lit(1))
    return F.greatest(letters * letters, F.lit(LEAST_QUALITY))


def draw(id_col: Column, seed: int = SEED) -> Column:
    """Uniform in (0, 1) by seed and id: 52 bits of a hash."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes(_none, _s, source_size)`` with ``target``; one row a source."""
    numbered = number_rows(sizes, ["_none", "_s"])
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("row_number") % len(weights) + 1).cast("int")).cast("bigint")
    table = materialise(numbered.select("_none", "_s", "source_size", weight.alias("_w"), (most * F.col("source_size")).alias("_cap")), "sources")
    big = lambda c, digits: c.cast(f"decimal({digits},0)")
    whole = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()
    capped_size = capped_weight = capped = 0
    while True:
        above = big(F.col("_w"), 9) * big(F.lit(whole.size - capped_size), 19) > big(F.col("_cap"), 19) * big(F.lit(whole.w - capped_weight), 18)
        now = table.where(above).agg(F.count("*").alias("n"), F.coalesce(F.sum("_cap"), F.lit(0)).alias("size"), F.coalesce(F.sum("_w"), F.lit(0)).alias("w")).first()
        if now.n == capped:
            break
        capped_size, capped_weight, capped = now.size, now.w, now.n
    level = (F.col("_w") * F.lit(whole.size - capped_size)).cast("double") / F.lit(float(max(whole.w - capped_weight, 1)))
    return table.select("_none", "_s", "source_size", F.when(above, F.col("_cap").cast("double")).otherwise(level).alias("target"))


def mix(docs: DataFrame, carry: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", weight: Column | None = None) -> DataFrame:
    """Per document: the columns of ``carry`` (default: all), size, source_size, target and taken (words, repeats counted).

    ``weight`` replaces the text's quality; where it is null or not above 0 it counts as LEAST_QUALITY.
    """
    spark, carry = docs.sparkSession, [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    # Own columns live in one struct beside the carried ones, so that no name can clash.
    w = quality(F.col(text_col)) if weight is None else F.when(weight > 0, weight).otherwise(LEAST_QUALITY)
    own = [
        F.col(source_col).isNull().alias("_none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_s"), (-F.ln(draw(F.col(id_col), seed)) / w).alias("_key"),
        F.col(id_col).cast("string").alias("_id"), F.size(words_of(F.col(text_col))).cast("bigint").alias("size"),
    ]
    kept = materialise(docs.select(F.struct(*(F.col(c) for c in carry)).alias("_row") if carry else F.lit(None).cast("int").alias("_row"), *own), "sizes")
    order = ["_none", "_s", "_key", "_id", "size", "_salt"]
    ranged = kept.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = materialise(ranged.drop("_salt").withColumn("_at", F.monotonically_increasing_id()), "mix-order").withColumn("_part", F.shiftrightunsigned("_at", 33))
    by = ["_part", "_none", "_s"]
    sums = placed.groupBy(*by).agg(F.sum("size").alias("_sum"))
    # A source has one row a range here: bounded by the number of ranges, whatever the input.
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(Window.partitionBy("_none", "_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = placed.withColumn("_before", inside).join(offsets, by).withColumn("_before", F.col("_before") + F.col("_offset"))
    targets = source_targets(sums.groupBy("_none", "_s").agg(F.sum("_sum").alias("source_size")), weights, most)
    budget, size, all_words = F.floor("target").cast("bigint"), F.col("size"), F.greatest("source_size", F.lit(1))
    rest = budget % all_words
    taken = F.floor((budget - rest) / all_words).cast("bigint") * size + F.greatest(F.lit(0), F.least(size, rest - F.col("_before")))
    out = before.join(targets, ["_none", "_s"]).withColumn("taken", taken.cast("bigint"))
    return out.select(*(F.col("_row")[c].alias(c) for c in carry), *ADDED)


def mixed_texts(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: ``mixed`` (from ``mix``, its text carried) with one row a copy, ``epoch`` from 1, and the text cut to what is taken.

    A whole copy keeps its text; a cut one has its first words, one blank between each two. Documents that give nothing go.
    """
    epoch, = fresh(mixed, "epoch")
    copies = F.ceil(F.col("taken") / F.greatest("size", F.lit(1))).cast("int")
    rows = mixed.where("taken > 0").withColumn(epoch, F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("size"), F.col("taken") - (F.col(epoch) - 1) * F.col("size")).cast("int")
    text = F.when(words == F.col("size"), F.col(text_col)).otherwise(F.array_join(F.slice(words_of(F.col(text_col)), F.lit(1), words), " "))
    return rows.withColumn(text_col, text)


def oracle(weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> str:
    """DuckDB SQL for the query's rows over ``documents``."""
    return rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS u, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS p FROM documents),
docs AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(u, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
  length(regexp_replace(p, '[!-@\[-`{{-~]+', '', 'g'))::DOUBLE / greatest(length(p), 1)::DOUBLE AS share,
  (('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r} AS u01 FROM t),
keyed AS (SELECT *, -ln(u01) / greatest(share * share, {LEAST_QUALITY}) AS key FROM docs),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} AS i FROM docs GROUP BY source),
weighed AS (SELECT source, source_size, {most} * source_size AS cap, [{', '.join(map(str, weights))}][i + 1]::BIGINT AS w FROM sizes),
level AS (SELECT *, sum(source_size) OVER ()::BIGINT AS t_all, sum(w) OVER ()::BIGINT AS w_all,
  coalesce(sum(cap) OVER o, 0)::BIGINT AS c, coalesce(sum(w) OVER o, 0)::BIGINT AS v FROM weighed
  WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, w::HUGEINT * (t_all - c) > cap::HUGEINT * (w_all - v) AS is_capped FROM level),
rest AS (SELECT coalesce(sum(cap) FILTER (is_capped), 0)::BIGINT AS c, coalesce(sum(w) FILTER (is_capped), 0)::BIGINT AS v FROM capped),
targets AS (SELECT source, source_size, CASE WHEN is_capped THEN cap::DOUBLE ELSE (w * (t_all - rest.c))::DOUBLE / greatest(w_all - rest.v, 1)::DOUBLE END AS target FROM capped, rest),
placed AS (SELECT doc_id, k.source, size, t.source_size, target, floor(target)::BIGINT AS budget, greatest(t.source_size, 1) AS whole,
  coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id::VARCHAR NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(budget // whole * size + greatest(0, least(size, budget % whole - before)) AS BIGINT) AS taken FROM placed"""
