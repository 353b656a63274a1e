"""The corpus pipeline: quality rules, language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import language, packing, passages, quality, simhash
from tillsight.llm.common import fresh, materialise, row_key, table
from tillsight.plans.shipping import ship

#: Lines that copies of so few texts hold stay: a later stage keeps one of the copies.
MIN_TEXTS = 10
#: Below this score no profile fits a text; natural text of a learned language scores far above it.
MIN_LANGUAGE_SCORE = 0.1


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list]:
    """``docs`` with columns that an operator would replace under other names, and how to select them back."""
    there = {c: fresh(docs, *names)[names.index(c)] for c in docs.columns if c in names}
    return docs.withColumnsRenamed(there), [F.col(there.get(c, c)).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the line rule keep, without their host's frequent lines.

    Null, empty and short texts go (base rule); of equal rows all stay or go alike; columns of any name are kept.
    """
    renamed, back = _aside(docs, quality.ADDED)
    text = F.when(F.col("removed_words") > 0, F.col("clean_text")).otherwise(F.col("text"))
    kept = quality.line_quality(renamed, min_texts=MIN_TEXTS).where("kept").withColumn("text", text)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*back)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; those without a letter or near no profile go.

    Without any labelled document there is no profile to judge by, and all documents stay.
    """
    known = language.profiles(docs.where(language.fold(F.col("doc_id"), 3) != 1))
    if not known:
        return docs
    renamed, back = _aside(docs, ("lang_pred", "score"))
    return language.identify(renamed, known).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*back)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: that with the least id, one with an id before those without.

    Rows are told apart by all their columns, since ids may be null or reused. Equal rows are always in one group.
    """
    content = [*docs.columns, *(F.col(c).isNull() for c in docs.columns)]  # a hash passes over nulls
    k1, k2 = fresh(docs, "_k1", "_k2")
    keyed = docs.select("*", *(c.alias(k) for c, k in zip(row_key(*content), (k1, k2), strict=True)))
    row = F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("id"), F.col(k1).alias("k1"), F.col(k2).alias("k2"))
    found = simhash.near_duplicates(keyed.select(row.alias("_row"), "text"), "_row")
    first = (F.col("doc_id.k1") == F.col("component_id.k1")) & (F.col("doc_id.k2") == F.col("component_id.k2"))
    gone = found.where(~first).select(F.col("doc_id.k1").alias(k1), F.col("doc_id.k2").alias(k2))
    # Equal rows have equal keys and are all of them first in their group.
    return keyed.join(gone, [k1, k2], "left_anti").dropDuplicates([k1, k2]).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that another document keeps; a text may be empty then, but its row stays."""
    return passages.remove(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 ids; a null or empty text is one piece, its end id."""
    pieces = packing.pack(packing.tokenise(docs, with_ids=False))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _shipped(stage):
    """The stage, after the package has been sent to the workers."""
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _shipped(stage)) for name, stage in [("quality_rules", quality_rules), ("language_id", language_id), ("simhash_dedup", simhash_dedup), ("substring_dedup", substring_dedup), ("packing", packed)]]

#: Language profiles, the near-duplicate and passage stages have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
