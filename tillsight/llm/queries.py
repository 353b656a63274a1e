"""The corpus queries ``opN_<name>`` over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm import centroids, extraction, feistel, language, merges, mixing, neighbours, packing, passages, quality, simhash, spelling, toxicity
from tillsight.llm.common import materialise, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = language.fold(F.col("doc_id"), 5)
    # The sample of labels has at most about FIT_ROWS rows of two numbers, so it may be broadcast.
    labels = F.broadcast(toxicity.sampled(table(spark, sf_dir, "labels").where(fold != 0)))
    labelled = materialise(docs.join(labels, "doc_id").select("text", "toxic"), "labelled")
    lm = toxicity.CharModel(toxicity.char_counts(docs))
    found = toxicity.score(docs, toxicity.fit(labelled, lm), carry=["doc_id"])
    return found.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.line_quality(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = feistel.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(packing.tokenise(table(spark, sf_dir, "documents"), with_ids=False))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merges.encode(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids")


def op5_rank_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = language.fold(F.col("doc_id"), 3)
    found = language.identify(docs, language.profiles(docs.where(fold != 1)), carry=["doc_id"])
    return found.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


def op7_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_crf_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_gray_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op11_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = materialise(spelling.vocabulary(table(spark, sf_dir, "documents")), "vocabulary")
    return spelling.variants(vocab).select("word", "form", "root", "n", "n_near", "form_n")


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_quality": op2_line_quality,
    "op3_ffd_packing": op3_ffd_packing,
    "op4_merge_dropout": op4_merge_dropout,
    "op5_rank_language": op5_rank_language,
    "op6_feistel_shards": op6_feistel_shards,
    "op7_hnsw": op7_hnsw,
    "op8_crf_extract": op8_crf_extract,
    "op9_gray_simhash": op9_gray_simhash,
    "op10_compact_windows": op10_compact_windows,
    "op11_weighted_mix": op11_weighted_mix,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_ball_kmeans": op13_ball_kmeans,
}

ORACLES: dict[str, str] = {
    "op2_line_quality": quality.ORACLE,
    "op6_feistel_shards": feistel.oracle(),
    "op11_weighted_mix": mixing.oracle(),
    "op12_spelling_variants": spelling.ORACLE,
    "op13_ball_kmeans": centroids.oracle(),
}
