"""Language identification by rank-order profiles.

A text's letters (runs of anything else are one boundary) give n-grams of one to three. A language's
profile is its most frequent n-grams over all labelled texts it may learn from, by rank. A document's own
most frequent n-grams are compared with each profile: the sum over them of how far the rank is out of place, the
greatest distance where the profile lacks the n-gram. The least sum names the language.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the least name;
null labels teach nothing; without any profile every text is ``und``; equal rows get equal answers;
an empty table gives an empty result; extra columns are carried through, but ``lang_pred`` and ``score`` are
replaced. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import fresh

ORDERS, PROFILE, OWN = 3, 400, 300
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def ngrams(text: str) -> np.ndarray:
    """All n-grams as numbers: 21 bits a letter, 0 for a boundary, and a bit that tells their length; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(letters()[codes], codes, 0)
    codes = codes[(codes != 0) | np.r_[True, codes[:-1] != 0]] if len(codes) else codes
    s = np.concatenate([[0] if len(codes) and codes[0] else [], codes, [0] if len(codes) and codes[-1] else []]).astype(np.uint64)
    if not s.any():
        return np.empty(0, np.uint64)
    two = (s[:-1] << np.uint64(21)) | s[1:]
    return np.concatenate([s[s > 0], two | np.uint64(1 << 42), (two[:-1] << np.uint64(21)) | s[2:] | np.uint64(1 << 63)])


def top(grams: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent, most frequent first, ties to the smaller number."""
    value, count = np.unique(grams, return_counts=True)
    return value[np.lexsort((value, -count))[:n]]


def profiles(docs: DataFrame, size: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Each language's n-grams by rank, from all rows of ``docs`` with a text and a language.

    Counts are gathered over the whole input and summed by Spark; only ``size`` n-grams a language, kept
    by a limited window, reach the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(np.unique(ngrams(text), return_counts=True))
            for lang, found in by.items():
                value, at = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
                total = np.bincount(at, weights=np.concatenate([n for _, n in found]).astype(float), minlength=len(value)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value)), pa.array(value.view(np.int64)), pa.array(total)], ["lang", "gram", "n"])

    known = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    total = known.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= size)
    out: dict[str, list[tuple[int, int]]] = {}
    for r in best.select("lang", "gram", "rank").collect():
        out.setdefault(r.lang, []).append((r.rank, r.gram))
    return {k: np.array([g for _, g in sorted(v)], np.int64).view(np.uint64) for k, v in sorted(out.items())}


class Ranker:
    def __init__(self, known: dict[str, np.ndarray], own: int = OWN):
        self.own, self.names, self.tables = own, list(known), []
        for grams in known.values():
            order = np.argsort(grams)
            self.tables.append((grams[order], order))
        self.most = max([len(g) for g in known.values()], default=1)

    def __call__(self, text: str | None) -> tuple[str, float]:
        grams = top(ngrams(text), self.own) if text else np.empty(0, np.uint64)
        if not len(grams) or not self.names:
            return "und", 0.0
        rank, sums = np.arange(len(grams)), []
        for grams_of, ranks in self.tables:
            at = np.minimum(np.searchsorted(grams_of, grams), len(grams_of) - 1)
            sums.append(int(np.where(grams_of[at] == grams, np.minimum(np.abs(ranks[at] - rank), self.most), self.most).sum()))
        best = int(np.argmin(sums))
        return self.names[best], 1.0 - sums[best] / (self.most * len(grams))


def identify(docs: DataFrame, known: dict[str, np.ndarray], own: int = OWN, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``lang_pred`` and ``score``; columns of those names are replaced."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    keep = [c for c in (docs.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    slim = docs.select(*(F.col(c) for c in keep), F.col(text_col).alias(fresh(docs, "_read")[0]))
    schema = StructType([*slim.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = Ranker(known, own)
        for batch in batches:
            found = [rank(t) for t in batch.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*keep, "lang_pred", "score"])

    return slim.mapInArrow(run, schema)


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
