"""Packing into fixed sequences: first-fit decreasing over a tournament tree of bin capacities.

Texts become token ids plus an end id; a document longer than a sequence is cut into whole sequences and a
rest. Pieces are dealt into groups of about ``group_size`` by a keyed hash of id, place and ids, so a second run deals
alike; equal pieces are told apart by their rows. Every group is packed alone, so no task sees more than
one group whatever the input. In a group, pieces go longest first into the first
bin with room; the tree's inner nodes hold the largest room below, so that bin is found in log(bins) steps.

Defined cases: a null text counts as empty (one piece, the end id); equal rows are packed one by one; an
empty table gives an empty result; extra columns are ignored; a text of any length is cut, never shortened.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import fresh, materialise

SEQUENCE, END_ID, GROUP = 4096, 2, 2048
_CACHE = 500_000
_ENCODERS: dict[str, WordEncoder] = {}
#: Fixed values of the tokenizer's own word split.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: The same split for texts of plain white space and code points from ! to U+0239, where it is a simple class.
_LATIN = "a-zA-ZªµºÀ-ÖØ-öø-ȹ"
_FAST = rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9²³¹¼½¾]|[^\s{_LATIN}0-9²³¹¼½¾]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def unassigned() -> str:
    """A character class's ranges of all code points without a category."""
    out, start = [], None
    for c in range(0x110001):
        none = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if none and start is None:
            start = c
        elif not none and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class WordEncoder:
    """Ids of whole texts as little-endian 32-bit bytes; equal to the tokenizer's own, one word looked up once.

    Words never merge with each other in this kind of vocabulary, so ids of a text are its words' ids in
    order. Texts that may hold a special token's name go to the tokenizer whole, and so do texts with code points
    that Python's Unicode tables don't know, since the tokenizer's and the split's may class them differently.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.norm = self.tok.normalizer.normalize_str
        self.words = regex.compile(_SPLIT).findall
        self.known: dict[str, bytes] = {}
        self.model = self.tok.model
        # A byte's letter: printable ones are themselves, the others follow from U+0100 on.
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.letters = {b: 256 + k for k, b in enumerate(odd)}
        self.fast_words = re.compile(_FAST).findall
        self.unknown = re.compile(f"[{unassigned()}]").search
        self.odd = re.compile("[^\\t\\n\\r\x20-\x7e\xa1-\u012f\u0131-\u0239]").search

    @staticmethod
    def raw(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _split(self, text: str) -> list[str] | None:
        """The text's words, or None where the tokenizer is to read it whole."""
        if "<|" in text:
            return None
        low = text.lower()  # small letters of some plain capitals lie beyond the simple class
        if not self.odd(text) and not self.odd(low) and unicodedata.is_normalized("NFC", text):
            return self.fast_words(low)
        return None if self.unknown(text) else self.words(self.norm(text))

    def many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; words that are new in any of them are looked up together."""
        lists = [self._split(t) for t in texts]
        if len(self.known) > _CACHE:
            self.known.clear()
        parts = [None if x is None else list(map(self.known.get, x)) for x in lists]
        new = {w for x, p in zip(lists, parts, strict=True) if p and None in p for w, b in zip(x, p, strict=True) if b is None}
        if new:
            self._learn(new)
        get, out = self.known.get, []
        for t, x, p in zip(texts, lists, parts, strict=True):
            if x is None:
                out.append(self.raw(self.tok.encode(t, add_special_tokens=False).ids))
            else:
                out.append(b"".join(map(get, x) if p and None in p else p))
        return out

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def _learn(self, new: set[str]) -> None:
        """Asks the vocabulary's own merge model for each new word, spelt in its byte letters."""
        tokenize, letters = self.model.tokenize, self.letters
        for w in new:
            self.known[w] = self.raw([t.id for t in tokenize(w.encode().decode("latin-1").translate(letters))])


def encoder(path: str) -> WordEncoder:
    """The one encoder of this worker process; its cache of words lives on from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenise(docs: DataFrame, tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens[, ids])`` of at most ``sequence`` ids."""
    path, end = tokenizer or default_tokenizer(), end_id.to_bytes(4, "little")
    ids_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {ids_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(path)
        for batch in batches:
            key, place, start, length, crc, total, ids = batch.column(0), [], [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, raw in enumerate(x + end for at in range(0, len(texts), 128) for x in encode.many(texts[at : at + 128])):
                for at in range(0, len(raw), 4 * sequence):
                    part = raw[at : at + 4 * sequence]
                    place.append(i), start.append(at // 4), length.append(len(part) // 4), crc.append(zlib.crc32(part)), total.append(len(raw) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            cols = [key.take(pa.array(place, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each length, which come longest first."""
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    room = [capacity] * (2 * size)  # room[1] is the root; bin i is leaf size + i
    placed = []
    for n in lengths:
        if n > capacity:
            raise ValueError("a piece is longer than a sequence")
        node = 1
        while node < size:
            node *= 2
            if room[node] < n:
                node += 1
        placed.append((node - size, capacity - room[node]))
        room[node] -= n
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return placed


def pack(pieces: DataFrame, sequence: int = SEQUENCE, group_size: int = GROUP, seed: int = 11) -> DataFrame:
    """``pieces`` (with a bigint ``length``) with ``sequence_id`` and ``offset``; works on any other columns too."""
    row, group, key, same = fresh(pieces, "_row", "_group", "_key", "_same")
    kept = materialise(pieces.withColumn(row, F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-kept.count() // group_size))
    content = [F.col(c) for c in ("doc_id", "start", "ids_crc32", "length") if c in pieces.columns] or [F.col(row)]
    slim = kept.select(row, "length", F.xxhash64(F.lit(seed), *content).alias(key))
    often = slim.groupBy(key).agg(F.count("*").alias(same)).where(F.col(same) > 1)
    slim = slim.join(often, key, "left").select(row, "length", key, F.pmod(F.when(F.col(same).isNull(), F.col(key)).otherwise(F.xxhash64(key, row)), F.lit(groups)).alias(group))

    def one(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", key, row], ascending=[False, True, True])
        placed = first_fit_decreasing(pieces["length"].tolist(), sequence)
        first = int(pieces[group].iloc[0]) << 32
        return pd.DataFrame({row: pieces[row], "sequence_id": [first + b for b, _ in placed], "offset": [o for _, o in placed]})

    where = slim.groupBy(group).applyInPandas(one, f"{row} bigint, sequence_id bigint, offset bigint")
    return kept.join(where, row).drop(row)
