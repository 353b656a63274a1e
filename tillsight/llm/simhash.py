"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has bit b set if more than half of the text's 3-word shingle hashes have it. Distinct
fingerprints that differ in at most three bits are linked. Fingerprints are cut into m blocks; two that
differ in three bits at most agree on some m - 3 blocks, so they meet in the bucket of those blocks. m grows
with the number of fingerprints so that a bucket of unrelated ones stays small. A bucket with more than
``chunk`` fingerprints is cut into ranges of Gray rank, whose members share many bits. Two ranges whose shared bits
differ in more than three places hold no link and are left out, as a whole group is inside a task; every other
pair of ranges is a task of its own.

Inside a task fingerprints are sorted by Gray rank, so neighbours share long runs of bits. Groups of eight
get a node with the bits that all members share (mask and value), groups of eight nodes another, and so on.
A child stores only bits that its parent does not fix. A search goes down with the differences gathered so
far and leaves a whole group as soon as they exceed three. Matches are not written out as pairs: a task
returns each fingerprint with the least one it is connected to there.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; texts under three
words have one shingle; equal rows share a fingerprint; null ids never name a component that has another
id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import components, materialise, shuffle_partitions

LINK, FAN, CHUNK, BUCKET = 3, 8, 1024, 256
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, unsigned."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    grams = [b" ".join(x) for x in zip(words, words[1:], words[2:])] if len(words) > 2 else [b" ".join(words)]  # noqa: B905
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(g, 42) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in reflected Gray order."""
    r = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Indexes over many buckets at once; ``bucket`` and ``codes`` come sorted by bucket, then Gray rank."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray, fan: int = FAN):
        full = ~np.uint64(0)
        self.codes, n = codes, len(codes)
        owner, mask, value = bucket, np.full(n, full), codes
        self.levels = []  # from the leaves up: mask, value, first child, number of children
        self.levels.append((mask, value, np.arange(n), np.ones(n, np.int64)))
        while True:
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            size = np.diff(np.r_[start, len(owner)])
            if size.max() == 1 and len(self.levels) > 1:
                break
            place = np.arange(len(owner)) - np.repeat(start, size)
            first = np.flatnonzero(place % fan == 0)
            ones = np.bitwise_and.reduceat(mask & value, first)
            zeros = np.bitwise_and.reduceat(mask & ~value, first)
            owner, mask, value = owner[first], ones | zeros, ones
            self.levels.append((mask, value, first, np.diff(np.r_[first, len(place)])))
        # Factor: a child keeps only bits that its parent leaves open.
        self.own = []
        for (m, _, _, _), (pm, _, _, count) in zip(self.levels, self.levels[1:]):  # noqa: B905
            self.own.append(m & ~np.repeat(pm, count))
        self.own.append(self.levels[-1][0])
        self.roots = owner

    def search(self, queries: np.ndarray, root: np.ndarray, most: int = LINK) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, code) in the tree ``root`` of each query at ``most`` differing bits."""
        q, node, seen = np.arange(len(queries)), root, np.zeros(len(queries), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            _, value, first, count = self.levels[level]
            seen = seen + np.bitwise_count((queries[q] ^ value[node]) & self.own[level][node])
            near = seen <= most
            q, node, seen = q[near], node[near], seen[near]
            if level:
                c = count[node]
                ends = np.cumsum(c)
                node = np.repeat(first[node] - (ends - c), c) + np.arange(ends[-1] if len(ends) else 0)
                q, seen = np.repeat(q, c), np.repeat(seen, c)
        return q, node


def local_roots(bucket: np.ndarray, codes: np.ndarray, most: int = LINK, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """``(code, least code it is connected to)`` within buckets, for codes that are not their own least."""
    order = np.lexsort((gray_rank(codes), bucket))
    bucket, codes = bucket[order], codes[order]
    index = GrayIndex(bucket, codes)
    root = np.searchsorted(index.roots, bucket)
    left, right = [], []
    for at in range(0, len(codes), block):
        q, p = index.search(codes[at : at + block], root[at : at + block], most)
        q = q + at
        left.append(q[q < p])
        right.append(p[q < p])
    a, b = np.concatenate(left), np.concatenate(right)
    rank = np.argsort(np.argsort(codes, kind="stable"), kind="stable")
    label = rank.copy()
    while True:  # least labels spread along matches, then along labels
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, label[a])
        sorted_codes = np.argsort(rank)
        label = label[sorted_codes[label]]
        if (label == before).all():
            break
    least = np.sort(codes)[label]
    moved = least != codes
    return codes[moved], least[moved]


def blocks_for(n: int, per_bucket: int = BUCKET) -> list[int]:
    """Masks that keep m - LINK of m blocks, m the least that leaves ``per_bucket`` random codes a bucket."""
    for m in range(LINK + 1, 17):
        edges = [64 * i // m for i in range(m + 1)]
        if n <= per_bucket << (64 * (m - LINK) // m) or m == 16:
            masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
            return [sum(c) for c in combinations(masks, m - LINK)]
    raise AssertionError


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_ranges(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``rows(fp, t, key)`` with ``range``: consecutive Gray ranks of one bucket, ``chunk`` at most."""
    rank = F.col("fp")
    for step in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, step))
    ordered = rows.withColumn("rank", rank.bitwiseXOR(F.lit(-(1 << 63)))).repartitionByRange(shuffle_partitions(rows.sparkSession), "t", "key", "rank").sortWithinPartitions("t", "key", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, place, name = None, 0, np.zeros(1, np.int64)
        for batch in batches:
            t, key, fp = (batch.column(i).to_numpy() for i in (1, 2, 0))
            if not len(t):
                continue
            new = np.r_[last != (t[0], key[0]), (t[1:] != t[:-1]) | (key[1:] != key[:-1])]
            head = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
            at = np.arange(len(t)) - np.maximum(head, 0) + np.where(head < 0, place, 0)
            last, place = (t[-1], key[-1]), int(at[-1]) + 1
            # A range is named by its first code, so parts of a bucket in other partitions have other names.
            first = at % chunk == 0
            lead = np.maximum.accumulate(np.where(first, np.arange(len(t)), -1))
            name = np.where(lead >= 0, fp[np.maximum(lead, 0)], name[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(name)], ["fp", "t", "key", "range"])

    return ordered.select("fp", "t", "key").mapInArrow(run, "fp bigint, t int, key bigint, range bigint")


def links(unique: DataFrame, n: int, chunk: int = CHUNK) -> DataFrame:
    """Edges ``(a, b)`` over distinct ``fp`` whose components are those of the links."""
    masks = blocks_for(n)
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)))
    rows = unique.select("fp", F.explode(keys).alias("k")).select("fp", "k.t", "k.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, ["t", "key"])
    small = rows.where(F.col("n") <= chunk).select("fp", F.xxhash64("t", "key").alias("task"))
    ranges = materialise(gray_ranges(rows.where(F.col("n") > chunk).select("fp", "t", "key"), chunk), "simhash-ranges")
    one = F.bit_or("fp"), F.bit_and("fp")
    roots = ranges.groupBy("t", "key", "range").agg(one[0].alias("some"), one[1].alias("all"))
    left, right = (roots.select("t", "key", *(F.col(c).alias(x + c) for c in ("range", "some", "all"))) for x in ("a_", "b_"))
    # Bits that all members of a range share, set or not, and that the other range's share otherwise.
    apart = (F.col("a_all").bitwiseAND(F.bitwise_not(F.col("b_some")))).bitwiseOR(F.col("b_all").bitwiseAND(F.bitwise_not(F.col("a_some"))))
    near = left.join(right, ["t", "key"]).where((F.col("a_range") <= F.col("b_range")) & (F.bit_count(apart) <= LINK))
    task = F.xxhash64("t", "key", "a_range", "b_range").alias("task")
    met = near.select("t", "key", F.explode(F.array_distinct(F.array("a_range", "b_range"))).alias("range"), task)
    large = ranges.join(met, ["t", "key", "range"]).select("fp", "task")
    dealt = small.unionByName(large).repartition(shuffle_partitions(unique.sparkSession), "task").sortWithinPartitions("task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_t, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def emit(t, f):
            if len(t) > 1:
                a, b = local_roots(t, f.view(np.uint64))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held_t = np.concatenate([held_t, batch.column(1).to_numpy()])
            held_f = np.concatenate([held_f, batch.column(0).to_numpy()])
            if not len(held_t):
                continue
            cut = int(np.searchsorted(held_t, held_t[-1]))  # the last task may go on in the next batch
            yield from emit(held_t[:cut], held_f[:cut])
            held_t, held_f = held_t[cut:], held_f[cut:]
        yield from emit(held_t, held_f)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``: the least id reachable over links."""
    fps = materialise(fingerprints(docs, id_col, text_col), "simhash")
    unique = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-unique")
    n = unique.count()
    roots = components(links(unique, n), "simhash-edges")
    rooted = unique.join(roots, unique.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(of, "fp", "left").select("doc_id", "fp", "component_id")
