"""Sharding by a keyed Feistel permutation over global row numbers.

Row numbers follow ``(doc_id, CRC, size)``. A Feistel network over ``Z_a x Z_b`` with ``a * b >= n`` permutes
them, walking cycles until the value falls below ``n``; then ``shard = value mod shards`` and
``slot = value div shards``. So the place of a row is computable from its number and the key alone, counts
of shards differ by one at most and slots have no gap. Nothing but DataFrame functions runs.

Defined cases: a null text has size 1 and CRC 0 like an empty one; null ids come first; equal rows are
interchangeable, so which copy gets which of their places is open but the set of result rows is not; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import let, materialise, shuffle_partitions

ROUNDS = 4
_M32 = (1 << 32) - 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{j}".encode()).digest()[:4], "big") for j in range(rounds)]


def sides(n: int) -> tuple[int, int]:
    """The least square-like domain ``a * b >= n``."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, max(1, -(-n // a))


def _mix(v: Column, key: int) -> Column:
    """A 32-bit mixing of ``v`` below 2^31; no product leaves 63 bits."""
    first = (v * F.lit(2654435761) + F.lit(key)).bitwiseAND(F.lit(_M32))
    fold = lambda t: t.bitwiseXOR(F.shiftright(t, 15))
    again = lambda t: (fold(t) * F.lit(746583917)).bitwiseAND(F.lit(_M32))
    return let(let(first, again), lambda t: t.bitwiseXOR(F.shiftright(t, 12)))


def _round(key: int, mod: int):
    return lambda s: F.struct(s["d"].alias("c"), ((s["c"] + _mix(s["d"], key)) % F.lit(mod)).alias("d"))


def permute(x: Column, n: int, seed: int) -> Column:
    """The image of ``x`` in ``[0, n)`` under the permutation of ``[0, n)`` that ``seed`` names."""
    a, b = sides(n)

    def once(v: Column) -> Column:
        state = F.struct((v % F.lit(a)).alias("c"), F.floor(v / F.lit(a)).cast("bigint").alias("d"))
        for j, key in enumerate(round_keys(seed)):
            state = let(state, _round(key, a if j % 2 == 0 else b))
        return let(state, lambda s: s["d"] * F.lit(a) + s["c"])

    # A walk only visits the a*b - n values outside, each once; the share outside is at most 2/sqrt(n).
    steps = min(max(a * b - n, 1), 64)
    walk = lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), v, lambda acc, _: F.when(acc < n, acc).otherwise(once(acc)))
    done = lambda v: F.when(v < n, v).otherwise(let(walk(v), lambda w: F.when(w < n, w).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))))
    return let(once(x), done)


def number_rows(docs: DataFrame, order: list[str]) -> DataFrame:
    """``docs`` with ``row_number`` from 0, global and gapless, in the order of ``order``.

    A range exchange (salted, so that equal rows spread over tasks) and a sort inside partitions fix the
    order; the partition's place and the place within it are stored, and the offsets, one row a
    partition, are added afterwards. No task sees all rows.
    """
    spark = docs.sparkSession
    salted = docs.withColumn("_salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(shuffle_partitions(spark), *order, "_salt").sortWithinPartitions(*order, "_salt")
    kept = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()).drop("_salt"), "rows")
    kept = kept.withColumn("_part", F.shiftrightunsigned("_at", 33)).withColumn("_in", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    # One row a partition: bounded by the number of partitions, whatever the input.
    offsets = kept.groupBy("_part").count().selectExpr("_part", "coalesce(sum(count) over (order by _part rows between unbounded preceding and 1 preceding), 0) as _offset")
    return kept.join(F.broadcast(offsets), "_part").withColumn("row_number", F.col("_offset") + F.col("_in")).drop("_part", "_in", "_at", "_offset")


def shard(docs: DataFrame, shards: int = 16, seed: int = 20240601, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, row_number, shard and slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    numbered = number_rows(slim, ["doc_id", "text_crc32", "size"])
    n = numbered.count()
    placed = numbered.withColumn("place", permute(F.col("row_number"), n, seed) if n else F.col("row_number"))
    return placed.select("doc_id", "size", "text_crc32", "row_number", (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("bigint").alias("slot"))


def oracle(shards: int = 16, seed: int = 20240601) -> str:
    """DuckDB SQL for the query's rows over ``documents``."""
    def mix(v: str, key: int) -> str:
        t = f"(({v}::BIGINT * 2654435761 + {key}) & {_M32})"
        t = f"((xor({t}, ({t} >> 15)) * 746583917) & {_M32})"
        return f"xor({t}, ({t} >> 12))"

    body, c, d = [], "c0", "d0"
    for j, key in enumerate(round_keys(seed)):
        body.append(f"r{j} AS (SELECT *, d{j} AS c{j + 1}, (c{j} + {mix(f'd{j}', key)}) % {'a' if j % 2 == 0 else 'b'} AS d{j + 1} FROM {'start' if j == 0 else f'r{j - 1}'})")
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, encode(coalesce(text, '')) AS u FROM documents),
bytes AS (SELECT doc_id, octet_length(u) + 1 AS size, hex(u) AS h FROM t),
tab AS (SELECT list(v ORDER BY i) AS v FROM (SELECT i, list_reduce(range(0, 8), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(3988292384, s >> 1) ELSE s >> 1 END, i) AS v FROM range(0, 256) r(i))),
crc AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(range(0, size - 1), lambda s, k: xor(tab.v[1 + xor(s & 255, ('0x' || h[2 * k + 1:2 * k + 2])::BIGINT)], s >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM bytes, tab),
num AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x, count(*) OVER () AS n FROM crc),
dom AS (SELECT n, a, CAST(ceil(n / a::DOUBLE) AS BIGINT) AS b FROM (SELECT n, CAST(ceil(sqrt(n::DOUBLE)) AS BIGINT) AS a FROM (SELECT count(*) AS n FROM documents))),
start AS (SELECT a, b, n, i AS x, i % a AS c0, i // a AS d0 FROM dom, unnest(range(0, a * b)) AS q(i)),
{', '.join(body)},
perm AS (SELECT x, d{ROUNDS} * a + c{ROUNDS} AS y, n FROM r{ROUNDS - 1}),
walk AS (SELECT x, y, n FROM perm WHERE x < n UNION ALL SELECT w.x, p.y, w.n FROM walk w JOIN perm p ON p.x = w.y WHERE w.y >= w.n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(y % {shards} AS INTEGER) AS shard, CAST(y // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM num JOIN walk ON num.x = walk.x AND walk.y < walk.n"""
