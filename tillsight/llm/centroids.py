"""Centroid clustering: exact Lloyd rounds by ball k-means.

Vectors become integers ``floor(256 * x)``. Centroids start as the vectors of the smallest hashes of their ids. In each round a
cluster is a ball: its centroid and the largest distance of a member. Another centroid can win or tie for a member at squared
distance ``d`` from its own only if the squared gap of the two centroids is at most ``4 d`` (triangle inequality), so the ball's
radius names its neighbour centroids, members nearer than half the way to the first neighbour are its stable core, and the
others lie in annuli between one neighbour and the next: a member is compared with the neighbours up to its annulus, exactly and in
integers. A ball whose centroid and neighbours have not moved keeps its members. Balls are formed by each batch of rows: a part
of a cluster has its own radius, at most the whole one's, so no pass for radii and no gathering of a cluster is needed.

Each round writes (row, integers, cluster, distance) to the shared folder; partial sums are taken a partition at a time, and
``k * dims`` sums reach the driver, which broadcasts as many integers: both bounded by the parameters, whatever the input.

Defined cases: a vector that is null, has another number of components, or a null, non-finite or huge one (256 x beyond 2^62)
takes no part; components up to 2^27 run in 64-bit integers, larger ones in unbounded ones, and a distance or an inertia beyond a
long is null; ties go to the smaller centroid; of equal ids the lexicographically smaller vector starts first, and a null id hashes like
the id ``null``; fewer vectors than ``k`` give as many centroids; an empty table gives an empty result; extra columns can be carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import materialise

K, ROUNDS, DIMS, SCALE, SEED = 40, 5, 64, 256, 2
#: Up to here the squares of 64 differences sum to less than 2^63.
NARROW = 1 << 27
HUGE = 1 << 62
_LONG = (1 << 63) - 1


def _squares(x: np.ndarray, center: np.ndarray) -> np.ndarray:
    d = x - center
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and squared distance of each row, all centroids compared; the smaller number wins a tie."""
    best, own = _squares(x, centers[0]), np.zeros(len(x), np.int32)
    for j in range(1, len(centers)):
        d = _squares(x, centers[j])
        won = np.asarray(d < best, bool)
        best[won], own[won] = d[won], j
    return own, best


def reassign(x: np.ndarray, own: np.ndarray, centers: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """As ``nearest``, from the clusters of the round before; also how many distances to other centroids that took."""
    out, best, compared = own.copy(), np.empty(len(x), x.dtype), 0
    for i in np.unique(own):
        rows = np.flatnonzero(own == i)
        members = x[rows]
        d = _squares(members, centers[i])
        best[rows] = d
        reach, gaps = 4 * d, _squares(centers, centers[i])
        neighbours = sorted((g, j) for j, g in enumerate(gaps.tolist()) if j != i and g <= reach.max())
        if not moved[i] and not any(moved[j] for _, j in neighbours):
            continue
        found, least = np.full(len(rows), i, np.int32), d.copy()
        for gap, j in neighbours:
            outer = np.flatnonzero(np.asarray(reach >= gap, bool))  # in this annulus or further out; the core is in none
            e = _squares(members[outer], centers[j])
            compared += len(outer)
            won = np.asarray((e < least[outer]) | ((e == least[outer]) & (j < found[outer])), bool)
            found[outer[won]], least[outer[won]] = j, e[won]
        out[rows], best[rows] = found, least
    return out, best, compared


def _matrix(column: pa.ListArray, centers: list[list[int]], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and centroids as integers that cannot overflow."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    widest = max(int(np.abs(x).max(initial=0)), max((abs(v) for c in centers for v in c), default=0))
    kind = np.int64 if widest <= NARROW and dims <= DIMS else object
    return x.astype(kind), np.array(centers, dtype=kind).reshape(-1, dims)


def _assigned(centers: list[list[int]], before: list[list[int]] | None, dims: int):
    def run(batches):
        moved = np.array([before is None or c != b for c, b in zip(centers, before or centers, strict=True)], bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, c = _matrix(batch.column("x"), centers, dims)
            if before is None:
                own, d = nearest(x, c)
            else:
                own, d, _ = reassign(x, batch.column("cluster").to_numpy(), c, moved)
            far = pa.array([v if v <= _LONG else None for v in d.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("x"), pa.array(own, pa.int32()), far], ["row", "x", "cluster", "distance"])

    return run


def _sums(k: int, dims: int):
    def run(batches):
        total, n = [[0] * dims for _ in range(k)], [0] * k
        for batch in batches:
            x, _ = _matrix(batch.column("x"), [], dims)
            own = batch.column("cluster").to_numpy()
            for i in np.unique(own):
                part = x[own == i]
                n[i] += len(part)
                total[i] = [a + b for a, b in zip(total[i], part.sum(axis=0).tolist(), strict=True)]
        seen = [i for i in range(k) if n[i]]
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array([i for i in seen for _ in range(dims)], pa.int32()), "dim": pa.array([j for _ in seen for j in range(dims)], pa.int32()),
            "sum": pa.array([str(v) for i in seen for v in total[i]], pa.string()), "n": pa.array([n[i] for i in seen for _ in range(dims)], pa.int64()),
        })

    return run


def integers(vectors: DataFrame, carry: list[str], dims: int = DIMS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(row, h, x)`` of the vectors that take part: carried columns, hash of the id, integers."""
    v = F.col(vec_col)
    fit = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float(HUGE // scale)), F.lit(False))  # noqa: E731  false for nan, too
    there = vectors.where((F.size(v) == dims) & F.forall(v, lambda x: fit(x) & ~F.isnan(x)))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    return there.select(F.struct(*(F.col(c) for c in carry)).alias("row"), h.alias("h"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")).alias("x"))


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, carry: list[str] | None = None, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Carried columns (default: the id), cluster, distance, cluster_inertia, inertia, centroid_sha256 and the centroid's integers."""
    spark, carry = vectors.sparkSession, [id_col] if carry is None else carry
    kept = materialise(integers(vectors, carry, dims, scale, seed, id_col, vec_col), "integers")
    centers, before = [list(r.x) for r in kept.orderBy("h", "x").limit(k).select("x").collect()], None  # k rows
    state = kept.select("row", "x", F.lit(0).alias("cluster"))
    schema = f"row {kept.schema['row'].dataType.simpleString()}, x array<bigint>, cluster int, distance bigint"
    schema = kept.select("row", "x", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).schema if any(" " in c or "`" in c for c in carry) else schema
    for _ in range(rounds + 1 if centers else 0):
        state = materialise(state.mapInArrow(_assigned(centers, before, dims), schema), "balls")
        before = centers
        if _ == rounds:
            break
        parts = state.select("x", "cluster").mapInArrow(_sums(len(centers), dims), "cluster int, dim int, sum string, n bigint")
        means = {i: [0] * dims for i in range(len(centers))}
        counted = set()
        for r in parts.groupBy("cluster", "dim").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect():  # k * dims rows
            means[r.cluster][r.dim] = int(r.s) // r.n
            counted.add(r.cluster)
        centers = [means[i] if i in counted else c for i, c in enumerate(centers)]
    if not centers:
        state = state.withColumn("distance", F.lit(None).cast("bigint"))
    whole = lambda some: F.when(F.count("*") == F.count(some), F.sum(F.col(some).cast("decimal(38,0)")))
    sums = {r.cluster: r.s for r in state.groupBy("cluster").agg(whole("distance").alias("s")).collect()}  # k rows
    long = lambda v: None if v is None or v > _LONG else int(v)
    total = None if None in sums.values() else long(sum(sums.values()))
    said = [(i, long(sums.get(i, 0)), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest(), c) for i, c in enumerate(centers)]
    balls = spark.createDataFrame(said, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    return state.join(F.broadcast(balls), "cluster").select(*(F.col("row")[c].alias(c) for c in carry), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid")  # k rows are broadcast


def oracle(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED) -> str:
    """DuckDB SQL for the query's rows over ``embeddings``, all centroids compared."""
    body = []
    for t in range(rounds + 1):
        body.append(f"""a{t} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': d, 'k': k}}) AS m FROM (
  SELECT rid, vec_id, v.x, c.k, list_sum(list_transform(range(1, {dims + 1}), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j])))::BIGINT AS d FROM v, c{t} c) GROUP BY rid)""")
        if t < rounds:
            body.append(f"""s{t} AS (SELECT k, j, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(x) AS y, unnest(range({dims})) AS j FROM a{t}) GROUP BY k, j),
m{t} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM s{t} GROUP BY k),
c{t + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN m{t} m ON c.k = m.k)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('{seed}:' || coalesce(vec_id::VARCHAR, 'null')) AS h, x FROM v ORDER BY h, x LIMIT {k})),
{', '.join(body)},
i AS (SELECT m.k AS k, sum(m.d)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY m.k)
SELECT a.vec_id, a.m.k::INTEGER AS cluster, a.m.d AS distance, i.cluster_inertia, (SELECT sum(cluster_inertia)::BIGINT FROM i) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN i ON i.k = a.m.k JOIN c{rounds} c ON c.k = a.m.k"""
