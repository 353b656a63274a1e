"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Vectors are dealt by a hash of their id into shards of about ``shard_size``; the number of shards follows the number
of vectors, so a task's memory does not. A shard's graph has levels: each node reaches a level
drawn from its id's hash, is linked on each to diverse near ones among the nodes put in before it, and they are linked
back, with at most ``m`` links above and ``2 m`` on the ground. Near ones are found by searching the graph built so
far with a beam of ``EF_BUILD``. The graph is stored as flat arrays (neighbours level by level, padded with -1; nodes tallest first) beside the
vectors, in a table. A query goes down greedily and searches the ground with a beam of ``ef``; queries are
taken in blocks, which pass by each shard's graph, and all of a block's beams advance together. The shards' bests are merged by distance and id.

Equal vectors of a shard are one node that carries all their ids, so that copies neither crowd out links nor
get lost.

Defined cases: vectors that are null, all zero, of another length than most, or hold null or non-finite components take no part, as
query or candidate; equal rows (same id and vector) are one vector; one id with two vectors is two candidates;
a query's own id is never among its answers; ties go to the smaller id; fewer candidates than k are all
returned; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import materialise, shuffle_partitions

K, M, EF, EF_BUILD, SHARD, BLOCK = 10, 12, 96, 64, 4096, 512


def usable(vector: Column) -> Column:
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, ok) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def _diverse(dist: np.ndarray, between: np.ndarray, most: int) -> np.ndarray:
    """Of candidates that come nearest first: those nearer to the node than to any chosen one; then the nearest others."""
    chosen, nearest = np.zeros(len(dist), bool), np.full(len(dist), np.inf)
    for i in range(len(dist)):
        if dist[i] < nearest[i]:
            chosen[i] = True
            most -= 1
            if not most:
                break
            np.minimum(nearest, between[i], out=nearest)
    if most:
        chosen[np.flatnonzero(~chosen)[:most]] = True
    return np.flatnonzero(chosen)


class Graph:
    """Flat arrays: ``levels[l]`` has a row of neighbours (padded with -1) for each of the first nodes, which reach level l."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray]):
        self.x, self.levels, self.norm = x, levels, (x * x).sum(1)

    @classmethod
    def build(cls, x: np.ndarray, height: np.ndarray, m: int = M, ef: int = EF_BUILD, block: int = 64) -> Graph:
        """Inserts nodes, which come tallest first, by searching what has been built so far.

        A block of nodes searches at once; those of one block also meet each other, as if put in one by one.
        """
        n = len(x)
        g = cls(x, [np.full((int((height >= level).sum()), 2 * m if level == 0 else m), -1, np.int32) for level in range(int(height[0]) + 1)])
        done = 1
        while done < n:
            new = np.arange(done, min(n, done + min(block, done)))
            at, found = np.zeros(len(new), np.int64), []
            inside = _squares(x[new], x[new])
            for level in range(len(g.levels) - 1, -1, -1):
                linked = height[new] >= level
                low = np.flatnonzero(~linked)
                if len(low):
                    at[low] = g._descend(level, x[new[low]], at[low])
                high = np.flatnonzero(linked)
                if len(high):
                    near = g._beam(level, x[new[high]], at[high], ef)
                    at[high] = near[:, 0]
                    found += [(level, int(k), near[r]) for r, k in enumerate(high)]
            for level, k, near in found:
                near = near[near >= 0]
                mates = np.flatnonzero(height[new[:k]] >= level)
                ids = np.r_[near, new[mates]]
                dist = np.r_[((x[near] - x[new[k]]) ** 2).sum(1), inside[k, mates]]
                order = np.argsort(dist, kind="stable")[:ef]
                mine = ids[order][_diverse(dist[order], _squares(x[ids[order]], x[ids[order]]), m)]
                g.levels[level][new[k], : len(mine)] = mine
                for j in mine.tolist():
                    g._link_back(level, j, int(new[k]))
            done += len(new)
        return g

    def _link_back(self, level: int, j: int, i: int) -> None:
        row = self.levels[level][j]
        free = np.flatnonzero(row < 0)
        if len(free):
            row[free[0]] = i
            return
        ids = np.r_[row, i]
        dist = ((self.x[ids] - self.x[j]) ** 2).sum(1)
        order = np.argsort(dist, kind="stable")
        ids = ids[order]
        row[:] = ids[_diverse(dist[order], _squares(self.x[ids], self.x[ids]), len(row))]

    def _dist(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own row of nodes; infinite for -1."""
        d = self.norm[ids] - 2 * np.einsum("qd,qnd->qn", q, self.x[ids]) + (q * q).sum(1)[:, None]
        return np.where(ids < 0, np.inf, d)

    def _descend(self, level: int, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each query's node after going greedily to nearer neighbours of one level."""
        at, moving = at.copy(), np.arange(len(q))
        while len(moving):
            ids = np.c_[at[moving], self.levels[level][at[moving]]]
            best = ids[np.arange(len(moving)), self._dist(q[moving], ids).argmin(1)]
            moved = best != at[moving]
            at[moving] = best
            moving = moving[moved]
        return at

    def _beam(self, level: int, q: np.ndarray, at: np.ndarray, ef: int) -> np.ndarray:
        """Up to ``ef`` near nodes of each query on one level (-1 where fewer), nearest first."""
        n, links = len(q), self.levels[level]
        seen = np.zeros((n, len(links) + 1), bool)  # the last column takes -1
        seen[np.arange(n), at] = True
        ids, open_ = at[:, None], np.ones((n, 1), bool)
        dist = self._dist(q, ids)
        live = np.arange(n)
        out = np.full((n, ef), -1, np.int64)
        while len(live):
            pick = np.where(open_, dist, np.inf).argmin(1)
            rows = np.arange(len(live))
            open_[rows, pick] = False
            fresh_ = links[ids[rows, pick]]
            fresh_ = np.where(seen[live[:, None], fresh_], -1, fresh_)
            seen[live[:, None], fresh_] = True
            seen[:, -1] = False
            ids, dist = np.c_[ids, fresh_], np.c_[dist, self._dist(q[live], fresh_)]
            open_ = np.c_[open_, fresh_ >= 0]
            order = np.argsort(dist, axis=1, kind="stable")[:, :ef]
            ids, dist, open_ = (np.take_along_axis(z, order, 1) for z in (ids, dist, open_))
            done = ~(open_ & np.isfinite(dist)).any(1)
            if done.any():
                w = ids.shape[1]
                out[live[done], :w] = np.where(np.isfinite(dist[done]), ids[done], -1)
                live, ids, dist, open_ = live[~done], ids[~done], dist[~done], open_[~done]
        return out

    def search(self, q: np.ndarray, ef: int = EF) -> np.ndarray:
        """Up to ``ef`` near nodes of each query (-1 where fewer), nearest first."""
        at = np.zeros(len(q), np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            at = self._descend(level, q, at)
        return self._beam(0, q, at, ef)


def _heights(ids: np.ndarray, m: int = M) -> np.ndarray:
    """Levels drawn from the ids, each with 1/m of the one below."""
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    u = ((z ^ (z >> np.uint64(29))) >> np.uint64(11)).astype(float) / 2.0**53
    return np.floor(-np.log(np.maximum(u, 1e-12)) / np.log(m)).astype(int)


def index(vectors: DataFrame, shard_size: int = SHARD, m: int = M) -> tuple[DataFrame, int]:
    """The table of graphs, one row a shard, from ``vectors(vec_id, embedding)``; and the number of shards."""
    n = vectors.count()
    shards = max(1, -(-n // shard_size))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id", kind="stable")
        all_x = np.array(group["embedding"].tolist(), float)
        x, node = np.unique(all_x, axis=0, return_inverse=True)
        node = node.ravel()
        first = np.full(len(x), len(all_x))
        np.minimum.at(first, node, np.arange(len(all_x)))
        height = _heights(group["vec_id"].to_numpy()[first], m)
        order = np.lexsort((first, -height))  # tallest first, then by their least id
        x, node = x[order], np.argsort(order)[node]
        g = Graph.build(x, height[order], m)
        return pd.DataFrame({
            "shard": [int(group["shard"].iloc[0])], "ids": [group["vec_id"].to_numpy()], "node": [node.astype(np.int32)], "x": [x.ravel()], "dim": [x.shape[1]],
            "sizes": [np.array([len(a) for a in g.levels], np.int32)], "links": [np.concatenate([a.ravel() for a in g.levels])], "m": [m],
        })

    return materialise(dealt.groupBy("shard").applyInPandas(one, _SCHEMA), "hnsw"), shards


_SCHEMA = "shard int, ids array<bigint>, node array<int>, x array<double>, dim int, sizes array<int>, links array<int>, m int"


def load(row: dict) -> tuple[Graph, np.ndarray, np.ndarray]:
    """A shard's graph, its ids and their nodes from its flat arrays."""
    x = np.asarray(row["x"], float).reshape(-1, row["dim"])
    levels, at = [], 0
    for level, n in enumerate(row["sizes"]):
        wide = 2 * row["m"] if level == 0 else row["m"]
        levels.append(np.asarray(row["links"][at : at + n * wide]).reshape(n, wide))
        at += n * wide
    return Graph(x, levels), np.asarray(row["ids"]), np.asarray(row["node"])


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def search(graphs: DataFrame, shards: int, queries: DataFrame, k: int = K, ef: int = EF, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found of each of ``queries(query_id, embedding)``.

    Every block of queries meets every shard once: the stated queries against all rows, in blocks. A shard's
    graph is sent to one task, ahead of the blocks, which pass by it one after another.
    """
    spark = graphs.sparkSession
    blocks = max(1, -(-queries.count() // block))
    asked = queries.withColumn("_block", F.pmod(F.xxhash64("query_id", F.lit(3)), F.lit(blocks)))
    packed = asked.groupBy("_block").agg(F.collect_list(F.struct("query_id", "embedding")).alias("queries"))
    passing = packed.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "queries")
    ahead = graphs.withColumn("queries", F.lit(None).cast(packed.schema["queries"].dataType))
    each = ahead.unionByName(passing, allowMissingColumns=True).repartition(max(shards, shuffle_partitions(spark)), "shard").sortWithinPartitions("shard", F.col("queries").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ()
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r] for i, n in enumerate(batch.schema.names)}
                if not row["queries"].is_valid:
                    graph, ids, node = load({n: row[n].as_py() if n in ("dim", "m") else row[n].values.to_numpy(zero_copy_only=False) for n in ("ids", "node", "x", "dim", "sizes", "links", "m")})
                    by_node = np.argsort(node, kind="stable")
                    held = graph, ids, by_node, np.searchsorted(node[by_node], np.arange(len(graph.x) + 1)), row["shard"].as_py()
                    continue
                if not held or held[4] != row["shard"].as_py():  # a shard that no vector was dealt to
                    continue
                graph, ids, by_node, start, _ = held
                asked = row["queries"].values
                qid = asked.field("query_id").to_numpy()
                q = np.array(asked.field("embedding").to_pylist(), float)
                out: list[tuple] = []
                for i, near in enumerate(graph.search(q, max(ef, k))):
                    near = near[near >= 0]
                    d = _exact(q[i], graph.x[near])
                    found = []
                    for j in np.lexsort((near, d)):
                        if len(found) >= k + 1 and d[j] > found[-1][0]:
                            break
                        mine = ids[by_node[start[near[j]] : start[near[j] + 1]]][: k + 1]
                        found += [(d[j], int(v)) for v in mine]
                    found = sorted(f for f in found if f[1] != qid[i])[:k]
                    out += [(int(qid[i]), v, s) for s, v in found]
                if out:
                    a, b, c = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["query_id", "vec_id", "score"])

    found = each.mapInArrow(run, "query_id bigint, vec_id bigint, score double").repartition(shuffle_partitions(spark), "query_id")
    from pyspark.sql import Window

    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of each vector whose id is divisible by ``every``."""
    slim = vectors.select(F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda x: x.cast("double")).alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).distinct()
    common = slim.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    slim = slim.where(F.size("embedding") == (common.n if common else 0))
    graphs, shards = index(slim)
    return search(graphs, shards, slim.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding"), k)
