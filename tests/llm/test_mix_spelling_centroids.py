"""Weighted mixes, spelling variants and centroid clusters against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.llm import centroids, common, mixing, spelling

DOCS = "doc_id bigint, text string, source string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(n))


# --- 11 mixing


def crowd():
    r, rows = random.Random(3), []
    for s, n in (("a", 40), ("b", 7), ("c", 90), ("d", 1), (None, 12), ("", 3), ("e", 2)):
        rows += [(len(rows) + i, words(r.choice([0, 1, 5, 60, 300]), 7 * len(rows) + i) + ("!!! 99" if i % 5 == 0 else ""), s) for i in range(n)]
    rows += [(7, None, "a"), (None, "one two three", "b"), (None, None, None), *([(1000, "same row here", "c")] * 4)]
    return rows


def plain_targets(sizes):
    """Targets by the rule as told: share by weight, cap, share the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and Fraction(weight[s] * rest, max(w, 1)) > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * rest / max(w, 1) for s in order}
        capped |= over


def test_mix_is_what_the_rule_says(spark):
    rows = crowd()
    got = mixing.mix(spark.createDataFrame(rows, DOCS), carry=["doc_id", "source", "text"]).collect()
    assert sorted((str(r.doc_id), str(r.text), str(r.source)) for r in got) == sorted((str(a), str(b), str(c)) for a, b, c in rows)
    sizes = Counter()
    for r in got:
        assert r.size == len((r.text or "").split())
        sizes[r.source] += r.size
    want = plain_targets(sizes)
    key = lambda r: -math.log((int(hashlib.md5(f"{mixing.SEED}:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / max(((sum(c not in "".join(map(chr, [*range(33, 65), *range(91, 97), *range(123, 127)])) for c in "".join((r.text or "").split()))) / max(1, len("".join((r.text or "").split())))) ** 2, mixing.LEAST_QUALITY)
    for s in sizes:
        own = sorted((r for r in got if r.source == s), key=lambda r: (key(r), "" if r.doc_id is None else str(r.doc_id), r.size))
        budget, before = math.floor(want[s]), 0
        assert {r.target for r in own} == {want[s]} and {r.source_size for r in own} == {sizes[s]} and sum(r.taken for r in own) == budget
        assert all(r.taken <= 3 * r.size for r in own)
        full = budget // max(sizes[s], 1)
        expected = Counter()
        for r in own:
            expected[r.doc_id, r.size, full * r.size + max(0, min(r.size, budget - full * sizes[s] - before))] += 1
            before += r.size
        assert Counter((r.doc_id, r.size, r.taken) for r in own) == expected
    assert any(0 < r.taken % max(r.size, 1) for r in got)


def test_the_mix_itself_has_the_words_that_are_taken(spark):
    mixed = mixing.mix(spark.createDataFrame(crowd(), DOCS)).withColumn("epoch", F.lit("own"))
    rows = mixing.mixed_texts(mixed).collect()
    n = Counter()
    for r in rows:
        n[r.doc_id, r.source, r.size, r.taken] += len(r.text.split())
        assert r.epoch == "own" and r["_epoch"] >= 1
    assert sum(n.values()) == sum(r.taken for r in mixed.collect())


def test_mix_edges(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None), (2, "  ", "x")], DOCS)).collect()
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    (r,) = mixing.mix(spark.createDataFrame([(1, "x " * 30_000, "s")], DOCS)).collect()
    assert (r.size, r.target, r.taken) == (30_000, 30_000.0, 30_000)
    d = spark.createDataFrame(crowd(), DOCS)
    base = sorted(map(str, mixing.mix(d, carry=["doc_id"]).collect()))
    more = d.select("*", *(F.lit("x").alias(c) for c in ("_row", "_none", "_s", "_key", "_id", "_at", "_part", "_before", "_offset", "_salt", "size", "target", "taken", "row_number")))
    got = mixing.mix(more)
    assert all(r["_s"] == r["_row"] == r["row_number"] == "x" for r in got.collect()) and sorted(map(str, got.select("doc_id", *mixing.ADDED).collect())) == base
    heavy = mixing.mix(d, carry=["doc_id"], weight=F.when(F.col("doc_id") % 2 == 0, 1e6).otherwise(None)).where("size > 0 AND source_size = 0")
    assert heavy.count() == 0


# --- 12 spelling


def plain_near(vocab):
    edits = {}
    for w in vocab:
        for k in range(len(w)):
            edits.setdefault((len(w), k, w[:k] + w[k + 1 :]), set()).add(w)
    out = {(a, b) for group in edits.values() for a in group for b in group if a != b}
    for w in vocab:
        for k in range(len(w)):
            if (x := w[:k] + w[k + 1 :]) in vocab:
                out |= {(w, x), (x, w)}
    return out


@pytest.mark.parametrize("hot,q", [(2_000, 3), (6, 3), (1, 3), (3, 2), (2, 4)])
def test_all_pairs_one_edit_apart_are_found(spark, hot, q):
    r = random.Random(hot)
    base = ["".join(r.choices("abcé", k=r.randint(5, 9))) for _ in range(60)] + ["aaaaa", "aaaaaa", "ababab", "bababa", "x" * 40, "x" * 41, "ÿÿÿÿÿ"]
    vocab = set(base)
    for w in base:
        k = r.randrange(len(w))
        vocab |= {w[:k] + w[k + 1 :] if len(w) > 5 else w, w[:k] + "z" + w[k:], w[:k] + "q" + w[k + 1 :]}
    rows = spark.createDataFrame([(w, 3) for w in vocab], "word string, n bigint")
    got = [(r.word, r.near) for r in spelling.near_words(rows, q=q, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_near(vocab)


def test_index_needs_two_grams_apart_and_blocks_count_overlaps():
    counts = Counter(g for w in ("strasse", "strasze", "gasse") for g in spelling.grams(w))
    places = spelling.posted("strasse", [], counts)
    assert max(places) - min(places) >= 3 and max(places[:-1]) - min(places[:-1]) < 3
    assert set(spelling.near_in_block(["strasse", "strasze", "gasse", "strase", "tstrasse"])) == {("strase", "strasse"), ("strase", "strasze"), ("strasse", "strasze"), ("strasse", "tstrasse")}
    assert spelling.one_edit("abcde", "abde") and not spelling.one_edit("abcde", "abcde") and not spelling.one_edit("abcde", "abedc") and not spelling.one_edit("abc", "abcde")


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in spelling.re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    vocab = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {}
    for a, b in plain_near(set(vocab)):
        near.setdefault(a, []).append((-vocab[b], b))
    form = {w: min(near[w])[1] if w in near and -min(near[w])[0] >= 2 * vocab[w] else None for w in vocab}
    out = {}
    for w in vocab:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, vocab[w], len(near.get(w, ())), vocab[form[w]] if form[w] else None)
    return out


def test_variants_are_what_the_rule_says(spark):
    r = random.Random(5)
    pool = ["Città", "citta", "cittá", "cittaa", "Straße", "strasse", "house", "houses", "housse", "ÉCOLE", "école", "ecole", "ecoles", "x×÷y"]
    rows = [(i, " ".join(r.choices(pool, weights=[9, 60, 3, 2, 30, 9, 30, 90, 7, 5, 25, 60, 4, 1], k=80)) + "\nnumber1word, end-of") for i in range(150)] + [(None, None), (None, "école " * 5), (1, ""), *([(3, "houses houses")] * 3)]
    d = spark.createDataFrame([(a, b, "x") for a, b in rows], DOCS).withColumn("word", F.lit("clash"))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spelling.vocabulary(d)).collect()}
    assert got == plain_variants(rows) and got["housse"][:2] == ("house", "houses")
    assert spelling.variants(spelling.vocabulary(d.limit(0))).count() == 0
    long = spark.createDataFrame([(i, "ab" * 15_000 + " " + "ab" * 15_000 + "a", "s") for i in range(4)], DOCS)
    got = {len(r.word): r.n_near for r in spelling.variants(spelling.vocabulary(long, drop_every=0)).collect()}
    assert got == {30_000: 1, 30_001: 1}


# --- 13 centroids


def plain_clusters(rows, k=40, rounds=5, dims=64):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centers = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for t in range(rounds + 1):
        own = [min((far(v, c), j) for j, c in enumerate(centers)) for _, v in kept]
        if t < rounds:
            for j in range(len(centers)):
                if mine := [v for (_, v), (_, o) in zip(kept, own, strict=True) if o == j]:
                    centers[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = Counter()
    for d, j in own:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own, strict=True))


VECS = "vec_id bigint, embedding array<double>"


def cloud(n, dims=64, spread=0.3, seed=1):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, dims))
    return [(i, (middles[i % 6 if i % 3 else 0] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]


def rows_of(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("case", ["plain", "ties", "few", "odd", "wide"])
def test_clusters_are_those_of_lloyd(spark, case):
    rows = cloud(150)
    if case == "ties":  # whole numbers in few dimensions that matter: equal distances and equal vectors abound
        r = random.Random(2)
        rows = [(i % 90, [r.randint(-1, 1) / 256 for _ in range(3)] + [0.0] * 61) for i in range(150)]
    if case == "few":
        rows = cloud(9)
    if case == "odd":
        v = rows[0][1]
        rows += [(900, None), (901, []), (902, v[:63]), (903, [None, *v[1:]]), (904, [math.nan, *v[1:]]), (905, [math.inf, *v[1:]]), (None, v), (None, rows[1][1]), (5, v), (5, v)]
    if case == "wide":
        rows = [(i, [x * 2**18 for x in v]) for i, v in rows]
    got = centroids.cluster(spark.createDataFrame(rows, VECS).withColumn("cluster", F.lit("clash")).withColumn("row", F.lit(1)))
    assert rows_of(got) == plain_clusters(rows)


def test_distances_beyond_a_long_are_null_and_nothing_is_lost(spark):
    rows = [*cloud(5), (70, [1e15] * 64), (71, [-1e15] * 64), (72, [1e30] * 64)]
    got = centroids.cluster(spark.createDataFrame(rows, VECS), k=2, rounds=1)
    assert {r.vec_id for r in got.collect()} == {0, 1, 2, 3, 4, 70, 71}
    assert any(r.distance is None and r.cluster_inertia is None for r in got.collect()) and all(r.inertia is None for r in got.collect())
    assert centroids.cluster(spark.createDataFrame([], VECS)).count() == 0
    got = centroids.cluster(spark.createDataFrame(cloud(20, 8), VECS), k=3, dims=8, carry=["vec_id", "embedding"])
    assert set(got.columns) >= {"vec_id", "embedding", "centroid"} and got.count() == 20


@pytest.mark.parametrize("seed", range(3))
def test_balls_compare_less_and_find_the_same(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-40, 40, (400, 64)) + 200 * rng.integers(0, 6, (400, 1))
    centers = x[:12]
    own, _ = centroids.nearest(x, centers)
    moved = centers.copy()
    for j in range(12):
        moved[j] = x[own == j].sum(axis=0) // max(1, (own == j).sum())
    want, d = centroids.nearest(x, moved)
    got, e, compared = centroids.reassign(x, own, moved, (moved != centers).any(axis=1))
    assert (got == want).all() and (d == e).all() and compared < 0.5 * 400 * 11
    again, f, none = centroids.reassign(x, want, moved, np.zeros(12, bool))
    assert (again == want).all() and (f == d).all() and none == 0


def test_a_cluster_without_a_shared_folder_gets_an_error():
    class Bare:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Bare)
