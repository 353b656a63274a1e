"""Passages whose keys are led by texts that don't hold them, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_corpus_operators import docs, prose
from tillsight.llm import passages


def found(spark, rows):
    return passages.near_duplicate_passages(docs(spark, rows)).collect()


def edited(words, rng):
    """The words with one of the middle ones replaced: a similarity of 0.8 or more of their shingles."""
    k = rng.randrange(10, len(words) - 10)
    return [*words[:k], f"edit{rng.random()}", *words[k + 1 :]]


@pytest.mark.parametrize("bridges", [0, 1, 3, 8])
def test_edited_passages_are_found_beside_bridging_texts(spark, bridges):
    """A bridge holds both halves of the passage, apart, so it meets both texts and shares no passage with either."""
    rng, rows, pairs = random.Random(bridges), [], []
    for k in range(120):
        p = prose(60, 10_000 + k).split()
        fill = lambda n: prose(n, rng.randrange(10**9))
        one, two = 1000 * k, 1000 * k + 1
        rows += [(one, f"{fill(40)} {' '.join(p)} {fill(40)}", "s"), (two, f"{fill(30)} {' '.join(edited(p, rng))} {fill(50)}", "s")]
        rows += [(1000 * k + 10 + b, f"{fill(30)} {' '.join(p[:29])} {fill(60)} {' '.join(p[31:])} {fill(30)}", "s") for b in range(bridges)]
        pairs.append((one, two))
    brute = [passages.chain(*(passages.tokens(t) for i, t, _ in rows if i in (a, b)))[0] for a, b in pairs]
    assert all(len(x) == 1 and x[0][1] - x[0][0] >= 50 and x[0][4] >= 0.8 for x in brute)
    got = {(r.doc_id, r.rep_doc_id) for r in found(spark, rows)}
    caught = sum((a, b) in got or (b, a) in got for a, b in pairs)
    assert caught >= 0.95 * len(pairs), caught
    assert all(a // 1000 == b // 1000 and (a == b or a % 1000 < 2 and b % 1000 < 2) for a, b in got)


def test_every_exact_run_has_a_key():
    for place in range(passages.WIDTH):
        starts = passages.starts_of(np.array([100 + place]), passages.WIDTH, passages.GRID)
        assert any(100 <= s and s + passages.RUN <= 100 + passages.WIDTH for s in starts)


def test_copies_cut_short_do_not_hide_whole_ones(spark):
    p = prose(50, 820).split()
    rows = [(k, f"{prose(40, k)} {' '.join(p)} {prose(40, 100 + k)}", "s") for k in (1, 2)]
    rows += [(1000 + 4 * k + x, f"{prose(40, 200 + 4 * k + x)} {' '.join(p[x : x + 47])} {prose(40, 600 + 4 * k + x)}", "s") for k in range(30) for x in range(4)]
    assert {r.doc_id for r in found(spark, rows) if r.similarity == 1.0 and r.n_words == 50} == {1, 2}


def test_copies_are_one_text(spark):
    text, alike = prose(80, 830), prose(55, 831)
    rows = [(i, text, "s") for i in (7, 3, 9, 9)] + [(None, text, "s"), (20, "short text", "s"), (21, "short text", "s"), (30, f"{prose(30, 832)} {alike} end", "s"), (31, f"{alike} {prose(20, 833)}", "s")]
    got = found(spark, rows)
    assert sorted(r.doc_id or 0 for r in got if r.rep_doc_id == 3) == [0, 3, 7, 9] and {r.n_words for r in got if r.rep_doc_id == 3} == {80}
    assert {r.doc_id for r in got if r.rep_doc_id != 3} == {30, 31}
    left = [(r.doc_id, r.text) for r in passages.remove(docs(spark, rows)).collect()]
    assert [i for i, t in left if t == text] == [3] and sum(t == "" for _, t in left) == 4 and sum(t == "short text" for _, t in left) == 2
    assert sum(alike in t for i, t in left if i in (30, 31)) == 1


@pytest.mark.parametrize("seed", range(6))
def test_chain_against_brute_force(seed):
    """Every exact run of 50 words is covered, also in texts of few words; no passage is less alike than it says."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range((1, 2, 40, 2000)[seed % 4])]
    a, b = ([rng.choice(vocab) for _ in range(rng.randrange(60, 200))] for _ in range(2))
    cut = a[20 : 20 + rng.randrange(50, 70)]
    b[10:10] = cut
    x, y = (passages.tokens(" ".join(t)) for t in (a, b))
    got, left, right = passages.chain(x, y)
    runs = {tuple(b[k : k + 50]) for k in range(len(b) - 49)}
    held = {k + d for k in range(len(a) - 49) if tuple(a[k : k + 50]) in runs for d in range(50)}
    assert held <= {k for s, e, *_ in got for k in range(s, e)}
    assert all(e - s >= 50 and 0.8 <= sim <= 1 and 0 <= vs < ve <= len(b) and e <= len(a) for s, e, vs, ve, sim in got)
    assert (x[left] == y[right]).all()


def test_hot_groups_keep_all_members():
    """Least and greatest of a group, and private keys for what each other one pairs with: the same pairs whole or in parts."""
    rng = np.random.default_rng(4)
    keys, texts = rng.integers(0, 5, 400).astype(np.uint64), rng.integers(0, 60, 400)
    k, t = passages._combined(keys, texts)
    groups: dict[int, set[int]] = {}
    for a, b in zip(k.tolist(), t.tolist(), strict=True):
        groups.setdefault(a, set()).add(b)
    for key in range(5):
        mine = set(texts[keys == key].tolist())
        assert groups[key] == {min(mine), max(mine)}
        private = {frozenset(g) for a, g in groups.items() if a >= 5}
        assert all({frozenset((x, min(mine))), frozenset((x, max(mine)))} <= private for x in mine - groups[key])


def test_texts_that_share_half_their_key_are_told_apart(spark):
    d = spark.createDataFrame([(1, "one"), (2, "two"), (3, "six"), (4, "four"), (5, "two"), (6, None), (7, "")], "doc_id bigint, text string")
    keyed = passages.with_text_key(d, "u", halves_of=lambda t: (F.length(t).cast("bigint"), F.xxhash64(t))).collect()
    u = {r.doc_id: r.u for r in keyed}
    assert len({u[k] for k in (1, 2, 3, 4, 6)}) == 5 and u[2] == u[5] and u[6] == u[7] and 3 in (u[1], u[2], u[3])
    assert {r.doc_id: r.u for r in passages.with_text_key(d, "u").collect()} == {r.doc_id: r.h for r in d.selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS h").collect()}


def test_tokens_and_joint_keys_of_many_texts_are_those_of_each():
    """Texts beside each other share neither words nor windows; a key is each two least hashes that some run of ``WIDTH`` has."""
    rng = random.Random(11)
    texts = ["", " ", "a", "b c d e", " f g h i j", "k l m n o\n", "", "à é ü x y z ß", prose(49, 1), prose(50, 2), "", "la " * 120, *(prose(rng.randrange(40, 300), k) for k in range(30)), " ".join(prose(60, 3).split() * 3), ""]
    each = [passages.tokens(t) for t in texts]
    together = passages.tokens_of([t.encode() for t in texts])
    assert [x.tolist() for x in together] == [x.tolist() for x in each] and [len(x) for x in each] == [max(0, len(t.split()) - 4) for t in texts]
    keys, places = passages.joint_keys(together)
    for k, s in enumerate(each):
        hashes = [passages._mix(s ^ seed) for seed in passages._SEEDS]
        windows = [dict.fromkeys((int(l), int(c), int(r)) for l, c, r in zip(*passages.compact_windows(v), strict=True)) for v in hashes]
        least = [[next(int(v[c]) for l, c, r in w if l <= x <= c < x + passages.WIDTH <= r + 1) for x in range(len(s) - passages.WIDTH + 1)] for v, w in zip(hashes, windows, strict=True)]
        want = {(f, g, x, y) for f in range(passages.FNS) for g in range(f + 1, passages.FNS) for x, y in zip(least[f], least[g], strict=True)}
        wanted = {int(passages._mix(np.array([x], np.uint64) ^ passages._mix(np.array([y], np.uint64) + np.uint64(passages.FNS * f + g)))[0]) for f, g, x, y in want}
        assert set(keys[places == k].tolist()) == wanted
    assert len(passages.joint_keys([])[0]) == len(passages.joint_keys(together[:8])[0]) == 0


def test_what_no_passage_holds_is_left_over():
    """With or without what is known of the second text; too few matches for a passage are all left over."""
    p, q = prose(60, 5).split(), prose(30, 6)
    b = passages.tokens(f"{q} {' '.join(p)} {prose(20, 7)} {q}")
    for a, n in ((f"{prose(9, 8)} {' '.join(p)}", 1), (f"{' '.join(p[:40])} x {q}", 0), (" ".join(p[5:50]), 0), (q, 0)):
        s = passages.tokens(a)
        got, left, right = passages.chain(s, b)
        again = passages.chain(s, b, index=passages.indexed(b))
        assert again[0] == got and (again[1] == left).all() and (again[2] == right).all() and len(got) == n
        assert (s[left] == b[right]).all()
        inside = {k for x, y, *_ in got for k in range(x, y - 4)}
        assert set(left.tolist()) == {k for k in range(len(s)) if s[k] in b and k not in inside}


def test_shuffles_go_with_the_table_they_made(spark):
    """No pass leaves its shuffle files to the driver's garbage collection, and the session's setting is as before."""
    from pathlib import Path

    def there():
        dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {f: f.stat().st_size for d in dirs for f in Path(str(d)).glob("*/shuffle_*.data")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rng, before, setting = random.Random(7), there(), spark.conf.get(name, "false")
    words = lambda n: " ".join(f"{rng.getrandbits(48):x}" for _ in range(n))
    shared = [words(60) for _ in range(40)]
    rows = [(k, f"{words(200)} {shared[k % 40]} {words(20)}", "s") for k in range(160)]
    d = docs(spark, rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that texts are shuffled
    try:
        got = passages.near_duplicate_passages(d)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = sum(size for f, size in there().items() if f not in before)
    assert left < 0.1 * sum(len(t) for _, t, _ in rows), left
    assert spark.conf.get(name, "false") == setting
    assert {r.doc_id for r in got.collect()} == set(range(160))
