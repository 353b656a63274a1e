"""Each stage of the pipeline against a plain version, on one small corpus with copies, boilerplate, junk and shared passages."""

import re
from collections import Counter, defaultdict

import pytest
import xxhash

import corpus_pipeline
from tests.llm.test_corpus_operators import DOCS, brute_components, prose, repeat_words
from tests.llm.test_exactness import number, plain_grams
from tillsight.llm import language, quality


@pytest.fixture(scope="module")
def corpus(spark):
    passage, copied, line = prose(60, 1), prose(90, 2), "Read more   on our site 24 hours a day and tell all your friends about it now"
    rows = [(i, prose(70 + i, 100 + i), "en", f"s{i % 2}", 0) for i in range(40)]
    rows += [(100 + i, copied if i % 3 else copied.upper(), "en", "s0", 0) for i in range(6)]  # copies, one in capitals
    rows += [(200 + i, f"{prose(80, 300 + i)}\n{line.replace('24', str(i))}\n{prose(20, 400 + i)}", "en", "s1", 0) for i in range(30)]
    rows += [(300 + i, f"{prose(40, 500 + i)} {passage} {prose(30, 600 + i)}", "en", "s0", 0) for i in range(5)]
    rows += [(400, "too short", "en", "s0", 0), (401, "again and again " * 40, "en", "s0", 0), (402, None, "en", "s0", 0), (403, "123 456 " * 20 + "!" * 40, None, "s0", 0), (404, f"{line}\n{line}\n{prose(21, 9)}", "en", "s1", 0)]
    return spark.createDataFrame(rows, DOCS), rows


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_quality_rules(spark, corpus):
    docs, rows = corpus
    normal = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", x.lower())).strip(" ")
    holders, texts, hosts = defaultdict(set), defaultdict(set), Counter()
    for i, t, _, host, _ in rows:
        hosts[host] += 1
        for x in {normal(x) for x in (t or "").split("\n")} - {""}:
            holders[host, x].add(i)
            texts[host, x].add(t)
    out = {}
    for i, t, _, host, _ in rows:
        often = [x for x in (t or "").split("\n") if len(holders[host, normal(x)]) > max(10, 0.1 * hosts[host]) and len(texts[host, normal(x)]) > 10 and normal(x)]
        n, gone = len(words(t)), sum(len(words(x)) for x in often)
        if n >= 20 and 100 * repeat_words(words(t)) <= 30 * n and n - gone >= quality.KEEP_SHARE * n:
            out[i] = "\n".join(x for x in t.split("\n") if x not in often) if often else t
    got = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, "").collect()}
    assert got == out and 404 not in out and any(out[200 + i] != rows[46 + i][1] for i in range(30))


def test_language_id(spark, corpus):
    docs, rows = corpus
    import zlib

    ranked = lambda c, n: sorted(c, key=lambda g: (-c[g], number(g)))[:n]
    signed = lambda g: number(g) - (1 << 64) if number(g) >> 63 else number(g)
    learned: dict = {}
    for i, t, lang, _, _ in rows:
        if t is not None and lang and zlib.crc32(str(i).encode()) % 3 != 1:
            learned[lang] = learned.get(lang, Counter()) + plain_grams(t)
    learned = {k: {g: n for n, g in enumerate(sorted(c, key=lambda g: (-c[g], signed(g)))[: language.PROFILE])} for k, c in learned.items()}
    most = max(map(len, learned.values()))
    keep = set()
    for i, t, _, _, _ in rows:
        if any(c.isalpha() for c in t or ""):
            mine = ranked(plain_grams(t), language.OWN)
            best = max(1 - sum(min(abs(p[g] - k), most) if g in p else most for k, g in enumerate(mine)) / (most * len(mine)) for p in learned.values())
            keep |= {i} if best >= corpus_pipeline.MIN_LANGUAGE_SCORE else set()
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()} == keep and 403 not in keep


def fingerprint(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_dedup(spark, corpus):
    docs, rows = corpus
    root = brute_components([fingerprint(t) for _, t, *_ in rows])
    least: dict = {}
    for (i, *_), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    got = [r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()]
    assert sorted(got) == sorted(least.values()) and 100 in got and 101 not in got


def test_substring_dedup(spark, corpus):
    docs, rows = corpus
    got = {r.doc_id: r.text for r in corpus_pipeline.substring_dedup(spark, docs, "").collect()}
    runs = lambda t: {tuple(w[k : k + 50]) for w in [words((t or "").lower())] for k in range(len(w) - 49)}
    before = Counter(x for _, t, *_ in rows for x in runs(t))
    after = Counter(x for t in got.values() for x in runs(t))
    assert all(after[x] == 1 for x, n in before.items() if n > 1), "a repeated run stays in one text"
    shared = {i for i, t, *_ in rows if any(before[x] > 1 for x in runs(t))}
    assert shared == {*range(100, 106), *range(300, 305)}
    assert all(got[i] == t for i, t, *_ in rows if i not in shared)
    assert sum(len(words(got[i])) for i in range(300, 305)) == 5 * 70 + 60


def test_packing(spark, corpus):
    docs, rows = corpus
    from tillsight.llm import packing

    tok = packing.WordEncoder(packing.default_tokenizer()).tok
    pieces = corpus_pipeline.packed(spark, docs, "").collect()
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    assert {p.doc_id: (p.start, p.length, p.doc_tokens) for p in pieces} == {i: (0, len(x), len(x)) for i, x in want.items()}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for found in sequences.values():
        ends = [o + n for o, n in sorted(found)]
        assert [0, *ends[:-1]] == [o for o, _ in sorted(found)] and ends[-1] <= 4096
