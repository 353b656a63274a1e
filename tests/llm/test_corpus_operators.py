"""Each corpus operator against a brute-force version, an exact round trip or known answers on small inputs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillsight.llm import extraction, feistel, language, merges, neighbours, packing, passages, quality, simhash, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_RNG = random.Random(3)
_VOCAB = ["".join(_RNG.choices("abcdefghijklmnoprstuvw", k=_RNG.randint(2, 8))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choices(_VOCAB, k=n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


# --- 1 toxicity


def test_restore_reads_through_disguises():
    plain = Counter({"idiot": 50, "stupid": 50, "clown": 40, "table": 300, "window": 300, "letter": 300, "moron": 30})
    grams = Counter()
    for w, n in plain.items():
        s = f"^{w}$"
        for k in range(1, 5):
            for i in range(len(s) - k + 1):
                grams[s[i : i + k]] += n
    lm = toxicity.CharModel(dict(grams))
    for seen, want in (("1d10t", "idiot"), ("i d i o t", "idiot"), ("stuuupid", "stupid"), ("cl0wn", "clown"), ("m.o.r.o.n", "moron"), ("table", "table"), ("letter", "letter")):
        assert toxicity.restore(seen, lm) == want
    assert toxicity.restore("", lm) == ""
    assert toxicity.words("ein i d i o t und 1d10t", lm)["idiot"] == 1


def test_toxicity_learns_and_scores(spark):
    rows = [(i, prose(30, i) + (" moron clown" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    lm = toxicity.CharModel(toxicity.char_counts(d))
    model = toxicity.fit(d.where("doc_id < 240").select("text", "toxic"), lm)
    got = {r.doc_id: r.score for r in toxicity.score(d, model, carry=["doc_id"]).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 240)
    assert model.score("m0r0n and c l o w n") > 0.5 > model.score("") and model.score(None) == model.score("")
    assert toxicity.fit(d.where("toxic = 0").select("text", "toxic"), lm).score("moron") < 0.01


# --- 2 quality rules


def repeat_words(words):
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for k in range(8)})


def test_base_columns_by_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t ", "a b c", " ".join("xyz"[i % 3] for i in range(60)), "#a $b\n\n#a $b\nc|d <e>"]
    texts += [" ".join(rng.choices("ab", k=rng.randint(1, 60))) + "\n" + prose(rng.randint(0, 40), i) for i in range(40)]
    got = {r.doc_id: r for r in quality.base_rules(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = t.split()
        lines = [x for x in t.split("\n") if x.split()]
        assert (got[i].n_words, got[i].word_chars, got[i].n_dup_lines) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)))
        assert got[i].n_symbols == sum(c in "#*$%&|<>" for c in t) and got[i].n_repeat_words == repeat_words(w)
        assert got[i].base_failed == (len(w) < 20 or 100 * repeat_words(w) > 30 * len(w))


def test_frequent_lines_go_and_depleted_documents_are_rejected(spark):
    line = "shared   Boilerplate line 123 of the host with many words in it so that it weighs"
    rows = [(i, f"{prose(30, i)}\n{line}", "a") for i in range(30)] + [(100, f"{prose(21, 7)}\n{line}\n{line.upper()}", "a"), (101, f"{prose(30, 8)}\n{line}", "b"), (102, prose(40, 9), None)]
    got = {r.doc_id: r for r in quality.line_quality(docs(spark, rows)).collect()}
    assert got[0].removed_words == 16 and got[0].kept and "boilerplate" not in got[0].clean_text.lower()
    assert not got[100].base_failed and not got[100].kept and got[100].removed_words == 32
    assert got[101].removed_words == 0 and got[101].kept and got[102].kept


def test_documents_are_counted_and_callers_may_spare_copies(spark):
    copy = "\n".join(prose(12, k) for k in range(5))
    d = docs(spark, [(i, copy, "a") for i in range(50)] + [(99, prose(40, 5), "a")])
    assert all(r.kept and r.removed_words == 0 for r in quality.line_quality(d, min_texts=10).collect())
    assert {r.doc_id: r.removed_words for r in quality.line_quality(d).collect()} == {i: 60 for i in range(50)} | {99: 0}
    # One document crawled again and again (equal rows) is one; one text under many ids is many documents.
    line = prose(9, 77)
    rows = [(1, f"{prose(30, 1)}\n{line}", "a")] * 40 + [(i, f"{prose(30, i)}\n{line}", "a") for i in range(2, 11)] + [(100 + i, prose(30, 100 + i), "a") for i in range(60)]
    assert quality.frequent_lines(docs(spark, rows)).count() == 0  # ten documents
    rows += [(i, rows[0][1], "a") for i in range(200, 203)]
    assert quality.frequent_lines(docs(spark, rows)).count() == 1 and quality.frequent_lines(docs(spark, rows), min_texts=10).count() == 0
    assert quality.frequent_lines(docs(spark, rows), share=0.9, min_texts=5).count() == 0 and quality.frequent_lines(docs(spark, rows), share=0.9, min_texts=5, most_docs=12).count() == 1


# --- 3 packing


def brute_first_fit(lengths, capacity):
    room, out = [], []
    for n in lengths:
        b = next((i for i, r in enumerate(room) if r >= n), None)
        if b is None:
            room.append(capacity)
            b = len(room) - 1
        out.append((b, capacity - room[b]))
        room[b] -= n
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_tournament_tree_is_first_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    assert packing.first_fit_decreasing(lengths, 100) == brute_first_fit(lengths, 100)


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(packing.default_tokenizer()), packing.WordEncoder(packing.default_tokenizer())
    rng = random.Random(0)
    alphabet = "abcXYZ éÈßÿŸİıſªµº²½0 9'sDtreLl!?.,\n\t--«»ǅȺɏ_日本　"
    texts = ["", "It's <|endoftext|> here", *("".join(rng.choices(alphabet, k=40)) for _ in range(500))]
    for t in texts:
        assert list(np.frombuffer(enc(t), "<u4")) == tok.encode(t, add_special_tokens=False).ids


def test_pieces_are_whole_and_sequences_gapless(spark):
    rows = [(i, prose(random.Random(i).randint(0, 400), i), "s") for i in range(60)] + [(60, prose(9000, 60), "s"), (61, None, "s"), (61, None, "s")]
    pieces = packing.pack(packing.tokenise(docs(spark, rows)), group_size=16).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        assert p.length == len(p.ids) <= 4096 and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
    enc = packing.WordEncoder(packing.default_tokenizer())
    for i, t, _ in rows[:61]:
        ids = [x for p in sorted(by_doc[i], key=lambda p: p.start) for x in p.ids]
        assert ids == [*np.frombuffer(enc(t), "<u4").tolist(), 2] and by_doc[i][0].doc_tokens == len(ids)
    assert len(by_doc[61]) == 2 and len(by_doc[60]) > 1
    for seq in by_seq.values():
        at = 0
        for p in sorted(seq, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096


# --- 4 merge-dropout


@pytest.fixture(scope="module")
def codec():
    return merges.Codec(merges.default_model())


def test_without_dropout_it_is_the_model(codec):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=merges.default_model())
    texts = [prose(50, 1), "a\nb  c   d", " x ", "ﬁ①é x\t日本語 𝒳", "      ", "x" * 300 + " " + "ab" * 100, "<s> <0x41>", ""]
    got = codec.encode(texts, np.arange(len(texts)).astype(np.uint64), 1, 0.0)
    assert [g.tolist() for g in got] == [sp.encode(t) for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4), st.floats(0, 1), st.integers(0, 5))
def test_decoding_is_lossless(texts, dropout, seed):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    c = merges.codec(merges.default_model())
    assert [c.decode(x) for x in c.encode(texts, np.arange(len(texts)).astype(np.uint64), seed, dropout)] == texts


def test_matrix_and_heap_take_the_same_steps(codec):
    units = [merges.BLANK + w for w in _VOCAB[:400]] + [merges.BLANK * 5 + "abcabcabc"]
    keys = merges._mix(np.arange(len(units)).astype(np.uint64))
    pool, at, n = codec.segment(units, keys, 0.3)
    for i, u in enumerate(units):
        ids, _ = codec._heap(codec.first[np.frombuffer(u.encode("utf-32-le"), np.uint32)], keys[i : i + 1], 0.3)
        assert ids == pool[at[i] : at[i] + n[i]].tolist()


def test_seeds_vary_and_repeat(spark):
    d = docs(spark, [(i, prose(80, 1), "s") for i in range(5)] + [(9, None, "s")])
    a, b, c = (merges.encode(d, 0.2, seed, carry=["doc_id"]).orderBy("doc_id").collect() for seed in (1, 1, 2))
    assert a == b != c and len({tuple(r.ids) for r in a[:5]}) > 1 and a[5].ids == []
    assert [r.text for r in merges.decode(merges.encode(d.where("doc_id = 0"))).collect()] == [prose(80, 1)]


# --- 5 language


def test_rank_order_profiles(spark):
    parts = {"aa": "ka ke ki ko ku", "bb": "zra vro dri bru", "cc": "élan çéda éta"}
    rows = [(i, " ".join(random.Random(i).choices(parts[lang].split(), k=40)), lang, "s", 0) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    d = spark.createDataFrame([*rows, (90, None, "aa", "s", 0), (91, "123 !!", "aa", "s", 0), (92, "ka ke", None, "s", 0)], DOCS)
    known = language.profiles(d)
    got = {r.doc_id: r for r in language.identify(d, known, carry=["doc_id"]).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang, _, _ in rows) and got[92].lang_pred == "aa"
    assert (got[90].lang_pred, got[91].lang_pred, got[90].score) == ("und", "und", 0.0)
    brute = Counter()
    for _, t, lang, _, _ in rows:
        if lang == "aa":
            for w in f" {t} ".replace("  ", " ").split(" "):
                brute.update(w)
    first = next(g for g in known["aa"].tolist() if g < 1 << 21 and g)
    assert chr(first) == max(brute, key=brute.get)


# --- 6 sharding


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 100, 1000])
def test_permutation_is_a_bijection(spark, n):
    from pyspark.sql import functions as F

    got = [r.y for r in spark.range(n).select(feistel.permute(F.col("id"), n, 7).alias("y")).collect()]
    assert sorted(got) == list(range(n))


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i % 300, prose(i % 7, i), "s") for i in range(333)] + [(None, None, "s"), (5, "same", "s"), (5, "same", "s")]
    got = feistel.shard(docs(spark, rows), shards=16).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    again = feistel.shard(docs(spark, rows).repartition(7), shards=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


# --- 7 neighbours


def brute_nearest(x, ids, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16)) + rng.integers(0, 4, (900, 1)) * 3
    x[300:420] = x[300]  # one common vector
    rows = [(i, v.astype(float).tolist()) for i, v in enumerate(x)]
    bad = [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [1.0, 2.0]), (1400, [None] * 16)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 100))
    hit = 0
    for q, found in got.items():
        want = brute_nearest(x, np.arange(900), q, 10)
        assert [f[0] for f in sorted(found)] == list(range(1, 11))
        hit += len({f[1] for f in found} & set(want))
        assert all(abs(f[2] - np.sqrt(((x[f[1]] - x[q]) ** 2).sum())) < 1e-9 for f in found)
    assert hit >= 0.9 * 90
    assert [f[1] for f in sorted(got[300])] == list(range(301, 311))


def test_flat_arrays_round_trip(spark):
    x = np.random.default_rng(1).normal(size=(200, 8))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id bigint, embedding array<double>")
    graphs, shards = neighbours.index(v, shard_size=64)
    rows = [r.asDict() for r in graphs.collect()]
    assert shards == 4 and sum(len(r["ids"]) for r in rows) == 200
    g, ids, node = neighbours.load(rows[0])
    assert g.levels[0].shape == (len(g.x), 24) and len(ids) == len(node)


# --- 8 extraction


@pytest.fixture(scope="module")
def field():
    return extraction.fitted()


def test_blocks_survive_broken_markup():
    page = "<p>a &amp; b<b>c<br>d<p>e</article><script>var t='</p><p>x'</script><li>f<li>g <!-- <p>h --> <td title='a>b'>i"
    assert [b[1] for b in extraction.blocks(page)] == ["a & bc d", "e", "f", "g", "i"]
    assert extraction.blocks(None) == extraction.blocks("") == extraction.blocks("<script>open") == []


def test_crf_finds_main_text(field):
    bad = total = 0
    for page, labels in extraction.labelled_pages(80, seed=77):
        got = field.decode([extraction.block_features(*b) for b in extraction.blocks(page)])
        bad += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert bad < 0.02 * total
    page = '<body><nav><a href=x>Home</a></nav><div class="ad">Buy this now, dear reader.</div><article><h1>Title here</h1><p>One   text, with words.</p><p>Two &eacute; more.</p><section class="comments"><p>I disagree with this.</p></section></article><footer>&copy; me</footer></body>'
    assert extraction.main_text(page, field) == "Title here\nOne text, with words.\nTwo é more."


def test_viterbi_is_the_best_path(field):
    rng = np.random.default_rng(2)
    rows = [tuple(rng.choice(list(field.weights), 4)) for _ in range(7)]

    def value(y):
        s = [sum(field.weights[f] for f in r) for r in rows]
        return sum(v for v, k in zip(s, y, strict=True) if k) + sum(field.moves[a][b] for a, b in zip(y, y[1:], strict=False))

    best = max(value([n >> k & 1 for k in range(7)]) for n in range(128))
    assert abs(value(field.decode(rows)) - best) < 1e-9


# --- 9 simhash


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_gray_index_against_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = []
    for _ in range(700):
        f = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for chunk in (1024, 16):
        edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), len(fps), chunk=chunk)
        root = {f: f for f in signed}
        for r in simhash.components(edges, "test").collect():
            root[r.node] = r.root
        groups = {}
        for f, b in zip(signed, brute_components(fps), strict=True):
            groups.setdefault(b, set()).add(root[f])
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_near_duplicates_by_brute_force(spark):
    text = prose(200, 1)
    near = text.split()
    near[50] = "changed"
    rows = [(7, text, "s"), (3, text, "s"), (9, " ".join(near), "s"), (4, prose(200, 2), "s"), (5, "", "s"), (6, None, "s"), (2, "A b", "s"), (1, "a  B", "s")]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    fps = [simhash.fingerprint(t) for _, t, _ in rows]
    roots = brute_components(fps)
    for k, (i, _, _) in enumerate(rows):
        assert got[i].component_id == min(rows[j][0] for j in range(len(rows)) if roots[j] == roots[k])
        assert got[i].fp & (2**64 - 1) == fps[k]
    assert got[6].fp == 0 and got[1].fp == got[2].fp


def test_hash_is_the_engines_own(spark):
    h = spark.sql("select xxhash64('a bé c') as h").first().h & (2**64 - 1)
    bits = simhash.fingerprint("a bé c")
    assert bits == h


# --- 10 passages


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 8))
def test_compact_windows_cover_each_run_once(values, width):
    v = np.array(values, np.int64)
    wins = list(zip(*(x.tolist() for x in passages.compact_windows(v, width)), strict=True))
    for i in range(len(v)):
        for j in range(i + width - 1, len(v)):
            hit = [w for w in wins if w[0] <= i <= w[1] <= j <= w[2]]
            assert len(hit) == 1 and v[hit[0][1]] == v[i : j + 1].min()


def test_planted_passages_are_found_and_cut(spark):
    p, q = prose(60, 100), prose(80, 101)
    edited = q.split()
    edited[40] = "edited"
    rows = [(i, f"{prose(100, i)} {p} {prose(30, 500 + i)}", "s") for i in range(8)] + [(20, f"{prose(50, 20)} {q}", "s"), (21, f"{' '.join(edited)} {prose(50, 21)}", "s"), (30, prose(150, 30), "s"), (31, f"{prose(40, 31)} {prose(20, 100)} {prose(40, 32)}", "s"), (40, None, "s"), (41, "", "s")]
    got = passages.near_duplicate_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == {*range(8), 20, 21}
    texts = {r.doc_id: r.text for r in passages.remove(docs(spark, rows)).collect()}
    assert len(texts) == len(rows) and sum(p in (t or "") for t in texts.values()) == 1
    assert texts[30] == rows[10][1] and texts[31] == rows[11][1] and texts[40] is None and texts[41] == ""
    assert sum(len(t.split()) for i, t in texts.items() if i < 8) == 8 * 130 + 60


def test_second_pass_finds_what_the_representative_lacks(spark):
    shared = prose(5, 900)
    pairs = [prose(30, 910 + k) + " " + shared + " " + prose(30, 950 + k) for k in range(4)]
    rows = [(2 * k + h, f"{prose(20, 70 + 2 * k + h)} {pairs[k]} {prose(20, 90 + 2 * k + h)}", "s") for k in range(4) for h in (0, 1)]
    got = passages.near_duplicate_passages(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == set(range(8))
    assert all(r.doc_id // 2 == r.rep_doc_id // 2 for r in got)
