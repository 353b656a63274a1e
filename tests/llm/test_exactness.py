"""Operators that no SQL can check, against brute force, the tokenizer itself, and held-out rows of the tables."""

import itertools
import random
import time
import os
import unicodedata
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_corpus_operators import DOCS, docs, prose
from tillsight.llm import extraction, language, neighbours, packing, queries, toxicity

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def model(plain):
    grams = Counter()
    for w, n in plain.items():
        s = f"^{w}$"
        for k in range(1, 5):
            for i in range(len(s) - k + 1):
                grams[s[i : i + k]] += n
    return toxicity.CharModel(dict(grams))


# --- 1 toxicity


def paths(token, lm):
    """Every path of the lattice with its cost, by enumeration."""
    span, out = lm.order - 1, {}

    def go(i, word, cost):
        state = ("^" + word)[-span:]
        if i == len(token):
            out.setdefault(word, []).append(cost + lm(state, "$"))
            return
        c = token[i]
        if c in " .-_*":
            return go(i + 1, word, cost - 0.1)
        for x in toxicity.LEET.get(c, ""):
            go(i + 1, word + x, cost - 1.0 + lm(state, x))
        go(i + 1, word + c, cost + (0.0 if c.isalpha() else -6.0) + lm(state, c))
        if state[-1] == c or state[-1] in toxicity.LEET.get(c, ""):
            go(i + 1, word, cost - 1.2)
        return None

    go(0, "", 0.0)
    return {w: max(c) for w, c in out.items()}


def test_viterbi_finds_the_best_of_all_paths():
    lm = model({"idiot": 50, "stupid": 50, "clown": 40, "table": 300, "loose": 100, "list": 90})
    for token in ("1d10t", "l00se", "s7up1d", "c|0wn", "t4b|e", "ii11ss", "l.1.s.7", "8", "$$7", "looooose"):
        every = paths(token, lm)
        best = max(every.values())
        assert every[toxicity.restore(token, lm)] == pytest.approx(best), token


def test_each_model_restores_by_itself():
    one, two = model({"idiot": 50, "table": 50}), model({"ldlot": 50, "table": 50})
    assert toxicity._plain("1d1ot", one) == "idiot" and toxicity._plain("1d1ot", two) == "ldlot" and toxicity._plain("1d1ot", one) == "idiot"


def test_long_tokens_and_wide_letters_count(spark):
    token = "1" + "ab" * 40
    assert token in toxicity.tokens(f"x {token} y")[1]
    d = docs(spark, [(1, "\U00010400\U00010401 ab", "s"), (2, "ab abc", "s")])
    counts = toxicity.char_counts(d)
    assert counts["ab"] == 3 and counts["^ab$"] == 2 and counts["￿￿"] == 1
    lm = toxicity.CharModel(counts)
    assert lm("", "\U00010428") == lm("", "￿")
    for most in (0, 1, 3, 5, 8, len(counts) - 1, len(counts)):
        few, left = toxicity.char_counts(d, most=most), sorted(counts.values(), reverse=True)
        assert len(few) == max(k for k in range(most + 1) if k in (0, len(left)) or left[k - 1] > left[k])  # as many as leave no tie
        assert all(counts[g] == n for g, n in few.items()) and sorted(few.values(), reverse=True) == left[: len(few)]


@tables
def test_held_out_toxicity(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in queries.op1_toxicity(spark, SF).collect() if r.held_out and labels.get(r.doc_id) is not None]
    bad, good = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    assert bad and good
    auc = np.mean([(a > b) + (a == b) / 2 for a in bad for b in good])
    assert auc >= 0.9, auc


# --- 3 packing


def test_ids_are_the_tokenizers_for_every_code_point():
    e = packing.WordEncoder(packing.default_tokenizer())
    texts = [f"a{chr(c)}b" for c in [*range(0xD800), *range(0xE000, 0x30000), *range(0xE0000, 0xE0200)]]
    want = [e.raw(x.ids) for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    got = [b for at in range(0, len(texts), 10_000) for b in e.many(texts[at : at + 10_000])]
    assert [hex(ord(t[1])) + unicodedata.category(t[1]) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_packing_repeats_and_wastes_little(spark):
    rows = [(i, prose(20 + i * 7 % 900, i), "s") for i in range(700)] + [(None, "equal rows", "s")] * 300
    d = docs(spark, rows)
    runs = []
    for parts in (1, 7):
        got = packing.pack(packing.tokenise(d.repartition(parts), with_ids=False), group_size=128).collect()
        runs.append(sorted((r.doc_id, r.start, r.sequence_id, r.offset) for r in got if r.doc_id is not None))
        used = {r.sequence_id for r in got}
        assert len({r.sequence_id >> 32 for r in got}) > 5
        assert sum(r.length for r in got) >= 0.97 * 4096 * (len(used) - len({s >> 32 for s in used}))  # but for each group's last
    alone = lambda run: {(i, s): q >> 32 for i, s, q, _ in run}
    assert alone(runs[0]) == alone(runs[1])


# --- 5 language


def plain_grams(text):
    """All n-grams of one to three, in strings; runs of anything but letters are one boundary."""
    s = []
    for c in text.lower():
        if c.isalpha():
            s.append(c)
        elif not s or s[-1] != " ":
            s.append(" ")
    s = "".join(s)
    s = (" " + s if s[0] != " " else s) + (" " if s[-1] != " " else "")
    return Counter([c for c in s if c != " "] + [s[i : i + 2] for i in range(len(s) - 1)] + [s[i : i + 3] for i in range(len(s) - 2)])


def number(gram):
    """Ties go by this number, as in the operator: 21 bits a letter, 0 a boundary, and the length."""
    n = 0
    for c in gram:
        n = n << 21 | (0 if c == " " else ord(c))
    return n | {1: 0, 2: 1 << 42, 3: 1 << 63}[len(gram)]


def test_out_of_place_distance_by_brute_force(spark):
    vocab = {"xx": "aei", "yy": "aou", "zz": "iuy"}
    rng = np.random.default_rng(2)
    text = lambda v: " ".join("".join(rng.choice(list("bcdf" + vocab[v]), 4)) for _ in range(60))
    rows = [(i, text(v), v) for i, v in enumerate(["xx", "yy", "zz"] * 8)] + [(90, "Abe, fac! 12 bed", None), (91, "é", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = language.profiles(d, size=50)
    ranked = lambda counts, n: sorted(counts, key=lambda g: (-counts[g], number(g)))[:n]
    signed = lambda counts, n: sorted(counts, key=lambda g: (-counts[g], number(g) - (1 << 64) if number(g) >> 63 else number(g)))[:n]
    learned = {v: signed(sum((plain_grams(t) for _, t, x in rows if x == v), Counter()), 50) for v in vocab}
    for r in language.identify(d, known, own=40).collect():
        mine, sums = ranked(plain_grams(r.text), 40), {}
        for v, profile in learned.items():
            place = {g: k for k, g in enumerate(profile)}
            sums[v] = sum(min(abs(place[g] - k), 50) if g in place else 50 for k, g in enumerate(mine))
        best = min(sums, key=lambda v: (sums[v], v))
        assert (r.lang_pred, r.score) == (best, pytest.approx(1 - sums[best] / (50 * len(mine)))), r.text


@tables
def test_held_out_languages(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [(r.lang_pred, lang[r.doc_id]) for r in queries.op5_rank_language(spark, SF).collect() if r.held_out and lang[r.doc_id]]
    assert np.mean([a == b for a, b in rows if a != "und"]) >= 0.98


def test_unlabelled_documents_pass_the_language_stage(spark):
    rows = [(i, prose(40, i), None, "s", 0) for i in range(20)]
    assert corpus_pipeline.language_id(spark, spark.createDataFrame(rows, DOCS), "").count() == 20


# --- 7 neighbours


@tables
def test_neighbour_recall_over_the_table(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in v.collect() if r.embedding is not None]
    rows = [(i, x) for i, x in rows if len(x) == len(rows[0][1]) and np.isfinite(x).all() and x.any()]
    ids, x = np.array([i for i, _ in rows]), np.stack([x for _, x in rows])
    got = {}
    for r in neighbours.nearest(v, every=50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        want = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        hit += len(found & set(want))
    assert hit >= 0.95 * 10 * len(got)


def test_graph_search_recall():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    height = -np.sort(-neighbours._heights(np.arange(3000)))
    g = neighbours.Graph.build(x, height)
    q = rng.normal(size=(100, 24))
    want = np.argsort(((q[:, None] - x[None]) ** 2).sum(2), axis=1)[:, :10]
    assert np.mean([len(set(a[:10].tolist()) & set(b.tolist())) for a, b in zip(g.search(q), want, strict=True)]) >= 9.0
    assert len(g.levels) > 1 and all((level < len(level)).all() for level in g.levels)


# --- 8 extraction


def test_wide_blanks_are_white_space():
    assert [b[1] for b in extraction.blocks("<p>&nbsp; a&nbsp;&nbsp;b &#8195;c</p>")] == ["a b c"]


@tables
def test_table_pages_are_read_as_their_article(spark):
    """The pages of the table were made elsewhere; their article element is the label."""
    field = extraction.fitted()
    rows = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r.html and "<article" in r.html]
    hit = total = wrong = 0
    for page in rows:
        found = extraction.blocks(page)
        truth = ["in:article" in b[0] for b in found]
        y = field.decode([extraction.block_features(*b) for b in found])
        hit += sum(a and b for a, b in zip(truth, y, strict=True))
        wrong += sum(b and not a for a, b in zip(truth, y, strict=True))
        total += sum(truth)
    assert hit >= 0.98 * total and wrong <= 0.02 * total


LAYOUTS = [("<article>", "</article>"), ("<div class='story'>", "</div>"), ("<div id='x'>", "</div>"), ("", ""), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>"), ("<div><div>", "</div></div>"), ("<div class='body-copy'>", "</div>")]
WORDS = "la città era piccola e molti andavano ogni giorno al mercato strada river house with people".split()


def a_page(start, end):
    """A menu, a title and five paragraphs of some 100 characters, readers' comments, a footer; and the article's text."""
    rng = random.Random(8)
    story = ["Una storia del fiume", *(" ".join(rng.choices(WORDS, k=18)).capitalize() + "." for _ in range(5))]
    menu, said = "<ul class='menu'><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul>", "<div class='comments'><p>I liked this text very much, thank you all.</p><p>Second reader says hello there.</p></div>"
    inside = f"<h1>{story[0]}</h1>" + "".join(f"<p>{x}</p>" for x in story[1:])
    return f"<html><body>{menu}{start}{inside}{end}{said}<div class='footer'><p>© 2020 Someone. All rights reserved.</p></div></body></html>", "\n".join(story)


def test_articles_without_a_telling_box_are_found():
    field = extraction.fitted()
    for start, end in LAYOUTS:
        page, story = a_page(start, end)
        assert extraction.main_text(page, field) == story, start


@tables
def test_table_pages_without_the_article_element(spark):
    """The table's pages with ``article`` renamed to ``div``: what tells is their text and the boxes around."""
    field = extraction.fitted()
    hit = wrong = total = 0
    for page in (r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r.html and "<article" in r.html):
        truth = {b[1] for b in extraction.blocks(page) if "in:article" in b[0]}
        got = set(extraction.main_text(page.replace("<article", "<div").replace("</article", "</div"), field).split("\n")) - {""}
        hit, wrong, total = hit + len(truth & got), wrong + len(got - truth), total + len(truth)
    assert hit >= 0.9 * total and wrong <= 0.1 * total


def test_deep_and_long_pages_take_time_in_their_length():
    field = extraction.Field({"in:div": 0.25, "own:a": 0.5, "tag:div": 0.125, "in:article": 3.0, "bias": -0.5}, np.zeros((2, 2)))
    began = time.process_time()
    assert extraction.main_text("<div class=a>x" * 100_000, field).count("x") == 100_000
    assert extraction.main_text("<h1>" * 50_000 + "<li>x</li>" * 50_000, field) == ""
    assert extraction.main_text("".join(f"<div class=a{'b' * (k % 50)}>y" for k in range(30_000)) + "</p></i>" * 30_000, field).count("y") > 0
    assert time.process_time() - began < 60
    # Running sums equal sums over the features of each block.
    page = a_page("<div class='a'><article>", "</article></div>")[0] + "<div class=a>z<div>w</div></div>" * 50
    scores = [sum(field.weights.get(f, 0.0) for f in extraction.block_features(*b)) for b in extraction.blocks(page)]
    path = extraction._Path(field.weights)
    assert scores == [path.score + sum(field.weights.get(f, 0.0) for f in (*path.own(), *extraction._shape(*b))) for b in extraction._walk(page, path)]


@pytest.mark.parametrize("k", range(3))
def test_orders_of_labels_by_enumeration(k):
    """Viterbi against all labellings of a short page."""
    rng = np.random.default_rng(k)
    f = extraction.Field({str(i): float(w) for i, w in enumerate(rng.normal(size=6))}, rng.normal(size=(2, 2)))
    rows = [tuple(rng.choice(list("012345"), 2)) for _ in range(8)]
    score = lambda y: sum(sum(f.weights[x] for x in r) for r, v in zip(rows, y, strict=True) if v) + sum(f.moves[a, b] for a, b in itertools.pairwise(y))
    assert score(f.decode(rows)) == pytest.approx(max(score(y) for y in itertools.product((0, 1), repeat=8)))
