"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_corpus_operators import DOCS, prose
from tillsight.llm import extraction, feistel, language, merges, neighbours, packing, passages, quality, simhash, toxicity

CASES = {
    "empty": [],
    "nulls": [(None, None, None, None, None), (1, None, "en", None, 0), (None, "a few words", None, "s", 3)],
    "blank": [(1, "", "en", "s", 0), (2, " \n\t ", "en", "s", 3), (3, "", "en", "s", 0)],
    "repeats": [(1, prose(80, 1), "en", "s", 9)] * 4 + [(1, prose(80, 2), "de", "s", 9)],
    "long": [(1, prose(30_000, 1), "en", "s", 9), (2, "a " * 20_000, "en", "s", 9), (3, "x" * 50_000, "en", "s", 9)],
}


def lm_model(d):
    lm = toxicity.CharModel(toxicity.char_counts(d))
    labels = d.selectExpr("doc_id", "CAST(1 AS INT) AS toxic")
    return toxicity.fit(d.join(toxicity.sampled(labels), "doc_id").select("text", "toxic"), lm)


OPERATORS = {
    "toxicity": lambda d: toxicity.score(d, lm_model(d)),
    "quality": quality.line_quality,
    "packing": lambda d: packing.pack(packing.tokenise(d)),
    "merges": merges.encode,
    "language": lambda d: language.identify(d, language.profiles(d)),
    "sharding": feistel.shard,
    "simhash": simhash.near_duplicates,
    "passages": passages.near_duplicate_passages,
    "cut": passages.remove,
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("name", OPERATORS)
def test_texts(spark, name, case):
    d = spark.createDataFrame(CASES[case], DOCS)
    got = OPERATORS[name](d).collect()
    if name in ("toxicity", "quality", "merges", "language", "sharding", "simhash", "cut"):
        assert len(got) == len(CASES[case])
    elif name == "packing":
        assert sum(r.start == 0 for r in got) == len(CASES[case])


#: Names that the operators use inside, and those that each replaces.
INSIDE = ("_u", "_cuts", "_copied", "_n", "_gone", "_out", "_k1", "_k2", "_key", "_read", "_row", "_group", "_same", "_host", "_h", "_at", "_text", "fp", "task", "shard", "slot", "n", "key", "time")
REPLACED = {"toxicity": ("score",), "quality": quality.ADDED, "merges": ("ids",), "language": ("lang_pred", "score"), "cut": ()}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(spark, name):
    d = spark.createDataFrame(CASES["repeats"], DOCS)
    base = OPERATORS[name](d)
    columns = sorted(base.columns)
    plain = sorted(str({k: r[k] for k in columns}) for r in base.collect()) if name in REPLACED else base.count()
    more = d.select("*", *(F.lit("x").alias(c) for c in dict.fromkeys((*INSIDE, "score", "kept", "ids", "lang_pred", "n_words", "clean_text", "removed_words"))))
    got = OPERATORS[name](more)
    if name not in REPLACED:
        assert got.count() == plain
        return
    rows = got.collect()
    assert all(r[c] == "x" for r in rows for c in INSIDE if c not in REPLACED[name])
    assert sorted(str({k: r[k] for k in columns}) for r in rows) == plain


def test_values_of_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, 0), (3, " \n\t ", "en", "s", 3), (None, "uno due tre", None, "s", 0), (4, "x" * 30_000, "en", "s", 9)]
    d = spark.createDataFrame(rows, DOCS)
    at = lambda df, *c: {r.doc_id: tuple(r[x] for x in c) if len(c) > 1 else r[c[0]] for r in df.collect()}
    assert at(quality.line_quality(d), "n_words", "base_failed", "kept") == {1: (0, True, False), 2: (0, True, False), 3: (0, True, False), None: (3, True, False), 4: (1, True, False)}
    lang = at(language.identify(d, language.profiles(d)), "lang_pred", "score")
    assert lang[1] == lang[2] == lang[3] == ("und", 0.0) and lang[4][0] == "en"
    assert {k: v[0] for k, v in at(language.identify(d, {}), "lang_pred", "score").items()} == dict.fromkeys((1, 2, 3, None, 4), "und")
    encoded = merges.encode(d)
    assert {k: len(v) for k, v in at(encoded, "ids").items() if k in (1, 2)} == {1: 0, 2: 0}
    assert at(merges.decode(encoded.drop("text")), "text") == {1: "", 2: "", 3: " \n\t ", None: "uno due tre", 4: "x" * 30_000}
    pieces = {r.doc_id: r for r in packing.pack(packing.tokenise(d)).collect() if r.start == 0}
    assert [list(pieces[k].ids) for k in (1, 2)] == [[2], [2]] and pieces[4].doc_tokens > 1000
    near = at(simhash.near_duplicates(d), "fp", "component_id")
    assert near[1] == near[2] == near[3] == (0, 1) and near[None][1] is None and near[4][1] == 4
    assert at(passages.remove(d), "text") == {1: None, 2: "", 3: " \n\t ", None: "uno due tre", 4: "x" * 30_000}
    scores = at(toxicity.score(d, lm_model(d)), "score")
    assert scores[1] == scores[2] == scores[3] and all(0 <= v <= 1 for v in scores.values())
    shards = at(feistel.shard(d), "size")
    assert shards == {1: 1, 2: 1, 3: 5, None: 12, 4: 30_001}


def test_vectors_and_pages(spark):
    v = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert neighbours.nearest(v).collect() == []
    same = spark.createDataFrame([(100, [1.0, 2.0])] * 3 + [(7, [1.0, 2.0]), (None, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(same.selectExpr("*", "1 AS score", "2 AS shard")).collect()] == [(100, 1, 7, 0.0)]
    p = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>a b"), (3, "u", "<p>a b")], "page_id bigint, url string, html string")
    got = extraction.extract(p.selectExpr("*", "'x' AS text", "'y' AS n")).collect()
    assert len(got) == 4 and got[0].text == "" and got[1].text == ""
    assert extraction.extract(p.limit(0)).collect() == []


@pytest.mark.parametrize("case", CASES)
def test_stages(spark, case, tmp_path):
    d = spark.createDataFrame(CASES[case], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, d, "")
        if name != "packing":
            assert got.columns == d.columns, name
        got.collect()


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    copy, passage = prose(120, 1), prose(60, 2)
    rows = [(i, prose(150, 10 + i), "en", f"s{i % 3}", 0) for i in range(40)] + [(100 + i, copy, "en", "s0", 0) for i in range(5)]
    rows += [(200 + i, f"{prose(80, 300 + i)} {passage} {prose(40, 400 + i)}", "en", "s1", 0) for i in range(5)] + [(300, "too short", "en", "s1", 0), (301, "1 2 3 " * 30, "en", "s1", 0)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == {*range(40), 100, *range(200, 205)}
    whole, cut = (sum(r.length for r in pieces if r.doc_id in ids) for ids in ({0}, {200, 201, 202, 203, 204}))
    assert cut < 5 * (whole * 1.4)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_dedup", "substring_dedup", "packing"]
