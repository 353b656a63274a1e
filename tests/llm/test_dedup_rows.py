"""The near-duplicate stage keeps one row of each group, whatever the ids."""

import corpus_pipeline
from tests.llm.test_corpus_operators import DOCS, prose


def test_null_and_reused_ids_lose_no_text(spark):
    texts = {k: prose(120, 700 + k) for k in range(8)}
    rows = [
        (None, texts[0], "en", "s", 0), (None, texts[1], "en", "s", 0), (None, texts[2], "en", None, 0),  # other texts without an id
        (5, texts[3], "en", "s", 0), (5, texts[4], "en", "s", 0),  # two texts under one id
        (1, texts[5], "en", "s", 0), (7, texts[5], "en", "s", 0), (7, texts[6], "en", "s", 0),  # one of id 7 is a copy
        (9, texts[7], "en", "s", 0), (9, texts[7], "en", "s", 0), (None, texts[7], "en", "s", 0),  # equal rows, and one without an id
    ]
    got = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(r.text for r in got) == sorted(texts.values())
    ids = {r.text: r.doc_id for r in got}
    assert [ids[texts[k]] for k in range(8)] == [None, None, None, 5, 5, 1, 7, 9]
