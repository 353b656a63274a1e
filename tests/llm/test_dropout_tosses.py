"""Each candidate merge of each unit of each document has a toss of its own."""

import numpy as np
import pytest

from tillsight.llm import merges


@pytest.fixture(scope="module")
def codec():
    return merges.codec(merges.default_model())


def test_one_word_varies_over_documents_and_places(codec):
    n = 4000
    got = codec.encode(["international"] * n, merges._mix(np.arange(n).astype(np.uint64)), 3, 0.3)
    assert len({tuple(x.tolist()) for x in got}) > 32 and {codec.decode(x) for x in got} == {"international"}
    places = codec.encode(["international " * n], np.ones(1, np.uint64), 3, 0.3)[0]
    words = "".join("|" * codec.pieces[i].startswith(merges.BLANK) + f" {i}" for i in places.tolist()).split("|")
    assert len(set(words)) > 32


def test_rate_is_the_dropout(codec):
    # A word of one merge: the share of occurrences that stay apart is the rate at which it is skipped.
    n = 20_000
    pair = next(w for w in ("an", "in", "er", "on", "at", "en") if codec.encode([w], np.zeros(1, np.uint64), 1, 0.0)[0].size == 1)
    pool, at, size = codec.segment([pair], merges._mix(np.arange(n).astype(np.uint64)), 0.1, np.zeros(n, np.int64))
    whole = codec.encode([pair + " " + pair] * n, merges._mix(np.arange(n).astype(np.uint64)), 1, 0.1)
    assert abs((size == 2).mean() - 0.1) < 0.01
    assert len({tuple(x.tolist()) for x in whole}) > 3


def test_shared_rows_equal_single_ones(codec):
    units = [merges.BLANK + w for w in ("international", "straightforward", "an", "日x①", "thethethe", "x" * 120)]
    of = np.random.default_rng(0).integers(0, len(units), 900)
    of[: len(units)] = np.arange(len(units))
    keys = merges._mix(np.arange(900).astype(np.uint64))
    pool, at, size = codec.segment(units, keys, 0.25, of)
    for k in range(900):
        one, a, s = codec.segment([units[of[k]]], keys[k : k + 1], 0.25)
        assert one[a[0] : a[0] + s[0]].tolist() == pool[at[k] : at[k] + size[k]].tolist()
