"""Near-duplicate passages by compact windows over token min-hashes.

Tokens are 5-word shingles (A-Z lower-cased). For each of ``FNS`` hash functions a Cartesian tree over the
tokens' hashes yields compact windows ``(l, c, r)``: every run of tokens within ``[l, r]`` that spans ``c`` has
its min-hash at ``c``. Nodes narrower than a passage of ``MIN_WORDS`` words are left out, so there are about
2n / width a function. Within a document the windows of each two functions are joined as intervals: a joint
window stands for all passages that share both min-hashes, and the two hashes are its key. Keys tell of a window
only its min-hash, so the windows of many texts are read off sliding minima at once.

Texts that share a key meet in its group. A group is not expanded into pairs: each member is paired with the
group's least and greatest text (by hashed text), first within a task and then over the tasks, so a key that a
third of all texts hold brings one or two rows a task to any place. Pairs are verified on their whole texts:
exact runs by the hashes of all runs of ``WIDTH`` tokens, near ones by chaining matched tokens into
passages of at least ``MIN_WORDS`` words with a Jaccard similarity of 0.8 or more.

A text may match its partners over a run and yet share the passage with another member only. Where a run of
``SEED`` matched tokens is explained by no passage (a near-duplicate of 0.8 always holds a longer one), the texts
meet again on longer keys around it: all functions' min-hashes together, and hashes of exact runs of ``RUN`` tokens
on a fixed grid, one of which any exact repeat of a whole passage shares. Where even such a run stays unexplained,
a third pass takes every run of ``WIDTH`` tokens around it, whose holders do share a whole passage. Nothing is
capped at any pass.

Defined cases: null, empty and short texts have no windows and pass unchanged; equal rows (same id and text) are
one document; copies of one text under several ids are one text, whose least id represents it; repeats inside one
document alone are not reported; an empty table gives an empty result; extra columns are carried through
``remove``, whatever their names; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import fresh, materialise, words_of

SHINGLE, MIN_WORDS, SIMILAR, FNS = 5, 50, 0.8, 4
WIDTH = MIN_WORDS - SHINGLE + 1
GRID = 4
RUN = WIDTH - GRID + 1
SEED, CELL = 16, 16
#: Keys that a task holds at once, and bytes of text whose keys make one bucket.
HELD, BUCKET_BYTES = 1_500_000, 12_000_000
#: Bytes of text that are turned into tokens at once.
STRETCH = 1 << 18
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        for k, x in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(2 * n, x, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


def _sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums of ``x`` weighted by powers: a run's hash is a difference, shifted back by the inverse power."""
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * _powers(len(x) + 1)[0][: len(x)], out=out[1:])
    return out


def _rolled(x: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` elements."""
    if len(x) < width:
        return np.empty(0, np.uint64)
    c = _sums(x)
    return _mix((c[width:] - c[:-width]) * _POWERS[1][: len(x) - width + 1])


def tokens_of(texts: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of its 5-word shingles, in order; A-Z counts as a-z, words end at white space."""
    bounds = np.cumsum([0, *map(len, texts)])
    raw = np.frombuffer(b"".join(texts).translate(_LOWER), np.uint8)
    word = (raw != 32) & ((raw < 9) | (raw > 13))
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    stops[:-1] &= ~word[1:]
    heads, tails = bounds[:-1][bounds[:-1] < len(raw)], bounds[1:][bounds[1:] > 0] - 1
    begins[heads], stops[tails] = word[heads], word[tails]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    if not len(start):
        return [np.empty(0, np.uint64)] * len(texts)
    c = _sums(raw.astype(np.uint64) + _U(1))
    words = _mix(((c[end] - c[start]) * _POWERS[1][start]) ^ _mix((end - start).astype(np.uint64)))
    shingles, at = _rolled(words, SHINGLE), np.searchsorted(start, bounds).tolist()
    return [shingles[x : max(x, y - SHINGLE + 1)] for x, y in zip(at[:-1], at[1:], strict=True)]


def tokens(text: str | None) -> np.ndarray:
    """Those of one text."""
    return tokens_of([(text or "").encode("utf-8", "replace")])[0]


def _tokenised(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Where each stretch of some ``STRETCH`` bytes of ``texts`` begins, and its texts' tokens."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts.cast(pa.binary()).to_pylist()):
        held.append(text)
        size += len(text)
        if size >= STRETCH or k + 1 == len(texts):
            yield first, tokens_of(held)
            held, size, first = [], 0, k + 1


def _least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least element of every run of ``width``."""
    at, least, reach = np.arange(len(values)), values, 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[:-step], at[step:]
        at = np.where(least[step:] < least[:-step], right, left)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return at


def compact_windows(values: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(l, c, r)`` of the Cartesian tree's nodes that span at least ``width`` places, by c; ties split at the first.

    Such nodes are just the places of the least elements of runs of ``width``, and the nodes above one are
    among them; so the tree is built over these places alone, with a stack.
    """
    if len(values) < width:
        return (np.empty(0, np.int64),) * 3
    own = _least_places(values, width)
    c = own[np.r_[True, own[1:] != own[:-1]]]
    least, left, right, stack = values[c].tolist(), [0] * len(c), [len(values) - 1] * len(c), []
    for k, (x, place) in enumerate(zip(least, c.tolist(), strict=True)):
        while stack and least[stack[-1]] > x:
            right[stack.pop()] = place - 1
        left[k] = int(c[stack[-1]]) + 1 if stack else 0
        stack.append(k)
    return np.array(left), c, np.array(right)


_SEEDS = _mix(np.arange(1, FNS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def _least_hashes(s: np.ndarray, width: int = WIDTH) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each function: where its windows begin among the starts of runs of ``width``, their places and min-hashes."""
    out = []
    for seed in _SEEDS:
        v = _mix(s ^ seed)
        left, c, _ = compact_windows(v, width)
        out.append((np.maximum(left, c - width + 1), c, v[c]))
    return out


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of ``width`` values."""
    least, reach = values, 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least


def joint_keys(texts: list[np.ndarray], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the joint windows of each two functions, and the place in ``texts`` of the text of each.

    Of a compact window a key takes the min-hash and where it begins among the starts of runs of ``width``: where the
    least of a run differs from that of the run before. So all texts' windows are read off sliding minima at once.
    """
    own = [k for k, s in enumerate(texts) if len(s) >= width]
    if not own:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    s, sizes = np.concatenate([texts[k] for k in own]), np.array([len(texts[k]) for k in own])
    ends = np.cumsum(sizes)
    n = len(s) - width + 1
    whole, head = np.ones(n, bool), np.zeros(n, bool)  # of every start: whether its run ends in the same text, and is its first
    across = (ends[:-1, None] - np.arange(1, width)).ravel()
    whole[across] = False
    head[ends - sizes] = True
    least, begins, keys, places = [], [], [], []
    for seed in _SEEDS:
        m = _minima(_mix(s ^ seed), width)
        begin = head.copy()
        begin[1:] |= m[1:] != m[:-1]
        least.append(m), begins.append(begin & whole)
    for f in range(FNS):
        for g in range(f + 1, FNS):
            at = np.flatnonzero(begins[f] | begins[g])  # a joint window begins where either does
            keys.append(_mix(least[f][at] ^ _mix(least[g][at] + _U(FNS * f + g))))
            places.append(at)
    return np.concatenate(keys), np.array(own)[np.searchsorted(ends, np.concatenate(places), "right")]


def _around(cells: np.ndarray, n: int, width: int) -> np.ndarray:
    """Starts of runs of ``width``, among ``n``, that meet one of ``cells``."""
    near = np.zeros(n + 1, np.int64)
    np.add.at(near, np.clip(cells * CELL - width + 1, 0, n), 1)
    np.add.at(near, np.clip((cells + 1) * CELL, 0, n), -1)
    return np.flatnonzero(np.cumsum(near[:-1]) > 0)


def longer_keys(s: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Around ``cells``: keys of all functions together, and of exact runs of ``RUN`` tokens on a grid about each anchor."""
    if len(s) < WIDTH:
        return np.empty(0, np.uint64)
    starts, least, runs = _around(cells, len(s) - WIDTH + 1, WIDTH), _least_hashes(s), _rolled(s, RUN)
    every = np.zeros(len(starts), np.uint64)
    for a, _, x in least:
        every = _mix(every ^ x[np.searchsorted(a, starts, "right") - 1])
    a, c, _ = least[0]
    anchors = np.unique(c[np.searchsorted(a, starts, "right") - 1])
    at = starts_of(anchors, WIDTH, GRID)
    return np.unique(np.concatenate([every, runs[at[(at >= 0) & (at < len(runs))]]]))


def whole_keys(s: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Keys of all exact runs of ``WIDTH`` tokens that meet ``cells``."""
    runs = _rolled(s, WIDTH)
    return np.unique(runs[_around(cells, len(runs), WIDTH)])


def _each(keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[..., tuple[np.ndarray, np.ndarray]]:
    """``keys_of(tokens, cells)`` for many texts: the keys, and the place of the text of each."""

    def run(texts: list[np.ndarray], cells: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        found = [keys_of(s, np.array(c)) for s, c in zip(texts, cells, strict=True)]
        return np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])

    return run


def starts_of(places: np.ndarray, reach: int, step: int) -> np.ndarray:
    """Starts of runs on a grid of ``step`` places, less than ``reach`` before one of ``places``."""
    return np.unique((places[:, None] - np.arange(0, reach, step)).ravel())


def _runs(i: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch in which ``i`` and the others go up by one."""
    if not len(i):
        return (np.empty(0, np.int64),) * 2
    breaks = np.ones(len(i) + 1, bool)
    breaks[1:-1] = i[1:] - i[:-1] != 1
    for x in others:
        breaks[1:-1] |= x[1:] - x[:-1] != 1
    cut = np.flatnonzero(breaks)
    return cut[:-1], cut[1:] - 1


def _sorted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of ``x`` in order of its values, equal ones in their own order; the values; whether each is the last of its kind."""
    order = np.argsort(x)
    values = x[order]
    last = np.ones(len(x), bool)
    last[:-1] = values[1:] != values[:-1]
    if not last.all():
        order = np.argsort(x, kind="stable")
    return order, values, last


def _sought(by_value: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``x`` the first place among the sorted values that is not less, the last one at most; whether it is the same."""
    order, low = np.argsort(x), np.empty(len(x), np.int64)
    low[order] = np.searchsorted(by_value[1], x[order])  # sorted ones are sought faster
    low = np.minimum(low, len(by_value[1]) - 1)
    return low, by_value[1][low] == x


def _aligned(a: np.ndarray, b: np.ndarray, by_value: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each token of ``a`` a place in ``b`` (-1: none); repeated ones follow the diagonal of their neighbours."""
    low, held = _sought(by_value, a)
    at = np.where(held, by_value[0][low], -1)
    lone = held & by_value[2][low]
    many = held & ~lone
    if many.any() and lone.any():
        place = np.arange(len(a))
        before = np.maximum.accumulate(np.where(lone, place, -1))
        after = np.minimum.accumulate(np.where(lone, place, len(a))[::-1])[::-1]
        for near, known in ((np.minimum(after, len(a) - 1), after < len(a)), (np.maximum(before, 0), before >= 0)):  # the token before has the last word
            j = place - (place - at)[near]
            ok = many & known & (j >= 0) & (j < len(b))
            ok &= b[np.minimum(np.maximum(j, 0), len(b) - 1)] == a
            at = np.where(ok, j, at)
    return at


def indexed(b: np.ndarray, width: int = WIDTH) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
    """What ``chain`` asks of its second text: its tokens by value, and its runs of ``width`` tokens by value."""
    return _sorted(b), _sorted(_rolled(b, width))


def chain(a: np.ndarray, b: np.ndarray, min_words: int = MIN_WORDS, similar: float = SIMILAR, index: tuple | None = None) -> tuple[list[tuple[int, int, int, int, float]], np.ndarray, np.ndarray]:
    """Passages ``(start, end, start in b, end in b, similarity)`` in words, ends exclusive; and what they leave.

    The rest is the places, in a and in b, of matched tokens within no passage. Every exact run counts whatever
    its diagonal, so texts that repeat one phrase can't break it. A passage within those found is left out.
    """
    found, covered, none = [], np.zeros(len(a), bool), np.empty(0, np.int64)
    if not len(a) or not len(b):
        return found, none, none
    width = min_words - SHINGLE + 1
    by_value, runs = index or indexed(b, width)
    at = _aligned(a, b, by_value)
    i = np.flatnonzero(at >= 0)
    if len(i) < similar * width:  # a passage has at least as many matches
        return found, i, at[i]
    first, last = _runs(i)
    inside = [np.arange(x, y - width + 2) for x, y in zip(i[first].tolist(), i[last].tolist(), strict=True) if y - x + 1 >= width] if len(runs[0]) else []
    if inside:  # only there all tokens of a run are matched
        i = np.concatenate(inside)
        low, same = _sought(runs, _rolled(a, width)[i])
        i, j = i[same], runs[0][low[same]]
        for x, y in zip(*_runs(i, j), strict=True):
            s, e, t = int(i[x]), int(i[y]) + width, int(j[x])
            at[s:e], covered[s:e] = np.arange(t, t + e - s), True
            found.append((s, e + SHINGLE - 1, t, t + e - s + SHINGLE - 1, 1.0))
    i = np.flatnonzero(at >= 0)
    j = at[i]
    steps = j[1:] - j[:-1]
    wide = np.maximum(i[1:] - i[:-1], steps)
    ends = np.concatenate([[0], np.flatnonzero((wide > 2 * SHINGLE + 1) | (steps < 1)) + 1, [len(i)]])
    long = np.flatnonzero(i[ends[1:] - 1] - i[ends[:-1]] + SHINGLE >= min_words)
    todo = list(zip(ends[long].tolist(), ends[long + 1].tolist(), strict=True))
    while todo:
        x, y = todo.pop()
        la, lb, m = int(i[y - 1] - i[x] + 1), int(j[y - 1] - j[x] + 1), y - x
        if la + SHINGLE - 1 < min_words or covered[i[x] : i[y - 1] + 1].all():
            continue
        s = m / (la + lb - m)
        if s >= similar:
            covered[i[x] : i[y - 1] + 1] = True
            found.append((int(i[x]), int(i[y - 1]) + SHINGLE, int(j[x]), int(j[y - 1]) + SHINGLE, s))
            continue
        gaps = wide[x : y - 1]
        if len(gaps) and gaps.max() > 1:
            k = x + int(gaps.argmax()) + 1
            todo += [(x, k), (k, y)]
    # Overlapping alignments of one stretch are one passage.
    out: list[tuple[int, int, int, int, float]] = []
    for x in sorted(found):
        if out and x[0] < out[-1][1]:
            s, e, vs, ve, sim = out[-1]
            out[-1] = (s, max(e, x[1]), min(vs, x[2]), max(ve, x[3]), min(sim, x[4]))
        else:
            out.append(x)
    left = i[~covered[i]]
    return out, left, at[left]


def _paired(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, text), in order; whether each is its key's first, and the places of its key's first and last."""
    order = np.argsort(keys)
    keys = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    shared = np.flatnonzero(same[1:] | same[:-1])  # most keys have one text
    order[shared] = order[shared][np.lexsort((texts[order[shared]], keys[shared]))]
    texts = texts[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1])] if len(keys) else np.empty(0, bool)
    keys, texts = keys[new], texts[new]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    size = np.diff(np.r_[head, len(keys)])
    return keys, texts, np.repeat(head, size), np.repeat(head + size - 1, size)


def _combined(keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same groups with the least and the greatest text alone; what each other pairs with has keys of its own."""
    keys, texts, first, last = _paired(keys, texts)
    place = np.arange(len(keys))
    mid = np.flatnonzero((place != first) & (place != last))
    out = [(keys[(place == first) | (place == last)], texts[(place == first) | (place == last)])]
    for end in (first, last):
        own = _mix(keys[mid] ^ _mix(texts[mid].view(np.uint64) ^ _mix(texts[end[mid]].view(np.uint64))))
        out += [(own, texts[mid]), (own, texts[end[mid]])]
    return np.concatenate([k for k, _ in out]), np.concatenate([t for _, t in out])


def _met(rows: DataFrame, keys_of: Callable[..., tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """Pairs ``(_u, _v)``, the greater text first, of the groups of ``rows(_u, text, ...)`` by ``keys_of(texts' tokens, ...)``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, held = [], [], 0

        def flush():
            k, t = _combined(np.concatenate(keys), np.concatenate(texts))
            order = np.argsort(k)  # by key: as many bytes a key however many buckets there are
            k, t = k[order], t[order]
            bucket = (((k >> _U(32)) * _U(buckets)) >> _U(32)).view(np.int64)  # goes up with the key
            at = np.flatnonzero(np.r_[True, np.diff(bucket) > 0])
            offsets = pa.array(np.r_[at, len(k)].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (k.view(np.int64), t)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[at]), *lists], ["bucket", "keys", "texts"])

        for batch in batches:
            u = batch.column(0).to_numpy()
            for first, some in _tokenised(batch.column(1)):
                k, place = keys_of(some, *(c.slice(first, len(some)).to_pylist() for c in batch.columns[2:]))
                if len(k):
                    keys.append(k), texts.append(u[first + place])
                    held += len(k)
                if held >= HELD:
                    yield flush()
                    keys, texts, held = [], [], 0
        if held:
            yield flush()

    def pairs(group: pa.Table) -> pa.Table:
        keys = np.concatenate([x.values.to_numpy() for x in group["keys"].chunks]).view(np.uint64)
        _, t, first, last = _paired(keys, np.concatenate([x.values.to_numpy() for x in group["texts"].chunks]))
        place = np.arange(len(t))
        u = np.concatenate([t[place != first], t[last[(place != first) & (place != last)]]])
        v = np.concatenate([t[first[place != first]], t[(place != first) & (place != last)]])
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.ones(len(u), bool)
        new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
        return pa.table({"_u": u[new], "_v": v[new]})

    return rows.mapInArrow(emit, "bucket bigint, keys array<bigint>, texts array<bigint>").groupBy("bucket").applyInArrow(pairs, "_u bigint, _v bigint").distinct()


def _written(df: DataFrame, label: str) -> DataFrame:
    """``materialise``; the shuffle files behind the table go once it is written, not when the driver next collects its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        return materialise(df, label)
    finally:
        conf.set(name, before)


def _verify(pairs: DataFrame, texts: DataFrame, least_run: int) -> DataFrame:
    """``(_u, _v, s, e, vs, ve, sim)`` of ``pairs``; rows without ``sim`` are cells ``s`` of ``_u`` that hold unexplained runs."""
    # Both joins take the table as it is, so that it is shuffled once.
    a, b = texts.alias("a"), texts.alias("b")
    both = pairs.alias("p").join(a, F.col("p._u") == F.col("a._u")).join(b, F.col("p._v") == F.col("b._u"))

    def cells(places: np.ndarray, other: np.ndarray) -> list[int]:
        first, last = _runs(places, other)
        long = last - first + 1 >= least_run
        return sorted({c for x, y in zip(places[first[long]].tolist(), places[last[long]].tolist(), strict=True) for c in range(x // CELL, y // CELL + 1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, (np.empty(0, np.uint64), None)
        for batch in batches:
            out, uv = [], [c.to_pylist() for c in batch.columns[:2]]
            texts_b = batch.column(3)
            for first, some in _tokenised(batch.column(2)):
                for k, s in enumerate(some, first):
                    u, v = uv[0][k], uv[1][k]
                    if v != last:  # rows come sorted by it
                        last, t = v, tokens(texts_b[k].as_py())
                        known = t, indexed(t)
                    found, left, right = chain(s, known[0], index=known[1])
                    out += [(u, v, *x) for x in found]
                    if len(left):
                        out += [(x, None, c, None, None, None, None) for x, p, q in ((u, left, right), (v, right, left)) for c in cells(p, q)]
            if out:
                kinds = [pa.int64()] * 6 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["_u", "_v", "s", "e", "vs", "ve", "sim"])

    return both.select("p._u", "p._v", F.col("a._text").alias("_a"), F.col("b._text").alias("_b")).mapInArrow(run, "_u bigint, _v bigint, s bigint, e bigint, vs bigint, ve bigint, sim double")


def _open(verified: DataFrame, *passages: DataFrame) -> DataFrame:
    """``(_u, cells)`` of the unexplained cells that lie in no passage of any partner."""
    inside = F.explode(F.sequence(F.ceil(F.col("s") / CELL), F.greatest(F.floor((F.col("e") - SHINGLE + 1) / CELL) - 1, F.ceil(F.col("s") / CELL)))).alias("s")
    known = None
    for p in passages:
        for u, s, e in (("_u", "s", "e"), ("_v", "vs", "ve")):
            one = p.select(F.col(u).alias("_u"), F.col(s).alias("s"), F.col(e).alias("e")).distinct().select("_u", inside)
            known = one if known is None else known.union(one)
    return verified.where("sim IS NULL").select("_u", "s").distinct().join(known.distinct(), ["_u", "s"], "left_anti").groupBy("_u").agg(F.collect_list("s").alias("cells"))


def spans(keyed: DataFrame, n_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Verified passages ``(_u, _v, s, e, vs, ve, sim)`` of texts ``_u`` that the lesser ``_v`` also holds, and the texts.

    ``keyed`` is ``(_u, _id, _text)``. The second table has ``(_u, _text)`` of every text of a pair or with copies.
    """
    buckets = max(1, -(-n_bytes // BUCKET_BYTES))
    pairs = _written(_met(keyed.select("_u", "_text"), joint_keys, buckets), "passages-pairs")
    copies = keyed.groupBy("_u").agg(F.count_distinct(F.struct("_id")).alias("n")).where("n > 1").select("_u")
    need = pairs.select("_u").union(pairs.select("_v")).union(copies).distinct()
    texts = _written(keyed.select("_u", "_text").join(need, "_u", "left_semi").dropDuplicates(["_u"]), "passages-texts")
    first = _written(_verify(pairs, texts, SEED), "passages-first")
    passages = first.where("sim IS NOT NULL")

    again = texts.join(_open(first, passages), "_u").select("_u", "_text", "cells")
    pairs2 = _written(_met(again, _each(longer_keys), buckets).join(pairs, ["_u", "_v"], "left_anti"), "passages-pairs2")
    second = _written(_verify(pairs2, texts, RUN), "passages-second")
    more = second.where("sim IS NOT NULL")

    last = texts.join(_open(second, passages, more), "_u").select("_u", "_text", "cells")
    pairs3 = _written(_met(last, _each(whole_keys), buckets).join(pairs.union(pairs2), ["_u", "_v"], "left_anti"), "passages-pairs3")
    third = _verify(pairs3, texts, WIDTH).where("sim IS NOT NULL")
    return _written(passages.union(more).union(third), "passages-all"), texts


def _size(docs: DataFrame, text: Column) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint")).first()[0]


def _halves(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def with_text_key(docs: DataFrame, u: str, text_col: str = "text", halves_of=_halves) -> DataFrame:
    """``docs`` with ``u``, a number that differing texts never share.

    Texts are told apart by 128 bits. ``u`` is the first half; where differing texts share it, all but the one with the
    least second half are numbered anew. At 10^10 texts some three pairs do, so the table of such halves is nearly always empty.
    """
    first, second = halves_of(F.coalesce(F.col(text_col), F.lit("")))
    halves = docs.select(first.alias("_a"), second.alias("_b")).groupBy("_a").agg(F.min("_b").alias("_least"), F.max("_b").alias("_most"))
    shared = _written(halves.where("_least <> _most").select("_a", "_least"), "passages-shared-halves")
    a, least = fresh(docs, "_a", "_least")
    met = docs.join(shared.withColumnsRenamed({"_a": a, "_least": least}), first == F.col(a), "left")
    return met.withColumn(u, F.when(F.col(least).isNull() | (F.col(least) == second), first).otherwise(F.xxhash64(F.lit("other"), first, second))).select(*docs.columns, u)


def _found(keyed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Passages of ``keyed(_u, _id, _text)``, representatives ``(_u, _rep)`` of all texts, and ``(_u, _rep, n)`` of texts with whole copies."""
    found, texts = spans(keyed, _size(keyed, F.col("_text")))
    # Of all texts: joined with those that matter first, copies of one text would meet in one task before they are counted.
    reps = _written(keyed.select("_u", "_id").distinct().groupBy("_u").agg(F.min("_id").alias("_rep"), F.count("*").alias("ids")), "passages-reps")
    n = F.size(words_of(F.col("_text"))).cast("bigint").alias("n")
    copied = texts.join(reps.where("ids > 1"), "_u").select("_u", "_rep", n).where(F.col("n") >= MIN_WORDS)
    return found, reps, _written(copied, "passages-copied")


def _keyed(docs: DataFrame, u: str, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(u).alias("_u"), F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def near_duplicate_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a passage: ``(doc_id, start_word, n_words, rep_doc_id, rep_start_word, similarity)``.

    A representative's own passages are rows whose rep_doc_id is their doc_id. A copy of a whole text is one
    passage of all its words.
    """
    slim = with_text_key(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_u", "_text")
    found, reps, copied = _found(_keyed(slim, "_u", "_id", "_text"))
    whole = slim.select("_u", "_id").distinct().join(copied, "_u")
    own = found.groupBy(F.col("_v").alias("_u"), "_v", F.col("vs").alias("s")).agg(F.max("ve").alias("e")).withColumns({"vs": F.col("s"), "sim": F.lit(1.0)})
    rows = found.select("_u", "_v", "s", "e", "vs", "sim").unionByName(own.select("_u", "_v", "s", "e", "vs", "sim"))
    rows = rows.join(reps.select(F.col("_u").alias("_v"), F.col("_rep").alias("rep_doc_id")), "_v").join(reps.select("_u", F.col("_rep").alias("doc_id")), "_u")
    rows = rows.select("doc_id", F.col("s").alias("start_word"), (F.col("e") - F.col("s")).alias("n_words"), "rep_doc_id", F.col("vs").alias("rep_start_word"), F.col("sim").alias("similarity"))
    return rows.unionByName(whole.select(F.col("_id").alias("doc_id"), F.lit(0).cast("bigint").alias("start_word"), F.col("n").alias("n_words"), F.col("_rep").alias("rep_doc_id"), F.lit(0).cast("bigint").alias("rep_start_word"), F.lit(1.0).alias("similarity")))


def _cut(text: str, ranges: list[tuple[int, int]]) -> str:
    import re

    places = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, at, last = [], 0, 0
    for s, e in sorted(ranges):
        s = max(s, last)
        if e <= s:
            continue
        out.append(text[at : places[s][0]])
        at = places[e][0] if e < len(places) else len(text)
        last = e
    return ("".join(out) + text[at:]).strip()


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every passage cut that a representative document keeps; of copies the one with the least id keeps it."""
    keep = list(docs.columns)
    u, cuts, first, n = fresh(docs, "_u", "_cuts", "_first", "_n")
    docs_u = with_text_key(docs, u, text_col)
    found, _, copies = _found(_keyed(docs_u, u, id_col, text_col))
    # One table of all that is cut from a text, so that the texts are joined once.
    spans_of = found.groupBy("_u").agg(F.collect_set(F.struct("s", "e")).alias(cuts))
    copied = copies.select("_u", F.struct(F.col("_rep").alias("id")).alias(first), F.col("n").alias(n))
    out = spans_of.join(copied, "_u", "full_outer").withColumnRenamed("_u", u)
    lesser = F.col(first).isNotNull() & ~F.col(id_col).eqNullSafe(F.col(first)["id"])
    joined = docs_u.join(out, u, "left").select(*keep, cuts, F.when(lesser, F.col(n)).alias(n))
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(at).to_pylist(), batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True)
            texts = [_cut(t, [(0, w)] if w else [(x["s"], x["e"]) for x in c]) if t is not None and (c or w) else t for t, c, w in rows]
            cols = [*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 : len(keep)]]
            yield pa.RecordBatch.from_arrays(cols, keep)

    return joined.mapInArrow(run, docs.schema)
