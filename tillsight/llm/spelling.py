"""Spelling variants: words one edit apart, found by a positional q-gram index with the count filter.

Padded with ``q - 1`` signs on both sides, a word of length L has L + q - 1 grams, and one inserted, deleted or replaced code point
touches at most ``q`` of them. So two words one edit apart share at least ``max(L, M) - 1`` grams, at places that differ by one at
most: the same distance from the start before the edit, from the end after it.

The index is distributed by keys (gram, side, distance from that side). A word is posted under its rarest grams alone, as many
as it takes that two of them do not overlap: then no edit touches all, so the rarest gram that the edit spares is among them, in both
words, and every pair meets. A block of words under one key is small as a rule; one of over ``HOT`` words is posted again
under a second spared gram and so on (the same argument holds for the grams left over), until blocks are small or ``DEPTH`` grams
are fixed, which leaves no more words than the alphabet allows. Inside a block the shortest posting lists of a word's grams are
heap-merged under the length and position limits, partners that reach the overlap bound are kept, and those are verified. Nothing
is capped.

Texts are counted a batch at a time, so a frequent word is one row a batch. The table of gram counts has at most 92^3 rows (90
letters and two signs), so it may pass through the driver.

Defined cases: a null or empty text has no words; a null id counts as the id ``null`` in the hash that deletes letters; words of any length
take part; equal rows count each; ties of forms go to the smallest word in code-point order; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from heapq import merge
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import materialise

Q, LEAST_LENGTH, LEAST_COUNT, DROP_EVERY, HOT, DEPTH = 3, 5, 3, 97, 2_000, 4
_RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_FLUSH = 200_000


def words_of_text(doc_id, text: str, drop_every: int = DROP_EVERY) -> Counter:
    """Words of one text: lower-cased runs, of which one in ``drop_every`` by hash loses a letter; ``drop_every=0`` takes none."""
    head, out = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode()), Counter()
    for w, n in Counter(_RUN.findall(text.encode().translate(_LOWER).decode())).items():
        h = zlib.crc32(w.encode(), head)
        if drop_every and h % drop_every == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        out[w] += n
    return out


def _counted(least_length: int, drop_every: int):
    def flushed(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(total.keys()), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text := text.as_py():
                    for w, n in words_of_text(doc_id, text, drop_every).items():
                        if len(w) >= least_length:
                            total[w] += n
                    if len(total) > _FLUSH:
                        yield flushed(total)
                        total = Counter()
        yield flushed(total)

    return run


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of the words long and frequent enough, over whole texts."""
    slim = docs.select(F.col(id_col), F.col(text_col)).where(F.col(text_col).isNotNull())
    counts = slim.mapInArrow(_counted(least_length, drop_every), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_count)


def grams(word: str, q: int = Q) -> list[str]:
    padded = "<" * (q - 1) + word + ">" * (q - 1)
    return [padded[i : i + q] for i in range(len(word) + q - 1)]


def _gram_counts(q: int):
    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for w in batch.column(0).to_pylist():
                total.update(grams(w, q))
        yield pa.RecordBatch.from_pydict({"gram": pa.array(list(total.keys()), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return run


def posted(word: str, used: list[int], counts: dict[str, int], q: int = Q) -> list[int]:
    """Places of the rarest grams not used yet, as many as it takes that no single edit touches all: two that do not overlap."""
    all_grams, taken = grams(word, q), set(used)
    out = []
    for i in sorted((i for i in range(len(all_grams)) if i not in taken), key=lambda i: (counts.get(all_grams[i], 0), all_grams[i], i)):
        out.append(i)
        if max(out) - min(out) >= q:
            break
    return out


def _posting(counts, q: int):
    """Rows of the index, one deeper than the rows given: ``counts`` is a broadcast dict."""
    def run(batches):
        known = counts.value
        for batch in batches:
            out = {"key": [], "word": [], "n": [], "used": []}
            for key, word, n, used in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "used")), strict=True):
                all_grams = grams(word, q)
                for i in posted(word, used, known, q):
                    for side, place in (("s", i), ("e", len(all_grams) - 1 - i)):
                        out["key"].append(xxhash.xxh64_intdigest(f"{key}/{side}{place}{all_grams[i]}") - (1 << 63))
                        out["word"].append(word)
                        out["n"].append(n)
                        out["used"].append([*used, i])
            yield pa.RecordBatch.from_pydict({"key": pa.array(out["key"], pa.int64()), "word": pa.array(out["word"], pa.string()), "n": pa.array(out["n"], pa.int64()), "used": pa.array(out["used"], pa.list_(pa.int32()))})

    return run


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_in_block(words: list[str], q: int = Q) -> list[tuple[str, str]]:
    """Pairs of ``words`` one edit apart.

    Of a word's posting lists, the ``q + 1`` shortest are merged by heap under the length and position limits: a partner misses
    at most ``q`` of the word's grams, so it is in one of those. The other lists, the long ones, are only asked for the
    partners found, and those that reach the overlap bound are verified.
    """
    words = sorted(set(words), key=lambda w: (len(w), w))
    own, lengths, lists = [grams(w, q) for w in words], [len(w) for w in words], defaultdict(list)
    # A posting is one number: the word's place in the block, then the gram's place in the word.
    bits = (lengths[-1] + q).bit_length()
    mask = (1 << bits) - 1
    for j, all_grams in enumerate(own):
        for posting, g in enumerate(all_grams, j << bits):
            lists[g].append(posting)
    held: dict[int, dict[str, list[int]]] = {}

    def places(k: int) -> dict[str, list[int]]:
        if (found := held.get(k)) is None:
            found = held[k] = defaultdict(list)
            for place, g in enumerate(own[k]):
                found[g].append(place)
        return found

    out = []
    # Words are in order of length: a pair is found from its first word, whose partners are those after it up to one longer.
    for j, word in enumerate(words):
        end = bisect_left(lengths, len(word) + 2)
        if end <= j + 1:
            continue
        mine, first, last, runs = own[j], (j + 1) << bits, end << bits, []
        by_length = sorted(range(len(mine)), key=lambda i: len(lists[mine[i]]))
        short, long = by_length[: q + 1], by_length[q + 1 :]
        for i in short:
            posting = lists[mine[i]]
            at = bisect_left(posting, first)
            if at < len(posting) and (run := [x >> bits for x in posting[at : bisect_left(posting, last, at)] if -1 <= (x & mask) - i <= 1]):
                runs.append(run)
        for k, run in groupby(merge(*runs) if len(runs) > 1 else runs[0] if runs else ()):
            shared, need = sum(1 for _ in run), lengths[k] - 1
            spare = shared + len(long) - need  # so many of the long lists may miss
            if spare < len(long):
                there = places(k)
                for i in long:
                    if (at := there.get(mine[i])) is None or not any(-1 <= p - i <= 1 for p in at):
                        spare -= 1
                        if spare < 0:
                            break
            if spare >= 0 and one_edit(word, words[k]):
                out.append((word, words[k]))
    return out


def _near(q: int):
    def run(batches):
        for batch in batches:
            out = {"word": [], "near": [], "near_n": []}
            for block in batch.column(0).to_pylist():
                n_of = {x["word"]: x["n"] for x in block}
                for a, b in near_in_block(list(n_of), q):
                    out["word"] += [a, b]
                    out["near"] += [b, a]
                    out["near_n"] += [n_of[b], n_of[a]]
            yield pa.RecordBatch.from_pydict({"word": pa.array(out["word"], pa.string()), "near": pa.array(out["near"], pa.string()), "near_n": pa.array(out["near_n"], pa.int64())})

    return run


def near_words(vocab: DataFrame, q: int = Q, hot: int = HOT, depth: int = DEPTH) -> DataFrame:
    """``(word, near, near_n)`` for all pairs of ``vocab(word, n)`` one edit apart, in both directions, each once."""
    spark = vocab.sparkSession
    counted = vocab.select("word").mapInArrow(_gram_counts(q), "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = spark.sparkContext.broadcast({r.gram: r.n for r in counted.toLocalIterator()})  # at most 92^q rows
    rows, found = vocab.select(F.lit(0).cast("bigint").alias("key"), "word", "n", F.array().cast("array<int>").alias("used")), None
    for level in range(1, depth + 1):
        rows = materialise(rows.select("key", "word", "n", "used").mapInArrow(_posting(counts, q), "key bigint, word string, n bigint, used array<int>"), "postings")
        sizes = rows.groupBy("key").agg(F.count("*").alias("_size")).where("_size > 1")
        last = level == depth
        small = rows.join(sizes if last else sizes.where(F.col("_size") <= hot), "key")
        blocks = small.groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("block")).select("block")
        pairs = blocks.mapInArrow(_near(q), "word string, near string, near_n bigint")
        found = pairs if found is None else found.union(pairs)
        large = sizes.where(F.col("_size") > hot)
        if last or large.isEmpty():
            break
        rows = rows.join(large, "key").drop("_size")
    return found.distinct()


def variants(vocab: DataFrame, q: int = Q, hot: int = HOT, depth: int = DEPTH) -> DataFrame:
    """``vocab(word, n)`` with n_near, form, form_n and root."""
    near = near_words(vocab, q, hot, depth)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best"))
    joined = vocab.join(best, "word", "left").withColumn("form_n", -F.col("best.m"))
    is_form = F.coalesce(F.col("form_n") >= 2 * F.col("n"), F.lit(False))
    forms = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
    # A form is at least twice as frequent as its word, so chains have under 63 links and double in six jumps.
    to = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(7):
        ahead = to.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        to = materialise(to.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if to.where("moved").isEmpty():
            break
        to = to.drop("moved")
    return forms.join(to.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


ORACLE = r"""
WITH tab AS (SELECT list(v ORDER BY i) AS v FROM (SELECT i, list_reduce(range(0, 8), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(3988292384, s >> 1) ELSE s >> 1 END, i) AS v FROM range(0, 256) r(i))),
runs AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
own AS (SELECT id, w, count(*) AS n, hex(encode(id || ':' || w)) AS h FROM runs GROUP BY id, w),
crc AS (SELECT w, n, xor(list_reduce(range(0, len(h) // 2), lambda s, k: xor(tab.v[1 + xor(s & 255, ('0x' || h[2 * k + 1:2 * k + 2])::BIGINT)], s >> 8), 4294967295::BIGINT), 4294967295::BIGINT) AS c FROM own, tab),
dropped AS (SELECT CASE WHEN c % 97 = 0 THEN substr(w, 1, CAST(c % length(w) AS BIGINT)) || substr(w, CAST(c % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM crc),
vocab AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM dropped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM vocab)),
near AS MATERIALIZED (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocab b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocab b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({'m': -near_n, 'w': near}) AS b FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 2 * v.n THEN b.w END AS form, CASE WHEN -b.m >= 2 * v.n THEN -b.m END AS form_n FROM vocab v LEFT JOIN best USING (word)),
chain AS (WITH RECURSIVE c(word, here) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM c JOIN forms f ON f.word = c.here WHERE f.form IS NOT NULL) SELECT * FROM c)
SELECT f.word, f.form, c.here AS root, f.n, f.n_near, f.form_n FROM forms f JOIN (SELECT c.word, c.here FROM chain c JOIN forms f ON f.word = c.here WHERE f.form IS NULL) c ON c.word = f.word"""
