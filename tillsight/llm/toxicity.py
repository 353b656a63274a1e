"""Toxicity of texts after noisy-channel deobfuscation.

Tokens that may be disguised (digits or symbols among letters, runs of one letter, letters set apart) become
character lattices: a symbol may stand for itself or for letters it resembles, a letter that repeats the last
one may be dropped, a separator between single letters may be dropped. A character language model, counted
over all documents, and the channel's costs weigh the paths; Viterbi finds the best, and the restored words
join the text's plain words. A logistic model over words and word beginnings then scores the document.

Only the text is an input of a score. The model is fitted on at most about ``FIT_ROWS`` labelled rows; the
language model's counts cover every document.

Defined cases: a null or empty text scores as a text without words; documents without a label only miss from
the fit; two labels of one document count as their maximum; without any label, or labels of one kind alone, the
score is the share of toxic labels (0 if none); equal rows score alike; an empty table gives an empty result;
extra columns are carried through, but a column ``score`` is replaced; texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillsight.llm.common import fresh, materialise

FIT_ROWS, FEATURES, SUPPORT, ORDER = 20_000, 600, 4, 4
#: How many n-grams the character model keeps at most; by default all that were counted.
GRAMS: int | None = None
#: Stands for every letter beyond the 16 bits that a letter has in the counts.
_WIDE = "\uffff"
#: What a symbol may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
SUBSTITUTE, REPEAT, DROP, KEEP_SYMBOL = -1.0, -1.2, -0.1, -6.0
_WORD = re.compile(r"[^\W\d_]+")
_SYMBOLS = re.escape("".join(LEET))
_LEETED = re.compile(rf"(?<![\w{_SYMBOLS}])(?=[{_SYMBOLS}]*[^\W\d_])(?=[^\W\d_]*[{_SYMBOLS}])(?:[^\W\d_]|[{_SYMBOLS}]){{3,}}(?!\w)")
_RUN = re.compile(r"[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*")
_APART = re.compile(rf"(?<!\w)(?:(?:[^\W\d_]|[{_SYMBOLS}])[ .\-_*]){{2,}}[^\W\d_](?!\w)")
_SEPARATORS = frozenset(" .-_*")


#: This process's models by their content, so that a worker keeps what it has worked out from one task to the next.
_MODELS: dict[str, object] = {}


def _same(key: str, kind: type, *parts):
    """The model of this content, made from its parts where the process has none."""
    if key not in _MODELS:
        if len(_MODELS) >= 8:
            _MODELS.clear()
        _MODELS[key] = kind(*parts)
    return _MODELS[key]


class CharModel:
    """Interpolated character n-grams within words; ``^`` opens and ``$`` closes a word."""

    def __init__(self, counts: dict[str, int], order: int = ORDER):
        self.order, self.n = order, counts
        self.key = hashlib.sha256(repr((order, sorted(counts.items()))).encode("utf-8", "backslashreplace")).hexdigest()
        self.context = Counter()
        for g, c in counts.items():
            self.context[g[:-1]] += c
        self.memo: dict[tuple[str, str], float] = {}
        self.restored: dict[str, str] = {}

    def __reduce__(self):
        return _same, (self.key, CharModel, self.n, self.order)

    def __call__(self, context: str, c: str) -> float:
        key = (context, c)
        if (found := self.memo.get(key)) is None:
            p = 1e-4
            context, c = ("".join(x if x < _WIDE else _WIDE for x in y) for y in (context, c))
            for k in range(len(context) + 1):  # from no context to the longest
                ctx = context[len(context) - k :]
                total = self.context.get(ctx, 0)
                if total:
                    p = (self.n.get(ctx + c, 0) + 5 * p) / (total + 5)
            if len(self.memo) > 500_000:
                self.memo.clear()
            found = self.memo[key] = math.log(p)
        return found


def restore(token: str, lm: CharModel) -> str:
    """The likeliest plain word behind ``token`` (lower case); exact Viterbi over the lattice."""
    span = lm.order - 1
    best: dict[str, tuple[float, tuple | None]] = {"^": (0.0, None)}
    for c in token.lower():
        after: dict[str, tuple[float, tuple | None]] = {}

        def put(state, score, back):
            if state not in after or score > after[state][0]:
                after[state] = (score, back)

        for state, (score, back) in best.items():
            if c in _SEPARATORS:
                put(state, score + DROP, back)
                continue
            ways = [(x, SUBSTITUTE) for x in LEET.get(c, "")]
            ways.append((c, 0.0 if c.isalpha() else KEEP_SYMBOL))
            for x, cost in ways:
                put((state + x)[-span:], score + cost + lm(state, x), (x, back))
            if c == state[-1] or any(x == state[-1] for x in LEET.get(c, "")):
                put(state, score + REPEAT, back)
        best = after
    score, back = max((s + lm(state, "$"), b) for state, (s, b) in best.items()) if best else (0.0, None)
    out = []
    while back:
        out.append(back[0])
        back = back[1]
    return "".join(reversed(out))


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is a word's letter, and whether a symbol that may stand for one."""
    letter = np.fromiter(((c := chr(i)).isalnum() and not c.isdecimal() for i in range(0x110000)), bool, 0x110000)
    symbol = np.zeros(0x110000, bool)
    symbol[[ord(c) for c in LEET]] = True
    return letter, symbol


def _signs(low: str) -> tuple[bool, bool, bool]:
    """Whether a text holds a letter beside a symbol, two letters that stand alone, and one letter three times in a row.

    Without them no token can be disguised in that way, so most texts are spared the searches for such tokens.
    """
    codes = np.frombuffer(f" {low} ".encode("utf-32-le", "replace"), np.uint32)
    letter, symbol = (k[codes] for k in _kinds())
    beside = (letter[1:] & symbol[:-1]) | (symbol[1:] & letter[:-1])
    alone = letter[1:-1] & ~letter[:-2] & ~letter[2:]
    same = (codes[1:] == codes[:-1]) & letter[1:]
    return bool(beside.any()), np.count_nonzero(alone) > 1, bool((same[1:] & same[:-1]).any())


def _plain(token: str, lm: CharModel) -> str:
    """``restore``, remembered with the model that it depends on."""
    if (r := lm.restored.get(token)) is None:
        if len(lm.restored) > 100_000:
            lm.restored.clear()
        r = lm.restored[token] = restore(token, lm)
    return r


def tokens(text: str | None) -> tuple[Counter, set[str], bool]:
    """The text's words with their counts, its tokens that may be disguised by symbols or blanks, and whether a letter runs."""
    low = (text or "").lower()
    beside, alone, tripled = _signs(low)
    odd = {m.group(0) for m in _LEETED.finditer(low)} if beside else set()
    if alone:
        odd |= {m.group(0) for m in _APART.finditer(low)}
    return Counter(_WORD.findall(low)), odd, tripled


def words(text: str | None, lm: CharModel) -> Counter:
    """Plain words of the text, and restored ones where a token may be disguised."""
    found, odd, tripled = tokens(text)
    for t in odd | ({w for w in found if _RUN.fullmatch(w)} if tripled else set()):
        r = _plain(t, lm)
        if r and r not in found:
            found[r] += 1
    return found


def features(found: Counter) -> Counter:
    """Word and word-beginning counts."""
    out: Counter = Counter()
    for w, n in found.items():
        out[w] += n
        for k in range(4, min(len(w), 9)):
            out[w[:k] + "*"] += n
    return out


def char_counts(docs: DataFrame, text_col: str = "text", order: int = ORDER, most: int | None = GRAMS) -> dict[str, int]:
    """Counts of character n-grams of orders 1 to ``order`` over the words of all documents.

    Summed by Spark from per-task counts over all texts, so what the model holds grows with the corpus as its distinct n-grams
    do, which is slowly (Heaps). ``most`` bounds that number for workers with little memory (``_most_frequent``).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain: Counter = Counter()
            for t in batch.column(0).to_pylist():
                plain.update(_WORD.findall(t.lower()))
            if not plain:
                continue
            # One pass over the longest n-grams; shorter ones are their beginnings. 16 bits a letter.
            tail = "$" * (order - 1)
            codes = np.frombuffer("".join([f"^{w}{tail}" for w in plain]).encode("utf-32-le"), np.uint32).astype(np.uint64)
            codes = np.minimum(codes, np.uint64(ord(_WIDE)))
            weight = np.repeat(np.fromiter(plain.values(), np.int64, len(plain)), np.fromiter(map(len, plain), np.int64, len(plain)) + order)
            key = np.zeros(len(codes) - order + 1, np.uint64)
            for k in range(order):
                key = (key << np.uint64(16)) | codes[k : k + len(key)]
            inside = codes[: len(key)] != ord("$")
            value, at = np.unique(key[inside], return_inverse=True)
            total = np.bincount(at, weights=weight[: len(key)][inside])
            text = value.byteswap().tobytes().decode("utf-16-be", "replace")
            grams: dict[str, int] = {}
            for i, n in enumerate(total.astype(np.int64).tolist()):
                g = text[order * i : order * i + order]
                for k in range(1, order + 1):
                    grams[g[:k]] = grams.get(g[:k], 0) + n
                    if g[k - 1] == "$":
                        break
            yield pa.RecordBatch.from_arrays([pa.array(list(grams)), pa.array(list(grams.values()), pa.int64())], ["g", "n"])

    texts = docs.select(text_col).where(F.col(text_col).isNotNull())
    total = texts.mapInArrow(run, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n"))
    if most is not None:
        total = _most_frequent(materialise(total, "grams"), most)
    pdf = total.toPandas()
    return dict(zip(pdf["g"], pdf["n"].tolist(), strict=True))


def _most_frequent(total: DataFrame, most: int) -> DataFrame:
    """The ``most`` most frequent rows of ``total(g, n)``, or fewer: of those as frequent as the last all stay or go.

    A table of frequencies, by powers of 2^(1/16) and then by number inside one such step, gives the least frequency that
    stays, so no task sorts what all others have found.
    """
    step = F.floor(16 * F.log2("n")).cast("int")
    steps = {r.step: r.c for r in total.groupBy(step.alias("step")).agg(F.count("*").alias("c")).collect()}  # 16 rows a doubling
    kept, least = 0, None
    for at in sorted(steps, reverse=True):
        if kept + steps[at] > most:
            least = at
            break
        kept += steps[at]
    if least is None:
        return total
    fit = total.where(step == least).groupBy("n").agg(F.count("*").alias("c")).withColumn("up_to", F.sum("c").over(Window.orderBy(F.desc("n")))).where(F.col("up_to") <= most - kept)
    bound = fit.agg(F.min("n")).first()[0]
    return total.where((step > least) | (F.col("n") >= bound) if bound is not None else step > least)


class Model:
    def __init__(self, lm: CharModel, names: list[str], weights: np.ndarray, bias: float):
        self.lm, self.at, self.weights, self.bias = lm, {n: i for i, n in enumerate(names)}, weights, bias
        self.heads = {n[:4] for n in names}  # no other word has a feature
        self.key = hashlib.sha256(repr((lm.key, names, list(weights), bias)).encode("utf-8", "backslashreplace")).hexdigest()
        self.memo: dict[str, tuple[int, ...]] = {}

    def __reduce__(self):
        return _same, (self.key, Model, self.lm, list(self.at), self.weights, self.bias)

    def _ids(self, word: str) -> tuple[int, ...]:
        """Features of a word as it stands and, if it holds a run of one letter, of the word behind it."""
        if (ids := self.memo.get(word)) is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            both = {word, _plain(word, self.lm)} if _RUN.fullmatch(word) else {word}
            ids = self.memo[word] = tuple(sorted({self.at[x] for w in both for x in (w, *(w[:k] + "*" for k in range(4, min(len(w), 9)))) if x in self.at}))
        return ids

    def hits(self, text: str | None) -> dict[int, int]:
        """Counts of the chosen features; a word's features are looked up once."""
        out: dict[int, int] = {}
        found, odd, tripled = tokens(text)
        heads, known = self.heads, self.memo.get
        for w, n in found.items():
            if w[:4] in heads or (tripled and _RUN.fullmatch(w)):
                if (ids := known(w)) is None:
                    ids = self._ids(w)
                for i in ids:
                    out[i] = out.get(i, 0) + n
        for t in odd:
            r = _plain(t, self.lm)
            if r not in found:
                for i in self._ids(r):
                    out[i] = out.get(i, 0) + 1
        return out

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[i] * math.log1p(n) for i, n in self.hits(text).items())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the penalised log loss; ``x`` ends with a column of ones."""
    n, d = x.shape
    step = 1 / (0.25 * float(np.linalg.eigvalsh((x.T @ x).astype(float))[-1]) / n + penalty / n)
    w = v = np.zeros(d)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v.astype(np.float32), -30, 30)))
        g = (x.T @ (p - y).astype(np.float32)).astype(float) / n + np.r_[v[:-1], 0] * penalty / n
        new = v - step * g
        v, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def sampled(labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """At most about ``rows`` labelled ids ``(doc_id, toxic)``, by hashed id; labels other than 0 and 1 go."""
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    total = one.count()
    return one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, rows / max(total, 1)) * 1_000_000))


def fit(labelled: DataFrame, lm: CharModel, size: int = FEATURES) -> Model:
    """The model from ``labelled(text, toxic)``, a bounded sample."""
    kinds = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total, bad = sum(kinds.values()), kinds.get(1, 0)
    if not bad or bad == total:
        share = bad / total if total else 0.0
        return Model(lm, [], np.zeros(0), math.log(share / (1 - share)) if 0 < share < 1 else (30.0 if share else -30.0))
    slim = labelled.select("text", F.col("toxic").cast("int").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = (Counter(), Counter())
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(features(words(text, lm)).keys())
            names = [*seen[0].keys() | seen[1].keys()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[0][x] for x in names], pa.int64()), pa.array([seen[1][x] for x in names], pa.int64())], ["f", "n0", "n1"])

    counts = slim.mapInArrow(count, "f string, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n1") + F.col("n0") >= SUPPORT)
    rate = F.col("n1") / float(bad) - F.col("n0") / float(total - bad)
    spread = F.sqrt((F.col("n0") + F.col("n1") + 2.0) / float(total))
    best = counts.orderBy(F.desc(F.abs(rate) / spread), "f").limit(size).select("f").collect()
    model = Model(lm, sorted(r.f for r in best), np.zeros(0), 0.0)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [model.hits(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([list(h) for h in hits], pa.list_(pa.int32())), pa.array([list(h.values()) for h in hits], pa.list_(pa.int32())), batch.column(1)], ["i", "n", "y"])

    pdf = slim.mapInArrow(vectors, "i array<int>, n array<int>, y int").toPandas()
    x = np.zeros((len(pdf), len(model.at) + 1), np.float32)
    x[:, -1] = 1
    for k, (i, n) in enumerate(zip(pdf["i"], pdf["n"], strict=True)):
        x[k, i] = np.log1p(n)
    weights, bias = logistic(x, pdf["y"].to_numpy(float))
    return Model(lm, list(model.at), weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``score``, the probability of label 1."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    keep = [c for c in (docs.columns if carry is None else carry) if c != "score"]
    slim = docs.select(*keep, F.col(text_col).alias(fresh(docs, "_read")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([model.score(t) for t in batch.columns[-1].to_pylist()], pa.float64())], [*keep, "score"])

    return slim.mapInArrow(run, StructType([*slim.schema.fields[:-1], StructField("score", DoubleType())]))
