"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between block-level tags. Each block has the tags and class words
of its ancestors and features of its text (length, links, stops). Two labels, main text and the rest, form a
chain; weights are fitted by gradient on pages with known labels, and Viterbi decodes a page.

The labelled pages are made here (``labelled_pages``): layouts of many kinds, each block marked as it is
written, with text of random syllables so that only structure and shape are learnt, no language or
site. In half of them nothing around the article tells what it is, so that a page without an ``article`` element or
a known word is read by its text and by what the other boxes are.

A page of any depth takes time in its length: features are counted as elements open and close, and a path's score is a running sum.

Defined cases: a null or empty page, or one without main text, gives an empty text; broken or unclosed markup is
read as far as it goes, to the end of the page; ties between paths go to the rest; equal rows give equal
texts; an empty table gives an empty result; extra columns are carried through. No page or block is cut short.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import fresh

#: Fixed values of HTML: elements that end a line of text, whose content isn't text, and that close each other.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style title textarea".split())
SKIPPED = frozenset("noscript template iframe svg select object audio video canvas button".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article aside section div form main nav body".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|([^>]*)(?:>|\Z))|<[/!?][^>]*>", re.S)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_ATTR = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-zA-Z][a-z]*")
_SPACE = re.compile(r"\s+")  # also no-break and wide blanks


def _tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """``(start, end, tag, closes, attributes)`` of all markup in order; what isn't a tag has no name.

    An element whose content isn't text is one entry up to its own end tag. Raw text without an end tag goes on
    to the end of the page; any other such element without one is its start tag alone.
    """
    found, open_at, ends, at, drawn = [], {}, {}, 0, 0
    while m := _TOKEN.search(page, at):
        start, at = m.span()
        tag, closes, attrs = (m[2] or "").lower(), bool(m[1]), m[3] if m[3] is not None else m[4] or ""
        alone = attrs.endswith("/")
        if tag in RAW and not closes and not (drawn and alone):  # a drawing's own elements may end at "/>"
            end = _RAW_END[tag].search(page, at)
            tag, at = "", end.end() if end else len(page)
        elif tag in SKIPPED and closes:
            if open_at.get(tag):
                ends[open_at[tag].pop()] = len(found)
            drawn -= tag == "svg" and drawn > 0
        elif tag in SKIPPED and not (tag == "svg" and alone):
            open_at.setdefault(tag, []).append(len(found))
            drawn += tag == "svg"
        elif m[3] is None:
            tag = ""
        found.append((start, at, tag, closes, attrs))
    out, k = [], 0
    while k < len(found):
        last = ends.get(k, k)
        out.append(found[k] if last == k else (found[k][0], found[last][1], "", False, ""))
        k = last + 1
    return out


class _Path:
    """Open elements of a page, with what they say of the blocks inside: features counted as elements open and close.

    With ``weights``, ``score`` is the sum of the path's features; weights are multiples of 2^-20, so it is exact however long
    features come and go. No step costs more than the element it opens or closes.
    """

    def __init__(self, weights: dict[str, float] | None = None):
        self.stack: list[tuple[str, frozenset, tuple]] = []
        self.open: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]
        self.counts: dict[str, int] = {}
        self.weights, self.score = weights, 0.0

    def push(self, tag: str, names: frozenset) -> None:
        said = (f"in:{tag}", *(f"word:{w}" for w in names), *(f"{box}>{tag}" for box in ("article", "main") if self.open.get(box)))
        for f in said:
            n = self.counts[f] = self.counts.get(f, 0) + 1
            if n == 1 and self.weights:
                self.score += self.weights.get(f, 0.0)
        self.stack.append((tag, names, said))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1
        if tag in SCOPES:
            self.scopes.append({})

    def pop(self) -> str:
        tag, _, said = self.stack.pop()
        for f in said:
            self.counts[f] -= 1
            if not self.counts[f]:
                del self.counts[f]
                if self.weights:
                    self.score -= self.weights.get(f, 0.0)
        if tag in SCOPES:
            self.scopes.pop()
        self.open[tag] -= 1
        self.scopes[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        if self.open.get(tag):
            while self.pop() != tag:
                pass

    def end_siblings(self, tag: str) -> None:
        """What the start of ``tag`` ends: an open paragraph, and open siblings in the same scope."""
        if self.stack and self.stack[-1][0] == "p":
            self.pop()
        ends = SIBLINGS.get(tag, ())
        if any(self.scopes[-1].get(t) for t in ends):
            # The last sibling of the scope and all that is open in it.
            at = len(self.stack) - 1
            while self.stack[at][0] not in ends:
                at -= 1
            while len(self.stack) > at:
                self.pop()

    def own(self) -> tuple[str, ...]:
        """Features of the innermost element alone."""
        return (f"tag:{self.stack[-1][0]}", *(f"own:{w}" for w in self.stack[-1][1])) if self.stack else ()

    def features(self) -> tuple[str, ...]:
        return tuple(sorted({*self.counts, *self.own()}))


def _walk(page: str | None, path: _Path) -> Iterator[tuple[str, int]]:
    """``(text, characters in links)`` of each leaf block in order, while ``path`` holds the elements it lies in."""
    parts, state = [], [0, 0]  # state: characters in links, open links

    def flush():
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        linked = state[0]
        parts.clear()
        state[0] = state[1] = 0
        return (text, linked) if text else None

    def text_of(s):
        if s:
            parts.append(s)
            if state[1]:
                state[0] += len(s)

    page, at = page or "", 0
    for start, end, tag, close, attrs in _tags(page):
        if start > at:
            text_of(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "a":
            state[1] = 0 if close else 1
        elif tag in ("br", "wbr"):
            parts.append(" ")
        elif tag in BLOCK:
            if found := flush():
                yield found
            if close:
                path.close(tag)
                continue
            path.end_siblings(tag)
            if tag != "hr":
                path.push(tag, frozenset(w.lower() for a in _ATTR.findall(attrs) for w in _NAME.findall("".join(a))) if attrs else frozenset())
    if at < len(page):
        text_of(page[at:])
    if found := flush():
        yield found


def _shape(text: str, linked: int) -> list[str]:
    n = len(text)
    shape = ["bias", f"len:{min(n.bit_length(), 11)}", f"link:{min(4, 5 * linked // max(n, 1))}", f"stops:{min(3, sum(text.count(c) for c in '.!?'))}"]
    if text[-1] in ".!?\"”»":
        shape.append("ends")
    if "©" in text[:3]:
        shape.append("copyright")
    return shape


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """``(features of its elements, text, characters in links)`` of each leaf block, in order."""
    path = _Path()
    return [(path.features(), text, linked) for text, linked in _walk(page, path)]


def block_features(inside: tuple[str, ...], text: str, linked: int) -> tuple[str, ...]:
    return (*inside, *_shape(text, linked))


class Field:
    """A chain of two labels: a weight a feature, and four transitions."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray):
        self.weights, self.moves = {f: round(w * 2**20) / 2**20 for f, w in weights.items()}, moves

    def decode(self, rows: list[tuple[str, ...]]) -> list[int]:
        return self.best([sum(self.weights.get(f, 0.0) for f in row) for row in rows])

    def best(self, scores: list[float]) -> list[int]:
        """The likeliest labels of a chain whose blocks have these scores as main text: Viterbi."""
        if not scores:
            return []
        (t00, t01), (t10, t11) = self.moves.tolist()
        back, a, b = [], 0.0, None
        for s in scores:
            if b is None:
                a, b = 0.0, s
                continue
            from0, from1 = (a + t00 >= b + t10), (a + t01 >= b + t11)
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + t00 if from0 else b + t10), (a + t01 if from1 else b + t11) + s
        y = [1 if b > a else 0]
        for ways in reversed(back):
            y.append(ways[y[-1]])
        return y[::-1]


def train(pages: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 200, penalty: float = 0.005, support: int = 1) -> Field:
    """Maximum penalised likelihood by Adam; forward and backward sums over all pages at once. A feature needs ``support`` pages."""
    seen_on = Counter(f for rows, _ in pages for f in {f for r in rows for f in r})
    names = sorted(f for f, n in seen_on.items() if n >= support)
    index = {f: i for i, f in enumerate(names)}
    n, long = len(pages), max(len(r) for r, _ in pages)
    x = np.zeros((n, long, len(names)), np.float32)
    y, live = np.zeros((n, long), int), np.zeros((n, long), bool)
    for p, (rows, labels) in enumerate(pages):
        live[p, : len(rows)] = True
        y[p, : len(rows)] = labels
        for k, r in enumerate(rows):
            x[p, k, [index[f] for f in r if f in index]] = 1
    flat = x.reshape(-1, len(names))
    both = live[:, 1:] & live[:, :-1]
    seen = np.array([[(both & (y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    theta = np.zeros(len(names) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        s = (flat @ theta[:-4].astype(np.float32)).reshape(n, long).astype(float)
        score = np.stack([np.zeros_like(s), s], -1) * live[..., None]
        moves = theta[-4:].reshape(2, 2)
        f, g = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        f[:, 0] = score[:, 0]
        for k in range(1, long):
            f[:, k] = np.where(live[:, k, None], np.logaddexp(f[:, k - 1, :1] + moves[0], f[:, k - 1, 1:] + moves[1]) + score[:, k], f[:, k - 1])
        for k in range(long - 2, -1, -1):
            after = score[:, k + 1] + g[:, k + 1]
            step = np.logaddexp(moves[:, 0] + after[:, :1], moves[:, 1] + after[:, 1:])
            g[:, k] = np.where(live[:, k + 1, None], step, 0.0)
        z = np.logaddexp(f[:, -1, 0], f[:, -1, 1])
        p1 = np.exp(f[..., 1] + g[..., 1] - z[:, None]) * live
        pair = np.exp(f[:, :-1, :, None] + moves + (score + g)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
        grad = np.r_[flat.T @ (p1 - y * live).ravel().astype(np.float32), (pair.sum((0, 1)) - seen).ravel()] / n + penalty * theta / 10
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(dict(zip(names, theta[:-4].tolist(), strict=True)), theta[-4:].reshape(2, 2))


_MAIN_BOX = ["article", "main", "div.content", "div.post", "div.entry-content", "section.story", "div#main", "div.article-body", "div.text"]
_BOXES = {
    "nav": ["nav", "div.menu", "ul.nav", "div#navigation", "div.breadcrumbs", "nav.site-nav", "div.navbar", "div.toc"],
    "header": ["header", "div.header", "div#header", "div.masthead", "div.topbar", "header.site-header"],
    "footer": ["footer", "div.footer", "div#footer", "div.copyright", "footer.site-footer", "div.legal"],
    "side": ["aside", "div.sidebar", "div#sidebar", "aside.related", "div.widget", "section.related-posts", "div.recommended", "div.popular"],
    "notice": ["div.cookie-notice", "div.notice", "div.alert", "div.banner", "div.consent", "div#gdpr", "section.notice", "div.popup", "div.disclaimer", "dialog"],
    "ad": ["div.ad", "div.advert", "div.ads", "aside.sponsored", "div.promo", "div.advertisement", "section.sponsor", "div#banner-ad"],
    "form": ["form", "form.search", "div.login", "div.newsletter", "form.subscribe", "form.contact", "div.signup", "fieldset"],
    "comment": ["div.comments", "section.comments", "div#comments", "ol.comment-list", "div.comment", "section.discussion", "div.replies", "article.comment", "div.reader-comments"],
    "share": ["div.share", "div.social", "ul.share-links", "div.author-bio", "div.tags", "div.pagination"],
}


def _tag(spec: str, rng: Random) -> tuple[str, str]:
    name = re.match(r"\w+", spec)[0]
    attrs = "".join(f' {"class" if k == "." else "id"}="{v}"' for k, v in re.findall(r"([.#])([\w-]+)", spec))
    return f"<{name}{attrs}>", f"</{name}>"


#: So many of the pages made for training have an article whose boxes say nothing: text alone, and what the other boxes are, must tell.
PLAIN = 0.5
#: A name that fewer pages have teaches nothing about others.
SUPPORT = 4


def _plain_box(rng: Random, name: str) -> tuple[str, str]:
    """Starts and ends of boxes without a telling tag or word around an article; also none at all."""
    said = rng.choice(["", f' class="{name}"', f' id="{name}"'])
    return rng.choice([("", ""), (f"<div{said}>", "</div>"), (f"<section{said}>", "</section>"), (f"<div><div{said}>", "</div></div>"), (f"<table><tr><td{said}>", "</td></tr></table>"), (f"<center><div{said}>", "</div></center>")])


def labelled_pages(n: int = 400, seed: int = 5) -> list[tuple[str, list[int]]]:
    """Pages and the label of each leaf block (1: main text)."""
    rng, made = Random(seed), []
    syllables = [a + b for a in "bdfklmnprst" for b in "aeiou"]

    def sentence(k):
        s = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(k))
        return s.capitalize() + rng.choice([".", ".", ".", "!", "?", "", ","])

    for _ in range(n):
        parts: list[str] = []
        labels: list[int] = []

        def block(tag, text, label, link=False):
            parts.append(f"<{tag}>" + (f'<a href="/x">{text}</a>' if link else text) + (f"</{tag}>" if rng.random() < 0.9 else ""))
            labels.append(label)

        def box(kind, rows=None):
            spec = rng.choice(_BOXES[kind])
            start, end = _tag(spec, rng)
            parts.append(start)
            links = kind in ("nav", "side", "share", "footer") and rng.random() < 0.7
            for _ in range(rows or rng.randint(1, 5)):
                wide = kind in ("comment", "notice", "ad", "side") or rng.random() < 0.3
                text = ("© " if kind == "footer" and rng.random() < 0.5 else "") + sentence(rng.randint(1, 40 if wide else 6))
                block(rng.choice(["p", "li", "div", "p"]) if rng.random() < 0.8 else "h3", text, 0, links)
            parts.append(end)

        if rng.random() < 0.8:
            box("nav")
        for kind in ("header", "ad", "notice", "form"):
            if rng.random() < 0.4:
                box(kind, rng.randint(1, 2))
        if rng.random() < PLAIN:
            start, end = _plain_box(rng, "".join(rng.choices(syllables, k=rng.randint(1, 3))))
        else:
            start, end = _tag(rng.choice(_MAIN_BOX) if rng.random() < 0.6 else "article", rng)
        wrap = rng.choice(["", "", "<main>", '<div class="page">', '<div id="wrapper">'])
        parts.append(wrap + start)
        head = rng.random() < 0.3
        parts.append("<header>" * head)
        block("h1", sentence(rng.randint(1, 12)), 1)
        parts.append("</header>" * head)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 12])):
            kind = rng.random()
            if kind < 0.06:
                box(rng.choice(["ad", "side", "share", "form", "notice"]), rng.randint(1, 2))
            elif kind < 0.14:
                block(rng.choice(["h2", "h3"]), sentence(rng.randint(1, 8)), 1)
            elif kind < 0.24:
                tag = rng.choice(["ul", "ol"])
                parts.append(f"<{tag}>")
                for _ in range(rng.randint(1, 4)):
                    block("li", sentence(rng.randint(1, 15)), 1, rng.random() < 0.1)
                parts.append(f"</{tag}>")
            elif kind < 0.32:
                tag = rng.choice(["blockquote", "figure", "pre", "table"])
                parts.append(f"<{tag}>")
                block({"figure": "figcaption", "table": "td"}.get(tag, "p"), sentence(rng.randint(1, 25)), 1)
                parts.append(f"</{tag}>")
            else:
                block(rng.choice(["p", "p", "p", "div"]), sentence(rng.choice([1, 2, 5, 20, 60, 150])), 1)
        if rng.random() < 0.25:
            box("comment")
        parts.append(end + ("</main>" if wrap == "<main>" else "</div>" if wrap else ""))
        for kind, p in (("comment", 0.4), ("side", 0.4), ("share", 0.2), ("ad", 0.2), ("form", 0.2), ("notice", 0.2), ("footer", 0.8)):
            if rng.random() < p:
                box(kind)
        made.append(("<html><body>" + "".join(parts) + ("</body></html>" if rng.random() < 0.9 else ""), labels))
    return made


def fitted(n: int = 400, seed: int = 5) -> Field:
    """The field trained on ``labelled_pages``."""
    pages = []
    for page, labels in labelled_pages(n, seed):
        rows = [block_features(*b) for b in blocks(page)]
        if len(rows) == len(labels):
            pages.append((rows, labels))
    return train(pages, support=SUPPORT)


def main_text(page: str | None, field: Field) -> str:
    path, get = _Path(field.weights), field.weights.get
    found = [(text, path.score + sum(get(f, 0.0) for f in (*path.own(), *_shape(text, linked)))) for text, linked in _walk(page, path)]
    return "\n".join(text for (text, _), y in zip(found, field.best([s for _, s in found]), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``carry``) with ``text``, the main text of the whole page."""
    from pyspark.sql.types import StringType, StructField, StructType

    model = field or fitted()
    keep = [c for c in (pages.columns if carry is None else carry) if c != "text"]
    slim = pages.select(*keep, F.col(html_col).alias(fresh(pages, "_read")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([main_text(x, model) for x in batch.columns[-1].to_pylist()], pa.string())], [*keep, "text"])

    return slim.mapInArrow(run, StructType([*slim.schema.fields[:-1], StructField("text", StringType())]))
