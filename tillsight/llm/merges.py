"""SentencePiece BPE with seeded merge-dropout, and decoding.

Blanks become U+2581 and one goes in front. Pieces never join a character with a blank after it, so a text
falls into units (blanks and what follows them) that are segmented alone. A unit's adjacent pieces whose
joint is a piece are an agenda: best score first, leftmost on ties. Each candidate taken from it is skipped
when a hash of (seed, document, place of the unit in the text, place in the unit, joint) falls below the dropout,
else merged. Characters without a piece are spelt as bytes. ``decode`` gives back the text exactly.

Many units are segmented at once as rows of a matrix, one agenda step a round for each; units of more than
``WIDE`` characters go through a heap. Both take the same steps. Every occurrence of a unit tosses for itself;
those in a task that have skipped and merged alike so far share a row, and part where they differ.

Defined cases: a null or empty text has no ids, and no ids decode to an empty text (null ids to null); U+2581 in a text is spelt as bytes, so that it survives; equal rows
have equal ids; an empty table gives an empty result; extra columns are carried through; texts are
encoded whole.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import fresh

BLANK, WIDE, CHUNK = "▁", 96, 3_000_000
_PAD, _ODD = 65535, 65534
_LITERAL = "\udb80"  # stands for U+2581 in a text; no valid text holds a lone surrogate
_UNITS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_U = np.uint64
_CODECS: dict[str, Codec] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _skipped(key: np.ndarray, place: np.ndarray, joint: np.ndarray, dropout: float) -> np.ndarray:
    h = _mix(key ^ _mix((place.astype(_U) << _U(32)) | joint.astype(_U)))
    return (h >> _U(11)).astype(float) / 2.0**53 < dropout


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
        ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        scores = sorted({sp.get_score(i) for i in range(n)})
        level = {s: k for k, s in enumerate(scores)}
        rank = [level[sp.get_score(i)] for i in range(n)]
        pairs = {}
        for p, i in ids.items():
            for k in range(1, len(p)):
                if (a := ids.get(p[:k])) is not None and (b := ids.get(p[k:])) is not None:
                    pairs[a << 16 | b] = i
        self.first = np.full(0x110000, _ODD, np.int64)
        for c in range(128):
            self.first[c] = self.bytes[c]
        for p, i in ids.items():
            if len(p) == 1:
                self.first[ord(p)] = i
        # Open addressing: a slot holds a pair, its joint and the joint's rank.
        bits = 21
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, -1, np.int64)
        self.slot_id = np.full(1 << bits, _PAD, np.int64)
        self.slot_rank = np.full(1 << bits, -1, np.int32)
        self.probes = 1
        for key, at in zip(pairs, self._slot(np.array(list(pairs), np.int64)).tolist(), strict=True):
            k = 1
            while self.slot_key[at] >= 0:
                at, k = (at + 1) & self.mask, k + 1
            self.probes = max(self.probes, k)
            self.slot_key[at], self.slot_id[at], self.slot_rank[at] = key, pairs[key], rank[pairs[key]]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(_U) * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def joints(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Joint ids (``_PAD``: none) and ranks (-1: none) of adjacent symbols."""
        key = a.astype(np.int64) << 16 | b
        at = self._slot(key)
        found = self.slot_key[at] == key
        for _ in range(self.probes - 1):
            more = ~found & (self.slot_key[at] >= 0)
            if not more.any():
                break
            at = np.where(more, (at + 1) & self.mask, at)
            found = self.slot_key[at] == key
        return np.where(found, self.slot_id[at], _PAD), np.where(found, self.slot_rank[at], -1).astype(np.int32)

    def _rows(self, sym: np.ndarray, of: np.ndarray, key: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Final rows of symbols and their first characters, and each occurrence's row.

        ``sym`` has a unit a row, padded with ``_PAD``; ``of`` and ``key`` are each occurrence's unit and key.
        """
        wide = sym.shape[1]
        start = np.broadcast_to(np.arange(wide, dtype=np.uint8), sym.shape).copy()
        if wide == 1:
            return sym, start, of
        out, out_start, done, final = [], [], 0, np.zeros(len(of), np.int64)
        live, at, cols = np.arange(len(of)), of, np.arange(wide)
        rank = self.joints(sym[:, :-1], sym[:, 1:])[1]

        def closed(x, keep, fill):
            """``x`` without one element a row, padded at the end."""
            y = np.empty_like(x)
            y[:, :-1] = x[keep].reshape(len(x), x.shape[1] - 1)
            y[:, -1] = fill
            return y

        while len(sym):
            col = rank.argmax(1)
            going = rank[np.arange(len(sym)), col] >= 0
            if not going.all():
                out.append(sym[~going]), out_start.append(start[~going])
                place = np.where(going, np.cumsum(going) - 1, done + np.cumsum(~going) - 1)
                done += len(out[-1])
                on, at = going[at], place[at]
                final[live[~on]] = at[~on]
                live, at, key = live[on], at[on], key[on]
                sym, start, rank, col = (x[going] for x in (sym, start, rank, col))
                if not len(sym):
                    break
            row, rest = np.arange(len(sym)), []
            joint = self.joints(sym[row, col], sym[row, col + 1])[0]
            if dropout:
                side = at + len(sym) * _skipped(key, start[row, col][at], joint[at], dropout)
                met = np.zeros(2 * len(sym), bool)
                met[side] = True
                at = (np.cumsum(met) - 1)[side]
                drop, take = np.flatnonzero(met[len(sym) :]), np.flatnonzero(met[: len(sym)])
                rest = [x[drop] for x in (sym, start, rank)]
                rest[2][np.arange(len(drop)), col[drop]] = -1
                sym, start, rank, col, joint = (x[take] for x in (sym, start, rank, col, joint))
            row = np.arange(len(sym))
            sym[row, col] = joint
            gone = cols != (col + 1)[:, None]
            sym, start = closed(sym, gone, _PAD), closed(start, gone, 0)
            rank = closed(rank, cols[:-1] != col[:, None], -1)
            left, right = row[col > 0], row[col < wide - 1]
            rank[left, col[left] - 1] = self.joints(sym[left, col[left] - 1], sym[left, col[left]])[1]
            rank[right, col[right]] = self.joints(sym[right, col[right]], sym[right, col[right] + 1])[1]
            if rest:
                sym, start, rank = (np.concatenate([x, y]) for x, y in zip((sym, start, rank), rest, strict=True))
        return np.concatenate(out), np.concatenate(out_start), final

    def _heap(self, first: np.ndarray, key: np.ndarray, dropout: float) -> tuple[list[int], list[int]]:
        """The same agenda for one long unit."""
        n = len(first)
        sym, after, before, alive = first.tolist(), [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        agenda: list = []

        def offer(i, j):
            if i >= 0 and j >= 0:
                joint, rank = self.joints(np.array([sym[i]]), np.array([sym[j]]))
                if rank[0] >= 0:
                    heapq.heappush(agenda, (-int(rank[0]), i, j, sym[i], sym[j], int(joint[0])))

        ids, ranks = self.joints(first[:-1], first[1:])
        agenda.extend((-int(ranks[i]), i, i + 1, sym[i], sym[i + 1], int(ids[i])) for i in np.flatnonzero(ranks >= 0).tolist())
        heapq.heapify(agenda)
        while agenda:
            _, i, j, a, b, joint = heapq.heappop(agenda)
            if not (alive[i] and alive[j] and after[i] == j and sym[i] == a and sym[j] == b):
                continue
            if dropout and _skipped(key, np.array([i]), np.array([joint]), dropout)[0]:
                continue
            sym[i], alive[j], after[i] = joint, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        keep = [i for i in range(n) if alive[i]]
        return [sym[i] for i in keep], keep

    def segment(self, units: list[str], keys: np.ndarray, dropout: float, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and each occurrence's first place and number there.

        ``keys`` hold what the skipping hash of an occurrence depends on besides place and joint; ``of`` has the
        units that they are occurrences of (by default each unit occurs once). Every unit must occur.
        """
        of = np.arange(len(units)) if of is None else of
        size = np.fromiter(map(len, units), np.int64, len(units))
        first_at, number, pool, held = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64), [np.empty(0, np.int32)], 0

        def put(at, ids):
            nonlocal held
            first_at[at], number[at] = held, len(ids)
            pool.append(ids)
            held += len(ids)

        def spell(ids, starts, unit):
            if _ODD not in ids:
                return np.asarray(ids, np.int32)
            flat: list[int] = []
            for i, s in zip(ids, starts, strict=True):
                flat += [i] if i != _ODD else [self.bytes[b] for b in unit[s].replace(_LITERAL, BLANK).encode("utf-8", "replace")]
            return np.array(flat, np.int32)

        parts = []
        for low, high in ((0, 2), (2, 4), (4, 6), (6, 8), (8, 11), (11, 14), (14, 20), (20, 32), (32, WIDE)):
            mine = np.flatnonzero((size > low) & (size <= high))
            parts += [(high, mine[at : at + 60_000]) for at in range(0, len(mine), 60_000)]
        group, row = np.full(len(units), len(parts)), np.zeros(len(units), np.int64)
        for p, (_, part) in enumerate(parts):
            group[part], row[part] = p, np.arange(len(part))
        order = np.argsort(group[of].astype(np.int16), kind="stable")
        edges = np.searchsorted(group[of][order], np.arange(len(parts) + 1))
        for p, (high, part) in enumerate(parts):
            mine = order[edges[p] : edges[p + 1]]
            codes = np.frombuffer("".join([units[i] for i in part.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32)
            sym = np.full((len(part), high), _PAD, np.int32)
            sym[np.arange(high) < size[part][:, None]] = self.first[codes]
            ids, starts, final = self._rows(sym, row[of[mine]], keys[mine], dropout)
            counts = (ids != _PAD).sum(1)
            flat = ids[ids != _PAD].astype(np.int32)
            first_at[mine], number[mine] = (held + np.cumsum(counts) - counts)[final], counts[final]
            pool.append(flat)
            held += len(flat)
            odd = (ids == _ODD).any(1)
            hit = np.flatnonzero(odd[final]) if odd.any() else np.empty(0, np.int64)
            same: dict[int, int] = {}  # of the rows that are spelt out: an occurrence that has been put
            for k, r in zip(mine[hit].tolist(), final[hit].tolist(), strict=True):
                if r in same:
                    first_at[k], number[k] = first_at[same[r]], number[same[r]]
                    continue
                same[r] = k
                put(k, spell(ids[r, : counts[r]].tolist(), starts[r, : counts[r]].tolist(), units[of[k]]))
        for i in order[edges[-1] :].tolist():
            unit = units[of[i]]
            first = self.first[np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)]
            put(i, spell(*self._heap(first, keys[i : i + 1], dropout), unit))
        return np.concatenate(pool), first_at, number

    def encode(self, texts: list[str | None], doc_keys: np.ndarray, seed: int, dropout: float) -> list[np.ndarray]:
        """Ids of each text; ``doc_keys`` are 64-bit keys of their documents."""
        known: dict[str, int] = {}
        base = _mix(np.array([seed], np.uint64) * _U(0x9E3779B97F4A7C15))[0]
        uids, counts = [], []
        for t in texts:
            units = _UNITS.findall((" " + t).replace(BLANK, _LITERAL).replace(" ", BLANK)) if t else []
            uids.append(np.array([known.setdefault(u, len(known)) for u in units], np.int64))
            counts.append(len(units))
        flat, counts = np.concatenate(uids) if uids else np.empty(0, np.int64), np.array(counts, np.int64)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        keys = _mix(np.repeat(doc_keys, counts) ^ _mix(place.astype(_U) + base))
        if dropout:
            pool, start, n = self.segment(list(known), keys, dropout, flat)
        else:
            pool, start, size = self.segment(list(known), np.zeros(len(known), np.uint64), 0.0)
            start, n = start[flat], size[flat]
        ends = np.cumsum(n)
        ids = pool[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        edge = np.r_[0, ends][np.cumsum(counts)]
        return np.split(ids, edge[:-1]) if len(counts) else []

    def decode(self, ids: np.ndarray | list[int]) -> str:
        parts, raw = [], bytearray()
        for i in np.asarray(ids).tolist():
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                parts.append(raw.decode("utf-8", "replace").replace(BLANK, _LITERAL))
                raw.clear()
            parts.append(self.pieces[i])
        if raw:
            parts.append(raw.decode("utf-8", "replace").replace(BLANK, _LITERAL))
        return "".join(parts).replace(BLANK, " ").replace(_LITERAL, BLANK)[1:]


def codec(path: str) -> Codec:
    """The one codec of this worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, dropout: float = 0.1, seed: int = 7, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``ids``."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    path = model or default_model()
    keep = [c for c in (docs.columns if carry is None else carry) if c != "ids"]
    key, read = fresh(docs, "_key", "_read")
    slim = docs.select(*keep, F.xxhash64(F.lit(seed), F.col(id_col).cast("string")).alias(key), F.col(text_col).alias(read))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts, at = batch.columns[-1].to_pylist(), 0
            keys = batch.columns[-2].to_numpy().view(np.uint64)
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end] or "") <= CHUNK):
                    held += len(texts[end] or "")
                    end += 1
                ids = pa.array(c.encode(texts[at:end], keys[at:end], seed, dropout), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(x.slice(at, end - at) for x in batch.columns[:-2]), ids], [*keep, "ids"])
                at = end

    return slim.mapInArrow(run, StructType([*slim.schema.fields[:-2], StructField("ids", ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``text`` (replaced if there)."""
    from pyspark.sql.types import StringType, StructField, StructType

    path = model or default_model()
    keep = [c for c in encoded.columns if c != "text"]
    slim = encoded.select(*keep)
    at = keep.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*keep, "text"])

    return slim.mapInArrow(run, StructType([*slim.schema.fields, StructField("text", StringType())]))
