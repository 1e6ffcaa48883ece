"""SentencePiece encoding and decoding, with N-best segmentation.

A text becomes ``▁`` + text with ``▁`` for blanks; the pieces of a SentencePiece vocabulary that match
spans of it make a lattice, and a segmentation's score is the sum of its pieces' scores. A forward Viterbi
pass gives, for each position, the best score from the start; a backward A* search from the end uses these
as its (exact) heuristic and yields segmentations best first. A character without a piece is spelt in byte
pieces, at a score below every piece's.

No piece holds ``▁`` after another character, so the lattice is a chain of units (blanks and the letters
after them) with one node between two of them. Units are solved once for each batch and kept; the N best
of a text are merged from its units. Only units whose second-best segmentation is among the N - 1 closest
can take part in the N best, and A* runs on those; their gap is exact from forward and backward scores.

The N best segmentations of a text come as the best one's pieces, and for each its score and its edits: which
pieces of the best are replaced by which (``edited`` applies them), as most of a long text is the same in all.

Ties go to the segmentation that A* meets first. The vocabulary's path is a
parameter; its pieces travel with the job. Edge cases: a null or empty text has no pieces and one
segmentation, of score 0; a ``▁`` in a text is spelt in bytes, so that decoding restores every text
exactly; repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from array import array
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from opweave.llm._text import _powers, mix
from opweave.session import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST, BLANK, UNITS_KEPT = 4, "▁", 500_000
#: Stands for a text's own ``▁`` inside units; a lone surrogate, which no valid text holds.
OWN = "\udfff"


class Vocabulary:
    """Pieces with scores; ``of_file`` reads a SentencePiece model."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int] | None):
        self.pieces = pieces
        self.ids = {p: i for i, (p, s) in enumerate(pieces) if p and s is not None}
        self.scores = [0.0 if s is None else s for _, s in pieces]
        self.byte_ids = byte_ids
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min(self.scores, default=0.0) - 10.0
        self.spelt = [(p or "").replace(BLANK, " ").encode() for p, _ in pieces]
        for b, i in enumerate(byte_ids or ()):
            self.spelt[i] = bytes([b])
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("a piece holds a blank after another character; units would not be separate")

    @classmethod
    def of_file(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        plain = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i)) for i in range(n)]
        return cls([(m.id_to_piece(i), m.get_score(i) if plain[i] else None) for i in range(n)], [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)])


    def ids_of(self, unit: str, steps: list[tuple[int, int]]) -> list[int]:
        """Ids of a path (start, piece or -1); -1 is spelt in bytes."""
        out = []
        for i, k in steps:
            out += [k] if k >= 0 else [self.byte_ids[b] for b in (BLANK if unit[i] == OWN else unit[i]).encode()]
        return out


def units(text: str) -> list[str]:
    """The chain of units of ``▁`` + text; a ``▁`` of the text itself is marked, no piece has that mark."""
    if not text:
        return []
    raw = text.replace(BLANK, OWN).split(" ")
    if "" not in raw:  # single blanks alone
        return [BLANK + w for w in raw]
    out, blanks = [], 1
    for k, w in enumerate(raw):
        if k:
            blanks += 1
        if w:
            out.append(BLANK * blanks + w)
            blanks = 0
    if blanks:
        out.append(BLANK * blanks)
    return out


class Lattice:
    """Arcs of one unit: arcs[j] lists (start, piece id or -1 for bytes, score) of what ends at j."""

    def __init__(self, unit: str, v: Vocabulary):
        self.unit, self.n, self.v = unit, len(unit), v
        self.arcs: list[list[tuple[int, int, float]]] = [[] for _ in range(self.n + 1)]
        get, scores = v.ids.get, v.scores
        for i in range(self.n):
            single = False
            for j in range(i + 1, min(self.n, i + v.longest) + 1):
                k = get(unit[i:j])
                if k is not None:
                    self.arcs[j].append((i, k, scores[k]))
                    single |= j == i + 1
            if not single:
                self.arcs[i + 1].append((i, -1, v.unknown))
        self.forward = [0.0] + [float("-inf")] * self.n
        self.back: list[tuple[int, int] | None] = [None] * (self.n + 1)
        for j in range(1, self.n + 1):
            for i, k, s in self.arcs[j]:
                if self.forward[i] + s > self.forward[j]:
                    self.forward[j], self.back[j] = self.forward[i] + s, (i, k)

    def best(self) -> list[tuple[int, int]]:
        """(start, piece id or -1) from left to right."""
        out, j = [], self.n
        while j:
            out.append(self.back[j])
            j = self.back[j][0]
        return out[::-1]

    def gap(self) -> float:
        """How far the second-best segmentation is behind the best; infinite if there is none."""
        after = [float("-inf")] * self.n + [0.0]
        for j in range(self.n, 0, -1):
            for i, _, s in self.arcs[j]:
                after[i] = max(after[i], after[j] + s)
        path = self.best()
        on = {(i, j) for (i, _), j in zip(path, [i for i, _ in path[1:]] + [self.n])}
        rest = [self.forward[i] + s + after[j] for j in range(1, self.n + 1) for i, _, s in self.arcs[j] if (i, j) not in on]
        return self.forward[-1] - max(rest, default=float("-inf"))

    def n_best(self, n: int) -> list[tuple[float, list[tuple[int, int]]]]:
        """Backward A*: the n best segmentations with their scores, best first. Of paths that promise the same (but
        for rounding) the one that is further on goes first, as else every one of many ties would be begun."""
        tick, out = count(), []
        heap = [(round(-self.forward[-1], 9), self.n, next(tick), 0.0, None)]
        while heap and len(out) < n:
            _, j, _, done, path = heapq.heappop(heap)
            if not j:
                steps = []
                while path:
                    steps.append(path[0])
                    path = path[1]
                out.append((done, steps))
                continue
            for i, k, s in self.arcs[j]:
                heapq.heappush(heap, (round(-(self.forward[i] + s + done), 9), i, next(tick), done + s, ((i, k), path)))
        return out


class Solver:
    """``Lattice`` for many units of one length at once: forward and backward passes over arrays."""

    SLOTS, LONGEST = 1 << 20, 40

    def __init__(self, v: Vocabulary):
        self.v = v
        self.scores = np.array(v.scores)
        self.bytes = np.array(v.byte_ids, np.int64)
        keys, ids = np.empty(len(v.ids), np.uint64), np.array(list(v.ids.values()), np.int64)
        by_length: dict[int, list[int]] = {}
        for at, p in enumerate(v.ids):
            by_length.setdefault(len(p), []).append(at)
        names = list(v.ids)
        for n, at in by_length.items():
            p = self._prefix(self._codes([names[i] for i in at], n))
            keys[at] = self._span(p, 0, n)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have one hash")
        self.tables = []  # of a slot's first, second, ... piece
        slot = (keys & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            key, own = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)
            key[slot[first]], own[slot[first]] = keys[first], ids[first]
            self.tables.append((key, own))
            keys, ids, slot = (np.delete(x, first) for x in (keys, ids, slot))
        self.taken = self.tables[0][1] >= 0 if self.tables else np.zeros(self.SLOTS, bool)

    @staticmethod
    def _codes(units: list[str], n: int) -> np.ndarray:
        return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(units), n)

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        up, _ = _powers(codes.shape[1] + 1)
        p = np.zeros((codes.shape[1] + 1, len(codes)), np.uint64)
        np.cumsum(mix(codes.T.astype(np.uint64) + np.uint64(1)) * up[: codes.shape[1], None], axis=0, out=p[1:])
        return p

    @staticmethod
    def _span(p: np.ndarray, i: int, j: int) -> np.ndarray:
        return mix((p[j] - p[i]) * _powers(len(p))[1][i])

    def _look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are a piece's, and the pieces."""
        slot = (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        at = np.flatnonzero(self.taken[slot])
        slot, h, out = slot[at], h[at], np.full(len(at), -1, np.int32)
        for key, own in self.tables:
            hit = key[slot] == h
            out[hit] = own[slot[hit]]
        return at[out >= 0], out[out >= 0]

    def solve(self, units: list[str]) -> tuple[list[str], list[bytes], np.ndarray, np.ndarray]:
        """The units in an order of its own, and for each: ids of the best segmentation (int32 bytes), its score,
        the gap to the second best."""
        by_length: dict[int, list[str]] = {}
        for u in units:
            by_length.setdefault(len(u), []).append(u)
        order, ids, score, gap = [], [], [np.zeros(0)], [np.zeros(0)]
        for n, all_of in by_length.items():
            for low in range(0, len(all_of), 20_000):
                part = all_of[low : low + 20_000]
                got = zip(*(one(Lattice(u, self.v)) for u in part)) if n > self.LONGEST else self._solve(part, n)
                order += part
                for all_, new in zip((ids, score, gap), got):
                    all_ += list(new) if all_ is ids else [np.array(new, float)]
        return order, ids, np.concatenate(score), np.concatenate(gap)

    def _solve(self, units: list[str], n: int):
        codes, m = self._codes(units, n), len(units)
        p, none = self._prefix(codes), -np.inf
        arc: dict[tuple[int, int], np.ndarray] = {}
        forward, start, piece = np.full((n + 1, m), none), np.zeros((n + 1, m), np.int64), np.zeros((n + 1, m), np.int64)
        forward[0] = 0
        for j in range(1, n + 1):
            for i in range(max(0, j - self.v.longest), j):
                row, k = self._look(self._span(p, i, j))
                s = self.scores[k]
                if i == j - 1:  # a character that is no piece is spelt in bytes
                    row = np.r_[row, bare := np.delete(np.arange(m), row)]
                    k, s = np.r_[k, np.full(len(bare), -1)], np.r_[s, np.full(len(bare), self.v.unknown)]
                arc[i, j] = row, s
                to = forward[i, row] + s
                better = to > forward[j, row]
                row, k = row[better], k[better]
                forward[j, row], start[j, row], piece[j, row] = to[better], i, k
        after = np.full((n + 1, m), none)
        after[n] = 0
        for (i, j), (row, s) in sorted(arc.items(), key=lambda x: -x[0][1]):
            after[i, row] = np.maximum(after[i, row], s + after[j, row])
        came = np.full((n + 1, m), -1)
        at, row = np.full(m, n), np.arange(m)
        while len(row):
            came[at, row] = start[at, row]
            at = start[at, row]
            row, at = row[at > 0], at[at > 0]
        second = np.full(m, none)
        for (i, j), (row, s) in arc.items():
            off = came[j, row] != i
            row = row[off]
            second[row] = np.maximum(second[row], forward[i, row] + s[off] + after[j, row])
        used = (came >= 0).T
        ids, size = piece.T[used], used.sum(axis=1)
        ends = np.cumsum(size)
        last = np.broadcast_to(np.arange(n + 1), used.shape)[used] - 1
        who = np.repeat(np.arange(m), size)
        plain = (ids < 0) & (codes[who, last] < 128)
        ids = np.where(plain, self.bytes[codes[who, last].clip(max=127)], ids).astype(np.int32)
        long = set(who[ids < 0].tolist())
        flat, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        out, best, gap = [flat[a:b] for a, b in zip(cuts, cuts[1:])], forward[n], forward[n] - second
        for r in long:  # letters of several bytes without a piece
            out[r], best[r], gap[r] = one(Lattice(units[r], self.v))
        return out, best, gap


def one(lattice: Lattice) -> tuple[bytes, float, float]:
    return np.array(lattice.v.ids_of(lattice.unit, lattice.best()), np.int32).tobytes(), lattice.forward[-1], lattice.gap()


class Encoder:
    """Units that were solved are kept as rows: ids (as bytes), score, gap to the second best."""

    def __init__(self, v: Vocabulary, n: int = N_BEST):
        self.v, self.n, self.ranked = v, n, {}
        self.solver = Solver(v)
        self._forget()

    def _forget(self) -> None:
        self.row, self.ids, self.score, self.gap = {}, [], array("d"), array("d")

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, list[tuple[float, list[tuple[int, int, list[int]]]]]]]:
        """For each text the ids of its best segmentation, and its N best as (score, edits)."""
        chains = [units(t) for t in texts]
        new = set().union(*chains).difference(self.row) if chains else set()
        if len(self.row) + len(new) > UNITS_KEPT:
            self._forget()
            new = set().union(*chains)
        order, ids, score, gap = self.solver.solve(list(new))
        self.row.update(zip(order, range(len(self.ids), len(self.ids) + len(order))))
        self.ids += ids
        self.score.frombytes(score.tobytes())
        self.gap.frombytes(gap.tobytes())
        flat = list(map(self.row.__getitem__, chain.from_iterable(chains)))
        at = np.array(flat, np.int64)
        pieces = list(map(self.ids.__getitem__, flat))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) // 4  # four bytes a piece
        every = np.frombuffer(b"".join(pieces), np.int32)
        score, gap = (np.frombuffer(x, float)[at] if len(x) else np.zeros(0) for x in (self.score, self.gap))
        out, low = [], 0
        for c in chains:
            high = low + len(c)
            first = int(ends[low - 1]) if low else 0
            out.append((every[first : int(ends[high - 1]) if high else 0], self._merged(c, float(score[low:high].sum()), gap[low:high], ends[low:high] - first)))
            low = high
        return out

    def encode(self, text: str) -> tuple[np.ndarray, list[tuple[float, list]]]:
        return self.encode_all([text])[0]

    def _ranked(self, unit: str) -> list[tuple[float, list[int]]]:
        """A unit's N best segmentations, as losses against the best and ids; the one that was kept comes first."""
        own = self.ranked.get(unit)
        if own is None:
            if len(self.ranked) >= UNITS_KEPT // 4:
                self.ranked.clear()
            top = [(s, self.v.ids_of(unit, path)) for s, path in Lattice(unit, self.v).n_best(self.n)]
            best = np.frombuffer(self.ids[self.row[unit]], np.int32).tolist()
            rest = [(top[0][0] - s, ids) for s, ids in top if ids != best]
            own = self.ranked[unit] = [(0.0, best), *rest][: self.n]
        return own

    def _merged(self, chain: list[str], best: float, gaps: np.ndarray, ends: np.ndarray) -> list[tuple[float, list]]:
        """The N best segmentations of a chain; ends are its units' in pieces."""
        ranked: list[tuple[float, tuple]] = [(0.0, ())]  # losses, and the units whose pieces change
        for i in self._closest(gaps):  # merge this unit's segmentations into those so far
            own = self._ranked(chain[i])
            both = [(a + b, (*edits, (i, k)) if k else edits) for a, edits in ranked for k, (b, _) in enumerate(own)]
            ranked = sorted(both)[: self.n]

        def edit(i: int, k: int) -> tuple[int, int, list[int]]:
            start = int(ends[i - 1]) if i else 0
            return start, int(ends[i]) - start, self._ranked(chain[i])[k][1]

        return [(best - loss, [edit(i, k) for i, k in sorted(edits)]) for loss, edits in ranked]

    def _closest(self, gaps: np.ndarray) -> list[int]:
        """The n - 1 units with the smallest finite gaps, the first of equal ones."""
        n = self.n - 1
        at = np.flatnonzero(gaps <= np.partition(gaps, n - 1)[n - 1]) if 0 < n < len(gaps) else np.arange(len(gaps))
        at = at[np.isfinite(gaps[at])]
        return at[np.argsort(gaps[at], kind="stable")][:n].tolist()

    def segmentations(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a text, best first, each with its score."""
        ranked: list[tuple[float, list[int]]] = [(0.0, [])]
        for u in units(text):
            own = [(s, self.v.ids_of(u, p)) for s, p in Lattice(u, self.v).n_best(self.n)]
            ranked = heapq.nlargest(self.n, ((a + s, x + y) for a, x in ranked for s, y in own), key=lambda t: t[0])
        return ranked

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text that was encoded."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join(map(self.v.spelt.__getitem__, ids))[1:].decode()


def edited(ids: list[int], edits) -> list[int]:
    """The best segmentation's ids with edits (start, n, pieces), which are in order and don't overlap, applied."""
    out, done = [], 0
    for start, n, pieces in edits:
        out += [*ids[done:start], *pieces]
        done = start + n
    return [*out, *ids[done:]]


_N_BEST_DDL = "array<struct<score: double, edits: array<struct<start: int, n: int, pieces: array<int>>>>>"
_N_BEST = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("pieces", pa.list_(pa.int32()))])))]))


def _nested(found: list) -> pa.Array:
    """N-best lists as one column, built level by level."""
    segs = [x for f in found for x in f]
    edits = [e for _, es in segs for e in es]
    offsets = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    pieces = pa.ListArray.from_arrays(offsets([len(p) for _, _, p in edits]), pa.array([k for _, _, p in edits for k in p], pa.int32()))
    of_edits = pa.StructArray.from_arrays([pa.array([s for s, _, _ in edits], pa.int32()), pa.array([n for _, n, _ in edits], pa.int32()), pieces], ["start", "n", "pieces"])
    of_segs = pa.StructArray.from_arrays([pa.array([s for s, _ in segs], pa.float64()), pa.ListArray.from_arrays(offsets([len(e) for _, e in segs]), of_edits)], ["score", "edits"])
    return pa.ListArray.from_arrays(offsets([len(f) for f in found]), of_segs).cast(_N_BEST)


def encoded(docs: DataFrame, vocabulary: Vocabulary, n: int = N_BEST) -> DataFrame:
    """(doc_id, n_pieces, pieces, n_best, round_trip) of every row of docs(doc_id, text)."""
    kept = vocabulary.pieces, vocabulary.byte_ids

    def rows(batches):
        own = Encoder(Vocabulary(*kept), n)
        for batch in batches:
            at = {name: batch.schema.get_field_index(name) for name in ("doc_id", "text")}
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [t or "" for t in part.column(at["text"]).to_pylist()]
                got = own.encode_all(texts)
                sizes = [len(x) for x, _ in got]
                flat = pa.array(np.concatenate([x for x, _ in got]), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)
                true = [own.decode(x) == t for (x, _), t in zip(got, texts)]
                yield pa.record_batch([part.column(at["doc_id"]).cast(pa.int64()), pa.array(sizes, pa.int64()), lists, _nested([s for _, s in got]), pa.array(true)], names=["doc_id", "n_pieces", "pieces", "n_best", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id long, n_pieces long, pieces array<int>, n_best {_N_BEST_DDL}, round_trip boolean")


def op5(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"), Vocabulary.of_file(), N_BEST)


QUERIES = {"op5_sentencepiece": op5}
