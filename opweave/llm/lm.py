"""Language-model scoring by a weighted backoff automaton.

States are histories of one token (``end`` before a text's first), arcs the n-grams of the training
texts. The arc of h for w has weight (1 - b) c(hw) / c(h) + b p(w), the failure arc of h weight b, where
p(w) = (c(w) + 1) / (N + V + 1); a history that was never seen fails without cost. One traversal from left
to right adds log10 weights. b depends on the size of c(h) (``BINS``) and is the value of ``GRID`` that
gives the training tokens, each left out in turn, the largest probability: every count, and the choice
of b, comes from all training texts and grows with them.

How it is dealt out: texts meet in segments of about ``SEGMENT_BYTES``; a segment sends each of its
distinct n-grams, as 64-bit hashes with counts, to the bucket of the hash, and gets the totals back in
the order it sent them. So no table of all n-grams is held anywhere. Texts are shuffled once.

Edge cases: a null or empty text is its end token alone; repeated rows count as often as they stand; a
null doc_id is a training row; without training rows N = V = 0, every token has probability 1 by the
formula and no history is known; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opweave.llm._spark import segment, segments, written
from opweave.llm._text import _ODD, mix, slices, utf8, word_hashes
from opweave.session import table

#: Bytes of text in a segment.
SEGMENT_BYTES = 6 << 20
END = np.uint64(0x1D8AF5C1E07B6A93)
#: Lower ends of the bins of c(h), and the backoff weights to choose from.
BINS = np.array([1, 2, 4, 16, 256, 4096, 65_536])
GRID = np.array([0.02, 0.1, 0.3, 0.5, 0.65, 0.8, 0.95, 1.0])
_CELLS = len(BINS) * len(GRID)


class BackoffAutomaton:
    """The automaton over explicit tokens, for texts that fit in memory; the end token is None."""

    def __init__(self, texts: list[list], backoff=None):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            self.uni.update([*t, None])
            self.bi.update(zip([None, *t], [*t, None]))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.backoff = self._fit() if backoff is None else backoff

    def _fit(self) -> list[float]:
        sums = np.zeros((len(BINS), len(GRID)))
        for (h, w), k in self.bi.items():
            c = self.uni[h]
            p = (1 - GRID) * ((k - 1) / max(c - 1, 1)) + GRID * (self.uni[w] / (self.n + self.v))
            sums[np.searchsorted(BINS, c, "right") - 1] += k * np.log10(p)
        return [float(x) for x in GRID[sums.argmax(axis=1)]]

    def unigram(self, w) -> float:
        return (self.uni.get(w, 0) + 1) / (self.n + self.v + 1)

    def score(self, tokens: list) -> float:
        total, state = 0.0, None
        for w in [*tokens, None]:
            c = self.uni.get(state, 0)
            if not c:
                p = self.unigram(w)  # no such state
            else:
                b = self.backoff[int(np.searchsorted(BINS, c, "right")) - 1]
                p = b * self.unigram(w)  # the failure arc, then the empty history's arc
                if k := self.bi.get((state, w), 0):
                    p += (1 - b) * k / c
            total, state = total + math.log10(p), w
        return total


def _tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all texts, one end after each; histories; document of each token; bigram hashes."""
    data, offsets = utf8(column)
    hashes, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in slices(offsets):
        h, d = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        hashes.append(h)
        docs.append(d + i)
    h, d, n = np.concatenate(hashes), np.concatenate(docs), len(offsets) - 1
    size = np.bincount(d, minlength=n)
    out = np.full(len(h) + n, END, np.uint64)
    doc = np.repeat(np.arange(n), size + 1)
    out[np.arange(len(h)) + d] = h
    before = np.r_[END, out[:-1]][: len(out)]
    return out, before, doc, mix(before * _ODD[0] + out * _ODD[1] + np.uint64(1))


def _distinct(h: np.ndarray, train: np.ndarray, buckets: int):
    """Distinct hashes in order of bucket and value, their training counts, cuts between buckets, and the inverse."""
    u, back = np.unique(h, return_inverse=True)
    count = np.bincount(back[train], minlength=len(u))
    home = (mix(u) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    place = np.empty(len(u), np.int64)
    place[order] = np.arange(len(u))
    return u[order], count[order], np.searchsorted(home[order], np.arange(buckets + 1)), place[back]


def _full(cuts: np.ndarray) -> list[tuple[int, int, int]]:
    """The buckets that have something, with their ranges: a segment sends no more messages than it has hashes."""
    at = np.flatnonzero(np.diff(cuts))
    return list(zip(at.tolist(), cuts[at].tolist(), cuts[at + 1].tolist()))


def _narrow(h: np.ndarray) -> bytes:
    """Seven bytes of each hash; the bucket they go to holds more of it."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _wide(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(b, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _short(n: np.ndarray) -> bytes:
    """Counts, most of them small: a byte each, and those of 255 and more again in full after all bytes."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype(np.int64).tobytes()


def _long(b: bytes, size: int) -> np.ndarray:
    out = np.frombuffer(b, np.uint8, size).astype(np.int64)
    out[out == 255] = np.frombuffer(b, np.int64, offset=size)
    return out


_SENT = "bucket long, seg long, kind int, hashes binary, counts binary"


def corpus_counts(docs: DataFrame, buckets: int) -> tuple[int, int]:
    """N and V over docs(text, train)."""

    def words(batches):
        for batch in batches:
            h, _, doc, _ = _tokens(batch["text"])
            train = np.asarray(batch["train"].to_numpy(zero_copy_only=False), bool)
            u, n, cuts, _ = _distinct(h[train[doc]], np.ones(int(train[doc].sum()), bool), buckets)
            full = np.flatnonzero(np.diff(cuts))
            yield pa.record_batch([pa.array(full), pa.array([_narrow(u[cuts[b] : cuts[b + 1]]) for b in full], pa.binary()), pa.array([int(n[cuts[b] : cuts[b + 1]].sum()) for b in full], pa.int64())], names=["bucket", "hashes", "n"])

    def distinct(t: pa.Table) -> pa.Table:
        u = np.unique(_wide(b"".join(t["hashes"].to_pylist())))
        return pa.table({"n": [sum(t["n"].to_pylist())], "v": [len(u)]})

    r = docs.select("text", "train").mapInArrow(words, "bucket long, hashes binary, n long").groupBy("bucket").applyInArrow(distinct, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return r[0] or 0, r[1] or 0


def scores(docs: DataFrame, held_out) -> DataFrame:
    """One row for every row of docs(doc_id, text); rows where held_out holds don't train."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    count_ = segments(docs, SEGMENT_BYTES)
    buckets = count_
    n_all, v_all = corpus_counts(docs, buckets)
    floor = n_all + v_all + 1
    dealt = docs.withColumn("seg", segment(count_))

    def send(t: pa.Table) -> pa.Table:
        h, _, doc, two = _tokens(t["text"])
        train = t["train"].to_numpy().astype(bool)[doc]
        rows: list[tuple] = []
        for kind, x in ((0, h), (1, two)):
            u, n, cuts, _ = _distinct(x, train, buckets)
            rows += [(b, kind, _narrow(u[i:j]), _short(n[i:j])) for b, i, j in _full(cuts)]
        b, k, x, n = zip(*rows)
        return pa.table([pa.array(b, pa.int64()), pa.array([t["seg"][0].as_py()] * len(b), pa.int64()), pa.array(k, pa.int32()), pa.array(x, pa.binary()), pa.array(n, pa.binary())], ["bucket", "seg", "kind", "hashes", "counts"])

    def total(t: pa.Table) -> pa.Table:
        segs, kinds = t["seg"].to_pylist(), t["kind"].to_pylist()
        own = [_wide(x) for x in t["hashes"].to_pylist()]
        counts = [_long(x, len(u)) for x, u in zip(t["counts"].to_pylist(), own)]
        sums: list = [b""] * len(own)
        for kind in (0, 1):
            at = [i for i, k in enumerate(kinds) if k == kind]
            if not at:
                continue
            _, back = np.unique(np.concatenate([own[i] for i in at]), return_inverse=True)
            n = np.bincount(back, np.concatenate([counts[i] for i in at]).astype(np.float64)).astype(np.int64)[back]
            cuts = np.cumsum([0, *(len(own[i]) for i in at)])
            for i, a, b in zip(at, cuts[:-1], cuts[1:]):
                sums[i] = _short(n[a:b])
        return pa.table({"seg": pa.array(segs, pa.int64()), "bucket": t["bucket"], "kind": pa.array(kinds, pa.int32()), "counts": pa.array(sums, pa.binary())})

    def score(t: pa.Table, back: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "sums", "left_out"]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        if not t.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        h, _, doc, two = _tokens(t["text"])
        is_train = t["train"].to_numpy().astype(bool)
        train = is_train[doc]
        got = {(k, b): x for k, b, x in zip(back["kind"].to_pylist(), back["bucket"].to_pylist(), back["counts"].to_pylist())}
        count = []
        for kind, x in ((0, h), (1, two)):
            _, _, cuts, at = _distinct(x, train, buckets)
            count.append(np.concatenate([_long(got[kind, b], j - i) for b, i, j in _full(cuts)])[at])
        c_w, c_hw = count
        first = np.r_[True, doc[1:] != doc[:-1]]
        ends = c_w[np.flatnonzero(h == END)[:1]]
        c_h = np.where(first, ends[0], np.r_[0, c_w[:-1]])
        known = c_h > 0
        which = np.searchsorted(BINS, c_h, "right") - 1
        base = np.log10((c_w + 1) / floor)
        n = t.num_rows
        sums = np.zeros((n, len(BINS), len(GRID)))
        left = np.zeros((len(BINS), len(GRID)))
        fresh = np.bincount(doc[~known], base[~known], n)
        at = doc[known] * len(BINS) + which[known]
        high, low = c_hw[known] / c_h[known], (c_w[known] + 1) / floor
        tr = train & known
        high1, low1 = (c_hw[tr] - 1) / np.maximum(c_h[tr] - 1, 1), c_w[tr] / max(floor - 1, 1)
        for g, b in enumerate(GRID):
            sums[:, :, g] = np.bincount(at, np.log10((1 - b) * high + b * low), n * len(BINS)).reshape(n, len(BINS))
            left[:, g] = np.bincount(which[tr], np.log10((1 - b) * high1 + b * low1), len(BINS))
        parts_ = np.concatenate([fresh[:, None], sums.reshape(n, _CELLS)], axis=1)
        per_doc = [t["doc_id"].combine_chunks(), pa.array(~is_train), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc, c_w > 0, n).astype(np.int64)), pa.array(np.bincount(doc, base, n)), pa.FixedSizeListArray.from_arrays(pa.array(parts_.ravel()), _CELLS + 1).cast(kinds[5]), pa.array([left.ravel().tolist()] + [None] * (n - 1), kinds[6])]
        return pa.table(per_doc, names)

    back = dealt.groupBy("seg").applyInArrow(send, _SENT).groupBy("bucket").applyInArrow(total, "seg long, bucket long, kind int, counts binary")
    rows = written(dealt.groupBy("seg").cogroup(back.groupBy("seg")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, sums array<double>, left_out array<double>"))
    sums = rows.where("left_out is not null").agg(*[F.sum(F.get("left_out", F.lit(i))).alias(f"s{i}") for i in range(_CELLS)]).first()
    left = np.array([x or 0.0 for x in sums]).reshape(len(BINS), len(GRID))
    best = left.argmax(axis=1)
    picked = [F.get("sums", F.lit(0))] + [F.get("sums", F.lit(1 + i * len(GRID) + int(g))) for i, g in enumerate(best)]
    total_score = picked[0]
    for p in picked[1:]:
        total_score = total_score + p
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", total_score.alias("score"))


def op6(spark, sf_dir):
    return scores(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


QUERIES = {"op6_lm_scoring": op6}
