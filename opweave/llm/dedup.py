"""Suffix-array deduplication by external induced sorting.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller
doc_id. Strings are compared in shards, each with a suffix array of its own:

1. Minimum substring partitioning: every window of ``length`` bytes has a minimizer, its ``K`` bytes of
   smallest hash, which depends on the window's content alone. Runs of windows with one minimizer make a
   string of under ``2 * length`` bytes, and equal windows go to the shard of their common minimizer.
2. Segments of documents send their distinct minimizers (64-bit hashes) to shards and learn which of
   them other documents have as well; only strings of those travel, each once from a segment, with its
   smallest doc_id.
3. In a shard the distinct strings' suffixes are sorted by induction (``InducedSorter``): suffixes that
   begin a descent (LMS) are sorted first, by recursive naming of their substrings in rounds; the others
   are induced from them, bucket by bucket, through queues that hold suffixes in order of first character,
   then of arrival, and go to disk beyond ``RAM`` bytes. Suffixes that share ``length`` bytes are then
   neighbours; the least doc_id of each such group goes back to the segments.

Documents that repeat a smaller one whole (equal lengths and 128-bit hashes) are settled in step 2, and strings
are told apart by the same.

Edge cases: a null text is empty; texts of under ``length`` bytes keep all; rows with one doc_id don't
remove from each other; a null doc_id counts as larger than any; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opweave.llm._spark import segment, segments
from opweave.llm._text import mix, prefix, rolling, slices, utf8
from opweave.session import table

LENGTH, K = 50, 20
#: Bytes of text in a segment.
SEGMENT_BYTES = 8 << 20
#: Bytes of queued suffixes that a sorter holds in memory.
RAM = 256 << 20
NOBODY = np.int64(2**63 - 1)


class BucketQueues:
    """A monotone priority queue: items leave by first character, then in order of arrival; beyond ``ram``
    bytes arrays are kept in a file that is gone when the queues are."""

    def __init__(self, n: int, ram: int = RAM):
        self.runs: list[list] = [[] for _ in range(n)]
        self.ram, self.held, self.file = ram, 0, None

    def push(self, c: int, items: np.ndarray) -> None:
        if self.held + items.nbytes > self.ram:
            self.file = self.file or tempfile.TemporaryFile()
            self.runs[c].append((self.file.seek(0, 2), len(items)))
            self.file.write(items.tobytes())
        else:
            self.held += items.nbytes
            self.runs[c].append(items)

    def pop(self, c: int) -> np.ndarray:
        out = []
        for run in self.runs[c]:
            if isinstance(run, tuple):
                self.file.seek(run[0])
                out.append(np.frombuffer(self.file.read(8 * run[1]), np.int64))
            else:
                self.held -= run.nbytes
                out.append(run)
        self.runs[c] = []
        return np.concatenate(out) if out else np.zeros(0, np.int64)


class InducedSorter:
    """Order of the suffixes of strings that end in 0 (letters are 1 and more), by their first ``depth`` letters."""

    def __init__(self, text: np.ndarray, depth: int, ram: int = RAM):
        self.text, self.depth, self.ram = text, depth, ram
        n = len(text)
        differs = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
        nxt = np.repeat(differs, np.diff(np.r_[-1, differs]))  # where the run of this letter ends
        after = np.r_[text[1:], 0]
        self.small = (text < after)[nxt] | (text == 0)  # S type
        self.lms = np.flatnonzero(self.small & np.r_[False, ~self.small[:-1]])

    def _sorted_lms(self) -> np.ndarray:
        """LMS suffixes in order: names for their substrings, doubled in length until all letters that count are covered."""
        at, t = self.lms, self.text
        n = len(t)
        ends = np.r_[at[1:], n - 1]
        word = np.zeros(len(at), np.uint64)
        long = ends - at + 1
        for k in range(7):  # the substring's first letters, 9 bits each
            p = np.minimum(at + k, n - 1)
            word = (word << np.uint64(9)) | np.where(k < long, t[p], 0).astype(np.uint64)
        names = np.unique(word, return_inverse=True)[1].astype(np.int64)
        # longer substrings are told apart by more words
        covered, most = 7, min(self.depth, int(long.max(initial=0)))
        while covered < most:
            word = np.zeros(len(at), np.uint64)
            for k in range(covered, covered + 7):
                word = (word << np.uint64(9)) | np.where(k < long, t[np.minimum(at + k, n - 1)], 0).astype(np.uint64)
            second = np.unique(word, return_inverse=True)[1]
            names = np.unique(names * (len(at) + 1) + second, return_inverse=True)[1].astype(np.int64)
            covered += 7
        stop = t[at] == 0  # nothing after an end counts
        step = 1
        while 2 * step < self.depth and len(at) > 1:  # LMS suffixes are two letters apart or more
            far = np.minimum(np.arange(len(at)) + step, len(at) - 1)
            follow = np.where(stop, 0, names[far] + 1)
            stop = stop | stop[far]
            new = np.unique(names * (len(at) + 1) + follow, return_inverse=True)[1].astype(np.int64)
            if new.max() == names.max():
                break
            names, step = new, 2 * step
        return at[np.argsort(names, kind="stable")]

    def _induce(self, queues: BucketQueues, items: np.ndarray, small: bool, c: int) -> np.ndarray:
        """Pushes the suffixes one before items that have the type; gives back those of letter c."""
        before = items[items > 0] - 1
        before = before[self.small[before] == small]
        letters = self.text[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cuts = np.flatnonzero(np.r_[True, letters[1:] != letters[:-1]]) if len(letters) else []
        same = before[:0]
        for i, j in zip(cuts, [*cuts[1:], len(before)]):
            if letters[i] == c:
                same = before[i:j]
            else:
                queues.push(int(letters[i]), before[i:j])
        return same

    def order(self) -> np.ndarray:
        alphabet = int(self.text.max(initial=0)) + 1
        lms = self._sorted_lms()
        heads = np.searchsorted(self.text[lms], np.arange(alphabet + 1))  # sorted suffixes have sorted first letters
        queues, large = BucketQueues(alphabet, self.ram), []
        for c in range(alphabet):
            got, now = [], queues.pop(c)
            while len(now):
                got.append(now)
                now = self._induce(queues, now, False, c)
            large.append(np.concatenate(got) if got else np.zeros(0, np.int64))
            self._induce(queues, lms[heads[c] : heads[c + 1]], False, c)
        queues, out = BucketQueues(alphabet, self.ram), []
        for c in reversed(range(alphabet)):
            got, now = [], queues.pop(c)
            while len(now):
                got.append(now)
                now = self._induce(queues, now, True, c)
            self._induce(queues, large[c][::-1], True, c)
            out.append(np.concatenate([large[c], *(g for g in [np.concatenate(got)[::-1]] if got)]) if got else large[c])
        return np.concatenate(out[::-1])


def least_owner(strings: np.ndarray, sizes: np.ndarray, owner: np.ndarray, length: int = LENGTH, ram: int = RAM) -> np.ndarray:
    """For each window of each string (in order), the least owner of a string that holds it.

    strings: the bytes of all strings, end to end."""
    ends = np.cumsum(sizes)
    text = np.zeros(len(strings) + len(sizes), np.uint16)
    own = np.repeat(np.arange(len(sizes)), sizes)
    text[np.arange(len(strings)) + own] = strings.astype(np.uint16) + 1
    start = ends - sizes + np.arange(len(sizes))
    windows = sizes - length + 1
    whose = np.repeat(np.arange(len(sizes)), windows)
    first = np.repeat(start, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    number = np.full(len(text), -1, np.int64)
    number[first] = np.arange(len(first))
    order = number[InducedSorter(text, length, ram).order()]
    order = order[order >= 0]
    at = first[order]
    same = np.ones(len(at) - 1, bool) if len(at) else np.zeros(0, bool)
    padded = np.concatenate([text, np.zeros(4, np.uint16)])
    quads = np.lib.stride_tricks.sliding_window_view(padded, 4)
    quads = np.ascontiguousarray(quads[: len(text)]).view(np.uint64).ravel()
    for k in [*range(0, length - 3, 4), *([length - 4] if length % 4 else [])]:
        w = quads[at + k]
        same &= w[1:] == w[:-1]
    group = np.cumsum(np.r_[0, ~same]) if len(at) else at
    least = np.full(int(group[-1]) + 1 if len(at) else 0, NOBODY)
    np.minimum.at(least, group, owner[whose[order]])
    out = np.empty(len(at), np.int64)
    out[order] = least[group]
    return out


def _runs(data: np.ndarray, offsets: np.ndarray, length: int):
    """Runs of windows with one minimizer: start, windows, document and the minimizer's hash."""
    out: list = [[], [], [], []]
    for i, j in slices(offsets):
        for low in range(int(offsets[i]), max(int(offsets[i]) + 1, int(offsets[j])), 1 << 22):  # a long document in pieces
            high = min(int(offsets[j]), low + (1 << 22) + length - 1)
            part = data[low:high]
            n = len(part) - length + 1
            if n <= 0:
                continue
            counts = np.diff(np.clip(offsets[i : j + 1], low, low + n))  # starts of windows in each document
            doc = np.repeat(np.arange(i, j), counts)
            fits = np.arange(low + length, low + length + n) <= np.repeat(offsets[i + 1 : j + 1], counts)
            h = rolling(prefix(part), K)
            x = h & np.uint64(2**64 - 2**23) | np.arange(len(h), dtype=np.uint64)
            w, width = length - K + 1, 1
            while 2 * width <= w:
                x = np.minimum(x[:-width], x[width:])
                width *= 2
            x = np.minimum(x[: len(x) - (w - width)], x[w - width :]) if w > width else x
            least = (x[:n] & np.uint64(2**23 - 1)).astype(np.int64)
            ok = np.flatnonzero(fits)
            if not len(ok):
                continue
            cut = np.flatnonzero(np.r_[True, (np.diff(ok) > 1) | (np.diff(least[ok]) != 0) | (np.diff(doc[ok]) != 0)])
            for o, v in zip(out, (ok[cut] + low, np.diff(np.r_[cut, len(ok)]), doc[ok[cut]], h[least[ok[cut]]])):
                o.append(v)
    kinds = (np.int64, np.int64, np.int64, np.uint64)
    return [np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, kinds)]


def _slots(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of keys by bucket and value, and the buckets that have any, with their ranges of it: a segment sends
    no more messages than it has keys."""
    home = (mix(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, home))
    return order, _ranges(home[order])


def _ranges(home: np.ndarray) -> list[tuple[int, int, int]]:
    cuts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]]) if len(home) else np.zeros(0, np.int64)
    return list(zip(home[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(home)]))


#: 128 bits of a hash, and a length.
NAME = np.dtype([("high", "u8"), ("low", "u8"), ("n", "i8")])


def named(data: np.ndarray, starts, ends) -> np.ndarray:
    """128-bit hashes, with lengths, of spans of the data."""
    out = np.empty(len(starts), NAME)
    raw = b"".join([xxhash.xxh3_128_digest(data[i:j].data) for i, j in zip(starts, ends)])
    both = np.frombuffer(raw, ">u8").reshape(-1, 2)
    out["high"], out["low"], out["n"] = both[:, 0], both[:, 1], np.asarray(ends) - np.asarray(starts)
    return out


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows of the distinct names, in order of their first 64 bits, and the inverse."""
    _, one, back = np.unique(names["high"], return_index=True, return_inverse=True)
    if (names["low"][one][back] != names["low"]).any() or (names["n"][one][back] != names["n"]).any():  # 64 bits don't tell them apart: the whole names do
        _, one, back = np.unique(names, return_index=True, return_inverse=True)
    return one, back


_DDL = "bucket long, seg long, kind int, a binary, b binary, c binary"
_NAMES = ["bucket", "seg", "kind", "a", "b", "c"]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
MINIMIZERS, WHOLE, STRINGS, STATE = 0, 1, 2, 3


def _table(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[]] * len(_NAMES)
    return pa.table([pa.array(c, k) for c, k in zip(cols, _KINDS)], _NAMES)


class _Segment:
    """What each step derives anew, in one order, from a segment's documents."""

    def __init__(self, t: pa.Table, length: int, buckets: int):
        self.seg = t["seg"][0].as_py()
        self.data, self.offsets = utf8(t["text"])
        self.ids = np.array([NOBODY if i is None else i for i in t["doc_id"].to_pylist()], np.int64)
        self.buckets = buckets
        self.starts, self.windows, self.doc, h = _runs(self.data, self.offsets, length)
        self.keys, self.key_of = np.unique(h & np.uint64(2**64 - 2), return_inverse=True)
        self.order, self.cuts = _slots(self.keys, buckets)
        own = self.ids[self.doc]
        low, high = np.full(len(self.keys), NOBODY), np.full(len(self.keys), np.int64(-(2**63)))
        np.minimum.at(low, self.key_of, own)
        np.maximum.at(high, self.key_of, own)
        self.several = low < high
        cut = self.offsets.tolist()
        whole = named(self.data, cut[:-1], cut[1:])
        one, self.text_of = distinct(whole)
        self.texts = whole[one]
        self.text_order, self.text_cuts = _slots(self.texts["high"], buckets)
        self.text_low = np.full(len(self.texts), NOBODY)
        np.minimum.at(self.text_low, self.text_of, self.ids)

    def sent_strings(self, shared: np.ndarray, text_low: np.ndarray, length: int):
        """Runs whose strings travel; the strings' hashes in order of shard; each run's place among them."""
        copies = text_low[self.text_of] < self.ids
        runs = np.flatnonzero(shared[self.key_of] & ~copies[self.doc])
        size = self.windows[runs] + length - 1
        one, of = distinct(named(self.data, self.starts[runs].tolist(), (self.starts[runs] + size).tolist()))
        home = (mix(self.keys[self.key_of[runs[one]]]) % np.uint64(self.buckets)).astype(np.int64)  # equal strings have one
        order = np.argsort(home, kind="stable")
        place = np.empty(len(one), np.int64)
        place[order] = np.arange(len(one))
        place, first = place[of], one[order]
        least = np.full(len(first), NOBODY)
        np.minimum.at(least, place, self.ids[self.doc[runs]])
        return copies, runs, place, first, size[first], least, _ranges(home[order])


def removals(docs: DataFrame, length: int = LENGTH, ram: int = RAM, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_text binary]) of every row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    count = segments(docs, SEGMENT_BYTES)
    buckets = count
    dealt = docs.withColumn("seg", segment(count))

    def send(t: pa.Table) -> pa.Table:
        s = _Segment(t, length, buckets)
        rows = []
        for b, i, j in s.cuts:
            o = s.order[i:j]
            rows.append((b, s.seg, MINIMIZERS, (s.keys[o] | s.several[o].astype(np.uint64)).tobytes(), None, None))
        for b, i, j in s.text_cuts:
            o = s.text_order[i:j]
            rows.append((b, s.seg, WHOLE, s.texts[o].tobytes(), s.text_low[o].tobytes(), None))
        return _table(rows)

    def compare(t: pa.Table) -> pa.Table:
        rows, bucket = [], t["bucket"][0].as_py()
        for kind in (MINIMIZERS, WHOLE):
            part = t.filter(pa.compute.equal(t["kind"], kind))
            keys = [np.frombuffer(x, np.uint64 if kind == MINIMIZERS else NAME) for x in part["a"].to_pylist()]
            if not keys:
                continue
            every = np.concatenate(keys)
            cuts = np.cumsum([0, *map(len, keys)])
            if kind == MINIMIZERS:
                u, back, n = np.unique(every >> np.uint64(1), return_inverse=True, return_counts=True)
                n = n + np.bincount(back, every & np.uint64(1), len(u)).astype(np.int64)
                got = (n > 1)[back]
            else:
                one, back = distinct(every)
                least = np.full(len(one), NOBODY)
                np.minimum.at(least, back, np.frombuffer(b"".join(part["b"].to_pylist()), np.int64))
                got = least[back]
            rows += [(bucket, s, kind, got[i:j].tobytes(), None, None) for s, i, j in zip(part["seg"].to_pylist(), cuts, cuts[1:])]
        return _table(rows)

    def state(s: _Segment, back: dict) -> tuple[np.ndarray, np.ndarray]:
        shared, low = np.zeros(len(s.keys), bool), np.full(len(s.texts), NOBODY)
        for b, i, j in s.cuts:
            shared[s.order[i:j]] = np.frombuffer(back[MINIMIZERS, b], bool)
        for b, i, j in s.text_cuts:
            low[s.text_order[i:j]] = np.frombuffer(back[WHOLE, b], np.int64)
        return shared, low

    def send_strings(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table([])
        s = _Segment(t, length, buckets)
        shared, low = state(s, {(k, b): a for k, b, a in zip(back["kind"].to_pylist(), back["bucket"].to_pylist(), back["a"].to_pylist())})
        _, runs, _, first, size, least, cuts = s.sent_strings(shared, low, length)
        starts = s.starts[runs[first]]
        rows = [(s.seg % buckets, s.seg, STATE, np.packbits(shared).tobytes(), low.tobytes(), None)]  # comes back as it is
        for b, i, j in cuts:
            text = b"".join(s.data[x : x + n].tobytes() for x, n in zip(starts[i:j].tolist(), size[i:j].tolist()))
            rows.append((b, s.seg, STRINGS, text, size[i:j].astype(np.uint8 if 2 * length < 256 else np.uint32).tobytes(), least[i:j].tobytes()))
        return _table(rows)

    def sort_shard(t: pa.Table) -> pa.Table:
        bucket = t["bucket"][0].as_py()
        rows = [(bucket, s, STATE, a, b, None) for s, k, a, b in zip(*(t[n].to_pylist() for n in ("seg", "kind", "a", "b"))) if k == STATE]
        part = t.filter(pa.compute.equal(t["kind"], STRINGS))
        if part.num_rows:
            sizes = [np.frombuffer(x, np.uint8 if 2 * length < 256 else np.uint32).astype(np.int64) for x in part["b"].to_pylist()]
            size, owner = np.concatenate(sizes), np.frombuffer(b"".join(part["c"].to_pylist()), np.int64)
            data = b"".join(part["a"].to_pylist())
            ends = np.cumsum(size)
            raw = np.frombuffer(data, np.uint8)
            one, back = distinct(named(raw, (ends - size).tolist(), ends.tolist()))  # each string once
            least = np.full(len(one), NOBODY)
            np.minimum.at(least, back, owner)
            picked = np.zeros(len(size), bool)
            picked[one] = True
            rank = np.cumsum(picked) - 1  # of the distinct strings, in order of place
            by_place = np.argsort(one)
            got = least_owner(raw[np.repeat(picked, size)], size[picked], least[by_place], length, ram)
            windows = size[picked] - length + 1
            begin = np.cumsum(windows) - windows
            edge = np.zeros(len(got), bool)
            edge[begin] = True
            edge[1:] |= got[1:] != got[:-1]
            at = np.flatnonzero(edge)  # runs of equal values inside strings
            run_len, run_val = np.diff(np.r_[at, len(got)]), got[at]
            run_lo = np.searchsorted(at, begin)
            run_n = np.diff(np.r_[run_lo, len(at)])
            place = rank[one][back]
            cuts = np.cumsum([0, *map(len, sizes)])
            for s, i, j in zip(part["seg"].to_pylist(), cuts.tolist(), cuts[1:].tolist()):
                p = place[i:j]
                n = run_n[p]
                idx = np.repeat(run_lo[p] - np.cumsum(n) + n, n) + np.arange(n.sum())
                rows.append((bucket, s, STRINGS, n.astype(np.uint8 if 2 * length < 256 else np.uint32).tobytes(), run_len[idx].astype(np.uint8 if 2 * length < 256 else np.uint32).tobytes(), run_val[idx].tobytes()))
        return _table(rows)

    out_names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if keep_text else [])]

    def remove(t: pa.Table, back: pa.Table) -> pa.Table:
        kinds = [pa.int64()] * 4 + [pa.string(), *([pa.binary()] if keep_text else [])]
        if not t.num_rows:
            return pa.table([pa.array([], k) for k in kinds], out_names)
        s = _Segment(t, length, buckets)
        got = {(k, b): (x, y, z) for k, b, x, y, z in zip(*(back[n].to_pylist() for n in ("kind", "bucket", "a", "b", "c")))}
        bits, low, _ = got[STATE, s.seg % buckets]
        shared = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(s.keys)).astype(bool)
        copies, runs, place, first, size, _, cuts = s.sent_strings(shared, np.frombuffer(low, np.int64), length)
        kind = np.uint8 if 2 * length < 256 else np.uint32
        ns, lens, vals = (np.concatenate([np.frombuffer(got[STRINGS, b][i], d) for b, _, _ in cuts] or [np.zeros(0, d)]) for i, d in enumerate((kind, kind, np.int64)))
        least = np.repeat(vals, lens)  # of every window of every sent string
        windows = size - length + 1
        begin = np.cumsum(windows) - windows
        n = s.windows[runs]
        idx = np.repeat(begin[place] - np.cumsum(n) + n, n) + np.arange(n.sum())
        at = np.repeat(s.starts[runs] - np.cumsum(n) + n, n) + np.arange(n.sum())
        hit = at[least[idx] < np.repeat(s.ids[s.doc[runs]], n)]
        cover = np.zeros(len(s.data) + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        cols: list[list] = [[] for _ in out_names]
        cut = s.offsets.tolist()
        for d, i in enumerate(t["doc_id"].to_pylist()):
            a, b = cut[d], cut[d + 1]
            g = gone[a:b] if not (copies[d] and b - a >= length) else np.ones(b - a, bool)
            if g.any():
                kept, removed = s.data[a:b][~g].tobytes(), int(g.sum())
                spans_ = int(g[0]) + int((g[1:] & ~g[:-1]).sum())
            else:
                kept, removed, spans_ = s.data[a:b].tobytes(), 0, 0
            for c, x in zip(cols, (i, b - a, removed, spans_, hashlib.sha256(kept).hexdigest(), kept)):
                c.append(x)
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], out_names)

    by_seg = dealt.groupBy("seg")
    known = by_seg.applyInArrow(send, _DDL).groupBy("bucket").applyInArrow(compare, _DDL)
    strings = by_seg.cogroup(known.groupBy("seg")).applyInArrow(send_strings, _DDL)
    sorted_ = strings.groupBy("bucket").applyInArrow(sort_shard, _DDL)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text binary" if keep_text else "")
    return by_seg.cogroup(sorted_.groupBy("seg")).applyInArrow(remove, ddl)


def op8(spark, sf_dir):
    return removals(table(spark, sf_dir, "documents"))


QUERIES = {"op8_suffix_array_dedup": op8}
