"""Document fingerprints from prefix polynomial hashes.

Modular prefix arrays of a text give the hash of any of its spans in constant time: ``PrefixHash`` answers
span equality and finds longest common extensions by binary search. A document's fingerprint is the hash
of the whole text, with its length, and a sketch: the ``SKETCH`` smallest hashes of its distinct spans of
``SPAN`` code points (of the whole text where it is shorter), all read off the prefix array.

The likeness of two fingerprints is 1 for equal whole-text hashes, else the Jaccard estimate of the
sketches: of the SKETCH smallest values of the union, the share that both have. Where two texts meet, the longest
common extension from their first code points tells how far they agree.

Edge cases: a null text is empty; the empty text has an empty sketch, and likeness 0 to all but itself;
rows are ordered by doc_id (null first), then text, so that repeated doc_ids have a defined next one; a
lone document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opweave.session import table

SPAN, SKETCH = 16, 64
#: Modulus (a Mersenne prime) and the two bases of the polynomial hashes.
MODULUS, BASES = (1 << 31) - 1, (911_382_323, 972_663_749)
_M, _S = np.uint64(MODULUS), np.uint64(31)


def _reduce(x: np.ndarray) -> np.ndarray:
    """x modulo MODULUS, for x below 2**63."""
    x = (x & _M) + (x >> _S)
    x = (x & _M) + (x >> _S)
    return np.minimum(x, x - _M)  # below the modulus the difference wraps round to a large number


class _Powers:
    def __init__(self, base: int):
        self.steps, self.tables = (base, pow(base, -1, MODULUS)), [np.ones(1, np.uint64)] * 2

    def __call__(self, n: int) -> list[np.ndarray]:
        if len(self.tables[0]) < n:
            n = max(n, 1 << 14)
            for k, step in enumerate(self.steps):
                t = np.ones(n, np.uint64)
                done = 1
                while done < n:  # doubles what is there
                    more = min(done, n - done)
                    t[done : done + more] = _reduce(t[:more] * np.uint64(pow(step, done, MODULUS)))
                    done += more
                self.tables[k] = t
        return self.tables


_powers = [_Powers(b) for b in BASES]


class PrefixHash:
    """Prefix arrays of one text, of one or both bases."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(self.codes)
        self._sums: list = [None, None]

    def _terms(self, k: int) -> np.ndarray:
        x = self.codes * _powers[k](self.n + 1)[0][: self.n]
        return (x & _M) + (x >> _S)

    def sums(self, k: int) -> np.ndarray:
        if self._sums[k] is None:
            p = np.zeros(self.n + 1, np.uint64)
            np.cumsum(self._terms(k), out=p[1:])
            self._sums[k] = _reduce(p)
        return self._sums[k]

    def spans(self, starts: np.ndarray, ends: np.ndarray, k: int = 0) -> np.ndarray:
        """Hashes, under base k, of the spans [start, end)."""
        p = self.sums(k)
        return _reduce((p[ends] + _M - p[starts]) * _powers[k](self.n + 1)[1][starts])

    def span(self, i: int, j: int) -> int:
        """Both hashes of one span, in one integer."""
        out = 0
        for k in (0, 1):
            p, down = self.sums(k), _powers[k](self.n + 1)[1]
            out = out << 31 | (int(p[j]) - int(p[i])) * int(down[i]) % MODULUS
        return out

    def whole(self) -> int:
        """span(0, n), without the second prefix array."""
        return int(self.sums(0)[-1]) << 31 | int(self._terms(1).sum()) % MODULUS

    def rolling(self, length: int) -> np.ndarray:
        """Hashes, under the first base, of all spans of one length."""
        p, down = self.sums(0), _powers[0](self.n + 1)[1]
        return _reduce((p[length:] + _M - p[: len(p) - length]) * down[: len(p) - length])

    def equal(self, i: int, j: int, length: int, other: PrefixHash | None = None) -> bool:
        other = other or self
        return i + length <= self.n and j + length <= other.n and self.span(i, i + length) == other.span(j, j + length)

    def extension(self, i: int, j: int, other: PrefixHash | None = None) -> int:
        """Length of the longest common extension of self[i:] and other[j:], by binary search."""
        other = other or self
        low, high = 0, min(self.n - i, other.n - j)
        if other is self and i == j:
            return high
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self.equal(i, j, mid, other) else (low, mid - 1)
        return low


def sketch(p: PrefixHash) -> np.ndarray:
    """The smallest span hashes, spread by a second mapping so that their order is a random one."""
    if not p.n:
        return np.zeros(0, np.uint32)
    h = p.rolling(min(SPAN, p.n))
    h = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    k = 2 * SKETCH
    while True:
        low = np.unique(np.partition(h, k)[:k] if k < len(h) else h)
        if len(low) >= SKETCH or k >= len(h):
            return low[:SKETCH]
        k *= 4


def printed(p: PrefixHash) -> str:
    return f"{p.whole():016x}:{p.n:x}:" + sketch(p).astype(">u4").tobytes().hex()


def fingerprint(text: str) -> str:
    """Whole-text hash (16 hex digits), length, and the sketch, 8 hex digits a value."""
    return printed(PrefixHash(text))


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for fingerprints of equal texts."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s.rsplit(":", 1)[1]), ">u4") for s in (a, b))
    if not len(x) or not len(y):
        return 0.0
    union = np.union1d(x, y)[:SKETCH]
    return float(np.isin(union, np.intersect1d(x, y, assume_unique=True), assume_unique=True).mean())


def edit(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


#: Rows behind one range of doc_ids in small tables, and in large ones, where the driver holds the bounds; a range
#: of any size is read as a stream.
RANGE_ROWS, FEW_RANGES, LARGE_ROWS = 500, 4096, 100_000


def in_order(docs: DataFrame) -> DataFrame:
    """(r, extra, doc_id, text), sorted within partitions: runs of rows in order of doc_id, one for each
    range r of ids, each followed by one extra row, the first of the next range (of the first, after the last).

    The ranges' bounds are quantiles of the ids, and the texts are shuffled once.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = docs.count()
    k = max(1, min(FEW_RANGES, n // RANGE_ROWS), n // LARGE_ROWS)
    cuts = sorted(set(docs.where("doc_id is not null").stat.approxQuantile("doc_id", [i / k for i in range(1, k)], 0.2 / k))) if k > 1 else []
    cuts = [-1e300, *cuts]  # one at least
    split = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="id", outputCol="own")
    low = F.lit(-(2**63)).cast("double")  # a null doc_id is the least
    own = lambda df: split.transform(df.withColumn("id", F.coalesce(F.col("doc_id").cast("double"), low))).withColumn("own", F.col("own").cast("int")).drop("id")
    found = own(docs.select("doc_id")).groupBy("own").agg(F.min("doc_id").alias("id"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()  # one row a range
    heads = {r["own"]: None if r["nulls"] else r["id"] for r in found}
    full = sorted(heads) or [0]
    before = {b: full[i - 1] for i, b in enumerate(full)}
    lows = F.lit([heads.get(b) if heads.get(b) is not None else -(2**63) for b in range(len(cuts) + 1)])
    is_head = F.coalesce(F.col("doc_id"), F.lit(-(2**63))) == F.get(lows, F.col("own"))
    to = F.array(F.struct(F.col("own").alias("r"), F.lit(False).alias("extra")))
    more = F.array(F.struct(F.get(F.lit([before.get(b, 0) for b in range(len(cuts) + 1)]), F.col("own")).alias("r"), F.lit(True).alias("extra")))
    dealt = own(docs).select("doc_id", "text", F.explode(F.when(is_head, F.concat(to, more)).otherwise(to)).alias("to"))
    return dealt.select("to.r", "to.extra", "doc_id", "text").repartition("r").sortWithinPartitions("r", "extra", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row its fingerprint and that of its edited text, with their likenesses, and how many code points
    the text shares, from the first on, with the edited and with the next one (``same_edited``, ``same_next``)."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "same_edited", "same_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]

    def runs(batches):
        cols: list[list] = [[] for _ in names]
        last = None  # range, doc_id, text, its prefix hashes and fingerprint, of a row whose next one is still to come
        for batch in batches:
            for r, extra, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                p = own = None
                if last is not None and last[0] == r:
                    _, j, old, q, mark = last
                    p, own = (q, mark) if text == old else (p := PrefixHash(text), printed(p))
                    changed = edit(old, text)
                    e = q if changed == old else PrefixHash(changed)
                    new = mark if e is q else printed(e)
                    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    for c, x in zip(cols, (j, len(old), sha, mark, new, likeness(mark, new), likeness(mark, own), q.extension(0, 0, e), q.extension(0, 0, p))):
                        c.append(x)
                if extra:
                    last = None
                else:
                    p = p or PrefixHash(text)
                    last = (r, i, text, p, own or printed(p))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names)
            cols = [[] for _ in names]

    return in_order(docs).mapInArrow(runs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_edited long, same_next long")


def op3(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op3_document_fingerprints": op3}
