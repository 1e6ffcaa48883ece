"""N-gram Jaccard join by a count-vector R-tree.

A document's set holds its distinct shingles. The tokens (shingle hashes) fall into groups, the more the
larger the set (classes of sizes, see ``groups_of``); the number of tokens in each group makes the document a point. For two points the sum of coordinate
minima bounds the overlap of the sets from above, and for a box of points the coordinate maxima do the
same; the R-tree prunes by these bounds, and what survives is verified on the sets themselves.

How the work is dealt out, all of it exact:

1. Every distinct set puts the first ``n - ceil(t n) + 1`` of its tokens, in one global order, into
   buckets: two sets that reach the threshold share one of them. Tokens that are common in a bounded
   sample of documents come last in that order (the sample decides speed only, never results).
2. Keys that one set alone has go; the others get their points, and in each key's bucket an R-tree (or,
   for a few points, its only leaf) yields which sets may link. Only a spanning forest leaves a bucket.
3. Components of the forests are the only places where links can be. Their members' texts meet in
   tiles, where bounds and then the sets verify links. A component of one chunk (``CHUNK`` sets, ``CHUNK_SHINGLES``
   shingles) is one tile. A larger one is dealt twice, each time in chunks of another hash: near copies that link
   densely come out as one class, sent twice however large it is. Pairs within the largest class need no more
   checks; chunks of the other members meet each other and those of the largest class in further tiles.
4. Components of the verified links are the result.

Edge cases: a null text is empty; a document without words has no set and links with nothing; equal
sets link; repeated doc_ids are separate rows; a null doc_id never names a component unless its whole
component has none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opweave.llm._spark import components, written
from opweave.llm._text import mix, shingle_sets
from opweave.session import table

#: Groups of the smallest class; each class has four times the groups, for sets up to four times as large.
GROUPS, LEAST_CLASS = 64, 768
#: Points in a leaf of the tree, and children of an inner node.
FANOUT = 32
#: Sets, and shingles of sets, in a chunk of a candidate component; a tile holds at most two chunks.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 21
#: Bounds of the sample that orders common tokens last, and of the list it makes.
SAMPLE_DOCS, SAMPLE_TOKENS = 10_000, 65_536
#: Documents behind one bucket of keys.
BUCKET_DOCS = 8_000
_BLOB = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
_BLOB_DDL = "bucket long, kind int, blob binary"


def node_of(tokens: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes(), 17)).astype(np.int64))


def class_of(size: int) -> int:
    k = 0
    while size > LEAST_CLASS << 2 * k:
        k += 1
    return k


def groups_of(k: int) -> int:
    return GROUPS << 2 * k


def classes(size: int, percent: int) -> list[int]:
    """A set's own class, and the one below if a set of that class can be near enough: two sets that can link share a class."""
    k = class_of(size)
    return [k, k - 1] if k and percent * size <= 100 * (LEAST_CLASS << 2 * (k - 1)) else [k]


def point(tokens: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((tokens % np.uint64(groups)).astype(np.int64), minlength=groups).astype(np.uint32)


def may_link(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """100 * overlap >= percent * union, where union = sizes - overlap."""
    return (100 + percent) * overlap.astype(np.int64) >= percent * sizes.astype(np.int64)


class CountTree:
    """R-tree, loaded in bulk, over count vectors; ``near`` gives what the bounds can't exclude."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int):
        self.percent = percent
        self.order = np.lexsort((points.argmax(axis=1), sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        top, least, most = self.points, self.sizes, self.sizes
        while len(top) > FANOUT or not self.levels:
            cuts = np.arange(0, len(top), FANOUT)
            top, least, most = np.maximum.reduceat(top, cuts, axis=0), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((top, least, most))

    def _pass(self, top, least, most, point, size) -> np.ndarray:
        fits = (100 * most >= self.percent * size) & (self.percent * least <= 100 * size)
        return fits & may_link(np.minimum(top, point).sum(axis=1, dtype=np.int64), size + least, self.percent)

    def near(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows, as numbered when the tree was built, whose points pass every bound."""
        at = np.arange(len(self.levels[-1][0]))
        for top, least, most in self.levels[::-1]:
            at = at[self._pass(top[at], least[at], most[at], point, size)]
            below = len(self.sizes) if top is self.levels[0][0] else len(self.levels[[x[0] is top for x in self.levels].index(True) - 1][0])
            at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            at = at[at < below]
        return self.order[at[self._pass(self.points[at], self.sizes[at], self.sizes[at], point, size)]]


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row that the pairs (a, b) connect each of n rows with."""
    own = np.arange(n)
    while len(a):
        low = np.minimum(own[a], own[b])
        was = own.copy()
        np.minimum.at(own, a, low)
        np.minimum.at(own, b, low)
        np.minimum.at(own, was[a], low)
        np.minimum.at(own, was[b], low)
        own = own[own]
        if (own == was).all():
            return own
    return own


def connect(points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Pairs of rows that pass the bounds, enough of them to connect all rows that such pairs connect."""
    tree, fresh, a, b = CountTree(points, sizes, percent), np.ones(len(sizes), bool), [], []
    for first in range(len(sizes)):
        stack = [first] if fresh[first] else []
        fresh[first] = False
        while stack:
            x = stack.pop()
            found = tree.near(points[x], int(sizes[x]))
            found = found[fresh[found]]
            fresh[found] = False
            a += [x] * len(found)
            b += found.tolist()
            stack += found.tolist()
    return a, b


def _blobs(bucket: np.ndarray, rows: np.ndarray, kind: int) -> pa.RecordBatch:
    """One row for each bucket, holding its records."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    names, cuts = np.unique(bucket, return_index=True)
    ends = [*cuts[1:].tolist(), len(bucket)]
    return pa.record_batch([pa.array(names.astype(np.int64)), pa.array(np.full(len(names), kind, np.int32)), pa.array([rows[i:j].tobytes() for i, j in zip(cuts.tolist(), ends)], pa.binary())], schema=_BLOB)


_KEY = np.dtype([("key", "u8"), ("node", "i8")])


def keys_kind(k: int) -> int:
    return 2 * k


def points_kind(k: int) -> int:
    return 2 * k + 1


def _point(k: int) -> np.dtype:
    """Counts travel in bytes. One of 255 stands for any count from 255 on, which bounds overlaps from above: see ``packed``."""
    return np.dtype([("node", "i8"), ("n", "i8"), ("at", "u1", (groups_of(k),))])


def packed(points: np.ndarray) -> np.ndarray:
    return np.minimum(points, 255).astype(np.uint8)


def unpacked(points: np.ndarray) -> np.ndarray:
    """Counts for bounds. A full byte counts as more than any set has, so that no bound falls below the truth."""
    if not (points == 255).any():
        return points
    out = points.astype(np.uint32)
    out[points == 255] = 1 << 24
    return out


def _classes(t: pa.Table) -> list[int]:
    return sorted({k // 2 for k in t["kind"].to_pylist()})


def _gather(t: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(b for k, b in zip(t["kind"].to_pylist(), t["blob"].to_pylist()) if k == kind), dtype)


def _home(node: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(node.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def common_tokens(docs: DataFrame, n_docs: int, width: int) -> np.ndarray:
    """Tokens of at least three of at most about SAMPLE_DOCS documents, rarest first; at most SAMPLE_TOKENS of the most frequent."""

    def held(batches):
        for batch in batches:
            got = [s for s in shingle_sets(batch["text"], width) if len(s)]
            if got:
                u, n = np.unique(np.concatenate(got), return_counts=True)
                yield _blobs((u >> np.uint64(60)).astype(np.int64), np.rec.fromarrays([u, n.astype(np.int64)], dtype=[("key", "u8"), ("n", "i8")]), 0)

    def summed(t: pa.Table) -> pa.Table:
        rows = _gather(t, 0, np.dtype([("key", "u8"), ("n", "i8")]))
        u, at = np.unique(rows["key"], return_inverse=True)
        n = np.bincount(at, rows["n"]).astype(np.int64)
        keep = np.flatnonzero(n >= 3)
        keep = keep[np.argsort(-n[keep], kind="stable")][:SAMPLE_TOKENS]
        return pa.table({"key": u[keep].view(np.int64), "n": n[keep]})

    share = int(min(1.0, SAMPLE_DOCS / max(1, n_docs)) * 1_000_000)
    few = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share).select("text")
    top = few.mapInArrow(held, _BLOB_DDL).groupBy("bucket").applyInArrow(summed, "key long, n long").orderBy(F.desc("n"), "key").limit(SAMPLE_TOKENS)
    rows = top.toArrow()
    return rows["key"].to_numpy().view(np.uint64)[::-1].copy()


def row_key() -> Column:
    """128-bit name of a row's doc_id and text; only rows that are equal in both share it (a null text is empty)."""
    named = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))
    return F.unhex(F.md5(F.concat(named, F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))))


def doc_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n_shingles, node); node is null for an empty set."""

    def sets(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            got = list(shingle_sets(batch["text"], width))
            yield pa.record_batch([batch["doc_id"], batch["key"], pa.array([len(s) for s in got], pa.int64()), pa.array([node_of(s) if len(s) else None for s in got], pa.int64())], names=["doc_id", "key", "n_shingles", "node"])

    return docs.withColumn("key", row_key()).mapInArrow(sets, "doc_id long, key binary, n_shingles long, node long")


def candidates(docs: DataFrame, n_docs: int, width: int, percent: int) -> DataFrame:
    """Edges (u, v) between nodes; their components hold every link."""
    buckets = max(1, -(-n_docs // BUCKET_DOCS))
    common = common_tokens(docs, n_docs, width)
    by_hash = np.argsort(common)
    ordered = common[by_hash]

    def emit(batches):
        for batch in batches:
            held: dict[int, list] = {}
            seen: set[int] = set()
            for s in shingle_sets(batch["text"], width):
                if not len(s):
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                seen.add(node)
                count = len(s) - -(-percent * len(s) // 100) + 1
                first = s[:count]
                if len(ordered):
                    at = np.searchsorted(ordered, s).clip(max=len(ordered) - 1)
                    known = ordered[at] == s
                    if known[:count].any():
                        first = np.concatenate([s[~known], common[np.sort(by_hash[at[known]])]])[:count]
                for k in classes(len(s), percent):
                    held.setdefault(k, []).append((node, len(s), point(s, groups_of(k)), mix(first + np.uint64(k))))
            for k, rows in held.items():
                keys = np.empty(sum(len(r[3]) for r in rows), _KEY)
                keys["key"], keys["node"] = np.concatenate([r[3] for r in rows]), np.repeat([r[0] for r in rows], [len(r[3]) for r in rows])
                yield _blobs((keys["key"] % np.uint64(buckets)).astype(np.int64), keys, keys_kind(k))
                points = np.array([(r[0], r[1], packed(r[2])) for r in rows], _point(k))
                yield _blobs(_home(points["node"], buckets), points, points_kind(k))

    def shared_keys(t: pa.Table) -> pa.Table:
        kept = t.filter(pa.compute.equal(pa.compute.bit_wise_and(t["kind"], 1), 1)).select(["bucket", "kind", "blob"]).cast(_BLOB)
        out = []
        for k in _classes(t):
            rows = _gather(t, keys_kind(k), _KEY)
            if len(rows):
                rows = rows[np.lexsort((rows["node"], rows["key"]))]
                same = rows["key"][1:] == rows["key"][:-1]
                rows = rows[np.r_[True, ~same | (rows["node"][1:] != rows["node"][:-1])]]
                same = rows["key"][1:] == rows["key"][:-1]
                rows = rows[np.r_[False, same] | np.r_[same, False]]
                out.append(_blobs(_home(rows["node"], buckets), rows, keys_kind(k)))
        return pa.concat_tables([pa.Table.from_batches(out, _BLOB), kept])

    def with_points(t: pa.Table) -> pa.Table:
        out = []
        for k in _classes(t):
            rows, at = _gather(t, keys_kind(k), _KEY), _gather(t, points_kind(k), _point(k))
            if not len(rows):
                continue
            bucket = (rows["key"] % np.uint64(buckets)).astype(np.int64)
            out.append(_blobs(bucket, rows, keys_kind(k)))
            node, first = np.unique(at["node"], return_index=True)
            to = np.unique(np.rec.fromarrays([bucket, rows["node"]], names="bucket,node"))  # each point once for a bucket
            out.append(_blobs(to["bucket"], at[first[np.searchsorted(node, to["node"])]], points_kind(k)))
        return pa.Table.from_batches(out, _BLOB)

    def linked(t: pa.Table) -> pa.Table:
        u, v = [], []
        for k in _classes(t):
            rows, at = _gather(t, keys_kind(k), _KEY), _gather(t, points_kind(k), _point(k))
            if not len(rows):
                continue
            node, first = np.unique(at["node"], return_index=True)
            n, points = at["n"][first], unpacked(at["at"][first])
            own = np.searchsorted(node, rows["node"])[np.argsort(rows["key"], kind="stable")]
            key = np.sort(rows["key"])
            cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            length = np.diff(np.r_[cuts, len(key)])
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size in np.unique(length[length <= FANOUT]):  # a single leaf: all its pairs
                i, j = np.triu_indices(int(size), 1)
                own_cuts = cuts[length == size]
                for part in np.array_split(own_cuts, len(own_cuts) * len(i) // 1_000_000 + 1):
                    x, y = own[(part[:, None] + i).ravel()], own[(part[:, None] + j).ravel()]
                    fits = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
                    a.append(x[fits])
                    b.append(y[fits])
            pairs = np.unique(np.concatenate(a) * len(node) + np.concatenate(b))  # a pair shares many keys
            a, b = [], []
            for part in np.array_split(pairs, len(pairs) * groups_of(k) // 4_000_000 + 1):
                x, y = part // len(node), part % len(node)
                good = may_link(np.minimum(points[x], points[y]).sum(axis=1, dtype=np.int64), n[x] + n[y], percent)
                a.append(x[good])
                b.append(y[good])
            for cut, size in zip(cuts[length > FANOUT].tolist(), length[length > FANOUT].tolist()):
                mine = own[cut : cut + size]
                x, y = connect(points[mine], n[mine], percent)
                a.append(mine[np.array(x, np.int64)])
                b.append(mine[np.array(y, np.int64)])
            root = labels(len(node), np.concatenate(a), np.concatenate(b))
            at = np.flatnonzero(root != np.arange(len(node)))
            u.append(node[at])
            v.append(node[root[at]])
        return pa.table({"u": np.concatenate([np.zeros(0, np.int64), *u]), "v": np.concatenate([np.zeros(0, np.int64), *v])})

    df = docs.select("text").mapInArrow(emit, _BLOB_DDL)
    for step in (shared_keys, with_points):
        df = df.groupBy("bucket").applyInArrow(step, _BLOB_DDL)
    return df.groupBy("bucket").applyInArrow(linked, "u long, v long")


def _chunks(n: str, weight: str):
    """How many chunks hold n sets of so many shingles: never more than sets."""
    return F.least(F.col(n), F.ceil(F.greatest(F.col(n) / CHUNK, F.col(weight) / CHUNK_SHINGLES)))


def _each(first, last):
    return F.explode(F.sequence(first.cast("long"), last.cast("long")))


def verified(docs: DataFrame, sets: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, component): what links connect, of the candidates found(node, component)."""
    keys = sets.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.max("n_shingles").alias("n"))
    member = written(found.join(keys, "node"))
    sized = member.join(member.groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("w")).withColumn("k", _chunks("m", "w")), "component")
    salts = F.when(F.col("k") > 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    salted = sized.withColumn("salt", F.explode(salts)).withColumn("c", F.pmod(F.xxhash64("node", "salt"), F.col("k")))
    classes = components(_linked_in_tiles(docs, salted.select("node", "key", "n", F.xxhash64("component", "salt", "c").alias("tile")), width, percent))
    large = sized.where("k > 1").select("component", "node", "key", "n")
    if not large.head(1):
        return classes
    large = written(large.join(classes.withColumnRenamed("component", "class"), "node", "left").withColumn("class", F.coalesce("class", "node")))
    by_class = large.groupBy("component", "class").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    main = by_class.groupBy("component").agg(F.max(F.struct("m", "w", "class")).alias("main"), F.sum("m").alias("all_m"), F.sum("w").alias("all_w"))
    main = main.select("component", "main.*", (F.col("all_m") - F.col("main.m")).alias("rest_m"), (F.col("all_w") - F.col("main.w")).alias("rest_w")).where("rest_m > 0")
    main = written(main.select("component", F.col("class").alias("main"), _chunks("rest_m", "rest_w").alias("r"), _chunks("m", "w").alias("a")))
    if not main.head(1):
        return classes
    # chunks 0 to r - 1 hold the other members and meet all chunks; chunks r to r + a - 1 hold the largest class
    own = large.join(main, "component").withColumn("inside", F.col("class") == F.col("main"))
    own = own.withColumn("c", F.when(F.col("inside"), F.col("r") + F.pmod(F.xxhash64("node"), F.col("a"))).otherwise(F.pmod(F.xxhash64("node"), F.col("r"))))
    met = own.withColumn("x", _each(F.lit(0), F.when(F.col("inside"), F.col("r")).otherwise(F.col("r") + F.col("a")) - 1))
    tiles = met.select("node", "key", "n", F.xxhash64("component", F.least("c", "x"), F.greatest("c", "x")).alias("tile"))
    more = _linked_in_tiles(docs, tiles, width, percent)
    return components(classes.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))


def _linked_in_tiles(docs: DataFrame, tiles: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges (u, v) of links between the nodes of a tile, enough to connect all that its links connect. tiles: (node, key, n, tile)."""
    dealt = written(tiles)
    n, weight = dealt.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    packs = max(1, -(-n // (2 * CHUNK)), -(-weight // (2 * CHUNK_SHINGLES)))
    texts = docs.groupBy(row_key().alias("key")).agg(F.min("text").alias("text"))  # rows of one key hold one text
    with_text = texts.join(dealt.hint("merge"), "key").select("tile", "node", "text", F.pmod("tile", F.lit(packs)).alias("pack"))

    def verify(t: pa.Table) -> pa.Table:
        tile, node = t["tile"].to_numpy(), t["node"].to_numpy()
        got = list(shingle_sets(t["text"], width))
        order = np.lexsort((node, tile))
        cuts = np.flatnonzero(np.r_[True, tile[order][1:] != tile[order][:-1]])
        u, v = [], []
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
            rows = [x for x in order[i:j].tolist() if len(got[x]) and node_of(got[x]) == node[x]]
            if len(rows) < 2:
                continue
            sizes = np.array([len(got[x]) for x in rows], np.int64)
            groups = groups_of(class_of(int(sizes.max())))
            points = np.array([point(got[x], groups) for x in rows])
            tree, fresh = CountTree(points, sizes, percent), np.ones(len(rows), bool)
            for first in range(len(rows)):
                stack = [first] if fresh[first] else []
                fresh[first] = False
                while stack:
                    x = stack.pop()
                    near = tree.near(points[x], int(sizes[x]))
                    near = near[fresh[near]]
                    if not len(near):
                        continue
                    both = np.concatenate([got[rows[y]] for y in near.tolist()])
                    at = np.searchsorted(got[rows[x]], both).clip(max=sizes[x] - 1)
                    hits = np.add.reduceat((got[rows[x]][at] == both).astype(np.int64), np.r_[0, np.cumsum(sizes[near])[:-1]])
                    near = near[may_link(hits, sizes[x] + sizes[near], percent)]
                    fresh[near] = False
                    stack += near.tolist()
                    u += [int(node[rows[x]])] * len(near)
                    v += [int(node[rows[y]]) for y in near.tolist()]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return with_text.groupBy("pack").applyInArrow(verify, "u long, v long")


def linked_rows(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, key, n_shingles, component) of every row; component is null for a row without words."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = written(doc_sets(docs, width))
    found = written(components(candidates(docs, sets.count(), width, percent)))
    linked = verified(docs, sets, found, width, percent)
    return sets.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: sets link when 100 * overlap >= percent * union."""
    named = linked_rows(docs, width, percent)
    least = named.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    return named.join(least, "component", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def op2(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


QUERIES = {"op2_ngram_jaccard_join": op2}
