"""Approximate nearest neighbours by multi-index hashing.

Codes: vectors are scaled to length 1, rotated to principal axes and then by a learned rotation that
brings them close to the corners of a cube (iterative quantisation); signs are the bits. The fit uses a
bounded sample (``FIT_ROWS``), and so does the search radius: the Hamming distance within which the fit's
own queries have ``FIT_RECALL`` of their true neighbours (in the whole table neighbours are nearer).

Search: codes are split into ``SUBSTRINGS``, each with an index from substring value to rows. By the
pigeonhole principle a code within radius r agrees with the query's, but for floor(r / m) bits (one less
in most substrings), in one substring at least; those buckets are probed, the retrieved codes within r
are kept and their vectors are ranked by exact cosine. A query that finds too few rows widens r until it
has enough or all rows.

Equal vectors are one entry with its ``k + 1`` smallest ids, which is all that any answer can need. Index
shards of ``SHARD_ROWS`` entries meet blocks of ``BLOCK_QUERIES`` queries.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, either as
query or as candidate; vectors of different lengths never meet; ties go to the smaller id; with fewer
than k candidates all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opweave.llm._spark import written
from opweave.session import table

FIT_ROWS, FIT_QUERIES, FIT_RECALL, FIT_ROUNDS = 8192, 256, 0.97, 40
SUBSTRINGS, SHARD_ROWS, BLOCK_QUERIES = 4, 16_384, 16_384


class Codes:
    """Learned rotated binary codes of at most 64 bits."""

    def __init__(self, sample: np.ndarray, k: int):
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = x.mean(axis=0)
        bits = min(64, x.shape[1])
        _, _, axes = np.linalg.svd(x - self.mean, full_matrices=False)
        axes = np.pad(axes, ((0, max(0, bits - len(axes))), (0, 0)))[:bits].T
        v = (x - self.mean) @ axes
        turn = np.linalg.qr(np.random.default_rng(5).normal(size=(bits, bits)))[0]
        for _ in range(FIT_ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        self.map, self.bits = axes @ turn, bits
        q = x[: FIT_QUERIES]
        sims = q @ x.T
        np.fill_diagonal(sims, -2)
        near = np.argsort(-sims, axis=1)[:, :k]
        own = self(sample)
        away = np.bitwise_count(own[: len(q), None] ^ own[near])
        self.radius = int(np.quantile(away, FIT_RECALL)) if away.size else 0

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        signs = (x - self.mean) @ self.map >= 0
        return np.packbits(np.pad(signs, ((0, 0), (0, 64 - self.bits))), axis=1, bitorder="little").view(np.uint64).ravel()


class MultiIndex:
    """An index from each substring's value to the codes that have it."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.bits = codes, bits
        self.cuts = [round(bits * j / SUBSTRINGS) for j in range(SUBSTRINGS + 1)]
        self.tables = []
        for a, b in zip(self.cuts, self.cuts[1:]):
            part = self._part(codes, a, b)
            order = np.argsort(part, kind="stable")
            keys, starts = np.unique(part[order], return_index=True)
            self.tables.append((order, keys, np.r_[starts, len(order)]))

    @staticmethod
    def _part(codes, a, b):
        return codes >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)

    def probe(self, code: np.uint64, radius: int) -> np.ndarray:
        """Every row whose code is within the radius, by probing the substrings' indexes."""
        each, spare = divmod(radius, SUBSTRINGS)
        seen = np.zeros(len(self.codes), bool)
        for j, (order, keys, starts) in enumerate(self.tables):
            most = each if j <= spare else each - 1
            if most < 0:
                continue
            width = self.cuts[j + 1] - self.cuts[j]
            own = self._part(code, self.cuts[j], self.cuts[j + 1])
            if most <= 2 and len(keys) > 200:  # few masks: look each one up
                masks = np.array([sum(1 << b for b in c) for r in range(min(most, width) + 1) for c in combinations(range(width), r)], np.uint64)
                want = own ^ masks
                at = np.searchsorted(keys, want).clip(max=len(keys) - 1)
                at = at[keys[at] == want]
            else:  # more masks than keys: go over the keys
                at = np.flatnonzero(np.bitwise_count(keys ^ own) <= most)
            size = starts[at + 1] - starts[at]
            seen[order[np.repeat(starts[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        rows = np.flatnonzero(seen)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def neighbours(df: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of df(vec_id, embedding) where is_query holds."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    first = Window.partitionBy("embedding").orderBy("vec_id")
    kept = df.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    entries = written(kept.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("embedding")))  # at most k + 1 ids each
    asked = df.where(is_query)
    queries = written(asked.groupBy("embedding").agg(F.min("vec_id").alias("query")).withColumn("dim", F.size("embedding")))
    out = []
    for dim, n in sorted(map(tuple, entries.groupBy("dim").count().collect())):
        own, ask = entries.where(F.col("dim") == dim), queries.where(F.col("dim") == dim)
        share = min(1.0, 1.2 * FIT_ROWS / n)
        sample = own.where(F.pmod(F.xxhash64("embedding"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(FIT_ROWS).toArrow()
        if sample.num_rows:
            out.append(_search(own, ask, Codes(_matrix(sample["embedding"]), k), n, k))
    if not out:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    named = asked.select(F.col("vec_id").alias("query_id"), "embedding").join(queries, "embedding").select("query_id", "query")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = named.join(top, "query").where("vec_id <> query_id").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", "vec_id", "score")


def _search(entries: DataFrame, queries: DataFrame, codes: Codes, n: int, k: int) -> DataFrame:
    """(query, vec_id, score): the k + 1 best ids of every shard for every query."""
    shards, blocks = -(-n // SHARD_ROWS), max(1, -(-queries.count() // BLOCK_QUERIES))
    h = lambda m: F.pmod(F.xxhash64("embedding"), F.lit(m))
    all_of = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    data = entries.select("embedding", "ids", h(shards).alias("s"), all_of(blocks).alias("b")).withColumn("cell", F.col("s") * blocks + F.col("b"))
    ask = queries.select("embedding", "query", h(blocks).alias("b"), all_of(shards).alias("s")).withColumn("cell", F.col("s") * blocks + F.col("b"))

    def search(have: pa.Table, want: pa.Table) -> pa.Table:
        q_out, id_out, score_out = [], [], []
        if have.num_rows and want.num_rows:
            x, q = _matrix(have["embedding"]), _matrix(want["embedding"])
            ids = have["ids"].to_pylist()
            size, least = np.linalg.norm(x, axis=1), np.array([i[0] for i in ids])
            index, q_codes = MultiIndex(codes(x), codes.bits), codes(q)
            for query, v, code in zip(want["query"].to_pylist(), q, q_codes):
                radius = codes.radius
                rows = index.probe(code, radius)
                while len(rows) <= k and radius < codes.bits:
                    radius = min(codes.bits, radius + SUBSTRINGS)
                    rows = index.probe(code, radius)
                score = (x[rows] * v).sum(axis=1) / (size[rows] * np.sqrt((v * v).sum()))
                if len(rows) > 4 * k:
                    enough = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    rows, score = rows[score >= enough], score[score >= enough]
                top = np.lexsort((least[rows], -score))[: k + 1]
                pairs = sorted((-float(score[t]), i) for t in top for i in ids[rows[t]])[: k + 1]
                q_out += [query] * len(pairs)
                id_out += [i for _, i in pairs]
                score_out += [-s for s, _ in pairs]
        return pa.table({"query": pa.array(q_out, pa.int64()), "vec_id": pa.array(id_out, pa.int64()), "score": pa.array(score_out, pa.float64())})

    return data.groupBy("cell").cogroup(ask.groupBy("cell")).applyInArrow(search, "query long, vec_id long, score double")


def op1(spark, sf_dir):
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


QUERIES = {"op1_nearest_neighbours": op1}
