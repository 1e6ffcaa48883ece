"""Segments of documents and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opweave.session import shared, written  # noqa: F401


def segments(docs: DataFrame, bytes_each: int) -> int:
    """How many segments of about ``bytes_each`` bytes of text the documents make, at least one."""
    return max(1, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bytes_each))


def segment(count: int):
    """A row's segment, from doc_id and text: neither null or repeated ids nor long texts gather in one."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(count))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (u, v) reach; nodes without edges don't appear.

    Alternating large-star and small-star steps until nothing changes, which takes rounds in the order of the
    logarithm of the longest path; each round is checkpointed, so that a lost executor costs one round. A hot
    node's rows meet in joins only, which AQE can split.
    """
    shared(edges.sparkSession)
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = small.where("u <> v").distinct().checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    low = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return low.unionByName(low.select(F.col("component").alias("node"), "component").distinct())
