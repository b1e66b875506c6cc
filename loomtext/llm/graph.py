"""Connected components by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions

#: A node with more than this share of the edges (and over 1,000) is hot; so at most 2 / HOT_SHARE are.
HOT_SHARE = 1 / 1000
#: Edges, of 16 bytes, that one task solves.
FEW = 1_000_000


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _stars(edges: DataFrame, large: bool, most: float) -> DataFrame:
    """Every node's neighbours (the larger ones, or for the small star the smaller ones and itself) are joined to its least neighbour.

    Nodes with over `most` edges are few, by that number, and broadcast; their edges are dealt out evenly past the join."""
    if large:
        pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    hot = F.broadcast(least.where(F.col("n") > most).select("u", F.col("m").alias("hot")))
    cold = least.where(F.col("n") <= most).select(F.col("u").alias("dealt"), "m")
    joined = pairs.join(hot, "u", "left").withColumn("dealt", F.when(F.col("hot").isNull(), F.col("u")).otherwise(F.xxhash64("v")))
    joined = joined.join(cold, "dealt", "left").select("u", "v", F.coalesce("hot", "m").alias("m"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _stars_of(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Stars around the least node of each component of some edges."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = np.arange(len(nodes))
    a, z = ends[: len(u)], ends[len(u) :]
    while True:
        low, before = np.minimum(root[a], root[z]), root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[z], low)
        root = root[root]
        if (root == before).all():
            break
    far = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["u", "v"])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task, a batch at a time, to stars."""
    for b in batches:
        yield _stars_of(np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a task at once to stars."""
    parts = [(np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64)) for b in batches]
    if parts:
        yield _stars_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def components(edges: DataFrame, what: str, few: int = FEW) -> DataFrame:
    """node, component (its least node) of each node of `edges` (columns u, v, long). Nodes without an edge are not listed.

    Tasks first contract what they have. Up to `few` edges that are left, by count, one task solves the rest. Beyond, each round is two
    exchanges of narrow rows and is written to the shared folder, so the plan stays short and a lost executor costs one round; the number
    of rounds grows with the logarithm of the longest path. Shuffles are sized by the number of edges."""
    spark = edges.sparkSession
    edges = materialise(edges.where("u != v").mapInArrow(_contracted, "u long, v long"), what)
    before = _state(edges)
    if before[0] <= few:
        edges = materialise(edges.coalesce(1).mapInArrow(_solved, "u long, v long"), what)
        before = (0,)
    while before[0]:
        most = max(1000, HOT_SHARE * before[0])
        with partitions(spark, before[0]):
            edges = materialise(_stars(_stars(edges, True, most), False, most), what)
            now = _state(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
