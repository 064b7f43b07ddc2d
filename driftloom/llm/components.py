"""Connected components of a link table, by alternating stars; nothing but counters reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, prepare

_EDGES = "a long, b long"
#: Links (16 bytes each) that one task takes together; more go through the rounds.
TOGETHER = 1_000_000


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_forest`` of all batches as one."""
    met = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())])).combine_chunks()
    yield from _forest(iter(met.to_batches()))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each Arrow batch as stars: the same reachability by fewer and shorter links."""
    for batch in batches:
        ends = np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()])
        names, ids = np.unique(ends, return_inverse=True)
        a, b = ids.reshape(2, -1)
        low = np.arange(len(names))
        while True:  # hook the larger root to the smaller one, then halve the paths
            x, y = low[a], low[b]
            if not (x != y).any():
                break
            np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
            while (low != low[low]).any():
                low = low[low]
        own = np.flatnonzero(low != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[low[own]])], ["a", "b"])


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the smallest one in reach instead."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count("*").alias("n")))
    return join_hot(both.where("b > a"), low.select("a", "low"), "a", "inner", low.select("a", "n")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, is linked to the smallest of them. Links run from a down to b."""
    low = cut(edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")))
    moved = join_hot(edges, low.select("a", "low"), "a", "inner", low.select("a", "n")).where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select("a", F.col("low").alias("b"))).distinct()


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def components(links: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(node, root) of every node in ``links`` (columns a, b: long); root is the smallest node in reach.

    Self links are dropped and repeated ones count once. Up to ``together`` links, once each partition's are stars, one task does the rest:
    each exchange of a round costs the driver a thread for a minute. Else each round is cut through the checkpoint folder; their number grows as
    the logarithm of the longest path, squared at worst.
    """
    prepare(links.sparkSession)
    down = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut(down.mapInArrow(_forest, _EDGES))
    if edges.count() <= together:
        return _named(cut(edges.coalesce(1).mapInArrow(_together, _EDGES)))
    mark = None
    while True:
        edges = cut(_small(cut(_large(edges))))
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            return _named(edges)
        mark = new
