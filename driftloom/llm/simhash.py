"""Operator 1: SimHash fingerprints, pigeonhole blocks, and the groups of near-duplicates they link.

A fingerprint has 64 bits, bit j being the majority of bit j over the XXH64 hashes of a text's shingles. Two
fingerprints link when at most ``max_bits`` bits differ. Cut into m blocks, two such fingerprints agree on at least
m - max_bits of them, so every set of m - max_bits blocks is a table, and each link is met in at least one. m grows
with the number of fingerprints (``blocks_for``), so that chance agreements stay fewer than the fingerprints.

Only distinct fingerprints are blocked: exact copies, however many, are one. A block that two share is a pair; a block
of up to ``GROUP`` is compared in one numpy step that hands out a spanning forest, not its pairs. A larger block (a
cloud of thousands of near-copies) is never gathered: each member names all values within ``ceil(max_bits / 2)`` bits of itself outside
the block, members that name the same value are within reach of each other by definition, and linking them through the
smallest one gives the same groups in rows that grow with the members, not with their square.

Defined results: no words (null, empty or blank text) give fingerprint zero, linked like any other; fewer words than a
shingle give the whole sequence; a null doc_id gets the group's smallest doc_id, or null where its group has none; repeated rows are linked; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEY, cut, join_hot, prepare, row_key, spread, table, without
from .components import components

WORDS, SEED, MAX_BITS = 4, 42, 4
#: Members of a block that are compared in one step.
GROUP = 512
_ALL = (1 << 64) - 1


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """ASCII lower case, words between white space, shingles with repeats, majority of bits."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    end = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    begin = np.concatenate([[0], end[:-1] + 1])
    k = min(words, len(parts))
    last = len(parts) - k + 1
    h = np.fromiter([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(begin[:last].tolist(), end[k - 1 :].tolist(), strict=True)], np.uint64, last)
    ones = np.zeros(64, np.int64)
    for i in range(0, last, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, key, fp): key is ``row_key``, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fps.view(np.int64))], ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, key {KEY}, fp long")


def blocks_for(n: int, max_bits: int = MAX_BITS) -> int:
    """The least number of blocks for which chance agreements of n random fingerprints stay below n."""
    m = max_bits + 2
    while m < 4 * max_bits and comb(m, max_bits) * n / 2 ** (64 * (m - max_bits) / m) > 2:
        m += 1
    return m


def _masks(m: int, max_bits: int) -> list[int]:
    bounds = [round(64 * i / m) for i in range(m + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return [sum(c) for c in combinations(block, m - max_bits)]


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _stars(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            flat, at = batch.column("fps").flatten().to_numpy().view(np.uint64), batch.column("fps").offsets.to_numpy()
            at = at - at[0]
            for i, j in zip(at[:-1], at[1:], strict=True):
                x = flat[i:j]
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= max_bits
                todo = np.ones(len(x), bool)
                while todo.any():  # each part from its first member outwards
                    root = int(todo.argmax())
                    part = front = np.zeros(len(x), bool)
                    part[root] = True
                    while True:
                        front = near[front].any(axis=0) & ~part
                        if not front.any():
                            break
                        part = part | front
                    todo &= ~part
                    rest = x[part][1:] if part.sum() > 1 else x[:0]
                    a.append(np.full(len(rest), x[part][0], np.uint64))
                    b.append(rest)
            a, b = (np.concatenate([np.zeros(0, np.uint64), *c]).view(np.int64) for c in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _around(fp: Column, mask: Column, reach: int) -> Column:
    """All values within ``reach`` bits of fp that differ outside the mask only."""
    free = F.filter(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)), lambda bit: bit.bitwiseAND(mask) == 0)
    out = F.array(fp)
    for _ in range(reach):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, lambda v: F.transform(free, lambda bit: v.bitwiseXOR(bit))))))
    return out


def links(fps: DataFrame, n: int, max_bits: int = MAX_BITS, group: int = GROUP) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that reach whatever all links within max_bits reach."""
    masks = _masks(blocks_for(n, max_bits), max_bits)
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)]))
    rows = fps.select("fp", tables.alias("x")).select("fp", "x.mask", F.xxhash64("x.t", F.col("fp").bitwiseAND(F.col("x.mask"))).alias("key"))
    counts = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = counts.where("n = 2").where(_differing(F.col("a"), F.col("b")) <= max_bits).select("a", "b")
    keys = counts.where("n > 2").select("key", "n")
    many = keys.count()
    if not many:
        return pairs
    # The keys are broadcast only where their counted size is small; else both sides are shuffled by key.
    shared = cut(rows.join(F.broadcast(keys) if many <= 500_000 else keys, "key"))
    grouped = shared.where(F.col("n") <= group).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    found = pairs.unionByName(grouped.mapInArrow(_stars(max_bits), "a long, b long"))
    if not keys.where(F.col("n") > group).isEmpty():
        near = cut(shared.where(F.col("n") > group).select("fp", "key", F.explode(_around(F.col("fp"), F.col("mask"), ceil(max_bits / 2))).alias("at")))
        low = near.groupBy("key", "at").agg(F.min("fp").alias("a"), F.count("*").alias("k")).where("k > 1")
        reached = near.join(low, ["key", "at"]).where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
        # Values between two members are within max_bits of both ways when max_bits is even; checked all the same.
        found = found.unionByName(reached.where(_differing(F.col("a"), F.col("b")) <= max_bits) if max_bits % 2 == 0 else reached)
    return found.distinct()


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, words: int = WORDS, also: DataFrame | None = None) -> DataFrame:
    """(fp, doc_id, key, component_id, root): component_id is the smallest doc_id in reach; root names the group.

    ``also``: a stored table (key, root) of groups found in another way; rows of one root are linked like fingerprints in reach.
    """
    prepare(docs.sparkSession)
    return groups(cut(fingerprints(docs, words)), max_bits, also)


def _linked(marked: DataFrame, also: DataFrame) -> DataFrame:
    """(a, b): each group's fingerprints, linked to its smallest one."""
    own = cut(marked.select("key", "fp").distinct().join(also.select("key", "root").distinct(), "key").select("root", "fp").distinct())
    low = cut(own.groupBy("root").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1"))
    return join_hot(own, low.select("root", "a"), "root", "inner", low.select("root", "n")).where("fp <> a").select("a", F.col("fp").alias("b"))


def groups(marked: DataFrame, max_bits: int = MAX_BITS, also: DataFrame | None = None) -> DataFrame:
    """``near_duplicates`` of a stored table of fingerprints."""
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    met = links(distinct.select("fp"), distinct.count(), max_bits)
    roots = cut(components(met if also is None else met.unionByName(_linked(marked, also))))
    lows = roots.join(distinct, roots["node"] == distinct["fp"]).select("root", "fp", "low")
    named = lows.join(lows.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id", "root")
    alone = distinct.join(named.select("fp"), "fp", "left_anti").select("fp", F.col("low").alias("component_id"), F.col("fp").alias("root"))
    return join_hot(marked, cut(named.unionByName(alone)), "fp")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS, also: DataFrame | None = None) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id (null is largest); of repeated rows, one.

    ``also`` as in ``near_duplicates``.
    """
    return first_of_groups(docs, cut(near_duplicates(docs, max_bits, also=also)))


def first_of_groups(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``keep_one`` by a stored table of groups (doc_id, key, root)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    chosen = cut(found.groupBy("root").agg(first).select("first.key"))
    kept = without(docs, cut(found.select("key").distinct().join(chosen, "key", "left_anti")))
    twice = cut(found.groupBy("key").count().where("count > 1").join(chosen, "key", "left_semi").select("key"))
    if twice.isEmpty():
        return kept
    return without(docs, cut(found.select("key").distinct().join(chosen.join(twice, "key", "left_anti"), "key", "left_anti"))).unionByName(kept.join(twice, row_key() == twice["key"], "left_semi").dropDuplicates(["doc_id", "text"]))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
