import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from driftloom.llm import simhash
from driftloom.llm.components import components

from .support import ODD, ascii_lower, rows, table, words


def fingerprint(text):
    w = words(ascii_lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids, fps, bits=4):
    """Smallest id in reach, by trying all pairs."""
    low = list(range(len(fps)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                low[find(i)] = find(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            r = find(i)
            best[r] = min(best.get(r, d), d)
    return [best.get(find(i)) for i in range(len(fps))]


def test_odd_rows_match_brute_force(spark):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] & (2**64 - 1), r["component_id"]) for r in rows(simhash.near_duplicates(table(spark, ODD))))
    fps = [fingerprint(t) for _, t, *_ in ODD]
    wanted = sorted((d is None, d or 0, f, c) for (d, *_), f, c in zip(ODD, fps, reach([r[0] for r in ODD], fps), strict=True))
    assert got == wanted


def test_empty_table(spark):
    assert rows(simhash.near_duplicates(table(spark, []))) == []


def test_chains_and_clouds_are_linked_like_all_pairs(spark):
    rng = random.Random(3)
    fps, base = set(), rng.getrandbits(64)
    for _ in range(120):  # a cloud around one value, and chains that leave it
        x = base
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    chain = rng.getrandbits(64)
    for _ in range(40):
        fps.add(chain)
        for b in rng.sample(range(64), 3):
            chain ^= 1 << b
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    wanted = reach(list(range(len(fps))), fps)
    for group in (512, 8):  # the second takes the way of large blocks
        found = simhash.links(frame, len(fps), group=group).collect()
        assert all(bin((r["a"] ^ r["b"]) & (2**64 - 1)).count("1") <= 64 for r in found)
        index = {x: i for i, x in enumerate(signed)}
        low = list(range(len(fps)))

        def find(i, low=low):
            while low[i] != i:
                i = low[i]
            return i

        for r in found:
            a, b = find(index[r["a"]]), find(index[r["b"]])
            low[max(a, b)] = min(a, b)
        smallest = {}
        for i in range(len(fps)):
            smallest[find(i)] = min(smallest.get(find(i), i), i)
        assert [smallest[find(i)] for i in range(len(fps))] == wanted


def test_blocks_grow_with_the_table():
    sizes = [simhash.blocks_for(n) for n in (10, 10**5, 10**8, 10**11)]
    assert sizes == sorted(sizes) and sizes[0] == 6 and sizes[-1] > 8


def test_components_of_a_long_path(spark):
    order = np.random.default_rng(1).permutation(300)
    edges = spark.createDataFrame([(int(order[i]), int(order[i + 1])) for i in range(299)] + [(1000, 1001), (5, 5)], "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(300)} | {1000: 1000, 1001: 1000}


def test_components_by_rounds_and_by_one_task_agree(spark):
    rng = np.random.default_rng(3)
    pairs = rng.integers(0, 400, (260, 2)).tolist()
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long").repartition(5)
    one, many = ({r["node"]: r["root"] for r in components(edges, k).collect()} for k in (10**6, 0))
    assert one == many and len(set(one.values())) > 5
    assert components(edges.where("a < 0")).count() == 0


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark):
    docs = table(spark, ODD)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in rows(kept)]
    fps = [fingerprint(t) for _, t, *_ in ODD]
    groups = reach(list(range(len(ODD))), fps)
    assert len(ids) == len(set(groups)) and 7 not in ids and 1 in ids and 2 in ids and 3 not in ids
    twice = table(spark, [(7, "same text here for both rows", "en", "s", 1)] * 2 + [(8, "another text that differs from it all", "en", "s", 1)])
    assert sorted(r["doc_id"] for r in rows(simhash.keep_one(twice))) == [7, 8]


def test_hot_fingerprint_join(spark):
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("copy of one text for all").alias("text"))
    got = simhash.near_duplicates(many).agg(F.count("*").alias("n"), F.max("component_id").alias("c")).first()
    assert tuple(got) == (6000, 0)
