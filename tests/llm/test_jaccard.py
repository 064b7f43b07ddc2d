import random

import numpy as np

import corpus_pipeline
from driftloom.llm import jaccard

from .support import ODD, ascii_lower, rows, table, words


def shingles(text):
    w = words(ascii_lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(data):
    """The smallest doc_id of each group of all pairs of 0.8 or more."""
    sets, group = [shingles(t) for _, t, *_ in data], list(range(len(data)))
    for i in range(len(data)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted(min(d for (d, *_), h in zip(data, group, strict=True) if h == g) for g in set(group))


def edited(rng, base, n):
    out = list(base)
    for i in rng.sample(range(len(base)), n):
        out[i] = f"edit{rng.randrange(10**9)}"
    return " ".join(out)


def test_stage_links_all_texts_of_similarity_0_8(spark):
    rng = random.Random(5)
    data = [r for r in ODD if r[0] is not None]
    for g in range(12):
        base = [f"w{g}x{rng.randrange(500)}" for _ in range(rng.choice([6, 30, 150, 400]))]
        data += [(100 * (g + 1) + i, edited(rng, base, min(len(base), i * len(base) // 120)), "en", "s", 1) for i in range(12)]
    docs = table(spark, data, clashes=False)
    got = sorted(r["doc_id"] for r in rows(corpus_pipeline.near_duplicates(spark, docs, "")))
    assert got == brute(data)


def test_chain_of_near_copies_is_one_group(spark):
    base = [f"w{i}" for i in range(200)]
    data = [(i, " ".join(base[4 * i : 4 * i + 120]), "en", "s", 1) for i in range(20)]
    assert brute(data) == [0]
    assert [r["doc_id"] for r in rows(corpus_pipeline.near_duplicates(spark, table(spark, data, clashes=False), ""))] == [0]


def test_sets_of_shingles():
    import pyarrow as pa

    texts = ["a b c d e f", "A  b c d e", "a b", "", None, "a b c d e a b c d e"]
    flat, at = jaccard.shingle_sets(pa.array(texts))
    got = [set(flat[a:b].tolist()) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [len(s) for s in got] == [2, 1, 1, 1, 1, 5] and got[1] < got[0] and got[3] == got[4] != got[2]


def test_sketches_never_rule_out_a_near_duplicate(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    sets = []
    for size in (1, 3, 7, 8, 15, 16, 31, 33, 60, 64, 127, 130, 250, 256, 900, 1100, 6000):
        base = rng.integers(-(1 << 62), 1 << 62, size)
        sets += [np.unique(np.concatenate([base[k:], rng.integers(-(1 << 62), 1 << 62, j)])) for k, j in ((0, 0), (size // 12, 0), (0, size // 8), (size // 10, size // 10), (size // 5, size // 5))]
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(sets)], "vertex long, set array<long>")
    near = jaccard._sketches(df, df.select("vertex")).join(df.select("vertex", F.size("set").alias("size")), "vertex")
    one, two = (near.select(F.col("vertex").alias(v), *[F.col(c).alias(f"{v}_{c}") for c in ("size", "bits", "low")]) for v in "ab")
    kept = {(r["a"], r["b"]): r["ok"] for r in one.crossJoin(two).where("a < b").select("a", "b", jaccard._reachable().alias("ok")).collect()}
    alike = {(a, b): len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in kept}
    assert all(kept[p] for p, j in alike.items() if j >= 0.8) and sum(j >= 0.8 for j in alike.values()) > 40
    assert sum(kept[p] for p, j in alike.items() if j < 0.6 and len(sets[p[0]]) > 50 and 0.8 < len(sets[p[0]]) / len(sets[p[1]]) < 1.25) == 0
