"""Near-duplicates by the Jaccard similarity of word shingles, for the pipeline.

Words are as in ``simhash``; a text is the set of its runs of ``WORDS`` words, as 64-bit hashes. Texts with equal sets are one
vertex. Two vertices are candidates where they agree on all ``ROWS`` minima of one of ``BANDS`` bands; a pair at the bound of
0.8 meets in none of them with a chance of (1 - 0.8^4)^40, below 1e-9. Candidates are verified by the whole sets, in whole numbers.

No pair inside a group is needed once the group is known. The members of a band's bucket are first compared with one of them, drawn
anew for each band: in a cloud of near copies every text meets as many others as it shares bands with, which leaves few outside the
cloud's group. Then members that lie in different groups by now are compared with each other, but for pairs whose sketches show that they can't
reach the bound. So the groups are those of all candidate pairs.

Defined results: texts without words are one set; fewer words than a shingle give the whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, cut, join_hot, prepare, row_key
from .components import components
from .hmm_lm import split_words
from .tokens import steps

WORDS, BANDS, ROWS = 5, 40, 4
#: Similarity from which two texts are near-duplicates, as a fraction.
OVER, UNDER = 4, 5
#: Bits of a sketch at most; sets of more than some thousand shingles are told apart less sharply then, and still safely.
MOST_BITS = 1 << 12
#: Text bytes that are taken apart at a time.
STEP = 3 << 20
#: Shingles whose minima are taken at once.
CHUNK = 1 << 15

_random = np.random.default_rng(42)
_FACTORS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each bit of the result depends on all bits of x (finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(flat, at): the sorted distinct shingle hashes of text i are flat[at[i]:at[i + 1]], one at least."""
    import xxhash

    lists = split_words(texts)
    at = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    own = np.fromiter([xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.uint64, len(coded.dictionary))
    h = own[coded.indices.to_numpy()]
    runs = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for j in range(words if len(runs) else 0):
        runs = _mixed(runs * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(runs)])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        else:
            x = np.full(1, b - a, np.uint64)
            for v in h[a:b]:
                x = _mixed(x * np.uint64(0x9E3779B97F4A7C15) + v)
            out.append(x)
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)]).astype(np.int64)


def _band_keys(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, BANDS) hashes of the minima of each band."""
    texts = len(at) - 1
    low = np.full((BANDS * ROWS, texts), (1 << 64) - 1, np.uint64)
    for i in range(0, len(flat), CHUNK):
        x = flat[i : i + CHUNK]
        first, last = np.searchsorted(at, i, "right") - 1, np.searchsorted(at, i + len(x), "left")
        begin = np.maximum(at[first:last], i) - i
        for k in range(BANDS * ROWS):
            low[k, first:last] = np.minimum(low[k, first:last], np.minimum.reduceat(x * _FACTORS[k] + _TERMS[k], begin))
    out = np.zeros((texts, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(texts, b + 1, np.uint64)
        for r in range(ROWS):
            key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + low[b * ROWS + r])
        out[:, b] = key
    return out


def _names(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each set, in any order of its shingles."""
    sums = np.add.reduceat(_mixed(flat), at[:-1]) if len(at) > 1 else np.zeros(0, np.uint64)
    return _mixed(sums + np.diff(at).astype(np.uint64)).view(np.int64)


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, key, vertex, size, bands): key is ``row_key``, vertex names the set of shingles, of ``size`` members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in steps(batch, "text", STEP):
                flat, at = shingle_sets(x.column("text"))
                keys = _band_keys(flat, at).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at)) * BANDS, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("key"), pa.array(_names(flat, at)), pa.array(np.diff(at)), lists], ["doc_id", "key", "vertex", "size", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, key {KEY}, vertex long, size long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vertex, set) of the vertices whose row keys are in ``wanted`` (column key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in steps(batch, "text", STEP):
                flat, at = shingle_sets(x.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array(_names(flat, at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64)))], ["vertex", "set"])

    rows = docs.select(row_key().alias("key"), F.col("text").cast("string").alias("text")).join(wanted, "key", "left_semi").select("text")
    return rows.mapInArrow(run, "vertex long, set array<long>").dropDuplicates(["vertex"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of OVER / UNDER at least."""
    left = join_hot(pairs, sets.select(F.col("vertex").alias("a"), F.col("set").alias("x")), "a", "inner", pairs.groupBy("a").agg(F.count("*").alias("n")))
    both = left.join(sets.select(F.col("vertex").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return cut(both.where(shared * (OVER + UNDER) >= (F.size("x") + F.size("y")) * OVER).select("a", "b"))


def _sketches(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vertex, bits, low) of the wanted vertices: which hash values their shingles have, of 4 to 8 times as many as there
    are shingles (``MOST_BITS`` at most), and of half as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column("set"):
                h = _mixed(row.values.to_numpy().view(np.uint64))
                n = min(MOST_BITS, 64 << max(1, int(len(h)).bit_length() - 4))
                bits = np.zeros(n, np.uint8)
                bits[h % np.uint64(n)] = 1
                out.append([np.packbits(x, bitorder="little").view(np.int64) for x in (bits, bits[: n // 2] | bits[n // 2 :])])
            yield pa.RecordBatch.from_arrays([batch.column("vertex"), *(pa.array([o[i] for o in out], pa.list_(pa.int64())) for i in (0, 1))], ["vertex", "bits", "low"])

    return cut(sets.join(wanted, "vertex", "left_semi").mapInArrow(run, "vertex long, bits array<long>, low array<long>"))


def _reachable() -> Column:
    """Whether the sketches of a pair (columns a_ and b_ size, bits, low) leave a similarity of OVER / UNDER possible.

    A hash value that one set has and the other has not stands for one shingle at least that is not shared.
    """
    same = F.size("a_bits") == F.size("b_bits")
    x = F.when(same | (F.size("a_bits") < F.size("b_bits")), F.col("a_bits")).otherwise(F.col("a_low"))
    y = F.when(same | (F.size("b_bits") < F.size("a_bits")), F.col("b_bits")).otherwise(F.col("b_low"))
    alone = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: F.bit_count(u.bitwiseAND(F.bitwise_not(v)))), F.lit(0), lambda n, k: n + k)
    most = F.least(F.col("a_size") - alone(x, y), F.col("b_size") - alone(y, x))
    return (F.size(x) != F.size(y)) | (most * (OVER + UNDER) >= (F.col("a_size") + F.col("b_size")) * OVER)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, key, root): root names the group that all pairs of a similarity of OVER / UNDER at least link."""
    prepare(docs.sparkSession)
    rows = cut(marked(docs))
    vertices = rows.groupBy("vertex").agg(F.min("size").alias("size"), F.first("bands").alias("bands"))
    banded = cut(vertices.select("vertex", "size", F.explode("bands").alias("band")))
    drawn = F.min(F.struct(F.xxhash64("vertex", "band").alias("draw"), "vertex", "size")).alias("one")
    buckets = cut(banded.groupBy("band").agg(F.count("*").alias("n"), drawn).where("n > 1"))
    shared = cut(join_hot(banded, buckets.select("band", "one.vertex", "one.size").toDF("band", "one", "one_size"), "band", "inner", buckets.select("band", "n")))
    wanted = rows.select("vertex", "key").join(shared.select("vertex").distinct(), "vertex", "left_semi").groupBy("vertex").agg(F.min("key").alias("key")).select("key")
    sets = cut(_sets(docs, cut(wanted)))
    alike = lambda p, q: F.least(p, q) * UNDER >= F.greatest(p, q) * OVER
    first = cut(shared.where((F.col("vertex") != F.col("one")) & alike(F.col("size"), F.col("one_size"))).select(F.least("vertex", "one").alias("a"), F.greatest("vertex", "one").alias("b")).distinct())
    links = _verified(first, sets)
    roots = cut(components(links))
    # Members of buckets that hold more than one group so far.
    placed = cut(join_hot(shared.select("vertex", "size", "band"), roots.withColumnRenamed("node", "vertex"), "vertex").select("vertex", "size", "band", F.coalesce("root", "vertex").alias("root")))
    mixed = placed.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("band")
    open_ = cut(placed.join(mixed, "band", "left_semi"))
    open_ = open_.join(_sketches(sets, open_.select("vertex").distinct()), "vertex")
    one, two = (open_.select("band", F.col("vertex").alias(v), *[F.col(c).alias(f"{v}_{c}") for c in ("size", "bits", "low", "root")]) for v in "ab")
    rest = one.join(two, (one["band"] == two["band"]) & (F.col("a") < F.col("b")) & (F.col("a_root") != F.col("b_root")) & alike(F.col("a_size"), F.col("b_size")) & _reachable()).select("a", "b").distinct()
    more = _verified(cut(rest.join(first, ["a", "b"], "left_anti")), sets)
    if not more.isEmpty():
        roots = cut(components(links.unionByName(more)))
    found = join_hot(rows.select("doc_id", "key", "vertex"), roots.withColumnRenamed("node", "vertex"), "vertex")
    return found.select("doc_id", "key", F.coalesce("root", "vertex").alias("root"))
