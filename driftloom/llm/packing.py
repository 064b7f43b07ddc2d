"""Operator 2: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``seq_len`` ids: full ones, and a rest. The histogram of piece lengths (at
most ``seq_len`` entries) is the only thing that the driver needs. Lengths are placed longest first, each into the
shortest packs that there are, as counts of packing patterns rather than one piece at a time; where even the shortest
pack has no room, new packs begin. A piece then finds its pattern by its rank among the pieces of its length. Ranks
come from a range partitioning by (length, document, start), so a length that a third of all pieces share is spread
over many tasks.

Size of what is sent to the executors: each length splits at most one pattern and opens at most one, so there are at
most 2 * seq_len patterns whatever the input, and (partitions + seq_len) rank offsets.

Defined results: a null text is empty; every document gets its closing id, so an empty one is a piece of one id; null
and repeated document ids are packed like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import cut, prepare, spread, table

SEQ_LEN = 1024
CLOSING_ID = 0
#: Text bytes that are encoded at a time; small, as packing often runs where workers still hold what others left.
STEP = 2 << 20
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Names of ``pack``; columns of its input that have them are given up.
_OWN = ("sequence_id", "offset", "_part")


def pieces(docs: DataFrame, tokenizer: str, seq_len: int = SEQ_LEN, closing_id: int = CLOSING_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: its document, the ids before it there, its length and crc32, and the document's ids in all.

    ``with_ids`` adds the ids themselves, as ``sequences`` needs them.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            for x in tokens.steps(batch, "text", STEP):
                ids, at = encoder.encode(x.column("text"))
                ids = np.insert(ids, at[1:], closing_id).astype("<u4")
                total = np.diff(at) + 1
                at = at + np.arange(len(at))
                n = -(-total // seq_len)
                row = np.repeat(np.arange(len(n)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * seq_len
                length = np.minimum(seq_len, total[row] - start)
                begin = at[:-1][row] + start
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begin, begin + length, strict=True)]
                cols = [x.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(total[row])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)), pa.int32()), pa.array(ids.view(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES + (", ids array<int>" if with_ids else ""))


def patterns(histogram: dict[int, int], seq_len: int = SEQ_LEN) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order of placing, packs of that kind) for a histogram of lengths."""
    by_size: dict[int, list[list]] = defaultdict(list)  # filled length -> [[lengths, packs], ...]
    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        placed: list[tuple[int, list]] = []
        for size in sorted(k for k, v in by_size.items() if v and k + length <= seq_len):
            while left and by_size[size]:
                kind = by_size[size][-1]
                n = min(left, kind[1])
                placed.append((size + length, [(*kind[0], length), n]))
                kind[1] -= n
                left -= n
                if not kind[1]:
                    by_size[size].pop()
            if not left:
                break
        each = seq_len // length
        if left >= each > 1:  # further pieces of this length fill packs of their own
            placed.append((each * length, [(length,) * each, left // each]))
            left %= each
        if left:
            placed.append((left * length if each > 1 else length, [(length,) * (left if each > 1 else 1), 1 if each > 1 else left]))
        for size, kind in placed:
            by_size[size].append(kind)
    return [(tuple(k), n) for size in sorted(by_size, reverse=True) for k, n in by_size[size] if n]


def _places(packs: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of the intervals, the sequence of each first rank, and the offset in the sequence."""
    ranks: dict[int, int] = defaultdict(int)
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    base = 0
    for lengths, n in packs:
        offset = 0
        for length in lengths:
            found[length].append((ranks[length], base, offset))
            ranks[length] += n
            offset += length
        base += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in found.items()}


def pack(cut_pieces: DataFrame, seq_len: int = SEQ_LEN, keys: tuple[str, ...] = ("doc_id", "start", "ids_crc32")) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``seq_len``; sequences have no gaps.

    Other columns are carried; one that has a name of the two is replaced.
    """
    ordered = cut(cut_pieces.drop(*_OWN)).repartitionByRange("length", *keys).sortWithinPartitions("length", *keys)
    ranked = cut(ordered.withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["length"], r["_part"], r["count"]) for r in ranked.groupBy("length", "_part").count().collect())
    histogram: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for length, part, n in counts:
        before[part, length] = histogram[length]
        histogram[length] += n
    sent = ranked.sparkSession.sparkContext.broadcast((before, _places(patterns(histogram, seq_len))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, places = sent.value
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            sequence, offset = np.empty((2, len(lengths)), np.int64)
            bounds = [0, *(np.flatnonzero(np.diff(lengths)) + 1), len(lengths)] if len(lengths) else [0]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                length, part = int(lengths[a]), batch.column("_part")[int(a)].as_py()
                rank = before[part, length] + seen[length] + np.arange(b - a)
                seen[length] += int(b - a)
                first, base, at = places[length]
                k = np.searchsorted(first, rank, "right") - 1
                sequence[a:b], offset[a:b] = base[k] + rank - first[k], at[k]
            keep = [n for n in batch.schema.names if n != "_part"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_part")
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, (sequence_id, ids, starts), of pieces that were made ``with_ids`` and then packed.

    Each piece has its ids with it, so documents without an id and documents that share one come out whole.
    """
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("x"))  # seq_len ids at most
    return rows.select("sequence_id", F.flatten("x.ids").alias("ids"), F.col("x.offset").alias("starts"))


def padding(packed: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """One row: sequences, ids, and pad ids (none for a sequence whose length is a power of two)."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    pad = F.when(F.expr("bit_count(n) = 1"), 0).otherwise(seq_len - F.col("n"))
    return filled.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(pad).alias("pad_ids"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spread(table(spark, sf_dir, "documents")), tokens.default_tokenizer()))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
