"""Operator 10: token ids in Parquet list columns, read back by column, row group and page.

Layout of a set of token files. Rows are range partitioned and sorted by document id, so file order is id order. Each
row has ``part`` (the writing partition), ``doc_id``, ``part_start`` (ids before the document in its partition),
``n_tokens`` and ``ids`` (array of int). The ids are dictionary encoded (a vocabulary fits one dictionary page); the
other columns are delta encoded by version 2 data pages. Row groups and pages have set sizes and carry page indexes, so
a reader of metadata never touches the ids, and a range of doc_id reads only its pages.

Defined results: a null text is an empty one and holds the end id alone; null document ids come first; rows that share
a document id keep one row each, ordered by a hash of their text; an empty table gives no rows. Other columns of the input are not
written. The write goes through Spark's commit protocol, so a lost executor's task is simply run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import prepare, shared_folder, table

#: Bytes of a row group and of a page in the token files.
ROW_GROUP, PAGE = 32 << 20, 256 << 10
END_ID = 2


def _encode(path: str, end_id: int | None):
    out = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, encoder = 0, tokens.encoder(path)
        for batch in batches:
            for x in tokens.steps(batch, "text"):
                ids, at = encoder.encode(x.column("text"))
                n = np.diff(at)
                if end_id is not None:
                    ids = np.insert(ids, at[1:], end_id)
                    n, at = n + 1, at + np.arange(len(at))
                rows = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([x.column("part"), x.column("doc_id"), pa.array(start + at[:-1]), pa.array(n), rows], schema=out)
                start += int(at[-1])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encode whole texts and write them in ascending order of the id column."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.xxhash64(text_column).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select(F.spark_partition_id().alias("part"), "doc_id", "text")
    ids = ordered.mapInArrow(_encode(tokenizer, end_id), "part int, doc_id long, part_start long, n_tokens long, ids array<int>")
    options = {"parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.dictionary.page.size": 1 << 20, "compression": "zstd"}
    ids.write.options(**{k: str(v) for k, v in options.items()}).mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before. Only what is selected is read."""
    files = spark.read.parquet(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each written partition
    bases = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return files.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rest = batch.column("ids"), [batch.column(k) for k in ("doc_id", "start")]
        at, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
        crcs = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(np.diff(at).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(files: DataFrame) -> DataFrame:
    """Per document of ``read_token_files``: where its ids start, how many there are, and their crc32."""
    return files.select("doc_id", "start", "ids").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokens.default_tokenizer())
    return digests(read_token_files(spark, path))


QUERIES = {"op10_token_files": op10_token_files}
ORACLES: dict[str, str] = {}
