"""What the training-data operators share: session set-up, lineage cuts and joins that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.keep import checkpoint_folder, remove_at_exit

#: The repository folder that holds the package.
ROOT = Path(__file__).resolve().parents[2]
#: A key is hot when it holds more than 1 / HOT_SHARE of all rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Set the checkpoint folder (see ``checkpoint_folder``) and send the package to the Python workers.

    A Python function takes the list of what was sent along when it is handed to Spark, so this comes first.
    """
    checkpoint_folder(spark)
    _ship(spark.sparkContext)
    return spark


def _ship(context: SparkContext) -> None:
    """Send the package once a session; what the workers' own path holds doesn't matter then."""
    if getattr(context, "_driftloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="driftloom-")  # the driver's own: executors fetch the file from the driver
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "driftloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((ROOT / "driftloom").rglob("*")):
            if path.is_file() and path.suffix != ".pyc":
                out.write(path, path.relative_to(ROOT))
    context.addPyFile(str(archive))
    context._driftloom_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; it lives as long as the driver's process, as results are read from it."""
    base = checkpoint_folder(prepare(spark))
    path = f"{base}/{name}-{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"
    remove_at_exit(spark, path)
    return path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt out anew where it has fewer partitions than the cluster has cores (a small or single file).

    Larger inputs have more partitions than cores and stay where they are.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


def cut(df: DataFrame) -> DataFrame:
    """Compute once, keep in the shared checkpoint folder, and forget the lineage."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


#: Keys that may be broadcast (32 bytes each); more are met in a shuffled join.
KEYS_SENT = 1_000_000
#: The type of ``row_key``.
KEY = "struct<a:long,b:long>"


def row_key(id_column: str = "doc_id", text_column: str = "text") -> Column:
    """128 bits of hash of a document's id and text; rows that share them are repeats of one another."""
    both = F.col(id_column), F.col(text_column)
    return F.struct(F.xxhash64(*both).alias("a"), F.xxhash64(F.lit(1), *both).alias("b"))


def without(docs: DataFrame, keys: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs less the rows whose ``row_key`` is in ``keys`` (column key, stored and without repeats)."""
    name = next(n for n in ("_key", *(f"_key{i}" for i in range(1000))) if n not in docs.columns)
    drop = keys.select(F.col("key").alias(name))
    return docs.withColumn(name, row_key(id_column, text_column)).join(F.broadcast(drop) if drop.count() <= KEYS_SENT else drop, name, "left_anti").select(*docs.columns)


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """Join on ``key`` (unique in ``right``) where a few keys may hold most rows of ``left``.

    Keys with more than 1/HOT_SHARE of the rows are at most HOT_SHARE, so their part of ``right`` has a proven bound
    and is broadcast; all other keys meet in a shuffled join, in which none of them is large. ``left`` is read twice
    and should be cheap to read. Rows with a null key stay in the shuffled part, spread by Spark as unmatched.
    ``counts`` (key, n) has the rows of ``left`` by key, if they are known and stored.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    total = left.count()
    hot = counts.where(F.col(key).isNotNull() & (F.col("n") > max(200, total // HOT_SHARE))).select(key)
    keys = [r[0] for r in hot.limit(HOT_SHARE + 1).collect()]
    if not keys:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    return left.where(~is_hot).join(right.where(~is_hot), key, how).unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))


def vector_sum(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """The sum of the vectors of doubles that ``run`` makes of each partition's Arrow batches.

    Vectors meet in two steps: about as many tasks as the square root of the partitions add up theirs, so the driver
    gets that many vectors and no task many more.
    """
    columns = "part int, v array<double>"

    def row(part: int, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v))], ["part", "v"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v in run(batches):
            yield row(TaskContext.get().partitionId(), v)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            out += batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1).sum(axis=0)
        yield row(0, out)

    few = max(1, round(rows._jdf.queryExecution().toRdd().getNumPartitions() ** 0.5))
    met = rows.mapInArrow(each, columns).repartition(few, F.col("part") % few).mapInArrow(added, columns)
    return np.sum([v.values.to_numpy() for v in met.select("v").toArrow().column("v")] or np.zeros((1, size)), axis=0)
