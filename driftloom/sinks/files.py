"""CSV sinks and atomic files on the driver; large outputs go to a folder that all executors write."""

from __future__ import annotations

import csv
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Typed, python_text
from ..sources.scan import spark_encoding


class SinkError(ValueError):
    """An output that can't be written."""


def atomic(path: str | Path, write: Callable, encoding: str = "utf-8", newline: str | None = "") -> Path:
    """Let ``write`` fill a temporary file beside ``path``, then put it in its place; nothing is left of a failure."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding=encoding, newline=newline) as f:
            write(f)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return path


def _remote(url: str):
    """Hadoop's path and file system of a URL."""
    spark = SparkSession.getActiveSession()
    at = spark._jvm.org.apache.hadoop.fs.Path(url)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def target_exists(path: str) -> bool:
    if "://" not in path:
        return Path(path).exists()
    at, files = _remote(path)
    return files.exists(at)


def publish(url: str, write: Callable, encoding: str, newline: str | None) -> str:
    """``atomic`` for a URL: the file is made in a temporary folder, copied beside its target, and then renamed."""
    at, files = _remote(url)
    spark = SparkSession.getActiveSession()
    with tempfile.TemporaryDirectory(prefix="driftloom-") as folder:
        made = atomic(Path(folder) / "out", write, encoding, newline)
        beside = spark._jvm.org.apache.hadoop.fs.Path(f"{url}.{uuid.uuid4().hex}.part")
        files.mkdirs(at.getParent())
        files.copyFromLocalFile(spark._jvm.org.apache.hadoop.fs.Path(made.as_uri()), beside)
        files.delete(at, False)
        if not files.rename(beside, at):
            files.delete(beside, False)
            raise SinkError(f"cannot write: {url}")
    return url


def as_text(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The named columns as the text a file shows; other columns are dropped."""
    return df.select(*[python_text(Typed(F.col(f"`{c}`"), t)).alias(c) for c, t in types.items()])


def precheck(outputs: dict[str, object], resolve: Callable[[str], str]) -> None:
    """Before anything is written: distinct targets, none there that may not be replaced."""
    seen: dict[str, str] = {}
    for name, spec in outputs.items():
        path = resolve(spec.path)
        if path in seen:
            raise SinkError(f"outputs.{name}: same path as outputs.{seen[path]}: {path}")
        seen[path] = name
        if not spec.header:
            raise SinkError(f"outputs.{name}: header: false is not supported")
        if spec.if_exists == "error" and target_exists(path):
            raise SinkError(f"outputs.{name}: file already exists: {path}")


def write_csv(df: DataFrame, types: dict[str, str], order: list[str], path: str, encoding: str = "utf-8-sig", delimiter: str = ",", newline: str = "\n") -> Path | str:
    """One CSV file in row order, local or under a URL. A path that ends in a slash is a folder that executors fill.

    For one file, rows are sorted by Spark and stream through the driver partition by partition; no frame is collected.
    The parts of a folder are sorted, each with a header, in the encoding and with the line ends asked for, but without
    the byte order mark that ``utf-8-sig`` puts before a single file.
    """
    columns = list(types)
    ordered = df.orderBy(*order) if order else df
    if path.endswith("/"):
        options = {"header": True, "sep": delimiter, "quote": '"', "escape": '"', "encoding": spark_encoding(encoding), "lineSep": newline, "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        as_text(ordered, types).write.mode("overwrite").options(**options).csv(path)
        return path if "://" in path else Path(path)

    def fill(f) -> None:
        out = csv.writer(f, delimiter=delimiter, lineterminator=newline)
        out.writerow(columns)
        for row in as_text(ordered, types).toLocalIterator(prefetchPartitions=True):
            out.writerow(["" if v is None else v for v in row])

    return publish(path, fill, encoding, "") if "://" in path else atomic(path, fill, encoding)
