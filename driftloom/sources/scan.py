"""Scans: CSV files, Parquet files and frames, as one shape: typed fields and a row number.

A schema names fields, the headers they may come from, normalizers and types. A cast that fails is fatal for the load
(``LoadError`` with examples); it is looked for in one pass over the source that also tells whole-number decimals apart.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.casts import cast, integral
from ..functions.normalize import normalize
from ..functions.text import SPARK_TYPES, Typed, declared_type
from .keep import keep

ROW = "__row_number"
# Texts of a CSV field that stand for a missing value.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


class LoadError(ValueError):
    """A source that can't be loaded."""


@dataclass
class Loaded:
    """A frame of fields by their schema names plus ROW, and the declared type of each field."""

    df: DataFrame
    types: dict[str, str]
    rows: int | None = None
    #: Header names each field came from.
    headers: list[str] = field(default_factory=list)

    def typed(self) -> dict[str, Typed]:
        return {n: Typed(F.col(f"`{n}`"), t) for n, t in self.types.items()}


def resolve(path: str, base: str | Path | None) -> str:
    """Relative paths start at the configuration's folder; paths with a scheme and absolute ones stay."""
    if "://" in path or path.startswith("/"):
        return path
    return str((Path(base or ".") / path).resolve()) + ("/" if path.endswith("/") else "")


def spark_encoding(name: str) -> str:
    return {"utf-8-sig": "utf-8", "utf_8_sig": "utf-8", "utf8": "utf-8", "cp932": "windows-31j", "latin-1": "iso-8859-1", "latin1": "iso-8859-1", "ascii": "us-ascii"}.get(name.lower(), name)


def read_header(path: str, encoding: str = "utf-8-sig", delimiter: str = ",") -> list[str]:
    """The first record of a local CSV file."""
    try:
        with open(path, encoding=encoding, newline="") as f:
            return next(csv.reader(f, delimiter=delimiter), [])
    except (OSError, UnicodeError, LookupError) as e:
        raise LoadError(f"cannot read CSV header: {path}: {e}") from e


def numbered(df: DataFrame, name: str = ROW, scanned: bool = False) -> DataFrame:
    """df with consecutive row numbers from 1 in its partitions' order.

    Partitions are counted first (one number each comes to the driver), so no task sees more than its own rows. The
    rows are kept before they are counted, as a plan that runs twice may deal them out in another way each time; only
    files that are just ``scanned`` have the same partitions in every run. A partition that wasn't counted is an error.
    """
    tagged = df.select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    tagged = tagged if scanned else keep(tagged)
    total, before = 0, []
    for part, n in sorted((r["__part"], r["count"]) for r in tagged.groupBy("__part").count().collect()):
        before.append((part, total - (part << 33) + 1))
        total += n
    shifts = F.broadcast(df.sparkSession.createDataFrame(before, "__part int, __shift bigint"))  # one row for each partition
    shift = F.coalesce("__shift", F.raise_error(F.lit("a partition wasn't counted before its rows were numbered")).cast("bigint"))
    return tagged.join(shifts, "__part", "left").withColumn(name, F.col("__at") + shift).drop("__part", "__at", "__shift")


# Character sets in which a line end and a quotation mark are bytes of their own, as in ASCII.
ASCII_LIKE = ["utf-8", "us-ascii", "ascii", "iso-8859-1", "latin-1", "windows-1252", "cp1252", "windows-31j", "shift_jis", "euc-jp"]


def needs_one_task(spark: SparkSession, path: str, reader, encoding: str) -> bool:
    """Whether a CSV file must be read whole by one task: some line has an odd number of quotation marks.

    Then a line end may stand inside quotes. Files that fill a single task anyway aren't looked at.
    """
    if spark_encoding(encoding).lower() not in ASCII_LIKE:
        return True
    if reader.option("multiLine", False).csv(path)._jdf.queryExecution().toRdd().getNumPartitions() <= 1:
        return True
    marks = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(marks % 2 == 1).isEmpty()


def raw_csv(spark: SparkSession, path: str, encoding: str = "utf-8-sig", delimiter: str = ",", multi_line: bool | None = None) -> DataFrame:
    """All columns as text, missing markers as null, with ROW.

    Files with line ends inside quotes need ``multi_line``, which reads a file in one task; files without are split
    among tasks. None finds out which it is, in one pass over the lines.
    """
    reader = spark.read.option("header", True).option("sep", delimiter).option("encoding", spark_encoding(encoding)).option("quote", '"').option("escape", '"').option("inferSchema", False).option("mode", "PERMISSIVE")
    try:
        whole = needs_one_task(spark, path, reader, encoding) if multi_line is None else multi_line
        df = reader.option("multiLine", whole).csv(path)
    except Exception as e:
        raise LoadError(f"cannot read CSV: {path}: {str(e).splitlines()[0]}") from e
    cleaned = df.select(*[F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")).alias(c.lstrip("﻿")) for c in df.columns])
    return numbered(cleaned, scanned=True)


def raw_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A single Parquet file keeps its own row order; several are numbered in the order of their partitions."""
    df = spark.read.parquet(path)
    if len(df.inputFiles()) == 1:
        return df.select("*", (F.col("_metadata.row_index") + 1).alias(ROW))
    return numbered(df, scanned=True)


def raw_source(spark: SparkSession, source, base: str | Path | None, frames: dict[str, DataFrame] | None = None, name: str = "") -> DataFrame:
    """The frame given under ``name``, else the source's file. A given frame without ROW is numbered as it lies."""
    if frames and name in frames:
        df = frames[name]
        return df if ROW in df.columns else numbered(df)
    path = resolve(source.path, base)
    if not source.header:
        raise LoadError(f"{name}: header: false is not supported")
    if path.endswith((".parquet", ".parquet/")):
        return raw_parquet(spark, path)
    if "://" not in path and not Path(path).exists():
        raise LoadError(f"{name}: file not found: {path}")
    return raw_csv(spark, path, source.encoding, source.delimiter)


def pick_header(name: str, spec, columns: list[str]) -> str | None:
    """The first listed source column that is there; without a list, the field's own name."""
    wanted = spec.source_columns or [name]
    return next((c for c in wanted if c in columns), None)


def load(spark: SparkSession, source, base: str | Path | None = None, frames: dict[str, DataFrame] | None = None, name: str = "input", limit: int | None = None, max_rows: int | None = None, check: bool = True) -> Loaded:
    """Read a source and apply its schema. ``limit`` keeps the first rows; more than ``max_rows`` rows are an error."""
    raw = raw_source(spark, source, base, frames, name)
    if max_rows is not None:
        n = raw.limit(max_rows + 1).count()
        if n > max_rows:
            raise LoadError(f"{name}: row count exceeds the limit of {max_rows}")
    if limit is not None and limit >= 0:
        raw = raw.where(F.col(ROW) <= limit)
    return apply_schema(raw, source.schema, name, check)


def apply_schema(raw: DataFrame, schema: dict, name: str = "input", check: bool = True) -> Loaded:
    """Aliases, normalizers and casts in one projection. Without a schema, all columns as they are."""
    present = [c for c in raw.columns if c != ROW]
    if not schema:
        kinds = {f.name: declared_type(f.dataType) for f in raw.schema if f.name != ROW}
        return Loaded(raw, kinds, headers=present)
    kinds_of = {f.name: declared_type(f.dataType) for f in raw.schema}
    values, fails, whole, types, used = {}, {}, {}, {}, []
    for n, spec in schema.items():
        header = pick_header(n, spec, present)
        if header is None:
            if spec.required:
                raise LoadError(f"{name}.{n}: required column is missing: {', '.join(spec.source_columns or [n])}")
            values[n], types[n] = F.lit(None).cast(SPARK_TYPES[spec.type]), spec.type
            continue
        used.append(header)
        col = F.col(f"`{header}`")
        if kinds_of[header] == spec.type != "string" and not spec.normalize:
            values[n], types[n] = col.cast(SPARK_TYPES[spec.type]), spec.type
            continue
        text = normalize(col.cast("string"), spec.normalize)
        value, failed = cast(text, spec.type, spec.date_format, [str(v) for v in spec.true_values] or None, [str(v) for v in spec.false_values] or None)
        values[n], types[n] = value.col, spec.type
        if spec.type != "string":
            fails[n] = (failed, text)
        if spec.type == "decimal":
            whole[n] = integral(text)
    if check and fails:
        tests = [F.count_if(f).alias(f"f_{i}") for i, (f, _) in enumerate(fails.values())] + [F.count_if(~w).alias(f"w_{i}") for i, w in enumerate(whole.values())]
        row = raw.agg(*tests).first()
        for i, (n, (failed, text)) in enumerate(fails.items()):
            if row[f"f_{i}"]:
                bad = [r[0] for r in raw.where(failed).orderBy(ROW).select(text).limit(5).collect()]
                raise LoadError(f"{name}.{n}: cannot convert to {schema[n].type}: {', '.join(map(repr, bad))}")
        for i, n in enumerate(whole):
            if not row[f"w_{i}"]:  # whole numbers alone, none missing: they stay whole
                values[n], types[n] = values[n].cast("bigint"), "integer"
    return Loaded(raw.select(*[v.alias(n) for n, v in values.items()], ROW), types, headers=used)


def check_keys(loaded: Loaded, name: str, keys: list[str]) -> None:
    """Reference keys exist, are never null, and are unique; raises with the first rows that offend."""
    for k in keys:
        if k not in loaded.types:
            raise LoadError(f"{name}: key column is not defined: {k}")
    cols = [F.col(f"`{k}`") for k in keys]
    missing = cols[0].isNull()
    for c in cols[1:]:
        missing = missing | c.isNull()
    nulls = [r[0] for r in loaded.df.where(missing).orderBy(ROW).select(ROW).limit(5).collect()]
    if nulls:
        raise LoadError(f"{name}: key is missing at rows: {', '.join(map(str, nulls))}")
    if loaded.df.groupBy(*cols).count().where("count > 1").isEmpty():
        return
    twice = loaded.df.groupBy(*cols).count().where("count > 1").drop("count")
    found = [r[0] for r in loaded.df.join(twice, keys, "left_semi").orderBy(ROW).select(ROW).limit(5).collect()]
    raise LoadError(f"{name}: duplicate key at rows: {', '.join(map(str, found))}")
