"""Column statistics of a loaded source, one row per field."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import python_text
from ..sources.scan import ROW, Loaded

SAMPLES, TOP = 3, 5


def column_metrics(source: Loaded) -> DataFrame:
    """(field, type, counts, rates, lengths, min, max, mean): exact, in one aggregation over all fields.

    Distinct counts are exact: each field's values are counted by value first, then the values.
    """
    typed = source.typed()
    aggs = [F.count("*").alias("rows")]
    for i, v in enumerate(typed.values()):
        aggs += [F.count(v.col).alias(f"n{i}"), F.min(v.col if v.type in ("integer", "decimal") else F.lit(None).cast("double")).cast("double").alias(f"lo{i}"), F.max(v.col if v.type in ("integer", "decimal") else F.lit(None).cast("double")).cast("double").alias(f"hi{i}"), F.avg(v.col if v.type in ("integer", "decimal") else F.lit(None).cast("double")).alias(f"mean{i}")]
        size = F.char_length(v.col) if v.type == "string" else F.lit(None).cast("int")
        aggs += [F.min(size).alias(f"short{i}"), F.max(size).alias(f"long{i}")]
    wide = source.df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(v.type).alias("type"), F.col(f"n{i}").alias("non_null_count"), (F.col("rows") - F.col(f"n{i}")).alias("missing_count"), F.when(F.col("rows") > 0, (F.col("rows") - F.col(f"n{i}")) / F.col("rows")).otherwise(0.0).alias("missing_rate"), F.col(f"short{i}").cast("bigint").alias("min_length"), F.col(f"long{i}").cast("bigint").alias("max_length"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col(f"mean{i}").alias("mean")) for i, (n, v) in enumerate(typed.items())])
    metrics = wide.select(F.explode(rows).alias("m")).select("m.*")
    unique = value_counts(source).groupBy("field").agg(F.count("*").alias("unique_count"))
    joined = metrics.join(unique, "field", "left").withColumn("unique_count", F.coalesce("unique_count", F.lit(0)).cast("bigint"))
    return joined.withColumn("duplicate_count", F.col("non_null_count") - F.col("unique_count"))


def _cells(source: Loaded) -> DataFrame:
    """(field, value, ROW) of every value that isn't missing, as text."""
    cells = F.array(*[F.struct(F.lit(n).alias("field"), python_text(v).alias("value")) for n, v in source.typed().items()])
    return source.df.select(ROW, F.explode(cells).alias("c")).select("c.field", "c.value", ROW).where("value is not null")


def value_counts(source: Loaded) -> DataFrame:
    """(field, value, n, first): each field's distinct values as text, how often they occur, and where first."""
    return _cells(source).groupBy("field", "value").agg(F.count("*").alias("n"), F.min(ROW).alias("first"))


def top_values(source: Loaded, top: int = TOP) -> DataFrame:
    """(field, rank, value, n) of the most frequent values of text fields; ties go to the one met first.

    Values are counted once; Spark cuts each task's candidates of a field to ``top`` before they meet.
    """
    texts = [n for n, t in source.types.items() if t == "string"]
    if not texts:
        return source.df.sparkSession.createDataFrame([], "field string, rank int, value string, n bigint")
    counts = value_counts(Loaded(source.df.select(*[F.col(f"`{n}`") for n in texts], ROW), {n: "string" for n in texts}))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "first")))
    return best.where(F.col("rank") <= top).select("field", "rank", "value", "n")


def sample_values(source: Loaded, samples: int = SAMPLES) -> dict[str, list[str]]:
    """The first values of each field that aren't missing, found for all fields in one pass."""
    at = F.row_number().over(Window.partitionBy("field").orderBy(ROW))
    found = _cells(source).withColumn("at", at).where(F.col("at") <= samples).orderBy("field", "at").collect()
    return {n: [r["value"] for r in found if r["field"] == n] for n in source.types}
