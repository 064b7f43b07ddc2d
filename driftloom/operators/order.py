"""Consecutive numbers without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Row numbers that share a block are ranked in one task.
BLOCK = 1 << 20


def ranked(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with ``name``: 1, 2, ... by ``order``, a column of distinct row numbers.

    Rows are ranked inside blocks of BLOCK row numbers; the blocks' sizes are summed up over one row for each block.
    """
    blocked = df.withColumn("__block", F.floor(F.col(order) / BLOCK))
    sizes = blocked.groupBy("__block").agg(F.count("*").alias("__n"))
    before = sizes.select("__block", (F.sum("__n").over(Window.orderBy("__block")) - F.col("__n")).alias("__before"))
    inside = blocked.withColumn(name, F.row_number().over(Window.partitionBy("__block").orderBy(order)))
    return inside.join(before, "__block").withColumn(name, (F.col(name) + F.col("__before")).cast("bigint")).drop("__block", "__before")
