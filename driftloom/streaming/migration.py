"""A migration's routes over a stream: rows go to outputs, errors and skips without state.

The compiled plan of a migration is row-wise but for its lookups, which are joins to static references. So the same plan
runs on a stream whose rows carry their own row number; policies that stop a run belong to batches and are left out.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..config.models import Migration
from ..plans.migration import Plan, compile_migration
from ..sources.scan import ROW


def stream_migration(spark: SparkSession, config: Migration, stream: DataFrame, references: dict[str, DataFrame] | None = None, base: str | Path | None = None) -> Plan:
    """The plan with a streaming input; its outputs, errors and skipped frames can be written by ``writeStream``."""
    if ROW not in stream.columns:
        raise ValueError(f"a streaming input needs a column {ROW}")
    name = next(iter(config.inputs))
    return compile_migration(spark, config, base, {name: stream} | (references or {}), check=False)
