"""Configurations and frames for tests."""

from driftloom.config.models import Migration, parse
from driftloom.sources.scan import ROW

HANDLING = {"error_output": "reports/errors.csv", "skipped_output": "reports/skipped.csv"}


def frame(spark, schema, data):
    names = schema + f", {ROW} long"
    return spark.createDataFrame([(*r, i) for i, r in enumerate(data, 1)], names)


def migration(schema, mappings, columns=None, **parts):
    outputs = {"out": {"path": "out.csv", "columns": columns or list(mappings)}}
    return parse(Migration, {"version": 1, "project": {"name": "t"}, "inputs": {"u": {"path": "u.csv", "schema": schema}}, "outputs": outputs, "mappings": {"out": mappings}, "error_handling": HANDLING, **parts})


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(ROW).collect()]
