"""Migration jobs: one lazy plan in which every row is routed to outputs, errors or skips by columns of its own.

``compile_migration`` builds the plan; nothing runs but what loading needs (cast and key checks). ``run_migration``
counts the routes in one pass, applies the policies, and returns frames that the sinks write.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.models import Migration
from ..expr.checks import CheckError, evaluate_check
from ..expr.scope import ERROR, CompileError, Scope, error
from ..functions.text import Typed, python_text
from ..operators.filters import skip_reason
from ..operators.mapping import Mapper, References, derive, first_error, values_used
from ..operators.validate import validate
from ..sources.keep import keep
from ..sources.scan import ROW, Loaded, check_keys, load

ERRORS = "run_id string, row_number bigint, stage string, output_name string, field string, rule string, message string, row_json string"


@dataclass
class Plan:
    """``routed`` has all rows and their routes; the rest are selections of it."""

    config: Migration
    routed: DataFrame
    fields: dict[str, Typed]
    outputs: dict[str, DataFrame]
    errors: DataFrame
    skipped: DataFrame
    types: dict[str, dict[str, str]]
    references: dict[str, Loaded]


@dataclass
class Result:
    plan: Plan
    status: str
    counts: dict[str, int]
    output_counts: dict[str, int]
    outputs: dict[str, DataFrame]
    errors: DataFrame
    skipped: DataFrame
    checks: list[dict] = field(default_factory=list)
    stop_reason: str | None = None
    stop_message: str | None = None


def _json(values: dict[str, Typed], row: bool = True) -> Column:
    """Typed values as JSON; dates are shown as Python shows them, missing values stay as null."""
    named = [x for n, v in values.items() for x in (F.lit(n), python_text(v) if v.type == "date" else v.col)]
    return F.to_json(F.named_struct(*([F.lit(ROW), F.col(ROW)] if row else []), *named), {"ignoreNullFields": "false"})


def _target(rule, config: Migration) -> tuple[str, str]:
    """(output, column) that an output validation is about."""
    space, dot, name = rule.field.partition(".")
    if dot and space in config.outputs and (rule.output or space) == space:
        return space, name
    return rule.output or next(iter(config.outputs)), rule.field


def compile_migration(spark: SparkSession, config: Migration, base: str | Path | None = None, frames: dict[str, DataFrame] | None = None, limit: int | None = None, check: bool = True, kept_rows: bool = False) -> Plan:
    """frames: sources given as DataFrames, by the name of the input or reference; others are read from their paths.

    ``kept_rows`` computes the routed rows once and keeps them, for a caller that needs several of the plan's frames.
    """
    name, source = next(iter(config.inputs.items()))
    runtime = config.runtime
    loaded = load(spark, source, base, frames, name, limit, runtime.max_input_rows, check)
    references = {}
    for r, spec in config.references.items():
        references[r] = load(spark, spec, base, frames, r, None, runtime.max_reference_rows, check)
        if check:
            check_keys(references[r], r, spec.keys)
    scope = Scope(name, loaded.typed())
    fields = dict(scope.fields)
    rules = config.validations.input
    df = validate(loaded.df, rules, fields, {i: v.field.partition(".")[2] for i, v in enumerate(rules)}, references, "__invalid")
    mapper = Mapper(df, scope, References(references, {n: c.key for n, c in config.references.items()}, values_used(config)))
    try:
        errors = derive(mapper, config.derived)
    except CompileError as e:
        errors = [error("derived", "derived", str(e))]
    reason, filter_errors = skip_reason(config.filters, scope)
    valid = F.size("__invalid") == 0
    df = mapper.df.withColumn("__failed", F.when(valid, first_error([*errors, *filter_errors])))
    mapper.df = df.withColumn("__skipped", F.when(valid & F.col("__failed").isNull(), reason))
    types: dict[str, dict[str, str]] = {}
    kept = valid & F.col("__failed").isNull() & F.col("__skipped").isNull()
    for j, (out, spec) in enumerate(config.outputs.items()):
        made = {c: mapper.compile(config.mappings[out][c], c) for c in spec.columns}
        types[out] = {c: m.value.type for c, m in made.items()}
        bad = [m.error for m in made.values() if m.error is not None]
        mapper.df = mapper.df.withColumns({f"__row_{j}": F.struct(*[m.value.col.alias(c) for c, m in made.items()]), f"__failed_{j}": F.when(kept, first_error(bad))})
        own = [v for v in config.validations.output if _target(v, config)[0] == out]
        cols = {c: Typed(F.col(f"__row_{j}")[c], t) for c, t in types[out].items()}
        mapper.df = validate(mapper.df, own, cols, {i: _target(v, config)[1] for i, v in enumerate(own)}, references, f"__invalid_{j}")
    routed = mapper.df
    routed = keep(mapper.df) if kept_rows else mapper.df
    outputs: dict[str, DataFrame] = {}
    parts: list[tuple[Column, str, str | None]] = [(F.col("__invalid"), "input_validation", None), (F.when(F.col("__failed").isNotNull(), F.array("__failed")), "mapping", None)]
    shown = _json(fields)
    for j, out in enumerate(config.outputs):
        made = {c: Typed(F.col(f"__row_{j}")[c], t) for c, t in types[out].items()}
        fine = kept & F.col(f"__failed_{j}").isNull()
        good = fine & (F.size(f"__invalid_{j}") == 0)
        outputs[out] = routed.where(good).select(*[v.col.alias(c) for c, v in made.items()], ROW)
        parts.append((F.when(F.col(f"__failed_{j}").isNotNull(), F.array(f"__failed_{j}")), "mapping", out))
        parts.append((F.when(fine, F.col(f"__invalid_{j}")), "output_validation", out))
        shown = F.when(F.col("e.kind") == len(parts) - 1, _json(made, False)).otherwise(shown)
    failures = _failures(routed, parts, shown)
    skipped = routed.where(F.col("__skipped").isNotNull()).select(F.lit("").alias("run_id"), F.col(ROW).alias("row_number"), F.col("__skipped").alias("reason"), _json(fields).alias("row_json"))
    return Plan(config, routed, fields, outputs, failures, skipped, types, references)


def _failures(df: DataFrame, parts: list[tuple[Column, str, str | None]], row: Column) -> DataFrame:
    """All errors of all rows by one pass: the arrays of every kind are joined into one, which is exploded once."""
    empty = F.array().cast(f"array<struct<kind:int,at:int,error:{ERROR}>>")

    def tagged(array: Column, kind: int) -> Column:
        return F.coalesce(F.transform(array, lambda e, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), e.alias("error"))), empty)

    found = F.flatten(F.array(*[tagged(a, k) for k, (a, _, _) in enumerate(parts)]))
    stage, output = (F.element_at(F.array(*[F.lit(p[n]).cast("string") for p in parts]), F.col("e.kind") + 1) for n in (1, 2))
    one = df.withColumn("__errors", found).where(F.size("__errors") > 0).select("*", F.explode("__errors").alias("e"))
    return one.select(F.lit("").alias("run_id"), F.col(ROW).alias("row_number"), stage.alias("stage"), output.alias("output_name"), "e.error.field", "e.error.rule", "e.error.message", row.alias("row_json"), F.col("e.at").alias("__at"), F.col("e.kind").alias("__order"))


def count_routes(plan: Plan) -> dict[str, int]:
    """Rows of each route, and errors by class, in one pass."""
    kept = (F.size("__invalid") == 0) & F.col("__failed").isNull() & F.col("__skipped").isNull()
    aggs = {"input_rows": F.count("*"), "invalid": F.sum(F.size("__invalid")), "skipped_rows": F.count("__skipped")}
    failed = {"": F.col("__failed")} | {str(j): F.col(f"__failed_{j}") for j in range(len(plan.outputs))}
    for k, e in failed.items():
        aggs[f"lookup{k}"] = F.count_if(F.coalesce(e["rule"] == "lookup_missing", F.lit(False)))
        aggs[f"failed{k}"] = F.count(e)
    for j in range(len(plan.outputs)):
        fine = kept & F.col(f"__failed_{j}").isNull()
        aggs[f"invalid{j}"] = F.sum(F.when(fine, F.size(f"__invalid_{j}")).otherwise(0))
        aggs[f"rows{j}"] = F.count_if(fine & (F.size(f"__invalid_{j}") == 0))
    row = plan.routed.agg(*[v.alias(k) for k, v in aggs.items()]).first()
    return {k: int(row[k] or 0) for k in aggs}


def run_migration(spark: SparkSession, config: Migration, base: str | Path | None = None, frames: dict[str, DataFrame] | None = None, limit: int | None = None, dry_run: bool = False, run_id: str = "", kept_rows: bool = False) -> Result:
    """Compile, count, and apply the policies. A fatal stop leaves all outputs empty; errors up to the stop are kept."""
    plan = compile_migration(spark, config, base, frames, limit, kept_rows=kept_rows)
    n = count_routes(plan)
    policy = config.error_handling
    names = list(plan.outputs)
    lookups = sum(v for k, v in n.items() if k.startswith("lookup"))
    transforms = sum(v for k, v in n.items() if k.startswith("failed")) - lookups
    invalid = sum(v for k, v in n.items() if k.startswith("invalid"))
    total = lookups + transforms + invalid
    rows = {o: n[f"rows{j}"] for j, o in enumerate(names)}
    stop: tuple[str, str] | None = None
    stops: Column = F.lit(False)
    if n["invalid"] and policy.on_validation_error == "stop":
        stop, stops = ("validation_error", "stopped at a validation error"), F.col("stage") == "input_validation"
    elif lookups and policy.on_lookup_missing == "stop":
        stop, stops = ("lookup_missing", "stopped at a missing lookup"), F.col("rule") == "lookup_missing"
    elif transforms and policy.on_transform_error == "stop":
        stop, stops = ("transform_error", "stopped at a transform error"), (F.col("stage") == "mapping") & (F.col("rule") != "lookup_missing")
    elif invalid and policy.on_validation_error == "stop":
        stop, stops = ("validation_error", "stopped at a validation error"), F.col("stage") == "output_validation"
    over = next((o for o in names if config.runtime.max_output_rows is not None and rows[o] > config.runtime.max_output_rows), None)
    errors, skipped = plan.errors, plan.skipped
    if stop:
        if stop[0] != "validation_error":  # rows after the one that stopped the run were never reached
            last = errors.where(stops).agg(F.min("row_number")).first()[0]
            errors, skipped = errors.where(F.col("row_number") <= last), skipped.where(F.col("row_number") <= last)
    elif total > policy.max_errors:
        stop = ("max_errors", f"error count exceeded max_errors: {total} > {policy.max_errors}")
        errors = errors.orderBy("__order", "row_number", "__at").limit(policy.max_errors + 1)
    elif over is not None:
        stop = ("max_output_rows", f"{over}: output row count exceeds the limit of {config.runtime.max_output_rows}")
    counts = {"input_rows": n["input_rows"], "output_rows": 0 if stop else rows[names[0]], "error_rows": total, "skipped_rows": n["skipped_rows"]}
    checks = []
    if not stop:
        for c in config.checks:
            try:
                checks.append({"name": c.name, "rule": c.rule, "passed": evaluate_check(c.rule, counts), "message": None})
            except CheckError as e:
                checks.append({"name": c.name, "rule": c.rule, "passed": False, "message": str(e)})
    failed_checks = any(not c["passed"] for c in checks)
    status = "failed" if stop else ("dry_run_" if dry_run else "") + "completed" + ("_with_check_failures" if failed_checks else "")
    outputs = {o: d.limit(0) if stop else d for o, d in plan.outputs.items()}
    tag = F.lit(run_id)
    return Result(plan, status, counts, {o: 0 if stop else r for o, r in rows.items()}, outputs, errors.withColumn("run_id", tag), skipped.withColumn("run_id", tag), checks, *(stop or (None, None)))
