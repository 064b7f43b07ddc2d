"""Jobs from configuration files to written outputs and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from functools import partial
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.loader import load as load_config
from ..config.models import ConfigError
from ..operators import jobs
from ..sinks import reports
from ..sinks.files import SinkError, precheck, write_csv
from ..sources.keep import keep
from ..sources.scan import ROW, Loaded, LoadError, load, resolve
from .migration import run_migration


@dataclass
class Outcome:
    """What a job came to: status, counts, and what was written."""

    kind: str
    status: str
    counts: dict[str, int]
    summary: dict[str, Any]
    written: list[str] = field(default_factory=list)
    reports: reports.Paths | None = None
    message: str | None = None
    #: The first rows of each output of a dry run.
    preview: dict[str, list[dict[str, Any]]] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return self.status in ("completed", "dry_run_completed")


#: Rows that a dry run shows of each output.
PREVIEW = 5


def _silent(step: str, percent: int) -> None:
    """No progress is shown."""


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def _run_id(runtime) -> str:
    return f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}" if runtime.run_id == "auto" else runtime.run_id


def _plain(handling) -> dict[str, Any]:
    return {k: v for k, v in asdict(handling).items() if k != "given"}


def _settle(paths: reports.Paths, payload: dict, errors: DataFrame, skipped: DataFrame, columns: list[str]) -> None:
    payload["reports"] = {"errors_csv": str(paths.errors), "skipped_csv": str(paths.skipped), "summary_json": str(paths.summary)} | ({"report_html": str(paths.page)} if paths.page else {})
    reports.write_rows(errors, columns, paths.errors)
    reports.write_rows(skipped, reports.SKIPS, paths.skipped)
    reports.write_summary(payload, paths.summary)
    if paths.page:
        reports.write_page(payload, errors, skipped, columns, paths.page)


def execute_migration(spark: SparkSession, path: str | Path, limit: int | None = None, dry_run: bool = False, write_reports: bool = True, reports_dir: Path | None = None, page: bool = False, progress: Callable[[str, int], None] = _silent) -> Outcome:
    """Run a migration file. Outputs are checked before any is written; a failed run writes none.

    ``progress`` is told each step and how much of the job is done by then, in per cent.
    """
    path, started = Path(path), _now()
    progress("config", 0)
    config = load_config(path, "run")
    base = path.parent
    to = partial(resolve, base=base)
    if not dry_run:
        precheck(config.outputs, to)
    run_id = _run_id(config.runtime)
    progress("load and route", 5)
    r = run_migration(spark, config, base, None, limit, dry_run, run_id, kept_rows=True)
    progress("outputs", 50)
    plan = r.plan
    written = []
    by = {(e["stage"], e["rule"]): e["count"] for e in plan.errors.groupBy("stage", "rule").count().collect()}
    of = lambda stages, rules=None: sum(n for (s, k), n in by.items() if s in stages and (rules is None or k in rules))
    if not dry_run and r.status != "failed":
        for name, spec in config.outputs.items():
            write_csv(r.outputs[name], plan.types[name], [ROW], to(spec.path), spec.encoding, spec.delimiter, spec.newline)
            written.append(name)
            progress(f"output {name}", 50 + 40 * len(written) // len(config.outputs))
    preview = {n: [x.asDict() for x in d.orderBy(ROW).limit(PREVIEW).drop(ROW).collect()] for n, d in r.outputs.items()} if dry_run else {}
    name, source = next(iter(config.inputs.items()))
    first = next(iter(config.outputs))
    lookups = of({"mapping"}, {"lookup_missing"})
    valid = of({"input_validation"})
    payload: dict[str, Any] = {
        "run_id": run_id, "project_name": config.project.name, "status": r.status, "config_path": str(path), "started_at": started, "finished_at": _now(), "error_handling": _plain(config.error_handling),
        "input": {"name": name, "path": source.path, "rows_loaded": r.counts["input_rows"]},
        "references": [{"name": n, "path": c.path, "key": c.key, "rows_loaded": plan.references[n].df.count()} for n, c in config.references.items()],
        "output": {"name": first, "path": config.outputs[first].path, "columns": config.outputs[first].columns, "rows_previewed": r.output_counts[first]},
        "outputs": [{"name": n, "path": c.path, "file_written": n in written, "columns": c.columns, "rows_previewed": r.output_counts[n]} for n, c in config.outputs.items()],
        "counts": {
            "input_rows": r.counts["input_rows"], "skipped_rows": r.counts["skipped_rows"], "error_rows": r.counts["error_rows"], "validation_errors": of({"input_validation", "output_validation"}), "mapping_errors": of({"mapping"}), "lookup_missing_errors": lookups,
            "transform_errors": of({"mapping"}) - lookups, "input_validation_errors": valid, "output_validation_errors": of({"output_validation"}), "check_failures": sum(not c["passed"] for c in r.checks), "check_successes": sum(c["passed"] for c in r.checks), "output_rows": r.counts["output_rows"],
        },
        "checks": r.checks,
        "notes": {
            "dry_run": dry_run, "output_file_written": bool(written), "checks_passed": all(c["passed"] for c in r.checks), "completed_with_row_errors": r.counts["error_rows"] > 0 and r.status != "failed", "final_outcome": _final(r), "fatal_error": r.status == "failed",
            "stop_reason": r.stop_reason, "stop_message": r.stop_message, "max_errors_exceeded": r.stop_reason == "max_errors",
        } | ({"limited_run": True, "limit": limit} if limit is not None and limit >= 0 else {}),
    }
    paths = None
    if write_reports:
        paths = reports.report_paths(config.error_handling, config.runtime, base, reports_dir, page)
        _settle(paths, payload, r.errors, r.skipped, reports.MIGRATION_ERRORS)
    progress("done", 100)
    return Outcome("run", r.status, r.counts, payload, written, paths, r.stop_message, preview)


def _final(r) -> str:
    if r.status == "failed":
        return "failed"
    if "check_failures" in r.status:
        return "completed_with_check_failures"
    return "completed_with_row_errors" if r.counts["error_rows"] else "success"


def job_plan(spark: SparkSession, kind: str, config, base: Path, frames: dict[str, DataFrame] | None = None) -> tuple[jobs.JobPlan, dict[str, object], dict[str, Any], dict[str, Loaded]]:
    """(plan, output settings by name, notes, loaded sources by name) of a relational job."""

    def read(name: str, source) -> Loaded:
        """A source, computed once: a job reads it for its outputs, its errors, its skipped rows and its counts."""
        loaded = load(spark, source, base, frames, name, None, config.runtime.max_input_rows)
        loaded.df = keep(loaded.df)
        return loaded

    if kind in ("merge", "union"):
        sources = {n: read(n, s) for n, s in config.inputs.items()}
        keys = {n: s.keys for n, s in config.inputs.items()}
        for n, s in sources.items():
            if absent := [k for k in keys[n] if k not in s.types]:
                raise LoadError(f"{n}: key column is not defined: {', '.join(absent)}")
        if kind == "merge":
            ordered = {c: config.merge.columns[c] for c in config.output.columns}
            kinds = [[s.types[k] for k in keys[n]] for n, s in sources.items()]
            if any(k != kinds[0] for k in kinds):
                raise ConfigError(["merge keys must have the same types in all inputs"])
            return jobs.merge(sources, keys, config.merge.base, ordered, config.merge.join_type), {"output": config.output}, {}, sources
        return jobs.union(sources, next(iter(keys.values())), config.union.columns), {"output": config.output}, {}, sources
    source = read("input", config.input)
    sources = {"input": source}
    if kind == "unpivot":
        u = config.unpivot
        return jobs.unpivot(source, u.id_columns, u.variable_column, u.value_column, u.value_columns, u.drop_null_values, config.filters), {"output": config.output}, {}, sources
    if kind == "aggregate":
        return jobs.aggregate(source, config.aggregate.group_by, config.aggregate.columns), {"output": config.output}, {"group_by": config.aggregate.group_by}, sources
    if kind == "match":
        m = config.match
        return jobs.match(source, m.keys, m.output_column, config.output.columns, m.id_prefix, m.id_padding, m.assign_singletons), {"output": config.output}, {"match_keys": m.keys, "match_output_column": m.output_column}, sources
    c = config.consolidate
    plan = jobs.consolidate(source, c.group_by, c.parent.columns, {k.name: k.columns for k in c.children})
    return plan, {"parent": c.parent.output} | {k.name: k.output for k in c.children}, {"group_by": c.group_by}, sources


def execute_job(spark: SparkSession, kind: str, path: str | Path, reports_dir: Path | None = None, page: bool = False) -> Outcome:
    """Run a relational job file. Any error row fails the job; its outputs then aren't written."""
    path, started = Path(path), _now()
    config = load_config(path, kind)
    base = path.parent
    to = partial(resolve, base=base)
    plan, settings, notes, read = job_plan(spark, kind, config, base)
    precheck(settings, to)
    run_id = _run_id(config.runtime)
    errors, skipped = (keep(x).withColumn("run_id", F.lit(run_id)) for x in (plan.errors, plan.skipped))
    sources = config.inputs if kind in ("merge", "union") else {"input": config.input}
    n_errors, n_skipped = errors.count(), skipped.count()
    outputs = {n: keep(d) for n, d in plan.outputs.items()}  # a sink's sort reads them twice
    rows = {n: d.count() for n, d in outputs.items()}
    most = config.runtime.max_output_rows
    reason = message = None
    if n_errors:
        reason, message = "row_errors", errors.orderBy("row_number").select("message").first()[0]
    elif most is not None and sum(rows.values()) > most:
        reason, message = "max_output_rows", f"output row count exceeds the limit of {most}: {sum(rows.values())}"
    status = "failed" if reason else "completed"
    written = []
    if not reason:
        for name, spec in settings.items():
            df = outputs[name]
            order = [c for c in ("__order", "__input_order", ROW, "__at") if c in df.columns]
            types = {c: plan.types[name][c] for c in spec.columns}
            write_csv(df, types, order, to(spec.path), spec.encoding, spec.delimiter, spec.newline)
            written.append(name)
    loaded = {n: read[n].df.count() for n in sources}
    counts = {"input_rows": sum(loaded.values()), "output_rows": 0 if reason else sum(rows.values()), "skipped_rows": n_skipped, "error_rows": n_errors}
    shown = [{"name": n, "path": s.path, "columns": s.columns, "rows": 0 if reason else rows[n], "file_written": n in written} for n, s in settings.items()]
    payload: dict[str, Any] = {
        "run_id": run_id, "project_name": config.project.name, "status": status, "config_path": str(path), "started_at": started, "finished_at": _now(), "error_handling": _plain(config.error_handling),
        "inputs": [{"name": n, "path": s.path, "rows_loaded": loaded[n]} for n, s in sources.items()], ("outputs" if kind == "consolidate" else "output"): shown if kind == "consolidate" else shown[0], "counts": counts,
        "notes": {kind: True, "output_file_written": bool(written), "final_outcome": "failed" if reason else "success", "stop_reason": reason, "stop_message": message, **notes},
    }
    paths = reports.report_paths(config.error_handling, config.runtime, base, reports_dir, page)
    _settle(paths, payload, errors, skipped, reports.JOB_ERRORS)
    return Outcome(kind, status, counts, payload, written, paths, message)


def execute(spark: SparkSession, kind: str, path: str | Path, reports_dir: Path | None = None, page: bool = False) -> Outcome:
    if kind == "run":
        return execute_migration(spark, path, reports_dir=reports_dir, page=page)
    return execute_job(spark, kind, path, reports_dir, page)


def run_all(spark: SparkSession, path: str | Path, report=print) -> list[tuple[str, Outcome | None, str | None]]:
    """The jobs of a list, one after another, up to the first that fails; (name, outcome, error) of each that ran."""
    path = Path(path)
    config = load_config(path, "run-all")
    done: list[tuple[str, Outcome | None, str | None]] = []
    for job in config.jobs:
        at = lambda p: None if p is None else Path(resolve(p, path.parent))
        try:
            outcome = execute(spark, job.type, at(job.config), at(job.reports_dir), bool(job.html_report))
        except (ConfigError, LoadError, SinkError) as e:
            done.append((job.name, None, str(e)))
            report(f"{job.name}: failed: {e}")
            break
        done.append((job.name, outcome, outcome.message))
        report(f"{job.name}: {outcome.status}")
        if not outcome.ok:
            break
    return done
