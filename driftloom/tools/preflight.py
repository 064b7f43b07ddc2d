"""Checks before a run, without reading data: headers, keys, limits, output folders; and summaries of configurations."""

from __future__ import annotations

import csv
from pathlib import Path

from ..config.loader import kind_of, load, read_yaml
from ..config.models import ConfigError
from ..expr.conditions import compile_condition
from ..expr.scope import CompileError, Scope
from ..functions.text import Typed
from ..sources.scan import LoadError, pick_header, read_header, resolve


def count_records(path: str, encoding: str, delimiter: str, stop: int) -> int:
    """Data records of a CSV file, blank lines aside, counted up to one more than ``stop``."""
    n = -1
    with open(path, encoding=encoding, newline="") as f:
        for row in csv.reader(f, delimiter=delimiter):
            n += bool(row)
            if n > stop:
                break
    return max(n, 0)


def _source(where: str, source, base: Path, keys: list[str], limit: int | None) -> list[str]:
    path = resolve(source.path, base)
    if not Path(path).is_file():
        return [f"{where}: file not found: {path}"]
    if not source.header:
        return [f"{where}: header: false is not supported"]
    try:
        header = read_header(path, source.encoding, source.delimiter)
    except LoadError as e:
        return [f"{where}: {e}"]
    out = [f"{where}.{n}: required column is missing: {', '.join(f.source_columns or [n])}" for n, f in source.schema.items() if f.required and pick_header(n, f, header) is None]
    fields = source.schema or dict.fromkeys(header)
    out += [f"{where}: key column is not defined: {k}" for k in keys if k not in fields]
    if limit is not None and count_records(path, source.encoding, source.delimiter, limit) > limit:
        out.append(f"{where}: row count exceeds the limit of {limit}")
    return out


def _output(where: str, spec, base: Path) -> list[str]:
    path = Path(resolve(spec.path, base))
    out = [f"{where}: header: false is not supported"] if not spec.header else []
    if spec.if_exists == "error" and path.exists():
        out.append(f"{where}: file already exists: {path}")
    parent = path.parent
    while not parent.exists():
        parent = parent.parent
    return out + ([] if parent.is_dir() else [f"{where}: not a folder: {parent}"])


def preflight(path: str | Path) -> tuple[str, list[str]]:
    """(kind, problems) of a configuration file; a job list is followed into its jobs."""
    path = Path(path)
    kind = kind_of(read_yaml(path))
    config, base = load(path, kind), path.parent
    found: list[str] = []
    if kind == "run-all":
        for job in config.jobs:
            try:
                found += [f"{job.name}: {p}" for p in preflight(resolve(job.config, base))[1]]
            except ConfigError as e:
                found.append(f"{job.name}: {e}")
        return kind, found
    runtime = config.runtime
    if kind == "run":
        for n, s in config.inputs.items():
            found += _source(f"inputs.{n}", s, base, [], runtime.max_input_rows)
        for n, s in config.references.items():
            found += _source(f"references.{n}", s, base, s.keys, runtime.max_reference_rows)
        for n, o in config.outputs.items():
            found += _output(f"outputs.{n}", o, base)
        for i, v in enumerate(config.validations.input + config.validations.output):
            if v.rule == "referential_integrity":
                ref = config.references[v.reference]
                fields = ref.schema or (dict.fromkeys(read_header(p, ref.encoding, ref.delimiter)) if Path(p := resolve(ref.path, base)).is_file() else {})
                found += [] if v.reference_key in fields else [f"validations[{i}].reference_key: unknown column: {v.reference_key}"]
        return kind, found + _conditions(config)
    sources = config.inputs if kind in ("merge", "union") else {"input": config.input}
    for n, s in sources.items():
        found += _source(f"inputs.{n}" if len(sources) > 1 else "input", s, base, s.keys if kind in ("merge", "union") else [], runtime.max_input_rows)
    outputs = {"parent": config.consolidate.parent.output} | {c.name: c.output for c in config.consolidate.children} if kind == "consolidate" else {"output": config.output}
    for n, o in outputs.items():
        found += _output(n, o, base)
    return kind, found


def _conditions(config) -> list[str]:
    """Conditions whose syntax would make every row an error. Needs a session, as columns do; skipped without one."""
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    if SparkSession.getActiveSession() is None:
        return []
    name, source = next(iter(config.inputs.items()))
    scope = Scope(name, {n: Typed(F.col(n), f.type) for n, f in source.schema.items()}, {n: Typed(F.col(n), "string") for n in config.derived})
    texts = [(f"filters.{s}[{i}].if", r.if_) for s in ("include", "exclude") for i, r in enumerate(getattr(config.filters, s))]
    texts += [(f"{o}.{c}.when[{i}].if", w.if_) for o, rules in {**config.mappings, "derived": config.derived}.items() for c, r in rules.items() if r.when for i, w in enumerate(r.when)]
    out = []
    for where, text in texts:
        try:
            compile_condition(text, scope)
        except CompileError as e:
            out.append(f"{where}: {e}")
    return out


def inspect(path: str | Path) -> list[str]:
    """A configuration in a few lines."""
    kind = kind_of(read_yaml(path))
    c = load(path, kind)
    if kind == "run-all":
        return [f"kind: {kind}", *(f"job {j.name}: {j.type} {j.config}" for j in c.jobs)]
    lines = [f"kind: {kind}", f"project: {c.project.name}"]
    for n, s in (c.inputs if hasattr(c, "inputs") else {"input": c.input}).items():
        lines.append(f"input {n}: {s.path} ({len(s.schema)} fields)")
    if kind == "run":
        lines += [f"reference {n}: {r.path} (key {', '.join(r.keys)})" for n, r in c.references.items()]
        lines += [f"derived: {', '.join(c.derived) or 'none'}", f"filters: {len(c.filters.include)} include, {len(c.filters.exclude)} exclude", f"validations: {len(c.validations.input)} input, {len(c.validations.output)} output", f"checks: {len(c.checks)}"]
        lines += [f"output {n}: {o.path} ({', '.join(o.columns)})" for n, o in c.outputs.items()]
    elif kind == "consolidate":
        lines += [f"output {n}: {o.path}" for n, o in [("parent", c.consolidate.parent.output), *((k.name, k.output) for k in c.consolidate.children)]]
    else:
        lines.append(f"output: {c.output.path} ({', '.join(c.output.columns)})")
    return lines
