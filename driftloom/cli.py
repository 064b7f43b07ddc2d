"""The command line: ``python -m driftloom COMMAND``. Exit codes: 0 done, 1 failed, 2 wrong usage."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .config.loader import kind_of, load, read_yaml
from .config.models import ConfigError
from .expr.scope import CompileError
from .sinks.files import SinkError
from .sources.scan import LoadError

JOBS = ("merge", "union", "unpivot", "aggregate", "match", "consolidate")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="driftloom", description="Declarative data preparation on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, config: bool = True, reports: bool = False) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        if config:
            p.add_argument("config", type=Path)
        if reports:
            p.add_argument("--reports-dir", type=Path)
            p.add_argument("--html-report", action="store_true")
        return p

    add("validate-config", "check a configuration file")
    add("preflight", "check files, headers and limits before a run")
    add("inspect", "show a configuration in short")
    dry = add("dry-run", "run a migration without writing outputs", reports=True)
    dry.add_argument("--limit", type=int, default=-1)
    dry.add_argument("--write-reports", action="store_true")
    add("run", "run a migration", reports=True).add_argument("--limit", type=int)
    profile = add("profile-input", "statistics of a migration's input")
    profile.add_argument("--limit", type=int)
    profile.add_argument("--chunk-size", type=int, help="accepted; Spark partitions instead")
    profile.add_argument("--format", choices=("text", "json"), default="text")
    for job in JOBS:
        add(job, f"run a {job} job", reports=True)
    add("run-all", "run a list of jobs")
    gen = add("generate-config", "make a migration file from a CSV header", config=False)
    for flag in ("--input", "--output", "--config"):
        gen.add_argument(flag, type=Path, required=True)
    for flag, default in (("--input-name", "input"), ("--output-name", "output"), ("--project-name", "generated_migration"), ("--encoding", "utf-8-sig"), ("--delimiter", ",")):
        gen.add_argument(flag, default=default)
    gen.add_argument("--overwrite", action="store_true")
    gen.add_argument("--safe-output-columns", action="store_true", help="name output columns by field instead of header")
    design = add("validate-design", "check a design workbook")
    design.add_argument("--summary-json", type=Path)
    design.add_argument("--errors-csv", type=Path)
    template = add("design-template", "write an empty design workbook")
    template.add_argument("--sheets-dir", type=Path)
    for wizard in ("merge-wizard", "migration-wizard"):
        add(wizard, "make a configuration by questions", config=False).add_argument("--overwrite", action="store_true")
    return parser


def _show(outcome) -> int:
    print(f"{outcome.kind}: {outcome.status}")
    for k, v in outcome.counts.items():
        print(f"  {k}: {v}")
    for c in outcome.summary.get("checks", []):
        print(f"  check {c['name']}: {'ok' if c['passed'] else 'FAILED'}")
    for name, shown in outcome.preview.items():
        print(f"  {name}:")
        for row in shown:
            print("    " + ", ".join(f"{k}={v}" for k, v in row.items()))
    if outcome.message:
        print(f"  {outcome.message}")
    if outcome.reports:
        print(f"  reports: {outcome.reports.errors}, {outcome.reports.skipped}, {outcome.reports.summary}")
    return 0 if outcome.ok else 1


def profile_payload(spark, path: Path, limit: int | None = None) -> dict:
    from .operators import profile
    from .sources.scan import load as load_source

    config = load(path, "run")
    name, source = next(iter(config.inputs.items()))
    loaded = load_source(spark, source, path.parent, None, name, limit, config.runtime.max_input_rows)
    samples = profile.sample_values(loaded)
    tops: dict[str, list] = {}
    for r in profile.top_values(loaded).orderBy("field", "rank").collect():
        tops.setdefault(r["field"], []).append({"value": r["value"], "count": r["n"]})
    metrics = {r["field"]: r.asDict() for r in profile.column_metrics(loaded).collect()}
    columns = [metrics[f] | {"sample_values": samples[f]} | ({"top_values": tops.get(f, [])} if loaded.types[f] == "string" else {}) for f in loaded.types]
    return {"input": name, "path": source.path, "rows": loaded.df.count(), "columns": columns}


def _run(args: argparse.Namespace) -> int:
    if args.command == "validate-config":
        load(args.config, kind_of(read_yaml(args.config)))
        print("config: ok")
        return 0
    if args.command == "inspect":
        from .tools.preflight import inspect

        print("\n".join(inspect(args.config)))
        return 0
    if args.command == "generate-config":
        from .tools.generate import generate_config

        path = generate_config(args.input, args.output, args.config, args.overwrite, input_name=args.input_name, output_name=args.output_name, project=args.project_name, encoding=args.encoding, delimiter=args.delimiter, keep_headers=not args.safe_output_columns)
        print(f"written: {path}")
        return 0
    if args.command == "validate-design":
        from .tools.design import validate_design, write_results

        design = validate_design(args.config)
        write_results(design, args.summary_json, args.errors_csv)
        for sheet, row, column, message in design.errors:
            print(f"{sheet}:{row or '-'}:{column or '-'}: {message}")
        print("design: ok" if design.valid else f"design: {len(design.errors)} errors")
        return 0 if design.valid else 1
    if args.command == "design-template":
        from .tools.design import write_template

        print(f"written: {write_template(args.config, args.sheets_dir)}")
        return 0
    if args.command.endswith("-wizard"):
        from .tools import wizards

        return 0 if (wizards.merge_wizard if args.command == "merge-wizard" else wizards.migration_wizard)(overwrite=args.overwrite) else 1
    return _spark(args)


def _spark(args: argparse.Namespace) -> int:
    from .plans import execute
    from .session import session

    if args.command == "run" and args.limit is not None and args.limit < 1:
        print("--limit must be at least 1", file=sys.stderr)
        return 2
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "preflight":
        from .tools.preflight import preflight

        kind, problems = preflight(args.config)
        print("\n".join([f"preflight ({kind}): {'ok' if not problems else f'{len(problems)} problems'}", *(f"- {p}" for p in problems)]))
        return 1 if problems else 0
    if args.command == "profile-input":
        payload = profile_payload(spark, args.config, args.limit)
        if args.format == "json":
            print(json.dumps(payload, ensure_ascii=False, indent=2, default=str))
        else:
            for c in payload["columns"]:
                print(", ".join(f"{k}={v}" for k, v in c.items() if v is not None))
        return 0
    if args.command in ("run", "dry-run"):
        dry = args.command == "dry-run"
        wanted = not dry or args.write_reports or args.html_report or args.reports_dir is not None
        return _show(execute.execute_migration(spark, args.config, args.limit, dry, wanted, args.reports_dir, args.html_report, lambda step, percent: print(f"{percent:3d} % {step}", file=sys.stderr)))
    if args.command == "run-all":
        done = execute.run_all(spark, args.config)
        return 0 if done and all(o is not None and o.ok for _, o, _ in done) else 1
    return _show(execute.execute_job(spark, args.command, args.config, args.reports_dir, args.html_report))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        return _run(args)
    except (ConfigError, LoadError, SinkError, CompileError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
