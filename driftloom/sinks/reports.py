"""Error, skip and summary reports, and a page that shows them; one implementation for all kinds of jobs."""

from __future__ import annotations

import html
import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from .files import atomic, write_csv

#: Rows of each kind that the page shows.
PREVIEW = 20
MIGRATION_ERRORS = ["run_id", "row_number", "stage", "output_name", "field", "rule", "message", "row_json"]
JOB_ERRORS = ["run_id", "input_name", "row_number", "stage", "field", "rule", "message", "row_json"]
SKIPS = ["run_id", "row_number", "reason", "row_json"]


@dataclass
class Paths:
    errors: Path
    skipped: Path
    summary: Path
    page: Path | None = None


def report_paths(handling, runtime, base: Path, folder: Path | None, page: bool) -> Paths:
    """A reports folder wins over configured paths; the summary lies beside the errors unless it has a path."""
    at = lambda p: Path(p) if Path(p).is_absolute() else base / p
    if folder is not None:
        paths = Paths(folder / "errors.csv", folder / "skipped.csv", folder / "summary.json")
    else:
        errors = at(handling.error_output)
        paths = Paths(errors, at(handling.skipped_output), at(runtime.summary_output) if runtime.summary_output else errors.with_name("summary.json"))
    if page:
        paths.page = paths.summary.with_name("report.html")
    return paths


def _order(df: DataFrame) -> list[str]:
    return [c for c in ("__order", "row_number", "__at") if c in df.columns]


def write_rows(df: DataFrame, columns: list[str], path: Path) -> None:
    write_csv(df, {c: "integer" if c == "row_number" else "string" for c in columns}, _order(df), str(path), "utf-8")


def write_summary(payload: dict[str, Any], path: Path) -> None:
    atomic(path, lambda f: f.write(json.dumps(payload, ensure_ascii=False, indent=2, default=str) + "\n"))


def _table(columns: list[str], rows: list) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def write_page(payload: dict[str, Any], errors: DataFrame, skipped: DataFrame, error_columns: list[str], path: Path) -> None:
    """A page of its own: counts, checks and the first rows of both reports, everything escaped."""
    first = lambda df, cols: [tuple(r) for r in df.orderBy(*_order(df)).select(*cols).limit(PREVIEW).collect()]
    parts = [
        f"<h1>{html.escape(str(payload['project_name']))}</h1><p>{html.escape(payload['status'])} – run {html.escape(payload['run_id'])}</p>",
        "<h2>Counts</h2>" + _table(["count", "rows"], list(payload["counts"].items())),
        "<h2>Checks</h2>" + _table(["name", "rule", "passed"], [(c["name"], c["rule"], c["passed"]) for c in payload.get("checks", [])]),
        "<h2>Errors</h2>" + _table(error_columns, first(errors, error_columns)),
        "<h2>Skipped rows</h2>" + _table(SKIPS, first(skipped, SKIPS)),
        "<h2>Notes</h2>" + _table(["note", "value"], list(payload["notes"].items())),
    ]
    page = f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{html.escape(str(payload['project_name']))}</title><style>body{{font-family:sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #bbb;padding:.2em .5em;text-align:left}}</style></head><body>{''.join(parts)}</body></html>\n"
    atomic(path, lambda f: f.write(page))
