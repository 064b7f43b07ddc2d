"""Migration files from CSV headers: safe field names, a schema of texts, and one output."""

from __future__ import annotations

import re
from pathlib import Path

import yaml

from ..config.models import ConfigError
from ..sources.scan import read_header


def safe_name(header: str) -> str | None:
    """Lower-case ASCII letters, digits and underscores, not starting with a digit; None if nothing is left."""
    name = "_".join(re.findall("[0-9a-z]+", header.strip().lower()))
    if not name:
        return None
    return f"field_{name}" if name[0].isdigit() else name


def safe_names(headers: list[str], prefix: str = "field") -> list[str]:
    """Distinct safe names; headers without one get a number, repeated ones a suffix."""
    out: list[str] = []
    unnamed = 0
    for h in headers:
        name = safe_name(h)
        if name is None:
            unnamed += 1
            name = f"{prefix}_{unnamed:03d}"
        base, n = name, 1
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def migration_scaffold(input_path: str, output_path: str, headers: list[str], input_name: str = "input", output_name: str = "output", project: str = "generated_migration", encoding: str = "utf-8-sig", delimiter: str = ",", keep_headers: bool = True) -> dict:
    fields = safe_names(headers)
    columns: list[str] = []
    for h, f in zip(headers, fields, strict=True):
        column = h.strip() if keep_headers and h.strip() and h.strip() not in columns else f
        columns.append(column)
    return {
        "version": 1, "project": {"name": project},
        "inputs": {input_name: {"path": input_path, "encoding": encoding, "delimiter": delimiter, "header": True, "schema": {f: {"source_columns": [h], "type": "string", "required": True, "normalize": ["trim"]} for h, f in zip(headers, fields, strict=True)}}},
        "outputs": {output_name: {"path": output_path, "encoding": "utf-8-sig", "delimiter": ",", "header": True, "newline": "\n", "if_exists": "error", "columns": columns}},
        "mappings": {output_name: {c: {"source": f"{input_name}.{f}"} for c, f in zip(columns, fields, strict=True)}},
        "error_handling": {"error_output": "./reports/errors.csv", "skipped_output": "./reports/skipped.csv"},
        "runtime": {"run_id": "auto", "summary_output": "./reports/summary.json"},
    }


def write_yaml(config: dict, path: str | Path, overwrite: bool = False) -> Path:
    path = Path(path)
    if path.exists() and not overwrite:
        raise ConfigError([f"{path}: config file already exists; use --overwrite to replace it"])
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(config, sort_keys=False, allow_unicode=True, width=1000), encoding="utf-8")
    return path


def generate_config(input_path: str | Path, output_path: str | Path, config_path: str | Path, overwrite: bool = False, **options) -> Path:
    source = Path(input_path).resolve()
    headers = read_header(str(source), options.get("encoding", "utf-8-sig"), options.get("delimiter", ","))
    if not headers:
        raise ConfigError([f"{source}: the CSV file has no header"])
    return write_yaml(migration_scaffold(str(source), str(Path(output_path).resolve()), headers, **options), config_path, overwrite)
