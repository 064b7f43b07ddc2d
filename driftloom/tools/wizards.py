"""Interactive authoring of migration and merge files: a few questions, suggestions by header, a review, and a file."""

from __future__ import annotations

from collections.abc import Callable
from itertools import islice
from pathlib import Path
import csv

from ..config.models import Merge, Migration, parse
from ..sources.scan import read_header
from .generate import migration_scaffold, safe_names, write_yaml

Ask = Callable[[str, str], str]

#: Words in a header that suggest a type, tried in this order.
HINTS = (("date", ("date", "日付", "_on", "_at")), ("decimal", ("amount", "price", "total", "金額", "rate", "cost")), ("integer", ("count", "quantity", "qty", "数量")), ("boolean", ("flag", "is_", "active", "enabled")))


class Cancelled(Exception):
    pass


def ask_console(question: str, default: str = "") -> str:
    answer = input(f"{question}{f' [{default}]' if default else ''}: ").strip()
    if answer.lower() in ("cancel", "quit"):
        raise Cancelled
    return answer or default


def suggest_type(header: str) -> str:
    text = header.strip().lower()
    return next((kind for kind, words in HINTS if any(w in text for w in words)), "string")


def preview(path: str, rows: int = 3, encoding: str = "utf-8-sig", delimiter: str = ",") -> list[list[str]]:
    with open(path, encoding=encoding, newline="") as f:
        return list(islice(csv.reader(f, delimiter=delimiter), rows + 1))


def _yes(answer: str) -> bool:
    return answer.strip().lower() in ("y", "yes", "true", "1")


def migration_wizard(ask: Ask = ask_console, say: Callable[[str], None] = print, overwrite: bool = False) -> Path | None:
    """Ask for input, types, columns, filters and checks; returns the file, or None if it was cancelled."""
    try:
        while True:
            source = ask("Input CSV", "")
            for row in preview(source):
                say("  " + " | ".join(row))
            headers = read_header(source)
            name = safe_names([ask("Input name", Path(source).stem)])[0]
            config = migration_scaffold(str(Path(source).resolve()), ask("Output CSV", "./output/out.csv"), headers, name, "output", ask("Project name", "migration"))
            schema, mapping = config["inputs"][name]["schema"], config["mappings"]["output"]
            kept = []
            for header, field, column in zip(headers, schema, list(mapping), strict=True):
                if not _yes(ask(f"Keep column '{header}'? (y/n)", "y")):
                    del mapping[column]
                    continue
                kind = ask(f"Type of '{header}'", suggest_type(header))
                schema[field]["type"] = kind
                if kind in ("decimal", "integer"):
                    schema[field]["normalize"] += ["remove_commas", "remove_currency_symbol"]
                renamed = ask(f"Output name of '{header}'", column)
                kept.append(renamed)
                mapping[renamed] = mapping.pop(column)
                rule = ask(f"Rule of '{renamed}' (source, value:<text>, expression:<text>)", "source")
                if rule.startswith("value:"):
                    mapping[renamed] = {"value": rule.removeprefix("value:")}
                elif rule.startswith("expression:"):
                    mapping[renamed] = {"expression": rule.removeprefix("expression:")}
                if _yes(ask(f"Is '{renamed}' required? (y/n)", "n")):
                    config.setdefault("validations", {}).setdefault("input", []).append({"field": f"{name}.{field}", "rule": "required"})
            config["outputs"]["output"]["columns"] = kept
            if condition := ask(f"Exclude rows where (condition over {name}.<field>, empty for none)", ""):
                config["filters"] = {"exclude": [{"if": condition}]}
            if _yes(ask("Check that every row is accounted for? (y/n)", "y")):
                config["checks"] = [{"name": "row_accounting", "rule": "input_rows == output_rows + error_rows + skipped_rows"}]
            done = _review(config, Migration, ask, say, overwrite)
            if done is not None:
                return done
    except Cancelled:
        say("cancelled")
        return None


def merge_wizard(ask: Ask = ask_console, say: Callable[[str], None] = print, overwrite: bool = False) -> Path | None:
    """Ask for two or more inputs and a purpose: keep the base's values, complete its gaps, or add amounts up."""
    try:
        while True:
            sources: dict[str, tuple[str, list[str], list[str]]] = {}
            while len(sources) < 2 or _yes(ask("Another input? (y/n)", "n")):
                path = ask(f"CSV of input {len(sources) + 1}", "")
                headers = read_header(path)
                name = safe_names([ask("Its name", Path(path).stem)])[0]
                sources[name] = (path, headers, [k.strip() for k in ask("Its key columns (comma-separated)", headers[0]).split(",")])
            base, purpose = ask("Base input", next(iter(sources))), ask("Purpose (enrich, complete, sum)", "enrich")
            columns: dict[str, dict] = {}
            for name, (_, headers, keys) in sources.items():
                for h in headers:
                    if name != base and h in keys:
                        continue
                    columns.setdefault(h, {"refs": []})["refs"].append(f"{name}.{h}")
            rules = {}
            for c, v in columns.items():
                refs = sorted(v["refs"], key=lambda r: not r.startswith(base + "."))
                numeric = suggest_type(c) in ("decimal", "integer")
                rules[c] = {"source": refs[0]} if len(refs) == 1 or purpose == "enrich" else {"sum": refs} if purpose == "sum" and numeric else {"first": refs}
            config = {
                "version": 1, "project": {"name": ask("Project name", "merge")}, "inputs": {n: {"path": str(Path(p).resolve()), "key": k[0] if len(k) == 1 else k, "schema": {h: {"type": "decimal" if suggest_type(h) == "decimal" else "string", "normalize": ["trim"]} for h in hs}} for n, (p, hs, k) in sources.items()},
                "merge": {"base": base, "join_type": ask("Join type (left, inner)", "left"), "columns": rules}, "output": {"path": ask("Output CSV", "./output/merged.csv"), "columns": list(rules)}, "error_handling": {"error_output": "./reports/errors.csv", "skipped_output": "./reports/skipped.csv"},
            }
            done = _review(config, Merge, ask, say, overwrite)
            if done is not None:
                return done
    except Cancelled:
        say("cancelled")
        return None


def _review(config: dict, model: type, ask: Ask, say: Callable[[str], None], overwrite: bool) -> Path | None:
    """Show what will be written; None to begin again."""
    import yaml

    parse(model, config)
    say(yaml.safe_dump(config, sort_keys=False, allow_unicode=True))
    answer = ask("Write this file? (yes, redo, cancel)", "yes").lower()
    if answer == "redo":
        return None
    if not _yes(answer):
        raise Cancelled
    path = write_yaml(config, ask("Config file", "config.yml"), overwrite)
    say(f"written: {path}")
    return path
