"""Configurations from YAML files."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import yaml

from .models import KINDS, ConfigError, parse


def read_yaml(path: str | Path) -> dict[str, Any]:
    try:
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ConfigError([f"{path}: invalid YAML: {e}"]) from e
    except OSError as e:
        raise ConfigError([f"{path}: cannot read config file: {e}"]) from e
    if not isinstance(raw, dict):
        raise ConfigError([f"{path}: config file is empty" if raw is None else f"{path}: the top level must be a mapping"])
    return raw


def kind_of(raw: dict[str, Any]) -> str:
    """run, merge, union, unpivot, aggregate, match, consolidate or run-all, by the keys at the top."""
    for key, (name, _) in KINDS.items():
        if key in raw:
            return name
    return "run"


def load(path: str | Path, kind: str | None = None) -> Any:
    """The checked configuration in a file, of the given kind or of the one its keys tell."""
    raw = read_yaml(path)
    model = next(m for n, m in KINDS.values() if n == (kind or kind_of(raw)))
    try:
        return parse(model, raw)
    except ConfigError as e:
        raise ConfigError([f"{path}: invalid configuration", *(f"- {p}" for p in e.problems)]) from e
