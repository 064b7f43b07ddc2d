"""The job descriptions as dataclasses, and one strict builder for all of them.

A mapping of the YAML file becomes a dataclass by its annotations: unknown keys, missing ones and wrong types are
collected with the place they are at. Keys that are Python words have an underscore at the end of the attribute's name.
"""

from __future__ import annotations

import types
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from typing import Any, Literal, Union, get_args, get_origin, get_type_hints

FieldType = Literal["string", "integer", "decimal", "boolean", "date"]
Policy = Literal["output_error", "stop"]


class ConfigError(ValueError):
    """All that is wrong with a configuration, one line each."""

    def __init__(self, problems: list[str]):
        self.problems = problems
        super().__init__("; ".join(problems))


@dataclass
class Base:
    #: Keys that the configuration gave.
    given: frozenset[str] = field(default=frozenset(), init=False, repr=False, compare=False)

    def problems(self) -> list[str]:
        """What is wrong beyond types, for this object alone."""
        return []


def _key(name: str) -> str:
    return name.rstrip("_")


def build(kind: Any, raw: Any, where: str, problems: list[str]) -> Any:
    """``raw`` as an object of ``kind``; what doesn't fit is added to problems."""
    at = where or "config"
    if kind is Any:
        return raw
    origin = get_origin(kind)
    if origin in (Union, types.UnionType):
        options = get_args(kind)
        if raw is None and type(None) in options:
            return None
        for option in (o for o in options if o is not type(None)):
            found: list[str] = []
            value = build(option, raw, where, found)
            if not found:
                return value
        problems += found
        return None
    if origin is Literal:
        if raw not in get_args(kind) or isinstance(raw, bool):
            problems.append(f"{at}: must be one of {', '.join(map(str, get_args(kind)))}")
        return raw
    if origin is list:
        if not isinstance(raw, list):
            problems.append(f"{at}: must be a list")
            return []
        return [build(get_args(kind)[0], x, f"{where}[{i}]", problems) for i, x in enumerate(raw)]
    if origin is dict:
        if not isinstance(raw, dict):
            problems.append(f"{at}: must be a mapping")
            return {}
        for k in raw:
            if not isinstance(k, str):
                problems.append(f"{at}: key {k!r} must be a string")
        return {k: build(get_args(kind)[1], v, f"{where}.{k}" if where else str(k), problems) for k, v in raw.items()}
    if is_dataclass(kind):
        return _object(kind, raw, where, problems)
    if kind is float and isinstance(raw, int) and not isinstance(raw, bool):
        return float(raw)
    if not isinstance(raw, kind) or (isinstance(raw, bool) and kind is not bool):
        problems.append(f"{at}: must be a {kind.__name__}")
    return raw


def _object(kind: type, raw: Any, where: str, problems: list[str]) -> Any:
    if not isinstance(raw, dict):
        problems.append(f"{where or 'config'}: must be a mapping")
        raw = {}
        return object.__new__(kind)
    hints = get_type_hints(kind)
    known = {_key(f.name): f for f in fields(kind) if f.init}
    problems += [f"{where + '.' if where else ''}{k}: unknown key" for k in raw if k not in known]
    values, before = {}, len(problems)
    for key, f in known.items():
        place = f"{where}.{key}" if where else key
        if key in raw:
            values[f.name] = build(hints[f.name], raw[key], place, problems)
        elif f.default is MISSING and f.default_factory is MISSING:
            problems.append(f"{place}: is required")
    if len(problems) > before and any(f.default is MISSING and f.default_factory is MISSING and f.name not in values for f in known.values()):
        return object.__new__(kind)
    out = kind(**values)
    out.given = frozenset(raw)
    if len(problems) == before:
        problems += [f"{where or 'config'}: {p}" if where else p for p in out.problems()]
    return out


def parse(kind: type, raw: Any) -> Any:
    problems: list[str] = []
    out = build(kind, raw, "", problems)
    if problems:
        raise ConfigError(problems)
    return out


# ---- shared parts ----


@dataclass
class SchemaField(Base):
    source_columns: list[str] = field(default_factory=list)
    type: FieldType = "string"
    required: bool = False
    date_format: str | None = None
    normalize: list[Literal["trim", "remove_commas", "remove_currency_symbol", "zenkaku_to_hankaku"]] = field(default_factory=list)
    true_values: list[Any] = field(default_factory=list)
    false_values: list[Any] = field(default_factory=list)

    def problems(self) -> list[str]:
        out = []
        if self.date_format is not None and self.type != "date":
            out.append("date_format needs type date")
        if self.date_format is not None and not self.date_format.strip():
            out.append("date_format must not be empty")
        return out


@dataclass
class Input(Base):
    path: str
    encoding: str = "utf-8-sig"
    delimiter: str = ","
    header: bool = True
    schema: dict[str, SchemaField] = field(default_factory=dict)


@dataclass
class KeyedInput(Input):
    key: str | list[str] = ""

    def problems(self) -> list[str]:
        return [] if self.keys else ["key: is required"]

    @property
    def keys(self) -> list[str]:
        return [self.key] if isinstance(self.key, str) and self.key else list(self.key)


@dataclass
class Reference(KeyedInput):
    on_duplicate: Literal["error"] = "error"


@dataclass
class Output(Base):
    path: str
    columns: list[str]
    encoding: str = "utf-8-sig"
    delimiter: str = ","
    header: bool = True
    newline: str = "\n"
    if_exists: Literal["error", "overwrite"] = "error"


@dataclass
class FilterRule(Base):
    if_: str
    reason: str | None = None


@dataclass
class Filters(Base):
    include: list[FilterRule] = field(default_factory=list)
    exclude: list[FilterRule] = field(default_factory=list)


@dataclass
class Project(Base):
    name: str
    description: str | None = None


@dataclass
class ErrorHandling(Base):
    error_output: str
    skipped_output: str
    on_validation_error: Policy = "output_error"
    on_lookup_missing: Policy = "output_error"
    on_transform_error: Policy = "output_error"
    max_errors: int = 1000
    include_original_row: bool = True


@dataclass
class Runtime(Base):
    run_id: str = "auto"
    log_dir: str = "./logs"
    log_level: Literal["DEBUG", "INFO", "WARNING", "ERROR"] = "INFO"
    summary_output: str | None = None
    max_input_rows: int | None = None
    max_reference_rows: int | None = None
    max_output_rows: int | None = None

    def problems(self) -> list[str]:
        limits = ("max_input_rows", "max_reference_rows", "max_output_rows")
        return [f"{k}: must be a positive integer" for k in limits if getattr(self, k) is not None and getattr(self, k) < 1]


# ---- migration ----


@dataclass
class Concat(Base):
    values: list[Any]


@dataclass
class Map(Base):
    source: str
    values: dict[str, Any]
    default: Any = None


@dataclass
class When(Base):
    if_: str
    then: Any


@dataclass
class Lookup(Base):
    reference: str
    key: str | list[str]
    value: str
    on_missing: Literal["error", "null", "empty", "default"] = "error"
    default: Any = None

    @property
    def keys(self) -> list[str]:
        return [self.key] if isinstance(self.key, str) else list(self.key)


@dataclass
class GenerateId(Base):
    fields: list[str]
    prefix: str = ""
    separator: str = "|"
    length: int = 16

    def problems(self) -> list[str]:
        return (["fields: at least one is needed"] if not self.fields else []) + ([] if 8 <= self.length <= 64 else ["length: must be between 8 and 64"])


RULE_KINDS = ("source", "value", "concat", "map", "when", "lookup", "generate_id", "expression")


@dataclass
class Rule(Base):
    source: str | None = None
    value: Any = None
    concat: Concat | None = None
    map: Map | None = None
    when: list[When] | None = None
    lookup: Lookup | None = None
    generate_id: GenerateId | None = None
    expression: str | None = None
    default: Any = None

    @property
    def kind(self) -> str:
        return next((k for k in RULE_KINDS if k in self.given), "")

    def problems(self) -> list[str]:
        n = sum(k in self.given for k in RULE_KINDS)
        return [] if n == 1 else [f"exactly one of {', '.join(RULE_KINDS)} is needed"]


@dataclass
class Validation(Base):
    field: str
    rule: Literal["required", "enum", "min", "max", "regex", "length", "referential_integrity"]
    output: str | None = None
    reference: str | None = None
    reference_key: str | None = None
    values: list[Any] | None = None
    value: Any = None
    pattern: str | None = None
    min: int | None = None
    max: int | None = None

    def problems(self) -> list[str]:
        needs = {"enum": ["values"], "min": ["value"], "max": ["value"], "regex": ["pattern"], "referential_integrity": ["reference", "reference_key"]}
        out = [f"{self.rule} validation requires {k}" for k in needs.get(self.rule, []) if not getattr(self, k) and getattr(self, k) != 0]
        if self.rule == "length" and self.min is None and self.max is None:
            out.append("length validation requires min or max")
        return out


@dataclass
class Validations(Base):
    input: list[Validation] = field(default_factory=list)
    output: list[Validation] = field(default_factory=list)


@dataclass
class Check(Base):
    name: str
    rule: str


@dataclass
class Migration(Base):
    version: Literal[1]
    project: Project
    inputs: dict[str, Input]
    outputs: dict[str, Output]
    mappings: dict[str, dict[str, Rule]]
    error_handling: ErrorHandling
    references: dict[str, Reference] = field(default_factory=dict)
    filters: Filters = field(default_factory=Filters)
    derived: dict[str, Rule] = field(default_factory=dict)
    validations: Validations = field(default_factory=Validations)
    checks: list[Check] = field(default_factory=list)
    runtime: Runtime = field(default_factory=Runtime)

    def problems(self) -> list[str]:
        from .crosscheck import migration_problems

        return migration_problems(self)


# ---- relational jobs ----


@dataclass
class Job(Base):
    version: Literal[1]
    project: Project
    output: Output
    error_handling: ErrorHandling


@dataclass
class Columns(Base):
    columns: dict[str, dict[str, Any]]


@dataclass
class MergeRules(Columns):
    base: str = ""
    join_type: Literal["left", "inner"] = "left"


@dataclass
class UnionRules(Base):
    columns: list[str] = field(default_factory=list)


@dataclass
class UnpivotRules(Base):
    id_columns: list[str]
    variable_column: str
    value_column: str
    value_columns: dict[str, Any]
    drop_null_values: bool = False


@dataclass
class AggregateRules(Columns):
    group_by: list[str] = field(default_factory=list)


@dataclass
class MatchRules(Base):
    keys: list[str]
    output_column: str
    id_prefix: str = "GROUP"
    id_padding: int = 6
    assign_singletons: bool = True
    on_missing_key: Literal["error"] = "error"


@dataclass
class Part(Columns):
    output: Output | None = None
    name: str = "parent"


@dataclass
class ConsolidateRules(Base):
    group_by: list[str]
    parent: Part
    children: list[Part] = field(default_factory=list)


@dataclass
class Merge(Job):
    inputs: dict[str, KeyedInput] = field(default_factory=dict)
    merge: MergeRules = field(default_factory=lambda: MergeRules({}))
    runtime: Runtime = field(default_factory=Runtime)

    def problems(self) -> list[str]:
        from .crosscheck import merge_problems

        return merge_problems(self)


@dataclass
class UnionJob(Job):
    inputs: dict[str, KeyedInput] = field(default_factory=dict)
    union: UnionRules = field(default_factory=UnionRules)
    runtime: Runtime = field(default_factory=Runtime)

    def problems(self) -> list[str]:
        from .crosscheck import union_problems

        return union_problems(self)


@dataclass
class SingleInput(Job):
    input: Input | None = None
    filters: Filters = field(default_factory=Filters)
    runtime: Runtime = field(default_factory=Runtime)

    def problems(self) -> list[str]:
        from .crosscheck import single_input_problems

        return single_input_problems(self)


@dataclass
class Unpivot(SingleInput):
    unpivot: UnpivotRules | None = None


@dataclass
class Aggregate(SingleInput):
    aggregate: AggregateRules | None = None


@dataclass
class Match(SingleInput):
    match: MatchRules | None = None


@dataclass
class Consolidate(Base):
    version: Literal[1]
    project: Project
    input: Input
    consolidate: ConsolidateRules
    error_handling: ErrorHandling
    runtime: Runtime = field(default_factory=Runtime)

    def problems(self) -> list[str]:
        from .crosscheck import single_input_problems

        return single_input_problems(self)


@dataclass
class RunAllJob(Base):
    name: str
    type: Literal["run", "merge", "union", "unpivot", "aggregate", "match", "consolidate"]
    config: str
    reports_dir: str | None = None
    html_report: str | None = None


@dataclass
class RunAll(Base):
    version: Literal[1]
    jobs: list[RunAllJob]
    project: Project | None = None

    def problems(self) -> list[str]:
        names = [j.name for j in self.jobs]
        out = ["jobs: at least one job is needed"] if not names else []
        return out + [f"jobs: duplicate job name: {n}" for n in sorted({n for n in names if names.count(n) > 1})]


#: Top-level key that tells the kind of a configuration, in order of looking.
KINDS: dict[str, tuple[str, type]] = {
    "jobs": ("run-all", RunAll), "merge": ("merge", Merge), "union": ("union", UnionJob), "unpivot": ("unpivot", Unpivot), "aggregate": ("aggregate", Aggregate),
    "match": ("match", Match), "consolidate": ("consolidate", Consolidate), "mappings": ("run", Migration),
}
