"""What must hold between the parts of a configuration."""

from __future__ import annotations

from collections.abc import Iterable

from ..expr.checks import SCALARS
from ..expr.conditions import references
from ..expr.scope import is_reference

REDUCERS = ("source", "first", "last", "sum", "min", "max", "count")
AGGREGATES = ("group_key", "sum", "count", "min", "max", "first", "last")
PARENT_RULES = ("first", "last", "sum", "count", "require_same")
CHILD_RULES = ("source", "parent_value")


def _unknown(where: str, names: Iterable[str], known: Iterable[str], what: str) -> list[str]:
    known = set(known)
    return [f"{where}: unknown {what}: {n}" for n in names if n not in known]


def _same(where: str, got: list[str], wanted: list[str]) -> list[str]:
    return [] if got == wanted else [f"{where}: must be exactly {wanted}"]


def single_rule(rule: dict, kinds: tuple[str, ...]) -> str | None:
    """The one rule kind of a column's mapping, or None."""
    found = [k for k in rule if k in kinds]
    return found[0] if len(found) == len(rule) == 1 else None


def _reference(where: str, text: str, fields: dict[str, set[str]]) -> list[str]:
    space, _, name = text.partition(".")
    if space not in fields:
        return [f"{where}: unknown field namespace '{space}'"]
    return [] if name in fields[space] else [f"{where}: unknown field '{text}'"]


def rule_references(rule) -> list[tuple[str, str]]:
    """(place in the rule, field reference) of a mapping rule."""
    kind = rule.kind
    out: list[tuple[str, str]] = []
    if kind == "source":
        out.append(("source", rule.source))
    elif kind == "concat":
        out += [(f"concat.values[{i}]", v) for i, v in enumerate(rule.concat.values) if is_reference(v)]
    elif kind == "map":
        out.append(("map.source", rule.map.source))
    elif kind == "when":
        for i, w in enumerate(rule.when):
            out += [(f"when[{i}].if", r) for r in references(w.if_)]
            out += [(f"when[{i}].then", w.then)] if is_reference(w.then) else []
    elif kind == "lookup":
        out += [(f"lookup.key[{i}]", k) for i, k in enumerate(rule.lookup.keys)]
    elif kind == "generate_id":
        out += [(f"generate_id.fields[{i}]", f) for i, f in enumerate(rule.generate_id.fields)]
    elif kind == "expression":
        out += [("expression", r) for r in references(rule.expression)]
    if "default" in rule.given and is_reference(rule.default):
        out.append(("default", rule.default))
    return out


def migration_problems(m) -> list[str]:
    out = [] if len(m.inputs) == 1 else ["inputs: exactly one input is supported"]
    for name, output in m.outputs.items():
        if name not in m.mappings:
            out.append(f"mappings.{name}: mappings for output are required")
            continue
        rules = set(m.mappings[name])
        out += [f"mappings.{name}: {what}: {', '.join(sorted(cols))}" for what, cols in (("missing mappings for output columns", set(output.columns) - rules), ("mappings contain unknown output columns", rules - set(output.columns))) if cols]
    out += _unknown("mappings", sorted(m.mappings), m.outputs, "output")
    if not m.inputs:
        return out
    input_name = next(iter(m.inputs))
    fields = {input_name: set(m.inputs[input_name].schema), "derived": set(m.derived)}
    places = [(f"derived.{f}", r) for f, r in m.derived.items()] + [(f"mappings.{o}.{f}", r) for o, rules in m.mappings.items() for f, r in rules.items()]
    for where, rule in places:
        for part, ref in rule_references(rule):
            out += _reference(f"{where}.{part}", ref, fields)
        if rule.kind == "lookup":
            out += _unknown(f"{where}.lookup.reference", [rule.lookup.reference], m.references, "reference")
    for section in ("include", "exclude"):
        for i, f in enumerate(getattr(m.filters, section)):
            for ref in references(f.if_):
                out += _reference(f"filters.{section}[{i}].if", ref, fields)
    for stage, rules in (("input", m.validations.input), ("output", m.validations.output)):
        for i, v in enumerate(rules):
            out += _validation(f"validations.{stage}[{i}]", stage, v, m, input_name)
    for i, c in enumerate(m.checks):
        out += _check(f"checks[{i}].rule", c.rule)
    return out


def _validation(where: str, stage: str, v, m, input_name: str) -> list[str]:
    out = []
    if v.rule == "referential_integrity" and v.reference not in m.references:
        out.append(f"{where}.reference: unknown reference: {v.reference}")
    space, dot, name = v.field.partition(".")
    if stage == "input":
        if dot != "." or space != input_name or name not in m.inputs[input_name].schema:
            out.append(f"{where}.field: unknown input field '{v.field}'")
        return out
    target = v.output or (space if dot and space in m.outputs else None)
    if v.output is not None and v.output not in m.outputs:
        out.append(f"{where}.output: unknown output: {v.output}")
    elif target is None and len(m.outputs) > 1:
        out.append(f"{where}: output is needed where there are several outputs")
    else:
        column = name if dot and space in m.outputs else v.field
        columns = m.outputs[target or next(iter(m.outputs))].columns
        if column not in columns:
            out.append(f"{where}.field: unknown output column '{column}'")
    return out


def _check(where: str, rule: str) -> list[str]:
    import ast

    try:
        tree = ast.parse(rule.strip(), mode="eval")
    except (SyntaxError, ValueError):
        return [f"{where}: invalid expression"]
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            out.append(f"{where}: function calls are not allowed")
        elif isinstance(node, ast.Attribute):
            out.append(f"{where}: fields are not allowed")
        elif isinstance(node, ast.Name) and node.id not in SCALARS and node.id.lower() not in ("true", "false"):
            out.append(f"{where}: unknown name '{node.id}'")
    return out


def _keys(inputs: dict) -> list[str]:
    out = []
    for name, i in inputs.items():
        if i.schema:
            out += _unknown(f"inputs.{name}.key", i.keys, i.schema, "key field")
    return out


def merge_problems(m) -> list[str]:
    out = [] if len(m.inputs) >= 2 else ["inputs: merge requires at least two inputs"]
    out += _unknown("merge.base", [m.merge.base], m.inputs, "base input") + _keys(m.inputs)
    rules = set(m.merge.columns)
    out += [f"merge.columns: {what}: {', '.join(sorted(cols))}" for what, cols in (("missing rules for", set(m.output.columns) - rules), ("rules for unknown columns", rules - set(m.output.columns))) if cols]
    sizes = {len(i.keys) for i in m.inputs.values()}
    out += ["inputs: all keys must have the same number of fields"] if len(sizes) > 1 else []
    for column, rule in m.merge.columns.items():
        kind = single_rule(rule, REDUCERS)
        where = f"merge.columns.{column}"
        if kind is None:
            out.append(f"{where}: exactly one of {', '.join(REDUCERS)} is needed")
            continue
        refs = [rule[kind]] if kind == "source" else rule[kind]
        if not isinstance(refs, list) or not refs or not all(isinstance(r, str) and r.strip() for r in refs):
            out.append(f"{where}.{kind}: must name at least one field")
            continue
        for r in refs:
            space, dot, name = r.partition(".")
            if not dot or space not in m.inputs:
                out.append(f"{where}.{kind}: field reference must be <input>.<field>: {r}")
            elif m.inputs[space].schema and name not in m.inputs[space].schema:
                out.append(f"{where}.{kind}: unknown input field '{r}'")
    return out


def union_problems(u) -> list[str]:
    out = [] if len(u.inputs) >= 2 else ["inputs: union requires at least two inputs"]
    out += _same("union.columns", u.union.columns, u.output.columns) + _keys(u.inputs)
    keys = [i.keys for i in u.inputs.values()]
    return out + (["inputs: all inputs must have the same key"] if any(k != keys[0] for k in keys) else [])


def single_input_problems(job) -> list[str]:
    source = job.input
    if source is None:
        return ["input: is required"]
    if not source.schema:
        return ["input.schema: is required"]
    fields = set(source.schema)
    if getattr(job, "unpivot", None) is not None:
        u = job.unpivot
        out = _same("output.columns", job.output.columns, [*u.id_columns, u.variable_column, u.value_column])
        out += _unknown("unpivot.id_columns", u.id_columns, fields, "input field") + _unknown("unpivot.value_columns", u.value_columns, fields, "input field")
        for section in ("include", "exclude"):
            for i, f in enumerate(getattr(job.filters, section)):
                for ref in references(f.if_):
                    out += _reference(f"filters.{section}[{i}].if", ref, {"input": fields})
        return out + ([] if u.value_columns else ["unpivot.value_columns: at least one is needed"])
    if getattr(job, "aggregate", None) is not None:
        a = job.aggregate
        out = _same("output.columns", job.output.columns, list(a.columns)) + _unknown("aggregate.group_by", a.group_by, fields, "input field")
        out += [] if a.group_by else ["aggregate.group_by: at least one field is needed"]
        used = []
        for column, rule in a.columns.items():
            kind, where = single_rule(rule, AGGREGATES), f"aggregate.columns.{column}"
            if kind is None:
                out.append(f"{where}: exactly one of {', '.join(AGGREGATES)} is needed")
                continue
            source_field = rule[kind]
            if kind == "count" and (source_field is None or not str(source_field).strip()):
                continue
            if not isinstance(source_field, str) or source_field not in fields:
                out.append(f"{where}.{kind}: unknown input field: {source_field}")
            elif kind == "group_key":
                out += [] if source_field in a.group_by else [f"{where}.group_key: must be one of aggregate.group_by"]
                used.append(source_field)
        out += [f"aggregate.group_by: {g} needs exactly one group_key column" for g in a.group_by if used.count(g) != 1]
        return out
    if getattr(job, "match", None) is not None:
        m = job.match
        out = _unknown("match.keys", m.keys, fields, "input field") + _unknown("output.columns", job.output.columns, fields | {m.output_column}, "column")
        out += [] if m.keys else ["match.keys: at least one key is needed"]
        out += ["match.output_column: is an input field already"] if m.output_column in fields else []
        out += [] if m.output_column in job.output.columns else ["output.columns: must include match.output_column"]
        out += ["output.columns: duplicate columns"] if len(set(job.output.columns)) < len(job.output.columns) else []
        return out + ([] if m.id_padding >= 1 else ["match.id_padding: must be positive"])
    if getattr(job, "consolidate", None) is not None:
        return _consolidate(job.consolidate, fields)
    return ["config: no job section"]


def _consolidate(c, fields: set[str]) -> list[str]:
    out = _unknown("consolidate.group_by", c.group_by, fields, "input field")
    out += [] if c.group_by else ["consolidate.group_by: at least one field is needed"]
    out += ["consolidate.group_by: duplicate fields"] if len(set(c.group_by)) < len(c.group_by) else []
    out += [] if c.children else ["consolidate.children: at least one child is needed"]
    names = [k.name for k in c.children]
    out += [f"consolidate.children: duplicate child name: {n}" for n in sorted({n for n in names if names.count(n) > 1})]
    for where, part, kinds in [("consolidate.parent", c.parent, PARENT_RULES), *[(f"consolidate.children[{i}]", k, CHILD_RULES) for i, k in enumerate(c.children)]]:
        if part.output is None:
            out.append(f"{where}.output: is required")
            continue
        out += _same(f"{where}.output.columns", part.output.columns, list(part.columns))
        for column, rule in part.columns.items():
            kind = single_rule(rule, kinds)
            if kind is None or not isinstance(rule[kind], str) or not rule[kind].strip():
                out.append(f"{where}.columns.{column}: exactly one of {', '.join(kinds)} with a field is needed")
            else:
                out += _unknown(f"{where}.columns.{column}", [rule[kind]], c.parent.columns if kind == "parent_value" else fields, "parent column" if kind == "parent_value" else "input field")
    return out
