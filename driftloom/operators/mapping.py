"""Mapping rules compiled to value and error columns; the same rules serve derived fields and output columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config.crosscheck import rule_references
from ..expr.arithmetic import compile_expression
from ..expr.conditions import compile_condition
from ..expr.scope import ERROR, Compiled, CompileError, Scope, error, is_reference
from ..functions.text import Typed, is_blank, literal, python_repr, python_text, unify
from ..sources.scan import Loaded

#: A reference with at most this many rows and bytes of text in its keys and the values that are looked up (counted) is
#: broadcast; larger ones meet the input in a shuffled join.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


@dataclass
class References:
    """Loaded references by name, with their keys, and the joins that the compiled lookups need so far."""

    loaded: dict[str, Loaded]
    keys: dict[str, str | list[str]]
    #: Value columns that some lookup uses, by reference.
    used: dict[str, set[str]]
    joined: dict[tuple, str] = field(default_factory=dict)
    small: dict[str, bool] = field(default_factory=dict)

    def fits(self, name: str) -> bool:
        """Whether the part of a reference that lookups need is small enough to be broadcast."""
        if name not in self.small:
            keys = self.keys[name]
            needed = sorted({*([keys] if isinstance(keys, str) else keys), *self.used.get(name, ())})
            size = F.lit(0)
            for c in needed:
                size = size + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
            n, bytes_ = self.loaded[name].df.limit(BROADCAST_ROWS + 1).select(size.cast("bigint").alias("b")).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
            self.small[name] = n <= BROADCAST_ROWS and bytes_ <= BROADCAST_BYTES
        return self.small[name]


def values_used(config) -> dict[str, set[str]]:
    """The value columns that a migration's lookups take from each reference."""
    used: dict[str, set[str]] = {}
    for rules in (config.derived, *config.mappings.values()):
        for rule in rules.values():
            if rule.kind == "lookup":
                used.setdefault(rule.lookup.reference, set()).add(rule.lookup.value)
    return used


class Mapper:
    """Compiles rules against a frame; lookups add joins to it, one for each reference and set of key columns."""

    def __init__(self, df: DataFrame, scope: Scope, references: References):
        self.df, self.scope, self.references = df, scope, references

    def value_of(self, value) -> Typed:
        return self.scope.find(value) if is_reference(value) else literal(value)

    def compile(self, rule, where: str) -> Compiled:
        """The rule's value and error; a rule that can't be compiled is an error in every row."""
        try:
            return getattr(self, f"_{rule.kind}")(rule, where)
        except CompileError as e:
            text = str(e)
            return Compiled(Typed(F.lit(None).cast("string"), "null"), error(where, rule.kind, text if text.startswith(where) else f"{where}: {text}"))

    def _source(self, rule, where: str) -> Compiled:
        return Compiled(self.scope.find(rule.source))

    def _value(self, rule, where: str) -> Compiled:
        return Compiled(literal(rule.value))

    def _concat(self, rule, where: str) -> Compiled:
        parts = [self.value_of(v) for v in rule.concat.values]
        return Compiled(Typed(F.concat(*[F.coalesce(python_text(p), F.lit("")) for p in parts]) if parts else F.lit(""), "string"))

    def _map(self, rule, where: str) -> Compiled:
        source = self.scope.find(rule.map.source)
        targets, kind = unify([literal(v) for v in (*rule.map.values.values(), rule.map.default)])
        if source.type == "string" and rule.map.values:
            pairs = [c for k, t in zip(rule.map.values, targets[:-1], strict=True) for c in (F.lit(k), t)]
            found = F.try_element_at(F.create_map(*pairs), source.col)
        else:  # keys are text, so values of other types are never among them
            found = F.when(F.lit(False), targets[-1])
        value = F.when(source.col.isNotNull(), F.coalesce(found, targets[-1]))
        if rule.map.default is not None:
            return Compiled(Typed(value, kind))
        bad = F.when(source.col.isNotNull() & found.isNull(), error(where, "map", F.concat(F.lit(f"{where}: unmapped values: "), python_repr(source))))
        return Compiled(Typed(value, kind), bad)

    def _generate_id(self, rule, where: str) -> Compiled:
        spec = rule.generate_id
        parts = [(f, self.scope.find(f)) for f in spec.fields]
        bad = [F.when(p.col.isNull(), error(where, "generate_id", f"{where}: generate_id field is missing: {f}")).when(is_blank(p), error(where, "generate_id", f"{where}: generate_id field is blank: {f}")) for f, p in parts]
        text = F.concat_ws(spec.separator, *[python_text(p, iso=True) for _, p in parts])
        return Compiled(Typed(F.concat(F.lit(spec.prefix), F.substring(F.sha2(text, 256), 1, spec.length)), "string"), F.coalesce(*bad) if len(bad) > 1 else bad[0])

    def _when(self, rule, where: str) -> Compiled:
        branches = [(compile_condition(w.if_, self.scope), self.value_of(w.then)) for w in rule.when]
        has_default = "default" in rule.given
        values, kind = unify([v for _, v in branches] + ([self.value_of(rule.default)] if has_default else []))
        value: Column | None = None
        failed = None
        for ((holds, fails), _), v in zip(branches, values, strict=False):
            value = F.when(holds, v) if value is None else value.when(holds, v)
            if fails is not None:
                failed = fails if failed is None else failed | fails
        out = value.otherwise(values[-1]) if has_default else value
        bad = None
        if not has_default:
            any_holds = branches[0][0][0]
            for (holds, _), _ in branches[1:]:
                any_holds = any_holds | holds
            bad = F.when(~any_holds, error(where, "when", f"{where}: no when condition matched and default is missing"))
        if failed is not None:
            broken = F.when(failed, error(where, "when", f"Unsupported condition expression: {'; '.join(w.if_ for w in rule.when)}"))
            bad = broken if bad is None else F.coalesce(broken, bad)
        return Compiled(Typed(out, kind), bad)

    def _expression(self, rule, where: str) -> Compiled:
        return compile_expression(rule.expression, self.scope, where)

    def _lookup(self, rule, where: str) -> Compiled:
        spec = rule.lookup
        if spec.reference not in self.references.loaded:
            raise CompileError(f"lookup reference is not loaded: {spec.reference}")
        loaded, ref_key = self.references.loaded[spec.reference], self.references.keys[spec.reference]
        if spec.value not in loaded.types:
            raise CompileError(f"lookup value column is not defined in reference '{spec.reference}': {spec.value}")
        if isinstance(spec.key, str) != isinstance(ref_key, str):
            raise CompileError("lookup.key and reference.key must both be single or both be lists")
        keys, ref_keys = spec.keys, [ref_key] if isinstance(ref_key, str) else list(ref_key)
        if len(keys) != len(ref_keys):
            raise CompileError("lookup.key count does not match reference.key count")
        mine = [self.scope.find(k) for k in keys]
        numeric = ("integer", "decimal")
        alike = all(a.type == loaded.types[r] or (a.type in numeric and loaded.types[r] in numeric) for a, r in zip(mine, ref_keys, strict=True))
        name = self._join(spec.reference, tuple(keys), mine, ref_keys) if alike else None
        # Keys of unlike types never meet: no text is read as a number for a lookup.
        met = F.col(name).isNotNull() if name else F.lit(False)
        target = Typed(F.col(f"`{name}_{spec.value}`") if name else F.lit(None).cast("string"), loaded.types[spec.value] if name else "null")
        if spec.on_missing == "default" and "default" not in spec.given:
            raise CompileError("lookup on_missing 'default' requires default value")
        instead = literal({"default": spec.default, "empty": ""}.get(spec.on_missing))
        (a, b), kind = unify([target, instead])
        bad = None
        if spec.on_missing == "error":
            shown = python_text(mine[0]) if len(mine) == 1 else F.concat(F.lit("("), F.concat_ws(", ", *[python_repr(m) for m in mine]), F.lit(")"))
            bad = F.when(~met, error("lookup missing", "lookup_missing", F.concat(F.lit(f"lookup missing: reference={spec.reference} key="), F.coalesce(shown, F.lit("<NA>")))))
        return Compiled(Typed(F.when(met, a).otherwise(b), kind), bad)

    def _join(self, reference: str, keys: tuple[str, ...], mine: list[Typed], ref_keys: list[str]) -> str:
        """The name of a column that is true where a key matches; the values that lookups use stand beside it."""
        if (reference, keys) in self.references.joined:
            return self.references.joined[reference, keys]
        name = f"__lookup_{len(self.references.joined)}"
        loaded = self.references.loaded[reference]
        values = [c for c in loaded.types if c in self.references.used.get(reference, ())]
        theirs = [F.col(f"`{k}`").alias(f"{name}__key{i}") for i, k in enumerate(ref_keys)]
        right = loaded.df.select(*theirs, *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in values], F.lit(True).alias(name))
        right = F.broadcast(right) if self.references.fits(reference) else right
        left = self.df.withColumns({f"{name}__mine{i}": m.col for i, m in enumerate(mine)})
        on = [F.col(f"{name}__mine{i}") == F.col(f"{name}__key{i}") for i in range(len(mine))]
        self.df = left.join(right, on, "left").drop(*[f"{name}__{side}{i}" for i in range(len(mine)) for side in ("key", "mine")])
        self.references.joined[reference, keys] = name
        return name


def derived_order(derived: dict) -> list[str]:
    """Derived fields after those they use; a cycle or an unknown field is a CompileError."""
    done: list[str] = []
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in done:
            return
        if name in open_:
            raise CompileError(f"derived field cycle detected: {name}")
        if name not in derived:
            raise CompileError(f"derived field is not defined: derived.{name}")
        open_.add(name)
        for _, ref in rule_references(derived[name]):
            space, _, other = ref.partition(".")
            if space == "derived":
                visit(other)
        open_.discard(name)
        done.append(name)

    for name in derived:
        visit(name)
    return done


def derive(mapper: Mapper, derived: dict) -> list[Column]:
    """Add derived fields to the mapper's frame and scope; the errors, in the order they are met."""
    errors = []
    for i, name in enumerate(derived_order(derived)):
        made = mapper.compile(derived[name], f"derived.{name}")
        columns = {f"__derived_{i}": made.value.col}
        if made.error is not None:
            columns[f"__derived_error_{i}"] = made.error
            errors.append(F.col(f"__derived_error_{i}"))
        mapper.df = mapper.df.withColumns(columns)
        mapper.scope.derived[name] = Typed(F.col(f"__derived_{i}"), made.value.type)
    return errors


def first_error(errors: list[Column]) -> Column:
    return F.coalesce(*errors, F.lit(None).cast(ERROR)) if errors else F.lit(None).cast(ERROR)
