"""The relational jobs: merge, union, unpivot, aggregate, match and consolidate, as lazy plans.

Each takes loaded sources and its rules and gives a ``JobPlan``: output frames, error rows and skipped rows. An error
row makes the whole job fail with empty outputs; that decision is the runner's, the frames here are what would be written.
Rows keep ROW (or an order column), and nothing is sorted before a sink needs it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config.crosscheck import AGGREGATES, CHILD_RULES, PARENT_RULES, REDUCERS, single_rule
from ..expr.scope import Scope
from ..functions.casts import to_number
from ..functions.text import Typed, is_blank, literal, python_repr, unify
from ..sources.scan import ROW, Loaded
from .filters import skip_reason
from .order import ranked

ERRORS = "input_name string, row_number bigint, stage string, field string, rule string, message string, row_json string"
SKIPPED = "row_number bigint, reason string, row_json string"


@dataclass
class JobPlan:
    #: Output name -> frame; columns beginning with two underscores give the order and aren't written.
    outputs: dict[str, DataFrame]
    errors: DataFrame
    skipped: DataFrame
    types: dict[str, dict[str, str]] = field(default_factory=dict)


def _json(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("__")]), {"ignoreNullFields": "false"})


def error_rows(df: DataFrame, input_name: str | Column, stage: str, where: str | Column, rule: str, message: str | Column, row: Column | None = None) -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(text(input_name).alias("input_name"), F.col(ROW).cast("bigint").alias("row_number"), F.lit(stage).alias("stage"), text(where).alias("field"), F.lit(rule).alias("rule"), text(message).alias("message"), (_json(df) if row is None else row).alias("row_json"))


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _union(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames) if frames else no_rows(spark, schema)


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def _blank_key(loaded: Loaded, keys: list[str]) -> Column:
    return _any([is_blank(loaded.typed()[k]) for k in keys])


def _missing_key_message(loaded: Loaded, keys: list[str], what: str) -> Column:
    names = F.array_compact(F.array(*[F.when(is_blank(loaded.typed()[k]), k) for k in keys]))
    return F.concat(F.lit(f"{what}: "), F.array_join(names, ", "))


def duplicate_keys(df: DataFrame, keys: list[Column]) -> DataFrame:
    """The keys that more than one row has. Counts are summed before the shuffle, so a hot key costs one row per task."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*named).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")


def rows_with(df: DataFrame, keys: list[Column], found: DataFrame, how: str) -> DataFrame:
    """Rows of df whose keys are (left_semi) or aren't (left_anti) in ``found``; null equals null."""
    return df.join(found, reduce(lambda a, b: a & b, [k.eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]), how)


# ---- merge ----


def merge(sources: dict[str, Loaded], keys: dict[str, list[str]], base: str, columns: dict[str, dict], join_type: str = "left") -> JobPlan:
    """Left joins of all other inputs to the base in their order; for ``inner``, rows without a partner are skipped and reported."""
    spark = sources[base].df.sparkSession
    bad = []
    for name, s in sources.items():
        own = [F.col(f"`{k}`") for k in keys[name]]
        missing = _any([k.isNull() for k in own])
        where = ", ".join(keys[name])
        bad.append(error_rows(s.df.where(missing), name, "merge", where, "missing_key", f"merge key is missing: {where}"))
        bad.append(error_rows(rows_with(s.df, own, duplicate_keys(s.df, own), "left_semi"), name, "merge", where, "duplicate_key", F.concat(F.lit("duplicate merge key: "), F.concat_ws(", ", *[k.cast("string") for k in own]))))
    typed = {f"{n}.{c}": Typed(F.col(f"`{n}.{c}`"), t) for n, s in sources.items() for c, t in s.types.items()}

    def prefixed(name: str) -> DataFrame:
        s = sources[name]
        return s.df.select(*[F.col(f"`{c}`").alias(f"{name}.{c}") for c in s.types], *[F.col(f"`{k}`").alias(f"__{name}_{i}") for i, k in enumerate(keys[name])], *([F.col(ROW)] if name == base else [F.lit(True).alias(f"__met_{name}")]))

    joined, skipped = prefixed(base), []
    for name in sources:
        if name == base:
            continue
        on = reduce(lambda a, b: a & b, [F.col(f"__{base}_{i}") == F.col(f"__{name}_{i}") for i in range(len(keys[base]))])
        joined = joined.join(prefixed(name), on, "left").drop(*[f"__{name}_{i}" for i in range(len(keys[base]))])
        if join_type == "inner":
            alone = joined.where(F.col(f"__met_{name}").isNull())
            skipped.append(alone.select(F.col(ROW).cast("bigint").alias("row_number"), F.lit(f"No merge match in {name}").alias("reason"), F.to_json(F.named_struct(*[x for c in sources[base].types for x in (F.lit(c), F.col(f"`{base}.{c}`"))]), {"ignoreNullFields": "false"}).alias("row_json")))
            joined = joined.where(F.col(f"__met_{name}").isNotNull())
    made = {c: _reduce(rule, typed) for c, rule in columns.items()}
    out = joined.select(*[v.col.alias(c) for c, v in made.items()], ROW)
    return JobPlan({"output": out}, _union(bad, spark, ERRORS), _union(skipped, spark, SKIPPED), {"output": {c: v.type for c, v in made.items()}})


def _reduce(rule: dict, typed: dict[str, Typed]) -> Typed:
    kind = single_rule(rule, REDUCERS)
    values = [typed[r] for r in ([rule[kind]] if kind == "source" else rule[kind])]
    if kind == "source":
        return values[0]
    if kind in ("first", "last"):
        cols, t = unify(values)
        return Typed(F.coalesce(*(cols if kind == "first" else cols[::-1])), t)
    if kind == "count":
        return Typed(reduce(lambda a, b: a + b, [v.col.isNotNull().cast("bigint") for v in values]), "integer")
    whole = all(v.type in ("integer", "boolean") for v in values)
    nums = [to_number(v).cast("bigint" if whole else "double") for v in values]
    if kind == "sum":
        some = _any([n.isNotNull() for n in nums])
        # A row's sum is a decimal whatever its parts are, so whole sums print with a point.
        return Typed(F.when(some, reduce(lambda a, b: a + b, [F.coalesce(n.cast("double"), F.lit(0.0)) for n in nums])), "decimal")
    else:
        col = nums[0] if len(nums) == 1 else (F.least if kind == "min" else F.greatest)(*nums)
    return Typed(col, "integer" if whole else "decimal")


# ---- union ----


def union(sources: dict[str, Loaded], keys: list[str], columns: list[str]) -> JobPlan:
    """All rows of all inputs in order. Missing keys are errors; so are keys that two of the other rows share, in one input or across."""
    parts, bad, types = [], [], {}
    for i, (name, s) in enumerate(sources.items()):
        if list(s.types) != columns:
            raise ValueError(f"{name}: columns must be exactly {columns}, found {list(s.types)}")
        types = types or s.types
        missing = _blank_key(s, keys)
        bad.append(error_rows(s.df.where(missing), name, "input_validation", ", ".join(keys), "missing_key", _missing_key_message(s, keys, "union key is missing")))
        parts.append(s.df.where(~missing).select(*[F.col(f"`{c}`") for c in columns], ROW, F.lit(i).alias("__input_order"), F.lit(name).alias("__input")))
    every = reduce(lambda a, b: a.unionByName(b), parts)
    own = [F.col(f"`{k}`") for k in keys]
    twice = rows_with(every, own, duplicate_keys(every, own), "left_semi")
    bad.append(error_rows(twice, F.col("__input"), "input_validation", ", ".join(keys), "duplicate_key", F.concat(F.lit("duplicate union key: "), F.concat_ws(", ", *[k.cast("string") for k in own]))))
    spark = every.sparkSession
    return JobPlan({"output": every.drop("__input")}, _union(bad, spark, ERRORS), no_rows(spark, SKIPPED), {"output": dict(types)})


# ---- unpivot ----


def unpivot(source: Loaded, id_columns: list[str], variable: str, value: str, value_columns: dict, drop_null: bool = False, filters=None) -> JobPlan:
    """Each row once for each value column, in order; filters come first. Mixed types become text."""
    typed = source.typed()
    df, spark, skipped, bad = source.df, source.df.sparkSession, None, []
    if filters is not None and (filters.include or filters.exclude):
        reason, failures = skip_reason(filters, Scope("input", typed))
        marked = df.withColumn("__reason", reason)
        if failures:
            marked = marked.withColumn("__failed", F.coalesce(*failures) if len(failures) > 1 else failures[0])
            bad.append(error_rows(marked.where("__failed is not null"), "input", "unpivot", F.col("__failed.field"), "filter", F.col("__failed.message"), _json(df)))
        out = marked.where(F.col("__reason").isNotNull())
        skipped = out.select(F.col(ROW).cast("bigint").alias("row_number"), F.col("__reason").alias("reason"), _json(df).alias("row_json"))
        df = marked.where(F.col("__reason").isNull())
    values, kind = unify([typed[c] for c in value_columns])
    labels, label_kind = unify([literal(v) for v in value_columns.values()])
    pairs = F.array(*[F.struct(n.alias("n"), v.alias("v")) for n, v in zip(labels, values, strict=True)])
    long = df.select(*[F.col(f"`{c}`") for c in id_columns], ROW, F.posexplode(pairs).alias("__at", "__pair"))
    out = long.select(*[F.col(f"`{c}`") for c in id_columns], F.col("__pair.n").alias(variable), F.col("__pair.v").alias(value), ROW, "__at")
    if drop_null:
        out = out.where(~is_blank(Typed(F.col(f"`{value}`"), kind)))
    types = {c: source.types[c] for c in id_columns} | {variable: label_kind, value: kind}
    return JobPlan({"output": out}, _union(bad, spark, ERRORS), skipped if skipped is not None else no_rows(spark, SKIPPED), {"output": types})


# ---- aggregate ----


def aggregate(source: Loaded, group_by: list[str], columns: dict[str, dict]) -> JobPlan:
    """One row per group with the rules' values; ``__order`` is the group's first row. Rows with a blank key are errors."""
    typed, df, spark = source.typed(), source.df, source.df.sparkSession
    missing = _blank_key(source, group_by)
    bad = [error_rows(df.where(missing), "input", "input_validation", ", ".join(group_by), "missing_group_key", _missing_key_message(source, group_by, "group key is missing"))]
    aggs, types = [], {}
    for name, rule in columns.items():
        kind = single_rule(rule, AGGREGATES)
        v = typed.get(rule[kind]) if rule[kind] else None
        col, types[name], odd = _aggregated(kind, v, name)
        if odd is not None:
            odd_rows = df.where(~missing & odd)
            bad.append(error_rows(odd_rows, "input", "aggregate", name, kind, F.concat(F.lit("value is not numeric: "), python_repr(v))))
        aggs.append((name, kind, col))
    grouped = df.where(~missing).groupBy(*[F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(group_by)])
    made = grouped.agg(F.min(ROW).alias("__order"), *[c.alias(f"__a{i}") for i, (_, _, c) in enumerate(aggs) if c is not None])
    out = made.select(*[(F.col(f"__g{group_by.index(columns[n]['group_key'])}") if k == "group_key" else F.col(f"__a{i}")).alias(n) for i, (n, k, _) in enumerate(aggs)], "__order")
    for n, k, _ in aggs:
        if k == "group_key":
            types[n] = source.types[columns[n]["group_key"]]
    return JobPlan({"output": out}, _union(bad, spark, ERRORS), no_rows(spark, SKIPPED), {"output": types})


def _by_order(kind: str, value: Column) -> Column:
    """First or last value that isn't null, by row number."""
    return (F.min_by if kind == "first" else F.max_by)(value, F.when(value.isNotNull(), F.col(ROW)))


def _aggregated(kind: str, v: Typed | None, name: str) -> tuple[Column | None, str, Column | None]:
    """(aggregate, type, where a value isn't numeric)."""
    if kind == "group_key":
        return None, "string", None
    if kind == "count":
        return F.count(F.lit(1)) if v is None else F.count(v.col), "integer", None
    if kind in ("first", "last"):
        return _by_order(kind, v.col), v.type, None
    if v.type == "date" and kind in ("min", "max"):
        return (F.min if kind == "min" else F.max)(v.col), "date", None
    n = to_number(v)
    odd = v.col.isNotNull() & n.isNull() if v.type in ("string", "date") else None
    whole = v.type in ("integer", "boolean")
    if kind == "sum":
        zero = F.lit(0).cast("bigint" if whole else "double")
        return F.coalesce(F.sum(n), zero), "integer" if whole else "decimal", odd
    return (F.min if kind == "min" else F.max)(n), "integer" if whole else "decimal", odd


# ---- match ----


def match(source: Loaded, keys: list[str], output_column: str, columns: list[str], prefix: str = "GROUP", padding: int = 6, singletons: bool = True) -> JobPlan:
    """Rows with the same keys share an id, numbered by first appearance; a number is used up even where it isn't shown."""
    df, spark = source.df, source.df.sparkSession
    missing = _blank_key(source, keys)
    bad = error_rows(df.where(missing), "input", "match", ", ".join(keys), "missing_match_key", _missing_key_message(source, keys, "match key is missing"))
    named = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    groups = df.where(~missing).groupBy(*named).agg(F.min(ROW).alias("__first"), F.count("*").alias("__n"))
    numbers = ranked(groups, "__first", "__number")
    digits = F.col("__number").cast("string")
    shown = F.concat(F.lit(prefix), F.when(F.length(digits) < padding, F.lpad(digits, padding, "0")).otherwise(digits))
    ids = numbers.select(*[f"__k{i}" for i in range(len(keys))], (shown if singletons else F.when(F.col("__n") > 1, shown)).alias("__id"))
    on = reduce(lambda a, b: a & b, [F.col(f"`{k}`") == F.col(f"__k{i}") for i, k in enumerate(keys)])
    out = df.where(~missing).join(ids, on).select(*[F.col("__id").alias(c) if c == output_column else F.col(f"`{c}`") for c in columns], ROW)
    types = {c: "string" if c == output_column else source.types[c] for c in columns}
    return JobPlan({"output": out}, bad, no_rows(spark, SKIPPED), {"output": types})


# ---- consolidate ----


def consolidate(source: Loaded, group_by: list[str], parent: dict[str, dict], children: dict[str, dict[str, dict]]) -> JobPlan:
    """One parent row per group, and for each child a row per source row that may carry its parent's values."""
    typed, df, spark = source.typed(), source.df, source.df.sparkSession
    missing = _blank_key(source, group_by)
    bad = [error_rows(df.where(missing), "input", "consolidate", ", ".join(group_by), "missing_group_key", _missing_key_message(source, group_by, "group key is missing"))]
    valid = df.where(~missing)
    aggs, faults, types = [F.min(ROW).alias("__order")], [], {}
    for i, (name, rule) in enumerate(parent.items()):
        kind = single_rule(rule, PARENT_RULES)
        v = typed[rule[kind]]
        types[name] = v.type
        if kind in ("first", "last"):
            col = _by_order(kind, v.col)
        elif kind == "count":
            col, types[name] = F.count(v.col), "integer"
        elif kind == "require_same":
            col = _by_order("first", v.col)
            aggs.append((F.min(v.col) != F.max(v.col)).alias(f"__bad{i}"))
            faults.append((i, name, "require_same_conflict", f"values differ within the group: {rule[kind]}"))
        else:
            n = to_number(v)
            whole = v.type in ("integer", "boolean")
            col, types[name] = F.sum(n), "integer" if whole else "decimal"
            aggs.append(((F.count_if(n.isNull()) > 0) & (F.count(v.col) > 0)).alias(f"__bad{i}"))
            faults.append((i, name, "invalid_sum_value", f"a value can't be summed: {rule[kind]}"))
        aggs.append(col.alias(f"__p{i}"))
    named = [F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(group_by)]
    groups = valid.groupBy(*named).agg(*aggs)
    on = reduce(lambda a, b: a & b, [F.col(f"`{g}`") == F.col(f"__g{i}") for i, g in enumerate(group_by)])
    for i, name, rule, message in faults:
        hit = valid.join(groups.where(F.coalesce(F.col(f"__bad{i}"), F.lit(False))).select(*[f"__g{j}" for j in range(len(group_by))]), on, "left_semi")
        bad.append(error_rows(hit, "input", "consolidate", name, rule, message))
    outputs = {"parent": groups.select(*[F.col(f"__p{i}").alias(n) for i, n in enumerate(parent)], "__order")}
    all_types = {"parent": types}
    index = {n: i for i, n in enumerate(parent)}
    carried = sorted({index[r["parent_value"]] for c in children.values() for r in c.values() if "parent_value" in r})
    rows = valid.join(groups.select(*[f"__g{j}" for j in range(len(group_by))], "__order", *[f"__p{i}" for i in carried]), on)
    for name, columns in children.items():
        picks = []
        for c, rule in columns.items():
            kind = single_rule(rule, CHILD_RULES)
            picks.append((F.col(f"`{rule[kind]}`") if kind == "source" else F.col(f"__p{index[rule[kind]]}")).alias(c))
            all_types.setdefault(name, {})[c] = typed[rule[kind]].type if kind == "source" else types[rule[kind]]
        outputs[name] = rows.select(*picks, "__order", ROW)
    return JobPlan(outputs, _union(bad, spark, ERRORS), no_rows(spark, SKIPPED), all_types)
