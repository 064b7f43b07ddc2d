"""Row validations: an array with every failure of a row, in the order of the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..expr.scope import ERROR, error
from ..functions.casts import number
from ..functions.text import Typed, is_blank, literal, python_repr, python_text
from ..sources.scan import Loaded
from .mapping import BROADCAST_ROWS


def _numeric(value: Typed) -> Column:
    if value.type == "string":
        return number(value.col)
    return value.col.cast("double") if value.type in ("integer", "decimal") else F.lit(None).cast("double")


def _python_pattern(pattern: str) -> str:
    """The common part of both dialects; named groups are written differently."""
    return pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")


def _failure(rule, value: Typed) -> Column:
    """The message of a failed rule other than required and referential_integrity, null where it holds."""
    shown = python_repr(value)
    if rule.rule == "enum":
        options = [literal(v) for v in rule.values]
        like = [o for o in options if o.type == value.type or {o.type, value.type} <= {"integer", "decimal", "boolean"}]
        same = F.lit(False)
        for o in like:
            same = same | (value.col.cast("double") == o.col.cast("double") if value.type != "string" and value.type != "date" else value.col == o.col)
        return F.when(~same, F.concat(F.lit("value is not in enum: "), shown))
    if rule.rule in ("min", "max"):
        n, bound = _numeric(value), F.lit(float(rule.value))
        beyond = n < bound if rule.rule == "min" else n > bound
        word = "less than min" if rule.rule == "min" else "greater than max"
        return F.when(n.isNull(), F.concat(F.lit("value is not numeric: "), shown)).when(beyond, F.concat(F.lit(f"value is {word} {rule.value}: "), shown))
    if rule.rule == "regex":
        return F.when(~python_text(value).rlike(rf"\A(?:{_python_pattern(rule.pattern)})\z"), F.concat(F.lit("value does not match regex: "), shown))
    size = F.char_length(python_text(value))
    out = F.lit(None).cast("string")
    if rule.max is not None:
        out = F.when(size > rule.max, F.concat(F.lit(f"length is greater than max {rule.max}: "), shown))
    if rule.min is not None:
        short = F.concat(F.lit(f"length is less than min {rule.min}: "), shown)
        out = F.when(size < rule.min, short).otherwise(out)
    return out


def validate(df: DataFrame, rules: list, fields: dict[str, Typed], names: dict[int, str], references: dict[str, Loaded], target: str) -> DataFrame:
    """df with ``target``: an array of ERROR structs. fields: by column name; names: each rule's (column), by index."""
    found = []
    for i, rule in enumerate(rules):
        value = fields[names[i]]
        blank = is_blank(value)
        if rule.rule == "required":
            found.append(F.when(blank, error(rule.field, rule.rule, "value is required")))
            continue
        if rule.rule == "referential_integrity":
            loaded = references[rule.reference]
            key = f"__known_{target}_{i}"
            alike = loaded.types[rule.reference_key] == value.type or {loaded.types[rule.reference_key], value.type} <= {"integer", "decimal"}
            if alike:
                known = loaded.df.select(F.col(f"`{rule.reference_key}`").alias(key)).where(F.col(key).isNotNull()).distinct()
                small = loaded.df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
                df = df.join(F.broadcast(known) if small else known, value.col == F.col(key), "left")
            message = F.concat(F.lit(f"value is not found in {rule.reference}.{rule.reference_key}: "), python_repr(value))
            bad = F.when(F.col(key).isNull(), message) if alike else message
        else:
            bad = _failure(rule, value)
        found.append(F.when(~blank & bad.isNotNull(), error(rule.field, rule.rule, bad)))
    array = F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{ERROR}>")
    helpers = [c for c in df.columns if c.startswith(f"__known_{target}_")]
    return df.withColumn(target, array).drop(*helpers)
