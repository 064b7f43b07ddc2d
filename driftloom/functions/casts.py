"""Casts of raw text to the five declared types; a value that doesn't cast becomes null beside a failure flag."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Typed, strip

# Texts accepted as booleans unless the schema names others.
TRUE_VALUES = ["true", "1", "yes", "y", "Y", "TRUE", "True"]
FALSE_VALUES = ["false", "0", "no", "n", "N", "FALSE", "False"]

#: Formats that a date without a declared one may have, tried in this order.
MIXED_DATES = (
    ("yyyy-M-d", r"\d{4}-\d{1,2}-\d{1,2}"), ("yyyy/M/d", r"\d{4}/\d{1,2}/\d{1,2}"), ("yyyyMMdd", r"\d{8}"), ("yyyy-M-d H:m:s", r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}"), ("yyyy-M-d'T'H:m:s", r"\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}"),
    ("yyyy-M-d H:m", r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}"), ("yyyy/M/d H:m:s", r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}"), ("M/d/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"), ("d/M/yyyy", r"\d{1,2}/\d{1,2}/\d{4}"), ("yyyy.M.d", r"\d{4}\.\d{1,2}\.\d{1,2}"),
    ("MMM d yyyy", r"[A-Za-z]{3} \d{1,2} \d{4}"), ("MMM d, yyyy", r"[A-Za-z]{3} \d{1,2}, \d{4}"), ("MMMM d, yyyy", r"[A-Za-z]{4,} \d{1,2}, \d{4}"), ("d MMM yyyy", r"\d{1,2} [A-Za-z]{3} \d{4}"),
)

_DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "M", "d": "d", "H": "H", "I": "h", "M": "m", "S": "s", "f": "SSSSSS", "b": "MMM", "B": "MMMM", "p": "a", "j": "D", "z": "xx", "%": "%"}
_PADDED = {"m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss"}


def java_format(pattern: str) -> str:
    """A strftime pattern as Spark writes it. Digits that touch must be padded; others may be short."""
    parts = re.findall(r"%(.)|([^%]+)", pattern)
    out = []
    for i, (code, text) in enumerate(parts):
        if text:
            out.append(re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", text.replace("'", "''")))
            continue
        if code not in _DIRECTIVES:
            raise ValueError(f"unsupported date format directive: %{code}")
        touching = (i and parts[i - 1][0]) or (i + 1 < len(parts) and parts[i + 1][0])
        out.append(_PADDED.get(code, _DIRECTIVES[code]) if touching else _DIRECTIVES[code])
    return "".join(out)


def parse_date(text: Column, pattern: str | None) -> Column:
    clean = strip(text)
    if pattern:
        return F.try_to_timestamp(clean, F.lit(java_format(pattern))).cast("timestamp_ntz")
    return F.coalesce(*[F.when(clean.rlike(f"^(?:{shape})$"), F.try_to_timestamp(clean, F.lit(fmt))) for fmt, shape in MIXED_DATES]).cast("timestamp_ntz")


_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """A double, or null where the text is no plain number."""
    clean = strip(text)
    return F.when(clean.rlike(_NUMBER), clean.try_cast("double")).when(F.lower(clean).isin("inf", "infinity", "+inf"), float("inf")).when(F.lower(clean).isin("-inf", "-infinity"), float("-inf"))


def cast(text: Column, kind: str, date_format: str | None = None, true_values: list[str] | None = None, false_values: list[str] | None = None) -> tuple[Typed, Column]:
    """(value, failed): failed where a text that isn't missing has no value of the type."""
    if kind == "string":
        return Typed(text, "string"), F.lit(False)
    if kind == "integer":
        clean = strip(text)
        value = F.coalesce(F.when(clean.rlike(r"^[+-]?\d+$"), clean.try_cast("bigint")), F.when(number(text) == F.floor(number(text)), number(text).try_cast("bigint")))
    elif kind == "decimal":
        value = number(text)
    elif kind == "boolean":
        value = F.when(text.isin(list(true_values or TRUE_VALUES)), True).when(text.isin(list(false_values or FALSE_VALUES)), False)
    elif kind == "date":
        text = F.when(strip(text) != "", text)
        value = parse_date(text, date_format)
    else:
        raise ValueError(f"unsupported type: {kind}")
    return Typed(value, kind), text.isNotNull() & value.isNull()


def integral(text: Column) -> Column:
    """Whether a decimal's text is a whole number: a column of such texts alone, none missing, prints without a point."""
    return F.coalesce(strip(text).rlike(r"^[+-]?\d{1,18}$"), F.lit(False))


def to_number(value: Typed) -> Column:
    """Numeric reading of any value, null where there is none: text is parsed, true is 1."""
    if value.type == "string":
        return number(value.col)
    if value.type == "boolean":
        return value.col.cast("bigint")
    return value.col if value.type in ("integer", "decimal") else F.lit(None).cast("double")
