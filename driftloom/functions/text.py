"""Text of typed values as Python prints them, blanks, and trimming of all white space."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What str.strip() removes.
SPACE = "\\x09-\\x0D\\x1C-\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


@dataclass(frozen=True)
class Typed:
    """A column with its declared type: string, integer, decimal, boolean, date, or null for a constant of no type."""

    col: Column
    type: str


SPARK_TYPES = {"string": "string", "integer": "bigint", "decimal": "double", "boolean": "boolean", "date": "timestamp_ntz", "null": "string"}


def declared_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "decimal"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "null" if isinstance(kind, T.NullType) else "string"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(value: Typed) -> Column:
    """Null, or a string of white space only."""
    null = value.col.isNull()
    return null | F.coalesce(strip(value.col) == "", F.lit(False)) if value.type == "string" else null


def _float_text(col: Column) -> Column:
    """repr() of a double: plain digits from 1e-4 to below 1e16, else with an exponent of two digits at least."""
    raw = col.cast("string")
    # 17 digits before the point and 21 behind hold every double of that range digit by digit.
    digits = F.regexp_replace(raw.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    plain = F.regexp_replace(digits, r"\.$", ".0")
    power = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\.0E", "E"), r"E(-?)(\d)$", "E$10$2"), r"E(\d)", "e+$1")
    odd = F.lower(F.replace(F.replace(raw, F.lit("Infinity"), F.lit("inf")), F.lit("E"), F.lit("e")))
    return F.when(~raw.rlike("[EIN]"), raw).when(F.abs(col).between(1e-4, 9999999999999998.0), plain).when(raw.contains("E"), F.replace(power, F.lit("E"), F.lit("e"))).otherwise(odd)


def python_text(value: Typed, iso: bool = False) -> Column:
    """str() of a value; null stays null. Dates without a time of day show the date alone unless ``iso``."""
    c = value.col
    if value.type == "boolean":
        return F.when(c, "True").when(~c, "False")
    if value.type == "decimal":
        return F.when(c.isNotNull(), _float_text(c.cast("double")))
    if value.type == "date":
        stamp = c.cast("timestamp_ntz")
        micros = F.date_format(stamp, "SSSSSS")
        time = F.concat(F.date_format(stamp, "HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))
        day = F.date_format(stamp, "yyyy-MM-dd")
        full = F.concat(day, F.lit("T" if iso else " "), time)
        return full if iso else F.when(time == "00:00:00", day).otherwise(full)
    return c.cast("string")


def python_repr(value: Typed) -> Column:
    """repr() of a value, for messages."""
    text = python_text(value)
    quoted = F.concat(F.lit("'"), text, F.lit("'")) if value.type in ("string", "date") else text
    return F.coalesce(quoted, F.lit("None"))


def literal(value) -> Typed:
    """A configuration scalar as a typed constant."""
    if value is None:
        return Typed(F.lit(None).cast("string"), "null")
    if isinstance(value, bool):
        return Typed(F.lit(value), "boolean")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), "integer") if abs(value) < 1 << 63 else Typed(F.lit(float(value)), "decimal")
    if isinstance(value, float):
        return Typed(F.lit(value), "decimal")
    if hasattr(value, "isoformat"):
        return Typed(F.lit(value.isoformat()).cast("timestamp_ntz"), "date")
    return Typed(F.lit(str(value)), "string")


def unify(values: list[Typed]) -> tuple[list[Column], str]:
    """Columns of one common type: their own if they agree, double for numbers, else Python text."""
    kinds = {v.type for v in values if v.type != "null"}
    if len(kinds) <= 1:
        kind = next(iter(kinds), "string")
        return [v.col.cast(SPARK_TYPES[kind]) for v in values], kind
    if kinds == {"integer", "decimal"}:
        return [v.col.cast("double") for v in values], "decimal"
    return [python_text(v) for v in values], "string"
