"""Names that expressions may use, and the pair of value and error that every compiled rule is."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import Typed

#: What a row error is made of.
ERROR = "struct<field:string,rule:string,message:string>"


class CompileError(ValueError):
    """A rule or expression that can't be compiled; at run time every row it applies to has this as its error."""


@dataclass
class Compiled:
    """A value, and the error (of type ERROR, null where there is none) that takes its place."""

    value: Typed
    error: Column | None = None


@dataclass
class Scope:
    """Fields of the input by name, and derived fields that are compiled already."""

    input_name: str
    fields: dict[str, Typed]
    derived: dict[str, Typed] = field(default_factory=dict)

    def find(self, reference: str) -> Typed:
        space, dot, name = reference.partition(".")
        if dot and space == self.input_name and name in self.fields:
            return self.fields[name]
        if dot and space == "derived" and name in self.derived:
            return self.derived[name]
        raise CompileError(f"field is not defined: {reference}")


def error(where: str, rule: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(where).alias("field"), F.lit(rule).alias("rule"), text.alias("message")).cast(ERROR)


def no_error() -> Column:
    return F.lit(None).cast(ERROR)


def is_reference(value) -> bool:
    """A string whose part before its first dot is an identifier stands for a field, not for itself."""
    return isinstance(value, str) and "." in value and value.partition(".")[0].isidentifier()
