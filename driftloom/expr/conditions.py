"""Conditions of filters and ``when`` rules, compiled to Spark columns.

The grammar is a part of Python's: comparisons of a field with literals (==, !=, <, <=, >, >=, in, not in, is null, is
not null), a bare field for its truth, ``and``, ``or`` and parentheses; true, false and null in lower case. A comparison never
gives null: each leaf says what a missing value counts as, so that ``and`` and ``or`` are plain logic.
"""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.casts import parse_date
from ..functions.text import Typed, literal
from .scope import CompileError, Scope

_NAMED = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
_FLIPPED = {ast.Lt: ast.Gt, ast.LtE: ast.GtE, ast.Gt: ast.Lt, ast.GtE: ast.LtE}
_NUMERIC = ("integer", "decimal")


class _Compiler:
    def __init__(self, text: str, scope: Scope):
        self.text, self.scope = text, scope
        #: Rows for which an ordering of unlike types would be taken, if their value is there.
        self.bad: list[Column] = []

    def reject(self) -> CompileError:
        return CompileError(f"Unsupported condition expression: {self.text}")

    def operand(self, node: ast.expr) -> tuple[str, object]:
        """("literal", value) or ("field", Typed)."""
        if isinstance(node, ast.Constant) and not isinstance(node.value, (bytes, complex, type(...))):
            return "literal", node.value
        if isinstance(node, ast.Name) and node.id in _NAMED:
            return "literal", _NAMED[node.id]
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            return "field", self.scope.find(f"{node.value.id}.{node.attr}")
        raise self.reject()

    def truth(self, node: ast.expr) -> Column:
        if isinstance(node, ast.BoolOp):
            parts = [self.truth(x) for x in node.values]
            return reduce((lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b), parts)
        if isinstance(node, ast.Compare):
            if len(node.ops) != 1:
                raise self.reject()
            return self.compare(node.left, node.ops[0], node.comparators[0])
        kind, value = self.operand(node)
        return F.lit(bool(value)) if kind == "literal" else self.holds(value)

    @staticmethod
    def holds(value: Typed) -> Column:
        by_type = {"boolean": value.col, "integer": value.col != 0, "decimal": value.col != 0, "string": F.length(value.col) > 0, "date": value.col.isNotNull()}
        return F.coalesce(by_type.get(value.type, F.lit(False)), F.lit(False))

    def compare(self, left: ast.expr, op: ast.cmpop, right: ast.expr) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            return self.member(left, right, isinstance(op, ast.NotIn))
        (a_kind, a), (b_kind, b) = self.operand(left), self.operand(right)
        if a_kind == b_kind == "field":
            raise self.reject()
        if a_kind == b_kind == "literal":
            return F.lit(self.constants(a, op, b))
        if a_kind == "literal":
            a, b, op = b, a, _FLIPPED.get(type(op), type(op))()
        if isinstance(op, (ast.Is, ast.IsNot)) and b is not None:
            raise self.reject()
        if b is None:
            if isinstance(op, (ast.Is, ast.Eq)):
                return a.col.isNull()
            if isinstance(op, (ast.IsNot, ast.NotEq)):
                return a.col.isNotNull()
            return F.lit(False)
        return self.leaf(a, op, b)

    def constants(self, a, op: ast.cmpop, b) -> bool:
        if isinstance(op, (ast.Is, ast.IsNot)):
            return (a is b) == isinstance(op, ast.Is)
        if isinstance(op, (ast.Eq, ast.NotEq)):
            return (a == b) == isinstance(op, ast.Eq)
        try:
            return {ast.Lt: lambda: a < b, ast.LtE: lambda: a <= b, ast.Gt: lambda: a > b, ast.GtE: lambda: a >= b}[type(op)]()
        except (TypeError, KeyError):
            raise self.reject() from None

    def comparable(self, field: Typed, value) -> tuple[Column, Column] | None:
        """Both sides in one type, or None if these types are never equal."""
        constant = literal(value)
        if field.type == "date" and constant.type == "string":
            return field.col, parse_date(constant.col, None)
        if field.type == constant.type == "string" or field.type == constant.type == "date":
            return field.col, constant.col
        as_number = {"integer": "bigint", "decimal": "double", "boolean": "bigint"}
        if field.type in as_number and constant.type in as_number:
            if "decimal" in (field.type, constant.type):
                return field.col.cast("double"), constant.col.cast("double")
            return field.col.cast("bigint"), constant.col.cast("bigint")
        return None

    def leaf(self, field: Typed, op: ast.cmpop, value) -> Column:
        sides = self.comparable(field, value)
        # A missing value differs from anything in string, decimal and date fields, but not in integer and boolean ones.
        missing_differs = field.type not in ("integer", "boolean")
        if isinstance(op, ast.Eq):
            return F.lit(False) if sides is None else F.coalesce(sides[0] == sides[1], F.lit(False))
        if isinstance(op, ast.NotEq):
            if sides is None:
                return F.lit(True) if missing_differs else field.col.isNotNull()
            return F.coalesce(sides[0] != sides[1], F.lit(missing_differs))
        if sides is None:
            self.bad.append(field.col.isNotNull())
            return F.lit(False)
        a, b = sides
        ordered = {ast.Lt: lambda: a < b, ast.LtE: lambda: a <= b, ast.Gt: lambda: a > b, ast.GtE: lambda: a >= b}.get(type(op))
        if ordered is None:
            raise self.reject()
        return F.coalesce(ordered(), F.lit(False))

    def member(self, left: ast.expr, right: ast.expr, negated: bool) -> Column:
        kind, value = self.operand(left)
        if not isinstance(right, (ast.List, ast.Tuple)):
            raise self.reject()
        items = [self.operand(x) for x in right.elts]
        if any(k == "field" for k, _ in items):
            raise self.reject()
        if kind == "literal":
            return F.lit((value in [v for _, v in items]) != negated)
        found = reduce(lambda a, b: a | b, [self.leaf(value, ast.Eq(), v) for _, v in items if v is not None], F.lit(False))
        return value.col.isNotNull() & ~found if negated else found


def compile_condition(text: str, scope: Scope) -> tuple[Column, Column | None]:
    """(holds, failed): a boolean that is never null, and where the condition can't be evaluated (None: nowhere)."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError, MemoryError):
        raise CompileError(f"Invalid condition expression: {text}") from None
    compiler = _Compiler(text, scope)
    holds = compiler.truth(tree.body)
    return holds, reduce(lambda a, b: a | b, compiler.bad) if compiler.bad else None


def references(text: str) -> list[str]:
    """Field references in a condition or expression, in order; empty if it can't be parsed."""
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError, MemoryError):
        return []
    return [f"{n.value.id}.{n.attr}" for n in ast.walk(tree) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name)]
