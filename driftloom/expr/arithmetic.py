"""Arithmetic expressions over fields, compiled to a value and an error column.

Operators + - * / // % **, unary + and -, parentheses, and round, abs, min, max, with Python's results: true and floor
division, the divisor's sign for %, half-even rounding. A missing operand, a zero divisor or an overflow is the row's error.
"""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import Typed, literal, python_repr
from .scope import Compiled, CompileError, Scope, error

_CALLS = ("round", "abs", "min", "max")


class _Compiler:
    def __init__(self, text: str, scope: Scope, where: str):
        self.text, self.scope, self.where = text, scope, where
        self.used: dict[str, Typed] = {}
        #: (condition, cause) in order of evaluation.
        self.faults: list[tuple[Column, str]] = []

    def fail(self, why: str) -> CompileError:
        return CompileError(f"{self.where}: {why}: {self.text}")

    def numbers(self, *values: Typed) -> str:
        for v in values:
            if v.type not in ("integer", "decimal", "boolean"):
                raise _Unlike(f"TypeError: unsupported operand type: {v.type}")
        return "integer" if all(v.type != "decimal" for v in values) else "decimal"

    def checked(self, value: Column, kind: str, cause: str = "OverflowError: result too large") -> Typed:
        self.faults.append((value.isNull(), cause))
        return Typed(value, kind)

    def visit(self, node: ast.expr) -> Typed:
        if isinstance(node, ast.Constant):
            if node.value is None or isinstance(node.value, (bool, int, float)):
                return literal(node.value)
            raise self.fail("unsupported literal")
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            name = f"{node.value.id}.{node.attr}"
            return self.used.setdefault(name, self.scope.find(name))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            v = self.visit(node.operand)
            kind = self.numbers(v)
            c = v.col.cast("bigint") if v.type == "boolean" else v.col
            return Typed(c, kind) if isinstance(node.op, ast.UAdd) else self.checked(F.try_subtract(F.lit(0).cast("bigint"), c), "integer") if kind == "integer" else Typed(-c, kind)
        if isinstance(node, ast.BinOp):
            power = node.right.value if isinstance(node.right, ast.Constant) else None
            return self.binary(node.op, self.visit(node.left), self.visit(node.right), power if type(power) is int and power >= 0 else None)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            return self.call(node.func.id, [self.visit(x) for x in node.args])
        raise self.fail("unsupported expression")

    def binary(self, op: ast.operator, a: Typed, b: Typed, power: int | None) -> Typed:
        if isinstance(op, ast.Add) and a.type == b.type == "string":
            return Typed(F.concat(a.col, b.col), "string")
        kind = self.numbers(a, b)
        spark = "bigint" if kind == "integer" else "double"
        x, y = a.col.cast(spark), b.col.cast(spark)
        if isinstance(op, (ast.Add, ast.Sub, ast.Mult)):
            if kind == "decimal":
                return Typed({ast.Add: x + y, ast.Sub: x - y, ast.Mult: x * y}[type(op)], kind)
            return self.checked({ast.Add: F.try_add, ast.Sub: F.try_subtract, ast.Mult: F.try_multiply}[type(op)](x, y), kind)
        if isinstance(op, (ast.Div, ast.FloorDiv, ast.Mod)):
            self.faults.append((y == 0, "ZeroDivisionError: division by zero"))
            safe = F.when(y != 0, y)
            if isinstance(op, ast.Div):
                return Typed(x.cast("double") / safe.cast("double"), "decimal")
            if kind == "integer":
                rest = x % safe
                off = (rest != 0) & ((rest < 0) != (safe < 0))
                if isinstance(op, ast.Mod):
                    return Typed(rest + F.when(off, safe).otherwise(F.lit(0).cast("bigint")), kind)
                return Typed(F.call_function("div", x, safe) - F.when(off, 1).otherwise(0).cast("bigint"), kind)
            rest = x % safe
            rest = rest + F.when((rest != 0) & ((rest < 0) != (safe < 0)), safe).otherwise(0.0)
            return Typed(rest if isinstance(op, ast.Mod) else F.round((x - rest) / safe, 0), kind)
        if isinstance(op, ast.Pow):
            raised = F.pow(x.cast("double"), y.cast("double"))
            self.faults.append((F.coalesce((x == 0) & (y < 0), F.lit(False)), "ZeroDivisionError: 0 cannot be raised to a negative power"))
            if kind == "decimal":
                self.faults.append((F.isnan(raised), "ValueError: the power is not a real number"))
                return Typed(raised, kind)
            if power is not None and power <= 16:  # whole bases stay whole, digit by digit
                product = F.lit(1).cast("bigint")
                for _ in range(power):
                    product = F.try_multiply(product, x)
                return self.checked(product, kind)
            if power is not None:  # a double knows whole numbers below 2 ** 53
                return self.checked(F.when(F.abs(raised) < float(1 << 53), raised.cast("bigint")), kind)
            return Typed(raised, "decimal")
        raise self.fail("unsupported operator")

    def call(self, name: str, args: list[Typed]) -> Typed:
        if not args or (name == "abs" and len(args) != 1) or (name == "round" and len(args) > 2):
            raise self.fail("wrong number of arguments")
        kind = self.numbers(*args)
        if name in ("min", "max"):
            if len(args) == 1:
                raise _Unlike(f"TypeError: {name} of a single number")
            cols = [x.col.cast("bigint" if kind == "integer" else "double") for x in args]
            return Typed((F.least if name == "min" else F.greatest)(*cols), kind)
        x = args[0]
        if name == "abs":
            return Typed(F.abs(x.col.cast("bigint") if x.type == "boolean" else x.col), kind)
        if x.type != "decimal":
            return Typed(x.col.cast("bigint"), "integer")
        if len(args) == 1:
            return self.checked(F.bround(x.col, 0).try_cast("bigint"), "integer")
        return Typed(F.call_function("bround", x.col, args[1].col.cast("int")), "decimal")


class _Unlike(Exception):
    """Operand types that fail in every row which has values."""


def compile_expression(text: str, scope: Scope, where: str) -> Compiled:
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except (SyntaxError, ValueError, MemoryError):
        raise CompileError(f"{where}: invalid expression: {text}") from None
    compiler = _Compiler(text, scope, where)
    unlike = None
    try:
        value = compiler.visit(tree.body)
    except _Unlike as e:
        unlike, value = str(e), Typed(F.lit(None).cast("double"), "decimal")
        for node in ast.walk(tree):
            if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
                compiler.used.setdefault(f"{node.value.id}.{node.attr}", scope.find(f"{node.value.id}.{node.attr}"))
    row = F.col("__row_number").cast("string")
    # Numbers are shown as Spark prints them: this text is part of every row's code, though few rows need it.
    seen = lambda v: F.coalesce(v.col.cast("string"), F.lit("None")) if v.type == "decimal" else python_repr(v)
    shown = F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), seen(v), F.lit(f" ({v.type})")) for n, v in compiler.used.items()])
    # One message of each kind, so that the plan grows with the operands and faults but not with their product.
    missing = [F.when(v.col.isNull(), n) for n, v in compiler.used.items()]
    causes = [F.when(F.coalesce(c, F.lit(False)), cause) for c, cause in compiler.faults] + ([F.lit(unlike)] if unlike else [])
    parts = []
    if missing:
        name = F.coalesce(*missing) if len(missing) > 1 else missing[0]
        parts.append(F.when(name.isNotNull(), error(where, "expression", F.concat(F.lit(f"{where}: expression field has missing value: "), name, F.lit(" at row "), row))))
    if causes:
        cause = F.coalesce(*causes) if len(causes) > 1 else causes[0]
        text = F.concat(F.lit(f"{where}: expression evaluation failed at row "), row, F.lit(f": {text}; values: "), shown, F.lit("; cause: "), cause)
        parts.append(F.when(cause.isNotNull(), error(where, "expression", text)))
    bad = F.coalesce(*parts) if len(parts) > 1 else parts[0] if parts else None
    return Compiled(value, bad)
