"""Run-level checks: boolean expressions over the counts of a run, evaluated on the driver."""

from __future__ import annotations

import ast
import operator

#: The names a check may use.
SCALARS = ("input_rows", "output_rows", "error_rows", "skipped_rows")
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg, ast.Not: operator.not_}


class CheckError(ValueError):
    pass


def _value(node: ast.AST, counts: dict[str, int]):
    if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float)):
        return node.value
    if isinstance(node, ast.Name):
        if node.id not in counts:
            raise CheckError(f"unknown name: {node.id}")
        return counts[node.id]
    if isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
        return _UNARY[type(node.op)](_value(node.operand, counts))
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        return _BINARY[type(node.op)](_value(node.left, counts), _value(node.right, counts))
    if isinstance(node, ast.BoolOp):
        values = [bool(_value(x, counts)) for x in node.values]
        return all(values) if isinstance(node.op, ast.And) else any(values)
    if isinstance(node, ast.Compare):
        values = [_value(x, counts) for x in (node.left, *node.comparators)]
        if any(type(op) not in _COMPARE for op in node.ops):
            raise CheckError("unsupported comparison")
        return all(_COMPARE[type(op)](a, b) for op, a, b in zip(node.ops, values[:-1], values[1:], strict=True))
    raise CheckError(f"unsupported syntax: {type(node).__name__}")


def evaluate_check(rule: str, counts: dict[str, int]) -> bool:
    try:
        tree = ast.parse(rule.strip(), mode="eval")
    except (SyntaxError, ValueError, MemoryError):
        raise CheckError(f"invalid check: {rule}") from None
    try:
        return bool(_value(tree.body, counts))
    except ZeroDivisionError:
        raise CheckError(f"division by zero: {rule}") from None
