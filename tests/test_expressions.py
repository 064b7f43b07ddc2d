import math

import pytest
from pyspark.sql import functions as F

from driftloom.expr.arithmetic import compile_expression
from driftloom.expr.checks import CheckError, evaluate_check
from driftloom.expr.conditions import compile_condition
from driftloom.expr.scope import CompileError, Scope
from driftloom.functions.text import Typed

from .helpers import frame

SCHEMA = "s string, n long, x double, b boolean, d timestamp_ntz"
TYPES = {"s": "string", "n": "integer", "x": "decimal", "b": "boolean", "d": "date"}


def scope():
    return Scope("u", {k: Typed(F.col(k), t) for k, t in TYPES.items()})


@pytest.fixture(scope="module")
def odd(spark):
    import datetime

    return frame(spark, SCHEMA, [("a", 1, 1.5, True, datetime.datetime(2024, 1, 2)), ("b", -7, -2.5, False, datetime.datetime(2023, 5, 6)), ("", 0, 0.0, None, None), (None, None, None, None, None)]).cache()


@pytest.mark.parametrize(("text", "wanted"), [
    ('u.s == "a"', [1, 0, 0, 0]), ('u.s != "a"', [0, 1, 1, 1]), ("u.n != 1", [0, 1, 1, 0]), ("u.x != 1.5", [0, 1, 1, 1]), ("u.b != true", [0, 1, 0, 0]), ("u.b == false", [0, 1, 0, 0]), ("u.n > 0", [1, 0, 0, 0]), ("u.n <= 0", [0, 1, 1, 0]), ("0 < u.n", [1, 0, 0, 0]),
    ('u.s in ["a", "b"]', [1, 1, 0, 0]), ('u.s not in ["a"]', [0, 1, 1, 0]), ("u.s is null", [0, 0, 0, 1]), ("u.s is not null", [1, 1, 1, 0]), ("u.s == null", [0, 0, 0, 1]), ("u.s != null", [1, 1, 1, 0]), ("u.s", [1, 1, 0, 0]), ("u.n", [1, 1, 0, 0]), ("u.b", [1, 0, 0, 0]), ("u.d", [1, 1, 0, 0]),
    ('u.n > 0 and u.s == "a" or u.x < 0', [1, 1, 0, 0]), ('(u.n == 1 or u.n == 0) and u.x >= 0', [1, 0, 1, 0]), ('u.d >= "2024-01-01"', [1, 0, 0, 0]), ("u.s == 5", [0, 0, 0, 0]), ("u.n == \"x\"", [0, 0, 0, 0]), ("u.n != \"x\"", [1, 1, 1, 0]), ("true", [1, 1, 1, 1]), ("1 < 2", [1, 1, 1, 1]), ("u.n == 1.0", [1, 0, 0, 0]),
])
def test_conditions(odd, text, wanted):
    holds, failed = compile_condition(text, scope())
    assert [int(r[0]) for r in odd.orderBy("__row_number").select(holds).collect()] == wanted and failed is None


def test_ordering_of_unlike_types_fails_where_a_value_is(odd):
    holds, failed = compile_condition("u.s > 5", scope())
    assert [tuple(r) for r in odd.orderBy("__row_number").select(holds, failed).collect()] == [(False, True)] * 3 + [(False, False)]


@pytest.mark.parametrize("text", ["u.n == -1", "u.n == u.x", "0 < u.n < 5", "not u.b", "u.n + 1 == 2", "len(u.s)", "u.q == 1", "v.n == 1", "u.n ==", "(u.n == 1", "u.s[0]", "name"])
def test_rejected_conditions(text):
    with pytest.raises(CompileError):
        compile_condition(text, scope())


@pytest.mark.parametrize("text", ["u.n + 2", "u.n - u.x", "u.n * u.n", "u.x / 2", "u.n // 2", "u.n % 3", "u.n // (0 - 2)", "u.n % (0 - 3)", "u.x // 2", "u.x % 2", "u.n ** 2", "u.x ** 2", "-u.n", "+u.x", "round(u.x)", "round(u.x, 1)", "abs(u.n)", "min(u.n, u.x)", "max(u.n, 3)", "(u.n + 1) * 2", "u.n ** (0 - 2) + 0.5"])
def test_arithmetic_is_pythons(odd, text):
    made = compile_expression(text, scope(), "c")
    got = odd.orderBy("__row_number").select(made.value.col.alias("v"), (made.error if made.error is not None else F.lit(None)).alias("e")).collect()
    for row, (n, x) in zip(got, [(1, 1.5), (-7, -2.5)], strict=False):
        class U:
            pass

        u = U()
        u.n, u.x = n, x
        wanted = eval(text, {"u": u, "round": round, "abs": abs, "min": min, "max": max})  # noqa: S307
        assert row["e"] is None and math.isclose(row["v"], wanted) and ("min(" in text or isinstance(row["v"], int) == isinstance(wanted, int))
    assert "missing value" in got[3]["e"]["message"] and "at row 4" in got[3]["e"]["message"]


@pytest.mark.parametrize(("text", "cause"), [("u.n / u.x", "ZeroDivisionError"), ("1 // u.n", "ZeroDivisionError"), ("1 % u.n", "ZeroDivisionError"), ("(u.n + 3037000499) ** 2", None), ("(u.n + 3037000500) ** 2", "OverflowError"), ("max(u.n + 1)", "TypeError"), ("(u.n + 9223372036854775807) * 2", "OverflowError"), ("u.s * u.s", "TypeError")])
def test_faults_are_row_errors(odd, text, cause):
    made = compile_expression(text, scope(), "c")
    third = odd.orderBy("__row_number").select(made.error.alias("e")).collect()[2]["e"]
    assert (third is None) == (cause is None) and (cause is None or cause in third["message"])


def test_texts_add_up(odd):
    made = compile_expression("u.s + u.s", scope(), "c")
    assert odd.orderBy("__row_number").select(made.value.col).first()[0] == "aa"


@pytest.mark.parametrize("text", ["u.n.real", "__import__('os')", "sum(u.n)", "round(u.n, ndigits=1)", "'a'", "u.n if u.b else 1", "u.n +", "[u.n]"])
def test_rejected_expressions(text):
    with pytest.raises(CompileError):
        compile_expression(text, scope(), "c")


def test_checks():
    counts = {"input_rows": 5, "output_rows": 3, "error_rows": 1, "skipped_rows": 1}
    assert evaluate_check("input_rows == output_rows + error_rows + skipped_rows", counts) and evaluate_check("0 < output_rows <= 3 and not error_rows > 1", counts)
    for bad in ("rows == 1", "len(input_rows)", "input_rows /", "input_rows / (error_rows - 1) > 0", "'a' == 'a'"):
        with pytest.raises(CheckError):
            evaluate_check(bad, counts)
