import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftloom.functions.casts import cast, java_format
from driftloom.functions.normalize import normalize
from driftloom.functions.text import Typed, python_text, strip


def one(spark, value, kind, make):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(make(F.col("x"))).first()[0]


@pytest.mark.parametrize("value", [0.0, -0.0, 1.0, 1.5, 1e7, 12345678.9, 1e15, 1e16, 1.234e16, 1.5e300, 1e-3, 1e-4, 0.00012345678901234567, 1e-5, -3.25e-10, float("inf"), float("nan"), 0.1])
def test_floats_print_like_python(spark, value):
    assert one(spark, value, "double", lambda c: python_text(Typed(c, "decimal"))) == repr(value)


def test_many_floats_print_like_python(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.floats(allow_nan=False, allow_infinity=False).filter(lambda x: abs(x) > 1e-300 or x == 0), min_size=300, max_size=300))
    def check(xs):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
        got = {r["i"]: r["t"] for r in df.select("i", python_text(Typed(F.col("x"), "decimal")).alias("t")).collect()}
        assert all(float(got[i]) == x for i, x in enumerate(xs))

    check()


@pytest.mark.parametrize("text", ["  a ", "\t\na\r", "　山田　", "\xa0x\x85", "\x1cy\x1f", "", "a b", " z "])
def test_strip_is_pythons(spark, text):
    assert one(spark, text, "string", strip) == text.strip()


@pytest.mark.parametrize(("names", "text", "wanted"), [(["trim", "remove_commas"], " 1,234 ", "1234"), (["remove_currency_symbol"], "¥￥$5", "5"), (["zenkaku_to_hankaku"], "ＡＢＣ１２３", "ABC123"), (["zenkaku_to_hankaku"], "ｱｲｳ", "アイウ"), (["zenkaku_to_hankaku", "remove_currency_symbol", "remove_commas"], "￥１２，３４５", "12345"), (["trim"], None, None)])
def test_normalizers(spark, names, text, wanted):
    assert one(spark, text, "string", lambda c: normalize(c, names)) == wanted


@pytest.mark.parametrize(("kind", "text", "value", "failed"), [
    ("integer", "12", 12, False), ("integer", " -3 ", -3, False), ("integer", "1.5", None, True), ("integer", "x", None, True), ("integer", "9223372036854775807", 9223372036854775807, False), ("integer", "12.0", 12, False), ("decimal", "1e3", 1000.0, False), ("decimal", "1d", None, True), ("decimal", None, None, False), ("decimal", ".5", 0.5, False),
    ("boolean", "yes", True, False), ("boolean", "Yes", None, True), ("boolean", "0", False, False), ("string", "", "", False),
])
def test_casts(spark, kind, text, value, failed):
    df = spark.createDataFrame([(text,)], "x string")
    typed, bad = cast(F.col("x"), kind)
    assert tuple(df.select(typed.col, bad).first()) == (value, failed)


@pytest.mark.parametrize(("text", "pattern", "wanted"), [("20240105", "%Y%m%d", "2024-01-05"), ("2024/1/5", "%Y/%m/%d", "2024-01-05"), ("2024-01-05", None, "2024-01-05"), ("2024/02/03", None, "2024-02-03"), ("13/02/2024", None, "2024-02-13"), ("01/02/2024", None, "2024-01-02"), ("2024-13-01", "%Y-%m-%d", None), ("", "%Y%m%d", None), ("2024-01-05 10:11:12", None, "2024-01-05 10:11:12"), ("5 Jan 2024", "%d %b %Y", "2024-01-05")])
def test_dates(spark, text, pattern, wanted):
    df = spark.createDataFrame([(text,)], "x string")
    typed, _ = cast(F.col("x"), "date", pattern)
    assert df.select(python_text(typed)).first()[0] == wanted


def test_unknown_directive():
    with pytest.raises(ValueError, match="%Q"):
        java_format("%Q")
