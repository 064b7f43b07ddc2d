import pytest

from driftloom.operators import jobs, profile
from driftloom.operators.order import ranked
from driftloom.sources.scan import ROW, Loaded

from .helpers import frame


def loaded(spark, schema, data):
    kinds = {"string": "string", "long": "integer", "double": "decimal", "timestamp_ntz": "date", "boolean": "boolean"}
    return Loaded(frame(spark, schema, data), {p.split()[0]: kinds[p.split()[1]] for p in schema.split(", ")})


def rows(df, *order):
    return [tuple(r[c] for c in df.columns if not c.startswith("__")) for r in df.orderBy(*order).collect()]


def bad(plan):
    return sorted((e["input_name"], e["row_number"], e["field"], e["rule"]) for e in plan.errors.collect())


def test_merge_reducers(spark):
    a = loaded(spark, "id string, name string, n long, t string", [("1", None, 5, "x"), ("2", "b", None, "7"), ("3", "c", 1, None)])
    b = loaded(spark, "k string, name string, n double", [("2", "B", 2.5), ("1", "A", 4.0)])
    rules = {"id": {"source": "a.id"}, "first": {"first": ["a.name", "b.name"]}, "last": {"last": ["a.name", "b.name"]}, "sum": {"sum": ["a.n", "b.n"]}, "min": {"min": ["a.n", "b.n"]}, "max": {"max": ["a.n", "b.n", "a.t"]}, "count": {"count": ["a.name", "b.name"]}}
    plan = jobs.merge({"a": a, "b": b}, {"a": ["id"], "b": ["k"]}, "a", rules)
    assert rows(plan.outputs["output"], ROW) == [("1", "A", "A", 9.0, 4.0, 5.0, 1), ("2", "b", "B", 2.5, 2.5, 7.0, 2), ("3", "c", "c", 1.0, 1.0, 1.0, 1)]
    assert bad(plan) == []
    inner = jobs.merge({"a": a, "b": b}, {"a": ["id"], "b": ["k"]}, "a", {"id": {"source": "a.id"}}, "inner")
    assert rows(inner.outputs["output"], ROW) == [("1",), ("2",)] and [(s["row_number"], s["reason"]) for s in inner.skipped.collect()] == [(3, "No merge match in b")]


def test_merge_key_errors(spark):
    a = loaded(spark, "id string", [("1",), (None,), ("1",), (None,), ("  ",)])
    b = loaded(spark, "id string", [("1",), ("2",)])
    plan = jobs.merge({"a": a, "b": b}, {"a": ["id"], "b": ["id"]}, "a", {"id": {"source": "a.id"}})
    assert bad(plan) == [("a", 1, "id", "duplicate_key"), ("a", 2, "id", "duplicate_key"), ("a", 2, "id", "missing_key"), ("a", 3, "id", "duplicate_key"), ("a", 4, "id", "duplicate_key"), ("a", 4, "id", "missing_key")]


def test_union(spark):
    a = loaded(spark, "id string, v long", [("1", 1), ("2", 2), ("2", 3)])
    b = loaded(spark, "id string, v long", [("1", 4), (" ", 5), ("4", 6)])
    plan = jobs.union({"a": a, "b": b}, ["id"], ["id", "v"])
    assert bad(plan) == [("a", 1, "id", "duplicate_key"), ("a", 2, "id", "duplicate_key"), ("a", 3, "id", "duplicate_key"), ("b", 1, "id", "duplicate_key"), ("b", 2, "id", "missing_key")]
    fine = jobs.union({"a": loaded(spark, "id string", [("1",), ("3",)]), "b": loaded(spark, "id string", [("2",)])}, ["id"], ["id"])
    assert rows(fine.outputs["output"], "__input_order", ROW) == [("1",), ("3",), ("2",)] and bad(fine) == []
    with pytest.raises(ValueError, match="exactly"):
        jobs.union({"a": a, "b": loaded(spark, "v long, id string", [(1, "1")])}, ["id"], ["id", "v"])


def test_unpivot(spark):
    s = loaded(spark, "id string, a long, b string", [("x", 1, "p"), ("y", None, " "), ("z", 3, None)])
    every = jobs.unpivot(s, ["id"], "name", "value", {"a": "A", "b": 2})
    assert rows(every.outputs["output"], ROW, "__at") == [("x", "A", "1"), ("x", "2", "p"), ("y", "A", None), ("y", "2", " "), ("z", "A", "3"), ("z", "2", None)]
    full = jobs.unpivot(s, ["id"], "name", "value", {"a": "A", "b": 2}, True)
    assert rows(full.outputs["output"], ROW, "__at") == [("x", "A", "1"), ("x", "2", "p"), ("z", "A", "3")]


def test_aggregate(spark):
    s = loaded(spark, "g string, n long, t string, v string", [("b", 1, "5", None), ("a", 2, "x", "p"), ("b", None, "6", "q"), ("b", 4, None, "r"), (" ", 9, "1", "s")])
    rules = {"g": {"group_key": "g"}, "sum": {"sum": "n"}, "all": {"count": None}, "n": {"count": "n"}, "lo": {"min": "n"}, "hi": {"max": "n"}, "first": {"first": "v"}, "last": {"last": "v"}}
    plan = jobs.aggregate(s, ["g"], rules)
    assert rows(plan.outputs["output"], "__order") == [("b", 5, 3, 2, 1, 4, "q", "r"), ("a", 2, 1, 1, 2, 2, "p", "p")]
    assert bad(plan) == [("input", 5, "g", "missing_group_key")]
    texts = jobs.aggregate(s, ["g"], {"g": {"group_key": "g"}, "t": {"sum": "t"}})
    assert bad(texts) == [("input", 2, "t", "sum"), ("input", 5, "g", "missing_group_key")]
    none = jobs.aggregate(loaded(spark, "g string, n long", [("a", None)]), ["g"], {"g": {"group_key": "g"}, "s": {"sum": "n"}, "lo": {"min": "n"}})
    assert rows(none.outputs["output"], "__order") == [("a", 0, None)]


def test_match(spark):
    s = loaded(spark, "id string, k string, l long", [("1", "x", 1), ("2", "y", 1), ("3", "x", 1), ("4", "z", 2), ("5", "", 2)])
    plan = jobs.match(s, ["k", "l"], "no", ["id", "no"])
    assert rows(plan.outputs["output"], ROW) == [("1", "GROUP000001"), ("2", "GROUP000002"), ("3", "GROUP000001"), ("4", "GROUP000003")]
    assert bad(plan) == [("input", 5, "k, l", "missing_match_key")]
    shown = jobs.match(s, ["k", "l"], "no", ["id", "no"], "G", 1, False)
    assert rows(shown.outputs["output"], ROW) == [("1", "G1"), ("2", None), ("3", "G1"), ("4", None)]


def test_numbers_beyond_the_padding(spark):
    s = loaded(spark, "k string", [(str(i),) for i in range(12)])
    got = rows(jobs.match(s, ["k"], "no", ["no"], "", 1).outputs["output"], ROW)
    assert [g[0] for g in got] == [str(i) for i in range(1, 13)]


def test_consolidate(spark):
    s = loaded(spark, "g string, a string, n long, note string", [("x", "p", 1, None), ("x", "p", 2, "n2"), ("y", "q", 3, "n3"), ("x", "p", 4, None)])
    parent = {"g": {"first": "g"}, "a": {"require_same": "a"}, "sum": {"sum": "n"}, "n": {"count": "note"}, "last": {"last": "note"}}
    plan = jobs.consolidate(s, ["g"], parent, {"lines": {"n": {"source": "n"}, "total": {"parent_value": "sum"}}})
    assert rows(plan.outputs["parent"], "__order") == [("x", "p", 7, 1, "n2"), ("y", "q", 3, 1, "n3")]
    assert rows(plan.outputs["lines"], "__order", ROW) == [(1, 7), (2, 7), (4, 7), (3, 3)] and bad(plan) == []
    odd = loaded(spark, "g string, a string, n long", [("x", "p", 1), ("x", "q", None), ("y", None, None), (None, "a", 1)])
    plan = jobs.consolidate(odd, ["g"], {"a": {"require_same": "a"}, "s": {"sum": "n"}}, {"c": {"g": {"source": "g"}}})
    assert bad(plan) == [("input", 1, "a", "require_same_conflict"), ("input", 1, "s", "invalid_sum_value"), ("input", 2, "a", "require_same_conflict"), ("input", 2, "s", "invalid_sum_value"), ("input", 4, "g", "missing_group_key")]
    assert rows(plan.outputs["parent"], "__order")[1] == (None, None)


def test_ranks_cross_blocks(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1 << 20, 3, (1 << 21) + 1, 7 << 20)], f"{ROW} long")
    assert sorted((r[ROW], r["n"]) for r in ranked(df, ROW, "n").collect()) == [(3, 1), (5, 2), (1 << 20, 3), ((1 << 21) + 1, 4), (7 << 20, 5)]


def test_profile(spark):
    s = loaded(spark, "t string, n long", [("a", 1), ("bb", None), ("a", 3), (None, 3), ("c", 8)])
    got = {r["field"]: r.asDict() for r in profile.column_metrics(s).collect()}
    assert got["t"]["unique_count"] == 3 and got["t"]["duplicate_count"] == 1 and got["t"]["missing_rate"] == 0.2 and (got["t"]["min_length"], got["t"]["max_length"]) == (1, 2)
    assert (got["n"]["min"], got["n"]["max"], got["n"]["mean"], got["n"]["unique_count"]) == (1.0, 8.0, 3.75, 3)
    assert [(r["value"], r["n"]) for r in profile.top_values(s).orderBy("rank").collect()] == [("a", 2), ("bb", 1), ("c", 1)]
    assert profile.sample_values(s) == {"t": ["a", "bb", "a"], "n": ["1", "3", "3"]}
