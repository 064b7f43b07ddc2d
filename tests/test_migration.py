import hashlib

import pytest

from driftloom.config.models import ConfigError
from driftloom.plans.migration import compile_migration, run_migration

from .helpers import frame, migration, values

SCHEMA = {"id": {}, "status": {}, "amount": {"type": "decimal"}, "qty": {"type": "integer"}, "dept": {}}
DDL = "id string, status string, amount double, qty long, dept string"
DATA = [("u1", "A", 10.0, 2, "D1"), ("u2", "B", 250.5, 0, "D9"), ("u3", None, None, 3, "D2"), ("", "C", 5.0, 1, "D1")]


def run(spark, mappings, data=DATA, refs=None, dry_run=False, **parts):
    config = migration(SCHEMA, mappings, references={"depts": {"path": "d.csv", "key": "code"}} if refs else {}, **parts)
    frames = {"u": frame(spark, DDL, data)} | ({"depts": frame(spark, "code string, name string", refs)} if refs else {})
    return run_migration(spark, config, None, frames, dry_run=dry_run)


def errors(r):
    return sorted((e["row_number"], e["stage"], e["output_name"], e["field"], e["rule"]) for e in r.errors.collect())


def test_rules(spark):
    rules = {"id": {"source": "u.id"}, "c": {"value": 5}, "label": {"concat": {"values": ["u.id", "-", "u.qty", "/", "u.amount"]}}, "s": {"map": {"source": "u.status", "values": {"A": "active"}, "default": "other"}}, "w": {"when": [{"if": "u.qty > 1", "then": "many"}, {"if": "u.qty == 1", "then": "u.id"}], "default": None}}
    r = run(spark, rules)
    assert values(r.outputs["out"], *rules) == [("u1", 5, "u1-2/10.0", "active", "many"), ("u2", 5, "u2-0/250.5", "other", None), ("u3", 5, "u3-3/", None, "many"), ("", 5, "-1/5.0", "other", "")]
    assert r.status == "completed" and r.counts == {"input_rows": 4, "output_rows": 4, "error_rows": 0, "skipped_rows": 0}


def test_every_row_goes_one_way(spark):
    rules = {"id": {"source": "u.id"}, "dept": {"lookup": {"reference": "depts", "key": "u.dept", "value": "name"}}, "unit": {"expression": "u.amount / u.qty"}}
    parts = {"validations": {"input": [{"field": "u.id", "rule": "required"}]}, "filters": {"exclude": [{"if": "u.amount is null", "reason": "no amount"}]}, "checks": [{"name": "all", "rule": "input_rows == output_rows + error_rows + skipped_rows"}]}
    r = run(spark, rules, refs=[("D1", "One"), ("D2", "Two")], **parts)
    assert errors(r) == [(2, "mapping", "out", "lookup missing", "lookup_missing"), (4, "input_validation", None, "u.id", "required")]
    assert [(s["row_number"], s["reason"]) for s in r.skipped.collect()] == [(3, "no amount")]
    assert values(r.outputs["out"], "id", "dept", "unit") == [("u1", "One", 5.0)] and r.checks[0]["passed"]


@pytest.mark.parametrize(("policy", "wanted"), [("error", None), ("null", ["One", None, None, "One"]), ("empty", ["One", "", "", "One"]), ("default", ["One", "?", "?", "One"])])
def test_lookup_policies(spark, policy, wanted):
    rule = {"lookup": {"reference": "depts", "key": "u.dept", "value": "name", "on_missing": policy} | ({"default": "?"} if policy == "default" else {})}
    r = run(spark, {"d": rule}, refs=[("D1", "One")])
    if wanted is None:
        assert [e[0] for e in errors(r)] == [2, 3] and r.errors.orderBy("row_number").first()["message"] == "lookup missing: reference=depts key=D9"
    else:
        assert [v[0] for v in values(r.outputs["out"], "d")] == wanted


def test_lookup_of_other_types_never_matches(spark):
    r = run(spark, {"d": {"lookup": {"reference": "depts", "key": "u.qty", "value": "name", "on_missing": "null"}}}, refs=[("2", "Two")])
    assert {v[0] for v in values(r.outputs["out"], "d")} == {None}


def test_generate_id(spark):
    r = run(spark, {"k": {"generate_id": {"fields": ["u.id", "u.qty"], "prefix": "K-", "separator": "::", "length": 20}}})
    assert values(r.outputs["out"], "k")[0][0] == "K-" + hashlib.sha256(b"u1::2").hexdigest()[:20]
    assert errors(r) == [(4, "mapping", "out", "k", "generate_id")]


def test_derived_fields_come_before_filters(spark):
    parts = {"derived": {"b": {"expression": "derived.a * 2"}, "a": {"expression": "u.amount + 1"}}, "filters": {"include": [{"if": "derived.b > 20"}]}}
    r = run(spark, {"v": {"source": "derived.b"}}, **parts)
    assert values(r.outputs["out"], "v") == [(22.0,), (503.0,)]
    assert errors(r) == [(3, "mapping", None, "derived.a", "expression")]
    assert [(s["row_number"], s["reason"]) for s in r.skipped.collect()] == [(4, "No include condition matched")]


def test_a_cycle_is_an_error_of_every_row(spark):
    r = run(spark, {"v": {"source": "u.id"}}, derived={"a": {"source": "derived.b"}, "b": {"source": "derived.a"}})
    assert len(errors(r)) == 4 and r.counts["output_rows"] == 0


def test_all_failures_of_a_row_are_reported(spark):
    rules = [{"field": "u.status", "rule": "enum", "values": ["A", "B"]}, {"field": "u.amount", "rule": "min", "value": 8}, {"field": "u.id", "rule": "regex", "pattern": "u[0-9]"}, {"field": "u.id", "rule": "length", "min": 2}, {"field": "u.status", "rule": "max", "value": 3}]
    r = run(spark, {"v": {"source": "u.id"}}, validations={"input": rules})
    assert errors(r) == [(1, "input_validation", None, "u.status", "max"), (2, "input_validation", None, "u.status", "max"), (4, "input_validation", None, "u.amount", "min"), (4, "input_validation", None, "u.status", "enum"), (4, "input_validation", None, "u.status", "max")]
    assert values(r.outputs["out"], "v") == [("u3",)]


def test_referential_integrity_and_output_validation(spark):
    parts = {"validations": {"input": [{"field": "u.dept", "rule": "referential_integrity", "reference": "depts", "reference_key": "code"}], "output": [{"field": "twice", "rule": "max", "value": 15}]}}
    r = run(spark, {"twice": {"expression": "u.qty * 10"}}, refs=[("D1", "x"), ("D2", "y")], **parts)
    assert errors(r) == [(1, "output_validation", "out", "twice", "max"), (2, "input_validation", None, "u.dept", "referential_integrity"), (3, "output_validation", "out", "twice", "max")]


def handling(**more):
    return {"error_handling": {"error_output": "e.csv", "skipped_output": "s.csv"} | more}


@pytest.mark.parametrize(("more", "reason"), [({"on_transform_error": "stop"}, "transform_error"), ({"max_errors": 1}, "max_errors"), ({"max_errors": 2}, None)])
def test_policies(spark, more, reason):
    from driftloom.config.models import Migration, parse

    raw = {"version": 1, "project": {"name": "t"}, "inputs": {"u": {"path": "u", "schema": SCHEMA}}, "outputs": {"out": {"path": "o", "columns": ["v"]}}, "mappings": {"out": {"v": {"expression": "u.amount / u.qty"}}}, **handling(**more)}
    r = run_migration(spark, parse(Migration, raw), None, {"u": frame(spark, DDL, DATA)})
    assert r.stop_reason == reason and (r.status == "failed") == (reason is not None)
    rows = [e[0] for e in errors(r)]
    assert rows == ([2] if reason == "transform_error" else [2, 3])
    assert r.outputs["out"].count() == (0 if reason else 2)


def test_check_failure_and_output_limit(spark):
    r = run(spark, {"v": {"source": "u.id"}}, checks=[{"name": "c", "rule": "output_rows > 100"}], dry_run=True)
    assert r.status == "dry_run_completed_with_check_failures"
    r = run(spark, {"v": {"source": "u.id"}}, runtime={"max_output_rows": 3})
    assert r.stop_reason == "max_output_rows" and r.counts["output_rows"] == 0


def test_partitioning_doesnt_matter(spark):
    rules = {"id": {"source": "u.id"}, "unit": {"expression": "u.amount / u.qty"}}
    config = migration(SCHEMA, rules, filters={"exclude": [{"if": "u.qty == 3"}]})
    data = frame(spark, DDL, DATA * 50)
    seen = []
    for n in (1, 4, 16):
        plan = compile_migration(spark, config, None, {"u": data.repartition(n)})
        seen.append((values(plan.outputs["out"], "id", "unit"), sorted(map(tuple, plan.errors.collect())), sorted(map(tuple, plan.skipped.collect()))))
    assert seen[0] == seen[1] == seen[2] and len(seen[0][0]) == 100


@pytest.mark.parametrize(("change", "text"), [
    ({"mappings": {"out": {"v": {"source": "u.nope"}}}}, "unknown field 'u.nope'"), ({"mappings": {"out": {"v": {"source": "u.id", "value": 1}}}}, "exactly one of"), ({"extra": 1}, "extra: unknown key"), ({"runtime": {"max_input_rows": 0}}, "positive"), ({"checks": [{"name": "x", "rule": "foo > 1"}]}, "unknown name 'foo'"),
    ({"mappings": {"out": {"v": {"when": [{"if": "u.qty > 1", "then": "example.com"}]}}}}, "example"), ({"validations": {"input": [{"field": "u.id", "rule": "enum"}]}}, "requires values"), ({"mappings": {"out": {"v": {"lookup": {"reference": "r", "key": "u.id", "value": "x"}}}}}, "unknown reference"),
])
def test_configuration_problems(change, text):
    with pytest.raises(ConfigError, match=text.replace("'", ".")):
        mappings = change.pop("mappings", {"out": {"v": {"source": "u.id"}}})["out"]
        migration(SCHEMA, mappings, **change)


def test_streaming_routes_rows_like_a_batch(spark, tmp_path):
    from driftloom.streaming.migration import stream_migration

    data = frame(spark, DDL, DATA)
    data.write.parquet(str(tmp_path / "in"))
    config = migration(SCHEMA, {"id": {"source": "u.id"}, "unit": {"expression": "u.amount / u.qty"}}, filters={"exclude": [{"if": "u.qty == 3"}]})
    plan = stream_migration(spark, config, spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")))
    for name, df in (("s_out", plan.outputs["out"]), ("s_err", plan.errors)):
        q = df.writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["id"] for r in spark.table("s_out").collect()) == ["", "u1"] and [r["row_number"] for r in spark.table("s_err").collect()] == [2]
