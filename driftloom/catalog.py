"""Registered queries over the shared test tables, each through the engine's own configuration and operators.

The tables have no missing values and no orphans, so missing operands, bad texts and unmatched keys are made inside
the query, in the same way on both sides. Row numbers are keys of the table, so no result depends on file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config.models import Filters, Migration, Reference, SchemaField, build, parse
from .operators import jobs, profile
from .plans.migration import compile_migration, run_migration
from .sources.scan import ROW, Loaded, apply_schema, load
from .functions.text import declared_type

_HANDLING = {"error_output": "errors.csv", "skipped_output": "skipped.csv"}


def _table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn(ROW, F.col(key).cast("bigint")) if key else df


def _fields(df: DataFrame) -> dict:
    return {f.name: {"type": declared_type(f.dataType)} for f in df.schema if f.name != ROW}


def _plan(spark: SparkSession, df: DataFrame, columns: dict, references: dict[str, tuple[DataFrame, str | list[str]]] | None = None, **parts):
    """A migration of frame ``t`` with one output, compiled."""
    raw = {
        "version": 1, "project": {"name": "catalog"}, "inputs": {"t": {"path": "t", "schema": _fields(df)}}, "outputs": {"out": {"path": "out.csv", "columns": list(columns)}}, "mappings": {"out": columns}, "error_handling": _HANDLING,
        "references": {n: {"path": n, "key": k, "schema": _fields(r)} for n, (r, k) in (references or {}).items()}, **parts,
    }
    frames = {"t": df} | {n: r.withColumn(ROW, F.lit(1).cast("bigint")) if ROW not in r.columns else r for n, (r, _) in (references or {}).items()}
    return compile_migration(spark, parse(Migration, raw), None, frames, check=False)


def _out(plan) -> DataFrame:
    return plan.outputs["out"].drop(ROW)


def _loaded(df: DataFrame) -> Loaded:
    return Loaded(df, {f.name: declared_type(f.dataType) for f in df.schema if f.name != ROW})


def _report(errors: DataFrame, *columns: str) -> DataFrame:
    return errors.select("row_number", *columns)


# ---- flagship: scan, expression, lookup, case, filter, projection ----


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem", "l_orderkey")
    orders = _table(spark, sf_dir, "orders")
    plan = _plan(
        spark, lines,
        {
            "order_key": {"source": "t.l_orderkey"}, "line": {"source": "t.l_linenumber"}, "net": {"source": "derived.net"},
            "priority": {"lookup": {"reference": "orders", "key": "t.l_orderkey", "value": "o_orderpriority"}},
            "state": {"when": [{"if": 't.l_returnflag == "R"', "then": "returned"}], "default": "kept"},
        },
        {"orders": (orders, "o_orderkey")},
        derived={"net": {"expression": "t.l_extendedprice * (1 - t.l_discount)"}}, filters={"exclude": [{"if": "t.l_quantity < 5", "reason": "small"}]},
    )
    return _out(plan)


_FLAGSHIP = """select l_orderkey as order_key, l_linenumber as line, l_extendedprice * (1 - l_discount) as net, o_orderpriority as priority,
case when l_returnflag = 'R' then 'returned' else 'kept' end as state from lineitem join orders on l_orderkey = o_orderkey where not l_quantity < 5"""


def scan_project_source_value(spark, d):
    return _out(_plan(spark, _table(spark, d, "nation", "n_nationkey"), {"id": {"source": "t.n_nationkey"}, "name": {"source": "t.n_name"}, "source_system": {"value": "CRM"}, "nothing": {"value": None}}))


_FILTERS = {"include": [{"if": 't.o_orderstatus == "F"'}, {"if": "t.o_totalprice > 100000 and t.o_orderstatus != \"P\""}], "exclude": [{"if": 't.o_orderpriority in ["1-URGENT", "5-LOW"]', "reason": "priority"}, {"if": "(t.o_totalprice <= 20000 or t.o_custkey == 7) and t.o_orderkey is not null"}]}


def filter_include_exclude(spark, d):
    return _out(_plan(spark, _table(spark, d, "orders", "o_orderkey"), {"key": {"source": "t.o_orderkey"}}, filters=_FILTERS))


def skip_report(spark, d):
    return _plan(spark, _table(spark, d, "orders", "o_orderkey"), {"key": {"source": "t.o_orderkey"}}, filters=_FILTERS).skipped.select("row_number", "reason")


_SKIP_CASE = """case when not (o_orderstatus = 'F' or (o_totalprice > 100000 and o_orderstatus <> 'P')) then 'No include condition matched'
when o_orderpriority in ('1-URGENT', '5-LOW') then 'priority' when o_totalprice <= 20000 or o_custkey = 7 then 'Excluded by filter' end"""


def condition_nulls(spark, d):
    df = _table(spark, d, "orders", "o_orderkey").select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("s"), F.expr("if(o_custkey % 3 = 0, null, o_custkey)").alias("n"), ROW)
    tests = {"differs": 't.s != "O"', "same": 't.s == "O"', "n_differs": "t.n != 5", "not_in": 't.s not in ["P"]', "is_null": "t.s is null", "eq_null": "t.n == null", "truth": "t.n", "below": "t.n < 100", "text_number": "t.s == 5"}
    return _out(_plan(spark, df, {"key": {"source": "t.o_orderkey"}} | {k: {"when": [{"if": c, "then": True}], "default": False} for k, c in tests.items()}))


_CONDITION_NULLS = """select o_orderkey as key, coalesce(s <> 'O', true) as differs, coalesce(s = 'O', false) as same, coalesce(n <> 5, false) as n_differs, coalesce(s not in ('P'), false) as not_in,
s is null as is_null, n is null as eq_null, coalesce(n <> 0, false) as truth, coalesce(n < 100, false) as below, false as text_number
from (select o_orderkey, nullif(o_orderstatus, 'F') as s, case when o_custkey % 3 = 0 then null else o_custkey end as n from orders)"""


def map_default(spark, d):
    df = _table(spark, d, "orders", "o_orderkey")
    return _out(_plan(spark, df, {"key": {"source": "t.o_orderkey"}, "status": {"map": {"source": "t.o_orderstatus", "values": {"F": "final", "O": "open"}, "default": "unknown"}}}))


def map_error_report(spark, d):
    df = _table(spark, d, "orders", "o_orderkey")
    plan = _plan(spark, df, {"key": {"source": "t.o_orderkey"}, "status": {"map": {"source": "t.o_orderstatus", "values": {"F": "final", "O": "open"}}}})
    return _report(plan.errors, "stage", "field", "rule")


def when_case(spark, d):
    rule = {"when": [{"if": "t.o_totalprice >= 200000", "then": "large"}, {"if": 't.o_totalprice >= 100000 and t.o_orderstatus == "F"', "then": "t.o_orderpriority"}], "default": "small"}
    return _out(_plan(spark, _table(spark, d, "orders", "o_orderkey"), {"key": {"source": "t.o_orderkey"}, "size": rule}))


def concat_pystr(spark, d):
    df = _table(spark, d, "customer", "c_custkey").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    return _out(_plan(spark, df, {"key": {"source": "t.c_custkey"}, "label": {"concat": {"values": ["t.c_name", " / ", "t.c_mktsegment", " #", "t.c_nationkey"]}}}))


def generate_id(spark, d):
    rule = {"generate_id": {"fields": ["t.c_custkey", "t.c_name"], "prefix": "CUS-", "separator": "::", "length": 20}}
    return _out(_plan(spark, _table(spark, d, "customer", "c_custkey"), {"key": {"source": "t.c_custkey"}, "id": rule}))


def lookup_single(spark, d):
    rule = {"lookup": {"reference": "customer", "key": "t.o_custkey", "value": "c_name"}}
    return _out(_plan(spark, _table(spark, d, "orders", "o_orderkey"), {"key": {"source": "t.o_orderkey"}, "customer": rule}, {"customer": (_table(spark, d, "customer"), "c_custkey")}))


def lookup_composite(spark, d):
    ref = _table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal")
    df = _table(spark, d, "customer", "c_custkey").select("c_custkey", "c_nationkey", "c_name", ROW)
    rule = {"lookup": {"reference": "r", "key": ["t.c_nationkey", "t.c_custkey"], "value": "c_acctbal"}}
    return _out(_plan(spark, df, {"key": {"source": "t.c_custkey"}, "balance": rule}, {"r": (ref, ["c_nationkey", "c_custkey"])}))


def _lookup_missing(policy: dict):
    def query(spark, d):
        ref = _table(spark, d, "customer").where("c_nationkey < 10")
        rule = {"lookup": {"reference": "customer", "key": "t.o_custkey", "value": "c_name", **policy}}
        return _out(_plan(spark, _table(spark, d, "orders", "o_orderkey"), {"key": {"source": "t.o_orderkey"}, "customer": rule}, {"customer": (ref, "c_custkey")}))

    return query


def lookup_error_report(spark, d):
    ref = _table(spark, d, "customer").where("c_nationkey < 10")
    rule = {"lookup": {"reference": "customer", "key": "t.o_custkey", "value": "c_name"}}
    plan = _plan(spark, _table(spark, d, "orders", "o_orderkey"), {"key": {"source": "t.o_orderkey"}, "customer": rule}, {"customer": (ref, "c_custkey")})
    return _report(plan.errors, "stage", "output_name", "field", "message")


def expr_arith(spark, d):
    df = _table(spark, d, "orders", "o_orderkey").withColumn("o_custkey", F.col("o_custkey").cast("bigint"))
    rules = {"add": "t.o_totalprice + t.o_custkey", "sub": "t.o_custkey - t.o_orderkey", "mul": "t.o_custkey * 3", "div": "t.o_totalprice / (t.o_custkey + 1)", "neg": "-t.o_custkey + 2", "mixed": "(t.o_totalprice - 1) * 0.5"}
    return _out(_plan(spark, df, {"key": {"source": "t.o_orderkey"}} | {k: {"expression": e} for k, e in rules.items()}))


def expr_floor_mod_pow(spark, d):
    df = _table(spark, d, "orders", "o_orderkey").select("o_orderkey", (F.col("o_custkey") - 700).cast("bigint").alias("n"), ROW)
    rules = {"floor_div": "t.n // 7", "modulo": "t.n % 7", "floor_neg": "t.n // (0 - 7)", "mod_neg": "t.n % (0 - 7)", "power": "(t.n % 10) ** 3", "halves": "t.n // 2.5"}
    return _out(_plan(spark, df, {"key": {"source": "t.o_orderkey"}} | {k: {"expression": e} for k, e in rules.items()}))


def expr_round_abs_min_max(spark, d):
    df = _table(spark, d, "orders", "o_orderkey").select("o_orderkey", (F.col("o_custkey") / 2 - 100).alias("h"), F.col("o_custkey").cast("bigint").alias("n"), ROW)
    rules = {"rounded": "round(t.h)", "absolute": "abs(t.h)", "least": "min(t.h, t.n, 50)", "most": "max(t.h, t.n)", "whole": "round(t.n)"}
    return _out(_plan(spark, df, {"key": {"source": "t.o_orderkey"}} | {k: {"expression": e} for k, e in rules.items()}))


def _expr_missing(spark, d):
    df = _table(spark, d, "orders", "o_orderkey").withColumn("o_custkey", F.expr("nullif(o_custkey % 5, 0)").cast("bigint")).withColumn("zero", F.expr("o_orderkey % 4").cast("bigint"))
    return _plan(spark, df, {"key": {"source": "t.o_orderkey"}, "x": {"expression": "t.o_totalprice / t.zero + t.o_custkey"}})


def expr_missing_error_report(spark, d):
    return _report(_expr_missing(spark, d).errors, "stage", "field", "rule").withColumn("missing", F.lit(True)).drop("missing")


def expr_missing_survivors(spark, d):
    return _out(_expr_missing(spark, d))


def derived_dag(spark, d):
    df = _table(spark, d, "orders", "o_orderkey")
    derived = {"c": {"expression": "derived.b * 2"}, "a": {"expression": "t.o_custkey + 1"}, "b": {"expression": "derived.a - 3"}, "label": {"concat": {"values": ["k", "derived.c"]}}}
    return _out(_plan(spark, df, {"key": {"source": "t.o_orderkey"}, "c": {"source": "derived.c"}, "label": {"source": "derived.label"}}, derived=derived))


def multiple_outputs(spark, d):
    df = _table(spark, d, "orders", "o_orderkey")
    raw = {"version": 1, "project": {"name": "x"}, "inputs": {"t": {"path": "t", "schema": _fields(df)}}, "error_handling": _HANDLING, "outputs": {"one": {"path": "1.csv", "columns": ["key", "v"]}, "two": {"path": "2.csv", "columns": ["key", "v"]}},
           "mappings": {"one": {"key": {"source": "t.o_orderkey"}, "v": {"source": "t.o_orderstatus"}}, "two": {"key": {"source": "t.o_orderkey"}, "v": {"map": {"source": "t.o_orderstatus", "values": {"F": "final"}}}}}}
    plan = compile_migration(spark, parse(Migration, raw), None, {"t": df}, check=False)
    return plan.outputs["one"].select(F.lit("one").alias("output"), "key", "v").unionByName(plan.outputs["two"].select(F.lit("two").alias("output"), "key", "v"))


# ---- normalizers and casts ----


def _schema(**fields) -> dict:
    problems: list[str] = []
    out = {k: build(SchemaField, v, k, problems) for k, v in fields.items()}
    if problems:
        raise ValueError(problems)
    return out


def normalize_trim_commas_currency(spark, d):
    df = _table(spark, d, "part", "p_partkey").select("p_partkey", F.expr("concat('  \t', p_name, '　 ')").alias("name"), F.expr("concat('$', format_string('%,d', cast(p_retailprice * 1000 as bigint)))").alias("price"), ROW)
    spec = _schema(p_partkey={"type": "integer"}, name={"normalize": ["trim"]}, price={"type": "integer", "normalize": ["trim", "remove_commas", "remove_currency_symbol"]})
    return apply_schema(df, spec, check=False).df.drop(ROW)


def normalize_nfkc(spark, d):
    df = _table(spark, d, "part", "p_partkey").select("p_partkey", F.expr("concat('ＡＢＣ', p_name, '１２３')").alias("name"), ROW)
    return apply_schema(df, _schema(p_partkey={"type": "integer"}, name={"normalize": ["zenkaku_to_hankaku"]}), check=False).df.drop(ROW)


def _casts(spark, d):
    text = "case when o_orderkey % 7 = 0 then 'x' when o_orderkey % 11 = 0 then null else %s end"
    cols = {"n": "cast(o_custkey as string)", "x": "cast(o_custkey / 4 as string)", "b": "case o_custkey % 4 when 0 then 'yes' when 1 then 'no' when 2 then 'TRUE' else '0' end", "t": "date_format(o_orderdate, 'yyyy-MM-dd')"}
    df = _table(spark, d, "orders", "o_orderkey").select("o_orderkey", *[F.expr(text.replace("%s", c)).alias(k) for k, c in cols.items()], ROW)
    return df, _schema(o_orderkey={"type": "integer"}, n={"type": "integer"}, x={"type": "decimal"}, b={"type": "boolean"}, t={"type": "date", "date_format": "%Y-%m-%d"})


def casts(spark, d):
    df, spec = _casts(spark, d)
    return apply_schema(df, spec, check=False).df.drop(ROW)


def limit_input(spark, d):
    df = _table(spark, d, "orders", "o_orderkey")
    spec = build(Reference, {"path": "x", "key": "o_orderkey", "schema": _fields(df)}, "x", [])
    return load(spark, spec, None, {"x": df}, "x", limit=100, check=False).df.select("o_orderkey")


# ---- validations and checks ----

_VALID = [
    {"field": "t.c_name", "rule": "required"}, {"field": "t.c_mktsegment", "rule": "enum", "values": ["AUTOMOBILE", "BUILDING", "MACHINERY"]}, {"field": "t.c_acctbal", "rule": "min", "value": 0}, {"field": "t.c_acctbal", "rule": "max", "value": 9000},
    {"field": "t.c_name", "rule": "regex", "pattern": "Customer#[0-9]+[02468]"}, {"field": "t.c_mktsegment", "rule": "length", "min": 9, "max": 10},
]


def validate_rules(spark, d):
    df = _table(spark, d, "customer", "c_custkey").withColumn("c_name", F.expr("case when c_custkey % 10 = 0 then '  ' else c_name end"))
    plan = _plan(spark, df, {"key": {"source": "t.c_custkey"}}, validations={"input": _VALID})
    return _report(plan.errors, "stage", "field", "rule")


def validate_survivors(spark, d):
    df = _table(spark, d, "customer", "c_custkey").withColumn("c_name", F.expr("case when c_custkey % 10 = 0 then '  ' else c_name end"))
    return _out(_plan(spark, df, {"key": {"source": "t.c_custkey"}}, validations={"input": _VALID}))


def validate_output(spark, d):
    plan = _plan(spark, _table(spark, d, "orders", "o_orderkey"), {"key": {"source": "t.o_orderkey"}, "tax": {"expression": "t.o_totalprice * 0.1"}}, validations={"output": [{"field": "tax", "rule": "max", "value": 20000}]})
    return _report(plan.errors, "stage", "output_name", "field", "rule")


def validate_referential_integrity(spark, d):
    ref = _table(spark, d, "customer").where("c_nationkey < 10")
    plan = _plan(spark, _table(spark, d, "orders", "o_orderkey"), {"key": {"source": "t.o_orderkey"}}, {"customer": (ref, "c_custkey")}, validations={"input": [{"field": "t.o_custkey", "rule": "referential_integrity", "reference": "customer", "reference_key": "c_custkey"}]})
    return _report(plan.errors, "field", "rule")


def checks_row_accounting(spark, d):
    df = _table(spark, d, "orders", "o_orderkey")
    raw = {"version": 1, "project": {"name": "x"}, "inputs": {"t": {"path": "t", "schema": _fields(df)}}, "outputs": {"out": {"path": "o.csv", "columns": ["key", "s"]}}, "mappings": {"out": {"key": {"source": "t.o_orderkey"}, "s": {"map": {"source": "t.o_orderstatus", "values": {"F": "final", "O": "open"}}}}},
           "filters": {"exclude": [{"if": "t.o_totalprice < 50000"}]}, "checks": [{"name": "all rows", "rule": "input_rows == output_rows + error_rows + skipped_rows"}], "error_handling": _HANDLING | {"max_errors": 10**9}}
    r = run_migration(spark, parse(Migration, raw), None, {"t": df})
    return spark.createDataFrame([(*(r.counts[k] for k in ("input_rows", "output_rows", "error_rows", "skipped_rows")), r.checks[0]["passed"])], "input_rows bigint, output_rows bigint, error_rows bigint, skipped_rows bigint, passed boolean")


# ---- relational jobs ----


def _merge_sources(spark, d):
    customers = _loaded(_table(spark, d, "customer", "c_custkey").select("c_custkey", "c_name", "c_acctbal", F.lit(None).cast("string").alias("note"), ROW))
    orders = _table(spark, d, "orders").where("o_totalprice > 150000").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"), F.max("o_orderpriority").alias("note")).withColumn(ROW, F.col("o_custkey").cast("bigint"))
    return {"c": customers, "o": _loaded(orders)}, {"c": ["c_custkey"], "o": ["o_custkey"]}


_MERGE = {"key": {"source": "c.c_custkey"}, "note": {"first": ["c.note", "o.note", "c.c_name"]}, "last": {"last": ["o.note", "c.c_name"]}, "sum": {"sum": ["c.c_acctbal", "o.top"]}, "low": {"min": ["c.c_acctbal", "o.top"]}, "high": {"max": ["c.c_acctbal", "o.top"]}, "found": {"count": ["c.note", "o.note", "o.n"]}}


def merge_left(spark, d):
    return jobs.merge(*_merge_sources(spark, d), "c", _MERGE).outputs["output"].drop(ROW)


def merge_inner(spark, d):
    return jobs.merge(*_merge_sources(spark, d), "c", {"key": {"source": "c.c_custkey"}, "n": {"source": "o.n"}}, "inner").outputs["output"].drop(ROW)


def merge_inner_skipped(spark, d):
    return jobs.merge(*_merge_sources(spark, d), "c", {"key": {"source": "c.c_custkey"}}, "inner").skipped.select("row_number", "reason")


def merge_key_errors(spark, d):
    a = _loaded(_table(spark, d, "orders", "o_orderkey").select(F.expr("nullif(o_custkey % 700, 3)").alias("k"), ROW))
    b = _loaded(_table(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("k"), ROW))
    return jobs.merge({"a": a, "b": b}, {"a": ["k"], "b": ["k"]}, "b", {"k": {"source": "b.k"}}).errors.select("input_name", "row_number", "rule")


def _union_sources(spark, d):
    n = _table(spark, d, "nation", "n_nationkey")
    pick = lambda where, shift=0: _loaded(n.where(where).select((F.col("n_nationkey") + shift).alias("id"), F.col("n_name").alias("name"), ROW))
    return pick


def union_all_keyed(spark, d):
    pick = _union_sources(spark, d)
    return jobs.union({"a": pick("n_nationkey < 10"), "b": pick("n_nationkey >= 10")}, ["id"], ["id", "name"]).outputs["output"].drop(ROW, "__input_order")


def union_key_errors(spark, d):
    pick = _union_sources(spark, d)
    return jobs.union({"a": pick("n_nationkey < 12"), "b": pick("n_nationkey >= 5", -5)}, ["id"], ["id", "name"]).errors.select("input_name", "row_number", "rule", "message")


def reference_key_errors(spark, d):
    df = _table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    keys = [F.col("l_orderkey"), F.col("l_linenumber")]
    return jobs.rows_with(df, keys, jobs.duplicate_keys(df, keys), "left_semi").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


def _unpivot(spark, d, drop_null):
    df = _table(spark, d, "orders", "o_orderkey").select("o_orderkey", F.col("o_custkey").cast("double").alias("a"), F.expr("if(o_orderkey % 3 = 0, null, o_totalprice)").alias("b"), ROW)
    rules = build(Filters, {"exclude": [{"if": "input.a < 20"}]}, "f", [])
    return jobs.unpivot(_loaded(df), ["o_orderkey"], "measure", "amount", {"a": "customer", "b": "total"}, drop_null, rules).outputs["output"].drop(ROW, "__at")


def unpivot_keep_null(spark, d):
    return _unpivot(spark, d, False)


def unpivot_drop_null(spark, d):
    return _unpivot(spark, d, True)


_UNPIVOT = """select o_orderkey, measure, amount from (select o_orderkey, 'customer' as measure, o_custkey::double as amount from orders where not o_custkey < 20
union all select o_orderkey, 'total', case when o_orderkey % 3 = 0 then null else o_totalprice end from orders where not o_custkey < 20)"""


def aggregate_group(spark, d):
    df = _table(spark, d, "orders", "o_orderkey").select("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("bigint").alias("n"), "o_totalprice", "o_orderdate", F.expr("if(o_orderkey % 2 = 0, null, concat('k', o_orderkey))").alias("note"), ROW)
    rules = {"status": {"group_key": "o_orderstatus"}, "priority": {"group_key": "o_orderpriority"}, "total": {"sum": "n"}, "rows": {"count": None}, "notes": {"count": "note"}, "low": {"min": "o_totalprice"}, "high": {"max": "o_totalprice"}, "from_date": {"min": "o_orderdate"}, "first_note": {"first": "note"}, "last_note": {"last": "note"}}
    return jobs.aggregate(_loaded(df), ["o_orderstatus", "o_orderpriority"], rules).outputs["output"].drop("__order")


def aggregate_errors(spark, d):
    df = _table(spark, d, "orders", "o_orderkey").select(F.expr("nullif(o_orderstatus, 'P')").alias("s"), F.expr("if(o_orderkey % 50 = 0, 'n/v', cast(o_custkey as string))").alias("v"), ROW)
    return jobs.aggregate(_loaded(df), ["s"], {"s": {"group_key": "s"}, "v": {"sum": "v"}}).errors.select("row_number", "stage", "field", "rule")


def _match(singletons):
    def query(spark, d):
        df = _table(spark, d, "customer", "c_custkey").select("c_custkey", "c_nationkey", "c_mktsegment", F.expr("cast(c_acctbal / 1000 as int)").alias("band"), ROW)
        return jobs.match(_loaded(df), ["c_nationkey", "c_mktsegment", "band"], "group_id", ["c_custkey", "group_id"], "G", 5, singletons).outputs["output"].drop(ROW)

    return query


_MATCH = """with c as (select c_custkey, c_nationkey, c_mktsegment, trunc(c_acctbal / 1000)::int as band from customer), g as (select c_nationkey, c_mktsegment, band, min(c_custkey) as f, count(*) as n from c group by all),
r as (select *, 'G' || lpad(row_number() over (order by f)::varchar, 5, '0') as id from g) select c_custkey, {} as group_id from c join r using (c_nationkey, c_mktsegment, band)"""

_PARENT = {"cust": {"first": "o_custkey"}, "last_prio": {"last": "o_orderpriority"}, "total": {"sum": "cents"}, "n": {"count": "o_orderkey"}, "status": {"require_same": "o_orderstatus"}}


def _consolidate(spark, d):
    df = _table(spark, d, "orders", "o_orderkey").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"), ROW)
    return jobs.consolidate(_loaded(df), ["o_custkey"], _PARENT, {"lines": {"key": {"source": "o_orderkey"}, "cust": {"parent_value": "cust"}, "total": {"parent_value": "total"}}})


def consolidate_parent(spark, d):
    return _consolidate(spark, d).outputs["parent"].drop("__order")


def consolidate_child(spark, d):
    return _consolidate(spark, d).outputs["lines"].drop("__order", ROW)


def consolidate_conflict(spark, d):
    return _consolidate(spark, d).errors.select("row_number", "stage", "field", "rule")


# ---- profiling ----


def profile_columns(spark, d):
    df = _table(spark, d, "customer", "c_custkey").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    out = profile.column_metrics(_loaded(df.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", ROW)))
    return out.select("field", "non_null_count", "missing_count", "unique_count", "duplicate_count", "min_length", "max_length", "min", "max", F.round("mean", 6).alias("mean"))


def _profile_sql() -> str:
    parts = []
    for c in ("c_custkey", "c_name", "c_mktsegment", "c_nationkey"):
        text = c in ("c_name", "c_mktsegment")
        of = lambda f, c=c, on=not text: f"{f}({c})::double" if on else "null::double"
        size = lambda f, c=c, on=text: f"{f}(length({c}))::bigint" if on else "null::bigint"
        parts.append(f"select '{c}' as field, count({c}) as non_null_count, count(*) - count({c}) as missing_count, count(distinct {c}) as unique_count, count({c}) - count(distinct {c}) as duplicate_count, {size('min')} as min_length, {size('max')} as max_length, {of('min')} as min, {of('max')} as max, round({of('avg')}, 6) as mean from c")
    return "with c as (select c_custkey, c_name, nullif(c_mktsegment, 'BUILDING') as c_mktsegment, c_nationkey from customer) " + " union all ".join(parts)


def profile_top_values(spark, d):
    return profile.top_values(_loaded(_table(spark, d, "customer", "c_custkey").select("c_mktsegment", ROW))).select("field", F.col("rank").cast("bigint").alias("rank"), "value", "n")


# ---- frames that carry no row number of their own; whole error and skip reports; run statuses ----


def _numbers(plan) -> DataFrame:
    """One row: what numbering must give, whatever the frame's plan is."""
    out = plan.outputs["out"]
    return out.agg(F.count("*").alias("rows"), F.count_distinct(ROW).alias("numbers"), F.min(ROW).alias("lowest"), F.max(ROW).alias("highest"), F.sum("key").cast("bigint").alias("keys"))


def frame_join_numbered(spark, d):
    joined = _table(spark, d, "lineitem").join(_table(spark, d, "orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return _numbers(_plan(spark, joined, {"key": {"source": "t.l_orderkey"}, "price": {"source": "t.o_totalprice"}}))


def frame_groupby_numbered(spark, d):
    grouped = _table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("quantity"), F.max("l_shipdate").cast("string").alias("last"), F.count("*").alias("n"))
    return _numbers(_plan(spark, grouped, {"key": {"source": "t.l_partkey"}, "n": {"source": "t.n"}}))


def error_rows_whole(spark, d):
    """All columns of the error report, its message and its row as JSON with them."""
    df = _table(spark, d, "nation", "n_nationkey").select("n_nationkey", "n_name", ROW)
    rules = {"key": {"source": "t.n_nationkey"}, "part": {"map": {"source": "t.n_name", "values": {"FRANCE": "W", "JAPAN": "E"}}}}
    plan = _plan(spark, df, rules, validations={"input": [{"field": "t.n_nationkey", "rule": "max", "value": 20}], "output": [{"field": "out.part", "rule": "enum", "values": ["W"]}]})
    return plan.errors.select("row_number", "stage", "output_name", "field", "rule", "message", "row_json")


def skipped_rows_whole(spark, d):
    df = _table(spark, d, "nation", "n_nationkey").select("n_nationkey", "n_name", ROW)
    return _plan(spark, df, {"key": {"source": "t.n_nationkey"}}, filters={"exclude": [{"if": "t.n_nationkey > 9", "reason": "late"}]}).skipped.select("row_number", "reason", "row_json")


def policy_statuses(spark, d):
    """(policy, status, stop_reason, error rows, output rows) of one migration under each error policy."""
    df = _table(spark, d, "orders", "o_orderkey")
    rows = []
    for policy in ({"on_validation_error": "stop"}, {"on_transform_error": "stop"}, {"max_errors": 3}, {"max_errors": 10_000_000}):
        raw = {"version": 1, "project": {"name": "p"}, "inputs": {"t": {"path": "t", "schema": _fields(df)}}, "outputs": {"out": {"path": "out.csv", "columns": ["key", "status"]}}, "error_handling": _HANDLING | {"max_errors": 1_000_000} | policy,
               "mappings": {"out": {"key": {"source": "t.o_orderkey"}, "status": {"map": {"source": "t.o_orderstatus", "values": {"F": "final", "O": "open"}}}}}, "validations": {"output": [{"field": "out.status", "rule": "enum", "values": ["final"]}]}}
        r = run_migration(spark, parse(Migration, raw), None, {"t": df})
        rows.append((next(iter(policy)) + "=" + str(next(iter(policy.values()))), r.status, r.stop_reason, r.errors.count(), r.outputs["out"].count()))
    return spark.createDataFrame(rows, "policy string, status string, stop_reason string, error_rows bigint, output_rows bigint")


def profile_samples(spark, d):
    found = profile.sample_values(_loaded(_table(spark, d, "customer", "c_custkey").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')")).select("c_custkey", "c_mktsegment", ROW)))
    return spark.createDataFrame([(f, i, v) for f, vs in found.items() for i, v in enumerate(vs, 1)], "field string, place bigint, value string")


_ORACLES = {
    "normalize_nfkc": "select p_partkey, 'ABC' || p_name || '123' as name from part",
    "frame_join_numbered": "select count(*) as rows, count(*) as numbers, 1::bigint as lowest, count(*) as highest, sum(l_orderkey)::bigint as keys from lineitem join orders on l_orderkey = o_orderkey",
    "frame_groupby_numbered": "select count(*) as rows, count(*) as numbers, 1::bigint as lowest, count(*) as highest, sum(l_partkey)::bigint as keys from (select distinct l_partkey from lineitem)",
    "error_rows_whole": """with n as (select n_nationkey as k, n_name as s, '{"__row_number":' || n_nationkey || ',"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as j from nation)
select k as row_number, 'input_validation' as stage, null::varchar as output_name, 't.n_nationkey' as field, 'max' as rule, 'value is greater than max 20: ' || k as message, j as row_json from n where k > 20
union all select k, 'mapping', 'out', 'part', 'map', 'part: unmapped values: ''' || s || '''', j from n where k <= 20 and s not in ('FRANCE', 'JAPAN')
union all select k, 'output_validation', 'out', 'out.part', 'enum', 'value is not in enum: ''E''', '{"key":' || k || ',"part":"E"}' from n where k <= 20 and s = 'JAPAN'""",
    "skipped_rows_whole": """select n_nationkey as row_number, 'late' as reason, '{"__row_number":' || n_nationkey || ',"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' as row_json from nation where n_nationkey > 9""",
    "policy_statuses": """with n as (select count(*) filter (o_orderstatus = 'P') as p, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'F') as f, min(o_orderkey) filter (o_orderstatus = 'P') as first from orders)
select 'on_validation_error=stop' as policy, 'failed' as status, 'validation_error' as stop_reason, p + o as error_rows, 0::bigint as output_rows from n
union all select 'on_transform_error=stop', 'failed', 'transform_error', (select count(*) from orders where o_orderstatus <> 'F' and o_orderkey <= first), 0 from n
union all select 'max_errors=3', 'failed', 'max_errors', 4, 0 from n union all select 'max_errors=10000000', 'completed', null, p + o, f from n""",
    "profile_samples": """select 'c_custkey' as field, row_number() over (order by c_custkey) as place, c_custkey::varchar as value from customer qualify place <= 3
union all select 'c_mktsegment', row_number() over (order by c_custkey) as place, c_mktsegment from customer where c_mktsegment <> 'BUILDING' qualify place <= 3""",
    "flagship_migration": _FLAGSHIP,
    "scan_project_source_value": "select n_nationkey as id, n_name as name, 'CRM' as source_system, null::varchar as nothing from nation",
    "filter_include_exclude": f"select o_orderkey as key from orders where ({_SKIP_CASE}) is null",
    "skip_report": f"select o_orderkey as row_number, {_SKIP_CASE} as reason from orders where ({_SKIP_CASE}) is not null",
    "condition_nulls": _CONDITION_NULLS,
    "map_default": "select o_orderkey as key, case o_orderstatus when 'F' then 'final' when 'O' then 'open' else 'unknown' end as status from orders",
    "map_error_report": "select o_orderkey as row_number, 'mapping' as stage, 'status' as field, 'map' as rule from orders where o_orderstatus not in ('F', 'O')",
    "when_case": "select o_orderkey as key, case when o_totalprice >= 200000 then 'large' when o_totalprice >= 100000 and o_orderstatus = 'F' then o_orderpriority else 'small' end as size from orders",
    "concat_pystr": "select c_custkey as key, c_name || ' / ' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') || ' #' || c_nationkey as label from customer",
    "generate_id": "select c_custkey as key, 'CUS-' || substr(sha256(c_custkey || '::' || c_name), 1, 20) as id from customer",
    "lookup_single": "select o_orderkey as key, c_name as customer from orders join customer on o_custkey = c_custkey",
    "lookup_composite": "select c_custkey as key, c_acctbal as balance from customer",
    "lookup_missing_default": "select o_orderkey as key, coalesce(c_name, 'nobody') as customer from orders left join (select * from customer where c_nationkey < 10) on o_custkey = c_custkey",
    "lookup_missing_empty": "select o_orderkey as key, coalesce(c_name, '') as customer from orders left join (select * from customer where c_nationkey < 10) on o_custkey = c_custkey",
    "lookup_missing_null": "select o_orderkey as key, c_name as customer from orders left join (select * from customer where c_nationkey < 10) on o_custkey = c_custkey",
    "lookup_error_report": "select o_orderkey as row_number, 'mapping' as stage, 'out' as output_name, 'lookup missing' as field, 'lookup missing: reference=customer key=' || o_custkey as message from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 10)",
    "expr_arith": "select o_orderkey as key, o_totalprice + o_custkey as add, o_custkey - o_orderkey as sub, o_custkey * 3 as mul, o_totalprice / (o_custkey + 1) as div, -o_custkey + 2 as neg, (o_totalprice - 1) * 0.5::double as mixed from orders",
    "expr_floor_mod_pow": "select o_orderkey as key, floor(n / 7)::bigint as floor_div, (n - floor(n / 7) * 7)::bigint as modulo, floor(n / -7)::bigint as floor_neg, (n - floor(n / -7) * -7)::bigint as mod_neg, power((n - floor(n / 10) * 10), 3)::bigint as power, floor(n / 2.5::double) as halves from (select o_orderkey, (o_custkey - 700)::bigint as n from orders)",
    "expr_round_abs_min_max": "select o_orderkey as key, round_even(h, 0)::bigint as rounded, abs(h) as absolute, least(h, n::double, 50.0::double) as least, greatest(h, n::double) as most, n as whole from (select o_orderkey, o_custkey / 2.0::double - 100 as h, o_custkey::bigint as n from orders)",
    "expr_missing_error_report": "select o_orderkey as row_number, 'mapping' as stage, 'x' as field, 'expression' as rule from orders where o_custkey % 5 = 0 or o_orderkey % 4 = 0",
    "expr_missing_survivors": "select o_orderkey as key, o_totalprice / (o_orderkey % 4) + o_custkey % 5 as x from orders where o_custkey % 5 <> 0 and o_orderkey % 4 <> 0",
    "derived_dag": "select o_orderkey as key, (o_custkey + 1 - 3) * 2 as c, 'k' || ((o_custkey + 1 - 3) * 2) as label from orders",
    "multiple_outputs": "select 'one' as output, o_orderkey as key, o_orderstatus as v from orders union all select 'two', o_orderkey, 'final' from orders where o_orderstatus = 'F'",
    "normalize_trim_commas_currency": "select p_partkey, p_name as name, trunc(p_retailprice * 1000)::bigint as price from part",
    "casts": "select o_orderkey, case when bad then null else o_custkey end as n, case when bad then null else o_custkey / 4::double end as x, case when bad then null else o_custkey % 4 in (0, 2) end as b, case when bad then null else date_trunc('day', o_orderdate)::timestamp end as t from (select *, o_orderkey % 7 = 0 or o_orderkey % 11 = 0 as bad from orders)",
    "limit_input": "select o_orderkey from orders where o_orderkey <= 100",
    "validate_rules": """with c as (select * replace (case when c_custkey % 10 = 0 then '  ' else c_name end as c_name) from customer)
select c_custkey as row_number, 'input_validation' as stage, f as field, r as rule from (
select c_custkey, 't.c_name' as f, 'required' as r from c where trim(c_name) = '' union all select c_custkey, 't.c_mktsegment', 'enum' from c where c_mktsegment not in ('AUTOMOBILE', 'BUILDING', 'MACHINERY')
union all select c_custkey, 't.c_acctbal', 'min' from c where c_acctbal < 0 union all select c_custkey, 't.c_acctbal', 'max' from c where c_acctbal > 9000
union all select c_custkey, 't.c_name', 'regex' from c where trim(c_name) <> '' and not regexp_full_match(c_name, 'Customer#[0-9]+[02468]')
union all select c_custkey, 't.c_mktsegment', 'length' from c where length(c_mktsegment) < 9 or length(c_mktsegment) > 10)""",
    "validate_survivors": "select c_custkey as key from customer where c_custkey % 10 <> 0 and c_mktsegment in ('AUTOMOBILE', 'BUILDING', 'MACHINERY') and c_acctbal between 0 and 9000 and regexp_full_match(c_name, 'Customer#[0-9]+[02468]') and length(c_mktsegment) between 9 and 10",
    "validate_output": "select o_orderkey as row_number, 'output_validation' as stage, 'out' as output_name, 'tax' as field, 'max' as rule from orders where o_totalprice * 0.1::double > 20000",
    "validate_referential_integrity": "select o_orderkey as row_number, 't.o_custkey' as field, 'referential_integrity' as rule from orders where o_custkey not in (select c_custkey from customer where c_nationkey < 10)",
    "checks_row_accounting": "select count(*) as input_rows, count(*) filter (o_totalprice >= 50000 and o_orderstatus in ('F', 'O')) as output_rows, count(*) filter (o_totalprice >= 50000 and o_orderstatus not in ('F', 'O')) as error_rows, count(*) filter (o_totalprice < 50000) as skipped_rows, true as passed from orders",
    "merge_left": """with o as (select o_custkey, count(*) as n, max(o_totalprice) as top, max(o_orderpriority) as note from orders where o_totalprice > 150000 group by 1)
select c_custkey as key, coalesce(note, c_name) as note, c_name as last, c_acctbal + coalesce(top, 0) as sum, least(c_acctbal, top) as low, greatest(c_acctbal, top) as high, (case when n is null then 0 else 2 end)::bigint as found from customer left join o on c_custkey = o_custkey""",
    "merge_inner": "select c_custkey as key, count(*) as n from customer join orders on c_custkey = o_custkey where o_totalprice > 150000 group by 1",
    "merge_inner_skipped": "select c_custkey as row_number, 'No merge match in o' as reason from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 150000)",
    "merge_key_errors": """with a as (select o_orderkey, nullif(o_custkey % 700, 3) as k from orders) select 'a' as input_name, o_orderkey as row_number, 'missing_key' as rule from a where k is null
union all select 'a', o_orderkey, 'duplicate_key' from (select *, count(*) over (partition by k) as n from a) where n > 1""",
    "union_all_keyed": "select n_nationkey as id, n_name as name from nation",
    "union_key_errors": "with u as (select 'a' as i, n_nationkey as r, n_nationkey as id from nation where n_nationkey < 12 union all select 'b', n_nationkey, n_nationkey - 5 from nation where n_nationkey >= 5) select i as input_name, r as row_number, 'duplicate_key' as rule, 'duplicate union key: ' || id as message from (select *, count(*) over (partition by id) as n from u) where n > 1",
    "reference_key_errors": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1",
    "unpivot_keep_null": _UNPIVOT,
    "unpivot_drop_null": _UNPIVOT + " where amount is not null",
    "aggregate_group": """with o as (select *, case when o_orderkey % 2 = 0 then null else 'k' || o_orderkey end as note from orders) select o_orderstatus as status, o_orderpriority as priority, sum(o_custkey)::bigint as total, count(*) as rows, count(note) as notes, min(o_totalprice) as low, max(o_totalprice) as high,
min(o_orderdate) as from_date, arg_min(note, o_orderkey) filter (note is not null) as first_note, arg_max(note, o_orderkey) filter (note is not null) as last_note from o group by 1, 2""",
    "aggregate_errors": "select o_orderkey as row_number, 'input_validation' as stage, 's' as field, 'missing_group_key' as rule from orders where o_orderstatus = 'P' union all select o_orderkey, 'aggregate', 'v', 'sum' from orders where o_orderstatus <> 'P' and o_orderkey % 50 = 0",
    "match_group_ids": _MATCH.format("id"),
    "match_no_singletons": _MATCH.format("case when n > 1 then id end"),
    "consolidate_parent": "select o_custkey as cust, arg_max(o_orderpriority, o_orderkey) as last_prio, sum(round(o_totalprice * 100)::bigint)::bigint as total, count(*) as n, arg_min(o_orderstatus, o_orderkey) as status from orders group by o_custkey",
    "consolidate_child": "select o_orderkey as key, o_custkey as cust, sum(round(o_totalprice * 100)::bigint) over (partition by o_custkey)::bigint as total from orders",
    "consolidate_conflict": "select o_orderkey as row_number, 'consolidate' as stage, 'status' as field, 'require_same_conflict' as rule from orders where o_custkey in (select o_custkey from orders group by 1 having count(distinct o_orderstatus) > 1)",
    "profile_columns": _profile_sql(),
    "profile_top_values": "select 'c_mktsegment' as field, row_number() over (order by n desc, f) as rank, v as value, n from (select c_mktsegment as v, count(*) as n, min(c_custkey) as f from customer group by 1) qualify rank <= 5",
}


def queries() -> dict:
    plain = (scan_project_source_value, filter_include_exclude, skip_report, condition_nulls, map_default, map_error_report, when_case, concat_pystr, generate_id, lookup_single, lookup_composite, lookup_error_report, expr_arith, expr_floor_mod_pow, expr_round_abs_min_max, expr_missing_error_report, expr_missing_survivors, derived_dag, multiple_outputs, normalize_trim_commas_currency, normalize_nfkc, casts, limit_input, validate_rules, validate_survivors, validate_output, validate_referential_integrity, checks_row_accounting, merge_left, merge_inner, merge_inner_skipped, merge_key_errors, union_all_keyed, union_key_errors, reference_key_errors, unpivot_keep_null, unpivot_drop_null, aggregate_group, aggregate_errors, consolidate_parent, consolidate_child, consolidate_conflict, profile_columns, profile_top_values,
             frame_join_numbered, frame_groupby_numbered, error_rows_whole, skipped_rows_whole, policy_statuses, profile_samples)
    found = {"flagship_migration": flagship} | {f.__name__: f for f in plain}
    found |= {"lookup_missing_default": _lookup_missing({"on_missing": "default", "default": "nobody"}), "lookup_missing_empty": _lookup_missing({"on_missing": "empty"}), "lookup_missing_null": _lookup_missing({"on_missing": "null"})}
    return found | {"match_group_ids": _match(True), "match_no_singletons": _match(False)}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
