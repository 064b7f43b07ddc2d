"""Registered queries at the smallest scale against DuckDB, and the entry module without the optional parts."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from driftloom import catalog

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the shared test tables")


def shown(rows):
    f = lambda v: "null" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(f(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_duckdb(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got = catalog.queries()[name](spark, str(DATA))
    wanted = con.sql(catalog.oracle_sql()[name])
    columns = sorted(wanted.columns)
    assert sorted(got.columns) == columns
    order = [wanted.columns.index(c) for c in columns]
    assert shown(tuple(r[c] for c in columns) for r in got.collect()) == shown(tuple(r[i] for i in order) for r in wanted.fetchall())


def test_error_reports_read_their_input_once(spark):
    plan = catalog.validate_rules(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_lookups_read_the_columns_they_use(spark):
    plan = catalog.flagship(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "o_orderpriority" in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.flagship(spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    lines = next(x for x in plan.splitlines() if "l_orderkey" in x and "ReadSchema" in x)
    assert "l_comment" not in lines and "l_shipdate" not in lines.split("ReadSchema")[-1]


def test_entry_without_the_optional_parts(tmp_path):
    for name in ("driftloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "driftloom/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') for k in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
