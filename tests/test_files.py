import csv
import json

import pytest
import yaml
from pyspark.sql import functions as F

from driftloom import cli
from driftloom.config.loader import kind_of, load
from driftloom.config.models import ConfigError, Input, build
from driftloom.plans.execute import execute_job, execute_migration, run_all
from driftloom.sinks import files
from driftloom.sinks.files import SinkError, atomic
from driftloom.sources import scan
from driftloom.tools import design, generate, preflight, wizards, xlsx

HANDLING = {"error_output": "reports/errors.csv", "skipped_output": "reports/skipped.csv"}


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))
    return path


def source(path, **more):
    problems = []
    out = build(Input, {"path": path, **more}, "x", problems)
    assert not problems
    return out


def read(path, encoding="utf-8-sig"):
    with open(path, encoding=encoding, newline="") as f:
        return list(csv.reader(f))


def test_scan(spark, tmp_path):
    put(tmp_path / "a.csv", '﻿id,顧客,amount,day\n1,"a ""q"", x\ny", "¥1,000" ,2024-01-02\nNA,null,,\n3,b,2,2024/1/5\n')
    schema = {"key": {"source_columns": ["nope", "id"]}, "name": {"source_columns": ["顧客"]}, "amount": {"type": "decimal", "normalize": ["trim", "remove_commas", "remove_currency_symbol"]}, "day": {"type": "date"}, "absent": {"type": "integer"}}
    put(tmp_path / "b.csv", '﻿id,顧客,amount,day\n1,"a ""q"", x\ny","¥1,000",2024-01-02\nNA,null,,\n3,b,2,2024/1/5\n')
    got = scan.load(spark, source("b.csv", schema=schema), tmp_path)
    rows = [(r["key"], r["name"], r["amount"], str(r["day"]), r["absent"], r[scan.ROW]) for r in got.df.orderBy(scan.ROW).collect()]
    assert rows == [("1", 'a "q", x\ny', 1000.0, "2024-01-02 00:00:00", None, 1), (None, None, None, "None", None, 2), ("3", "b", 2.0, "2024-01-05 00:00:00", None, 3)]
    assert scan.load(spark, source("b.csv"), tmp_path, limit=1).df.count() == 1


def test_whole_decimals_stay_whole(spark, tmp_path):
    put(tmp_path / "a.csv", "x,y\n1,1\n2,2.5\n")
    got = scan.load(spark, source("a.csv", schema={"x": {"type": "decimal"}, "y": {"type": "decimal"}}), tmp_path)
    assert got.types == {"x": "integer", "y": "decimal"}


@pytest.mark.parametrize(("more", "text"), [
    ({"schema": {"x": {"type": "integer"}}}, "cannot convert to integer: 'a', 'b'"), ({"schema": {"q": {"required": True}}}, "required column is missing"), ({"header": False}, "header: false"), ({"path": "none.csv"}, "not found"),
])
def test_load_errors(spark, tmp_path, more, text):
    put(tmp_path / "a.csv", "x\na\n1\nb\n")
    with pytest.raises(scan.LoadError, match=text):
        scan.load(spark, source(**{"path": "a.csv", **more}), tmp_path)


def test_limits_and_keys(spark, tmp_path):
    put(tmp_path / "a.csv", "k,l\n1,a\n1,a\n2,\n")
    with pytest.raises(scan.LoadError, match="limit of 2"):
        scan.load(spark, source("a.csv"), tmp_path, max_rows=2)
    got = scan.load(spark, source("a.csv"), tmp_path)
    with pytest.raises(scan.LoadError, match="duplicate key at rows: 1, 2"):
        scan.check_keys(got, "r", ["k"])
    with pytest.raises(scan.LoadError, match="missing at rows: 3"):
        scan.check_keys(got, "r", ["k", "l"])


@pytest.mark.parametrize("encoding", ["cp932", "utf-8-sig", "utf-16"])
def test_encodings(spark, tmp_path, encoding):
    put(tmp_path / "a.csv", "id;名\n1;山田\n", encoding)
    got = scan.load(spark, source("a.csv", encoding=encoding, delimiter=";"), tmp_path)
    assert [r["名"] for r in got.df.collect()] == ["山田"]


def test_rows_are_numbered_over_many_partitions(spark):
    df = spark.range(1000).repartition(13)
    assert sorted(r[scan.ROW] for r in scan.numbered(df).collect()) == list(range(1, 1001))


CONFIG = {
    "version": 1, "project": {"name": "p"}, "inputs": {"u": {"path": "in.csv", "schema": {"id": {}, "n": {"type": "integer"}, "d": {"type": "date"}}}}, "references": {"r": {"path": "ref.csv", "key": "code"}},
    "outputs": {"o": {"path": "out/o.csv", "columns": ["id", "half", "name", "d"], "newline": "\r\n"}}, "mappings": {"o": {"id": {"source": "u.id"}, "half": {"expression": "u.n / 2"}, "name": {"lookup": {"reference": "r", "key": "u.id", "value": "name"}}, "d": {"source": "u.d"}}},
    "filters": {"exclude": [{"if": "u.n > 100", "reason": "big <b>"}]}, "checks": [{"name": "all", "rule": "input_rows == output_rows + error_rows + skipped_rows"}], "error_handling": HANDLING, "runtime": {"run_id": "R1"},
}


def job(tmp_path, config=CONFIG, name="m.yml"):
    put(tmp_path / "in.csv", "id,n,d\na,1,2024-01-02\nb,500,\nc,3,2024-05-06\n")
    put(tmp_path / "ref.csv", "code,name\na,Ä, \nb,B\n".replace(", ", ""))
    return put(tmp_path / name, yaml.safe_dump(config))


def test_migration_files(spark, tmp_path):
    out = execute_migration(spark, job(tmp_path), page=True)
    assert out.status == "completed" and out.counts == {"input_rows": 3, "output_rows": 1, "error_rows": 1, "skipped_rows": 1}
    assert (tmp_path / "out/o.csv").read_bytes() == "﻿id,half,name,d\r\na,0.5,Ä,2024-01-02\r\n".encode()
    errors = read(tmp_path / "reports/errors.csv")
    assert errors[0] == ["run_id", "row_number", "stage", "output_name", "field", "rule", "message", "row_json"] and errors[1][:6] == ["R1", "3", "mapping", "o", "lookup missing", "lookup_missing"]
    assert json.loads(errors[1][7]) == {"__row_number": 3, "id": "c", "n": 3, "d": "2024-05-06"}
    assert [r[1:3] for r in read(tmp_path / "reports/skipped.csv")] == [["row_number", "reason"], ["2", "big <b>"]]
    summary = json.loads((tmp_path / "reports/summary.json").read_text())
    assert summary["counts"]["lookup_missing_errors"] == 1 and summary["notes"]["final_outcome"] == "completed_with_row_errors" and summary["outputs"][0]["file_written"]
    page = (tmp_path / "reports/report.html").read_text()
    assert "big &lt;b&gt;" in page and "<b>" not in page
    with pytest.raises(SinkError, match="already exists"):
        execute_migration(spark, tmp_path / "m.yml")


def test_dry_run_writes_nothing_and_stop_leaves_no_output(spark, tmp_path):
    path = job(tmp_path)
    steps = []
    out = execute_migration(spark, path, dry_run=True, write_reports=False, progress=lambda s, p: steps.append(p))
    assert steps == sorted(steps) and steps[-1] == 100 and [r["id"] for r in out.preview["o"]] == ["a"]
    assert out.status == "dry_run_completed" and not (tmp_path / "out").exists() and not (tmp_path / "reports").exists()
    path = job(tmp_path, CONFIG | {"error_handling": HANDLING | {"on_lookup_missing": "stop"}})
    out = execute_migration(spark, path)
    assert out.status == "failed" and out.summary["notes"]["stop_reason"] == "lookup_missing" and not (tmp_path / "out").exists()


def test_atomic_leaves_nothing_of_a_failure(tmp_path):
    put(tmp_path / "a.txt", "old")
    with pytest.raises(RuntimeError):
        atomic(tmp_path / "a.txt", lambda f: (f.write("new"), (_ for _ in ()).throw(RuntimeError()))[1].__next__())
    assert [p.name for p in tmp_path.iterdir()] == ["a.txt"] and (tmp_path / "a.txt").read_text() == "old"


AGGREGATE = {
    "version": 1, "project": {"name": "a"}, "input": {"path": "in.csv", "schema": {"id": {}, "n": {"type": "decimal"}, "d": {"type": "date"}}}, "aggregate": {"group_by": ["id"], "columns": {"id": {"group_key": "id"}, "n": {"sum": "n"}, "rows": {"count": None}}},
    "output": {"path": "out/a.csv", "columns": ["id", "n", "rows"]}, "error_handling": HANDLING,
}


def test_job_files_and_run_all(spark, tmp_path):
    job(tmp_path)
    put(tmp_path / "in.csv", "id,n,d\nb,1,\na,2,\nb,3,\n")
    path = put(tmp_path / "a.yml", yaml.safe_dump(AGGREGATE))
    out = execute_job(spark, "aggregate", path)
    assert out.ok and read(tmp_path / "out/a.csv") == [["id", "n", "rows"], ["b", "4", "2"], ["a", "2", "1"]]
    put(tmp_path / "in.csv", "id,n,d\n,1,\n")
    (tmp_path / "out/a.csv").unlink()
    bad = execute_job(spark, "aggregate", path)
    assert bad.status == "failed" and not (tmp_path / "out/a.csv").exists() and read(tmp_path / "reports/errors.csv")[1][1:6] == ["input", "1", "input_validation", "id", "missing_group_key"]
    jobs = {"version": 1, "jobs": [{"name": "one", "type": "aggregate", "config": "a.yml"}, {"name": "two", "type": "run", "config": "m.yml"}]}
    said = []
    done = run_all(spark, put(tmp_path / "all.yml", yaml.safe_dump(jobs)), said.append)
    assert [n for n, *_ in done] == ["one"] and said == ["one: failed"]
    put(tmp_path / "in.csv", "id,n,d\na,1,\n")
    assert [o.status for _, o, _ in run_all(spark, tmp_path / "all.yml", said.append)] == ["completed", "completed"]


def test_kinds_and_configuration_errors(tmp_path):
    assert kind_of({"jobs": []}) == "run-all" and kind_of({"merge": {}}) == "merge" and kind_of({"mappings": {}}) == "run"
    with pytest.raises(ConfigError, match="empty"):
        load(put(tmp_path / "e.yml", ""))
    with pytest.raises(ConfigError, match="output.columns: must be exactly"):
        load(put(tmp_path / "x.yml", yaml.safe_dump(AGGREGATE | {"output": {"path": "o", "columns": ["id"]}})))
    with pytest.raises(ConfigError, match="at least one job"):
        load(put(tmp_path / "j.yml", "version: 1\njobs: []\n"))


def test_preflight_and_inspect(tmp_path):
    path = job(tmp_path)
    assert preflight.preflight(path) == ("run", [])
    assert "reference r: ref.csv (key code)" in preflight.inspect(path)
    put(tmp_path / "ref.csv", "kode,name\n")
    put(tmp_path / "out/o.csv", "")
    kind, problems = preflight.preflight(job(tmp_path, CONFIG | {"references": {"r": {"path": "ref.csv", "key": "kode"}}, "runtime": {"max_input_rows": 2}}))
    assert any("row count" in p for p in problems) and any("already exists" in p for p in problems) and any("key column" in p for p in problems)


def test_generated_names_and_config(tmp_path):
    assert generate.safe_names(["User ID", "Name", "Name", "顧客", "2026 Amount", "", "a--b"]) == ["user_id", "name", "name_2", "field_001", "field_2026_amount", "field_002", "a_b"]
    put(tmp_path / "i.csv", "User ID;Name\n1;a\n")
    path = generate.generate_config(tmp_path / "i.csv", tmp_path / "o.csv", tmp_path / "c.yml", delimiter=";")
    config = load(path, "run")
    assert config.outputs["output"].columns == ["User ID", "Name"] and list(config.inputs["input"].schema) == ["user_id", "name"]
    with pytest.raises(ConfigError, match="overwrite"):
        generate.generate_config(tmp_path / "i.csv", tmp_path / "o.csv", tmp_path / "c.yml", delimiter=";")


def test_design(tmp_path):
    path = design.write_template(tmp_path / "d.xlsx")
    sheets = xlsx.read_workbook(path)
    assert list(sheets) == list(design.COLUMNS)
    sheets["project"].append(["Demo", "", "utf-8", ","])
    sheets["jobs"] += [["a", "merge", "1", "true", "a.yml", "b"], ["b", "migration", "1", "maybe", "b.yml", "a"], ["b", "x", "0", "no", "", "zz"]]
    sheets["checks"].append(["q", "n", "r"])
    got = design.validate_design(xlsx.write_workbook(path, sheets))
    said = [e[3] for e in got.errors]
    for text in ("duplicate order 1", "enabled must be boolean-like", "duplicate job_id 'b'", "unknown job_id 'q'", "enabled merge job requires rows in merge_inputs", "dependency cycle detected: a -> b -> a"):
        assert text in said
    design.write_results(got, tmp_path / "s.json", tmp_path / "e.csv")
    assert json.loads((tmp_path / "s.json").read_text())["error_count"] == len(got.errors) == len(read(tmp_path / "e.csv")) - 1
    assert not design.validate_design(put(tmp_path / "no.xlsx", "text")).valid


def test_wizards(tmp_path):
    put(tmp_path / "in.csv", "ID,Total Amount\n1,2\n")
    answers = {"Input CSV": str(tmp_path / "in.csv"), "Config file": str(tmp_path / "w.yml"), "Type of 'Total Amount'": "decimal"}
    assert wizards.migration_wizard(lambda q, d: answers.get(q, d), lambda x: None) == tmp_path / "w.yml"
    assert load(tmp_path / "w.yml", "run").inputs["in"].schema["total_amount"].type == "decimal"
    put(tmp_path / "b.csv", "ID,Total Amount,City\n1,2,x\n")
    answers = {"CSV of input 1": str(tmp_path / "in.csv"), "CSV of input 2": str(tmp_path / "b.csv"), "Its name": "", "Config file": str(tmp_path / "m.yml"), "Purpose (enrich, complete, sum)": "sum"}
    names = iter(["one", "two"])
    assert wizards.merge_wizard(lambda q, d: next(names) if q == "Its name" else answers.get(q, d), lambda x: None) == tmp_path / "m.yml"
    assert load(tmp_path / "m.yml").merge.columns["Total Amount"] == {"sum": ["one.Total Amount", "two.Total Amount"]}
    assert wizards.migration_wizard(lambda q, d: (_ for _ in ()).throw(wizards.Cancelled()), lambda x: None) is None


def test_command_line(tmp_path, capsys, spark):
    path = str(job(tmp_path))
    assert cli.main(["validate-config", path]) == 0 and cli.main(["inspect", path]) == 0
    assert cli.main(["run", path, "--limit", "0"]) == 2
    assert cli.main(["preflight", path]) == 0
    assert cli.main(["validate-config", str(tmp_path / "none.yml")]) == 1
    assert "kind: run" in capsys.readouterr().out
    with pytest.raises(SystemExit) as e:
        cli.main(["nothing"])
    assert e.value.code == 2
    payload = cli.profile_payload(spark, tmp_path / "m.yml")
    assert payload["rows"] == 3 and next(c for c in payload["columns"] if c["field"] == "id")["top_values"][0] == {"value": "a", "count": 1}


def test_frames_from_shuffles_keep_all_their_rows(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(200_000).select("id", *[(F.col("id") * k).cast("string").alias(f"l{k}") for k in range(1, 12)])
        right = spark.range(200_000).select("id", *[F.repeat(F.lit("x"), k).alias(f"r{k}") for k in range(1, 12)])
        for df in (left.join(right, "id"), left.groupBy("id").agg(*[F.max(f"l{k}").alias(f"m{k}") for k in range(1, 12)]), left.repartition("id")):
            got = scan.numbered(df).agg(F.count("*"), F.count_distinct(scan.ROW), F.min(scan.ROW), F.max(scan.ROW)).first()
            assert tuple(got) == (200_000, 200_000, 1, 200_000)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_large_files_are_split_unless_quotes_span_lines(spark, tmp_path):
    lines = [f'{i},"a, {i}",{"x" * 60}' for i in range(150_000)]
    put(tmp_path / "a.csv", "k,l,m\n" + "\n".join(lines) + "\n")
    lines[70_000] = '70000,"a,\n70000",y'
    put(tmp_path / "b.csv", "k,l,m\n" + "\n".join(lines) + "\n")
    one, two = (scan.raw_csv(spark, str(tmp_path / f)) for f in ("a.csv", "b.csv"))
    assert one.rdd.getNumPartitions() > 1 == two.rdd.getNumPartitions()
    for df in (one, two):
        assert df.where(F.col(scan.ROW) - 1 == F.col("k").cast("long")).count() == 150_000
    assert two.where("l like '%\n%'").count() == 1


def test_first_five_rows_of_repeated_keys_are_named(spark, tmp_path):
    put(tmp_path / "a.csv", "k\n1\n2\n1\n1\n3\n2\n1\n")
    with pytest.raises(scan.LoadError, match="rows: 1, 2, 3, 4, 6$"):
        scan.check_keys(scan.load(spark, source("a.csv"), tmp_path), "r", ["k"])


def test_targets_under_urls_and_in_folders(spark, tmp_path):
    df = spark.createDataFrame([(2, "ä "), (1, None)], "n long, s string")
    kinds = {"n": "integer", "s": "string"}
    files.write_csv(df, kinds, ["n"], f"file://{tmp_path}/x/one.csv", "utf-8-sig", newline="\r\n")
    assert (tmp_path / "x/one.csv").read_bytes() == "﻿n,s\r\n1,\r\n2,ä \r\n".encode()
    assert files.target_exists(f"file://{tmp_path}/x/one.csv") and not files.target_exists(f"file://{tmp_path}/x/two.csv")
    at = scan.resolve("out/", tmp_path)
    assert at.endswith("/out/")
    files.write_csv(df.coalesce(1), kinds, ["n"], at, "latin-1", newline="\r\n")
    assert b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))).replace(b"n,s\r\n", b"") == "1,\r\n2,ä \r\n".encode("latin-1")
