"""Queries run from a folder where workers can't find the package by themselves."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import sys; sys.path.insert(0, sys.argv[1])
import __spark_entry__ as e
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
print("rows", e.queries()[sys.argv[2]](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="needs the shared test tables")
@pytest.mark.parametrize("name", ["op2_packing", "op10_token_files"])
def test_first_query_from_another_folder(tmp_path, name):
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != ROOT)}
    out = subprocess.run([sys.executable, "-c", CODE, str(ROOT), name], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=200)
    assert out.returncode == 0 and "rows " in out.stdout, out.stderr[-2000:]
