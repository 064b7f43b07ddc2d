import zlib

import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from driftloom.llm import token_files, tokens

from .support import ODD, rows, table

PATH = tokens.default_tokenizer()


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "ids")
    token_files.write_token_files(table(spark, ODD), path, PATH)
    got = sorted(rows(token_files.digests(token_files.read_token_files(spark, path))), key=lambda r: r["start"])
    t = Tokenizer.from_file(PATH)
    wanted = [(d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4")) for d, x, *_ in ODD]
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in wanted), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert r["start"] == at and any(d == r["doc_id"] and len(i) == r["n_tokens"] and zlib.crc32(i) == r["ids_crc32"] for d, i in wanted)
        at += r["n_tokens"]


def test_layout(spark, tmp_path):
    path = tmp_path / "ids"
    token_files.write_token_files(table(spark, ODD), str(path), PATH)
    group = pq.ParquetFile(max(path.glob("*.parquet"), key=lambda p: p.stat().st_size)).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    ids = next(c for n, c in columns.items() if n.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings) and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    plan = token_files.read_token_files(spark, str(path)).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[-1]


def test_empty_table(spark, tmp_path):
    token_files.write_token_files(table(spark, []), str(tmp_path / "ids"), PATH)
    assert rows(token_files.digests(token_files.read_token_files(spark, str(tmp_path / "ids")))) == []
