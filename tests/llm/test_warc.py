import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from driftloom.llm import warc

from .support import rows

SCHEMA = "page_id long, url string, html string"
BIG = "<p>ünï</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 3000
PAGES = [(1, "http://a/?x=1", "<p>same</p>"), (2, None, "<p>same</p>"), (5, "http://b/ \r\nX: y", BIG), (6, "http://c", BIG), (7, "http://d", None), (8, "http://e", ""), (9, "http://f", "a\nb\r\n\r\n"), (None, "http://g", "<p>same</p>"), (None, "http://h", "alone"), (9, "http://f", "a\nb\r\n\r\n"), (10, "u", BIG + "!"), (10, "u", BIG + "!")]


def run(spark, pages, path, **options):
    df = spark.createDataFrame(pages, SCHEMA).withColumns({c: F.lit(c) for c in ("sha", "best", "n", "value", "file")})
    warc.write_archives(df, str(path), **options)
    return rows(warc.read_archives(spark, str(path)))


def brute(pages, least=0):
    best = {}
    for p, _, h in pages:
        h = h or ""
        if p is not None and len(h.encode()) >= least:
            best[h] = max(best.get(h, p), p)
    out = []
    for p, _, h in pages:
        b = (h or "").encode()
        first = best.get(h or "")
        revisit = first is not None and p != first and sum((x[2] or "") == (h or "") for x in pages) > 1
        out.append((str(p), len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [16 << 10, 700, 1 << 30])
def test_round_trip(spark, tmp_path, segment):
    got = run(spark, PAGES, tmp_path / "w", segment=segment, chunk=512)
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(PAGES)
    assert all(bytes(r["payload"]).decode() in {h or "" for _, _, h in PAGES} for r in got if r["record_type"] == "response")


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    got = run(spark, PAGES, tmp_path / "w", min_bytes=1000)
    assert sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(PAGES, 1000)


def test_records_are_written_in_the_format(spark, tmp_path):
    run(spark, PAGES, tmp_path / "w", segment=700)
    text = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("*.gz")))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and f"WARC-Segment-Origin-ID: {warc._name(6, base64.b32encode(hashlib.sha1(BIG.encode()).digest()).decode())}".encode() in text and b"WARC-Segment-Total-Length: " in text and b"X: y" not in text.replace(b"%20%0D%0AX:%20y", b"")


def test_hot_payload_and_empty_table(spark, tmp_path):
    pages = [(i, f"http://{i}", "<p>one page for all</p>" if i % 2 else f"<p>{i}</p>") for i in range(900)]
    got = run(spark, pages, tmp_path / "w")
    assert sum(r["record_type"] == "revisit" for r in got) == 449 and {r["refers_to"] for r in got} == {None, 899}
    assert run(spark, [], tmp_path / "e") == []


def test_lost_segment_is_an_error(spark, tmp_path):
    (tmp_path / "w").mkdir()
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Segment-Number: 1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    last = b"WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Record-ID: <c>\r\nWARC-Segment-Origin-ID: <a>\r\nWARC-Segment-Number: 3\r\nWARC-Segment-Total-Length: 4\r\nContent-Length: 2\r\n\r\ncd\r\n\r\n"
    with gzip.open(tmp_path / "w" / "x.warc.gz", "wb") as f:
        f.write(head + last)
    with pytest.raises(Exception, match="not complete"):
        rows(warc.read_archives(spark, str(tmp_path / "w")))


def test_dechunk():
    assert warc.dechunk(b"3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n") == b"abcde"
