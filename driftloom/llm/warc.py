"""Operator 9: web archives. Pages are written as WARC records and read back, segments put together again.

Writing: each page is a response record, an HTTP message in chunked transfer framing; of pages with equal payloads the
one with the largest page_id is the response and the others are revisit records without a body. A block longer than
``SEGMENT`` bytes is split: the first record has segment number 1, continuation records name it as their origin, and
the last one has the total length. The record text goes through Spark's text sink (gzip, one file per partition), whose line separator is
the blank line that ends a record, so writing is committed by Spark and a lost task is run again.

Reading: lines of gzip files, which Spark never splits, stream through a parser that goes by Content-Length, so memory is one
record. Continuation records are grouped by their origin and ordered by segment number; the total length must hold.
Then the transfer framing is decoded. The digest in the header is checked against the payload that was read.

Defined results: a null html is an empty payload; a null url gives no target; null page_ids lose to others, and
without any other all are responses; rows that repeat the largest page_id are all responses; an empty table gives no rows;
other columns are not read. Damaged segments (missing, or of another total length) raise an error that names the record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, prepare, shared_folder, table

#: Bytes of a record's block, of a transfer chunk, and the least payload that is looked up among equal ones.
SEGMENT, CHUNK, MIN_BYTES = 16 << 10, 8 << 10, 0
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a parsed record is: a whole page, or (with ``part``) a segment of one.
_PAGE = "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_PARSED = f"key string, {_PAGE}, part struct<type:string,page_id:long,uri:string,digest:string,segment:int,total:long,block:binary>"


def _head(kind: str, fields: list[tuple[str, object]], length: int) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a transfer chunk has no end")
        at = end + 4 + n


def _name(page: int | None, digest: str, segment: int = 1) -> str:
    """A record's id: a UUID of the page, its payload and the segment."""
    text = f"page:{'none' if page is None else page}:{digest}:{segment}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(text.encode()).digest()[:16], version=5)}>"


def page_records(page: int | None, url: str | None, payload: bytes, refers: int | None, segment: int, chunk: int) -> Iterator[bytes]:
    """The records of one page, without the blank line that ends each; refers: the response's page, for a revisit."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    own = [("WARC-Record-ID", _name(page, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Page-ID", page), ("Content-Type", "application/http;msgtype=response")]
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _head("revisit", [*own, ("WARC-Refers-To", _name(refers, digest)), ("WARC-Refers-To-Page-ID", refers), ("WARC-Profile", _PROFILE)], len(block)) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + _chunked(payload, chunk)
    if len(block) <= segment:
        yield _head("response", own, len(block)) + block
        return
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    yield _head("response", [*own, ("WARC-Segment-Number", 1)], len(parts[0])) + parts[0]
    for k, part in enumerate(parts[1:], 2):
        later = [("WARC-Record-ID", _name(page, digest, k)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", _name(page, digest)), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)]
        yield _head("continuation", later, len(part)) + part


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, chunk: int = CHUNK, min_bytes: int = MIN_BYTES) -> None:
    """Write page_id, url, html as archives; decide responses and revisits by equal payloads."""
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha"))
    sizes = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("best"))
    shared = cut(sizes.where("n > 1"))
    # Pages without a twin need no lookup. Payloads that many pages share are few (each has 1 / HOT_SHARE of those pages at least) and are broadcast.
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r["sha"] for r in shared.where(F.col("n") > max(200, total // HOT_SHARE)).select("sha").collect()]
    is_hot = F.col("sha").isin(hot) if hot else F.lit(False)
    joined = rows.where(~is_hot).join(shared.where(~is_hot), "sha", "left")
    if hot:
        joined = joined.unionByName(rows.where(is_hot).join(F.broadcast(shared.where(is_hot)), "sha", "left"))
    refers = F.when(F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best")), F.col("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: driftloom\r\nformat: WARC File Format 1.1"
        yield pa.RecordBatch.from_arrays([pa.array([_head("warcinfo", [("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], len(info)) + info], pa.binary())], ["value"])
        for batch in batches:
            out, size = [], 0
            for page, url, body, best in zip(*(batch.column(k) for k in ("page_id", "url", "payload", "refers")), strict=True):
                for record in page_records(page.as_py(), url.as_py(), body.as_buffer().to_pybytes(), best.as_py(), segment, chunk):
                    out.append(record)
                    size += len(record)
                if size > HANDED:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    records = joined.select("page_id", "url", "payload", refers.alias("refers")).mapInArrow(run, "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", _END).option("compression", "gzip").mode("overwrite").text(path)


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for x in lines[1:]:
        k, _, v = x.decode("utf-8", "replace").partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


#: Bytes of blocks that are handed on at once, and rows that are decoded at once.
HANDED, DECODED = 4 << 20, 128


def _page(key: str, kind: str, page: int | None, uri: str | None, digest: str | None, refers: int | None, block: bytes, with_payload: bool) -> tuple:
    """A page from its whole block: the transfer framing is decoded and the digest checked."""
    head, _, body = block.partition(b"\r\n\r\n")
    said = _fields(head.split(b"\r\n"))
    if kind != "response":
        return key, page, uri, _number(said.get("content-length")), digest, kind, refers, None, None
    payload = dechunk(body) if said.get("transfer-encoding") == "chunked" else body
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest not in (None, found):
        raise ValueError(f"{key}: the payload has another digest")
    return key, page, uri, len(payload), found, kind, refers, payload if with_payload else None, None


def _record(f: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    key, kind, segment = f.get("warc-record-id"), f.get("warc-type"), _number(f.get("warc-segment-number"))
    page, uri, digest = _number(f.get("warc-page-id")), f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if segment is None and kind != "continuation":
        return _page(key, kind, page, uri, digest, _number(f.get("warc-refers-to-page-id")), block, with_payload)
    part = {"type": kind, "page_id": page, "uri": uri, "digest": digest, "segment": segment, "total": _number(f.get("warc-segment-total-length")), "block": block}
    return f.get("warc-segment-origin-id") or key, None, None, None, None, None, None, None, part


def _parse(with_payload: bool):
    """Lines (file, value), in order, to parsed records. State between lines: header lines, or the block so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, head, fields, block, left = None, [], None, [], 0
        for batch in batches:
            out: list[tuple] = []
            size = 0
            names = batch.column("file").to_pylist()
            for name, value in zip(names, batch.column("value"), strict=True):
                if name != file:
                    if fields is not None:
                        raise ValueError(f"{file} ends inside a record")
                    file, head = name, []
                line = value.as_buffer().to_pybytes()
                if fields is None:
                    line = line.removesuffix(b"\r")
                    if line:
                        head.append(line)
                        continue
                    if not head:
                        continue  # between records
                    if not head[0].startswith(b"WARC/"):
                        raise ValueError(f"{file}: a record begins with {head[0][:40]!r}")
                    fields, head, block = _fields(head), [], []
                    left = int(fields["content-length"])
                    if left:
                        continue
                else:
                    block.append(line[:left] if len(line) > left else line)
                    left -= len(line)
                    if left > 0:
                        block.append(b"\n")
                        left -= 1
                if left <= 0 and fields is not None:
                    if fields.get("warc-type") in ("response", "revisit", "continuation"):
                        whole = b"".join(block)
                        out.append(_record(fields, whole, with_payload))
                        size += len(whole)
                    fields, block = None, []
                    if size > HANDED:
                        yield _rows(out, _PARSED)
                        out, size = [], 0
            yield _rows(out, _PARSED)
        if fields is not None:
            raise ValueError(f"{file} ends inside a record")

    return run


def _rows(rows: list[tuple], columns: str) -> pa.RecordBatch:
    schema = _arrow(columns)
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


@cache
def _arrow(columns: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    names = columns.partition(", part struct<")
    flat = [pa.field(*(f(x) for f, x in zip((str, kinds.get), c.split(), strict=True))) for c in names[0].split(", ")]
    inner = [pa.field(*(f(x) for f, x in zip((str, kinds.get), c.split(":"), strict=True))) for c in names[2].removesuffix(">").split(",") if c]
    return pa.schema([*flat, pa.field("part", pa.struct(inner))] if inner else flat)


def _joined(with_payload: bool):
    """Put the segments of a page in order, check the total, and decode the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, DECODED) for b in batches for i in range(0, max(1, b.num_rows), DECODED)):
            out = []
            for row in batch.to_pylist():
                groups: dict[int, list[dict]] = {}
                for p in row["parts"]:
                    groups.setdefault(p["segment"] or 1, []).append(p)
                copies = len(groups.get(1, []))  # rows that repeat a page repeat all its records
                if sorted(groups) != list(range(1, len(groups) + 1)) or any(len(g) != copies for g in groups.values()):
                    raise ValueError(f"{row['key']}: segments {sorted(groups)} are not complete")
                block = b"".join(groups[k][0]["block"] for k in sorted(groups))
                total = groups[len(groups)][0]["total"]
                if (len(groups) > 1) != (total is not None) or total not in (None, len(block)):
                    raise ValueError(f"{row['key']}: {len(block)} bytes where the last segment says {total}")
                first = groups[1][0]
                out += [_page(row["key"], first["type"], first["page_id"], first["uri"], first["digest"], None, block, with_payload)[1:-1]] * copies
            yield _rows(out, _PAGE)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """(page_id, uri, payload_bytes, payload_digest, record_type, refers_to, payload) of gzip archives.

    A revisit's payload is null, as all are without ``with_payload``. Archives are parsed once: what comes of it, the
    pages and the segments that are still to be joined, is stored. Of repeated rows a group holds one page's segments.
    """
    prepare(spark)
    lines = spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("value"))
    parsed = cut(lines.mapInArrow(_parse(with_payload), _PARSED))
    whole = parsed.where("part is null").drop("key", "part")
    split = parsed.where("part is not null").groupBy("key").agg(F.collect_list("part").alias("parts"))
    return whole.unionByName(split.mapInArrow(_joined(with_payload), _PAGE))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op9_warc": op9_warc}
ORACLES = {
    "op9_warc": """
with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as sha, max(page_id) over (partition by coalesce(html, '')) as best from pages),
b as (select *, (unhex(sha)::bit)::varchar as bits from p)
select page_id, octet_length(encode(body))::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i::int + 1, 1)::int + 8 * substr(bits, 5 * i::int + 2, 1)::int
    + 4 * substr(bits, 5 * i::int + 3, 1)::int + 2 * substr(bits, 5 * i::int + 4, 1)::int + substr(bits, 5 * i::int + 5, 1)::int, 1)), '') as payload_digest,
  case when page_id = best then 'response' else 'revisit' end as record_type, case when page_id <> best then best end::bigint as refers_to
from b"""
}
