"""WARC archives: writing pages as segmented, chunked records, and reading them back by segment reassembly."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A record's block holds so many bytes at most; the rest goes on in continuation records. A chunk of the HTTP message likewise.
SEGMENT_BYTES, CHUNK_BYTES = 32 << 10, 8 << 10
#: An archive file is closed once it holds so many bytes.
ARCHIVE_BYTES = 16 << 20
DATE = "2020-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(row: int, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'row:{row}:{segment}')}>"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """payload in HTTP's chunked transfer coding."""
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[k : k + size] for k in range(0, len(payload), size))) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body: chunk extensions and trailers are passed over; a cut or malformed one is an error."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk of the wrong length")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head) else body


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


def page_records(row: int, page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None = None, refers_row: int | None = None) -> Iterator[bytes]:
    """A row's records, gzip members: a response in as many segments as it takes, or a revisit of another row's page. A null page id has no header."""
    target = re.sub(r"[\r\n]", " ", url or "")
    common_headers = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), *([] if page is None else [("X-Page-Id", page)])]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(row)), *common_headers, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_row)), ("X-Refers-To-Page-Id", refers), ("X-Payload-Length", len(payload)), ("Content-Type", "application/http;msgtype=response")], http)
        return
    block = http + chunked(payload)
    parts = [block[k : k + SEGMENT_BYTES] for k in range(0, len(block), SEGMENT_BYTES)]
    for k, part in enumerate(parts, 1):
        own = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", record_id(row, k)), *common_headers, ("WARC-Block-Digest", f"sha1:{base32_sha1(part)}")]
        if len(parts) > 1:
            own.append(("WARC-Segment-Number", k))
        if k > 1:
            own.append(("WARC-Segment-Origin-ID", record_id(row)))
            if k == len(parts):
                own.append(("WARC-Segment-Total-Length", len(block)))
        yield _record([*own, ("Content-Type", "application/http;msgtype=response")], part)


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive of gzip members, or of a plain one."""
    for raw in _members(data):
        at = 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            version, *lines = raw[at:end].decode("utf-8").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError("not a WARC record")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            size = int(headers["content-length"])
            if len(raw) < end + 4 + size:
                raise ValueError("a record is cut short")
            yield headers, raw[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def _members(data: bytes, step: int = 32 << 10) -> Iterator[bytes]:
    """The gzip members of data, unpacked; fed in steps, as what is left unused of a call is copied."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut short")
            parts.append(member.decompress(data[at : at + step]))
            at += step
        at = min(at, len(data)) - len(member.unused_data)
        yield b"".join(parts)


def duplicates(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(row, page_id, url, html, refers_to, refers_row): of pages with equal payloads of least_bytes or more those with the largest id are kept, the others refer to one.

    Payloads are equal when both SHA-1 and SHA-256 of their bytes are. Every row has a number of its own, so repeated ids are rows like any
    others; a null id is less than any, and rows of null ids only are all kept. Rows are written once with their numbers and
    digests. Partial maxima leave one row a task for each payload; the join's hot payloads are split by adaptive execution.
    """
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.concat(F.sha1(body), F.sha2(body, 256)).alias("_key"), F.octet_length(F.coalesce(F.col("html"), F.lit(""))).alias("_n"), F.monotonically_increasing_id().alias("row"))
    keyed = common.persisted(keyed, "pages")
    most = keyed.where(F.col("_n") >= least_bytes).groupBy("_key").agg(F.max(F.struct("page_id", "row")).alias("_to"), F.count(F.lit(1)).alias("_c")).where("_c > 1 and _to.page_id is not null").drop("_c")
    # Written, so that the join exchanges both sides and adaptive execution can split a hot payload.
    most = common.persisted(most, "payloads")
    other = F.col("_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_to.page_id"))
    return keyed.join(most, "_key", "left").select("row", "page_id", "url", "html", F.when(other, F.col("_to.page_id")).alias("refers_to"), F.when(other, F.col("_to.row")).alias("refers_row"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Archives of pages (page_id, url, html) under folder: their index (file, bytes), committed by Spark, names the attempts that count.

    Each row is a record, repeated and null ids too. Null html is empty. A file is closed once it holds ARCHIVE_BYTES, so one record
    may make it larger.
    """
    common.prepare(pages.sparkSession)
    rows = duplicates(pages, least_bytes)

    def run(batches):
        out: list[bytes] = []
        size = 0

        def flush():
            nonlocal out, size
            name = f"{folder}/archives/{uuid.uuid4().hex}.warc.gz"
            info = gzip.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), 1, mtime=0)
            data = b"".join([info, *out])
            common.write_file(name, data)
            out, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)])], ["file", "bytes"])

        for row, page, url, html, refers, refers_row in common.rows(batches, "row", "page_id", "url", "html", "refers_to", "refers_row"):
            payload = (html or "").encode()
            for record in page_records(row, page, url, payload, base32_sha1(payload), refers, refers_row):
                out.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if out:
            yield flush()

    index = rows.mapInArrow(run, "file string, bytes long")
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


PARSED = "page_id long, origin string, segment long, total long, type string, digest string, refers_to long, length long, block binary"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def parse(index: DataFrame) -> DataFrame:
    """Records of the archives: whole responses with their payload's length and checked digest, revisits, and the segments of others with their blocks."""

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("type", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("length", pa.int64()), ("block", pa.binary())])
        out: list[dict] = []
        size = 0
        for (file,) in common.rows(batches, "file"):
            for h, block in records(common.read_file(file)):
                kind = h["warc-type"]
                if kind not in ("response", "revisit", "continuation"):
                    continue
                number = int(h["warc-segment-number"]) if "warc-segment-number" in h else None
                row = {"page_id": int(h["x-page-id"]) if "x-page-id" in h else None, "origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "segment": number, "total": int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, "type": kind, "digest": h["warc-payload-digest"].removeprefix("sha1:"), "refers_to": None, "length": None, "block": None}
                if kind == "revisit":
                    row |= {"refers_to": int(h["x-refers-to-page-id"]), "length": int(h["x-payload-length"])}
                elif number is None:
                    payload = payload_of(block)
                    if base32_sha1(payload) != row["digest"]:
                        raise ValueError(f"page {row['page_id']}: the payload's digest differs")
                    row["length"] = len(payload)
                else:
                    if h["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"page {row['page_id']}: the block's digest differs")
                    row["block"] = block
                    size += len(block)
                out.append(row)
                if len(out) >= 4096 or size >= 16 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    n = common.partitions(index.sparkSession)
    return index.select("file").repartition(n, "file").mapInArrow(run, PARSED)


def reassemble(segments: DataFrame) -> DataFrame:
    """One row for each segmented record: segments grouped by origin, ordered by number, their total length checked, the body unchunked.

    A group is one record, so it is as large as a record. Repeated copies of a segment count once. A record with a missing
    segment, no total, or another length is an error.
    """

    def join(key, pdf):
        import pandas as pd

        parts = {int(n): b for n, b in zip(pdf["segment"], pdf["block"], strict=True)}
        total = pdf["total"].max()
        block = b"".join(bytes(parts[n]) for n in sorted(parts))
        if pd.isna(total) or sorted(parts) != list(range(1, len(parts) + 1)) or len(block) != total:
            raise ValueError(f"record {key[0]}: segments are missing or of the wrong length")
        payload = payload_of(block)
        digest = base32_sha1(payload)
        if digest != pdf["digest"].iloc[0]:
            raise ValueError(f"record {key[0]}: the payload's digest differs")
        page = pdf["page_id"].iloc[0]
        return pd.DataFrame({"page_id": pd.array([None if pd.isna(page) else int(page)], "Int64"), "payload_bytes": [len(payload)], "payload_digest": [digest], "record_type": ["response"], "refers_to": pd.array([None], "Int64")})

    return segments.groupBy("origin").applyInPandas(join, RESULT)


def read(index: DataFrame) -> DataFrame:
    """One row for each page's record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The archives are parsed once; the records' rows, with segments' blocks, are written before they part ways.
    """
    rows = common.persisted(parse(index), "records")
    whole = rows.where("block is null").select("page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
    return whole.unionByName(reassemble(rows.where("block is not null").select("origin", "segment", "total", "block", "digest", "page_id")))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """read(write(pages)) in a new shared folder: one row for each row of pages, with repeated and null ids too. An empty table gives none."""
    return read(write(pages, common.work_dir(pages.sparkSession, "warc"), least_bytes))


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Base 32 of a SHA-1 in hexadecimal: 32 groups of 5 of its 160 bits.
SQL = f"""
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select page_id, strlen(h) as payload_bytes, sha1(h) as hex, max(page_id) over (partition by h) as top from p),
b as (select *, list_aggregate(list_transform(range(0, 40), lambda i: lpad(bin(('0x' || substr(hex, i::int + 1, 1))::int), 4, '0')), 'string_agg', '') as bits from g)
select page_id, payload_bytes::bigint as payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('{BASE32}', (list_sum(list_transform(range(0, 5), lambda j: substr(bits, (i * 5 + j)::int + 1, 1)::int * (1 << (4 - j)::int))))::int + 1, 1)), 'string_agg', '') as payload_digest,
       case when top is null or page_id = top then 'response' else 'revisit' end as record_type, case when page_id = top then null else top end as refers_to
from b
"""
