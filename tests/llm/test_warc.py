"""WARC archives: framing, segments, revisits."""

import base64
import hashlib
import random

import pytest

from quillspark.llm import common, warc
from tests.llm.conftest import got

PAGES = "page_id long, url string, html string, digest string, file int"


@pytest.mark.parametrize("size", [0, 1, 8191, 8192, 8193, 100_000])
def test_framing(size):
    data = random.Random(size).randbytes(size)
    assert warc.unchunked(warc.chunked(data)) == data
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"3;x=1\r\nabc\r\n0\r\nTrailer: y\r\n\r\n"
    assert warc.payload_of(block) == b"abc"
    assert warc.payload_of(b"HTTP/1.1 200 OK\r\n\r\n3\r\nabc") == b"3\r\nabc"


def test_bad_framing():
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.records(b"HTTP/1.1 200\r\n\r\n"))


def test_records_are_read_as_written():
    payload = b"x\r\n\r\nWARC/1.1" * 9000
    data = b"".join(warc.page_records(0, 7, "http://a\r\nb", payload, warc.base32_sha1(payload)))
    rows = list(warc.records(data))
    assert [h["warc-type"] for h, _ in rows] == ["response"] + ["continuation"] * (len(rows) - 1) and len(rows) > 2
    assert rows[-1][0]["warc-segment-total-length"] == str(sum(len(b) for _, b in rows))
    assert warc.payload_of(b"".join(b for _, b in rows)) == payload
    plain = b"".join(warc._members(data))
    assert list(warc.records(plain)) == rows
    with pytest.raises(ValueError):
        list(warc.records(data[:-5]))


def expected(pages):
    top: dict = {}
    for i, h in pages.items():
        top[h or ""] = max(i, top.get(h or "", i))
    return {i: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if top[h or ""] == i else "revisit", None if top[h or ""] == i else top[h or ""]) for i, h in pages.items()}


def test_round_trip(spark):
    pages = {k: random.Random(k % 20).choice(["<p>é</p>", "x" * 90_000, "y" * 40_000 + str(k % 3), "", None]) for k in range(120)}
    df = spark.createDataFrame([(k, "http://h/" if k % 2 else None, h, "d", 1) for k, h in pages.items()], PAGES)
    out = warc.round_trip(df)
    assert got(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected(pages)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_small_pages_stay_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab", "", 0), (2, "u", "ab", "", 0), (3, "u", "abcdef", "", 0), (4, "u", "abcdef", "", 0)], PAGES)
    out = got(warc.round_trip(df, least_bytes=4), "page_id", "record_type", "refers_to")
    assert out == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}


def test_repeated_and_null_ids(spark):
    """Every row is a record: repeated ids with equal and other payloads, null ids, segmented ones among them."""
    long = "s" * 90_000
    rows = [(1, "a"), (1, "b"), (1, "a"), (None, "a"), (None, "c"), (None, "c"), (2, "a"), (3, long), (3, long), (None, long), (2**62 + 1, "")]
    df = spark.createDataFrame([(i, "u", h, "", 0) for i, h in rows], PAGES)
    top = {h: max((i for i, g in rows if g == h and i is not None), default=None) for _, h in rows}
    key = lambda r: tuple(-1 if x is None else x for x in r)
    want = [(i, len(h), *(("response", None) if top[h] in (None, i) else ("revisit", top[h]))) for i, h in rows]
    out = warc.round_trip(df).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted(map(key, out)) == sorted(map(key, want))


def test_sql_agrees_on_odd_rows(spark):
    import duckdb
    import pandas as pd

    pages = pd.DataFrame({"page_id": pd.array([1, 1, 2, None, None, None, 3], "Int64"), "html": ["a", "a", "a", "a", "b", "b", None]})  # noqa: F841
    want = duckdb.sql(warc.SQL).fetchall()
    df = spark.createDataFrame([(1, "u", "a", "", 0), (1, "u", "a", "", 0), (2, "u", "a", "", 0), (None, "u", "a", "", 0), (None, "u", "b", "", 0), (None, "u", "b", "", 0), (3, "u", None, "", 0)], PAGES)
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, warc.round_trip(df).collect())) == sorted(map(key, want))


def test_a_page_larger_than_an_archive(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1000)
    pages = {k: "".join(random.Random(k).choices("abcdefgh", k=n)) for k, n in enumerate((10, 200_000, 10, 70_000))}
    out = warc.round_trip(spark.createDataFrame([(k, None, h, "d", 1) for k, h in pages.items()], PAGES))
    assert got(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == {k: (len(h), warc.base32_sha1(h.encode()), "response", None) for k, h in pages.items()} | {2: (10, warc.base32_sha1(pages[2].encode()), "response", None)}


def test_missing_segments_are_errors(spark):
    df = spark.createDataFrame([(1, "u", "z" * 100_000, "", 0)], PAGES)
    rows = warc.parse(warc.write(df, common.work_dir(spark, "warc")))
    for hole in ("segment <> 2", "total is null"):
        with pytest.raises(Exception, match="segments are missing"):
            warc.reassemble(rows.where(hole).select("origin", "segment", "total", "block", "digest", "page_id")).collect()
