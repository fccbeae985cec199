"""ARC and WARC archives: round trips, both ARC versions, revisits against a plain computation."""

import base64
import gzip
import hashlib
import random
import uuid

import pytest

from shoplens.llm import archives
from shoplens.llm.shared import shared_folder

ROW = "page_id long, url string, html string, record_type string"


def plain(rows, least=0):
    first = {}
    for page, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= least and page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        lead = first.get(data) if len(data) >= least else None
        again = lead is not None and lead != page
        out.append((page, len(data), digest, "revisit" if again else "response", lead if again else None))
    return sorted(out, key=str)


def made(count=300):
    rng = random.Random(4)
    html = ["<p>é\r\n\r\nHTTP/1.1 200\n</p>", "", None, "WARC/1.0\r\n\r\n", "filedesc://x 0.0.0.0 1 text/plain 3\nabc", "x" * 50_000]
    html += [f"<p>{k}</p>" for k in range(30)]
    urls = ["http://a.example/é b?x=1#y", None, "", "http://b.example/\n"]
    rows = [(k, rng.choice(urls), rng.choice(html) if k % 3 else "<hot>", "old") for k in range(count)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("least", [0, 20])
def test_archived_pages(spark, least):
    rows = made()
    got = archives.archived(spark.createDataFrame(rows, ROW), shared_folder(spark, "t"), least).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain(rows, least)
    by_id = {r.page_id: r for r in got}
    for r in got:
        assert r.verified and uuid.UUID(r.record_id[10:-1]) and r.date == "2000-01-01T00:00:00Z"
        if r.record_type == "revisit":
            assert r.refers_to_record == by_id[r.refers_to].record_id and r.payload is None
        else:
            assert len(r.payload) == r.payload_bytes
    html = {page: (h or "").encode() for page, _, h, _ in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.payload is not None)


def test_null_ids_repeated_rows_and_empty_table(spark):
    rows = [(None, "u", "same", "x"), (5, "u", "same", "x"), (5, "u", "same", "x"), (3, None, None, "x"), (3, None, "other", "x")]
    got = archives.archived(spark.createDataFrame(rows, ROW), shared_folder(spark, "t")).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got) == [
        ("3", "response", None, 0), ("3", "response", None, 5), ("5", "response", None, 4), ("5", "response", None, 4),
        ("None", "revisit", 5, 4)]
    assert archives.archived(spark.createDataFrame([], ROW), shared_folder(spark, "t")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers(version):
    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: 7\r\n\r\nhello\nworld"
    data = archives.arc_version_block(version, "n.arc", "20010203040506") + b"\n" + archives.arc_record(
        version, "http://h/a b", "20010203040506", body) + b"\n\n" + archives.arc_record(version, None, "2001", b"raw") + b"\n"
    first, second = archives.parse_arc(data)
    assert first["URL"] == "http://h/a%20b" and first["content"] == body and first["Archive-length"] == str(len(body))
    assert second["URL"] == "-" and second["content"] == b"raw" and (version == 1 or first["Result-code"] == "200")
    with pytest.raises(ValueError):
        list(archives.parse_arc(data[:-20]))
    with pytest.raises(ValueError):
        list(archives.parse_arc(data.replace(b"IP-address Archive-date", b"IP-address Other-date")))
    with pytest.raises(ValueError):
        list(archives.parse_arc(archives.arc_record(version, "u", "2001", b"x")))


def test_warc_records_and_gzip_members():
    one = archives.warc_record({"WARC-Type": "response", "A": None}, b"\r\n\r\nWARC/1.0") + b"\n"
    data = archives._unpacked(gzip.compress(one) + gzip.compress(one))
    assert [b for _, b in archives.parse_warc(data)] == [b"\r\n\r\nWARC/1.0"] * 2 and archives._unpacked(one) == one
    with pytest.raises(ValueError):
        list(archives.parse_warc(one[:-3]))
    with pytest.raises(ValueError):
        list(archives.parse_warc(b"x\r\n\r\n"))


def test_dates():
    assert archives.warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert archives.warc_date("200102030405") == "2001-02-03T04:05:00Z" and archives.warc_date("-") == "2000-01-01T00:00:00Z"
