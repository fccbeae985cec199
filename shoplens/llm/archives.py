"""Converter from legacy ARC archives to WARC, with writers and readers of both.

An ARC archive begins with a version block, whose lines say which fields a record's header line has (version 1: five,
version 2: ten); then come header lines, each followed by as many bytes as it declares. The converter parses them and
writes equivalent WARC records: an identifier made from what the record says, the date in ISO form, the type, digests
of payload and block. Of records with equal payloads one is the response, the others are revisits that refer to it and
keep only their HTTP headers.

Archives are written by Spark's text sink, one record per row, gzip-compressed and with bounded sizes, and are read
whole, one task per archive: any file system that Spark reaches will do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.shared import attach, checkpointed

#: Bytes that a task gathers before it passes them on as one row, and such rows per archive: what bounds an archive.
SEGMENT_BYTES, SEGMENTS = 4 << 20, 4
#: Crawl date of records without one, as ARC writes it.
NO_DATE = "20000101000000"

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

ARC_ROW = "page_id string, url string, ip string, date string, mime string, status string, http binary, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _segments(records: Iterator[bytes], head: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of many records each, with a head in front, so that an archive may begin at any row."""
    held, size = [head], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= SEGMENT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary())], names=["record"])
            held, size = [head], 0
    if len(held) > 1:
        yield pa.RecordBatch.from_arrays([pa.array([b"\n".join(held)], pa.binary())], names=["record"])


def _written(rows: DataFrame, path: str) -> None:
    """rows: one binary column of records without the line end that the sink adds."""
    (rows.select(F.col("record").cast("string").alias("value")).write
     .option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", SEGMENTS)
     .text(path))


# ---- ARC ----------------------------------------------------------------------------------------------------------

def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 shoplens\n{ARC_FIELDS[version]}\n".encode()
    given = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain",
             "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name,
             "Archive-length": str(len(body))}
    return " ".join(given[f] for f in ARC_FIELDS[version].split()).encode() + b"\n" + body


def arc_record(version: int, url: str | None, date: str, content: bytes, name: str = "-") -> bytes:
    given = {"URL": quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else "-", "IP-address": "0.0.0.0", "Archive-date": date,
             "Content-type": "text/html", "Result-code": "200", "Checksum": hashlib.md5(content).hexdigest(),
             "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(content))}
    return " ".join(given[f] for f in ARC_FIELDS[version].split()).encode() + b"\n" + content


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = NO_DATE) -> None:
    """One ARC record per row of (page_id, url, html): the HTTP response that brought the page.

    A null html is an empty payload, a null url is written as '-'; the id travels in an HTTP header.
    """
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", F.col("html").cast("binary").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"pages-v{version}.arc"

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(k).to_pylist() for k in range(3))):
                    html = html or b""
                    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n"
                            + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + "\r\n").encode()
                    yield arc_record(version, url, date, head + html, name)
        return _segments(records(), arc_version_block(version, name, date))
    _written(rows.mapInArrow(run, "record binary"), path)


def parse_arc(data: bytes) -> Iterator[dict[str, object]]:
    """Records of an archive: the fields that its version block names, and content. Version blocks are no records."""
    at, fields = 0, None
    while at < len(data):
        if data[at:at + 1] == b"\n":  # the line end between records
            at += 1
            continue
        end = data.index(b"\n", at)
        parts = data[at:end].decode("utf-8", "replace").split(" ")
        length = int(parts[-1])
        content = data[end + 1:end + 1 + length]
        if len(content) < length:
            raise ValueError(f"the archive ends inside the record at byte {at}")
        at = end + 1 + length
        if parts[0].startswith("filedesc:"):
            lines = content.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0])
            fields = lines[1].split(" ")
            if ARC_FIELDS.get(version, "").split(" ") != fields:
                raise ValueError(f"unknown ARC version {lines[:2]}")
            continue
        if fields is None or len(parts) != len(fields):
            raise ValueError(f"a header line does not fit the version block: {parts[:3]}")
        yield dict(zip(fields, parts)) | {"content": content}


def _unpacked(data: bytes) -> bytes:
    """The content of a gzip file of one or more members; anything else as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out)


def _http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head (with its blank line), header fields in lower case, payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    head, gap, payload = block.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"^([^:\s]+):[ \t]*(.*?)\r?$", head.decode("utf-8", "replace"), re.M))
    return head + gap, {k.lower(): v for k, v in fields.items()}, payload


def _files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("content")


def read_arc(spark: SparkSession, *paths: str) -> DataFrame:
    """The records of ARC archives with their HTTP head and payload apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                columns: list[list] = [[] for _ in range(8)]
                for record in parse_arc(_unpacked(data.as_py())):
                    head, fields, payload = _http_parts(record["content"])
                    row = (fields.get("x-page-id"), None if record["URL"] == "-" else record["URL"], record["IP-address"],
                           record["Archive-date"], record["Content-type"], record.get("Result-code", "-"), head, payload)
                    for column, value in zip(columns, row):
                        column.append(value)
                kinds = [pa.string()] * 6 + [pa.binary()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 names=[f.split()[0] for f in ARC_ROW.split(", ")])
    return _files(spark, *paths).mapInArrow(run, ARC_ROW)


# ---- WARC ---------------------------------------------------------------------------------------------------------

def warc_date(arc_date: str) -> str:
    """ARC dates have 14 digits (older ones 12 or 8); missing ones are taken from NO_DATE."""
    d = (arc_date + NO_DATE[len(arc_date):]) if arc_date.isdigit() else NO_DATE
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(page_id: str | None, digest: str) -> str:
    """A UUID that depends on the page and its payload only, so that other records can refer to it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def warc_record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A record without its last line end."""
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return ("\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r"


def _converted(row: dict) -> bytes:
    payload, head, first = row["payload"], row["http"], row["first_page"]
    digest = sha1_base32(payload)
    revisit = first is not None
    block = head if revisit else head + payload
    return warc_record({
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(row["page_id"], digest),
        "WARC-Date": warc_date(row["date"]),
        "WARC-Target-URI": row["url"],
        "WARC-IP-Address": row["ip"],
        "Content-Type": "application/http; msgtype=response" if head else row["mime"],
        "WARC-Identified-Payload-Type": row["mime"],
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Block-Digest": f"sha1:{sha1_base32(block)}",
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Refers-To": record_id(first, digest) if revisit else None,
        "X-Page-Id": row["page_id"], "X-Refers-To-Page-Id": first if revisit else None,
        "X-Payload-Length": str(len(payload)),
    }, block)


def _payload_rows(records: DataFrame) -> DataFrame:
    return checkpointed(records.select(F.col("page_id").cast("bigint").alias("number"), "digest",
                                       F.octet_length("payload").alias("bytes")))


def _visit(number: Column | str) -> Column:
    """A page and its payload as one key."""
    return F.concat_ws(":", number, "digest")


def _first_pages(rows: DataFrame, least_bytes: int) -> DataFrame:
    """(number, digest, first_page) of the records that revisit another page.

    Only ids and digests are exchanged, a payload that very many pages share is one row per task.
    """
    firsts = checkpointed(rows.where(F.col("bytes") >= least_bytes).groupBy(F.col("digest").alias("of"))
                          .agg(F.min("number").alias("first"), F.count("*").alias("n")).where("n > 1"))
    return (attach(rows, firsts, "digest", "of", "number").where("first is not null and not (number <=> first)")
            .select("number", "digest", F.col("first").cast("string").alias("first_page")).distinct())


def convert(spark: SparkSession, arc_paths: list[str], warc_path: str, least_bytes: int = 0) -> None:
    """WARC archives equivalent to the ARC archives.

    Records with equal payloads of at least least_bytes revisit the one of the smallest page id (as a number); a
    record without an id always revisits another, if one with an id has its payload. Records that repeat the smallest
    id are responses all of them.
    """
    records = read_arc(spark, *arc_paths).withColumn("digest", F.sha1("payload"))
    again = checkpointed(_first_pages(_payload_rows(records), least_bytes).select(_visit("number").alias("of"), "first_page"))
    joined = (attach(records.withColumn("visit", _visit(F.col("page_id").cast("bigint"))), again, "visit", "of", "visit")
              .select("page_id", "url", "ip", "date", "mime", "http", "payload", "first_page"))
    info = warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, warc_path)}>",
                        "WARC-Date": warc_date(NO_DATE), "Content-Type": "application/warc-fields"},
                       b"software: shoplens\r\nformat: WARC File Format 1.0\r\n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _segments((_converted(row) for batch in batches for row in batch.to_pylist()), info)
    _written(joined.mapInArrow(run, "record binary"), warc_path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (names in lower case) and block of every record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        start, length = end + 4, int(fields["content-length"])
        if len(data) < start + length + 4:
            raise ValueError(f"the archive ends inside the record at byte {at}")
        yield fields, data[start:start + length]
        at = start + length + 4


WARC_ROW = ("record_id string, record_type string, date string, url string, page_id bigint, payload_bytes bigint, "
            "payload_digest string, refers_to_record string, refers_to bigint, verified boolean, payload binary")


def read_warc(spark: SparkSession, *paths: str) -> DataFrame:
    """Responses and revisits of WARC archives.

    A revisit has no payload; its size and digest are those that the full payload had. verified: block and payload
    have the digests that the record declares.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for fields, block in parse_warc(_unpacked(data.as_py())):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    payload = None if kind == "revisit" else _http_parts(block)[2]
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    size = len(payload) if payload is not None else int(fields["x-payload-length"])
                    number = {k: int(fields[k]) if k in fields else None for k in ("x-page-id", "x-refers-to-page-id")}
                    good = (fields["warc-block-digest"] == f"sha1:{sha1_base32(block)}"
                            and (payload is None or digest == sha1_base32(payload)))
                    rows.append((fields["warc-record-id"], kind, fields["warc-date"], fields.get("warc-target-uri"),
                                 number["x-page-id"], size, digest, fields.get("warc-refers-to"),
                                 number["x-refers-to-page-id"], good, payload))
                kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 11, kinds)],
                    names=[f.split()[0] for f in WARC_ROW.split(", ")])
    return _files(spark, *paths).mapInArrow(run, WARC_ROW)


def archived(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Pages written as ARC archives of both versions below the folder, converted, and read back from WARC."""
    spark = pages.sparkSession
    half = F.pmod(F.xxhash64("page_id"), F.lit(2))
    for version in (1, 2):
        write_arc(pages.where(half == version - 1), f"{folder}/arc{version}", version)
    convert(spark, [f"{folder}/arc1", f"{folder}/arc2"], f"{folder}/warc", least_bytes)
    return read_warc(spark, f"{folder}/warc")
