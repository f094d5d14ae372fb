"""Legacy archives: version-specific ARC header lines and declared lengths in, equivalent WARC records out.

ARC version 1 has five header fields (URL, IP, date, type, length), version 2 ten (URL, IP, date, type, result
code, checksum, location, offset, file name, length). The version is in the second line of the leading
``filedesc:`` record. Bodies are cut by the declared length, never by looking for the next header, so a body
may hold anything. Archives are written through Spark's own writers, so any file system of the cluster takes them
and lost tasks are repeated. Every record is a gzip member of its own, as WARC readers expect.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import common

#: The header fields of the two ARC versions.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "code", "checksum", "location", "offset", "file", "length"),
}
CRLF = b"\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_text(value: str | None) -> str:
    """A header field: ARC separates fields by spaces, so white space and controls are percent-coded; empty is '-'."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "") or "-"


def arc_archive(records: list[tuple[str | None, bytes]], version: int = 1, date: str = "20200101000000", ip: str = "0.0.0.0", mime: str = "text/html") -> bytes:
    """An uncompressed ARC file of (URL, body) records."""
    fields = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    about = f"{version} 0 braidwork\n{fields}\n".encode()
    out = io.BytesIO()

    def put(url: str, kind: str, body: bytes) -> None:
        more = f"200 - - {out.tell()} braidwork.arc " if version == 2 else ""
        out.write(f"{url} {ip} {date} {kind} {more}{len(body)}\n".encode() + body + b"\n")

    put("filedesc://braidwork.arc", "text/plain", about)
    for url, body in records:
        put(arc_text(url), mime, body)
    return out.getvalue()


def parse_arc(data: bytes, description: bool = False) -> Iterator[dict]:
    """The records after the leading description (with it, where asked), as dicts of header fields with the body; raises ValueError on a broken header or a body cut short."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # blank lines between records
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at byte {at}")
        parts = data[at:end].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        if not version:
            if not parts[0].startswith("filedesc:") or not parts[-1].isdigit():
                raise ValueError("an ARC file starts with a filedesc record")
            about = data[end + 1 : end + 1 + int(parts[-1])]
            version = int(about[:1]) if about[:1] in (b"1", b"2") else 0
            if not version:
                raise ValueError("unknown ARC version")
            if len(parts) not in map(len, ARC_FIELDS.values()) or len(about) != int(parts[-1]):
                raise ValueError("broken filedesc record")
            if description:  # writers of either version give its header five or ten fields
                yield dict(zip(ARC_FIELDS[1], [*parts[:4], parts[-1]])) | {"version": version, "body": about}
            at = end + 1 + int(parts[-1])
            continue
        names = ARC_FIELDS[version]
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"broken header at byte {at}")
        body = data[end + 1 : end + 1 + int(parts[-1])]
        if len(body) != int(parts[-1]):
            raise ValueError(f"the body at byte {end + 1} is cut short")
        yield dict(zip(names, parts)) | {"version": version, "body": body}
        at = end + 1 + len(body)


def warc_date(arc_date: str) -> str:
    """14 (or 12) digits to ISO 8601; anything else is the epoch."""
    try:
        return datetime.strptime(arc_date[:14].ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'braidwork:' + key)}>"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; all is payload where there is no HTTP header."""
    if body.startswith(b"HTTP/"):
        end = body.find(CRLF * 2)
        if end >= 0:
            return body[: end + 4], body[end + 4 :]
    return b"", body


def warc_record(arc: dict, key: str = "", refers_to: str | None = None) -> bytes:
    """One WARC record without the closing CR LF CR LF. key names the row (it makes the id); refers_to is the key of the response that a revisit repeats."""
    head, payload = split_http(arc["body"])
    http = bool(head)
    kind = "revisit" if refers_to is not None else "warcinfo" if arc["url"].startswith("filedesc:") else "response" if http else "resource"
    block = head if refers_to is not None else arc["body"]
    digest = base32_sha1(payload)  # part of the id: rows of one key and other payloads are records of their own
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id((key or arc['url'] + arc['date']) + ' ' + digest)}",
        f"WARC-Date: {warc_date(arc['date'])}",
        f"WARC-Target-URI: {arc['url']}",
        f"WARC-IP-Address: {arc['ip']}",
        f"Content-Type: {'application/http; msgtype=response' if http else arc['mime']}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Row-Key: {key}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to + ' ' + digest)}", f"X-Refers-To-Key: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + CRLF * 2 + block


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records as dicts: header (lower-case names) and block, cut by Content-Length."""
    at = 0
    while at < len(data):
        end = data.find(CRLF * 2, at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC header at byte {at}")
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        header = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        size = int(header["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"the block at byte {end + 4} is cut short")
        yield {"header": header, "block": block}
        at = end + 4 + size
        if data[at : at + 4] == CRLF * 2:
            at += 4


#: A payload of more than one in HOT of all pages is hot: there are fewer than HOT of them. Its pages are dealt to SALTS tasks.
HOT, SALTS = 1000, 256
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def convert_pages(pages: DataFrame, min_bytes: int = 0, version: int = 1) -> DataFrame:
    """(page_id, record BINARY): each page as an ARC record, converted to WARC.

    Of pages with equal payloads of at least min_bytes bytes the largest page_id is the response, the others
    are revisits. A null html is an empty payload, a null url '-'. Rows with a null page_id are written as
    responses with an empty key and never referred to. Rows that repeat a page_id and payload repeat its record.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("n"))
    of = keyed.filter((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).filter("copies > 1")
    ids = keyed.select("page_id", "digest")
    many = F.col("copies") > ids.count() // HOT
    hot = F.broadcast(of.filter(many).select("digest", F.lit(True).alias("hot")))
    dealt = ids.join(hot, "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).otherwise(0))
    copies = of.withColumn("salt", F.explode(F.when(many, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    met = dealt.join(copies, ["digest", "salt"])
    refers = met.filter("page_id < response").groupBy(F.col("page_id"), F.col("digest")).agg(F.max("response").alias("response"))
    joined = keyed.join(refers, ["page_id", "digest"], "left").select("page_id", "url", "html", "response")

    def make():
        def each(rows):
            out = []
            for page_id, url, html, response in zip(rows["page_id"], rows["url"], rows["html"], rows["response"]):
                data = arc_archive([(url, HTTP_HEAD + html.encode("utf-8", "surrogatepass"))], version)
                (arc,) = parse_arc(data)
                out.append(warc_record(arc, "" if page_id is None else str(page_id), None if response is None else str(response)))
            return {"page_id": rows["page_id"], "record": out}

        return each

    return common.map_rows(joined, make, "page_id bigint, record binary")


#: Compressed bytes of a file, about: a record of more has a file of its own.
FILE_BYTES = 32 << 20


def member(record: bytes) -> bytes:
    """A record with its closing CR LF CR LF as a gzip member, less the last byte, a zero, which the writer's separator puts back. (The last four bytes are the length: from 16 MB on it takes an empty member to end in zero.)"""
    out = gzip.compress(record + CRLF * 2, 6, mtime=0)
    if out[-1]:
        out += gzip.compress(b"", 6, mtime=0)
    return out[:-1]


def members(data: bytes) -> Iterator[bytes]:
    """What the gzip members of a file hold, one by one; ValueError where the last is cut short."""
    at, view = 0, memoryview(data)
    while at < len(data):
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut short")
            piece = view[at : at + 8192]
            out.append(inflate.decompress(piece))
            at += len(piece)
        at -= len(inflate.unused_data)
        yield b"".join(out)


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of about FILE_BYTES under path: whole records, each gzip-coded by itself."""

    def run(batches):
        held, n = [], 0
        for batch in common.pieces(batches):
            for cell in batch.column(0):
                held.append(member(cell.as_py()))
                n += len(held[-1])
                if n >= FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"\0".join(held)], pa.binary())], names=["file"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"\0".join(held)], pa.binary())], names=["file"])

    files = records.select("record").mapInArrow(run, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def read_warc(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, warc_date, payload) of all records; raises where a stored payload doesn't match its digest."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, warc_date string, payload binary"
    arrow = common.arrow_schema(common.T._parse_datatype_string(schema))

    def row(x: dict) -> tuple:
        h = x["header"]
        digest, revisit = h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"] == "revisit"
        payload = split_http(x["block"])[1]
        if not revisit and (base32_sha1(payload) != digest or len(payload) != int(h["x-payload-length"])):
            raise ValueError(f"payload of {h['warc-record-id']} doesn't match its digest")
        return (int(h["x-row-key"]) if h["x-row-key"] else None, int(h["x-payload-length"]), digest, h["warc-type"], int(h["x-refers-to-key"]) if revisit else None, h["warc-target-uri"], h["warc-date"], payload)

    def run(batches):
        for batch in batches:
            for cell in batch.column(0):
                rows, n = [], 0
                for data in members(cell.as_py()):
                    for x in parse_warc(data):
                        rows.append(row(x))
                        n += len(x["block"])
                    if len(rows) >= common.BATCH_ROWS or n >= common.BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                        rows, n = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return files.mapInArrow(run, schema)


def read_arc(spark, path: str) -> DataFrame:
    """(key, url, ip, date, mime, digest, n, body) of all records of ARC files of either version, plain or gzip-coded (as a whole or by record), the descriptions included.

    key is the file's name and the record's place in it, with leading zeros, so keys ascend with the records; digest
    and n are of the payload. A file is read as one row, as archives of 100 MB or so allow.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), "content")
    schema = "key string, url string, ip string, date string, mime string, digest string, n bigint, body binary"
    arrow = common.arrow_schema(common.T._parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for name, cell in zip(batch.column(0), batch.column(1)):
                data = cell.as_py()
                data = b"".join(members(data)) if data[:2] == b"\x1f\x8b" else data
                for i, x in enumerate(parse_arc(data, description=True)):
                    payload = split_http(x["body"])[1]
                    values = (f"{name.as_py()}:{i:012d}", x["url"], x["ip"], x["date"], x["mime"], base32_sha1(payload), len(payload), x["body"])
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

    return files.mapInArrow(run, schema)


def convert_archives(arcs: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(key, record): a WARC record for each row of read_arc(). Of HTTP responses with equal payloads of at least min_bytes bytes that with the largest key is the response, others revisit it; a file's description is a warcinfo record."""
    http = F.substring("body", 1, 5) == F.lit(b"HTTP/")
    of = arcs.filter((F.col("n") >= min_bytes) & http).groupBy("digest").agg(F.max("key").alias("response"), F.count("*").alias("copies")).filter("copies > 1")
    refers = arcs.filter(http).select("key", "digest").join(of, "digest").filter("key < response").select("key", "response")

    def make():
        def each(rows):
            arc = (dict(zip(("url", "ip", "date", "mime", "body"), x)) for x in zip(rows["url"], rows["ip"], rows["date"], rows["mime"], rows["body"]))
            return {"record": [warc_record(a, k, r) for a, k, r in zip(arc, rows["key"], rows["response"])]}

        return each

    return common.map_rows(arcs.join(refers, "key", "left").select("key", "url", "ip", "date", "mime", "body", "response"), make, "record binary", keep=("key",), read=("key", "url", "ip", "date", "mime", "body", "response"))


def archive(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Writes all pages as WARC under path and reads them back."""
    write_warc(convert_pages(pages, min_bytes), path)
    return read_warc(pages.sparkSession, path)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = common.load(spark, sf_dir, "pages", "page_id", "url", "html")
    return archive(pages, common.scratch_path(spark, "warc")).drop("payload", "url", "warc_date")


#: SHA-1 as base32: eight groups of five hexadecimal digits, each four symbols of five bits.
OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT p.page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(p.h, 1 + 5 * (i // 4)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN p.page_id = m.top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id = m.top THEN NULL ELSE m.top END AS refers_to
FROM p JOIN m USING (h)
"""
