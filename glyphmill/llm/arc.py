"""Legacy web archives (ARC, versions 1 and 2) converted to WARC records.

An ARC file begins with a version block, whose body's first line names the
version and whose second the fields of all header lines. A record is a header
line of those fields, so many bytes as its length field declares, and a newline.
The parser walks a file by these declared lengths; what a WARC record needs and
ARC lacks (identifier, type, ISO timestamp, digests) is made from the block by
built-in functions.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import _text
from glyphmill.ship import ship

FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RECORD = "archive string, offset long, version int, url string, ip string, date string, mime string, status int, declared long, block binary, error string"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def version_block(version: int, name: str, date: str = "20240101000000") -> bytes:
    """The block that opens an archive."""
    body = f"{version} {'1' if version == 2 else '0'} glyphmill\n{FIELDS[version]}\n\n".encode()
    tail = f"200 - - 0 {name} " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {tail}{len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, block: bytes, status: int = 200, name: str = "-", offset: int = 0) -> bytes:
    tail = f"{status} - - {offset} {name} " if version == 2 else ""
    return f"{url} {ip} {date} {mime} {tail}{len(block)}\n".encode() + block + b"\n"


def parse(data: bytes) -> Iterator[tuple]:
    """Of one archive, plain or gzipped by file or record: (offset, version, url,
    ip, date, mime, status, declared length, block, error) of each record but the
    version block. After a header line that can't be read, or a declared length
    beyond the end, one row with an error ends the archive: the next record can't
    be found. A gzip member cut short gives what could be read, then an error."""
    broken = None
    if data[:2] == b"\x1f\x8b":
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError, zlib.error):
            out, rest = [], data
            while rest[:2] == b"\x1f\x8b":
                z = zlib.decompressobj(31)
                try:
                    out.append(z.decompress(rest))
                except zlib.error:
                    break
                if not z.eof:
                    break
                rest = z.unused_data
            data, broken = b"".join(out), "archive is cut short"
    fields, version, at = FIELDS[1].split(), 1, 0
    view = memoryview(data)
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        if end < 0:
            yield at, version, None, None, None, None, None, None, None, broken or "header line is cut short"
            return
        opening = line.startswith("filedesc:")
        parts = line.split(" ")
        names = FIELDS[2 if len(parts) == len(FIELDS[2].split()) else 1].split() if opening else fields
        extra = len(parts) - len(names)
        if extra > 0:  # blanks in the URL, the only field that may hold them
            parts = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
        got = dict(zip(names, parts, strict=False))
        size = got.get("Archive-length", "")
        if extra < 0 or not (size.isascii() and size.isdigit()):
            yield at, version, None, None, None, None, None, None, None, "header line doesn't have the version's fields"
            return
        length = int(size)
        if end + 1 + length > len(data):
            yield at, version, got["URL"], got["IP-address"], got["Archive-date"], got["Content-type"], None, length, None, broken or "declared length passes the end"
            return
        block = bytes(view[end + 1 : end + 1 + length])
        if opening:
            lines = block.decode("utf-8", "replace").split("\n")
            if lines[0][:1].isdigit():
                version = int(lines[0].split(" ")[0])
            if len(lines) > 1 and lines[1].startswith("URL "):
                fields = lines[1].strip().split(" ")
            elif version in FIELDS:
                fields = FIELDS[version].split()
        else:
            code = got.get("Result-code", "")
            yield at, version, got["URL"], got["IP-address"], got["Archive-date"], got["Content-type"], int(code) if code.isascii() and code.isdigit() else None, length, block, None
        at = end + 1 + length
    if broken:
        yield at, version, None, None, None, None, None, None, None, broken


def read_arc(archives: DataFrame, name_col: str = "path", data_col: str = "content") -> DataFrame:
    """Records of whole archives, one row an archive, as the binaryFile source
    gives them; see ``parse``. A null or empty archive has no records."""
    ship(archives.sparkSession)

    def walk(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), _text.each(batch.column(1), 1), strict=True):
                rows: list[tuple] = []
                size = 0
                for r in parse(data or b""):
                    rows.append((name, *r))
                    size += r[7] or 0
                    if size > 8_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return archives.select(name_col, data_col).mapInArrow(walk, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def base32_sha1(data: Column) -> Column:
    """``sha1:`` and the SHA-1 in base 32: every 5 hex digits are 4 letters."""
    h = F.sha1(data)
    groups = [F.conv(F.substring(h, 1 + 5 * g, 5), 16, 10).cast("int") for g in range(8)]
    letters = [F.substring(F.lit(_BASE32), F.shiftright(x, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for x in groups for j in range(4)]
    return F.concat(F.lit("sha1:"), *letters)


def to_warc(records: DataFrame) -> DataFrame:
    """WARC header fields of ARC records, one row each, in any order.

    An HTTP block of an http(s) URL is a ``response``, whose payload is what
    follows the first blank line; other blocks are a ``resource``, their own
    payload. Dates of 14 digits (or fewer, from the left) become ISO 8601 UTC, or
    null. ``warc_record_id`` is a UUID from URL, date and block digest, so equal
    records in two archives have equal identifiers. Rows with a parse error have
    no WARC record and are left out; they are to be found in ``records``.
    """
    ok = records.where("error is null and block is not null")
    head = F.substring(F.col("block"), 1, 5) == F.lit(b"HTTP/")
    web = F.lower("url").rlike("^https?://") & head
    digits = F.rpad(F.regexp_extract("date", "^[0-9]{4,14}", 0), 14, "00000101000000")
    digits = F.when(F.length(F.regexp_extract("date", "^[0-9]{4,14}", 0)) >= 4, F.concat(F.regexp_extract("date", "^[0-9]{4,14}", 0), F.expr("substring('00000101000000', length(regexp_extract(date, '^[0-9]{4,14}', 0)) + 1)")))
    when = F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))
    latin = F.decode("block", "ISO-8859-1")
    cut_at = F.instr(latin, "\r\n\r\n")
    body = F.when(web & (cut_at > 0), F.expr("substring(block, cut_at + 4)")).otherwise(F.when(~web, F.col("block")).otherwise(F.lit(b"")))
    out = ok.withColumn("cut_at", cut_at).withColumn("body", body).withColumn("warc_block_digest", base32_sha1(F.col("block"))).withColumn("warc_payload_digest", base32_sha1(F.col("body")))
    iso = F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    m = F.md5(F.concat_ws(" ", F.col("url"), F.coalesce("date", F.lit("")), F.col("warc_block_digest")))
    uuid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.substring(m, 13, 4), F.substring(m, 17, 4), F.substring(m, 21, 12)), F.lit(">"))
    return out.select(
        uuid.alias("warc_record_id"), F.when(web, "response").otherwise("resource").alias("warc_type"), iso.alias("warc_date"), F.col("url").alias("warc_target_uri"), F.col("ip").alias("warc_ip_address"),
        F.when(web, "application/http; msgtype=response").otherwise(F.col("mime")).alias("content_type"), F.col("declared").alias("content_length"), "warc_block_digest", "warc_payload_digest",
        F.when(web, F.regexp_extract(F.substring(latin, 1, 64), r"^HTTP/[0-9.]+ ([0-9]{3})", 1)).cast("int").alias("http_status"),
        F.col("mime").alias("payload_type"), F.octet_length("body").cast("long").alias("payload_length"), F.col("version").alias("arc_version"),
    )


def pages_as_arc(pages: DataFrame) -> DataFrame:
    """``path, content``: the pages as ARC archives, as a crawler of its day would
    have left them, of version 1 for even ids and 2 for odd ones, one archive for
    every version and batch. A null id counts as even, a null URL as
    ``about:blank``, a null page as empty; the date is a day of 2004 by the id."""
    ship(pages.sparkSession)

    def write(batches):
        for batch in batches:
            ids, urls = (c.to_pylist() for c in batch.columns[:2])
            for version in (1, 2):
                name = f"batch-v{version}.arc"
                parts, size = [version_block(version, name)], 0
                for i, url, html in zip(ids, urls, _text.each(batch.column(2)), strict=True):
                    if ((i or 0) % 2 == 1) != (version == 2):
                        continue
                    body = (html or "").encode()
                    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
                    date = f"2004{(i or 0) % 12 + 1:02d}{(i or 0) % 28 + 1:02d}120000"
                    parts.append(arc_record(version, (url or "about:blank").replace("\n", "%0A"), "192.0.2.1", date, "text/html", block, name=name, offset=size))
                    size += len(parts[-1])
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], ["path", "content"])
                        parts, size = [version_block(version, name)], 0
                if len(parts) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], ["path", "content"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(write, "path string, content binary")


def _sql_base32(hex_: str) -> str:
    parts = []
    for g in range(8):
        x = f"('0x' || substr({hex_}, {1 + 5 * g}, 5))::INTEGER"
        parts += [f"substr('{_BASE32}', (({x} >> {15 - 5 * j}) & 31) + 1, 1)" for j in range(4)]
    return "'sha1:' || " + " || ".join(parts)


ORACLE = f"""
WITH p AS (SELECT coalesce(page_id, 0) AS i, replace(coalesce(url, 'about:blank'), chr(10), '%0A') AS url, coalesce(html, '') AS html FROM pages),
b AS (SELECT *, '2004' || lpad(CAST(i % 12 + 1 AS VARCHAR), 2, '0') || lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') || '120000' AS d,
  'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(html)) || chr(13) || chr(10) || chr(13) || chr(10) || html AS block FROM p),
h AS (SELECT *, sha1(block) AS hb, sha1(html) AS hp, regexp_matches(lower(url), '^https?://') AS web FROM b),
g AS (SELECT *, {_sql_base32('hb')} AS bd, CASE WHEN web THEN {_sql_base32('hp')} ELSE {_sql_base32('hb')} END AS pd FROM h),
u AS (SELECT *, md5(url || ' ' || d || ' ' || bd) AS m FROM g)
SELECT '<urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>' AS warc_record_id,
  CASE WHEN web THEN 'response' ELSE 'resource' END AS warc_type, substr(d, 1, 4) || '-' || substr(d, 5, 2) || '-' || substr(d, 7, 2) || 'T12:00:00Z' AS warc_date,
  url AS warc_target_uri, '192.0.2.1' AS warc_ip_address, CASE WHEN web THEN 'application/http; msgtype=response' ELSE 'text/html' END AS content_type,
  octet_length(encode(block)) AS content_length, bd AS warc_block_digest, pd AS warc_payload_digest, CASE WHEN web THEN 200 END AS http_status,
  'text/html' AS payload_type, CASE WHEN web THEN octet_length(encode(html)) ELSE octet_length(encode(block)) END AS payload_length, CASE WHEN i % 2 = 1 THEN 2 ELSE 1 END AS arc_version
FROM u
"""
