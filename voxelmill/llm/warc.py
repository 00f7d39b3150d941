"""Web archives: legacy ARC files written, converted to WARC, and WARC files read.

An ARC file begins with a version block that names the fields of its URL records; the last field of a
record's header line is the declared length of what follows. The converter reads fields by the names
of the file's own version (1: five fields, 2: ten), takes exactly the declared bytes, and makes of each
record the equivalent WARC/1.1 one: a record id derived from what it holds, the date in ISO form, type
response (or resource where the content is no HTTP message), and SHA-1 digests of block and payload.
Of records with equal payloads that with the smallest page id is kept, the others become revisits.

Payloads are bytes throughout, of any encoding or none. Archives are read whole, plain or gzipped, whatever their
names; heads may end their lines with LF only. A header line that can't be read, a declared length beyond the
file's end and a broken gzip stream become records with an error, up to the next line that is a header, and are set aside: they are
returned, not converted, and stop nothing.

Archives are cut at about ARCHIVE bytes, whatever their number of records; a file is one row of Spark's text
writer, so any store that Spark writes will do. In gzipped files each record is a gzip member of its own, so it can be read
from its offset alone; the last member is empty and marks the end.

A null payload is empty. A null url is `urn:none`, blanks in urls are escaped. Null page ids, and what isn't a 64-bit integer in a
foreign head, come after all others; where only such records share a payload the first by file and place is the response.
Repeated rows of the smallest id are all responses. Only page_id, url and html are read. An empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, checkpoint_dir, cut, remove

#: Bytes of an archive, about.
ARCHIVE = 1 << 24
#: Of gzip: a third of the time of the usual sixth level for files that are a twentieth larger.
LEVEL = 4
#: The URL record definitions of the two versions of the ARC format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 voxelmill\n{FIELDS[version]}\n\n"
    middle = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 20240101000000 text/plain {middle}{len(body)}\n{body}".encode()


def url_record(version: int, name: str, url: str, date: str, content: bytes) -> bytes:
    middle = "" if version == 1 else f"200 {base32_sha1(content)} - 0 {name} "
    return f"{url} 0.0.0.0 {date} text/html {middle}{len(content)}\n".encode() + content


def page_message(page_id: int | None, html: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(html)}\r\n\r\n".encode() + html


def zipped(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def archives(records: Iterator[bytes], first: bytes, end: bytes, compress: bool) -> Iterator[pa.RecordBatch]:
    """Whole files of about ARCHIVE bytes, each beginning with `first`; `end` follows every record, and of plain files the writer adds the last."""

    def row(held: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held) if compress else end.join(held)], pa.binary())], names=["value"])

    held, size = [], 0
    for r in records:
        for x in (r,) if held else (first, r):
            held.append(zipped(x + end) if compress else x)
            size += len(held[-1])
        if size >= ARCHIVE:
            yield row(held)
            held, size = [], 0
    if held:
        yield row(held)


def save(files: DataFrame, path: str, end: bytes, compress: bool) -> None:
    """Each row's bytes as a file. What the text writer puts after a row is an empty gzip member or the end of the last record."""
    last = zipped(b"") if compress else end
    files.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", last.decode("latin-1")).option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str, version: int | None = None, compress: bool = True) -> None:
    """ARC files of (page_id, url, html), html text or bytes; of version 1 and 2 by turns of the partition if none is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        v, name = version or 1 + part % 2, f"pages-{part:05d}.arc"

        def records() -> Iterator[bytes]:
            for batch in batches:
                for k in range(batch.num_rows):
                    key, url, html = (batch.column(c)[k].as_py() for c in range(3))
                    yield url_record(v, name, (url or "urn:none").replace(" ", "%20").replace("\n", "%0A"), "20240102030405", page_message(key, html or b""))

        yield from archives(records(), version_block(v, name), b"\n", compress)

    save(pages.select("page_id", "url", F.col("html").cast("binary")).mapInArrow(run, "value binary"), path, b"\n", compress)


def header_fields(line: bytes, names: list[str]) -> dict[str, str] | None:
    """Fields of an ARC header line, from the right, as old urls may hold blanks; null where it is none."""
    values = line.rstrip(b"\r\n").rsplit(b" ", len(names) - 1)
    if len(values) != len(names):
        return None
    url = urllib.parse.quote(values[0], safe="".join(map(chr, range(33, 127))))
    fields = dict(zip(names, [url, *[v.decode("latin-1") for v in values[1:]]], strict=True))
    date, size = fields.get("Archive-date", ""), fields.get("Archive-length", "")
    whole = size.isascii() and size.isdigit() and date.isascii() and date.isdigit() and len(date) in (4, 6, 8, 10, 12, 14)
    return fields if whole and url else None


def arc_records(content: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, by the names of the file's version, and content of each URL record; what can't be read has a field `error`."""
    names, skipped, reason = FIELDS[1].split(" "), bytearray(), ""
    while True:
        try:
            line = content.readline()
            if not line or (fields := header_fields(line, names)) or line.startswith(b"filedesc://"):
                if skipped.strip():
                    yield {"error": reason or "no header line"}, bytes(skipped)
                skipped, reason = bytearray(), ""
                if not line:
                    return
                if line.startswith(b"filedesc://"):
                    size = line.rstrip().rsplit(b" ", 1)[-1]
                    body = content.read(int(size) if size.isdigit() else 0).split(b"\n")
                    stated = body[1].decode("latin-1").split() if len(body) > 1 else []
                    names = stated if stated[:1] == ["URL"] and stated[-1] == "Archive-length" else names
                    continue
                size = int(fields["Archive-length"])
                data = content.read(size)
                yield (fields, data) if len(data) == size else ({"error": f"{len(data)} of {size} declared bytes"}, line + data)
            else:
                skipped += line
        except (EOFError, zlib.error, gzip.BadGzipFile) as e:
            yield {"error": f"broken gzip: {e}"}, bytes(skipped)
            return


def http_parts(content: bytes) -> tuple[bytes, bytes]:
    """The head with its blank line, and the payload; no head where the content is no HTTP message."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    ends = [at + len(e) for e in (b"\r\n\r\n", b"\n\n") if (at := content.find(e)) >= 0]
    return (content[: min(ends)], content[min(ends) :]) if ends else (b"", content)


def header(lines: bytes, name: str) -> str | None:
    for x in lines.split(b"\n"):
        if x.lower().startswith(name.lower().encode() + b":"):
            return x.split(b":", 1)[1].strip().decode("latin-1")
    return None


def number(text: str | None) -> int | None:
    """A 64-bit integer in ASCII digits; null for anything else, as foreign heads may say."""
    if not text or not re.fullmatch(r"-?[0-9]{1,19}", text):
        return None
    return n if -(1 << 63) <= (n := int(text)) < 1 << 63 else None


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def opened(content: pa.Scalar) -> io.BufferedIOBase:
    raw = content.as_buffer()
    return io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw)), 1 << 20) if bytes(raw[:2]) == b"\x1f\x8b" else io.BytesIO(raw)


def described(fields: dict[str, str], whole: bytes) -> dict:
    """What a WARC record needs of an ARC record beside its bytes."""
    if "error" in fields:
        return {"error": fields["error"], "bytes": len(whole)}
    head, body = http_parts(whole)
    d = fields["Archive-date"]
    day = "-".join(x for x in (d[:4], d[4:6], d[6:8]) if x)
    date = f"{day}T{d[8:10]}:{d[10:12] or '00'}:{d[12:14] or '00'}Z" if len(d) > 8 else day
    name = uuid.UUID(bytes=hashlib.sha1(f"{fields['URL']} {date} {base32_sha1(whole)}".encode()).digest()[:16], version=5)
    return {
        "page_id": number(header(head, "X-Page-Id")), "record_id": f"<urn:uuid:{name}>", "uri": fields["URL"], "date": date, "ip": fields.get("IP-address", ""), "kind": fields.get("Content-type", ""),
        "http": bool(head), "bytes": len(body), "digest": base32_sha1(body),
    }


RECORD = pa.schema([
    ("path", pa.string()), ("place", pa.int64()), ("page_id", pa.int64()), ("record_id", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("kind", pa.string()), ("http", pa.bool_()),
    ("bytes", pa.int64()), ("digest", pa.string()), ("error", pa.string()),
])
RECORD_DDL = "path string, place long, page_id long, record_id string, uri string, date string, ip string, kind string, http boolean, bytes long, digest string, error string"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Every URL record by its file and place: what a WARC record needs of it but its bytes, or the error that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, held = batch.column("path")[k].as_py(), []
                for place, (fields, whole) in enumerate(arc_records(opened(batch.column("content")[k]))):
                    held.append({"path": own, "place": place, **described(fields, whole)})
                    if len(held) == 10000:
                        yield pa.RecordBatch.from_pylist(held, RECORD)
                        held = []
                yield pa.RecordBatch.from_pylist(held, RECORD)

    return files(spark, path).mapInArrow(run, RECORD_DDL)


def warc_record(r: dict, whole: bytes, first: dict | None) -> bytes:
    """One record without the two line ends after it; of a revisit of `first` the head only."""
    head, _ = http_parts(whole)
    block = head if first else whole
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if first else 'response' if head else 'resource'}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['uri']}",
        *([f"WARC-IP-Address: {r['ip']}"] if r["ip"] not in ("", "0.0.0.0") else []), f"WARC-Payload-Digest: sha1:{r['digest']}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {first['record_id']}", f"WARC-Refers-To-Target-URI: {first['uri']}", f"WARC-Refers-To-Date: {first['date']}"] if first else []),
        f"Content-Type: {'application/http; msgtype=response' if head else r['kind'] or 'application/octet-stream'}", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + RECORD_END + block


def convert_arc(spark: SparkSession, arc: str, warc: str, least_bytes: int = 0, compress: bool = True) -> DataFrame:
    """WARC files of all records of the ARC files; equal payloads of `least_bytes` or more are kept once. Returns the records that are set aside, with their errors.

    Which records are revisits is found from descriptions without payloads; an archive's bytes then meet the
    list of its own revisits, so payloads are not moved by digest, however many share one.
    """
    scratch = Scratch(spark)
    found = scratch.cut(read_arc(spark, arc))
    known = found.where("error IS NULL AND http").where(F.col("bytes") >= least_bytes)
    # The smallest page id; without any, as in archives of others, the first record by file and place.
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.when(F.col("page_id").isNull(), F.struct("path", "place")).alias("at"), "record_id", "uri", "date", "path", "place")
    firsts = known.groupBy("digest").agg(F.min(order).alias("first"))
    itself = F.when(F.col("page_id").isNull(), (F.col("path") == F.col("first.path")) & (F.col("place") == F.col("first.place"))).otherwise(F.col("page_id") == F.coalesce("first.page_id", "page_id"))
    again = known.join(firsts, "digest").where(~itself).select("path", F.struct("place", "first.record_id", "first.uri", "first.date").alias("r"))
    revisits = scratch.cut(again.groupBy("path").agg(F.collect_list("r").alias("revisits")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for k in range(batch.num_rows):
                    first = {x["place"]: x for x in batch.column("revisits")[k].as_py() or []}
                    for place, (fields, whole) in enumerate(arc_records(opened(batch.column("content")[k]))):
                        if "error" not in fields:
                            yield warc_record(described(fields, whole), whole, first.get(place))

        info = b"software: voxelmill\r\nformat: WARC File Format 1.1\r\n"
        about = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, info.decode())}>\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
        yield from archives(records(), about.encode() + info, RECORD_END, compress)

    save(files(spark, arc).join(revisits, "path", "left").select("content", "revisits").mapInArrow(run, "value binary"), warc, RECORD_END, compress)
    scratch.drop(revisits)
    return found.where("error IS NOT NULL").select("path", "place", "bytes", "error")


def warc_records(content: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, by its declared length."""
    while line := content.readline():
        if not line.startswith(b"WARC/"):
            continue
        fields = {}
        while (line := content.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip()] = value.strip()
        yield fields, content.read(number(fields.get("Content-Length")) or 0)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_record string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Of every record but warcinfo: what its payload is, from the payload itself or, of revisits, from the headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "page_id payload_bytes payload_digest record_type record_id refers_record".split()
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
        for content in (opened(batch.column("content")[k]) for batch in batches for k in range(batch.num_rows)):
            rows = []
            for fields, block in warc_records(content):
                kind = fields["WARC-Type"]
                if kind == "warcinfo":
                    continue
                head, body = http_parts(block)
                stated = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
                if kind == "revisit":
                    size, digest = number(header(head, "Content-Length")), stated
                else:
                    size, digest = len(body), base32_sha1(body)
                    if stated and digest != stated:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload doesn't have the stated digest")
                rows.append((number(header(head, "X-Page-Id")), size, digest, kind, fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files(spark, path).select("content").mapInArrow(run, READ)


def archive_query(pages: DataFrame) -> DataFrame:
    """Pages to ARC, to WARC, and read back; the archives are in the shared folder of spark.checkpoint.dir until then."""
    spark = pages.sparkSession
    folder = f"{checkpoint_dir(spark)}/archives-{uuid.uuid4()}"
    write_arc(pages, f"{folder}/arc")
    bad = convert_arc(spark, f"{folder}/arc", f"{folder}/warc")
    if not bad.isEmpty():
        raise ValueError("an archive that was written here can't be read")
    found = cut(read_warc(spark, f"{folder}/warc"))
    remove(spark, folder)
    answered = found.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_record")).agg(F.min("page_id").alias("refers_to"))
    return found.join(answered, "refers_record", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB: base32 of a SHA-1 from its hex digits, five bits at a time.
ARCHIVE_SQL = """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
coded AS (
  SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 10 * g + 1, 10) AS BIGINT) >> (35 - 5 * k)) & 31 AS INTEGER), 1) FOR k IN range(8)], '') FOR g IN range(4)], '') AS payload_digest
  FROM hashed
), firsts AS (SELECT payload_digest, min(page_id) AS first FROM coded GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM coded JOIN firsts USING (payload_digest)
"""
