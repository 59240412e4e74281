"""Operator 8, WARC: pages held in legacy ARC files are converted to WARC records and read back.

ARC: a file opens with a version block (`filedesc://...`) whose second line gives the version and whose third
names the header fields of version 1 (5 fields) or 2 (10 fields). Every record is a header line and as
many bytes as it declares. The converter reads headers by the field names of the file at hand and derives
what WARC needs: record id from digest and place, date from 14 digits, type, payload and block digests.

Of records with equal payloads of at least `REVISIT_FROM` bytes, the one with the smallest page id (then
archive and offset) is the response and the others revisit it, without its payload. Payloads are joined
with the few repeated digests only. Files are written by Spark's text sink, gzip-compressed, one segment of
about `SEGMENT` bytes each: a record is text around a UTF-8 payload, and the line separator ends records.

Null html is an empty payload; null urls are written as `-` and get no target URI; null ids sort last and
come back null. Rows that repeat id and payload stay separate records. An empty table gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemart.llm.session import prepared, stored, table
from tidemart.session import work_dir

REVISIT_FROM = 100
SEGMENT = 8 << 20
FETCHED = "20000101000000"
V1 = ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length")
V2 = ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")
_PARSED = "page_id long, uri string, date string, mime string, archive string, offset long, digest string, payload_bytes long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- ARC


def _version_block(name: str, version: int) -> bytes:
    body = f"{version} 0 tidemart\n{' '.join(V1 if version == 1 else V2)}\n".encode()
    tail = "200 - - 0 " + name + " " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {FETCHED} text/plain {tail}{len(body)}\n".encode() + body


def _uri(url: str | None) -> str:
    """One token: white space and control characters are percent-encoded, and nothing else."""
    return "".join(c if c > " " and c != "\x7f" and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "-"


def arc_record(name: str, version: int, offset: int, page_id: int | None, url: str | None, html: bytes) -> bytes:
    mark = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n{mark}\r\n".encode() + html
    extra = f"200 - - {offset} {name} " if version == 2 else ""
    return f"{_uri(url)} 0.0.0.0 {FETCHED} text/html {extra}{len(block)}\n".encode() + block


def _arc_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments by ARC version: even ids go to version 1 files, odd ones to version 2."""
    part, made = TaskContext.get().partitionId(), 0
    held: dict[int, list] = {}

    def done(version: int) -> pa.RecordBatch:
        return pa.record_batch({"value": pa.array([b"\n".join(held.pop(version)[2])], pa.binary())})

    for batch in batches:
        for page_id, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html"))):
            version = 1 + (page_id or 0) % 2
            if version not in held:
                name = f"pages-{part:06d}-{made:06d}.arc"
                block = _version_block(name, version)
                held[version], made = [name, len(block) + 1, [block]], made + 1
            name, offset, records = held[version]
            records.append(arc_record(name, version, offset, page_id, url, html or b""))
            held[version][1] += len(records[-1]) + 1
            if held[version][1] >= SEGMENT:
                yield done(version)
    for version in list(held):
        yield done(version)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of one ARC file, by the header fields that its version block names."""
    at, fields, name = 0, V1, ""
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode().split(" ")
        if line[0].startswith("filedesc://"):
            name = line[0][len("filedesc://") :]
            size = int(line[-1])
            fields = tuple(data[end + 1 : end + 1 + size].decode().split("\n")[1].split(" "))
            at = end + 1 + size
            continue
        if len(line) != len(fields):
            raise ValueError(f"{name}: {len(line)} header fields at {at}, the version block names {len(fields)}")
        header = dict(zip(fields, line))
        size = int(header["Archive-length"])
        block = data[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"{name}: record at {at} declares {size} bytes, {len(block)} are left")
        yield {"header": header, "block": block, "archive": name, "offset": at}
        at = end + 1 + size


def _http(block: bytes) -> tuple[dict[str, str], int]:
    """Header fields in lower case, and where the payload starts."""
    end = block.index(b"\r\n\r\n")
    lines = block[:end].decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}, end + 4


def _read_arc(with_block: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for r in parse_arc(gzip.decompress(content.as_py())):
                    http, at = _http(r["block"])
                    payload = r["block"][at:]
                    page = http.get("x-page-id")
                    rows.append(
                        {
                            "page_id": None if page is None else int(page), "uri": r["header"]["URL"], "date": r["header"]["Archive-date"],
                            "mime": r["header"]["Content-type"], "archive": r["archive"], "offset": r["offset"],
                            "digest": hashlib.sha256(payload).hexdigest(), "payload_bytes": len(payload), **({"block": r["block"]} if with_block else {}),
                        }
                    )
                yield pa.RecordBatch.from_pylist(rows, _schema(with_block))

    return read


def _schema(with_block: bool) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [pa.field(n, kinds[k]) for n, k in (x.split(" ") for x in _PARSED.split(", "))]
    return pa.schema(fields + [pa.field("block", pa.binary())] * with_block)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


# ---- WARC


def _instant(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, offset: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}:{offset}:{digest}')}>"


def warc_record(kind: str, id: str, date: str, uri: str, payload_digest: str, block: bytes, refers_to: str | None = None) -> bytes:
    """Header and block, without the two line ends that close a record."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {id}", f"WARC-Date: {_instant(date)}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{payload_digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}",
    ]
    if uri != "-":
        head.insert(4, f"WARC-Target-URI: {uri}")
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def _warc_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            block, original = r["block"], r["original"]
            id = record_id(r["archive"], r["offset"], r["digest"])
            first = original is None or (original["archive"], original["offset"]) == (r["archive"], r["offset"])
            if first:
                record = warc_record("response", id, r["date"], r["uri"], r["digest"], block)
            else:
                refers = record_id(original["archive"], original["offset"], r["digest"])
                record = warc_record("revisit", id, r["date"], r["uri"], r["digest"], block[: _http(block)[1]], refers)
            held.append(record)
            size += len(record)
            if size >= SEGMENT:
                yield pa.record_batch({"value": pa.array([b"\r\n\r\n".join(held)], pa.binary())})
                held, size = [], 0
    if held:
        yield pa.record_batch({"value": pa.array([b"\r\n\r\n".join(held)], pa.binary())})


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields in lower case and block of each record of a WARC file."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"no record at {at}")
        header = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        at = end + 4 + int(header["content-length"])
        yield header, data[end + 4 : at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record before {at} is not closed")
        at += 4


def _read_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests are taken anew from the payload where it is there, and must agree with the header."""
    for batch in batches:
        for content in batch["content"]:
            rows = []
            for header, block in parse_warc(gzip.decompress(content.as_py())):
                http, at = _http(block)
                digest = header["warc-payload-digest"].removeprefix("sha256:")
                kind, page = header["warc-type"], http.get("x-page-id")
                if kind == "response" and hashlib.sha256(block[at:]).hexdigest() != digest:
                    raise ValueError(f"payload of {header['warc-record-id']} does not match its digest")
                size = len(block) - at if kind == "response" else int(http["content-length"])
                rows.append((None if page is None else int(page), size, digest, kind, header["warc-record-id"], header.get("warc-refers-to")))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            names = ("page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id")
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def write_segments(rows: DataFrame, segments, path: str, end: str) -> None:
    """One gzip file per segment: the text sink adds the end of its last record."""
    made = rows.mapInArrow(segments, "value binary").select(F.col("value").cast("string"))
    made.write.option("lineSep", end).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str) -> None:
    write_segments(pages.select("page_id", "url", F.col("html").cast("binary").alias("html")), _arc_segments, path, "\n")


def convert(spark: SparkSession, arc: str, warc: str) -> None:
    """Read ARC files below `arc` and write the equivalent WARC files below `warc`."""
    found = _files(spark, arc).mapInArrow(_read_arc(False), _PARSED)
    large = found.filter(f"payload_bytes >= {REVISIT_FROM}")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "archive", "offset")
    firsts = large.groupBy("digest").agg(F.min(order).alias("original"), F.count("*").alias("n")).filter("n > 1")
    firsts = stored(firsts.select("digest", F.struct("original.archive", "original.offset").alias("original")), "warc-originals")
    rows = _files(spark, arc).mapInArrow(_read_arc(True), f"{_PARSED}, block binary")
    write_segments(rows.join(firsts, "digest", "left"), _warc_segments, warc, "\r\n\r\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, record_id, refers_to_id of every record below `path`."""
    return _files(spark, path).mapInArrow(
        _read_warc, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string"
    )


def op8(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    work = work_dir(prepared(spark), "warc")
    write_arc(pages, f"{work}/arc")
    convert(spark, f"{work}/arc", f"{work}/warc")
    records = stored(read_warc(spark, f"{work}/warc"), "warc-records")
    responses = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    revisits = records.filter("record_type = 'revisit'").join(responses, "refers_to_id")
    rest = records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return revisits.select(*names).unionByName(rest.select(*names))


SQL8 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {REVISIT_FROM} AND page_id <> first_id THEN first_id END AS refers_to
FROM m
"""
