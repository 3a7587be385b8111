"""Legacy ARC archives, and their conversion to WARC.

An ARC file begins with a version block (`filedesc://`) whose second line names the version: version 1 records have
URL, IP address, 14-digit date, content type and length in their header line, version 2 records also result code,
checksum, location, offset and file name. The length is the only thing that says where a record ends. Each record
becomes a WARC record: its identifier is a name-based UUID of the URL, the date, the key, the place in the archive and the
digest, so that repeated records have identifiers of their own and a second conversion gives the same; its date is
the ARC date in ISO form; HTTP responses become `response` records, or `revisit` records if an equal payload of at
least 100 bytes has a smaller key, all others `resource`; block and payload digests are computed from the bytes.

Files are gzipped and written by Spark's text writer, a record a row, so that any store Spark writes to will do: the
writer's line separator is what each format puts after a record. They are read whole by the binaryFile reader; the
number of files follows the volume, so that a file has about `FILE_BYTES`, or the size of one larger record.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, scratch_path, settle

FILE_BYTES = 16_000_000
#: Payloads with fewer bytes are never revisits.
REVISIT_BYTES = 100
ARC_V1 = b"URL IP-address Archive-date Content-type Archive-length"
ARC_V2 = b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 9562: URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY = "X-Archive-Key"
_DATE = re.compile(rb"\d{14}\Z")


def arc_record(version: int, url: str, date: str, mime: str, content: bytes, ip: str = "0.0.0.0", status: int = 200, offset: int = 0) -> bytes:
    """A record without the line feed after it. White space in a URL would break the header line and is escaped."""
    url = re.sub(r"[\s\x00-\x20]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    middle = f" {status} {zlib.crc32(content):08x} - {offset} -" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{middle} {len(content)}\n".encode() + content


def arc_head(version: int, date: str = "20000101000000") -> bytes:
    body = b"%d 0 tidewell\n" % version + (ARC_V1 if version == 1 else ARC_V2) + b"\n"
    return arc_record(version, "filedesc://tidewell.arc", date, "text/plain", body)


def http_response(body: bytes, key: int | None, mime: str = "text/html; charset=utf-8") -> bytes:
    name = "" if key is None else f"{KEY}: {key}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}\r\n{name}Content-Length: {len(body)}\r\n\r\n".encode() + body


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an uncompressed ARC file after its version block; a malformed header line or a short record raises ValueError."""
    at, version = 0, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":  # what stands between records
            at += 1
            continue
        end = data.find(b"\n", at)
        fields = data[at : end if end >= 0 else len(data)].rstrip(b"\r").split(b" ")
        if end < 0 or len(fields) < 5 or not fields[-1].isdigit():
            raise ValueError(f"ARC header line at {at}: {fields[:3]!r}")
        length = int(fields[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) != length:
            raise ValueError(f"ARC record at {at}: {len(content)} of {length} bytes")
        if fields[0].startswith(b"filedesc://"):
            version = int(content.split(b" ", 1)[0])
            if version not in (1, 2):
                raise ValueError(f"ARC version {version}")
        else:
            tail = 5 if version == 2 else 0
            if version == 0 or len(fields) < 5 + tail or not _DATE.match(fields[2 if len(fields) == 5 + tail else -3 - tail]):
                raise ValueError(f"ARC header line at {at} isn't of version {version}")
            mime = fields[-2 - tail]
            yield {
                "offset": at, "url": b" ".join(fields[: -4 - tail]).decode("utf-8", "replace"), "ip": fields[-4 - tail].decode("latin-1"),
                "date": fields[-3 - tail].decode(), "mime": mime.decode("latin-1"), "status": int(fields[-6]) if tail and fields[-6].isdigit() else None, "content": content,
            }
        at = end + 1 + length


def split_http(content: bytes) -> tuple[bytes, bytes] | None:
    """Head, with the empty line after it, and body of an HTTP response; None if it isn't one."""
    if not content.startswith(b"HTTP/"):
        return None
    for gap in (b"\r\n\r\n", b"\n\n"):
        if (at := content.find(gap)) >= 0:
            return content[: at + len(gap)], content[at + len(gap) :]
    return content, b""


def field(head: bytes, name: str) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*(.*?)\r?$", head)
    return m[1].decode("utf-8", "replace") if m else None


def key_of(name: str | None) -> int | None:
    """A key header's value if it is a signed 64-bit number; other values are no key."""
    key = int(name) if name and re.fullmatch(r"-?[0-9]{1,19}", name) else None
    return key if key is not None and -(1 << 63) <= key < 1 << 63 else None


def iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def record_id(url: str, date: str, key: str, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join((url, date, key, digest)))}"


def warc_record(kind: str, rid: str, url: str, date: str, ip: str, block: bytes, mime: str, digest: str | None, refers: str | None = None) -> bytes:
    """A record without the two line ends after it."""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"Content-Type: {mime}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}",
    ]
    if refers:
        head[2:2] = [f"WARC-Refers-To: <{refers}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(head, block) of each record; a record that doesn't begin with WARC/ or is cut short raises ValueError."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at {at}")
        head = data[at : end + 2]
        n = int(field(head, "Content-Length") or -1)
        block = data[end + 4 : end + 4 + n]
        if n < 0 or len(block) != n or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at {at} is cut short")
        yield head, block
        at = end + 8 + n


def gunzip(data: bytes) -> bytes:
    """All members of a gzip file; other data as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out) or data


def _save(rows: DataFrame, path: str, after: str) -> str:
    """Write the rows' binary column `value`, each followed by `after`."""
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", after).option("compression", "gzip").text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def write_arc(pages: DataFrame, path: str, version: int = 1, date: str = "20000101000000", file_bytes: int = FILE_BYTES) -> str:
    """Frame pages (page_id, url, html) as ARC files. A null html is an empty payload, a null url the URL `-`.

    Rows are dealt evenly, whatever their keys: no file has more than its share of a page_id that many rows have, or of
    rows without one. No rows give one file without records.
    """
    rows = only(pages, "page_id", "url", "html")
    volume = rows.select(F.sum(F.octet_length("html")).alias("n")).first()["n"] or 0
    files = max(1, -(-volume // file_bytes))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [arc_head(version, date)] if first else []
                first = False
                for key, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    out.append(arc_record(version, url or "-", date, "text/html", http_response((html or "").encode(), key)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    return _save(rows.repartition(files).mapInArrow(work, "value binary"), path, "\n")


_FACTS = "source string, key long, record_id string, digest string, payload_bytes long, http boolean"


def _arc_rows(files: list) -> Iterator[tuple]:
    """Of each record: (source, key, url, ip, ISO date, mime, HTTP head or None, payload, digest, record id)."""
    for path, content in files:
        for r in parse_arc(gunzip(content)):
            parts = split_http(r["content"])
            head, payload = parts if parts else (None, r["content"])
            source = f"{path.rsplit('/', 1)[-1]}:{r['offset']}"
            name = field(head, KEY) if head else None
            key = key_of(name)
            digest = hashlib.sha256(payload).hexdigest()
            yield source, key, r["url"], r["ip"], iso(r["date"]), r["mime"], head, payload, digest, record_id(r["url"], r["date"], f"{name or ''}@{source}", digest)


def convert(spark: SparkSession, arc: str, path: str, least: int = REVISIT_BYTES) -> str:
    """Convert the ARC files of a folder to WARC files in `path`, as many as there are.

    Of HTTP responses with equal payloads of at least `least` bytes, the one with the smallest key is a response and
    the others revisits of it that keep their HTTP head only; those without a key, and shorter ones, are responses.
    Of repeated keys the record with the least source (file and offset) counts as smaller. First the digests alone
    are gathered, so that a payload with any number of copies moves no bytes; the decisions come back by source.
    """

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(r[0], r[1], r[9], r[8], len(r[7]), r[6] is not None) for r in _arc_rows([pair])]
                for at in range(0, len(rows), 5_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c) if i not in (1, 4) else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows[at : at + 5_000], strict=True))], names=["source", "key", "record_id", "digest", "payload_bytes", "http"])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pair, known in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2).to_pylist(), strict=True):
                revisits = {x["source"]: x["refers"] for x in known or ()}
                out, size = [], 0
                for source, _, url, ip, date, mime, head, payload, digest, rid in _arc_rows([pair]):
                    if head is None:
                        out.append(warc_record("resource", rid, url, date, ip, payload, mime, digest))
                    elif source in revisits:
                        out.append(warc_record("revisit", rid, url, date, ip, head, "application/http; msgtype=response", digest, revisits[source]))
                    else:
                        out.append(warc_record("response", rid, url, date, ip, head + payload, "application/http; msgtype=response", digest))
                    size += len(out[-1])
                    if size > 2_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    files = _files(spark, arc)
    known = settle(files.mapInArrow(facts, _FACTS).where("http and key is not null").where(F.col("payload_bytes") >= least), "arc-facts")
    rank = F.struct("key", "source", "record_id")
    groups = settle(known.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "payloads")
    revisits = known.join(groups, "digest").where(F.col("source") != F.col("first.source"))
    # one row a file: as many decisions as the file has records, and a file has a bounded size
    by_file = revisits.groupBy(F.substring_index("source", ":", 1).alias("file")).agg(F.collect_list(F.struct("source", F.col("first.record_id").alias("refers"))).alias("known"))
    rows = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(by_file, "file", "left").select("path", "content", "known")
    return _save(rows.mapInArrow(records, "value binary"), path, "\r\n\r\n")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: (key, record_id, record_type, refers_to, url, date, payload_bytes, payload_digest).

    Block digests are verified. Size and digest of a response's payload come from its bytes, those of a revisit, whose
    payload isn't there, from its headers. refers_to is a record id.
    """
    names = ["key", "record_id", "record_type", "refers_to", "url", "date", "payload_bytes", "payload_digest"]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(1):
                out = []
                for head, block in parse_warc(gunzip(content.as_py())):
                    if field(head, "WARC-Block-Digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
                        raise ValueError("a WARC block doesn't have its digest")
                    kind = field(head, "WARC-Type")
                    http, payload = split_http(block) or (b"", block)
                    name = field(http, KEY)
                    if kind == "revisit":
                        size, digest = int(field(http, "Content-Length") or 0), (field(head, "WARC-Payload-Digest") or "").removeprefix("sha256:")
                    else:
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    refers = field(head, "WARC-Refers-To")
                    out.append((key_of(name), (field(head, "WARC-Record-ID") or "")[1:-1], kind, refers[1:-1] if refers else None, field(head, "WARC-Target-URI"), field(head, "WARC-Date"), size, digest))
                for at in range(0, len(out), 5_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 5_000], strict=True), kinds, strict=True)], names=names)

    return _files(spark, path).mapInArrow(work, "key long, record_id string, record_type string, refers_to string, url string, date string, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages as ARC files, converted to WARC and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    pages needs page_id, url and html; null html is an empty payload. refers_to is the page_id of the response that a
    revisit refers to, found by its record id. A row whose page_id is null has no key and is a response; rows with
    the same page_id are records of their own. Very long pages stay whole; further columns are ignored; no rows give none.
    """
    spark = pages.sparkSession
    arc = write_arc(pages, scratch_path(spark, "arc"), version)
    warc = convert(spark, arc, scratch_path(spark, "warc"))
    rows = settle(read_warc(spark, warc), "warc-rows")
    cited = settle(rows.where("refers_to is not null").select("refers_to").distinct(), "cited")
    keys = settle(rows.select(F.col("record_id").alias("refers_to"), F.col("key").alias("refers_key")).join(cited, "refers_to", "left_semi").distinct(), "cited-keys")
    plain = rows.where("refers_to is null").withColumn("refers_key", F.lit(None).cast("long"))
    found = rows.where("refers_to is not null").join(keys, "refers_to", "left")
    return found.unionByName(plain).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_key").alias("refers_to"))
