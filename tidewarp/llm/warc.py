"""Conversion of legacy ARC archives to WARC, and reading WARC back.

ARC files open with a version block that names the fields of the header lines to come (five in version 1, ten in
version 2); a record is one such line and as many bytes as it declares. The converter parses both versions by their
declared lengths and makes up what WARC asks for and ARC lacks: record identifiers (name-based UUIDs, so a retried task
writes the same bytes), ISO timestamps, record types, block and payload digests.

Payloads that occur before become revisit records. Which record is the response is found on (id, SHA-1) pairs alone;
the payloads themselves are never grouped, so a page copied to a third of all rows costs no skew. The archives are
written by Spark's own writer (committed atomically) below the shared folder, each file one gzip stream that opens with
a warcinfo record and holds ``FILE_BYTES`` of records at most, or one longer record. They are read back from there as whole
files; a reader, of ARC as of WARC, unpacks and holds one record at a time.

Defined results: a null html is the empty payload; empty payloads equal one another; a null url is written as
``urn:page:<page_id>``. Of equal payloads the smallest page_id is the response; null ids are last, and where all ids are
null, each is a response. Rows that repeat the response's page_id and payload are responses as well. An empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarp.llm.common import prepare, stage
from tidewarp.session import staging_path

FILE_BYTES = 16 << 20
SPACE_UUID = uuid.uuid5(uuid.NAMESPACE_URL, "urn:archive-records")
#: fixed values: the header fields of the two ARC versions, as their version blocks spell them
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD = "source_id long, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- ARC

def arc_head(version: int, name: str = "pages.arc", date: str = "20240101000000") -> bytes:
    body = f"{version} 0 {'-'}\n{ARC_FIELDS[version]}\n".encode()
    fields = [f"filedesc://{name}", "0.0.0.0", date, "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str, content: bytes, mime: str = "text/html", date: str = "20240101000000", ip: str = "0.0.0.0",
               status: str = "200", name: str = "pages.arc") -> bytes:
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    fields = [url, ip, date, mime] + ([status, "-", "-", "0", name] if version == 2 else [])
    return " ".join([*fields, str(len(content))]).encode() + b"\n" + content + b"\n"


def arc_parse(stream):
    """Records of an ARC stream (a binary file object) as dicts of the fields its version names, and ``content``."""
    names = None
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        line = line.decode("utf-8", "replace").rstrip("\r\n")
        if names is None:
            if not line.startswith("filedesc:"):
                raise ValueError("an ARC file begins with its version block")
            body = stream.read(int(line.rsplit(" ", 1)[1])).decode("utf-8", "replace").splitlines()
            version = int(body[0].split()[0])
            names = (body[1] if len(body) > 1 and body[1].strip() else ARC_FIELDS[version]).split()
            continue
        # an old crawler may have left spaces in a URL: the other fields count from the right
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"header line with {len(values)} of {len(names)} fields: {line[:200]}")
        record = dict(zip(names, values))
        length = int(record["Archive-length"])
        record["content"] = stream.read(length)
        if len(record["content"]) != length:
            raise ValueError("the archive ends inside a record")
        yield record


def warc_date(date14: str) -> str:
    """ISO time of an ARC date: 14 digits, or 12 without seconds, or 8 without time."""
    d = (date14 + "000000")[:14] if date14.isdigit() and len(date14) >= 8 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


# ---------------------------------------------------------------- WARC

def _split_http(content: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its empty line) and payload; content without a head is all payload."""
    if content.startswith(b"HTTP/"):
        end = content.find(b"\r\n\r\n")
        if end >= 0:
            return content[:end + 4], content[end + 4:]
    return b"", content


def record_id(source_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE_UUID, str(source_id))}>"


def _warc(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def warc_info(name: str, date: str = "2024-01-01T00:00:00Z") -> bytes:
    block = b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/\r\n"
    return _warc([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(SPACE_UUID, 'info:' + name)}>"), ("WARC-Date", date),
                  ("Content-Type", "application/warc-fields")], block)


def from_arc(record: dict, source_id, refers_to=None) -> bytes:
    """The WARC record equal to a parsed ARC record: a response, or a revisit of the record of row ``refers_to``."""
    head, payload = _split_http(record["content"])
    is_http = bool(head)
    sha = digest(payload)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(source_id)),
              ("WARC-Date", warc_date(record["Archive-date"])), ("WARC-Target-URI", record["URL"]), ("WARC-IP-Address", record["IP-address"]),
              ("WARC-Payload-Digest", f"sha1:{sha}"), ("WARC-Identified-Payload-Type", record["Content-type"]),
              ("WARC-Source-Row", "-" if source_id is None else str(source_id))]
    block = record["content"]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)),
                   ("WARC-Refers-To-Source-Row", str(refers_to)), ("WARC-Payload-Length", str(len(payload)))]
        block = head
    fields += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http;msgtype=response" if is_http else record["Content-type"])]
    return _warc(fields, block)


def warc_parse(stream):
    """(fields, block) of each record of a WARC stream (a binary file object), by declared lengths."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            k, _, v = line.partition(b":")
            fields[k.decode().lower()] = v.strip().decode()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError("the archive ends inside a record")
        yield fields, block


def _number(text: str | None):
    """A row's number; None for a record that no numbered row made."""
    return int(text) if text and text.removeprefix("-").isdigit() else None


def _unpacked(content: bytes):
    """A stream over an archive, gzipped or plain."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if content[:2] == b"\x1f\x8b" else raw


def _rows(content: bytes):
    """Rows of RECORD of one archive, gzipped or plain."""
    for fields, block in warc_parse(_unpacked(content)):
        kind = fields["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        payload = _split_http(block)[1] if kind == "response" else None
        if payload is not None and named and digest(payload) != named:
            raise ValueError(f"digest of {fields['warc-record-id']} differs from its payload")
        n = len(payload) if payload is not None else _number(fields.get("warc-payload-length"))
        yield (_number(fields.get("warc-source-row")), fields.get("warc-target-uri"), fields.get("warc-date"), kind, n, named or digest(payload or b""),
               _number(fields.get("warc-refers-to-source-row")), payload)


# ---------------------------------------------------------------- on Spark

def read(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The response and revisit records of the WARC files under ``path``."""
    prepare(spark)
    schema = RECORD if with_payload else RECORD.removesuffix(", payload binary")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for b in batches:
            for content in b.column(0):
                rows, held = [], 0
                for row in _rows(content.as_py()):
                    rows.append(row[:len(names)])
                    held += len(row[-1] or b"") if with_payload else 100
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def convert_arc(spark: SparkSession, arc_path: str, out: str) -> None:
    """Convert the ARC files under ``arc_path`` to WARC files under ``out``, every record a response."""
    prepare(spark)

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                for i, record in enumerate(arc_parse(_unpacked(content.as_py()))):
                    yield from_arc(record, f"{name}#{i}")

    _write(spark.read.format("binaryFile").load(arc_path).select("path", "content").mapInArrow(lambda batches: _files(run(batches), "archive"), "file binary"), out)


def _files(records, name: str):
    """The records of a task as the contents of files, one a row."""
    def whole():
        # the writer ends a file with the line feed that its last byte lacks here
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["file"])

    info = warc_info(name)
    held, size = [info], len(info)
    for record in records:
        if len(held) > 1 and size + len(record) > FILE_BYTES:
            yield whole()
            held, size = [info], len(info)
        held.append(record)
        size += len(record)
    if len(held) > 1:
        yield whole()


def _write(files: DataFrame, out: str) -> None:
    (files.select(F.col("file").cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\n")
     .option("maxRecordsPerFile", 1).text(out))


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the rows whose payload, of ``least_bytes`` or more, belongs to a smaller page_id."""
    payload = F.coalesce("html", F.lit(""))
    keyed = stage(pages.select("page_id", "html").where(F.octet_length(payload) >= least_bytes)
                  .select("page_id", F.unhex(F.sha1(payload)).alias("sha")), "warc-keys")
    first = stage(keyed.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null")
                  .select("sha", "refers_to"), "warc-first")
    return stage(keyed.join(first, "sha").where("page_id is null or page_id <> refers_to").distinct(), "warc-revisits")


def write_pages(pages: DataFrame, out: str, least_bytes: int = 0) -> None:
    """Write every row of ``pages`` (page_id, url, html) as an ARC record, odd ids in version 2, and convert the archive
    to WARC files under ``out``."""
    prepare(pages.sparkSession)
    again = revisits(pages, least_bytes).select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), "refers_to")
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html").withColumn("sha", F.unhex(F.sha1(payload)))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select("page_id", "url", "html", "refers_to")

    def run(batches):
        for b in batches:
            ids, urls, refers = (b.column(i).to_pylist() for i in (0, 1, 3))
            for lo in range(0, b.num_rows, 64):
                own = range(lo, min(lo + 64, b.num_rows))
                for version in (1, 2):
                    part = [i for i in own if 1 + (ids[i] or 0) % 2 == version]
                    arc = [arc_head(version)]
                    for i in part:
                        body = (b.column(2)[i].as_py() or "").encode()
                        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                        arc.append(arc_record(version, urls[i] or f"urn:page:{ids[i]}", head + body))
                    for i, r in zip(part, arc_parse(io.BytesIO(b"".join(arc)))):
                        yield from_arc(r, ids[i], refers[i])

    _write(rows.mapInArrow(lambda batches: _files(run(batches), "pages"), "file binary"), out)


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as WARC files under the shared folder and read them back: (page_id, payload_bytes,
    payload_digest, record_type, refers_to)."""
    out = staging_path(pages.sparkSession, "warc")
    write_pages(pages, out, least_bytes)
    return read(pages.sparkSession, out, with_payload=False).select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
