"""Legacy web archives: ARC files converted to WARC records, and both formats read by length.

An ARC file begins with a version block; its URL records are header lines whose fields depend on
that version and whose last field is the length of what follows. The converter parses them and
makes up what WARC wants besides: record ids, dates, types and digests. Files are opened by Spark's
reader for binary files and parsed as streams, so a task holds one compressed file and the records
of one batch.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.common import full_text, named
from furrow.session import new_path, ship_package

# ---- fixed values: header lines of both ARC versions, and WARC's names ----------------------
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum",
        "Location", "Offset", "Filename", "Archive-length"),
}
WARC_VERSION = "WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
# -------------------------------------------------------------------------------------------
CAPTURED = "20000101000000"
PAGE_HEADER = "X-Page-Id"
BATCH_BYTES = 8 << 20


def base32_sha1(content: bytes) -> str:
    return base64.b32encode(hashlib.sha1(content).digest()).decode()


def opened(content: bytes) -> io.BufferedReader:
    """A stream over a plain file or a gzip file of one or many members."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw)


def taken(stream: io.BufferedReader, length: int, what: str) -> bytes:
    found = stream.read(length)
    if len(found) != length:
        raise ValueError(f"{what}: {length} bytes declared, {len(found)} found")
    return found


# ---- ARC ------------------------------------------------------------------------------------

def arc_header(version: int, url: str, mime: str, body: bytes, name: str, status: str) -> str:
    plain = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(
        f"%{b:02X}" for b in m[0].encode()), url) or "-"
    values = {"URL": plain, "IP-address": "0.0.0.0", "Archive-date": CAPTURED,
              "Content-type": mime, "Result-code": status, "Checksum": "-", "Location": "-",
              "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(values[field] for field in ARC_FIELDS[version])


def arc_start(version: int, name: str) -> str:
    """The version block without its final line break."""
    body = f"{version} 0 furrow\n{' '.join(ARC_FIELDS[version])}\n"
    return arc_header(version, f"filedesc://{name}", "text/plain", body.encode(), name,
                      "200") + "\n" + body


def arc_records(content: bytes) -> Iterator[dict]:
    """The URL records of an ARC file: the header's fields, number, and the content."""
    stream = opened(content)
    first = stream.readline()
    if not first:
        return
    if not first.startswith(b"filedesc://"):
        raise ValueError(f"no ARC file begins with {first[:40]!r}")
    block = taken(stream, int(first.rsplit(b" ", 1)[1]), "version block")
    version = int(block.split(b" ", 1)[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version}")
    # The second line of the block names the fields of the file's own headers.
    declared = block.split(b"\n")[1:2]
    fields = declared[0].decode("utf-8", "replace").split() if declared else []
    fields, number = fields or ARC_FIELDS[version], 0
    lost = set(ARC_FIELDS[1]) - set(fields)
    if lost or fields[0] != "URL":
        raise ValueError(f"headers declared without {sorted(lost) or 'the URL in front'}")
    while line := stream.readline():
        if not line.strip():
            continue
        values = line.rstrip(b"\r\n").decode("utf-8", "replace").rsplit(" ", len(fields) - 1)
        if len(values) != len(fields):
            raise ValueError(f"header line {number} has {len(values)} fields")
        record = dict(zip(fields, values))
        yield record | {"number": number, "version": version, "content": taken(
            stream, int(record["Archive-length"]), f"record {number}")}
        number += 1


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header block (with its empty line) and payload; other content is payload alone."""
    if content.startswith(b"HTTP/"):
        head, found, payload = content.partition(b"\r\n\r\n")
        if found:
            return head + found, payload
    return b"", content


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
              html_col: str = "html", versions: tuple[int, ...] = (1, 2)) -> None:
    """Pages as gzipped ARC files, one per task, the versions in turn.

    A page is an HTTP response whose header names the page; null html is an empty payload, a null
    url is '-'.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(named(id_col).cast("long").alias("page_id"),
                        full_text(url_col).alias("url"), full_text(html_col).alias("html"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = versions[part % len(versions)], f"part-{part:05d}.arc"
        lines, size, begun = [], 0, False
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun:
                    lines.append(arc_start(version, name))
                    begun = True
                given = "" if page is None else f"{PAGE_HEADER}: {page}\r\n"
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{given}\r\n{html}"
                lines.append(arc_header(version, url, "text/html", content.encode(), name,
                                        "200") + "\n" + content)
                size += len(lines[-1])
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_pydict({"value": lines})
                    lines, size = [], 0
        if lines:
            yield pa.RecordBatch.from_pydict({"value": lines})

    rows.mapInArrow(records, "value string").write.option("compression", "gzip").option(
        "lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder, whatever their names; Spark leaves out those that begin with _ or a dot."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", "content")


ARC_SCHEMA = ("record_id string, url string, ip string, date string, mime string, "
              "version int, page_id long, head binary, payload binary, payload_bytes long, "
              "payload_digest string, block_digest string")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC files, with what their WARC counterparts need.

    Every file below the folder is read, whatever its name. A record id is made from the file's path
    below the folder and the place in it, so equal records stay apart and reruns agree. A file that
    is no ARC file, a header that does not fit the declared fields, or fewer bytes than declared,
    stops the read; an empty file has no records.
    """
    ship_package(spark)
    folder = re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", path).rstrip("/") + "/"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        schema = pa.schema([
            ("record_id", pa.string()), ("url", pa.string()), ("ip", pa.string()),
            ("date", pa.string()), ("mime", pa.string()), ("version", pa.int32()),
            ("page_id", pa.int64()), ("head", pa.binary()), ("payload", pa.binary()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("block_digest", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows, size = [], 0
                place = name.split(folder, 1)[-1]
                # A writer's own files are named anew by every run, but for their number.
                numbered = re.match(r"part-(\d+)-[0-9a-f-]{36}", place)
                for record in arc_records(content.as_py()):
                    head, payload = split_http(record["content"])
                    found = re.search(rb"\r\n" + PAGE_HEADER.encode() + rb": *(-?\d+)\r\n", head)
                    stamp = record["Archive-date"].ljust(14, "0")
                    rows.append({
                        "record_id": str(uuid.uuid5(uuid.NAMESPACE_URL, "{}/{}/{}".format(
                            numbered[1] if numbered else place, record["number"], record["URL"]))),
                        "url": record["URL"], "ip": record["IP-address"],
                        "date": "{}-{}-{}T{}:{}:{}Z".format(
                            stamp[:4], *(stamp[k:k + 2] for k in range(4, 14, 2))),
                        "mime": record["Content-type"], "version": record["version"],
                        "page_id": int(found[1]) if found else None, "head": head,
                        "payload": payload, "payload_bytes": len(payload),
                        "payload_digest": base32_sha1(payload),
                        "block_digest": base32_sha1(record["content"])})
                    size += len(payload)
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return _files(spark, path).mapInArrow(parse, ARC_SCHEMA)


# ---- WARC -----------------------------------------------------------------------------------

def write_warc(records: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Records of `read_arc` as gzipped WARC files.

    Of records with equal payloads of `least_bytes` or more, the one of the smallest page (null
    last, then smallest record id) is written whole; the others are revisits of it. Payloads are
    equal when digest and length are.
    """
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"),
                     F.col("record_id").alias("record"))
    first = records.where(F.col("payload_bytes") >= least_bytes).groupBy(
        "payload_digest", "payload_bytes").agg(
        F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = records.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & (F.col("first.record") != F.col("record_id"))
    http = F.octet_length("head") > 0

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    block = F.when(again, F.col("head")).otherwise(F.concat("head", "payload"))
    header = F.concat(
        F.lit(WARC_VERSION + "\r\n"),
        line("WARC-Type", F.when(again, "revisit").when(http, "response").otherwise("resource")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), "record_id", F.lit(">"))),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(again, F.concat(
            line("WARC-Profile", F.lit(REVISIT_PROFILE)),
            line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), "first.record", F.lit(">")))
        )).otherwise(line("WARC-Block-Digest", F.concat(F.lit("sha1:"), "block_digest"))),
        line("Content-Type", F.when(http, "application/http; msgtype=response")
             .otherwise(F.col("mime"))),
        line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    # A record ends in two line breaks, which the text writer puts behind each.
    rows.select(F.concat(header.cast("binary"), block).cast("string").alias("value")).write.option(
        "compression", "gzip").option("lineSep", "\r\n\r\n").text(path)


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields and block of every record of a WARC file."""
    stream = opened(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.lower()] = value.strip()
        yield fields, taken(stream, int(fields["content-length"]), fields["warc-record-id"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record.

    Digests of whole records are computed anew and compared with what their headers say. A revisit
    takes the length of the payload from the record that it refers to.
    """
    ship_package(spark)
    schema = ("record_id string, of_id string, record_type string, page_id long, "
              "payload_bytes long, payload_digest string")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block in warc_records(content.as_py()):
                    head, payload = split_http(block)
                    found = re.search(rb"\r\n" + PAGE_HEADER.encode() + rb": *(-?\d+)\r\n", head)
                    kind = fields["warc-type"]
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind != "revisit" and base32_sha1(payload) != digest:
                        raise ValueError(f"wrong digest of {fields['warc-record-id']}")
                    rows.append((fields["warc-record-id"], fields.get("warc-refers-to"), kind,
                                 int(found[1]) if found else None,
                                 None if kind == "revisit" else len(payload), digest))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (
                            pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(),
                            pa.string()))],
                        [part.split(" ")[0] for part in schema.split(", ")])

    records = _files(spark, path).mapInArrow(parse, schema)
    whole = records.where("record_type != 'revisit'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.lit(None).cast("long").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").select(
        "of_id", "page_id", "payload_digest", "record_type")
    known = records.where("record_type != 'revisit'").select(
        F.col("record_id").alias("of_id"), F.col("page_id").alias("refers_to"), "payload_bytes")
    return whole.unionByName(revisits.join(known, "of_id", "left").drop("of_id"))


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """All ARC files of a folder as WARC files in another."""
    write_warc(read_arc(spark, arc_path), warc_path, least_bytes)


def archived_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages written as ARC files, converted to WARC files, and read back: one row per page.

    Null html is an empty payload; pages with null ids lose against others and stay apart;
    repeated rows are one response and its revisits; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col)
    convert(spark, arc, warc, least_bytes)
    return read_warc(spark, warc)
