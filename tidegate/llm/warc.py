"""Legacy archives to WARC: ARC files of version 1 and 2 are parsed and rewritten as WARC/1.1 records.

An ARC file starts with a version block that names the fields of its record lines; a record is such a line
and as many bytes as it declares. The converter gives each record what WARC asks for and ARC lacks:
an identifier made from the record's own fields (so a repeated run makes the same), a date in ISO form, a
type, and digests of block and payload. Records whose payload another record keeps become revisits.

Executors write archives of a bounded size to the shared folder and read them back in a second pass.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blobs
from ._base import Scratch, need, quoted, schema

FIELDS_V1 = "URL IP-address Archive-date Content-type Archive-length"
FIELDS_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, RFC 4122
ID_HEADER = "X-Archive-Key"
NO_URL = "urn:none"
FILE_BYTES = 32 << 20
CHUNK_BYTES = 4 << 20


class BadArchive(ValueError):
    """An archive that doesn't hold what it declares."""


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    version_block: bool = False  # the first record of a file, whatever the URLs of others are


def inflate(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file, or the data itself."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        out = member.decompress(data) + member.flush()
        if not member.eof:
            raise BadArchive("a gzip member is cut off")
        yield out
        data = member.unused_data


def arc_version_block(version: int, name: str, date: str) -> bytes:
    rest = f"{version} 0 archive\n{FIELDS_V1 if version == 1 else FIELDS_V2}\n\n".encode()
    first = f"filedesc://{name} 0.0.0.0 {date} text/plain "
    first += f"{len(rest)}\n" if version == 1 else f"200 - - 0 {name} {len(rest)}\n"
    return first.encode() + rest


def bare(url: str) -> str:
    """A URL as a record line can hold it: white space in percent form."""
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"


def arc_record(version: int, record: ArcRecord, offset: int = 0, name: str = "-") -> bytes:
    line = f"{bare(record.url)} {record.ip} {record.date} {record.mime} "
    if version == 2:
        line += f"200 {hashlib.md5(record.body).hexdigest()} - {offset} {name} "
    return f"{line}{len(record.body)}\n".encode() + record.body + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, its version block first (mime text/plain, URL filedesc:...)."""
    data = b"".join(inflate(data))
    at = data.find(b"\n")
    head = data[:at].decode("utf-8", "replace").split(" ")
    if at < 0 or not head[0].startswith("filedesc:"):
        raise BadArchive("no version block")
    try:
        length = int(head[-1])
    except ValueError:
        raise BadArchive("the version block declares no length") from None
    block = data[at + 1 : at + 1 + length]
    lines = block.decode("utf-8", "replace").split("\n")
    version = lines[0].split(" ")[0]
    if version not in ("1", "2"):
        raise BadArchive(f"unknown version {version!r}")
    fields = lines[1].split(" ") if len(lines) > 1 and lines[1] else (FIELDS_V1 if version == "1" else FIELDS_V2).split(" ")
    place = {f.lower(): i for i, f in enumerate(fields)}
    yield ArcRecord(head[0], head[1], head[2], head[3], block, True)
    at += 1 + length
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            raise BadArchive("a record line is cut off")
        # the URL may hold spaces in old files, the other fields can't
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(fields) - 1)
        if len(parts) != len(fields) or not parts[-1].isdigit():
            raise BadArchive(f"not a record line of version {version}: {parts[:1]}")
        length = int(parts[place["archive-length"]])
        if end + 1 + length > len(data):
            raise BadArchive("a record is shorter than declared")
        yield ArcRecord(parts[place["url"]], parts[place["ip-address"]], parts[place["archive-date"]], parts[place["content-type"]], data[end + 1 : end + 1 + length])
        at = end + 1 + length


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_date(date: str) -> str:
    """ISO form of an ARC date of 4 to 14 digits; missing parts are the first of their kind."""
    digits = re.sub(r"\D", "", date)[:14]
    digits += "00000101000000"[len(digits) :] if len(digits) >= 4 else ""
    if len(digits) != 14:
        digits = "19700101000000"
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes] | None:
    """(head with its blank line, payload) of an HTTP message."""
    if not body.startswith(b"HTTP/"):
        return None
    for gap in (b"\r\n\r\n", b"\n\n"):
        at = body.find(gap)
        if at >= 0:
            return body[: at + len(gap)], body[at + len(gap) :]
    return body, b""


def record_id(record: ArcRecord, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{record.url} {record.date} {payload_digest} {digest(record.body)}')}>"


def to_warc(record: ArcRecord, revisits: Callable[[ArcRecord, str], dict[str, str] | None] = lambda r, d: None) -> bytes:
    """The WARC record of an ARC record; revisits gives the extra headers of a revisit, or None."""
    http = split_http(record.body)
    payload = http[1] if http else record.body
    sha, block = digest(payload), record.body
    head = {"WARC-Record-ID": record_id(record, sha), "WARC-Date": warc_date(record.date)}
    if record.version_block:
        kind, mime = "warcinfo", "application/warc-fields"
        head["WARC-Filename"] = record.url.split("://", 1)[-1]
        block = f"software: arc converter\r\nformat: WARC File Format 1.1\r\ndescription: converted from {head['WARC-Filename']}\r\n".encode()
    elif http:
        kind, mime = "response", "application/http; msgtype=response"
        if more := revisits(record, sha):
            kind, block = "revisit", http[0]
            head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Truncated": "length"} | more
        head |= {"WARC-Payload-Digest": f"sha1:{sha}", "X-Payload-Length": str(len(payload))}
    else:
        kind, mime = "resource", record.mime or "application/octet-stream"
        head |= {"WARC-Payload-Digest": f"sha1:{sha}", "X-Payload-Length": str(len(payload))}
    if kind != "warcinfo":
        head |= {"WARC-Target-URI": record.url}
        if re.fullmatch(r"[0-9a-fA-F.:]+", record.ip) and record.ip != "0.0.0.0":
            head["WARC-IP-Address"] = record.ip
    head = {"WARC-Type": kind} | head | {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": mime, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of the records of a WARC file; digests and lengths are checked."""
    for part in inflate(data):
        at = 0
        while at < len(part):
            end = part.find(b"\r\n\r\n", at)
            if not part.startswith(b"WARC/", at) or end < 0:
                raise BadArchive("no WARC record where one should start")
            head = {}
            for line in part[at:end].decode("utf-8").split("\r\n")[1:]:
                k, _, v = line.partition(":")
                head[k.strip().lower()] = v.strip()
            size = int(head["content-length"])
            block = part[end + 4 : end + 4 + size]
            if len(block) != size or part[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
                raise BadArchive("a record is shorter than declared")
            if (d := head.get("warc-block-digest")) and d != f"sha1:{digest(block)}":
                raise BadArchive("a block doesn't have its digest")
            if head["warc-type"] == "response" and (http := split_http(block)) and head.get("warc-payload-digest") != f"sha1:{digest(http[1])}":
                raise BadArchive("a payload doesn't have its digest")
            yield head, block
            at = end + 8 + size


READ = schema(page_id="long", payload_bytes="long", payload_digest="string", record_type="string", refers_to="long", warc_record_id="string", warc_date="string", target_uri="string", file="string")


def _write(root: str, date: str, file_bytes: int):
    """Rows (key, url, html, refers_to, refers_url, revisit) as ARC in memory, converted, and written as gzipped WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, version, stream, name, size, records = _blobs.Writer(root, ".warc.gz"), [], 1, None, None, 0, 0
        done: list[tuple[str, int, int]] = []

        def convert() -> None:
            """One ARC file through the converter; versions take turns."""
            nonlocal held, version, stream, name, size, records
            if not held:
                return
            arc = [arc_version_block(version, f"legacy-v{version}.arc", date)]
            at = len(arc[0])
            known = {}
            for key, url, html, refers, refers_url, revisit in held:
                body = html.encode("utf-8", "surrogatepass")
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{ID_HEADER}: {'' if key is None else key}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                arc.append(arc_record(version, ArcRecord(url or NO_URL, "0.0.0.0", date, "text/html", head + body), at, f"legacy-v{version}.arc"))
                at += len(arc[-1])
                if revisit:
                    # A decision belongs to a key and a payload: rows of one key can differ in their payloads.
                    known[key, digest(body)] = {"WARC-Refers-To-Target-URI": bare(refers_url or NO_URL), "WARC-Refers-To-Date": warc_date(date), "X-Refers-To-Key": str(refers)}

            def revisits(record: ArcRecord, sha: str) -> dict[str, str] | None:
                key = re.search(rb"(?i)\r\n" + ID_HEADER.encode() + rb": *(-?\d*)\r\n", split_http(record.body)[0])[1]
                return known.get((int(key) if key else None, sha))

            if stream is None:
                name, stream = out.create()
            for record in parse_arc(b"".join(arc)):
                packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                data = packer.compress(to_warc(record, revisits)) + packer.flush()
                stream.write(data)
                size += len(data)
                records += not record.version_block
            held, version = [], 3 - version
            if size >= file_bytes:
                close()

        def close() -> None:
            nonlocal stream, size, records
            if stream is not None:
                stream.close()
                done.append((name, records, size))
            stream, size, records = None, 0, 0

        weight = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if weight > CHUNK_BYTES:
                    convert()
                    weight = 0
                held.append((row[0], row[1], row[2] or "", *row[3:]))
                weight += len(row[2] or "") + 300
        convert()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["file", "records", "bytes"])

    return run


def _read(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                for head, block in parse_warc(_blobs.read_file(root, name)):
                    if head["warc-type"] == "warcinfo":
                        continue
                    key = re.search(rb"(?i)\r\n" + ID_HEADER.encode() + rb": *(-?\d*)\r\n", split_http(block)[0])[1]
                    size = len(split_http(block)[1]) if head["warc-type"] == "response" else int(head["x-payload-length"])
                    refers = head.get("x-refers-to-key")
                    rows.append((int(key) if key else None, size, head["warc-payload-digest"].partition(":")[2], head["warc-type"], int(refers) if refers else None, head["warc-record-id"], head["warc-date"], head["warc-target-uri"], name))
                for a in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.dataType.simpleString().replace("bigint", "int64")) for c, f in zip(zip(*rows[a : a + 10_000]), READ.fields)], READ.names)

    return run


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "20240101000000", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a WARC record for each page through the ARC converter and read the archives back:
    (page_id, payload_bytes, payload_digest, record_type, refers_to, warc_record_id, warc_date, target_uri, file).

    Of records with equal payloads of at least min_bytes, the one with the largest id is the response and
    the others revisit it; smaller ones are responses. Rows that share that largest id are responses
    each; a null id is below all others, and equal payloads that all lack an id are responses. Null html is an empty payload; a null
    URL is urn:none. An empty table gives an empty table. Other columns are ignored.
    """
    need(pages, (id_col, url_col, html_col), "archive")
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    root = scratch.at("files")
    rows = pages.select(quoted(id_col).cast("long").alias("key"), quoted(url_col).cast("string").alias("url"), F.coalesce(quoted(html_col).cast("string"), F.lit("")).alias("html"))
    light = rows.where(F.octet_length("html") >= min_bytes).select("key", "url", F.unhex(F.sha1(F.col("html").cast("binary"))).alias("sha"))
    light = scratch.table(light, "digests")
    kept = light.groupBy("sha").agg(F.max(F.struct("key", "url")).alias("last"), F.count("*").alias("n")).where("n > 1 AND last.key IS NOT NULL").select("sha", F.col("last.key").alias("refers_to"), F.col("last.url").alias("refers_url"))
    revisits = light.join(kept, "sha").where("key IS NULL OR key <> refers_to").select("key", "sha", "refers_to", "refers_url").distinct()
    revisits = scratch.table(revisits, "revisits").withColumnRenamed("key", "k")
    joined = rows.withColumn("s", F.unhex(F.sha1(F.col("html").cast("binary")))).join(revisits, F.col("key").eqNullSafe(F.col("k")) & (F.col("s") == F.col("sha")), "left")
    files = joined.select("key", "url", "html", "refers_to", "refers_url", F.col("sha").isNotNull().alias("revisit")).mapInArrow(_write(root, date, file_bytes), schema(file="string", records="long", bytes="long"))
    files = scratch.table(files, "manifest")
    n = max(1, files.count())
    out = files.select("file").repartition(min(n, 4 * spark.sparkContext.defaultParallelism if n < 1000 else n), "file").mapInArrow(_read(root), READ)
    return out.withColumnRenamed("page_id", id_col)
