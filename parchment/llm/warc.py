"""Legacy web archives (ARC, versions 1 and 2) to WARC, and WARC files in the shared folder.

An ARC file opens with a filedesc record whose body names the version and the fields of the header lines that
follow. Each record is one header line, as many bytes as it declares, and a line end. The converter gives each an
equivalent WARC record: identifier, timestamp, type and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from datetime import UTC, datetime
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, often_from, table

#: Header lines by version, as the filedesc record spells them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Compressed bytes after which a new WARC file is begun.
FILE_BYTES = 64 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    block: bytes
    extra: dict[str, str] = field(default_factory=dict)


def write_arc(records: list[ArcRecord], version: int = 1, name: str = "pages.arc", date: str = "20000101000000") -> bytes:
    """An ARC file. White space in URLs is percent-encoded, as header lines are split at spaces."""
    about = f"{version} 0 parchment\n{ARC_FIELDS[version]}\n".encode()
    out, offset = [], 0
    for r in [ArcRecord(f"filedesc://{name}", "0.0.0.0", date, "text/plain", about), *records]:
        url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r.url) or "-"
        rest = f"200 {hashlib.md5(r.block).hexdigest()} - {offset} {name} " if version == 2 else ""
        out.append(f"{url} {r.ip} {r.date} {r.mime} {rest}{len(r.block)}\n".encode() + r.block + b"\n")
        offset += len(out[-1])
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, without its filedesc. Raises ValueError at a header that can't be followed."""
    at, fields = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):  # writers differ in the line ends between records
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "surrogateescape").rstrip("\r")
        words = line.split(" ")
        length = int(words[-1]) if words[-1].isdigit() else -1
        block = data[end + 1 : end + 1 + length]
        if end < 0 or length < 0 or len(block) < length:
            raise ValueError(f"ARC record at byte {at}: {line[:80]!r}")
        at = end + 1 + length
        if words[0].startswith("filedesc:"):
            about = block.decode("utf-8", "replace").splitlines()
            version = int(about[0].split()[0]) if about and about[0][:1].isdigit() else 1
            fields = (about[1] if len(about) > 1 and about[1].strip() else ARC_FIELDS[version]).split(" ")
            continue
        names = fields or ARC_FIELDS[1].split(" ")
        if len(words) != len(names):
            raise ValueError(f"ARC record with {len(words)} of {len(names)} fields: {line[:80]!r}")
        got = dict(zip(names, words, strict=True))
        known = [got.pop(k, "-") for k in ("URL", "IP-address", "Archive-date", "Content-type")]
        got.pop("Archive-length", None)
        yield ArcRecord(*known, block, got)


def warc_date(date: str) -> str:
    """14 digits as an ISO timestamp; missing digits are those of the start of the period."""
    d = re.sub(r"\D", "", date)[:14]
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {key}')}>"


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """Headers with their blank line, and payload, of an HTTP response; None for anything else."""
    if not block.startswith(b"HTTP/"):
        return None
    m = re.search(rb"\r?\n\r?\n", block)
    return (block[: m.end()], block[m.end() :]) if m else (block, b"")


def to_warc(r: ArcRecord, key: str = "", refers: tuple[str, str] | None = None, extra: dict[str, str] | None = None) -> bytes:
    """The WARC record of an ARC record: response for HTTP, resource for anything else; revisit if refers gives
    the (url, key) of the record whose payload it repeats. Then the block holds the HTTP headers alone, and the
    digest still is that of the whole payload. Ends with the two line ends of a record."""
    http = split_http(r.block)
    payload = http[1] if http else r.block
    kind, block = ("response" if http else "resource"), r.block
    head = {}
    if refers:
        kind, block = "revisit", http[0] if http else b""
        head = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers[0], r.date, refers[1]), "WARC-Refers-To-Target-URI": refers[0]}
    head = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(r.url, r.date, key), "WARC-Date": warc_date(r.date), "WARC-Target-URI": r.url,
        **({"WARC-IP-Address": r.ip} if r.ip not in ("-", "0.0.0.0") else {}), **head, "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}", "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
        **(extra or {}), "Content-Type": "application/http; msgtype=response" if http else r.mime, "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogateescape") + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
        head = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        declared = next((v for k, v in head.items() if k.lower() == "content-length"), "")
        if not declared.isdecimal():
            raise ValueError(f"WARC record at byte {at} declares no length")
        stop = end + 4 + int(declared)
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} doesn't end where it says")
        yield head, data[end + 4 : stop]
        at = stop + 4


def warcinfo(name: str) -> bytes:
    """The record that opens a WARC file."""
    about = b"software: parchment\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(name, '', 'info')}\r\nWARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n"
    return b"WARC/1.1\r\n" + head.encode() + about + b"\r\n\r\n"


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The contents of each gzip member of a file, one after the other. Bytes are fed in slices of `step`, so that what is
    left behind a member's end, and copied, is less than that."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, out = zlib.decompressobj(31), []
        while not d.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut off")
            part = view[at : at + step]
            out.append(d.decompress(part))
            at += len(part) - len(d.unused_data)
        yield b"".join(out)
        while at < len(view) and view[at] == 0:
            at += 1


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records of a WARC file, gzipped or not. A gzip member may hold a record, as they should, or
    any number of them."""
    if data[:2] != b"\x1f\x8b":
        yield from parse_warc(data)
        return
    for part in members(data):
        yield from parse_warc(part)


def _files(path: str):
    """(file system, path in it) that Python workers write to; Spark's own forms of local paths are understood."""
    local = re.sub(r"^file:/+", "/", path)
    return (pa.fs.LocalFileSystem(), local) if "://" not in local else pa.fs.FileSystem.from_uri(path)


class ArchiveWriter:
    """WARC files of about `most` bytes under a folder: a gzip member for each record, the first a warcinfo. A file has its
    name only once it is whole. Names hold the stem, which is an attempt's own: attempts never write over each other."""

    def __init__(self, path: str, stem: str, most: int):
        self.fs, self.path = _files(path)
        self.stem, self.most, self.n, self.parts, self.size = stem, most, 0, [], 0
        self.names: list[str] = []
        self.fs.create_dir(self.path, recursive=True)

    def add(self, record: bytes) -> None:
        if not self.parts:
            self._put(warcinfo(f"{self.stem}-{self.n:05d}.warc.gz"))
        self._put(record)
        if self.size >= self.most:
            self.close()

    def _put(self, record: bytes) -> None:
        c = zlib.compressobj(6, wbits=31)
        self.parts.append(c.compress(record) + c.flush())
        self.size += len(self.parts[-1])

    def close(self) -> str | None:
        if not self.parts:
            return None
        name = f"{self.path}/{self.stem}-{self.n:05d}.warc.gz"
        draft = f"{self.path}/_{self.stem}-{self.n:05d}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as f:
            for p in self.parts:
                f.write(p)
        self.fs.move(draft, name)
        self.n, self.parts, self.size = self.n + 1, [], 0
        self.names.append(name.rsplit("/", 1)[1])
        return name


MANIFEST = "n long, names array<string>"


def manifest_of(path: str) -> str:
    """The table (records, files) of the tasks that wrote an archive."""
    return f"{path.rstrip('/')}.manifest"


def archive_pages(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, file_bytes: int = FILE_BYTES) -> int:
    """Writes gzipped WARC files under path, and tells how many records: each page goes through an ARC record (version 1 or 2
    in turn) and the converter. Of pages with equal payloads of at least `least` bytes the one with the smallest id is a response,
    the others revisit it; rows that repeat the smallest id are responses too. Null html is an empty payload; null
    ids never are the smallest, unless all of the group are null: then all are responses. Null urls are "-".

    Which files a finished task wrote is told by a table beside the folder (manifest_of()), which read_archives() goes by: files
    of attempts that failed, were lost or came second are no part of the archive.

    Payloads with very many copies don't meet in one task: which is the first of them is broadcast.
    """
    rows = pages.select(F.col(id).cast("long").alias("id"), F.coalesce(url, F.lit("-")).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("same", F.when(F.length("payload") >= least, F.sha2("payload", 256)))
    first = rows.where("same is not null").groupBy("same").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1 and not first.no_id")
    first = Scratch(pages.sparkSession, "warc-first").put(first.select("same", F.col("first.id").alias("of"), F.col("first.url").alias("of_url"), "n"), "first")
    most = often_from(first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    hot, rest = first.where(F.col("n") > most).drop("n"), first.where(F.col("n") <= most).drop("n")
    if hot.isEmpty():
        rows = rows.join(rest, "same", "left")
    else:
        keys = F.broadcast(hot.select("same"))
        rows = rows.join(keys, "same", "left_anti").join(rest, "same", "left").unionByName(rows.join(F.broadcast(hot), "same"))
    rows = rows.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("of")), F.col("of")).alias("of"), "of_url")

    def run(batches):
        context = TaskContext.get()
        out, n = ArchiveWriter(path, f"part-{context.partitionId():06d}-{uuid.uuid4().hex[:12]}", file_bytes), 0
        for batch in batches:
            for i, link, payload, of, of_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Source-Id: {i}\r\n" if i is not None else "") + f"Content-Length: {len(payload)}\r\n\r\n"
                arc = write_arc([ArcRecord(link, "0.0.0.0", "20000101000000", "text/html", head.encode() + payload)], 1 + (i or 0) % 2)
                for r in parse_arc(arc):
                    more = {} if of is None else {"X-Refers-To-Source-Id": str(of)}
                    out.add(to_warc(r, str(i), None if of is None else (of_url, str(of)), more))
                    n += 1
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([out.names], pa.list_(pa.string()))], names=["n", "names"])

    rows.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(manifest_of(path))
    return pages.sparkSession.read.schema(MANIFEST).parquet(manifest_of(path)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


PAGES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,18}", text) else None


def measured(head: dict[str, str], block: bytes) -> tuple | None:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record; None if it is no response, revisit or
    resource. Header names count in any case; what isn't there, or is no number, is null. A declared SHA-1 must be right."""
    head = {k.lower(): v for k, v in head.items()}
    kind = head.get("warc-type", "").lower()
    if kind not in ("response", "revisit", "resource"):
        return None
    http, payload = split_http(block) or (b"", block)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\n")[1:])}
    own, of, revisit = fields.get("x-source-id"), head.get("x-refers-to-source-id"), kind == "revisit"
    label, _, digest = head.get("warc-payload-digest", "").partition(":")
    declared = digest.upper() if label.lower() == "sha1" and digest else None
    if revisit:
        return _number(own), _number(fields.get("content-length")) if fields else 0, declared, kind, _number(of)
    if declared and declared != base32_sha1(payload):
        raise ValueError(f"digest of page {own} differs")
    return _number(own), len(payload), base32_sha1(payload), kind, _number(of)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under path, of all gzip members: of the files that the archive's manifest names, or of all
    where there is none. Responses are measured; a revisit tells what it declares. Other records are left out; such of other
    writers that name no source page have nulls there."""
    manifest = spark._jvm.org.apache.hadoop.fs.Path(manifest_of(path))
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz")
    if manifest.getFileSystem(spark._jsc.hadoopConfiguration()).exists(manifest):
        # Names of files, as Spark's own listing holds them on the driver.
        names = [r.name for r in spark.read.schema(MANIFEST).parquet(manifest_of(path)).select(F.explode("names").alias("name")).collect()]
        if not names:
            return spark.createDataFrame([], PAGES)
        files = reader.load([f"{path.rstrip('/')}/{name}" for name in names]).select("content")
    else:
        files = reader.load(path).select("content")

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                out = [m for head, block in read_warc(content.as_py()) if (m := measured(head, block))]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PAGES.split(", ")])

    return files.mapInArrow(run, PAGES)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10_warc: the contract's columns, read back from the archives of all pages."""
    path = f"{Scratch(spark, 'warc').at}/warc"
    archive_pages(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path)


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS n, sha1(t) AS s, min(page_id) OVER (PARTITION BY t) AS f FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: bin(strpos('0123456789abcdef', s[i]) - 1)[-4:].lpad(4, '0')), '') AS bits FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5*i+1, 1) AS INT) + 8 * CAST(substr(bits, 5*i+2, 1) AS INT) + 4 * CAST(substr(bits, 5*i+3, 1) AS INT) + 2 * CAST(substr(bits, 5*i+4, 1) AS INT) + CAST(substr(bits, 5*i+5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM b
"""
