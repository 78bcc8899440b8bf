"""WARC archives as a PySpark Python data source, `warc`, that reads and writes.

Reading plans one partition for each file, or for some small files together. Each record's headers are
parsed first: only as many bytes are inflated as hold them. Predicates on the record type and on header
columns are pushed down, and a record they exclude, or any record when option payload is false, has its
payload skipped without decoding: written archives keep each gzip member's length in an extra field, so
the reader jumps to the next one; foreign archives, which lack it, are inflated up to their end. Plain
.warc files are read as well and skipped by Content-Length.

Writing makes one gzip member a record. A task writes under hidden names; the driver gives the files
their names once all tasks have ended, so a task that runs twice leaves no second copy.

Defined results: a null html is an empty payload; rows without page_id are written as responses with a
record id of their own and read back with a null page_id; repeated rows give repeated records; extra
columns are ignored; an empty table gives an empty folder, which reads as no rows. A record with a null
header has null in that column.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from lodestar.llm._spark import fs_of, materialize, scratch

SCHEMA = "record_type string, record_id string, page_id long, refers_to long, target_uri string, date string, payload_digest string, payload_bytes long, http_status int, content_length long, payload binary"
WRITES = "page_id long, url string, html string, record_type string, refers_to long, payload_digest string, payload_bytes long"
DATE = "2024-01-01T00:00:00Z"
#: Roll to a new file beyond this; small files share a partition up to this.
FILE_BYTES, LEVEL = 64_000_000, 1
#: Payloads from this size on may be stored once.
LEAST_BYTES = 1000
#: Rows of the revisit table up to which it is broadcast (24 bytes and a digest each).
BROADCAST_ROWS = 200_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose extra field LS holds the member's own length."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    size = 20 + len(body) + 8
    return struct.pack("<4BI2BH2sHI", 0x1F, 0x8B, 8, 4, 0, 0, 255, 8, b"LS", 4, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: str, payload_bytes: int, date: str = DATE) -> bytes:
    """The bytes of one record; a revisit has the HTTP header of the full payload and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % payload_bytes
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{uuid.uuid4().hex if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def _page(value: str | None) -> int | None:
    tail = (value or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() and len(tail) < 20 else None


def _row(h: dict[str, str]) -> dict:
    digest = h.get("warc-payload-digest")
    return {
        "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "page_id": _page(h.get("warc-record-id")), "refers_to": _page(h.get("warc-refers-to")),
        "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"), "payload_digest": digest and digest.removeprefix("sha1:"),
        "payload_bytes": None, "http_status": None, "content_length": int(h.get("content-length", 0)), "payload": None,
    }


class _Member:
    """Bytes of one gzip member, inflated as far as they are asked for."""

    def __init__(self, source: io.BufferedReader):
        self.source, self.inflate, self.out, self.left = source, zlib.decompressobj(31), bytearray(), b""

    def need(self, n: int) -> bytearray:
        while len(self.out) < n and not self.inflate.eof:
            data = self.left or self.source.read(16_384)
            if not data:
                raise EOFError("a gzip member is cut short")
            self.out += self.inflate.decompress(data, max(1024, n - len(self.out)))
            self.left = self.inflate.unconsumed_tail
        return self.out

    def end(self) -> int:
        """Inflates to the end; how many bytes that were read belong to what follows."""
        while not self.inflate.eof:
            data = self.left or self.source.read(65_536)
            if not data:
                raise EOFError("a gzip member is cut short")
            self.inflate.decompress(data, 1 << 20)
            self.left = self.inflate.unconsumed_tail
        return len(self.inflate.unused_data)


class _Plain:
    """Bytes of a plain file from where it stands."""

    def __init__(self, source: io.BufferedReader):
        self.source, self.out = source, bytearray()

    def need(self, n: int) -> bytearray:
        while len(self.out) < n and (data := self.source.read(max(1024, n - len(self.out)))):
            self.out += data
        return self.out


def _until(part: _Member | _Plain, mark: bytes, start: int = 0) -> int:
    """Where the mark ends; -1 if it never comes."""
    n = start + 1024
    while True:
        data = part.need(n)
        at = data.find(mark, start)
        if at >= 0:
            return at + len(mark)
        if len(data) < n:
            return -1
        n *= 2


def records(source: io.BufferedReader, gz: bool, wanted: Callable[[dict], bool], payload: bool) -> Iterator[dict]:
    """Rows of an archive that the predicate on header columns accepts."""
    at = 0
    while True:
        source.seek(at)
        head = source.read(20)
        if len(head) < (20 if gz else 1):
            return
        size = struct.unpack("<I", head[16:20])[0] if gz and head[3] & 4 and head[12:14] == b"LS" else None
        source.seek(at)
        part: _Member | _Plain = _Member(source) if gz else _Plain(source)
        ends = _until(part, b"\r\n\r\n")
        if ends < 0:
            if part.need(1).strip():
                raise EOFError("a record has no end of its headers")
            return
        start = part.out.find(b"WARC/")
        row, gone = _row(parse_headers(part.out[max(0, start) : ends - 4])), False
        if wanted(row):
            http = _until(part, b"\r\n\r\n", ends) if row["content_length"] and row["record_type"] in ("response", "revisit") else ends
            if ends < http <= ends + row["content_length"] and part.out[ends : ends + 5] == b"HTTP/":
                block = part.out[ends : http - 4]
                row["http_status"] = int(block.split(None, 2)[1])
                length = parse_headers(block).get("content-length")
                row["payload_bytes"] = int(length) if length and length.isdigit() else ends + row["content_length"] - http
            else:
                http = ends
                row["payload_bytes"] = row["content_length"]
            if payload and row["record_type"] != "revisit":
                row["payload"] = bytes(memoryview(part.need(ends + row["content_length"]))[http : ends + row["content_length"]])
                over = part.end() if gz else 0  # to its end, where the member's CRC is verified
                gone = True
            yield row
        if size is not None:
            at += size
        elif gz:
            over = over if gone else part.end()
            at = source.tell() - over
        else:
            at += ends + row["content_length"] + 4


class WarcPartition(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        known = {"record_type", "record_id", "page_id", "refers_to", "target_uri", "date", "payload_digest"}
        for f in filters:
            if isinstance(f, EqualTo | EqualNullSafe | In | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in known:
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        fs, root = fs_of(self.path)
        found = fs.get_file_info(root)
        files = [found] if found.type == FileType.File else fs.get_file_info(FileSelector(root, allow_not_found=True))
        files = sorted((x for x in files if x.type == FileType.File and x.base_name.endswith((".warc", ".warc.gz")) and not x.base_name.startswith((".", "_"))), key=lambda x: x.path)
        bins: list[list[str]] = []
        room = 0
        for x in files:
            if not bins or x.size > room:
                bins.append([])
                room = FILE_BYTES // 8
            bins[-1].append(x.path)
            room -= x.size
        return [WarcPartition(b) for b in bins] or [WarcPartition([])]

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.tests:
            have = row[column]
            if kind == "In":
                ok = have is not None and have in value
            elif kind == "StringStartsWith":
                ok = have is not None and have.startswith(value)
            elif kind == "EqualTo":
                ok = have is not None and have == value
            else:
                ok = have == value
            if not ok:
                return False
        return True

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        fs, _ = fs_of(self.path)
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "http_status": pa.int32(), "content_length": pa.int64(), "payload": pa.binary()}
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

        for path in partition.files:
            rows, held = [], 0
            with io.BufferedReader(fs.open_input_file(path), 1 << 17) as source:
                for row in records(source, path.endswith(".gz"), self._wanted, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or b"")
                    if len(rows) >= 2000 or held > 8_000_000:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, level: int):
        self.path, self.overwrite, self.level = path, overwrite, level

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = fs_of(self.path)
        fs.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for b in iterator:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000).to_pydict()
                for row in zip(*(part[n.split()[0]] for n in WRITES.split(", ")), strict=True):
                    page_id, url, html, kind, refers_to, digest, n = row
                    if out is None:
                        names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out, size = fs.open_output_stream(f"{root}/.{names[-1]}", compression=None), 0
                    data = member(record(page_id, url, (html or "").encode(), kind, refers_to, digest, n), self.level)
                    out.write(data)
                    size += len(data)
                    if size > FILE_BYTES:
                        out.close()
                        out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow.fs import FileSelector

        fs, root = fs_of(self.path)
        fs.create_dir(root, recursive=True)
        new = [n for m in messages if m for n in m.names]
        if self.overwrite:
            for x in fs.get_file_info(FileSelector(root)):
                if x.base_name.endswith((".warc", ".warc.gz")) and x.base_name.lstrip(".") not in new:
                    fs.delete_file(x.path)
        for n in new:
            fs.move(f"{root}/.{n}", f"{root}/{n}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = fs_of(self.path)
        for n in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{root}/.{n}")


class WarcSource(DataSource):
    """spark.read.format("warc").option("payload", "false").load(folder); df.write.format("warc").save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite, int(self.options.get("level", LEVEL)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def revisits(pages: DataFrame, least: int = LEAST_BYTES, salts: int = 16) -> DataFrame:
    """(page_id, digest, refers_to) of pages whose payload a page with a larger id also has.

    Only ids and digests move. The larger side of the join back is salted, so that the copies of one
    payload go to `salts` tasks; the other side has one row for each repeated payload and salt.
    """
    ids = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).filter((F.col("n") >= least) & F.col("page_id").isNotNull())
    last = ids.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    spread = last.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = ids.withColumn("salt", F.pmod("page_id", F.lit(salts)).cast("int")).join(spread, ["digest", "salt"])
    return found.filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_pages(pages: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """A record for each row (page_id, url, html): repeated payloads become revisits of the largest page_id's."""
    spark = pages.sparkSession
    register(spark)
    again = materialize(revisits(pages, least), "warc-revisits")
    small = again.count() <= BROADCAST_ROWS
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    joined = rows.join(F.broadcast(again) if small else again, ["page_id", "digest"], "left")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    out = joined.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), kind.alias("record_type"), "refers_to", F.col("digest").alias("payload_digest"), "payload_bytes")
    out.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    full = F.col("record_type") == "response"
    size, digest = F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")), F.when(full, F.sha1("payload")).otherwise(F.col("payload_digest"))
    return read_warc(spark, path).select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE_SQL = {
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM w"""
}
