"""Media columns: content-addressed payloads in tar shards.

`store` pads each text to a positive multiple of 192 bytes and keeps it losslessly as a PNG image of
64 RGB pixels a row (192 samples of 8 bits), one member of an uncompressed tar shard for each distinct
payload of a task; the member's name is the payload's SHA-256. Rows carry digest, shard, offset and
length of the stored form. Of a payload that several tasks stored, `canonical` names one place.
`headers` reads only a member's first bytes (tar header and PNG header) and fills the metadata columns;
`features` reads the stored bytes back, decodes them and computes on the samples.

Each task writes shards of its own under a fresh name and renames each when whole, so a task run twice leaves
at most an unnamed shard; the index is written as Parquet in the shared folder before anything reads it.
Equal payloads meet as one row for each task that stored them, never one for each document, so a hot
payload needs no large group; document ids ride along in rows of the task that read them, at most REFS of them in one.

Defined results: a null text counts as empty, and an empty text is 192 spaces; repeated rows give equal
rows; an empty table gives an empty result. A payload that fails to read back raises an error.
"""

from __future__ import annotations

import hashlib
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm._spark import bounded, fs_of, materialize, scratch, shuffle_partitions, slices, text_buffers

UNIT, PIXELS = 192, 64
#: A shard ends at the first member beyond so many bytes; payloads in hand are written out at so many.
SHARD_BYTES, LEVEL = 64_000_000, 1
PNG_SIGN = b"\x89PNG\r\n\x1a\n"
#: References to documents that a task holds before it passes them on: copies of one payload fill no shard.
REFS = 20_000
#: Bytes at a member's start that hold the tar header and the PNG header.
HEAD_BYTES = 512 + 8 + 25


def pad(text: bytes) -> bytes:
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def png(payload: bytes) -> bytes:
    """A PNG of 64 x n RGB pixels whose samples are the payload, rows unfiltered."""
    rows = len(payload) // UNIT
    lines = np.zeros((rows, UNIT + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, UNIT)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return PNG_SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", PIXELS, rows, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, LEVEL)) + chunk(b"IEND", b"")


def png_header(head: bytes) -> dict:
    if head[:8] != PNG_SIGN or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    if zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("the PNG header is damaged")
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bits": bits, "channels": {0: 1, 2: 3, 4: 2, 6: 4}[colour]}


def png_samples(stored: bytes) -> np.ndarray:
    """Samples by row, of what png() makes; each chunk's CRC is verified."""
    head, at, body = png_header(stored), 8, []
    while at < len(stored):
        (size,), kind = struct.unpack(">I", stored[at : at + 4]), stored[at + 4 : at + 8]
        data = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), dtype=np.uint8).reshape(head["height"], -1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are expected")
    return lines[:, 1:]


def tar_header(name: str, size: int) -> bytes:
    """A ustar header of a plain file."""
    h = bytearray(512)
    for at, field in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        h[at : at + len(field)] = field
    h[148:156] = b"%06o\0 " % sum(h)
    return bytes(h)


def feature_of(samples: np.ndarray) -> str:
    """Mean, spread, entropy of the samples, and a 64-bit mean hash of an 8 x 8 reduction."""
    counts = np.bincount(samples.reshape(-1), minlength=256)
    n = int(counts.sum())
    values = np.arange(256)
    mean = int((counts * values).sum()) / n
    var = max(0.0, int((counts * values * values).sum()) / n - mean * mean)
    p = counts[counts > 0] / n
    rows = samples.shape[0]
    by_row = np.add.reduceat(samples.reshape(rows, 8, -1).sum(axis=2, dtype=np.int64), np.minimum(np.arange(8) * rows // 8, rows - 1), axis=0)
    share = np.maximum(1, np.diff(np.append(np.minimum(np.arange(8) * rows // 8, rows - 1), rows)))[:, None]
    small = by_row / share
    bits = (small > small.mean()).reshape(-1)
    hashed = int.from_bytes(np.packbits(bits).tobytes(), "big")
    return f"mean={mean:.4f};std={math.sqrt(var):.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};ahash={hashed:016x}"


STORED = T.StructType(
    [
        T.StructField("digest", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("refs", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType())]))),
    ]
)


def store(df: DataFrame, text: str = "text", key: str = "doc_id", folder: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the payloads to shards; a row for each payload and task, with `refs` to its documents.

    The result is an index that has been written: shards that it names exist.
    """
    spark = df.sparkSession
    folder = folder or scratch(spark, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = fs_of(folder)
        fs.create_dir(root, recursive=True)
        at: dict[str, tuple[str, int, int, int]] = {}
        refs: dict[str, list] = {}
        out, name, size, waiting = None, "", 0, 0

        def close() -> None:
            out.write(b"\0" * 1024)
            out.close()
            fs.move(f"{root}/.{name}", f"{root}/{name}")

        def rows() -> pa.RecordBatch:
            keys = list(refs)
            places = [at[k] for k in keys]
            columns = [keys, *([p[i] for p in places] for i in range(4)), [refs[k] for k in keys]]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("id", pa.int64()), ("n_bytes", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=STORED.names)

        for b in slices(batches):
            view, offsets = text_buffers(b.column(1))
            for key_of, i, j in zip(b.column(0).to_pylist(), offsets, offsets[1:], strict=False):
                payload = pad(bytes(view[i:j]))
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in at:
                    if out is None:
                        name, size = f"{uuid.uuid4().hex}.tar", 0
                        out = fs.open_output_stream(f"{root}/.{name}", compression=None)
                    media = png(payload)
                    out.write(tar_header(f"{digest}.png", len(media)) + media + b"\0" * (-len(media) % 512))
                    at[digest] = (name, size + 512, len(media), len(payload))
                    size += 512 + len(media) + -len(media) % 512
                refs.setdefault(digest, []).append({"id": key_of, "n_bytes": j - i})
                waiting += 1
                if size > shard_bytes or waiting >= REFS:
                    yield rows()
                    refs.clear()
                    waiting = 0
                if size > shard_bytes:
                    close()
                    at.clear()
                    out, size = None, 0
        if out is not None:
            close()
        if refs:
            yield rows()

    chosen = df.select(F.col(f"`{key}`").cast("long").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    index = materialize(bounded(chosen).mapInArrow(run, STORED), "media-index")
    return index.withColumn("folder", F.lit(folder))


def canonical(index: DataFrame) -> DataFrame:
    """One place for each digest: the least shard and offset of those that hold it."""
    places = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length", "payload_bytes", "folder")).alias("at"))
    return places.select("digest", "at.*")


HEADER = "width int, height int, bits int, channels int"
FEATURES = f"{HEADER}, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _by_shard(places: DataFrame, made: str, work) -> DataFrame:
    """Reads each shard's members in the order in which they lie."""
    near = places.repartition(shuffle_partitions(places.sparkSession), "shard", (F.col("offset") / 8_000_000).cast("long")).sortWithinPartitions("shard", "offset")
    schema = T.StructType([*places.schema.fields, *T._parse_datatype_string(made).fields])
    fields = schema.fields[len(places.columns) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        held, shard = None, None
        for b in slices(batches, 500):
            rows = []
            for p in b.to_pylist():
                if shard != (p["folder"], p["shard"]):
                    if held is not None:
                        held.close()
                    fs, root = fs_of(p["folder"])
                    held, shard = fs.open_input_file(f"{root}/{p['shard']}"), (p["folder"], p["shard"])
                rows.append(work(held, p))
            made_columns = [pa.array([r[f.name] for r in rows], to_arrow_type(f.dataType)) for f in fields]
            yield pa.RecordBatch.from_arrays([*b.columns, *made_columns], names=schema.names)
        if held is not None:
            held.close()

    return near.mapInArrow(run, schema)


def _header(held, p: dict) -> dict:
    head = held.read_at(HEAD_BYTES, p["offset"] - 512)
    if not head.startswith(p["digest"].encode()):
        raise ValueError(f"{p['shard']} has another member at {p['offset']}")
    return png_header(head[512:])


def _features(held, p: dict) -> dict:
    head = _header(held, p)
    stored = held.read_at(p["length"], p["offset"])
    samples = png_samples(stored)
    payload = samples.tobytes()
    found = hashlib.sha256(payload).hexdigest()
    if found != p["digest"]:
        raise ValueError(f"{p['shard']} at {p['offset']} holds another payload than {p['digest']}")
    return head | {"payload_sha256": found, "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature_of(samples)}


def headers(places: DataFrame) -> DataFrame:
    """Metadata columns from range reads of headers only; pixels stay unread."""
    return _by_shard(places, HEADER, _header)


def features(places: DataFrame) -> DataFrame:
    """Header columns, then what the stored bytes, read back and decoded, give."""
    return _by_shard(places, FEATURES, _features)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = store(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    made = features(canonical(index)).drop("payload_bytes", "shard", "offset", "length", "folder")
    refs = index.select("digest", "payload_bytes", F.col("shard").alias("stored_in"), "refs").join(made, "digest")
    return refs.select(F.explode("refs").alias("ref"), "*").select(
        F.col("ref.id").alias("doc_id"), F.col("ref.n_bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"
    )
