"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset and the master is local (tests) a temporary folder takes its place.
    """
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set; executors and driver need a shared folder")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def scratch(spark: SparkSession, tag: str) -> str:
    """URI of a new folder (not yet made) in the shared one."""
    return f"{shared_dir(spark)}/lodestar/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder as Parquet and read back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fs_of(uri: str):
    """A pyarrow file system and the path in it, for workers that read and write the shared folder."""
    from pyarrow import fs

    if "://" not in uri:
        uri = uri.replace("file:/", "file:///") if uri.startswith("file:/") else "file://" + uri
    return fs.FileSystem.from_uri(uri)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What a worker process keeps from task to task, by what it is for.
HELD: dict = {}


def hold(key, make):
    """The worker's object for a key, made once; what was kept for other keys goes."""
    if key not in HELD:
        release()
        HELD[key] = make()
    return HELD[key]


def release() -> None:
    """Let go of what is kept, and hand free memory back to the system: workers serve many operators in turn."""
    import ctypes

    HELD.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only in the GNU C library
        pass


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000, size: int = 1 << 20, holds: bool = False) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most so many rows and, unless one row has more, bytes: bounds a worker's memory.

    holds: the task uses what the worker keeps; else that goes first.
    """
    if not holds:
        release()
    for b in batches:
        for i in range(0, b.num_rows, rows):
            waiting = [b.slice(i, rows)]
            while waiting:
                part = waiting.pop()
                if part.num_rows > 1 and part.nbytes > size:
                    half = part.num_rows // 2
                    waiting += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


def free_name(columns: Iterable[str], base: str = "__text") -> str:
    """A column name that none of the given ones equals, whatever their case."""
    taken = {c.lower() for c in columns}
    while base in taken:
        base += "_"
    return base


def bounded(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, after the session's Arrow batches are bounded to so many rows: texts are long, workers small."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    have = int(df.sparkSession.conf.get(name))
    if have <= 0 or have > rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def text_buffers(column: pa.Array) -> tuple[memoryview, list[int]]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty.

    The view starts at the first row's first byte.
    """
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    import numpy as np

    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    start, end = int(offsets[0]), int(offsets[-1])
    view = memoryview(data)[start:end] if data is not None else memoryview(b"")
    return view, (offsets - start).tolist()
