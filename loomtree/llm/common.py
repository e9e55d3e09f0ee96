"""What the operators of this folder share: the shared folder, and words and hashes of whole Arrow batches in numpy."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that numpy handles at a time; its temporary arrays take about 150 times as many.
BLOCK = 1 << 18
ROWS_A_FILE = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset (tests), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomtree-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and a lost executor loses nothing.

    rows: how many rows it has at most, where that is known and rows are small; it then gets a file for each `ROWS_A_FILE` of them.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` from the shared folder, once what was made of them is written itself."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """work, giving freed memory back to the system when a task ends: workers live on, idle ones beside busy ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def small(keys: DataFrame, rows: int = 500_000) -> DataFrame:
    """keys, to be broadcast if they are that few (a count decides; a row of keys takes some 50 bytes), else left to a shuffle join."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def whole_texts(df: DataFrame, rows: int = 2000, size: int = 4 << 20) -> DataFrame:
    """df, after limiting what the session sends to Python at once, as rows here are whole texts: by rows, and by bytes where the
    release knows such a limit."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else df carries; an absent text counts as empty."""
    return whole_texts(df).select(*(F.coalesce(df[n], F.lit("")).alias(n) if n == "text" else df[n] for n in names))


@functools.cache
def _byte_values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the hash base and its inverse modulo 2**64, n at least."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, BLOCK + 1), base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[j] - h[i] = sum of value(data[k]) * base**k for i <= k < j."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the bytes starts[i] to ends[i], whatever their place."""
    return mix((h[ends] - h[starts]) * powers(len(h))[1][starts] + (ends - starts).astype(np.uint64))


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without nulls, not copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def blocks(data: np.ndarray, at: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `most` bytes together (a longer row is alone): first row, last row + 1, their bytes, their offsets."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and each row's first word (one more entry than rows)."""
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    full = at[1:] > at[:-1]
    a, b = at[:-1][full], at[1:][full] - 1
    first[a] = solid[a]
    last[b] = solid[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)
