"""What several operators share: the cluster's shared folder, whole-text hashing and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.shipping import ship

#: Odd base of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of an Arrow batch at most, and its bytes, but for a longer row: with packed rows of 100 KB, 512 would be 50 MB in the JVM
#: and again in Python.
ROWS, BYTES = 512, 4 << 20
UNBASE = pow(BASE, -1, 1 << 64)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of this machine only if all of Spark runs on it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioscope-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: cuts the lineage, survives lost executors.

    Shuffle files of the write go as soon as it ends; nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table of written() that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(name: str, df: DataFrame) -> str:
    """A column name that df does not have yet."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def text_of(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def bytes_of(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string or binary column (null: empty) in one array, and where each row starts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Slices of a batch whose column holds about `limit` bytes; a longer row is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, min(stop, n) - start)
        start = stop


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    have = 1
    while have < n:
        take = min(have, n - have)
        with np.errstate(over="ignore"):
            out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out


_POWERS: list = [0, None, None]


def power_pair(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of BASE and of UNBASE; a worker keeps the longest for all operators."""
    if n > _POWERS[0]:
        size = n + n // 8
        _POWERS[:] = size, powers(size, BASE), powers(size, UNBASE)
    return _POWERS[1], _POWERS[2]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes (the public murmur3 finaliser)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


#: A 64-bit value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Rolling:
    """Hashes of any spans of a byte array, from one prefix sum."""

    def __init__(self, data: np.ndarray, up: np.ndarray, down: np.ndarray):
        """up, down: powers of BASE and UNBASE, at least as many as data has bytes."""
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE[data] * up[: len(data)], out=self.sums[1:])
        self.down = down

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def each(self, size: int) -> np.ndarray:
        """The hashes of `size` bytes from every position that has as many."""
        with np.errstate(over="ignore"):
            sums = self.sums[size:] - self.sums[: len(self.sums) - size]
            return mix(sums * self.down[: len(sums)] + np.uint64(size) * np.uint64(0x9E3779B97F4A7C15))


def trimmed() -> None:
    """Gives back what the allocators of a worker keep: it stays for later tasks, and while it waits others need the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, make, schema: str, *args) -> DataFrame:
    """mapInArrow with a generator function make(batches, *args); empty batches are left out.

    Batches are held to ROWS rows and BYTES bytes in this session: tables of whole texts need no more to be read fast.
    """
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    for name, most in ((BATCH_ROWS, ROWS), (BATCH_BYTES, BYTES)):
        own = conf.get(name).removesuffix("b")
        if not own.isdigit() or not 0 < int(own) <= most:
            conf.set(name, str(most))

    def run(batches):
        try:
            yield from make((b for b in batches if b.num_rows), *args)
        finally:
            trimmed()

    return df.mapInArrow(run, schema)
