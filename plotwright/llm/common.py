"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import math
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that Python gets at once; Spark's default is sixteen times as much, for each of an executor's tasks.
BATCH_BYTES = 4 << 20


def lean(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ``BATCH_BYTES``: texts come by the megabyte, and executors' memory is shared with the JVM. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: Arrays of so many bytes are mapped one by one, so that they go back to the machine when freed.
MAPPED_BYTES = 4 << 20


@functools.cache
def allocator() -> ctypes.CDLL | None:
    """The C library, told once in a worker to hold little free memory; None where it has no such calls."""
    lib = ctypes.CDLL(None)
    if not (hasattr(lib, "mallopt") and hasattr(lib, "malloc_trim")):
        return None
    lib.mallopt(-3, MAPPED_BYTES)
    lib.mallopt(-1, 4 * MAPPED_BYTES)
    return lib


def sparing(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow. Workers outlive their tasks, so what a task has freed is given back at its end: idle workers of earlier stages hold no more than their modules."""

    @functools.wraps(run)
    def spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = allocator()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if lib is not None:
                lib.malloc_trim(0)

    return spared


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table; read by Spark, so any store it knows will do."""
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where none is set and the master is this machine. Elsewhere executors could not read it, so that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plotwright-"))
        found = context.getCheckpointDir().get()
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a lost executor costs no earlier stage. Spark's cleaner removes it once ``df`` is let go, in sessions with ``spark.cleaner.referenceTracking.cleanCheckpoints`` (as ``plotwright.session`` makes them)."""
    checkpoint_dir(df.sparkSession)
    lean(df.sparkSession)
    return df.checkpoint()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder that is no longer read, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def others(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` but those called ``names`` in any case: what an operator adds stands in place of what is called so."""
    taken = {n.lower() for n in names}
    return [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


def crc_mod(column: Column, n: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % n


def text_pieces(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of at most ``most`` characters together (a longer row stands alone), whole texts, null as empty."""
    begin, held, size = 0, [], 0
    values = batch.column(column)
    for i in range(len(values)):
        text = values[i].as_py() or ""
        if held and size + len(text) > most:
            yield begin, held
            begin, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield begin, held


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; uint64 in, uint64 out, wrapping."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codepoints(text: str) -> np.ndarray:
    """Lone surrogates, which no UTF-8 text holds, pass through."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def partitions_for(rows: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / each))
