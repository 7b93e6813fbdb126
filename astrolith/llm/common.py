"""Helpers that several corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where none is configured in local mode (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="astrolith-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Rows of the batches between JVM and Python while a table is written: whole texts are wide rows.
BATCH_ROWS = 2000


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage
    ends at files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more: what was made of them is stored itself."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text"):
    """One key for rows that agree in id and text. Such rows get equal results, so
    sharing the key loses nothing, and rows with a null or repeated id stay apart."""
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))


#: Names of columns that operators put beside a caller's own for a while.
KEY, SPANS, PASSAGES, MARK = "__row_key", "__spans", "__passages", "__mark"


def release() -> None:
    """Give freed memory back: workers outlive their tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        del batch
    release()


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values' bytes in one array, and the n+1 offsets of the values in it; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (in place)."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def words_at(data: np.ndarray, count: int | None = None) -> np.ndarray:
    """The little-endian uint64 that starts at every byte; ``data`` must be padded by 7."""
    n = len(data) - 7 if count is None else count
    return np.ndarray((max(n, 0),), "<u8", np.ascontiguousarray(data), 0, (1,)).astype(np.uint64)


def parts_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def least_hashes(rows: DataFrame, k: int, known: int | None = None) -> pa.Table:
    """At most ``k`` distinct rows, those whose contents have the least hashes: exactly k where there
    are as many, however many rows are alike. A bound on the hash goes first, so that tasks send few
    rows; it is widened until k rows lie below it or the table ends. ``known``: how many rows
    there are; counted if not given."""
    names = rows.columns
    total = rows.count() if known is None else known
    marked = rows.withColumn(MARK, F.xxhash64(*names))
    share = 2 * k / max(total, 1)
    while True:
        below = marked.where(F.col(MARK) < -(1 << 63) + int((1 << 64) * share)) if share < 1 else marked
        found = below.dropDuplicates([MARK]).orderBy(MARK).limit(k).select(*names).toArrow()
        if share >= 1 or found.num_rows == k:
            return found
        share *= 8
