"""Shared helpers: scratch tables, size-checked joins, bounded byte batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_libc = ctypes.CDLL(None)

#: A side of a join is broadcast only when it was counted and holds at most this many rows.
BROADCAST_ROWS = 200_000
#: Copies of the small side in a salted join.
SALT = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a fresh local one where none is configured (tests)."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or getattr(sc, "_sievelog_scratch", None)
    if not base and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if not base:
        base = sc._sievelog_scratch = "file://" + tempfile.mkdtemp(prefix="sievelog-")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later steps start from files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(left: DataFrame, right: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join on ``key`` where left may hold one key in a large share of its rows.

    ``right`` must be a written table with distinct keys. It is counted: up to ``limit`` rows
    are broadcast; a larger side is replicated SALT times and joined on (key, salt).
    """
    if right.count() <= limit:
        return left.join(F.broadcast(right), key, how)
    salt = "__salt"
    salted = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.withColumn(salt, F.floor(F.rand(7) * SALT).cast("int")).join(salted, [key, salt], how).drop(salt)


#: Rows of one key that a task may always have.
HOT_ROWS = 512


def attach_hot(left: DataFrame, right: DataFrame, key: str, spread_by: str) -> DataFrame:
    """Inner equi-join on ``key``, distinct in ``right``; few keys may hold most of ``left``, a written table.

    A key of more than a thousandth of the rows of ``left``, so one of less than a thousand, is hot. Its row
    of ``right`` is copied once for every such share that it has, and its rows of ``left`` are dealt to the
    copies by a hash of ``spread_by``: below two thousand rows are copied, whatever they hold.
    """
    share = max(HOT_ROWS, left.count() // 1000)
    copies, salt = "__copies", "__salt"
    hot = left.groupBy(key).agg(F.ceil(F.count("*") / share).cast("int").alias(copies)).where(F.col(copies) > 1)
    hot = materialize(hot, "hot")
    if hot.isEmpty():
        return left.join(right, key)
    number = F.coalesce(copies, F.lit(1))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn(salt, F.pmod(F.xxhash64(spread_by), number).cast("int")).drop(copies)
    copied = right.join(F.broadcast(hot), key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), number - 1))).drop(copies)
    return dealt.join(copied, [key, salt]).drop(salt)


def spread(column: str) -> Column:
    """A deterministic 64-bit hash, used to order or deal out rows."""
    return F.xxhash64(F.col(column))


def give_back() -> None:
    """Returns freed memory of a worker to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task function that gives memory back after every batch and at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                give_back()

        yield from run(each())
        give_back()

    return wrapped


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi
