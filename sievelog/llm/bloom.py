"""Exact duplicates by two passes of Bloom filtering.

Pass one counts hash slots to one or "two and more" and keeps a bitmap of the latter. Pass two
tests every document against the bitmap: only possible repeats are shuffled, as (digest, doc_id),
and compared exactly by SHA-256; all other rows pass straight through. Texts never move.

The bitmap's size follows the number of rows up to ``MOST_BITS``. Beyond that it fills up and more
rows take the shuffle; results stay exact.

Cases: null counts as empty; equal empty texts are one group. A null doc_id never stays when the
group has a doc_id. Rows repeated with one doc_id count apart in group_size and share their fate.
An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, materialize

PROBES = 2
BITS_A_ROW = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Slots of a segment, the unit in which partial filters are merged.
SEGMENT = 1 << 16


def normalized(text: str = "text"):
    """Null as empty; runs of ASCII white space become one space."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES slots for each 64-bit hash, shape (n, PROBES)."""
    hashes = hashes.view(np.uint64)
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)], axis=1).astype(np.int64)


def filter_bits(rows: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, rows * BITS_A_ROW - 1).bit_length()))


def _partial(bits: int):
    """Per task: for each segment, its slots hit once and those hit more often, as sorted uint16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = slots(batch.column("h").to_numpy(zero_copy_only=False), bits)
            hit = np.concatenate([hit[:, 0], *(hit[:, i][~(hit[:, :i] == hit[:, i : i + 1]).any(axis=1)] for i in range(1, PROBES))])
            slot, count = np.unique(hit, return_counts=True)
            cut = np.flatnonzero(np.diff(slot // SEGMENT)) + 1
            rows = [(int(s[0]) // SEGMENT, (s[c == 1] % SEGMENT).astype("<u2").tobytes(), (s[c > 1] % SEGMENT).astype("<u2").tobytes()) for s, c in zip(np.split(slot, cut), np.split(count, cut), strict=True) if len(s)]
            if rows:
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["segment", "once", "more"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    """One segment: a slot hit by two tasks, or twice by one, is a repeat."""
    total = np.zeros(SEGMENT, np.int32)
    for once, more in zip(table.column("once").to_pylist(), table.column("more").to_pylist(), strict=True):
        total[np.frombuffer(once, "<u2")] += 1
        total[np.frombuffer(more, "<u2")] += 2
    bitmap = np.packbits(total > 1).tobytes()
    return pa.table({"segment": table.column("segment").slice(0, 1), "bitmap": pa.array([bitmap], pa.binary())})


def repeated_slots(hashed: DataFrame, rows: int) -> tuple[np.ndarray, int]:
    """The bitmap of slots hit at least twice by column h; at most MOST_BITS / 8 bytes reach the driver."""
    bits = filter_bits(rows)
    merged = hashed.select("h").mapInArrow(_partial(bits), "segment long, once binary, more binary").groupBy("segment").applyInArrow(_merge, "segment long, bitmap binary")
    bitmap = np.zeros(max(bits, SEGMENT) // 8, np.uint8)
    for row in merged.toLocalIterator():
        bitmap[row.segment * SEGMENT // 8 : (row.segment + 1) * SEGMENT // 8] = np.frombuffer(row.bitmap, np.uint8)
    return bitmap, bits


def possible_repeats(hashed: DataFrame, bitmap: np.ndarray, bits: int) -> DataFrame:
    """Adds the column ``maybe``: every slot of h was hit more than once."""
    shared = hashed.sparkSession.sparkContext.broadcast(bitmap)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = slots(batch.column("h").to_numpy(zero_copy_only=False), bits)
            hit = ((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield batch.append_column("maybe", pa.array(hit))

    return hashed.mapInArrow(test, T.StructType([*hashed.schema.fields, T.StructField("maybe", T.BooleanType())]))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalized().alias("text"))
    digests = materialize(text.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.xxhash64("text").alias("h")), "digests")
    bitmap, bits = repeated_slots(digests, digests.count())
    tested = materialize(possible_repeats(digests, bitmap, bits).select("doc_id", "text_sha256", "maybe"), "tested")
    groups = tested.where("maybe").groupBy("text_sha256").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    repeats = attach(tested.where("maybe"), materialize(groups, "groups"), "text_sha256")
    whole = repeats.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(tested.where("not maybe").select("doc_id", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("group_size"), "text_sha256"))
    keep = F.coalesce("keep_id", "doc_id")
    return whole.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
