"""A corpus pipeline: quality, exact duplicates, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but the
last return the rows of ``docs`` that stay, with their columns; the last returns packed pieces.

Every row is judged by itself, whatever its doc_id. Rows that share a doc_id, or have none, are told
apart by a row key: a rejected or contaminated row goes, and the others with its doc_id stay. Of copies,
exact or near, the row with the smallest doc_id stays, and of several rows with it the first. Rows
without a doc_id are left to quality and decontamination alone: they are no one's copies and are never
removed as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelog.llm import bloom, minhash, packing, quality, suffixes
from sievelog.llm.common import BROADCAST_ROWS, materialize, scratch_path
from sievelog.llm.queries import table, tokenizer_path


KEY = "__key"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with KEY, a long that no two rows share and that is in the order of the doc_ids, nulls last.

    Where no doc_id repeats or is null, it is the doc_id. Otherwise rows are sorted, and written once
    so that every later reading has the same keys.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn(KEY, F.col("doc_id").cast("long"))
    placed = docs.withColumn(KEY, F.monotonically_increasing_id())
    # the place among equal ids spreads these over tasks
    return materialize(placed.sort(F.col("doc_id").cast("long").asc_nulls_last(), KEY).withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def by_key(docs: DataFrame) -> DataFrame:
    """Texts of keyed rows under their keys, for operators that judge by doc_id."""
    return docs.select(F.col(KEY).alias("doc_id"), "text")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Rows of keyed ``docs`` whose KEY is not in ``dropped`` (doc_id, holding keys), without KEY.
    Rows with a null doc_id, or with one that others have too, are dropped each by its own key. Only
    keys are compared, so no text moves while the dropped ones are few enough to be broadcast."""
    keys = materialize(dropped.select(F.col("doc_id").alias("__dropped")), "dropped")
    if keys.count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return docs.join(keys, F.col(KEY) == F.col("__dropped"), "left_anti").drop(KEY)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of good quality; those with a null or shared doc_id are judged each by its own text."""
    docs = keyed(docs)
    found = quality.scores(docs, table(spark, sf_dir, "labels"), KEY).where("predicted = 0")
    return without(docs, found.select(F.col(KEY).alias("doc_id")))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of exact copies, also among rows of one doc_id; all rows with a null doc_id."""
    docs = keyed(docs)
    return without(docs, bloom.exact_duplicates(by_key(docs.where("doc_id is not null"))).where("not kept"))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of near copies, also among rows of one doc_id; all rows with a null doc_id."""
    docs = keyed(docs)
    return without(docs, minhash.near_duplicates(by_key(docs.where("doc_id is not null"))).where("not kept"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Uncontaminated rows; those with a null or shared doc_id are judged each by its own text."""
    docs = keyed(docs)
    return without(docs, suffixes.contamination(by_key(docs), table(spark, sf_dir, "benchmark")).where("contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", keep_first_copies),
    ("near_dedup", keep_one_of_near),
    ("decontaminate", keep_uncontaminated),
    ("packing", pack_sequences),
]

#: The quality model and the packing have no SQL form; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
