"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

Each participant of a conversation is the assistant once; every other speaker is a named user, and
system turns stay system turns. A row is one turn in one perspective: its rendered segment, where
the segment lies in the rendered dialogue, and the span that is trained on. Positions come from two
levels of running sums (blocks of turns, then block totals), so that no task holds a conversation.

Cases: turns are ordered by turn, role and text; null turns come last, null roles are the speaker
"unknown", null texts are empty. Repeated rows are turns each. Rows with a null conv_id are one
conversation. A conversation of system turns only has no perspective. Empty tables give empty
results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
#: Turn numbers in a block.
BLOCK = 64


def segment(speaker, role, text):
    """A rendered turn of ``role`` from the perspective of ``speaker``."""
    head = F.when(role == SYSTEM, F.lit("<|im_start|>system\n")).when(role == speaker, F.lit("<|im_start|>assistant\n")).otherwise(F.concat(F.lit("<|im_start|>user name="), role, F.lit("\n")))
    return head, F.concat(head, text, F.lit("<|im_end|>\n"))


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, position, turn, role, segment, begin, mask_begin, mask_end, trained."""
    base = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(2**62)))
    people = base.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    seen = base.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    head, whole = segment(F.col("perspective"), F.col("speaker"), F.col("text"))
    seen = seen.withColumn("segment", whole).withColumn("head", F.length(head)).withColumn("size", F.length("segment"))
    inner = Window.partitionBy("conv_id", "perspective", "block").orderBy(F.asc_nulls_last("turn"), "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    local = seen.select("*", F.coalesce(F.sum("size").over(inner), F.lit(0)).alias("before"), (F.count("*").over(inner) + 1).alias("rank"))
    totals = seen.groupBy("conv_id", "perspective", "block").agg(F.sum("size").alias("total"), F.count("*").alias("n"))
    outer = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base_of = totals.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("k"), F.coalesce(F.sum("total").over(outer), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base_rank"))
    placed = local.join(base_of, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("k")))
    trained = F.col("speaker") == F.col("perspective")
    begin = F.col("base") + F.col("before")
    return placed.select(
        "conv_id",
        "perspective",
        (F.col("base_rank") + F.col("rank")).alias("position"),
        "turn",
        F.when(F.col("speaker") == SYSTEM, "system").when(trained, "assistant").otherwise("user").alias("role"),
        F.when((F.col("speaker") != SYSTEM) & ~trained, F.col("speaker")).alias("name"),
        "segment",
        begin.alias("begin"),
        F.when(trained, begin + F.col("head")).alias("mask_begin"),
        # the end mark is trained on, the line break after it is not
        F.when(trained, begin + F.col("size") - 1).alias("mask_end"),
        F.when(trained, 1).otherwise(0).alias("trained"),
    )


def dialogues(rotated: DataFrame) -> DataFrame:
    """One rendered text for each conversation and perspective, for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "segment", "mask_begin", "mask_end")))
    spans = F.filter("parts", lambda x: x["mask_begin"].isNotNull())
    return rotated.groupBy("conv_id", "perspective").agg(parts.alias("parts")).select("conv_id", "perspective", F.array_join(F.transform("parts", lambda x: x["segment"]), "").alias("text"), F.transform(spans, lambda x: F.struct(x["mask_begin"].alias("begin"), x["mask_end"].alias("end"))).alias("masks"))
