"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, attach_hot, materialize


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``edges`` (u, v) with the smallest neighbour m of u. A star's centre may hold most edges: ``least``
    is broadcast if its ``n`` rows at most are few, otherwise copied for such centres."""
    if n <= BROADCAST_ROWS:
        return edges.join(F.broadcast(least), "u")
    return attach_hot(materialize(edges, "star-edges"), materialize(least, "least"), "u", "v")


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Every node hands its larger neighbours to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return _with_least(both.where("v > u"), least, 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Every node links its smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = _with_least(edges, least, n)
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node reachable.

    Each round is written to the shared folder. It ends when a round leaves the edges as they were.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = materialize(ordered, "edges"), None
    for _ in range(most):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        larger = _large(now, mark[0]).where("u <> v").distinct()
        now = materialize(_small(larger, mark[0]).where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
