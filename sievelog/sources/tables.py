"""The given tables as entities: a schema and a wide DataFrame for each."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelog.sources.schema import Schema, number, one_of, ref, string

SCHEMA = Schema(
    {
        "region": {"name": string()},
        "nation": {"name": string(), "region": ref("region")},
        "customer": {"name": string(), "nation": ref("nation"), "balance": number(), "segment": string()},
        "supplier": {"name": string(), "nation": ref("nation"), "balance": number(), "part": ref("part").multiple()},
        "part": {"name": string(), "word": string().multiple(), "brand": string(), "size": number(), "price": number()},
        "order": {"customer": ref("customer"), "status": one_of("F", "O", "P"), "total": number(), "priority": string()},
        "lineitem": {"order": ref("order"), "part": ref("part"), "supplier": ref("supplier"), "line": number(), "quantity": number(), "price": number()},
        "document": {"lang": string(), "source": string(), "chars": number(), "quality": number().optional(), "toxic": number().optional()},
        "user": {"type": string()},
    }
)


def _id(entity: str, column: str):
    return F.concat(F.lit(f"{entity}_"), F.col(column).cast("string"))


#: Where ids and references come from: entity and field to the table, its key column, and the entity that it numbers.
KEYS = {
    ("region", "id"): ("region", "r_regionkey", "region"), ("nation", "id"): ("nation", "n_nationkey", "nation"), ("nation", "region"): ("nation", "n_regionkey", "region"),
    ("customer", "id"): ("customer", "c_custkey", "customer"), ("customer", "nation"): ("customer", "c_nationkey", "nation"),
    ("supplier", "id"): ("supplier", "s_suppkey", "supplier"), ("supplier", "nation"): ("supplier", "s_nationkey", "nation"), ("part", "id"): ("part", "p_partkey", "part"),
    ("order", "id"): ("orders", "o_orderkey", "order"), ("order", "customer"): ("orders", "o_custkey", "customer"),
    ("lineitem", "order"): ("lineitem", "l_orderkey", "order"), ("lineitem", "part"): ("lineitem", "l_partkey", "part"), ("lineitem", "supplier"): ("lineitem", "l_suppkey", "supplier"),
    ("document", "id"): ("documents", "doc_id", "document"),
}


def _numbers(entity: str, ids: list[str]) -> list[int]:
    """The keys of ids; one that is no number in plain form has none."""
    rest = [i.removeprefix(f"{entity}_") for i in ids if i.startswith(f"{entity}_")]
    return [int(r) for r in rest if re.fullmatch(r"0|-?[1-9][0-9]{0,17}", r)]


def entity_frame(spark: SparkSession, sf_dir: str, entity: str, among: dict[str, list[str]] | None = None) -> DataFrame:
    """The wide DataFrame of an entity: id and its fields, with the source's types; of rows whose ids or
    references are ``among`` those given, read by the table's own keys."""
    asked = {f: KEYS[entity, f] for f in among or {} if (entity, f) in KEYS}

    def read(name: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        for field, (table, column, numbered) in asked.items():
            if table == name:
                rows = rows.where(F.col(column).isin(*_numbers(numbered, among[field])))
        return rows

    if entity == "region":
        return read("region").select(_id("region", "r_regionkey").alias("id"), F.col("r_name").alias("name"))
    if entity == "nation":
        return read("nation").select(_id("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"), _id("region", "n_regionkey").alias("region"))
    if entity == "customer":
        return read("customer").select(_id("customer", "c_custkey").alias("id"), F.col("c_name").alias("name"), _id("nation", "c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    if entity == "supplier":
        parts = read("lineitem").select("l_suppkey", "l_partkey").distinct().groupBy("l_suppkey").agg(F.sort_array(F.collect_list(_id("part", "l_partkey"))).alias("part"))
        base = read("supplier").join(parts, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        return base.select(_id("supplier", "s_suppkey").alias("id"), F.col("s_name").alias("name"), _id("nation", "s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), F.coalesce("part", F.array().cast("array<string>")).alias("part"))
    if entity == "part":
        return read("part").select(_id("part", "p_partkey").alias("id"), F.col("p_name").alias("name"), F.split("p_name", " ").alias("word"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"))
    if entity == "order":
        return read("orders").select(_id("order", "o_orderkey").alias("id"), _id("customer", "o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"))
    if entity == "lineitem":
        rows = read("lineitem")
        return rows.select(F.concat(F.lit("lineitem_"), F.xxhash64(*rows.columns).cast("string")).alias("id"), _id("order", "l_orderkey").alias("order"), _id("part", "l_partkey").alias("part"), _id("supplier", "l_suppkey").alias("supplier"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    if entity == "document":
        rows = read("documents").join(read("labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
        return rows.select(_id("document", "doc_id").alias("id"), "lang", "source", F.col("n_chars").alias("chars"), "quality", "toxic")
    raise KeyError(entity)


class Tables:
    """Frames of the given tables by entity, made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, entity: str) -> DataFrame:
        if entity not in self._made:
            self._made[entity] = entity_frame(self.spark, self.sf_dir, entity)
        return self._made[entity]

    def seek(self, entity: str, among: dict[str, list[str]]) -> DataFrame:
        """The frame, or the part of it with ids or references among those given."""
        return entity_frame(self.spark, self.sf_dir, entity, among) if among else self[entity]

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
