"""Operators on fact tables: scans, folds, overlays, differences, shapes."""

from __future__ import annotations

from decimal import Decimal
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelog.functions.values import FACT, entity_column, fact_key, fact_value
from sievelog.sources.schema import Field, Schema


def unpivot(schema: Schema, entity: str, wide: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Wide rows as facts, in one pass."""
    parts: list[Column] = []
    for name in names or [n for n in schema.entities[entity] if n in wide.columns]:
        field = schema.field(entity, name)
        col = F.coalesce(F.col(name), F.array()) if field.is_multiple else F.array_compact(F.array(F.col(name)))
        parts.append(F.transform(col, partial(_fact_struct, field, f"{entity}/{name}")))
    facts = wide.select(F.col("id").alias("subject"), F.explode(F.concat(*parts)).alias("f"))
    return facts.select("subject", *[F.col(f"f.{c}") for c in FACT[1:]])


def _fact_struct(field: Field, predicate: str, value: Column) -> Column:
    none = {"s": F.lit(None).cast("string"), "n": F.lit(None).cast("double"), "b": F.lit(None).cast("boolean")}
    tag = {"number": "n", "boolean": "b", "ref": "r", "object": "o"}.get(field.kind, "s")
    if field.kind == "union":
        tag, none = value["tag"], {"s": value["s"], "n": value["n"], "b": value["b"]}
    else:
        tag = F.lit(tag)
        slot = {"number": "n", "boolean": "b"}.get(field.kind, "s")
        none[slot] = F.to_json(value) if field.kind == "object" else value.cast({"s": "string", "n": "double", "b": "boolean"}[slot])
    return F.struct(F.lit(predicate).alias("predicate"), tag.alias("tag"), *[c.alias(k) for k, c in none.items()])


def widen(schema: Schema, entity: str, facts: DataFrame) -> DataFrame:
    """Facts as one row a subject: a single aggregation, partial before its shuffle."""
    columns = []
    for name, field in schema.entities[entity].items():
        mine = F.col("predicate") == f"{entity}/{name}"
        slot = {"number": F.col("n"), "boolean": F.col("b")}.get(field.kind, F.col("s"))
        if field.kind == "union":
            slot = F.struct("tag", "s", "n", "b")
        if field.is_multiple:
            columns.append(F.sort_array(F.collect_set(F.when(mine, slot))).alias(name))
        elif field.kind == "object":
            columns.append(F.from_json(F.max(F.when(mine, slot)), field.spark_type()).alias(name))
        else:
            columns.append(F.max(F.when(mine, slot)).alias(name))
    own = facts.where(entity_column(F.col("subject")) == entity).where(F.col("predicate").startswith(f"{entity}/"))
    return own.groupBy(F.col("subject").alias("id")).agg(*columns)


def match(facts: DataFrame, subject: str | None = None, predicate: str | None = None, value: Any = None) -> DataFrame:
    """Facts that fit a pattern; what is left out matches anything."""
    out = facts
    if subject is not None:
        out = out.where(F.col("subject") == subject)
    if predicate is not None:
        out = out.where(F.col("predicate") == predicate)
    if value is not None:
        tag, s, n, b = fact_value(value)
        slot, bound = {"n": ("n", n), "b": ("b", b)}.get(tag, ("s", s))
        out = out.where((F.col("tag") == tag) & (F.col(slot) == bound))
    return out


def match_subjects(facts: DataFrame, ids: DataFrame, predicate: str) -> DataFrame:
    """Facts of one predicate for any of ``ids`` (id)."""
    return facts.where(F.col("predicate") == predicate).join(ids.select(F.col("id").alias("subject")), "subject", "left_semi")


def match_range(facts: DataFrame, predicate: str, **bounds: Any) -> DataFrame:
    """Facts of one predicate in a range of the encoded order: by tag, then by value."""
    out = facts.where(F.col("predicate") == predicate)
    for op, bound in bounds.items():
        tag, s, n, b = fact_value(bound)
        slot, value = {"n": ("n", n), "b": ("b", b)}.get(tag, ("s", s))
        up = op in ("gt", "gte")
        inner = {"gt": F.col(slot) > value, "gte": F.col(slot) >= value, "lt": F.col(slot) < value, "lte": F.col(slot) <= value}[op]
        out = out.where(F.when(F.col("tag") == tag, inner).otherwise(F.col("tag") > tag if up else F.col("tag") < tag))
    return out


def top_subjects(facts: DataFrame, ids: DataFrame | None, predicate: str, take: int, descending: bool = False, after: tuple[Any, str] | None = None) -> DataFrame:
    """(subject, value fact) ranked by value and subject, from a cursor on."""
    rows = match_subjects(facts, ids, predicate) if ids is not None else facts.where(F.col("predicate") == predicate)
    value = F.struct("tag", "s", "n", "b")
    if after:
        tag, s, n, b = fact_value(after[0])
        bound = F.struct(F.lit(tag).alias("tag"), F.lit(s).cast("string").alias("s"), F.lit(n).cast("double").alias("n"), F.lit(b).cast("boolean").alias("b"))
        rows = rows.where((value < bound if descending else value > bound) | ((value == bound) & (F.col("subject") > after[1])))
    return rows.orderBy(value.desc() if descending else value.asc(), F.col("subject").asc()).limit(take)


def fold(log: DataFrame) -> DataFrame:
    """State of a log (version, seq, op, fact): facts whose last operation added them.

    Version and seq are one number, so that the aggregation's buffers are of fixed width and it hashes
    instead of sorting its rows before and after the shuffle; null comes before any number.
    """
    version, seq = (F.coalesce(F.col(c).cast("long"), F.lit(-(1 << 63))).cast("decimal(19,0)") for c in ("version", "seq"))
    place = version * F.lit(Decimal(10**19)) + seq
    last = F.max_by(F.col("op") == "+", place)
    return log.groupBy(*FACT).agg(last.alias("added")).where("added").drop("added")


def fold_last_write(log: DataFrame, key: str, value: str, version: str) -> DataFrame:
    """For set operations on single fields: the last value of each key."""
    return log.groupBy(key).agg(F.max_by(value, version).alias(value))


def without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys) that are not among ``others``; nulls equal nulls, as a fact has in two of its places."""
    whole = F.struct(*keys)
    return rows.select(keys).withColumn("__k", whole).join(others.select(whole.alias("__k")), "__k", "left_anti").drop("__k")


def overlay(base: DataFrame, removed: DataFrame, added: DataFrame, keys: list[str]) -> DataFrame:
    """Base without removed, with added, as a set."""
    return without(base, removed, keys).unionByName(added.select(keys)).distinct()


def evictable(held: DataFrame, *needed: DataFrame) -> DataFrame:
    """Facts of a cache that no live query's payload holds."""
    for payload in needed:
        held = without(held, payload, held.columns)
    return held.distinct()


def effective(facts: DataFrame, delta: DataFrame) -> DataFrame:
    """Changes (op, fact) that change anything: removals of what is there, additions of what is not.

    What is removed and added again stays. One aggregation marks each fact as held, removed and added.
    """
    no, added, removed = F.lit(False), F.col("op") == "+", F.col("op") == "-"
    held = facts.select(*FACT, F.lit(True).alias("was"), no.alias("come"), no.alias("gone"))
    rows = held.unionByName(delta.select(*FACT, no.alias("was"), added.alias("come"), removed.alias("gone")))
    marked = rows.groupBy(*FACT).agg(*[F.max(c).alias(c) for c in ("was", "come", "gone")])
    op = F.when(F.col("come") & ~F.col("was"), "+").when(F.col("gone") & F.col("was") & ~F.col("come"), "-")
    return marked.withColumn("op", op).where("op IS NOT NULL").select("op", *FACT)


def difference(before: DataFrame, after: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(gone, come) between two sets of ids."""
    one, two = before.select(key).distinct(), after.select(key).distinct()
    return one.join(two, key, "left_anti"), two.join(one, key, "left_anti")


def inbound(schema: Schema, facts: DataFrame, subject: str) -> DataFrame:
    """References that point at a subject."""
    refs = [p for p, f in schema.predicates.items() if f.kind == "ref"]
    return facts.where(F.col("predicate").isin(*refs) & (F.col("tag") == "r") & (F.col("s") == subject))


def delete_sweep(schema: Schema, facts: DataFrame, subject: str) -> DataFrame:
    """What deleting a subject removes: its facts and references to it."""
    return facts.where(F.col("subject") == subject).unionByName(inbound(schema, facts, subject)).distinct()


def required_violations(schema: Schema, entity: str, after: DataFrame) -> DataFrame:
    """(id, field) of surviving rows that lack a required field."""
    fields = schema.entities[entity]
    needed = [n for n, f in fields.items() if f.is_required and n in after.columns]
    if not needed:
        return after.select("id", F.lit("").alias("field")).limit(0)
    any_left = F.lit(False)
    for name, field in fields.items():
        if name in after.columns:
            any_left = any_left | (F.size(F.coalesce(F.col(name), F.array())) > 0 if field.is_multiple else F.col(name).isNotNull())
    lacking = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in needed]))
    return after.where(any_left).select("id", F.explode(lacking).alias("field"))


def entity_counts(facts: DataFrame) -> DataFrame:
    """Distinct subjects of each entity."""
    return facts.groupBy(entity_column(F.col("subject")).alias("entity")).agg(F.countDistinct("subject").alias("n"))


def fingerprints(rows: DataFrame, key: str = "id") -> DataFrame:
    """A hash of each row's other columns."""
    rest = [c for c in rows.columns if c != key]
    return rows.select(key, F.xxhash64(F.to_json(F.struct(*rest))).alias("mark"))


def changed_rows(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Keys of rows that came, went or differ."""
    one, two = fingerprints(before, key), fingerprints(after, key).withColumnRenamed("mark", "now")
    return one.join(two, key, "full_outer").where(~F.col("mark").eqNullSafe(F.col("now"))).select(key)


def by_subject(delta: DataFrame) -> DataFrame:
    """A delta's predicates for each subject and entity."""
    return delta.groupBy("subject", entity_column(F.col("subject")).alias("entity")).agg(F.sort_array(F.collect_set("predicate")).alias("predicates"))


def present(events: DataFrame, joins: Column, leaves: Column, who: str, version: str) -> DataFrame:
    """Who is online: the last join or leave of each is a join."""
    seen = events.where(joins | leaves)
    return seen.groupBy(who).agg(F.max_by(joins, version).alias("on")).where("on").select(who)


def coalesced(events: DataFrame, keys: list[Column], payload: str, version: str) -> DataFrame:
    """The latest payload of each key."""
    return events.groupBy(*keys).agg(F.max_by(payload, version).alias("payload"))
