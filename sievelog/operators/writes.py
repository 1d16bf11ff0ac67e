"""Transactions: drafts and operations, their compilation, and the checked path to a commit.

A transaction is small and is compiled on the driver against the facts of the subjects it touches;
``compile_bulk`` does the same for operation tables of any size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelog.functions.values import FACT, FACTS, entity_of_id, fact_value
from sievelog.operators.facts import delete_sweep, required_violations, widen
from sievelog.operators.policy import Policy
from sievelog.sources.schema import Schema, SchemaError, check_id, value_problem
from sievelog.sources.warehouse import Warehouse

Fact = tuple[str, str, str, str | None, float | None, bool | None]


class Rejected(RuntimeError):
    pass


@dataclass(frozen=True)
class Operation:
    kind: str  # set, add, remove, delete
    subject: str
    field: str | None = None
    value: Any = None


def new_id(entity: str) -> str:
    return f"{entity}_{uuid.uuid4().hex[:8]}"


class _List:
    """A list field of a draft: push and remove are recorded, reads see them."""

    def __init__(self, tx: Transaction, subject: str, name: str, values: list[Any]):
        self._tx, self._subject, self._name, self._values = tx, subject, name, list(values)

    def push(self, value: Any) -> None:
        self._tx.operations.append(Operation("add", self._subject, self._name, value))
        if value not in self._values:
            self._values.append(value)

    def remove(self, value: Any) -> None:
        self._tx.operations.append(Operation("remove", self._subject, self._name, value))
        self._values = [v for v in self._values if v != value]

    def __iter__(self):
        return iter(self._values)

    def __len__(self) -> int:
        return len(self._values)


class Draft:
    """Attribute access to one subject inside a transaction."""

    def __init__(self, tx: Transaction, entity: str, subject: str, values: Mapping[str, Any]):
        object.__setattr__(self, "_tx", tx)
        object.__setattr__(self, "_entity", entity)
        object.__setattr__(self, "id", subject)
        object.__setattr__(self, "_values", dict(values))

    def __getattr__(self, name: str) -> Any:
        field = self._tx.schema.field(self._entity, name)
        if field.is_multiple and not isinstance(self._values.get(name), _List):
            self._values[name] = _List(self._tx, self.id, name, self._values.get(name) or [])
        return self._values.get(name)

    def __setattr__(self, name: str, value: Any) -> None:
        field = self._tx.schema.field(self._entity, name)
        if field.is_multiple:
            raise SchemaError(f"{name} is a list; push and remove")
        if value is None and not field.is_optional:
            raise SchemaError(f"{name} is required")
        self._tx.operations.append(Operation("set", self.id, name, value))
        self._values[name] = value


class Transaction:
    def __init__(self, schema: Schema):
        self.schema, self.operations = schema, []

    def edit(self, entity: str, subject: str, values: Mapping[str, Any] | None = None) -> Draft:
        check_id(self.schema, entity, subject)
        return Draft(self, entity, subject, values or {})

    def create(self, entity: str, values: Mapping[str, Any], subject: str | None = None) -> Draft:
        fields = self.schema.entities[entity]
        for name in values:
            self.schema.field(entity, name)
        for name, field in fields.items():
            if field.is_required and values.get(name) is None:
                raise SchemaError(f"{entity}/{name} is required")
        subject = subject or new_id(entity)
        check_id(self.schema, entity, subject)
        for name, value in values.items():
            if fields[name].is_multiple:
                self.operations += [Operation("add", subject, name, v) for v in value or ()]
            elif value is not None:
                self.operations.append(Operation("set", subject, name, value))
        return Draft(self, entity, subject, values)

    def delete(self, subject: str) -> None:
        self.operations.append(Operation("delete", subject))


def validate(schema: Schema, op: Operation) -> None:
    entity = entity_of_id(op.subject)
    check_id(schema, entity, op.subject)
    if op.kind == "delete":
        return
    field = schema.field(entity, op.field)
    if op.kind == "set" and field.is_multiple:
        raise Rejected(f"{entity}/{op.field} holds several values; add or remove")
    if op.kind in ("add", "remove") and not field.is_multiple:
        raise Rejected(f"{entity}/{op.field} holds one value; set it")
    if op.value is None:
        if op.kind == "set" and field.is_optional:
            return
        raise Rejected(f"{entity}/{op.field} is required")
    if problem := value_problem(field, op.value):
        raise Rejected(f"{entity}/{op.field}: {problem}")


def compile_operations(schema: Schema, operations: Iterable[Operation], facts_of: Callable[[str], set[Fact]], inbound_of: Callable[[str], set[Fact]]) -> tuple[set[Fact], set[Fact]]:
    """(added, removed): operations in order, later ones see earlier effects, opposites cancel."""
    added: set[Fact] = set()
    removed: set[Fact] = set()

    def add(fact: Fact) -> None:
        if fact in removed:
            removed.discard(fact)
        else:
            added.add(fact)

    def remove(fact: Fact) -> None:
        if fact in added:
            added.discard(fact)
        else:
            removed.add(fact)

    def current(subject: str) -> set[Fact]:
        return (facts_of(subject) - removed) | {f for f in added if f[0] == subject}

    for op in operations:
        validate(schema, op)
        if op.kind == "delete":
            pointing = (inbound_of(op.subject) - removed) | {f for f in added if f[2] == "r" and f[3] == op.subject}
            for fact in current(op.subject) | pointing:
                remove(fact)
            continue
        predicate = f"{entity_of_id(op.subject)}/{op.field}"
        if op.kind == "set":
            for fact in current(op.subject):
                if fact[1] == predicate:
                    remove(fact)
            if op.value is not None:
                add((op.subject, predicate, *fact_value(op.value)))
        elif op.kind == "add":
            add((op.subject, predicate, *fact_value(op.value)))
        else:
            remove((op.subject, predicate, *fact_value(op.value)))
    return added, removed


def compile_bulk(operations: DataFrame, facts: DataFrame) -> DataFrame:
    """Changes (op, fact) of an operation table (seq, kind, fact): the last operation wins.

    A set removes the field's other values, a delete all of a subject's facts and all references to
    it, each at its place in the order; adds and removes after it still count.
    """
    sets = operations.where("kind = 'set'").groupBy("subject", "predicate").agg(F.max("seq").alias("set_at"))
    deletes = operations.where("kind = 'delete'").groupBy("subject").agg(F.max("seq").alias("deleted_at"))
    old = facts.select(F.lit(-1).cast("long").alias("seq"), F.lit("+").alias("op"), *FACT)
    new = operations.where("kind <> 'delete'").select(F.col("seq").cast("long"), F.when(F.col("kind") == "remove", "-").otherwise("+").alias("op"), *FACT)
    swept = deletes.select(F.col("subject").alias("gone"), F.col("deleted_at").alias("swept_at"))
    pointing = lambda rows: (rows["tag"] == "r") & (rows["s"] == swept["gone"])
    own = old.join(operations.select("subject").distinct(), "subject", "left_semi")
    rows = own.unionByName(old.join(swept, pointing(old), "left_semi")).unionByName(new)
    last = rows.groupBy(*FACT).agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"), F.max(F.col("seq") < 0).alias("was"))
    last = last.join(sets, ["subject", "predicate"], "left").join(deletes, "subject", "left")
    last = last.join(swept, pointing(last), "left")
    cut = F.greatest(*(F.coalesce(at, F.lit(-2)) for at in ("set_at", "deleted_at", "swept_at")))
    stays = (F.col("op") == "+") & (F.col("seq") >= cut)
    return last.withColumn("now", stays).where("now <> was").select(F.when(F.col("now"), "+").otherwise("-").alias("op"), *FACT)


class Engine:
    """A workspace under a schema and a policy: queries, checked and trusted writes."""

    def __init__(self, store: Warehouse, schema: Schema, policy: Policy | None = None, accepted: Iterable[str] = ()):
        self.store, self.schema, self.policy = store, schema, policy
        self.accepted = {schema.generation, *accepted}

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def check_generation(self, generation: str | None) -> None:
        if generation is not None and generation not in self.accepted:
            raise Rejected("the schema is outdated")

    def reload(self, schema: Schema, policy: Policy | None) -> None:
        """A new schema and policy; readers of earlier generations stay accepted."""
        self.accepted |= {schema.generation}
        self.schema, self.policy = schema, policy

    def frames(self, facts: DataFrame | None = None) -> dict[str, DataFrame]:
        facts = self.store.facts() if facts is None else facts
        return {e: widen(self.schema, e, facts) for e in self.schema.entities}

    def planner(self, actor: dict[str, Any] | None = None, facts: DataFrame | None = None):
        from sievelog.plans.planner import Planner

        return Planner(self.schema, self.frames(facts), self.policy if actor is not None else None, actor)

    def actor_record(self, subject: str, facts: DataFrame) -> dict[str, Any]:
        """The actor's own facts, all of them; without any just the id."""
        rows = widen(self.schema, entity_of_id(subject), facts.where(F.col("subject") == subject)).collect()
        return rows[0].asDict() if rows else {"id": subject}

    def _compiled(self, operations: list[Operation], facts: DataFrame) -> DataFrame:
        # bounded by the transaction: the facts of its subjects and references to deleted ones
        subjects = {o.subject for o in operations}
        held: dict[str, set[Fact]] = {}
        for row in facts.where(F.col("subject").isin(*subjects)).select(*FACT).collect():
            held.setdefault(row.subject, set()).add(tuple(row))
        swept: dict[str, set[Fact]] = {s: {tuple(r) for r in delete_sweep(self.schema, facts, s).select(*FACT).collect()} for s in {o.subject for o in operations if o.kind == "delete"}}
        added, removed = compile_operations(self.schema, operations, lambda s: held.get(s, set()), lambda s: swept.get(s, set()))
        rows = [("-", *f) for f in sorted(removed, key=str)] + [("+", *f) for f in sorted(added, key=str)]
        return self.spark.createDataFrame(rows, f"op string, {FACTS}")

    def _states(self, facts: DataFrame, delta: DataFrame) -> DataFrame:
        keys = FACT
        nullsafe = facts.select(*keys).exceptAll(delta.where("op = '-'").select(*keys).distinct())
        return nullsafe.unionByName(delta.where("op = '+'").select(*keys)).distinct()

    def transact(self, build: Callable[[Transaction], None] | list[Operation], actor: str, generation: str | None = None) -> int | None:
        """The checked path: generation, types, policy, required fields, then a commit."""
        self.check_generation(generation)
        operations = build
        if callable(build):
            build(tx := Transaction(self.schema))
            operations = tx.operations
        if not operations:
            return None
        facts = self.store.facts()
        try:
            delta = self._compiled(operations, facts).cache()
        except SchemaError as e:
            raise Rejected(str(e)) from None
        after = self._states(facts, delta)
        frames, later = self.frames(facts), self.frames(after)
        deleted = [o.subject for o in operations if o.kind == "delete"]
        touched = {(r.subject, r.predicate) for r in delta.select("subject", "predicate").distinct().collect()}
        if self.policy is not None:
            record = self.actor_record(actor, facts)
            for entity in sorted({entity_of_id(s) for s, _ in touched}):
                own = self.spark.createDataFrame([(s, p.split("/", 1)[1]) for s, p in touched if entity_of_id(s) == entity], "id string, field string")
                gone = self.spark.createDataFrame([(s,) for s in deleted], "id string")
                bad = self.policy.write_verdicts(entity, frames[entity], later[entity], gone, own, frames, later, record).where("not ok").orderBy("id", "field").first()
                if bad:
                    raise Rejected(f"{bad.verb} of {bad.id} ({bad.field}) is not allowed")
        for entity in sorted({entity_of_id(s) for s, _ in touched}):
            ids = sorted({s for s, _ in touched if entity_of_id(s) == entity})
            lacking = required_violations(self.schema, entity, later[entity].where(F.col("id").isin(*ids))).orderBy("id", "field").first()
            if lacking:
                raise Rejected(f"{lacking.id} would lack {entity}/{lacking.field}")
        return self.store.apply(delta, actor)

    def commit(self, operations: list[Operation] | DataFrame, actor: str | None = None) -> int | None:
        """The trusted path, for seeds and upkeep: no policy, no required check."""
        delta = operations if isinstance(operations, DataFrame) else self._compiled(operations, self.store.facts())
        return self.store.apply(delta, actor)

    def ensure(self, subject: str, values: Mapping[str, Any]) -> int | None:
        """Sets what differs of an identity's record."""
        return self.commit([Operation("set", subject, k, v) for k, v in values.items()])


__all__ = ["Draft", "Engine", "Operation", "Rejected", "Transaction", "compile_bulk", "compile_operations", "new_id", "validate"]
