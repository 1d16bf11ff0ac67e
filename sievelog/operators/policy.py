"""Row and field permissions as Columns: rules, masks, write checks, dependencies."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelog.functions.values import ref_id
from sievelog.sources.schema import Schema, SchemaError

Rule = Callable[["Context"], Column]


class Context:
    """What a rule may read: the subject's own fields, declared paths along references, the actor."""

    def __init__(self, columns: Mapping[str, Column], actor: dict[str, Any] | None, after: Mapping[str, Column] | None = None):
        self._columns, self._actor, self._after = columns, actor or {}, after or {}
        self.asked_after = False

    def __getitem__(self, path: str) -> Column:
        if path not in self._columns:
            raise SchemaError(f"the rule reads {path}, which its policy does not declare")
        return self._columns[path]

    def after(self, name: str) -> Column:
        """The field as the write leaves it; absent where nothing is left."""
        self.asked_after = True
        return self._after.get(name, F.lit(None))

    @property
    def subject(self) -> Column:
        return self._columns["id"]

    def actor(self, name: str = "id") -> Column:
        value = ref_id(self._actor.get(name))
        return F.array(*[F.lit(ref_id(v)) for v in value]) if isinstance(value, (list, tuple)) else F.lit(value)

    def actor_value(self, name: str = "id") -> Any:
        return self._actor.get(name)


def nobody(_: Context) -> Column:
    return F.lit(False)


def anyone(_: Context) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class EntityPolicy:
    """A rule for each verb, paths that rules read, and overrides for single fields."""

    read: Rule = nobody
    create: Rule = nobody
    update: Rule = nobody
    delete: Rule = nobody
    fields: tuple[str, ...] = ()
    overrides: Mapping[str, Mapping[str, Rule]] = field(default_factory=dict)


def granted(rule: Rule, context: Context) -> Column:
    """Only true grants."""
    return F.coalesce(rule(context), F.lit(False))


def any_of(*rules: Rule) -> Rule:
    """A rule that grants what any of ``rules`` grants, and keeps them apart for joins."""

    def rule(c: Context) -> Column:
        return reduce(or_, [r(c) for r in rules])

    rule.alternatives = tuple(a for r in rules for a in alternatives(r))
    return rule


def alternatives(rule: Rule) -> tuple[Rule, ...]:
    return getattr(rule, "alternatives", (rule,))


class Policy:
    def __init__(self, schema: Schema, entities: Mapping[str, EntityPolicy]):
        if missing := set(schema.entities) - set(entities):
            raise SchemaError(f"no policy for {sorted(missing)[0]}")
        for entity, policy in entities.items():
            for path in policy.fields:
                self._walk(schema, entity, path)
            for name in policy.overrides:
                schema.field(entity, name)
        self.schema, self.entities = schema, dict(entities)

    @staticmethod
    def _walk(schema: Schema, entity: str, path: str) -> list[tuple[str, str]]:
        """(entity, field) of each step."""
        steps = []
        for at, name in enumerate(path.split(".")):
            known = schema.field(entity, name)
            steps.append((entity, name))
            if at < path.count("."):
                if known.kind != "ref":
                    raise SchemaError(f"{path}: {entity}/{name} is no reference")
                entity = known.points_to
        return steps

    def context(self, entity: str, raw: DataFrame, frames: Mapping[str, DataFrame], actor: dict[str, Any] | None, after: Mapping[str, Column] | None = None) -> tuple[DataFrame, Context, list[str]]:
        """``raw`` with the declared paths joined on, unfiltered; the rules' context; the added columns."""
        schema, added, rows = self.schema, [], raw
        columns: dict[str, Column] = {c: F.col(c) for c in raw.columns}
        for path in self.entities[entity].fields:
            steps = self._walk(schema, entity, path)
            for at in range(1, len(steps)):
                prefix = ".".join(n for _, n in steps[:at])
                here = ".".join(n for _, n in steps[: at + 1])
                if here in columns:
                    continue
                own, key = f"__ctx_{here.replace('.', '_')}", f"__key_{here.replace('.', '_')}"
                target, name = steps[at]
                side = frames[target].select(F.col("id").alias(key), F.col(name).alias(own))
                if schema.field(*steps[at - 1]).is_multiple:
                    # a path through a list maps over its elements
                    pairs = rows.select(F.col("id").alias("__own"), F.explode(columns[prefix]).alias("__each")).join(side, F.col("__each") == F.col(key))
                    value = F.flatten(F.collect_set(own)) if schema.field(target, name).is_multiple else F.collect_set(own)
                    side = pairs.groupBy("__own").agg(value.alias(own))
                    rows = rows.join(side, F.col("id") == F.col("__own"), "left").drop("__own")
                else:
                    rows = rows.join(side, columns[prefix] == F.col(key), "left").drop(key)
                columns[here] = F.col(own)
                added.append(own)
        return rows, Context(columns, actor, after), added

    def mask(self, schema: Schema, entity: str, raw: DataFrame, frames: Mapping[str, DataFrame], actor: dict[str, Any] | None) -> DataFrame:
        """Each field as this reader may see it; hidden is absent. Rows with nothing to see are gone."""
        policy = self.entities[entity]
        rows, context, _ = self.context(entity, raw, frames, actor)
        base = granted(policy.read, context)
        shown = []
        for name in raw.columns:
            if name != "id":
                rule = policy.overrides.get(name, {}).get("read")
                shown.append(F.when(base if rule is None else granted(rule, context), F.col(name)).alias(name))
        out = rows
        if not any("read" in x for x in policy.overrides.values()):
            return out.where(base).select(*raw.columns)
        return out.select("id", *shown).where(reduce(or_, [F.col(c).isNotNull() for c in raw.columns if c != "id"]))

    def mask_each(self, entity: str, raw: DataFrame, frames: Mapping[str, DataFrame], actors: DataFrame) -> DataFrame:
        """``mask`` for every reader of ``actors`` (id and what rules read of them): (actor, row) pairs.

        Each alternative of the read rules is the condition of a join of its own, so that one which
        equates a field with one of the reader's is an equi-join, and only pairs that grant something
        come out, once each.
        """
        who = actors.dropDuplicates(["id"]).select(*[F.col(c).alias(f"__actor_{c}") for c in actors.columns])
        rows, context, _ = self.context(entity, raw, frames, {c: F.col(f"__actor_{c}") for c in actors.columns})
        policy = self.entities[entity]
        reads = {f: o["read"] for f, o in policy.overrides.items() if "read" in o}
        base, shown = granted(policy.read, context), []
        ways = [rows.join(who, a(context)) for r in (policy.read, *reads.values()) for a in alternatives(r)]
        pairs = reduce(DataFrame.unionByName, ways)
        pairs = pairs.dropDuplicates(["__actor_id", "id"]) if len(ways) > 1 else pairs
        for name in raw.columns:
            if name != "id":
                shown.append(F.when(granted(reads[name], context) if name in reads else base, F.col(name)).alias(name))
        masked = pairs.select(F.col("__actor_id").alias("actor"), "id", *shown)
        return masked.where(reduce(or_, [F.col(c).isNotNull() for c in raw.columns if c != "id"])) if reads else masked

    def readable(self, entity: str, subjects: DataFrame, frames: Mapping[str, DataFrame], actor: dict[str, Any] | None) -> DataFrame:
        """(id, field) for each field of ``subjects`` (id) that its own rule shows, whether or not it holds a value."""
        policy, raw = self.entities[entity], subjects.join(frames[entity], "id", "left")
        rows, context, _ = self.context(entity, raw, frames, actor)
        rules = {f: policy.overrides.get(f, {}).get("read", policy.read) for f in self.schema.entities[entity]}
        names = F.array_compact(F.array(*[F.when(granted(r, context), F.lit(f)) for f, r in rules.items()]))
        return rows.select("id", F.explode(names).alias("field"))

    def can_see(self, entity: str, raw: DataFrame, frames: Mapping[str, DataFrame], actor: dict[str, Any] | None) -> DataFrame:
        """The ids that the entity's read rule shows."""
        rows, context, _ = self.context(entity, raw, frames, actor)
        return rows.where(granted(self.entities[entity].read, context)).select("id")

    def dependencies(self) -> dict[str, list[tuple[str, str]]]:
        """For every predicate that a read rule reads along references: (root entity, path to it)."""
        out: dict[str, list[tuple[str, str]]] = {}
        for entity, policy in self.entities.items():
            for path in policy.fields:
                steps = self._walk(self.schema, entity, path)
                for at, (owner, name) in enumerate(steps):
                    out.setdefault(f"{owner}/{name}", []).append((entity, ".".join(n for _, n in steps[:at])))
        return {k: sorted(set(v)) for k, v in out.items()}

    def affected(self, changed: DataFrame, predicate: str, frames: Mapping[str, DataFrame]) -> DataFrame:
        """Roots (entity, id) whose visibility may change with ``predicate`` on ``changed`` (id): a backward walk."""
        parts = []
        for root, path in self.dependencies().get(predicate, []):
            steps = [s for s in self._walk(self.schema, root, path)] if path else []
            ids = changed.select("id")
            for owner, name in reversed(steps):
                key = F.explode(name) if self.schema.field(owner, name).is_multiple else F.col(name)
                edges = frames[owner].select(F.col("id").alias("__from"), key.alias("__to"))
                ids = edges.join(ids, F.col("__to") == F.col("id"), "left_semi").select(F.col("__from").alias("id")).distinct()
            parts.append(ids.select(F.lit(root).alias("entity"), "id"))
        if not parts:
            return changed.select(F.lit("").alias("entity"), "id").limit(0)
        return reduce(DataFrame.unionByName, parts).distinct()

    def write_verdicts(self, entity: str, before: DataFrame, after: DataFrame, deleted: DataFrame, touched: DataFrame, frames: Mapping[str, DataFrame], frames_after: Mapping[str, DataFrame], actor: dict[str, Any] | None) -> DataFrame:
        """(id, verb, field, ok) for each touched subject and field of ``touched`` (id, field).

        An explicit delete is a delete, a subject with facts before is updated, any other created.
        Creations are judged on the state after, the others on the state before; updates also see
        ``after``. A field's write override stands in for create and update, not for delete.
        """
        policy = self.entities[entity]
        gone, asked = deleted.select("id"), touched.select("id", F.col("field").alias("__field"))
        kept = asked.join(gone, "id", "left_anti")
        verbs = (
            ("create", kept.join(before.select("id"), "id", "left_anti"), after, frames_after, "left"),
            ("update", kept, before, frames, "inner"),
            ("delete", asked.join(gone, "id", "left_semi"), before, frames, "left"),
        )
        parts = []
        for name, own, state, other, how in verbs:
            # each state is joined once, and no row but the touched ones is judged
            rows = own.join(state.withColumn("__there", F.lit(True)), "id", how)
            after_columns: dict[str, Column] = {c: F.col(c) for c in state.columns} if name == "create" else {}
            if name == "update":
                after_columns = {c: F.col(f"__after_{c}") for c in after.columns if c != "id"}
            joined, context, _ = self.context(entity, rows, other, actor, after_columns)
            value = granted(getattr(policy, name), context)
            writes = {f: granted(o["write"], context) for f, o in policy.overrides.items() if "write" in o} if name != "delete" else {}
            for f, w in writes.items():
                value = F.when(F.col("__field") == f, w).otherwise(value)
            if name == "update" and context.asked_after:
                later = after.select(*[F.col(c).alias(f"__after_{c}") for c in after.columns])
                joined = joined.join(later, F.col("id") == F.col("__after_id"), "left")
            ok = F.coalesce(F.when(F.col("__there"), value), F.lit(False))
            parts.append(joined.select("id", F.lit(name).alias("verb"), F.col("__field").alias("field"), ok.alias("ok")))
        return reduce(DataFrame.unionByName, parts)


# Rules as data.


def _paths(rule: Any) -> set[str]:
    if isinstance(rule, str):
        return {rule.removeprefix("fields.")} if rule.startswith("fields.") else set()
    if isinstance(rule, dict):
        return set() if "literal" in rule else set().union(*map(_paths, rule.values())) if rule else set()
    return set().union(*map(_paths, rule)) if isinstance(rule, list) else set()


def _operand(value: Any, where: str) -> Callable[[Context], Column]:
    if isinstance(value, dict) and set(value) == {"literal"}:
        fixed = ref_id(value["literal"])
        return lambda c: F.lit(fixed)
    if value == "subject":
        return lambda c: c.subject
    if isinstance(value, str):
        head, _, rest = value.partition(".")
        if head == "actor":
            return lambda c: c.actor(rest or "id")
        if head == "fields" and rest:
            return lambda c: c[rest]
        if head == "after" and rest:
            return lambda c: c.after(rest)
    raise SchemaError(f"{where}: not a path or literal: {value!r}")


def compile_rule(rule: Any, where: str = "rule") -> Rule:
    """JSON to a rule. A missing value on either side of a comparison is false."""
    bare = _bare(rule, where)

    def whole(c: Context) -> Column:
        return granted(bare, c)

    whole.alternatives = alternatives(bare)
    return whole


def _bare(rule: Any, where: str) -> Rule:
    """The rule as joins take it, its comparisons bare: null stands for false, and negations see to that."""
    if rule is True or rule is False:
        return anyone if rule else nobody
    if not isinstance(rule, dict) or len(rule) != 1:
        raise SchemaError(f"{where}: a rule is true, false or an object with one operator")
    ((op, body),) = rule.items()
    if op == "equals":
        if not isinstance(body, list) or len(body) != 2:
            raise SchemaError(f"{where}.equals: two operands")
        a, b = (_operand(x, f"{where}.equals") for x in body)
        return lambda c: a(c) == b(c)
    if op == "in":
        if not isinstance(body, list) or len(body) != 2:
            raise SchemaError(f"{where}.in: two operands")
        needle = _operand(body[0], f"{where}.in")
        if isinstance(body[1], list):
            items = [_operand(x, f"{where}.in") for x in body[1]]
            return lambda c: reduce(or_, [needle(c) == i(c) for i in items], F.lit(False))
        hay = _operand(body[1], f"{where}.in")
        return lambda c: F.array_contains(hay(c), needle(c))
    if op in ("anyOf", "allOf"):
        if not isinstance(body, list) or not body:
            raise SchemaError(f"{where}.{op}: a list of rules")
        parts = [_bare(x, f"{where}.{op}[{i}]") for i, x in enumerate(body)]
        return any_of(*parts) if op == "anyOf" else lambda c: reduce(and_, [p(c) for p in parts])
    if op == "not":
        inner = _bare(body, f"{where}.not")
        return lambda c: ~granted(inner, c)
    raise SchemaError(f"{where}: unknown operator {op}")


def compile_policy(schema: Schema, declared: Mapping[str, Mapping[str, Any]]) -> Policy:
    """Policies as data: verbs, and fields with their read and write rules; a missing verb denies."""
    out = {}
    for entity in schema.entities:
        spec = declared.get(entity, {})
        rules = {v: compile_rule(spec.get(v, False), f"{entity}.{v}") for v in ("read", "create", "update", "delete")}
        overrides = {f: {k: compile_rule(r, f"{entity}.fields.{f}.{k}") for k, r in o.items()} for f, o in spec.get("fields", {}).items()}
        paths = sorted(p for p in _paths([spec.get(v, False) for v in rules] + list(spec.get("fields", {}).values())) if "." in p)
        out[entity] = EntityPolicy(**rules, fields=tuple(paths), overrides=overrides)
    return Policy(schema, out)
