"""Turns a query into one lazy DataFrame, under a reader's policy.

Order of work: unfiltered context joins, masks, constraints on masked columns, whole roots, window,
selection. A positive constraint also holds on the raw column, so it is put below the masks too,
where it reaches the scan. Negations and absences never are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace
from functools import partial, reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelog.functions.values import fact_value
from sievelog.operators.policy import Policy
from sievelog.plans.query import Constraint, Query, QueryError, Row, Selection, _constrained
from sievelog.sources.schema import Field, Schema


def _value(value: Any, field: Field | None) -> Column:
    if field is not None and field.kind == "union":
        tag, s, n, b = fact_value(value)
        return F.struct(F.lit(tag).alias("tag"), F.lit(s).cast("string").alias("s"), F.lit(n).cast("double").alias("n"), F.lit(b).cast("boolean").alias("b"))
    return F.lit(value)


def _holds(col: Column, field: Field, values: tuple[Any, ...]) -> Column:
    """Whether the field holds any of the values; null where it can't be said."""
    if not values:
        return F.lit(False)
    if field.is_multiple:
        return F.arrays_overlap(col, F.array(*[_value(v, field) for v in values]))
    if field.kind in ("union", "object"):
        return reduce(or_, [col == _value(v, field) for v in values])
    return col == F.lit(values[0]) if len(values) == 1 else col.isin(*values)


def _absent(col: Column, field: Field) -> Column:
    return col.isNull() | (F.size(col) == 0) if field.is_multiple else col.isNull()


def _compared(col: Column, field: Field, op: str, bound: Any) -> Column:
    if field.kind == "union":
        # across kinds by tag, booleans before numbers before texts
        tag, s, n, b = fact_value(bound)
        own, other = col["tag"], F.lit(tag)
        inner = _compared(col[{"s": "s", "n": "n", "b": "b"}[tag]], Field({"s": "string", "n": "number", "b": "boolean"}[tag]), op, bound)
        return F.when(own == other, inner).otherwise(own > other if op in ("gt", "gte") else own < other)
    value = F.lit(bound)
    return {"gt": col > value, "gte": col >= value, "lt": col < value, "lte": col <= value}[op]


def condition(schema: Schema, entity: str, constraints: tuple[Constraint, ...], column=F.col) -> Column:
    """The conjunction of constraints, null-safe: each term is true or false."""
    terms = []
    for c in constraints:
        field = schema.entities[entity].get(c.field) if c.field else None
        col = column(c.field) if c.field else None
        if c.kind == "id":
            term = column("id") == c.value
        elif c.kind == "either":
            term = reduce(or_, [condition(schema, entity, b, column) for b in c.branches])
        elif c.kind in ("eq", "in"):
            term = F.coalesce(_holds(col, field, c.value if c.kind == "in" else (c.value,)), F.lit(False))
        elif c.kind == "not":
            term = ~F.coalesce(_holds(col, field, c.value), F.lit(False))
        elif c.kind == "absent":
            term = _absent(col, field)
        else:
            term = F.coalesce(reduce(and_, [_compared(col, field, op, v) for op, v in c.value]), F.lit(False))
        terms.append(term)
    return reduce(and_, terms) if terms else F.lit(True)


def _plain(constraints: tuple[Constraint, ...], schema: Schema, entity: str) -> list[Column]:
    """Positive constraints as bare comparisons, the form that scans take."""
    out = []
    for c in constraints:
        if c.kind == "id":
            out.append(F.col("id") == c.value)
        elif c.kind in ("eq", "in", "range"):
            field, col = schema.field(entity, c.field), F.col(c.field)
            if c.kind == "range":
                out += [_compared(col, field, op, v) for op, v in c.value]
            else:
                out.append(_holds(col, field, c.value if c.kind == "in" else (c.value,)))
        elif c.kind == "either" and all(_plain(b, schema, entity) and all(x.kind not in ("not", "absent") for x in b) for b in c.branches):
            out.append(reduce(or_, [reduce(and_, _plain(b, schema, entity)) for b in c.branches]))
    return out


def _keys(constraints: tuple[Constraint, ...], schema: Schema, entity: str) -> dict[str, list[str]]:
    """Ids that the subject or its single references must be among, for sources that store them in other forms."""
    out: dict[str, list[str]] = {}
    for c in constraints:
        if c.kind == "id":
            out["id"] = [c.value]
        elif c.kind in ("eq", "in") and (field := schema.field(entity, c.field)).kind == "ref" and not field.is_multiple:
            values = c.value if c.kind == "in" else (c.value,)
            if all(isinstance(v, str) for v in values):
                out[c.field] = list(values)
    return out


def order_columns(order: tuple[str, bool] | None, prefix: str = "") -> list[Column]:
    """The total order: missing values last both ways, ids break ties."""
    if not order:
        return [F.col(prefix + "id").asc()]
    col = F.col(prefix + order[0])
    return [col.desc_nulls_last() if order[1] else col.asc_nulls_last(), F.col(prefix + "id").asc()]


def past(order: tuple[str, bool] | None, value: Any, subject: str) -> Column:
    """Rows strictly after the cursor in the total order."""
    later = F.col("id") > subject
    if not order:
        return later
    col = F.col(order[0])
    if value is None:
        return col.isNull() & later
    ahead = col < F.lit(value) if order[1] else col > F.lit(value)
    return ahead | ((col == F.lit(value)) & later) | col.isNull()

#: Rows that a subquery may have which is the same for every parent.
ALONE = 10_000


class Planner:
    """Plans queries over raw wide frames by entity, masked for ``actor`` where a policy is given."""

    def __init__(self, schema: Schema, frames: Mapping[str, DataFrame], policy: Policy | None = None, actor: dict[str, Any] | None = None):
        self.schema, self.frames, self.policy, self.actor = schema, frames, policy, actor

    def masked(self, entity: str, given: DataFrame | None = None) -> DataFrame:
        raw = self.frames[entity] if given is None else given
        return raw if self.policy is None else self.policy.mask(self.schema, entity, raw, self.frames, self.actor)

    def _rooted(self, query: Query, constraints: tuple[Constraint, ...]) -> DataFrame:
        """Masked rows that are instances, pass the constraints and hold what is read of them."""
        raw = self.frames[query.entity]
        if hasattr(self.frames, "seek"):
            raw = self.frames.seek(query.entity, _keys(constraints, self.schema, query.entity))
        pushed = _plain(constraints, self.schema, query.entity)
        rows = self.masked(query.entity, raw.where(reduce(and_, pushed)) if pushed else raw)
        fields = self.schema.entities[query.entity]
        instance = [~_absent(F.col(f), fields[f]) for f in (fields if any(c.kind == "id" for c in constraints) else self.schema.instance_predicates(query.entity))]
        read = {*_constrained(constraints), *query.selection.fields, *(k for k, _ in query.selection.nested)}
        absent_ok = {c.field for c in constraints if c.kind == "absent"}
        whole = [F.col(f).isNotNull() for f in sorted(read) if fields[f].is_required and f not in absent_ok]
        return rows.where(condition(self.schema, query.entity, constraints) & reduce(or_, instance) & (reduce(and_, whole) if whole else F.lit(True)))

    def roots(self, query: Query) -> DataFrame:
        """The windowed root rows, all fields."""
        rows = self._rooted(query, query.constraints)
        if query.cursor:
            rows = rows.where(past(query.order, *query.cursor))
        if query.take is not None or query.order:
            rows = rows.orderBy(*order_columns(query.order))
        return rows if query.take is None else rows.limit(query.take)

    def run(self, query: Query) -> DataFrame:
        """The rows as selected: id, fields, nested rows as structs, lists as arrays."""
        return self._shaped(self.roots(query), query.entity, query.selection)

    def _shaped(self, rows: DataFrame, entity: str, selection: Selection) -> DataFrame:
        fields, out = self.schema.entities[entity], [F.col("id")]
        for name in selection.fields:
            field, col = fields[name], F.col(name)
            if field.kind == "ref":
                col = F.transform(col, lambda x: F.struct(x.alias("id"))) if field.is_multiple else F.when(col.isNotNull(), F.struct(col.alias("id")))
            out.append((F.coalesce(col, F.array()) if field.is_multiple else col).alias(name))
        for name, inner in selection.nested:
            rows = self._followed(rows, name, fields[name], inner)
            out.append(F.col(f"__{name}").alias(name))
        for key, query, handle in selection.queries:
            rows = self._nested(rows, key, query, handle)
            out.append(F.col(f"__{key}").alias(key))
        return rows.select(*out)

    def _followed(self, rows: DataFrame, name: str, field: Field, inner: Selection) -> DataFrame:
        """Left join to the masked target; a hidden or dangling target is still an id."""
        target = self._shaped(self.masked(field.points_to), field.points_to, inner)
        there = [c for c in target.columns if c != "id"]
        target = target.select(F.col("id").alias("__there"), *[F.col(c).alias(f"__there_{c}") for c in there])
        made = lambda key: F.struct(key.alias("id"), *[F.col(f"__there_{c}").alias(c) for c in there])
        if not field.is_multiple:
            joined = rows.join(target, F.col(name) == F.col("__there"), "left")
            return joined.withColumn(f"__{name}", F.when(F.col(name).isNotNull(), made(F.col(name)))).drop("__there", *[f"__there_{c}" for c in there])
        parts = rows.select(F.col("id").alias("__own"), F.explode(name).alias("__key")).join(target, F.col("__key") == F.col("__there"), "left")
        lists = parts.groupBy("__own").agg(F.sort_array(F.collect_list(made(F.col("__key")))).alias(f"__{name}"))
        joined = rows.join(lists, F.col("id") == F.col("__own"), "left").drop("__own")
        return joined.withColumn(f"__{name}", F.coalesce(F.col(f"__{name}"), F.array()))

    def followed_rows(self, rows: DataFrame, entity: str, name: str, inner: dict[str, Any]) -> DataFrame:
        """(id, target id, target fields) with a row for each reference, without making lists."""
        field = self.schema.field(entity, name)
        query = Query.of(self.schema, field.points_to).select(inner)
        target = self._shaped(self.masked(field.points_to), field.points_to, query.selection)
        key = F.explode_outer(name) if field.is_multiple else F.col(name)
        return rows.select("id", key.alias(name)).join(target.withColumnRenamed("id", "__there"), F.col(name) == F.col("__there"), "left").drop("__there")

    def _children(self, query: Query, handle: int) -> DataFrame | None:
        """Child rows with their parent's id as __parent, windowed for each parent; None if uncorrelated."""
        branches = _bound(query.constraints, handle)
        if branches == [((), query.constraints)]:
            return None
        parts = []
        for bound, rest in branches:
            if not bound:
                raise QueryError("every branch of either must name the parent, or none")
            rows = self._rooted(query, rest)
            for at, name in enumerate(bound):
                if name == "id":
                    key = F.col("id")
                else:
                    key = F.explode(name) if self.schema.field(query.entity, name).is_multiple else F.col(name)
                if at == 0:
                    rows = rows.withColumn("__parent", key)
                else:
                    rows = rows.where(F.array_contains(name, F.col("__parent")) if self.schema.field(query.entity, name).is_multiple else F.col(name) == F.col("__parent"))
            parts.append(rows.where(F.col("__parent").isNotNull()))
        rows = reduce(DataFrame.unionByName, parts)
        rows = rows.dropDuplicates(["__parent", "id"]) if len(parts) > 1 else rows
        if query.cursor:
            rows = rows.where(past(query.order, *query.cursor))
        if query.take is not None:
            rank = Window.partitionBy("__parent").orderBy(*order_columns(query.order))
            rows = rows.withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= query.take).drop("__rank")
        return rows

    def child_rows(self, query: Query, key: str) -> DataFrame:
        """(__parent, order value, child row) of a subquery as plain rows, for joins without lists."""
        inner, handle = next((q, h) for k, q, h in query.selection.queries if k == key)
        rows = self._children(inner, handle)
        if rows is None:
            raise QueryError(f"{key} does not name its parent")
        return self._with_shape(rows, inner)

    def _with_shape(self, rows: DataFrame, query: Query) -> DataFrame:
        """__parent and the shaped child columns; the order value is kept as __order."""
        keep = rows.select("__parent", F.col("id").alias("__kid"), (F.col(query.order[0]) if query.order else F.lit(None)).alias("__order"))
        if not query.selection.nested and not query.selection.queries:
            shaped = [F.col("id"), *[F.col(f) for f in query.selection.fields]]
            return rows.select("__parent", (F.col(query.order[0]) if query.order else F.lit(None)).alias("__order"), *shaped)
        shaped = self._shaped(rows.drop("__parent").dropDuplicates(["id"]), query.entity, query.selection)
        return keep.join(shaped, keep["__kid"] == shaped["id"]).drop("__kid")

    def _nested(self, rows: DataFrame, key: str, query: Query, handle: int) -> DataFrame:
        """Attaches an array of the subquery's rows to each parent; none is an empty array."""
        children = self._children(query, handle)
        if children is None:
            alone = self.run(query)
            if (query.take is None or query.take > ALONE) and alone.select("id").limit(ALONE + 1).count() > ALONE:
                raise QueryError(f"{key} does not name its parent and has over {ALONE} rows; give it a limit")
            one = alone.agg(F.collect_list(F.struct(*alone.columns)).alias(f"__{key}"))
            # one row: the uncorrelated answer, attached to every parent
            return rows.crossJoin(F.broadcast(one))
        shaped = self._with_shape(children, query)
        names = [c for c in shaped.columns if c not in ("__parent", "__order")]
        item = F.struct(F.col("__order").isNull().alias("missing"), F.col("__order").alias("value"), F.col("id").alias("key"), F.struct(*names).alias("row"))
        lists = shaped.groupBy("__parent").agg(F.collect_list(item).alias("items"))
        down = bool(query.order and query.order[1])

        def compare(x: Column, y: Column) -> Column:
            less = (x["value"] > y["value"]) if down else (x["value"] < y["value"])
            more = (x["value"] < y["value"]) if down else (x["value"] > y["value"])
            by_id = F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)
            return F.when(x["missing"] & ~y["missing"], 1).when(~x["missing"] & y["missing"], -1).when(less, -1).when(more, 1).otherwise(by_id)

        lists = lists.select("__parent", F.transform(F.array_sort("items", compare), lambda x: x["row"]).alias(f"__{key}"))
        joined = rows.join(lists, F.col("id") == F.col("__parent"), "left").drop("__parent")
        return joined.withColumn(f"__{key}", F.coalesce(F.col(f"__{key}"), F.array()))

    def joined(self, query: Query, key: str, outer: bool = True) -> DataFrame:
        """Roots with the rows of one subquery as plain rows: parent id as ``id``, child columns as they are."""
        children = self.child_rows(query, key).drop("__order")
        kids = children.select("__parent", *[F.col(c).alias(f"{key}_{c}") for c in children.columns if c != "__parent"])
        parents = self.roots(query).select("id")
        return parents.join(kids, F.col("id") == F.col("__parent"), "left" if outer else "inner").drop("__parent")

    def cursor_of(self, query: Query) -> tuple[Any, str] | None:
        """(order value, id) of the last row of the window, whether or not it is selected."""
        col = F.col(query.order[0]) if query.order else F.lit(None)
        if not query.take:
            return None
        rows = self.roots(query).select(col.alias("v"), "id").offset(query.take - 1).limit(1).collect()
        return (rows[0].v, rows[0].id) if rows else None

    def payload_facts(self, query: Query) -> DataFrame:
        """The facts a cache needs to answer the query: subject, predicate, value as text, without repeats.

        These are what the roots are found, ordered and selected by, the same for the rows that the
        selection follows or nests, and evidence for negations: all values of a negated field, for
        every subject that holds the constraints named before it.
        """

        def reached(constraints: tuple[Constraint, ...]) -> DataFrame:
            return self._rooted(replace(query, constraints=constraints, selection=Selection()), constraints)

        parts = self._payload(query, query.constraints, self.roots(query), reached)
        return reduce(DataFrame.unionByName, parts).distinct()

    def _payload(self, query: Query, constraints: tuple[Constraint, ...], rows: DataFrame, reached: Callable[[tuple[Constraint, ...]], DataFrame]) -> list[DataFrame]:
        """Fact frames of a query's windowed rows; ``constraints`` are those not bound to a parent."""
        entity, fields = query.entity, self.schema.entities[query.entity]
        names = {*([query.order[0]] if query.order else [])}
        if not constraints or constraints[0].kind in ("not", "absent"):
            names |= set(self.schema.instance_predicates(entity))
        held: dict[str, list[Column]] = {}
        for c in _positive(constraints):
            if fields[c.field].is_multiple:
                held.setdefault(c.field, []).extend(_value(v, fields[c.field]) for v in (c.value if c.kind == "in" else (c.value,)))
            else:
                names.add(c.field)
        parts = [facts_as_text(self.schema, entity, rows, sorted(names))] if names else []
        if held:
            # of a list, the elements that the constraints name
            some = rows.select("id", *[F.array_intersect(n, F.array(*v)).alias(n) for n, v in held.items()])
            parts.append(facts_as_text(self.schema, entity, some, sorted(held)))
        for at, c in enumerate(constraints):
            if negated := sorted(_negated((c,))):
                parts.append(facts_as_text(self.schema, entity, reached(constraints[:at]), negated))
        return parts + self._selected_facts(rows, entity, query.selection)

    def _selected_facts(self, rows: DataFrame, entity: str, selection: Selection) -> list[DataFrame]:
        fields, parts = self.schema.entities[entity], []
        if names := sorted({*selection.fields, *(k for k, _ in selection.nested)}):
            parts.append(facts_as_text(self.schema, entity, rows, names))
        for name, inner in selection.nested:
            target = fields[name].points_to
            ids = rows.select((F.explode(name) if fields[name].is_multiple else F.col(name)).alias("__to")).distinct()
            there = self.masked(target)
            parts += self._selected_facts(there.join(ids, there["id"] == ids["__to"], "left_semi"), target, inner)
        for _, query, handle in selection.queries:
            children = self._children(query, handle)
            if children is None:
                parts.append(self.payload_facts(query))
                continue
            parents = rows.select(F.col("id").alias("__attach")).distinct()
            mine = children.join(parents, F.col("__parent") == F.col("__attach"), "left_semi")
            for bound, rest in _bound(query.constraints, handle):

                def reached(constraints: tuple[Constraint, ...], bound=bound, query=query, handle=handle, parents=parents) -> DataFrame:
                    named = tuple(Constraint("eq", b, Row(handle)) for b in bound)
                    found = self._children(replace(query, constraints=(*named, *constraints), selection=Selection(), order=None, take=None, cursor=None), handle)
                    return found.join(parents, F.col("__parent") == F.col("__attach"), "left_semi")

                own = mine.where(condition(self.schema, query.entity, rest))
                for name in bound:
                    if name != "id":
                        many = self.schema.field(query.entity, name).is_multiple
                        links = own.select("id", (F.array_intersect(name, F.array("__parent")) if many else F.col(name)).alias(name))
                        parts.append(facts_as_text(self.schema, query.entity, links, [name]))
                parts += self._payload(query, rest or (Constraint("id"),), own, reached)
        return parts


def _positive(constraints: tuple[Constraint, ...]) -> list[Constraint]:
    """Positive constraints on fields, those of branches too."""
    inner = [x for c in constraints if c.kind == "either" for b in c.branches for x in _positive(b)]
    return [c for c in constraints if c.kind in ("eq", "in", "range")] + inner


def _negated(constraints: tuple[Constraint, ...]) -> set[str]:
    return {c.field for c in constraints if c.kind in ("not", "absent")}.union(*[_negated(b) for c in constraints for b in c.branches])


def _named(predicate: str, value: Column) -> Column:
    return F.struct(F.lit(predicate).alias("predicate"), value.alias("value"))


def facts_as_text(schema: Schema, entity: str, rows: DataFrame, names: list[str]) -> DataFrame:
    """Wide rows as (subject, predicate, value) for the named fields, one pass over the rows, repeats left in."""
    fields = schema.entities[entity]
    texts = [F.transform(F.col(n), lambda x: x.cast("string")) if fields[n].is_multiple else F.array_compact(F.array(F.to_json(n) if fields[n].kind in ("object", "union") else F.col(n).cast("string"))) for n in names]
    parts = F.flatten(F.array(*[F.transform(t, partial(_named, f"{entity}/{n}")) for n, t in zip(names, texts, strict=True)]))
    return rows.select(F.col("id").alias("subject"), F.explode(parts).alias("f")).select("subject", "f.predicate", "f.value")


def _bound(constraints: tuple[Constraint, ...], handle: int) -> list[tuple[tuple[str, ...], tuple[Constraint, ...]]]:
    """Alternatives of (fields equal to the parent, other constraints)."""
    out: list[tuple[tuple[str, ...], tuple[Constraint, ...]]] = [((), ())]
    for c in constraints:
        if isinstance(c.value, Row) and c.kind == "eq":
            out = [((*b, c.field), r) for b, r in out]
        elif c.kind == "either" and any(_mentions(b) for b in c.branches):
            inner = [x for branch in c.branches for x in _bound(branch, handle)]
            out = [((*b, *b2), (*r, *r2)) for b, r in out for b2, r2 in inner]
        elif isinstance(c.value, tuple) and any(isinstance(v, Row) for v in c.value):
            raise QueryError("a parent row stands alone as a value")
        else:
            out = [(b, (*r, c)) for b, r in out]
    return out


def _mentions(constraints: tuple[Constraint, ...]) -> bool:
    return any(isinstance(c.value, Row) or any(_mentions(b) for b in c.branches) for c in constraints)
