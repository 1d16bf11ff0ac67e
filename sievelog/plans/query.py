"""The query builder: an immutable chain of constraints, an order, a window and a selection tree."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

from sievelog.functions.values import predicate_of, ref_id
from sievelog.sources.schema import Schema, SchemaError, check_id

_handles = itertools.count(1)
RANGES = ("gt", "gte", "lt", "lte")


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Row:
    """Stands for the parent row inside a selection's subquery."""

    handle: int


@dataclass(frozen=True)
class Constraint:
    kind: str
    field: str | None = None
    value: Any = None
    branches: tuple[tuple[Constraint, ...], ...] = ()


@dataclass(frozen=True)
class Selection:
    """Own fields, nested selections by reference field, and subqueries by result key."""

    fields: tuple[str, ...] = ()
    nested: tuple[tuple[str, Selection], ...] = ()
    queries: tuple[tuple[str, Query, int], ...] = ()


@dataclass(frozen=True)
class Query:
    schema: Schema
    entity: str
    constraints: tuple[Constraint, ...] = ()
    order: tuple[str, bool] | None = None
    take: int | None = None
    cursor: tuple[Any, str] | None = None
    selection: Selection = field(default_factory=Selection)

    @staticmethod
    def of(schema: Schema, entity: str) -> Query:
        if entity not in schema.entities:
            raise QueryError(f"unknown entity {entity}")
        return Query(schema, entity)

    def _field(self, name: str):
        try:
            return self.schema.field(self.entity, name)
        except SchemaError as e:
            raise QueryError(str(e)) from None

    def _with(self, kind: str, name: str, value: Any = None) -> Query:
        self._field(name)
        return replace(self, constraints=(*self.constraints, Constraint(kind, name, value)))

    def where(self, name: str, value: Any) -> Query:
        """The field holds the value, or any value of a list."""
        if isinstance(value, (list, tuple, set)):
            return self._with("in", name, tuple(ref_id(v) for v in value))
        return self._with("eq", name, ref_id(value))

    def where_not(self, name: str, value: Any) -> Query:
        """Drops subjects that hold the value or any of a list; absent ones pass."""
        values = value if isinstance(value, (list, tuple, set)) else [value]
        return self._with("not", name, tuple(ref_id(v) for v in values))

    def where_absent(self, name: str) -> Query:
        return self._with("absent", name)

    def _range(self, name: str, **bounds: Any) -> Query:
        if not self._field(name).ordered:
            raise QueryError(f"{self.entity}/{name} has no ranges")
        return self._with("range", name, tuple(bounds.items()))

    def where_greater(self, name: str, value: Any) -> Query:
        return self._range(name, gt=value)

    def where_greater_or_equal(self, name: str, value: Any) -> Query:
        return self._range(name, gte=value)

    def where_lesser(self, name: str, value: Any) -> Query:
        return self._range(name, lt=value)

    def where_lesser_or_equal(self, name: str, value: Any) -> Query:
        return self._range(name, lte=value)

    def where_between(self, name: str, low: Any, high: Any) -> Query:
        return self._range(name, gte=low, lte=high)

    def where_either(self, *branches: Callable[[Query], Query]) -> Query:
        if len(branches) < 2:
            raise QueryError("either needs two branches")
        made = []
        for branch in branches:
            part = branch(Query.of(self.schema, self.entity))
            if not part.constraints or part.order or part.take is not None or part.cursor or part.selection != Selection():
                raise QueryError("a branch holds constraints only, at least one")
            made.append(part.constraints)
        return replace(self, constraints=(*self.constraints, Constraint("either", branches=tuple(made))))

    def where_id(self, subject: str) -> Query:
        try:
            check_id(self.schema, self.entity, subject)
        except SchemaError as e:
            raise QueryError(str(e)) from None
        return replace(self, constraints=(*self.constraints, Constraint("id", value=subject)))

    def order_by(self, name: str, direction: str = "asc") -> Query:
        if not self._field(name).ordered:
            raise QueryError(f"{self.entity}/{name} has no order")
        if direction not in ("asc", "desc"):
            raise QueryError("a direction is asc or desc")
        return replace(self, order=(name, direction == "desc"))

    def limit(self, n: int) -> Query:
        if not isinstance(n, int) or n < 0:
            raise QueryError("a limit is a whole number")
        return replace(self, take=n)

    def after(self, value: Any, subject: str) -> Query:
        """Rows strictly after (value, id) in the total order; a value of None is the missing zone."""
        return replace(self, cursor=(value, subject))

    def select(self, selection: dict[str, Any] | Callable[[Row], dict[str, Any]]) -> Query:
        return replace(self, selection=self._selected(self.entity, selection, ()))

    def _selected(self, entity: str, tree: Any, outer: tuple[int, ...]) -> Selection:
        handle = next(_handles)
        tree = tree(Row(handle)) if callable(tree) else tree
        fields, nested, queries = [], [], []
        for key, value in tree.items():
            if key == "id":
                continue
            if isinstance(value, Query):
                foreign = set(_handles_in(value)) - {handle}
                if foreign:
                    raise QueryError(f"{key}: a row of another selection is used here")
                queries.append((key, value, handle))
                continue
            try:
                known = self.schema.field(entity, key)
            except SchemaError as e:
                raise QueryError(str(e)) from None
            if value is True:
                fields.append(key)
            elif isinstance(value, dict) or callable(value):
                if known.kind != "ref":
                    raise QueryError(f"{entity}/{key} is no reference")
                nested.append((key, self._selected(known.points_to, value, (*outer, handle))))
            else:
                raise QueryError(f"{key}: True, a selection or a query")
        return Selection(tuple(fields), tuple(nested), tuple(queries))

    @property
    def predicates(self) -> set[str]:
        """Every predicate that can change the answer, the order's included."""
        out = {predicate_of(self.entity, f) for f in _constrained(self.constraints)}
        out |= {predicate_of(self.entity, f) for f in self.schema.instance_predicates(self.entity)}
        if self.order:
            out.add(predicate_of(self.entity, self.order[0]))
        return out | set(_selected_predicates(self.schema, self.entity, self.selection))


def _constrained(constraints: tuple[Constraint, ...]) -> Iterator[str]:
    for c in constraints:
        if c.field:
            yield c.field
        for b in c.branches:
            yield from _constrained(b)


def _handles_in(query: Query) -> Iterator[int]:
    def walk(constraints: tuple[Constraint, ...]) -> Iterator[int]:
        for c in constraints:
            values = c.value if isinstance(c.value, tuple) else (c.value,)
            yield from (v.handle for v in values if isinstance(v, Row))
            for b in c.branches:
                yield from walk(b)

    yield from walk(query.constraints)


def _selected_predicates(schema: Schema, entity: str, selection: Selection) -> Iterator[str]:
    yield from (predicate_of(entity, f) for f in selection.fields)
    for key, inner in selection.nested:
        yield predicate_of(entity, key)
        yield from _selected_predicates(schema, schema.field(entity, key).points_to, inner)
    for _, query, _ in selection.queries:
        yield from query.predicates


def from_data(schema: Schema, data: dict[str, Any]) -> Query:
    """A query as plain data: entity, where (equality or any of), select (all fields by default)."""
    query = Query.of(schema, data["entity"])
    for name, value in (data.get("where") or {}).items():
        query = query.where(name, value)
    return query.select(data.get("select") or dict.fromkeys(schema.entities[data["entity"]], True))
