"""Typed schemas: field builders, entities, declarations as data, generations, migration checks."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import types as T

from sievelog.functions.values import canonical_json, entity_of_id, is_ref

_NAME = re.compile(r"[a-z][A-Za-z0-9]*")
SCALARS = {"string": T.StringType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
TAGGED = T.StructType([T.StructField("tag", T.StringType()), T.StructField("s", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("b", T.BooleanType())])


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    kind: str
    target: str | Callable[[], str] | None = None
    values: tuple[str, ...] = ()
    shape: tuple[tuple[str, Field], ...] = ()
    members: tuple[Field, ...] = ()
    is_multiple: bool = False
    is_optional: bool = False

    def multiple(self) -> Field:
        if self.kind == "object" and any(f.is_multiple for _, f in self.shape):
            raise SchemaError("objects hold no lists")
        return replace(self, is_multiple=True)

    def optional(self) -> Field:
        return replace(self, is_optional=True)

    @property
    def points_to(self) -> str | None:
        return self.target() if callable(self.target) else self.target

    @property
    def is_required(self) -> bool:
        return not self.is_optional and not self.is_multiple

    @property
    def ordered(self) -> bool:
        """Whether ranges and orderings apply: one scalar value."""
        return not self.is_multiple and self.kind in (*SCALARS, "oneOf", "union")

    def spark_type(self) -> T.DataType:
        one = SCALARS.get(self.kind) or {"ref": T.StringType(), "oneOf": T.StringType(), "union": TAGGED}.get(self.kind)
        one = one or T.StructType([T.StructField(n, f.spark_type()) for n, f in self.shape])
        return T.ArrayType(one, False) if self.is_multiple else one


def string() -> Field:
    return Field("string")


def number() -> Field:
    return Field("number")


def boolean() -> Field:
    return Field("boolean")


def ref(target: str | Callable[[], str]) -> Field:
    return Field("ref", target=target)


def one_of(*values: str) -> Field:
    if not values or len(set(values)) != len(values):
        raise SchemaError("oneOf needs distinct values")
    return Field("oneOf", values=values)


def obj(shape: dict[str, Field]) -> Field:
    if not shape or any(f.kind == "ref" or f.is_multiple for f in shape.values()):
        raise SchemaError("objects hold fields without references or lists")
    return Field("object", shape=tuple(shape.items()))


def union(*members: Field) -> Field:
    if len(members) < 2 or any(m.kind not in SCALARS for m in members):
        raise SchemaError("a union joins two or more scalars")
    return Field("union", members=members)


class Schema:
    """Entities by name; the flat map of predicates is what the rest works with."""

    def __init__(self, entities: dict[str, dict[str, Field]]):
        for name, fields in entities.items():
            for what in (name, *fields):
                if not _NAME.fullmatch(what) or (what == "id" and what != name):
                    raise SchemaError(f"not a usable name: {what}")
            for key, field in fields.items():
                if not isinstance(field, Field):
                    raise SchemaError(f"{name}/{key} is not a field")
        seen: dict[int, str] = {}
        for name, fields in entities.items():
            if seen.setdefault(id(fields), name) != name:
                raise SchemaError("one entity cannot have two names")
        self.entities = {n: dict(f) for n, f in entities.items()}
        for name, fields in self.entities.items():
            for key, field in fields.items():
                if field.kind == "ref" and field.points_to not in self.entities:
                    raise SchemaError(f"{name}/{key} points to the unknown entity {field.points_to}")

    def field(self, entity: str, name: str) -> Field:
        try:
            return self.entities[entity][name]
        except KeyError:
            raise SchemaError(f"unknown field {entity}/{name}") from None

    @property
    def predicates(self) -> dict[str, Field]:
        return {f"{e}/{k}": f for e, fields in self.entities.items() for k, f in fields.items()}

    def instance_predicates(self, entity: str) -> list[str]:
        """The first required single field, else every field: what makes a subject an instance."""
        fields = self.entities[entity]
        first = next((k for k, f in fields.items() if f.is_required), None)
        return [first] if first else list(fields)

    def struct_type(self, entity: str) -> T.StructType:
        return T.StructType([T.StructField("id", T.StringType()), *(T.StructField(k, f.spark_type()) for k, f in self.entities[entity].items())])

    @property
    def generation(self) -> str:
        """A stable 32-bit hash of everything that matters to a reader, whatever the order."""
        state = 0x811C9DC5
        for byte in canonical_json(declaration_of(self, unions=True)).encode():
            state = ((state ^ byte) * 0x01000193) & 0xFFFFFFFF
        return f"{state:08x}"


def check_id(schema: Schema, entity: str, subject: str) -> None:
    if entity_of_id(subject) != entity or entity not in schema.entities:
        raise SchemaError(f"{subject} is no id of {entity}")


def value_problem(field: Field, value: Any) -> str | None:
    """Why one value does not fit, or None."""
    if field.kind == "number":
        return None if isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) else "not a finite number"
    if field.kind == "string":
        return None if isinstance(value, str) else "not a string"
    if field.kind == "boolean":
        return None if isinstance(value, bool) else "not a boolean"
    if field.kind == "oneOf":
        return None if value in field.values else f"not one of {', '.join(field.values)}"
    if field.kind == "ref":
        return None if is_ref(value) else "not a reference"
    if field.kind == "union":
        return None if any(value_problem(m, value) is None for m in field.members) else "fits no member"
    if not isinstance(value, dict):
        return "not an object"
    shape = dict(field.shape)
    if extra := set(value) - set(shape):
        return f"unknown member {sorted(extra)[0]}"
    for name, member in shape.items():
        if value.get(name) is None:
            if not member.is_optional:
                return f"missing member {name}"
        elif problem := value_problem(member, value[name]):
            return f"{name}: {problem}"
    return None


# Declarations: schemas as JSON data.

_KEYS = {"type", "entity", "values", "fields", "members", "multiple", "optional"}


def _declared(where: str, spec: Any) -> Field:
    spec = {"type": spec} if isinstance(spec, str) else spec
    if not isinstance(spec, dict) or not isinstance(spec.get("type"), str):
        raise SchemaError(f"{where}: a field is a type name or an object with a type")
    if extra := set(spec) - _KEYS:
        raise SchemaError(f"{where}: unknown key {sorted(extra)[0]}")
    kind = spec["type"]
    try:
        if kind in SCALARS:
            out = Field(kind)
        elif kind == "ref":
            if not isinstance(spec.get("entity"), str):
                raise SchemaError("a ref names its entity")
            out = ref(spec["entity"])
        elif kind == "oneOf":
            out = one_of(*spec.get("values", ()))
        elif kind == "object":
            out = obj({k: _declared(f"{where}.{k}", v) for k, v in (spec.get("fields") or {}).items()})
        else:
            raise SchemaError(f"unknown type {kind}")
    except SchemaError as e:
        raise e if str(e).startswith(where) else SchemaError(f"{where}: {e}") from None
    out = out.multiple() if spec.get("multiple") else out
    return out.optional() if spec.get("optional") else out


def from_declaration(declaration: dict[str, Any], base: dict[str, dict[str, Field]] | None = None) -> Schema:
    """Entities of a declaration beside fixed ones; references may be mutual."""
    base = base or {}
    entities = dict(base)
    for name, spec in declaration.items():
        if name in base:
            raise SchemaError(f"{name}: a fixed entity cannot be declared again")
        if not isinstance(spec, dict):
            raise SchemaError(f"{name}: an entity is an object of fields")
        entities[name] = {k: _declared(f"{name}/{k}", v) for k, v in spec.items()}
    return Schema(entities)


def _spec(field: Field, unions: bool) -> Any:
    out: dict[str, Any] = {"type": field.kind}
    if field.kind == "union":
        if not unions:
            raise SchemaError("a union has no declaration form")
        out["members"] = [m.kind for m in field.members]
    if field.kind == "ref":
        out["entity"] = field.points_to
    if field.kind == "oneOf":
        out["values"] = sorted(field.values) if unions else list(field.values)
    if field.kind == "object":
        out["fields"] = {k: _spec(f, unions) for k, f in field.shape}
    if field.is_multiple:
        out["multiple"] = True
    if field.is_optional:
        out["optional"] = True
    return out


def declaration_of(schema: Schema, unions: bool = False) -> dict[str, Any]:
    return {e: {k: _spec(f, unions) for k, f in fields.items()} for e, fields in schema.entities.items()}


def migration_problems(before: Schema, after: Schema, has_rows: Callable[[str], bool]) -> list[str]:
    """Refusals of a schema change: kinds and cardinalities stay, new required fields need an empty entity."""
    out = []
    for entity, fields in after.entities.items():
        old = before.entities.get(entity, {})
        for name, field in fields.items():
            was = old.get(name)
            if was is None:
                if field.is_required and entity in before.entities and has_rows(entity):
                    out.append(f"{entity}/{name}: a new required field on an entity with rows")
            elif _spec(replace(was, is_optional=False, is_multiple=False), True) != _spec(replace(field, is_optional=False, is_multiple=False), True):
                out.append(f"{entity}/{name}: its type changed")
            elif was.is_multiple != field.is_multiple:
                out.append(f"{entity}/{name}: its cardinality changed")
            elif was.is_optional and field.is_required:
                out.append(f"{entity}/{name}: optional became required")
    return out
