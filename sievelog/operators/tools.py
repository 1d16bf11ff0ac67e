"""Operations by name over a workspace: reads, schema changes, and apps with drafts and releases."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import functions as F

from sievelog.functions.values import content_type
from sievelog.operators.facts import match
from sievelog.operators.policy import compile_policy
from sievelog.operators.writes import Engine, Operation, Rejected, new_id
from sievelog.plans.query import Query, from_data
from sievelog.sources.schema import Field, declaration_of, from_declaration, migration_problems, number, one_of, ref, string

_EMAIL = re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]+")
_PATH = re.compile(r"[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*")

#: Entities that every workspace has.
FIXED: dict[str, dict[str, Field]] = {
    "user": {"name": string(), "role": one_of("admin", "member", "appUser"), "email": string().optional()},
    "app": {"name": string(), "live": ref("release").optional(), "audience": one_of("members", "invited", "public"), "invited": string().multiple()},
    "release": {"app": ref("app"), "version": number(), "schemaGeneration": string(), "publishedBy": ref("user"), "publishedAt": number()},
    "draftFile": {"app": ref("app"), "path": string(), "content": string()},
    "releaseFile": {"release": ref("release"), "path": string(), "content": string()},
}

_STAFF = {"in": ["actor.role", [{"literal": "admin"}, {"literal": "member"}]]}

_SELF = {"equals": ["subject", "actor"]}


def _audience(path: str) -> dict[str, Any]:
    """Admins always; others as the app's audience says: members, the invited, or anyone. ``path`` leads to the app."""
    at = lambda f: f"fields.{path}{f}"
    open_to = lambda who, rule: {"allOf": [{"equals": [at("audience"), {"literal": who}]}, rule]}
    admin = {"equals": ["actor.role", {"literal": "admin"}]}
    return {"anyOf": [admin, open_to("members", _STAFF), open_to("invited", {"in": ["actor.email", at("invited")]}), open_to("public", True)]}


FIXED_RULES: dict[str, Any] = {
    "user": {"read": {"anyOf": [_STAFF, _SELF]}, "create": _SELF, "update": _SELF, "delete": _SELF, "fields": {"role": {"write": False}}},
    "app": {"read": _audience(""), "create": _STAFF, "update": _STAFF, "delete": _STAFF},
    "release": {"read": _audience("app."), "create": _STAFF, "update": False, "delete": _STAFF},
    "draftFile": {"read": _STAFF, "create": _STAFF, "update": _STAFF, "delete": _STAFF},
    "releaseFile": {"read": _audience("release.app."), "create": _STAFF, "update": False, "delete": _STAFF},
}


def build_workspace(declaration: dict[str, Any], rules: dict[str, Any]):
    """(schema, policy) of the fixed and the declared entities."""
    schema = from_declaration(declaration, FIXED)
    return schema, compile_policy(schema, FIXED_RULES | rules)


class Tools:
    """``call(name, arguments)`` as one actor."""

    def __init__(self, engine: Engine, actor: str):
        self.engine, self.actor = engine, actor

    def call(self, name: str, arguments: dict[str, Any] | None = None) -> Any:
        if name.startswith("_") or name == "call" or not callable(getattr(type(self), name, None)):
            raise Rejected(f"unknown tool {name}")
        return getattr(self, name)(**(arguments or {}))

    def _planner(self):
        facts = self.engine.store.facts()
        return self.engine.planner(self.engine.actor_record(self.actor, facts), facts)

    def query(self, entity: str, where: dict[str, Any] | None = None, select: dict[str, Any] | None = None):
        return self._planner().run(from_data(self.engine.schema, {"entity": entity, "where": where, "select": select}))

    def describe(self) -> dict[str, Any]:
        return {"entities": declaration_of(self.engine.schema, unions=True), "generation": self.engine.schema.generation, "rules": "equals, in, anyOf, allOf, not over actor, subject, fields and after"}

    def set_schema(self, declaration: dict[str, Any], rules: dict[str, Any]) -> str:
        """Admins only; refuses what would break stored rows or readers."""
        if self.engine.actor_record(self.actor, self.engine.store.facts()).get("role") != "admin":
            raise Rejected("only an admin changes the schema")
        schema, policy = build_workspace(declaration, rules)
        facts = self.engine.store.facts()
        problems = migration_problems(self.engine.schema, schema, lambda e: not facts.where(F.col("predicate").startswith(f"{e}/")).isEmpty())
        if problems:
            raise Rejected("; ".join(problems))
        self.engine.reload(schema, policy)
        return schema.generation

    # Reads of the operator, unfiltered.

    def info(self) -> dict[str, Any]:
        return self.engine.store.info()

    def triples(self, limit: int = 100):
        return self.engine.store.facts().orderBy("subject", "predicate").limit(limit)

    def find(self, **pattern: Any):
        return match(self.engine.store.facts(), **pattern)

    def log(self, since: int = 0):
        return self.engine.store.entries_since(since)

    # Apps.

    def create_app(self, name: str, audience: str = "members") -> str:
        app = new_id("app")
        ops = [Operation("set", app, "name", name), Operation("set", app, "audience", audience)]
        own = self.engine.actor_record(self.actor, self.engine.store.facts()).get("email")
        if audience == "invited" and own:
            # who makes an app for invited people is the first of them
            ops.append(Operation("add", app, "invited", own))
        self.engine.transact(ops, self.actor)
        return app

    def _rows(self, entity: str, **where: Any) -> list:
        return self.query(entity, where).collect()

    def write_file(self, app: str, path: str, content: str) -> None:
        if not _PATH.fullmatch(path) or ".." in path:
            raise Rejected(f"not a usable path: {path}")
        old = self._rows("draftFile", app=app, path=path)
        subject = old[0].id if old else new_id("draftFile")
        self.engine.transact([Operation("set", subject, "app", {"id": app}), Operation("set", subject, "path", path), Operation("set", subject, "content", content)], self.actor)

    def read_file(self, app: str, path: str = "index.html", channel: str = "live") -> tuple[str, str] | None:
        """(content, media type) of a file; the index stands in for paths that don't exist."""
        wanted = [path, "index.html"]
        if channel == "draft":
            files = self._rows("draftFile", app=app, path=wanted)
        else:
            rows = self._planner().run(Query.of(self.engine.schema, "app").where_id(app).select({"live": True})).collect()
            live = rows[0].live if rows else None
            files = self._rows("releaseFile", release=live["id"], path=wanted) if live else []
        by = {f.path: f.content for f in files}
        found = path if path in by else "index.html"
        return (by[found], content_type(found)) if found in by else None

    def publish(self, app: str, at: float) -> str:
        """A release of the drafts, its version one more than the last, made live."""
        past = self._rows("release", app=app)
        release, version = new_id("release"), max([0, *(int(r.version) for r in past)]) + 1
        made = {"app": {"id": app}, "version": version, "schemaGeneration": self.engine.schema.generation, "publishedBy": {"id": self.actor}, "publishedAt": at}
        ops = [Operation("set", release, k, v) for k, v in made.items()]
        for f in self._rows("draftFile", app=app):
            copy = new_id("releaseFile")
            ops += [Operation("set", copy, "release", {"id": release}), Operation("set", copy, "path", f.path), Operation("set", copy, "content", f.content)]
        self.engine.transact([*ops, Operation("set", app, "live", {"id": release})], self.actor)
        return release

    def rollback(self, app: str, version: int) -> str:
        release = next((r.id for r in self._rows("release", app=app) if r.version == version), None)
        if release is None:
            raise Rejected(f"no release {version}")
        self.engine.transact([Operation("set", app, "live", {"id": release})], self.actor)
        return release

    def unpublish(self, app: str) -> None:
        self.engine.transact([Operation("set", app, "live", None)], self.actor)

    def set_audience(self, app: str, audience: str) -> None:
        self.engine.transact([Operation("set", app, "audience", audience)], self.actor)

    def invite(self, app: str, email: str) -> None:
        if not _EMAIL.fullmatch(email):
            raise Rejected(f"not an address: {email}")
        self.engine.transact([Operation("add", app, "invited", email)], self.actor)

    def delete_app(self, app: str) -> None:
        releases = [r.id for r in self._rows("release", app=app)]
        files = [f.id for r in releases for f in self._rows("releaseFile", release=r)] + [f.id for f in self._rows("draftFile", app=app)]
        self.engine.transact([Operation("delete", x) for x in (*files, *releases, app)], self.actor)

    def list_apps(self):
        return self._planner().run(Query.of(self.engine.schema, "app").select({"name": True, "audience": True, "live": True}))


__all__ = ["FIXED", "FIXED_RULES", "Tools", "build_workspace"]
