"""Reads by name, apps, rules as data, live queries, streams of changes and pending writes."""

import pytest
from pyspark.sql import functions as F

from sievelog.functions.values import Ref
from sievelog.operators import facts as ops
from sievelog.operators.policy import EntityPolicy, Policy, anyone, compile_rule
from sievelog.operators.tools import Tools, build_workspace
from sievelog.operators.writes import Engine, Operation, Rejected, compile_bulk
from sievelog.plans.query import Query
from sievelog.sources.schema import Schema, SchemaError, boolean, ref, string
from sievelog.sources.warehouse import Conflict, Warehouse
from sievelog.streaming.live import LiveQuery, Outbox, Presence, Status, broadcast_visible, envelopes, fan_out, optimistic, repair, subscribe

SCHEMA = Schema({"user": {"name": string()}, "todo": {"text": string(), "done": boolean(), "owner": ref("user"), "tags": string().multiple()}})


def own(c):
    return c["owner"] == c.actor("id")


OWN = Policy(SCHEMA, {"user": EntityPolicy(read=anyone), "todo": EntityPolicy(read=own, create=own, update=own, delete=own)})
TODO = "id string, text string, done boolean, owner string, tags array<string>"


def todos(spark, *rows):
    return spark.createDataFrame([(i, t, d, o, g) for i, t, d, o, g in rows], TODO)


def test_fan_out_to_a_table_of_readers(spark):
    before = {"todo": todos(spark, ("todo_1", "x", False, "user_a", ["p"]), ("todo_2", "y", False, "user_b", []))}
    after = {"todo": todos(spark, ("todo_1", "x", True, "user_a", ["p"]), ("todo_2", "y", False, "user_a", []))}
    readers = spark.createDataFrame([("user_a",), ("user_b",), ("user_b",), ("user_c",)], "id string")
    sent = fan_out(OWN, SCHEMA, "todo", before, after, readers).cache()
    got = {(r.actor, r.op, r.subject, r.predicate) for r in sent.collect()}
    done = {("user_a", op, "todo_1", "todo/done") for op in "+-"}
    moved = {(a, op, "todo_2", f"todo/{f}") for a, op in (("user_a", "+"), ("user_b", "-")) for f in ("text", "done", "owner")}
    assert got == done | moved
    rows = {r.actor: (r.n, r.author) for r in envelopes(4, ["user_a", "user_b", "user_c"], sent, spark, "user_a").collect()}
    assert rows == {"user_a": (5, "user_a"), "user_b": (3, "user_a"), "user_c": (0, None)}


def test_masks_for_each_reader_are_those_of_one(spark):
    rule = Policy(SCHEMA, {"user": EntityPolicy(read=anyone), "todo": EntityPolicy(read=own, overrides={"done": {"read": lambda c: c["text"] == "x"}})})
    frame = {"todo": todos(spark, ("todo_1", "x", True, "user_a", ["p"]), ("todo_2", "y", True, "user_b", None), ("todo_3", "z", True, None, None))}
    readers = spark.createDataFrame([("user_a",), ("user_b",)], "id string")
    each = rule.mask_each("todo", frame["todo"], frame, readers).collect()
    for actor in ("user_a", "user_b"):
        one = rule.mask(SCHEMA, "todo", frame["todo"], frame, {"id": actor}).collect()
        assert sorted(tuple(r)[1:] for r in each if r.actor == actor) == sorted(map(tuple, one))


def test_alternatives_are_joins_of_their_own(spark):
    from sievelog.operators.policy import Context, any_of

    rows = spark.createDataFrame([("todo_1", "user_a", "team_x"), ("todo_2", "user_b", None), ("todo_3", None, "team_x"), ("todo_4", None, None)], "id string, owner string, team string")
    readers = spark.createDataFrame([("user_a", "team_x"), ("user_b", None), ("user_c", "team_x")], "id string, team string")
    own, mates = {"equals": ["fields.owner", "actor"]}, {"equals": ["fields.team", "actor.team"]}
    schema = Schema({"todo": {"owner": string().optional(), "team": string().optional()}})
    declared = compile_rule({"anyOf": [own, {"anyOf": [mates, own]}]})
    assert len(declared.alternatives) == 3
    for rule in (declared, any_of(lambda c: c["owner"] == c.actor("id"), lambda c: c["team"] == c.actor("team"))):
        policy = Policy(schema, {"todo": EntityPolicy(read=rule)})
        pairs = policy.mask_each("todo", rows, {"todo": rows}, readers)
        assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()
        # todo_1 is granted by both ways, and comes once
        assert sorted((r.actor, r.id) for r in pairs.collect()) == [("user_a", "todo_1"), ("user_a", "todo_3"), ("user_b", "todo_2"), ("user_c", "todo_1"), ("user_c", "todo_3")]
        context = Context({c: F.col(c) for c in rows.columns}, {"id": "user_b", "team": None})
        assert [r.id for r in rows.where(rule(context)).collect()] == ["todo_2"]


def test_rules_as_data(spark):
    from sievelog.operators.policy import Context

    frame = spark.createDataFrame([("todo_1", "user_a", None, ["user_b"])], "id string, owner string, team string, seen array<string>")
    context = Context({c: F.col(c) for c in frame.columns}, {"id": "user_a", "role": None})

    def verdict(rule):
        return frame.select(compile_rule(rule)(context).alias("v")).first().v

    mine = {"equals": ["fields.owner", "actor"]}
    absent = {"equals": ["fields.team", "actor.role"]}
    assert verdict(mine) and not verdict({"not": mine}) and not verdict(absent) and verdict({"not": absent})
    assert verdict({"anyOf": [absent, mine]}) and not verdict({"allOf": [absent, mine]})
    assert not verdict({"in": ["actor", "fields.seen"]}) and verdict({"in": ["actor", [{"literal": "x"}, "fields.owner"]]})
    for wrong in ({"like": ["a", "b"]}, {"equals": ["actor"]}, {"anyOf": []}, {"equals": ["nowhere", "actor"]}, {}):
        with pytest.raises(SchemaError):
            compile_rule(wrong)


def test_pending_layers_and_bulk_operations(spark):
    held = spark.createDataFrame([("a", "x"), ("b", "x")], "id string, tag string")
    layers = [spark.createDataFrame(rows, "op string, id string, tag string") for rows in ([("+", "c", "x"), ("-", "a", "x")], [("-", "c", "x"), ("+", "a", "y")])]
    assert sorted(map(tuple, optimistic(held, layers, ["id", "tag"]).collect())) == [("a", "y"), ("b", "x")]
    assert optimistic(held, [], ["id", "tag"]).count() == 2
    schema = "seq long, kind string, subject string, predicate string, tag string, s string, n double, b boolean"
    fact = lambda s, v: (s, "todo/tags", "s", v, None, None)
    facts = spark.createDataFrame([fact("todo_1", "p"), fact("todo_1", "q"), fact("todo_2", "p")], schema.split("kind string, ")[1])
    queued = [(0, "add", *fact("todo_1", "p")), (1, "remove", *fact("todo_1", "q")), (2, "delete", *fact("todo_2", None)), (3, "add", *fact("todo_2", "r")), (4, "set", *fact("todo_3", "u")), (5, "set", *fact("todo_3", "v"))]
    got = sorted((r.op, r.subject, r.s) for r in compile_bulk(spark.createDataFrame(queued, schema), facts).collect())
    assert got == [("+", "todo_2", "r"), ("+", "todo_3", "v"), ("-", "todo_1", "q"), ("-", "todo_2", "p")]


def test_cursor_is_the_last_row_only(spark, monkeypatch):
    from sievelog.plans.planner import Planner

    planner = Planner(SCHEMA, {"todo": todos(spark, *[(f"todo_{i}", f"x{i % 7}", True, "user_a", None) for i in range(40)]).repartition(5)})
    for n in (1, 9, 40):
        for query in (Query.of(SCHEMA, "todo").order_by("text").limit(n), Query.of(SCHEMA, "todo").order_by("text", "desc").limit(n)):
            last = planner.roots(query).collect()[-1]
            assert planner.cursor_of(query) == (last.text, last.id)
    assert planner.cursor_of(Query.of(SCHEMA, "todo").order_by("text").limit(41)) is None
    monkeypatch.setattr(planner, "roots", None)
    assert planner.cursor_of(Query.of(SCHEMA, "todo").order_by("text")) is None


def test_bulk_operations_sweep_references(spark):
    import random

    from sievelog.operators.writes import compile_operations

    schema = Schema({"user": {"name": string().optional()}, "team": {"name": string().optional(), "member": ref("user").multiple()}, "todo": {"owner": ref("user").optional(), "team": ref("team").optional(), "tags": string().multiple()}})
    columns = "seq long, kind string, subject string, predicate string, tag string, s string, n double, b boolean"
    some = random.Random(7)
    ids = {e: [f"{e}_{i}" for i in range(4)] for e in schema.entities}
    held, queued, state = [], [], set()
    fields = [("user", "name", None), ("team", "name", None), ("team", "member", "user"), ("todo", "owner", "user"), ("todo", "team", "team"), ("todo", "tags", None)]
    many = {"member", "tags"}
    for i in range(260):
        entity, field, to = some.choice(fields)
        subject, target = some.choice(ids[entity]), some.choice(ids[to]) if to else some.choice("xyz")
        fact = (subject, f"{entity}/{field}", "r" if to else "s", target, None, None)
        if i > 60 and some.random() < 0.15:
            op = (Operation("delete", subject), "delete", (subject, None, None, None, None, None))
        elif field not in many:
            op = (Operation("set", subject, field, Ref(target) if to else target), "set", fact)
        else:
            kind = "remove" if fact in state else "add"
            op = (Operation(kind, subject, field, Ref(target) if to else target), kind, fact)
        before = set(state)
        added, removed = compile_operations(schema, [op[0]], lambda s: {f for f in before if f[0] == s}, lambda s: {f for f in before if f[2] == "r" and f[3] == s})
        state = (state - removed) | added
        if i < 60:
            held = sorted(state, key=str)
        else:
            queued.append((i, op[1], *op[2]))
    facts = spark.createDataFrame(held, columns.split("kind string, ")[1])
    delta = [(r[0], tuple(r[1:])) for r in compile_bulk(spark.createDataFrame(queued, columns), facts).collect()]
    assert len(delta) == len(set(delta)) and any(k == "delete" for _, k, *_ in queued)
    assert (set(held) - {f for o, f in delta if o == "-"}) | {f for o, f in delta if o == "+"} == state
    one = facts.where("false").union(spark.createDataFrame([("todo_1", "todo/owner", "r", "user_1", None, None)], facts.schema))
    gone = spark.createDataFrame([(0, "delete", "user_1", None, None, None, None, None)], columns)
    assert [(r.op, r.subject, r.s) for r in compile_bulk(gone, one).collect()] == [("-", "todo_1", "user_1")]


def test_live_readers(spark, tmp_path):
    engine = Engine(Warehouse(spark, f"file://{tmp_path}"), SCHEMA, OWN)
    fields = {"text": "x", "done": False, "owner": Ref("user_a")}
    engine.commit([Operation("set", "user_a", "name", "Ada"), *[Operation("set", "todo_1", k, v) for k, v in fields.items()]])
    told = []
    live = LiveQuery(lambda query: engine.planner({"id": "user_a"}).run(query), Query.of(SCHEMA, "todo").where("done", False).select({"text": True}), told.append)
    assert live.status is Status.READY and [r.id for r in live.rows] == ["todo_1"]
    assert not live.touched({"user/name"}) and live.runs == 1
    box, late = Outbox(), []
    box.on_rejected.append(lambda operations, reason: late.append(reason))
    box.add([Operation("set", "todo_1", "done", True)], SCHEMA.generation)
    box.add([Operation("set", "todo_1", "owner", None)])
    box.add([Operation("set", "todo_1", "text", "y")], "other")
    assert box.drain(engine, "user_a") == 1 and len(late) == 2 and not box.queue
    assert live.touched({"todo/done"}) and live.rows == [] and len(told) == 2
    kinds = {m["kind"]: m for m in subscribe(engine, "user_a", since=1)}
    assert set(kinds) == {"hello", "backlog", "repair"} and kinds["hello"]["version"] == 2
    assert {(r.op, r.b) for r in kinds["backlog"]["entries"].collect()} == {("-", False), ("+", True)}
    hidden = {m["kind"]: m for m in subscribe(engine, "user_b", since=1)}
    assert hidden["backlog"]["entries"].count() == 0 and [r.id for r in hidden["repair"]["evict"].collect()] == ["todo_1"]
    engine.store.compact(2)
    again = {m["kind"]: m for m in subscribe(engine, "user_a", since=1)}
    assert set(again) == {"hello", "resync"} and again["resync"]["facts"]["todo"].count() == 3
    assert engine.store.version == 2 and engine.store.entries_since(1) is None and engine.store.entries_since(2).count() == 0


def test_second_writer_of_a_version_fails(spark, tmp_path):
    class Late(Warehouse):
        """Sees version 1 as the last, as a writer that began before version 2 did."""

        @property
        def version(self):
            return min(super().version, 1)

    one = Warehouse(spark, f"file://{tmp_path}")
    delta = lambda text: spark.createDataFrame([("+", "user_a", "user/name", "s", text, None, None)], "op string, subject string, predicate string, tag string, s string, n double, b boolean")
    assert [one.apply(delta("Ada")), one.apply(delta("Bo")), one.apply(delta("Bo"))] == [1, 2, None]
    with pytest.raises(Conflict):
        Late(spark, f"file://{tmp_path}").apply(delta("Eve"))
    assert one.version == 2 and sorted(r.s for r in one.facts().collect()) == ["Ada", "Bo"]
    assert len(list((tmp_path / "main" / "log").iterdir())) == 2


def test_presence_messages_and_repair(spark):
    online = Presence()
    assert [online.connect("a"), online.connect("a"), online.connect("b")] == ["joined", None, "joined"]
    assert [online.disconnect("a"), online.disconnect("b"), online.roster] == [None, "left", ["a"]]
    messages = spark.createDataFrame([(None, "hi"), ("todo_1", "on it"), ("todo_2", "no"), (None, "x" * 20000)], "about string, payload string")
    ids = spark.createDataFrame([("todo_1",), ("todo_3",)], "id string")
    assert sorted(r.payload for r in broadcast_visible(messages, ids).collect()) == ["hi", "on it"]
    evict, refresh = repair(spark.createDataFrame([("todo_1",), ("todo_2",)], "id string"), ids)
    assert [r.id for r in evict.collect()] == ["todo_2"] and [r.id for r in refresh.collect()] == ["todo_1"]


def test_apps(spark, tmp_path):
    note = {"note": {"text": "string"}}
    schema, policy = build_workspace(note, {"note": {"read": True}})
    engine = Engine(Warehouse(spark, f"file://{tmp_path}"), schema, policy)
    people = (("user_m", "member", "m@x.org"), ("user_i", "appUser", "i@x.org"), ("user_o", "appUser", "o@x.org"), ("user_r", "admin", "r@x.org"))
    engine.commit([Operation("set", u, k, v) for u, role, mail in people for k, v in (("name", u), ("role", role), ("email", mail))])
    staff = Tools(engine, "user_m")
    app = staff.call("create_app", {"name": "Board", "audience": "invited"})
    staff.call("write_file", {"app": app, "path": "index.html", "content": "one"})
    with pytest.raises(Rejected):
        staff.call("write_file", {"app": app, "path": "../x", "content": "no"})
    assert staff.call("read_file", {"app": app}) is None
    first = staff.call("publish", {"app": app, "at": 1.0})
    assert staff.call("read_file", {"app": app, "path": "missing"})[0] == "one"
    staff.call("invite", {"app": app, "email": "i@x.org"})
    assert Tools(engine, "user_i").call("read_file", {"app": app})[0] == "one"
    assert Tools(engine, "user_o").call("read_file", {"app": app}) is None
    with pytest.raises(Rejected):
        Tools(engine, "user_i").call("set_audience", {"app": app, "audience": "public"})
    with pytest.raises(Rejected):
        engine.transact([Operation("set", first, "version", 9)], "user_m")
    with pytest.raises(Rejected):
        staff.call("set_schema", {"declaration": note, "rules": {}})
    before = engine.schema.generation
    Tools(engine, "user_r").call("set_schema", {"declaration": {"note": {"text": "string"}, "card": {"text": "string"}}, "rules": {}})
    assert engine.schema.generation != before and {before, engine.schema.generation} <= engine.accepted
    with pytest.raises(Rejected):
        staff.call("_rows", {"entity": "app"})


def test_patterns(spark):
    facts = ops.unpivot(SCHEMA, "todo", todos(spark, ("todo_1", "x", True, "user_a", ["p", "q"]), ("todo_2", None, None, "user_b", ["p"])))
    assert facts.count() == 7
    assert ops.match(facts, subject="todo_2").count() == 2 and ops.match(facts, predicate="todo/tags", value="p").count() == 2
    assert ops.match(facts, value=Ref("user_a")).count() == 1 and ops.match(facts, value=True).count() == 1
    wide = {r.id: r for r in ops.widen(SCHEMA, "todo", facts).collect()}
    assert wide["todo_1"].tags == ["p", "q"] and wide["todo_2"].text is None
    top = ops.top_subjects(facts, None, "todo/text", 5)
    assert [r.subject for r in top.collect()] == ["todo_1"]


def test_backlog_hides_fields(spark, tmp_path):
    rule = EntityPolicy(read=anyone, create=anyone, update=anyone, delete=own, overrides={"done": {"read": own}})
    engine = Engine(Warehouse(spark, f"file://{tmp_path}"), SCHEMA, Policy(SCHEMA, {"user": EntityPolicy(read=anyone), "todo": rule}))
    fields = {"text": "x", "done": False, "owner": Ref("user_a")}
    engine.commit([Operation("set", s, k, v) for s in ("todo_1", "todo_2") for k, v in fields.items()])
    engine.commit([Operation("set", "todo_1", "done", True), Operation("set", "todo_1", "text", "y"), Operation("delete", "todo_2")])

    def got(actor):
        kinds = {m["kind"]: m for m in subscribe(engine, actor, since=1)}
        entries = {(r.op, r.subject, r.predicate) for r in kinds["backlog"]["entries"].collect()}
        fresh = {(r.subject, r.predicate) for r in kinds["repair"]["refresh"].collect()}
        return entries, fresh, sorted(r.id for r in kinds["repair"]["evict"].collect())

    entries, fresh, gone = got("user_b")
    # of a subject that is gone, the fields that anyone may read are told
    assert entries == {("-", "todo_1", "todo/text"), ("+", "todo_1", "todo/text"), ("-", "todo_2", "todo/text"), ("-", "todo_2", "todo/owner")}
    assert fresh == {("todo_1", "todo/text"), ("todo_1", "todo/owner")} and gone == ["todo_2"]
    entries, fresh, gone = got("user_a")
    assert {p for _, s, p in entries if s == "todo_1"} == {"todo/text", "todo/done"} and ("todo_1", "todo/done") in fresh


def test_repair_follows_references(spark, tmp_path):
    """A reader that a team has dropped while away loses the team's todos, which the backlog doesn't name."""
    schema = Schema({"user": {"name": string()}, "team": {"name": string(), "member": ref("user").multiple()}, "todo": {"text": string(), "team": ref("team")}})
    member = lambda c: F.coalesce(F.array_contains(c["team.member"], c.actor("id")), F.lit(False))
    policy = Policy(schema, {"user": EntityPolicy(read=anyone), "team": EntityPolicy(read=anyone), "todo": EntityPolicy(read=member, fields=("team.member",))})
    engine = Engine(Warehouse(spark, f"file://{tmp_path}"), schema, policy)
    engine.commit([Operation("set", "team_1", "name", "t"), Operation("add", "team_1", "member", Ref("user_a")), Operation("set", "todo_1", "text", "x"), Operation("set", "todo_1", "team", Ref("team_1"))])
    engine.commit([Operation("remove", "team_1", "member", Ref("user_a")), Operation("add", "team_1", "member", Ref("user_b"))])
    kinds = {a: {m["kind"]: m for m in subscribe(engine, a, since=1)} for a in ("user_a", "user_b")}
    assert [r.id for r in kinds["user_a"]["repair"]["evict"].collect()] == ["todo_1"]
    assert ("todo_1", "todo/text") in {(r.subject, r.predicate) for r in kinds["user_b"]["repair"]["refresh"].collect()}


def test_facts_with_nulls_are_removed(spark):
    facts = ops.unpivot(SCHEMA, "todo", todos(spark, ("todo_1", "x", True, None, ["p", "q"]))).cache()
    tags = facts.where("predicate = 'todo/tags'")
    gone, new = tags.where("s = 'p'"), tags.where("s = 'q'").withColumn("s", F.lit("r"))
    assert sorted(r.s for r in ops.overlay(tags, gone, new, tags.columns).collect()) == ["q", "r"]
    layer = gone.withColumn("op", F.lit("-")).unionByName(new.withColumn("op", F.lit("+")))
    assert sorted(r.s for r in optimistic(tags, [layer], tags.columns).collect()) == ["q", "r"]
    assert sorted(str(r.s) for r in ops.evictable(facts, tags, facts.where("b")).collect()) == ["x"]


def test_apps_open_to_their_audience(spark, tmp_path):
    schema, policy = build_workspace({}, {})
    engine = Engine(Warehouse(spark, f"file://{tmp_path}"), schema, policy)
    people = {"user_m": "member", "user_n": "member", "user_i": "appUser", "user_r": "admin"}
    engine.commit([Operation("set", u, k, v) for u, role in people.items() for k, v in (("name", u), ("role", role), ("email", f"{u}@x.org"))])
    staff = Tools(engine, "user_m")
    app = staff.call("create_app", {"name": "Board", "audience": "invited"})
    see = lambda: {u for u in people if Tools(engine, u).call("list_apps").count()}
    assert see() == {"user_m", "user_r"}
    staff.call("set_audience", {"app": app, "audience": "members"})
    assert see() == {"user_m", "user_n", "user_r"}
    for name in ("engine", "actor", "_rows", "call", "nothing"):
        with pytest.raises(Rejected):
            staff.call(name)
    engine.transact([Operation("set", "user_i", "name", "Ida")], "user_i")
    engine.transact([Operation("delete", "user_i")], "user_i")
    with pytest.raises(Rejected):
        engine.transact([Operation("delete", "user_n")], "user_m")


def test_limits_of_names_and_changes():
    from sievelog.sources.schema import migration_problems
    from sievelog.sources.tables import _numbers
    from sievelog.sources.warehouse import _WORKSPACE

    assert _WORKSPACE.fullmatch("a" * 64) and not _WORKSPACE.fullmatch("a" * 65)
    one, two = Schema({"a": {"x": string().optional(), "y": string()}}), Schema({"a": {"x": string(), "y": string()}})
    assert migration_problems(one, two, lambda e: False) and not migration_problems(two, one, lambda e: True)
    assert _numbers("order", ["order_42", "order_042", "order_x", "part_1", "order_-3", "order_"]) == [42, -3]


def test_same_rows_for_every_parent_need_a_limit(spark, monkeypatch):
    from sievelog.plans import planner
    from sievelog.plans.query import QueryError

    frames = {"todo": todos(spark, *[(f"todo_{i}", "x", True, "user_a", None) for i in range(9)]), "user": spark.createDataFrame([("user_a", "A")], "id string, name string")}
    made = planner.Planner(SCHEMA, frames)
    every = lambda n: Query.of(SCHEMA, "user").select({"todos": Query.of(SCHEMA, "todo").limit(n) if n else Query.of(SCHEMA, "todo")})
    monkeypatch.setattr(planner, "ALONE", 8)
    with pytest.raises(QueryError):
        made.run(every(None))
    assert len(made.run(every(8)).first().todos) == 8
    monkeypatch.setattr(planner, "ALONE", 9)
    assert len(made.run(every(None)).first().todos) == 9
