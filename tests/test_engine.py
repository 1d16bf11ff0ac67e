"""Checked writes, the log and its fold, permissions on writes, on a small workspace."""

import pytest
from pyspark.sql import functions as F

from sievelog.functions.values import FACTS, Ref, decode_number, decode_value, encode_number, encode_value
from sievelog.operators import facts as ops
from sievelog.operators.policy import EntityPolicy, Policy, anyone
from sievelog.operators.writes import Engine, Operation, Rejected
from sievelog.plans.query import Query, QueryError
from sievelog.sources.schema import Schema, SchemaError, boolean, declaration_of, from_declaration, migration_problems, ref, string
from sievelog.sources.warehouse import Warehouse

SCHEMA = Schema({"user": {"name": string()}, "todo": {"text": string(), "done": boolean(), "owner": ref("user"), "tags": string().multiple()}})


def own(c):
    return c["owner"] == c.actor("id")


POLICY = Policy(SCHEMA, {"user": EntityPolicy(read=anyone), "todo": EntityPolicy(read=own, create=own, update=own, delete=own, overrides={"done": {"write": anyone}})})


def test_transactions(spark, tmp_path):
    engine = Engine(Warehouse(spark, f"file://{tmp_path}"), SCHEMA, POLICY)
    assert engine.commit([Operation("set", "user_a", "name", "Ada"), Operation("set", "user_b", "name", "Bo")]) == 1

    def build(tx):
        tx.create("todo", {"text": "x", "done": False, "owner": Ref("user_a"), "tags": ["p", "q"]}, "todo_1")

    assert engine.transact(build, "user_a") == 2
    with pytest.raises(Rejected):
        engine.transact([Operation("set", "todo_1", "text", "y")], "user_b")
    assert engine.transact([Operation("set", "todo_1", "done", True)], "user_b") == 3
    assert engine.transact([Operation("set", "todo_1", "done", True)], "user_b") is None
    with pytest.raises(Rejected):
        engine.transact([Operation("add", "todo_1", "text", "y")], "user_a")
    query = Query.of(SCHEMA, "todo").where("tags", "p").select({"text": True, "done": True, "owner": {"name": True}})
    (row,) = engine.planner({"id": "user_a"}).run(query).collect()
    assert (row.id, row.text, row.done, row.owner.name) == ("todo_1", "x", True, "Ada")
    assert engine.planner({"id": "user_b"}).run(query).count() == 0
    assert engine.store.facts(2).where("b = false").count() == 1


def test_schema_rules():
    with pytest.raises(SchemaError):
        Schema({"Bad": {"x": string()}})
    with pytest.raises(QueryError):
        Query.of(SCHEMA, "todo").where("missing", 1)
    with pytest.raises(QueryError):
        Query.of(SCHEMA, "todo").where_greater("tags", "a")
    again = from_declaration(declaration_of(SCHEMA))
    assert again.generation == SCHEMA.generation
    more = from_declaration(declaration_of(SCHEMA) | {"user": {"name": "string", "age": "number"}})
    assert migration_problems(SCHEMA, more, lambda e: True) and not migration_problems(SCHEMA, more, lambda e: False)


def test_encodings():
    numbers = [-1e300, -2.5, -0.0, 0.0, 1e-9, 3.0, 7e22]
    assert sorted(map(encode_number, numbers)) == list(map(encode_number, numbers))
    assert all(decode_number(encode_number(x)) == x for x in numbers)
    for value in ("42", 42.0, True, Ref("user_1"), {"b": 1, "a": 2}):
        assert decode_value(encode_value(value)) == value


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_changes_and_folds_are_one_hash_aggregation(spark):
    fact = lambda name, **slot: ("user_" + name, "user/name", "s", slot.get("s"), slot.get("n"), slot.get("b"))
    facts = {k: fact(k, s=k) for k in "abcd"} | {"n": fact("n", n=0.0), "e": fact("e", b=False), "f": fact("f")}
    held = spark.createDataFrame([facts[k] for k in "aabbne"], FACTS)
    # removed; removed and added again; held already; new, twice; neither held nor added; held with nulls; new with nulls; of no operation
    delta = [("-", "a"), ("-", "b"), ("+", "b"), ("+", "n"), ("+", "c"), ("+", "c"), ("-", "d"), ("-", "e"), ("+", "f"), (None, "a")]
    changes = ops.effective(held, spark.createDataFrame([(op, *facts[k]) for op, k in delta], f"op string, {FACTS}"))
    assert changes.columns == ["op", "subject", "predicate", "tag", "s", "n", "b"]
    assert sorted((r.op, r.subject[5:]) for r in changes.collect()) == [("+", "c"), ("+", "f"), ("-", "a"), ("-", "e")]
    log = [(1, 0, "+", "a"), (2, 0, "-", "a"), (1, 1, "+", "b"), (1, 0, "-", "b"), (2, 0, "+", "c"), (1, 5, "-", "c"), (2**62, -1, "-", "d"), (2**62, 2**31 - 1, "+", "d"), (2**62 - 1, 2**31 - 1, "-", "d")]
    log += [(3, 1, "-", "n"), (3, 0, "+", "n"), (None, 9, "-", "f"), (0, None, "+", "f"), (1, 1, None, "e")]
    state = ops.fold(spark.createDataFrame([(v, q, op, *facts[k]) for v, q, op, k in log], f"version long, seq int, op string, {FACTS}"))
    assert sorted(r.subject[5:] for r in state.collect()) == ["b", "c", "d", "f"]
    for df in (changes, state):
        plan = plan_of(df)
        assert plan.count("Exchange hashpartitioning") == 1 and "HashAggregate" in plan and "Sort" not in plan


def test_a_snapshot_or_first_commit_alone_is_not_folded(spark, tmp_path):
    store = Warehouse(spark, f"file://{tmp_path}")
    rows = spark.range(5).select(F.lit("+").alias("op"), F.concat(F.lit("user_"), "id").alias("subject"), F.lit("user/name").alias("predicate"), F.lit("s").alias("tag"), F.lit("x").alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"))
    assert store.apply(rows.unionByName(rows).unionByName(rows.withColumn("op", F.lit("-")))) == 1
    assert "Exchange" not in plan_of(store.facts(1)) and store.facts(1).count() == 5
    assert store.apply(rows.where("subject = 'user_0'").withColumn("op", F.lit("-"))) == 2
    store.compact(2)
    assert "Exchange" not in plan_of(store.facts()) and store.facts().count() == 4
    assert store.apply(rows) == 3 and store.facts().count() == 5 and store.facts(2).count() == 4


def test_write_checks_join_each_state_once(spark):
    """Verbs by what was there, rules on touched rows only, and few sorted sides in a task."""
    schema = Schema({"item": {"n": string(), "field": string(), "up": ref("item")}})
    rules = dict(create=lambda c: c["n"] == c.after("n"), update=lambda c: (c["n"].cast("int") > 0) & (c.after("n") == "9"), delete=lambda c: c["up.n"] == "1")
    policy = Policy(schema, {"item": EntityPolicy(fields=("up.n",), overrides={"field": {"write": lambda c: c["field"] == "y"}}, **rules)})
    row = "id string, n string, field string, up string"
    before = spark.createDataFrame([("item_a", "1", "y", "item_a"), ("item_b", "0", "x", "item_b"), ("item_c", "2", "x", "item_a"), ("item_d", "bad", "x", None)], row)
    after = spark.createDataFrame([("item_a", "9", "y", None), ("item_b", "9", "y", None), ("item_e", "5", "z", None), ("item_d", "bad", "x", None)], row)
    gone = spark.createDataFrame([("item_c",), ("item_c",), ("item_x",)], "id string")
    touched = spark.createDataFrame([("item_a", "n"), ("item_a", "field"), ("item_b", "n"), ("item_b", "field"), ("item_c", "n"), ("item_e", "n"), ("item_e", "field"), ("item_f", "n"), ("item_x", "n"), (None, "n")], "id string, field string")
    want = {("a", "update", "n", True), ("a", "update", "field", True), ("b", "update", "n", False), ("b", "update", "field", False), ("c", "delete", "n", True)}
    want |= {("e", "create", "n", True), ("e", "create", "field", False), ("f", "create", "n", False), ("x", "delete", "n", False), ("", "create", "n", False)}

    def verdicts(policy):
        frames, later = {"item": before}, {"item": after}
        return policy.write_verdicts("item", before, after, gone, touched, frames, later, {"id": "user_a"})

    got = verdicts(policy)
    assert got.columns == ["id", "verb", "field", "ok"]
    assert sorted(((r.id or "")[5:], r.verb, r.field, r.ok) for r in got.collect()) == sorted(want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = verdicts(Policy(schema, {"item": EntityPolicy(create=anyone, update=anyone, delete=anyone)}))
        assert plan_of(plain).count("SortMergeJoin") == 7 and {r.verb for r in plain.where("ok").collect()} == {"create", "update", "delete"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
