"""The registered queries of the engine, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelog.functions.values import FACTS
from sievelog.operators import facts as ops
from sievelog.operators.policy import EntityPolicy, Policy, any_of, anyone, compile_policy
from sievelog.plans.planner import Planner
from sievelog.plans.query import Query
from sievelog.sources.tables import SCHEMA, Tables

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def q(entity: str) -> Query:
    return Query.of(SCHEMA, entity)


def plan(spark: SparkSession, sf_dir: str, policy: Policy | None = None, actor: dict | None = None) -> Planner:
    return Planner(SCHEMA, Tables(spark, sf_dir), policy, actor)


def simple(name: str, query: Query, sql: str, policy: Callable[[SparkSession, str], tuple[Policy, dict]] | None = None) -> None:
    """Registers a query whose result is its flat selection."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = policy(spark, sf_dir) if policy else (None, None)
        return plan(spark, sf_dir, *made).run(query)

    QUERIES[name], SQL[name] = run, sql


ORDER, DOC = "'order_'||o_orderkey id", "(SELECT 'document_'||d.doc_id id, lang, source, n_chars, l.quality FROM documents d LEFT JOIN labels l USING(doc_id))"
_doc = f"SELECT id FROM {DOC} WHERE "

simple("where_eq", q("order").where("status", "F").select({"total": True}), f"SELECT {ORDER}, o_totalprice total FROM orders WHERE o_orderstatus='F'")
simple("where_in", q("order").where("priority", ["1-URGENT", "2-HIGH"]), f"SELECT {ORDER} FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')")
simple("where_in_empty", q("order").where("priority", []), f"SELECT {ORDER} FROM orders WHERE false")
simple("where_multiple", q("part").where("word", "small"), "SELECT 'part_'||p_partkey id FROM part WHERE list_contains(string_split(p_name,' '),'small')")
simple("where_not", q("order").where_not("status", ["F", "P"]), f"SELECT {ORDER} FROM orders WHERE NOT o_orderstatus IN ('F','P')")
simple("where_not_multiple", q("part").where_not("word", ["small", "ring"]), "SELECT 'part_'||p_partkey id FROM part WHERE NOT list_has_any(string_split(p_name,' '),['small','ring'])")
simple("where_not_keeps_absent", q("document").where_not("quality", 1), _doc + "quality IS NULL OR quality<>1")
simple("where_absent", q("document").where_absent("quality"), _doc + "quality IS NULL")
simple("where_greater", q("customer").where_greater("balance", 5000), "SELECT 'customer_'||c_custkey id FROM customer WHERE c_acctbal>5000")
simple("where_ge", q("customer").where_greater_or_equal("balance", 5000), "SELECT 'customer_'||c_custkey id FROM customer WHERE c_acctbal>=5000")
simple("where_lesser", q("customer").where_lesser("balance", 0), "SELECT 'customer_'||c_custkey id FROM customer WHERE c_acctbal<0")
simple("where_le", q("customer").where_lesser_or_equal("balance", 0), "SELECT 'customer_'||c_custkey id FROM customer WHERE c_acctbal<=0")
simple("where_between_text", q("customer").where_between("segment", "B", "G"), "SELECT 'customer_'||c_custkey id FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'G'")
simple("where_either", q("order").where_either(lambda x: x.where("status", "F").where_greater("total", 100000), lambda x: x.where("priority", "1-URGENT")), f"SELECT {ORDER} FROM orders WHERE (o_orderstatus='F' AND o_totalprice>100000) OR o_orderpriority='1-URGENT'")
simple("where_either_negated", q("document").where_either(lambda x: x.where("lang", "en"), lambda x: x.where_absent("quality")), _doc + "lang='en' OR quality IS NULL")
simple("where_id", q("order").where_id("order_42").select({"total": True}), f"SELECT {ORDER}, o_totalprice total FROM orders WHERE o_orderkey=42")
simple("every_instance", q("nation").select({"name": True}), "SELECT 'nation_'||n_nationkey id, n_name name FROM nation")
simple("negation_first", q("nation").where_not("name", "NATION_0"), "SELECT 'nation_'||n_nationkey id FROM nation WHERE n_name<>'NATION_0'")
simple("order_limit", q("order").where("status", "O").order_by("total").limit(50).select({"total": True}), f"SELECT {ORDER}, o_totalprice total FROM orders WHERE o_orderstatus='O' ORDER BY o_totalprice, id LIMIT 50")
simple("order_desc_missing_last", q("document").order_by("quality", "desc").limit(500).select({"quality": True}), f"SELECT id, quality FROM {DOC} ORDER BY quality DESC NULLS LAST, id LIMIT 500")
simple("after_cursor", q("order").order_by("total").after(100000.0, "order_5").limit(50).select({"total": True}), f"SELECT {ORDER}, o_totalprice total FROM orders WHERE o_totalprice>100000 OR (o_totalprice=100000 AND 'order_'||o_orderkey>'order_5') ORDER BY o_totalprice, id LIMIT 50")
simple("after_cursor_missing_zone", q("document").order_by("quality").after(None, "document_5").limit(50), f"SELECT id FROM {DOC} WHERE quality IS NULL AND id>'document_5' ORDER BY id LIMIT 50")


@registered("SELECT 'order_'||o_orderkey id, 'customer_'||o_custkey customer FROM orders WHERE o_custkey=7")
def where_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(spark, sf_dir).run(q("order").where("customer", {"id": "customer_7"}).select({"customer": True}))
    return rows.select("id", F.col("customer.id").alias("customer"))


@registered("SELECT 'order_'||o_orderkey id, 'customer_'||o_custkey customer_id, c_name customer_name, n_name nation_name FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey WHERE o_orderstatus='F'")
def nested_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(spark, sf_dir).run(q("order").where("status", "F").select({"customer": {"name": True, "nation": {"name": True}}}))
    return rows.select("id", F.col("customer.id").alias("customer_id"), F.col("customer.name").alias("customer_name"), F.col("customer.nation.name").alias("nation_name"))


#: In the given tables' keys, ids below 20 by number.
_FIRST = [f"supplier_{i}" for i in range(20)]


@registered("SELECT DISTINCT 'supplier_'||l_suppkey id, 'part_'||l_partkey part_id, p_brand brand FROM lineitem JOIN part ON l_partkey=p_partkey WHERE l_suppkey<20")
def nested_multi_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    planner = plan(spark, sf_dir)
    rows = planner.roots(q("supplier")).where(F.col("id").isin(*_FIRST))
    return planner.followed_rows(rows, "supplier", "part", {"brand": True}).where("part is not null").select("id", F.col("part").alias("part_id"), "brand")


@registered("SELECT DISTINCT 'supplier_'||l_suppkey id, 'part_'||l_partkey part_id, p_brand brand FROM lineitem JOIN part ON l_partkey=p_partkey")
def nested_multi_ref_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier with the parts it refers to."""
    planner = plan(spark, sf_dir)
    rows = planner.followed_rows(planner.roots(q("supplier")), "supplier", "part", {"brand": True})
    return rows.where("part is not null").select("id", F.col("part").alias("part_id"), "brand")


@registered("SELECT 'order_'||o_orderkey id, l_linenumber line, l_extendedprice price FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey WHERE o_orderstatus='F'")
def subquery_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = q("order").where("status", "F").select(lambda row: {"items": q("lineitem").where("order", row).select({"line": True, "price": True})})
    return plan(spark, sf_dir).joined(query, "items").select("id", F.col("items_line").alias("line"), F.col("items_price").alias("price"))


@registered("SELECT 'customer_'||c_custkey id, 'order_'||o_orderkey order_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, 'order_'||o_orderkey) rn FROM orders) JOIN customer ON o_custkey=c_custkey WHERE rn<=3")
def subquery_top3_per_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = q("customer").select(lambda row: {"orders": q("order").where("customer", row).order_by("total").limit(3)})
    return plan(spark, sf_dir).joined(query, "orders", outer=False).select("id", F.col("orders_id").alias("order_id"))


@registered("SELECT 'customer_'||c_custkey id, 'order_'||o_orderkey order_id FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice>300000) ON o_custkey=c_custkey")
def subquery_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through the nested form: an array for each parent, then its elements."""
    query = q("customer").select(lambda row: {"orders": q("order").where("customer", row).where_greater("total", 300000)})
    return plan(spark, sf_dir).run(query).select("id", F.explode_outer("orders").alias("o")).select("id", F.col("o.id").alias("order_id"))


@registered("SELECT 'order_'||a.o_orderkey id, 'order_'||b.o_orderkey sibling FROM orders a JOIN orders b ON a.o_custkey=b.o_custkey WHERE a.o_orderkey<100")
def subquery_at_ref_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = q("order").where("status", ["F", "O", "P"]).select({"customer": lambda row: {"orders": q("order").where("customer", row)}})
    planner = plan(spark, sf_dir)
    chosen = planner.roots(query).where(F.substring_index("id", "_", -1).cast("long") < 100)
    rows = planner._shaped(chosen, "order", query.selection)
    return rows.select("id", F.explode("customer.orders").alias("o")).select("id", F.col("o.id").alias("sibling"))


@registered("SELECT 'order_'||a.o_orderkey id, 'order_'||b.o_orderkey sibling FROM orders a JOIN orders b ON a.o_custkey=b.o_custkey")
def subquery_at_ref_depth_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the orders of its customer."""
    query = q("order").select({"customer": lambda row: {"orders": q("order").where("customer", row)}})
    rows = plan(spark, sf_dir).run(query)
    return rows.select("id", F.explode("customer.orders").alias("o")).select("id", F.col("o.id").alias("sibling"))


@registered("SELECT 'region_'||r_regionkey id, 'nation_'||n_nationkey nation_id FROM region CROSS JOIN (SELECT * FROM nation ORDER BY 'nation_'||n_nationkey LIMIT 2)")
def subquery_uncorrelated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(spark, sf_dir).run(q("region").select({"nations": q("nation").limit(2)}))
    return rows.select("id", F.explode("nations").alias("n")).select("id", F.col("n.id").alias("nation_id"))


@registered("SELECT 'customer_'||c_custkey id, 'order_'||o_orderkey order_id FROM customer LEFT JOIN (SELECT *, o_custkey k FROM orders WHERE o_orderstatus='F' UNION SELECT *, o_custkey FROM orders WHERE o_totalprice>400000) ON k=c_custkey")
def subquery_either_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = q("customer").select(lambda row: {"orders": q("order").where_either(lambda b: b.where("customer", row).where("status", "F"), lambda b: b.where("customer", row).where_greater("total", 400000))})
    return plan(spark, sf_dir).joined(query, "orders").select("id", F.col("orders_id").alias("order_id"))


@registered("SELECT 'nation_'||n_nationkey id, 'customer_'||c_custkey customer_id, 'order_'||o_orderkey order_id FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal>9000) ON c_nationkey=n_nationkey LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus='P') ON o_custkey=c_custkey")
def subquery_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = lambda c: {"orders": q("order").where("customer", c).where("status", "P")}
    query = q("nation").select(lambda row: {"customers": q("customer").where("nation", row).where_greater("balance", 9000).select(orders)})
    rows = plan(spark, sf_dir).run(query).select("id", F.explode_outer("customers").alias("c"))
    return rows.select("id", F.col("c.id").alias("customer_id"), F.explode_outer("c.orders").alias("o")).select("id", "customer_id", F.col("o.id").alias("order_id"))


# Permissions.


def order_policy(neighbours: bool = True) -> Policy:
    """Orders: one's own; with ``neighbours`` also open ones of customers of one's nation."""

    def own(c):
        return c["customer"] == c.actor("id")

    def nearby(c):
        return (c["status"] == "O") & (c["customer.nation"] == c.actor("nation"))

    read = any_of(own, nearby) if neighbours else own
    rest = {e: EntityPolicy(read=anyone) for e in SCHEMA.entities}
    return Policy(SCHEMA, rest | {"order": EntityPolicy(read=read, fields=("customer.nation",))})


def as_customer(spark: SparkSession, sf_dir: str) -> dict:
    """Customer 7's record: one row."""
    return Tables(spark, sf_dir)["customer"].where("id = 'customer_7'").first().asDict()


_SEEN = "(SELECT o.*, c.c_nationkey FROM orders o JOIN customer c ON o_custkey=c_custkey WHERE o_custkey=7 OR (o_orderstatus='O' AND c_nationkey=(SELECT c_nationkey FROM customer WHERE c_custkey=7)))"
_reader = lambda s, d: (order_policy(), as_customer(s, d))

simple("policy_read", q("order"), f"SELECT {ORDER} FROM {_SEEN}", _reader)
simple("policy_window", q("order").order_by("total").limit(20), f"SELECT {ORDER} FROM {_SEEN} ORDER BY o_totalprice, id LIMIT 20", _reader)
simple("policy_filter_pushed", q("order").where("status", "O").select({"total": True}), f"SELECT {ORDER}, o_totalprice total FROM {_SEEN} WHERE o_orderstatus='O'", _reader)


_OPEN_NEARBY = {"allOf": [{"equals": ["fields.status", {"literal": "O"}]}, {"equals": ["fields.customer.nation", "actor.nation"]}]}
_DECLARED = {e: {"read": True} for e in SCHEMA.entities} | {"order": {"read": {"anyOf": [{"equals": ["fields.customer", "actor"]}, _OPEN_NEARBY]}}}

simple("policy_declared", q("order"), f"SELECT {ORDER} FROM {_SEEN}", lambda s, d: (compile_policy(SCHEMA, _DECLARED), as_customer(s, d)))


def _quality_policy(spark: SparkSession, sf_dir: str) -> tuple[Policy, dict]:
    rules = {e: EntityPolicy(read=anyone) for e in SCHEMA.entities}
    rules["document"] = EntityPolicy(read=anyone, overrides={"quality": {"read": lambda c: c["lang"] == "en"}})
    return Policy(SCHEMA, rules), {"id": "user_0"}


simple("policy_field_hidden_is_absent", q("document").where_absent("quality"), _doc + "lang<>'en' OR quality IS NULL", _quality_policy)


@registered(f"SELECT {ORDER} FROM {_SEEN} WHERE o_custkey<>7")
def visibility_revoked(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, actor = Tables(spark, sf_dir), as_customer(spark, sf_dir)
    before = order_policy().can_see("order", tables["order"], tables, actor)
    after = order_policy(neighbours=False).can_see("order", tables["order"], tables, actor)
    return ops.difference(before, after)[0]


@registered("SELECT 'order_'||o_orderkey id FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_nationkey=3")
def affected_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, sf_dir)
    changed = tables["customer"].where("nation = 'nation_3'").select("id")
    return order_policy().affected(changed, "customer/nation", tables).where("entity = 'order'").select("id")


# Facts and the log.


@registered(f"SELECT 'order_'||o_orderkey subject, 'order/status' predicate, o_orderstatus \"value\" FROM orders WHERE o_orderstatus='F' UNION ALL SELECT 'order_'||o_orderkey, 'order/customer', 'customer_'||o_custkey FROM orders WHERE o_orderstatus='F'")
def payload_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).payload_facts(q("order").where("status", "F").select({"customer": True}))


@registered("SELECT 'order_'||o_orderkey subject, unnest(['order/status','order/priority','order/customer']) predicate, unnest([o_orderstatus,o_orderpriority,'customer_'||o_custkey]) \"value\" FROM orders WHERE o_orderstatus='P' AND o_orderpriority='1-URGENT' UNION ALL SELECT DISTINCT 'customer_'||c_custkey, 'customer/nation', 'nation_'||c_nationkey FROM customer JOIN orders ON o_custkey=c_custkey WHERE o_orderstatus='P' AND o_orderpriority='1-URGENT'")
def payload_facts_followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).payload_facts(q("order").where("status", "P").where("priority", "1-URGENT").select({"customer": {"nation": True}}))


@registered(f"SELECT id subject, unnest(['document/lang','document/source']) predicate, unnest([lang,source]) \"value\" FROM {DOC} WHERE lang='en' AND (quality IS NULL OR quality<>1) UNION ALL SELECT id, 'document/quality', quality::varchar FROM {DOC} WHERE lang='en' AND quality IS NOT NULL")
def payload_facts_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negation ships what it was judged by, for every subject that reached it."""
    return plan(spark, sf_dir).payload_facts(q("document").where("lang", "en").where_not("quality", 1).select({"source": True}))


@registered("SELECT 'customer_'||c_custkey subject, 'customer/nation' predicate, 'nation_3' \"value\" FROM customer WHERE c_nationkey=3 UNION ALL SELECT 'order_'||o_orderkey, unnest(['order/customer','order/status','order/priority']), unnest(['customer_'||o_custkey,o_orderstatus,o_orderpriority]) FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_nationkey=3 AND o_orderstatus='F'")
def payload_facts_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = lambda row: {"orders": q("order").where("customer", row).where("status", "F").select({"priority": True})}
    return plan(spark, sf_dir).payload_facts(q("customer").where("nation", {"id": "nation_3"}).select(nested))


@registered("SELECT 'order_'||o_orderkey subject, 'customer_'||o_custkey \"value\" FROM orders WHERE o_orderstatus='P'")
def match_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir)["order"]
    return ops.match_subjects(ops.unpivot(SCHEMA, "order", orders, ["customer"]), orders.where("status = 'P'"), "order/customer").select("subject", F.col("s").alias("value"))


@registered("SELECT '-' op, 'order_'||o_orderkey subject FROM orders WHERE o_orderstatus='P' UNION ALL SELECT '+', 'order_'||o_orderkey FROM orders WHERE o_orderstatus='P'")
def effective_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Setting P and F orders to F, as removals of P and additions of F: only P orders change."""
    orders = Tables(spark, sf_dir)["order"]
    facts = ops.unpivot(SCHEMA, "order", orders, ["status"])
    named = orders.where("status <> 'O'")
    removed = ops.unpivot(SCHEMA, "order", named.withColumn("status", F.lit("P")), ["status"]).withColumn("op", F.lit("-"))
    added = ops.unpivot(SCHEMA, "order", named.withColumn("status", F.lit("F")), ["status"]).withColumn("op", F.lit("+"))
    return ops.effective(facts, removed.unionByName(added)).select("op", "subject")


@registered("SELECT 'order_'||o_orderkey subject FROM orders WHERE o_custkey=7")
def match_p_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = ops.unpivot(SCHEMA, "order", Tables(spark, sf_dir)["order"], ["customer"])
    return ops.match(facts, predicate="order/customer", value={"id": "customer_7"}).select("subject")


@registered("SELECT 'customer_'||c_custkey subject, c_acctbal n FROM customer WHERE c_acctbal>=9000 AND c_acctbal<9500")
def match_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = ops.unpivot(SCHEMA, "customer", Tables(spark, sf_dir)["customer"], ["balance"])
    return ops.match_range(facts, "customer/balance", gte=9000.0, lt=9500.0).select("subject", "n")


@registered("SELECT 'order_'||o_orderkey subject, o_totalprice n FROM orders WHERE o_orderstatus='P' ORDER BY o_totalprice DESC, subject LIMIT 25")
def top_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir)["order"]
    return ops.top_subjects(ops.unpivot(SCHEMA, "order", orders, ["total"]), orders.where("status = 'P'").select("id"), "order/total", 25, descending=True).select("subject", "n")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).read("events").withColumn("user", F.concat(F.lit("user_"), F.col("user_id").cast("string")))


@registered("SELECT 'user_'||user_id id, arg_max(event_type, event_id) last_type FROM events GROUP BY user_id")
def log_fold_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = ops.fold_last_write(_events(spark, sf_dir), "user", "event_type", "event_id")
    return folded.select(F.col("user").alias("id"), F.col("event_type").alias("last_type"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: each adds its type as a tag, every seventh removes it."""
    op = F.when(F.col("event_id") % 7 != 0, "+").otherwise("-")
    return _events(spark, sf_dir).select(F.col("event_id").alias("version"), F.lit(0).alias("seq"), op.alias("op"), F.col("user").alias("subject"), F.lit("user/tag").alias("predicate"), F.lit("s").alias("tag"), F.col("event_type").alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"))


@registered("SELECT 'user_'||user_id id, event_type tag FROM events GROUP BY 1,2 HAVING arg_max(event_id%7<>0, event_id)")
def log_fold_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fold(event_log(spark, sf_dir)).select(F.col("subject").alias("id"), F.col("s").alias("tag"))


@registered("SELECT event_id \"version\", 'user_'||user_id subject, event_type \"value\" FROM events WHERE event_id>9000")
def log_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).where("version > 9000").select("version", "subject", F.col("s").alias("value"))


@registered("SELECT o_orderkey k FROM orders WHERE o_orderkey%3<>0 UNION SELECT c_custkey+1000000 FROM customer")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, sf_dir)
    base = tables.read("orders").select(F.col("o_orderkey").alias("k"))
    added = tables.read("customer").select((F.col("c_custkey") + 1000000).alias("k"))
    return ops.overlay(base, base.where("k % 3 = 0"), added, ["k"])


@registered("SELECT 'customer_7' subject, p predicate FROM (VALUES ('customer/name'),('customer/nation'),('customer/balance'),('customer/segment')) t(p) UNION ALL SELECT 'order_'||o_orderkey, 'order/customer' FROM orders WHERE o_custkey=7")
def delete_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, sf_dir)
    facts = ops.unpivot(SCHEMA, "customer", tables["customer"]).unionByName(ops.unpivot(SCHEMA, "order", tables["order"], ["customer"]))
    return ops.delete_sweep(SCHEMA, facts, "customer_7").select("subject", "predicate")


@registered("SELECT 'order_'||o_orderkey id FROM orders WHERE o_custkey=7")
def required_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that deleting customer 7 would leave without their customer."""
    after = Tables(spark, sf_dir)["order"].withColumn("customer", F.when(F.col("customer") != "customer_7", F.col("customer")))
    return ops.required_violations(SCHEMA, "order", after).select("id")


@registered("SELECT 'customer' entity, count(*) n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'order', count(*) FROM orders")
def entity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = Tables(spark, sf_dir)
    parts = [ops.unpivot(SCHEMA, e, tables[e], SCHEMA.instance_predicates(e)) for e in ("customer", "nation", "order")]
    return ops.entity_counts(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@registered("SELECT 'user_'||user_id id FROM events WHERE event_type IN ('signup','error') GROUP BY user_id HAVING arg_max(event_type,event_id)='signup'")
def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    return ops.present(_events(spark, sf_dir), kind == "signup", kind == "error", "user", "event_id").select(F.col("user").alias("id"))


@registered("SELECT 'user_'||user_id id, date_trunc('hour',ts) AS hour_ts, arg_max(\"value\",event_id) payload FROM events GROUP BY 1,2")
def coalesce_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.coalesced(_events(spark, sf_dir), [F.col("user").alias("id"), F.date_trunc("hour", "ts").alias("hour_ts")], "value", "event_id")


@registered("SELECT 'order_'||o_orderkey id FROM orders WHERE o_orderstatus='P'")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Tables(spark, sf_dir)["order"]
    after = before.withColumn("status", F.when(F.col("status") == "P", "F").otherwise(F.col("status")))
    return ops.changed_rows(before, after)


@registered("SELECT 'order_'||o_orderkey subject, 'order' entity, 2 n FROM orders WHERE o_orderstatus='P'")
def delta_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = Tables(spark, sf_dir)["order"].where("status = 'P'")
    return ops.by_subject(ops.unpivot(SCHEMA, "order", orders, ["status", "total"])).select("subject", "entity", F.size("predicates").alias("n"))


@registered(
    "SELECT 'user_'||user_id actor, 'order_'||o_orderkey subject FROM (SELECT DISTINCT user_id FROM events WHERE user_id<5) JOIN orders ON o_custkey=user_id WHERE o_orderstatus='P'"
)
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit: every P order becomes F. Each of five readers gets the changed orders of its own customer."""
    return _sent_to(spark, sf_dir, _events(spark, sf_dir).where("user_id < 5"))


@registered("SELECT 'user_'||user_id actor, 'order_'||o_orderkey subject FROM (SELECT DISTINCT user_id FROM events) JOIN orders ON o_custkey=user_id WHERE o_orderstatus='P'")
def fan_out_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same commit, to every user of the events."""
    return _sent_to(spark, sf_dir, _events(spark, sf_dir).dropDuplicates(["user_id"]))


@registered("SELECT DISTINCT 'user_'||user_id actor, 'order_'||o_orderkey subject FROM events JOIN (SELECT o_custkey k, o_orderkey FROM orders WHERE o_orderstatus='P' UNION SELECT o_orderkey, o_orderkey FROM orders WHERE o_orderstatus='P') ON k=user_id")
def fan_out_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same commit under a declared rule of two alternatives: one's customer's orders, and the order one watches."""
    own, watched = ({"equals": ["fields.customer", "actor.customer"]}, {"equals": ["subject", "actor.watched"]})
    declared = {e: {"read": True} for e in SCHEMA.entities} | {"order": {"read": {"anyOf": [own, watched]}}}
    users = _events(spark, sf_dir).dropDuplicates(["user_id"])
    return _sent_to(spark, sf_dir, users, compile_policy(SCHEMA, declared))


def _sent_to(spark: SparkSession, sf_dir: str, users: DataFrame, policy: Policy | None = None) -> DataFrame:
    from sievelog.streaming.live import fan_out as sent

    before = {"order": Tables(spark, sf_dir)["order"]}
    after = {"order": before["order"].withColumn("status", F.when(F.col("status") == "P", "F").otherwise(F.col("status")))}
    number = F.col("user_id").cast("string")
    readers = users.select(F.col("user").alias("id"), F.concat(F.lit("customer_"), number).alias("customer"), F.concat(F.lit("order_"), number).alias("watched"))
    rules = {e: EntityPolicy(read=anyone) for e in SCHEMA.entities} | {"order": EntityPolicy(read=lambda c: c["customer"] == c.actor("customer"))}
    return sent(policy or Policy(SCHEMA, rules), SCHEMA, "order", before, after, readers, changed_rows(spark, sf_dir)).select("actor", "subject").distinct()


# Live reads, pending writes and their checks.


@registered("SELECT 'order/'||p predicate, count(*) n, p<>'priority' runs FROM orders, (VALUES ('customer'),('status'),('total'),('priority')) t(p) GROUP BY p UNION ALL SELECT 'user/tag', count(*), false FROM events")
def live_rerun_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each predicate of the log's users and of orders: whether a live query on orders runs again."""
    watched = sorted(q("order").where("status", "F").order_by("total").select({"customer": {"name": True}}).predicates)
    facts = ops.unpivot(SCHEMA, "order", Tables(spark, sf_dir)["order"]).unionByName(event_log(spark, sf_dir).select(*[c.split(" ")[0] for c in FACTS.split(", ")]))
    touched = facts.groupBy("predicate").agg(F.count("*").alias("n"))
    return touched.select("predicate", "n", F.arrays_overlap(F.array("predicate"), F.array(*[F.lit(p) for p in watched])).alias("runs"))


_TAGS = "SELECT 'user_'||user_id id, event_type tag FROM events GROUP BY 1,2 HAVING arg_max(event_id%7<>0, event_id)"


@registered(f"WITH t AS ({_TAGS}) SELECT * FROM t UNION SELECT DISTINCT id, 'seen' FROM t WHERE id NOT IN (SELECT id FROM t WHERE tag='signup')")
def optimistic_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed tags of users under two pending layers: one adds "seen" for all, one takes it back for signups."""
    from sievelog.streaming.live import optimistic

    tags = log_fold_set(spark, sf_dir)
    one = tags.select(F.lit("+").alias("op"), "id", F.lit("seen").alias("tag")).distinct()
    two = tags.where("tag = 'signup'").select(F.lit("-").alias("op"), "id", F.lit("seen").alias("tag"))
    return optimistic(tags, [one, two], ["id", "tag"])


@registered(
    "WITH f AS (SELECT 'user_'||user_id subject, event_type \"value\", arg_max(event_id%7<>0, event_id) now, bool_or(event_id%7<>0) AND substr(md5('user_'||user_id),1,1)<'8' was FROM events GROUP BY user_id, event_type) SELECT CASE WHEN now THEN '+' ELSE '-' END op, subject, \"value\" FROM f WHERE now<>was"
)
def outbox_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as queued operations, replayed in order over the tags that half of the users hold."""
    from sievelog.operators.writes import compile_bulk

    log = event_log(spark, sf_dir)
    fact = ["subject", "predicate", "tag", "s", "n", "b"]
    queued = log.select(F.col("version").alias("seq"), F.when(F.col("op") == "+", "add").otherwise("remove").alias("kind"), *fact)
    held = log.where("op = '+'").select(*fact).distinct().where(F.substring(F.md5("subject"), 1, 1) < "8")
    return compile_bulk(queued, held).select("op", "subject", F.col("s").alias("value"))


@registered("SELECT 'order_'||o_orderkey id, 'update' verb, 'status' field, o_custkey=7 ok FROM orders WHERE o_orderstatus='P'")
def write_check_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer 7 sets every P order to F: allowed on its own orders, and only as an update."""
    rules = {e: EntityPolicy(read=anyone) for e in SCHEMA.entities}
    rules["order"] = EntityPolicy(read=anyone, update=lambda c: c["customer"] == c.actor("id"), overrides={"status": {"write": lambda c: (c["customer"] == c.actor("id")) & (c.after("status") == "F")}})
    tables = Tables(spark, sf_dir)
    before = tables["order"]
    after = before.withColumn("status", F.when(F.col("status") == "P", "F").otherwise(F.col("status")))
    touched = changed_rows(spark, sf_dir).select("id", F.lit("status").alias("field"))
    return Policy(SCHEMA, rules).write_verdicts("order", before, after, before.select("id").limit(0), touched, tables, tables, {"id": "customer_7"})


@registered(f"SELECT *, '{SCHEMA.generation}' generation FROM (SELECT 'customer' entity, count(*) n FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'order', count(*) FROM orders)")
def schema_generation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each entity with the generation that a reader must know."""
    return entity_counts(spark, sf_dir).withColumn("generation", F.lit(SCHEMA.generation))


@registered("SELECT 'user_'||user_id id, arg_max(event_type, event_id) last_type FROM events GROUP BY user_id")
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each user through Structured Streaming, a file a micro-batch."""
    from sievelog.sources.scratch import scratch_path
    from sievelog.streaming.live import fold_stream, log_stream

    events = _events(spark, sf_dir).select(F.col("user").alias("id"), F.col("event_type").alias("last_type"), F.col("event_id").alias("version"))
    path = scratch_path(spark, "stream-log")
    events.repartition(3, "version").write.parquet(path)
    stream = log_stream(spark, path, "id string, last_type string, version long")
    return fold_stream(stream, scratch_path(spark, "stream-state"), scratch_path(spark, "stream-offsets"), "id", "last_type", "version").select("id", "last_type")


# Shapes of selections.

simple("after_cursor_desc", q("order").order_by("total", "desc").after(100000.0, "order_5").limit(50).select({"total": True}), f"SELECT {ORDER}, o_totalprice total FROM orders WHERE o_totalprice<100000 OR (o_totalprice=100000 AND 'order_'||o_orderkey>'order_5') ORDER BY o_totalprice DESC, id LIMIT 50")
simple("id_in_selection", q("nation").select({"id": True, "name": True}), "SELECT 'nation_'||n_nationkey id, n_name name FROM nation")


@registered("SELECT 'part_'||p_partkey id, p_name words FROM part")
def select_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of several values is an array."""
    return plan(spark, sf_dir).run(q("part").select({"word": True})).select("id", F.array_join("word", " ").alias("words"))


@registered("SELECT id, part_id, brand, row_number() OVER (PARTITION BY id ORDER BY part_id)::INTEGER place FROM (SELECT DISTINCT 'supplier_'||l_suppkey id, 'part_'||l_partkey part_id, p_brand brand FROM lineitem JOIN part ON l_partkey=p_partkey)")
def nested_multi_ref_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Followed references in one array for each row, in the order of their ids."""
    rows = plan(spark, sf_dir).run(q("supplier").select({"part": {"brand": True}})).select("id", F.posexplode("part").alias("place", "p"))
    return rows.select("id", F.col("p.id").alias("part_id"), F.col("p.brand").alias("brand"), (F.col("place") + 1).alias("place"))


@registered("SELECT 'customer_'||o_custkey id, 'order_'||o_orderkey order_id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, 'order_'||o_orderkey))::INTEGER place FROM orders")
def nested_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of rows inside a parent's array."""
    query = q("customer").select(lambda row: {"orders": q("order").where("customer", row).order_by("total", "desc")})
    rows = plan(spark, sf_dir).run(query).select("id", F.posexplode("orders").alias("place", "o"))
    return rows.select("id", F.col("o.id").alias("order_id"), (F.col("place") + 1).alias("place"))


@registered("SELECT 'nation_'||n_nationkey id, 'customer_'||c_custkey customer_id, (row_number() OVER (PARTITION BY n_nationkey ORDER BY 'customer_'||c_custkey))::INTEGER place FROM nation JOIN customer ON c_nationkey=n_nationkey")
def nested_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without an order, the rows inside an array go by id."""
    query = q("nation").select(lambda row: {"customers": q("customer").where("nation", row)})
    rows = plan(spark, sf_dir).run(query).select("id", F.posexplode("customers").alias("place", "c"))
    return rows.select("id", F.col("c.id").alias("customer_id"), (F.col("place") + 1).alias("place"))


@registered(f"SELECT {ORDER}, o_totalprice total FROM orders WHERE o_orderstatus<>'P'")
def whole_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack a required field which is read are no answers: here the P orders have lost their total."""
    orders = Tables(spark, sf_dir)["order"].withColumn("total", F.when(F.col("status") != "P", F.col("total")))
    return Planner(SCHEMA, {"order": orders}).run(q("order").select({"total": True}))


@registered("SELECT 'customer_'||c_custkey id, c_name name, 'nation_'||c_nationkey nation, c_acctbal balance, c_mktsegment segment FROM customer WHERE c_mktsegment='BUILDING'")
def query_as_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query given as plain data; without a selection every field is selected."""
    from sievelog.plans.query import from_data

    rows = plan(spark, sf_dir).run(from_data(SCHEMA, {"entity": "customer", "where": {"segment": "BUILDING"}}))
    return rows.withColumn("nation", F.col("nation.id"))


# Facts in the log's form.


@registered("SELECT 'order_'||o_orderkey subject, CASE o_orderstatus WHEN 'P' THEN 'F' ELSE o_orderstatus END \"value\" FROM orders")
def overlay_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status facts with P replaced by F; a fact holds nulls in the places of other kinds."""
    from sievelog.functions.values import FACT

    orders = Tables(spark, sf_dir)["order"]
    facts = ops.unpivot(SCHEMA, "order", orders, ["status"])
    added = ops.unpivot(SCHEMA, "order", orders.where("status = 'P'").withColumn("status", F.lit("F")), ["status"])
    return ops.overlay(facts, facts.where("s = 'P'"), added, FACT).select("subject", F.col("s").alias("value"))


@registered("SELECT 'order_'||o_orderkey id, 'customer_'||o_custkey customer, o_orderstatus status, o_totalprice total, o_orderpriority priority FROM orders")
def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of orders, and the rows that they make again."""
    return ops.widen(SCHEMA, "order", ops.unpivot(SCHEMA, "order", Tables(spark, sf_dir)["order"]))


@registered("SELECT 'order/'||unnest(['customer','status','total','priority']) predicate FROM orders WHERE o_orderkey=42")
def match_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.match(ops.unpivot(SCHEMA, "order", Tables(spark, sf_dir)["order"]), subject="order_42").select("predicate")


@registered("SELECT 'order_'||o_orderkey subject, o_totalprice n FROM orders WHERE o_totalprice>100000 OR (o_totalprice=100000 AND 'order_'||o_orderkey>'order_5') ORDER BY o_totalprice, subject LIMIT 25")
def top_subjects_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = ops.unpivot(SCHEMA, "order", Tables(spark, sf_dir)["order"], ["total"])
    return ops.top_subjects(facts, None, "order/total", 25, after=(100000.0, "order_5")).select("subject", "n")


@registered("SELECT 'order_'||o_orderkey subject, unnest(['order/status','order/total']) predicate FROM orders WHERE o_orderstatus='O'")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache of F and O orders may drop once only the F orders are watched."""
    planner = plan(spark, sf_dir)
    payload = lambda *status: planner.payload_facts(q("order").where("status", status).select({"total": True}))
    return ops.evictable(payload("F", "O"), payload("F")).select("subject", "predicate")


def _committed(spark: SparkSession, sf_dir: str):
    """A workspace whose first version has every order's status and total and whose second turns P into F."""
    from sievelog.operators.policy import Policy as Rules
    from sievelog.operators.writes import Engine
    from sievelog.sources.scratch import scratch_path
    from sievelog.sources.warehouse import Warehouse

    rules = {e: EntityPolicy(read=anyone) for e in SCHEMA.entities}
    engine = Engine(Warehouse(spark, scratch_path(spark, "workspace")), SCHEMA, Rules(SCHEMA, rules))
    orders = Tables(spark, sf_dir)["order"]
    facts = lambda rows, op, names: ops.unpivot(SCHEMA, "order", rows, names).withColumn("op", F.lit(op))
    engine.commit(facts(orders, "+", ["status", "total"]), "user_1")
    old = orders.where("status = 'P'")
    engine.commit(facts(old, "-", ["status"]).unionByName(facts(old.withColumn("status", F.lit("F")), "+", ["status"])), "user_2")
    return engine


@registered("SELECT 2::BIGINT \"version\", unnest(['-','+']) op, 'order_'||o_orderkey subject, unnest(['P','F']) \"value\", 'user_2' actor FROM orders WHERE o_orderstatus='P'")
def log_entries_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes after version 1 of a workspace on storage."""
    return _committed(spark, sf_dir).store.entries_since(1).select("version", "op", "subject", F.col("s").alias("value"), "actor")


@registered("SELECT 'order_'||o_orderkey id, CASE o_orderstatus WHEN 'P' THEN 'F' ELSE o_orderstatus END status, o_totalprice total FROM orders")
def state_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a workspace whose log is folded into its base."""
    store = _committed(spark, sf_dir).store
    store.compact(2)
    return ops.widen(SCHEMA, "order", store.facts()).select("id", "status", "total")


@registered("SELECT 'order_'||o_orderkey id, o_orderstatus status, o_totalprice total FROM orders")
def state_at_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.widen(SCHEMA, "order", _committed(spark, sf_dir).store.facts(1)).select("id", "status", "total")


def _own_total() -> Policy:
    """Customers see all orders, but totals only of their own."""
    rules = {e: EntityPolicy(read=anyone) for e in SCHEMA.entities}
    rules["order"] = EntityPolicy(read=anyone, overrides={"total": {"read": lambda c: c["customer"] == c.actor("id")}})
    return Policy(SCHEMA, rules)


@registered("SELECT 'order_'||o_orderkey subject, 'order/status' predicate FROM orders WHERE o_orderstatus='P' UNION ALL SELECT 'order_'||o_orderkey, 'order/total' FROM orders WHERE o_orderstatus='P' AND o_custkey=7")
def backlog_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of status and total of the P orders, as customer 7 gets them after an absence: by field."""
    from sievelog.streaming.live import readable_entries

    tables = Tables(spark, sf_dir)
    entries = ops.unpivot(SCHEMA, "order", tables["order"].where("status = 'P'"), ["status", "total"])
    frames = {e: tables[e] if e == "order" else spark.createDataFrame([], SCHEMA.struct_type(e)) for e in SCHEMA.entities}
    return readable_entries(_own_total(), SCHEMA, entries, frames, {"id": "customer_7"}).select("subject", "predicate")


@registered("SELECT 'customer_'||c_custkey id FROM customer WHERE c_nationkey=3 UNION ALL SELECT 'order_'||o_orderkey FROM orders JOIN customer ON o_custkey=c_custkey WHERE c_nationkey=3")
def repair_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader must check again when the customers of a nation have changed it while it was away."""
    from sievelog.streaming.live import held_subjects

    tables = Tables(spark, sf_dir)
    entries = ops.unpivot(SCHEMA, "customer", tables["customer"].where("nation = 'nation_3'"), ["nation"])
    return held_subjects(order_policy(), entries, tables, tables)


@registered("SELECT 'order_'||o_orderkey id, 'create' verb, o_custkey=7 ok FROM orders WHERE o_orderstatus='P' UNION ALL SELECT 'order_'||o_orderkey, 'delete', o_orderpriority='5-LOW' FROM orders WHERE o_orderstatus='F'")
def write_check_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P orders are created, judged by what they become; F orders deleted, judged by what they were."""
    rules = {e: EntityPolicy(read=anyone) for e in SCHEMA.entities}
    rules["order"] = EntityPolicy(read=anyone, create=lambda c: c["customer"] == c.actor("id"), delete=lambda c: c["priority"] == "5-LOW")
    tables = Tables(spark, sf_dir)
    every = tables["order"]
    before, after = every.where("status <> 'P'"), every.where("status <> 'F'")
    touched = every.where("status <> 'O'").select("id", F.lit("total").alias("field"))
    gone = every.where("status = 'F'").select("id")
    verdicts = Policy(SCHEMA, rules).write_verdicts("order", before, after, gone, touched, tables, tables, {"id": "customer_7"})
    return verdicts.select("id", "verb", "ok")


@registered("SELECT DISTINCT 'supplier_'||l_suppkey id FROM lineitem JOIN part ON l_partkey=p_partkey WHERE p_brand='Brand#11'")
def policy_path_through_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that reads a field of every row that a list refers to."""
    rules = {e: EntityPolicy(read=anyone) for e in SCHEMA.entities}
    rules["supplier"] = EntityPolicy(read=lambda c: F.array_contains(c["part.brand"], "Brand#11"), fields=("part.brand",))
    return plan(spark, sf_dir, Policy(SCHEMA, rules), {"id": "user_0"}).run(q("supplier"))


@registered("SELECT user_id, event_type payload FROM events WHERE event_type='signup' OR 'order_'||event_id IN (SELECT 'order_'||o_orderkey FROM orders WHERE o_custkey=7)")
def broadcast_to_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlogged messages: signups are about nothing, others about the order of the event's number, which only its customer sees."""
    from sievelog.streaming.live import broadcast_visible

    tables = Tables(spark, sf_dir)
    about = F.when(F.col("event_type") != "signup", F.concat(F.lit("order_"), F.col("event_id").cast("string")))
    messages = tables.read("events").select(about.alias("about"), F.col("event_type").alias("payload"), "user_id")
    seen = order_policy(neighbours=False).can_see("order", tables["order"], tables, {"id": "customer_7"})
    return broadcast_visible(messages, seen).select("user_id", "payload")
