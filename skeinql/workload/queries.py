"""The reference workload's shapes on the TPC-H-like tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinql.functions import calls
from skeinql.functions import scalars as S
from skeinql.operators.recursion import descendants, fixpoint, kept, shared_folder, transitive_closure
from skeinql.operators.types import Hierarchy, TypeIndex, type_case, type_filter
from skeinql.plans.index import Indexes
from skeinql.plans.query import Equals, Query, every, odd, product, some, total
from skeinql.sources.collections import exps, int_range, literal, table
from skeinql.streaming import views

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}

#: Types of events as a hierarchy: what a user looks at, what earns, and what fails.
EVENTS = Hierarchy([("view", "interaction"), ("click", "interaction"), ("signup", "conversion"), ("purchase", "conversion"), ("interaction", "action"), ("conversion", "action"), ("action", "event"), ("error", "event")])
_EDGES = "(VALUES ('view','interaction'),('click','interaction'),('signup','conversion'),('purchase','conversion'),('interaction','action'),('conversion','action'),('action','event'),('error','event'))"


def query(name: str, sql: str | None) -> Callable[[Run], Run]:
    def add(f: Run) -> Run:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def cents(c: str) -> Column:
    """Exact sums, whatever their order."""
    return F.col(c).cast("decimal(18,2)")


#: What a session has stored of a folder's tables: the nested table, the indexes.
_STORED: dict[tuple, object] = {}


def once(spark: SparkSession, sf: str, name: str, make: Callable[[], object]) -> object:
    """make(), once in a session for each folder of tables: stored structures serve many queries."""
    at = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), sf, name
    if at not in _STORED:
        _STORED[at] = make()
    return _STORED[at]


def nested_orders(spark: SparkSession, sf: str) -> Query:
    """Orders with their items as an array, as the reference's records have them: stored once, so that
    a query is the scan, unnest and filter that it stands for."""

    def make() -> DataFrame:
        items = table(spark, sf, "lineitem").df.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"))).alias("items"))
        return kept(table(spark, sf, "orders").df.join(items, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey"))

    return Query(once(spark, sf, "nested_orders", make), name="nested_orders")


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# The flagship: customers as books, a segment as publisher, orders as authors


def records(customers: Query, orders: Query) -> Query:
    count = F.count("*").over(_by("c_custkey")) - 1
    return customers.filter(Equals("c_mktsegment", "BUILDING")).join(orders, "c_custkey", "o_custkey").map("c_name", order_name=F.concat("o_orderstatus", F.lit(" "), F.col("o_orderkey").cast("string")), others=count)


def _by(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(*columns)


def title_filter(q: Query, keyword: str) -> Query:
    return q.filter(F.col("c_name").contains(keyword)).map("c_name", "order_name")


_RECORDS = "SELECT c_name, o_orderstatus || ' ' || o_orderkey AS order_name, count(*) OVER (PARTITION BY c_custkey) - 1 AS others FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING'"


@query("flagship_records", _RECORDS)
def flagship(spark, sf):
    return records(table(spark, sf, "customer"), table(spark, sf, "orders")).df


@query("modular_composed", f"SELECT c_name, order_name FROM ({_RECORDS}) WHERE contains(c_name, '7')")
def modular_composed(spark, sf):
    return title_filter(records(table(spark, sf, "customer"), table(spark, sf, "orders")), "7").df


@query("modular_inlined", SQL["modular_composed"])
def modular_inlined(spark, sf):
    q = table(spark, sf, "customer").filter(Equals("c_mktsegment", "BUILDING"), F.col("c_name").contains("7")).join(table(spark, sf, "orders"), "c_custkey", "o_custkey")
    return q.map("c_name", order_name="concat(o_orderstatus, ' ', o_orderkey)").df


@query("parameterised_query", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'MACHINERY' AND contains(c_name, '1')")
def parameterised(spark, sf):
    def by(segment: str, keyword: str) -> Query:
        return table(spark, sf, "customer").filter(Equals("c_mktsegment", segment), F.col("c_name").contains(keyword)).join(table(spark, sf, "orders"), "c_custkey", "o_custkey").map("c_custkey", "o_orderkey")

    return by("MACHINERY", "1").df


# Sources


@query("literal_set", "SELECT DISTINCT a, b FROM (VALUES (1, 'x'), (1, 'x'), (2, NULL), (2, NULL)) t(a, b)")
def literal_set(spark, sf):
    return literal(spark, [(1, "x"), (1, "x"), (2, None), (2, None)], "a int, b string", kind="set").df


@query("literal_computed", "SELECT unnest([1 + 1, 3, 2 * 2]) AS value")
def literal_computed(spark, sf):
    return exps(spark, [F.lit(1) + 1, F.lit(3), F.lit(2) * 2]).df


@query("ranges_dependent", "SELECT i::INT AS i, j::INT AS j, k::INT AS k FROM range(1, 10) a(i), range(1, i) b(j), range(1, j) c(k)")
def ranges_dependent(spark, sf):
    q = int_range(spark, 1, 10, column="i").to_bag()
    return q.flat_map("j", S.int_range(F.lit(1), F.col("i")), "i").flat_map("k", S.int_range(F.lit(1), F.col("j")), "i", "j").df


# Projection, filter, unnest


@query("map_filter_hoist", "SELECT n_name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_regionkey < 2 AND c_acctbal > 0")
def map_filter_hoist(spark, sf):
    return table(spark, sf, "nation").join(table(spark, sf, "customer"), "n_nationkey", "c_nationkey").filter("n_regionkey < 2", "c_acctbal > 0").map("n_name", "c_custkey").df


@query("map_set", "SELECT DISTINCT c_mktsegment, c_nationkey % 5 AS g FROM customer")
def map_set(spark, sf):
    return table(spark, sf, "customer", kind="set").map("c_mktsegment", g="c_nationkey % 5").df


@query("map_of_map_keeps_keys", "SELECT o_custkey % 7 AS k, count(*) AS n FROM orders GROUP BY 1")
def map_of_map(spark, sf):
    return table(spark, sf, "orders").group(F.count("*").alias("n"), k="o_custkey % 7").df


@query("flatmap_unnest", "SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 30")
def flatmap_unnest(spark, sf):
    return nested_orders(spark, sf).unnest("items", "i").filter("i.l_quantity > 30").map("o_orderkey", "i.l_partkey", "i.l_quantity").df


@query("collect_partial", "SELECT o_totalprice - 200000 AS over FROM orders WHERE o_totalprice > 200000")
def collect_partial(spark, sf):
    return table(spark, sf, "orders").collect(F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice") - 200000), "over").df


@query("let_binding", "SELECT p_partkey, round(p_retailprice * 1.1, 2) AS price FROM part WHERE round(p_retailprice * 1.1, 2) > 900")
def let_binding(spark, sf):
    return table(spark, sf, "part").let("price", "round(p_retailprice * cast(1.1 as double), 2)").filter("price > 900").map("p_partkey", "price").df


@query("flatten_unzip", "SELECT l_orderkey AS k, list_sum(list(l_partkey))::BIGINT AS parts, list_sum(list(l_suppkey))::BIGINT AS supps FROM lineitem GROUP BY 1")
def flatten_unzip(spark, sf):
    q = table(spark, sf, "lineitem").group_by_sel(F.struct(F.col("l_partkey").alias("_1"), F.col("l_suppkey").alias("_2")), "pairs", k="l_orderkey")
    return q.let("z", S.unzip("pairs")).map("k", parts=S.array_sum("z._1"), supps=S.array_sum("z._2")).df


# Joins and quantifiers


_EQUI = "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey"


@query("equi_join_explicit", _EQUI)
def equi_join(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), "c_custkey", "o_custkey").map("c_custkey", "o_orderkey").df


@query("equi_join_comprehension", _EQUI)
def equi_comprehension(spark, sf):
    return table(spark, sf, "customer").product(table(spark, sf, "orders")).filter("c_custkey = o_custkey").map("c_custkey", "o_orderkey").df


@query("cartesian_theta", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey < n_regionkey")
def cartesian_theta(spark, sf):
    return table(spark, sf, "region").theta(table(spark, sf, "nation"), "r_regionkey < n_regionkey").map("r_name", "n_name").df


@query("cartesian_product", "SELECT r_name, n_name FROM region, nation")
def cartesian_product(spark, sf):
    return table(spark, sf, "region").product(table(spark, sf, "nation")).map("r_name", "n_name").df


_NULLABLE = "(SELECT CASE WHEN {k} % 3 > 0 THEN {k} % 3 END AS k, count(*) AS {n} FROM {t} GROUP BY 1)"


@query("null_safe_join", f"SELECT a.k AS k, na, nb FROM {_NULLABLE.format(k='user_id', n='na', t='events')} a JOIN {_NULLABLE.format(k='event_id', n='nb', t='events')} b ON a.k IS NOT DISTINCT FROM b.k")
def null_safe_join(spark, sf):
    side = lambda c, n, k: table(spark, sf, "events").group(F.count("*").alias(n), **{k: f"case when {c} % 3 > 0 then {c} % 3 end"})
    return side("user_id", "na", "k").join(side("event_id", "nb", "kb"), "k", "kb").map("k", "na", "nb").df


@query("exists_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def exists_semi(spark, sf):
    return table(spark, sf, "customer").exists(table(spark, sf, "orders").filter("o_totalprice > 250000"), "o_custkey = c_custkey").map("c_custkey").df


@query("forall_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice > 20000)")
def forall_anti(spark, sf):
    return table(spark, sf, "customer").forall(table(spark, sf, "orders"), "o_totalprice > 20000", "o_custkey = c_custkey").map("c_custkey").df


@query("membership_semi", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def membership_semi(spark, sf):
    return table(spark, sf, "part").member("p_partkey", table(spark, sf, "lineitem").filter("l_returnflag = 'R'"), "l_partkey").map("p_partkey").df


@query("not_member_anti", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def not_member_anti(spark, sf):
    return table(spark, sf, "part").not_member("p_partkey", table(spark, sf, "lineitem").filter("l_quantity > 45"), "l_partkey").map("p_partkey").df


@query("option_lookup_default", "SELECT c_custkey, coalesce(n, -1) AS n_orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def option_lookup(spark, sf):
    counts = table(spark, sf, "orders").group(F.count("*").alias("n"), k="o_custkey")
    return table(spark, sf, "customer").lookup(counts, "c_custkey", "k", n="n").map("c_custkey", n_orders=S.get_or_else("n", F.lit(-1).cast("long"))).df


# Sets and bags


@query("union_bag", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_bag(spark, sf):
    return table(spark, sf, "customer").map(k="c_nationkey").union(table(spark, sf, "supplier").map(k="s_nationkey")).df


@query("union_set", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_set(spark, sf):
    return table(spark, sf, "customer").map(k="c_nationkey").to_set().union(table(spark, sf, "supplier").map(k="s_nationkey")).df


@query("append_one", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NOWHERE'")
def append_one(spark, sf):
    return table(spark, sf, "region").map("r_regionkey", "r_name").append(99, "NOWHERE").df


@query("set_difference", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_difference(spark, sf):
    return table(spark, sf, "part").map(k="p_partkey").difference(table(spark, sf, "lineitem").filter("l_quantity > 45").map(k="l_partkey")).df


@query("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf):
    return table(spark, sf, "customer").map(k="c_nationkey").intersect(table(spark, sf, "supplier").map(k="s_nationkey")).df


@query("bag_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def bag_intersect(spark, sf):
    return table(spark, sf, "customer").map(k="c_nationkey").bag_intersect(table(spark, sf, "supplier").map(k="s_nationkey")).df


@query("bag_difference", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def bag_difference(spark, sf):
    return table(spark, sf, "customer").map(k="c_nationkey").bag_difference(table(spark, sf, "supplier").map(k="s_nationkey")).df


@query("bag_counts", "SELECT o_orderpriority, o_orderstatus, count(*) AS mult FROM orders GROUP BY ALL")
def bag_counts(spark, sf):
    return table(spark, sf, "orders").map("o_orderpriority", "o_orderstatus").counted().df


# Groups


@query("index_by_size", "SELECT o_custkey AS k, count(*)::INT AS size FROM orders GROUP BY 1")
def index_by_size(spark, sf):
    return table(spark, sf, "orders").index_by(k="o_custkey").map("k", size=F.size("elements")).df


@query("group_by_sel", "SELECT l_suppkey AS k, count(DISTINCT l_partkey)::INT AS parts FROM lineitem GROUP BY 1")
def group_by_sel(spark, sf):
    return table(spark, sf, "lineitem").map("l_suppkey", "l_partkey").to_set().group_by_sel("l_partkey", "parts", k="l_suppkey").map("k", parts=F.size("parts")).df


@query("group_fused", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS qty, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS price FROM lineitem GROUP BY ALL")
def group_fused(spark, sf):
    return table(spark, sf, "lineitem").group(F.count("*").alias("n"), F.sum(cents("l_quantity")).cast("double").alias("qty"), F.sum(cents("l_extendedprice")).cast("double").alias("price"), l_returnflag="l_returnflag", l_linestatus="l_linestatus").df


@query("fold_sum_zero", "SELECT coalesce(sum(o_custkey), 0)::BIGINT AS none, (SELECT sum(o_custkey)::BIGINT FROM orders) AS every FROM orders WHERE o_totalprice < 0")
def fold_sum_zero(spark, sf):
    o = table(spark, sf, "orders")
    return o.filter("o_totalprice < 0").fold(total("o_custkey").alias("none")).product(o.fold(total("o_custkey").alias("every"))).df


@query("fold_product", "SELECT n_regionkey AS k, product(n_nationkey + 1)::BIGINT AS p, (SELECT coalesce(product(n_nationkey), 1)::BIGINT FROM nation WHERE n_nationkey < 0) AS none FROM nation GROUP BY 1")
def fold_product(spark, sf):
    n = table(spark, sf, "nation")
    return n.group(product(F.col("n_nationkey") + 1).cast("long").alias("p"), k="n_regionkey").product(n.filter("n_nationkey < 0").fold(product("n_nationkey").cast("long").alias("none"))).df


@query("fold_left_array", "SELECT o_custkey AS k, (sum(o_orderkey % 10) + count(*))::BIGINT AS folded FROM orders GROUP BY 1")
def fold_left_array(spark, sf):
    q = table(spark, sf, "orders").group_by_sel("o_orderkey % 10", "digits", k="o_custkey")
    return q.map("k", folded=S.fold_left("digits", F.lit(0).cast("long"), lambda a, x: a + x + 1)).df


@query("is_empty_per_key", "SELECT c_custkey, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS empty FROM customer")
def is_empty_per_key(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    on = "o_custkey = c_custkey"
    return c.exists(o, on).map("c_custkey", empty=F.lit(False)).union(c.not_exists(o, on).map("c_custkey", empty=F.lit(True))).df


@query("head_last_of_group", "SELECT o_custkey AS k, min(o_orderkey) AS head, max(o_orderkey) AS last FROM orders GROUP BY 1")
def head_last(spark, sf):
    q = table(spark, sf, "orders").group_by_sel("o_orderkey", "keys", k="o_custkey")
    return q.map("k", head=S.head_option(S.sorted_("keys")), last=S.last_option(S.sorted_("keys"))).df


@query("whole_size", "SELECT count(*) AS size FROM lineitem")
def whole_size(spark, sf):
    return table(spark, sf, "lineitem").size().df


# Sequences


@query("zip_with_index", "SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT - 1 AS index FROM lineitem")
def zip_with_index(spark, sf):
    return table(spark, sf, "lineitem").to_seq("l_linenumber", "l_partkey", "l_suppkey").zip_with_index("l_orderkey").map("l_orderkey", "l_partkey", "index").df


def _user_events(spark, sf) -> Query:
    return table(spark, sf, "events").map("event_id", "user_id", "event_type", "ts").to_seq("ts", "event_id")


_LEAD = "SELECT *, lead(event_type) OVER w AS t1, lead(event_type, 2) OVER w AS t2, lead(event_id) OVER w AS e1 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query("sliding2_pattern", f"SELECT user_id, event_id, e1 AS next_id FROM ({_LEAD}) WHERE event_type = 'click' AND t1 = 'purchase'")
def sliding2(spark, sf):
    w = _user_events(spark, sf).sliding(2, "user_id").filter("size(window) = 2", "window[0].event_type = 'click'", "window[1].event_type = 'purchase'")
    return w.map("user_id", event_id="window[0].event_id", next_id="window[1].event_id").df


@query("sliding3_pattern", f"SELECT user_id, event_id FROM ({_LEAD}) WHERE event_type IN ('view', 'click') AND t1 IN ('view', 'click') AND t2 IN ('signup', 'purchase')")
def sliding3(spark, sf):
    kind = lambda i, name: EVENTS.is_instance(F.col("window")[i]["event_type"], name)
    w = _user_events(spark, sf).sliding(3, "user_id").filter("size(window) = 3").filter(kind(0, "interaction"), kind(1, "interaction"), kind(2, "conversion"))
    return w.map("user_id", event_id="window[0].event_id").df


@query("sliding_arrays", "SELECT l_orderkey AS k, greatest(count(*) - 2, 1)::INT AS windows FROM lineitem GROUP BY 1")
def sliding_arrays(spark, sf):
    return table(spark, sf, "lineitem").group_by_sel("l_partkey", "parts", k="l_orderkey").map("k", windows=F.size(S.sliding("parts", 3))).df


# Types


@query("type_filter", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def type_filter_(spark, sf):
    return type_filter(table(spark, sf, "events"), "event_type", "purchase", EVENTS).map("event_id", "user_id").df


@query("subtype_filter", "SELECT event_id FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase')")
def subtype_filter(spark, sf):
    return type_filter(table(spark, sf, "events"), "event_type", "action", EVENTS).map("event_id").df


@query("type_case", "SELECT DISTINCT CASE WHEN event_type = 'purchase' AND value > 50 THEN 'big ' || user_id WHEN event_type IN ('purchase', 'signup') THEN 'conversion' WHEN event_type = 'error' THEN 'error ' || user_id % 10 END AS value FROM events WHERE event_type IN ('purchase', 'signup', 'error')")
def type_case_(spark, sf):
    user = F.col("user_id")
    return type_case(table(spark, sf, "events"), "event_type", EVENTS, ("purchase", F.col("value") > 50, F.concat(F.lit("big "), user.cast("string"))), ("conversion", F.lit(True), F.lit("conversion")), ("error", F.lit(True), F.concat(F.lit("error "), (user % 10).cast("string")))).df


@query("if_instance_of", "SELECT event_id, CASE WHEN event_type IN ('signup', 'purchase') THEN value END AS earned FROM events")
def if_instance_of(spark, sf):
    return table(spark, sf, "events").map("event_id", earned=EVENTS.if_instance(F.col("event_type"), "conversion", F.col("value"))).df


def type_index(spark: SparkSession, sf: str) -> TypeIndex:
    make = lambda: TypeIndex(table(spark, sf, "events").map("event_id", "event_type"), "event_type", EVENTS, folder(spark, "types"))
    return once(spark, sf, "type_index", make)


@query("type_index_lookup", "SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click')")
def type_index_lookup(spark, sf):
    return type_index(spark, sf).get("interaction").df


@query("type_index_substituted", "SELECT event_id FROM events WHERE event_type IN ('signup', 'purchase') AND value > 10")
def type_index_substituted(spark, sf):
    """A type filter among other filters: the index is found without being named."""
    q = type_filter(table(spark, sf, "events").filter("value > 10"), "event_type", "conversion", EVENTS)
    return declared(spark, sf).optimize(q).map("event_id").df


@query("type_collect", "SELECT value * 2 AS earned FROM events WHERE event_type IN ('signup', 'purchase') AND value IS NOT NULL")
def type_collect(spark, sf):
    """Safe casts of a partial map are filters on the type."""
    return table(spark, sf, "events").collect(EVENTS.if_instance(F.col("event_type"), "conversion", F.col("value") * 2), "earned").df


@query("safe_cast_checked", "SELECT event_id, value AS earned FROM events WHERE event_type = 'purchase'")
def safe_cast_checked(spark, sf):
    q = type_filter(table(spark, sf, "events"), "event_type", "purchase", EVENTS)
    return q.map("event_id", earned=EVENTS.as_instance(F.col("event_type"), "conversion", F.col("value"))).df


# Recursion


@query("transitive_closure", f"WITH RECURSIVE e(child, parent) AS (SELECT * FROM {_EDGES} UNION ALL SELECT 'event', 'event'), c(child, parent) AS (SELECT * FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON c.parent = e.child) SELECT child, parent FROM c")
def closure(spark, sf):
    edges = [(c, p) for c, ps in EVENTS.parents.items() for p in ps] + [("event", "event")]
    return transitive_closure(literal(spark, edges, "child string, parent string").df)


_TRADE = "SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE o_orderpriority = '1-URGENT' AND l_quantity = 50 AND c_nationkey < s_nationkey"


@query("transitive_closure_trade", f"WITH RECURSIVE e(a, b) AS ({_TRADE}), c(a, b) AS (SELECT * FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c")
def closure_trade(spark, sf):
    """From the nation of a customer to that of a supplier, at any distance."""
    q = table(spark, sf, "customer").join(table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'"), "c_custkey", "o_custkey")
    q = q.join(table(spark, sf, "lineitem").filter("l_quantity = 50"), "o_orderkey", "l_orderkey").join(table(spark, sf, "supplier"), "l_suppkey", "s_suppkey")
    return transitive_closure(q.filter("c_nationkey < s_nationkey").map(a="c_nationkey", b="s_nationkey").df)


@query("closure_descendants", f"WITH RECURSIVE e(child, parent) AS (SELECT * FROM {_EDGES}), below(t) AS (SELECT child FROM e WHERE parent = 'action' UNION SELECT child FROM e JOIN below ON parent = t) SELECT t AS child FROM below")
def closure_descendants(spark, sf):
    edges = [(c, p) for c, ps in EVENTS.parents.items() for p in ps]
    return descendants(transitive_closure(literal(spark, edges, "child string, parent string").df), "action")


@query("fixpoint_halves", "WITH RECURSIVE h(x) AS (SELECT DISTINCT p_size FROM part UNION SELECT x // 2 FROM h) SELECT x::INT AS x FROM h")
def fixpoint_halves(spark, sf):
    sizes = table(spark, sf, "part").map(x="cast(p_size as int)").df
    return fixpoint(sizes, lambda df: df.unionByName(df.select((F.col("x") / 2).cast("int").alias("x"))))


# Indexes


_INDEXED = "SELECT o_orderkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' AND l_quantity > 40"
_KEYS = "case when user_id % 3 = 0 then '' when user_id % 3 = 1 then event_type end"


def declare(spark: SparkSession, sf: str) -> Indexes:
    """The indexes of the workload, stored."""
    indexes = Indexes(folder(spark, "indexes"))
    indexes.add("segment", table(spark, sf, "customer"), "c_mktsegment")
    indexes.add("sum", table(spark, sf, "customer"), "c_nationkey + c_custkey % 2")
    indexes.add("priority", table(spark, sf, "orders").join(table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey"), "o_orderpriority")
    indexes.add("types", table(spark, sf, "events"), "event_type")
    indexes.add("keys", table(spark, sf, "events").let("k", _KEYS), "k")
    indexes.add("user", table(spark, sf, "events"), "user_id")
    indexes.keep("urgent", table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'"))
    return indexes


def declared(spark: SparkSession, sf: str) -> Indexes:
    return once(spark, sf, "indexes", lambda: declare(spark, sf))


@query("index_build", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def index_build(spark, sf):
    """An index made anew, and its rows counted: the cost that the lookups save."""
    return Query(Indexes(folder(spark, "index")).add("segment", table(spark, sf, "customer"), "c_mktsegment").frame).group(F.count("*").alias("n"), c_mktsegment="c_mktsegment").df


@query("index_simple", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def index_simple(spark, sf):
    c = table(spark, sf, "customer")
    return declared(spark, sf).optimize(c.filter(Equals("c_mktsegment", "BUILDING"))).map("c_custkey", "c_name").df


@query("index_residual", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_nationkey + c_custkey % 2 > 3")
def index_residual(spark, sf):
    c = table(spark, sf, "customer")
    return declared(spark, sf).optimize(c.filter("c_acctbal > 0", Equals("(c_mktsegment)", "BUILDING"), "c_nationkey + c_custkey % 2 > 3")).map("c_custkey").df


@query("index_of_a_sum", "SELECT c_custkey FROM customer WHERE c_nationkey + c_custkey % 2 = 8")
def index_of_a_sum(spark, sf):
    """The key's operands in another order."""
    return declared(spark, sf).optimize(table(spark, sf, "customer").filter(Equals("c_custkey % 2 + c_nationkey", 8))).map("c_custkey").df


@query("index_of_a_difference", "SELECT c_custkey FROM customer WHERE (c_nationkey + c_custkey) % 2 = 1")
def index_of_a_difference(spark, sf):
    """A key of the same words that isn't the index's."""
    return declared(spark, sf).optimize(table(spark, sf, "customer").filter(Equals("(c_nationkey + c_custkey) % 2", 1))).map("c_custkey").df


@query("index_nested", _INDEXED)
def index_nested(spark, sf):
    prefix = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey")
    return declared(spark, sf).optimize(prefix.filter("l_quantity > 40", Equals("o_orderpriority", "1-URGENT"))).map("o_orderkey", "l_partkey").df


@query("index_none", _INDEXED)
def index_none(spark, sf):
    prefix = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey")
    return prefix.filter("l_quantity > 40", Equals("o_orderpriority", "1-URGENT")).map("o_orderkey", "l_partkey").df


@query("index_empty_key", f"SELECT event_id FROM events WHERE ({_KEYS}) = ''")
def index_empty_key(spark, sf):
    return declared(spark, sf).optimize(table(spark, sf, "events").let("k", _KEYS).filter(Equals("k", ""))).map("event_id").df


@query("index_null_key", f"SELECT event_id FROM events WHERE ({_KEYS}) IS NULL")
def index_null_key(spark, sf):
    return declared(spark, sf).optimize(table(spark, sf, "events").let("k", _KEYS).filter(Equals("k", None))).map("event_id").df


@query("index_many_keys", "SELECT event_id, user_id FROM events WHERE user_id = 7")
def index_many_keys(spark, sf):
    """A key of many values, in buckets."""
    return declared(spark, sf).optimize(table(spark, sf, "events").filter(Equals("user_id", 7))).map("event_id", "user_id").df


@query("index_other_base", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000")
def index_other_base(spark, sf):
    """A base of the same name with other rows is not the index's."""
    rich = Query(table(spark, sf, "customer").df.filter("c_acctbal > 5000"), name=table(spark, sf, "customer").name)
    return declared(spark, sf).optimize(rich.filter(Equals("c_mktsegment", "BUILDING"))).map("c_custkey").df


@query("subquery_kept", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def subquery_kept(spark, sf):
    q = declared(spark, sf).optimize(table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'"))
    return q.map("o_orderkey", "o_totalprice").df


# Scalars


@query("string_scalars", "SELECT p_partkey, (instr(p_name, 'a') - 1)::INT AS first_a, CASE WHEN instr(reverse(p_name), 'a') = 0 THEN -1 ELSE length(p_name) - instr(reverse(p_name), 'a') END::INT AS last_a, substr(p_name, 3, 1) AS third, upper(p_name) AS up, p_name || '/' || p_brand AS both, length(p_type)::INT AS n, starts_with(p_brand, 'Brand#1') AS ones, ends_with(p_brand, '3') AS threes FROM part")
def string_scalars(spark, sf):
    return table(spark, sf, "part").map("p_partkey", first_a=S.index_of("p_name", "a"), last_a=S.last_index_of("p_name", "a"), third=S.char_at("p_name", 2), up=F.upper("p_name"), both=S.concat("p_name", F.lit("/"), "p_brand"), n=F.length("p_type"), ones=F.col("p_brand").startswith("Brand#1"), threes=F.col("p_brand").endswith("3")).df


@query("regex_find", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[12][3-5]$')")
def regex_find(spark, sf):
    return table(spark, sf, "part").filter(S.finds("p_brand", "#[12][3-5]$")).map("p_partkey").df


@query("if_chain", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size, greatest(p_size, 25) AS least_25, p_size % 7 AS rest FROM part")
def if_chain(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").map("p_partkey", size=S.if_else((size < 10, "small"), (size < 30, "medium"), default="large"), least_25=S.larger("p_size", F.lit(25)), rest=size % 7).df


@query("guarded_access", "SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING count(*) > 2 AND list(o_orderkey ORDER BY o_orderkey)[3] % 2 = 0")
def guarded_access(spark, sf):
    q = table(spark, sf, "orders").group_by_sel("o_orderkey", "keys", k="o_custkey").let("s", "sort_array(keys)")
    return q.filter(S.guarded(F.size("s") > 2, S.at("s", 2) % 2 == 0)).map("k").df


@query("opaque_call", "SELECT p_partkey, p_size * 2 + length(p_name) AS score, coalesce(p_size, 0)::BIGINT AS size FROM part")
def opaque_call(spark, sf):
    score = calls.Call("score", "long", lambda size, name: size * 2 + name.str.len())
    return table(spark, sf, "part").map("p_partkey", score=score("p_size", "p_name"), size=calls.global_call("coalesce", F.col("p_size").cast("long"), F.lit(0).cast("long"))).df


@query("flat_map_of_a_function", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def flat_map_function(spark, sf):
    words = calls.by_row("words", "array<string>", lambda s: s.split(" "))
    return table(spark, sf, "part").flat_map("word", words("p_name"), "p_partkey").df


@query("partial_function", "SELECT DISTINCT CASE WHEN p_size < 5 THEN 'tiny' WHEN p_type = 'PROMO' THEN 'promo' END AS kind FROM part WHERE p_size < 5 OR p_type = 'PROMO'")
def partial_function(spark, sf):
    return table(spark, sf, "part", kind="set").collect(calls.partial((F.col("p_size") < 5, F.lit("tiny")), (F.col("p_type") == "PROMO", F.lit("promo"))), "kind").df


@query("fold_booleans", "SELECT o_orderpriority AS k, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 300000) AS some, count(*) FILTER (o_orderstatus = 'F') % 2 = 1 AS odd FROM orders GROUP BY 1")
def fold_booleans(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").group(every(price > 1000).alias("every"), some(price > 300000).alias("some"), odd(F.col("o_orderstatus") == "F").alias("odd"), k="o_orderpriority").df


@query("null_equality", "SELECT k IS NOT DISTINCT FROM NULL AS null_is_null, count(*) AS n FROM (SELECT CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS k FROM events) GROUP BY 1")
def null_equality(spark, sf):
    return table(spark, sf, "events").let("k", "case when user_id % 3 > 0 then user_id % 3 end").group(F.count("*").alias("n"), null_is_null=S.same("k", F.lit(None))).df


@query("derived_change", "SELECT o_custkey, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND c_acctbal > 0 GROUP BY 1")
def derived_change(spark, sf):
    """What a query of a base and its change adds to that of the base alone."""
    o, c = table(spark, sf, "orders").df, table(spark, sf, "customer").df.filter("c_acctbal > 0")
    f = lambda changes: views.joined(changes, views.include(c), F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", views.MULT)
    return views.derive(f, views.include(o.filter("o_orderstatus = 'P'"))).withColumnRenamed(views.MULT, "n")


# Maintained views: the batch result of the net input is the oracle


@query("ivm_counts", "SELECT event_type, count(*)::BIGINT AS n, sum(user_id)::BIGINT AS users FROM events WHERE NOT value < 20 GROUP BY 1")
def ivm_counts(spark, sf):
    e = table(spark, sf, "events").map("event_type", "user_id", "value").df
    changes = views.include(e).unionByName(views.remove(e.filter("value < 20")))
    return views.grouped(changes, ["event_type"], users="user_id").select("event_type", "n", "users")


@query("ivm_join_delta", "WITH o AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'O'), c AS (SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0) SELECT o_custkey, count(*)::BIGINT AS mult FROM o JOIN c ON o_custkey = c_custkey GROUP BY 1")
def ivm_join(spark, sf):
    o, c = table(spark, sf, "orders").map("o_orderkey", "o_custkey", "o_orderstatus").df, table(spark, sf, "customer").map("c_custkey", "c_acctbal").df
    left, right = views.include(o), views.include(c)
    on = F.col("o_custkey") == F.col("c_custkey")
    before = views.joined(left, right, on)
    delta = views.join_delta(left, right, views.remove(o.filter("o_orderstatus = 'O'")), views.remove(c.filter("c_acctbal < 0")), on)
    return views.net(views.map_changes(before.unionByName(delta), "o_custkey"))


@query("ivm_set", "SELECT DISTINCT user_id FROM events WHERE event_type <> 'view'")
def ivm_set(spark, sf):
    e = table(spark, sf, "events").map("event_id", "event_type", "user_id").df
    changes = views.include(e).unionByName(views.remove(e.filter("event_type = 'view'")))
    return views.as_set(views.net(views.map_changes(changes, "user_id")))


@query("ivm_update", "SELECT event_type, count(*)::BIGINT AS n, sum(CASE WHEN event_type = 'click' THEN user_id + 1 ELSE user_id END)::BIGINT AS users FROM events GROUP BY 1")
def ivm_update(spark, sf):
    """New values for some rows: each goes as it was and comes as it is."""
    e = table(spark, sf, "events").map("event_type", "user_id").df
    old = e.filter("event_type = 'click'")
    changes = views.include(e).unionByName(views.update(old, old.withColumn("user_id", F.col("user_id") + 1)))
    return views.grouped(changes, ["event_type"], users="user_id").select("event_type", "n", "users")


@query("ivm_union", "SELECT k, count(*)::BIGINT AS mult FROM (SELECT c_nationkey AS k FROM customer WHERE NOT c_acctbal < 0 UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1")
def ivm_union(spark, sf):
    c, s = table(spark, sf, "customer").map("c_acctbal", k="c_nationkey").df, table(spark, sf, "supplier").map(k="s_nationkey").df
    changes = views.include(c).unionByName(views.remove(c.filter("c_acctbal < 0"))).select("k", views.MULT)
    return views.net(changes.unionByName(views.include(s)))


@query("ivm_not_exists", "SELECT c_custkey, 1::BIGINT AS mult FROM customer WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def ivm_not_exists(spark, sf):
    """Customers without orders, as customers go and as orders go."""
    c, o = table(spark, sf, "customer").map("c_acctbal", "c_custkey").df, table(spark, sf, "orders").map("o_orderstatus", c_custkey="o_custkey").df
    left, right = views.include(c.select("c_custkey")), views.include(o.select("c_custkey"))
    d_left, d_right = views.remove(c.filter("c_acctbal <= 0").select("c_custkey")), views.remove(o.filter("o_orderstatus <> 'F'").select("c_custkey"))
    before = views.include(c.select("c_custkey").join(o.select("c_custkey"), "c_custkey", "left_anti"))
    return views.net(before.unionByName(views.not_exists_delta(left, right, d_left, d_right, ["c_custkey"])))


@query("ivm_fold", "SELECT o_custkey, min(o_totalprice) AS least, 1::BIGINT AS mult FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def ivm_fold(spark, sf):
    """A minimum, which removals can't be subtracted from."""
    o = table(spark, sf, "orders").map("o_custkey", "o_totalprice", "o_orderstatus").df
    least = F.min("o_totalprice").alias("least")
    before = views.include(o.groupBy("o_custkey").agg(least))
    change = views.fold_delta(views.include(o), views.remove(o.filter("o_orderstatus = 'F'")), ["o_custkey"], least)
    return views.net(before.unionByName(change))


@query("ivm_unnest", "SELECT l_partkey, count(*)::BIGINT AS mult FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1")
def ivm_unnest(spark, sf):
    n = nested_orders(spark, sf).df.select("o_orderstatus", "items")
    changes = views.include(n).unionByName(views.remove(n.filter("o_orderstatus = 'F'")))
    return views.net(views.map_changes(views.unnested(changes, "items", "i"), "i.l_partkey"))


# Forms of the operators above that the workload doesn't need


@query("range_filter", "SELECT i::INT AS value FROM range(1, 10) t(i) WHERE i < 4")
def range_filter(spark, sf):
    return int_range(spark, 1, 10).filter("value < 4").df


@query("self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def self_join(spark, sf):
    side = lambda name, key: table(spark, sf, "nation").map(**{name: "n_name", key: "n_regionkey"})
    return side("a", "ra").join(side("b", "rb"), "ra", "rb").map("a", "b").df


@query("forced_view", "SELECT n_name FROM nation WHERE n_regionkey = 2")
def forced_view(spark, sf):
    return table(spark, sf, "nation").filter("n_regionkey = 2").view().force().map("n_name").df


@query("to_map_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def to_map_last(spark, sf):
    return table(spark, sf, "orders").map("o_custkey", "o_orderkey").to_seq("o_orderkey").to_map("o_custkey").df


@query("option_iterable", "SELECT event_id, value AS earned FROM events WHERE event_type = 'purchase' AND value IS NOT NULL")
def option_iterable(spark, sf):
    earned = EVENTS.if_instance(F.col("event_type"), "purchase", F.col("value"))
    return table(spark, sf, "events").flat_map("earned", S.to_iterable(earned), "event_id").df


@query("division", "SELECT p_partkey, p_retailprice / p_size AS each, p_partkey / 7 AS seventh FROM part")
def division(spark, sf):
    return table(spark, sf, "part").map("p_partkey", each=S.divide("p_retailprice", "p_size"), seventh=S.divide("p_partkey", F.lit(7))).df


@query("arithmetic_wraps", "SELECT o_orderkey, ((o_orderkey * 1000003 + 2147483648) % 4294967296 - 2147483648)::INT AS low, (-o_custkey)::BIGINT AS minus, (o_custkey * 3 - o_orderkey + 1)::BIGINT AS mixed FROM orders")
def arithmetic_wraps(spark, sf):
    key = F.col("o_orderkey").cast("long")
    return table(spark, sf, "orders").map("o_orderkey", low=S.wrapped(key * 1000003), minus=-F.col("o_custkey").cast("long"), mixed=F.col("o_custkey").cast("long") * 3 - key + 1).df


@query("letting_once", "SELECT p_partkey, (p_size * 2) * (p_size * 2) + p_size * 2 AS v FROM part")
def letting_once(spark, sf):
    return table(spark, sf, "part").map("p_partkey", v=S.letting(F.col("p_size") * 2, lambda x: x * x + x)).df


@query("digits_and_text", "SELECT p_partkey, regexp_matches(substr(p_brand, 7, 1), '^[0-9]$') AS digit, p_size::VARCHAR AS text, CASE WHEN p_size < 10 THEN 'null' ELSE p_brand END AS brand FROM part")
def digits_and_text(spark, sf):
    return table(spark, sf, "part").map("p_partkey", digit=S.is_digit(S.char_at("p_brand", 6)), text=S.to_text("p_size"), brand=S.to_text(F.when(F.col("p_size") >= 10, F.col("p_brand")))).df


@query("map_defined_at", "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS known FROM orders")
def map_defined_at(spark, sf):
    names = F.create_map(F.lit("F"), F.lit("filled"), F.lit("O"), F.lit("open"))
    return table(spark, sf, "orders").map("o_orderkey", known=calls.defined_at(names, F.col("o_orderstatus"))).df


@query("head_last_of_array", "SELECT l_orderkey AS o_orderkey, min(l_linenumber) AS head, max(l_linenumber) AS last FROM lineitem GROUP BY 1")
def head_last_of_array(spark, sf):
    return nested_orders(spark, sf).map("o_orderkey", head=S.head("items")["l_linenumber"], last=S.last("items")["l_linenumber"]).df


@query("sliding_unzip", "SELECT * FROM (SELECT l_orderkey AS o_orderkey, (l_linenumber + lead(l_linenumber) OVER w)::BIGINT AS lines, (l_partkey + lead(l_partkey) OVER w)::BIGINT AS parts FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)) WHERE lines IS NOT NULL")
def sliding_unzip(spark, sf):
    pairs = F.transform("items", lambda i: F.struct(i["l_linenumber"].alias("_1"), i["l_partkey"].alias("_2")))
    q = nested_orders(spark, sf).flat_map("w", F.transform(S.sliding(pairs, 2), S.unzip), "o_orderkey").filter("size(w._1) = 2")
    return q.map("o_orderkey", lines=S.array_sum("w._1"), parts=S.array_sum("w._2")).df


@query("counted_emptiness", "SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) >= 1")
def counted_emptiness(spark, sf):
    """A correlated count that only asks whether there is one: a semi join."""
    return table(spark, sf, "customer").counted_by(table(spark, sf, "orders").filter("o_totalprice > 200000"), ">=", 1, "o_custkey = c_custkey").map("c_custkey").df


@query("counted_more", "SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) <= 8")
def counted_more(spark, sf):
    return table(spark, sf, "customer").counted_by(table(spark, sf, "orders"), "<=", 8, "o_custkey = c_custkey").map("c_custkey").df


@query("sized_filter", "SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 48")
def sized_filter(spark, sf):
    """The size of a filtered array, compared with 0: stops at the first element that is left."""
    return nested_orders(spark, sf).filter(S.sized(S.filtered("items", lambda i: i["l_quantity"] > 48), ">", 0)).map("o_orderkey").df


@query("group_folds", "SELECT o_custkey AS k, sum(o_orderkey)::BIGINT AS total, bool_or(o_orderkey % 4 = 0) AS some, bool_and(o_orderkey % 4 > 0) AS every, count(*)::INT AS n FROM orders GROUP BY 1")
def group_folds(spark, sf):
    """Folds of a group's elements are aggregates."""
    q = table(spark, sf, "orders").group_by_sel("o_orderkey", "keys", k="o_custkey")
    return q.map("k", total=S.array_sum("keys"), some=S.exists("keys", lambda x: x % 4 == 0), every=S.forall("keys", lambda x: x % 4 > 0), n=S.size("keys")).df


@query("aggregate_of_a_function", "SELECT o_custkey, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY 1")
def aggregate_of_a_function(spark, sf):
    spread = calls.fold_call("spread", "double", lambda v: float(v.max() - v.min()))
    return table(spark, sf, "orders").group(spread("o_totalprice").alias("spread"), o_custkey="o_custkey").df


@query("rows_of_a_function", "SELECT p_partkey, unnest(range(p_size % 3))::INT AS i FROM part")
def rows_of_a_function(spark, sf):
    def run(batches):
        for b in batches:
            b = b.loc[b.index.repeat(b.p_size % 3)]
            yield b.assign(i=b.groupby("p_partkey").cumcount())[["p_partkey", "i"]]

    parts = table(spark, sf, "part").map("p_partkey", "p_size")
    return parts.table_map(calls.TableCall("rows", f"p_partkey {dict(parts.df.dtypes)['p_partkey']}, i int", run)).df
