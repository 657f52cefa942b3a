"""The 24 analyses of the reference workload: each keeps its query's shape, on the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinql.functions import scalars as S
from skeinql.plans.query import Query
from skeinql.sources.collections import literal, table
from skeinql.workload.queries import EVENTS, _EDGES, _LEAD, _user_events, nested_orders, query

_FROM = "FROM orders JOIN lineitem ON o_orderkey = l_orderkey"


@query("protected_field", f"SELECT o_orderkey, l_partkey {_FROM} WHERE o_orderstatus = 'F' AND l_returnflag = 'R'")
def protected_field(spark, sf):
    """Outer filter, unnest, inner filter."""
    return nested_orders(spark, sf).filter("o_orderstatus = 'F'").unnest("items", "i").filter("i.l_returnflag = 'R'").map("o_orderkey", "i.l_partkey").df


@query("finalizer_not_protected", f"SELECT DISTINCT o_orderkey {_FROM} WHERE l_quantity > 48")
def finalizer(spark, sf):
    """Filter by exists over a nested collection."""
    return nested_orders(spark, sf).filter(S.exists("items", lambda i: i["l_quantity"] > 48)).map("o_orderkey").df


@query("finalizer_not_protected_2", f"SELECT o_orderkey {_FROM} WHERE l_quantity > 48")
def finalizer_2(spark, sf):
    """Unnest, filter and project the outer row: a bag keeps its duplicates."""
    return nested_orders(spark, sf).unnest("items", "i").filter("i.l_quantity > 48").map("o_orderkey").df


_UNUSED = "SELECT c.c_custkey, count(DISTINCT o.o_orderpriority)::BIGINT AS unused FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice <= 150000 WHERE NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = c.c_custkey AND p.o_totalprice > 150000 AND p.o_orderpriority = o.o_orderpriority) GROUP BY 1"


@query("unused_private_field", _UNUSED)
def unused_field(spark, sf):
    """A difference of two correlated sets for each group, kept where it isn't empty."""
    pairs = lambda p: table(spark, sf, "orders").filter(p).map("o_custkey", "o_orderpriority").to_set()
    left = pairs("o_totalprice <= 150000").difference(pairs("o_totalprice > 150000"))
    return left.group(F.count("*").alias("unused"), c_custkey="o_custkey").member("c_custkey", table(spark, sf, "customer").map(k="c_custkey"), "k").df


@query("unused_private_field_grouped", _UNUSED)
def unused_field_grouped(spark, sf):
    """The same by one grouping: flags of each pair instead of two sets."""
    pairs = table(spark, sf, "orders").group(F.bool_or(F.col("o_totalprice") > 150000).alias("used"), o_custkey="o_custkey", o_orderpriority="o_orderpriority")
    return pairs.filter("not used").group(F.count("*").alias("unused"), c_custkey="o_custkey").df


_NESTED = "FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey"


@query("gc_call", f"SELECT DISTINCT n_name, CASE WHEN l_returnflag = 'R' AND l_quantity > 49 THEN 'returned ' || l_linestatus ELSE 'shipped ' || o_orderstatus END AS what {_NESTED} WHERE (l_returnflag = 'R' AND l_quantity > 49) OR (l_returnflag = 'N' AND l_quantity < 2)")
def gc_call(spark, sf):
    """Four levels, and a case of two types with guards."""
    q = table(spark, sf, "nation").join(table(spark, sf, "customer"), "n_nationkey", "c_nationkey").join(nested_orders(spark, sf), "c_custkey", "o_custkey").unnest("items", "i")
    flag, n = F.col("i.l_returnflag"), F.col("i.l_quantity")
    what = F.when((flag == "R") & (n > 49), F.concat(F.lit("returned "), F.col("i.l_linestatus"))).when((flag == "N") & (n < 2), F.concat(F.lit("shipped "), F.col("o_orderstatus")))
    return q.filter(what.isNotNull()).map("n_name", what=what, kind="set").df


@query("run_finalizers_on_exit", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND (value > 90 OR value < 5)")
def run_finalizers(spark, sf):
    """A type and a disjunction."""
    q = table(spark, sf, "events").filter(EVENTS.is_instance(F.col("event_type"), "error"), "value > 90 or value < 5")
    return q.map("user_id", kind="set").df


@query("no_suitable_constructor", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def no_constructor(spark, sf):
    """A map lookup, then not exists."""
    q = table(spark, sf, "customer").lookup(table(spark, sf, "nation"), "c_nationkey", "n_nationkey", name="n_name").filter("name is not null")
    return q.not_exists(table(spark, sf, "orders").filter("o_orderstatus = 'O'"), "o_custkey = c_custkey").map("c_custkey", n_name="name").df


@query("dont_catch_imse", f"SELECT r_name, l_orderkey, l_linenumber FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey = 3")
def dont_catch(spark, sf):
    """Five levels and a last equality."""
    q = table(spark, sf, "region")
    for name, outer, inner in (("nation", "r_regionkey", "n_regionkey"), ("customer", "n_nationkey", "c_nationkey"), ("orders", "c_custkey", "o_custkey"), ("lineitem", "o_orderkey", "l_orderkey")):
        q = q.join(table(spark, sf, name), outer, inner)
    return q.filter("l_suppkey = 3").map("r_name", "l_orderkey", "l_linenumber").df


@query("covariant_compareto", "SELECT n_name, s_suppkey, s_acctbal * 2 AS twice FROM nation JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE r_name IN ('ASIA', 'EUROPE')")
def covariant_compare(spark, sf):
    """A set of names, looked up, unnested, with a binding."""
    names = literal(spark, [("ASIA",), ("EUROPE",)], "name string", kind="set")
    q = names.join(table(spark, sf, "region"), "name", "r_name").join(table(spark, sf, "nation"), "r_regionkey", "n_regionkey").join(table(spark, sf, "supplier"), "n_nationkey", "s_nationkey")
    return q.let("twice", "s_acctbal * 2").to_bag().map("n_name", "s_suppkey", "twice").df


@query("covariant_equals", "SELECT l_orderkey, l_linenumber, s_suppkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey")
def covariant_equals(spark, sf):
    """An equality with the outer row."""
    q = table(spark, sf, "customer").join(table(spark, sf, "orders"), "c_custkey", "o_custkey").join(table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey").join(table(spark, sf, "supplier"), "l_suppkey", "s_suppkey")
    return q.filter("s_nationkey = c_nationkey").map("l_orderkey", "l_linenumber", "s_suppkey").df


@query("no_clone", "SELECT DISTINCT user_id FROM events a WHERE event_type IN ('signup', 'purchase') AND NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'error' AND b.value > 120)")
def no_clone(spark, sf):
    """Members of a set of subtypes without a row of another type."""
    e = table(spark, sf, "events")
    q = e.filter(EVENTS.is_instance(F.col("event_type"), "conversion")).map("user_id", kind="set")
    return q.not_member("user_id", e.filter("event_type = 'error'", "value > 120").map(u="user_id"), "u").df


@query("super_clone_missing", f"SELECT DISTINCT o_orderkey {_FROM} WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o_orderkey AND x.l_returnflag = 'N' AND x.l_quantity > 20)")
def super_clone(spark, sf):
    """Not exists over a nested sequence, narrowed to a type."""
    return nested_orders(spark, sf).filter(~S.exists("items", lambda i: (i["l_returnflag"] == "N") & (i["l_quantity"] > 20))).map("o_orderkey").df


@query("not_cloneable", f"WITH RECURSIVE e(child, parent) AS (SELECT * FROM {_EDGES}), below(t) AS (SELECT 'action' UNION SELECT child FROM e JOIN below ON parent = t) SELECT event_id, event_type FROM events WHERE event_type NOT IN (SELECT t FROM below)")
def not_cloneable(spark, sf):
    """Rows whose type isn't a subtype."""
    return table(spark, sf, "events").filter(~EVENTS.is_instance(F.col("event_type"), "action")).map("event_id", "event_type").df


@query("boxing_unboxed", f"SELECT event_id, e1 FROM ({_LEAD}) WHERE event_type = 'view' AND t1 = 'view'")
def boxing(spark, sf):
    """Two steps in a row of the same type."""
    w = _user_events(spark, sf).sliding(2, "user_id").filter("size(window) = 2", "window[0].event_type = 'view' and window[1].event_type = 'view'")
    return w.map(event_id="window[0].event_id", e1="window[1].event_id").df


@query("long_bits_to_double", "SELECT l_orderkey, a AS l_linenumber FROM (SELECT l_orderkey, l_linenumber AS a, l_linestatus = lead(l_linestatus) OVER w AND l_quantity < lead(l_quantity) OVER w AS hit FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus)) WHERE hit")
def long_bits(spark, sf):
    """Windows of two over a nested sequence."""
    pairs = nested_orders(spark, sf).flat_map("w", S.sliding("items", 2), "o_orderkey").filter("size(w) = 2")
    return pairs.filter("w[0].l_linestatus = w[1].l_linestatus and w[0].l_quantity < w[1].l_quantity").map(l_orderkey="o_orderkey", l_linenumber="w[0].l_linenumber").df


@query("inefficient_to_array", f"SELECT event_id FROM ({_LEAD}) WHERE event_type IN ('view', 'click') AND t1 = 'error' AND t2 IN ('view', 'click', 'signup', 'purchase')")
def to_array(spark, sf):
    """Windows of three with a test for subtypes."""
    kind = lambda i, name: EVENTS.is_instance(F.col("window")[i]["event_type"], name)
    w = _user_events(spark, sf).sliding(3, "user_id").filter("size(window) = 3").filter(kind(0, "interaction"), kind(1, "error"), kind(2, "action"))
    return w.map(event_id="window[0].event_id").df


@query("do_inside_privileged", "SELECT l_orderkey, index, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INT - 1 AS index FROM lineitem) WHERE l_quantity > 45 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority IN ('1-URGENT', '2-HIGH'))")
def privileged(spark, sf):
    """Not exists on the outer row, and places in the nested sequence."""
    q = nested_orders(spark, sf).not_member("o_orderpriority", literal(spark, [("1-URGENT",), ("2-HIGH",)], "p string"), "p")
    return q.flat_map("x", S.zip_with_index("items"), "o_orderkey").filter("x._1.l_quantity > 45").map(l_orderkey="o_orderkey", index="x._2", l_partkey="x._1.l_partkey").df


@query("useless_finalizer", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'A' AND l_linestatus = 'F')")
def useless(spark, sf):
    """Exists over a nested sequence."""
    return nested_orders(spark, sf).filter(S.exists("items", lambda i: (i["l_returnflag"] == "A") & (i["l_linestatus"] == "F"))).map("o_orderkey").df


@query("package_protect", "SELECT DISTINCT l_partkey, l_suppkey, l_linestatus FROM lineitem a WHERE l_quantity > 40 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey = a.l_suppkey AND b.l_linestatus = a.l_linestatus AND b.l_returnflag <> a.l_returnflag)")
def package_protect(spark, sf):
    """Anti-exists with three equalities and one inequality."""
    items = table(spark, sf, "lineitem")
    others = items.map(p="l_partkey", s="l_suppkey", t="l_linestatus", r="l_returnflag")
    q = items.filter("l_quantity > 40").not_exists(others, "p = l_partkey", "s = l_suppkey", "t = l_linestatus", "r <> l_returnflag")
    return q.map("l_partkey", "l_suppkey", "l_linestatus", kind="set").df


@query("should_be_final", "SELECT p_partkey, p_brand FROM part WHERE p_size > 10 AND p_size < 40 AND p_retailprice > 500 AND p_brand <> 'Brand#11'")
def should_be_final(spark, sf):
    """A conjunction."""
    return table(spark, sf, "part").filter("p_size > 10", "p_size < 40", "p_retailprice > 500", S.differ("p_brand", "Brand#11")).map("p_partkey", "p_brand").df


@query("bad_field_inner_class", "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE coalesce(most < 300000, true)")
def bad_field(spark, sf):
    """An option that counts as true where it is none."""
    most = table(spark, sf, "orders").group(F.max("o_totalprice").alias("most"), k="o_custkey")
    return table(spark, sf, "customer").lookup(most, "c_custkey", "k", most="most").filter(S.get_or_else(F.col("most") < 300000, True)).map("c_custkey").df


@query("swing_methods", "SELECT event_id, user_id FROM events WHERE starts_with(event_type, 'p') AND event_type IN ('signup', 'purchase') AND value > 10")
def swing(spark, sf):
    """A prefix, and a safe cast."""
    q = table(spark, sf, "events").let("earned", EVENTS.if_instance(F.col("event_type"), "conversion", F.col("value")))
    return q.filter(F.col("event_type").startswith("p"), "earned is not null", "earned > 10").map("event_id", "user_id").df


@query("inner_should_be_static", "SELECT p_partkey, substr(p_brand, instr(p_brand, '#') + 1) AS number FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND regexp_matches(p_brand, '#[1-3]') AND (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) > 1")
def inner_static(spark, sf):
    """An uncorrelated set, string functions, a pattern, and a correlated count over one."""
    items = table(spark, sf, "lineitem")
    counts = items.group(F.count("*").alias("n"), k="l_partkey").filter("n > 1")
    q = table(spark, sf, "part").not_member("p_partkey", items.filter("l_quantity > 49").map(k="l_partkey"), "k").filter(S.finds("p_brand", "#[1-3]")).member("p_partkey", counts, "k")
    return q.map("p_partkey", number=F.substr("p_brand", S.index_of("p_brand", "#") + 2)).df


@query("uninit_read", "SELECT n_name, c_custkey, o_orderkey, x.l_partkey, x.l_suppkey FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) = 1) x ON x.l_orderkey = o_orderkey WHERE n_regionkey = 1 AND EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = o_orderkey AND y.l_returnflag = 'R')")
def uninit_read(spark, sf):
    """A join of five levels that depend on each other, a head that may be none, and exists."""
    q = table(spark, sf, "nation").filter("n_regionkey = 1").join(table(spark, sf, "customer"), "n_nationkey", "c_nationkey").join(nested_orders(spark, sf), "c_custkey", "o_custkey")
    q = q.let("first", S.head_option("items")).filter("first is not null", S.exists("items", lambda i: i["l_returnflag"] == "R"))
    return q.map("n_name", "c_custkey", "o_orderkey", l_partkey="first.l_partkey", l_suppkey="first.l_suppkey").df


@query("type_hierarchy_maps", f"WITH RECURSIVE e(child, parent) AS (SELECT * FROM {_EDGES}) SELECT parent AS k, count(*)::INT AS n, 'down' AS way FROM e GROUP BY 1 UNION ALL SELECT child, count(*)::INT, 'up' FROM e GROUP BY 1")
def type_maps(spark, sf):
    """A relation grouped both ways."""
    edges = literal(spark, [(c, p) for c, ps in sorted(EVENTS.parents.items()) for p in ps], "child string, parent string")
    side = lambda key, value, way: edges.group_by_sel(value, "names", k=key).map("k", n=F.size("names"), way=F.lit(way)).to_bag()
    return side("parent", "child", "down").union(side("child", "parent", "up")).df


@query("ensemble_dependencies", "SELECT l_orderkey, 'part' AS why FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 9) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 4000) UNION ALL SELECT l_orderkey, 'supplier' FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 15) UNION ALL SELECT o_orderkey, 'order' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def ensembles(spark, sf):
    """Three branches, each by membership or its absence in sets."""
    t = lambda name, p=None: table(spark, sf, name).filter(p) if p else table(spark, sf, name)
    items = t("lineitem")
    a = items.member("l_partkey", t("part", "p_size < 9"), "p_partkey").not_member("l_suppkey", t("supplier", "s_acctbal > 4000"), "s_suppkey").map("l_orderkey", why=F.lit("part"))
    b = items.member("l_suppkey", t("supplier", "s_nationkey = 15"), "s_suppkey").map("l_orderkey", why=F.lit("supplier"))
    c: Query = t("orders").not_member("o_custkey", t("customer", "c_acctbal > 0"), "c_custkey").map(l_orderkey="o_orderkey", why=F.lit("order"))
    return a.union(b).union(c).df
