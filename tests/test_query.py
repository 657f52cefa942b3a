"""Literal cases of each operator, kinds, plans and edge cases."""

import pytest
from pyspark.sql import functions as F

from skeinql.functions import calls
from skeinql.functions import scalars as S
from skeinql.operators.recursion import descendants, fixpoint, transitive_closure
from skeinql.operators.types import Hierarchy, TypeIndex, type_case, type_filter
from skeinql.plans.index import Indexes
from skeinql.plans.query import Equals, Query, product, total
from skeinql.sources.collections import exps, int_range, literal, table, value, write

SF = "/root/testdata/sf0.001"


def rows(q):
    return sorted((tuple(r) for r in (q.df if isinstance(q, Query) else q).collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kinds_decide_on_duplicates(spark):
    data, schema = [(1,), (2,), (2,), (3,), (5,), (5,), (3,)], "x int"
    bag, set_ = literal(spark, data, schema), literal(spark, data, schema, kind="set")
    assert len(rows(bag.map(y="x % 2"))) == 7 and rows(set_.map(y="x % 2")) == [(0,), (1,)]
    assert len(rows(bag.union(bag))) == 14 and len(rows(set_.union(set_))) == 4
    assert len(rows(bag.to_set())) == 4 and len(rows(bag.append(9))) == 8
    pairs = literal(spark, [(1, 2), (2, 4), (3, 4)], "k int, v int").to_map("k")
    assert pairs.kind == "map" and pairs.map("v").kind == "bag" and rows(pairs.map("v")) == [(2,), (4,), (4,)]
    with pytest.raises(ValueError):
        Query(bag.df, "heap")


def test_set_keeps_its_distinct_when_a_bag_takes_it(spark):
    q = literal(spark, [(1,), (2,), (3,)], "x int", kind="set").map(y="x % 2")
    assert len(rows(q.to_bag().map("y"))) == 2


def test_exists_keeps_multiplicity(spark):
    outer, inner = literal(spark, [(1,), (1,), (2,)], "x int"), literal(spark, [(1,), (1,), (1,)], "y int")
    assert rows(outer.exists(inner, "x = y")) == [(1,), (1,)] and rows(outer.not_exists(inner, "x = y")) == [(2,)]
    assert rows(outer.forall(inner, "y > 5", "x = y")) == [(2,)]


def test_nulls_are_equal(spark):
    a, b = literal(spark, [(1,), (None,)], "x int"), literal(spark, [(None,), (2,)], "y int")
    assert rows(a.join(b, "x", "y")) == [(None, None)]
    assert rows(a.member("x", b, "y")) == [(None,)] and rows(a.not_member("x", b, "y")) == [(1,)]
    assert rows(a.filter(S.same("x", F.lit(None)))) == [(None,)] and rows(a.filter(S.differ("x", F.lit(1)))) == [(None,)]


def test_groups_keep_nulls_and_empty_folds_are_neutral(spark):
    q = literal(spark, [(1, None), (1, 2), (None, 3)], "k int, v int")
    assert rows(q.group_by_sel("v", "vs", k="k").map("k", n=F.size("vs"))) == [(1, 2), (None, 1)]
    assert rows(q.index_by(k="k").map("k", n=F.size("elements"))) == [(1, 2), (None, 1)]
    none = q.filter("k > 9")
    assert rows(none.fold(total("v").alias("s"), product("v").alias("p"))) == [(0, 1.0)] and none.is_empty()
    assert rows(none.size()) == [(0,)]


def test_sequences(spark):
    q = int_range(spark, 1, 5)
    assert rows(q.zip_with_index()) == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert [len(r[1]) for r in rows(q.sliding(3))] == [3, 3] and [len(r[1]) for r in rows(q.sliding(9))] == [4]
    assert rows(q.head_option()) == [(1,)] and rows(q.last_option()) == [(4,)] and rows(q.filter("value > 9").head_option()) == []
    with pytest.raises(ValueError):
        literal(spark, [(1,)], "x int").zip_with_index()
    arrays = literal(spark, [([1, 2, 3, 4],), ([1],), ([],)], "a array<int>")
    assert [r[0] for r in arrays.map(w=S.sliding("a", 3)).df.collect()] == [[[1, 2, 3], [2, 3, 4]], [[1]], []]
    assert rows(arrays.map(h=S.head_option("a"), l=S.last_option("a"), s=S.array_sum("a"), p=S.array_product("a"), e=S.is_empty("a"))) == [(1, 1, 1, 1.0, False), (1, 4, 10, 24.0, False), (None, None, 0, 1.0, True)]
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        arrays.map(h=S.head("a")).df.collect()


def test_scalars(spark):
    q = literal(spark, [("abcab", 7.0, 0.0), (None, -7.0, 0.0), ("", 0.0, 0.0)], "s string, a double, b double")
    got = q.map(i=S.index_of("s", "b"), l=S.last_index_of("s", "b"), z=S.last_index_of("s", "z"), c=S.char_at("s", 1), t=S.concat("s", F.lit("!"))).df.collect()
    assert [tuple(r) for r in got] == [(1, 4, -1, "b", "abcab!"), (None, None, None, None, "null!"), (-1, -1, -1, None, "!")]
    d = [r[0] for r in q.map(d=S.divide("a", "b")).df.collect()]
    assert d[0] == float("inf") and d[1] == float("-inf") and d[2] != d[2]
    o = literal(spark, [(None,), (1,)], "x int")
    assert rows(o.filter(S.guarded(S.is_defined("x"), F.col("x") == 1))) == [(1,)]
    assert rows(o.map(f=S.option_fold("x", F.lit(-1), lambda x: x * 5), m=S.option_map("x", lambda x: x + 1), k=S.option_filter("x", lambda x: x > 1), g=S.get_or_else("x", 9))) == [(-1, None, None, 9), (5, 2, None, 1)]
    assert rows(literal(spark, [("5",), ("x",), ("",)], "c string").filter(S.is_digit("c"))) == [("5",)]


TYPES = Hierarchy([("Int", "Number"), ("Double", "Number"), ("Number", "Any"), ("String", "Any")])


def union(spark):
    return literal(spark, [("Int", 1, None, None), ("String", None, "foo", None), ("Double", None, None, 5.0), ("Other", None, None, None), (None, None, None, None), ("Int", 2, None, None)], "tag string, i int, s string, d double")


def test_types(spark, tmp_path):
    q, tag = union(spark), F.col("tag")
    assert TYPES.subtypes("Number") == ["Double", "Int", "Number"] and TYPES.is_subtype("Int", "Any") and not TYPES.is_subtype("Any", "Int")
    assert len(rows(type_filter(q, "tag", "Number", TYPES))) == 3
    i, s = F.col("i").cast("string"), F.col("s")
    assert rows(type_case(q, "tag", TYPES, ("Int", F.lit(True), i), ("String", F.lit(True), s))) == [("1",), ("2",), ("foo",)]
    first = type_case(q, "tag", TYPES, ("Int", F.col("i") > 1, F.lit("big")), ("Number", F.lit(True), F.lit("number")))
    assert rows(first) == [("big",), ("number",)]
    assert rows(q.map(x=TYPES.is_instance(tag, "Int"))).count((False,)) == 4
    assert rows(q.filter("tag = 'Int'").map(x=TYPES.as_instance(tag, "Number", i))) == [("1",), ("2",)]
    with pytest.raises(Exception, match="not a Number: String"):
        q.filter("tag = 'String'").map(x=TYPES.as_instance(tag, "Number", i)).df.collect()
    index = TypeIndex(q, "tag", TYPES, f"file://{tmp_path}/types")
    assert len(rows(index.get("Number"))) == 3 and "PartitionFilters: [" in physical(index.get("Number").df) and "/types" in physical(index.get("Number").df)
    indexes = Indexes(f"file://{tmp_path}")
    indexes.add("tags", q, "tag")
    assert "/tags" in physical(indexes.optimize(type_filter(q.filter("i > 1"), "tag", "Int", TYPES)).df) and rows(indexes.optimize(type_filter(q.filter("i > 1"), "tag", "Int", TYPES)).map("i")) == [(2,)]
    earned = q.collect(TYPES.if_instance(tag, "Number", F.col("i")), "n")
    assert rows(earned) == [(1,), (2,)] and "IN (" in plan(earned.df)


def test_closure(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    assert rows(transitive_closure(e)) == [(1, 2), (1, 3), (2, 3)]
    assert len(rows(transitive_closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 2)], "a int, b int")))) == 9
    assert rows(transitive_closure(e.limit(0))) == []
    assert rows(descendants(transitive_closure(e), 3)) == [(1,), (2,)]
    halves = fixpoint(spark.createDataFrame([(40,)], "x int"), lambda df: df.unionByName(df.select((F.col("x") / 2).cast("int").alias("x"))))
    assert rows(halves) == [(0,), (1,), (10,), (2,), (20,), (40,), (5,)]


def test_indexes(spark, tmp_path):
    orders, items = table(spark, SF, "orders"), table(spark, SF, "lineitem")
    indexes = Indexes(f"file://{tmp_path}")
    prefix = orders.join(items, "o_orderkey", "l_orderkey")
    indexes.add("status", orders, "o_orderstatus")
    indexes.add("nested", prefix, "o_orderstatus")
    for q, used in ((orders.filter("o_totalprice > 1000", Equals("( o_orderstatus )", "F")), "/status"), (prefix.filter("l_quantity > 40", Equals("o_orderstatus", "F")), "/nested")):
        best = indexes.optimize(q)
        assert used in physical(best.df) and "PartitionFilters: [isnotnull(_index_bucket" in physical(best.df)
        assert q.df.exceptAll(best.df.select(*q.df.columns)).isEmpty() and best.df.select(*q.df.columns).exceptAll(q.df).isEmpty()
        assert indexes.optimize(best) is best
    # An index on a prefix serves a longer query.
    longer = orders.join(table(spark, SF, "customer"), "o_custkey", "c_custkey").filter(Equals("o_orderstatus", "F"))
    assert "/status" in physical(indexes.optimize(longer).df) and longer.df.count() == indexes.optimize(longer).df.count()
    other = orders.filter(Equals("o_orderpriority", "1-URGENT"))
    assert indexes.optimize(other) is other
    indexes.drop("status")
    q = orders.filter(Equals("o_orderstatus", "F"))
    assert indexes.optimize(q) is q


def used(indexes, q):
    best = indexes.optimize(q)
    assert rows(best) == rows(q)
    return best is not q


def test_what_an_index_is_of(spark, tmp_path):
    a = literal(spark, [(1, 2, 3, ""), (2, 2, 2, None), (5, 2, 3, "x y")], "a int, b int, c int, s string", name="t")
    b = literal(spark, [(9, 9, 9, ""), (8, 8, 8, "")], "a int, b int, c int, s string", name="t")
    indexes = Indexes(f"file://{tmp_path}")
    indexes.add("s", a, "s")
    indexes.add("sum", a, "(a > b + c)")
    indexes.add("text", a, "concat(s, ' +  1')")
    assert used(indexes, a.filter(Equals("s", ""))) and used(indexes, a.filter(Equals("s", None)))
    assert not used(indexes, b.filter(Equals("s", "")))
    assert used(indexes, a.filter(Equals("a > c + b", False))) and not used(indexes, a.filter(Equals("c + a > b", True)))
    assert not used(indexes, a.filter(Equals("concat(s, ' + 1')", "x y + 1"))) and used(indexes, a.filter(Equals("concat( s,' +  1' )", "x y +  1")))
    indexes.add("a", a, "a")
    assert not used(indexes, a.filter(Equals("a", 1.5))) and used(indexes, a.filter(Equals("a", 1 << 40))) and not used(indexes, a.filter(Equals("a", "1")))
    # What a step makes is told apart from a column of the same plan under another name.
    indexes.add("let", a.let("x", "a * 2"), "x")
    assert used(indexes, a.let("x", "2 * a").filter(Equals("x", 4))) and not used(indexes, a.let("y", "a * 2").filter(Equals("y", 4)))


def test_a_kept_subquery_is_read(spark, tmp_path):
    orders = table(spark, SF, "orders")
    indexes = Indexes(f"file://{tmp_path}")
    indexes.keep("big", orders.filter("o_totalprice > 200000"))
    q = orders.filter("o_totalprice > 200000")
    assert "/big" in physical(indexes.optimize(q).df) and used(indexes, q) and not used(indexes, orders.filter("o_totalprice > 200001"))


def test_folds_of_groups_make_no_lists(spark):
    q = literal(spark, [(1, 4), (1, None), (2, 3), (2, 3), (None, 7)], "k int, v int")
    lists = q.group_by_sel("v", "vs", k="k")
    columns = dict(n=F.size("vs"), m="size(vs)", s=S.array_sum("vs"), p=S.array_product("vs"), a=S.exists("vs", lambda x: x > 3), e=S.forall("vs", lambda x: x > 2), h=S.head_option(S.sorted_("vs")), l=S.last_option(S.sorted_("vs")), i=S.is_empty("vs"))
    fused = lists.map("k", **columns)
    plain = lists.filter(F.lit(True)).map("k", **columns)
    assert "collect_list" not in plan(fused.df) and "collect_list" in plan(plain.df)
    assert rows(fused) == rows(plain) and fused.df.schema.names == plain.df.schema.names
    assert [f.dataType for f in fused.df.schema] == [f.dataType for f in plain.df.schema]
    of_set = q.to_set().group_by_sel("v", "vs", k="k")
    assert rows(of_set.map("k", n=F.size("vs"), s=S.array_sum("vs"))) == rows(of_set.filter(F.lit(True)).map("k", n=F.size("vs"), s=S.array_sum("vs")))
    assert "collect_list" in plan(lists.map("k", "vs").df)


def test_counts_that_ask_for_emptiness(spark):
    a, b = literal(spark, [(1,), (1,), (2,), (None,)], "x int"), literal(spark, [(1,), (1,), (3,)], "y int")
    for op, n in ((">", 0), ("==", 0), (">=", 2), ("!=", 2), ("<", 2), ("<=", 0)):
        count = {1: 2, 2: 0, None: 0}
        assert rows(a.counted_by(b, op, n, "x = y")) == sorted(((x,) for x in (1, 1, 2, None) if S.COMPARE[op](count[x], n)), key=str)
    assert "LeftSemi" in plan(a.counted_by(b, ">", 0, "x = y").df) and "Aggregate" not in plan(a.counted_by(b, "==", 0, "x = y").df)
    arrays = literal(spark, [([1, 5],), ([],), (None,)], "a array<int>")
    big = S.filtered("a", lambda x: x > 3)
    assert rows(arrays.map(e=S.sized(big, "==", 0), n=S.sized(big, ">", 0), t=S.sized("a", ">", 1))) == [(False, True, True), (True, False, False), (True, False, False)]
    assert "exists(" in plan(arrays.filter(S.sized(big, ">", 0)).df)


def test_more_functions(spark):
    q = literal(spark, [(1, "a"), (2, "a"), (2, "b")], "x int, k string")
    assert rows(q.to_seq("x").to_map("k")) == [(2, "a"), (2, "b")]
    assert rows(q.group(calls.fold_call("last", "long", lambda v: int(v.max()))("x").alias("m"), k="k")) == [("a", 2), ("b", 2)]
    twice = calls.TableCall("twice", "x int, k string", lambda batches: (b for c in batches for b in (c, c)))
    assert len(rows(q.table_map(twice))) == 6
    big = literal(spark, [(2**31,), (2**31 - 1,), (-(2**31) - 1,), (2**40 + 5,)], "x long")
    assert [r[0] for r in big.map(w=S.wrapped("x")).df.collect()] == [-(2**31), 2**31 - 1, 2**31 - 1, 5]
    assert rows(literal(spark, [(1,), (None,)], "x int").flat_map("y", S.to_iterable("x"))) == [(1,)]


def test_plans(spark):
    c, o = table(spark, SF, "customer"), table(spark, SF, "orders")
    assert "LeftAnti" in plan(c.not_exists(o, "o_custkey = c_custkey").df) and "LeftSemi" in plan(c.member("c_custkey", o, "o_custkey").df)
    product_ = c.product(o).filter("c_custkey = o_custkey").map("c_custkey").df
    assert "CartesianProduct" not in physical(product_) and "NestedLoop" not in physical(product_)
    composed = c.join(o, "c_custkey", "o_custkey").filter("c_acctbal > 0").map("c_custkey").df
    assert "PushedFilters: [IsNotNull(c_acctbal), GreaterThan(c_acctbal,0.0)" in composed._jdf.queryExecution().executedPlan().toString()
    assert "c_name" not in physical(composed)
    hoisted = literal(spark, [(1, [1, 2])], "x int, a array<int>").unnest("a", "e").filter("x < 3").df
    assert plan(hoisted).index("Generate") < plan(hoisted).index("Filter")


def test_values_and_tables(spark, tmp_path):
    q = exps(spark, [F.lit(1), F.lit(1)], kind="set")
    assert [tuple(r) for r in value(q)] == [(1,)]
    assert rows(write(literal(spark, [(1, "a"), (2, "b")], "x int, p string"), f"file://{tmp_path}/t", ["p"])) == [(1, "a"), (2, "b")]
    a, b = literal(spark, [(1,), (1,)], "x int"), literal(spark, [(1,)], "x int")
    assert b.subset_of(a) and not a.subset_of(b) and rows(a.counted()) == [(1, 2)]
    assert rows(a.bag_difference(b)) == [(1,)] and rows(a.bag_intersect(b)) == [(1,)]


def test_calls(spark):
    q = literal(spark, [(1, "a"), (None, "b")], "x int, s string")
    twice = calls.by_row("twice", "long", lambda x: int(x) * 2)
    assert rows(q.map(y=twice("x"))) == [(2,), (None,)]
    assert twice == calls.by_row("twice", "long", lambda x: 0) and twice != calls.by_row("thrice", "long", lambda x: 0)
    assert rows(q.map(y=calls.Call("seven", "long", lambda: 7)())) == [(7,), (7,)]
    assert rows(q.map(y=calls.global_call("upper", "s"), p=calls.partial((F.col("x") == 1, "one")))) == [("A", "one"), ("B", None)]
    m = F.create_map(F.lit("k"), F.lit(1))
    assert rows(q.map(y=calls.defined_at(m, F.lit("k")), n=calls.defined_at(m, F.col("s")))) == [(True, False), (True, False)]
    forced = q.force()
    assert rows(forced.view()) == rows(q) and forced.kind == q.kind
    forced.frame.unpersist()
