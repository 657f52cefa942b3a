import pytest
from pyspark.sql import functions as F

from skeinql.streaming import views


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_view_follows_a_stream(spark, tmp_path):
    log, schema = f"{tmp_path}/log", "op string, x int"
    put = lambda *changes: spark.createDataFrame(changes, schema).coalesce(1).write.mode("append").parquet(log)
    view = views.MaintainedView(f"file://{tmp_path}/view", lambda c: views.map_changes(views.from_log(c), (F.col("x") * 10).alias("y")))
    with pytest.raises(ValueError):
        view.read(spark)
    steps = [[("include", 1), ("include", 2), ("include", 3)], [("include", 4), ("include", 4), ("remove", 2)], [("remove", 4), ("include", 2)]]
    want = [[10, 20, 30], [10, 30, 40, 40], [10, 20, 30, 40]]
    for step, now in zip(steps, want, strict=True):
        put(*step)
        q = view.start(spark.readStream.schema(schema).parquet(log), f"{tmp_path}/checkpoint")
        q.awaitTermination(120)
        assert rows(views.expanded(view.read(spark))) == [(y,) for y in now]
    assert rows(views.as_set(view.read(spark))) == [(10,), (20,), (30,), (40,)]
    again = views.MaintainedView(f"file://{tmp_path}/view")
    assert rows(views.as_set(again.read(spark))) == [(10,), (20,), (30,), (40,)] and again.versions(spark) == [1, 2]


def test_joins_and_folds_of_changes(spark):
    left, right = views.include(spark.createDataFrame([(10,), (20,), (30,)], "i int")), views.include(spark.createDataFrame([(20,), (40,)], "j int"))
    on = F.col("j") == 2 * F.col("i")
    d = views.join_delta(left, right, views.include(spark.createDataFrame([(20,)], "i int")), views.remove(spark.createDataFrame([(20,)], "j int")), on)
    after = views.net(views.joined(left, right, on).unionByName(d))
    assert rows(after) == [(20, 40, 2)]
    c = views.update(spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 5)], "k string, v int")).unionByName(views.include(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))).unionByName(views.remove(spark.createDataFrame([("b", 2)], "k string, v int")))
    assert rows(views.grouped(c, ["k"], total="v")) == [("a", 1, 5)]
    assert rows(views.net(after.unionByName(views.reset(after)))) == []
    with pytest.raises(Exception, match="no such change"):
        views.from_log(spark.createDataFrame([("put", 1)], "op string, x int")).collect()


def test_negation_and_folds_that_no_sum_undoes(spark):
    of = lambda schema, *r: spark.createDataFrame(list(r), schema)
    left, right = views.include(of("k int, v string", (1, "a"), (2, "b"), (None, "n"), (4, "d"))), views.include(of("k int", (1,), (1,), (None,), (9,)))
    d_left = views.remove(of("k int, v string", (4, "d"))).unionByName(views.include(of("k int, v string", (5, "e"), (9, "i"))))
    d_right = views.remove(of("k int", (1,), (None,))).unionByName(views.include(of("k int", (2,))))
    d = views.not_exists_delta(left, right, d_left, d_right, ["k"])
    key = lambda r: str(r)
    assert sorted(map(tuple, d.collect()), key=key) == sorted([(2, "b", -1), (None, "n", 1), (4, "d", -1), (5, "e", 1)], key=key)
    base = views.include(of("k string, v int", ("a", 1), ("a", 2), ("b", 5), ("c", 7)))
    change = views.remove(of("k string, v int", ("a", 1), ("b", 5))).unionByName(views.include(of("k string, v int", ("d", 3))))
    assert rows(views.fold_delta(base, change, ["k"], F.min("v").alias("least"))) == [("a", 1, -1), ("a", 2, 1), ("b", 5, -1), ("d", 3, 1)]
    arrays = views.remove(of("a array<int>", ([1, 2, 2],)))
    assert rows(views.net(views.unnested(arrays, "a", "x").select("x", views.MULT))) == [(1, -1), (2, -2)]
