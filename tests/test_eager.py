import random

from pyspark.sql import functions as F

from tessaria.operators import eager


def test_join_of_states_equals_join_of_rows(spark):
    rng = random.Random(1)
    left = [(rng.choice(["hot"] * 5 + ["a", "b", "c", None]), rng.choice(["SP", "RJ", None]), rng.randrange(9)) for _ in range(300)]
    right = [(rng.choice(["hot"] * 5 + ["a", "d", None]), rng.choice([None, *range(9)])) for _ in range(200)]
    a = spark.createDataFrame(left, "k string, g string, x int")
    b = spark.createDataFrame(right, "k string, y int")
    s = eager.reduce_by_key(a, ["k"], {"x": F.col("x")}, carry=["g"])
    t = eager.reduce_by_key(b, ["k"], {"y": F.col("y")})
    got = eager.roll_up(eager.join_states(s, t, "k", ["x"], ["y"]), ["g"], ["x", "y"])
    want = a.join(b, "k", "left").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))
    assert {(r.g, r[eager.COUNT], r.x, r.y) for r in got.collect()} == {(r.g, r.n, r.x, r.y) for r in want.collect()}


def test_empty_and_unmatched(spark):
    a = spark.createDataFrame([], "k string, g string, x int")
    b = spark.createDataFrame([("z", 1)], "k string, y int")
    s, t = eager.reduce_by_key(a, ["k"], {"x": F.col("x")}, carry=["g"]), eager.reduce_by_key(b, ["k"], {"y": F.col("y")})
    assert eager.join_states(s, t, "k", ["x"], ["y"]).count() == 0
    out = eager.join_states(t, s, "k", ["y"], ["x"]).first()
    assert (out[eager.COUNT], out.y, out.x) == (1, 1, None)


def test_latest_row_with_ties_and_null_times(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, None), ("b", None, "w"), (None, 1, "n")], "k string, at int, v string")
    assert {(r.k, r.v) for r in eager.latest(df, ["k"], "at", ["v"]).collect()} == {("a", "z"), ("b", "w"), (None, "n")}


def test_skewed_plan_aggregates_before_the_exchange(spark, small):
    from tessaria import data_queries

    plan = data_queries.p7_state_rollup(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan and "CartesianProduct" not in plan
