import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessaria.operators import orphans
from tessaria.sources.tables import norm_id

ROWS = T.StructType([T.StructField("id", T.StringType()), T.StructField("loaded_at", T.TimestampType()), T.StructField("state", T.StringType())])


def day(n):
    return None if n is None else dt.datetime(2018, 1, 1) + dt.timedelta(days=n)


def run(spark, children, parents, removed, n_ranges=None):
    c = spark.createDataFrame([(k, day(n), "x") for k, n in children], ROWS)
    p = spark.createDataFrame([(k, day(n), "y") for k, n in parents], ROWS)
    r = spark.createDataFrame([("p", k) for k in removed], "table_name string, key_value string").select("table_name", norm_id("key_value").alias("k"))
    args = ([orphans.Reference("c", "id", "p", c, norm_id("id"))], [orphans.Parent("p", p, norm_id("id"))], r)
    keys = {(x.ref_value, x.state) for x in orphans.orphan_keys(*args, n_ranges=n_ranges).collect()}
    counts = {(x.period, x.state): x.n_keys for x in orphans.orphan_counts(*args, n_ranges=n_ranges).collect()}
    return keys, counts


def test_states_with_nulls_repeats_and_spellings(spark):
    children = [("A", 0), (" a ", 0), ("b", 0), ("C", 5), ("d", None), (None, 0), ("  ", 0), ("e", 3), ("e", 40), ("f", 1), ("ab" * 16, 2)]
    keys, counts = run(spark, children, [("a", 1), ("a", 9), ("c", 5), ("d", 3), ("e", 3)], ["B", "a"])
    assert keys == {("a", "late"), ("b", "deleted"), ("f", "missing"), ("ab" * 16, "missing")}
    assert counts == {("2018-01", "late"): 1, ("2018-01", "deleted"): 1, ("2018-01", "missing"): 2}


def test_empty_tables(spark):
    assert run(spark, [], [], []) == (set(), {})
    assert run(spark, [("a", 0)], [], [])[0] == {("a", "missing")}
    assert run(spark, [], [("a", 0)], ["a"]) == (set(), {})


def test_against_brute_force_with_a_hot_key_and_dense_ranges(spark):
    rng = random.Random(4)
    children = [(f"k{rng.randrange(9000)}", rng.randrange(90)) for _ in range(9000)] + [("hot", rng.randrange(90)) for _ in range(4000)]
    parents = [(f"k{i}", rng.randrange(90)) for i in range(0, 9000, 2)]
    removed = [f"k{i}" for i in range(1, 9000, 4)]
    born, gone = {}, set(removed)
    for k, n in parents:
        born[k] = min(n, born.get(k, n))
    want = set()
    for k, n in children:
        if k not in born:
            want.add((k, "deleted" if k in gone else "missing"))
        elif n < born[k]:
            want.add((k, "late"))
    assert run(spark, children, parents, removed, n_ranges=1)[0] == want
    assert run(spark, children, parents, removed)[0] == want


def test_container_round_trip():
    import numpy as np

    for n in (0, 1, 5000, 70000):
        codes = np.unique(np.random.default_rng(n).integers(0, 200_000, n))
        assert (orphans._codes(orphans._squeeze(codes)) == codes).all()


def test_pack_round_trip(spark):
    keys = ["ab" * 16, "AB" * 16, "x", "ção ", "0" * 31]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(orphans.unpack(orphans.pack(F.col("k")))).collect()] == keys
