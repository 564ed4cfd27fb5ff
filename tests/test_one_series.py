"""One series in memory beside the operators over many."""

import random

import pytest

from pyspark.sql import functions as F

from tessaria.functions import one_series, series, tests


def make(kind, rng):
    x = [rng.gauss(10, 1) for _ in range(60)]
    if kind == "run":
        x[30:37] = [v - 6 for v in x[30:37]]
    elif kind == "extreme":
        x[20] += 40
    elif kind == "gaps":
        x[25:29] = [v + 9 for v in x[25:29]]
        x[10] = x[40] = None
    elif kind == "flat":
        x = [5.0] * 60
    return x


KINDS = ("run", "extreme", "gaps", "noise", "flat")


def test_equals_the_operators_over_many_series(spark):
    rng = random.Random(11)
    every = {k: make(k, rng) for k in KINDS}
    df = spark.createDataFrame([(k, i, f"w{i:03d}", v) for k, x in every.items() for i, v in enumerate(x)], "k string, i int, week string, value double")
    z = series.with_z(df, ["k"]).cache()
    cores = {r.k: r for r in series.event_core(z, ["k"]).collect()}
    windows = {}
    for r in series.event_window(z, series.event_core(z, ["k"]), ["k"]).orderBy("i").collect():
        windows.setdefault(r.k, []).append(r.role)
    crossed = {r.k: r.i for r in series.first_crossing(series.cusum(z, ["k"]), ["k"]).collect()}
    zs = {}
    for r in z.orderBy("i").collect():
        zs.setdefault(r.k, []).append(r.z)
    for k, x in every.items():
        mine = one_series.band(x).z(x)
        assert mine == pytest.approx(zs[k])
        core = one_series.core(mine)
        assert (core is None) == (k not in cores), k
        if core:
            assert (core.rule, core.direction, core.start, core.end) == (cores[k].rule, cores[k].direction, cores[k].start_i, cores[k].end_i)
            assert one_series.roles(mine, core) == windows[k]
        assert one_series.first_crossing(x, mine) == crossed.get(k)
    assert one_series.core([]) is None and one_series.band([]).scale == 0.0 and one_series.band([None, 1.0]).scale == 0.0


def test_lag(spark):
    rng = random.Random(3)
    cause = [rng.random() for _ in range(40)]
    for lag in (-2, 0, 3):
        effect = [cause[i - lag] if 0 <= i - lag < 40 else 0.5 for i in range(40)]
        df = spark.createDataFrame([(f"w{i:03d}", a, b) for i, (a, b) in enumerate(zip(cause, effect))], "week string, x double, y double")
        assert one_series.best_lag(cause, effect) == series.lead_lag(df, "x", "y").where("best").first().lag == lag
    assert one_series.best_lag([1.0, 1.0, 1.0], [1.0, 2.0, 3.0]) is None and one_series.best_lag([], []) is None


def test_welch_in_memory(spark):
    rng = random.Random(5)
    for e, b in (([rng.gauss(1, 2) for _ in range(30)], [rng.gauss(0, 1) for _ in range(9)]), ([1.0], [2.0, 3.0]), ([2.0, 2.0], [1.0, 1.0]), ([], [])):
        df = spark.createDataFrame([("e", v) for v in e] + [("b", v) for v in b], "s string, v double")
        want = tests.with_welch(df.agg(*tests.moments(F.col("v"), F.col("s") == "e", "e"), *tests.moments(F.col("v"), F.col("s") == "b", "b"))).first()
        got = tests.welch(tests.moments_of(e), tests.moments_of(b))
        for c in ("estimate", "p_value", "ci_low", "ci_high"):
            assert got[c] == pytest.approx(want[c])
