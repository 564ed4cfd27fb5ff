import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tessaria.functions import dist, fdr, series, tests


def test_distributions():
    assert dist.t_two_sided(2.0, 5) == pytest.approx(0.101939, abs=1e-6)
    assert dist.t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert dist.t_quantile(0.975, 1e6) == pytest.approx(dist.Z95, abs=1e-5)
    assert dist.normal_two_sided(1.959963984540054) == pytest.approx(0.05)
    assert dist.scan_corrected_z(86) > dist.scan_corrected_z(12) > dist.Z95


def test_sample_sizes():
    assert tests.required_sample_size(0.836892, 0.049690) == 757
    assert tests.required_sample_size(0.1, 0) == 0 and tests.required_sample_size(1.2, 0.1) == 0
    assert tests.required_sample_size_continuous(1.0, 0.5) == 63


def test_welch_and_edges(spark):
    rng = random.Random(1)
    a, b = [rng.gauss(0, 1) for _ in range(40)], [rng.gauss(0.5, 2) for _ in range(60)]
    rows = [("t", "e", x) for x in a] + [("t", "b", x) for x in b] + [("few", "e", 1.0), ("few", "b", 2.0), ("few", "b", 3.0)] + [("flat", s, v) for s, v in (("e", 2.0), ("e", 2.0), ("b", 1.0), ("b", 1.0))] + [("nan", "e", float("nan")), ("nan", "b", None)]
    df = spark.createDataFrame(rows, "k string, s string, v double").groupBy("k").agg(*tests.moments(F.col("v"), F.col("s") == "e", "e"), *tests.moments(F.col("v"), F.col("s") == "b", "b"))
    r = {x.k: x for x in tests.with_welch(df).collect()}
    va, vb = statistics.variance(a) / 40, statistics.variance(b) / 60
    t = (statistics.mean(a) - statistics.mean(b)) / math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va**2 / 39 + vb**2 / 59)
    assert r["t"].t == pytest.approx(t) and r["t"].dof == pytest.approx(dof) and r["t"].p_value == pytest.approx(dist.t_two_sided(t, dof))
    assert (r["few"].estimate, r["few"].p_value) == (0.0, 1.0)
    assert (r["flat"].estimate, r["flat"].p_value, r["flat"].ci_low) == (1.0, 1.0, 1.0)
    assert (r["nan"].e_n, r["nan"].b_n, r["nan"].p_value) == (0, 0, 1.0)


def test_two_proportions(spark):
    df = spark.createDataFrame([("a", 30, 100, 50, 100), ("none", 0, 0, 5, 10), ("same", 5, 5, 7, 7)], "k string, x1 int, n1 int, x2 int, n2 int")
    r = {x.k: x for x in tests.with_two_proportion(df, "x1", "n1", "x2", "n2").collect()}
    assert r["a"].estimate == pytest.approx(-0.2) and r["a"].z == pytest.approx(-2.886751, abs=1e-6)
    assert (r["none"].estimate, r["none"].p_value) == (0.0, 1.0)
    assert (r["same"].z, r["same"].p_value) == (0.0, 1.0)


def test_false_discovery_adjustment(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.216]
    want = [0.01, 0.04, 0.084, 0.084, 0.084, 0.1, 0.10571, 0.216, 0.216, 0.216]
    rows = fdr.adjusted(spark.createDataFrame([(i, v) for i, v in enumerate(p)] + [(99, None)], "i int, p_value double")).orderBy("i").collect()
    assert [r.p_adjusted for r in rows[:-1]] == pytest.approx(want, abs=1e-4)
    assert [r.rejected for r in rows] == [True, True] + [False] * 9 and rows[-1].p_adjusted is None
    assert fdr.adjusted(spark.createDataFrame([], "p_value double")).count() == 0


def test_difference_in_differences():
    cells = {("treat", "post"): (50, 8.0, 1.0), ("treat", "pre"): (50, 10.0, 1.0), ("control", "post"): (50, 10.0, 1.0), ("control", "pre"): (50, 10.0, 1.0)}
    r = tests.difference_in_differences(cells, [0.1, -0.1, 0.1, -0.1, 0.1, -0.1])
    assert r["estimate"] == -2.0 and r["ci_high"] < 0 and r["parallel_ok"]
    assert not tests.difference_in_differences(cells, [1, 2, 3, 4, 5, 6.1])["parallel_ok"]
    assert tests.difference_in_differences({})["p_value"] == 1.0


def test_bootstrap_covers_the_mean(spark):
    r = tests.bootstrap_ci(spark.range(2000).select((F.col("id") % 10).cast("double").alias("v")), "v", 200).first()
    assert r.low < 4.5 < r.high and r.high - r.low < 0.5


def make(spark, values):
    import datetime as dt

    return series.indexed(spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(7 * i), None if v is None else float(v)) for i, v in enumerate(values)], "week date, m double"), "m")


def test_robust_baseline(spark):
    r = series.robust_baseline(make(spark, [1, 2, 3, 4, 100, None, float("nan")])).first()
    assert (r.n, r.center) == (5, 3.0) and r.scale == pytest.approx(max(1.4826, 2 / 1.349))
    assert series.robust_baseline(make(spark, [5, 5, 5, 5, 5, 5])).first().scale == 0.0
    flat = series.robust_baseline(make(spark, [5, 5, 5, 5, 9])).first()
    assert flat.scale == pytest.approx(statistics.stdev([5, 5, 5, 5, 9]))


NOISE = [10, 11, 9, 10, 12, 8, 10, 11, 9, 10, 12, 8, 10, 11, 9, 10]


def test_runs_windows_and_ties(spark):
    z = series.with_z(make(spark, NOISE + [2, 1, 2, 8, 10] + NOISE + [20, 19, 20, 10]))
    runs = {(r.direction, r.start_i, r.end_i, r.length) for r in series.sustained_runs(z).collect()}
    assert runs == {("down", 16, 18, 3), ("up", 37, 39, 3)}
    core = series.event_core(z)
    assert core.first().direction == "down"  # on ties downward runs first
    roles = {r.i: r.role for r in series.event_window(z, core).collect()}
    assert roles[16] == roles[18] == "event" and roles[21] in ("buffer", "baseline", "event") and roles[0] == "baseline"
    assert series.event_core(series.with_z(make(spark, NOISE))).count() == 0
    assert series.event_core(series.with_z(make(spark, NOISE + [60]))).first().rule == "extreme"


def test_cusum_equals_its_recursion(spark):
    rng = random.Random(8)
    values = [rng.gauss(0, 1) + (2 if i > 30 else 0) if i % 11 else None for i in range(60)]
    z = series.with_z(make(spark, values))
    rows = series.cusum(z).orderBy("i").collect()
    hi = lo = 0.0
    for r in rows:
        hi, lo = (0.0, 0.0) if r.value is None else (max(0.0, hi + r.z - 0.5), min(0.0, lo + r.z + 0.5))
        assert (r.hi, r.lo) == (pytest.approx(hi, abs=1e-9), pytest.approx(lo, abs=1e-9))
    first = series.first_crossing(series.cusum(z)).collect()
    assert first and first[0].crossed in ("up", "down")


def test_lead_lag(spark):
    import datetime as dt

    x = [math.sin(i / 3) for i in range(50)]
    df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(7 * i), x[i], x[i - 2]) for i in range(2, 50)], "week date, a double, b double")
    best = series.lead_lag(df, "a", "b").where("best").collect()
    assert [r.lag for r in best] == [2] and best[0].r == pytest.approx(1.0)
    assert series.lead_lag(df.limit(2), "a", "b").count() == 0


def test_composite_score():
    assert tests.composite_score(1, 1, 1, 1) == pytest.approx(1) and tests.composite_score(9, -1, 0.5, 0) == pytest.approx(0.35 + 0.125)
