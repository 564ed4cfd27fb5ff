"""Two-sample tests on sufficient statistics, as column expressions over one row per test."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaria.functions.dist import Z95, normal_pvalue, t_critical95, t_pvalue, t_quantile, t_two_sided

POWER = 0.80


def moments(value: Column, when: Column, name: str) -> list[Column]:
    """Aggregates n, mean and sample variance of a value where a condition holds, as name_n, name_mean, name_var."""
    x = F.when(when, F.nanvl(value.cast("double"), F.lit(None).cast("double")))
    return [F.count(x).alias(f"{name}_n"), F.avg(x).alias(f"{name}_mean"), F.var_samp(x).alias(f"{name}_var")]


def with_welch(df: DataFrame, a: str = "e", b: str = "b") -> DataFrame:
    """Adds estimate (a - b), se, t, dof, p_value, ci_low, ci_high from the moments of a and b.

    Fewer than two values on a side: estimate 0 and p 1; no variance at all: the difference with p 1.
    """
    n1, n2, v1, v2 = F.col(f"{a}_n"), F.col(f"{b}_n"), F.col(f"{a}_var"), F.col(f"{b}_var")
    enough = (n1 >= 2) & (n2 >= 2)
    s1, s2 = F.try_divide(v1, n1), F.try_divide(v2, n2)
    se = F.when(enough, F.sqrt(s1 + s2))
    ok = enough & (se > 0)
    df = df.withColumn("estimate", F.when(enough, F.col(f"{a}_mean") - F.col(f"{b}_mean")).otherwise(0.0)).withColumn("se", se)
    df = df.withColumn("t", F.when(ok, F.try_divide(F.col("estimate"), F.col("se"))))
    dof = F.try_divide((s1 + s2) * (s1 + s2), F.try_divide(s1 * s1, n1 - 1) + F.try_divide(s2 * s2, n2 - 1))
    df = df.withColumn("dof", F.when(ok, dof))
    half = F.coalesce(t_critical95("dof") * F.col("se"), F.lit(0.0))
    return df.withColumn("p_value", F.coalesce(t_pvalue("t", "dof"), F.lit(1.0))).withColumn("_h", half).withColumn("ci_low", F.col("estimate") - F.col("_h")).withColumn("ci_high", F.col("estimate") + F.col("_h")).drop("_h")


def welch(e: Sequence[float | None], b: Sequence[float | None]) -> dict:
    """The same for one test in memory: (n, mean, variance) of both sides."""
    (n1, m1, v1), (n2, m2, v2) = e, b
    out = {"e_n": n1, "e_mean": m1, "b_n": n2, "b_mean": m2, "estimate": 0.0, "p_value": 1.0, "ci_low": 0.0, "ci_high": 0.0}
    if n1 < 2 or n2 < 2:
        return out
    d, s1, s2 = m1 - m2, v1 / n1, v2 / n2
    if s1 + s2 <= 0:
        return out | {"estimate": d, "ci_low": d, "ci_high": d}
    se, dof = math.sqrt(s1 + s2), (s1 + s2) ** 2 / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1))
    half = t_quantile(0.975, dof) * se
    return out | {"estimate": d, "se": se, "dof": dof, "p_value": t_two_sided(d / se, dof), "ci_low": d - half, "ci_high": d + half}


def sides(r) -> tuple[tuple, tuple]:
    """The moments e and b of a row as made by `moments`."""
    return tuple((r[f"{w}_n"], r[f"{w}_mean"], r[f"{w}_var"] or 0.0) for w in "eb")


def moments_of(values: Sequence[float]) -> tuple[int, float | None, float]:
    n = len(values)
    mean = sum(values) / n if n else None
    return n, mean, sum((v - mean) ** 2 for v in values) / (n - 1) if n > 1 else 0.0


def two_proportion(x1: Column, n1: Column, x2: Column, n2: Column) -> dict[str, Column]:
    """estimate, ci_low, ci_high (unpooled) and z (pooled) of a difference of shares; zeros where a side is empty."""
    x1, n1, x2, n2 = (c.cast("double") for c in (x1, n1, x2, n2))
    ok = (n1 > 0) & (n2 > 0)
    p1, p2 = F.try_divide(x1, n1), F.try_divide(x2, n2)
    se = F.sqrt(F.try_divide(p1 * (1 - p1), n1) + F.try_divide(p2 * (1 - p2), n2))
    pool = F.try_divide(x1 + x2, n1 + n2)
    pooled = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    zero = F.lit(0.0)
    return {
        "estimate": F.when(ok, p1 - p2).otherwise(zero),
        "ci_low": F.when(ok, p1 - p2 - Z95 * se).otherwise(zero),
        "ci_high": F.when(ok, p1 - p2 + Z95 * se).otherwise(zero),
        "z": F.when(ok & (pooled > 0), F.try_divide(p1 - p2, pooled)).otherwise(zero),
    }


def with_two_proportion(df: DataFrame, x1: str, n1: str, x2: str, n2: str) -> DataFrame:
    for name, c in two_proportion(F.col(x1), F.col(n1), F.col(x2), F.col(n2)).items():
        df = df.withColumn(name, c)
    empty = (F.col(n1) <= 0) | (F.col(n2) <= 0)
    return df.withColumn("p_value", F.when(empty, F.lit(1.0)).otherwise(normal_pvalue("z")))


def significant(low: Column, high: Column) -> Column:
    """The interval excludes zero."""
    return (low > 0) | (high < 0)


def statistical_strength(est: Column, low: Column, high: Column) -> Column:
    se = (high - low) / (2 * 1.96)
    return F.when((se > 0) & ~F.isnan(se), F.least(F.lit(1.0), F.try_divide(F.abs(est), se) / 4)).otherwise(0.0)


def composite_score(stat: float, temporal: float, specificity: float, discrimination: float) -> float:
    """Evidence score of an explanation from four parts, each clipped to 0..1."""
    clip = lambda x: max(0.0, min(1.0, x))
    return 0.35 * clip(stat) + 0.20 * clip(temporal) + 0.25 * clip(specificity) + 0.20 * clip(discrimination)


def required_sample_size(p: float, mde: float, alpha: float = 0.05, power: float = POWER) -> int:
    """Per arm, to see a change of a share by mde."""
    if not 0 < p < 1 or mde <= 0:
        return 0
    za, zb = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(power)
    q = min(max(p + mde, 1e-6), 1 - 1e-6)
    mean = (p + q) / 2
    top = za * math.sqrt(2 * mean * (1 - mean)) + zb * math.sqrt(p * (1 - p) + q * (1 - q))
    return math.ceil((top / (q - p)) ** 2)


def required_sample_size_continuous(sd: float, mde: float, alpha: float = 0.05, power: float = POWER) -> int:
    if sd <= 0 or mde <= 0:
        return 0
    za, zb = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(power)
    return math.ceil(2 * ((za + zb) * sd / mde) ** 2)


def difference_in_differences(cells: dict[tuple[str, str], tuple[int, float, float]], pre: list[float] | None = None) -> dict:
    """From (n, mean, var) of ('treat'|'control', 'post'|'pre'): estimate, se, interval, p; and whether the difference of
    the groups before the event had no trend (slope p above 0.10 over at least four periods)."""
    from tessaria.functions.dist import normal_two_sided, t_two_sided

    get = lambda g, t: cells.get((g, t), (0, 0.0, 0.0))
    est = (get("treat", "post")[1] - get("treat", "pre")[1]) - (get("control", "post")[1] - get("control", "pre")[1])
    se = math.sqrt(sum((v or 0.0) / n for n, _, v in (get(g, t) for g in ("treat", "control") for t in ("post", "pre")) if n))
    p = normal_two_sided(est / se) if se > 0 else 1.0
    trend = 1.0
    if pre and len(pre) >= 4:
        x, y = np.arange(len(pre), dtype=float), np.asarray(pre, float)
        if y.std() > 0:
            r = float(np.corrcoef(x, y)[0, 1])
            dof = len(pre) - 2
            trend = t_two_sided(r * math.sqrt(dof / max(1e-300, 1 - r * r)), dof)
    return {"estimate": est, "se": se, "ci_low": est - Z95 * se, "ci_high": est + Z95 * se, "p_value": p, "parallel_p": trend, "parallel_ok": bool(pre and len(pre) >= 4 and trend > 0.10)}


def bootstrap_ci(df: DataFrame, value: str, replicates: int = 500, seed: int = 20260830) -> DataFrame:
    """(low, high): percentile interval of the mean by Poisson resampling, every row weighted once per replicate.

    Weights are drawn inside Arrow batches and reduced to (sum, count) per replicate before anything is shuffled.
    """

    def run(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId() if TaskContext.get() else 0])
        sums, counts = np.zeros(replicates), np.zeros(replicates)
        for batch in batches:
            x = batch[value].dropna().to_numpy(float)
            for part in np.array_split(x, max(1, len(x) // 4096)):
                w = rng.poisson(1.0, (replicates, len(part)))
                sums += w @ part
                counts += w.sum(1)
        yield pd.DataFrame({"replicate": range(replicates), "s": sums, "k": counts})

    per = df.select(F.col(value).cast("double").alias(value)).mapInPandas(run, "replicate int, s double, k double")
    means = per.groupBy("replicate").agg((F.sum("s") / F.sum("k")).alias("m"))
    return means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
