"""Did the data change rather than the business? Recent weeks held against all before, one conditional aggregate each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.functions import tests
from tessaria.functions.series import recent_and_prior
from tessaria.plans.parallel import at_once

VOLUME, COVERAGE, NULLS, DRIFT = 0.40, 0.15, 0.10, 0.30


def with_part(panel: DataFrame) -> DataFrame:
    """Rows with `part` ('recent', 'prior'); none where the history is too short."""
    return panel.join(F.broadcast(recent_and_prior(panel)), "week")  # one row per week


def row_moments(parts: DataFrame) -> DataFrame:
    w = parts.groupBy("week", "part").agg(F.count(F.lit(1)).alias("k"))
    r = F.col("part") == "recent"
    return w.agg(*tests.moments(F.col("k"), r, "e"), *tests.moments(F.col("k"), ~r, "b"))


def row_shift(parts: DataFrame) -> dict:
    """The same as rows_per_week for one table, tested in memory."""
    r = tests.welch(*tests.sides(row_moments(parts).first()))
    return r | {"shift": abs(r["estimate"]) / max(r["b_mean"] or 0.0, 1e-9)}


def rows_per_week(parts: DataFrame) -> DataFrame:
    """One row: moments of rows per week in both parts, Welch's test, the relative shift."""
    m = tests.with_welch(row_moments(parts))
    return m.withColumn("shift", F.abs("estimate") / F.greatest("b_mean", F.lit(1e-9)))


def coverage(parts: DataFrame, metric: str) -> DataFrame:
    """One row: share of rows with a value of the metric in both parts, and the test of the difference."""
    r = F.col("part") == "recent"
    has = F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double")).isNotNull()
    c = parts.agg(F.count(F.when(r & has, 1)).alias("x_e"), F.count(F.when(r, 1)).alias("n_e"), F.count(F.when(~r & has, 1)).alias("x_b"), F.count(F.when(~r, 1)).alias("n_b"))
    return tests.with_two_proportion(c, "x_e", "n_e", "x_b", "n_b")


def null_rates(parts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, null_recent, null_prior, shift) per column."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).isNull().cast("double").alias("gone")) for c in columns])
    r = F.col("part") == "recent"
    n = parts.select("part", F.explode(cells).alias("c")).groupBy("c.column_name").agg(F.avg(F.when(r, F.col("c.gone"))).alias("null_recent"), F.avg(F.when(~r, F.col("c.gone"))).alias("null_prior"))
    return n.withColumn("shift", F.abs(F.col("null_recent") - F.col("null_prior")))


def category_drift(parts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, drift, gone, new): values in one part only over the prior's distinct values, with three examples.

    Two-level: values are reduced to flags per (column, value) first, then counted, so no set of a column is gathered;
    the examples are the three least values, by bounded aggregates over flagged values.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    v = parts.select("part", F.explode(cells).alias("c")).select("part", "c.*").where("value IS NOT NULL")
    r = F.col("part") == "recent"
    v = v.groupBy("column_name", "value").agg(F.max(r).alias("in_recent"), F.max(~r).alias("in_prior"))
    gone, new = F.col("in_prior") & ~F.col("in_recent"), F.col("in_recent") & ~F.col("in_prior")
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("column_name", "in_recent", "in_prior").orderBy("value"))
    named = v.where(gone | new).withColumn("k", k).where("k <= 3").groupBy("column_name").agg(F.array_sort(F.collect_list(F.when(gone, F.col("value")))).alias("gone"), F.array_sort(F.collect_list(F.when(new, F.col("value")))).alias("new"))
    d = v.groupBy("column_name").agg(F.count(F.when(gone | new, 1)).alias("odd"), F.count(F.when(F.col("in_prior"), 1)).alias("base")).where("base > 0")
    empty = F.array().cast("array<string>")
    return d.join(named, "column_name", "left").select("column_name", (F.col("odd") / F.col("base")).alias("drift"), F.coalesce("gone", empty).alias("gone"), F.coalesce("new", empty).alias("new"))


def gate(panel: DataFrame, metric: str | None, segments: Sequence[str], values: Sequence[str], limits: tuple = (VOLUME, COVERAGE, NULLS, DRIFT)) -> dict:
    """The report: checks (name, flagged, structural, magnitude) and whether the data, not the business, changed.

    An artefact needs a flagged structural check and a second flagged one. Four small aggregates reach the driver.
    """
    parts = with_part(panel.select("week", *dict.fromkeys([c for c in [metric, *segments, *values] if c and c in panel.columns]))).persist()
    try:
        nulls, drifts = [c for c in values if c in panel.columns], [c for c in segments if c in panel.columns]
        volume = row_shift(parts)  # also fills what is kept of parts
        if not volume["e_n"]:
            return {"assessed": False, "is_artefact": False, "checks": [], "n_flagged": 0, "n_structural": 0}
        covered, null, drift = at_once(
            lambda: coverage(parts, metric).drop("p_value").first() if metric and metric in panel.columns else None,
            lambda: null_rates(parts, nulls).orderBy(F.col("shift").desc(), "column_name").first() if nulls else None,
            lambda: category_drift(parts, drifts).orderBy(F.col("drift").desc(), "column_name").first() if drifts else None,
        )
        sig = lambda r: r["ci_low"] > 0 or r["ci_high"] < 0
        checks = [{"name": "rows_per_period", "flagged": bool(sig(volume) and volume["shift"] > limits[0]), "structural": False, "magnitude": volume["shift"]}]
        if covered:
            checks.append({"name": "metric_coverage", "flagged": bool(sig(covered) and abs(covered["estimate"]) > limits[1]), "structural": True, "magnitude": abs(covered["estimate"])})
        if null and null["shift"] > 0:
            checks.append({"name": "missing_values", "flagged": null["shift"] > limits[2], "structural": True, "magnitude": null["shift"], "column": null["column_name"]})
        if drift and drift["drift"] > 0:
            checks.append({"name": "category_stability", "flagged": drift["drift"] > limits[3], "structural": True, "magnitude": drift["drift"], "column": drift["column_name"], "gone": drift["gone"], "new": drift["new"]})
    finally:
        parts.unpersist()
    flagged = [c for c in checks if c["flagged"]]
    structural = [c for c in flagged if c["structural"]]
    return {"assessed": True, "is_artefact": len(structural) >= 1 and len(flagged) >= 2, "checks": checks, "n_flagged": len(flagged), "n_structural": len(structural)}
