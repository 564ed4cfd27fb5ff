"""Ordered operators over a weekly series: one row per present period, columns `i` (0, 1, ..), `week`, `value`.

A series has as many rows as there are periods (hundreds), so its windows may run in one task; `keys` partition many
series at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUSTAINED_SIGMA, SUSTAINED_RUN, EXTREME_SIGMA, BAND_SIGMA = 2.0, 3, 5.0, 3.0
MIN_HISTORY, BUFFER, WIDEN_SIGMA = 12, 2, 1.0


def indexed(weekly: DataFrame, metric: str, keys: Sequence[str] = (), week: str = "week") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(week)
    value = F.nanvl(F.col(metric).cast("double"), F.lit(None).cast("double"))
    return weekly.select(*keys, (F.row_number().over(w) - 1).alias("i"), F.col(week).alias("week"), value.alias("value"))


def robust_baseline(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, center, scale): median, and the larger of 1.4826 MAD and IQR / 1.349; the deviation where both are 0."""
    all_of = Window.partitionBy(*keys)
    s = series.where(F.col("value").isNotNull()).withColumn("center", F.median("value").over(all_of))
    s = s.groupBy(*keys, "center").agg(
        F.count("value").alias("n"), F.median(F.abs(F.col("value") - F.col("center"))).alias("mad"),
        (F.percentile("value", F.lit(0.75)) - F.percentile("value", F.lit(0.25))).alias("iqr"), F.stddev_samp("value").alias("sd"),
    )
    scale = F.greatest(1.4826 * F.col("mad"), F.col("iqr") / 1.349)
    return s.select(*keys, "n", "center", F.when(scale > 0, scale).otherwise(F.coalesce("sd", F.lit(0.0))).alias("scale"))


def with_z(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds center, scale, z (0 where the value is missing or there is no spread) and the control limits."""
    base = robust_baseline(series, keys)
    s = series.join(base, list(keys)) if keys else series.crossJoin(F.broadcast(base))  # without keys it is one row
    z = F.when((F.col("scale") > 0) & F.col("value").isNotNull(), (F.col("value") - F.col("center")) / F.col("scale")).otherwise(0.0)
    return s.withColumn("z", z).withColumn("lower", F.col("center") - BAND_SIGMA * F.col("scale")).withColumn("upper", F.col("center") + BAND_SIGMA * F.col("scale"))


def islands(series: DataFrame, flag: Column, keys: Sequence[str] = (), name: str = "island") -> DataFrame:
    """Numbers the unbroken spans of rows where flag holds; null elsewhere."""
    w = Window.partitionBy(*keys).orderBy("i")
    s = series.withColumn("_f", F.coalesce(flag, F.lit(False)))
    of_flag = Window.partitionBy(*keys, "_f").orderBy("i")
    return s.withColumn(name, F.when(F.col("_f"), F.row_number().over(w) - F.row_number().over(of_flag))).drop("_f")


def sustained_runs(z: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, direction, start_i, end_i, length): spans of at least SUSTAINED_RUN rows beyond two sigmas on one side."""
    parts = []
    for direction, flag in (("down", F.col("z") <= -SUSTAINED_SIGMA), ("up", F.col("z") >= SUSTAINED_SIGMA)):
        s = islands(z, flag, keys).where(F.col("island").isNotNull()).groupBy(*keys, "island").agg(F.min("i").alias("start_i"), F.max("i").alias("end_i"), F.count(F.lit(1)).alias("length"))
        parts.append(s.where(F.col("length") >= SUSTAINED_RUN).select(*keys, F.lit(direction).alias("direction"), "start_i", "end_i", "length"))
    return parts[0].unionByName(parts[1])


def event_core(z: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, rule, direction, start_i, end_i): the longest sustained run (downward ones first, then the earliest), else
    the most extreme row if it lies five sigmas out; no row where neither exists."""
    run = sustained_runs(z, keys).select(*keys, F.lit(0).alias("pref"), F.lit("run").alias("rule"), "direction", "start_i", "end_i", (-F.col("length")).cast("double").alias("by"), F.when(F.col("direction") == "down", 0).otherwise(1).alias("side"))
    one = z.where(F.abs("z") >= EXTREME_SIGMA).select(
        *keys, F.lit(1).alias("pref"), F.lit("extreme").alias("rule"), F.when(F.col("z") < 0, "down").otherwise("up").alias("direction"), F.col("i").alias("start_i"), F.col("i").alias("end_i"), (-F.abs("z")).alias("by"), F.lit(0).alias("side"),
    )
    best = Window.partitionBy(*keys).orderBy("pref", "by", "side", "start_i")
    return run.unionByName(one).withColumn("_k", F.row_number().over(best)).where("_k = 1").select(*keys, "rule", "direction", "start_i", "end_i")


def event_window(z: DataFrame, core: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """z with `role`: 'event' for the core widened over neighbours beyond one sigma on its side, 'buffer' for two rows
    around it, else 'baseline'. Series without a core are dropped."""
    s = z.join(core, list(keys)) if keys else z.crossJoin(F.broadcast(core))  # without keys it is one row
    sign = F.when(F.col("direction") == "down", -1).otherwise(1)
    in_core = (F.col("i") >= F.col("start_i")) & (F.col("i") <= F.col("end_i"))
    s = islands(s, (sign * F.col("z") >= WIDEN_SIGMA) | in_core, keys, "wide")
    all_of = Window.partitionBy(*keys)
    s = s.withColumn("_core", F.max(F.when(in_core, F.col("wide"))).over(all_of))
    event = F.col("wide") == F.col("_core")
    s = s.withColumn("first_i", F.min(F.when(event, F.col("i"))).over(all_of)).withColumn("last_i", F.max(F.when(event, F.col("i"))).over(all_of))
    near = (F.col("i") >= F.col("first_i") - BUFFER) & (F.col("i") <= F.col("last_i") + BUFFER)
    role = F.when(F.coalesce(event, F.lit(False)), "event").when(near, "buffer").otherwise("baseline")
    return s.withColumn("role", role).drop("wide", "_core")


def cusum(z: DataFrame, keys: Sequence[str] = (), k: float = 0.5, h: float = 4.0) -> DataFrame:
    """z with both accumulators and `crossed` ('up' before 'down'). A missing value resets them.

    The recursion max(0, s + z - k) equals the running sum less its running minimum, inside each stretch between
    missing values.
    """
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    raw = F.when(F.col("value").isNotNull(), F.col("z"))
    s = z.withColumn("_z", raw).withColumn("_part", F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).over(w))
    p = Window.partitionBy(*keys, "_part").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_hi", F.sum(F.coalesce(F.col("_z") - k, F.lit(0.0))).over(p)).withColumn("_lo", F.sum(F.coalesce(F.col("_z") + k, F.lit(0.0))).over(p))
    s = s.withColumn("hi", F.col("_hi") - F.least(F.lit(0.0), F.min("_hi").over(p))).withColumn("lo", F.col("_lo") - F.greatest(F.lit(0.0), F.max("_lo").over(p)))
    return s.withColumn("crossed", F.when(F.col("hi") > h, "up").when(F.col("lo") < -h, "down")).drop("_z", "_part", "_hi", "_lo")


def first_crossing(path: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    first = Window.partitionBy(*keys).orderBy("i")
    return path.where(F.col("crossed").isNotNull()).withColumn("_k", F.row_number().over(first)).where("_k = 1").select(*keys, "i", "week", "crossed")


def lead_lag(weekly: DataFrame, cause: str, effect: str, max_lag: int = 4) -> DataFrame:
    """(lag, n, r, best): correlation of the cause at i with the effect at i + lag; best is the largest |r|, the earliest
    lag on ties. Needs three pairs and spread on both sides."""
    w = Window.orderBy("week")
    s = weekly.select("week", F.col(cause).cast("double").alias("x"), F.col(effect).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("i", F.row_number().over(w))
    shifted = s.select("i", "x").withColumn("lag", F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag)))).withColumn("j", F.col("i") + F.col("lag"))
    pairs = shifted.join(s.select(F.col("i").alias("j"), "y"), "j")
    c = pairs.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), F.when((F.stddev_pop("x") > 0) & (F.stddev_pop("y") > 0), F.corr("x", "y")).alias("r")).where("n >= 3 AND r IS NOT NULL")
    top = F.row_number().over(Window.orderBy(F.round(F.abs("r"), 12).desc(), "lag"))
    return c.withColumn("best", top == 1)


def recent_and_prior(weeks: DataFrame, recent: int = 8, least: int = 6) -> DataFrame:
    """(week, part): the last weeks against all before; none where fewer than twice `least` exist."""
    w = Window.orderBy("week")
    n = F.count(F.lit(1)).over(Window.partitionBy())
    s = weeks.select("week").where(F.col("week").isNotNull()).distinct().withColumn("i", F.row_number().over(w)).withColumn("n", n)
    cut = F.greatest(F.col("n") - recent, F.lit(least))
    return s.where(F.col("n") >= 2 * least).select("week", F.when(F.col("i") > cut, "recent").otherwise("prior").alias("part"))
