"""Where a movement is: conditional moments per segment, mix against rate, segment scan, and what is built on them.

One aggregate per segment column, `segment_moments`, holds everything the tests need. Its rows are segment values; the
rows of a hot segment are combined on the map side, so no task sees them together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaria.functions import fdr, tests

MIN_SEGMENT_N, RATE_OR_MIX = 40, 0.65


def segment_moments(panel: DataFrame, segment: str, metrics: Sequence[str], population: Column | None = None) -> DataFrame:
    """Per value of a segment: rows in both windows, and per metric n, mean and variance in each.

    Columns: segment, rows_e, rows_b, <metric>_e_n, <metric>_e_mean, .. The panel has `role`; rows outside the
    population (a condition) or without a role count nowhere.
    """
    rows = panel.where(F.col("role").isNotNull())
    if population is not None:
        rows = rows.where(population)
    e, b = F.col("role") == "event", F.col("role") == "baseline"
    agg = [F.count(F.when(e, 1)).alias("rows_e"), F.count(F.when(b, 1)).alias("rows_b")]
    for m in metrics:
        agg += [*tests.moments(F.col(m), e, f"{m}_e"), *tests.moments(F.col(m), b, f"{m}_b")]
    return rows.groupBy(F.col(segment).cast("string").alias("segment")).agg(*agg)


def _plain(moments: DataFrame, metric: str) -> DataFrame:
    return moments.select("segment", "rows_e", "rows_b", *[F.col(f"{metric}_{w}_{s}").alias(f"{w}_{s}") for w in "eb" for s in ("n", "mean", "var")])


def _beside(m: DataFrame, **totals: Column) -> DataFrame:
    """Every row with aggregates of all rows: one row of totals is sent to the segments, which stay where they are."""
    return m.crossJoin(F.broadcast(m.agg(*[c.alias(name) for name, c in totals.items()])))


def mix_vs_rate(moments: DataFrame, metric: str) -> DataFrame:
    """One row: the change of the overall mean as mix (shares moved), rate (values moved) and their interaction.

    Rows without a metric value take no part in shares; a segment absent from the baseline has the overall baseline mean
    there, one absent from the event its baseline mean. `total` is the plain difference of means, null segments included.
    """
    m = _plain(moments, metric)
    total = m.agg(F.try_divide(F.sum(F.col("e_n") * F.col("e_mean")), F.sum("e_n")).alias("mean_e"), F.try_divide(F.sum(F.col("b_n") * F.col("b_mean")), F.sum("b_n")).alias("mean_b"))
    known = m.where(F.col("segment").isNotNull())
    s = _beside(known, all_e=F.sum("e_n"), all_b=F.sum("b_n"), sum_b=F.sum(F.col("b_n") * F.col("b_mean")))
    s = s.withColumn("w_e", F.coalesce(F.try_divide("e_n", "all_e"), F.lit(0.0))).withColumn("w_b", F.coalesce(F.try_divide("b_n", "all_b"), F.lit(0.0)))
    s = s.withColumn("m_b", F.coalesce("b_mean", F.try_divide("sum_b", "all_b"))).withColumn("m_e", F.coalesce("e_mean", "m_b"))
    parts = s.agg(
        F.sum((F.col("w_e") - F.col("w_b")) * F.col("m_b")).alias("mix"),
        F.sum(F.col("w_b") * (F.col("m_e") - F.col("m_b"))).alias("rate"),
        F.sum((F.col("w_e") - F.col("w_b")) * (F.col("m_e") - F.col("m_b"))).alias("interaction"),
    )
    d = parts.crossJoin(F.broadcast(total))  # two single rows
    size = F.abs("mix") + F.abs("rate") + F.abs("interaction")
    share = lambda c: F.when(size > 0, F.abs(c) / size).otherwise(0.0)
    d = d.withColumn("total", F.col("mean_e") - F.col("mean_b")).withColumn("mix_share", share("mix")).withColumn("rate_share", share("rate"))
    kind = F.when(F.col("rate_share") >= RATE_OR_MIX, "rate").when(F.col("mix_share") >= RATE_OR_MIX, "mix").otherwise("mixed")
    return d.withColumn("reading", kind)


def segment_shares(moments: DataFrame) -> DataFrame:
    known = _beside(moments.where(F.col("segment").isNotNull()), all_e=F.sum("rows_e"), all_b=F.sum("rows_b"))
    return known.select("segment", F.try_divide("rows_e", "all_e").alias("share_e"), F.try_divide("rows_b", "all_b").alias("share_b"))


def segment_scan(moments: DataFrame, metric: str, least: int = MIN_SEGMENT_N) -> DataFrame:
    """Per segment value with enough values in both windows: Welch's test of its change, adjusted for the number of
    tests, and its contribution (share of event values times change over the overall change)."""
    m = _plain(moments, metric)
    mean = lambda w: F.try_divide(F.sum(F.col(f"{w}_n") * F.col(f"{w}_mean")), F.sum(f"{w}_n"))
    m = _beside(m, overall=mean("e") - mean("b"), all_e=F.sum("e_n"))
    m = m.where(F.col("segment").isNotNull() & (F.col("e_n") >= least) & (F.col("b_n") >= least))
    m = fdr.adjusted(tests.with_welch(m))
    share = F.col("e_n") / F.col("all_e")
    contribution = F.when(F.col("overall") != 0, share * F.col("estimate") / F.col("overall")).otherwise(0.0)
    return m.withColumn("contribution", contribution).withColumnRenamed("estimate", "delta")


def count_scan(panel: DataFrame, segment: str, least: int = MIN_SEGMENT_N) -> DataFrame:
    """The same for row counts: per segment value with enough rows in both windows, Welch's test of its weekly counts.

    e_n and b_n are the value's rows; a week without any row of it is not counted as zero.
    """
    weeks = panel.where(F.col("role").isNotNull() & F.col(segment).isNotNull()).groupBy(F.col(segment).cast("string").alias("segment"), "week", "role").agg(F.count(F.lit(1)).alias("k"))
    e, b = F.col("role") == "event", F.col("role") == "baseline"
    m = weeks.groupBy("segment").agg(*tests.moments(F.col("k"), e, "e"), *tests.moments(F.col("k"), b, "b"), *[F.coalesce(F.sum(F.when(w, F.col("k"))), F.lit(0)).alias(n) for w, n in ((e, "rows_e"), (b, "rows_b"))])
    m = fdr.adjusted(tests.with_welch(m.where((F.col("rows_e") >= least) & (F.col("rows_b") >= least))))
    return m.withColumnRenamed("estimate", "delta").withColumns({"e_n": F.col("rows_e"), "b_n": F.col("rows_b")}).drop("rows_e", "rows_b")


def concentration(scan: DataFrame) -> DataFrame:
    """One row: how much of the movement one segment value holds, how far it stands out, how many move materially."""
    s = _beside(scan, _n=F.sum("e_n"), _most=F.max(F.abs("delta")))
    s = s.withColumn("size", F.abs("delta")).withColumn("weighted", F.abs("delta") * F.col("e_n") / F.col("_n"))
    return s.agg(
        F.try_divide(F.max("weighted"), F.sum("weighted")).alias("concentration"),
        F.try_divide(F.max("size") - F.median("size"), F.max("size")).alias("separation"),
        F.count(F.when(F.col("size") >= 0.5 * F.col("_most"), 1)).alias("n_material"),
    )


def uniformity(scan: DataFrame) -> DataFrame:
    """One row: share of values that move in one direction, and how evenly."""
    s = scan.agg(F.count(F.lit(1)).alias("n_values"), F.avg((F.col("delta") < 0).cast("double")).alias("down"), F.avg((F.col("delta") > 0).cast("double")).alias("up"), F.stddev_pop("delta").alias("sd"), F.avg("delta").alias("mean"))
    cv = F.col("sd") / (F.abs("mean") + 1e-9)
    s = s.withColumn("same_direction", F.greatest("down", "up")).withColumn("uniformity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.least(cv, F.lit(1.5)) / 1.5)))
    return s.select("n_values", "same_direction", "uniformity", ((F.col("same_direction") >= 0.8) & (F.col("uniformity") >= 0.55)).alias("supported"))


def simpson_fraction(scan: DataFrame) -> DataFrame:
    """One row: segment values, those that fall, and their share."""
    return scan.agg(F.count(F.lit(1)).alias("n_segments"), F.count(F.when(F.col("delta") < 0, 1)).alias("n_down")).withColumn("share_down", F.coalesce(F.try_divide("n_down", "n_segments"), F.lit(0.0)))


def dose_response(moments: DataFrame, dose: str, effect: str, least: int = MIN_SEGMENT_N) -> DataFrame:
    """One row: regression over segments of the change of an effect on the change of a dose."""
    m = moments.where(F.col("segment").isNotNull() & (F.col("rows_e") >= least) & (F.col("rows_b") >= least))
    x, y = F.col(f"{dose}_e_mean") - F.col(f"{dose}_b_mean"), F.col(f"{effect}_e_mean") - F.col(f"{effect}_b_mean")
    m = m.select(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    d = m.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.corr("x", "y").alias("r"))
    enough = F.col("n") >= 4
    d = d.select("n", F.when(enough, F.col("slope")).otherwise(0.0).alias("slope"), F.coalesce(F.when(enough, F.col("r")), F.lit(0.0)).alias("r"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.greatest(F.lit(1e-300), 1 - F.col("r") * F.col("r")))
    from tessaria.functions.dist import t_pvalue

    return d.withColumn("p_value", F.when(F.col("n") >= 4, t_pvalue(t, (F.col("n") - 2).cast("double"))).otherwise(1.0))


def exposed(moments: DataFrame, exposure: str, least: int = MIN_SEGMENT_N) -> DataFrame:
    """Segments with enough rows in both windows and their change `d` of exposure."""
    m = moments.where(F.col("segment").isNotNull() & (F.col("rows_e") >= least) & (F.col("rows_b") >= least))
    return m.withColumn("d", F.col(f"{exposure}_e_mean") - F.col(f"{exposure}_b_mean")).where("d IS NOT NULL")


def did_groups(moments: DataFrame, exposure: str, least: int = MIN_SEGMENT_N, divisor: int = 4, k_least: int = 3) -> DataFrame:
    """(segment, grp): the segments with the lowest change of exposure as 'treat', those with the highest as 'control'."""
    m = exposed(moments, exposure, least)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    m = m.withColumn("k", F.greatest(F.floor(n / divisor), F.lit(k_least))).withColumn("lo", F.row_number().over(Window.orderBy("d", "segment"))).withColumn("hi", F.row_number().over(Window.orderBy(F.col("d").desc(), "segment")))
    grp = F.when(F.col("lo") <= F.col("k"), "treat").when(F.col("hi") <= F.col("k"), "control")
    return m.select("segment", grp.alias("grp")).where(F.col("grp").isNotNull())


def did_cells(panel: DataFrame, groups: DataFrame, segment: str, outcome: str) -> DataFrame:
    """(grp, role, n, mean, var) of an outcome."""
    rows = panel.where(F.col("role").isNotNull()).withColumn("segment", F.col(segment).cast("string")).join(groups, "segment")
    x = F.nanvl(F.col(outcome).cast("double"), F.lit(None).cast("double"))
    return rows.groupBy("grp", "role").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))


def did_estimate(cells: DataFrame) -> DataFrame:
    """One row: estimate, se and interval of the difference in differences."""
    cell = lambda g, r, c: F.max(F.when((F.col("grp") == g) & (F.col("role") == r), F.col(c)))
    change = lambda g: cell(g, "event", "mean") - cell(g, "baseline", "mean")
    d = cells.agg((change("treat") - change("control")).alias("estimate"), F.sqrt(F.sum(F.try_divide("var", "n"))).alias("se"))
    return d.withColumn("ci_low", F.col("estimate") - tests.Z95 * F.col("se")).withColumn("ci_high", F.col("estimate") + tests.Z95 * F.col("se"))


def weekly_gaps(panel: DataFrame, groups: DataFrame, segment: str, outcome: str) -> DataFrame:
    """(week, t, c): both groups' means in the weeks of the baseline."""
    rows = panel.where(F.col("role") == "baseline").withColumn("segment", F.col(segment).cast("string")).join(groups, "segment")
    return rows.groupBy("week").agg(F.avg(F.when(F.col("grp") == "treat", F.col(outcome))).alias("t"), F.avg(F.when(F.col("grp") == "control", F.col(outcome))).alias("c"))


def parallel_trend(panel: DataFrame, groups: DataFrame, segment: str, outcome: str, last: int = 12) -> DataFrame:
    """One row: slope of the difference of both groups' weekly means over the last weeks of the baseline."""
    w = weekly_gaps(panel, groups, segment, outcome)
    w = w.withColumn("k", F.row_number().over(Window.orderBy(F.col("week").desc()))).where(F.col("k") <= last)
    return w.where("t IS NOT NULL AND c IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(F.col("t") - F.col("c"), -F.col("k")).alias("slope"))


def topic_lift(panel: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Per topic: hits and texts in both windows, rates, lift and the test of the difference; delivered rows with text."""
    rows = panel.where(F.col("role").isNotNull() & F.col("delivered") & F.col("has_text"))
    cells = F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"topic_{t}").alias("hit")) for t in topics])
    e = F.col("role") == "event"
    c = rows.select("role", F.explode(cells).alias("c")).groupBy("c.topic").agg(
        F.coalesce(F.sum(F.when(e, F.col("c.hit"))), F.lit(0.0)).alias("x_e"), F.count(F.when(e, 1)).alias("n_e"), F.coalesce(F.sum(F.when(~e, F.col("c.hit"))), F.lit(0.0)).alias("x_b"), F.count(F.when(~e, 1)).alias("n_b")
    )
    c = c.withColumn("rate_e", F.coalesce(F.try_divide("x_e", "n_e"), F.lit(0.0))).withColumn("rate_b", F.coalesce(F.try_divide("x_b", "n_b"), F.lit(0.0)))
    c = c.withColumn("lift", F.coalesce(F.try_divide("rate_e", "rate_b"), F.lit(0.0)))
    return tests.with_two_proportion(c, "x_e", "n_e", "x_b", "n_b")


def text_alignment(panel: DataFrame, segment: str, topic_col: str, flagged: Sequence[str], least: int = 30) -> DataFrame:
    """One row: mean lift of a topic in up to five flagged segments and in the others (four lifts at least)."""
    rows = panel.where(F.col("role").isNotNull() & F.col("delivered") & F.col("has_text") & F.col(segment).isNotNull())
    e = F.col("role") == "event"
    s = rows.groupBy(F.col(segment).alias("segment")).agg(F.count(F.when(e, 1)).alias("n_e"), F.count(F.when(~e, 1)).alias("n_b"), F.avg(F.when(e, F.col(topic_col))).alias("r_e"), F.avg(F.when(~e, F.col(topic_col))).alias("r_b"))
    s = s.where((F.col("n_e") >= least) & (F.col("n_b") >= least) & (F.col("r_b") > 0)).withColumn("lift", F.col("r_e") / F.col("r_b"))
    hit = F.col("segment").isin(*list(flagged)[:5]) if flagged else F.lit(False)
    d = s.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(hit, F.col("lift"))).alias("flagged_lift"), F.avg(F.when(~hit, F.col("lift"))).alias("other_lift"))
    return d.withColumn("aligned", F.coalesce((F.col("n") >= 4) & (F.col("flagged_lift") > F.col("other_lift")), F.lit(False)))


def term_lift(panel: DataFrame, text: str, least_texts: int = 40) -> DataFrame:
    """Terms (words, word pairs) that more texts of the event hold than of the baseline, adjusted for their number.

    Document frequencies of both windows come from one explode with map-side partial counts. Candidates: in at least
    max(8, 1 % of the event's texts) of them and 15 texts in all; nothing where a window has fewer than 40 texts.
    """
    from tessaria.functions.text import normalised, words_and_pairs

    rows = panel.where(F.col("role").isNotNull() & (F.length(text) > 0))
    e = F.col("role") == "event"
    n = rows.agg(F.count(F.when(e, 1)).alias("n_e"), F.count(F.when(~e, 1)).alias("n_b"))
    terms = rows.select("role", F.explode(F.array_distinct(words_and_pairs(normalised(F.col(text))))).alias("term"))
    df = terms.groupBy("term").agg(F.count(F.when(e, 1)).alias("k_e"), F.count(F.when(~e, 1)).alias("k_b"))
    c = df.crossJoin(F.broadcast(n))  # one row of totals
    c = c.where((F.col("n_e") >= least_texts) & (F.col("n_b") >= least_texts) & (F.col("k_e") >= F.greatest(F.lit(8.0), 0.01 * F.col("n_e"))) & (F.col("k_e") + F.col("k_b") >= 15))
    c = c.withColumn("rate_e", F.col("k_e") / F.col("n_e")).withColumn("rate_b", F.col("k_b") / F.col("n_b")).where("rate_e > rate_b")
    c = c.withColumn("lift", F.col("rate_e") / F.greatest("rate_b", F.lit(1e-9)))
    return fdr.adjusted(tests.with_two_proportion(c, "k_e", "n_e", "k_b", "n_b"))
