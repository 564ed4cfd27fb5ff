"""Percentiles of very large numeric columns per group, by exact bisection.

Values are numbered by the cells of a fixed grid of width `width`. A mergeable state counts rows per (group, period,
coarse cell), a coarse cell being `step` cells wide, so it holds groups x range / (step x width) counts however many rows
there are; states of files, weeks or days are joined by adding counts, in any order, without loss. A percentile (the
value of nearest rank, ceil(p * n)) starts from the coarse cell that holds its rank. Each pass then keeps an interval of
cells per group and percentile, counts the rows below its midpoints (`fanout` - 1 of them), and narrows it to the part
that holds the target rank, until every interval is one cell. The true percentile lies in [low, high) of that cell, so
the middle is wrong by at most width / 2, whatever was joined. From a state alone, without rows, the bound is that of
its own cells.

Scale: a pass over rows is a scan with a broadcast of the intervals and one small aggregate with map-side counts; rows
outside every interval are dropped in the scan. The number of passes is the logarithm of `step` to the base of `fanout`,
not of the rows. Intervals are cut from their lineage after each pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaria.plans.materialize import cut, small_side

MAX_BROADCAST_INTERVALS = 200_000
FANOUT = 64


def finite(c: Column) -> Column:
    """c, or null where it is NaN or infinite."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def cell_state(df: DataFrame, groups: Sequence[str], value: str, width: float) -> DataFrame:
    """(groups, cell, n). Null, NaN and infinite values are no values; groups may be null."""
    return df.select(*groups, cell_of(F.col(value), width).alias("cell")).where(F.col("cell").isNotNull()).groupBy(*groups, "cell").agg(F.count(F.lit(1)).alias("n"))


def merge(states: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The state of coarser groups, or of the union of states, by adding counts."""
    return states.groupBy(*groups, "cell").agg(F.sum("n").alias("n"))


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of keys, b's having a leading underscore."""
    out = F.lit(True)
    for k in keys:
        out &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out


def cell_of(value: Column, width: float) -> Column:
    return F.floor(finite(value) / width).cast("long")


def coarse(cells: DataFrame, groups: Sequence[str], step: int) -> DataFrame:
    """The mergeable state of rows (groups, cell) or states (groups, cell, n): counts per `step` cells."""
    n = F.sum("n") if "n" in cells.columns else F.count(F.lit(1))
    return cells.groupBy(*groups, F.floor(F.col("cell") / step).cast("long").alias("cell")).agg(n.alias("n"))


def _narrowed(live: DataFrame, source: DataFrame, groups: Sequence[str], fanout: int) -> DataFrame:
    """One pass: intervals of more than one cell are cut to the part that holds the rank, by counts of the source."""
    keys, carried = [f"_{g}" for g in groups] + ["p"], ["total", "rank"]
    done, rest = live.where("lo = hi"), live.where("lo < hi")
    size = F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(fanout)).cast("long")
    near = source.join(small_side(rest, MAX_BROADCAST_INTERVALS), _same(source, rest, groups) & (F.col("cell") >= F.col("lo")) & (F.col("cell") <= F.col("hi")))
    near = near.withColumn("part", F.floor((F.col("cell") - F.col("lo")) / size).cast("long"))
    n = F.sum("n") if "n" in source.columns else F.count(F.lit(1))
    parts = near.groupBy(*keys, *carried, "below", "part").agg(n.alias("k"), F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    up_to = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("to", F.col("below") + F.sum("k").over(up_to))
    hit = parts.where((F.col("to") >= F.col("rank")) & (F.col("to") - F.col("k") < F.col("rank")))
    hit = hit.select(*keys, *carried, "lo", "hi", (F.col("to") - F.col("k")).alias("below"))
    return cut(done.select(hit.columns).unionByName(hit))


def percentiles(state: DataFrame, groups: Sequence[str], ps: Sequence[float], width: float, fanout: int = FANOUT, rows: DataFrame | None = None, step: int = 1) -> DataFrame:
    """(groups, p, n, rank, cell, low, high) per group and p in (0, 1].

    state: as made by cell_state, merge or coarse, with cells of `step` x width; rows: (groups, cell) with cells of
    width, the rows that the state counts, or none for step 1. Groups without a value have no rows; ties share a cell;
    an empty state gives an empty result; other columns are ignored.
    """
    state = cut(state)
    spread = state.groupBy(*groups).agg(F.sum("n").alias("total"), F.min("cell").alias("lo"), F.max("cell").alias("hi"))
    spread = spread.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    rank = F.greatest(F.ceil(F.col("p") * F.col("total")), F.lit(1)).cast("long")
    live = cut(spread.select(*[F.col(g).alias(f"_{g}") for g in groups], "p", "total", rank.alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below")))
    while live.where("lo < hi").limit(1).count():
        live = _narrowed(live, state, groups, fanout)
    if rows is not None:
        live = live.withColumns({"lo": F.col("lo") * step, "hi": F.col("lo") * step + (step - 1)})
        for _ in range(math.ceil(round(math.log(step, fanout), 9))):
            live = _narrowed(live, rows.select(*groups, "cell"), groups, fanout)
    return live.select(
        *[F.col(f"_{g}").alias(g) for g in groups], "p", F.col("total").alias("n"), "rank", F.col("lo").alias("cell"), (F.col("lo") * F.lit(width)).alias("low"), ((F.col("lo") + 1) * F.lit(width)).alias("high")
    )
