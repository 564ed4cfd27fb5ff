"""Benjamini-Hochberg adjustment over the tests of a family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def adjusted(df: DataFrame, p: str = "p_value", family: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Adds p_adjusted and rejected. A family is a handful of tests per key, never rows of data; ties adjust alike."""
    all_of = Window.partitionBy(*family)
    n, rank = F.count(p).over(all_of), F.row_number().over(all_of.orderBy(F.col(p).asc_nulls_last()))
    df = df.withColumn("_n", n).withColumn("_r", rank)
    down = all_of.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    adj = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(down))
    df = df.withColumn("p_adjusted", F.when(F.col(p).isNotNull(), adj))
    return df.withColumn("rejected", F.coalesce(F.col("p_adjusted") <= alpha, F.lit(False))).drop("_n", "_r")
