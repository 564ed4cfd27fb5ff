"""Eager aggregation through joins: per-key results without a hot key's rows ever meeting in one task.

Each input is reduced to one row per join key before the join (the reduction starts on the map side, so a key that
holds a third of all rows leaves each map task as one row). The join then pairs compact states one to one, and what
a join of the raw rows would have produced follows by algebra: a sum of one side is multiplied by the other side's row
count, counts are multiplied. The roll-up to the coarse, skewed key sums those few columns, again with map-side partial
sums, so its largest task reads one partial row per map task and group.

Nulls: rows with a null join key are kept apart on the left side (they match nothing) and dropped on the right.
Empty inputs give an empty result (or zero sums for unmatched left keys). Extra columns are ignored. Ties and repeated
rows are the caller's: `latest` picks one row a key before this operator where repeats are copies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT = "rows_"


def reduce_by_key(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], carry: Sequence[str] = ()) -> DataFrame:
    """One row per key: COUNT and each sum; carry columns become part of the key (functionally dependent ones)."""
    return df.groupBy(*keys, *carry).agg(F.count(F.lit(1)).alias(COUNT), *[F.sum(v).alias(k) for k, v in sums.items()])


def join_states(left: DataFrame, right: DataFrame, key: str, left_sums: Sequence[str], right_sums: Sequence[str]) -> DataFrame:
    """Left outer join of two reduced states on key, with the sums and COUNT that the joined raw rows would have.

    An unmatched left key keeps its own sums with a right count of one (as in an outer join of the raw rows) and null
    right sums. Left columns besides the sums are passed through.
    """
    r = right.where(F.col(key).isNotNull()).select(F.col(key).alias("_rk"), F.col(COUNT).alias("_rc"), *[F.col(c).alias(f"_r_{c}") for c in right_sums])
    joined = left.join(r, F.col(key) == F.col("_rk"), "left")
    factor = F.coalesce(F.col("_rc"), F.lit(1))
    rest = [c for c in left.columns if c not in {COUNT, *left_sums}]
    return joined.select(
        *rest,
        (F.col(COUNT) * factor).alias(COUNT),
        *[(F.col(c) * factor).alias(c) for c in left_sums],
        *[(F.col(f"_r_{c}") * F.col(COUNT)).alias(c) for c in right_sums],
    )


def roll_up(state: DataFrame, groups: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums of the compact states per coarse group."""
    return state.groupBy(*groups).agg(F.sum(COUNT).alias(COUNT), *[F.sum(c).alias(c) for c in sums])


def latest(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """One row per key: the columns of its row with the greatest `order` (ties: the greatest values, nulls least).

    An aggregate with map-side combine, not a window: a key with many repeats is reduced before the shuffle.
    """
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in columns])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in columns])
