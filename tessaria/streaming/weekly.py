"""The weekly roll-up over a stream: tumbling seven-day windows that begin on Mondays, late rows up to a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEEK, MONDAY = "7 days", "4 days"  # windows count from 1970-01-01, a Thursday


def weekly_stream(rows: DataFrame, at: str, metrics: Sequence[str], by: Sequence[str] = (), late: str = "2 days") -> DataFrame:
    """Rows and mean of each metric per week (and segment), for a batch or a stream alike."""
    stamped = rows.withColumn(at, F.col(at).cast("timestamp"))
    stamped = stamped.withWatermark(at, late) if rows.isStreaming else stamped
    w = F.window(at, WEEK, startTime=MONDAY)
    out = stamped.groupBy(w, *by).agg(F.count(F.lit(1)).alias("rows"), *[F.avg(m).alias(m) for m in metrics])
    return out.select(F.col("window.start").cast("date").alias("week"), *by, "rows", *metrics)
