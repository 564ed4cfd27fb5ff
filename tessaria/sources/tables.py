"""Readers of the parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def norm_id(c: Column | str) -> Column:
    """An id without outer spaces and in lower case; null where nothing is left."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(c != "", c)


def norm_state(c: Column | str) -> Column:
    """A state code as capitals without outer spaces; null where nothing is left."""
    c = F.upper(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(c != "", c)
