"""Session defaults used by tests, bench and scripts; library code takes any session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from tessaria.plans.ship import ship


def local_session(name: str = "tessaria", cpus: int | None = None, memory: str = "12g") -> SparkSession:
    """A local session with UTC, AQE and as many shuffle partitions as cores."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark
