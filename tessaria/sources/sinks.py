"""Results as files: one JSON document per investigation, and a script bundle of several."""

from __future__ import annotations

import datetime
import json
import math
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonable(v):
    """Plain JSON values; NaN and infinities become null."""
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, dict):
        return {str(k): jsonable(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set)):
        return [jsonable(x) for x in v]
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v.item() if hasattr(v, "item") else v


def write_json(payload: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(jsonable(payload), indent=2, ensure_ascii=False, allow_nan=False))


def write_bundle(payloads: dict[str, dict], path: str, variable: str = "INVESTIGATIONS") -> None:
    Path(path).write_text(f"window.{variable} = {json.dumps(jsonable(payloads), allow_nan=False)};\n")


def chart_series(z: DataFrame) -> list[dict]:
    """Per week: value, z, whether in the event. A series has hundreds of rows."""
    rows = z.orderBy("i").select(F.date_format("week", "yyyy-MM-dd").alias("week"), "value", "z", "lower", "upper", (F.col("role") == "event").alias("in_event")).collect()
    return [r.asDict() for r in rows]


def timeline(weekly: DataFrame, windows: DataFrame, columns: Sequence[str]) -> list[dict]:
    """Per week: the given figures and whether in the event."""
    rows = weekly.join(F.broadcast(windows.select("week", "role")), "week", "left").orderBy("week")  # one row per week
    return [r.asDict() for r in rows.select(F.date_format("week", "yyyy-MM-dd").alias("week"), F.coalesce(F.col("role") == "event", F.lit(False)).alias("in_event"), *columns).collect()]
