"""Queries over tables of unknown roles, whole investigations, and the decision operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.kpi_queries import r6, rounded
from tessaria.operators import ingest
from tessaria.operators import panel as P
from tessaria.plans import investigate as I
from tessaria.sources.tables import table

COLUMNS = ("order_id", "order_date", "region", "category", "amount", "quantity", "customer_feedback")


def _upload(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "upload_records").select(*COLUMNS)


def upload_statistics(spark: SparkSession, d: str) -> DataFrame:
    """What roles are inferred from, per column."""
    s = ingest.column_stats(ingest.column_values(_upload(spark, d)))
    return r6(s.select("column_name", "n_rows", "n_missing", "n_unique", "numeric_share", "low", "high", "mean_number", "sd_number", "mean_length", "mean_words"))


def upload_roles(spark: SparkSession, d: str) -> DataFrame:
    p = ingest.profile(_upload(spark, d))
    return spark.createDataFrame([(c.name, c.role, c.confidence, c.n_unique, c.null_rate, c.date_format) for c in p.columns], "column_name string, role string, confidence double, n_unique long, null_rate double, date_format string")


def upload_weekly(spark: SparkSession, d: str) -> DataFrame:
    """Weekly figures of the rows whose dates are written yyyy-MM-dd, dd/MM/yyyy or dd MMM yyyy."""
    u = _upload(spark, d)
    p = ingest.profile(u)
    return r6(ingest.generic_weekly(ingest.generic_panel(u, p), p).select("week", "records", "total_value", "avg_value"))


def flag_rate(spark: SparkSession, d: str) -> DataFrame:
    """Share of rows with one value of a flag, per week."""
    p = P.order_panel(spark, d, topics=False)
    return r6(p.groupBy("week").agg(F.avg(F.col("has_text").cast("double")).alias("rate"), F.count(F.lit(1)).alias("records")))


def avg_by_measure(spark: SparkSession, d: str) -> DataFrame:
    p = P.order_panel(spark, d, topics=False)
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("x")) for m in ("order_value", "freight_value", "review_score", "delivery_days")])
    return r6(p.select(F.explode(cells).alias("c")).groupBy("c.measure").agg(F.avg("c.x").alias("mean"), F.stddev_samp("c.x").alias("sd"), F.count("c.x").alias("n")))


def weekly_windows(spark: SparkSession, d: str) -> DataFrame:
    """The streaming roll-up, over the table as one batch."""
    from tessaria.streaming.weekly import weekly_stream

    return r6(weekly_stream(table(spark, d, "events"), "ts", ["value"], ["event_type"]))


def _investigation(metric: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        panel = P.order_panel(spark, d).persist()
        try:
            r = I.investigate(panel, metric)
        finally:
            panel.unpersist()
        t, e = r["triage"], r["decision"]
        weeks = t["event_weeks"]
        row = (metric, e["state"], t["verdict"], t.get("rule"), weeks[0] if weeks else None, len(weeks), t["event_value"], t["baseline_value"], t.get("robust_z"), e.get("leading"), [(v["agent"], v["family"], v["supported"], float(v["score"])) for v in r["verdicts"]])
        return spark.createDataFrame([row], "metric string, state string, verdict string, rule string, first_week string, n_weeks int, event_value double, baseline_value double, robust_z double, leading string, verdicts array<struct<agent:string,family:string,supported:boolean,score:double>>")

    return run


def investigation_upload(spark: SparkSession, d: str) -> DataFrame:
    r = I.investigate_table(_upload(spark, d))
    rows = [(c["name"], bool(c["flagged"]), bool(c["structural"]), float(c["magnitude"]), r["decision"]["state"]) for c in r["integrity"]["checks"]]
    return spark.createDataFrame(rows, "check string, flagged boolean, structural boolean, magnitude double, state string")


QUERIES = {
    "upload_statistics": upload_statistics,
    "upload_roles": upload_roles,
    "upload_weekly": upload_weekly,
    "flag_rate": flag_rate,
    "avg_by_measure": avg_by_measure,
    "weekly_windows": weekly_windows,
    **{f"investigation_{m}": _investigation(m) for m in ("review_score", "delivery_days", "order_value", "on_time", "cancellation_rate", "revenue")},
    "investigation_upload": investigation_upload,
}

_CELLS = ", ".join(f"{{'c': '{c}', 'v': {c}::VARCHAR}}" for c in COLUMNS)
SQL = {
    "upload_statistics": rounded(
        f"""WITH x AS (SELECT u.c AS column_name, CASE WHEN trim(u.v) <> '' AND lower(u.v) <> 'nan' THEN u.v END AS v FROM (SELECT unnest([{_CELLS}]) AS u FROM upload_records)), y AS (SELECT *, try_cast(v AS DOUBLE) AS k FROM x)
        SELECT column_name, count(*) AS n_rows, count(*) - count(v) AS n_missing, count(DISTINCT v) AS n_unique, count(k) / count(v) AS numeric_share, min(k) AS low, max(k) AS high, avg(k) AS mean_number, CASE WHEN count(k) > 0 THEN stddev_pop(k) END AS sd_number,
        avg(length(v)) AS mean_length, avg(len(regexp_extract_all(v, '\\s+')) + 1) AS mean_words FROM y GROUP BY 1""",
        "numeric_share, low, high, mean_number, sd_number, mean_length, mean_words",
    ),
}


def _with_panel() -> dict[str, str]:
    from tessaria.kpi_queries import PANEL

    measures = " UNION ALL ".join(f"SELECT '{m}' AS measure, avg({m}) AS mean, stddev_samp({m}) AS sd, count({m}) AS n FROM orders_panel" for m in ("order_value", "freight_value", "review_score", "delivery_days"))
    return {
        "flag_rate": rounded(f"WITH {PANEL} SELECT week, avg(has_text::INT) AS rate, count(*) AS records FROM orders_panel GROUP BY 1", "rate"),
        "avg_by_measure": rounded(f"WITH {PANEL} {measures}", "mean, sd"),
        "weekly_windows": rounded("SELECT date_trunc('week', ts AT TIME ZONE 'UTC')::DATE AS week, event_type, count(*) AS rows, avg(value) AS value FROM events GROUP BY ALL", "value"),
        "upload_weekly": rounded(
            """WITH u AS (SELECT coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%d/%m/%Y'), try_strptime(order_date, '%m/%d/%Y'), try_strptime(order_date, '%d-%m-%Y'), try_strptime(order_date, '%Y/%m/%d'), try_strptime(order_date, '%d %b %Y'), try_strptime(order_date, '%b %d, %Y')) AS made,
            CASE WHEN isnan(amount) THEN NULL ELSE amount END AS v FROM upload_records)
            SELECT date_trunc('week', made)::DATE AS week, count(*) AS records, sum(v) AS total_value, avg(v) AS avg_value FROM u WHERE made IS NOT NULL GROUP BY 1""",
            "total_value, avg_value",
        ),
    }


SQL |= _with_panel()
