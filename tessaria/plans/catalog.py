"""What the engine knows of its own sources, KPIs, explanations and methods, as rows and as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: table, what a row is, key, time that tells how fresh it is, how sensitive it is
SOURCES = (
    ("olist_orders_dataset", "an order with its five dates", "order_id", "loaded_at", "internal"),
    ("olist_customers_dataset", "the customer of one order", "customer_id", "loaded_at", "internal"),
    ("olist_order_items_dataset", "one item of an order", "order_id, order_item_id", "loaded_at", "internal"),
    ("olist_order_reviews_dataset", "a review of an order, with free text", "review_id", "loaded_at", "confidential"),
)
#: metric, unit, expression over the order panel, rows it is taken over, direction that is worse, whether orders carry it
KPIS = (
    ("review_score", "stars", "avg(review_score)", "delivered orders", "down", True),
    ("delivery_days", "days", "avg(delivered to customer - purchase)", "delivered orders", "up", True),
    ("days_late", "days", "avg(delivered to customer - estimate)", "delivered orders", "up", True),
    ("days_to_carrier", "days", "avg(handed to carrier - purchase)", "delivered orders", "up", True),
    ("on_time", "share", "avg(delivered to customer <= estimate)", "delivered orders", "down", True),
    ("order_value", "currency", "avg(sum of item prices)", "delivered orders", "down", True),
    ("n_items", "items", "avg(count of items)", "delivered orders", "down", True),
    ("revenue", "currency", "sum(order_value)", "delivered orders", "down", False),
    ("orders", "orders", "count", "delivered orders", "down", False),
    ("cancellation_rate", "share", "avg(status is canceled)", "all orders", "up", True),
)
#: method, what it answers, where it is
METHODS = (
    ("robust baseline", "what is usual for a series", "functions.series.robust_baseline"),
    ("sustained run", "did it leave the usual for several weeks", "functions.series.sustained_runs"),
    ("cumulative sum", "when did a slow change begin", "functions.series.cusum"),
    ("Welch's test", "do two means differ", "functions.tests.with_welch"),
    ("two proportions", "do two shares differ", "functions.tests.with_two_proportion"),
    ("false discovery control", "which of many tests hold", "functions.fdr.adjusted"),
    ("mix against rate", "did shares move or values", "operators.localize.mix_vs_rate"),
    ("segment scan", "where did it move", "operators.localize.segment_scan"),
    ("dose and response", "does more cause give more effect", "operators.localize.dose_response"),
    ("lead and lag", "which series moves first", "functions.series.lead_lag"),
    ("difference in differences", "does it hold against what was not exposed", "functions.tests.difference_in_differences"),
    ("agreement of segments", "does it hold inside segments", "operators.localize.simpson_fraction"),
    ("term lift", "which words became frequent", "operators.localize.term_lift"),
    ("integrity gate", "did the data change instead", "operators.integrity.gate"),
    ("sample size", "how large a test has to be", "functions.tests.required_sample_size"),
    ("bootstrap interval", "how sure is a mean without a distribution", "functions.tests.bootstrap_ci"),
)
#: agent, what it claims, what would disprove it, the columns that its evidence comes from
EXPLANATIONS = {
    "fulfilment": ("Deliveries became late, and that moved the KPI", "the share delivered on time did not fall in the event, or states with a larger fall moved no more than others", "orders: order_delivered_customer_date, order_estimated_delivery_date, order_delivered_carrier_date by customer_state"),
    "customer_voice": ("Customers complain of late delivery more than before", "complaints of late delivery rose no more than other complaints, or elsewhere than the KPI moved", "reviews: review_comment_message of delivered orders by topic"),
    "demand": ("More orders arrived than could be served", "weekly orders of the event are no higher than in the eight weeks before", "orders: delivered orders per week"),
    "data_feed": ("The way data are collected changed", "coverage, nulls, row counts and categories are the same in both windows", "all columns of the panel, by window"),
    "concentrated": ("A few segment values changed on their own", "the values moved alike, or no value's change survives the adjustment for many tests", "the segment columns and the metric"),
    "mix": ("The shares of segments moved, not their values", "with shares held fixed the movement remains", "the segment columns and the metric"),
    "systemic": ("Everything moved together, from outside the data", "the values of the first segment moved apart or in different directions", "the first segment column and the metric"),
    "wording": ("Texts of the event speak of something new", "no term's share of texts rose beyond chance", "the text column"),
}


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, "source string, grain string, key string, freshness_column string, sensitivity string")


def kpis(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KPIS, "metric string, unit string, formula string, population string, worse string, row_level boolean")


def methods(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METHODS, "method string, question string, function string")


def explanations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in EXPLANATIONS.items()], "agent string, hypothesis string, falsified_by string, source string")
