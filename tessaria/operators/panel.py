"""The row-level panel of the order tables and its weekly roll-ups.

Children (reviews, items) are reduced to one row per order before they are joined, so no join fans out; repeated rows
are taken once. Ids and states are brought to one spelling. Missing values are null, never NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.functions.text import TOPICS, normalised, topic
from tessaria.operators.eager import latest
from tessaria.sources.tables import norm_id, norm_state, table

#: The weeks that queries analyse unless told otherwise.
START, END = "2017-01-02", "2018-08-20"
MEANS = ("order_value", "on_time", "delivery_days", "days_late", "days_to_carrier", "review_score", "n_items")
TIMES = ("order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date")


def number(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def order_items_rollup(items: DataFrame) -> DataFrame:
    """(order_id, order_value, freight_value, n_items) per order."""
    one = items.select(norm_id("order_id").alias("order_id"), "order_item_id", number(F.col("price")).alias("price"), number(F.col("freight_value")).alias("freight"))
    one = one.where(F.col("order_id").isNotNull()).groupBy("order_id", "order_item_id").agg(F.max("price").alias("price"), F.max("freight").alias("freight"))
    return one.groupBy("order_id").agg(F.sum("price").alias("order_value"), F.sum("freight").alias("freight_value"), F.count(F.lit(1)).alias("n_items"))


def review_rollup(reviews: DataFrame) -> DataFrame:
    """(order_id, review_score, review_text, review_created) per order; texts joined in order of creation."""
    one = reviews.select(norm_id("order_id").alias("order_id"), norm_id("review_id").alias("review_id"), number(F.col("review_score")).alias("score"), F.col("review_comment_message").alias("text"), F.col("review_creation_date").alias("at"))
    one = one.where(F.col("order_id").isNotNull()).groupBy("order_id", "review_id").agg(F.max("score").alias("score"), F.max("text").alias("text"), F.min("at").alias("at"))
    said = F.collect_list(F.when(F.trim("text") != "", F.struct("at", "review_id", "text")))
    return one.groupBy("order_id").agg(
        F.avg("score").alias("review_score"), F.array_join(F.transform(F.array_sort(said), lambda x: x["text"]), " ").alias("review_text"), F.min("at").alias("review_created")
    )


def days_between(a: str, b: str) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(86400e6)


def order_panel(spark: SparkSession, d: str, topics: bool = True, first: str | None = START, last: str | None = END) -> DataFrame:
    """One row per order with its outcomes, segments and text flags, in the weeks from first to last (None: no bound)."""
    orders = table(spark, d, "olist_orders_dataset").select(norm_id("order_id").alias("order_id"), norm_id("customer_id").alias("customer_id"), "order_status", *TIMES, "loaded_at")
    week = F.date_trunc("week", "order_purchase_timestamp").cast("date")
    orders = orders.where(F.col("order_id").isNotNull() & week.isNotNull())
    if first:
        orders = orders.where(week >= F.lit(first).cast("date"))
    if last:
        orders = orders.where(week <= F.lit(last).cast("date"))
    orders = latest(orders, ["order_id"], "loaded_at", ["customer_id", "order_status", *TIMES])
    customers = table(spark, d, "olist_customers_dataset").select(norm_id("customer_id").alias("customer_id"), norm_state("customer_state").alias("customer_state"), F.lower(F.trim("customer_city")).alias("customer_city"), "loaded_at")
    customers = latest(customers.where(F.col("customer_id").isNotNull()), ["customer_id"], "loaded_at", ["customer_state", "customer_city"])
    p = orders.join(customers, "customer_id", "left")
    p = p.join(review_rollup(table(spark, d, "olist_order_reviews_dataset")), "order_id", "left")
    p = p.join(order_items_rollup(table(spark, d, "olist_order_items_dataset")), "order_id", "left")
    on_time = F.when(F.col("order_delivered_customer_date").isNotNull() & F.col("order_estimated_delivery_date").isNotNull(), (F.col("order_delivered_customer_date") <= F.col("order_estimated_delivery_date")).cast("double"))
    p = p.withColumns(
        {
            "week": week,
            "delivered": F.coalesce(F.col("order_status") == "delivered", F.lit(False)),
            "cancellation_rate": F.coalesce(F.col("order_status") == "canceled", F.lit(False)).cast("double"),
            "on_time": on_time,
            "delivery_days": days_between("order_delivered_customer_date", "order_purchase_timestamp"),
            "days_late": days_between("order_delivered_customer_date", "order_estimated_delivery_date"),
            "days_to_carrier": days_between("order_delivered_carrier_date", "order_purchase_timestamp"),
            "review_text": F.coalesce("review_text", F.lit("")),
        }
    ).withColumn("has_text", F.length("review_text") > 0)
    if topics:
        p = p.withColumn("norm", normalised(F.col("review_text"))).withColumns({f"topic_{t}": topic(F.col("norm"), t) for t in TOPICS})
    return p


_kept: dict[tuple[str, str], DataFrame] = {}


def kept_panel(spark: SparkSession, d: str, force: bool = False) -> DataFrame:
    """The panel of a folder, persisted once per application; force reads the tables anew."""
    key = (spark.sparkContext.applicationId, d)
    if force and key in _kept:
        _kept.pop(key).unpersist()
    if key not in _kept:
        _kept[key] = order_panel(spark, d).persist()
    return _kept[key]


def mean_where(value: Column, when: Column) -> Column:
    return F.avg(F.when(when, number(value)))


def weekly(panel: DataFrame, by: Sequence[str] = (), topics: bool = False) -> DataFrame:
    """KPIs per week (and segment): figures of delivered orders, cancellation over all orders, topic rates over delivered
    orders with text. One conditional aggregate replaces the outer joins of separate roll-ups: a week with orders but no
    deliveries keeps null KPIs."""
    done = F.col("delivered")
    agg = [
        F.count(F.lit(1)).alias("orders_placed"),
        F.count(F.when(done, 1)).alias("orders"),
        F.sum(F.when(done, F.col("order_value"))).alias("revenue"),
        *[mean_where(F.col(c), done).alias(c) for c in MEANS],
        F.count(F.when(done, F.col("review_score"))).alias("n_reviews"),
        F.avg("cancellation_rate").alias("cancellation_rate"),
    ]
    if topics:
        with_text = done & F.col("has_text")
        agg += [F.count(F.when(with_text, 1)).alias("n_text"), *[mean_where(F.col(f"topic_{t}"), with_text).alias(f"topic_{t}") for t in TOPICS]]
    return panel.groupBy("week", *by).agg(*agg)


def topic_counts(panel: DataFrame, when: Column) -> DataFrame:
    """(topic, hits, total) over rows with text where a condition holds."""
    rows = panel.where(when & F.col("has_text"))
    cells = F.array(*[F.struct(F.lit(t).alias("topic"), F.col(f"topic_{t}").alias("hit")) for t in TOPICS])
    return rows.select(F.explode(cells).alias("c")).groupBy("c.topic").agg(F.sum("c.hit").cast("long").alias("hits"), F.count(F.lit(1)).alias("total"))


def with_role(panel: DataFrame, windows: DataFrame) -> DataFrame:
    """Panel rows with the `role` of their week ('event', 'baseline'); other weeks have none. windows: (week, role)."""
    return panel.join(F.broadcast(windows.where(F.col("role").isin("event", "baseline")).select("week", "role")), "week", "left")  # one row per week


def options(panel: DataFrame) -> dict:
    """What a caller can choose from: regions by delivered orders, the metrics, the first and the last week."""
    from tessaria.plans.catalog import KPIS

    span = panel.agg(F.min("week").alias("first"), F.max("week").alias("last")).first()
    regions = region_options(panel).orderBy(F.col("orders").desc(), "customer_state").collect()  # one row a region
    return {"regions": [r.asDict() for r in regions], "metrics": [k[0] for k in KPIS], "first": str(span["first"]), "last": str(span["last"])}


def region_options(panel: DataFrame) -> DataFrame:
    return panel.where("delivered AND customer_state IS NOT NULL").groupBy("customer_state").agg(F.count(F.lit(1)).alias("orders"))
