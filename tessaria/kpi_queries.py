"""Queries over the order panel: roll-ups, triage, localisation, integrity, text. Each has SQL for the same tables.

Doubles are rounded to six digits on both sides. The event window of queries that need one is fixed (FIRST..LAST, two
weeks around it belong to neither window); `event_window` and the others of its family find windows themselves, in the
weekly mean of METRIC as it is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.functions import fdr, series, tests
from tessaria.functions.labels import STATES, label
from tessaria.functions.text import STOP, TOPICS, normalised, words, words_and_pairs
from tessaria.operators import integrity, localize
from tessaria.operators import panel as P
from tessaria.plans import catalog
from tessaria.plans.sizing import LEAST_RECOVERY
from tessaria.sources.tables import table

FIRST, LAST, METRIC = "2018-01-15", "2018-03-26", "delivery_days"
SEGMENT = "customer_state"


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return P.order_panel(spark, d)


def _windows(spark: SparkSession) -> DataFrame:
    """(week, role) of every week of the span: event, buffer or baseline."""
    weeks = spark.sql(f"SELECT explode(sequence(DATE'{P.START}', DATE'{P.END}', INTERVAL 7 DAYS)) AS week")
    day = lambda s, n: F.date_add(F.lit(s).cast("date"), n)
    role = F.when(F.col("week").between(day(FIRST, 0), day(LAST, 0)), "event").when(F.col("week").between(day(FIRST, -14), day(LAST, 14)), "buffer").otherwise("baseline")
    return weeks.withColumn("role", role)


def _roled(spark: SparkSession, d: str) -> DataFrame:
    return P.with_role(_panel(spark, d), _windows(spark))


def r6(df: DataFrame) -> DataFrame:
    """All doubles rounded to six digits (halves up, with the same arithmetic as in the SQL), 32-bit integers widened."""
    out = []
    for c, t in df.dtypes:
        out.append((F.floor(F.col(c).cast("double") * 1e6 + 0.50001) / 1e6).alias(c) if t in ("double", "float") or t.startswith("decimal") else F.col(c).cast("long").alias(c) if t == "int" else F.col(c))
    return df.select(*out)


def _series(spark: SparkSession, d: str) -> DataFrame:
    return series.indexed(P.weekly(_panel(spark, d)), METRIC)


def _z(spark: SparkSession, d: str) -> DataFrame:
    return series.with_z(_series(spark, d))


def panel_rollup(spark, d):
    cols = ["order_id", "customer_state", "week", "delivered", "order_value", "freight_value", "n_items", "review_score", "on_time", "delivery_days", "days_late", "days_to_carrier", "cancellation_rate", "has_text"]
    return r6(_panel(spark, d).select(*cols))


def order_items_agg(spark, d):
    return r6(P.order_items_rollup(table(spark, d, "olist_order_items_dataset")))


def review_rollup(spark, d):
    r = P.review_rollup(table(spark, d, "olist_order_reviews_dataset"))
    return r6(r.select("order_id", "review_score", F.coalesce("review_text", F.lit("")).alias("review_text"), F.unix_micros("review_created").alias("review_created_micros")))


def weekly_kpis(spark, d):
    return r6(P.weekly(_panel(spark, d)))


def weekly_kpis_by_segment(spark, d):
    return r6(P.weekly(_panel(spark, d), [SEGMENT]))


def weekly_cancellation(spark, d):
    return r6(P.weekly(_panel(spark, d)).select("week", "orders_placed", "orders", "cancellation_rate", "review_score"))


def weekly_topic_rates(spark, d):
    return r6(P.weekly(_panel(spark, d), topics=True).select("week", "n_text", *[f"topic_{t}" for t in TOPICS]))


def topic_counts(spark, d):
    return P.topic_counts(_panel(spark, d), F.col("delivered"))


def region_options(spark, d):
    return P.region_options(_panel(spark, d)).withColumn("label", label(F.col("customer_state")))


def robust_baseline(spark, d):
    return r6(series.robust_baseline(_series(spark, d)))


def weekly_z(spark, d):
    return r6(_z(spark, d).select("i", "week", "value", "z"))


def control_limits(spark, d):
    return r6(_z(spark, d).select("center", "scale", "lower", "upper").distinct())


def sustained_runs(spark, d):
    return r6(series.sustained_runs(_z(spark, d)))


def event_core(spark, d):
    return r6(series.event_core(_z(spark, d)))


def event_window(spark, d):
    z = _z(spark, d)
    return r6(series.event_window(z, series.event_core(z)).select("i", "week", "value", "z", "role"))


def extreme_week(spark, d):
    z = _z(spark, d)
    return r6(z.orderBy(F.abs("z").desc(), "i").limit(1).select("i", "week", "value", "z"))


def cusum_path(spark, d):
    return r6(series.cusum(_z(spark, d)).select("i", "week", "hi", "lo", "crossed"))


def cusum_first_cross(spark, d):
    return r6(series.first_crossing(series.cusum(_z(spark, d))))


def lead_lag_corr(spark, d):
    return r6(series.lead_lag(P.weekly(_panel(spark, d)), "on_time", "review_score"))


def _moments(spark, d, *metrics):
    return localize.segment_moments(_roled(spark, d), SEGMENT, metrics, F.col("delivered"))


def welch_moments(spark, d):
    m = _roled(spark, d).where("delivered")
    e, b = F.col("role") == "event", F.col("role") == "baseline"
    w = tests.with_welch(m.agg(*tests.moments(F.col("review_score"), e, "e"), *tests.moments(F.col("review_score"), b, "b")))
    return r6(w.select("e_n", "b_n", "e_mean", "b_mean", "e_var", "b_var", "estimate", "se", "t", "dof"))


def welch_p_values(spark, d):
    s = localize.segment_scan(_moments(spark, d, "review_score"), "review_score")
    return r6(s.select("segment", "t", "dof", "p_value", "ci_low", "ci_high", "p_adjusted", "rejected"))


def two_proportion_z(spark, d):
    p = _roled(spark, d)
    e, b = F.col("role") == "event", F.col("role") == "baseline"
    c = p.agg(F.count(F.when(e & F.col("delivered"), 1)).alias("x_e"), F.count(F.when(e, 1)).alias("n_e"), F.count(F.when(b & F.col("delivered"), 1)).alias("x_b"), F.count(F.when(b, 1)).alias("n_b"))
    for k, v in tests.two_proportion(F.col("x_e"), F.col("n_e"), F.col("x_b"), F.col("n_b")).items():
        c = c.withColumn(k, v)
    return r6(c)


def mix_vs_rate(spark, d):
    return r6(localize.mix_vs_rate(_moments(spark, d, "review_score"), "review_score"))


def segment_shares(spark, d):
    return r6(localize.segment_shares(_moments(spark, d, "review_score")))


def segment_scan_moments(spark, d):
    s = localize.segment_scan(_moments(spark, d, "review_score"), "review_score")
    return r6(s.select("segment", "e_n", "b_n", "e_mean", "b_mean", "delta", "se", "contribution"))


def bh_adjust(spark, d):
    """Adjustment of the segments' tests, by a stand-in for p that both engines compute alike: 1 / (1 + t^2)."""
    s = localize.segment_scan(_moments(spark, d, "review_score"), "review_score").select("segment", (1 / (1 + F.col("t") * F.col("t"))).alias("p_value"))
    return r6(fdr.adjusted(s))


def segment_concentration(spark, d):
    return r6(localize.concentration(localize.segment_scan(_moments(spark, d, "review_score"), "review_score")))


def segment_uniformity(spark, d):
    return r6(localize.uniformity(localize.segment_scan(_moments(spark, d, "review_score"), "review_score")).drop("n_values"))


def simpson_fraction(spark, d):
    return r6(localize.simpson_fraction(localize.segment_scan(_moments(spark, d, "review_score"), "review_score")))


def dose_response(spark, d):
    return r6(localize.dose_response(_moments(spark, d, "on_time", "review_score"), "on_time", "review_score").select("n", "slope", "r"))


def did_estimate(spark, d):
    groups = localize.did_groups(_moments(spark, d, "on_time"), "on_time")
    return r6(localize.did_estimate(localize.did_cells(_roled(spark, d).where("delivered"), groups, SEGMENT, "review_score")))


def parallel_trend_slope(spark, d):
    groups = localize.did_groups(_moments(spark, d, "on_time"), "on_time")
    return r6(localize.parallel_trend(_roled(spark, d).where("delivered"), groups, SEGMENT, "review_score"))


def order_level_late_vs_ontime(spark, d):
    rows = _roled(spark, d).where("delivered AND role = 'event'")
    w = rows.agg(*tests.moments(F.col("review_score"), F.col("on_time") == 0, "e"), *tests.moments(F.col("review_score"), F.col("on_time") == 1, "b"))
    return r6(tests.with_welch(w).select("e_n", "b_n", "e_mean", "b_mean", "estimate", "se"))


def leg_decomposition(spark, d):
    rows = _roled(spark, d).where("delivered")
    change = lambda c: F.avg(F.when(F.col("role") == "event", F.col(c))) - F.avg(F.when(F.col("role") == "baseline", F.col(c)))
    t = rows.agg(change("delivery_days").alias("total"), change("days_to_carrier").alias("handling"))
    return r6(t.withColumn("transit", F.col("total") - F.col("handling")).withColumn("transit_share", F.when(F.col("total") != 0, F.col("transit") / F.col("total")).otherwise(0.0)))


def demand_vs_prior8(spark, d):
    w = P.weekly(_panel(spark, d)).select("week", "orders")
    e = F.col("week").between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))
    before = F.row_number().over(series.Window.partitionBy(F.col("week") < F.lit(FIRST).cast("date")).orderBy(F.col("week").desc()))
    w = w.withColumn("prior", (F.col("week") < F.lit(FIRST).cast("date")) & (before <= 8)).withColumn("event", e)
    m = tests.with_welch(w.agg(*tests.moments(F.col("orders"), F.col("event"), "e"), *tests.moments(F.col("orders"), F.col("prior"), "b"), F.avg(F.when(~F.col("event"), F.col("orders"))).alias("rest")))
    return r6(m.select("e_n", "b_n", "e_mean", "b_mean", "estimate", "se", (F.col("e_mean") / F.col("rest")).alias("ratio")))


def topic_lift(spark, d):
    return r6(localize.topic_lift(_roled(spark, d), list(TOPICS)).select("topic", "x_e", "n_e", "x_b", "n_b", "rate_e", "rate_b", "lift", "estimate", "z"))


def text_segment_alignment(spark, d):
    return r6(localize.text_alignment(_roled(spark, d), SEGMENT, "topic_delivery_delay", ["RJ", "BA", "PE"]))


def integrity_rows_per_week(spark, d):
    return r6(integrity.rows_per_week(integrity.with_part(_panel(spark, d))).select("e_n", "b_n", "e_mean", "b_mean", "estimate", "se", "shift"))


def integrity_coverage(spark, d):
    return r6(integrity.coverage(integrity.with_part(_panel(spark, d)), "review_score").select("x_e", "n_e", "x_b", "n_b", "estimate", "z"))


def integrity_null_rates(spark, d):
    return r6(integrity.null_rates(integrity.with_part(_panel(spark, d)), ["order_value", "review_score", "order_delivered_customer_date"]))


def integrity_category_drift(spark, d):
    v = integrity.category_drift(integrity.with_part(_panel(spark, d)), ["customer_state", "order_status", "customer_city"])
    return r6(v.select("column_name", "drift", F.array_join("gone", ",").alias("gone"), F.array_join("new", ",").alias("new")))


def normalized_text(spark, d):
    return table(spark, d, "documents").select("doc_id", normalised(F.col("text")).alias("norm"))


def topic_flags(spark, d):
    return r6(_panel(spark, d).where("has_text").select("order_id", *[f"topic_{t}" for t in TOPICS]))


def _doc_terms(spark, d):
    t = table(spark, d, "upload_records").select(normalised(F.col("customer_feedback")).alias("norm")).where("norm IS NOT NULL")
    return t


def term_doc_frequency(spark, d):
    return _doc_terms(spark, d).select(F.explode(F.array_distinct(words(F.col("norm")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bigram_doc_frequency(spark, d):
    w = _doc_terms(spark, d).select(F.explode(F.array_distinct(words_and_pairs(F.col("norm")))).alias("term")).where(F.instr("term", " ") > 0)
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_lift(spark, d):
    return r6(localize.term_lift(_roled(spark, d), "review_text").select("term", "k_e", "k_b", "n_e", "n_b", "rate_e", "rate_b", "lift", "estimate", "z"))


def freshness(spark, d):
    names = ["olist_orders_dataset", "olist_customers_dataset", "olist_order_items_dataset", "olist_order_reviews_dataset"]
    parts = [table(spark, d, n).agg(F.lit(n).alias("source"), F.count(F.lit(1)).alias("n_rows"), F.date_format(F.max("loaded_at"), "yyyy-MM-dd HH:mm:ss").alias("newest")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def segment_count_scan(spark, d):
    """Weekly delivered orders of each state, event against baseline."""
    s = localize.count_scan(_roled(spark, d).where("delivered"), SEGMENT)
    return r6(s.select("segment", "e_n", "b_n", "e_mean", "b_mean", "delta", "se"))


def recovery_sizes(spark, d):
    """Per state: the share on time in the event, half of what it lost (2 points at least), orders per arm that show it."""
    m = _moments(spark, d, "on_time").where("segment IS NOT NULL AND on_time_e_n > 0 AND on_time_b_n > 0").select("segment", F.col("on_time_e_mean").alias("now"), F.col("on_time_b_mean").alias("before"))
    rows = [(r["segment"], r["now"], r["before"], max((r["before"] - r["now"]) / 2, LEAST_RECOVERY)) for r in m.collect()]  # one row a state
    return r6(spark.createDataFrame([(*r, tests.required_sample_size(r[1], r[3])) for r in rows], "segment string, now double, before double, mde double, n_per_arm long"))


def catalog_sources(spark, d):
    """The sources with their rows and how fresh they are."""
    return catalog.sources(spark).join(freshness(spark, d), "source")


def catalog_kpis(spark, d):
    return catalog.kpis(spark)


def catalog_methods(spark, d):
    return catalog.methods(spark)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        panel_rollup, order_items_agg, review_rollup, weekly_kpis, weekly_kpis_by_segment, weekly_cancellation, weekly_topic_rates, topic_counts, region_options, robust_baseline, weekly_z, control_limits, sustained_runs, event_core,
        event_window, extreme_week, cusum_path, cusum_first_cross, lead_lag_corr, welch_moments, welch_p_values, two_proportion_z, mix_vs_rate, segment_shares, segment_scan_moments, bh_adjust, segment_concentration, segment_uniformity,
        simpson_fraction, dose_response, did_estimate, parallel_trend_slope, order_level_late_vs_ontime, leg_decomposition, demand_vs_prior8, topic_lift, text_segment_alignment, integrity_rows_per_week, integrity_coverage, integrity_null_rates,
        integrity_category_drift, normalized_text, topic_flags, term_doc_frequency, bigram_doc_frequency, term_lift, freshness, segment_count_scan, recovery_sizes, catalog_sources, catalog_kpis, catalog_methods,
    )
}

# --- SQL ---

_NUM = "CASE WHEN isnan({0}) THEN NULL ELSE {0} END"


@lru_cache
def _decompositions() -> str:
    """A SQL map from each character that NFKD or the loss of its marks changes to what is left, by rule from the
    Unicode data; Latin first, because the map is searched in order. Hangul syllables are left out: 11,172 of them."""
    pairs = []
    for i in (*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1F300), *range(0x2F800, 0x2FA20), *range(0x1FBF0, 0x1FBFA)):
        left = "".join(x for x in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(x))
        if left != chr(i):
            pairs.append((chr(i), left.replace("'", "''")))
    said = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return f"MAP([{said(c for c, _ in pairs)}], [{said(x for _, x in pairs)}])"


def _normalised(column: str) -> str:
    """Lower case, NFKD, without combining marks: character by character, where a text has others than ASCII."""
    each = f"lambda c: CASE WHEN c < chr(128) THEN c ELSE coalesce({_decompositions()}[c], c) END"
    return f"CASE WHEN regexp_matches({column}, '[^\\x00-\\x7f]') THEN array_to_string(list_transform(regexp_extract_all(lower({column}), '(?s).'), {each}), '') ELSE lower({column}) END"


#: Where a query's SQL needs the normalised review text; the others leave it out.
NORM = "/*norm*/NULL::VARCHAR"
_TOPIC = ", ".join(f"regexp_matches(norm, '{p}')::INT::DOUBLE AS topic_{t}" for t, p in TOPICS.items())
_DAYS = "(epoch_us({0}) - epoch_us({1})) / 86400e6"
ITEMS = f"""
items1 AS (SELECT lower(trim(order_id)) AS order_id, order_item_id, max({_NUM.format("price")}) AS price, max({_NUM.format("freight_value")}) AS freight FROM olist_order_items_dataset WHERE trim(order_id) <> '' GROUP BY ALL),
items2 AS (SELECT order_id, sum(price) AS order_value, sum(freight) AS freight_value, count(*) AS n_items FROM items1 GROUP BY 1)"""
REVIEWS = f"""
reviews1 AS (SELECT lower(trim(order_id)) AS order_id, nullif(lower(trim(review_id)), '') AS review_id, max({_NUM.format("review_score")}) AS score, max(review_comment_message) AS text, min(review_creation_date) AS made
  FROM olist_order_reviews_dataset WHERE trim(order_id) <> '' GROUP BY 1, 2),
reviews2 AS (SELECT order_id, avg(score) AS review_score, coalesce(string_agg(text, ' ' ORDER BY made NULLS FIRST, review_id NULLS FIRST, text) FILTER (trim(text) <> ''), '') AS review_text, min(made) AS review_created FROM reviews1 GROUP BY 1)"""
PANEL = f"""
{ITEMS}, {REVIEWS},
orders1 AS (SELECT lower(trim(order_id)) AS order_id, nullif(lower(trim(customer_id)), '') AS customer_id, * EXCLUDE (order_id, customer_id) FROM olist_orders_dataset WHERE trim(order_id) <> ''
  AND date_trunc('week', order_purchase_timestamp AT TIME ZONE 'UTC')::DATE BETWEEN DATE '{P.START}' AND DATE '{P.END}'
  QUALIFY row_number() OVER (PARTITION BY lower(trim(order_id)) ORDER BY loaded_at DESC NULLS LAST, customer_id DESC NULLS LAST) = 1),
customers1 AS (SELECT lower(trim(customer_id)) AS customer_id, nullif(upper(trim(customer_state)), '') AS customer_state, lower(trim(customer_city)) AS customer_city FROM olist_customers_dataset WHERE trim(customer_id) <> ''
  QUALIFY row_number() OVER (PARTITION BY lower(trim(customer_id)) ORDER BY loaded_at DESC NULLS LAST, nullif(upper(trim(customer_state)), '') DESC NULLS LAST, lower(trim(customer_city)) DESC NULLS LAST) = 1),
panel0 AS (SELECT o.*, c.customer_state, c.customer_city, r.review_score, coalesce(r.review_text, '') AS review_text, i.order_value, i.freight_value, i.n_items,
    date_trunc('week', order_purchase_timestamp AT TIME ZONE 'UTC')::DATE AS week, coalesce(order_status = 'delivered', false) AS delivered, coalesce(order_status = 'canceled', false)::INT::DOUBLE AS cancellation_rate,
    CASE WHEN order_delivered_customer_date IS NOT NULL AND order_estimated_delivery_date IS NOT NULL THEN (order_delivered_customer_date <= order_estimated_delivery_date)::INT::DOUBLE END AS on_time,
    {_DAYS.format("order_delivered_customer_date", "order_purchase_timestamp")} AS delivery_days, {_DAYS.format("order_delivered_customer_date", "order_estimated_delivery_date")} AS days_late,
    {_DAYS.format("order_delivered_carrier_date", "order_purchase_timestamp")} AS days_to_carrier
  FROM orders1 o LEFT JOIN customers1 c USING (customer_id) LEFT JOIN reviews2 r USING (order_id) LEFT JOIN items2 i USING (order_id)),
panel1 AS (SELECT *, length(review_text) > 0 AS has_text, {NORM} AS norm FROM panel0),
panel AS (SELECT *, {_TOPIC} FROM panel1)""".replace("panel AS (", "orders_panel AS (").replace("{{", "{").replace("}}", "}")
WEEKLY_COLUMNS = """count(*) AS orders_placed, count(*) FILTER (delivered) AS orders, sum(order_value) FILTER (delivered) AS revenue,
  avg(order_value) FILTER (delivered) AS order_value, avg(on_time) FILTER (delivered) AS on_time, avg(delivery_days) FILTER (delivered) AS delivery_days, avg(days_late) FILTER (delivered) AS days_late,
  avg(days_to_carrier) FILTER (delivered) AS days_to_carrier, avg(review_score) FILTER (delivered) AS review_score, avg(n_items) FILTER (delivered) AS n_items,
  count(review_score) FILTER (delivered) AS n_reviews, avg(cancellation_rate) AS cancellation_rate"""
WEEKLY = f"{PANEL}, weekly AS (SELECT week, {WEEKLY_COLUMNS} FROM orders_panel GROUP BY week)"
SERIES = f"""{WEEKLY},
series AS (SELECT row_number() OVER (ORDER BY week) - 1 AS i, week, {METRIC} AS value FROM weekly),
med AS (SELECT median(value) AS center FROM series),
base AS (SELECT count(value) AS n, any_value(center) AS center, CASE WHEN greatest(1.4826 * median(abs(value - center)), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349) > 0
   THEN greatest(1.4826 * median(abs(value - center)), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349) ELSE coalesce(stddev_samp(value), 0) END AS scale FROM series, med),
zs AS (SELECT series.*, center, scale, CASE WHEN scale > 0 AND value IS NOT NULL THEN (value - center) / scale ELSE 0 END AS z FROM series, base)"""
RUNS = f"""{SERIES},
sides AS (SELECT i, 'down' AS direction, z <= -2 AS f FROM zs UNION ALL SELECT i, 'up', z >= 2 FROM zs),
isl AS (SELECT direction, i, f, row_number() OVER (PARTITION BY direction ORDER BY i) - row_number() OVER (PARTITION BY direction, f ORDER BY i) AS g FROM sides),
runs AS (SELECT direction, min(i) AS start_i, max(i) AS end_i, count(*) AS length FROM isl WHERE f GROUP BY direction, g HAVING count(*) >= 3),
core AS (SELECT rule, direction, start_i, end_i FROM (
    SELECT 0 AS pref, 'run' AS rule, direction, start_i, end_i, -length::DOUBLE AS by_, (direction = 'up')::INT AS side FROM runs
    UNION ALL SELECT 1, 'extreme', CASE WHEN z < 0 THEN 'down' ELSE 'up' END, i, i, -abs(z), 0 FROM zs WHERE abs(z) >= 5) ORDER BY pref, by_, side, start_i LIMIT 1)"""
WINDOWED = f"""{RUNS},
w1 AS (SELECT zs.*, start_i, end_i, (CASE WHEN direction = 'down' THEN -1 ELSE 1 END) * z >= 1 OR i BETWEEN start_i AND end_i AS f FROM zs, core),
w2 AS (SELECT *, CASE WHEN f THEN row_number() OVER (ORDER BY i) - row_number() OVER (PARTITION BY f ORDER BY i) END AS g FROM w1),
w3 AS (SELECT *, g = max(g) FILTER (i BETWEEN start_i AND end_i) OVER () AS ev FROM w2),
w4 AS (SELECT *, min(i) FILTER (ev) OVER () AS a, max(i) FILTER (ev) OVER () AS b FROM w3)"""
CUSUM = f"""{SERIES},
c1 AS (SELECT *, sum((value IS NULL)::INT) OVER (ORDER BY i) AS part FROM zs),
c2 AS (SELECT *, sum(CASE WHEN value IS NULL THEN 0 ELSE z - 0.5 END) OVER w AS sh, sum(CASE WHEN value IS NULL THEN 0 ELSE z + 0.5 END) OVER w AS sl FROM c1 WINDOW w AS (PARTITION BY part ORDER BY i)),
c3 AS (SELECT *, sh - least(0, min(sh) OVER w) AS hi, sl - greatest(0, max(sl) OVER w) AS lo FROM c2 WINDOW w AS (PARTITION BY part ORDER BY i)),
path AS (SELECT i, week, hi, lo, CASE WHEN hi > 4 THEN 'up' WHEN lo < -4 THEN 'down' END AS crossed FROM c3)"""
ROLED = f"""{PANEL},
roled AS (SELECT *, CASE WHEN week BETWEEN DATE '{FIRST}' AND DATE '{LAST}' THEN 'event' WHEN week BETWEEN DATE '{FIRST}' - 14 AND DATE '{LAST}' + 14 THEN NULL ELSE 'baseline' END AS role FROM orders_panel)"""


def _mom(metric: str, side: str, role: str) -> str:
    f = f"FILTER (role = '{role}')"
    return f"count({metric}) {f} AS {side}_n, avg({metric}) {f} AS {side}_mean, var_samp({metric}) {f} AS {side}_var"


MOMENTS = f"""{ROLED},
m0 AS (SELECT customer_state AS segment, count(*) FILTER (role = 'event') AS rows_e, count(*) FILTER (role = 'baseline') AS rows_b, {_mom("review_score", "e", "event")}, {_mom("review_score", "b", "baseline")},
   avg(on_time) FILTER (role = 'event') AS oe, avg(on_time) FILTER (role = 'baseline') AS ob FROM roled WHERE delivered AND role IS NOT NULL GROUP BY 1)"""
SCAN = f"""{MOMENTS},
tot AS (SELECT sum(e_n * e_mean) / sum(e_n) - sum(b_n * b_mean) / sum(b_n) AS overall, sum(e_n) AS all_e FROM m0),
scan AS (SELECT *, e_mean - b_mean AS delta, sqrt(e_var / e_n + b_var / b_n) AS se, CASE WHEN overall <> 0 THEN e_n / all_e * (e_mean - b_mean) / overall ELSE 0 END AS contribution
   FROM m0, tot WHERE segment IS NOT NULL AND e_n >= 40 AND b_n >= 40)"""
GROUPS = f"""{MOMENTS},
g0 AS (SELECT segment, oe - ob AS d FROM m0 WHERE segment IS NOT NULL AND rows_e >= 40 AND rows_b >= 40 AND oe - ob IS NOT NULL),
g1 AS (SELECT *, greatest(floor(count(*) OVER () / 4), 3) AS k, row_number() OVER (ORDER BY d, segment) AS lo, row_number() OVER (ORDER BY d DESC, segment) AS hi FROM g0),
grp AS (SELECT segment, CASE WHEN lo <= k THEN 'treat' WHEN hi <= k THEN 'control' END AS grp FROM g1 WHERE lo <= k OR hi <= k),
gp AS (SELECT roled.*, grp FROM roled JOIN grp ON customer_state = segment WHERE delivered AND role IS NOT NULL)"""
PARTS = f"""{PANEL},
wk AS (SELECT week, row_number() OVER (ORDER BY week) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT week FROM orders_panel)),
parts AS (SELECT p.*, CASE WHEN i > greatest(n - 8, 6) THEN 'recent' ELSE 'prior' END AS part FROM orders_panel p JOIN wk USING (week) WHERE n >= 12)"""
_STOPS = ", ".join("'" + s.replace("'", "''") + "'" for s in STOP)
_WORDS = f"list_filter(regexp_extract_all({{0}}, '[a-z][a-z''\\-]{{{{2,}}}}'), lambda w: NOT list_contains([{_STOPS}], w))".replace("{{{{", "{{").replace("}}}}", "}}")
_PAIRS = "list_transform(range(1, len({0})), lambda k: {0}[k] || ' ' || {0}[k + 1])"
TEXTS = f"texts AS (SELECT {_normalised('customer_feedback')} AS norm FROM upload_records WHERE customer_feedback IS NOT NULL), ws AS (SELECT {_WORDS.format('norm')} AS w FROM texts)".replace("{{", "{").replace("}}", "}")
_P2 = lambda xe, ne, xb, nb: f"{xe} / {ne} - {xb} / {nb} AS estimate, ({xe} / {ne} - {xb} / {nb}) / sqrt(({xe} + {xb}) / ({ne} + {nb}) * (1 - ({xe} + {xb}) / ({ne} + {nb})) * (1 / {ne} + 1 / {nb})) AS z"

_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items())


def rounded(sql: str, doubles: str) -> str:
    """sql with the named columns rounded to six digits."""
    names = [c.strip() for c in doubles.split(",") if c.strip()]
    return f"SELECT * REPLACE ({', '.join(f'floor({c}::DOUBLE * 1e6 + 0.50001) / 1e6 AS {c}' for c in names)}) FROM ({sql})" if names else sql


SQL = {
    "panel_rollup": rounded(
        f"WITH {PANEL} SELECT order_id, customer_state, week, delivered, order_value, freight_value, n_items, review_score, on_time, delivery_days, days_late, days_to_carrier, cancellation_rate, has_text FROM orders_panel",
        "order_value, freight_value, review_score, on_time, delivery_days, days_late, days_to_carrier, cancellation_rate",
    ),
    "order_items_agg": rounded(f"WITH {ITEMS} SELECT * FROM items2", "order_value, freight_value"),
    "review_rollup": rounded(f"WITH {REVIEWS} SELECT order_id, review_score, review_text, epoch_us(review_created) AS review_created_micros FROM reviews2", "review_score"),
    "weekly_kpis": rounded(f"WITH {WEEKLY} SELECT * FROM weekly", "revenue, order_value, on_time, delivery_days, days_late, days_to_carrier, review_score, n_items, cancellation_rate"),
    "weekly_kpis_by_segment": rounded(f"WITH {PANEL} SELECT week, customer_state, {WEEKLY_COLUMNS} FROM orders_panel GROUP BY week, customer_state", "revenue, order_value, on_time, delivery_days, days_late, days_to_carrier, review_score, n_items, cancellation_rate"),
    "weekly_cancellation": rounded(
        f"""WITH {PANEL}, a AS (SELECT week, count(*) AS orders_placed, avg(cancellation_rate) AS cancellation_rate FROM orders_panel GROUP BY 1),
        b AS (SELECT week, count(*) AS orders, avg(review_score) AS review_score FROM orders_panel WHERE delivered GROUP BY 1)
        SELECT week, orders_placed, coalesce(orders, 0) AS orders, cancellation_rate, review_score FROM a FULL JOIN b USING (week)""",
        "cancellation_rate, review_score",
    ),
    "weekly_topic_rates": rounded(
        f"WITH {PANEL}, t AS (SELECT week, count(*) AS n_text, {', '.join(f'avg(topic_{t}) AS topic_{t}' for t in TOPICS)} FROM orders_panel WHERE delivered AND has_text GROUP BY 1) SELECT week, coalesce(n_text, 0) AS n_text, t.* EXCLUDE (week, n_text) FROM (SELECT DISTINCT week FROM orders_panel) LEFT JOIN t USING (week)",
        ", ".join(f"topic_{t}" for t in TOPICS),
    ),
    "topic_counts": f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{t}' AS topic, sum(topic_{t})::BIGINT AS hits, count(*) AS total FROM orders_panel WHERE delivered AND has_text" for t in TOPICS),
    "region_options": f"WITH {PANEL} SELECT customer_state, count(*) AS orders, CASE customer_state {_LABELS} ELSE customer_state END AS label FROM orders_panel WHERE delivered AND customer_state IS NOT NULL GROUP BY 1",
    "robust_baseline": rounded(f"WITH {SERIES} SELECT n, center, scale FROM base", "center, scale"),
    "weekly_z": rounded(f"WITH {SERIES} SELECT i, week, value, z FROM zs", "value, z"),
    "control_limits": rounded(f"WITH {SERIES} SELECT center, scale, center - 3 * scale AS lower, center + 3 * scale AS upper FROM base", "center, scale, lower, upper"),
    "sustained_runs": f"WITH {RUNS} SELECT * FROM runs",
    "event_core": f"WITH {RUNS} SELECT * FROM core",
    "event_window": rounded(f"WITH {WINDOWED} SELECT i, week, value, z, CASE WHEN coalesce(ev, false) THEN 'event' WHEN i BETWEEN a - 2 AND b + 2 THEN 'buffer' ELSE 'baseline' END AS role FROM w4", "value, z"),
    "extreme_week": rounded(f"WITH {SERIES} SELECT i, week, value, z FROM zs ORDER BY abs(z) DESC, i LIMIT 1", "value, z"),
    "cusum_path": rounded(f"WITH {CUSUM} SELECT * FROM path", "hi, lo"),
    "cusum_first_cross": f"WITH {CUSUM} SELECT i, week, crossed FROM path WHERE crossed IS NOT NULL ORDER BY i LIMIT 1",
    "lead_lag_corr": rounded(
        f"""WITH {WEEKLY}, s AS (SELECT row_number() OVER (ORDER BY week) AS i, on_time AS x, review_score AS y FROM weekly WHERE on_time IS NOT NULL AND review_score IS NOT NULL),
        c AS (SELECT lag, count(*) AS n, corr(a.x, b.y) AS r FROM s a, (SELECT unnest(range(-4, 5)) AS lag), s b WHERE b.i = a.i + lag GROUP BY lag HAVING count(*) >= 3)
        SELECT lag, n, r, row_number() OVER (ORDER BY round(abs(r), 12) DESC, lag) = 1 AS best FROM c""",
        "r",
    ),
    "welch_moments": rounded(
        f"""WITH {ROLED}, m AS (SELECT {_mom("review_score", "e", "event")}, {_mom("review_score", "b", "baseline")} FROM roled WHERE delivered)
        SELECT e_n, b_n, e_mean, b_mean, e_var, b_var, e_mean - b_mean AS estimate, sqrt(e_var / e_n + b_var / b_n) AS se, (e_mean - b_mean) / sqrt(e_var / e_n + b_var / b_n) AS t,
        power(e_var / e_n + b_var / b_n, 2) / (power(e_var / e_n, 2) / (e_n - 1) + power(b_var / b_n, 2) / (b_n - 1)) AS dof FROM m""",
        "e_mean, b_mean, e_var, b_var, estimate, se, t, dof",
    ),
    "two_proportion_z": rounded(
        f"""WITH {ROLED}, c AS (SELECT count(*) FILTER (role = 'event' AND delivered) AS x_e, count(*) FILTER (role = 'event') AS n_e, count(*) FILTER (role = 'baseline' AND delivered) AS x_b, count(*) FILTER (role = 'baseline') AS n_b FROM roled),
        p AS (SELECT *, {_P2("x_e", "n_e", "x_b", "n_b")}, 1.959963984540054 * sqrt(x_e / n_e * (1 - x_e / n_e) / n_e + x_b / n_b * (1 - x_b / n_b) / n_b) AS h FROM c)
        SELECT x_e, n_e, x_b, n_b, estimate, estimate - h AS ci_low, estimate + h AS ci_high, z FROM p""",
        "estimate, ci_low, ci_high, z",
    ),
    "mix_vs_rate": rounded(
        f"""WITH {MOMENTS}, t AS (SELECT sum(e_n * e_mean) / sum(e_n) AS mean_e, sum(b_n * b_mean) / sum(b_n) AS mean_b FROM m0),
        k AS (SELECT e_n / sum(e_n) OVER () AS we, b_n / sum(b_n) OVER () AS wb, coalesce(b_mean, sum(b_n * b_mean) OVER () / sum(b_n) OVER ()) AS mb, e_mean FROM m0 WHERE segment IS NOT NULL),
        k2 AS (SELECT *, coalesce(e_mean, mb) AS me FROM k),
        s AS (SELECT sum((we - wb) * mb) AS mix, sum(wb * (me - mb)) AS rate, sum((we - wb) * (me - mb)) AS interaction FROM k2),
        v AS (SELECT mix, rate, interaction, mean_e, mean_b, mean_e - mean_b AS total, abs(mix) / (abs(mix) + abs(rate) + abs(interaction)) AS mix_share, abs(rate) / (abs(mix) + abs(rate) + abs(interaction)) AS rate_share FROM s, t)
        SELECT *, CASE WHEN rate_share >= 0.65 THEN 'rate' WHEN mix_share >= 0.65 THEN 'mix' ELSE 'mixed' END AS reading FROM v""",
        "mix, rate, interaction, mean_e, mean_b, total, mix_share, rate_share",
    ),
    "segment_shares": rounded(f"WITH {MOMENTS} SELECT segment, rows_e / sum(rows_e) OVER () AS share_e, rows_b / sum(rows_b) OVER () AS share_b FROM m0 WHERE segment IS NOT NULL", "share_e, share_b"),
    "segment_scan_moments": rounded(f"WITH {SCAN} SELECT segment, e_n, b_n, e_mean, b_mean, delta, se, contribution FROM scan", "e_mean, b_mean, delta, se, contribution"),
    "bh_adjust": rounded(
        f"""WITH {SCAN}, p AS (SELECT segment, 1 / (1 + (delta / se) * (delta / se)) AS p_value FROM scan), r AS (SELECT *, row_number() OVER (ORDER BY p_value) AS r, count(*) OVER () AS n FROM p),
        a AS (SELECT segment, p_value, least(1, min(p_value * n / r) OVER (ORDER BY r DESC)) AS p_adjusted FROM r) SELECT *, p_adjusted <= 0.05 AS rejected FROM a""",
        "p_value, p_adjusted",
    ),
    "segment_concentration": rounded(
        f"""WITH {SCAN}, w AS (SELECT abs(delta) AS size, abs(delta) * e_n / sum(e_n) OVER () AS weighted, max(abs(delta)) OVER () AS most FROM scan)
        SELECT max(weighted) / sum(weighted) AS concentration, (max(size) - median(size)) / max(size) AS separation, count(*) FILTER (size >= 0.5 * most) AS n_material FROM w""",
        "concentration, separation",
    ),
    "segment_uniformity": rounded(
        f"""WITH {SCAN}, u AS (SELECT greatest(avg((delta < 0)::INT), avg((delta > 0)::INT)) AS same_direction, greatest(0, least(1, 1 - least(stddev_pop(delta) / (abs(avg(delta)) + 1e-9), 1.5) / 1.5)) AS uniformity FROM scan)
        SELECT *, same_direction >= 0.8 AND uniformity >= 0.55 AS supported FROM u""",
        "same_direction, uniformity",
    ),
    "simpson_fraction": rounded(f"WITH {SCAN} SELECT count(*) AS n_segments, count(*) FILTER (delta < 0) AS n_down, coalesce(count(*) FILTER (delta < 0) / nullif(count(*), 0), 0) AS share_down FROM scan", "share_down"),
    "dose_response": rounded(
        f"""WITH {MOMENTS}, x AS (SELECT oe - ob AS x, e_mean - b_mean AS y FROM m0 WHERE segment IS NOT NULL AND rows_e >= 40 AND rows_b >= 40 AND oe - ob IS NOT NULL AND e_mean - b_mean IS NOT NULL)
        SELECT count(*) AS n, CASE WHEN count(*) >= 4 THEN regr_slope(y, x) ELSE 0 END AS slope, CASE WHEN count(*) >= 4 THEN coalesce(corr(y, x), 0) ELSE 0 END AS r FROM x""",
        "slope, r",
    ),
    "did_estimate": rounded(
        f"""WITH {GROUPS}, c AS (SELECT grp, role, count(review_score) AS n, avg(review_score) AS m, var_samp(review_score) AS v FROM gp GROUP BY ALL),
        e AS (SELECT (max(m) FILTER (grp = 'treat' AND role = 'event') - max(m) FILTER (grp = 'treat' AND role = 'baseline')) - (max(m) FILTER (grp = 'control' AND role = 'event') - max(m) FILTER (grp = 'control' AND role = 'baseline')) AS estimate, sqrt(sum(v / nullif(n, 0))) AS se FROM c)
        SELECT *, estimate - 1.959963984540054 * se AS ci_low, estimate + 1.959963984540054 * se AS ci_high FROM e""",
        "estimate, se, ci_low, ci_high",
    ),
    "parallel_trend_slope": rounded(
        f"""WITH {GROUPS}, w AS (SELECT week, avg(review_score) FILTER (grp = 'treat') AS t, avg(review_score) FILTER (grp = 'control') AS c FROM gp WHERE role = 'baseline' GROUP BY 1 ORDER BY week DESC LIMIT 12),
        k AS (SELECT *, row_number() OVER (ORDER BY week) AS k FROM w) SELECT count(*) AS n, regr_slope(t - c, k) AS slope FROM k WHERE t IS NOT NULL AND c IS NOT NULL""",
        "slope",
    ),
    "order_level_late_vs_ontime": rounded(
        f"""WITH {ROLED}, m AS (SELECT count(review_score) FILTER (on_time = 0) AS e_n, count(review_score) FILTER (on_time = 1) AS b_n, avg(review_score) FILTER (on_time = 0) AS e_mean, avg(review_score) FILTER (on_time = 1) AS b_mean,
          var_samp(review_score) FILTER (on_time = 0) AS ev, var_samp(review_score) FILTER (on_time = 1) AS bv FROM roled WHERE delivered AND role = 'event')
        SELECT e_n, b_n, e_mean, b_mean, e_mean - b_mean AS estimate, sqrt(ev / e_n + bv / b_n) AS se FROM m""",
        "e_mean, b_mean, estimate, se",
    ),
    "leg_decomposition": rounded(
        f"""WITH {ROLED}, c AS (SELECT avg(delivery_days) FILTER (role = 'event') - avg(delivery_days) FILTER (role = 'baseline') AS total, avg(days_to_carrier) FILTER (role = 'event') - avg(days_to_carrier) FILTER (role = 'baseline') AS handling FROM roled WHERE delivered)
        SELECT total, handling, total - handling AS transit, CASE WHEN total <> 0 THEN (total - handling) / total ELSE 0 END AS transit_share FROM c""",
        "total, handling, transit, transit_share",
    ),
    "demand_vs_prior8": rounded(
        f"""WITH {WEEKLY}, p AS (SELECT orders FROM weekly WHERE week < DATE '{FIRST}' ORDER BY week DESC LIMIT 8), e AS (SELECT orders FROM weekly WHERE week BETWEEN DATE '{FIRST}' AND DATE '{LAST}'),
        ms AS (SELECT count(*) AS e_n, avg(orders) AS e_mean, var_samp(orders) AS ev FROM e), mp AS (SELECT count(*) AS b_n, avg(orders) AS b_mean, var_samp(orders) AS bv FROM p),
        o AS (SELECT avg(orders) AS rest FROM weekly WHERE week NOT BETWEEN DATE '{FIRST}' AND DATE '{LAST}')
        SELECT e_n, b_n, e_mean, b_mean, e_mean - b_mean AS estimate, sqrt(ev / e_n + bv / b_n) AS se, e_mean / rest AS ratio FROM ms, mp, o""",
        "e_mean, b_mean, estimate, se, ratio",
    ),
    "topic_lift": rounded(
        f"WITH {ROLED}, c AS ("
        + " UNION ALL ".join(f"SELECT '{t}' AS topic, sum(topic_{t}) FILTER (role = 'event') AS x_e, count(*) FILTER (role = 'event') AS n_e, sum(topic_{t}) FILTER (role = 'baseline') AS x_b, count(*) FILTER (role = 'baseline') AS n_b FROM roled WHERE delivered AND has_text AND role IS NOT NULL" for t in TOPICS)
        + f") SELECT topic, x_e, n_e, x_b, n_b, x_e / n_e AS rate_e, x_b / n_b AS rate_b, coalesce(x_e / n_e / nullif(x_b / n_b, 0), 0) AS lift, {_P2('x_e', 'n_e', 'x_b', 'n_b')} FROM c",
        "x_e, x_b, rate_e, rate_b, lift, estimate, z",
    ),
    "text_segment_alignment": rounded(
        f"""WITH {ROLED}, s AS (SELECT customer_state AS s, count(*) FILTER (role = 'event') AS ne, count(*) FILTER (role = 'baseline') AS nb, avg(topic_delivery_delay) FILTER (role = 'event') AS re, avg(topic_delivery_delay) FILTER (role = 'baseline') AS rb
          FROM roled WHERE delivered AND has_text AND role IS NOT NULL AND customer_state IS NOT NULL GROUP BY 1),
        l AS (SELECT s, re / rb AS lift FROM s WHERE ne >= 30 AND nb >= 30 AND rb > 0),
        a AS (SELECT count(*) AS n, avg(lift) FILTER (s IN ('RJ', 'BA', 'PE')) AS flagged_lift, avg(lift) FILTER (s NOT IN ('RJ', 'BA', 'PE')) AS other_lift FROM l)
        SELECT *, coalesce(n >= 4 AND flagged_lift > other_lift, false) AS aligned FROM a""",
        "flagged_lift, other_lift",
    ),
    "integrity_rows_per_week": rounded(
        f"""WITH {PARTS}, w AS (SELECT week, part, count(*) AS k FROM parts GROUP BY ALL),
        m AS (SELECT count(k) FILTER (part = 'recent') AS e_n, count(k) FILTER (part = 'prior') AS b_n, avg(k) FILTER (part = 'recent') AS e_mean, avg(k) FILTER (part = 'prior') AS b_mean, var_samp(k) FILTER (part = 'recent') AS ev, var_samp(k) FILTER (part = 'prior') AS bv FROM w)
        SELECT e_n, b_n, e_mean, b_mean, e_mean - b_mean AS estimate, sqrt(ev / e_n + bv / b_n) AS se, abs(e_mean - b_mean) / greatest(b_mean, 1e-9) AS shift FROM m""",
        "e_mean, b_mean, estimate, se, shift",
    ),
    "integrity_coverage": rounded(
        f"""WITH {PARTS}, c AS (SELECT count(review_score) FILTER (part = 'recent') AS x_e, count(*) FILTER (part = 'recent') AS n_e, count(review_score) FILTER (part = 'prior') AS x_b, count(*) FILTER (part = 'prior') AS n_b FROM parts)
        SELECT *, {_P2("x_e", "n_e", "x_b", "n_b")} FROM c""",
        "estimate, z",
    ),
    "integrity_null_rates": rounded(
        f"WITH {PARTS}, u AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS column_name, avg(({c} IS NULL)::INT) FILTER (part = 'recent') AS null_recent, avg(({c} IS NULL)::INT) FILTER (part = 'prior') AS null_prior FROM parts" for c in ("order_value", "review_score", "order_delivered_customer_date"))
        + ") SELECT *, abs(null_recent - null_prior) AS shift FROM u",
        "null_recent, null_prior, shift",
    ),
    "integrity_category_drift": rounded(
        f"WITH {PARTS}, v AS ("
        + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, bool_or(part = 'recent') AS r, bool_or(part = 'prior') AS p FROM parts WHERE {c} IS NOT NULL GROUP BY 2" for c in ("customer_state", "order_status", "customer_city"))
        + """) SELECT column_name, count(*) FILTER (r <> p) / count(*) FILTER (p) AS drift, coalesce(array_to_string(list_sort(list(value) FILTER (p AND NOT r))[1:3], ','), '') AS gone, coalesce(array_to_string(list_sort(list(value) FILTER (r AND NOT p))[1:3], ','), '') AS new
        FROM (SELECT * FROM v) GROUP BY 1 HAVING count(*) FILTER (p) > 0""",
        "drift",
    ),
    "normalized_text": f"SELECT doc_id, {_normalised('text')} AS norm FROM documents",
    "topic_flags": f"WITH {PANEL} SELECT order_id, {', '.join(f'topic_{t}' for t in TOPICS)} FROM orders_panel WHERE has_text",
    "term_doc_frequency": f"WITH {TEXTS} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM ws) GROUP BY 1",
    "bigram_doc_frequency": f"WITH {TEXTS} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({_PAIRS.format('w')})) AS term FROM ws) GROUP BY 1",
    "term_lift": rounded(
        f"""WITH {ROLED}, t AS (SELECT role, {_WORDS.format("norm").replace("{{", "{").replace("}}", "}")} AS w FROM roled WHERE role IS NOT NULL AND has_text),
        n AS (SELECT count(*) FILTER (role = 'event') AS n_e, count(*) FILTER (role = 'baseline') AS n_b FROM t),
        d AS (SELECT role, unnest(list_distinct(list_concat(w, {_PAIRS.format("w")}))) AS term FROM t),
        k AS (SELECT term, count(*) FILTER (role = 'event') AS k_e, count(*) FILTER (role = 'baseline') AS k_b FROM d GROUP BY 1)
        SELECT term, k_e, k_b, n_e, n_b, k_e / n_e AS rate_e, k_b / n_b AS rate_b, k_e / n_e / greatest(k_b / n_b, 1e-9) AS lift, {_P2("k_e", "n_e", "k_b", "n_b")}
        FROM k, n WHERE n_e >= 40 AND n_b >= 40 AND k_e >= greatest(8, 0.01 * n_e) AND k_e + k_b >= 15 AND k_e / n_e > k_b / n_b""",
        "rate_e, rate_b, lift, estimate, z",
    ),
    "freshness": " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) AS n_rows, strftime(max(loaded_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS newest FROM {n}" for n in ("olist_orders_dataset", "olist_customers_dataset", "olist_order_items_dataset", "olist_order_reviews_dataset")),
}
_ZA, _ZB = NormalDist().inv_cdf(0.975), NormalDist().inv_cdf(tests.POWER)
SQL |= {
    "segment_count_scan": rounded(
        f"""WITH {ROLED}, w AS (SELECT customer_state AS segment, role, week, count(*) AS k FROM roled WHERE delivered AND role IS NOT NULL AND customer_state IS NOT NULL GROUP BY ALL),
        m AS (SELECT segment, sum(k) FILTER (role = 'event')::BIGINT AS e_n, sum(k) FILTER (role = 'baseline')::BIGINT AS b_n, avg(k) FILTER (role = 'event') AS e_mean, avg(k) FILTER (role = 'baseline') AS b_mean,
          var_samp(k) FILTER (role = 'event') AS e_var, var_samp(k) FILTER (role = 'baseline') AS b_var, count(*) FILTER (role = 'event') AS ew, count(*) FILTER (role = 'baseline') AS bw FROM w GROUP BY 1)
        SELECT segment, e_n, b_n, e_mean, b_mean, CASE WHEN ew >= 2 AND bw >= 2 THEN e_mean - b_mean ELSE 0 END AS delta, sqrt(e_var / ew + b_var / bw) AS se FROM m WHERE e_n >= 40 AND b_n >= 40""",
        "e_mean, b_mean, delta, se",
    ),
    "recovery_sizes": rounded(
        f"""WITH {ROLED}, m AS (SELECT customer_state AS segment, avg(on_time) FILTER (role = 'event') AS now, avg(on_time) FILTER (role = 'baseline') AS before FROM roled WHERE delivered AND customer_state IS NOT NULL GROUP BY 1),
        x AS (SELECT *, greatest((before - now) / 2, {LEAST_RECOVERY}) AS mde FROM m WHERE now IS NOT NULL AND before IS NOT NULL),
        q AS (SELECT *, least(greatest(now + mde, 1e-6), 1 - 1e-6) AS q FROM x)
        SELECT segment, now, before, mde, CASE WHEN now > 0 AND now < 1 THEN ceil(pow(({_ZA!r} * sqrt(2 * (now + q) / 2 * (1 - (now + q) / 2)) + {_ZB!r} * sqrt(now * (1 - now) + q * (1 - q))) / (q - now), 2))::BIGINT ELSE 0 END AS n_per_arm FROM q""",
        "now, before, mde",
    ),
}
for _name in ("weekly_topic_rates", "topic_counts", "topic_flags", "topic_lift", "text_segment_alignment", "term_lift"):
    SQL[_name] = SQL[_name].replace(NORM, _normalised("review_text"))
