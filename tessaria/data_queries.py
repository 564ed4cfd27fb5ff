"""Queries on data quality, orphan references and skewed keys, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaria.operators import eager, orphans, quality
from tessaria.plans.materialize import cut
from tessaria.sources.tables import norm_id, norm_state, table

SHARE = 0.08
ITEMS, REVIEWS, ORDERS, CUSTOMERS = "olist_order_items_dataset", "olist_order_reviews_dataset", "olist_orders_dataset", "olist_customers_dataset"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = quality.issues(table(spark, d, "upload_records"), table(spark, d, "column_profile"))
    return found.select(F.col("feed_id").cast("long").alias("feed_id"), F.col("load_no").cast("long").alias("load_no"), "column_name", "issue")


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    figures = quality.profile(quality.value_state(table(spark, d, "upload_records")))
    share = lambda c: F.round(F.col(c) / F.col("n_rows"), 6).alias(c.replace("n_", "") + "_share")
    return figures.select(F.col("feed_id").cast("long").alias("feed_id"), F.col("load_no").cast("long").alias("load_no"), "column_name", "n_rows", share("n_null"), share("n_missing"), "n_unique", "min_number", "max_number", F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length"))


def p2_control_limits(spark: SparkSession, d: str) -> DataFrame:
    figures = quality.profile(quality.value_state(table(spark, d, "upload_records")))
    out = quality.control_limits(figures, ["n_rows", "n_null", "n_missing", "n_unique", "max_number"])
    return out.select(F.col("feed_id").cast("long").alias("feed_id"), F.col("load_no").cast("long").alias("load_no"), "column_name", "metric", F.round("value", 4).alias("value"), F.round("center", 4).alias("center"), F.round("spread", 4).alias("spread"), "out_of_control")


CHANGES = ("n_formats", "pattern_share", "value_set_change", "distance")


def p2_change(spark: SparkSession, d: str) -> DataFrame:
    """What p2_profile lacks: formats, and the change of formats, values and distribution against the base loads."""
    figures = quality.change_profile(table(spark, d, "upload_records"))
    return figures.select(F.col("feed_id").cast("long").alias("feed_id"), F.col("load_no").cast("long").alias("load_no"), "column_name", "n_formats", *[F.round(c, 6).alias(c) for c in CHANGES[1:]])


def p2_change_limits(spark: SparkSession, d: str) -> DataFrame:
    """Control limits of the metrics that p2_control_limits lacks."""
    figures = quality.change_profile(table(spark, d, "upload_records"))
    out = quality.control_limits(cut(figures), ["min_number", *CHANGES])
    return out.select(F.col("feed_id").cast("long").alias("feed_id"), F.col("load_no").cast("long").alias("load_no"), "column_name", "metric", F.round("value", 4).alias("value"), F.round("center", 4).alias("center"), F.round("spread", 4).alias("spread"), "out_of_control")


def _orphan_inputs(spark: SparkSession, d: str) -> tuple:
    t = lambda n: table(spark, d, n)
    refs = [
        orphans.Reference(ITEMS, "order_id", ORDERS, t(ITEMS), norm_id("order_id")),
        orphans.Reference(REVIEWS, "order_id", ORDERS, t(REVIEWS), norm_id("order_id")),
        orphans.Reference(ORDERS, "customer_id", CUSTOMERS, t(ORDERS), norm_id("customer_id")),
    ]
    parents = [orphans.Parent(ORDERS, t(ORDERS), norm_id("order_id")), orphans.Parent(CUSTOMERS, t(CUSTOMERS), norm_id("customer_id"))]
    removed = t("removed_keys").select("table_name", norm_id("key_value").alias("k"))
    return refs, parents, removed


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_keys(*_orphan_inputs(spark, d))


def p5_orphans_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(*_orphan_inputs(spark, d))


def state_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Per state: distinct customers, orders, items, revenue, freight, delivered orders, mean delivery days, from raw tables.

    Repeated rows count once (the latest stored one of a customer or order; an item row by order and number). Orders
    whose customer is unknown form the group of a null state, customers without orders count as customers only.
    """
    money = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double")).cast("decimal(18,4)")
    items = table(spark, d, ITEMS).select(norm_id("order_id").alias("order_id"), "order_item_id", money("price").alias("price"), money("freight_value").alias("freight"))
    items = items.where(F.col("order_id").isNotNull()).groupBy("order_id", "order_item_id").agg(F.max("price").alias("price"), F.max("freight").alias("freight"))
    item_state = eager.reduce_by_key(items, ["order_id"], {"revenue": F.col("price"), "freight": F.col("freight")}).withColumn("items", F.col(eager.COUNT)).withColumn(eager.COUNT, F.lit(1).cast("long"))
    orders = table(spark, d, ORDERS).select(
        norm_id("order_id").alias("order_id"), norm_id("customer_id").alias("customer_id"), "loaded_at",
        ((F.unix_micros("order_delivered_customer_date") - F.unix_micros("order_purchase_timestamp"))).alias("micros"),
    )
    orders = eager.latest(orders.where(F.col("order_id").isNotNull()), ["order_id"], "loaded_at", ["customer_id", "micros"])
    order_state = eager.reduce_by_key(orders, ["order_id"], {"micros": F.col("micros"), "delivered": F.col("micros").isNotNull().cast("long")}, carry=["customer_id"])
    per_order = eager.join_states(order_state, item_state, "order_id", ["micros", "delivered"], ["revenue", "freight", "items"])
    per_customer = per_order.groupBy("customer_id").agg(F.sum(eager.COUNT).alias(eager.COUNT), *[F.sum(c).alias(c) for c in ("micros", "delivered", "revenue", "freight", "items")])
    customers = table(spark, d, CUSTOMERS).select(norm_id("customer_id").alias("customer_id"), norm_state("customer_state").alias("customer_state"), "loaded_at").where(F.col("customer_id").isNotNull())
    # a null state never hides a known one: known states sort last
    customers = customers.groupBy("customer_id").agg(F.max(F.when(F.col("customer_state").isNotNull(), F.struct("loaded_at", "customer_state"))).alias("s")).select("customer_id", F.col("s.customer_state").alias("customer_state"))
    customers = customers.withColumn("customers", F.lit(1).cast("long"))
    unknown = F.col("customers").isNull()
    joined = per_customer.join(customers, "customer_id", "full_outer")
    sums = ["micros", "delivered", "revenue", "freight", "items", "customers"]
    total = eager.roll_up(joined.withColumn("customer_state", F.when(~unknown, F.col("customer_state"))), ["customer_state"], sums)
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return total.select(
        "customer_state", n("customers").alias("n_customers"), n(eager.COUNT).alias("n_orders"), n("items").alias("n_items"), n("delivered").alias("n_delivered"),
        F.round(F.col("revenue").cast("double"), 2).alias("revenue"), F.round(F.col("freight").cast("double"), 2).alias("freight"),
        F.round(F.col("micros") / F.col("delivered") / 86400e6, 6).alias("delivery_days"),
    )


def p7_state_rollup(spark: SparkSession, d: str) -> DataFrame:
    return state_rollup(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Of the joined roll-up, written once (a row a state): it is read for the total and for the states."""
    known = cut(state_rollup(spark, d)).where(F.col("customer_state").isNotNull())
    all_of = known.agg(F.sum("n_customers").alias("all_customers"))
    return known.join(F.broadcast(all_of)).where(F.col("n_customers") > SHARE * F.col("all_customers")).select("customer_state")  # one row of totals


QUERIES = {
    "p2_found": p2_found,
    "p2_profile": p2_profile,
    "p2_control_limits": p2_control_limits,
    "p2_change": p2_change,
    "p2_change_limits": p2_change_limits,
    "p5_found": p5_found,
    "p5_orphans_by_month": p5_orphans_by_month,
    "p7_found": p7_found,
    "p7_state_rollup": p7_state_rollup,
}

_NO_VALUE = ", ".join("'" + v.replace("'", "''") + "'" for v in quality.NO_VALUE)
_CELLS = f"""
cells AS (
  SELECT feed_id, load_no, u.column_name, u.value, u.number,
         u.value IS NULL OR lower(trim(u.value)) IN ({_NO_VALUE}) AS absent, load_no <= 3 AS is_base
  FROM (SELECT feed_id, load_no, unnest([
      {{'column_name': 'order_id', 'value': order_id, 'number': NULL::DOUBLE}}, {{'column_name': 'order_date', 'value': order_date, 'number': NULL::DOUBLE}},
      {{'column_name': 'region', 'value': region, 'number': NULL::DOUBLE}}, {{'column_name': 'category', 'value': category, 'number': NULL::DOUBLE}},
      {{'column_name': 'customer_feedback', 'value': customer_feedback, 'number': NULL::DOUBLE}},
      {{'column_name': 'amount', 'value': CASE WHEN isnan(amount) THEN NULL ELSE amount::VARCHAR END, 'number': CASE WHEN isnan(amount) THEN NULL ELSE amount END}},
      {{'column_name': 'quantity', 'value': quantity::VARCHAR, 'number': quantity::DOUBLE}}]) AS u FROM upload_records)
)"""
_FIGURES = """
figures AS (
  SELECT feed_id, load_no, column_name, count(*) AS n_rows, count(*) FILTER (value IS NULL) AS n_null, count(*) FILTER (absent) AS n_missing,
         count(DISTINCT value) AS n_unique, min(number) AS min_number, max(number) AS max_number,
         min(length(value)) FILTER (NOT absent) AS min_length, max(length(value)) FILTER (NOT absent) AS max_length
  FROM cells GROUP BY ALL
)"""
_FORMAT = r"regexp_replace(regexp_replace(value, '\p{L}+', 'A', 'g'), '\p{Nd}', '9', 'g')"

_CHANGES = f"""vals AS (SELECT * FROM cells WHERE NOT absent),
forms AS (SELECT feed_id, load_no, column_name, is_base, {_FORMAT} AS form FROM vals WHERE column_name IN ('order_id', 'order_date')),
base_forms AS (SELECT DISTINCT feed_id, column_name, form, true AS known FROM forms WHERE is_base),
sets AS (SELECT DISTINCT feed_id, load_no, column_name, is_base, value FROM vals WHERE column_name IN ('region', 'category')),
base_set AS (SELECT DISTINCT feed_id, column_name, value FROM sets WHERE is_base),
set_odd AS (
  SELECT l.feed_id, l.load_no, l.column_name,
         (SELECT count(*) FROM base_set b WHERE b.feed_id = l.feed_id AND b.column_name = l.column_name AND b.value NOT IN (SELECT value FROM sets s WHERE s.feed_id = l.feed_id AND s.column_name = l.column_name AND s.load_no = l.load_no))
       + (SELECT count(*) FROM sets s WHERE s.feed_id = l.feed_id AND s.column_name = l.column_name AND s.load_no = l.load_no AND s.value NOT IN (SELECT value FROM base_set b WHERE b.feed_id = l.feed_id AND b.column_name = l.column_name)) AS odd,
         (SELECT count(*) FROM base_set b WHERE b.feed_id = l.feed_id AND b.column_name = l.column_name) AS size
  FROM loads l WHERE l.column_name IN ('region', 'category')),
nums AS (SELECT feed_id, load_no, column_name, is_base, number FROM cells WHERE number IS NOT NULL),
lim AS (SELECT feed_id, column_name, min(number) AS low, max(number) AS high FROM nums WHERE is_base GROUP BY ALL),
cat AS (SELECT feed_id, column_name, load_no, value, count(*) AS n FROM vals WHERE column_name IN ('region', 'category') AND NOT is_base GROUP BY ALL),
cat_l AS (SELECT *, n / sum(n) OVER (PARTITION BY feed_id, column_name, load_no) AS p FROM cat),
cat_bn AS (SELECT feed_id, column_name, value, count(*) AS n FROM vals WHERE column_name IN ('region', 'category') AND is_base GROUP BY ALL),
cat_b AS (SELECT feed_id, column_name, value, n / sum(n) OVER (PARTITION BY feed_id, column_name) AS q FROM cat_bn),
cat_k AS (SELECT DISTINCT feed_id, column_name, load_no FROM cat),
cat_d AS (SELECT feed_id, load_no, column_name, sum(abs(p - q)) / 2 AS dist FROM (
   SELECT feed_id, column_name, load_no, value, p, coalesce(q, 0) AS q FROM cat_l LEFT JOIN cat_b USING (feed_id, column_name, value)
   UNION ALL SELECT k.feed_id, k.column_name, k.load_no, b.value, 0, b.q FROM cat_k k JOIN cat_b b USING (feed_id, column_name) ANTI JOIN cat c ON c.feed_id = k.feed_id AND c.column_name = k.column_name AND c.load_no = k.load_no AND c.value = b.value) GROUP BY ALL),
num_k AS (SELECT DISTINCT feed_id, column_name, load_no FROM nums WHERE NOT is_base),
points AS (
  SELECT feed_id, column_name, load_no, number, count(*) AS n, 0 AS b FROM nums WHERE NOT is_base GROUP BY ALL
  UNION ALL SELECT k.feed_id, k.column_name, k.load_no, m.number, 0, count(*) FROM num_k k JOIN nums m ON m.feed_id = k.feed_id AND m.column_name = k.column_name AND m.is_base GROUP BY ALL),
steps AS (SELECT feed_id, column_name, load_no, number, sum(n) AS n, sum(b) AS b FROM points GROUP BY ALL),
cum AS (SELECT feed_id, column_name, load_no,
   sum(n) OVER (PARTITION BY feed_id, column_name, load_no ORDER BY number) / sum(n) OVER (PARTITION BY feed_id, column_name, load_no)
 - sum(b) OVER (PARTITION BY feed_id, column_name, load_no ORDER BY number) / nullif(sum(b) OVER (PARTITION BY feed_id, column_name, load_no), 0) AS diff FROM steps),"""

_CHANGE = f"""
WITH {_CELLS},
loads AS (SELECT DISTINCT feed_id, load_no, column_name FROM cells WHERE NOT is_base),
{_CHANGES}
every AS (SELECT feed_id, load_no, column_name, count(DISTINCT {_FORMAT}) FILTER (NOT absent) AS n_formats FROM cells GROUP BY ALL),
pat AS (SELECT feed_id, load_no, column_name, avg((known IS NULL)::INT) AS pattern_share FROM forms LEFT JOIN base_forms USING (feed_id, column_name, form)
  WHERE NOT is_base AND (feed_id, column_name) IN (SELECT feed_id, column_name FROM base_forms) GROUP BY ALL),
sets_c AS (SELECT feed_id, load_no, column_name, odd / size AS value_set_change FROM set_odd WHERE size > 0),
dist AS (SELECT feed_id, load_no, column_name, dist AS distance FROM cat_d UNION ALL SELECT feed_id, load_no, column_name, max(abs(diff)) FROM cum GROUP BY ALL)
SELECT feed_id::BIGINT AS feed_id, load_no::BIGINT AS load_no, column_name, n_formats, pattern_share, value_set_change, distance
FROM every LEFT JOIN pat USING (feed_id, load_no, column_name) LEFT JOIN sets_c USING (feed_id, load_no, column_name) LEFT JOIN dist USING (feed_id, load_no, column_name)"""

SQL = {
    "p2_found": f"""
WITH {_CELLS}, {_FIGURES},
loads AS (SELECT DISTINCT feed_id, load_no, column_name FROM cells WHERE NOT is_base),
miss AS (SELECT feed_id, column_name, load_no, is_base, avg(absent::INT) AS share FROM cells GROUP BY ALL),
miss_base AS (SELECT feed_id, column_name, avg(absent::INT) AS share FROM cells WHERE is_base GROUP BY ALL),
{_CHANGES}
rec AS (SELECT DISTINCT feed_id, load_no, name AS column_name, role, n_unique, null_rate FROM column_profile WHERE name IS NOT NULL),
found AS (
  SELECT l.feed_id, l.load_no, l.column_name, 'missing' AS issue FROM miss l JOIN miss_base b USING (feed_id, column_name) WHERE NOT l.is_base AND l.share - b.share > 0.10 + 1e-9
  UNION ALL SELECT feed_id, load_no, column_name, 'pattern' FROM forms LEFT JOIN base_forms USING (feed_id, column_name, form) WHERE NOT is_base AND (feed_id, column_name) IN (SELECT feed_id, column_name FROM base_forms) GROUP BY feed_id, load_no, column_name HAVING avg((known IS NULL)::INT) > 0.05 + 1e-9
  UNION ALL SELECT feed_id, load_no, column_name, 'value_set' FROM set_odd WHERE size > 0 AND odd / size > 0.30 + 1e-9
  UNION ALL SELECT feed_id, load_no, column_name, 'range' FROM nums JOIN lim USING (feed_id, column_name) WHERE NOT is_base GROUP BY feed_id, load_no, column_name HAVING avg((number < low OR number > high)::INT) > 0.05 + 1e-9
  UNION ALL SELECT feed_id, load_no, column_name, 'distribution' FROM cat_d WHERE dist > 0.25 + 1e-9
  UNION ALL SELECT feed_id, load_no, column_name, 'distribution' FROM cum GROUP BY ALL HAVING max(abs(diff)) > 0.25 + 1e-9
  UNION ALL SELECT feed_id, load_no, column_name, 'null_rate' FROM rec r JOIN figures f USING (feed_id, load_no, column_name) WHERE NOT isnan(r.null_rate) AND abs(r.null_rate - n_null / n_rows) > 0.005 + 1e-9
  UNION ALL SELECT feed_id, load_no, column_name, 'n_unique' FROM rec r JOIN figures f USING (feed_id, load_no, column_name) WHERE r.n_unique <> f.n_unique
  UNION ALL SELECT r.feed_id, r.load_no, r.column_name, 'role' FROM rec r JOIN (SELECT feed_id, column_name, min(role) AS role FROM rec WHERE load_no = 1 GROUP BY ALL) f USING (feed_id, column_name) WHERE r.load_no > 3 AND r.role <> f.role)
SELECT DISTINCT feed_id::BIGINT AS feed_id, load_no::BIGINT AS load_no, column_name, issue FROM found""",
    "p2_profile": f"""
WITH {_CELLS}, {_FIGURES}
SELECT feed_id::BIGINT AS feed_id, load_no::BIGINT AS load_no, column_name, n_rows, round(n_null / n_rows, 6) AS null_share, round(n_missing / n_rows, 6) AS missing_share,
       n_unique, min_number, max_number, min_length::BIGINT AS min_length, max_length::BIGINT AS max_length FROM figures""",
    "p2_change": f"""
SELECT feed_id, load_no, column_name, n_formats, round(pattern_share, 6) AS pattern_share, round(value_set_change, 6) AS value_set_change, round(distance, 6) AS distance FROM ({_CHANGE})""",
    "p2_control_limits": f"""
WITH {_CELLS}, {_FIGURES},
long AS (SELECT feed_id, load_no, column_name, unnest([
   {{'metric': 'n_rows', 'value': n_rows::DOUBLE}}, {{'metric': 'n_null', 'value': n_null::DOUBLE}}, {{'metric': 'n_missing', 'value': n_missing::DOUBLE}},
   {{'metric': 'n_unique', 'value': n_unique::DOUBLE}}, {{'metric': 'max_number', 'value': max_number}}]) AS u FROM figures),
lim AS (SELECT feed_id, load_no, column_name, u.metric AS metric, u.value AS value, avg(u.value) OVER w AS center, stddev_samp(u.value) OVER w AS spread, count(u.value) OVER w AS n
   FROM long WINDOW w AS (PARTITION BY feed_id, column_name, u.metric ORDER BY load_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT feed_id::BIGINT AS feed_id, load_no::BIGINT AS load_no, column_name, metric, round(value, 4) AS value, round(center, 4) AS center, round(spread, 4) AS spread,
       coalesce(n >= 3 AND abs(value - center) > 3 * spread + 1e-9, false) AS out_of_control FROM lim""",
}

SQL["p2_change_limits"] = f"""
WITH change AS ({_CHANGE}),
{_CELLS}, {_FIGURES},
long AS (SELECT feed_id, load_no, column_name, unnest([{{'metric': 'min_number', 'value': min_number}}]) AS u FROM figures
  UNION ALL SELECT feed_id, load_no, column_name, unnest([{{'metric': 'n_formats', 'value': n_formats::DOUBLE}}, {{'metric': 'pattern_share', 'value': pattern_share::DOUBLE}}, {{'metric': 'value_set_change', 'value': value_set_change::DOUBLE}}, {{'metric': 'distance', 'value': distance::DOUBLE}}]) FROM change),
lim AS (SELECT feed_id, load_no, column_name, u.metric AS metric, u.value AS value, avg(u.value) OVER w AS center, stddev_samp(u.value) OVER w AS spread, count(u.value) OVER w AS n
   FROM long WINDOW w AS (PARTITION BY feed_id, column_name, u.metric ORDER BY load_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT feed_id::BIGINT AS feed_id, load_no::BIGINT AS load_no, column_name, metric, round(value, 4) AS value, round(center, 4) AS center, round(spread, 4) AS spread,
       coalesce(n >= 3 AND abs(value - center) > 3 * spread + 1e-9, false) AS out_of_control FROM lim"""

_REFS = """
refs AS (
  SELECT 'olist_order_items_dataset' AS child_table, 'order_id' AS ref_column, 'olist_orders_dataset' AS parent, lower(trim(order_id)) AS k, loaded_at FROM olist_order_items_dataset
  UNION ALL SELECT 'olist_order_reviews_dataset', 'order_id', 'olist_orders_dataset', lower(trim(order_id)), loaded_at FROM olist_order_reviews_dataset
  UNION ALL SELECT 'olist_orders_dataset', 'customer_id', 'olist_customers_dataset', lower(trim(customer_id)), loaded_at FROM olist_orders_dataset),
parents AS (
  SELECT 'olist_orders_dataset' AS parent, lower(trim(order_id)) AS k, min(loaded_at) AS born FROM olist_orders_dataset GROUP BY ALL
  UNION ALL SELECT 'olist_customers_dataset', lower(trim(customer_id)), min(loaded_at) FROM olist_customers_dataset GROUP BY ALL),
gone AS (SELECT DISTINCT table_name AS parent, lower(trim(key_value)) AS k, true AS listed FROM removed_keys),
judged AS (
  SELECT r.child_table, r.ref_column, r.k AS ref_value, strftime(r.loaded_at AT TIME ZONE 'UTC', '%Y-%m') AS period,
         CASE WHEN p.k IS NULL AND listed THEN 'deleted' WHEN p.k IS NULL THEN 'missing' WHEN r.loaded_at < born THEN 'late' END AS state
  FROM refs r LEFT JOIN parents p ON p.parent = r.parent AND p.k = r.k LEFT JOIN gone g ON g.parent = r.parent AND g.k = r.k
  WHERE r.k <> '')"""
SQL |= {
    "p5_found": f"WITH {_REFS} SELECT DISTINCT child_table, ref_column, ref_value, state FROM judged WHERE state IS NOT NULL",
    "p5_orphans_by_month": f"WITH {_REFS} SELECT child_table, ref_column, period, state, count(DISTINCT ref_value) AS n_keys FROM judged WHERE state IS NOT NULL GROUP BY ALL",
    "p7_found": f"""
WITH c AS (SELECT lower(trim(customer_id)) AS id, upper(trim(customer_state)) AS s, loaded_at FROM olist_customers_dataset WHERE trim(customer_id) <> '' AND trim(customer_state) <> ''),
one AS (SELECT id, max({{'at': loaded_at, 's': s}}).s AS s FROM c GROUP BY id)
SELECT s AS customer_state FROM one GROUP BY s HAVING count(*) > {SHARE} * (SELECT count(*) FROM one)""",
    "p7_state_rollup": """
WITH c AS (SELECT lower(trim(customer_id)) AS id, max(CASE WHEN trim(customer_state) <> '' THEN {'at': loaded_at, 's': upper(trim(customer_state))} END).s AS customer_state FROM olist_customers_dataset WHERE trim(customer_id) <> '' GROUP BY 1),
o AS (SELECT lower(trim(order_id)) AS id, max({'at': loaded_at, 'c': nullif(lower(trim(customer_id)), ''), 'm': epoch_us(order_delivered_customer_date) - epoch_us(order_purchase_timestamp)}) AS b FROM olist_orders_dataset WHERE trim(order_id) <> '' GROUP BY 1),
i AS (SELECT id, count(*) AS n, sum(price) AS price, sum(freight) AS freight FROM (
   SELECT lower(trim(order_id)) AS id, order_item_id, max(CASE WHEN isnan(price) THEN NULL ELSE price END::DECIMAL(18,4)) AS price, max(CASE WHEN isnan(freight_value) THEN NULL ELSE freight_value END::DECIMAL(18,4)) AS freight
   FROM olist_order_items_dataset WHERE trim(order_id) <> '' GROUP BY ALL) GROUP BY id),
f AS (SELECT c.customer_state, o.b.m AS m, i.n, i.price, i.freight FROM o LEFT JOIN c ON c.id = o.b.c LEFT JOIN i ON i.id = o.id),
fs AS (SELECT customer_state, count(*) AS n_orders, sum(n) AS n_items, count(m) AS n_delivered, sum(price) AS price, sum(freight) AS freight, sum(m) AS m FROM f GROUP BY 1),
cs AS (SELECT customer_state, count(*) AS n_customers FROM c GROUP BY 1)
SELECT coalesce(fs.customer_state, cs.customer_state) AS customer_state, coalesce(n_customers, 0)::BIGINT AS n_customers, coalesce(n_orders, 0)::BIGINT AS n_orders, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(n_delivered, 0)::BIGINT AS n_delivered,
       round(price::DOUBLE, 2) AS revenue, round(freight::DOUBLE, 2) AS freight, round(m / n_delivered / 86400e6, 6) AS delivery_days
FROM fs FULL JOIN cs ON fs.customer_state IS NOT DISTINCT FROM cs.customer_state""",
}
