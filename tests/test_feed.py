"""Is the feed of the event's weeks another one: checks count, not columns."""

import datetime as dt

from tessaria.plans import investigate as I

ORDER = "week date, role string, order_status string, delivered boolean, review_score double, has_text boolean, order_delivered_customer_date timestamp, order_delivered_carrier_date timestamp, order_estimated_delivery_date timestamp, order_value double, on_time double, delivery_days double"


def orders(spark, done=0.95, reviewed=0.9, said=0.5, valued=1.0, n=1000):
    """n orders a window; the baseline has the defaults, the event what is given."""
    at, rows = dt.datetime(2018, 1, 1), []
    for role, shares in (("baseline", (0.95, 0.9, 0.5, 1.0)), ("event", (done, reviewed, said, valued))):
        d, r, t, v = (int(x * n) for x in shares)
        for i in range(n):
            j = i * 37 % n  # other orders than those without delivery
            ok = i < d
            rows.append((at.date(), role, "delivered" if ok else "shipped", ok, 4.0 if j < r else None, j < t, at if ok else None, at, at, 10.0 if j < v else None, 1.0 if ok else None, 5.0 if ok else None))
    return I.Context(spark.createDataFrame(rows, ORDER), None, "review_score", ["customer_state"])


def flagged(v):
    return {x["name"] for x in v["evidence"]["checks"] if x["flagged"]}


def test_a_fall_of_deliveries_alone_is_one_check(spark):
    v = I.order_feed(orders(spark, done=0.85))
    assert flagged(v) == {"status_mix"} and not v["supported"]
    assert len(v["evidence"]["checks"]) == 4


def test_coverage_and_text_rate_agree(spark):
    v = I.order_feed(orders(spark, reviewed=0.7, said=0.3))
    assert flagged(v) == {"review_coverage", "text_rate"} and v["supported"]


def test_several_fields_are_one_check_and_must_be_significant(spark):
    assert flagged(I.order_feed(orders(spark, valued=0.8))) == {"missing_fields"}
    assert flagged(I.order_feed(orders(spark, done=0.85, n=20))) == set()  # ten points of twenty orders are chance


def table(spark, rows_event=40, nulls=0.0, blank=None, region="a"):
    rows = []
    for w in range(20):
        event = w >= 14
        for i in range((rows_event if event else 40) + w % 3):
            gone = event and i < nulls * rows_event
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(7 * w), "event" if event else "baseline", blank if gone else 1.0, blank if gone else 2.0, region if event else "a"))
    return I.Context(spark.createDataFrame(rows, "week date, role string, x double, y double, region string"), None, "records", [])


def test_two_measures_are_one_check_of_a_table(spark):
    for blank in (None, float("nan")):
        v = I.table_feed(table(spark, nulls=0.3, blank=blank), ["region"], ["x", "y"])
        assert flagged(v) == {"missing_values"} and not v["supported"]


def test_row_volume_counts_beside_nulls(spark):
    v = I.table_feed(table(spark, rows_event=20, nulls=0.3), ["region"], ["x", "y"])
    assert flagged(v) == {"row_volume", "missing_values"} and v["supported"]
    v = I.table_feed(table(spark, rows_event=20, region="b"), ["region"], [])
    assert flagged(v) == {"row_volume", "category_drift"} and v["supported"]
