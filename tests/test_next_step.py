"""What an investigation says of itself and of what comes next."""

import pytest

from pyspark.sql import functions as F

from tessaria.operators import localize
from tessaria.operators import panel as P
from tessaria.plans import catalog, investigate, sizing
from tessaria.sources.csv_upload import Uploads


def rows(spark):
    data = []
    for w in range(20):
        for s, n in (("a", 30), ("b", 30), ("c", 30), ("d", 4)):
            late = w >= 16 and s == "a"
            data += [(f"2018-{1 + w // 4:02d}-{1 + 7 * (w % 4):02d}", s, "event" if w >= 16 else "baseline", True, 0.2 if late else 0.9, 2.0 + i % 3) for i in range(n * 2 if late else n)]
    df = spark.createDataFrame(data, "week string, customer_state string, role string, delivered boolean, on_time double, review_score double")
    return df.withColumn("week", F.col("week").cast("date"))


def test_size_of_a_recovery_test(spark):
    t = sizing.recovery_test(rows(spark), [100.0, 200.0], "customer_state", ["a"], True)
    now = (60 * 0.2 + 64 * 0.9) / 124
    assert t["baseline"] == pytest.approx(now) and t["mde"] == pytest.approx((0.9 - now) / 2) and t["instrument"].startswith("intervention")
    share = (16 * 30 + 4 * 60) / (16 * 94 + 4 * 124)
    assert t["per_week"] == pytest.approx(150 * share) and t["weeks"] == -(-2 * t["n_per_arm"] // t["per_week"]) and t["n_per_arm_score"] > 0
    assert sizing.recovery_test(rows(spark).limit(0), [], "customer_state", [], False)["weeks"] == 0


def test_size_of_a_movement_test(spark):
    t = sizing.movement_test(rows(spark), "review_score", -0.5, "customer_state", ["a"], False)
    assert t["mde"] == 0.25 and t["instrument"].startswith("difference") and t["per_week"] == pytest.approx(124 * 60 / 124) and t["n_per_arm"] > 0
    assert sizing.movement_test(rows(spark).withColumn("one", F.lit(1.0)), "one", 0.0, "customer_state", [], False)["n_per_arm"] == 0


def test_weekly_counts_of_segments(spark):
    got = {r.segment: r for r in localize.count_scan(rows(spark), "customer_state", 20).collect()}
    assert got.keys() == {"a", "b", "c"}  # 16 rows of d in the event
    assert got["a"].delta == 30.0 and got["b"].delta == 0.0 and (got["a"].e_n, got["a"].b_n) == (240, 480)
    assert localize.count_scan(rows(spark).limit(0), "customer_state").count() == 0


def test_every_explanation_says_what_would_disprove_it_and_where_its_evidence_is_from():
    for agent in catalog.EXPLANATIONS:
        v = investigate.verdict(agent, "x", lift=2.0)
        assert v["hypothesis"] and v["falsified_by"] and all(i["source"] for i in v["items"]) and v["items"][0]["value"] == 2.0


def test_open_explanations_are_told_apart_by_their_checks():
    vs = [investigate.verdict("demand", "external"), investigate.verdict("fulfilment", "fulfilment", True, (1, 1, 1, 1)), investigate.verdict("data_feed", "measurement")]
    assert [c["agent"] for c in sizing.discriminating_checks(vs)] == ["fulfilment", "demand"]
    out = investigate.next_step(None, {"verdicts": vs}, {"state": "INCONCLUSIVE"}, lambda *_: None)
    assert out["checks"] and investigate.next_step(None, {}, {"state": "ARTEFACT"}, lambda *_: None)["instrument"] == sizing.ADVICE["measurement"]
    assert investigate.next_step(None, {}, {"state": "CONFIRMED", "leading": "mix"}, lambda *_: None)["instrument"] == sizing.ADVICE["mix"]


def test_options_and_unknown_choices(spark, small):
    o = P.options(P.order_panel(spark, small, topics=False))
    assert o["regions"][0]["orders"] >= o["regions"][-1]["orders"] and "review_score" in o["metrics"] and o["first"] < o["last"]
    with pytest.raises(ValueError):
        investigate.investigate(rows(spark), "nothing")
    with pytest.raises(ValueError):
        investigate.investigate(rows(spark), "on_time", week_from="2018-02-05", week_to="2018-01-01")


def test_weeks_of_the_panel_are_a_parameter(spark, tmp_path):
    import datetime as dt

    at = dt.datetime(2019, 5, 1)
    orders = [("o1", "c", "delivered", at, at, at, at, at, at)]
    names = "order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp, order_approved_at timestamp, order_delivered_carrier_date timestamp, order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp, loaded_at timestamp"
    spark.createDataFrame(orders, names).write.parquet(f"{tmp_path}/olist_orders_dataset.parquet")
    for t, s in (("customers", "customer_id string, customer_state string, customer_city string, loaded_at timestamp"), ("order_items", "order_id string, order_item_id int, price double, freight_value double"), ("order_reviews", "review_id string, order_id string, review_score double, review_comment_message string, review_creation_date timestamp")):
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/olist_{t}_dataset.parquet")
    assert P.order_panel(spark, str(tmp_path)).count() == 0
    assert P.order_panel(spark, str(tmp_path), last=None).count() == 1 == P.order_panel(spark, str(tmp_path), first="2019-01-07", last="2019-06-03").count()


def test_the_newest_uploads_are_kept(spark, tmp_path):
    u = Uploads(spark, f"file://{tmp_path}", keep=2)
    keys = [u.put(f"a,b\n{i},x\n".encode()) for i in range(3)]
    assert u.get(keys[2]).first().a == "2" and u.get(keys[1]).first().a == "1"
    with pytest.raises(KeyError):
        u.get(keys[0])
    assert len(list(tmp_path.iterdir())) == 2


def test_a_panel_is_kept_by_folder(spark, small):
    a = P.kept_panel(spark, small)
    assert P.kept_panel(spark, small) is a and a.is_cached
    b = P.kept_panel(spark, small, force=True)
    assert b is not a and not a.is_cached
    b.unpersist()
    P._kept.clear()
