"""Formats and change against the base, as figures and within control limits."""

import pytest

from tessaria import data_queries as q

SCHEMA = "feed_id int, load_no int, order_id string, order_date string, region string, category string, amount double, quantity int, customer_feedback string"


def load(no, n=20, odd=0, low=1.0, regions="AB"):
    """n rows, odd of them with a date in another format; the amounts run up from low."""
    return [(1, no, f"o-1{i % 10}", "01/01/2024" if i < odd else "2024-01-01", regions[i % len(regions)], "c", low + i, 1, None) for i in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("change"))
    rows = [r for no in range(1, 8) for r in load(no)] + load(8, odd=10, low=-50.0, regions="ABCD")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/upload_records.parquet")
    return d


def test_change(spark, folder):
    got = {(r.load_no, r.column_name): r for r in q.QUERIES["p2_change"](spark, folder).collect()}
    assert len(got) == 8 * 7
    assert (got[8, "order_date"].n_formats, got[8, "order_date"].pattern_share) == (2, 0.5)
    assert (got[4, "order_date"].n_formats, got[4, "order_date"].pattern_share) == (1, 0.0) and got[1, "order_date"].pattern_share is None
    assert got[8, "region"].value_set_change == 1.0 and got[8, "region"].distance == 0.5 and got[5, "region"].distance == 0.0
    assert got[8, "amount"].distance == 1.0 and got[8, "customer_feedback"].n_formats == 0


def test_limits(spark, folder):
    out = {(r.load_no, r.column_name, r.metric) for r in q.QUERIES["p2_change_limits"](spark, folder).collect() if r.out_of_control}
    assert out == {(8, "order_date", "n_formats"), (8, "order_date", "pattern_share"), (8, "region", "value_set_change"), (8, "region", "distance"), (8, "amount", "min_number"), (8, "amount", "distance"), (8, "amount", "n_formats")}  # negative amounts are of new formats
