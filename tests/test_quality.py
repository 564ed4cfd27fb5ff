import pytest

from tessaria.operators import quality

SCHEMA = "feed_id int, load_no int, order_id string, order_date string, region string, category string, amount double, quantity int, customer_feedback string, value string, n int"
NAN = float("nan")


def rows(feed, load, n=20, region="A", amount=None, date="2024-01-01"):
    return [(feed, load, f"o-1{i % 10}", date, region if isinstance(region, str) or region is None else region(i), "c", float(i) if amount is None else amount(i), 1, "fine words", "clash", 9) for i in range(n)]


def base(feed):
    return [r for load in (1, 2, 3) for r in rows(feed, load)]


# per case: the later load of a feed of its own, and what must be found there
CASES = {
    "clean": (rows(1, 4), set()),
    "missing": (rows(2, 4, region=lambda i: "A" if i < 16 else ["", "  ", "N/A", None][i % 4]), {("region", "missing")}),
    "pattern": (rows(3, 4, date="01/01/2024"), {("order_date", "pattern")}),
    "value_set": (rows(4, 4, region=lambda i: "B" if i == 0 else "A"), {("region", "value_set")}),
    "nan": (rows(5, 4, amount=lambda i: NAN if i < 10 else float(i - 10)), {("amount", "missing"), ("amount", "distribution")}),
    "range": (rows(6, 4, amount=lambda i: 1e6 if i < 2 else float(i)), {("amount", "range")}),
    "distribution": (rows(7, 4, region=lambda i: "ABCDEF"[i % 6]), {("region", "value_set"), ("region", "distribution")}),
    "all_missing": (rows(8, 4, region=None), {("region", "missing"), ("region", "value_set")}),
    "recorded": (rows(9, 4), {("region", "role"), ("region", "n_unique"), ("region", "null_rate")}),
    "repeated_rows": (rows(10, 4) * 2, set()),
}
RECORDED = [
    (9, 1, "region", "segment", "o", 1, 0.0), (9, 4, "region", "measure", "o", 2, 0.5), (9, 4, "region", "measure", "o", 2, 0.5), (9, 4, "amount", None, "o", None, None), (9, 4, None, "x", "o", 1, 0.0), (11, 9, "region", "x", "o", 1, 0.0),
]


@pytest.fixture(scope="module")
def found(spark):
    data = [r for k, (later, _) in CASES.items() for r in base(later[0][0]) + later] + rows(12, 4)  # feed 12 has no base
    rec = spark.createDataFrame(RECORDED, "feed_id int, load_no int, name string, role string, dtype string, n_unique long, null_rate double")
    return quality.issues(spark.createDataFrame(data, SCHEMA), rec).collect()


@pytest.mark.parametrize("case", CASES)
def test_issues(found, case):
    later, want = CASES[case]
    assert {(r.column_name, r.issue) for r in found if r.feed_id == later[0][0]} == want


def test_no_base_and_no_repeats(found):
    assert not [r for r in found if r.feed_id in (11, 12)] and len(found) == len(set(found))


def test_empty_table(spark):
    assert quality.issues(spark.createDataFrame([], SCHEMA)).count() == 0


def test_states_of_parts_merge_to_the_state_of_all(spark):
    a, b = spark.createDataFrame(base(1), SCHEMA), spark.createDataFrame(rows(1, 4), SCHEMA)
    parts = quality.merge_states(quality.value_state(a), quality.value_state(b))
    whole = quality.value_state(a.unionByName(b))
    assert sorted(map(repr, parts.collect())) == sorted(map(repr, whole.select(parts.columns).collect()))


def test_numeric_distance_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    old, new = rng.normal(0, 1, 900).round(1), rng.normal(0.4, 1.5, 300).round(1)
    data = [(1, 1, "o", "d", "r", "c", float(x), 1, "f", "v", 1) for x in old] + [(1, 4, "o", "d", "r", "c", float(x), 1, "f", "v", 1) for x in new]
    s = quality._flagged(quality.value_state(spark.createDataFrame(data, SCHEMA)), quality.UPLOAD)
    got = quality.numeric_distance(s, ["amount"]).first()["distance"]
    at = np.unique(np.concatenate([old, new]))
    want = max(abs((old <= x).mean() - (new <= x).mean()) for x in at)
    assert abs(got - want) < 1e-12


def test_control_limits(spark):
    df = spark.createDataFrame([(1, i, "c", float(v)) for i, v in enumerate([10, 11, 9, 10, 50, 10], 1)], "feed_id int, load_no int, column_name string, m double")
    out = {r.load_no: r.out_of_control for r in quality.control_limits(df, ["m"]).collect()}
    assert out == {1: False, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_declared_control_limits_are_issues(spark):
    from dataclasses import replace

    data = [r for load in range(1, 6) for r in rows(1, load)] + rows(1, 6, n=60)
    checks = replace(quality.UPLOAD, declared=(), control=("n_rows", "max_number"))
    found = quality.issues(spark.createDataFrame(data, SCHEMA), checks=checks).collect()
    assert {(r.load_no, r.issue) for r in found} == {(6, "control_n_rows"), (6, "control_max_number")}
    assert {r.column_name for r in found if r.issue == "control_n_rows"} == set(checks.columns)


def test_the_state_holds_no_text(spark):
    s = quality.value_state(spark.createDataFrame(base(1), SCHEMA))
    assert [c for c, t in s.dtypes if t == "string"] == ["column_name"]
