"""Challenges of the order panel beside numbers worked out by hand."""

import datetime as dt

import pytest

from tessaria.plans import investigate as I

SCHEMA = "week date, role string, customer_state string, delivered boolean, on_time double, review_score double"


def context(spark, n_states=8, late_score=2.0, drift=0.0):
    """20 weeks of baseline, 5 of event, 16 orders a state and week; the first half of the states get late in the event."""
    rows, weeks = [], {"baseline": [], "event": []}
    for w in range(25):
        week, role = dt.date(2018, 1, 1) + dt.timedelta(7 * w), "event" if w >= 20 else "baseline"
        weeks[role].append(str(week))
        for s in range(n_states):
            hit = s < n_states // 2
            for i in range(16):
                late = i < (10 if hit and role == "event" else 2)
                rows.append((week, role, f"S{s}", True, float(not late), (late_score if late else 4.0) + 0.25 * (i % 2) + (drift * w if hit else 0.0)))
    c = I.Context(spark.createDataFrame(rows, SCHEMA), None, "review_score", ["customer_state"])
    c.triage = {"event_weeks": weeks["event"], "baseline_weeks": weeks["baseline"]}
    return c


def named(r):
    return {x["name"]: x for x in r["challenges"]}


def test_three_challenges_and_no_trend(spark):
    c = context(spark)
    r = named(I.challenge_orders(c))
    assert set(r) == {"inside_segments", "against_unexposed", "order_level"} and r["order_level"]["passed"]
    did = r["against_unexposed"]
    assert did["passed"] and did["pre_weeks"] == 12 and did["parallel_ok"] and did["pre_slope"] == pytest.approx(0.0, abs=1e-9)
    assert did["estimate"] == pytest.approx(-2.0 * 8 / 16)
    assert not r["inside_segments"]["passed"]  # half of the states fall


def test_a_trend_before_the_event_is_seen(spark):
    did = named(I.challenge_orders(context(spark, drift=-0.02)))["against_unexposed"]
    assert did["parallel_p"] < 0.10 and not did["parallel_ok"] and did["pre_slope"] == pytest.approx(-0.02)


def test_five_states_have_no_control_group(spark):
    did = named(I.challenge_orders(context(spark, n_states=5)))["against_unexposed"]
    assert not did["passed"] and did["reason"] == "too few segments"


def test_a_rise_and_equal_late_orders_do_not_pass(spark):
    r = I.challenge_orders(context(spark, late_score=5.0))
    assert not any(named(r)[k]["passed"] for k in ("against_unexposed", "order_level")) and not r["survived"]
