"""What to do next, as far as figures say it: the size of a test that would settle a confirmed cause, or the checks that
would tell explanations apart which are not separable yet."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaria.functions.tests import POWER, required_sample_size, required_sample_size_continuous
from tessaria.plans.catalog import EXPLANATIONS

#: Least recovery of a share worth a test, change of a score that a second reading looks for.
LEAST_RECOVERY, SCORE_CHANGE, ALPHA = 0.02, 0.15, 0.05


def weeks_for(n_per_arm: int, per_week: float) -> int:
    """Weeks until both arms are full."""
    return math.ceil(2 * n_per_arm / max(per_week, 1.0)) if n_per_arm else 0


def _design(instrument: str, segment: str, affected: Sequence[str], **figures) -> dict:
    return {"instrument": instrument, "unit": segment, "affected": list(affected), "alpha": ALPHA, "power": POWER, **figures}


def _share_of(affected: Sequence[str], segment: str) -> Column:
    return F.coalesce(F.avg(F.coalesce(F.col(segment).cast("string").isin(*affected), F.lit(False)).cast("double")), F.lit(0.0)) if affected else F.lit(0.0)


def instrument(survived: bool) -> str:
    """A cause that survived the challenges is tested by an intervention, another first by data at hand."""
    return "intervention in some segments" if survived else "difference in differences on data at hand"


def recovery_test(panel: DataFrame, recent_orders: Sequence[float], segment: str, affected: Sequence[str], survived: bool) -> dict:
    """A test of whether half the lost share delivered on time can be won back; panel: rows with a role."""
    done, e = panel.where("delivered"), F.col("role") == "event"
    r = done.agg(F.avg(F.when(e, F.col("on_time"))).alias("now"), F.avg(F.when(~e, F.col("on_time"))).alias("before"), F.stddev_samp(F.when(e, F.col("review_score"))).alias("sd"), _share_of(affected, segment).alias("share")).first()
    now, before = r["now"] or 0.0, r["before"] or 0.0
    mde = max((before - now) / 2, LEAST_RECOVERY)
    n = required_sample_size(now, mde, ALPHA)
    per_week = (sum(recent_orders) / len(recent_orders) if recent_orders else 0.0) * r["share"]
    return _design(instrument(survived), segment, affected, metric="on_time", baseline=now, mde=mde, n_per_arm=n, per_week=per_week, weeks=weeks_for(n, per_week), n_per_arm_score=required_sample_size_continuous(r["sd"] or 0.0, SCORE_CHANGE, ALPHA))


def movement_test(panel: DataFrame, metric: str, delta: float, segment: str, affected: Sequence[str], survived: bool) -> dict:
    """A test of whether half the movement of a row's metric can be undone; panel: rows with a role."""
    e = F.col("role") == "event"
    weeks = F.count_distinct(F.when(e, F.col("week")))
    r = panel.agg(F.avg(F.when(~e, F.col(metric))).alias("mean"), F.stddev_samp(F.when(~e, F.col(metric))).alias("sd"), F.try_divide(F.count(F.when(e, 1)), weeks).alias("per_week")).first()
    share = panel.where(e).agg(_share_of(affected, segment).alias("s")).first()["s"] if affected else 1.0
    sd = r["sd"] or 0.0
    mde = abs(delta) / 2 if delta else 0.2 * sd
    n = required_sample_size_continuous(sd, max(mde, 1e-9), ALPHA) if sd else 0
    per_week = (r["per_week"] or 0.0) * share
    return _design(instrument(survived), segment, affected, metric=metric, baseline=r["mean"], mde=mde, n_per_arm=n, per_week=per_week, weeks=weeks_for(n, per_week))


ADVICE = {"measurement": "mend the data before reading them", "mix": "report the metric per segment or at fixed shares", "systemic": "compare with sources outside this table"}


def discriminating_checks(verdicts: Sequence[dict]) -> list[dict]:
    """Per explanation that is still open, the strongest first: what would disprove it."""
    open_ = sorted((v for v in verdicts if v["family"] != "measurement"), key=lambda v: (not v["supported"], -v["score"]))
    return [{"agent": v["agent"], "family": v["family"], "check": EXPLANATIONS[v["agent"]][1]} for v in open_]
