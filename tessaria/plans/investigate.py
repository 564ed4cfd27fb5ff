"""An investigation: integrity gate, triage, localisation, competing explanations, challenges, decision.

Row-level work is lazy and runs as a few aggregates over one role-tagged panel that is kept only while explanations are
tested; the driver sees one row per week, segment value or term. A run that ends at the gate or as noise never starts
the later jobs.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaria.functions import one_series, series, tests
from tessaria.functions.text import TOPICS
from tessaria.operators import ingest, integrity, localize
from tessaria.operators import panel as P
from tessaria.plans import sizing
from tessaria.plans.catalog import EXPLANATIONS, KPIS
from tessaria.plans.parallel import at_once

MARGIN, NEUTRAL = 0.15, 0.5
GENERIC_LEAST, GENERIC_LIMITS = 30, (0.35, 0.15, 0.10, 0.35)
#: What a check of the order feed must move by, and the fields whose nulls it watches.
FEED_MATERIAL = 0.05
FEED_FIELDS = ("order_delivered_customer_date", "order_delivered_carrier_date", "order_estimated_delivery_date", "order_value")


@dataclass
class Context:
    panel: DataFrame
    weekly: DataFrame
    metric: str
    segments: list[str]
    population: object = None
    text: str | None = None
    triage: dict = field(default_factory=dict)
    top_segments: list[str] = field(default_factory=list)

    def moments(self, segment: str, *metrics: str) -> DataFrame:
        return localize.segment_moments(self.panel, segment, metrics or [self.metric], self.population)


def clip(x: float | None) -> float:
    return max(0.0, min(1.0, x or 0.0))


def strength(r: dict) -> float:
    se = ((r["ci_high"] or 0.0) - (r["ci_low"] or 0.0)) / 3.92
    return min(1.0, abs(r["estimate"]) / se / 4) if se > 0 else 0.0


def sure(r: dict) -> bool:
    return r["ci_low"] > 0 or r["ci_high"] < 0


def verdict(agent: str, family: str, supported: bool = False, parts: Sequence[float] = (0, 0, 0, 0), **evidence) -> dict:
    """What an explanation came to: its claim, what would disprove it, its score, and its evidence, each item with its source."""
    names = ("statistical", "temporal", "specificity", "discrimination")
    claim, falsified_by, source = EXPLANATIONS[agent]
    items = [{"name": k, "value": v, "source": source} for k, v in evidence.items()]
    return {
        "agent": agent, "family": family, "hypothesis": claim, "falsified_by": falsified_by, "supported": bool(supported), "score": tests.composite_score(*parts),
        "components": dict(zip(names, map(clip, parts))), "evidence": evidence, "items": items,
    }


def local(df: DataFrame) -> DataFrame:
    """A table of one row per week as a local one of one partition: windows over it need no exchange."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema).coalesce(1)


def triage(panel: DataFrame, weekly: DataFrame, metric: str, population=None) -> dict:
    """NO_BASELINE, NOISE or SIGNAL with windows, direction, sizes and the test on rows (or weekly values)."""
    rows = weekly.select(F.col("week").cast("string").alias("week"), F.nanvl(F.col(f"`{metric}`").cast("double"), F.lit(None).cast("double")).alias("value")).orderBy("week").collect()  # one per week
    weeks, values = [r["week"] for r in rows], [r["value"] for r in rows]
    known = [v for v in values if v is not None]
    nothing = {"event_weeks": [], "baseline_weeks": []}
    if len(known) < series.MIN_HISTORY:
        return {"verdict": "NO_BASELINE", "rule": f"only {len(known)} periods", "event_value": known[-1] if known else None, "baseline_value": sum(known) / len(known) if known else None, "delta": 0.0} | nothing
    band = one_series.band(values)
    z = band.z(values)
    core = one_series.core(z)
    if core is None:
        i = max(range(len(z)), key=lambda i: (abs(z[i]), -i))
        return {"verdict": "NOISE", "rule": "none", "event_value": values[i], "baseline_value": band.center, "delta": (values[i] or 0.0) - band.center, "robust_z": z[i], "limits": band.limits} | nothing
    roles = one_series.roles(z, core)
    pick = lambda xs, role: [x for x, r in zip(xs, roles) if r == role and x is not None]
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    event, base = pick(values, "event"), pick(values, "baseline")
    event_weeks, baseline_weeks = pick(weeks, "event"), pick(weeks, "baseline")
    if metric in panel.columns:
        said = F.col("week").cast("string")
        tagged = panel.where(population) if population is not None else panel
        test = tests.welch(*tests.sides(tagged.agg(*tests.moments(F.col(f"`{metric}`"), said.isin(event_weeks), "e"), *tests.moments(F.col(f"`{metric}`"), said.isin(baseline_weeks), "b")).first()))
    else:
        test = tests.welch(tests.moments_of(event), tests.moments_of(base))
    cross = one_series.first_crossing(values, z)
    ev, bs = mean(event), mean(base)
    return {
        "verdict": "SIGNAL", "rule": core.rule, "direction": core.direction, "run_length": core.end - core.start + 1, "event_weeks": event_weeks, "baseline_weeks": baseline_weeks,
        "event_value": ev, "baseline_value": bs, "delta": (ev or 0.0) - (bs or 0.0), "robust_z": (min if core.direction == "down" else max)(pick(z, "event")), "limits": band.limits, "first_crossing": weeks[cross] if cross is not None else None,
        "p_value": test["p_value"], "ci_low": test["ci_low"], "ci_high": test["ci_high"], "series": [{"week": w, "value": v, "z": x, "in_event": r == "event"} for w, v, x, r in zip(weeks, values, z, roles)],
    }


# --- explanations of the order panel ---


def fulfilment(c: Context) -> dict:
    """On-time share fell: test, legs of the delivery time, gradient over segments, order in time."""
    done = c.panel.where(F.col("delivered") & F.col("role").isNotNull())
    e, b = F.col("role") == "event", F.col("role") == "baseline"
    x = F.col("on_time")
    agg = [F.coalesce(F.sum(F.when(e, x)), F.lit(0.0)).alias("x_e"), F.count(F.when(e, x)).alias("n_e"), F.coalesce(F.sum(F.when(b, x)), F.lit(0.0)).alias("x_b"), F.count(F.when(b, x)).alias("n_b")]
    for m in ("delivery_days", "days_to_carrier"):
        agg.append((F.avg(F.when(e, F.col(m))) - F.avg(F.when(b, F.col(m)))).alias(m))
    r = tests.with_two_proportion(done.agg(*agg), "x_e", "n_e", "x_b", "n_b").drop("p_value").first().asDict()
    total, handling = r["delivery_days"] or 0.0, r["days_to_carrier"] or 0.0
    transit = (total - handling) / total if total else 0.0
    dose = localize.dose_response(localize.segment_moments(c.panel, c.segments[0], ["on_time", "review_score"], F.col("delivered")), "on_time", "review_score").drop("p_value").first().asDict()
    w = c.weekly.orderBy("week").select("on_time", "review_score").collect()  # one row a week
    lag = one_series.best_lag([x["on_time"] for x in w], [x["review_score"] for x in w])
    temporal = 0.2 if lag is None or lag < 0 else 0.65 if lag == 0 else 1.0
    return verdict("fulfilment", "fulfilment", sure(r) and r["estimate"] < 0, (strength(r), temporal, abs(dose["r"]), abs(transit)), on_time=r, transit_share=transit, dose_response=dose, best_lag=lag)


def customer_voice(c: Context) -> dict:
    """Complaints of late delivery rose more than other complaints, and in the segments that moved."""
    t = {r["topic"]: r.asDict() for r in localize.topic_lift(c.panel, list(TOPICS)).drop("p_value").collect()}
    focal = t.get("delivery_delay")
    if not focal:
        return verdict("customer_voice", "fulfilment")
    rival = max((v["lift"] for k, v in t.items() if k not in ("delivery_delay", "positive")), default=1.0)
    a = localize.text_alignment(c.panel, c.segments[0], "topic_delivery_delay", c.top_segments).first()
    spec = clip((a["flagged_lift"] - a["other_lift"]) / max(a["flagged_lift"], 1e-9)) if a["n"] >= 4 and a["flagged_lift"] is not None and a["other_lift"] is not None else 0.0
    return verdict("customer_voice", "fulfilment", sure(focal) and focal["estimate"] > 0, (strength(focal), 0.65, spec, clip((focal["lift"] - rival) / max(focal["lift"], 1e-9))), topics=t)


def demand(c: Context) -> dict:
    """More orders than in the eight weeks before."""
    rows = c.weekly.orderBy("week").select(F.col("week").cast("string").alias("week"), "orders").collect()
    ev = set(c.triage["event_weeks"])
    first = min(ev)
    e, b = [float(r["orders"]) for r in rows if r["week"] in ev], [float(r["orders"]) for r in rows if r["week"] < first][-8:]
    r = tests.welch(tests.moments_of(e), tests.moments_of(b))
    spike = sure(r) and r["estimate"] > 0
    return verdict("demand", "external", spike, (strength(r) if spike else 0.0, NEUTRAL, 0.5 * spike, 0.4 * spike), orders=r)


def feed_verdict(checks: Sequence[tuple[str, bool, float]], material: float) -> dict:
    """A measurement artefact where two checks agree; checks: (name, flagged, magnitude)."""
    worst = clip(max(m for _, _, m in checks) / material)
    return verdict("data_feed", "measurement", sum(f for _, f, _ in checks) >= 2, (worst, NEUTRAL, worst, worst), checks=[{"name": n, "flagged": f, "magnitude": m} for n, f, m in checks])


def order_feed(c: Context) -> dict:
    """Review coverage, text rate and nulls of delivered orders, and the delivered share: each significant and material."""
    rows = c.panel.where(F.col("role").isNotNull())
    done = F.col("delivered")
    shares = {"review_coverage": (done, F.col("review_score").isNotNull()), "text_rate": (done, F.col("has_text")), "status_mix": (F.lit(True), F.col("order_status") == "delivered"), **{f: (done, F.col(f).isNull()) for f in FEED_FIELDS}}
    sides = {"e": F.col("role") == "event", "b": F.col("role") == "baseline"}
    m = rows.agg(*[F.count(F.when(w & base & hit if k == "x" else w & base, 1)).alias(f"{n}_{k}_{s}") for n, (base, hit) in shares.items() for s, w in sides.items() for k in "xn"])
    for n in shares:
        m = m.withColumns({f"{n}_{k}": x for k, x in tests.two_proportion(*[F.col(f"{n}_{k}_{s}") for s in "eb" for k in "xn"]).items()})
    r = m.first().asDict()
    one = {n: (sure({k: r[f"{n}_{k}"] for k in ("ci_low", "ci_high")}) and abs(r[f"{n}_estimate"]) > FEED_MATERIAL, abs(r[f"{n}_estimate"])) for n in shares}
    fields = [one.pop(f) for f in FEED_FIELDS]
    one["missing_fields"] = (any(f for f, _ in fields), max(x for _, x in fields))
    return feed_verdict([(n, *v) for n, v in one.items()], FEED_MATERIAL)


def table_feed(c: Context, segments: Sequence[str], values: Sequence[str]) -> dict:
    """Rows per week, the worst null shift and the worst change of categories of the event's weeks against the baseline's."""
    said = {x: F.col(f"`{x}`").cast("string") for x in dict.fromkeys([*segments, *values])}
    known = [F.when((F.trim(v) != "") & (F.lower(v) != "nan"), v).alias(x) for x, v in said.items()]
    parts = c.panel.where(F.col("role").isNotNull()).select("week", F.when(F.col("role") == "event", "recent").otherwise("prior").alias("part"), *known)
    rows = integrity.row_shift(parts)
    nulls = max((r["shift"] or 0.0 for r in integrity.null_rates(parts, list(values)).collect()), default=0.0) if values else 0.0
    drift = max((r["drift"] for r in integrity.category_drift(parts, list(segments)).collect()), default=0.0) if segments else 0.0
    return feed_verdict([("row_volume", sure(rows) and rows["shift"] > GENERIC_LIMITS[0], rows["shift"]), ("missing_values", nulls > GENERIC_LIMITS[2], nulls), ("category_drift", drift > GENERIC_LIMITS[3], drift)], GENERIC_LIMITS[3])


# --- explanations of any table ---


def _scans(c: Context) -> list[tuple[str, DataFrame]]:
    """Per segment column its values' changes: of the metric in rows, or of weekly row counts where rows do not carry it."""
    out = []
    for s in c.segments:
        out.append((s, localize.segment_scan(c.moments(s), c.metric, GENERIC_LEAST) if c.metric in c.panel.columns else localize.count_scan(c.panel, s, GENERIC_LEAST)))
    return out


def concentrated(c: Context) -> dict:
    """One segment value changed on its own."""
    best = None
    for name, scan in _scans(c):
        rows = [r.asDict() for r in scan.collect()]
        if len(rows) < 2 or not any(r["rejected"] for r in rows):
            continue
        k = localize.concentration(scan).first().asDict()
        if best is None or (k["concentration"] or 0) > (best[1]["concentration"] or 0):
            best = (name, k, max(rows, key=lambda r: abs(r["delta"])), len(rows))
    if best is None:
        return verdict("concentrated", "segment")
    name, k, top, n = best
    return verdict("concentrated", "segment", True, (strength(top | {"estimate": top["delta"]}), NEUTRAL, k["concentration"], k["separation"]), column=name, value=top["segment"], delta=top["delta"], n_values=n, **k)


def mix(c: Context) -> dict:
    """The shares of segments moved, not their values."""
    found = [(s, localize.mix_vs_rate(c.moments(s), c.metric).first().asDict()) for s in c.segments] if c.metric in c.panel.columns else []
    found = [(s, d) for s, d in found if d["total"] is not None and d["mix"] is not None]
    if not found:
        return verdict("mix", "mix")
    s, d = max(found, key=lambda x: x[1]["mix_share"])
    return verdict("mix", "mix", d["mix_share"] > 0.5, (abs(d["mix"]) / (abs(d["total"]) + 1e-9), NEUTRAL, d["mix_share"], d["mix_share"] - d["rate_share"]), column=s, **d)


def systemic(c: Context) -> dict:
    """All values of the first segment moved alike."""
    if not c.segments:
        return verdict("systemic", "systemic")
    u = localize.uniformity(_scans(replace(c, segments=c.segments[:1]))[0][1]).first().asDict()
    if u.pop("n_values") < 3:
        return verdict("systemic", "systemic")
    return verdict("systemic", "systemic", u["supported"], (u["uniformity"], NEUTRAL, u["uniformity"], u["same_direction"]), column=c.segments[0], even=u["uniformity"], same_direction=u["same_direction"])


def wording(c: Context) -> dict:
    """Terms that rose in the texts of the event."""
    if not c.text:
        return verdict("wording", "segment")
    rows = [r.asDict() for r in localize.term_lift(c.panel, c.text).orderBy((F.col("rate_b") - F.col("rate_e")), "term").collect()]  # candidates hold at least 1 % of the texts
    sig = [r for r in rows if r["rejected"]]
    if not sig:
        return verdict("wording", "segment", n_terms=len(rows))
    lifts = sorted(r["lift"] for r in rows)
    mid = (lifts[len(lifts) // 2] + lifts[(len(lifts) - 1) // 2]) / 2
    top = sig[0]
    return verdict("wording", "segment", True, (strength(top), NEUTRAL, 1 - len(sig) / len(rows), (top["lift"] - mid) / max(top["lift"], 1e-9)), terms=[{k: r[k] for k in ("term", "lift", "rate_e", "rate_b", "p_adjusted")} for r in sig[:6]])


# --- challenges and decision ---


def inside_segments(moments: DataFrame, outcome: str, least: int, n_least: int, passes: Callable[[float], bool]) -> dict:
    """Does the movement hold inside segments?"""
    s = localize.simpson_fraction(localize.segment_scan(moments, outcome, least)).first().asDict()
    return {"name": "inside_segments", "passed": bool(s["n_segments"] >= n_least and passes(s["share_down"])), **s}


def against_unexposed(c: Context, rows: DataFrame, moments: DataFrame, segment: str, outcome: str, exposure: str, least: int, divisor: int, k_least: int, n_least: int, passes: Callable[[dict], bool]) -> dict:
    """Does it hold against the segments that were not exposed, and did both groups move alike in the last 12 weeks before?"""
    out = {"name": "against_unexposed", "passed": False}
    if localize.exposed(moments, exposure, least).count() < n_least:
        return out | {"reason": "too few segments"}
    groups = localize.did_groups(moments, exposure, least, divisor, k_least).persist()
    try:
        cells = {(r["grp"], "post" if r["role"] == "event" else "pre"): (r["n"], r["mean"], r["var"]) for r in localize.did_cells(rows, groups, segment, outcome).collect()}
        if len(cells) < 4 or not all(v[0] for v in cells.values()):
            return out | {"reason": "a group has no values"}
        last = sorted(c.triage["baseline_weeks"])[-12:]
        gaps = localize.weekly_gaps(rows.where(F.col("week").cast("string").isin(last)), groups, segment, outcome).where("t IS NOT NULL AND c IS NOT NULL").orderBy("week").collect()
    finally:
        groups.unpersist()
    pre = [r["t"] - r["c"] for r in gaps]
    d = tests.difference_in_differences(cells, pre)
    slope = float(np.polyfit(range(len(pre)), pre, 1)[0]) if len(pre) >= 2 else None
    return out | {"passed": bool(passes(d)), **d, "pre_slope": slope, "pre_weeks": len(pre)}


def order_level(rows: DataFrame) -> dict:
    """Do late orders of the event score lower than those on time?"""
    w = rows.where(F.col("role") == "event").agg(*tests.moments(F.col("review_score"), F.col("on_time") == 0, "e"), *tests.moments(F.col("review_score"), F.col("on_time") == 1, "b"))
    r = tests.welch(*tests.sides(w.first()))
    return {"name": "order_level", "passed": bool(sure(r) and r["estimate"] < 0), **r}


def outcome_of(out: list[dict]) -> dict:
    return {"challenges": out, "n_passed": sum(x["passed"] for x in out), "n_total": len(out), "survived": all(x["passed"] for x in out)}


def challenge_orders(c: Context) -> dict:
    """Of delivered orders: three quarters of the states fall, the less punctual states fall more (six states at least),
    and late orders score lower."""
    rows, least = c.panel.where("delivered"), localize.MIN_SEGMENT_N
    m = localize.segment_moments(rows, "customer_state", ["review_score", "on_time"]).persist()
    try:
        return outcome_of(at_once(
            lambda: inside_segments(m, "review_score", least, 1, lambda share: share >= 0.75),
            lambda: against_unexposed(c, rows, m, "customer_state", "review_score", "on_time", least, 4, 3, 6, lambda d: d["estimate"] < 0 and d["ci_high"] < 0),
            lambda: order_level(rows),
        ))
    finally:
        m.unpersist()


def challenge_table(c: Context) -> dict:
    """Of any table: segments agree in direction, and the most moved differ from the least moved (four values at least)."""
    m = c.moments(c.segments[0]).persist()
    try:
        return outcome_of([
            inside_segments(m, c.metric, GENERIC_LEAST, 3, lambda share: share >= 0.6 or share <= 0.4),
            against_unexposed(c, c.panel, m, c.segments[0], c.metric, c.metric, GENERIC_LEAST, 3, 1, 4, sure),
        ])
    finally:
        m.unpersist()


def decide(gate: dict, tri: dict, verdicts: Sequence[dict] = ()) -> dict:
    """The state: NO_BASELINE, ARTEFACT, NOISE, INCONCLUSIVE or CONFIRMED with the leading family.

    Explanations of one family are witnesses to one cause: a family scores as its strongest member, and leads if it is
    MARGIN ahead of the next.
    """
    if tri["verdict"] == "NO_BASELINE":
        return {"state": "NO_BASELINE", "families": []}
    if gate["is_artefact"]:
        return {"state": "ARTEFACT", "families": [], "by": "gate"}
    if tri["verdict"] == "NOISE":
        return {"state": "NOISE", "families": []}
    if any(v["supported"] and v["family"] == "measurement" for v in verdicts):
        return {"state": "ARTEFACT", "families": [], "by": "explanation"}
    families: dict[str, list[dict]] = {}
    for v in verdicts:
        if v["supported"]:
            families.setdefault(v["family"], []).append(v)
    ranked = sorted(({"family": f, "score": max(v["score"] for v in vs), "members": [v["agent"] for v in sorted(vs, key=lambda v: -v["score"])]} for f, vs in families.items()), key=lambda x: (-x["score"], x["family"]))
    gap = 0.0 if not ranked else 1.0 if len(ranked) == 1 else ranked[0]["score"] - ranked[1]["score"]
    return {"state": "CONFIRMED" if ranked and gap >= MARGIN else "INCONCLUSIVE", "families": ranked, "gap": gap, "leading": ranked[0]["family"] if ranked else None}


def next_step(c: Context, out: dict, decision: dict, size: Callable[[Context, dict], dict]) -> dict | None:
    """The size of a test of a confirmed cause, advice where no test can settle it, or what would tell explanations apart."""
    if decision["state"] == "INCONCLUSIVE":
        return {"instrument": "tell the explanations apart", "checks": sizing.discriminating_checks(out["verdicts"])}
    if decision["state"] == "ARTEFACT" or decision.get("leading") in sizing.ADVICE:
        return {"instrument": sizing.ADVICE[decision.get("leading") or "measurement"]}
    return size(c, out) if decision["state"] == "CONFIRMED" else None


def _run(c: Context, gate: dict, explain: Callable[[Context], list[dict]], challenge: Callable[[Context], dict], size: Callable[[Context, dict], dict], log: Callable[[str], None]) -> dict:
    began = time.time()
    marks: dict[str, float] = {}

    def mark(step: str) -> None:
        marks[step] = round((time.time() - began) * 1000, 1)
        log(step)

    tri = triage(c.panel, c.weekly, c.metric, c.population) if not gate["is_artefact"] else {"verdict": "SIGNAL", "event_weeks": [], "baseline_weeks": []}
    mark("triage")
    out = {"metric": c.metric, "integrity": gate, "triage": tri, "verdicts": [], "localisation": None, "adversary": None}
    if gate["is_artefact"] or tri["verdict"] != "SIGNAL":
        return out | {"decision": decide(gate, tri), "telemetry_ms": marks}
    spark = c.panel.sparkSession
    windows = spark.createDataFrame([(w, "event") for w in tri["event_weeks"]] + [(w, "baseline") for w in tri["baseline_weeks"]], "w string, role string").select(F.col("w").cast("date").alias("week"), "role")
    c.panel, c.triage = P.with_role(c.panel, windows).where(F.col("role").isNotNull()).persist(), tri
    try:
        if c.metric in c.panel.columns and c.segments:
            m = c.moments(c.segments[0]).persist()
            scan, parts = at_once(lambda: [r.asDict() for r in localize.segment_scan(m, c.metric).orderBy("delta", "segment").collect()], lambda: localize.mix_vs_rate(m, c.metric).first().asDict())
            m.unpersist()
            out["localisation"] = {"decomposition": parts, "segments": scan}
            c.top_segments = [r["segment"] for r in scan if r["rejected"]][:8]
        mark("localise")
        out["verdicts"] = sorted(explain(c), key=lambda v: -v["score"])
        mark("explain")
        if any(v["supported"] and v["family"] != "measurement" for v in out["verdicts"]):
            out["adversary"] = challenge(c)
        mark("challenge")
        decision = decide(gate, tri, out["verdicts"])
        out["next"] = next_step(c, out, decision, size)
        mark("decide")
    finally:
        c.panel.unpersist()
    return out | {"decision": decision, "telemetry_ms": marks}


def investigate(panel: DataFrame, metric: str = "review_score", states: Sequence[str] = (), week_from: str | None = None, week_to: str | None = None, log: Callable[[str], None] = lambda s: None) -> dict:
    """An investigation of a KPI of the order panel, sliced by states and weeks. `cancellation_rate` is over all orders.

    An unknown metric or an empty span of weeks is an error; a state without orders gives NO_BASELINE.
    """
    if metric not in {k[0] for k in KPIS}:
        raise ValueError(f"unknown metric {metric}")
    if week_from and week_to and week_from > week_to:
        raise ValueError("the first week lies behind the last")
    if states:
        panel = panel.where(F.col("customer_state").isin(*states))
    if week_from:
        panel = panel.where(F.col("week") >= F.lit(week_from).cast("date"))
    if week_to:
        panel = panel.where(F.col("week") <= F.lit(week_to).cast("date"))
    weekly = local(P.weekly(panel))
    population = None if metric == "cancellation_rate" else F.col("delivered")
    c = Context(panel, weekly, metric, ["customer_state"], population)
    gate = integrity.gate(panel, metric if metric in panel.columns else None, ["customer_state", "order_status"], ["order_value", "review_score", "order_delivered_customer_date"])
    log("integrity")

    def explain(c: Context) -> list[dict]:
        return at_once(lambda: fulfilment(c), lambda: customer_voice(c), lambda: demand(c), lambda: order_feed(c))

    def size(c: Context, out: dict) -> dict:
        recent = [float(r["orders"]) for r in c.weekly.orderBy(F.col("week").desc()).limit(8).collect()]
        return sizing.recovery_test(c.panel, recent, "customer_state", c.top_segments[:6], bool(out["adversary"] and out["adversary"]["survived"]))

    return _run(c, gate, explain, challenge_orders, size, log)


def investigate_table(df: DataFrame, metric: str | None = None, log: Callable[[str], None] = lambda s: None) -> dict:
    """The same for any table: roles are inferred, the first metric is taken where none (or an unknown one) is named."""
    p = ingest.profile(df)
    keys = [m["key"] for m in p.metrics]
    metric = metric if metric in keys else keys[0]
    panel = ingest.generic_panel(df, p)
    weekly = local(ingest.generic_weekly(panel, p))
    gate = integrity.gate(panel, metric if metric in panel.columns else None, p.segments, [c for c in p.measures if c in panel.columns])
    log("integrity")
    c = Context(panel, weekly, metric, p.segments, None, "_text" if p.text else None)

    def explain(c: Context) -> list[dict]:
        return at_once(lambda: concentrated(c), lambda: mix(c), lambda: systemic(c), lambda: wording(c), lambda: table_feed(c, p.segments, [*p.measures, *([p.text] if p.text else [])]))

    def challenge(c: Context) -> dict:
        return challenge_table(c) if c.segments and metric in c.panel.columns else {"challenges": [], "survived": False}

    def size(c: Context, out: dict) -> dict:
        if metric not in c.panel.columns or not c.segments:
            return {"instrument": sizing.instrument(False)}
        return sizing.movement_test(c.panel, metric, out["triage"]["delta"], c.segments[0], c.top_segments[:4], bool(out["adversary"] and out["adversary"]["survived"]))

    return {"profile": {"rows": p.rows, "undated": p.undated, "roles": {x.name: x.role for x in p.columns}, "metrics": keys}} | _run(c, gate, explain, challenge, size, log)
