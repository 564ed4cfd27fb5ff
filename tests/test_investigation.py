import datetime as dt
import json
import random

import pytest

from tessaria.operators import ingest, integrity
from tessaria.plans import investigate as I
from tessaria.sources import csv_upload, sinks


def upload(weeks=60, seed=7, change=lambda w, region, cat, amount: amount, per_week=120, keep=lambda w, rng: True, name=lambda w, r: r):
    rng = random.Random(seed)
    rows = []
    for w in range(weeks):
        for i in range(per_week):
            if not keep(w, rng):
                continue
            day = dt.date(2024, 1, 1) + dt.timedelta(days=7 * w + i % 7)
            region, cat = rng.choice(["North", "South", "East", "West", "Centre"]), rng.choice(["Books", "Toys", "Garden"])
            amount = change(w, region, cat, rng.gammavariate(3, 15))
            rows.append((f"o{len(rows)}", str(day), name(w, region), cat, None if amount is None else round(amount, 2), rng.choice([1, 1, 2, 2, 3]), rng.choice(["arrived on time and works", "good quality for the price"]) if not (20 <= w < 29 and region == "North") else "the handle broke after two days"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "order_id string, order_date string, region string, category string, amount double, quantity int, customer_feedback string")


def test_roles(spark):
    p = ingest.profile(frame(spark, upload(20)))
    assert {c.name: c.role for c in p.columns} == {"order_id": "identifier", "order_date": "date", "region": "segment", "category": "segment", "amount": "measure", "quantity": "measure", "customer_feedback": "text"}
    assert (p.money, p.quantity, p.date.date_format) == ("amount", "quantity", "yyyy-MM-dd")
    assert [m["key"] for m in p.metrics][:2] == ["avg_value", "avg_quantity"]


def test_profile_edges(spark):
    with pytest.raises(ValueError):
        ingest.profile(frame(spark, []))
    with pytest.raises(ValueError):
        ingest.profile(spark.createDataFrame([("a", 1), ("b", 2)], "x string, y int"))
    mixed = spark.createDataFrame([("2024-01-01", 1.0), ("02/01/2024", 2.0), ("03 Jan 2024", float("nan")), (None, None)] * 10, "when string, v double")
    p = ingest.profile(mixed.where("when IS NOT NULL"))
    assert p.date.date_format == "mixed" and ingest.generic_panel(mixed, p).count() == 30  # no date is lost
    seconds = spark.createDataFrame([(1_700_000_000 + 86400 * i, i % 3) for i in range(30)], "t long, v int")
    assert ingest.profile(seconds).date.date_format == "seconds"


def test_noise_and_short_history(spark):
    assert I.investigate_table(frame(spark, upload()), "avg_value")["decision"]["state"] == "NOISE"
    assert I.investigate_table(frame(spark, upload(9)), "avg_value")["decision"]["state"] == "NO_BASELINE"


def test_localised_event(spark):
    r = I.investigate_table(frame(spark, upload(change=lambda w, region, cat, a: a * 0.3 if 20 <= w < 29 and region == "North" else a)), "avg_value")
    assert r["triage"]["verdict"] == "SIGNAL" and r["triage"]["direction"] == "down"
    lead = next(v for v in r["verdicts"] if v["agent"] == "concentrated")
    assert lead["supported"] and lead["evidence"]["value"] in ("North", "the handle broke after two days")
    json.dumps(sinks.jsonable(r), allow_nan=False)


def test_systemic_shift(spark):
    r = I.investigate_table(frame(spark, upload(change=lambda w, region, cat, a: a * 0.6 if 30 <= w < 40 else a)), "avg_value")
    v = next(v for v in r["verdicts"] if v["agent"] == "systemic")
    assert v["supported"] and r["triage"]["event_weeks"][0] == "2024-07-29"


def test_measurement_artefact(spark):
    rows = upload(change=lambda w, region, cat, a: None if w >= 50 and hash((w, round(a, 3))) % 5 < 2 else a, keep=lambda w, rng: w < 50 or rng.random() < 0.5, name=lambda w, r: "Western" if w >= 50 and r == "West" else r)
    r = I.investigate_table(frame(spark, rows), "avg_value")
    assert r["decision"] == {"state": "ARTEFACT", "families": [], "by": "gate"} and r["verdicts"] == [] and r["integrity"]["n_structural"] >= 1


def test_volume_alone_is_no_artefact(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(7 * w), float(i), "s") for w in range(30) for i in range(40 if w < 20 else 120)]
    g = integrity.gate(spark.createDataFrame(rows, "week date, value double, seg string"), "value", ["seg"], ["value"])
    assert g["assessed"] and not g["is_artefact"]


def test_decision_order():
    gate, ok = {"is_artefact": True}, {"is_artefact": False}
    v = lambda f, s: {"agent": f, "family": f, "supported": True, "score": s}
    assert I.decide(gate, {"verdict": "NO_BASELINE"})["state"] == "NO_BASELINE"
    assert I.decide(gate, {"verdict": "NOISE"})["state"] == "ARTEFACT"
    assert I.decide(ok, {"verdict": "NOISE"})["state"] == "NOISE"
    signal = {"verdict": "SIGNAL"}
    assert I.decide(ok, signal, [v("measurement", 0.1), v("x", 0.9)])["state"] == "ARTEFACT"
    assert I.decide(ok, signal)["state"] == "INCONCLUSIVE"
    assert I.decide(ok, signal, [v("x", 0.9), v("y", 0.8)])["state"] == "INCONCLUSIVE"
    assert I.decide(ok, signal, [v("x", 0.9), v("y", 0.5)])["leading"] == "x"


def test_csv_of_unknown_form(spark, tmp_path):
    text = "﻿id; when ;amount\nç1;2024-01-01;\"1,5\"\n2;2024-01-02;2\n"
    for raw in (text.encode("utf-8"), text.replace("﻿", "").encode("latin-1")):
        df = csv_upload.read_csv_bytes(spark, raw, str(tmp_path))
        assert df.columns == ["id", "when", "amount"] and [tuple(r) for r in df.collect()] == [("ç1", "2024-01-01", "1,5"), ("2", "2024-01-02", "2")]
    assert csv_upload.sniff(b"a|b\n1|2\n") == ("utf-8-sig", "|")
    with pytest.raises(ValueError):
        csv_upload.read_csv_bytes(spark, b"a,b\n", str(tmp_path))
    with pytest.raises(ValueError):
        csv_upload.read_csv_bytes(spark, b"a\n1\n", str(tmp_path))


def test_sinks(tmp_path):
    sinks.write_json({"a": float("nan"), "d": dt.date(2024, 1, 1)}, f"{tmp_path}/x/y.json")
    assert json.loads((tmp_path / "x/y.json").read_text()) == {"a": None, "d": "2024-01-01"}
    sinks.write_bundle({"k": {"v": 1}}, f"{tmp_path}/b.js")
    assert (tmp_path / "b.js").read_text() == 'window.INVESTIGATIONS = {"k": {"v": 1}};\n'


def test_stream_equals_batch(spark, small, tmp_path):
    from tessaria.streaming.weekly import weekly_stream

    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    q = weekly_stream(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), "ts", ["value"], late="60 days").writeStream.format("memory").queryName("weekly_t").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.week, r.rows) for r in spark.table("weekly_t").collect()}
    assert got == {(r.week, r.rows) for r in weekly_stream(events, "ts", ["value"]).collect()} and len(got) == 5
