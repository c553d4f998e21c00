"""Blocks, captures of which the last counts, whole files, first signers, controls, rates at anchors, deposits and equal
credits against plain loops, with nulls, ties and empty tables."""

import calendar
import json
import random
import statistics as st
from datetime import date, datetime, timezone

import pytest

from tapeweave.operators import cohorts
from tapeweave.sources import blocks, scans

CAPTURE = "mint string, pool string, swaps array<struct<ts: bigint, sol: double>>"


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_blocks(spark, tmp_path):
    key = lambda name, signer: {"pubkey": name, "signer": signer}
    good = {"err": None, "signatures": ["s1", "s2"], "keys": [key("prog", False), key("apump", True), key("bpump", False), key("cpump", True), key("dpum", True), key(None, True)]}
    lines = [
        {"slot": 10, "answer": {"transactions": [good, dict(good, err="x"), dict(good, keys=good["keys"][1:]), dict(good, signatures=[])]}},
        {"slot": 11, "answer": None},
        {"slot": 13, "answer": {"transactions": []}},
        {"slot": 14, "answer": {"transactions": None}},
        {"slot": 20, "answer": {"transactions": [good]}},
    ]
    (tmp_path / "x.json").write_text("\n".join(map(json.dumps, lines)) + '\n{"slot": 15, "answ')
    read = blocks.landed(spark, str(tmp_path))
    found = blocks.creations(read, "prog", "pump", 10, 8)
    assert sorted(rows(found), key=str) == sorted([("apump", 10, "s1"), ("cpump", 10, "s1"), ("apump", 10, None), ("cpump", 10, None)], key=str)
    assert rows(blocks.tally(read, found, 10, 8)) == [(8, 3, 5, 4, 2)]


def test_last_capture_wins(spark, tmp_path):
    swap = [{"ts": 1, "sol": 2.0}]
    for name, lines in (("a/1.json", [("m", swap), ("n", swap), ("o", swap)]), ("a/2.json", [("m", swap), ("n", [])]), ("b/1.json", [("o", None), ("p", swap), (None, swap), ("p", swap)])):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(json.dumps({"mint": m, "pool": f"{name}:{k}", "swaps": s}) + "\n" for k, (m, s) in enumerate(lines)) + '{"mint": "m", "sw\n')
    kept = scans.last_wins(spark, [("x", str(tmp_path / "a")), ("y", str(tmp_path / "b"))], CAPTURE, "mint").select("mint", "role", "pool")
    assert sorted(rows(kept)) == [("m", "x", "a/2.json:0"), ("n", "x", "a/1.json:1"), ("o", "x", "a/1.json:2"), ("p", "y", "b/1.json:3")]


def test_whole_files_and_populations(spark, tmp_path):
    yes = {"q_mc_regime_ok": True, "q_mc_plausible": True, "o_ath_true": True}
    doc = {"A": [{"poison_default": False}, {"poison_default": True}, {}], "B": [dict(yes, detect_mc=2.0), dict(yes, detect_mc=0.0), yes, dict(yes, o_ath_true=None)], "C": [dict(yes, q_mc_plausible=False), yes]}
    (tmp_path / "one.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "two.json").write_text(json.dumps([{"A": [{}]}, {"B": []}], indent=2))
    row = "array<struct<poison_default: boolean, q_mc_regime_ok: boolean, q_mc_plausible: boolean, o_ath_true: boolean, detect_mc: double>>"
    read = scans.whole(spark, str(tmp_path), f"A {row}, B {row}, C {row}", "*.json")
    assert read.count() == 3 and dict(rows(cohorts.populations(read).groupBy("population").count())) == {"A_clean": 3, "B_clean": 3, "B_priced": 1, "C_clean": 1}
    with pytest.raises(ValueError, match="no file"):
        scans.whole(spark, str(tmp_path), "A string", "snipe_*.json")


def test_first_signers(spark):
    rng = random.Random(2)
    touches = [(rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(90), k, rng.choice([None, *range(9)])) for k in range(400)]
    want = []
    for mint in ("hot", "a", "b"):
        mine = sorted(((ts, seq, s) for m, ts, seq, s in touches if m == mint), key=lambda x: x[:2])
        order = []
        for ts, seq, signer in mine:
            if ts <= mine[0][0] + 20 and signer is not None and signer not in [o[0] for o in order] and len(order) < 4:
                order.append((signer, ts, seq))
        want += [(mint, s, k, ts, seq) for k, (s, ts, seq) in enumerate(order, 1)]
    schema = "mint string, ts long, seq long, signer int"
    assert sorted(rows(cohorts.first_signers(spark.createDataFrame(touches, schema), 4, 20).where("mint is not null"))) == sorted(want)
    assert rows(cohorts.first_signers(spark.createDataFrame([], schema), 4, 20)) == []


def test_active_controls(spark):
    rng = random.Random(3)
    anchors = [40, 44, 300]
    all_ = [(k, rng.choice([True, False, None]), rng.choice([False, None, False, True]), rng.choice([None, 10, 30, 31]), rng.choice([True, True, False, None])) for k in range(0, 200, 2)]
    fit = [k for k, g, led, n, genesis in all_ if not g and not led and n is not None and n >= 30 and genesis and k not in anchors]
    want = []
    for a in anchors:
        q = sorted((abs(k - a), k) for k in fit if abs(k - a) <= 30)
        want += [(a, k, d, r, len(q)) for r, (d, k) in enumerate(q[:3], 1)]
    candidates = spark.createDataFrame(all_, "control long, graduated boolean, led boolean, transactions long, genesis boolean")
    got = cohorts.active_controls(spark.createDataFrame([(a,) for a in anchors], "anchor long"), candidates, 30, 3, 30)
    assert sorted(rows(got.select("anchor", "control", "distance", "rank", "eligible"))) == sorted(want) and want


def test_rates_at_anchors(spark):
    rng = random.Random(5)
    at = lambda *d: int(datetime(*d, tzinfo=timezone.utc).timestamp())
    times = sorted([rng.randrange(at(2023, 11, 20), at(2024, 3, 9)) for _ in range(300)] + [at(2024, 1, 7)] * 60)
    want, now = {}, times[-1]
    for y, m in ((2023, 11), (2023, 12), (2024, 1), (2024, 2), (2024, 3)):
        t0 = at(y, m, 1)
        t1 = t0 + 86_400 * calendar.monthrange(y, m)[1]
        pages = []
        for k in range(4):
            anchor = int(t0 + (t1 - t0) * (k + 0.5) / 4)
            before = [t for t in times if t < anchor][-30:]
            if anchor < now - 3600 and len(before) >= 15:
                pages.append((len(before) - 1) / (before[-1] - before[0]) if before[-1] > before[0] else None)
        if pages:
            rate = st.median([p for p in pages if p]) if any(pages) else None
            want[f"{y}-{m:02}"] = (len(pages), pytest.approx(rate), pytest.approx(rate * (min(t1, now) - t0)))
    frame = spark.createDataFrame([(t,) for t in times] + [(None,)], "ts long")
    assert {r.month: (r.anchors, r.rate, r.estimate) for r in cohorts.monthly_rates(frame, 4, 30, 15).collect()} == want
    assert rows(cohorts.monthly_rates(spark.createDataFrame([(t,) for t in [now] * 40], "ts long"), 4, 30, 15)) == []
    assert rows(cohorts.monthly_rates(spark.createDataFrame([], "ts long"), 4, 30, 15)) == []


def test_deposits(spark):
    day = date
    views = [
        ("w", "2024-01", day(2024, 1, 1), 100, "a", None), ("w", "2024-01", day(2024, 1, 1), -30, None, "a"), ("w", "2024-01", day(2024, 1, 2), 7, "b", None),
        ("v", "2024-01", day(2024, 1, 1), 5, "a", None), ("w", "2024-02", day(2024, 2, 1), 9, None, None), ("w", "2024-02", day(2024, 2, 1), 0, None, None), ("w", "2024-03", day(2024, 2, 1), -1, None, None),
    ]
    frame = spark.createDataFrame(views, "subject string, month string, day date, units long, sender string, recipient string")
    closes = spark.createDataFrame([(day(2024, 1, 1), 1.5), (day(2024, 1, 2), 2.0)], "day date, close double")
    got = cohorts.deposits(frame, closes).select("month", "n", "units", "unpriced", "worth", "senders", "returned", "returned_units", "swept", "residual")
    assert sorted(rows(got), key=str) == sorted([
        ("2024-01", 3, 112, 0, 150 + 14 + 8, 2, 1, 100, 30, 82), ("2024-02", 1, 9, 1, None, 0, 0, 0, 0, 9), ("2024-03", 0, 0, 0, None, 0, 0, 0, 1, -1), (None, 4, 121, 1, None, 2, 1, 100, 31, 90),
    ], key=str)


def test_equal_credits(spark):
    schema = "wallet string, ts long, amount double"
    events = [("a", 5, 0.1 + 0.2), ("b", 9, 0.3), ("a", 6, 0.3), ("c", 1, 0.300000002), ("d", 1, 0.2), ("d", 4, 0.2), ("e", 7, 0.2), ("f", 2, None)]
    got = cohorts.equal_credits(spark.createDataFrame(events, schema))
    assert sorted(rows(got)) == [("d", 2, 0.2, 3, 1, 7, 6), ("e", 1, 0.2, 3, 1, 7, 6)]
    assert rows(cohorts.equal_credits(spark.createDataFrame([], schema))) == []
