"""Rows met in time against plain loops; no row for each pair of a probe and a tick."""

import math
import random
import statistics as st

import numpy as np
import pytest

from tapeweave.operators import meetings, sequence, tape


def tape_of(seed, n=400):
    """Ticks of three mints: many at one time, some without a price, some far away; and probes, some of a mint without ticks."""
    rng = random.Random(seed)
    ticks = [(rng.choice("abc"), rng.choice([0, 29, 30, 31, rng.randrange(-50, 300), 10_000]), k, rng.choice(["buy", "sell"]), rng.choice([None, 1.0, 2.5, rng.uniform(0, 5)]), rng.choice([0.1, 0.2, 0.3, 1.5])) for k in range(n)]
    probes = sorted({(rng.choice("abcd"), rng.choice([t[1], t[1] - 30, rng.randrange(-60, 320)])) for t in ticks})
    return ticks, probes


def frames(spark, ticks, probes):
    return spark.createDataFrame(ticks, "mint string, ts long, seq long, side string, price double, sol double").repartition(5), spark.createDataFrame(probes, "mint string, t long")


def pairs_joined(df):
    return "Join" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("floor", [0.0, 0.25])
def test_market_mark_joins_no_pairs(spark, floor):
    ticks, probes = tape_of(1)
    frame, asked = frames(spark, ticks, probes)
    got = tape.market_mark(asked, frame, (10, 20, 30), floor)
    assert not pairs_joined(got)
    found = {(r.mint, r.t): r.mark for r in got.collect()}
    for mint, t in probes:
        want = next((st.median(x) for w in (10, 20, 30) if (x := [p for m, s, _, _, p, sol in ticks if m == mint and t <= s < t + w and p is not None and sol >= floor])), None)
        assert found[mint, t] == (want if want is None else pytest.approx(want, rel=1e-12)), (mint, t)
    assert len(found) == len(probes) and None in found.values()


def test_order_statistics_of_runs():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 9, 100).astype(float)
    rank, order = meetings.ranks(values)
    low = rng.integers(0, 90, 300)
    high = low + rng.integers(1, 11, 300)
    for place in (0, -1):
        k = (high - low - 1) if place else np.zeros(300, np.int64)
        assert [values[x] for x in order[meetings.chosen(rank, low, high, k)]] == [sorted(values[a:b])[place] for a, b in zip(low, high)]
    one = meetings.medians(np.array([2.0]), [(np.array([0, 0]), np.array([1, 0]))])[0]
    assert one[0] == 2 and math.isnan(one[1]) and len(meetings.medians(np.empty(0), [(np.zeros(0, int), np.zeros(0, int))])[0]) == 0
    assert all(math.isnan(x) for x in meetings.medians(np.empty(0), [(np.zeros(2, int), np.zeros(2, int))])[0])


def test_cells_larger_than_a_step(spark, monkeypatch):
    """Whole cells come together however batches cut them."""
    import pyarrow as pa

    rows = [(0, 1)] * 3 + [(1, 1)] * 20 + [(1, 2)] * 2 + [(2, 2)] * 7
    monkeypatch.setattr(meetings, "STEP_ROWS", 4)
    whole = pa.table({"_cell": [r[0] for r in rows], "_by0": [r[1] for r in rows]})
    for size in (1, 3, 5, 40):
        parts = list(meetings.whole_cells(iter(whole.to_batches(max_chunksize=size)), 1))
        assert pa.concat_tables(parts).equals(whole)
        cells = [set(zip(p["_cell"].to_pylist(), p["_by0"].to_pylist())) for p in parts]
        assert not any(a & b for a, b in zip(cells, cells[1:]))


@pytest.mark.parametrize("side", ["bid", "ask"])
@pytest.mark.parametrize("position", [0.3, 0.6, 2.0, 4.7])
def test_depth_joins_no_pairs(spark, side, position):
    """Sizes whose sums come to the position only within rounding are added in the order of the walk, as SQL does."""
    ticks, probes = tape_of(2)
    ticks = [x for x in ticks if x[4] is not None]
    frame, asked = frames(spark, ticks, probes)
    got = tape.depth(asked, frame, side, position, 30)
    assert not pairs_joined(got)
    found = {(r.mint, r.t): (r.price, r.status) for r in got.collect()}
    for mint, t in probes:
        near = sorted(((-p if side == "bid" else p, s, k, sol) for m, s, k, _, p, sol in ticks if m == mint and t <= s and (s <= t + 30 if side == "bid" else s < t + 30)))
        total, want = 0.0, (None, "unfillable")
        for p, _, _, sol in near:
            total, want = total + sol, (abs(p), "thin")
            if total >= position:
                want = (abs(p), "ok")
                break
        assert found[mint, t] == want, (mint, t)
    assert len(found) == len(probes) and {"unfillable", "ok"} <= {s for _, s in found.values()}


def test_entry_gate_joins_mints_only(spark):
    ticks, probes = tape_of(4)
    frame, asked = frames(spark, ticks, probes)
    got = tape.entry_gate(asked, frame, 0.5, 30, 0.25, 0.15, 5)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with a mint's last tick
    found = {(r.mint, r.t): r for r in got.collect()}
    ends = {m: max(x[1] for x in ticks if x[0] == m) for m in "abc"}
    assert set(found) == {p for p in probes if p[0] in ends}
    for (mint, t), r in found.items():
        near = [x for x in ticks if x[0] == mint and t <= x[1] < t + 30]
        prices, volume = [x[4] for x in near if x[5] >= 0.25 and x[4] is not None], math.fsum(x[5] for x in near if x[5] >= 0.25)
        ask, total = None, 0.0
        for p, _, _, sol in sorted((x[4], x[1], x[2], x[5]) for x in near if x[3] == "sell" and x[5] >= 0.15 and x[4] is not None):
            ask, total = p, total + sol
            if total >= 0.5:
                break
        gate = "after_end" if t >= ends[mint] else "no_price" if not prices else "thin_volume" if volume < 0.5 - 1e-12 else "no_ask" if ask is None else "no_room" if ends[mint] - 5 < t + 60 else "ok"
        assert r.gate == gate and r.entry == (pytest.approx(max(st.median(prices), ask)) if gate == "ok" else None)
    assert len({r.gate for r in found.values()}) >= 4


def test_nearest_joins_no_pairs(spark):
    rng = random.Random(5)
    right = [(m, t, rng.choice([None, rng.random()])) for m in "ab" for t in sorted({rng.randrange(-200, 200) for _ in range(60)})] + [("a", None, 1.0), (None, 5, 2.0)]
    left = [(rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(-260, 260)]), k) for k in range(500)]
    got = sequence.nearest(spark.createDataFrame(left, "mint string, ts long, id long"), spark.createDataFrame(right, "mint string, ts long, rate double"), ["mint"], "rate", 7)
    assert not pairs_joined(got) and got.columns == ["mint", "ts", "id", "rate"]
    found = {r.id: r for r in got.collect()}
    for mint, t, k in left:
        near = sorted((abs(s - t), s, v) for m, s, v in right if None not in (m, s, mint, t) and m == mint and abs(s - t) <= 7)
        assert tuple(found[k]) == (mint, t, k, near[0][2] if near else None)
    assert len(found) == 500


def test_volumes_join_no_pairs(spark):
    ticks, probes = tape_of(6)
    frame, asked = frames(spark, ticks, probes)
    got = tape.volumes(asked, frame, 30)
    assert not pairs_joined(got)
    found = {(r.mint, r.t): (r.trades, r.volume) for r in got.collect()}
    want = {p: [x[5] for x in ticks if x[0] == p[0] and p[1] <= x[1] < p[1] + 30] for p in probes}
    assert found == {p: (len(x), pytest.approx(math.fsum(x), rel=1e-12)) for p, x in want.items() if x}
