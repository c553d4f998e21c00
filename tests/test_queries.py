"""Every query with SQL against DuckDB on the smallest tables, and order-dependent operators against plain loops."""

import glob
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeweave.functions import columns
from tapeweave.operators import sequence, splits, statistics, tape
from tapeweave.plans import catalog
from tapeweave.sources.tapes import CAPTURE, captures, event_tape, swaps_of
from tapeweave.streaming.twins import robust_price_stream, session_stream

SF = "/root/testdata/sf0.001"


def rounded(row):
    return tuple((x is None, str(type(x)), round(x, 6) if isinstance(x, float) else x) for x in row)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(map(rounded, df.select(*names).collect()))
    if name in catalog.SQL:
        want = sorted(map(rounded, duck.sql(f"select {','.join(names)} from ({catalog.SQL[name]})").fetchall()))
        assert got == want and got


def plain_splits(events, tolerance, window, least):
    """The reference rule once more, in its simplest form: (amount, ts, wallet) in order of amounts."""
    events, used, out = sorted(events, key=lambda e: e[0]), set(), []
    for i, (amount, ts, wallet) in enumerate(events):
        if i not in used:
            near = [k for k in range(i + 1, len(events)) if k not in used and events[k][0] - amount <= amount * tolerance and events[k][2] != wallet and abs(events[k][1] - ts) <= window]
            group = [i, *near]
            if len({events[k][2] for k in group}) >= least:
                used.update(group)
                times = [events[k][1] for k in group]
                out.append((round(amount, 9), tuple(sorted({events[k][2] for k in group})), min(times), max(times) - min(times)))
    return sorted(out)


def test_greedy_splits_and_the_set_form(spark):
    assert splits.greedy([(2.9768156, 100, "w1"), (2.9768156, 250, "w2"), (2.9768156, 400, "w3"), (5.0, 300, "l")], 1e-4, 3600, 3) == [[0, 1, 2]]
    assert splits.greedy([(2.0, 0, "a"), (2.0, 1, "b")], 1e-4, 3600, 3) == []
    shadow = [(1.0, 0, "w1"), (1.00002, 3500, "w2"), (1.00004, 5000, "w3"), (1.00006, 5500, "w4")]
    assert splits.greedy(shadow, 1e-4, 3600, 3) == [[1, 2, 3]]
    assert splits.greedy([(1.0, t, w) for t, w in ((0, "A"), (10, "B"), (20, "B"), (30, "C"), (3610, "D"), (3615, "E"))], 1e-4, 3600, 3) == [[0, 1, 2, 3]]
    rng, rows = random.Random(20), []
    for label in range(120):
        for k in range(rng.randint(2, 14)):
            rows.append((label, f"w{rng.randint(0, 5)}", 1 + rng.uniform(-3e-4, 3e-4), rng.randint(0, 8000), label * 100 + k))
    frame = spark.createDataFrame(rows, "label long, wallet string, amount double, ts long, seq long").repartition(3)
    got: dict = {}
    for r in splits.split_clusters(frame, "label").collect():
        assert r.n_wallets == len(r.wallets) and r.date == "1970-01-01"
        got.setdefault(r.label, []).append((r.amount, tuple(r.wallets), r.first_ts, r.span_seconds))
    for label in range(120):
        assert sorted(got.get(label, [])) == plain_splits([(a, t, w) for x, w, a, t, _ in rows if x == label], 1e-4, 3600, 3)
    assert {r.label: r.split for r in sequence.split_exists(frame, "label", 1e-4, 3600, 3).collect()} == {k: k in got for k in range(120)} and len(got) > 20


def test_as_of_over_bins(spark):
    rng = random.Random(3)
    right = {(k, rng.randrange(400)): rng.random() for k in "ab" for _ in range(30)}
    left = [(rng.choice("abc"), rng.randrange(-50, 500), i) for i in range(200)]
    l, r = spark.createDataFrame(left, "mint string, ts long, id long"), spark.createDataFrame([(*k, v) for k, v in right.items()], "mint string, ts long, rate double")
    for x in sequence.as_of(l, r, ["mint"], "rate", width=7).collect():
        times = sorted(t for k, t in right if k == x.mint)
        past = [t for t in times if t <= x.ts]
        assert x.rate == (right[x.mint, (past or times[:1])[-1]] if times else None)


def test_hub_components(spark, duck):
    pairs = duck.sql("with d as (select distinct l_orderkey g, l_partkey i from lineitem) select a.i, b.i from d a join d b using (g) where a.i < b.i group by 1, 2 having count(*) >= 2").fetchall()
    root: dict = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want: dict = {}
    for v in list(root):
        want[find(v)] = want.get(find(v), 0) + 1
    assert {r.component: r.size for r in catalog.QUERIES["hub_components"](spark, SF).collect()} == want and want


def test_keyed_hash_equals_the_library(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([("text",), ("",), ("é" * 90,)], "x string").select("x", columns.hmac_sha256(F.col("x"), b"k").alias("h")).collect()
    assert all(r.h == hmac.new(b"k", r.x.encode(), hashlib.sha256).hexdigest() for r in got)


def test_statistics(spark):
    low, high = columns.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (1, 1), (58, 70)], "k int, n int").select(low.alias("a"), high.alias("b")).collect()
    assert got[0].a is None and got[1].b == 1 and got[2].a == pytest.approx(0.724, abs=1e-3) and got[2].b == pytest.approx(0.899, abs=1e-3)
    one, two = statistics.fisher(3, 1, 1, 3)
    assert one == pytest.approx(17 / 70) and two == pytest.approx(34 / 70)
    assert statistics.hypergeometric_tail(1, 2, 4, 2) == pytest.approx(5 / 6)
    assert statistics.clopper_pearson(0, 10)[1] == pytest.approx(1 - 0.025 ** 0.1, rel=1e-6)
    values = spark.createDataFrame([([4.0, 3.0, 2.0, 1.0],), ([5.0, None, 1.0, None],)], "v array<double>")
    assert [r[0] for r in values.select(columns.nearest_rank(F.col("v"), 0.0)).collect()] == [1, 1]
    few = spark.createDataFrame([([4.0, 3.0, None, 2.0, 1.0],)], "v array<double>").select(columns.exclusive_quantile(F.col("v"), 0.25), columns.count_rank(F.col("v"), 1.0), columns.slice_rank(F.col("v"), 4)).first()
    assert tuple(few) == (1.25, 4.0, 2.0)
    fair = spark.range(1).select(columns.round_trip(F.lit(1.0), F.lit(1.0))).first()[0]
    assert fair == pytest.approx(0.99 * 0.98 / (1.01 * 1.02) - 1)


def test_null_model_against_loops(spark):
    catalog.checkpoints(spark)
    rng, rows = random.Random(9), []
    for k in range(160):
        rows.append((rng.randrange(50), rng.randrange(400), rng.randrange(1500), 100 * (1 + rng.randrange(30) * 1e-5) + rng.randrange(8), rng.randrange(9000), k))
    frame = spark.createDataFrame(rows, "wallet long, source long, sig long, amount double, ts long, seq long").repartition(3)
    sizes, draws = (4, 12, 30, 1000), 60
    picked = {}
    for r in statistics.drawn_groups(frame, sizes, draws, 5).collect():
        picked.setdefault(r["round"], set()).add(r.wallet)
    assert all(len(picked[r]) == sizes[r // draws] for r in range(3 * draws)) and len(picked) == 3 * draws and len({frozenset(p) for p in picked.values()}) > 100
    want = {}
    for r, wallets in picked.items():
        inside = [x for x in sorted(rows, key=lambda x: (x[3], x[5])) if x[0] in wallets]
        shares = [any(len({y[0] for y in inside if y[c] == x[c]}) >= 2 for x in inside) for c in (2, 1)]
        near = any(len({y[0] for y in inside[i + 1 :] if y[3] <= x[3] * (1 + 1e-4) and abs(y[4] - x[4]) <= 3600} | {x[0]}) >= 3 for i, x in enumerate(inside))
        hits = (shares[0], near, shares[1], any(shares) or near)
        size = sizes[r // draws]
        want[size] = [a + b for a, b in zip(want.get(size, [0] * 4), hits)]
    got = {r.size: [r.transaction, r.amount, r.source, r.any] for r in statistics.null_model(frame, sizes, draws, 5).collect()}
    assert set(got) == {4, 12, 30} and all(got[s] == pytest.approx([n / draws for n in want[s]]) for s in got)
    assert want[12] != want[30] and all(0 < n for n in want[30])


def test_whole_tables(spark, duck):
    """Every tick is a probe and every purchase a rate, where the queries over subsets take some."""
    assert not any("seq % 10 = 0" in catalog.SQL[f"{q}_all"] or "seq % 20 = 1" in catalog.SQL[f"{q}_all"] for q in ("as_of_clamped", "nearest_within", "interval_volume", "depth_bid", "depth_ask", "market_mark"))
    ticks = duck.sql("select count(*) from (select distinct event_type, floor(epoch(ts)) from events)").fetchall()[0][0]
    assert all(catalog.QUERIES[q](spark, SF).count() == ticks for q in ("interval_volume_all", "depth_bid_all", "depth_ask_all", "market_mark_all"))
    root: dict = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for (c,) in duck.sql("select o_custkey from orders").fetchall():
        a, b = sorted((find(c), find(c * 7 % 1000 + 1)))
        root[b] = a
    got = {r.id: r.component for r in catalog.QUERIES["components_all"](spark, SF).collect()}
    assert got == {v: find(v) for v in list(root) if v in got} and set(root) - set(got) <= {v for v in root if v * 7 % 1000 + 1 == v}


def test_triggers_against_loops(spark):
    rng, rows, want = random.Random(3), [], {}
    for mint in range(60):
        prices = [rng.uniform(0.5, 2) for _ in range(rng.randint(1, 12))]
        rows += [(mint, k, p) for k, p in enumerate(prices)]
        peak = prices[0]
        for k, p in enumerate(prices[1:], 1):
            if p <= peak * (1 - 0.3):
                want[mint] = k
                break
            peak = max(peak, p)
    frame = spark.createDataFrame(rows, "mint long, k long, price double")
    assert {r.mint: r.fires for r in tape.trailing_stop(frame, 0.3).collect()} == want


def test_captures(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"mint":"m","created":5,"swaps":[{"ts":1,"side":"buy","sol":2.0,"tokens":4.0},{"ts":1,"side":"x","sol":1.0,"tokens":1.0}]}\n{bad\n')
    read = captures(spark, str(tmp_path / "c.json"))
    swaps = swaps_of(read)
    assert "swaps" in CAPTURE and [tuple(r) for r in tape.clean(swaps).select("seq", "price").collect()] == [(0, 0.5)]


def test_streams_equal_batch(spark, tmp_path):
    ticks = event_tape(spark, SF).select("mint", F.timestamp_seconds("ts").alias("time"), "price", F.col("trader").alias("user_id")).where("price is not null")
    ticks.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in"))
    for name, build in (("prices", lambda d: robust_price_stream(d, "1 hour")), ("sessions", lambda d: session_stream(d, "6 hours"))):
        q = build(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        key = [f for f in spark.table(name).columns]
        assert sorted(map(str, spark.table(name).select(*key).collect())) == sorted(map(str, build(ticks).select(*key).collect()))


def test_entry_without_llm():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert math.isfinite(len(__spark_entry__.queries()))


def test_greedy_splits_of_a_dense_label_pass_over_what_is_taken_or_far_off():
    """As the plain search finds them; 30,000 equal amounts, of which each event is near three in time, in less than a second each."""
    import time

    def plain(events, tolerance, window, least):
        order, free, out = sorted(range(len(events)), key=lambda k: events[k][0]), [True] * len(events), []
        for at, seed in enumerate(order):
            near = [k for k in order[at + 1 :] if free[k] and events[k][0] - events[seed][0] <= events[seed][0] * tolerance and abs(events[k][1] - events[seed][1]) <= window and events[k][2] != events[seed][2]]
            if free[seed] and len({events[k][2] for k in (seed, *near)}) >= least:
                out.append([seed, *near])
                for k in out[-1]:
                    free[k] = False
        return out

    rng = random.Random(12)
    for _ in range(300):
        events = [(rng.choice([1.0, 2.0, rng.uniform(0.5, 3)]), rng.randrange(-60, 60), rng.choice("abcdefg")) for _ in range(rng.randrange(40))]
        for tolerance, window, least in ((0.0, 10, 2), (0.05, 40, 3), (0.5, 1, 3)):
            assert splits.greedy(events, tolerance, window, least) == plain(events, tolerance, window, least)
    began = time.process_time()
    assert splits.greedy([(5.0, 100 * (k // 2), f"w{k % 2}") for k in range(30_000)], 1e-4, 60, 3) == []
    assert len(splits.greedy([(5.0, 100 * (k // 3), f"w{k % 3}") for k in range(30_000)], 1e-4, 60, 3)) == 10_000
    assert time.process_time() - began < 5


def test_near_amounts_across_the_edges_of_cells(spark):
    """Rounds of payments near the borders of cells in time and amount equal a loop's; each payment is sent to few cells."""
    rng, rows = random.Random(13), []
    for k in range(400):
        rows.append((rng.randrange(60), rng.choice([1.0, 170.0, 1e4, 164.0 * 1.01 ** rng.randrange(12)]) * (1 + rng.randrange(5) * 3e-3), rng.choice([35, 36, 37, 108]) + rng.randrange(-4, 5) + 72 * rng.randrange(6), k))
    wallets, of = zip(*((w, r) for r in range(200) for w in rng.sample(range(60), rng.choice([3, 8]))))
    rounds = statistics.Rounds(np.array(wallets), np.array(of), 200)
    frame = spark.createDataFrame(rows, "w long, amount double, ts long, seq long").repartition(4)
    found = statistics.rounds_of_near_amounts(frame, 0.01, 3, 3, spark.sparkContext.broadcast(rounds))
    picked = {r: {w for w, x in zip(wallets, of) if x == r} for r in range(200)}
    want = set()
    for r, some in picked.items():
        inside = sorted((x for x in rows if x[0] in some), key=lambda x: (x[1], x[3]))
        if any(len({y[0] for y in inside[i + 1 :] if y[1] <= x[1] * 1.01 and abs(y[2] - x[2]) <= 3} | {x[0]}) >= 3 for i, x in enumerate(inside)):
            want.add(r)
    assert {x["round"] for x in found.collect()} == want and 20 < len(want) < 190
    parts = [x for x in rounds.pieces(np.array(wallets), np.array(of), 7)]
    assert [k for p in parts for k in range(p.start, p.stop)] == list(range(len(of))) and not any(of[p.start] == of[p.start - 1] for p in parts[1:])
