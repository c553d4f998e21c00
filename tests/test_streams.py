"""Streams against plain loops: order of arrival, restarts, late rows, bounded state, and pages read once."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tapeweave.sources.pages import PageReader, pages
from tapeweave.streaming import bursts, coverage, replay, triggers


def plain_stop(path, drop):
    peak, out = None, []
    for _, k, price in sorted(path):
        if out:
            return [*out, ("execute", k, price)]
        if price is not None and peak is not None and price <= peak * (1 - drop):
            out.append(("decide", k, price))
        elif price is not None:
            peak = price if peak is None else max(peak, price)
    return out


def test_trailing_stop_decides_in_order_of_time(spark, tmp_path):
    """Rows arrive shuffled within the lateness allowed, in three runs from one checkpoint; some prices are missing."""
    rng, rows = random.Random(5), []
    for mint in range(25):
        for k in range(rng.randint(1, 14)):
            rows.append((mint, 100_000 + 60 * k + mint, k, None if rng.random() < 0.3 else rng.uniform(0.5, 2)))
    frame = spark.createDataFrame(rows, "mint long, ts long, k long, price double").select("mint", F.timestamp_seconds("ts").alias("time"), "k", "price")
    cut = [F.pmod(F.hash("mint", "k"), F.lit(3)) == n for n in range(3)]  # any order: all rows lie within the lateness
    got = replay.replayed(frame, cut, lambda s: triggers.trailing_stop_stream(s, 0.3, "1 hour"), str(tmp_path / "a"), "1 hour").collect()
    for mint in range(25):
        mine = sorted((r.k, r.what, r.price) for r in got if r.mint == mint)
        assert mine == [(k, w, p) for w, k, p in plain_stop([x[1:] for x in rows if x[0] == mint], 0.3)]
    assert any(r.what == "execute" and r.price is None for r in got) and len({r.mint for r in got}) > 10


def test_micro_fixture_of_the_trailing_stop(spark, tmp_path):
    prices = [1.0, 1.2, None, 0.8, 0.7]
    frame = spark.createDataFrame([("m", 100_000 + k, k, p) for k, p in enumerate(prices)], "mint string, ts long, k long, price double").select("mint", F.timestamp_seconds("ts").alias("time"), "k", "price")
    got = replay.replayed(frame, [F.lit(True)], lambda s: triggers.trailing_stop_stream(s, 0.3), str(tmp_path / "a"), "1 hour")
    assert sorted(map(tuple, got.select("what", "k", "price").collect())) == [("decide", 3, 0.8), ("execute", 4, 0.7)]


def test_bursts_and_their_state(spark, tmp_path):
    """Found bursts equal a plain loop's; what the watermark has passed is evicted."""
    rng, rows = random.Random(6), []
    for k in range(900):
        rows.append((k % 2, rng.randrange(12), rng.choice([1.0, 2.5, 7.0]) * (1 + rng.choice([0, 0, 5e-5, 3e-4])), 100_000 + k * 240, k))
    want = set()
    for label, wallet, amount, ts, seq in rows:
        near = {w for x, w, a, t, s in rows if x == label and (a > amount or a == amount and s > seq) and a <= amount * (1 + 1e-4) and abs(t - ts) <= 3600 and w != wallet}
        if len(near) >= 2:
            want.add((label, seq, len(near) + 1))
    frame = spark.createDataFrame(rows, "label long, wallet long, amount double, ts long, seq long").select("label", "wallet", "amount", F.timestamp_seconds("ts").alias("time"), "seq")
    folder = str(tmp_path / "a")
    ends = [100_000 + 240 * n for n in range(0, 901, 150)]
    slices = [(F.unix_seconds("time") >= a) & (F.unix_seconds("time") < b) for a, b in zip(ends, ends[1:])]
    got = replay.replayed(frame, slices, lambda s: bursts.burst_stream(s, 1e-4, 3600, 3, "10 minutes"), folder, "10 minutes", bursts.last())
    assert {(r.label, r.seq, r.wallets) for r in got.collect()} == want and len(want) > 50
    # once more over what landed, file by file: rows kept at any time stay near the window's, not the tape's
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", "1").option("basePath", f"{folder}/tape").parquet(f"{folder}/tape/*")
    with replay.rocks_db(spark):
        query = bursts.burst_stream(stream, 1e-4, 3600, 3, "10 minutes").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "b")).outputMode("append").start()
        query.processAllAvailable()
        kept = [sum(o["numRowsTotal"] for o in x["stateOperators"]) for x in query.recentProgress]
        query.stop()
    assert kept and kept[-1] < 60


def test_late_rows_are_marked_and_a_failed_batch_runs_again(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "a")
    at = lambda *xs: spark.createDataFrame([("m", x) for x in xs], "mint string, ts long").select("mint", F.timestamp_seconds("ts").alias("time"))
    first = at(1000, 5000, None)
    replay.land(first, folder, 0)
    coverage.run(spark, first.schema, f"{folder}/tape", folder, "10 minutes")
    replay.land(at(4500, 4300, 9000), folder, 1)
    real, calls = coverage.marked, []

    def failing(*args):
        write = real(*args)

        def once(batch, number):
            write(batch, number)
            calls.append(number)
            if len(calls) == 1:
                raise RuntimeError("lost after writing, before the batch was noted")

        return once

    monkeypatch.setattr(coverage, "marked", failing)
    with pytest.raises(Exception, match="lost after writing"):
        coverage.run(spark, first.schema, f"{folder}/tape", folder, "10 minutes")
    coverage.run(spark, first.schema, f"{folder}/tape", folder, "10 minutes")
    assert calls == [1, 1]
    rows = spark.read.parquet(f"{folder}/rows")
    got = sorted((r.ts or 0, r.coverage) for r in rows.select(F.unix_seconds("time").alias("ts"), "coverage").collect())
    assert got == [(0, "unreadable"), (1000, "on_time"), (4300, "late"), (4500, "on_time"), (5000, "on_time"), (9000, "on_time")]
    found = coverage.covered(rows, spark.read.parquet(f"{folder}/marks"), "mint", 1000, "10 minutes")
    assert sorted(map(tuple, found.collect())) == [("m", 1000, 1, 0, "complete"), ("m", 4000, 1, 1, "late"), ("m", 5000, 1, 0, "complete"), ("m", 9000, 1, 0, "censored")]


def write_pages(folder, numbers, size, rows):
    folder.mkdir(exist_ok=True)
    for n in numbers:
        part = rows[n * size : (n + 1) * size]
        (folder / f"page-{n}.jsonl").write_text("".join(json.dumps({"signature": s, "t": t, "other": 1}) + "\n" for s, t in part))


def test_pages_are_read_once(spark, tmp_path):
    """A run that dies resumes after the pages it has; a page that isn't full is the last."""
    rows = [(f"s{k}", k) for k in range(23)]
    folder = tmp_path / "pages"
    write_pages(folder, [0, 1, 3], 5, rows)  # page 2 is missing: 3 waits
    dead = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")
        if number == 1 and not dead:
            dead.append(number)
            raise RuntimeError("killed")

    def run():
        query = pages(spark, str(folder), "signature string, t long", 5).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    assert sorted(r.page for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0] * 5 + [1] * 5
    write_pages(folder, [2, 4], 5, rows)
    with pytest.raises(Exception, match="killed"):
        run()
    run()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.signature, r.t) for r in got) == sorted(rows) and dead == [1]
    assert {r.page: r.last for r in got} == {0: False, 1: False, 2: False, 3: False, 4: True}
    reader = PageReader(pages(spark, str(folder), "signature string, t long", 5).schema, str(folder), 5)
    assert reader.latestOffset() == {"page": 5} and len(reader.partitions({"page": 2}, {"page": 5})) == 3
