"""Captures over several sources, landed candles, keys, credits, purchases, exits and splits with a floor against plain loops."""

import gzip
import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tapeweave.functions import keys
from tapeweave.operators import predicates, splits
from tapeweave.plans import captures, catalog
from tapeweave.sources import candles, scans
from tapeweave.sources.tapes import CAPTURE

P = keys.PRIME


def packed(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    (gzip.open if path.suffix == ".gz" else open)(path, "wt").write("".join(line + "\n" for line in lines))


def test_scans_keep_the_first_of_each_key(spark, tmp_path):
    rng = random.Random(4)
    sources, seen, kept, counts = [], set(), {}, {}
    barred = {f"m{k}" for k in range(0, 60, 7)}
    for role, files in (("early", 3), ("late", 2), ("control", 1)):
        tally = counts.setdefault(role, {"rows": 0, "unreadable": 0, "excluded": 0, "kept": 0, "repeated": 0})
        for number in range(files):
            lines = []
            for at in range(40 if role != "control" else 0):
                mint = f"m{rng.randrange(60)}"
                line = json.dumps({"mint": mint, "created": at, "pool": f"{role}{number}", "swaps": [{"ts": at, "sol": 1.5}] * (at % 3), "unknown": [1]})
                kind = rng.randrange(8)
                lines.append(line[:25] if kind == 0 else line.replace(f'"{mint}"', "null") if kind == 1 else line)
                tally["rows"] += 1
                if kind < 2:
                    tally["unreadable"] += 1
                elif mint in barred:
                    tally["excluded"] += 1
                elif mint in seen:
                    tally["repeated"] += 1
                else:
                    seen.add(mint)
                    kept[mint] = (role, f"{role}{number}", at)
                    tally["kept"] += 1
            if role == "control":
                lines = [json.dumps({"mint": m}) for m in sorted(barred)]
                tally |= {"rows": len(lines), "excluded": len(lines)}
            packed(tmp_path / role / f"part{number}.json{'.gz' if number != 1 else ''}", lines)
        sources.append((role, str(tmp_path / role)))
    first, ledger = scans.scan(spark, sources, CAPTURE, "mint", ("control",))
    assert {r.mint: (r.role, r.pool, r.created) for r in first.collect()} == kept
    assert {r.role: {c: r[c] for c in counts["early"]} for r in ledger.collect()} == counts
    assert counts["late"]["repeated"] and counts["early"]["unreadable"]
    every, _ = scans.scan(spark, sources, CAPTURE, "mint")
    assert every.count() > len(kept) and {r.mint for r in every.where("role = 'control'").collect()} <= barred
    (tmp_path / "empty").mkdir()
    none, empty = scans.scan(spark, [("x", str(tmp_path / "empty"))], CAPTURE, "mint")
    assert none.count() == 0 and empty.count() == 0


def test_landed_candles(spark, tmp_path):
    day = lambda t, *v: [t, *v]
    lines = [
        json.dumps({"mint": "ok", "pools": [{"id": "b", "depth": 5}, {"id": "a", "depth": 5}, {"id": "c", "depth": 1}, {"depth": 99}], "ohlcv": [day(100, 0, 2, 1, 3.0, 9), day(200, 4, 4, 4, 4, 1), [None, 1, 1, 1, 1, 1], [300, 1]]}),
        json.dumps({"mint": "empty", "pools": [{"id": "a"}], "ohlcv": []}), json.dumps({"mint": "null", "pools": [{"id": "a", "depth": 0}]}), json.dumps({"mint": "none", "pools": [], "ohlcv": [day(1, 1, 1, 1, 1, 1)]}),
        json.dumps({"mint": "absent"}), json.dumps({"mint": "down", "error": "timeout", "pools": [{"id": "a"}]}), '{"mint": "cut", "po',
        json.dumps({"mint": "late", "pools": [{"id": "a"}], "ohlcv": [day(9000, 1, 1, 1, 1, 1)]}),
    ]
    packed(tmp_path / "x" / "a.json", lines)
    got = candles.landed(spark, str(tmp_path / "x"))
    assert {(r.mint, r.pool, r.status) for r in got.where("mint <> 'cut'").collect()} == {("ok", "a", "ok"), ("empty", "a", "zero_bougie"), ("null", "a", "zero_bougie"), ("none", None, "pool_absent"), ("absent", None, "pool_absent"), ("down", "a", "echec_reseau"), ("late", "a", "ok")}
    assert got.where("status = 'echec_reseau'").count() == 2
    rows = candles.candles(got)
    assert sorted(tuple(r) for r in rows.where("mint = 'ok'").collect()) == [("ok", 100, 0.0, 2.0, 1.0, 3.0, 9.0), ("ok", 200, 4.0, 4.0, 4.0, 4.0, 1.0)]
    prices = spark.createDataFrame([("ok", 0, 1.5, 2.0), ("late", 0, 1.0, 1.0), ("empty", 0, 1.0, 1.0), ("ok", 50, 0.0, 2.0)], "mint string, start long, price double, rate double")
    assert [tuple(r) for r in candles.unit_ratios(got, prices, 7200).collect()] == [("ok", 1.0)]  # its open is zero: the close


def point(key):
    y = int.from_bytes(key, "little") & ((1 << 255) - 1)
    square = (y * y - 1) * (keys.D * y * y + 1) % P
    return len(key) == 32 and y < P and pow(square, (P - 1) // 2, P) in (0, 1)


def name_of(key):
    n, out = int.from_bytes(key, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = keys.ALPHABET[r] + out
    return "1" * (len(key) - len(key.lstrip(b"\0"))) + out


def test_keys_equal_whole_numbers():
    rng = random.Random(2)
    edges = [x.to_bytes(32, "little") for x in (0, 1, 2, P - 2, P - 1, P, P + 1, 2**255 - 1, 2**255, 2**255 + 1, 2**256 - 1, 4 * pow(5, -1, P) % P)]
    many = edges + [rng.randbytes(32) for _ in range(3000)]
    assert keys.on_curve([*many, None, b"", bytes(31), bytes(33)]) == [*map(point, many), None, False, False, False]
    assert keys.on_curve([edges[-1]]) == [True] and keys.on_curve([]) == []  # the curve's base point
    raw = [*many[:300], b"", b"\0", bytes(40), b"\0\0a", rng.randbytes(700)] + [b"\xff" * n for n in range(1, 120)]
    assert keys.encode(raw) == list(map(name_of, raw)) and keys.decode(keys.encode(raw)) == raw
    assert keys.decode(["0", "l", None, "", "1", "é", "2", "a b"]) == [None, None, None, b"", b"\0", None, b"\1", None]
    found = keys.derived([b"seed", None, b""], bytes(range(32)))
    for seed, (address, bump) in ((b"seed", found[0]), (b"", found[2])):
        digest = lambda b: hashlib.sha256(seed + bytes([b]) + bytes(range(32)) + b"ProgramDerivedAddress").digest()
        assert address == digest(bump) and not point(address) and all(point(digest(b)) for b in range(bump + 1, 256))
    assert found[1] is None


def test_key_columns(spark):
    names = ["9cRCn9rGT8V2imeM2BaKs13yhMEais3ruM3rPvTGpump", "G2YxRa6wt1qePMwfJzdXZG62ej4qaTC7YURzuh2Lwd3t", "tooShort", "", "0OIl0OIl0OIl0OIl0OIl0OIl0OIl0OIl", "has a space in it 111111111111111111", "1" * 32, None]
    frame = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, name string")
    got = frame.select("k", keys.is_key(F.col("name")).alias("is"), keys.base58_encoded(keys.base58_decoded("name")).alias("again")).orderBy("k").collect()
    assert [r["is"] for r in got] == [True, True, False, False, False, False, True, None]
    assert [r.again for r in got] == [*names[:4], None, None, names[6], None]
    some = captures.derived_addresses(spark, "/root/testdata/sf0.001").collect()
    for r in some[:100]:
        key = hashlib.sha256(str(r.p_partkey).encode()).digest()
        address, bump = keys.derived([b"bonding-curve" + key], captures.PROGRAM)[0]
        assert (r.point, r.address, r.bump) == (point(key), name_of(address), bump)


def test_credits(spark):
    rows = [
        ("transfer", 1, "TRANSFER", [1, 2], [0, 50], [40, 10], []), ("sale", 1, "SWAP", [1, 2], [0, 50], [40, 10], [(1, -3.0), (2, 3.0)]), ("others sale", 1, "SWAP", [1, 2, 3], [0, 50, 30], [40, 30, 10], [(2, -3.0)]),
        ("no source", 1, "SWAP", [1, 2], [0, 9], [40, 9], None), ("system only", 1, None, [1, 0], [0, 90], [40, 50], []), ("small", 1, "TRANSFER", [1, 2], [0, 9], [4, 5], []), ("absent", 7, "TRANSFER", [1, 2], [0, 9], [40, 5], []),
        ("twice", 1, "SWAP", [1, 1, 2, 2], [0, 0, 20, 20], [8, 8, 12, 12], []), ("none", 1, "SWAP", [], [], [], []),
    ]
    frame = spark.createDataFrame(rows, "tx string, subject long, kind string, keys array<long>, pre array<long>, post array<long>, tokens array<struct<owner: bigint, change: double>>")
    got = {r.tx: (r.gain, r.sources, r.nature) for r in predicates.credits(frame, 1.0, 10.0, [0]).collect()}
    assert got == {
        "transfer": (40.0, [2], "financement"), "sale": (40.0, [2], "produit_de_vente"), "others sale": (40.0, [2, 3], "financement"),
        "no source": (40.0, [], "indetermine_sans_source"), "system only": (40.0, [], "indetermine_sans_source"), "twice": (16.0, [2], "financement"),
    }


def test_purchases_exits_and_peaks(spark):
    rows = [("m", 0, 9, 1e6, 1, 1.0), ("m", 0, 1, 5.0, 1, 1.0)]
    for idx, lost, got, sol in ((1, -10, 10, 1.0), (2, -10, 8.5, 1.0), (3, -10, 8.4, 1.0), (4, -1, 1.5, 1.0), (5, -10, 10, 0.0005), (6, 10, 10, 1.0), (7, -1.1, 1, 1.0)):
        rows += [("m", idx, 9, float(lost), 2, sol), ("m", idx, 2, float(got), 2, sol), ("m", idx, 3, 99.0, 2, sol)]
    changes = spark.createDataFrame(rows, "mint string, idx long, account long, change double, signer long, sol double")
    assert sorted((r.idx, r.tokens, r.price) for r in predicates.curve_purchases(changes).collect()) == [(1, 10.0, 0.1), (2, 8.5, 1 / 8.5)]
    entries = spark.createDataFrame([(k, 1000, last) for k, last in enumerate((1000, 1179, 1180, 1500, 2000, 2021))], "k int, start long, last long")
    got = [(r.safe, r.timeout, r.flag) for r in predicates.safe_exits(entries, 300).orderBy("k").collect()]
    want = []
    for last in (1000, 1179, 1180, 1500, 2000, 2021):
        safe = last - 120
        most = (safe - 1000) // 300 - 1
        want.append((safe, min(1000 + 300 * max(1, most + 1), safe), "ok") if safe >= 1060 else (None, None, "no_room"))
    assert got == want
    cases = [("ok", 5.0, 1.0), ("ok", None, 1.0), ("ok", -61.0, 1.0), ("bad", 0.0, 1.0), ("ok", 0.0, 0.0), ("ok", 0.0, None), (None, 0.0, 1.0)]
    frame = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, s string, d double, w double")
    assert [r.x for r in frame.orderBy("k").select(predicates.measurable(F.col("s"), F.col("d"), F.col("w"), 60.0).alias("x")).collect()] == [True, True, False, False, False, False, False]
    ticks = spark.createDataFrame([("a", 1, 0, 5.0), ("a", 2, 1, 9.0), ("a", 2, 2, 9.0), ("a", 7, 3, 9.0), ("b", 1, 0, 1.0)], "mint string, ts long, seq long, price double")
    assert [tuple(r) for r in predicates.peaks(ticks, 3).select("mint", "seen", "price", "peak").collect()] == [("a", 2, 9.0, 2)]


def test_splits_with_a_floor(spark):
    assert splits.greedy([(0.005, 0, "a"), (0.005, 1, "b"), (0.005, 2, "c")], 1e-4, 3600, 3, 1e-7, 0.01) == []
    assert splits.greedy([(1.0, 0, "a"), (1.5, 1, "b"), (2.0, 2, "c"), (2.01, 3, "d")], 1e-4, 3600, 3, 1.0, 0.01) == [[0, 1, 2]]
    rng = random.Random(8)
    events = [("x", f"w{rng.randrange(9)}", round(rng.uniform(0, 3), 2), rng.randrange(9000), k) for k in range(300)]
    frame = spark.createDataFrame(events, "label string, wallet string, amount double, ts long, seq long")
    got = sorted((r.amount, r.n_wallets, r.first_ts, r.span_seconds) for r in splits.split_clusters(frame, "label", 1e-3, 3600, 3, 0.015, 0.5).collect())
    rows = [(e[2], e[3], e[1]) for e in events]
    want = []
    for cluster in splits.greedy(rows, 1e-3, 3600, 3, 0.015, 0.5):
        times = [rows[k][1] for k in cluster]
        want.append((rows[cluster[0]][0], len({rows[k][2] for k in cluster}), min(times), max(times) - min(times)))
    assert got == sorted(want) and len(got) > 5


def test_unit_ratio_where_first_candles_open_at_zero(spark, tmp_path):
    """Equal to its SQL where a user's first value is zero, with and without a close of the day beside it."""
    con = duckdb.connect()
    con.execute("create table events as select k as event_id, timestamp '2024-01-01' + interval (k // 40 * 5) hour as ts, k % 40 as user_id, 'click' as event_type, case when k < 20 or k % 40 = 1 and k < 90 then 0.0 else 1 + k * 7 % 13 end::double as value, '{}' as props from range(400) r(k)")
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got, want = catalog.QUERIES["unit_ratio"](spark, str(tmp_path)).first(), con.execute(catalog.SQL["unit_ratio"]).fetchone()
    assert tuple(got) == pytest.approx(want) and 0 < want[0] < 20
