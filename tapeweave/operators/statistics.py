"""Inference on small tables of counts, resampling, and regressions."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.special import hypergeometric_tails
from tapeweave.operators.meetings import changes, whole_cells
from tapeweave.operators.order import value_ranks
from tapeweave.operators.sequence import independent


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if 0 <= k <= n else -math.inf


def hypergeometric_tail(hits: int, good: int, total: int, drawn: int) -> float:
    """The chance of `hits` or more good ones among those drawn without replacement."""
    whole = log_choose(total, drawn)
    return min(1.0, math.fsum(math.exp(log_choose(good, k) + log_choose(total - good, drawn - k) - whole) for k in range(max(hits, 0), min(good, drawn) + 1)))


def fisher(a: int, b: int, c: int, d: int) -> tuple[float, float]:
    """One-sided (a or more) and two-sided exact tests of a 2 x 2 table."""
    row, column, total = a + b, a + c, a + b + c + d
    whole = log_choose(total, column)
    chance = {k: math.exp(log_choose(row, k) + log_choose(total - row, column - k) - whole) for k in range(max(0, column - (c + d)), min(row, column) + 1)}
    return hypergeometric_tail(a, row, total, column), min(1.0, math.fsum(p for p in chance.values() if p <= chance[a] * 1.000001))


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """Exact interval of a share, by bisection."""

    def at_least(p: float) -> float:
        return math.fsum(math.exp(log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))

    def at_most(p: float) -> float:
        return math.fsum(math.exp(log_choose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))

    def root(f, rising: bool) -> float:
        low, high = 1e-12, 1 - 1e-12
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (f(mid) < alpha / 2) == rising else (low, mid)
        return (low + high) / 2

    return (0.0 if k == 0 else root(at_least, True)), (1.0 if k == n else root(at_most, False))


def exact_tests(tables: DataFrame) -> DataFrame:
    """Rows of key, a, b, c, d (2 x 2 tables) with exact tests and the interval of a / (a + b)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [(r.key, *fisher(r.a, r.b, r.c, r.d), *clopper_pearson(r.a, r.a + r.b)) for r in p.itertuples()]
            yield pd.DataFrame(out, columns=["key", "p_greater", "p_two_sided", "low", "high"])

    return tables.select("key", "a", "b", "c", "d").mapInPandas(run, "key string, p_greater double, p_two_sided double, low double, high double")


def pair_significance(members: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """Pairs of items, the groups they share, and the chance p that independent items share as many or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            p = hypergeometric_tails(*(x.column(c).to_numpy() for c in ("shared", "n_a", "total", "n_b")))
            yield pa.record_batch([*(x.column(c) for c in ("a", "b", "shared")), pa.array(p)], ["a", "b", "shared", "p"])

    kind = members.schema[item].dataType.simpleString()
    return independent(members, group, item, most).mapInArrow(run, f"a {kind}, b {kind}, shared long, p double")


def mantel_haenszel_chi_square() -> Column:
    """The continuity-corrected statistic over strata with counts a, b, c, d."""
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    some = n > 1
    gap = F.sum(F.when(some, a - F.try_divide((a + b) * (a + c), n)))
    spread = F.sum(F.when(some, F.try_divide((a + b) * (c + d) * (a + c) * (b + d), n * n * (n - 1))))
    return F.try_divide(F.pow(F.abs(gap) - 0.5, F.lit(2)), spread)


def drawn_groups(wallets: DataFrame, sizes: tuple[int, ...], draws: int, seed: int) -> DataFrame:
    """wallet and round (the size's place times draws, plus the draw) of seeded draws without replacement; sizes beyond
    the number of wallets are left out. Draws are of places in the sorted wallets, joined to them by place."""
    spark = wallets.sparkSession
    ranks = value_ranks(wallets.where("wallet is not null").select(F.lit(0).alias("all"), "wallet").distinct(), ["all"], "wallet")
    numbered = ranks.select("wallet", F.col("start").alias("at")).checkpoint()
    total = numbered.count()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = [(k, r) for r in p["id"] if sizes[r // draws] <= total for k in random.Random(f"{seed}-{r}").sample(range(total), sizes[r // draws])]
            yield pd.DataFrame(out, columns=["at", "round"]).astype("int64")

    return spark.range(len(sizes) * draws).mapInPandas(run, "at long, round long").join(numbered, "at").select("wallet", "round")


class Rounds:
    """Each drawn wallet's rounds; wallets by number."""

    def __init__(self, wallet: np.ndarray, of: np.ndarray, n: int) -> None:
        self.of, self.n = of[np.argsort(wallet, kind="stable")], n
        self.upto = np.concatenate([[0], np.cumsum(np.bincount(wallet, minlength=1))])

    def spread(self, wallet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `wallet`, each as often as its wallet was drawn, and the rounds."""
        size = self.upto[wallet + 1] - self.upto[wallet]
        at = np.repeat(np.arange(len(wallet)), size)
        first = np.cumsum(size) - size
        return at, self.of[np.arange(len(at)) - first[at] + self.upto[wallet][at]]

    def pieces(self, wallet: np.ndarray, group: np.ndarray, most: int = 4_000_000) -> Iterator[slice]:
        """Runs of whole groups that spread to some `most` rows, or one group."""
        spread = np.cumsum(self.upto[wallet + 1] - self.upto[wallet])
        ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
        at = 0
        while at < len(group):
            before = spread[at - 1] if at else 0
            k = int(np.searchsorted(spread[ends - 1], before + most, "right")) - 1
            end = int(ends[max(k, int(np.searchsorted(ends, at, "right")))])
            yield slice(at, end)
            at = end


def rounds_shared(events: DataFrame, key: str, rounds: Broadcast) -> DataFrame:
    """Rounds that drew two wallets or more of one key. events: the key and w, a drawn wallet's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = rounds.value
        fired = np.zeros(x.n, bool)
        for rows in whole_cells(batches, 0):
            new, w = changes(rows, 0), rows["w"].to_numpy()
            group = np.cumsum(new)
            first = np.append(True, (np.diff(w) != 0) | new[1:])
            group, w = group[first], w[first]
            several = np.bincount(group)[group] > 1
            group, w = group[several], w[several]
            for part in x.pieces(w, group):
                at, of = x.spread(w[part])
                code = np.sort(group[part][at] * x.n + of)
                fired[code[1:][code[1:] == code[:-1]] % x.n] = True
        yield pa.record_batch([pa.array(np.flatnonzero(fired).astype(np.int64))], ["round"])

    dealt = events.where(F.col(key).isNotNull()).select(F.col(key).alias("_cell"), "w").repartition("_cell").sortWithinPartitions("_cell", "w")
    return dealt.mapInArrow(run, "round long").distinct()


def rounds_of_near_amounts(events: DataFrame, tolerance: float, window: int, least: int, rounds: Broadcast) -> DataFrame:
    """Rounds in which a drawn wallet's payment gathers those of other wallets of the round so that `least` wallets take part: later
    ones in order of (amount, seq), within the tolerance above its amount and the window around its time. events: w (a drawn
    wallet's number), amount, ts and seq.

    Cells of time and of the amount's logarithm are wide, and what lies at a cell's edge is sent to its neighbour too. What could
    be in a group is spread over its wallets' rounds, and only rows of one round are compared."""
    wide, many = 24 * window, 512
    bin = F.floor(F.ln("amount") / F.log1p(F.lit(tolerance)))
    at, edge = F.col("ts") + 12 * window, F.pmod(F.col("ts") + 12 * window, F.lit(wide))
    time = F.floor(at / wide)
    times = F.array_compact(F.array(time, F.when(edge <= window, time - 1), F.when(edge >= wide - window, time + 1)))
    upper = F.floor(bin / many)
    amounts = F.array_compact(F.array(upper, F.when(F.pmod(bin, F.lit(many)) <= 1, upper - 1)))
    cells = events.where("amount > 0 and ts is not null").select("w", "amount", "ts", "seq", time.alias("t"), upper.alias("u"), F.explode(times).alias("_cell"), amounts.alias("us"))
    cells = cells.select("w", "amount", "ts", "seq", "t", "u", "_cell", F.explode("us").alias("_by0")).withColumn("own", (F.col("t") == F.col("_cell")) & (F.col("u") == F.col("_by0"))).drop("t", "u")
    dealt = cells.repartition("_cell", "_by0").sortWithinPartitions("_cell", "_by0", "amount", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = rounds.value
        fired = np.zeros(x.n, bool)
        for rows in whole_cells(batches, 1):
            group = np.cumsum(changes(rows, 1))
            amount, ts, w, own, seq = (rows[c].to_numpy() for c in ("amount", "ts", "w", "own", "seq"))
            kept = could_be(group, amount, own, tolerance, least)
            group, amount, ts, w, own, seq = (c[kept] for c in (group, amount, ts, w, own, seq))
            for part in x.pieces(w, group):
                place, of = x.spread(w[part])
                code = group[part][place] * x.n + of
                order = np.argsort(code, kind="stable")
                code, place, of = code[order], place[order], of[order]
                a, t, v, o, s = (c[part][place] for c in (amount, ts, w, own, seq))
                again = could_be(code, a, o, tolerance, least)
                code, of, a, t, v, o, s = (c[again] for c in (code, of, a, t, v, o, s))
                seeds, step, found = np.flatnonzero(o), 1, []
                while len(seeds := seeds[seeds + step < len(code)]):
                    seeds = seeds[(code[seeds + step] == code[seeds]) & (a[seeds + step] <= a[seeds] * (1 + tolerance))]
                    other = seeds + step
                    good = (np.abs(t[other] - t[seeds]) <= window) & (v[other] != v[seeds]) & ((a[other] > a[seeds]) | (s[other] > s[seeds]))
                    found.append(seeds[good] * len(x.upto) + v[other[good]])
                    step += 1
                if found:
                    met_by = np.bincount(np.unique(np.concatenate(found)) // len(x.upto))  # each wallet once
                    fired[of[np.flatnonzero(met_by >= max(least - 1, 1))]] = True
        yield pa.record_batch([pa.array(np.flatnonzero(fired).astype(np.int64))], ["round"])

    return dealt.mapInArrow(run, "round long").distinct()


def could_be(group: np.ndarray, amount: np.ndarray, own: np.ndarray, tolerance: float, least: int) -> np.ndarray:
    """Rows of groups, in order of amounts, that are within the tolerance above a seed that has `least` - 1 rows there."""
    n, far = len(group), max(least - 1, 1)
    seed = np.zeros(n, bool)
    if n > far:
        seed[:-far] = own[:-far] & (group[far:] == group[:-far]) & (amount[far:] <= amount[:-far] * (1 + tolerance))
    last = np.maximum.accumulate(np.where(seed, np.arange(n), -1)) if n else np.empty(0, np.int64)
    return (last >= 0) & (group[last] == group) & (amount <= amount[last] * (1 + tolerance)) if n else seed


def null_model(events: DataFrame, sizes: tuple[int, ...], draws: int, seed: int, tolerance: float = 1e-4, window: int = 3600, least: int = 3) -> DataFrame:
    """size and the shares of draws of that many wallets in which each criterion of the detector fires: two wallets share
    a transaction; `least` wallets are paid nearly equal amounts within the window; two wallets share a source; any of
    these. events: wallet, source, sig, amount, ts and seq. Sizes beyond the number of wallets are left out.

    What is sent to tasks is the wallets drawn, as many as the sizes and draws say, whatever the table."""
    spark = events.sparkSession
    drawn = drawn_groups(events, sizes, draws, seed).toPandas()
    number, wallets = pd.factorize(drawn["wallet"])
    of = drawn["round"].to_numpy(np.int64)
    rounds = spark.sparkContext.broadcast(Rounds(number, of, len(sizes) * draws))
    numbered = spark.createDataFrame([(w, k) for k, w in enumerate(wallets.tolist())], f"wallet {events.schema['wallet'].dataType.simpleString()}, w long")
    some = events.join(F.broadcast(numbered), "wallet")  # the wallets drawn
    criteria = {"transaction": rounds_shared(some, "sig", rounds), "amount": rounds_of_near_amounts(some, tolerance, window, least, rounds), "source": rounds_shared(some, "source", rounds)}
    fired = None
    for name, found in criteria.items():
        one = found.select("round", F.lit(name).alias("criterion"))
        fired = one if fired is None else fired.union(one)
    place = F.floor(F.col("round") / draws)
    sums = fired.groupBy("round").agg(F.collect_set("criterion").alias("c")).groupBy(place.alias("place")).agg(*(F.count_if(F.array_contains("c", n)).alias(n) for n in criteria), F.count("*").alias("any"))
    tried = spark.createDataFrame([(k, n) for k, n in enumerate(sizes) if n <= (of // draws == k).sum()], "place long, size int")
    return tried.join(sums, "place", "left").select("size", *((F.coalesce(c, F.lit(0)) / draws).alias(c) for c in (*criteria, "any")))


def demeaned_slope(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """slope and n of y on x, both less their means within `by`."""
    w = Window.partitionBy(by)
    d = rows.select((F.col(x) - F.avg(x).over(w)).alias("dx"), (F.col(y) - F.avg(y).over(w)).alias("dy"))
    return d.agg((F.sum(F.col("dx") * F.col("dy")) / F.sum(F.col("dx") * F.col("dx"))).alias("slope"), F.count("*").alias("n"))
