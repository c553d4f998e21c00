"""Special functions as column expressions: log gamma, binomials, hypergeometric tails, exact tests and the normal tail."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_gamma(x: Column) -> Column:
    """For x >= 1, by Stirling's series eight steps further up."""

    def series(x: Column) -> Column:
        z, product = x + 8, x
        for k in range(1, 8):
            product = product * (x + k)
        w = 1 / (z * z)
        more = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z
        return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + more - F.ln(product)

    return let(x.cast("double"), series)


def log_choose(n: Column, k: Column) -> Column:
    """For 0 <= k <= n."""
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def hypergeometric(k: Column, good: Column, total: Column, drawn: Column) -> Column:
    """The chance of k good ones among those drawn without replacement."""
    return F.exp(log_choose(good, k) + log_choose(total - good, drawn - k) - log_choose(total, drawn))


def hypergeometric_sum(good: Column, total: Column, drawn: Column, keep) -> Column:
    """The sum of the chances of those k for which keep(k, chance) holds. Chances go out from the likeliest k by their ratios,
    so that only one is a matter of logarithms and none that counts is lost to underflow."""
    rest = total - good - drawn
    low, high = F.greatest(F.lit(0), -rest).cast("long"), F.least(good, drawn).cast("long")
    middle = F.least(high, F.greatest(low, F.floor((drawn + 1).cast("double") * (good + 1) / (total + 2))))
    none = F.array().cast("array<bigint>")
    some = lambda k, p: F.when(keep(k, p), p).otherwise(0.0)

    def run(peak: Column, steps: Column, ratio) -> Column:
        def step(s: Column, k: Column) -> Column:
            return let(s["p"] * ratio(k.cast("double")), lambda p: F.struct(p.alias("p"), (s["sum"] + some(k, p)).alias("sum")))

        return F.aggregate(steps, F.struct(peak.alias("p"), F.lit(0.0).alias("sum")), step)["sum"]

    def out(x: Column) -> Column:
        mode, peak = x["mode"], x["peak"]
        up, down = F.when(mode < high, F.sequence(mode + 1, high)).otherwise(none), F.when(mode > low, F.sequence(mode - 1, low)).otherwise(none)
        upward = run(peak, up, lambda k: (good - k + 1) * (drawn - k + 1) / (k * (rest + k)))
        return some(mode, peak) + upward + run(peak, down, lambda k: (k + 1) * (rest + k + 1) / ((good - k) * (drawn - k)))

    return let(middle, lambda mode: let(F.struct(mode.alias("mode"), hypergeometric(mode, good, total, drawn).alias("peak")), out))


def hypergeometric_tail(hits: Column, good: Column, total: Column, drawn: Column) -> Column:
    """The chance of `hits` or more."""
    return F.least(F.lit(1.0), hypergeometric_sum(good, total, drawn, lambda k, p: k >= hits))


def log_gammas(x: np.ndarray) -> np.ndarray:
    """log_gamma in numpy."""
    z, product = x + 8, x.copy()
    for k in range(1, 8):
        product *= x + k
    w = 1 / (z * z)
    more = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + more - np.log(product)


def hypergeometric_tails(hits: np.ndarray, good: np.ndarray, total: np.ndarray, drawn: np.ndarray) -> np.ndarray:
    """The chances of `hits` or more, of many cases at once. Terms go out from `hits` by their ratios, or below it if that is the
    likeliest or less, until none adds a digit to its sum."""
    hits, good, total, drawn = (x.astype(float) for x in (hits, good, total, drawn))
    rest = total - good - drawn
    low, high = np.maximum(0, -rest), np.minimum(good, drawn)
    up = hits > (drawn + 1) * (good + 1) / (total + 2)
    k = np.where(up, hits, hits - 1)
    out = np.where(up, 0.0, 1.0)
    at = np.flatnonzero((k >= low) & (k <= high))
    k, up, good, drawn, rest, total = (x[at] for x in (k, up, good, drawn, rest, total))
    choose = lambda n, k: log_gammas(n + 1) - log_gammas(k + 1) - log_gammas(n - k + 1)
    term = np.exp(choose(good, k) + choose(total - good, drawn - k) - choose(total, drawn))
    sign = np.where(up, 1.0, -1.0)
    while len(at):
        out[at] += sign * term
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(up, (good - k) * (drawn - k) / ((k + 1) * (rest + k + 1)), k * (rest + k) / ((good - k + 1) * (drawn - k + 1)))
        term, k = term * ratio, k + sign
        go = (term > 0) & (term > 1e-18 * np.abs(out[at]))
        at, k, up, good, drawn, rest, term, sign = (x[go] for x in (at, k, up, good, drawn, rest, term, sign))
    return np.clip(out, 0.0, 1.0)


def fisher(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """Exact tests of a 2 x 2 table: a or more; and two-sided, over tables no likelier than this one within a millionth of
    its chance, or within 1e-12."""
    row, column, total = a + b, a + c, a + b + c + d
    here = hypergeometric(a, row, total, column)
    two = (let(most, lambda most: hypergeometric_sum(row, total, column, lambda k, p: p <= most)) for most in (here * 1.000001, here + 1e-12))
    return hypergeometric_tail(a, row, total, column), *(F.least(F.lit(1.0), p) for p in two)


def erfc(x: Column) -> Column:
    """The complementary error function: a series of positive terms under 2, a continued fraction from there on."""
    y = F.abs(x.cast("double"))
    steps = F.sequence(F.lit(1), F.lit(70))
    first = F.struct(y.alias("term"), y.alias("sum"))

    def grown(s: Column, n: Column) -> Column:
        term = s["term"] * 2 * y * y / (2 * n + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-y * y) * F.aggregate(steps, first, grown)["sum"]
    below = F.aggregate(F.reverse(steps), y, lambda f, n: y + n / 2 / f)
    far = F.exp(-y * y) / math.sqrt(math.pi) / below
    tail = F.when(y < 2, near).otherwise(far)
    return F.when(x < 0, 2 - tail).otherwise(tail)


def chi_square_p(x: Column) -> Column:
    """The chance of a chi-square of one degree at least as large."""
    return erfc(F.sqrt(x / 2))
