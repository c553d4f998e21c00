"""Tape operators: gates, robust prices, depth, marks, triggers and round trips."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions.columns import round_trip
from tapeweave.operators.meetings import Met, chosen, medians, met, or_null, ranks, reached, sums


def clean(swaps: DataFrame) -> DataFrame:
    """Usable swaps, with their price."""
    return swaps.where("ts is not null and tokens > 0 and sol > 0 and side in ('buy', 'sell')").withColumn("price", F.col("sol") / F.col("tokens"))


def gate(swaps: DataFrame, floor: float, least_span: int) -> DataFrame:
    """mint and the first of the ordered reasons to reject it, or ok."""
    good = "ts is not null and tokens > 0 and sol > 0"
    sums = swaps.groupBy("mint").agg(
        F.expr(f"count_if({good})").alias("usable"), F.expr(f"max(ts) filter (where {good}) - min(ts) filter (where {good})").alias("span"),
        F.expr(f"count_if({good} and side = 'buy')").alias("buys"), F.expr(f"count_if({good} and sol >= {floor})").alias("large"),
    )
    reason = F.when(F.col("usable") == 0, "no_usable_swap").when(F.col("span") < least_span, "short_span").when(F.col("buys") == 0, "no_buy").when(F.col("large") == 0, "no_large_swap")
    return sums.select("mint", reason.otherwise("ok").alias("status"))


def robust_price(swaps: DataFrame, floor: float, width: int) -> DataFrame:
    """mint, bucket, median price and trades of large swaps, by buckets from a mint's first large swap."""
    large = swaps.where(F.col("sol") >= floor)
    first = large.groupBy("mint").agg(F.min("ts").alias("base"))
    bucket = F.floor((F.col("ts") - F.col("base")) / width).cast("bigint")
    return large.join(first, "mint").groupBy("mint", bucket.alias("bucket")).agg(F.median("price").alias("price"), F.count("*").alias("trades"))


def in_windows(probes: DataFrame, ticks: DataFrame, columns: list[str], width: int, order: list[str], more: str, measure) -> DataFrame:
    """probes (mint, t and others) with what `measure` gives (see meetings.met) from the ticks of their mint; ticks from t to
    t + width are among those it gets, in order of ts and `order`."""
    asked = probes.withColumnRenamed("t", "ts")
    found = met(asked, ticks.select("mint", "ts", *columns), ["mint"], width, (-1, 0), order, more, measure)
    return found.withColumnRenamed("ts", "t")


def volumes(probes: DataFrame, ticks: DataFrame, width: int) -> DataFrame:
    """mint, t, trades and volume of the ticks from t to before t + width; probes without any are left out."""

    def measure(x: Met) -> list:
        low, high = x.since(0), x.since(width)
        return [high - low, sums(np.nan_to_num(x.numbers("_r_sol")), low, high)]

    return in_windows(probes, ticks, ["sol"], width, [], "trades long, volume double", measure).where("trades > 0")


def depth(probes: DataFrame, ticks: DataFrame, side: str, position: float, width: int) -> DataFrame:
    """mint, t, price at which the position is filled and status, walking the window's ticks from the best price: thin
    if they don't suffice (the last price), unfillable if there are none. Sales walk down the bids, purchases up the
    asks; bids count up to the window's end. Other columns of the probes stay in front."""
    bid = side == "bid"

    def measure(x: Met) -> list:
        low, high = x.since(0), x.since(width + 1 if bid else width)
        price, some = x.numbers("_r_price"), high > low
        rank, order = ranks(price, down=bid)
        hit = reached(rank, np.nan_to_num(x.numbers("_r_sol")), low, high, position)
        worst = np.zeros(len(low), np.int64)
        worst[some] = chosen(rank, low[some], high[some], (high - low)[some] - 1)
        at = np.where(hit < 0, worst, hit)
        known = np.full(len(low), np.nan)
        known[some] = price[order[at[some]]]
        return [or_null(known), np.where(~some, "unfillable", np.where(hit < 0, "thin", "ok"))]

    return in_windows(probes, ticks, ["price", "sol", "seq"], width, ["seq"], "price double, status string", measure)


def market_mark(probes: DataFrame, ticks: DataFrame, widths: tuple[int, ...] = (30, 60, 120), floor: float = 0.0) -> DataFrame:
    """mint, t and the median price of the shortest window that has ticks of the floor or more; null if none has."""

    def measure(x: Met) -> list:
        out, low = np.full(len(x.left), np.nan), x.since(0)
        for found in medians(x.numbers("_r_price"), [(low, x.since(w)) for w in widths]):
            out = np.where(np.isnan(out), found, out)
        return [or_null(out)]

    return in_windows(probes, ticks.where(F.col("sol") >= floor) if floor else ticks, ["price"], max(widths), [], "mark double", measure)


def entry_gate(probes: DataFrame, ticks: DataFrame, position: float, width: int, large: float, depth_least: float, margin: int) -> DataFrame:
    """mint, t, the first of the ordered reasons against an entry (or ok), the price of an entry (the higher of price and
    ask), safe (the last time of an exit) and timeout (the time of the last bucket's exit).

    Price and volume are the median price and the sum of swaps of `large` or more in the bucket of `width` from t. Asks are
    sales of `depth_least` or more in it; a thin one takes the worst price, only none at all is a reason. safe is `margin`
    before the mint's last tick, and an entry needs a minute before it."""
    ended = ticks.groupBy("mint").agg(F.max("ts").alias("ended"))

    def measure(x: Met) -> list:
        low, high = x.since(0), x.since(width)
        (price,) = medians(x.numbers("_r_price"), [(low, high)])
        return [or_null(price), pa.array(sums(x.numbers("_r_sol"), low, high), mask=low == high)]

    near = in_windows(probes, ticks.where(F.col("sol") >= large), ["price", "sol"], width, [], "large_price double, volume double", measure)
    asks = ticks.where((F.col("side") == "sell") & (F.col("sol") >= depth_least) & F.col("price").isNotNull())
    ask = depth(near, asks, "ask", position, width).withColumnRenamed("price", "ask").withColumnRenamed("large_price", "price")
    x = ask.join(ended, "mint")
    safe = F.col("ended") - margin
    reason = F.when(F.col("t") >= F.col("ended"), "after_end").when(F.col("price").isNull(), "no_price").when(F.col("volume") < position, "thin_volume")
    reason = reason.when(F.col("ask").isNull(), "no_ask").when(safe < F.col("t") + 60, "no_room").otherwise("ok")
    buckets = F.greatest(F.lit(1), F.floor((safe - F.col("t")) / width))
    entry = lambda c: F.when(F.col("gate") == "ok", c)
    out = x.select("mint", "t", reason.alias("gate"), F.greatest("price", "ask").alias("entry"), safe.alias("safe"), F.least(F.col("t") + width * buckets, safe).alias("timeout"))
    return out.select("mint", "t", "gate", *(entry(F.col(c)).alias(c) for c in ("entry", "safe", "timeout")))


def trailing_stop(path: DataFrame, drop: float) -> DataFrame:
    """mint and the first k at which the price is `drop` under the highest before it; it executes at k + 1."""
    before = Window.partitionBy("mint").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    hit = path.withColumn("peak", F.max("price").over(before)).where(F.col("price") <= F.col("peak") * (1 - drop))
    return hit.groupBy("mint").agg(F.min("k").alias("fires"), (F.min("k") + 1).alias("executes"))


def first_exit(path: DataFrame, take: float, stop: float) -> DataFrame:
    """mint, the first k at which the price is `take` times the entry's (k = 0) or falls to `stop` times it, and which;
    taking profit comes first within a k. The exit is priced at k + 1; pnl is null if the path ends before."""
    start = path.where(F.col("k") == 0).select("mint", F.col("price").alias("entry"))
    ahead = path.withColumn("exit", F.lead("price").over(Window.partitionBy("mint").orderBy("k")))
    at = ahead.where(F.col("k") > 0).join(start, "mint")
    which = F.when(F.col("price") >= F.col("entry") * take, 0).when(F.col("price") <= F.col("entry") * stop, 1)
    first = at.where(which.isNotNull()).groupBy("mint").agg(F.min_by(F.struct("k", which.alias("which"), "exit", "entry"), "k").alias("x"))
    return first.select("mint", F.col("x.k").alias("fires"), F.when(F.col("x.which") == 0, "take").otherwise("stop").alias("reason"), round_trip(F.col("x.entry"), F.col("x.exit")).alias("pnl"))


def staged_exit(path: Column, ladder: tuple[tuple[float, float], ...]) -> Column:
    """Proceeds of selling shares at multiples of the entry (the array's first price), and the rest at the last."""
    sold, out = F.lit(0.0), F.lit(0.0)
    for rung, share in ladder:
        part = F.when(F.array_max(path) >= path[0] * rung, share).otherwise(0.0)
        out, sold = out + part * rung, sold + part
    return out + (1 - sold) * F.element_at(path, -1) / path[0]
