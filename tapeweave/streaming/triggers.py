"""Triggers as streams: decide at a bucket, execute at the next.

State is kept by mint in the RocksDB store: the highest price so far, what was decided, and the buckets that the
watermark hasn't passed yet. A timer at the earliest of those makes sure that buckets are looked at in order of time,
whatever order they arrive in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: What a trigger gives out: a decision at k with its price, and the execution at the next bucket with that one's.
DECISION = "what string, k long, price double"
WAITING, DECIDED, DONE = 0, 1, 2


class TrailingStop(StatefulProcessor):
    """Decides at the first bucket whose price is `drop` under the highest before it. Buckets without a price are passed
    over; the execution is at the bucket after the decision's in order of time, whatever its price."""

    def __init__(self, drop: float) -> None:
        self.drop = drop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.path = handle.getValueState("path", "peak double, stage int")
        self.ahead = handle.getListState("ahead", "ms long, k long, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t.value // 1_000_000), int(k), None if pd.isna(p) else float(p)) for part in rows for t, k, p in zip(part["time"], part["k"], part["price"]) if not pd.isna(k)]
        if new and (not self.path.exists() or self.path.get()[1] != DONE):
            held = list(self.ahead.get()) if self.ahead.exists() else []
            first = min(new)[0]
            if not held or first < min(x[0] for x in held):
                self.handle.registerTimer(first)
            self.ahead.appendList(new)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(x) for x in self.ahead.get()), key=lambda x: x[:2]) if self.ahead.exists() else []
        peak, stage = self.path.get() if self.path.exists() else (None, WAITING)
        out, at = [], 0
        while at < len(held) and held[at][0] <= now and stage != DONE:
            _, k, price = held[at]
            at += 1
            if stage == DECIDED:
                out.append((*key, "execute", k, price))
                stage = DONE
            elif price is not None and peak is not None and price <= peak * (1 - self.drop):
                out.append((*key, "decide", k, price))
                stage = DECIDED
            elif price is not None:
                peak = price if peak is None else max(peak, price)
        self.path.update((peak, stage))
        left = [] if stage == DONE else held[at:]
        if left:
            self.ahead.put(left)
            self.handle.registerTimer(left[0][0])
        else:
            self.ahead.clear()
        yield pd.DataFrame(out, columns=["mint", "what", "k", "price"])

    def close(self) -> None:
        pass


def trailing_stop_stream(prices: DataFrame, drop: float, late: str = "1 hour") -> DataFrame:
    """mint, what (decide or execute), k and price, as a stream in append mode; at most two rows for each mint.

    prices: mint, time, k and price, k rising with time within a mint. Rows later than the watermark, or without k, don't count. A row is
    looked at when the watermark has passed it: a tape ends with a row of a mint of its own that is later than all
    others (see `replay.replayed`). State is a row for each mint and its buckets ahead of the watermark; what is done keeps its
    stage alone."""
    kind = prices.schema["mint"].dataType.simpleString()
    schema = StructType.fromDDL(f"mint {kind}, {DECISION}")
    keyed = prices.select("mint", "time", "k", "price").withWatermark("time", late).groupBy("mint")
    return keyed.transformWithStateInPandas(statefulProcessor=TrailingStop(drop), outputStructType=schema, outputMode="Append", timeMode="EventTime")
