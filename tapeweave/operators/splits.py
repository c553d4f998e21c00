"""Splits: clusters of nearly equal amounts paid to several wallets within a short time."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def greedy(events: list[tuple[float, int, str]], tolerance: float, window: int, least: int, floor: float = 0.0, smallest: float | None = None) -> list[list[int]]:
    """Positions of each cluster's events. In order of amounts, each event not yet in a cluster gathers later ones of
    wallets other than its own within the tolerance above its amount and the window around its time; they become a
    cluster if `least` wallets take part, else all stay free. The tolerance is no narrower than `floor`, and amounts up to
    `smallest` gather nothing. Events that are in a cluster, or far off in time, are passed over unseen."""
    order = sorted(range(len(events)), key=lambda k: events[k][0])
    amounts = [events[k][0] for k in order]
    cells: dict[int, list[int]] = {}  # places in order, by cells of the window's width in time
    slot = [0] * len(order)
    for place, k in enumerate(order):
        cell = cells.setdefault(events[k][1] // (window + 1), [])
        slot[place] = len(cell)
        cell.append(place)
    ahead = {c: list(range(len(x) + 1)) for c, x in cells.items()}  # the next slot of a cell that isn't in a cluster

    def free_from(skip: list[int], at: int) -> int:
        end = at
        while skip[end] != end:
            end = skip[end]
        while skip[at] != end:
            skip[at], at = end, skip[at]
        return end

    out = []
    for place, seed in enumerate(order):
        amount, ts, wallet = events[seed]
        here = ts // (window + 1)
        if ahead[here][slot[place]] != slot[place] or smallest is not None and amount <= smallest:
            continue
        reach, taken = max(amount * tolerance, floor), [place]
        for c in (here - 1, here, here + 1):
            if (cell := cells.get(c)) is None:
                continue
            skip, n = ahead[c], len(cell)
            at = free_from(skip, slot[place] + 1 if c == here else bisect_right(cell, place))
            while at < n and amounts[k := cell[at]] - amount <= reach:
                _, other, name = events[order[k]]
                if abs(other - ts) <= window and name != wallet:
                    taken.append(k)
                at = free_from(skip, at + 1)
        if len(taken) >= least and len({events[order[k]][2] for k in taken}) >= least:
            taken.sort()
            for k in taken:
                ahead[events[order[k]][1] // (window + 1)][slot[k]] = slot[k] + 1
            out.append([order[k] for k in taken])
    return out


def split_clusters(events: DataFrame, label: str, tolerance: float = 1e-4, window: int = 3600, least: int = 3, floor: float = 0.0, smallest: float | None = None) -> DataFrame:
    """label, amount (to nine decimals), n_wallets, wallets, first_ts, span_seconds and date of each cluster. events: label,
    wallet, amount, ts and seq, which settles ties.

    A label is cut where neighbouring amounts differ by more than the tolerance, which no cluster spans; its rows come sorted to a
    task, which searches one piece after the other. Rows without a label, an amount or a time are in no cluster."""
    names = [label, "amount", "n_wallets", "wallets", "first_ts", "span_seconds", "date"]

    def found(piece: pa.Table) -> list[tuple]:
        amounts, times, wallets = (piece[c].to_pylist() for c in ("amount", "ts", "wallet"))
        out = []
        for c in greedy(list(zip(amounts, times, wallets)), tolerance, window, least, floor, smallest):
            when, who = [times[k] for k in c], sorted({wallets[k] for k in c})
            first = min(when)
            out.append((piece["label"][0].as_py(), round(amounts[c[0]], 9), len(who), who, first, max(when) - first, pd.Timestamp(first, unit="s").strftime("%Y-%m-%d")))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            part = pa.Table.from_batches([batch])
            of, amount = part["label"].to_pylist(), part["amount"].to_numpy()
            if last:
                amount = np.concatenate([[last[1]], amount])
                of = [last[0], *of]
            cut = np.diff(amount) > np.maximum(amount[:-1] * tolerance, floor)
            cut |= np.array([x != y for x, y in zip(of, of[1:])], bool)
            at, rows = 0, []
            for end in (np.flatnonzero(cut) + (0 if last else 1)).tolist():
                piece = pa.concat_tables([*held, part.slice(at, end - at)])
                rows += found(piece) if len(piece) >= least else []
                held, at = [], end
            held.append(part.slice(at))
            last = (of[-1], float(amount[-1]))
            yield from given(rows)
        if held and sum(map(len, held)) >= least:
            yield from given(found(pa.concat_tables(held)))

    def given(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 1000):
            part = list(zip(*rows[at : at + 1000]))
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(part, arrow.types)], names)

    kinds = {f.name: f.dataType for f in events.schema.fields}
    schema = StructType.fromDDL(f"{label} {kinds[label].simpleString()}, amount double, n_wallets int, wallets array<{kinds['wallet'].simpleString()}>, first_ts long, span_seconds long, date string")
    arrow = to_arrow_schema(schema)
    rows = events.select(F.col(label).alias("label"), "wallet", F.col("amount").cast("double").alias("amount"), "ts", "seq").dropna(subset=["label", "amount", "ts"])
    return rows.repartition("label").sortWithinPartitions("label", "amount", "seq").drop("seq").mapInArrow(run, schema)
