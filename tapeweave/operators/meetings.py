"""Rows met by many others in time, without a row for each pair: sums, order statistics and walks of windows that overlap.

Both sides are dealt out by cells of a key and of time and come sorted; what a left row meets is a run of the right rows of its
cell. Order statistics of all runs are found side by side by a wavelet matrix, a pass for each bit of the rows' ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Rows that one step of a task works on at once, if a cell has no more.
STEP_ROWS = 1 << 18


class Met:
    """Left and right rows of some cells; right rows are in order within their cell."""

    def __init__(self, rows: pa.Table, by: int, width: int) -> None:
        cell, left = rows["_cell"].combine_chunks(), rows["_left"].to_numpy()
        new = changes(rows, by)
        number = np.cumsum(new) - 1
        at = pc.fill_null(rows["_ts"], 0).to_numpy() - pc.fill_null(cell, 0).to_numpy() * width
        self.stride, self.width = 8 * width + 8, width
        code = number * self.stride + np.clip(at, -width, 2 * width) + 2 * width
        self.left, self.right = rows.filter(pa.array(left)), rows.filter(pa.array(~left))
        self.asked, self.held, self.first = code[left], code[~left], number[left] * self.stride
        self.n = len(self.held)

    def since(self, delta: int) -> np.ndarray:
        """For each left row, the place of the first right row of its cell at its time plus delta or later."""
        return np.searchsorted(self.held, np.clip(self.asked + delta, self.first, self.first + self.stride - 1))

    def numbers(self, column: str) -> np.ndarray:
        """A column of the right rows; null is NaN."""
        return self.right[column].cast(pa.float64()).to_numpy()


def changes(rows: pa.Table, by: int) -> np.ndarray:
    """Where a row's cell isn't that of the row before."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for c in ("_cell", *(f"_by{k}" for k in range(by))):
        code = pc.fill_null(rows[c].combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


def whole_cells(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.Table]:
    """Tables of whole cells, of some STEP_ROWS rows or of one cell that has more."""
    held: list[pa.Table] = []
    count, due = 0, STEP_ROWS
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        count += len(batch)
        if count >= due:
            rows = pa.concat_tables(held)
            if cut := int(np.flatnonzero(changes(rows, by))[-1]):
                yield rows.slice(0, cut)
                rows = rows.slice(cut)
            held, count = [rows], len(rows)
            due = max(STEP_ROWS, 2 * count)
    if count:
        yield pa.concat_tables(held)


def met(left: DataFrame, right: DataFrame, by: list[str], width: int, around: tuple[int, ...], order: list[str], more: str, measure: Callable[[Met], list]) -> DataFrame:
    """left with the columns `more`, which measure gives from the right rows of each left row's cell: those whose time, in
    cells of `width`, lies as many cells before or after the left row's as `around` says (negated). Both have `by` and ts, in
    whole numbers; right rows without either aren't met. order: columns that order right rows of one time."""
    for side in (left, right):
        if not isinstance(side.schema["ts"].dataType, IntegralType):
            raise ValueError("times are whole numbers")
    keys = [F.col(c).alias(f"_by{k}") for k, c in enumerate(by)]
    mine, theirs = ([c for c in side.columns if c not in (*by, "ts")] for side in (left, right))
    cell, ts = F.floor(F.col("ts") / width), F.col("ts").cast("long").alias("_ts")
    null = lambda side, c: F.lit(None).cast(side.schema[c].dataType)
    asked = left.select(*keys, cell.alias("_cell"), ts, F.lit(True).alias("_left"), *(F.col(c).alias(f"_l{k}") for k, c in enumerate(mine)), *(null(right, c).alias(f"_r_{c}") for c in theirs))
    known = right.where(F.col("ts").isNotNull()).dropna(subset=by)
    spread = known.select(*keys, F.explode(F.array(*(cell + k for k in around))).alias("_cell"), ts, F.lit(False).alias("_left"), *(null(left, c).alias(f"_l{k}") for k, c in enumerate(mine)), *(F.col(c).alias(f"_r_{c}") for c in theirs))
    n, cells = len(by), [f"_by{k}" for k in range(len(by))] + ["_cell"]
    rows = asked.unionByName(spread).repartition(*cells).sortWithinPartitions(*cells, "_ts", *(f"_r_{c}" for c in order))
    kinds = {f.name: f.dataType.simpleString() for f in left.schema}
    schema = ", ".join([*(f"_by{k} {kinds[c]}" for k, c in enumerate(by)), "_ts long", *(f"_l{k} {kinds[c]}" for k, c in enumerate(mine)), more])
    kept = [f"_by{k}" for k in range(n)] + ["_ts"] + [f"_l{k}" for k in range(len(mine))]
    names = [x.split()[0] for x in more.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_cells(batches, n):
            x = Met(part, n, width)
            if len(x.left):
                yield from pa.table([*(x.left[c] for c in kept), *map(pa.array, measure(x))], [*kept, *names]).to_batches(max_chunksize=10_000)

    back = {c: F.col(f"_by{k}") for k, c in enumerate(by)} | {"ts": F.col("_ts").cast(left.schema["ts"].dataType)} | {c: F.col(f"_l{k}") for k, c in enumerate(mine)}
    return rows.mapInArrow(run, schema).select(*(back[c].alias(c) for c in left.columns), *names)


def ranks(values: np.ndarray, down: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each value's rank, ties in order of place, and the places by rank; NaN is the greatest."""
    order = np.argsort(np.where(np.isnan(values), -np.inf, -values) if down else values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return rank, order


def chosen(rank: np.ndarray, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The ranks of the k-th (from 0) of the rows in low .. high - 1 in order of rank, all at once; k is less than their number."""
    found, l, r, k, here = np.zeros(len(k), np.int64), low.copy(), high.copy(), k.copy(), rank
    for b in reversed(range(max(1, (len(rank) - 1).bit_length()))):
        one = (here >> b & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        zl, zr = zeros[l], zeros[r]
        right = k >= zr - zl
        found |= right.astype(np.int64) << b
        k -= np.where(right, zr - zl, 0)
        l, r = np.where(right, zeros[-1] + l - zl, zl), np.where(right, zeros[-1] + r - zr, zr)
        here = np.concatenate([here[~one], here[one]])
    return found


def reached(rank: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, aim: float) -> np.ndarray:
    """The ranks at which the weights of the rows in low .. high - 1, added in order of rank, come to the aim; -1 if they don't.

    Whole weights are exact here. Where others come within rounding of the aim, or some are negative, a run's weights are added one
    by one, as SQL does."""
    found, l, r = np.zeros(len(low), np.int64), low.copy(), high.copy()
    close, so_far, here, w = np.zeros(len(low), bool), np.zeros(len(low)), rank, weight
    plain = bool((weight >= 0).all()) and np.isfinite(weight).all()
    exact = plain and bool((weight == np.floor(weight)).all()) and weight.sum() < 1 << 53
    rounding = 0 if exact else 1e-15 * (len(weight) + 64) * float(np.abs(weight).sum()) if plain else 0
    upto = np.concatenate([[0], np.cumsum(weight)])
    total = upto[high] - upto[low]
    out = np.where(total >= aim, 0, -1)
    close |= np.abs(total - aim) <= rounding
    for b in reversed(range(max(1, (len(rank) - 1).bit_length()))) if plain else ():
        one = (here >> b & 1).astype(bool)
        zeros, sums = np.concatenate([[0], np.cumsum(~one)]), np.concatenate([[0], np.cumsum(np.where(one, 0, w))])
        zl, zr = zeros[l], zeros[r]
        part = so_far + (sums[r] - sums[l])
        close |= np.abs(part - aim) <= rounding
        right = part < aim
        found |= right.astype(np.int64) << b
        so_far = np.where(right, part, so_far)
        l, r = np.where(right, zeros[-1] + l - zl, zl), np.where(right, zeros[-1] + r - zr, zr)
        here, w = np.concatenate([here[~one], here[one]]), np.concatenate([w[~one], w[one]])
    out = np.where((out < 0) | (low == high), -1, found)
    for k in np.flatnonzero((close & (not exact)) | (not plain)).tolist():
        run = low[k] + np.argsort(rank[low[k] : high[k]])
        hits = np.flatnonzero(np.cumsum(weight[run]) >= aim)
        out[k] = rank[run[hits[0]]] if len(hits) else -1
    return out


def medians(values: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The medians of the values in each span (low .. high - 1), NaN for an empty one. Null values are NaN and don't count."""
    known = ~np.isnan(values)
    upto = np.concatenate([[0], np.cumsum(known)])
    rank, order = ranks(values[known])
    low, high = (np.concatenate([upto[s[k]] for s in spans]) for k in (0, 1))
    n, out = high - low, np.full(len(low), np.nan)
    some = np.flatnonzero(n > 0)
    if len(some):
        two = chosen(rank, np.tile(low[some], 2), np.tile(high[some], 2), np.concatenate([(n[some] - 1) // 2, n[some] // 2]))
        a, b = values[known][order[two]].reshape(2, -1)
        out[some] = np.where(a == b, a, 0.5 * a + 0.5 * b)
    return np.split(out, len(spans))


def sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Sums of runs, as differences of sums that carry more digits."""
    upto = np.concatenate([np.zeros(1, np.longdouble), np.cumsum(values, dtype=np.longdouble)])
    return (upto[high] - upto[low]).astype(float)


def or_null(values: np.ndarray) -> pa.Array:
    """NaN as null."""
    return pa.array(values, mask=np.isnan(values))
