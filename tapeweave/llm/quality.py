"""Operator 7, quality classifier: a sparse rule ensemble.

Statistics of each whole text are taken in one pass. On a bounded sample of labelled rows the driver grows small
boosted trees, reads every path as a conjunction of conditions, and fits lasso logistic weights to them; few rules keep
a weight. These are compiled into one Spark column expression over the statistics, which scores all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.llm.common import remainder, steps, table, texts

#: Labelled rows that the rules are fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
THRESHOLD = 0.7
STATS = (
    "size", "words", "word_size", "upper", "digit", "newline", "high", "stop", "bang", "bar", "symbol", "hash", "markup",
    "distinct_words", "same_as_before", "distinct_lines", "longest_line", "squeezed", "marked_words",
)


def groups() -> np.ndarray:
    """By byte, the group whose share of the text is a statistic: upper, digit, newline, high, stop, bang, bar, symbol,
    hash, markup."""
    of = np.full(256, 10)
    of[ord("A") : ord("Z") + 1] = 0
    of[ord("0") : ord("9") + 1] = 1
    of[ord("\n")] = 2
    of[128:] = 3
    for k, letters in ((4, b".,"), (5, b"!?"), (6, b"|"), (7, b"*$%&@+=~^_"), (8, b"#"), (9, b"<>{}[]\\/")):
        of[list(letters)] = k
    return of


GROUP = groups()


def stats_of(text: bytes) -> list[float]:
    """STATS of a text; all zero for an empty one."""
    if not text:
        return [0.0] * len(STATS)
    n = len(text)
    shares = np.bincount(GROUP, np.bincount(np.frombuffer(text, np.uint8), minlength=256), 11)[:10] / n
    words = text.split()
    lines = text.split(b"\n")
    count = max(1, len(words))
    same = sum(map(bytes.__eq__, words, words[1:])) / count
    marked = sum(map(MARKS.__contains__, [w[-1] for w in words])) / count
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), (n - len(words)) / count, *shares.tolist(), len(set(words)) / count, same,
        len(set(lines)) / len(lines), max(map(len, lines)) / n, len(zlib.compress(text, 1)) / (n + 16), marked,
    ]


MARKS = frozenset(b"!*$%&#|@+=~^_")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b)):
            values = np.array([stats_of(x) for x in texts(part["text"])], float).reshape(-1, len(STATS))
            yield pa.record_batch([part["doc_id"], *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(STATS)))], ["doc_id", *STATS])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} double" for x in STATS))


Condition = tuple[int, bool, float]  # the statistic, whether it is above, the cut


@dataclass
class Rules:
    """A fitted ensemble: each rule is a conjunction, with a weight."""

    rules: list[tuple[tuple[Condition, ...], float]]
    bias: float

    def column(self, stats: tuple[str, ...] = STATS) -> Column:
        """The probability of label 1 as a Spark expression over the columns of STATS."""
        total = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            test = F.lit(True)
            for k, above, cut in conditions:
                test = test & (F.col(stats[k]) > cut if above else F.col(stats[k]) <= cut)
            total = total + F.when(test, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            total += weight * holds(x, conditions)
        return 1 / (1 + np.exp(-total))


def holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in conditions:
        out &= x[:, k] > cut if above else x[:, k] <= cut
    return out


def grow(codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, depth: int, path: tuple[Condition, ...], found: list, value: np.ndarray, rows: np.ndarray) -> None:
    """One tree on the rows: appends each node's path, and sets `value` to its leaves' means."""
    if path:
        found.append(path)
    best = (1e-9, -1, -1)
    total, n = gradient[rows].sum(), len(rows)
    value[rows] = total / max(1, n)
    if not depth or n < 40:
        return
    for k in range(codes.shape[1]):
        size = len(cuts[k]) + 1
        if size < 2:
            continue
        c = codes[rows, k]
        left_n = np.cumsum(np.bincount(c, minlength=size))[:-1]
        left = np.cumsum(np.bincount(c, gradient[rows], size))[:-1]
        right_n = n - left_n
        gain = np.where((left_n >= 15) & (right_n >= 15), left**2 / np.maximum(left_n, 1) + (total - left) ** 2 / np.maximum(right_n, 1) - total**2 / n, 0)
        if gain[at := int(gain.argmax())] > best[0]:
            best = (gain[at], k, at)
    if best[1] < 0:
        return
    _, k, at = best
    below = codes[rows, k] <= at
    for side, above in ((rows[below], False), (rows[~below], True)):
        grow(codes, cuts, gradient, depth - 1, (*path, (k, above, float(cuts[k][at]))), found, value, side)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, seed: int = 7) -> Rules:
    """Rules fitted to statistics and labels 0 or 1. Without rows of both labels the score is the share of ones (0.5
    without rows)."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Rules([], bias)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 64))) for k in range(x.shape[1])]
    codes = np.stack([np.searchsorted(cuts[k], x[:, k], "left") for k in range(x.shape[1])], 1)
    margin, found = np.full(len(y), bias), []
    for _ in range(trees):
        gradient = y - 1 / (1 + np.exp(-margin))
        value = np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        before = len(found)
        grow(codes, cuts, gradient, depth, (), found, value, rows)
        for path in found[before:]:
            if len(path) == depth or not any(p != path and p[: len(path)] == path for p in found[before:]):
                inside = holds(x, path)
                margin[inside] += 0.5 * np.clip(gradient[inside].mean() * 4 if inside.any() else 0, -2, 2)
    rules = list(dict.fromkeys(tuple(sorted(p)) for p in found))
    if not rules:
        return Rules([], bias)
    design = np.stack([holds(x, r) for r in rules], 1).astype(float)
    used = (design.mean(0) > 0.002) & (design.mean(0) < 0.998)
    rules, design = [r for r, u in zip(rules, used) if u], design[:, used]
    if not rules:
        return Rules([], bias)
    weights, bias = lasso(design, y, bias)
    return Rules([(r, float(w)) for r, w in zip(rules, weights) if w], float(bias))


def lasso(design: np.ndarray, y: np.ndarray, bias: float, penalty: float = 6e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights by accelerated proximal gradient steps; the bias isn't penalised."""
    n = len(y)
    full = np.column_stack([design, np.ones(n)])
    start = np.ones(full.shape[1])
    for _ in range(12):  # the largest eigenvalue, for the step's length
        start = full.T @ (full @ start) / n
        start /= np.linalg.norm(start)
    step = 1 / (0.25 * np.linalg.norm(full.T @ (full @ start) / n) * 1.05)
    w = np.zeros(full.shape[1])
    w[-1] = bias
    ahead, t = w.copy(), 1.0
    for _ in range(rounds):
        new = ahead - step * (full.T @ (1 / (1 + np.exp(-full @ ahead)) - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (last - 1) / t * (new - w), new
    return w[:-1], w[-1]


def sample_of(docs: DataFrame, labels: DataFrame, label: str, fold: Column, most: int) -> DataFrame:
    """doc_id, text and label of at most `most` labelled rows of the fold, those with the smallest hashes of their ids.
    Rows without an id or a label take no part."""
    chosen = labels.where(fold & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # most labels at most


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Rules:
    """Learns from labels of rows whose crc32(doc_id as text) mod 4 is not 2."""
    rows = sample_of(docs, labels, "quality", remainder("doc_id", 4) != 2, most)
    return fit(*_sample(rows, most))


def _sample(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of the sample, `most` rows at most where ids repeat, in the order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b)):
            values = np.array([stats_of(x) for x in texts(part["text"])], float).reshape(-1, len(STATS))
            yield pa.record_batch([part["doc_id"], part["label"], *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(STATS)))], ["doc_id", "label", *STATS])

    got = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, " + ", ".join(f"{x} double" for x in STATS))
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "label", *STATS).limit(most).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    return got[list(STATS)].to_numpy(float), (got["label"].to_numpy() == 1).astype(float)


def scored(docs: DataFrame, rules: Rules, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; empty texts have a score too. A null id's held_out is null."""
    score = statistics(docs).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), rules.column().alias("score"))
    return score.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def filtered(docs: DataFrame, rules: Rules, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score the threshold or more, in the same columns."""
    stats = tuple(f"tapeweave_stat_{x}" for x in STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in steps(b)):
            values = np.array([stats_of(x) for x in texts(part["text"])], float).reshape(-1, len(STATS))
            yield pa.record_batch([*part.columns, *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(STATS)))], [*part.schema.names, *stats])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(x, T.DoubleType()) for x in stats)])
    return docs.mapInArrow(run, schema).where(rules.column(stats) >= threshold).select(*docs.columns)


def op7_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
