"""Operator 8, toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is the embedding of its hash plus the mean of its character trigrams' embeddings. Windows of WINDOW
words overlap by WINDOW - STRIDE; every window of every text is scored, and a text's score is its worst window's.
Training on the driver uses a bounded sample of labelled rows. Labels mark whole texts, so the windows of toxic texts
that hold a word far more frequent in toxic texts count as toxic, and the windows of other texts as clean.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import remainder, steps, table, texts

#: Labelled rows of each label that the network is trained on, at most: those with the smallest hashes of their ids.
SAMPLE = 2_000
#: Bytes of a labelled text that the network is trained on, at most (longer ones are left out of training), and of all.
LONGEST, BYTES = 1 << 18, 1 << 25
THRESHOLD = 0.5
WINDOW, STRIDE = 64, 48
WORD_ROWS, CHAR_ROWS, INPUT, HIDDEN, ATTENTION = 1 << 14, 1 << 12, 12, 8, 8
#: Words whose inputs one Python worker keeps; beyond, they are computed anew.
REMEMBERED = 200_000
#: Punctuation at a word's ends that its input leaves out.
EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

Weights = dict[str, np.ndarray]


def hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the words' embeddings; rows of their trigrams' embeddings; each word's first trigram. A word is taken
    lower-case between marks of its start and end."""
    raw = np.frombuffer(b"".join(b"\2" + w + b"\3" for w in words), np.uint8).astype(np.uint64)
    size = np.array([len(w) for w in words]) + 2
    end = np.cumsum(size)
    code = raw[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ raw[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ raw[2:] * np.uint64(0x165667B19E3779F9)
    code = (code ^ code >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    inside = np.ones(len(raw), bool)  # trigrams within one word; an empty word has none but its marks
    inside[end - 1] = inside[end - 2] = False
    count = np.maximum(size - 2, 0)
    place = np.arange(len(raw)) - np.repeat(end - size, size)
    power = np.cumprod(np.full(256, 0x100000001B3, np.uint64))
    letter = (raw + np.uint64(1)) * power[np.minimum(place, 255)]
    word = np.add.reduceat(letter * (letter >> np.uint64(7) | np.uint64(1)), end - size)
    word = (word ^ word >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)
    return (word % np.uint64(WORD_ROWS)).astype(np.int64), (code[inside[: len(code)]] % np.uint64(CHAR_ROWS)).astype(np.int64), np.cumsum(count) - count


def plain(word: bytes) -> bytes:
    return word.lower().strip(EDGE) or word[:1]


def inputs(weights: Weights, words: list[bytes]) -> np.ndarray:
    """A row for each (plain) word."""
    rows, grams, first = hashes(words)
    sums = np.add.reduceat(np.vstack([weights["chars"][grams], np.zeros((1, INPUT), np.float32)]), first, axis=0)
    count = np.diff([*first, len(grams)])
    return weights["words"][rows] + np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], 0).astype(np.float32)


def fresh(seed: int = 11) -> Weights:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    out = {"words": normal(WORD_ROWS, INPUT, scale=0.1), "chars": normal(CHAR_ROWS, INPUT, scale=0.3), "pad": np.zeros((1, INPUT), np.float32)}
    for side in "fb":
        out |= {f"W{side}": normal(INPUT, 3 * HIDDEN, scale=0.4), f"U{side}": normal(HIDDEN, 3 * HIDDEN, scale=0.35), f"b{side}": np.zeros(3 * HIDDEN, np.float32)}
    return out | {"A": normal(2 * HIDDEN, ATTENTION, scale=0.4), "v": normal(ATTENTION, scale=0.5), "o": normal(2 * HIDDEN, scale=0.3), "c": np.zeros(1, np.float32)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def recur(projected: np.ndarray, index: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction, time by window by unit. projected: a row of gate inputs for each word; index: time by
    window. Gates: update, reset, candidate. keep: gets what the backward pass needs."""
    h = np.zeros((index.shape[1], HIDDEN), np.float32)
    out = np.empty((*index.shape, HIDDEN), np.float32)
    for t, rows in enumerate(index):
        x, r = projected[rows], h @ u
        gates = sigmoid(x[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
        update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[:, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((h, gates, new, r[:, 2 * HIDDEN :]))
        h = new + update * (h - new)
        out[t] = h
    return out


def forward(weights: Weights, projected: tuple[np.ndarray, np.ndarray], index: np.ndarray, live: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Each window's logit. index, live: time by window; only live places are attended to."""
    kept: tuple[list | None, list | None] = ([], []) if keep is not None else (None, None)
    states = np.concatenate([recur(projected[0], index, weights["Uf"], kept[0]), recur(projected[1], index[::-1], weights["Ub"], kept[1])[::-1]], 2)
    hidden = np.tanh(states @ weights["A"])
    mark = np.where(live, hidden @ weights["v"], -1e9)
    share = np.exp(mark - mark.max(0))
    share /= share.sum(0)
    pooled = np.einsum("tb,tbh->bh", share, states)
    if keep is not None:
        keep |= {"kept": kept, "states": states, "hidden": hidden, "share": share, "pooled": pooled}
    return pooled @ weights["o"] + weights["c"]


def back(weights: Weights, index: np.ndarray, keep: dict, slope: np.ndarray, words: int) -> tuple[Weights, np.ndarray]:
    """Gradients of the weights but the embeddings, and of the words' inputs. slope: by each window's logit."""
    states, hidden, share = keep["states"], keep["hidden"], keep["share"]
    out = {"o": keep["pooled"].T @ slope, "c": np.array([slope.sum()], np.float32)}
    pooled = slope[:, None] * weights["o"]
    by_share = np.einsum("bh,tbh->tb", pooled, states)
    mark = share * (by_share - (share * by_share).sum(0))
    deep = mark[:, :, None] * weights["v"] * (1 - hidden**2)
    out |= {"v": np.einsum("tb,tba->a", mark, hidden), "A": np.einsum("tbh,tba->ha", states, deep)}
    by_state = share[:, :, None] * pooled + deep @ weights["A"].T
    by_input = np.zeros((words, INPUT), np.float32)
    embedded = keep["inputs"]
    for side, kept, order, part in (("f", keep["kept"][0], index, by_state[:, :, :HIDDEN]), ("b", keep["kept"][1], index[::-1], by_state[::-1, :, HIDDEN:])):
        u = weights[f"U{side}"]
        du, db, dh = np.zeros_like(u), np.zeros((words, 3 * HIDDEN), np.float32), 0
        for t in reversed(range(len(order))):
            h, gates, new, r = kept[t]
            update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            d = part[t] + dh
            d_new = d * (1 - update) * (1 - new**2)
            d_gates = np.concatenate([d * (h - new), d_new * r], 1) * gates * (1 - gates)
            into_u = np.concatenate([d_gates, d_new * reset], 1)
            du += h.T @ into_u
            dh = d * update + into_u @ u.T
            np.add.at(db, order[t], np.concatenate([d_gates, d_new], 1))
        out[f"U{side}"] = du
        out[f"b{side}"] = db.sum(0)
        out[f"W{side}"] = embedded.T @ db
        by_input += db @ weights[f"W{side}"].T
    return out, by_input


def cut(count: int) -> list[tuple[int, int]]:
    """The windows of a text of so many words, which overlap and cover all of it."""
    return [(a, min(a + WINDOW, count)) for a in range(0, max(1, count - (WINDOW - STRIDE)), STRIDE)] if count else []


def laid(windows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index and live places, time by window; 0 is the row of padding."""
    size = np.array([len(w) for w in windows])
    live = np.arange(WINDOW)[:, None] < size[None, :]
    index = np.zeros((WINDOW, len(windows)), np.int64)
    index.T[live.T] = np.concatenate(windows)
    return index, live


def windows_of(rows: list[tuple[bytes, int]], seed: int = 5) -> tuple[list[list[bytes]], np.ndarray]:
    """Training windows, of plain words, and their labels."""
    same: dict[bytes, bytes] = {}
    docs = [([same.setdefault(p, p) for p in map(plain, text.split())], label) for text, label in rows]
    toxic, clean = (Counter(w for words, y in docs if y == label for w in set(words)) for label in (1, 0))
    n, m = (max(1, sum(y == label for _, y in docs)) for label in (1, 0))
    odds = {w: math.log((c + 0.5) / n) - math.log((clean[w] + 0.5) / m) for w, c in toxic.items() if c >= max(3, n // 400)}
    rng = np.random.default_rng(seed)
    out, labels = [], []
    for words, y in docs:
        places = [words[a:b] for a, b in cut(len(words))]
        if y and places:
            worst = [max(odds.get(w, -9) for w in p) for p in places]
            bad = [p for p, s in zip(places, worst) if s >= 2] or [places[int(np.argmax(worst))]]
            out += [bad[k] for k in rng.permutation(len(bad))[:3]]
        else:
            out += [places[k] for k in rng.permutation(len(places))[:4]]
        labels += [y] * (len(out) - len(labels))
    return out, np.array(labels, np.float32)


def train_network(rows: list[tuple[bytes, int]], rounds: tuple[int, ...] = (3, 2, 2), batch: int = 128, rate: float = 0.01, seed: int = 3) -> Weights:
    """Adam on windows. After each of the rounds but the last, the windows of clean texts that the network takes for
    toxic join the training set. Without rows of both labels: a network whose logit is the label's (0 without rows)."""
    weights = fresh()
    windows, labels = windows_of(rows)
    if not len(labels) or labels.min() == labels.max():
        weights["o"][:] = 0
        weights["c"][:] = 0 if not len(labels) else 8 * labels[0] - 4
        return weights
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    rng, step = np.random.default_rng(seed), 0
    clean = [text for text, y in rows if not y]
    for k, passes in enumerate(rounds):
        step = epochs(weights, windows, labels, first, second, step, passes, batch, rate / (k + 1), rng)
        if k < len(rounds) - 1:
            scorer = Scorer(weights)
            same = {w: w for x in windows for w in x}
            hard = [[same.setdefault(p, p) for p in map(plain, w)] for at in range(0, len(clean), 50) for _, w, score in scorer.windows(clean[at : at + 50]) if score >= 0.2]
            hard = [hard[i] for i in rng.permutation(len(hard))[: len(windows)]]
            windows, labels = windows + hard, np.concatenate([labels, np.zeros(len(hard), np.float32)])
    return weights


def epochs(weights: Weights, windows: list, labels: np.ndarray, first: Weights, second: Weights, step: int, passes: int, batch: int, rate: float, rng: np.random.Generator) -> int:
    """Passes over the windows, in place; first, second: Adam's moments. The number of steps so far."""
    heavy = np.where(labels == 1, max(1.0, 0.5 * len(labels) / labels.sum() - 0.5), 1).astype(np.float32)
    for _ in range(passes):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            row = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for c in chosen for w in windows[c]))}
            embedded = np.vstack([weights["pad"], inputs(weights, list(row))])
            index, live = laid([[row[w] for w in windows[c]] for c in chosen])
            keep: dict = {"inputs": embedded}
            logit = forward(weights, tuple(embedded @ weights[f"W{s}"] + weights[f"b{s}"] for s in "fb"), index, live, keep)
            slope = ((sigmoid(logit) - labels[chosen]) * heavy[chosen] / len(chosen)).astype(np.float32)
            grads, by_input = back(weights, index, keep, slope, len(embedded))
            words, grams, start = hashes(list(row))
            grads |= {"pad": by_input[:1], "words": np.zeros_like(weights["words"]), "chars": np.zeros_like(weights["chars"])}
            np.add.at(grads["words"], words, by_input[1:])
            count = np.diff([*start, len(grams)])
            np.add.at(grads["chars"], grams, np.repeat(by_input[1:] / np.maximum(count, 1)[:, None], count, 0))
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return step


class Scorer:
    """The network with the gate inputs of the words that it has seen."""

    def __init__(self, weights: Weights) -> None:
        self.weights = weights
        self.row: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        self.row.clear()
        self.size = 1
        self.table = np.empty((1 << 12, 6 * HIDDEN), np.float32)
        self.table[:1] = self.project(self.weights["pad"])

    def project(self, embedded: np.ndarray) -> np.ndarray:
        return np.hstack([embedded @ self.weights[f"W{s}"] + self.weights[f"b{s}"] for s in "fb"])

    def rows(self, docs: list[list[bytes]]) -> list[list[int]]:
        get = self.row.get
        found = [list(map(get, d)) for d in docs]
        if lacking := [k for k, f in enumerate(found) if None in f]:
            new = list({w for k in lacking for w, i in zip(docs[k], found[k]) if i is None})
            if self.size + len(new) > REMEMBERED and self.size > 1:
                self.forget()
                return self.rows(docs)
            rows = self.project(inputs(self.weights, [plain(w) for w in new]))
            if self.size + len(new) > len(self.table):
                grown = np.empty((max(2 * len(self.table), self.size + len(new)), self.table.shape[1]), np.float32)
                grown[: self.size] = self.table[: self.size]
                self.table = grown
            self.table[self.size : self.size + len(new)] = rows
            self.row.update(zip(new, range(self.size, self.size + len(new))))
            self.size += len(new)
            for k in lacking:
                found[k] = list(map(self.row.__getitem__, docs[k]))
        return found

    def windows(self, raw: list[bytes]) -> Iterator[tuple[int, list[bytes], float]]:
        """The text, the words and the probability of every window."""
        words = [x.split() for x in raw]
        docs = self.rows(words)
        places = [(k, a, b) for k, d in enumerate(docs) for a, b in cut(len(d))]
        sides = (self.table[:, : 3 * HIDDEN], self.table[:, 3 * HIDDEN :])
        for at in range(0, len(places), 2048):
            part = places[at : at + 2048]
            logit = forward(self.weights, sides, *laid([docs[k][a:b] for k, a, b in part]))
            yield from ((k, words[k][a:b], score) for (k, a, b), score in zip(part, sigmoid(logit).tolist(), strict=True))

    def scores(self, raw: list[bytes]) -> np.ndarray:
        """Each text's worst window's probability; 0 for a text without words."""
        out = np.zeros(len(raw))
        for k, _, score in self.windows(raw):
            out[k] = max(out[k], score)
        return out


def scored(docs: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a text that is null or has no words scores 0. A null id's
    held_out is null."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in (p for b in batches for p in steps(b)):
            yield pa.record_batch([part["doc_id"], pa.array(scorer.scores(texts(part["text"])))], ["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return rows.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filtered(docs: DataFrame, weights: Weights, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score under the threshold, in the same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for part in (p for b in batches for p in steps(b)):
            yield part.filter(pa.array(scorer.scores(texts(part["text"])) < threshold))

    return docs.mapInArrow(run, docs.schema)


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Weights:
    """Learns from labels of rows whose crc32(doc_id as text) mod 5 is not 0. Rows without an id or a label take no
    part. Rows that repeat an id all count towards the sample's bounds."""
    fold: Column = remainder("doc_id", 5) != 0
    known = labels.where(fold & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= LONGEST)
    order = [F.xxhash64("doc_id"), "doc_id", "toxic", "text"]
    rows = whole.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").orderBy(*order).limit(2 * most)  # 2 * most labels at most
    bytes_so_far = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    got = sorted(rows.withColumn("bytes", bytes_so_far).where(F.col("bytes") <= BYTES).select("doc_id", "toxic", "text").collect())
    return train_network([(x.text.encode(), x.toxic) for x in got])


def op8_bigru_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))
