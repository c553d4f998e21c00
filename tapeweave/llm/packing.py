"""Operator 10, packing: harmonic packing of token ids into sequences.

A document's ids are cut into full sequences and pieces of the reciprocal-capacity classes: class k holds lengths in
(capacity / (k + 1), capacity / k] and closes a bin once it has k pieces. A remainder that would waste more than a
fiftieth of its class's share is cut down to the next class's full share, and the rest is classed again. Every Spark
task fills its own bins and needs no other's. What is left in open bins at a task's end is laid end to end and cut at
the capacity; the last sequence is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tapeweave.llm.bpe import LibraryBPE, loaded
from tapeweave.llm.common import steps, table, texts

CAPACITY = 1024
#: Share of a class's full length that a piece may leave unused rather than be cut.
SLACK = 50
#: Remainders up to this share of the capacity are classed as they are.
SMALL = 32
#: Sequence ids of one task.
TASK_IDS = 1 << 36
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

Piece = tuple[object, int, bytes, int]


def lengths(rest: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of the pieces that a remainder under the capacity is cut into."""
    out = []
    while rest:
        k = capacity // rest
        full = capacity // k
        if rest * SMALL <= capacity or (full - rest) * SLACK <= full:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= out[-1]
    return out


class Harmonic:
    """The bins of one task. A piece: doc_id, start, its ids' bytes, its document's number of ids."""

    def __init__(self, first_id: int, capacity: int = CAPACITY) -> None:
        self.capacity, self.next_id, self.rows = capacity, first_id, []
        self.open: dict[int, list[Piece]] = {}

    def close(self, bin: list[Piece]) -> None:
        offset = 0
        for doc_id, start, ids, total in bin:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next_id, offset))
            offset += n
        self.next_id += 1

    def add(self, doc_id: object, ids: bytes) -> None:
        total = len(ids) // 4
        full = total // self.capacity
        start = 0
        for n in [self.capacity] * full + lengths(total - full * self.capacity, self.capacity):
            k = self.capacity // n
            bin = self.open.setdefault(k, [])
            bin.append((doc_id, start, ids[4 * start : 4 * (start + n)], total))
            if len(bin) == k:
                self.close(self.open.pop(k))
            start += n

    def finish(self) -> None:
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        n = sum(len(p[2]) // 4 for p in left)
        sizes = [self.capacity] * (n // self.capacity)
        sizes += [1 << b for b in reversed(range(self.capacity.bit_length())) if n % self.capacity >> b & 1]
        for size in sizes:
            bin, room = [], size
            while room:
                doc_id, start, ids, total = left.pop(0)
                if len(ids) > 4 * room:
                    left.insert(0, (doc_id, start + room, ids[4 * room :], total))
                    ids = ids[: 4 * room]
                bin.append((doc_id, start, ids, total))
                room -= len(ids) // 4
            self.close(bin)


def packed(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are documents of their own; an empty table has no pieces.
    Sequence ids are unique but not gapless; a task that runs again gives its rows the same ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = loaded(LibraryBPE, path), end_id.to_bytes(4, "little")
        bins = Harmonic(TaskContext.get().partitionId() * TASK_IDS, capacity)
        schema = None

        def flush() -> pa.RecordBatch:
            columns = list(zip(*bins.rows, strict=True)) or [[]] * len(COLUMNS)
            bins.rows = []
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], COLUMNS)

        for part in (p for b in batches for p in steps(b)):
            schema = [part.schema.field("doc_id").type, *[pa.int64()] * 6]
            for doc_id, ids in zip(part["doc_id"].to_pylist(), bpe.encode_raw(texts(part["text"])), strict=True):
                bins.add(doc_id, ids + end)
            yield flush()
        bins.finish()
        if bins.rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COLUMNS[1:]))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
