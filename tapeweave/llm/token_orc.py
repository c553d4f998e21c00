"""Operator 5, token ids as ORC: stripes with integer run-length encoding, row indexes and Bloom filters on doc_id.

Rows are range-partitioned and sorted by doc_id, so that row indexes and Bloom filters let a reader skip stripes and
row groups; a reader splits files by stripe. Each row carries its file part and its start within it, which delta-code
to almost nothing; a document's start in the whole is that plus the ids of earlier parts, read from those two narrow
columns alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeweave.llm.bpe import LibraryBPE, loaded
from tapeweave.llm.common import scratch, steps, table, texts

ORC = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}


def write_ids(docs: DataFrame, to: str, path: str, end_id: int) -> None:
    """ORC files of part int, part_start long, doc_id, n_tokens long, ids array<int>, in ascending doc_id order.

    A null or empty text is its end id alone. A null doc_id comes first; rows with equal doc_id are in the order of
    their texts' hashes. An empty table makes an empty folder of files."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end, before = loaded(LibraryBPE, path), end_id.to_bytes(4, "little"), 0
        part_id = TaskContext.get().partitionId()
        for part in (p for b in batches for p in steps(b)):
            ids = [x + end for x in bpe.encode_raw(texts(part["text"]))]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(n)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), values)
            columns = [np.full(len(n), part_id, np.int32), before + ends - n, part["doc_id"], n, lists]
            yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], ["part", "part_start", "doc_id", "n_tokens", "ids"])
            before += int(ends[-1])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    rows = ordered.mapInArrow(run, f"part int, part_start long, doc_id {kind}, n_tokens long, ids array<int>")
    rows.write.options(**ORC).orc(to)


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with doc_ids those documents only, found by row indexes and Bloom filters."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 from the files."""
    rows = read_ids(spark, path)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ids"]
            offsets = np.asarray(lists.offsets, np.int64)
            raw = memoryview(np.ascontiguousarray(np.asarray(lists.values)).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.record_batch([batch["part"], batch["part_start"], batch["doc_id"], pa.array(np.diff(offsets)), pa.array(crc, pa.int64())], ["part", "part_start", "doc_id", "n_tokens", "ids_crc32"])

    read = rows.mapInArrow(run, f"part int, part_start long, doc_id {kind}, n_tokens long, ids_crc32 long")
    sizes = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file part
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    joined = read.join(F.broadcast(starts), "part")  # one narrow row for each file part
    return joined.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = scratch(spark, "token-orc")
    write_ids(table(spark, sf_dir, "documents"), to, public_tokenizers.path("word_bpe_49k.json"), 2)
    return digest(spark, to)
