"""Operator 6, BPE encoding and decoding: a column's texts to token ids and back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tapeweave.llm.bpe import SegmentTreeBPE, loaded
from tapeweave.llm.common import steps, table, texts


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers, as binary) of every whole text; a null text has none.

    Rows are taken one by one, in any order: repeated rows give repeated rows, an empty table an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(SegmentTreeBPE, path)
        for part in (p for b in batches for p in steps(b)):
            ids = bpe.encode_raw(texts(part["text"]))
            yield pa.record_batch([part["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of `encoded`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(SegmentTreeBPE, path)
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array([bpe.decode(x) for x in batch["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every text encoded and decoded again, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(SegmentTreeBPE, path)
        for part in (p for b in batches for p in steps(b)):
            ids = bpe.encode_raw(texts(part["text"]))
            columns = [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]
            yield pa.record_batch([part["doc_id"], *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
