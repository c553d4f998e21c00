"""Shared helpers: the shared scratch folder, label folds, and Arrow batch plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python task works on at once.
STEP_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or that the session has been given. Without either: a temporary one in
    local mode, as in tests; on a cluster there is none that all executors share, which is an error."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        base = found
        if not context.getCheckpointDir():
            context.setCheckpointDir(base)
    elif not (base := context.getCheckpointDir()):
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tapeweave-")
        context.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again: cuts lineage, survives lost executors. options: of
    the writer."""
    path = scratch(df.sparkSession, name)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % n


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `most` bytes of text, of one row at least."""
    size = batch.column(column).cast(pa.large_binary())
    lengths = np.frombuffer(size.buffers()[1], np.int64, len(size) + 1, size.offset * 8) if len(size) else np.zeros(1, np.int64)
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(lengths, lengths[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches sorted by them; a run may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if not len(part):
            continue
        change = np.zeros(len(part), bool)
        values = [part[k].to_pylist() for k in keys]
        rows = list(zip(*values, strict=True))
        change[1:] = [a != b for a, b in zip(rows, rows[1:])]
        cuts = [0, *np.flatnonzero(change).tolist(), len(part)]
        for a, b in zip(cuts, cuts[1:]):
            if held and rows[a] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(a, b - a))
            last = rows[a]
    if held:
        yield pa.concat_tables(held)


def squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def full(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def planes(x: np.ndarray) -> bytes:
    """Integers byte by byte, low bytes of all first, so that the codec finds the zeros."""
    return squeezed(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(full(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel()
