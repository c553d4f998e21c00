"""Operator 1, approximate nearest neighbours: cross-polytope hashing.

A vector's hash in a table is the signed axis nearest to its pseudo-rotation: three rounds of random signs and a fast
Hadamard transform. A query probes, in each table, the buckets of its PROBES nearest axes; candidates that share a
bucket with it are scored by their exact cosines in double precision, block against block in numpy.

Of equal vectors the few with the smallest ids stand for all, which loses nothing since ties go to smaller ids; equal
queries are searched once. Large buckets are dealt out in blocks of bounded size, on both sides. A query that finds
fewer than it should probes every bucket of one table, which holds every vector once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import saved, table

TABLES, PROBES, SEED = 14, 8, 20240229
#: Rows of a bucket that one task holds, of either side.
BLOCK = 4096


@dataclass(frozen=True)
class Hashing:
    tables: int = TABLES
    probes: int = PROBES
    seed: int = SEED
    block: int = BLOCK

    def rotated(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The pseudo-rotations of the rows, one for each table; rows are padded to a power of two."""
        width = 1 << max(1, x.shape[1] - 1).bit_length()
        unit = np.zeros((len(x), width))
        unit[:, : x.shape[1]] = x / np.sqrt((x * x).sum(1))[:, None]
        signs = np.random.default_rng(self.seed).choice([-1.0, 1.0], (self.tables, 3, width))
        for rounds in signs:
            out = unit
            for s in rounds:
                out = hadamard(out * s)
            yield out


def hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def bucket(size: int, at: int, rotated: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Keys of buckets: the vectors' size, the table, the axis and its sign."""
    negative = np.take_along_axis(rotated, axis, 1) < 0
    return (np.int64(size) << 40) + (np.int64(at) << 28) + axis * 2 + negative


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding as doubles, without vectors that are null, empty or zero or hold null or non-finite
    components, and without null ids."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite & F.exists(x, lambda v: v != 0)).select("vec_id", F.transform(x, lambda v: v.cast("double")).alias("embedding"))


def keyed(vectors: DataFrame, hashing: Hashing, probes: int | None, with_vector: bool) -> DataFrame:
    """A row for each vector and bucket: key, vec_id and, if asked for, the vector's bytes. probes: None for every
    bucket of the first table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(np.asarray(batch["embedding"].offsets))
            values = np.asarray(batch["embedding"].flatten(), float)
            start = np.cumsum(size) - size
            for n in np.unique(size).tolist():
                rows = np.flatnonzero(size == n)
                for at in range(0, len(rows), 2000):
                    part = rows[at : at + 2000]
                    x = values[start[part][:, None] + np.arange(n)]
                    raw = [v.tobytes() for v in x]
                    for k, rotated in enumerate(hashing.rotated(x)):
                        width = rotated.shape[1]
                        if probes is None:
                            both = np.arange(2 * width)
                            key = np.tile((np.int64(n) << 40) + both, (len(part), 1))
                        else:
                            axis = np.argsort(-np.abs(rotated), 1, kind="stable")[:, :probes] if probes > 1 else np.abs(rotated).argmax(1)[:, None]
                            key = bucket(n, k, rotated, axis)
                        of = np.repeat(np.arange(len(part)), key.shape[1])
                        columns = [pa.array(key.ravel()), batch["vec_id"].take(pa.array(part[of]))]
                        if with_vector:
                            columns.append(pa.array([raw[i] for i in of.tolist()], pa.binary()))
                        yield pa.record_batch(columns, ["key", "vec_id", "vector"][: len(columns)])
                        if probes is None:
                            break

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"key long, vec_id {kind}" + ", vector binary" * with_vector)


def nearest(queries: pd.DataFrame, index: pd.DataFrame, most: int) -> pd.DataFrame:
    """The `most` rows of the index nearest to each query, by exact cosine, ties to smaller ids."""
    empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    if not len(queries) or not len(index):
        return empty
    q, x = (np.frombuffer(b"".join(side["vector"]), float).reshape(len(side), -1) for side in (queries, index))
    q_ids, ids = queries["vec_id"].to_numpy(), index["vec_id"].to_numpy()
    q_norm, norm = (np.sqrt((v * v).sum(1)) for v in (q, x))
    out = []
    for at in range(0, len(q), 256):
        rough = q[at : at + 256] @ x.T / norm
        k = min(most, len(x))
        least = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]
        i, j = np.nonzero(rough >= (least - 1e-9 * q_norm[at : at + 256])[:, None])
        exact = (q[at + i] * x[j]).sum(1) / (q_norm[at + i] * norm[j])
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < most
        out.append(pd.DataFrame({"query_id": q_ids[at + i[keep]], "vec_id": ids[j[keep]], "score": exact[keep]}))
    return pd.concat(out)


def probed(queries: DataFrame, index: DataFrame, hashing: Hashing, probes: int | None, most: int) -> DataFrame:
    """query_id, vec_id and score: the best of each block of each bucket that a query probes."""
    spark = queries.sparkSession
    sides = []
    for vectors, probe in ((queries, probes), (index, 1)):
        counts = {r.key: r.n for r in keyed(vectors, hashing, probe, False).groupBy("key").agg(F.count("*").alias("n")).collect()}  # tables times axes at most
        sides.append({k: -(-n // hashing.block) for k, n in counts.items()})
    rows = [(k, sides[0][k], sides[1][k]) for k in sides[0].keys() & sides[1].keys()]
    q_side, x_side = (spark.createDataFrame(rows, "key long, q_blocks long, x_blocks long") for _ in sides)
    place = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    q = keyed(queries, hashing, probes, True).join(F.broadcast(q_side), "key").withColumn("q_block", place("q_blocks")).withColumn("x_block", every("x_blocks"))
    x = keyed(index, hashing, 1, True)
    if probes is None:
        x = x.where(F.shiftright("key", 28) % 4096 == 0)
    x = x.join(F.broadcast(x_side), "key").withColumn("x_block", place("x_blocks")).withColumn("q_block", every("q_blocks"))
    by = ["key", "q_block", "x_block"]
    pairs = q.groupBy(*by).cogroup(x.groupBy(*by)).applyInPandas(lambda a, b: nearest(a, b, most), "query_id long, vec_id long, score double")
    ranked = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, hashing: Hashing = Hashing()) -> DataFrame:
    """query_id, rank from 1, vec_id and score: of all vectors but the query's own id, the k nearest found to each query.

    Both sides have vec_id and embedding. Unusable vectors (see `usable`) take no part; vectors are compared with those
    of their own size only. Fewer than k others: all of them. An empty table gives no rows. Rows that repeat an id and
    its vector count once."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    known = usable(vectors).dropDuplicates(["vec_id", "embedding"])
    index = saved(known.withColumn("copy", F.row_number().over(order)).where(F.col("copy") <= k + 1).drop("copy"), "index")
    asked = usable(queries).dropDuplicates(["vec_id", "embedding"])
    groups = saved(asked.groupBy("embedding").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "embedding"), "queries")
    found = saved(probed(groups, index, hashing, hashing.probes, k + 1), "found")
    short = groups.join(found.where(F.col("rank") == k + 1).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if not short.isEmpty():
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(probed(short, index, hashing, None, k + 1))
    of = asked.join(groups.withColumnRenamed("vec_id", "group_id"), "embedding").select(F.col("vec_id").alias("query_id"), "group_id")
    rows = of.join(found.withColumnRenamed("query_id", "group_id"), "group_id").where(F.col("query_id") != F.col("vec_id"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors.where(F.col("vec_id") % 50 == 0), vectors)
