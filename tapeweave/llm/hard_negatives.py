"""Operator 11, hard negatives: norm-bucketed search.

Rows are sorted by falling norm and cut into buckets. By Cauchy-Schwarz no row of a bucket scores higher than the
anchor's norm times the bucket's largest, so a bucket is left out for every window whose lower limit, or whose kth score
so far, lies above that. A window is a range of scores of an anchor: all scores for its positives, then one for each
positive's negatives.

Anchors and buckets meet as packed blocks: a group of anchors with each bucket that any of its windows can still use,
by lanes of buckets. The first lane, of the largest norms, runs before the others and gives them kth scores to start with.
Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeweave.llm.common import saved, table

#: Rows of a bucket or a group of anchors, buckets of a lane, and anchors that are scored at once.
BUCKET, LANE, STEP = 2048, 4, 128
#: Scores below this are exact in doubles.
EXACT = 1 << 53
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantized(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, whole (floor(scale * x) of each component) and norm2, without rows that hold a null or a non-finite
    component; equal rows once. Squared lengths of 2**62 or more are an error."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & finite)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("whole"))
    rough = F.aggregate("whole", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    checked = F.when(rough < float(1 << 62), F.aggregate("whole", F.lit(0).cast("long"), lambda s, v: s + v * v)).otherwise(F.raise_error(F.lit("a vector is too long for exact scores")))
    return rows.dropDuplicates().withColumn("norm2", checked)


def in_buckets(rows: DataFrame) -> DataFrame:
    """Rows sorted by size and falling norm and packed: bucket, size of the vectors, norm (the largest), ids, labels, norms
    and vectors of up to BUCKET rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n_out = TaskContext.get().partitionId() << 32, 0

        def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            norm = np.sqrt(t["norm2"].to_numpy().astype(float))
            width = int(t["size"][0].as_py())
            values = np.asarray(pa.chunked_array(t["whole"]).combine_chunks().flatten(), np.int64)
            raw = [t["vec_id"].to_numpy(), t["label"].to_numpy(), norm, values]
            columns = [pa.array([base + n_out]), pa.array([width], pa.int32()), pa.array([norm.max()]), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in raw)]
            return pa.record_batch(columns, ["bucket", "size", "norm", "ids", "labels", "norms", "vectors"])

        held, count, size = [], 0, None
        for b in batches:
            sizes = np.asarray(b["size"])
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(b)]
            for lo, hi in zip(cuts, cuts[1:]):
                while lo < hi:
                    if held and (count == BUCKET or size != sizes[lo]):
                        yield block(held)
                        held, count, n_out = [], 0, n_out + 1
                    take = min(hi - lo, BUCKET - count)
                    held.append(b.slice(lo, take))
                    size, count, lo = sizes[lo], count + take, lo + take
        if held:
            yield block(held)

    order = [F.col("size"), F.desc("norm2"), F.col("vec_id")]
    ranged = rows.withColumn("size", F.size("whole")).repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.mapInArrow(run, "bucket long, size int, norm double, ids binary, labels binary, norms binary, vectors binary")


@dataclass
class Sweep:
    """Windows of a group of anchors and the best rows found so far. limit: a window's lower limit, or its kth score."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    norms: np.ndarray
    at: np.ndarray
    high: np.ndarray
    limit: np.ndarray
    k: int
    same: bool
    found: list[np.ndarray] = field(default_factory=lambda: [np.empty(0, np.int64)] * 3)

    def meet(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, norm: float) -> None:
        """Rows of a bucket, whose largest norm is given."""
        reach = self.norms[self.at] * norm * (1 + 1e-9) + 1
        live = np.flatnonzero(reach >= self.limit)
        exact = norm * self.norms.max(initial=0) < EXACT
        side = x.astype(float).T if exact else x.T
        new: list[tuple[np.ndarray, ...]] = []
        anchors = np.unique(self.at[live])
        for some in (anchors[n : n + STEP] for n in range(0, len(anchors), STEP)):
            scores = np.rint(self.vectors[some].astype(float) @ side).astype(np.int64) if exact else self.vectors[some] @ side
            fits = (self.labels[some][:, None] == labels) == self.same
            if self.same:
                fits &= self.ids[some][:, None] != ids
            windows = live[np.isin(self.at[live], some)]
            for part in (windows[n : n + STEP] for n in range(0, len(windows), STEP)):
                of = np.searchsorted(some, self.at[part])
                s = scores[of]
                inside = fits[of] & (s >= self.limit[part][:, None]) & (s <= self.high[part][:, None])
                many = np.flatnonzero(np.count_nonzero(inside, axis=1) > self.k)
                if len(many):
                    kth = np.partition(np.where(inside[many], s[many], LOWEST), s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
                    inside[many] &= s[many] >= kth[:, None]
                i, j = np.nonzero(inside)
                new.append((part[i], s[i, j], ids[j]))
        if new:
            self.add(*(np.concatenate(c) for c in zip(*new, strict=True)))

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        window, score, ids = (np.concatenate(pair) for pair in zip(self.found, (window, score, ids), strict=True))
        order = np.lexsort((ids, -score, window))
        window, score, ids = window[order], score[order], ids[order]
        rank = np.arange(len(window)) - np.searchsorted(window, window)
        keep, last = rank < self.k, rank == self.k - 1
        self.found = [window[keep], score[keep], ids[keep]]
        self.limit[window[last]] = np.maximum(self.limit[window[last]], score[last])


def arrays(r: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """ids, labels, norms and vectors of a packed row."""
    ids, labels, norms, whole = (np.frombuffer(r[c][0].as_py(), t) for c, t in (("ids", np.int64), ("labels", np.int64), ("norms", float), ("vectors", np.int64)))
    return ids, labels, norms, whole.reshape(len(ids), r["size"][0].as_py())


def met(anchors: DataFrame, windows: DataFrame, buckets: DataFrame, k: int, same: bool) -> DataFrame:
    """group, window, score and vec_id: the k best rows of each window and lane. windows: group, window, at (the anchor's
    place in its group), high, limit."""
    packed = windows.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("window", "at", "high", "limit"))).alias("windows"), F.min("limit").alias("least"))  # a group's
    asked = anchors.join(packed, "group")
    limits = asked.select("group", "size", F.col("norm").alias("reach"), "least")
    spread = buckets.join(F.broadcast(limits), "size").where(F.col("norm") * F.col("reach") * (1 + 1e-9) + 1 >= F.col("least"))  # a row for each group of anchors
    lanes = spread.select("group", "lane").distinct()
    none = F.lit(None).cast(asked.schema["windows"].dataType)
    columns = ["group", "lane", "kind", "bucket", "size", "norm", "ids", "labels", "norms", "vectors", "windows"]
    both = asked.join(lanes, "group").withColumn("kind", F.lit(0)).withColumn("bucket", F.lit(None).cast("long")).select(*columns)
    both = both.unionByName(spread.withColumn("kind", F.lit(1)).withColumn("windows", none).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = group = numbers = None

        def result() -> pa.RecordBatch:
            window, score, ids = sweep.found
            return pa.record_batch([pa.array(np.full(len(window), group)), pa.array(numbers[window]), pa.array(score), pa.array(ids)], ["group", "window", "score", "vec_id"])

        for r in (b.slice(i, 1) for b in batches for i in range(len(b))):
            ids, labels, norms, whole = arrays(r)
            if r["kind"][0].as_py() == 1:
                sweep.meet(whole, ids, labels, r["norm"][0].as_py())
                continue
            if sweep:
                yield result()
            flat = r["windows"].flatten()
            numbers, at, high, limit = (np.asarray(flat.field(c)) for c in ("window", "at", "high", "limit"))
            sweep, group = Sweep(whole, ids, labels, norms, at, high, limit.copy(), k, same), r["group"][0].as_py()
        if sweep:
            yield result()

    dealt = both.repartition("group", "lane").sortWithinPartitions("group", "lane", "kind", F.desc("norm"), "bucket")
    return dealt.mapInArrow(run, "group long, window long, score long, vec_id long")


def swept(anchors: DataFrame, windows: DataFrame, buckets: DataFrame, k: int, same: bool) -> DataFrame:
    """group, window, rank (from 1), vec_id and score: the k best rows of each window, ties to smaller ids."""
    first = saved(met(anchors, windows, buckets.where("lane = 0"), k, same), "first")
    kth = first.groupBy("group", "window").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k).drop("n")
    after = windows.join(kth, ["group", "window"], "left").withColumn("limit", F.greatest("limit", "kth")).drop("kth")
    every = first.union(met(anchors, after, buckets.where("lane <> 0"), k, same))
    rank = F.row_number().over(Window.partitionBy("group", "window").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def places(anchors: DataFrame) -> DataFrame:
    """group, at and anchor_id of packed anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (b.slice(i, 1) for b in batches for i in range(len(b))):
            ids = arrays(r)[0]
            yield pa.record_batch([pa.array(np.full(len(ids), r["group"][0].as_py())), pa.array(np.arange(len(ids))), pa.array(ids)], ["group", "at", "anchor_id"])

    return anchors.mapInArrow(run, "group long, at long, anchor_id long")


def mined(vectors: DataFrame, every: int, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    vectors: vec_id (integer), label (integer), embedding. Anchors are rows whose vec_id is divisible by `every`. A score is
    the inner product with the anchor of components floor(scale * x). Positives are the `positives` best rows of the
    anchor's label and another id; of each, the `negatives` best rows of other labels whose score is between `low` and
    `high` hundredths of the positive's. Higher scores come first, ties go to smaller ids; fewer rows where there are
    fewer. Rows with a null id, label or vector, or a null or non-finite component, take no part; rows equal in all three
    count once; rows that share an id only are rows of their own. Vectors meet those of their own size. An empty table
    gives no rows. Other columns don't matter. Scores that don't fit 62 bits are an error."""
    rows = saved(quantized(vectors, scale), "whole")
    place = F.col("bucket") % (1 << 32)
    buckets = saved(in_buckets(rows).withColumn("lane", F.col("bucket") - place + F.floor(place / LANE)), "buckets")
    anchors = saved(in_buckets(rows.where(F.col("vec_id") % every == 0)).withColumnRenamed("bucket", "group"), "anchors")
    of = saved(places(anchors), "places")
    all_scores = of.select("group", F.col("at").alias("window"), "at", F.lit(HIGHEST).alias("high"), F.lit(LOWEST).alias("limit"))
    found = swept(anchors, all_scores, buckets, positives, True)
    share = lambda n: F.col("positive_score").cast("decimal(20,0)") * n / 100
    pairs = found.select("group", F.col("window").alias("at"), (F.col("window") * positives + F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = saved(pairs.withColumn("limit", F.ceil(share(low)).cast("long")).withColumn("high", F.floor(share(high)).cast("long")).where("limit <= high"), "positives")
    hits = swept(anchors, pairs.select("group", "window", "at", "high", "limit"), buckets, negatives, False)
    named = hits.join(pairs.select("group", "window", "at", "positive_id", "positive_score"), ["group", "window"]).join(of, ["group", "at"])
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(vectors.withColumn("label", moved), 100)


ORACLE_SQL = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.x, b.x) as bigint) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as rank, vec_id as negative_id, positive_score, score as negative_score
  from p join s on s.anchor_id = p.anchor_id and not s.same where 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 10"""
