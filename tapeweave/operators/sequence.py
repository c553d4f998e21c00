"""Order, time and graph operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.operators.meetings import Met, changes, met, whole_cells


def gap_clusters(events: DataFrame, by: list[str], gap: int, order: list[str]) -> DataFrame:
    """Adds cluster, from 0: a new one begins where more than `gap` lies between a row and the one before."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = (F.col(order[0]) - F.lag(order[0]).over(w) > gap).cast("int")
    return events.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def as_of(left: DataFrame, right: DataFrame, by: list[str], value: str, width: int = 86_400) -> DataFrame:
    """left (by, ts, id) with the value of right's (by, ts) last row at or before ts; before the first row, the first's.
    Values are not null.

    Rows are dealt out by bins of `width` in time, so that one key fills many tasks; what a bin takes over from those
    before it comes from one row for each bin."""
    bin = F.floor(F.col("ts") / width).alias("bin")
    both = left.select(*by, "ts", "id", F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("kind"), bin).unionByName(
        right.select(*by, "ts", F.lit(None).cast(left.schema["id"].dataType).alias("id"), value, F.lit(0).alias("kind"), bin)
    )
    inside = Window.partitionBy(*by, "bin").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    bins = both.groupBy(*by, "bin").agg(F.max_by(value, F.when(F.col("kind") == 0, F.col("ts"))).alias("newest"))
    earlier = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.select(*by, "bin", F.last("newest", ignorenulls=True).over(earlier).alias("carried"))
    first = right.groupBy(*by).agg(F.min_by(value, "ts").alias("first"))
    rows = both.withColumn("found", F.last(value, ignorenulls=True).over(inside)).where(F.col("kind") == 1)
    rows = rows.join(carried, [*by, "bin"]).join(first, by, "left")
    return rows.select(*by, "ts", "id", F.coalesce("found", "carried", "first").alias(value))


def nearest(left: DataFrame, right: DataFrame, by: list[str], value: str, tolerance: int) -> DataFrame:
    """left (by, ts, id) with the value of right's nearest row within the tolerance; ties to the earlier."""

    def measure(x: Met) -> list:
        if not x.n:
            return [pa.nulls(len(x.left), x.right[f"_r_{value}"].type)]
        after = x.since(0)
        before = x.held[np.maximum(after - 1, 0)]
        at = x.held[np.minimum(after, x.n - 1)]
        none = x.stride
        back = np.where((after > 0) & (before >= x.first) & (x.asked - before <= tolerance), x.asked - before, none)
        ahead = np.where((after < x.n) & (at < x.first + x.stride) & (at - x.asked <= tolerance), at - x.asked, none)
        place = np.where(back <= ahead, after - 1, after)
        return [x.right[f"_r_{value}"].combine_chunks().take(pa.array(place, mask=np.minimum(back, ahead) == none))]

    kind = right.schema[value].dataType.simpleString()
    found = met(left.select(*by, "ts", "id"), right.select(*by, "ts", value), by, tolerance, (-1, 0, 1), [], f"{value} {kind}", measure)
    return found.select(*by, "ts", "id", value)


def shortest_window(times: Column, share: float) -> Column:
    """Of a collected array of times: the length of the shortest span that holds the share of them (one at least)."""
    s = F.sort_array(times)
    k = F.greatest(F.lit(1), F.floor(F.size(s) * share).cast("int"))
    return F.array_min(F.transform(F.sequence(F.lit(0), F.size(s) - k), lambda i: F.get(s, i + k - 1) - F.get(s, i)))


def co_occurrence(members: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """Pairs of items and the groups they share; groups of more than `most` items are hubs and don't count, which bounds
    the pairs."""
    distinct = members.select(group, item).distinct()
    fit = distinct.groupBy(group).agg(F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= most)).select(group)
    kept = distinct.join(fit, group)
    pairs = kept.select(group, F.col(item).alias("a")).join(kept.select(group, F.col(item).alias("b")), group).where(F.col("a") < F.col("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def jaccard(members: DataFrame, group: str, item: str, most: int) -> DataFrame:
    sizes = members.groupBy(item).agg(F.countDistinct(group).alias("n"))
    pairs = co_occurrence(members, group, item, most)
    a, b = (sizes.select(F.col(item).alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    joined = pairs.join(a, "a").join(b, "b")
    return joined.select("a", "b", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def independent(members: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """Pairs of items with shared, n_a, n_b (groups of either) and total, all over the groups that co_occurrence counts: those
    of up to `most` items. Groups come whole and sorted to a task, which lists their pairs; a null group has no pairs and
    isn't counted in total, but its items are in n_a and n_b."""
    kind = members.schema[item].dataType.simpleString()
    dealt = members.select(F.col(group).alias("_cell"), F.col(item).alias("i")).repartition("_cell").sortWithinPartitions("_cell", "i")

    def kept(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Different items of the groups that count, their groups' numbers, and whether the group isn't null."""
        item, new = rows["i"].combine_chunks(), changes(rows, 0)
        code = pc.fill_null(item.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        first = new.copy()
        first[1:] |= code[1:] != code[:-1]
        of, named = np.cumsum(new)[first], rows["_cell"].is_valid().to_numpy()[first]
        fit = (np.bincount(of)[of] <= most) | ~named
        return item.filter(pa.array(first)).filter(pa.array(fit)), of[fit], named[fit]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches, 0):
            items, of, named = kept(rows)
            known = items.is_valid().to_numpy(zero_copy_only=False) & named
            at, step = np.flatnonzero(known), 1
            while len(at := at[at + step < len(of)]):
                at = at[of[at + step] == of[at]]
                yield from pa.table([items.take(pa.array(at)), items.take(pa.array(at + step))], ["a", "b"]).to_batches(max_chunksize=10_000)
                step += 1

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches, 0):
            items, of, named = kept(rows)
            groups = len(np.unique(of[named]))
            found = pa.table([pc.value_counts(items).field(k) for k in (0, 1)], ["i", "n"])
            found = found.filter(pc.field("i").is_valid())
            yield from pa.concat_tables([found, pa.table([pa.nulls(1, items.type), pa.array([groups])], ["i", "n"])]).to_batches()

    counts = dealt.mapInArrow(sizes, f"i {kind}, n long").groupBy("i").agg(F.sum("n").alias("n"))
    total = counts.where("i is null").select(F.col("n").alias("total"))
    a, b = (counts.where("i is not null").select(F.col("i").alias(x), F.col("n").alias(f"n_{x}")).hint("shuffle_hash") for x in "ab")
    shared = dealt.mapInArrow(pairs, f"a {kind}, b {kind}").groupBy("a", "b").agg(F.count("*").alias("shared"))
    return shared.join(a, "a").join(b, "b").crossJoin(F.broadcast(total)).select("a", "b", "shared", "n_a", "n_b", "total")  # one row


def lift(members: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """Pairs of items with the groups they share, the number expected of independent items, and their ratio."""
    expected = F.col("n_a") * F.col("n_b") / F.col("total")
    return independent(members, group, item, most).select("a", "b", "shared", expected.alias("expected"), (F.col("shared") / expected).alias("lift"))


def stored(df: DataFrame) -> DataFrame:
    """The rows written in the folder of checkpoints and read again. A checkpoint keeps the plan's estimate of its size, which
    joins multiply: over rounds that join its digits double each time, until planning takes all the time there is."""
    base = df.sparkSession.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """id and component, the smallest id reachable, of the ends of edges a, b; hooks nodes to their smallest neighbours
    and contracts until no edge is left; each round is written in the shared folder."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("component", F.col("id"))
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")))
        label = stored(label.join(hook, F.col("component") == F.col("node"), "left").select("id", F.coalesce("to", "component").alias("component")))
        left, right = (hook.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        moved = edges.join(left, "a").join(right, "b").where("a_to <> b_to")
        edges = stored(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
    return label


def split_exists(events: DataFrame, label: str, tolerance: float, window: int, least: int) -> DataFrame:
    """label and whether some event is met, within relative tolerance above its amount and the time window, by events of
    other wallets so that `least` wallets take part. events: label, wallet, amount, ts, seq.

    The self join is binned by the amount's logarithm."""
    width = F.log1p(F.lit(tolerance))
    bin = F.floor(F.ln("amount") / width)
    seeds = events.select(label, *(F.col(c).alias(f"s_{c}") for c in ("wallet", "amount", "ts", "seq")), F.explode(F.array(bin, bin + 1)).alias("bin"))
    met = seeds.join(events.withColumn("bin", bin), [label, "bin"]).where(
        "(amount > s_amount or amount = s_amount and seq > s_seq) and abs(ts - s_ts) <= %d and wallet <> s_wallet and amount <= s_amount * (1 + %r)" % (window, tolerance)
    )
    hits = met.groupBy(label, "s_seq").agg(F.countDistinct("wallet").alias("n")).where(F.col("n") >= least - 1).select(label).distinct()
    return events.select(label).distinct().join(hits.withColumn("hit", F.lit(True)), label, "left").select(label, F.coalesce("hit", F.lit(False)).alias("split"))
