"""Exact order statistics of groups of any size, without sorting a group in one task or collecting it.

Different values are counted first, so that a value which a third of all rows share is one row; they are then dealt out by
ranges of (group, value), and a value's rank is what its range has before it plus what earlier ranges of its group hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.operators.sequence import as_of


def value_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n (its rows), start (the rank of the first of them within its group, from 0) and total (the group's rows).
    Nulls have no rank: n is 0 and start is that of the least value."""
    keys = [f"_by{k}" for k in range(len(by))]  # whatever the columns are called
    named = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(value).alias("_v"))
    counts = named.groupBy(*keys, "_v").agg(F.count("*").alias("_n")).withColumn("_n", F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0))
    ranged = counts.repartitionByRange(*keys, "_v").withColumn("_part", F.spark_partition_id()).checkpoint()
    held = ranged.groupBy("_part", *keys).agg(F.sum("_n").alias("_held"))  # a row for each range and group in it
    of_group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_held").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = held.select(F.col("_part").alias("_of"), *(F.col(k).alias(f"_of{k}") for k in keys), before.alias("_before"), F.sum("_held").over(of_group).alias("_total"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_part", *keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here = ranged.withColumn("_inside", inside)
    same = here["_part"] == ends["_of"]
    for k in keys:
        same &= here[k].eqNullSafe(ends[f"_of{k}"])
    shown = [F.col(k).alias(c) for c, k in zip(by, keys)]
    return here.join(ends, same).select(*shown, F.col("_v").alias(value), F.col("_n").alias("n"), (F.col("_before") + F.col("_inside")).alias("start"), F.col("_total").alias("total"))


def order_statistics(rows: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """by, total and the values at places (ranks from 0, expressions over total); null where there is no such rank."""
    ranks = value_ranks(rows, by, value)
    at = lambda k: F.max(F.when((F.col("start") <= k) & (k < F.col("start") + F.col("n")), F.col(value)))
    return ranks.groupBy(*by).agg(F.max("total").alias("total"), *(at(k).alias(name) for name, k in places.items()))


def nearest(q: float) -> Column:
    """The place round-half-even(q * (total - 1))."""
    return F.bround(F.lit(q) * (F.col("total") - 1), 0).cast("long")


def floor_of(q: float) -> Column:
    return F.floor(F.lit(q) * (F.col("total") - 1))


def middle() -> dict[str, Column]:
    """The places whose values' mean is the median."""
    return {"low": F.floor((F.col("total") - 1) / 2), "high": F.floor(F.col("total") / 2)}


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, total and median; null for a group without values."""
    return order_statistics(rows, by, value, middle()).select(*by, "total", ((F.col("low") + F.col("high")) / 2).alias("median"))


def exclusive(rows: DataFrame, by: list[str], value: str, q: float, more: dict[str, Column]) -> DataFrame:
    """by, total, quantile (linear between the values around place q * (total + 1), counted from 1; null beyond the ends) and
    the values at more places."""
    place = F.lit(q) * (F.col("total") + 1)
    low = F.floor(place)
    found = order_statistics(rows, by, value, {"below": low - 1, "above": low, **more})
    return found.select(*by, "total", (F.col("below") + (place - low) * (F.col("above") - F.col("below"))).alias("quantile"), *more)


def shortest_windows(rows: DataFrame, by: str, value: str, share: float) -> DataFrame:
    """by and span: the length of the shortest span of values that holds the share of a group's rows, one at least.

    A span of k rows that begins with a value begins best with the first of its rows and ends at the rank k - 1 later; what
    value has that rank is an as-of join over ranks."""
    ranks = value_ranks(rows.where(F.col(value).isNotNull()), [by], value)
    k = F.greatest(F.lit(1), F.floor(F.col("total") * share))
    begins = ranks.select(by, (F.col("start") + k - 1).alias("ts"), F.col(value).alias("id"), "total").where("ts < total").drop("total")
    ends = as_of(begins, ranks.select(by, F.col("start").alias("ts"), F.col(value).alias("end")), [by], "end", width=4096)
    return ends.groupBy(by).agg(F.min(F.col("end") - F.col("id")).alias("span"))
