"""Landed answers of candle services: which pool they are for, whether there is anything in them, and their candles as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANDED = "mint string, error string, pools array<struct<id: string, depth: double>>, ohlcv array<array<double>>"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """mint, pool, status and ohlcv of each answer. The pool is the deepest (ties to the smaller id). Fixed values of status:
    echec_reseau (an error, or no JSON), pool_absent, zero_bougie, ok. Candles without a time, or of under five values, are none."""
    read = spark.read.schema(f"{LANDED}, _corrupt_record string").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)
    by_depth = F.transform("pools", lambda p: F.struct((-F.coalesce(p["depth"], F.lit(0.0))).alias("shallow"), p["id"].alias("id")))
    pool = F.array_min(F.filter(by_depth, lambda p: p["id"].isNotNull()))["id"]
    whole = F.filter(F.coalesce("ohlcv", F.array().cast("array<array<double>>")), lambda c: (F.size(c) >= 5) & F.get(c, F.lit(0)).isNotNull())
    status = F.when(F.col("error").isNotNull() | F.col("_corrupt_record").isNotNull(), "echec_reseau").when(F.col("pool").isNull(), "pool_absent").when(F.size("whole") == 0, "zero_bougie").otherwise("ok")
    found = read.withColumn("pool", pool).withColumn("whole", whole)
    return found.select("mint", "pool", status.alias("status"), F.col("whole").alias("ohlcv"))


def candles(answers: DataFrame) -> DataFrame:
    """mint, ts, open, high, low, close and volume, from answers that are ok."""
    names = ("open", "high", "low", "close", "volume")
    each = answers.where("status = 'ok'").select("mint", F.explode("ohlcv").alias("c"))
    return each.select("mint", F.get("c", F.lit(0)).cast("long").alias("ts"), *(F.get("c", F.lit(k)).alias(n) for k, n in enumerate(names, 1)))


def unit_ratios(answers: DataFrame, prices: DataFrame, latest: int) -> DataFrame:
    """mint and ratio: a mint's first candle's price (its open, else its close) over its own price times the rate, near 1
    where units agree. prices: mint, start, price and rate. First candles later than `latest` after the start don't count,
    nor do prices and rates of zero or null."""
    first = F.get("ohlcv", F.lit(0))
    some = lambda k: F.nullif(F.get(first, F.lit(k)), F.lit(0.0))
    known = answers.where("status = 'ok'").select("mint", F.get(first, F.lit(0)).alias("ts"), F.coalesce(some(1), some(4)).alias("candle"))
    near = known.join(prices, "mint").where(F.col("ts") <= F.col("start") + latest)
    return near.select("mint", (F.col("candle") / F.nullif("price", F.lit(0.0)) / F.nullif("rate", F.lit(0.0))).alias("ratio")).where("ratio is not null")
