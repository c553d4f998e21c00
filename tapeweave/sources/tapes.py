"""Tapes: flat trade ticks and transfers, from nested captures or from star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAPTURE = (
    "mint string, detect_mc double, created bigint, supply double, pool string, snipers array<string>, captured_at bigint, capture_min double, n_swaps bigint, "
    "swaps array<struct<ts:bigint,side:string,trader:string,sol:double,tokens:double,price:double,src:string,progs:array<string>,sig:string>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str) -> Column:
    return F.unix_seconds(F.col(column).cast("timestamp"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Captures from JSON lines, with unreadable lines kept in _corrupt_record."""
    return spark.read.schema(f"{CAPTURE}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def swaps_of(captured: DataFrame) -> DataFrame:
    """One row for each swap of nested captures; seq keeps the file's order for ties."""
    return captured.select("mint", "created", F.posexplode("swaps").alias("seq", "swap")).select("mint", "created", "seq", "swap.*")


def line_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a tape: mint, ts, seq, trader, side, tokens, sol."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("mint"), epoch("l_shipdate").alias("ts"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_suppkey").alias("trader"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").alias("tokens"), F.col("l_extendedprice").alias("sol"),
    )


def event_tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a tape: mint (the type), ts, seq, trader, side and price."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("mint"), epoch("ts").alias("ts"), F.col("event_id").alias("seq"), F.col("user_id").alias("trader"),
        F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("value").alias("price"), (F.col("event_id") % 7 + 1).cast("double").alias("sol"),
    )
