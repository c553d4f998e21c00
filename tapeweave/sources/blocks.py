"""Landed blocks: one answer for each slot asked, what tokens they create, and how many slots had none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "slot bigint, answer struct<transactions: array<struct<err: string, signatures: array<string>, keys: array<struct<pubkey: string, signer: boolean>>>>>"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """slot and answer of each line; lines that aren't JSON of the schema have neither and count as no answer."""
    return spark.read.schema(BLOCK).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").json(path)


def creations(blocks: DataFrame, program: str, suffix: str, start: int, slots: int) -> DataFrame:
    """mint, slot and sig (the transaction's first signature, null if it has none) of each signing key that ends in the suffix,
    in transactions that succeeded and name the program. Only `slots` slots from `start` on take part."""
    asked = blocks.where(F.col("slot").between(start, start + slots - 1))
    each = asked.select("slot", F.inline("answer.transactions"))
    made = each.where(F.col("err").isNull() & F.exists("keys", lambda k: k["pubkey"] == program))
    minted = F.filter("keys", lambda k: k["signer"] & F.endswith(k["pubkey"], F.lit(suffix)))
    return made.select("slot", F.get("signatures", F.lit(0)).alias("sig"), F.explode(minted["pubkey"]).alias("mint")).select("mint", "slot", "sig")


def tally(blocks: DataFrame, found: DataFrame, start: int, slots: int) -> DataFrame:
    """slots asked, answered, skipped (asked without an answer: no block, or no line) and found creations and mints: one row."""
    here = F.col("slot").between(start, start + slots - 1) & F.col("answer").isNotNull()
    both = blocks.where(here).select("slot", F.lit(None).cast("string").alias("mint")).unionByName(found.select(F.lit(None).cast("long").alias("slot"), "mint"))
    answered = F.countDistinct("slot")
    return both.agg(F.lit(slots).cast("long").alias("slots"), answered.alias("answered"), (F.lit(slots) - answered).alias("skipped"), F.count("mint").alias("found"), F.countDistinct("mint").alias("mints"))
