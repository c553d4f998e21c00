"""Identifiers replaced by labels, in free text and in JSON of any depth: text is cut into gaps and matches, matches are
joined to the map, and the pieces are put together again by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = "[1-9A-HJ-NP-Za-km-z]"
#: A whole run of 32 to 44 letters of the base-58 alphabet; a window inside a longer run, such as a signature, is none.
TOKEN = f"(?<!{LETTERS}){LETTERS}{{32,44}}(?!{LETTERS})"
#: A string of JSON, keys included.
STRING = '"(?:[^"\\\\]|\\\\.)*"'


def replaced(rows: DataFrame, key: str, text: str, pattern: str, found: Column, labels: DataFrame, put) -> DataFrame:
    """rows with text's matches of the pattern replaced where labels (digest: the SHA-256 of what is replaced; label) has
    them. key names a row; found is what a `match` stands for, put(label) what is written in its place."""
    pieces = F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    cut = rows.where(F.regexp_like(text, F.lit(pattern))).select(key, F.posexplode(pieces).alias("at", "x")).select(key, "at", "x.gap", "x.match")
    named = cut.withColumn("digest", F.sha2(found.cast("string"), 256)).join(labels.select("digest", "label"), "digest", "left")
    piece = F.struct("at", F.concat("gap", F.coalesce(F.when(F.col("label").isNotNull(), put(F.col("label"))), "match", F.lit(""))).alias("s"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda p: p["s"]), "")
    joined = named.groupBy(key).agg(whole.alias("scrubbed"))  # one row's own pieces
    return rows.join(joined, key, "left").withColumn(text, F.coalesce("scrubbed", text)).drop("scrubbed")


def scrub_text(rows: DataFrame, key: str, text: str, labels: DataFrame) -> DataFrame:
    """Anchored tokens of free text."""
    return replaced(rows, key, text, TOKEN, F.col("match"), labels, lambda label: label)


def scrub_json(rows: DataFrame, key: str, text: str, labels: DataFrame) -> DataFrame:
    """Whole strings of JSON, values and keys at any depth; what is written with escapes is no identifier."""
    inside = F.expr("substring(match, 2, length(match) - 2)")
    return replaced(rows, key, text, STRING, inside, labels, lambda label: F.concat(F.lit('"'), label, F.lit('"')))
