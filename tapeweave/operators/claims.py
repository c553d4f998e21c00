"""Claims checked against values: what a text says of an artefact, and what the artefact says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def written(value: Column, rule: Column) -> Column:
    """A number as a text writes it: whole, round1, round2 (half to even), dec9 (nine decimals), percent1 (of a share), signed; as it is by any
    other rule."""
    x = value.cast("double")
    out = F.when(rule == "whole", F.bround(x, 0).cast("long").cast("string")).when(rule == "round1", F.format_string("%.1f", F.bround(x, 1))).when(rule == "round2", F.format_string("%.2f", F.bround(x, 2)))
    return out.when(rule == "dec9", F.format_string("%.9f", x)).when(rule == "percent1", F.concat(F.format_string("%.1f", F.bround(100 * x, 1)), F.lit(" %"))).when(rule == "signed", F.format_string("%+d", F.bround(x, 0).cast("long"))).otherwise(value)


def checked(claims: DataFrame, artefacts: DataFrame) -> DataFrame:
    """claim, found (the value as the rule writes it) and status: pass, fail, or missing, where the artefact or the path isn't
    there. claims: claim, artefact, path (of JSON), rule and expected; artefacts: artefact and body (JSON)."""
    value = F.expr("get_json_object(body, path)")
    rows = claims.join(artefacts, "artefact", "left").withColumn("found", F.when(value.isNotNull(), written(value, F.col("rule"))))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("expected"), "pass").otherwise("fail")
    return rows.select("claim", "found", status.alias("status"))
