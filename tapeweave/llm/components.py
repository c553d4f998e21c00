"""Connected components of links in a table, by hooking every node to its smallest neighbour and contracting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every end of the links a, b. Null ends and loops don't count.

    Each round removes all nodes with a smaller neighbour and leaves the links between the others' groups."""
    order = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = saved(links.where(F.col("a") != F.col("b")).select(*order(F.col("a"), F.col("b"))).distinct(), "links")
    nodes = links.select(F.col("a").alias("id")).union(links.select("b")).distinct().withColumn("component", F.col("id"))
    hooks: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = saved(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("to")), "hooks")
        hooks.append(hook)
        left, right = (hook.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        moved = links.join(left, "a").join(right, "b").where(F.col("a_to") != F.col("b_to"))
        links = saved(moved.select(*order(F.col("a_to"), F.col("b_to"))).distinct(), "links")

    def followed(at: DataFrame, hook: DataFrame) -> DataFrame:
        return at.join(hook.withColumnRenamed("node", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))

    return saved(reduce(followed, hooks, nodes), "components")
