"""Graphs of wallets and tokens: fleets with their profiles, and giant components with hubs left out one at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeweave.operators.order import medians
from tapeweave.operators.sequence import co_occurrence, components


def variation(x: Column) -> Column:
    """Population standard deviation over mean; 0 for one value or a mean of 0."""
    return F.coalesce(F.try_divide(F.stddev_pop(x), F.avg(x)), F.lit(0.0))


def fleets(rows: DataFrame, least_sol: float, hub: int, together: int, overlap: float, members: int, most: int) -> tuple[DataFrame, DataFrame]:
    """wallet and lead (the fleet's smallest wallet), and the core rows. rows: mint, wallet, sol, ts and created.

    The core has wallets that spent `least_sol` on a mint, less hubs (in the core of `hub` mints or more). Wallets of one
    core are linked if they share `together` mints and that share of the mints of either; components of `members` or more
    are fleets. Mints whose core has more than `most` wallets link nobody."""
    bought = rows.where(F.col("sol") >= least_sol)
    busy = bought.groupBy("wallet").agg(F.countDistinct("mint").alias("n")).where(F.col("n") >= hub)
    core = bought.join(busy, "wallet", "left_anti").checkpoint()
    sizes = core.groupBy("wallet").agg(F.countDistinct("mint").alias("n"))
    a, b = (sizes.select(F.col("wallet").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    pairs = co_occurrence(core, "mint", "wallet", most).where(F.col("shared") >= together).join(a, "a").join(b, "b")
    linked = pairs.where(F.col("shared") >= overlap * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b")
    found = components(linked).select(F.col("id").alias("wallet"), F.col("component").alias("lead"))
    large = found.groupBy("lead").agg(F.count("*").alias("n")).where(F.col("n") >= members).select("lead")
    return found.join(large, "lead").select("wallet", "lead"), core


def fleet_profiles(rows: DataFrame, least_sol: float, hub: int, together: int, overlap: float, members: int, most: int = 200) -> DataFrame:
    """A row for each fleet: lead, n_wallets, n_mints, mode (of members at a mint, the smaller of equally frequent ones),
    mints_at_mode, median, least and most sol of a mint, its variation over mints, the median variation within a mint, the
    longest time within one and the median share of all that was spent on it, and hours between its first and last mint.
    Rows are one for each mint and wallet; see `fleets`."""
    of, core = fleets(rows, least_sol, hub, together, overlap, members, most)
    of = of.checkpoint()
    spent = rows.groupBy("mint").agg(F.sum("sol").alias("all_sol"))
    launches = core.join(of, "wallet").groupBy("lead", "mint").agg(F.count("*").alias("members"), F.sum("sol").alias("sol"), variation(F.col("sol")).alias("inside"), (F.max("ts") - F.min("ts")).alias("span"), F.min("created").alias("created"))
    launches = launches.join(spent, "mint").withColumn("share", F.try_divide("sol", "all_sol")).checkpoint()
    times = launches.groupBy("lead", "members").agg(F.count("*").alias("n"))
    mode = times.groupBy("lead").agg(F.max_by("members", F.struct("n", -F.col("members"))).alias("mode"), F.max("n").alias("mints_at_mode"))
    whole = launches.groupBy("lead").agg(F.count("*").alias("n_mints"), F.min("sol").alias("least_sol"), F.max("sol").alias("most_sol"), variation(F.col("sol")).alias("between"), F.max("span").alias("longest"), F.round((F.max("created") - F.min("created")) / 3600, 1).alias("hours"))
    out = of.groupBy("lead").agg(F.count("*").alias("n_wallets")).join(whole, "lead").join(mode, "lead")
    for column, name in (("sol", "median_sol"), ("inside", "median_inside"), ("share", "median_share")):
        out = out.join(medians(launches, ["lead"], column).select("lead", F.col("median").alias(name)), "lead")
    return out


def giant_shares(members: DataFrame, group: str, item: str, least: int, hubs: int, most: int) -> DataFrame:
    """hub, mints (how many groups have it), giant (nodes of the largest component) and change, for no hub (null) and for
    each of the `hubs` most frequent items left out: groups are linked if they share `least` items or more.

    Leaving out an item takes one from what the pairs of its groups share, so only pairs that share `least` exactly are
    lost; all graphs are searched at once, their nodes named by hub and group. Items of more than `most` groups link none."""
    distinct = members.select(group, item).distinct().checkpoint()
    frequent = distinct.groupBy(item).agg(F.count("*").alias("mints")).where(F.col("mints") <= most)
    chosen = frequent.orderBy(F.desc("mints"), item).limit(hubs).select(F.col(item).alias("hub"), "mints").checkpoint()
    pairs = co_occurrence(distinct, item, group, most).where(F.col("shared") >= least).checkpoint()
    of_hub = distinct.join(F.broadcast(chosen), F.col(item) == F.col("hub")).select("hub", group)  # so many rows as asked for
    edge = of_hub.select("hub", F.col(group).alias("a")).join(of_hub.select("hub", F.col(group).alias("b")), "hub").where("a < b")
    lost = edge.join(pairs.where(F.col("shared") == least), ["a", "b"]).select("hub", "a", "b")
    without = pairs.select("a", "b", F.explode(F.array(*(F.lit(r.hub) for r in chosen.collect()))).alias("hub")) if not chosen.isEmpty() else None  # so many as asked for
    none = pairs.select("a", "b", F.lit(None).cast(chosen.schema["hub"].dataType).alias("hub"))
    graphs = none if without is None else none.unionByName(without.join(lost, ["hub", "a", "b"], "left_anti"))
    node = lambda c: F.struct(F.coalesce(F.col("hub").cast("string"), F.lit("")).alias("hub"), F.col(c).alias("node"))
    found = components(graphs.select(node("a").alias("a"), node("b").alias("b")))
    giants = found.groupBy("component").agg(F.count("*").alias("n")).groupBy(F.col("component.hub").alias("name")).agg(F.max("n").alias("giant"))
    all_hubs = chosen.unionByName(chosen.sparkSession.createDataFrame([(None, None)], f"hub {chosen.schema['hub'].dataType.simpleString()}, mints long")).withColumn("name", F.coalesce(F.col("hub").cast("string"), F.lit("")))
    out = all_hubs.join(giants, "name", "left").select("hub", "mints", F.coalesce("giant", F.lit(0)).alias("giant"))
    base = out.where("hub is null").select(F.col("giant").alias("base"))
    return out.crossJoin(F.broadcast(base)).select("hub", "mints", "giant", (F.col("giant") - F.col("base")).alias("change"))  # one row
