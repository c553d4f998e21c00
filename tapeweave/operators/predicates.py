"""What counts: which cases can be measured, what a credit is, which swaps buy from the curve, and when an exit is safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def measurable(status: Column, drift: Column, spent: Column, most: float) -> Column:
    """An ok case whose clocks, where known, differ by no more than `most`, with something spent in the window."""
    return (F.coalesce(status, F.lit("")) == "ok") & (F.coalesce(F.abs(drift), F.lit(0.0)) <= most) & (F.coalesce(spent, F.lit(0.0)) > 0)


def credits(transactions: DataFrame, unit: float, least: float, system: list) -> DataFrame:
    """tx, subject, gain, sources and nature of transactions that bring the subject `least` or more: produit_de_vente where
    it gave tokens away, financement where it didn't (a transfer, or a loser of as much is known), else
    indetermine_sans_source. transactions: tx, subject, kind, arrays keys, pre and post that belong together by position, and
    tokens (array of owner and change). An account that stands in keys more than once has the sum of its changes. sources:
    other accounts but those of the system that lost `least` or more, the largest loss first, ties to smaller keys."""
    each = transactions.select("tx", "subject", F.explode(F.arrays_zip("keys", "pre", "post")).alias("a")).groupBy("tx", "subject", F.col("a.keys").alias("key")).agg((F.sum(F.col("a.post") - F.col("a.pre")) / unit).alias("delta"))
    mine = F.col("key") == F.col("subject")
    lost = ~mine & (F.col("delta") <= -least) & ~F.col("key").isin(*system) if system else ~mine & (F.col("delta") <= -least)
    sums = each.groupBy("tx", "subject").agg(F.max(F.when(mine, F.col("delta"))).alias("gain"), F.sort_array(F.collect_list(F.when(lost, F.struct("delta", "key")))).alias("lost"))  # accounts of one transaction
    sold = F.exists(F.coalesce("tokens", F.expr("array()").cast("array<struct<owner: bigint, change: double>>")), lambda t: (t["owner"] == F.col("subject")) & (t["change"] < 0))
    nature = F.when(F.coalesce("sold", F.lit(False)), "produit_de_vente").when((F.col("kind") == "TRANSFER") | (F.size("lost") > 0), "financement").otherwise("indetermine_sans_source")
    said = transactions.select("tx", "subject", "kind", sold.alias("sold"))
    return sums.where(F.col("gain") >= least).join(said, ["tx", "subject"]).select("tx", "subject", "gain", F.col("lost.key").alias("sources"), nature.alias("nature"))


def curve_purchases(changes: DataFrame, share: float = 0.85, least_paid: float = 0.0005) -> DataFrame:
    """mint, idx, signer, sol, tokens and price of clean purchases from the curve. changes: mint, idx, account, change,
    signer, sol. The curve is the account that gains most in the mint's first transaction (ties to the smaller); in a clean
    purchase it loses over 1, the signer gains over 1 and `share` of that loss or more, and over `least_paid` is paid."""
    first = changes.groupBy("mint").agg(F.min("idx").alias("first"))
    made = changes.join(first, "mint")
    curve = made.where(F.col("idx") == F.col("first")).groupBy("mint", "first").agg(F.max_by("account", F.struct(F.col("change"), -F.col("account"))).alias("curve"))
    later = changes.join(curve, "mint").where(F.col("idx") > F.col("first"))
    of = lambda who: F.coalesce(F.sum(F.when(F.col("account") == F.col(who), F.col("change"))), F.lit(0.0))
    sums = later.groupBy("mint", "idx", "signer", "sol").agg(of("curve").alias("lost"), of("signer").alias("tokens"))
    clean = sums.where((F.col("lost") < -1) & (F.col("tokens") > 1) & (F.col("tokens") >= -share * F.col("lost")) & (F.col("sol") > least_paid))
    return clean.select("mint", "idx", "signer", "sol", "tokens", (F.col("sol") / F.col("tokens")).alias("price"))


def safe_exits(entries: DataFrame, bucket: int, margin: int = 120, room: int = 60) -> DataFrame:
    """Entries (with start, the time of entry, and last, that of the last swap) and their safe (margin before the last
    swap), timeout (the end of the last whole bucket before that, one at least, but no later than safe) and flag: no_room
    where safe is less than `room` after the entry, and neither time holds."""
    safe = F.col("last") - margin
    steps = F.floor((safe - F.col("start")) / bucket)
    timeout = F.least(F.col("start") + bucket * F.greatest(F.lit(1), steps), safe)
    fits = safe >= F.col("start") + room
    return entries.select("*", F.when(fits, safe).alias("safe"), F.when(fits, timeout).alias("timeout"), F.when(fits, "ok").otherwise("no_room").alias("flag"))


def cut_at(planned: Column, safe: Column) -> Column:
    """When an exit planned for some time takes place: then, but no later than is safe."""
    return F.least(planned, safe)


def peaks(ticks: DataFrame, nth: int) -> DataFrame:
    """mint, peak (the time of the highest price, ties to the earliest), seen (the time of the nth tick) and price then.
    ticks: mint, ts, seq, price. Mints of fewer ticks are left out."""
    number = F.row_number().over(Window.partitionBy("mint").orderBy("ts", "seq"))
    seen = ticks.withColumn("number", number).where(F.col("number") == nth).select("mint", F.col("ts").alias("seen"), F.col("price").alias("price"))
    return seen.join(ticks.groupBy("mint").agg(F.max_by("ts", F.struct(F.col("price"), -F.col("ts"))).alias("peak")), "mint")
