"""Transactions: balance and token deltas, parties, transfers; detector criteria; traces; reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def balance_deltas(transactions: DataFrame, unit: float) -> DataFrame:
    """tx, pos, key and delta of every account, from arrays keys, pre and post that belong together by position."""
    rows = transactions.select("tx", F.posexplode(F.arrays_zip("keys", "pre", "post")).alias("pos", "a"))
    return rows.select("tx", F.col("pos").cast("bigint").alias("pos"), F.col("a.keys").alias("key"), ((F.col("a.post") - F.col("a.pre")) / unit).alias("delta"))


def parties(deltas: DataFrame) -> DataFrame:
    """tx, its sender (the most negative delta), recipient (the most positive; ties to the earlier place) and number of
    accounts."""
    out, into = F.col("delta") < 0, F.col("delta") > 0
    return deltas.groupBy("tx").agg(
        F.min_by(F.when(out, F.col("key")), F.when(out, F.struct("delta", "pos"))).alias("sender"),
        F.max_by(F.when(into, F.col("key")), F.when(into, F.struct(F.col("delta"), -F.col("pos")))).alias("recipient"),
        F.count("*").alias("others"),
    )


def wallet_view(transactions: DataFrame, unit: float) -> DataFrame:
    """tx, the subject's own delta, and the other party: the sender (the account with the lowest delta, ties to the earlier
    place) where the subject gained, the recipient (the highest) where it lost. transactions: tx, subject, err and arrays
    keys, pre and post that belong together by position. Failed ones, and those without the subject, are left out."""
    mine = (F.array_position("keys", F.col("subject")) - 1).cast("int")
    delta = lambda a: (a["post"] - a["pre"]) / unit
    rows = transactions.where(F.col("err").isNull() & F.array_contains("keys", F.col("subject"))).select("tx", mine.alias("mine"), F.arrays_zip("keys", "pre", "post").alias("a"))
    other = F.filter(F.transform("a", lambda a, i: F.struct(delta(a).alias("delta"), i.alias("at"), (-i).alias("back"), a["keys"].alias("key"))), lambda x: x["at"] != F.col("mine"))
    seen = rows.select("tx", delta(F.get("a", F.col("mine"))).alias("delta"), other.alias("other"))
    low = F.array_min(F.transform("other", lambda x: F.struct(x["delta"], x["at"], x["key"].alias("key"))))["key"]
    high = F.array_max(F.transform("other", lambda x: F.struct(x["delta"], x["back"], x["key"].alias("key"))))["key"]
    return seen.select("tx", "delta", F.when(F.col("delta") > 0, low).alias("sender"), F.when(F.col("delta") < 0, high).alias("recipient"))


def token_deltas(pre: DataFrame, post: DataFrame, how: str) -> DataFrame:
    """tx, idx, owner and delta of token balances before and after. how: left keeps accounts that have a balance after;
    full also those that were emptied. A missing balance is 0."""
    a, b = pre.select("tx", "idx", F.col("owner").alias("o0"), F.col("amount").alias("a0")), post.select("tx", "idx", F.col("owner").alias("o1"), F.col("amount").alias("a1"))
    joined = b.join(a, ["tx", "idx"], how)
    return joined.select("tx", "idx", F.coalesce("o1", "o0").alias("owner"), (F.coalesce("a1", F.lit(0.0)) - F.coalesce("a0", F.lit(0.0))).alias("delta"))


def inbound(transactions: DataFrame) -> DataFrame:
    """tx, destination, units and number of transfers, from instructions and those nested in `inner`."""
    every = F.filter(F.concat("instructions", F.flatten("inner")), lambda i: i.is_transfer)
    rows = transactions.select("tx", F.inline(every))
    return rows.groupBy("tx", "destination").agg(F.sum("units").alias("units"), F.count("*").alias("transfers"))


def fan_out(events: DataFrame, by: str, ahead: int) -> DataFrame:
    """by, seq and delta of credits that a debit of the same size to two payees or more follows within `ahead` rows, and
    the first such debit's seq. events: by, seq, t, delta and payees."""
    w = Window.partitionBy(by).orderBy("t", "seq")
    here = F.col("delta")

    def match(k: int):
        return F.when((F.abs(F.lead("delta", k).over(w) + here) < 0.01) & (F.lead("payees", k).over(w) >= 2), F.lead("seq", k).over(w))

    found = events.withColumn("debit", F.coalesce(*(match(k) for k in range(1, ahead + 1))))
    return found.where((here > 0.5) & F.col("debit").isNotNull()).select(by, "seq", "delta", "debit")


def shared(events: DataFrame, label: str, key: str, least: int) -> DataFrame:
    """label, how many of its keys `least` wallets or more share, and whether any. events: label, key, wallet."""
    keys = events.groupBy(label, key).agg(F.countDistinct("wallet").alias("n"))
    return keys.groupBy(label).agg(F.count_if(F.col("n") >= least).alias("shared")).withColumn("fires", F.col("shared") > 0)


def trace(roots: DataFrame, payments: DataFrame, levels: int, most: int, known: DataFrame | None = None) -> DataFrame:
    """root, node and level: payers of payers of each root, up to so many levels, over the `most` largest payers of each
    payee (ties to smaller payers). payments: payer, payee, units. known: nodes (node) whose payers aren't followed.

    A level goes on from nodes that no earlier one has seen; each is checkpointed."""
    sums = payments.where("payer <> payee").groupBy("payer", "payee").agg(F.sum("units").alias("units"))
    rank = F.row_number().over(Window.partitionBy("payee").orderBy(F.desc("units"), "payer"))
    top = sums.withColumn("rank", rank).where(F.col("rank") <= most).select("payee", "payer").checkpoint()
    at = roots.select("root", F.col("root").alias("node")).distinct().withColumn("level", F.lit(0)).checkpoint()
    seen = at
    for k in range(1, levels + 1):
        from_ = at if known is None else at.join(known.select("node").distinct(), "node", "left_anti")
        paid = from_.join(top, F.col("node") == F.col("payee")).select("root", F.col("payer").alias("node")).distinct()
        at = paid.join(seen, ["root", "node"], "left_anti").withColumn("level", F.lit(k)).checkpoint()
        seen = seen.unionByName(at)
    return seen


def reconciled(a: DataFrame, b: DataFrame, key: str, tolerance: float) -> DataFrame:
    """How many keys two implementations (key, value) share, how many values agree, and the largest difference."""
    gap = F.abs(F.col("a") - F.col("b"))
    both = a.select(key, F.col("value").alias("a")).join(b.select(key, F.col("value").alias("b")), key)
    return both.agg(F.count("*").alias("n"), F.count_if(gap < tolerance).alias("identical"), F.round(F.max(gap), 6).alias("largest"))


def coalesced(passes: list[DataFrame], key: str) -> DataFrame:
    """Of each key the best covered measurement of several passes; of equally covered ones the later pass's. passes: key,
    covered, value, pass."""
    order = F.struct("covered", "pass")
    rows = reduce(DataFrame.unionByName, passes)
    return rows.groupBy(key).agg(F.max_by("value", order).alias("value"), F.max("covered").alias("covered"), F.max_by("pass", order).alias("pass"))


def controls(anchors: DataFrame, candidates: DataFrame, reach: int, most: int) -> DataFrame:
    """anchor, control, distance and rank: the `most` nearest candidates within reach of each anchor, ties to the smaller.

    The range join is binned by reach."""
    at = lambda c: F.floor(F.col(c) / reach)
    near = anchors.withColumn("bin", F.explode(F.array(at("anchor") - 1, at("anchor"), at("anchor") + 1))).join(candidates.withColumn("bin", at("control")), "bin")
    near = near.withColumn("distance", F.abs(F.col("control") - F.col("anchor"))).where(F.col("distance") <= reach)
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy("distance", "control"))
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("anchor", "control", "distance", "rank")


def attrition(captures: DataFrame, swaps: DataFrame, floor: float, least_span: int, least_since: int) -> DataFrame:
    """mint and the first of the ordered reasons to reject a capture, or ok. captures: mint, created; swaps: mint, ts, side,
    tokens, sol. Captures without swaps are empty."""
    good = "ts is not null and tokens > 0 and sol > 0"
    sums = swaps.groupBy("mint").agg(
        F.count("*").alias("n"), F.expr(f"count_if({good})").alias("usable"), F.expr(f"min(ts) filter (where {good})").alias("first"), F.expr(f"max(ts) filter (where {good})").alias("last"),
        F.expr(f"count_if({good} and side = 'buy')").alias("buys"), F.expr(f"count_if({good} and sol >= {floor})").alias("large"),
    )
    x = captures.join(sums, "mint", "left")
    reason = F.when(F.col("n").isNull(), "empty").when(F.col("usable") == 0, "no_usable_swap").when(F.col("last") - F.col("first") < least_span, "short_span")
    reason = reason.when(F.col("last") - F.col("created") < least_since, "short_since_creation").when(F.col("buys") == 0, "no_buy").when(F.col("large") == 0, "no_large_swap")
    return x.select("mint", reason.otherwise("ok").alias("status"))
