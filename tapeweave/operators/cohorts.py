"""Who and what is compared: first signers of a token, controls that traded enough, clean populations, rates at anchors of each
month, deposits with what is swept out, and the largest group of equal credits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.operators import ledger, order
from tapeweave.operators.sequence import as_of


def first_signers(touches: DataFrame, most: int, window: int) -> DataFrame:
    """mint, signer, rank, ts and seq: the first `most` different signers of each token within `window` seconds of the first
    transaction that touches it, signed or not, in order of (ts, seq). touches: mint, ts, seq, signer (null: unknown; such a
    transaction names nobody, but may be the first). Signers are settled before they are ranked, so that a token which a third
    of all transactions touch shuffles a row for each signer, and at most `most` of each task are ranked."""
    signers = touches.where("ts is not null").groupBy("mint", "signer").agg(F.min(F.struct("ts", "seq")).alias("first"))
    born = signers.groupBy("mint").agg(F.min("first.ts").alias("born"))
    early = signers.where(F.col("signer").isNotNull()).join(born, "mint").where(F.col("first.ts") <= F.col("born") + window)
    rank = F.row_number().over(Window.partitionBy("mint").orderBy("first.ts", "first.seq", "signer"))
    return early.withColumn("rank", rank).where(F.col("rank") <= most).select("mint", "signer", "rank", "first.ts", "first.seq")


def active_controls(anchors: DataFrame, candidates: DataFrame, reach: int, most: int, least: int) -> DataFrame:
    """anchor, control, distance, rank and eligible (how many could have been taken): the `most` nearest candidates within
    reach of each anchor that aren't anchors themselves, neither graduated nor led, whose first page is known (genesis) and
    whose transactions are known and `least` or more. candidates: control, graduated, led, transactions, genesis; nulls of the
    first two are no, of the others unknown, which takes no part."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    fit = candidates.where(no(F.col("graduated")) & no(F.col("led")) & (F.col("transactions") >= least) & F.col("genesis"))
    fit = fit.join(anchors.select(F.col("anchor").alias("control")), "control", "left_anti")
    near = ledger.controls(anchors, fit, reach, 2 * reach + 1)  # every one within reach
    counted = near.withColumn("eligible", F.count("*").over(Window.partitionBy("anchor")))
    return counted.where(F.col("rank") <= most)


def populations(documents: DataFrame) -> DataFrame:
    """population and the rows of A_clean (not poisoned), B_clean and C_clean (regime, plausible value and true peak are all
    known to be good) and B_priced (B_clean of a positive detected value), from documents of arrays A, B and C."""
    each = documents.select(F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col(p).alias("rows")) for p in "ABC"))).alias("x")).select("x.p", F.inline("x.rows"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    good = yes("q_mc_regime_ok") & yes("q_mc_plausible") & yes("o_ath_true")
    names = F.when(F.col("p") == "A", F.when(~yes("poison_default"), F.array(F.lit("A_clean")))).when(good & (F.col("p") == "B") & (F.col("detect_mc") > 0), F.array(F.lit("B_clean"), F.lit("B_priced")))
    return each.select(F.explode(names.when(good, F.array(F.concat("p", F.lit("_clean"))))).alias("population"), *(c for c in each.columns if c != "p"))


def anchors_of(bounds: DataFrame, each: int, settle: int = 3600) -> DataFrame:
    """month, start, end and anchor (seconds): `each` times spread evenly over every month of bounds (one row: born, now), those
    later than `settle` before now left out. The last month ends now."""
    month = F.explode(F.sequence(F.trunc(F.timestamp_seconds("born"), "month"), F.trunc(F.timestamp_seconds("now"), "month"), F.expr("interval 1 month")))
    at = lambda c: F.unix_seconds(c.cast("timestamp"))
    months = bounds.select("born", "now", month.alias("m")).select("born", "now", F.date_format("m", "yyyy-MM").alias("month"), at(F.col("m")).alias("start"), at(F.add_months("m", 1)).alias("next"))
    place = F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("k")
    spread = months.select("*", place).withColumn("anchor", F.floor(F.col("start") + (F.col("next") - F.col("start")) * (F.col("k") + 0.5) / each))
    return spread.where(F.col("anchor") < F.col("now") - settle).select("month", "start", F.least("next", "now").alias("end"), "anchor", "born")


def anchor_rates(creations: DataFrame, each: int, page: int, least: int) -> DataFrame:
    """month, start, end, anchor, n, span and rate: at each anchor the last `page` creations (ts, seconds) before it, how
    many seconds they span and (n - 1) / span, null where the span is 0. Pages of fewer than `least` are left out.

    A page is told by two ranks: different times are counted and ranked by ranges, and anchors look up the newest and the
    oldest of their page as of their time and rank, so no creation is joined to an anchor."""
    bounds = creations.agg(F.min("ts").alias("born"), F.max("ts").alias("now"))
    anchors = anchors_of(bounds, each).checkpoint()
    ranks = order.value_ranks(creations.where("ts is not null").select(F.lit(0).alias("all"), "ts"), ["all"], "ts").checkpoint()
    newest = ranks.select("all", "ts", F.struct((F.col("start") + F.col("n")).alias("before"), F.col("ts").alias("newest")).alias("hit"))
    seen = as_of(anchors.select(F.lit(0).alias("all"), (F.col("anchor") - 1).alias("ts"), F.col("anchor").alias("id")), newest, ["all"], "hit")
    seen = seen.join(anchors, F.col("id") == F.col("anchor")).where(F.col("anchor") > F.col("born")).select("anchor", "hit.before", "hit.newest", F.least("hit.before", F.lit(page)).alias("n"))
    seen = seen.where(F.col("n") >= least)
    ends = as_of(seen.select(F.lit(0).alias("all"), (F.col("before") - F.col("n")).alias("ts"), F.col("anchor").alias("id")), ranks.select("all", F.col("start").alias("ts"), F.col("ts").alias("oldest")), ["all"], "oldest", width=4096)
    spans = seen.join(ends.select(F.col("id").alias("anchor"), "oldest"), "anchor").select("anchor", "n", (F.col("newest") - F.col("oldest")).alias("span"))
    return anchors.join(spans, "anchor").select("month", "start", "end", "anchor", "n", "span", F.when(F.col("span") > 0, (F.col("n") - 1) / F.col("span")).alias("rate"))


def monthly_rates(creations: DataFrame, each: int, page: int, least: int) -> DataFrame:
    """month, anchors (usable ones), rate (the median of theirs) and estimate (that times the month's seconds, up to now).
    Months without a usable anchor are left out; without a rate both values are null."""
    rates = anchor_rates(creations, each, page, least)
    months = rates.groupBy("month", "start", "end").agg(F.count("*").alias("anchors"), F.median("rate").alias("rate"))  # `each` rows a month
    return months.select("month", "anchors", "rate", (F.col("rate") * (F.col("end") - F.col("start"))).alias("estimate"))


def deposits(views: DataFrame, closes: DataFrame) -> DataFrame:
    """By month, and over all (month null): incoming transfers n, what they brought (units), worth (units at the close of the
    day; null if a day has none: it is not guessed), unpriced (such transfers), different senders, returned and returned_units
    (transfers whose sender has also been paid out to), swept (units paid out) and residual (units less swept). views: subject,
    month, day, units (a whole number, negative: out), sender, recipient; closes: day, close."""
    out = views.where("units < 0").select("subject", F.col("recipient").alias("sender")).where("sender is not null").distinct().withColumn("back", F.lit(True))
    x = views.join(closes, "day", "left").join(out, ["subject", "sender"], "left")
    into = F.col("units") > 0
    unpriced = F.count_if(into & F.col("close").isNull())
    sums = x.rollup("month").agg(
        F.grouping("month").alias("all"), F.count_if(into).alias("n"), F.coalesce(F.sum(F.when(into, F.col("units"))), F.lit(0)).alias("units"), unpriced.alias("unpriced"),
        F.when(unpriced == 0, F.sum(F.when(into, F.round(F.col("units") * F.col("close")).cast("long")))).alias("worth"), F.countDistinct(F.when(into, F.col("sender"))).alias("senders"),
        F.count_if(into & F.col("back")).alias("returned"), F.coalesce(F.sum(F.when(into & F.col("back"), F.col("units"))), F.lit(0)).alias("returned_units"),
        F.coalesce(F.sum(F.when(F.col("units") < 0, -F.col("units"))), F.lit(0)).alias("swept"),
    )
    return sums.withColumn("residual", F.col("units") - F.col("swept")).drop("all")


def equal_credits(credits: DataFrame) -> DataFrame:
    """wallet of the largest group of credits that are equal at nine decimals (ties to the smaller amount), each with the
    group's amount, n, wallets, first, last and span. credits: wallet, ts, amount. No tolerance: equality is the claim."""
    exact = credits.where("amount is not null").withColumn("amount", F.col("amount").cast("decimal(20,9)"))
    groups = exact.groupBy("amount").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    best = groups.agg(F.max(F.struct("n", (-F.col("amount")).alias("less"), "first", "last")).alias("g")).where("g is not null").select((-F.col("g.less")).cast("decimal(20,9)").alias("amount"), "g.n", "g.first", "g.last")
    members = exact.join(F.broadcast(best), "amount").groupBy("wallet", "amount", "n", "first", "last").agg(F.count("*").alias("credits"))  # one row
    return members.select("wallet", "credits", F.col("amount").cast("double").alias("amount"), "n", "first", "last", (F.col("last") - F.col("first")).alias("span"))
