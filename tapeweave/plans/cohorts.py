"""Queries on cohorts: tokens created in landed blocks, first signers, controls that traded, clean populations of whole-file
documents, captures of which the last counts, rates at anchors, deposits, and equal credits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.operators import cohorts, ledger
from tapeweave.plans.captures import PICKED, folder, watched
from tapeweave.plans.ledger import ACCOUNTS, transactions
from tapeweave.plans.registry import checkpoints, query
from tapeweave.sources import blocks, scans
from tapeweave.sources.tapes import CAPTURE, epoch, table

DAY = 86_400


def answered(spark, sf_dir) -> tuple[DataFrame, int, int]:
    """Orders as transactions of blocks, four keys a slot, landed as gzipped JSON lines; every ninth slot's answer is null,
    and slots of no order aren't landed. The blocks read back, the first slot and how many there are."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), "o_custkey", "o_orderstatus", "o_orderpriority")
    slots = o.agg(F.floor(F.min("tx") / 4).alias("a"), F.floor(F.max("tx") / 4).alias("b")).first()
    own = F.transform(F.arrays_zip("keys", "signers"), lambda a: F.struct(F.concat(F.lit("S"), a["keys"]).alias("pubkey"), a["signers"].alias("signer")))
    program = F.when(F.startswith("o_orderpriority", F.lit("1")), F.array(F.struct(F.lit("program").alias("pubkey"), F.lit(False).alias("signer")))).otherwise(F.array().cast("array<struct<pubkey: string, signer: boolean>>"))
    signed = F.when(F.col("o_custkey") % 10 != 0, F.array(F.concat(F.lit("T"), "tx"))).otherwise(F.array().cast("array<string>"))
    t = transactions(spark, sf_dir).join(o, "tx").select("tx", F.struct(F.when(F.col("o_orderstatus") == "P", "failed").alias("err"), signed.alias("signatures"), F.concat(program, own).alias("keys")).alias("t"))
    slot = F.floor(F.col("tx") / 4).alias("slot")
    made = t.groupBy(slot).agg(F.collect_list("t").alias("transactions"))  # four keys a block
    to = folder(spark, "blocks")
    made.select("slot", F.when(F.col("slot") % 9 != 0, F.struct("transactions")).alias("answer")).write.option("compression", "gzip").json(to)
    return blocks.landed(spark, to), int(slots.a or 0), int(slots.b - slots.a + 1) if slots.b is not None else 0


MADE = f"""{ACCOUNTS}, c as (select 'S' || key as mint, tx // 4 as slot, case when o_custkey % 10 <> 0 then 'T' || tx end as sig from accounts join orders on o_orderkey = tx
  where signer and key % 10 = 7 and o_orderstatus <> 'P' and o_orderpriority like '1%' and tx // 4 % 9 <> 0)"""


@query(f"with {MADE} select * from c")
def block_creations(spark, sf_dir):
    """Signing keys that end in 7, of transactions that name the program, as tokens created in blocks."""
    read, start, n = answered(spark, sf_dir)
    return blocks.creations(read, "program", "7", start, n)


@query(f"""with {MADE}, s as (select max(o_orderkey) // 4 - min(o_orderkey) // 4 + 1 as slots, count(distinct o_orderkey // 4) filter (where o_orderkey // 4 % 9 <> 0 and exists (select 1 from lineitem where l_orderkey = o_orderkey)) as answered from orders)
select slots, answered, slots - answered as skipped, (select count(*) from c) as found, (select count(distinct mint) from c) as mints from s""")
def block_tally(spark, sf_dir):
    read, start, n = answered(spark, sf_dir)
    return blocks.tally(read, blocks.creations(read, "program", "7", start, n), start, n)


@query(f"""with {ACCOUNTS}, g as (select tx, arg_min(key, pos) filter (where signer) as signer from accounts group by 1),
x as (select distinct l_partkey as mint, tx as seq, cast(epoch(o_orderdate) as bigint) as ts, signer from g join lineitem on l_orderkey = tx join orders on o_orderkey = tx),
f as (select mint, signer, ts, seq, min(ts) over (partition by mint) as born from x), e as (select mint, signer, arg_min(ts, (ts, seq)) as ts, arg_min(seq, (ts, seq)) as seq, any_value(born) as born from f where signer is not null group by 1, 2)
select mint, signer, rank, ts, seq from (select *, row_number() over (partition by mint order by ts, seq, signer) as rank from e where ts <= born + {500 * DAY}) where rank <= 5""")
def first_signers(spark, sf_dir):
    """The first five signers of each part's orders within 500 days of the first of them."""
    l = table(spark, sf_dir, "lineitem")
    place = F.struct("l_linenumber", "l_suppkey")
    signed = l.groupBy(F.col("l_orderkey").alias("tx")).agg(F.min_by("l_suppkey", F.when(F.col("l_returnflag") == "R", place)).alias("signer"))
    dated = signed.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), epoch("o_orderdate").alias("ts")), "tx")
    touched = l.select(F.col("l_partkey").alias("mint"), F.col("l_orderkey").alias("tx"))
    return cohorts.first_signers(touched.join(dated, "tx").withColumnRenamed("tx", "seq"), 5, 500 * DAY)


@query("""with n as (select l_partkey as p, count(*) as transactions, arg_min(l_linenumber, (l_shipdate, l_linenumber)) <= 5 as genesis from lineitem group by 1),
a as (select p_partkey * 3 as anchor from part where p_partkey % 50 = 0), c as (select p_partkey * 3 as control from part join n on p = p_partkey where p_size <= 40 and p_type not like '%BRASS%' and transactions >= 25 and genesis and p_partkey % 50 <> 0),
r as (select anchor, control, abs(control - anchor) as distance, row_number() over (partition by anchor order by abs(control - anchor), control) as rank, count(*) over (partition by anchor) as eligible from a join c on control between anchor - 200 and anchor + 200) select * from r where rank <= 3""")
def active_controls(spark, sf_dir):
    """Controls near each anchor that never graduated, traded enough and are known from their first page on."""
    first = F.min_by("l_linenumber", F.struct("l_shipdate", "l_linenumber"))
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("transactions"), (first <= 5).alias("genesis"))
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 40).alias("graduated"), F.contains("p_type", F.lit("BRASS")).alias("led"))
    slot = F.col("p_partkey") * 3
    return cohorts.active_controls(p.where("p_partkey % 50 = 0").select(slot.alias("anchor")), p.join(n, "p_partkey", "left").select(slot.alias("control"), "graduated", "led", "transactions", "genesis"), 200, 3, 25)


ROW = "array<struct<poison_default: boolean, q_mc_regime_ok: boolean, q_mc_plausible: boolean, o_ath_true: boolean, detect_mc: double, cluster_id: string, day: string>>"


@query("""with r as (select p_partkey % 3 as p, coalesce(p_size % 10 = 0, false) as poison, p_size > 5 and p_size % 7 <> 0 and p_retailprice < 985 and p_brand not like '%3' as good, case when p_size % 4 <> 0 then p_retailprice - 950 end as mc, p_brand as cluster, p_type as day from part),
n as (select unnest(case when p = 0 then case when not poison then ['A_clean'] end when p = 1 and good and mc > 0 then ['B_clean', 'B_priced'] when p = 1 and good then ['B_clean'] when good then ['C_clean'] end) as population, cluster, day from r)
select population, count(*) as n, count(distinct cluster) as clusters, count(distinct day) as days from n group by 1""")
def populations(spark, sf_dir):
    """Parts as documents that fill a file each (arrays A, B and C of 256 parts), read back, and their clean populations."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    row = F.struct(
        (size % 10 == 0).alias("poison_default"), F.when(size % 7 != 0, size > 5).alias("q_mc_regime_ok"), (price < 985).alias("q_mc_plausible"), (~F.endswith("p_brand", F.lit("3"))).alias("o_ath_true"),
        F.when(size % 4 != 0, price - 950).alias("detect_mc"), F.col("p_brand").alias("cluster_id"), F.col("p_type").alias("day"),
    )
    arrays = [F.collect_list(F.when(F.col("p_partkey") % 3 == k, row)).alias(name) for k, name in enumerate("ABC")]
    each = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 256).alias("file")).agg(*arrays)  # 256 parts a document
    to = folder(spark, "documents")
    each.select(F.to_json(F.struct("A", "B", "C"), {"pretty": "true"}).alias("value")).write.option("maxRecordsPerFile", 1).text(to)
    found = cohorts.populations(scans.whole(spark, to, ", ".join(f"{c} {ROW}" for c in "ABC"), "*.txt"))
    return found.groupBy("population").agg(F.count("*").alias("n"), F.countDistinct("cluster_id").alias("clusters"), F.countDistinct("day").alias("days"))


@query(f"""with {PICKED}, l as (select p, case when in_c then 'control' when in_b then 'second' when in_a and not broken then 'watch' end as last from k)
select 'P' || p as mint, last as role, case last when 'watch' then 'a' when 'second' then 'b' else 'c' end as pool, count(*) as swaps, cast(sum(cents) as bigint) as cents from s join l using (p) where last is not null and (last <> 'watch' or n <= 3) group by 1, 2, 3""")
def last_captures(spark, sf_dir):
    """The last capture of each mint over three folders, those without swaps left out."""
    s = scans.last_wins(spark, watched(spark, sf_dir), CAPTURE, "mint")
    cents = F.aggregate("swaps", F.lit(0).cast("long"), lambda a, x: a + x["sol"].cast("long"))
    return s.select("mint", "role", "pool", F.size("swaps").cast("long").alias("swaps"), cents.alias("cents"))


@query("""with o as (select cast(epoch(o_orderdate) as bigint) as ts from orders where o_orderdate is not null), r as (select ts, row_number() over (order by ts) - 1 as k from o), b as (select min(ts) as born, max(ts) as now from o),
m as (select m, now from (select unnest(generate_series(date_trunc('month', make_timestamp(born * 1000000)), date_trunc('month', make_timestamp(now * 1000000)), interval 1 month)) as m, now from b)),
s as (select strftime(m, '%Y-%m') as month, cast(epoch(m) as bigint) as start, cast(epoch(m + interval 1 month) as bigint) as next, now from m),
a as (select month, start, least(next, now) as stop, now, cast(floor(start + (next - start) * (k + 0.5::double) / 6) as bigint) as anchor from s, range(6) as t(k)),
c as (select month, start, stop, anchor, count(ts) as before from (select * from a where anchor < now - 3600) join o on ts < anchor group by 1, 2, 3, 4), p as (select *, least(before, 40) as n from c where before >= 20),
e as (select p.*, x.ts - y.ts as span from p join r x on x.k = before - 1 join r y on y.k = before - n)
select month, count(*) as anchors, median(case when span > 0 then (n - 1) / span end) as rate, round(median(case when span > 0 then (n - 1) / span end) * (stop - start), 6) as estimate from e group by month, start, stop""")
def monthly_rates(spark, sf_dir):
    """Orders as creations: the rate at six anchors of each month, from pages of 40, carried on over the month."""
    checkpoints(spark)
    return cohorts.monthly_rates(table(spark, sf_dir, "orders").select(epoch("o_orderdate").alias("ts")), 6, 40, 20).withColumn("estimate", F.round("estimate", 6))


@query(f"""with {ACCOUNTS}, s as (select o_orderkey as tx, o_orderkey % 7 * 3 % 10 as subject, o_orderstatus = 'P' as failed, cast(o_orderdate as date) as day from orders),
m as (select tx, subject, day, min(pos) as mine from accounts join s using (tx) where key = subject and not failed group by 1, 2, 3), d as (select tx, subject, day, pos, key, mine, post - pre as delta from accounts join m using (tx)),
v as (select tx, subject, day, arg_min(delta, pos) filter (where pos = mine) as units, arg_min(key, (delta, pos)) filter (where pos <> mine) as low, arg_max(key, (delta, -pos)) filter (where pos <> mine) as high from d group by 1, 2, 3),
w as (select *, strftime(day, '%Y-%m') as month, case when units > 0 then low end as sender, case when units < 0 then high end as recipient from v),
c as (select cast(l_shipdate as date) as day, arg_max(l_tax, (l_orderkey, l_linenumber, l_tax)) + 0.5 as close from lineitem group by 1), q as (select distinct subject, recipient as sender, true as back from w where units < 0 and recipient is not null),
x as (select * from w left join c using (day) left join q using (subject, sender))
select month, count(*) filter (where units > 0) as n, cast(coalesce(sum(units) filter (where units > 0), 0) as bigint) as units, count(*) filter (where units > 0 and close is null) as unpriced,
  case when count(*) filter (where units > 0 and close is null) = 0 then cast(sum(cast(round(units * close) as bigint)) filter (where units > 0) as bigint) end as worth, count(distinct sender) filter (where units > 0) as senders,
  count(*) filter (where units > 0 and back) as returned, cast(coalesce(sum(units) filter (where units > 0 and back), 0) as bigint) as returned_units, cast(coalesce(sum(-units) filter (where units < 0), 0) as bigint) as swept,
  cast(coalesce(sum(units) filter (where units > 0), 0) - coalesce(sum(-units) filter (where units < 0), 0) as bigint) as residual from x group by rollup(month)""")
def deposit_ledger(spark, sf_dir):
    """What reaches the subjects' wallets by month at the day's close, from whom, what is paid out, and what stays."""
    o = table(spark, sf_dir, "orders")
    state = o.select(F.col("o_orderkey").alias("tx"), (F.col("o_orderkey") % 7 * 3 % 10).alias("subject"), F.when(F.col("o_orderstatus") == "P", "failed").alias("err"))
    view = ledger.wallet_view(transactions(spark, sf_dir).join(state, "tx"), 1.0)
    day = F.to_date("o_orderdate")
    dated = o.select(F.col("o_orderkey").alias("tx"), (F.col("o_orderkey") % 7 * 3 % 10).alias("subject"), day.alias("day"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    views = view.join(dated, "tx").select("subject", "month", "day", F.col("delta").cast("long").alias("units"), "sender", "recipient")
    closes = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg((F.max_by("l_tax", F.struct("l_orderkey", "l_linenumber", "l_tax")) + 0.5).alias("close"))
    return cohorts.deposits(views, closes)


@query("""with c as (select o_custkey as wallet, cast(epoch(o_orderdate) as bigint) as ts, cast(floor(o_totalprice / 1000) / 7 as decimal(20, 9)) as amount from orders where o_totalprice is not null), g as (select amount, count(*) as n, min(ts) as first, max(ts) as last from c group by 1),
b as (select * from g order by n desc, amount limit 1) select wallet, count(*) as credits, cast(amount as double) as amount, n, first, last, last - first as span from c join b using (amount) group by wallet, amount, n, first, last""")
def equal_credits(spark, sf_dir):
    """The largest group of orders that are worth the same sevenths of a thousand, at nine decimals, by wallet."""
    return cohorts.equal_credits(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("wallet"), epoch("o_orderdate").alias("ts"), (F.floor(F.col("o_totalprice") / 1000) / 7).alias("amount")))
