"""Queries on transactions, detector criteria, traces and labels: orders stand for transactions, their lines for the
accounts of one, suppliers and customers for wallets, parts for tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeweave.functions import columns as C
from tapeweave.operators import ledger, sequence, statistics
from tapeweave.plans.registry import SQL, checkpoints, query
from tapeweave.sources.tapes import epoch, table

ACCOUNTS = """accounts as (select l_orderkey as tx, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, cast(l_quantity * 1000 as bigint), cast(round(l_extendedprice) as bigint), l_returnflag = 'R') - 1 as pos, l_suppkey as key,
  cast(l_quantity * 1000 as bigint) as pre, cast(round(l_extendedprice) as bigint) as post, l_returnflag = 'R' as signer from lineitem)"""


def transactions(spark, sf_dir) -> DataFrame:
    """tx and position-aligned arrays keys, pre, post and signers."""
    row = F.struct("l_linenumber", F.col("l_suppkey").alias("key"), (F.col("l_quantity") * 1000).cast("bigint").alias("pre"), F.round("l_extendedprice").cast("bigint").alias("post"), (F.col("l_returnflag") == "R").alias("signer"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tx")).agg(F.sort_array(F.collect_list(row)).alias("x"))  # the accounts of one transaction
    return lines.select("tx", F.col("x.key").alias("keys"), F.col("x.pre").alias("pre"), F.col("x.post").alias("post"), F.col("x.signer").alias("signers"))


@query(f"with {ACCOUNTS} select tx, pos, key, (post - pre) / 1e3 as delta from accounts where abs((post - pre) / 1e3) between 1 and 50")
def balance_deltas(spark, sf_dir):
    return ledger.balance_deltas(transactions(spark, sf_dir), 1e3).where(F.abs("delta").between(1, 50))


@query(f"""with {ACCOUNTS}, d as (select tx, pos, key, (post - pre) / 1e3 as delta from accounts where pos > 0)
select tx, arg_min(key, (delta, pos)) filter (where delta < 0) as sender, arg_max(key, (delta, -pos)) filter (where delta > 0) as recipient, count(*) as others from d group by 1""")
def transfer_parties(spark, sf_dir):
    return ledger.parties(ledger.balance_deltas(transactions(spark, sf_dir), 1e3).where("pos > 0"))


@query(f"with {ACCOUNTS} select tx, arg_min(key, pos) filter (where signer) as payer, count(*) filter (where signer) as signers from accounts group by 1")
def fee_payers(spark, sf_dir):
    t = transactions(spark, sf_dir)
    of = F.filter(F.arrays_zip("keys", "signers"), lambda a: a.signers)
    return t.select("tx", F.get(of, F.lit(0))["keys"].alias("payer"), F.size(of).cast("bigint").alias("signers"))


TOKENS = """pre as (select l_orderkey as tx, l_linenumber as idx, l_suppkey as owner, l_quantity as amount from lineitem where l_returnflag <> 'N'),
post as (select l_orderkey as tx, l_linenumber as idx, l_suppkey as owner, l_quantity * 2 as amount from lineitem where l_linestatus = 'O' or l_returnflag = 'A')"""


def token_balances(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf_dir, "lineitem")
    of = lambda df, amount: df.select(F.col("l_orderkey").alias("tx"), F.col("l_linenumber").alias("idx"), F.col("l_suppkey").alias("owner"), amount.alias("amount"))
    return of(l.where("l_returnflag <> 'N'"), F.col("l_quantity")), of(l.where("l_linestatus = 'O' or l_returnflag = 'A'"), F.col("l_quantity") * 2)


@query(f"with {TOKENS} select tx, idx, post.owner, post.amount - coalesce(pre.amount, 0) as delta from post left join pre using (tx, idx)")
def token_deltas_left(spark, sf_dir):
    return ledger.token_deltas(*token_balances(spark, sf_dir), how="left")


@query(f"with {TOKENS} select tx, idx, coalesce(post.owner, pre.owner) as owner, coalesce(post.amount, 0) - coalesce(pre.amount, 0) as delta from post full join pre using (tx, idx)")
def token_deltas_full(spark, sf_dir):
    return ledger.token_deltas(*token_balances(spark, sf_dir), how="full")


@query(f"""with {TOKENS}, d as (select tx, coalesce(post.owner, pre.owner) as owner, coalesce(post.amount, 0) - coalesce(pre.amount, 0) as delta from post full join pre using (tx, idx)),
s as (select tx, max(o_totalprice) filter (where o_orderstatus = 'F') as paid from d join orders on o_orderkey = tx group by 1)
select case when delta > 0 and paid is not null then 'buy' when delta < 0 then 'sell' when delta > 0 then 'transfer' else 'other' end as kind, count(*) as n, sum(cast(delta as bigint)) as net from d join s using (tx) group by 1""")
def trade_kinds(spark, sf_dir):
    d = ledger.token_deltas(*token_balances(spark, sf_dir), how="full")
    paid = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("paid"))
    kind = F.when((F.col("delta") > 0) & F.col("paid").isNotNull(), "buy").when(F.col("delta") < 0, "sell").when(F.col("delta") > 0, "transfer").otherwise("other")
    return d.join(paid, "tx").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.col("delta").cast("bigint")).alias("net"))


@query("""with i as (select l_orderkey as tx, l_suppkey as destination, cast(round(l_extendedprice * 100) as bigint) as units, l_discount < 0.05 as is_transfer from lineitem)
select tx, destination, sum(units) as units, count(*) as transfers from i where is_transfer group by 1, 2""")
def inbound_transfers(spark, sf_dir):
    """Transfers by destination from the instructions of a transaction and those nested in them."""
    row = F.struct(F.col("l_suppkey").alias("destination"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("units"), (F.col("l_discount") < 0.05).alias("is_transfer"))
    outer = F.col("l_tax") >= 0.04
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tx")).agg(F.collect_list(F.when(outer, row)).alias("instructions"), F.collect_list(F.when(~outer, F.array(row))).alias("inner"))
    return ledger.inbound(t)


@query(f"""with {ACCOUNTS}, x as (select tx as block, key as wallet, pos as place from accounts),
w as (select block, wallet, min(place) as first_at, (max(place) - min(place) + 1 = count(*)) as contiguous, count(*) as n from x group by 1, 2), c as (select block, arg_min(wallet, place) as creator from x group by 1)
select w.block, w.wallet, first_at, contiguous, n, wallet = creator as is_creator, min(first_at) filter (where wallet <> creator) over (partition by w.block) as first_external from w join c using (block)""")
def block_order(spark, sf_dir):
    """Places in a block: whether a wallet's are contiguous, and the first one of another wallet than the creator."""
    x = ledger.balance_deltas(transactions(spark, sf_dir), 1e3).select(F.col("tx").alias("block"), F.col("key").alias("wallet"), F.col("pos").alias("at"))
    w = x.groupBy("block", "wallet").agg(F.min("at").alias("first_at"), (F.max("at") - F.min("at") + 1 == F.count("*")).alias("contiguous"), F.count("*").alias("n"))
    own = Window.partitionBy("block")
    first = F.col("first_at") == F.min("first_at").over(own)
    return w.select("*", first.alias("is_creator")).select("*", F.min(F.when(~F.col("is_creator"), F.col("first_at"))).over(own).alias("first_external"))


@query("""with e as (select o_custkey as wallet, o_orderkey as seq, o_orderdate as t, (case when o_orderkey % 2 = 0 then -1 else 1 end) * floor(o_totalprice / 50000) as delta, n as payees
  from orders join (select l_orderkey, count(distinct l_suppkey) as n from lineitem group by 1) on l_orderkey = o_orderkey),
l as (select *, lead(struct_pack(d := delta, p := payees, s := seq), 1) over w as a, lead(struct_pack(d := delta, p := payees, s := seq), 2) over w as b, lead(struct_pack(d := delta, p := payees, s := seq), 3) over w as c from e window w as (partition by wallet order by t, seq))
select wallet, seq, delta, coalesce(case when abs(a.d + delta) < 0.01 and a.p >= 2 then a.s end, case when abs(b.d + delta) < 0.01 and b.p >= 2 then b.s end, case when abs(c.d + delta) < 0.01 and c.p >= 2 then c.s end) as debit from l
where delta > 0.5 and debit is not null""")
def fan_out(spark, sf_dir):
    payees = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(F.countDistinct("l_suppkey").alias("payees"))
    sign = F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(1)
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("wallet"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("t"), (sign * F.floor(F.col("o_totalprice") / 50000)).cast("double").alias("delta"))
    return ledger.fan_out(e.join(payees, "seq"), "wallet", 3)


@query("with s as (select l_orderkey as sig from lineitem group by 1 having count(distinct l_suppkey) >= 2) select o_custkey as label, count(sig) as shared, count(sig) > 0 as fires from orders left join s on sig = o_orderkey group by 1")
def criterion_transaction(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    events = o.select(F.col("o_custkey").alias("label"), F.col("o_orderkey").alias("sig")).join(l.select(F.col("l_orderkey").alias("sig"), F.col("l_suppkey").alias("wallet")), "sig", "left")
    return ledger.shared(events, "label", "sig", 2)


@query("""with hub as (select l_suppkey as s from lineitem group by 1 having count(distinct l_partkey) >= 70), e as (select distinct o_custkey as wallet, l_suppkey as source, l_partkey as label from lineitem join orders on o_orderkey = l_orderkey),
g as (select label, source from e where source not in (select s from hub) group by 1, 2 having count(*) >= 2) select label, count(source) as shared, count(source) > 0 as fires from (select distinct label from e) left join g using (label) group by 1""")
def criterion_source(spark, sf_dir):
    """Sources that fund two wallets or more of a label; those known as infrastructure don't count."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    hub = l.groupBy(F.col("l_suppkey").alias("source")).agg(F.countDistinct("l_partkey").alias("n")).where("n >= 70")
    e = l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("wallet"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("label"))
    private = e.join(hub.select("source"), "source", "left_anti")
    return e.select("label").distinct().join(ledger.shared(private, "label", "source", 2), "label", "left").select("label", F.coalesce("shared", F.lit(0)).alias("shared"), F.coalesce("fires", F.lit(False)).alias("fires"))


@query("""with c as (select cast(round(l_extendedprice * 100) as bigint) as cents, count(distinct l_partkey) as tokens, count(distinct l_suppkey) as wallets, count(*) as n from lineitem group by 1) select * from c where tokens >= 2""")
def recurring_amounts(spark, sf_dir):
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents")
    return table(spark, sf_dir, "lineitem").groupBy(cents).agg(F.countDistinct("l_partkey").alias("tokens"), F.countDistinct("l_suppkey").alias("wallets"), F.count("*").alias("n")).where("tokens >= 2")


@query("""with f as (select l_partkey as mint, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) as collector from lineitem where l_returnflag = 'A' group by 1) select collector, count(*) as mints, min(mint) as first_mint from f group by 1""")
def collectors(spark, sf_dir):
    first = F.min_by("l_suppkey", F.struct("l_shipdate", "l_orderkey", "l_linenumber"))
    f = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_partkey").alias("mint")).agg(first.alias("collector"))
    return f.groupBy("collector").agg(F.count("*").alias("mints"), F.min("mint").alias("first_mint"))


@query("""with b as (select c_nationkey as fleet, c_custkey, cast(epoch(min(o_orderdate)) as bigint) as born from customer left join orders on o_custkey = c_custkey group by 1, 2)
select fleet, count(born) as dated, count(*) - count(born) as censored, case when count(born) >= 2 then max(born) - min(born) end as span from b group by 1""")
def birth_spans(spark, sf_dir):
    born = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(epoch("o_orderdate")).alias("born"))
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("fleet"), "c_custkey").join(born, "c_custkey", "left")
    n = F.count("born")
    return b.groupBy("fleet").agg(n.alias("dated"), (F.count("*") - n).alias("censored"), F.when(n >= 2, F.max("born") - F.min("born")).alias("span"))


@query("""select l_suppkey as terminal, count(*) as mentions, count(*) filter (where l_discount <> 0) as flows, count(distinct l_orderkey) filter (where l_discount <> 0) as paying from lineitem group by 1""")
def terminal_contacts(spark, sf_dir):
    flow = F.col("l_discount") != 0
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("terminal")).agg(F.count("*").alias("mentions"), F.count_if(flow).alias("flows"), F.countDistinct(F.when(flow, F.col("l_orderkey"))).alias("paying"))


PAYMENTS = "e as (select o_custkey * 7 % 1000 + 1 as payer, o_custkey as payee, sum(cast(round(o_totalprice * 100) as bigint)) as units from orders group by 1, 2 having payer <> payee)"


def payments(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") * 7 % 1000 + 1).alias("payer"), F.col("o_custkey").alias("payee"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("units"))


@query(f"""with {PAYMENTS}, r as (select *, row_number() over (partition by payee order by units desc, payer) as rank from e), top as (select * from r where rank <= 3),
l0 as (select distinct o_custkey as root, o_custkey as node from orders where o_totalprice >= 400000), l1 as (select distinct root, payer as node from l0 join top on payee = node), l2 as (select distinct root, payer as node from l1 join top on payee = node),
l3 as (select distinct root, payer as node from l2 join top on payee = node), a as (select *, 0 as level from l0 union all select *, 1 from l1 union all select *, 2 from l2 union all select *, 3 from l3) select root, node, min(level) as level from a group by 1, 2""")
def funding_trace(spark, sf_dir):
    """The payers of payers, three levels up, from wallets with a large payment."""
    checkpoints(spark)
    roots = table(spark, sf_dir, "orders").where("o_totalprice >= 400000").select(F.col("o_custkey").alias("root")).distinct()
    return ledger.trace(roots, payments(spark, sf_dir), levels=3, most=3)


@query("""with d as (select distinct l_orderkey as g, l_suppkey as i from lineitem), t as (select count(distinct g) as total from d), n as (select i, count(*) as n from d group by 1), p as (select a.i as a, b.i as b, count(*) as shared from d a join d b using (g) where a.i < b.i group by 1, 2),
x as (select a, b, shared, x.n as na, y.n as nb, total from p join n x on x.i = a join n y on y.i = b, t)
select a, b, shared, round(least(1.0, list_sum(list_transform(range(shared, least(na, nb) + 1), lambda k: exp(lgamma(na + 1) - lgamma(k + 1) - lgamma(na - k + 1) + lgamma(total - na + 1) - lgamma(nb - k + 1) - lgamma(total - na - nb + k + 1) - lgamma(total + 1) + lgamma(nb + 1) + lgamma(total - nb + 1))))), 6) as p from x where total - na - nb + shared >= 0""")
def pair_significance(spark, sf_dir):
    return statistics.pair_significance(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 200).withColumn("p", F.round("p", 6))


@query("select o_orderpriority as key, count(*) as n, round(regr_slope(o_totalprice, o_custkey), 6) as slope, round(regr_r2(o_totalprice, o_custkey), 9) as r2 from orders group by 1")
def plain_slopes(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("n"), F.round(F.regr_slope("o_totalprice", "o_custkey"), 6).alias("slope"), F.round(F.regr_r2("o_totalprice", "o_custkey"), 9).alias("r2"))


@query("""with s as (select o_orderpriority as s, count(*) filter (where x and y) as a, count(*) filter (where x and not y) as b, count(*) filter (where not x and y) as c, count(*) filter (where not x and not y) as d from (select o_orderpriority, o_totalprice > 150000 as x, o_orderstatus = 'F' as y from orders) group by 1),
m as (select *, (a + b + c + d)::double as n from s) select round(power(abs(sum(a - (a + b) * (a + c) / n)) - 0.5::double, 2) / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))), 8) as chi_square, count(*) as strata from m where n > 1""")
def mantel_haenszel_test(spark, sf_dir):
    x, y = F.col("o_totalprice") > 150000, F.col("o_orderstatus") == "F"
    s = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"))
    return s.agg(F.round(statistics.mantel_haenszel_chi_square(), 8).alias("chi_square"), F.count("*").alias("strata"))


@query("""with t as (select o_orderpriority as key, count(*) as n, count(*) filter (where o_totalprice > 600000) as k, count(*) filter (where o_orderstatus = 'F') as f from orders group by 1)
select key, n, k, case when k = 0 then round(1 - power(0.05::double, 1.0::double / n), 12) end as zero_bound, round(power(f::double / n, 3), 12) as all_of_three from t""")
def rule_of_three(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 600000).alias("k"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    return t.select("key", "n", "k", F.round(C.zero_bound(F.col("k"), F.col("n")), 12).alias("zero_bound"), F.round(F.pow(F.col("f") / F.col("n"), 3), 12).alias("all_of_three"))


@query("select o_custkey as wallet, arg_max(status, (n, status)) as most_common, max(n) as n from (select o_custkey, o_orderstatus as status, count(*) as n from orders group by 1, 2) group by 1")
def status_modes(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("wallet"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return counts.groupBy("wallet").agg(F.max_by("status", F.struct("n", "status")).alias("most_common"), F.max("n").alias("n"))


@query("""with p as (select o_custkey as mint, arg_min(o_totalprice, (o_orderdate, o_orderkey)) as launch, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as now, max(o_totalprice) as peak from orders group by 1)
select mint, launch, now, peak, case when peak > launch and launch > 0 then round(ln(now / launch) / ln(peak / launch), 9) end as run_consumed from p""")
def log_runs(spark, sf_dir):
    at = F.struct("o_orderdate", "o_orderkey")
    p = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("mint")).agg(F.min_by("o_totalprice", at).alias("launch"), F.max_by("o_totalprice", at).alias("now"), F.max("o_totalprice").alias("peak"))
    run = F.when((F.col("peak") > F.col("launch")) & (F.col("launch") > 0), F.round(F.ln(F.col("now") / F.col("launch")) / F.ln(F.col("peak") / F.col("launch")), 9))
    return p.select("*", run.alias("run_consumed"))


@query("""with s as (select l_partkey as mint, l_suppkey as wallet, sum(cast(l_quantity as bigint)) as tokens from lineitem group by 1, 2) select mint, wallet, tokens, tokens / sum(tokens) over (partition by mint) as share from s""")
def supply_shares(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("mint"), F.col("l_suppkey").alias("wallet")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("tokens"))
    return s.withColumn("share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("mint")))


@query("""with u as (select user_id, count(*) as n, greatest(1, cast(floor(epoch(max(ts))) as bigint) - cast(floor(epoch(min(ts))) as bigint)) as span from events group by 1)
select user_id, n, span, n * 86400.0::double / span as per_day, round(n * 86400.0::double / span * 30, 6) as month_rate from u""")
def sampling_rates(spark, sf_dir):
    u = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.max(epoch("ts")) - F.min(epoch("ts"))).alias("span"))
    return u.select("*", (F.col("n") * 86400.0 / F.col("span")).alias("per_day"), F.round(F.col("n") * 86400.0 / F.col("span") * 30, 6).alias("month_rate"))


@query("""with fx as (select cast(ts as date) as day, median(value) as rate from events group by 1), o as (select strftime(o_orderdate, '%Y-%m') as month, o_totalprice as sol, o_custkey, rate from orders left join fx on month(day) = month(o_orderdate) and day(day) = day(o_orderdate))
select month, count(*) as n, count(rate) as valued, count(distinct o_custkey) as senders, sum(cast(round(sol * rate) as bigint)) as worth, count(*) - count(rate) as residual from o group by rollup(month)""")
def valued_ledger(spark, sf_dir):
    day = lambda c: (F.month(c).alias("m"), F.dayofmonth(c).alias("d"))
    fx = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.median("value").alias("rate")).select(*day("day"), "rate")
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_totalprice").alias("sol"), "o_custkey", *day("o_orderdate")).join(fx, ["m", "d"], "left")
    sums = F.count("*").alias("n"), F.count("rate").alias("valued"), F.countDistinct("o_custkey").alias("senders"), F.sum(F.round(F.col("sol") * F.col("rate")).cast("bigint")).alias("worth"), (F.count("*") - F.count("rate")).alias("residual")
    return o.rollup("month").agg(*sums)


@query("""with p as (select * from (values (10.0::double, 'R'), (25.0, 'R'), (25.0, 'A'), (40.0, 'N')) as t(least_quantity, flag)) select least_quantity, flag, count(*) as n, count(*) filter (where l_quantity >= least_quantity) as hits,
  count(distinct l_partkey) filter (where l_quantity >= least_quantity) as mints from lineitem join p on l_returnflag = flag group by 1, 2""")
def parameter_sweep(spark, sf_dir):
    """Every rule of a table of parameters over every token: the table is four rows."""
    rules = spark.createDataFrame([(10.0, "R"), (25.0, "R"), (25.0, "A"), (40.0, "N")], "least_quantity double, flag string")
    x = table(spark, sf_dir, "lineitem").join(F.broadcast(rules), F.col("l_returnflag") == F.col("flag"))
    hit = F.col("l_quantity") >= F.col("least_quantity")
    return x.groupBy("least_quantity", "flag").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.countDistinct(F.when(hit, F.col("l_partkey"))).alias("mints"))


@query("""with v as (select l_partkey as mint, sum(l_extendedprice) / sum(l_quantity) as a, avg(l_extendedprice / l_quantity) as b from lineitem group by 1) select count(*) as n, count(*) filter (where abs(a - b) < 1e-4) as identical, round(max(abs(a - b)), 6) as largest from v""")
def reconciliation(spark, sf_dir):
    """Two ways to price a token, side by side."""
    g = lambda value: table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("mint")).agg(value.alias("value"))
    return ledger.reconciled(g(F.sum("l_extendedprice") / F.sum("l_quantity")), g(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))), "mint", 1e-4)


PASSES = [("1-URGENT", 3), ("2-HIGH", 2), ("5-LOW", 1)]


@query("""with p as (select o_custkey as wallet, case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 2 when '5-LOW' then 1 end as pass, count(*) as covered, max(o_totalprice) as value from orders group by 1, 2)
select wallet, arg_max(value, (covered, pass)) as value, max(covered) as covered, arg_max(pass, (covered, pass)) as pass from p where pass is not null group by 1""")
def coalesced_passes(spark, sf_dir):
    """Of repeated measurements the best covered; among equals the latest pass."""
    o = table(spark, sf_dir, "orders")
    passes = [o.where(F.col("o_orderpriority") == name).groupBy(F.col("o_custkey").alias("wallet")).agg(F.count("*").alias("covered"), F.max("o_totalprice").alias("value"), F.lit(k).alias("pass")) for name, k in PASSES]
    return ledger.coalesced(passes, "wallet")


@query("""select 'with' as kind, count(*) as n from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000) union all
select 'without', count(*) from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)""")
def memberships(spark, sf_dir):
    c, big = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return reduce(DataFrame.union, (c.join(big, "c_custkey", how).agg(F.lit(kind).alias("kind"), F.count("*").alias("n")) for kind, how in (("with", "left_semi"), ("without", "left_anti"))))


@query("""with f as (select o_custkey as wallet, min(o_orderdate) as born from orders where o_orderstatus = 'F' group by 1) select coalesce(wallet is not null and o_orderdate < born, false) as before_first, wallet is null as never, count(*) as n from orders left join f on wallet = o_custkey group by 1, 2""")
def before_first_seen(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = o.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.min("o_orderdate").alias("born"))
    x = o.join(f, "o_custkey", "left")
    return x.groupBy(F.coalesce(F.col("o_orderdate") < F.col("born"), F.lit(False)).alias("before_first"), F.col("born").isNull().alias("never")).agg(F.count("*").alias("n"))


@query("select role, count(*) as n, count(distinct key) as keys from (select 'customer' as role, c_nationkey as key from customer union all select 'supplier', s_nationkey from supplier) group by 1")
def tagged_union(spark, sf_dir):
    of = lambda name, key: table(spark, sf_dir, name).select(F.lit(name).alias("role"), F.col(key).alias("key"))
    return of("customer", "c_nationkey").unionByName(of("supplier", "s_nationkey")).groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


@query("""with a as (select o_orderkey as anchor from orders where o_totalprice >= 300000), c as (select o_orderkey as control from orders where o_totalprice < 300000 and o_orderstatus = 'F'),
r as (select anchor, control, abs(control - anchor) as distance, row_number() over (partition by anchor order by abs(control - anchor), control) as rank from a join c on control between anchor - 200 and anchor + 200) select * from r where rank <= 3""")
def control_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    anchors, controls = o.where("o_totalprice >= 300000").select(F.col("o_orderkey").alias("anchor")), o.where("o_totalprice < 300000 and o_orderstatus = 'F'").select(F.col("o_orderkey").alias("control"))
    return ledger.controls(anchors, controls, 200, 3)


@query("""select o_orderstatus as status, count(*) as n, count(*) filter (where o_totalprice < 2000 and o_custkey % 100 = 0) as placeholders, count(*) filter (where o_totalprice < 0.95::double * best) as censored from
(select *, max(o_totalprice) over (partition by o_custkey) as best from orders) group by 1""")
def contamination(spark, sf_dir):
    """Placeholder values, and logged values under 95 % of the true ones."""
    o = table(spark, sf_dir, "orders")
    best = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))
    price = F.col("o_totalprice")
    return o.join(best, "o_custkey").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_if((price < 2000) & (F.col("o_custkey") % 100 == 0)).alias("placeholders"), F.count_if(price < 0.95 * F.col("best")).alias("censored"))


@query("select conv_id, count(*) as n, count(*) % 2 = 0 as suspicious from conversations group by 1")
def page_counts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), (F.pmod(F.count("*"), F.lit(2)) == 0).alias("suspicious"))


@query("""select case when abs(v - round(v, 0)) < 1e-9 then 'unit' when abs(v - round(v, 1)) < 1e-9 then 'one' when abs(v - round(v, 2)) < 1e-9 then 'two' else 'more' end as decimals, count(*) as n from (select o_totalprice / 8 as v from orders) group by 1""")
def rounded_amounts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(C.rounded_to(F.col("o_totalprice") / 8).alias("decimals")).agg(F.count("*").alias("n"))


@query(r"select s_suppkey, s_name, regexp_full_match(replace(s_name, '#', ''), '[1-9A-HJ-NP-Za-km-z]{10,44}') as valid from supplier")
def base58_ids(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", C.is_base58(F.replace("s_name", F.lit("#"), F.lit("")), 10, 44).alias("valid"))


def hmac_sql(x: str, key: bytes) -> str:
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({x}))))"


@query(f"select c_custkey, {hmac_sql('c_name', b'a key')} as mac from customer")
def keyed_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", C.hmac_sha256(F.col("c_name"), b"a key").alias("mac"))


@query("select doc_id, len(regexp_extract_all(text, '[0-9]{4,}')) as found, list_max(regexp_extract_all(text, '[0-9]{4,}')) as highest from documents where text is not null")
def token_scan(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit("[0-9]{4,}"), F.lit(0))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(found).cast("bigint").alias("found"), F.array_max(found).alias("highest"))


@query("""with m as (select strftime(o_orderdate, '%Y-%m') as month, o_orderkey, md5(strftime(o_orderdate, '%Y-%m') || '|11|' || o_orderkey) as h from orders) select month, o_orderkey from (select *, row_number() over (partition by month order by h, o_orderkey) as r from m) where r <= 4""")
def monthly_sample(spark, sf_dir):
    """A seeded sample of each month, by order of hashes."""
    m = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey")
    r = F.row_number().over(Window.partitionBy("month").orderBy(F.md5(F.concat("month", F.lit("|11|"), F.col("o_orderkey").cast("string"))), "o_orderkey"))
    return m.withColumn("r", r).where("r <= 4").drop("r")


@query("""with s as (select o_custkey as author, o_orderkey, o_orderdate, list(distinct l_suppkey) as x from orders join lineitem on l_orderkey = o_orderkey group by 1, 2, 3), p as (select *, lag(x) over (partition by author order by o_orderdate, o_orderkey) as before from s)
select author, o_orderkey, len(x) as size, len(list_intersect(x, before)) as reused, len(list_intersect(x, before)) / len(x) as share from p where before is not null""")
def adjacent_overlap(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    s = l.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("x")).join(o.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")  # the accounts of one transaction
    p = s.withColumn("before", F.lag("x").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))).where("before is not null")
    reused = F.size(F.array_intersect("x", "before"))
    return p.select(F.col("o_custkey").alias("author"), "o_orderkey", F.size("x").cast("bigint").alias("size"), reused.cast("bigint").alias("reused"), (reused / F.size("x")).alias("share"))


@query("""with f as (select l_partkey as mint, l_suppkey as wallet, min(l_shipdate) as first_at from lineitem group by 1, 2), r as (select *, row_number() over (partition by mint order by first_at, wallet) as rank from f) select mint, wallet, rank from r where rank <= 5""")
def early_buyers(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("mint"), F.col("l_suppkey").alias("wallet")).agg(F.min("l_shipdate").alias("first_at"))
    return f.withColumn("rank", F.row_number().over(Window.partitionBy("mint").orderBy("first_at", "wallet"))).where("rank <= 5").select("mint", "wallet", "rank")


@query("select key, arg_min(name, (role, name)) as name, arg_min(role, (role, name)) as role from (select c_nationkey as key, c_name as name, 'a' as role from customer union all select s_nationkey, s_name, 'b' from supplier) group by 1")
def first_label_wins(spark, sf_dir):
    of = lambda name, key, label, role: table(spark, sf_dir, name).select(F.col(key).alias("key"), F.col(label).alias("name"), F.lit(role).alias("role"))
    x = of("customer", "c_nationkey", "c_name", "a").unionByName(of("supplier", "s_nationkey", "s_name", "b"))
    return x.groupBy("key").agg(F.min_by("name", F.struct("role", "name")).alias("name"), F.min("role").alias("role"))


@query("select p_partkey, ends_with(p_name, right(p_brand, 1)) as created, lower(p_type) like '%brass%' as swap_output from part")
def created_by_suffix(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.endswith("p_name", F.right("p_brand", F.lit(1))).alias("created"), F.contains(F.lower("p_type"), F.lit("brass")).alias("swap_output"))


@query("""with s as (select p_partkey as mint, count(l_partkey) as n, count(*) filter (where l_quantity > 0 and l_extendedprice > 0) as usable, epoch(max(l_shipdate)) - epoch(min(l_shipdate)) as span, epoch(max(l_shipdate)) - 694224000 as since, count(*) filter (where l_returnflag <> 'R') as buys, count(*) filter (where l_extendedprice >= 90000) as large
  from part left join lineitem on l_partkey = p_partkey group by 1) select case when n = 0 then 'empty' when usable = 0 then 'no_usable_swap' when span < 180000000 then 'short_span' when since < 190000000 then 'short_since_creation' when buys = 0 then 'no_buy' when large = 0 then 'no_large_swap' else 'ok' end as status, count(*) as n from s group by 1""")
def attrition(spark, sf_dir):
    """The six ordered gates, over all captures, empty ones among them."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("mint"), epoch("l_shipdate").alias("ts"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"), F.col("l_quantity").alias("tokens"), F.col("l_extendedprice").alias("sol"))
    captures = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mint"), F.lit(694_224_000).alias("created"))
    return ledger.attrition(captures, l, floor=90_000, least_span=180_000_000, least_since=190_000_000).groupBy("status").agg(F.count("*").alias("n"))


@query("""select l_suppkey as recipient, case when sum(l_extendedprice) < 2000000 then 'dust' when sum(l_extendedprice) < 3000000 then 'between' else 'funded' end as tier, count(*) as n from lineitem group by 1""")
def recipient_tiers(spark, sf_dir):
    total = F.sum("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("recipient")).agg(F.when(total < 2_000_000, "dust").when(total < 3_000_000, "between").otherwise("funded").alias("tier"), F.count("*").alias("n"))


@query("""select case when l_orderkey is null then 'no_upstream' when l_shipdate < o_orderdate then 'upstream_later' else 'ok' end as reason, count(*) as links, count(distinct o_orderkey) as payments from orders left join lineitem on l_orderkey = o_orderkey group by 1""")
def link_reasons(spark, sf_dir):
    """Links of payments to what they pay for, with rejected ones counted by reason."""
    x = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    reason = F.when(F.col("l_orderkey").isNull(), "no_upstream").when(F.col("l_shipdate") < F.col("o_orderdate"), "upstream_later").otherwise("ok")
    return x.groupBy(reason.alias("reason")).agg(F.count("*").alias("links"), F.countDistinct("o_orderkey").alias("payments"))
