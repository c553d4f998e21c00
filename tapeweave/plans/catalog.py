"""The registry of queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeweave.functions import columns as C
from tapeweave.operators import order, resample, sequence, splits, statistics, tape
from tapeweave.plans import captures, cohorts, evidence, ledger, streams  # noqa: F401  (register their queries)
from tapeweave.plans.registry import QUERIES, SQL, checkpoints, query
from tapeweave.sources.tapes import epoch, event_tape, line_tape, table

def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


LINES = """lines as (select l_partkey as mint, cast(epoch(l_shipdate) as bigint) as ts, l_orderkey * 8 + l_linenumber as seq, l_suppkey as trader,
  case when l_returnflag = 'R' then 'sell' else 'buy' end as side, l_quantity as tokens, l_extendedprice as sol, l_extendedprice / l_quantity as price from lineitem)"""
TICKS = """ticks as (select event_type as mint, cast(floor(epoch(ts)) as bigint) as ts, event_id as seq, user_id as trader,
  case when event_id % 2 = 0 then 'buy' else 'sell' end as side, value as price, cast(event_id % 7 + 1 as double) as sol from events)"""
DAY = 86_400


def lcg_sql(seed: int, rows: str, estimate: str, point: str, replicates: int = 2000) -> str:
    """The interval of an estimate over congruential draws of rows (id, v): a draw's state after t steps is the fold of the
    steps' maps for the bits of t."""
    return f"""with recursive p as (select row_number() over (order by id) - 1 as place, v from {rows}), n as (select count(*) as n from p),
w as (select 0 as b, 1103515245::bigint as a, 12345::bigint as c union all select b + 1, a * a % 2147483648, (a * c + c) % 2147483648 from w where b < 39),
d as (select 0 as b, t, {seed}::bigint as s from (select unnest(range(1, {replicates} * n + 1)) as t from n) union all
  select d.b + 1, t, case when (t >> d.b) & 1 = 1 then (w.a * s + w.c) % 2147483648 else s end from d join w on w.b = d.b),
e as (select (t - 1) // n as r, {estimate}(v) as e from d, n, p where d.b = 40 and p.place = s % n group by 1), o as (select e, row_number() over (order by e) - 1 as k from e)
select (select {point}(v) from p) as estimate, (select e from o where k = {int(0.025 * (replicates - 1))}) as low, (select e from o where k = {int(0.975 * (replicates - 1))}) as high"""


@query(f"with {LINES} select mint, count(*) as trades, count(distinct trader) as traders, min(ts) as first_ts, max(ts) as last_ts, max(ts) - min(ts) as span from lines group by mint")
def corpus_census(spark, sf_dir):
    t = tape.clean(line_tape(spark, sf_dir))
    return t.groupBy("mint").agg(F.count("*").alias("trades"), F.countDistinct("trader").alias("traders"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (F.max("ts") - F.min("ts")).alias("span"))


@query(f"""with {LINES}, s as (select mint, max(ts) - min(ts) as span, count(*) filter (where side = 'buy') as buys, count(*) filter (where sol >= 90000) as large from lines group by mint)
select case when span < 180000000 then 'short_span' when buys = 0 then 'no_buy' when large = 0 then 'no_large_swap' else 'ok' end as status, count(*) as n from s group by 1""")
def rejects_ledger(spark, sf_dir):
    return tape.gate(line_tape(spark, sf_dir), 90_000, 180_000_000).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""with {LINES}, big as (select * from lines where sol >= 20000), base as (select mint, min(ts) as base from big group by mint)
select mint, cast(floor((ts - base) / 2592000.0) as bigint) as bucket, median(price) as price, count(*) as trades from big join base using (mint) group by 1, 2""")
def robust_price(spark, sf_dir):
    return tape.robust_price(tape.clean(line_tape(spark, sf_dir)), 20_000, 30 * DAY)


@query("""with v as (select event_type, list_sort(list(value) filter (where value is not null)) as s from events group by 1)
select event_type, s[cast(round_even(0.1 * (len(s) - 1), 0) as int) + 1] as q10, s[cast(round_even(0.9 * (len(s) - 1), 0) as int) + 1] as q90,
  s[cast(floor(0.75 * (len(s) - 1)) as int) + 1] as floor75, s[cast(floor(len(s) / 2) as int) + 1] as upper_median from v""")
def quantile_conventions(spark, sf_dir):
    checkpoints(spark)
    places = {"q10": order.nearest(0.1), "q90": order.nearest(0.9), "floor75": order.floor_of(0.75), "upper_median": F.floor(F.col("total") / 2)}
    return order.order_statistics(table(spark, sf_dir, "events"), ["event_type"], "value", places).drop("total")


@query("""with b as (select cast(floor(o_totalprice / 50000) as bigint) as band, count(*) as n, count(*) filter (where o_orderstatus = 'F') as hits from orders group by 1 having count(*) >= 5),
p as (select *, hits * 1.0 / n as p from b), c as (select *, (p + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) as centre, 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4.0 * n * n)) / (1 + 1.96 * 1.96 / n) as spread from p)
select band, n, hits, round(greatest(0.0, centre - spread), 9) as low, round(least(1.0, centre + spread), 9) as high from c""")
def wilson_by_band(spark, sf_dir):
    b = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_totalprice") / 50000).alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("hits")).where("n >= 5")
    low, high = C.wilson(F.col("hits"), F.col("n"))
    return b.select("band", "n", "hits", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("""select m as threshold, count(*) filter (where o_totalprice >= m) * 1.0 / count(*) as share from orders, (values (50000.0::double), (100000.0), (200000.0), (400000.0)) as t(m) group by m""")
def survival_sweep(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"), *(F.count_if(F.col("o_totalprice") >= m).alias(f"m{m}") for m in (50000, 100000, 200000, 400000)))
    return sums.select(F.expr("stack(4, 50000D, m50000 / n, 100000D, m100000 / n, 200000D, m200000 / n, 400000D, m400000 / n) as (threshold, share)"))


@query(f"""with {TICKS}, f as (select *, case when ts - lag(ts) over w > 21600 then 1 else 0 end as new from ticks window w as (partition by trader order by ts, seq)),
c as (select *, sum(new) over (partition by trader order by ts, seq) as cluster from f)
select trader, cast(cluster as bigint) as cluster, count(*) as n, min(ts) as first_ts, max(ts) as last_ts from c group by 1, 2""")
def user_sessions(spark, sf_dir):
    c = sequence.gap_clusters(event_tape(spark, sf_dir), ["trader"], 21_600, ["ts", "seq"])
    return c.groupBy("trader", "cluster").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""with {TICKS}, r as (select trader, ts, row_number() over (partition by trader order by ts) as i, count(*) over (partition by trader) as n from ticks),
k as (select *, greatest(1, cast(floor(n * 0.9) as bigint)) as k from r) select a.trader, min(b.ts - a.ts) as span from k a join k b on a.trader = b.trader and b.i = a.i + a.k - 1 group by 1""")
def shortest_window_90(spark, sf_dir):
    checkpoints(spark)
    return order.shortest_windows(event_tape(spark, sf_dir), "trader", "ts", 0.9)


def fx(spark, sf_dir):
    return event_tape(spark, sf_dir).where("side = 'buy'").groupBy("mint", "ts").agg(F.max("price").alias("rate"))


FX = "fx as (select mint, ts, max(price) as rate from ticks where side = 'buy' group by 1, 2)"
SELLS = "sells as (select mint, ts, seq as id from ticks where side = 'sell')"


@query(f"""with {TICKS}, {FX}, {SELLS}, first as (select mint, arg_min(rate, ts) as first_rate from fx group by 1)
select s.mint, s.ts, s.id, coalesce(f.rate, first_rate) as rate from sells s asof left join fx f on s.mint = f.mint and s.ts >= f.ts left join first on first.mint = s.mint""")
def as_of_clamped(spark, sf_dir):
    sells = event_tape(spark, sf_dir).where("side = 'sell'").select("mint", "ts", F.col("seq").alias("id"))
    return sequence.as_of(sells, fx(spark, sf_dir), ["mint"], "rate")


@query(f"""with {TICKS}, {FX}, {SELLS}, n as (select s.id, arg_min(rate, (abs(f.ts - s.ts), f.ts)) as rate from sells s join fx f on f.mint = s.mint and abs(f.ts - s.ts) <= 5400 group by 1)
select s.mint, s.ts, s.id, rate from sells s left join n using (id)""")
def nearest_within(spark, sf_dir):
    sells = event_tape(spark, sf_dir).where("side = 'sell'").select("mint", "ts", F.col("seq").alias("id"))
    return sequence.nearest(sells, fx(spark, sf_dir), ["mint"], "rate", 5400)


PROBES = "probes as (select distinct mint, ts as t from ticks)"


def probes(spark, sf_dir):
    return event_tape(spark, sf_dir).select("mint", F.col("ts").alias("t")).distinct()


@query(f"""with {TICKS}, {PROBES} select p.mint, p.t, count(*) as trades, sum(sol) as volume from probes p join ticks k on k.mint = p.mint and k.ts >= p.t and k.ts < p.t + 7200 group by 1, 2""")
def interval_volume(spark, sf_dir):
    return tape.volumes(probes(spark, sf_dir), event_tape(spark, sf_dir), 7200)


def depth_sql(side: str, direction: str, end: str) -> str:
    return f"""with {TICKS}, {PROBES}, n as (select p.mint, p.t, k.price, row_number() over w as step, sum(sol) over w as total from probes p join ticks k on k.mint = p.mint and k.ts >= p.t and k.ts {end} p.t + 7200
  where side = '{side}' window w as (partition by p.mint, p.t order by k.price {direction}, k.ts, k.seq rows unbounded preceding)),
b as (select mint, t, arg_min(price, step) filter (where total >= 6) as hit, arg_max(price, step) as worst from n group by 1, 2)
select p.mint, p.t, coalesce(hit, worst) as price, case when worst is null then 'unfillable' when hit is null then 'thin' else 'ok' end as status from probes p left join b on p.mint = b.mint and p.t = b.t"""


@query(depth_sql("sell", "desc", "<="))
def depth_bid(spark, sf_dir):
    return tape.depth(probes(spark, sf_dir), event_tape(spark, sf_dir).where("side = 'sell' and price is not null"), "bid", 6, 7200)


@query(depth_sql("buy", "asc", "<"))
def depth_ask(spark, sf_dir):
    return tape.depth(probes(spark, sf_dir), event_tape(spark, sf_dir).where("side = 'buy' and price is not null"), "ask", 6, 7200)


@query(f"""with {TICKS}, {PROBES}, n as (select p.mint, p.t, median(price) filter (where k.ts < p.t + 600) as a, median(price) filter (where k.ts < p.t + 1800) as b, median(price) as c
  from probes p join ticks k on k.mint = p.mint and k.ts >= p.t and k.ts < p.t + 7200 group by 1, 2) select p.mint, p.t, coalesce(a, b, c) as mark from probes p left join n on p.mint = n.mint and p.t = n.t""")
def market_mark(spark, sf_dir):
    return tape.market_mark(probes(spark, sf_dir), event_tape(spark, sf_dir), (600, 1800, 7200))


for _name in ("as_of_clamped", "nearest_within", "interval_volume", "depth_bid", "depth_ask", "market_mark"):
    QUERIES[f"{_name}_all"], SQL[f"{_name}_all"] = QUERIES[_name], SQL[_name]  # an earlier name, from when some took part of their tables


def sql_of(name: str) -> str:
    return f"({SQL[name]})"


@query(f"""with {TICKS}, {PROBES}, last as (select mint, max(ts) as ended from ticks group by 1),
n as (select p.mint, p.t, median(price) as price, sum(sol) as volume from probes p join ticks k on k.mint = p.mint and k.ts >= p.t and k.ts < p.t + 7200 where k.sol >= 4 group by 1, 2),
k as (select p.mint, p.t, k.price, row_number() over w as step, sum(sol) over w as total from probes p join ticks k on k.mint = p.mint and k.ts >= p.t and k.ts < p.t + 7200
  where side = 'sell' and sol >= 2 and price is not null window w as (partition by p.mint, p.t order by k.price, k.ts, k.seq rows unbounded preceding)),
a as (select mint, t, coalesce(arg_min(price, step) filter (where total >= 6), arg_max(price, step)) as ask from k group by 1, 2),
g as (select p.mint, p.t, ended - 7200 as safe, price, ask, case when p.t >= ended then 'after_end' when price is null then 'no_price' when volume < 6 then 'thin_volume' when ask is null then 'no_ask' when ended - 7200 < p.t + 60 then 'no_room' else 'ok' end as gate
  from probes p join last on last.mint = p.mint left join n on n.mint = p.mint and n.t = p.t left join a on a.mint = p.mint and a.t = p.t)
select mint, t, gate, case when gate = 'ok' then greatest(price, ask) end as entry, case when gate = 'ok' then safe end as safe,
  case when gate = 'ok' then least(t + 7200 * greatest(1, (safe - t) // 7200), safe) end as timeout from g""")
def entry_gate(spark, sf_dir):
    return tape.entry_gate(probes(spark, sf_dir), event_tape(spark, sf_dir), 6, 7200, 4, 2, 7200)


@query(f"""with {TICKS}, {PROBES}, n as (select p.mint, p.t, median(price) filter (where k.ts < p.t + 600) as a, median(price) filter (where k.ts < p.t + 1800) as b, median(price) as c
  from probes p join ticks k on k.mint = p.mint and k.ts >= p.t and k.ts < p.t + 7200 where k.sol >= 4 group by 1, 2) select p.mint, p.t, coalesce(a, b, c) as mark from probes p left join n on p.mint = n.mint and p.t = n.t""")
def large_mark(spark, sf_dir):
    return tape.market_mark(probes(spark, sf_dir), event_tape(spark, sf_dir), (600, 1800, 7200), floor=4)


PATH = "path as (select l_partkey as mint, row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber) - 1 as k, l_extendedprice as price from lineitem)"


def path(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("mint"), (F.row_number().over(w) - 1).alias("k"), F.col("l_extendedprice").alias("price"))


@query(f"""with {PATH}, m as (select *, max(price) over (partition by mint order by k rows between unbounded preceding and 1 preceding) as peak from path)
select mint, min(k) as fires, min(k) + 1 as executes from m where price <= peak * (1 - 0.3) group by 1""")
def trailing_stop(spark, sf_dir):
    return tape.trailing_stop(path(spark, sf_dir), 0.3)


@query(f"""with {PATH}, e as (select mint, price as entry from path where k = 0), n as (select *, lead(price) over (partition by mint order by k) as after from path), h as (select mint, k, after, entry, case when price >= entry * 2.0 then 0 when price <= entry * 0.5 then 1 end as which from n join e using (mint) where k > 0),
x as (select mint, min(k) as k from h where which is not null group by 1)
select h.mint, h.k as fires, case which when 0 then 'take' else 'stop' end as reason, h.after * (1 - 0.01) * (1 - 0.02) / (entry * (1 + 0.01) * (1 + 0.02)) - 1 as pnl from h join x on h.mint = x.mint and h.k = x.k""".replace("(1 - 0.01)", "0.99::double").replace("(1 - 0.02)", "0.98::double").replace("(1 + 0.01)", "1.01::double").replace("(1 + 0.02)", "1.02::double"))
def take_or_stop(spark, sf_dir):
    return tape.first_exit(path(spark, sf_dir), 2.0, 0.5)


@query("""with p as (select o_custkey as mint, list(o_totalprice order by o_orderdate, o_orderkey) as p from orders group by 1)
select mint, (case when list_max(p) >= p[1] * 2.0 then 0.5::double else 0 end) * 2 + (case when list_max(p) >= p[1] * 5.0 then 0.25::double else 0 end) * 5
 + (1 - (case when list_max(p) >= p[1] * 2.0 then 0.5::double else 0 end) - (case when list_max(p) >= p[1] * 5.0 then 0.25::double else 0 end)) * p[len(p)] / p[1] as proceeds from p""")
def staged_exit(spark, sf_dir):
    p = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))), lambda x: x.o_totalprice).alias("p"))
    return p.select(F.col("o_custkey").alias("mint"), tape.staged_exit(F.col("p"), ((2.0, 0.5), (5.0, 0.25))).alias("proceeds"))


@query("select l_suppkey as wallet, (sum(cast(l_quantity as bigint)) - max(cast(l_quantity as bigint))) * 1.0::double / (count(*) - 1) as mean_without_best from lineitem group by 1 having count(*) > 1")
def leave_best_out(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("wallet")).agg(((F.sum(q) - F.max(q)) / (F.count("*") - 1)).alias("mean_without_best"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("""with d as (select distinct l_orderkey as g, l_partkey as i from lineitem), s as (select g from d group by 1 having count(*) between 2 and 200)
select a.i as a, b.i as b, count(*) as shared from d a join d b using (g) where a.i < b.i and g in (select g from s) group by 1, 2 having count(*) >= 2""")
def cooccurrence(spark, sf_dir):
    return sequence.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 200).where("shared >= 2")


@query("""with d as (select distinct l_orderkey as g, l_partkey as i from lineitem), s as (select g from d group by 1 having count(*) between 2 and 200), n as (select i, count(*) as n from d group by 1),
p as (select a.i as a, b.i as b, count(*) as shared from d a join d b using (g) where a.i < b.i and g in (select g from s) group by 1, 2)
select a, b, shared, shared / (x.n + y.n - shared) as jaccard from p join n x on x.i = a join n y on y.i = b where shared >= 2""")
def jaccard_edges(spark, sf_dir):
    return sequence.jaccard(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 200).where("shared >= 2")


@query("select l_suppkey as hub, count(distinct l_partkey) as tokens from lineitem group by 1 order by tokens desc, hub limit 15")
def hub_ubiquity(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("hub")).agg(F.countDistinct("l_partkey").alias("tokens")).orderBy(F.desc("tokens"), "hub").limit(15)


@query()
def components(spark, sf_dir):
    checkpoints(spark)
    return sequence.components(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") * 7 % 1000 + 1).alias("b")))


QUERIES["components_all"] = components


@query()
def hub_components(spark, sf_dir):
    """size and count of components of parts that share two orders or more, orders of over 200 parts left out."""
    checkpoints(spark)
    edges = sequence.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", 200).where("shared >= 2")
    return sequence.components(edges.select("a", "b")).groupBy("component").agg(F.count("*").alias("size"))


PAID = "paid as (select o_custkey % 20 as label, o_custkey as wallet, o_totalprice as amount, cast(epoch(o_orderdate) as bigint) as ts, o_orderkey as seq from orders)"


def paid(spark, sf_dir):
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("label"), F.col("o_custkey").alias("wallet"), F.col("o_totalprice").alias("amount"), epoch("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"))


@query(f"""with {PAID}, h as (select a.label, a.seq from paid a join paid b on a.label = b.label and (b.amount > a.amount or b.amount = a.amount and b.seq > a.seq) and abs(b.ts - a.ts) <= 8640000 and b.wallet <> a.wallet
  and b.amount <= a.amount * (1 + 0.0005) group by 1, 2 having count(distinct b.wallet) >= 2) select label, label in (select label from h) as split from (select distinct label from paid)""")
def split_exists(spark, sf_dir):
    return sequence.split_exists(paid(spark, sf_dir), "label", 0.0005, 8_640_000, 3)


@query()
def split_clusters(spark, sf_dir):
    return splits.split_clusters(paid(spark, sf_dir), "label", 0.0005, 8_640_000, 3)


@query("""with x as (select l_partkey, l_suppkey, l_orderkey, lead(l_suppkey) over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber) as nxt from lineitem)
select l_partkey as mint, count(*) filter (where nxt = l_suppkey) as reused, count(nxt) as pairs from x group by 1""")
def adjacent_reuse(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    x = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("mint"), "l_suppkey", F.lead("l_suppkey").over(w).alias("nxt"))
    return x.groupBy("mint").agg(F.count_if(F.col("nxt") == F.col("l_suppkey")).alias("reused"), F.count("nxt").alias("pairs"))


@query("""select s_suppkey as source, c_custkey as wallet, arg_min(l_orderkey, (l_shipdate, l_orderkey)) as first_link from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
where l_shipdate >= o_orderdate group by 1, 2""")
def trace_two_hop(spark, sf_dir):
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, s = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "supplier").select("s_suppkey")
    j = l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(c, F.col("c_custkey") == F.col("o_custkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    return j.where("l_shipdate >= o_orderdate").groupBy(F.col("s_suppkey").alias("source"), F.col("c_custkey").alias("wallet")).agg(F.min_by("l_orderkey", F.struct("l_shipdate", "l_orderkey")).alias("first_link"))


@query("""with x as (select o_orderpriority as g, log10(o_totalprice) as y, log10(o_custkey + 1.0) as x from orders), d as (select y - avg(y) over (partition by g) as dy, x - avg(x) over (partition by g) as dx from x)
select round(sum(dx * dy) / sum(dx * dx), 8) as slope, count(*) as n from d""")
def demeaned_elasticity(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select("o_orderpriority", F.log10("o_totalprice").alias("y"), F.log10(F.col("o_custkey") + 1.0).alias("x"))
    return statistics.demeaned_slope(x, "o_orderpriority", "x", "y").withColumn("slope", F.round("slope", 8))


@query("""with r as (select c_nationkey, row_number() over (partition by c_nationkey order by c_acctbal, c_custkey) as a, row_number() over (partition by c_nationkey order by c_custkey) as b from customer)
select c_nationkey, round(corr(a, b), 8) as spearman from r group by 1 having count(*) > 2""")
def ordinal_spearman(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("c_nationkey")
    r = table(spark, sf_dir, "customer").select("c_nationkey", F.row_number().over(w.orderBy("c_acctbal", "c_custkey")).alias("a"), F.row_number().over(w.orderBy("c_custkey")).alias("b"))
    return r.groupBy("c_nationkey").agg(F.round(F.corr("a", "b"), 8).alias("spearman"), F.count("*").alias("n")).where("n > 2").drop("n")


STRATA = """strata as (select o_orderpriority as s, count(*) filter (where x and y) as a, count(*) filter (where x and not y) as b, count(*) filter (where not x and y) as c, count(*) filter (where not x and not y) as d, count(*) as n
 from (select o_orderpriority, o_totalprice > 150000 as x, o_orderstatus = 'F' as y from orders) group by 1)"""


@query(f"with {STRATA} select round(sum(a * d * 1.0 / n) / sum(b * c * 1.0 / n), 9) as pooled, round((sum(a) * 1.0 * sum(d)) / (sum(b) * 1.0 * sum(c)), 9) as crude from strata")
def mantel_haenszel(spark, sf_dir):
    x, y = F.col("o_totalprice") > 150000, F.col("o_orderstatus") == "F"
    s = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"), F.count("*").alias("n"))
    pooled = F.sum(F.col("a") * F.col("d") / F.col("n")) / F.sum(F.col("b") * F.col("c") / F.col("n"))
    crude = F.sum("a") * 1.0 * F.sum("d") / (F.sum("b") * 1.0 * F.sum("c"))
    return s.agg(F.round(pooled, 9).alias("pooled"), F.round(crude, 9).alias("crude"))


@query()
def exact_tests(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    t = d.groupBy(F.col("lang").alias("key")).agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    total = d.agg(F.sum("toxic").alias("ta"), F.sum(1 - F.col("toxic")).alias("tb"))
    return statistics.exact_tests(t.crossJoin(F.broadcast(total)).select("key", "a", "b", (F.col("ta") - F.col("a")).alias("c"), (F.col("tb") - F.col("b")).alias("d")))  # one row


@query(lcg_sql(999, "(select date_trunc('day', ts) as id, avg(value) as v from events where value is not null group by 1)", "avg", "avg"))
def bootstrap_groups(spark, sf_dir):
    checkpoints(spark)
    g = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("id")).agg(F.avg("value").alias("mean"))
    return resample.group_interval(g)


@query(lcg_sql(12345, "(select s_suppkey as id, s_acctbal as v from supplier where s_acctbal is not null)", "median", "median"))
def bootstrap_median(spark, sf_dir):
    checkpoints(spark)
    return resample.median_interval(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal")


@query()
def bootstrap_median_mersenne(spark, sf_dir):
    checkpoints(spark)
    return resample.median_interval(table(spark, sf_dir, "supplier"), "s_suppkey", "s_acctbal", replicates=4000, mersenne=True)


@query()
def bootstrap_pooled(spark, sf_dir):
    checkpoints(spark)
    return resample.pooled_interval(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), "day", "value")


@query()
def null_model(spark, sf_dir):
    checkpoints(spark)
    events = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("wallet"), F.col("l_partkey").alias("source"), F.col("l_orderkey").alias("sig"), F.col("l_extendedprice").alias("amount"), epoch("l_shipdate").alias("ts"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
    )
    return statistics.null_model(events, (10, 20, 40), 5000, 7)


@query("""with x as (select vec_id, unnest(embedding) as e, generate_subscripts(embedding, 1) - 1 as pos, label from embeddings) select pos, count(*) as n, count(*) filter (where e > 0) as positive, max(e) as high, arg_max(vec_id, (e, vec_id)) as best from x group by 1""")
def array_positions(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    return x.groupBy(F.col("pos").cast("bigint").alias("pos")).agg(F.count("*").alias("n"), F.count_if(F.col("e") > 0).alias("positive"), F.max("e").alias("high"), F.max_by("vec_id", F.struct("e", "vec_id")).alias("best"))


@query("""select strftime(o_orderdate, '%Y-%m') as month, count(*) as n, count(distinct o_custkey) as senders, sum(cast(round(o_totalprice * 100) as bigint)) as cents from orders group by rollup(strftime(o_orderdate, '%Y-%m'))""")
def ledger_monthly(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return o.rollup("month").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("senders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


@query("""select case when u % 1000000000 = 0 then 'whole' when u % 100000000 = 0 then 'tenth' when u % 10000000 = 0 then 'hundredth' when u % 1000000 = 0 then 'thousandth' else 'precise' end as roundness, count(*) as n
from (select cast(round(o_totalprice * 1000000000) as bigint) as u from orders) group by 1""")
def amount_roundness(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(C.roundness(C.units(F.col("o_totalprice"))).alias("roundness")).agg(F.count("*").alias("n"))


@query("select length(rtrim(split_part(printf('%.9f', o_totalprice), '.', 2), '0')) as decimals, count(*) as n, max(cast(printf('%.2e', o_totalprice) as double)) as high from orders group by 1")
def decimals(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(C.significant_decimals(F.col("o_totalprice")).cast("bigint").alias("decimals")).agg(F.count("*").alias("n"), F.max(C.significant(F.col("o_totalprice"), 3)).alias("high"))


@query("select 'ID-' || substr(sha256(cast(c_custkey as varchar)), 1, 10) as id, c_mktsegment as segment from customer")
def redact_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(C.pseudonym(F.col("c_custkey")).alias("id"), F.col("c_mktsegment").alias("segment"))


@query("select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first_value, len(json_keys(props)) as keys from events")
def json_paths(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("m", F.from_json("props", "map<string,string>"))
    return e.select("event_id", F.element_at(F.map_values("m"), 1).alias("first_value"), F.size(F.map_keys("m")).cast("bigint").alias("keys"))


@query("select o_orderpriority, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3")
def top_n_per_group(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 3").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("""select 'both' as kind, count(*) as n from (select c_custkey from customer intersect select o_custkey from orders) union all select 'first', count(*) from (select c_custkey from customer except select o_custkey from orders)
union all select 'any', count(*) from (select c_custkey from customer union select o_custkey from orders)""")
def set_operations(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("both", c.intersect(o)).union(count("first", c.subtract(o))).union(count("any", c.union(o).distinct()))


@query("""with r as (select o_orderpriority as g, o_totalprice as v, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) as r, count(*) over (partition by o_orderpriority) as n from orders)
select g, cast(least(9, (r - 1) // greatest(1, n // 10)) as bigint) as decile, count(*) as n, min(v) as low, max(v) as high from r group by 1, 2""")
def deciles(spark, sf_dir):
    checkpoints(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.struct(F.col("o_totalprice").alias("v"), "o_orderkey").alias("row"))
    r = order.value_ranks(rows, ["g"], "row").select("g", "row.v", "n", "start", "total")
    decile = F.least(F.lit(9), F.floor(F.col("start") / F.greatest(F.lit(1), F.floor(F.col("total") / 10)))).cast("bigint")
    return r.groupBy("g", decile.alias("decile")).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("""with x as (select o_orderkey, o_totalprice as v, o_orderdate as d from orders) select case when grouping(month) = 0 then 'month' when grouping(quarter) = 0 then 'quarter' else 'all' end as level,
  coalesce(month, quarter) as period, count(*) as n, median(v) as median_value, max(v) as high from (select v, strftime(d, '%Y-%m') as month, year(d) || '-Q' || quarter(d) as quarter from x) group by grouping sets ((month), (quarter), ())""")
def period_tables(spark, sf_dir):
    checkpoints(spark)
    levels = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), period.alias("period")) for level, period in (
        ("month", F.date_format("o_orderdate", "yyyy-MM")), ("quarter", F.concat(F.year("o_orderdate"), F.lit("-Q"), F.quarter("o_orderdate"))), ("all", F.lit(None).cast("string"))))))
    o = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("v"), levels.alias("x")).select("v", "x.level", "x.period")
    places = {**order.middle(), "most": F.col("total") - 1}
    return order.order_statistics(o, ["level", "period"], "v", places).select("level", "period", F.col("total").alias("n"), ((F.col("low") + F.col("high")) / 2).alias("median_value"), F.col("most").alias("high"))


@query("""with s as (select l_partkey as mint, list_sort(list(l_quantity)) as q, count(*) as n from lineitem group by 1 having count(*) >= 4)
select mint, q[cast(floor(0.25 * (n + 1)) as int)] + (0.25 * (n + 1) - floor(0.25 * (n + 1)))::double * (q[cast(floor(0.25 * (n + 1)) as int) + 1] - q[cast(floor(0.25 * (n + 1)) as int)]) as q1,
  q[least(n, cast(round_even(n * 0.9, 0) as int) + 1)] as at90, q[n // 4 + 1] as quarter_slice from s""")
def exclusive_quartiles(spark, sf_dir):
    checkpoints(spark)
    lines, total = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("mint"), "l_quantity"), F.col("total")
    more = {"at90": F.least(total - 1, F.bround(F.lit(0.9) * total, 0).cast("long")), "quarter_slice": F.floor(total / 4)}
    return order.exclusive(lines, ["mint"], "l_quantity", 0.25, more).where("total >= 4").select("mint", F.col("quantile").alias("q1"), *more)


@query("""with g as (select l_orderkey as g, l_suppkey as i from lineitem group by 1, 2), t as (select count(distinct g) as total from g), n as (select i, count(*) as n from g group by 1), f as (select g from g group by 1 having count(*) between 2 and 200),
p as (select a.i as a, b.i as b, count(*) as shared from g a join g b using (g) where a.i < b.i and g in (select g from f) group by 1, 2)
select a, b, shared, x.n * y.n / total as expected, shared / (x.n * y.n / total) as lift from p join n x on x.i = a join n y on y.i = b, t""")
def pair_lift(spark, sf_dir):
    return sequence.lift(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", 200)


@query("""with d as (select distinct l_partkey as mint, l_suppkey as w, min(l_shipdate) as t from lineitem group by 1, 2), g as (select w, count(*) as tokens, min(t) as first_seen, max(t) as last_seen from d group by 1)
select w as wallet, tokens, case when tokens >= 70 then 'hub' when tokens >= 30 then 'between' else 'private' end as tier, cast(epoch(last_seen) as bigint) - cast(epoch(first_seen) as bigint) as span from g""")
def hub_tiers(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min(epoch("l_shipdate")).alias("t"))
    g = d.groupBy(F.col("l_suppkey").alias("wallet")).agg(F.count("*").alias("tokens"), (F.max("t") - F.min("t")).alias("span"))
    return g.select("wallet", "tokens", F.when(F.col("tokens") >= 70, "hub").when(F.col("tokens") >= 30, "between").otherwise("private").alias("tier"), "span")


@query("""select l_suppkey as counterparty, count(*) as n, min(l_shipdate)::date as first_day, max(l_shipdate)::date as last_day, sum(cast(round(l_extendedprice * 100) as bigint)) as cents,
  list_sort(list(distinct l_quantity))[1:3] as smallest, max(l_extendedprice) as high, arg_max(l_orderkey, (l_extendedprice, -l_orderkey)) as best from lineitem group by 1""")
def counterparty_rollup(spark, sf_dir):
    day = F.col("l_shipdate").cast("date")
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("counterparty"))
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return g.agg(F.count("*").alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), cents.alias("cents"), F.slice(F.sort_array(F.collect_set("l_quantity")), 1, 3).alias("smallest"),
                 F.max("l_extendedprice").alias("high"), F.max_by("l_orderkey", F.struct("l_extendedprice", -F.col("l_orderkey"))).alias("best"))


@query("""with c as (select l_suppkey as w, cast(round(l_quantity * 100) as bigint) as amount, count(*) as n, count(distinct l_partkey) as mints from lineitem group by 1, 2 having count(*) >= 2)
select w as wallet, count(*) as repeated, max(n) as most, arg_max(amount, (n, -amount)) as amount, max(mints) as mints from c group by 1""")
def repeated_amounts(spark, sf_dir):
    amount = F.round(F.col("l_quantity") * 100).cast("bigint")
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("wallet"), amount.alias("amount")).agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("mints")).where("n >= 2")
    return c.groupBy("wallet").agg(F.count("*").alias("repeated"), F.max("n").alias("most"), F.max_by("amount", F.struct("n", -F.col("amount"))).alias("amount"), F.max("mints").alias("mints"))


@query(f"""with {LINES}, b as (select mint, min(ts) as born from lines group by 1), x as (select mint, (ts - born) / 86400.0 as age, price from lines join b using (mint)),
h as (select mint, arg_max(price, (age, price)) filter (where age <= 90) as h90, arg_max(price, (age, price)) filter (where age <= 365 and age > 90) as h365, arg_max(price, (age, price)) filter (where age > 365) as later from x group by 1)
select horizon, count(p) as n, median(p) as seen, median(coalesce(p, 0)) as all_mints, median(p) filter (where whole) as matched from (select mint, unnest(['h90', 'h365', 'later']) as horizon, unnest([h90, h365, later]) as p,
  h90 is not null and h365 is not null and later is not null as whole from h) group by 1""")
def horizon_panels(spark, sf_dir):
    checkpoints(spark)
    lines = tape.clean(line_tape(spark, sf_dir))
    x = lines.join(lines.groupBy("mint").agg(F.min("ts").alias("born")), "mint").select("mint", ((F.col("ts") - F.col("born")) / 86400).alias("age"), "price")
    last = lambda test: F.max_by(F.when(test, F.col("price")), F.when(test, F.struct("age", "price")))
    age = F.col("age")
    h = x.groupBy("mint").agg(last(age <= 90).alias("h90"), last((age <= 365) & (age > 90)).alias("h365"), last(age > 365).alias("later"))
    long = h.withColumn("whole", F.expr("h90 is not null and h365 is not null and later is not null")).unpivot(["mint", "whole"], ["h90", "h365", "later"], "horizon", "p")
    kinds = long.unpivot(["horizon"], [F.col("p").alias("seen"), F.coalesce("p", F.lit(0.0)).alias("all_mints"), F.when(F.col("whole"), F.col("p")).alias("matched")], "kind", "v")
    medians = order.medians(kinds, ["horizon", "kind"], "v")
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(kind)
    return medians.groupBy("horizon").agg(of("seen", "total").alias("n"), *(of(kind, "median") for kind in ("seen", "all_mints", "matched")))


@query("""with x as (select user_id, event_id, event_type, ts from events), b as (select user_id, min(ts) filter (where event_type = 'click') as t0 from x group by 1)
select x.user_id, min(epoch_us(ts) - epoch_us(t0)) as delay_us, arg_min(event_id, (ts, event_id)) as first_purchase from x join b using (user_id) where event_type = 'purchase' and ts > t0 group by 1""")
def first_then_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    b = e.where("event_type = 'click'").groupBy("user_id").agg(F.min("ts").alias("t0"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    later = e.where("event_type = 'purchase'").join(b, "user_id").where("ts > t0")
    return later.groupBy("user_id").agg(F.min(us("ts") - us("t0")).alias("delay_us"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_purchase"))


@query("""select o_custkey as wallet, max(n) as n, max(n) filter (where i % 3 = 1) as strided, count(*) filter (where i % 3 = 1) as kept from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as i, count(*) over (partition by o_custkey) as n from orders) group by 1""")
def sample_strided(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    r = table(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")).alias("i"), F.count("*").over(w).alias("n"))
    step = F.col("i") % 3 == 1
    return r.groupBy(F.col("o_custkey").alias("wallet")).agg(F.max("n").alias("n"), F.max(F.when(step, F.col("n"))).alias("strided"), F.count_if(step).alias("kept"))


@query("""select l_partkey as mint, sum(cast(round(l_extendedprice * 100) as bigint)) / sum(cast(l_quantity as bigint)) as vwap_cents, case when count(*) < 2 or avg(cast(l_quantity as bigint)) = 0 then 0 else round(stddev_pop(l_quantity) / avg(l_quantity), 8) end as cv from lineitem group by 1""")
def vwap_and_spread(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("mint"))
    cents, q = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")), F.col("l_quantity")
    cv = F.when((F.count("*") < 2) | (F.avg(q) == 0), 0.0).otherwise(F.round(F.stddev_pop(q) / F.avg(q), 8))
    return g.agg((cents / F.sum(q.cast("bigint"))).alias("vwap_cents"), cv.alias("cv"))


@query("""with p as (select o_custkey as payee, o_orderkey, o_orderdate as paid, o_totalprice from orders), f as (select o_custkey as payee, min(o_orderdate) as born from orders group by 1)
select case when o_totalprice < 20000 then 'dust' when o_totalprice < 200000 then 'between' else 'funded' end as tier, count(*) as n, count(*) filter (where paid <= born + interval 30 day) as fresh, count(distinct payee) as payees from p join f using (payee) group by 1""")
def fresh_payees(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("payee"), "o_totalprice", epoch("o_orderdate").alias("paid"))
    tier = F.when(F.col("o_totalprice") < 20000, "dust").when(F.col("o_totalprice") < 200000, "between").otherwise("funded")
    x = o.join(o.groupBy("payee").agg(F.min("paid").alias("born")), "payee")
    return x.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.count_if(F.col("paid") <= F.col("born") + 30 * DAY).alias("fresh"), F.countDistinct("payee").alias("payees"))


@query("""with x as (select lang, source, count(*) as n, count(toxic) as covered, count(*) filter (where toxic = 1) as hits from documents left join labels using (doc_id) group by 1, 2)
select lang, source, n, covered, hits, case when covered = 0 then 'unmeasured' when covered < n then 'partial' when hits = 0 then 'negative' else 'detected' end as verdict, hits / nullif(covered, 0) as rate from x""")
def coverage_verdicts(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    g = x.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count("toxic").alias("covered"), F.count_if(F.col("toxic") == 1).alias("hits"))
    verdict = F.when(F.col("covered") == 0, "unmeasured").when(F.col("covered") < F.col("n"), "partial").when(F.col("hits") == 0, "negative").otherwise("detected")
    return g.select("*", verdict.alias("verdict"), F.try_divide("hits", "covered").alias("rate"))
