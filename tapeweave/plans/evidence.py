"""Queries on evidence: wallets' own view of transactions, exact tests in columns, fleets, hubs left out, scrubbed text, claims
against artefacts, and manifests of exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeweave.functions import special
from tapeweave.operators import claims, fleets, ledger, scrub, statistics
from tapeweave.plans.ledger import ACCOUNTS, transactions
from tapeweave.plans.registry import checkpoints, query
from tapeweave.sources import exports
from tapeweave.sources.tapes import epoch, table


@query(f"""with {ACCOUNTS}, s as (select o_orderkey as tx, o_orderkey % 7 * 3 % 10 as subject, o_orderstatus = 'P' as failed from orders),
m as (select tx, subject, min(pos) as mine from accounts join s using (tx) where key = subject and not failed group by 1, 2),
d as (select tx, pos, key, mine, (post - pre) / 1e3 as delta from accounts join m using (tx))
select tx, arg_min(delta, pos) filter (where pos = mine) as delta, case when arg_min(delta, pos) filter (where pos = mine) > 0 then arg_min(key, (delta, pos)) filter (where pos <> mine) end as sender,
  case when arg_min(delta, pos) filter (where pos = mine) < 0 then arg_max(key, (delta, -pos)) filter (where pos <> mine) end as recipient from d group by 1""")
def wallet_view(spark, sf_dir):
    state = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tx"), (F.col("o_orderkey") % 7 * 3 % 10).alias("subject"), F.when(F.col("o_orderstatus") == "P", "failed").alias("err"))
    return ledger.wallet_view(transactions(spark, sf_dir).join(state, "tx"), 1e3)


FRAUD = """t as (select o_orderpriority || '-' || o_custkey % 40 as key, count(*) filter (where x and y) as a, count(*) filter (where x and not y) as b, count(*) filter (where not x and y) as c, count(*) filter (where not x and not y) as d
  from (select *, o_totalprice > 150000 as x, o_orderstatus = 'F' as y from orders) group by 1)"""
CHANCE = "exp(lgamma(a + b + 1) - lgamma({k} + 1) - lgamma(a + b - {k} + 1) + lgamma(c + d + 1) - lgamma(a + c - {k} + 1) - lgamma(c + d - a - c + {k} + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1))"


@query(f"""with {FRAUD}, p as (select *, list_transform(range(greatest(0, a - d), least(a + b, a + c) + 1), lambda k: {CHANCE.format(k="k")}) as each, {CHANCE.format(k="a")} as here, greatest(0, a - d) as low from t)
select key, round(least(1.0, list_sum(each[a - low + 1:])), 9) as greater, round(least(1.0, list_sum(list_filter(each, lambda x: x <= here * 1.000001::double))), 9) as relative,
  round(least(1.0, list_sum(list_filter(each, lambda x: x <= here + 1e-12))), 9) as absolute from p""")
def fisher_columns(spark, sf_dir):
    """Exact tests of many tables, in columns alone."""
    x, y = F.col("o_totalprice") > 150000, F.col("o_orderstatus") == "F"
    key = F.concat("o_orderpriority", F.lit("-"), F.col("o_custkey") % 40)
    t = table(spark, sf_dir, "orders").groupBy(key.alias("key")).agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"))
    return t.select("key", *(F.round(p, 9).alias(n) for p, n in zip(special.fisher(*map(F.col, "abcd")), ("greater", "relative", "absolute"))))


@query("""with s as (select o_orderpriority as s, count(*) filter (where x and y) as a, count(*) filter (where x and not y) as b, count(*) filter (where not x and y) as c, count(*) filter (where not x and not y) as d from (select o_orderpriority, o_totalprice > 150000 as x, o_custkey % 3 = 0 as y from orders) group by 1),
m as (select *, (a + b + c + d)::double as n from s), c as (select power(abs(sum(a - (a + b) * (a + c) / n)) - 0.5::double, 2) / sum((a + b) * (c + d) * (a + c) * (b + d) / (n * n * (n - 1))) as x from m where n > 1), z as (select x, sqrt(x / 2) as z from c)
select round(x, 8) as chi_square, round(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda n: power(-1::double, n) * power(z, 2 * n + 1) / (gamma(n + 1::double) * (2 * n + 1)))), 9) as p from z""")
def mantel_haenszel_p(spark, sf_dir):
    x, y = F.col("o_totalprice") > 150000, F.col("o_custkey") % 3 == 0
    s = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"))
    found = s.agg(statistics.mantel_haenszel_chi_square().alias("chi"))
    return found.select(F.round("chi", 8).alias("chi_square"), F.round(special.chi_square_p(F.col("chi")), 9).alias("p"))


LAUNCHES = """l as (select l_partkey as mint, case when l_suppkey % 10 = 0 then 0 else l_partkey % 50 * 8 + l_linenumber end as wallet, sum(l_extendedprice) as sol, cast(min(epoch(l_shipdate)) as bigint) as ts from lineitem group by 1, 2),
r as (select *, min(ts) over (partition by mint) as created from l)"""


def launches(spark, sf_dir) -> DataFrame:
    wallet = F.when(F.col("l_suppkey") % 10 == 0, 0).otherwise(F.col("l_partkey") % 50 * 8 + F.col("l_linenumber"))
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("mint"), wallet.alias("wallet")).agg(F.sum("l_extendedprice").alias("sol"), F.min(epoch("l_shipdate")).alias("ts"))
    return l.join(l.groupBy("mint").agg(F.min("ts").alias("created")), "mint")


@query(f"""with recursive {LAUNCHES}, big as (select * from r where sol >= 20000), core as (select * from big where wallet not in (select wallet from big group by 1 having count(*) >= 5000)), n as (select wallet, count(*) as n from core group by 1),
p as (select a.wallet as a, b.wallet as b, count(*) as co from core a join core b on a.mint = b.mint and a.wallet < b.wallet group by 1, 2), e as (select a, b from p join n x on x.wallet = a join n y on y.wallet = b where co >= 2 and co >= 0.4 * (x.n + y.n - co)),
s as (select a, b from e union all select b, a from e), w as (select a as pos, a as seen from s union select s.b, w.seen from w join s on s.a = w.pos), f as (select pos as wallet, min(seen) as lead from w group by 1), g as (select * from f where lead in (select lead from f group by 1 having count(*) >= 3)),
v as (select mint, sum(sol) as everything from r group by 1),
c as (select lead, mint, count(*) as members, sum(sol) as sol, coalesce(stddev_pop(sol) / avg(sol), 0) as inside, max(ts) - min(ts) as span, min(created) as created from core join g using (wallet) group by 1, 2),
m as (select lead, members, count(*) as n from c group by 1, 2), k as (select lead, arg_max(members, (n, -members)) as mode, max(n) as mints_at_mode from m group by 1), q as (select lead, count(*) as n_wallets from g group by 1)
select lead, n_wallets, n_mints, mode, mints_at_mode, median_sol, least_sol, most_sol, between_mints, median_inside, longest, median_share, hours from (select lead, count(*) as n_mints, median(sol) as median_sol, min(sol) as least_sol, max(sol) as most_sol, stddev_pop(sol) / avg(sol) as between_mints,
  median(inside) as median_inside, max(span) as longest, median(sol / everything) as median_share, round((max(created) - min(created)) / 3600.0, 1)::double as hours from c join v using (mint) group by 1) join k using (lead) join q using (lead)""")
def fleet_profiles(spark, sf_dir):
    checkpoints(spark)
    return fleets.fleet_profiles(launches(spark, sf_dir), 20_000, 5000, 2, 0.4, 3).withColumnRenamed("between", "between_mints")


@query()
def giant_by_hub(spark, sf_dir):
    """Giant components of customers that bought four parts together, without each of the five most bought parts."""
    checkpoints(spark)
    bought = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", "o_custkey")
    return fleets.giant_shares(bought, "o_custkey", "l_partkey", 4, 5, 200)


def ident(x):
    """Forty letters of the base-58 alphabet from a number."""
    return F.translate(F.substring(F.sha2(x.cast("string"), 256), 1, 40), "0", "z")


IDENT = "translate(substring(sha256(cast({x} as varchar)), 1, 40), '0', 'z')"
USERS = f"select distinct {IDENT.format(x='user_id')} as id from events where user_id % 3 = 0"


def labels(spark, sf_dir) -> DataFrame:
    ids = table(spark, sf_dir, "events").where("user_id % 3 = 0").select(ident(F.col("user_id")).alias("id")).distinct()
    digest = F.sha2("id", 256)
    return ids.select(digest.alias("digest"), F.concat(F.lit("RDCT-"), F.substring(digest, 1, 10)).alias("label"))


@query(f"""with e as (select event_id, 'From ' || {IDENT.format(x="user_id")} || ' to (' || {IDENT.format(x="user_id + 1")} || '), signed ' || {IDENT.format(x="user_id")} || {IDENT.format(x="event_id")} || '. ' || event_type as t from events), u as ({USERS}),
x as (select event_id, string_split_regex(t, '[1-9A-HJ-NP-Za-km-z]+') as gaps, regexp_extract_all(t, '[1-9A-HJ-NP-Za-km-z]+') as runs from e),
r as (select event_id, generate_subscripts(gaps, 1) as i, unnest(gaps) as gap, unnest(list_concat(runs, [''])) as run from x)
select event_id, string_agg(gap || case when length(run) between 32 and 44 and id is not null then 'RDCT-' || substring(sha256(run), 1, 10) else run end, '' order by i) as text from r left join u on u.id = r.run group by 1""")
def scrubbed_text(spark, sf_dir):
    user, event = F.col("user_id"), F.col("event_id")
    text = F.concat(F.lit("From "), ident(user), F.lit(" to ("), ident(user + 1), F.lit("), signed "), ident(user), ident(event), F.lit(". "), F.col("event_type"))
    return scrub.scrub_text(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "event_id", "text", labels(spark, sf_dir))


@query(f"""with u as ({USERS}), e as (select event_id, {IDENT.format(x="user_id")} as a, {IDENT.format(x="user_id + 1")} as b from events), n as (select event_id, a, b, case when x.id is null then a else 'RDCT-' || substring(sha256(a), 1, 10) end as sa, case when y.id is null then b else 'RDCT-' || substring(sha256(b), 1, 10) end as sb
  from e left join u x on x.id = e.a left join u y on y.id = e.b) select event_id, '{{"' || sa || '":{{"to":["' || sb || '",{{"by":"' || sa || '","note":"x ' || a || '","n":' || event_id || '}}]}},"q":"\\"' || a || '\\""}}' as body from n""")
def scrubbed_json(spark, sf_dir):
    a, b = ident(F.col("user_id")), ident(F.col("user_id") + 1)
    body = F.concat(F.lit('{"'), a, F.lit('":{"to":["'), b, F.lit('",{"by":"'), a, F.lit('","note":"x '), a, F.lit('","n":'), F.col("event_id"), F.lit('}]},"q":"\\"'), a, F.lit('\\""}'))
    return scrub.scrub_json(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "event_id", "body", labels(spark, sf_dir))


CLAIMS = (("orders", "$.all.orders", "whole"), ("mean", "$.all.mean", "round2"), ("finished", "$.all.finished", "percent1"), ("top", "$.most[0].value", "round1"), ("gone", "$.all.nothing", "whole"))


@query("""with v as (select o_orderpriority as a, count(*) as n, avg(o_totalprice) as mean, count(*) filter (where o_orderstatus = 'F') / count(*) as share, max(o_totalprice) as top from orders group by 1), t as (select avg(o_totalprice) as overall from orders),
f as (select a || ':orders' as claim, cast(n as varchar) as found, cast(n as varchar) as expected from v union all select a || ':mean', printf('%.2f', round_even(mean, 2)), printf('%.2f', round_even(overall, 2)) from v, t
  union all select a || ':finished', printf('%.1f', round_even(100 * share, 1)) || ' %', printf('%.1f', round_even(100 * share, 1)) || ' %' from v union all select a || ':top', printf('%.1f', round_even(top, 1)), printf('%.1f', round_even(top, 1)) from v union all select a || ':gone', null, '0' from v)
select claim, found, case when found is null then 'missing' when found = expected then 'pass' else 'fail' end as status from f""")
def claim_ledger(spark, sf_dir):
    """What is claimed of each priority's artefact: that its mean is the mean of all orders is false."""
    o = table(spark, sf_dir, "orders")
    v = o.groupBy(F.col("o_orderpriority").alias("artefact")).agg(F.count("*").alias("orders"), F.avg("o_totalprice").alias("mean"), (F.count_if(F.col("o_orderstatus") == "F") / F.count("*")).alias("finished"), F.max("o_totalprice").alias("top"))
    body = F.to_json(F.struct(F.struct("orders", "mean", "finished").alias("all"), F.array(F.struct(F.col("top").alias("value"))).alias("most")))
    mean = o.agg(F.avg("o_totalprice").alias("overall"))
    said = {"orders": F.col("orders"), "mean": F.col("overall"), "finished": F.col("finished"), "top": F.col("top"), "gone": F.lit(0)}
    each = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("path"), F.lit(r).alias("rule"), claims.written(said[n].cast("string"), F.lit(r)).alias("expected")) for n, p, r in CLAIMS))
    made = v.crossJoin(F.broadcast(mean)).select("artefact", F.explode(each).alias("x")).select("artefact", F.concat("artefact", F.lit(":"), "x.name").alias("claim"), "x.path", "x.rule", "x.expected")  # one row
    return claims.checked(made, v.select("artefact", body.alias("body")))


@query()
def export_manifest(spark, sf_dir):
    """Suppliers as an export, their keys hidden, and the manifest of its files."""
    to = f"{checkpoints(spark).rstrip('/')}/export-{uuid.uuid4().hex}"
    exports.export(table(spark, sf_dir, "supplier"), to, {"s_suppkey": "SUP-"})
    return exports.manifest(spark, to)
