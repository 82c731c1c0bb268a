"""Bootstraps, permutations and weights over the driver's tables."""

from pyspark.sql import functions as F

from ..operators import resampling as rs
from ..operators import statistics as st
from . import query, table
from .statistics import _W


def _hash(*parts: str) -> str:
    """The SQL of ``resampling.uniform``."""
    return "('0x' || substr(md5(" + " || ':' || ".join(f"({p})::varchar" for p in parts) + "), 1, 8))::ubigint::double / 4294967296.0::double"


_MULTI = "(select draw, l, count(*) as w from (select i // m as draw, floor(" + _hash("'{seed}'", "i // m", "i % m") + " * m)::bigint as k from (select count(distinct {c}) as m from {t}) x, lateral (select unnest(range(0, 50 * m)) as i)) join (select {c} as l, row_number() over (order by {c}) - 1 as k from (select distinct {c} from {t})) using (k) group by draw, l)"


def _multi(t, c, seed):
    return _MULTI.format(t=t, c=c, seed=seed)


def _e(spark, d):
    """Events with a target, changes and a score."""
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("value").alias("y"), (F.col("event_id") * 7919 % 101).cast("double").alias("x"), (F.col("event_id") * 31 % 17).cast("double").alias("s"), (F.col("event_id") % 3 == 0).alias("hit"))


_E = "(select event_id, user_id, user_id as c, event_type, value as y, (event_id * 7919 % 101)::double as x, (event_id * 31 % 17)::double as s, event_id % 3 = 0 as hit from events)"


def _out(df, *cols, digits=8):
    return df.select(F.col("draw").cast("long").alias("draw"), *[F.round(c, digits).alias(c) for c in cols])


def _w(spark, d):
    return st.draws(spark, table(spark, d, "events"), "user_id", 50)


@query("hsh11_multinomial_weights", f"select draw, l as l_returnflag, w from {_multi('lineitem', 'l_returnflag', 3)}")
def _(spark, d):
    return rs.multinomial_draws(spark, table(spark, d, "lineitem"), "l_returnflag", 50, 3).select("draw", "l_returnflag", "w")


_CELLS = "(select n_regionkey as r, p_brand as b, case when count(*) > 3 then avg(l_discount) end as m from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join part on l_partkey = p_partkey group by all)"


def _cells(spark, d):
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy(F.col("n_regionkey").alias("r"), F.col("p_brand").alias("b")).agg(F.when(F.count("*") > 3, F.avg("l_discount")).alias("m"))


def _crossed(draws):
    return f"select draw, round(sum(a.w * b.w * m)::double / nullif(sum(a.w * b.w), 0)::double, 8) as mean, count(*) as cells from {_CELLS} x join {draws('r', 1)} a on x.r = a.r join {draws('b', 2)} b on x.b = b.b and a.draw = b.draw where m is not null group by a.draw"


def _multi_of(c, seed):
    return f"(select draw, l as {c}, w from {_MULTI.format(t=_CELLS, c=c, seed=seed)})"


def _exp_of(c, seed):
    return f"(select draw, {c}, -ln(1 - {_hash(repr(str(seed)), 'draw', c)}) as w from (select distinct {c} from {_CELLS}), range(0, 50) t(draw))"


@query("sta32_crossed_multinomial_bootstrap", _crossed(_multi_of).replace("select draw, round", "select a.draw, round", 1))
def _(spark, d):
    c = _cells(spark, d)
    factors = {f: rs.multinomial_draws(spark, c, f, 50, i) for i, f in ((1, "r"), (2, "b"))}
    return rs.crossed_mean(c, factors, "m").select("draw", F.round("mean", 8).alias("mean"), "cells")


@query("sta34_bayesian_factor_bootstrap", _crossed(_exp_of).replace("select draw, round", "select a.draw, round", 1))
def _(spark, d):
    c = _cells(spark, d)
    out = rs.crossed_mean(c, {f: rs.exponential_draws(c, f, 50, i) for i, f in ((1, "r"), (2, "b"))}, "m")
    return out.select(F.col("draw").cast("long").alias("draw"), F.round("mean", 8).alias("mean"), "cells")


_THREE = "(select l_returnflag as f, l_linestatus as t, l_linenumber as n, avg(l_tax) as m from lineitem group by all)"


def _pick(c, seed):
    return f"(select draw, l as {c}, w from {_MULTI.format(t=_THREE, c=c, seed=seed)})"


@query("sta33_crossed_factors_bootstrap", f"select a.draw, round(sum(a.w * b.w * c.w * m)::double / sum(a.w * b.w * c.w)::double, 8) as mean from {_THREE} x join {_pick('f', 1)} a on x.f = a.f join {_pick('t', 2)} b on x.t = b.t and a.draw = b.draw join {_pick('n', 3)} c on x.n = c.n and a.draw = c.draw group by a.draw")
def _(spark, d):
    c = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("t"), F.col("l_linenumber").alias("n")).agg(F.avg("l_tax").alias("m"))
    return _out(rs.crossed_mean(c, {f: rs.multinomial_draws(spark, c, f, 50, i) for i, f in enumerate("ftn", 1)}, "m"), "mean")


@query("sta28_fit_bootstrap", f"""
with s as (select c, count(*) as n, sum(x) as x, sum(y) as y, sum(x * x) as xx, sum(y * y) as yy, sum(x * y) as xy, sum((y - x) * (y - x)) as e from {_E} group by all),
b as (select draw, sum(w * n) as n, sum(w * x) as x, sum(w * y) as y, sum(w * xx) as xx, sum(w * yy) as yy, sum(w * xy) as xy, sum(w * e) as e from s join {_W} using (c) group by draw)
select draw, round(1 - e / (yy - y * y / n), 7) as r2, round((xy - x * y / n) / sqrt((xx - x * x / n) * (yy - y * y / n)), 7) as r from b
""")
def _(spark, d):
    return _out(rs.fit_metrics(_e(spark, d), "user_id", "y", "x", _w(spark, d)), "r2", "r", digits=7)


def _auroc(score):
    return f"(select draw, sum(p * (b + n / 2)) / nullif(sum(p) * sum(n), 0) as a from (select *, coalesce(sum(n) over (partition by draw order by {score} rows between unbounded preceding and 1 preceding), 0) as b from (select draw, {score}, sum(w * hit::int)::double as p, sum(w * (1 - hit::int))::double as n from {_E} join {_W} using (c) group by draw, {score})) group by draw)"


@query("sta35_auroc_difference", f"select draw, round(p.a - q.a, 8) as delta from {_auroc('x')} p join {_auroc('s')} q using (draw) where p.a is not null and q.a is not null")
def _(spark, d):
    return _out(rs.auroc_difference(_e(spark, d), "user_id", "x", "s", "hit", _w(spark, d)), "delta")


@query("sta48_auroc_drop_beyond_random", f"""
with a as (select draw, a from {_auroc('x')}), b as (select draw, a from {_auroc('s')}), r as (select draw, a from {_auroc('y')})
select draw, round((a.a - b.a) - (a.a - r.a), 8) as excess from a join b using (draw) join r using (draw)
""")
def _(spark, d):
    e, w = _e(spark, d), _w(spark, d)
    drop = rs.auroc_difference(e, "user_id", "x", "s", "hit", w)
    control = rs.auroc_difference(e, "user_id", "x", "y", "hit", w).withColumnRenamed("delta", "random")
    return _out(drop.join(control, "draw").withColumn("excess", F.col("delta") - F.col("random")), "excess")


@query("sta36_selectivity_beyond_random", f"select draw, round(sum(w * y) / sum(w), 8) as selected, round(sum(w * (x + s) / 2) / sum(w), 8) as random, round((sum(w * y) - sum(w * (x + s) / 2)) / sum(w), 8) as excess from {_E} join {_W} using (c) group by draw")
def _(spark, d):
    return _out(rs.beyond_random(_e(spark, d), "user_id", "y", ["x", "s"], _w(spark, d)), "selected", "random", "excess")


@query("sta37_steering_metrics", f"select draw, round(t, 8) as effect, round(o, 8) as off_target, round(o / (abs(t) + o + 1e-6), 8) as index from (select draw, sum(w * y) / sum(w) as t, sqrt(sum(w * (x * x + s * s) / 2) / sum(w)) as o from {_E} join {_W} using (c) group by draw)")
def _(spark, d):
    return _out(rs.steering_metrics(_e(spark, d), "user_id", "y", ["x", "s"], _w(spark, d)), "effect", "off_target", "index")


@query("sta47_by_protocol", f"select draw, round(sum(w * y) / sum(w), 8) as all_records, round(sum(w * y * hit::int) / nullif(sum(w * hit::int), 0), 8) as passing from {_E} join {_W} using (c) group by draw")
def _(spark, d):
    return _out(rs.by_protocol(_e(spark, d), "user_id", "y", "hit", _w(spark, d)), "all_records", "passing")


@query("sta49_wrong_target_margin", f"""
with m as (select draw, event_type = 'click' as own, sum(w * y) / sum(w) as m from {_E} join {_W} using (c) group by draw, event_type)
select draw, round(max(m) filter (own), 8) as own, round(max(m) filter (not own), 8) as worst_other, round(max(m) filter (own) - max(m) filter (not own), 8) as margin from m group by draw
""")
def _(spark, d):
    e = _e(spark, d).withColumn("wanted", F.col("event_type") == "click")
    return _out(rs.wrong_target_margin(e, "user_id", "event_type", "y", "wanted", _w(spark, d)), "own", "worst_other", "margin")


@query("sta45_paired_units", f"""
with u as (select c, avg(y) filter (event_type = 'click') - avg(y) filter (event_type = 'view') as i from {_E} group by all)
select draw, round(sum(w * i) / sum(w), 8) as improvement from u join {_W} using (c) where i is not null group by draw
""")
def _(spark, d):
    return _out(rs.signed_improvement(_e(spark, d), "user_id", "event_type", "click", "view", "y", _w(spark, d)), "improvement")


@query("sta38_permutation_enrichment", f"""
with i as (select p_partkey as k, p_size % 7 as g, p_retailprice > 1500 as c from part), n as (select count(*) filter (c) as n from i),
r as (select draw, g, sum((o <= n)::int) as h from (select *, row_number() over (partition by draw order by u, k) as o from (select draw, k, g, {_hash("'0'", 'draw', 'k')} as u from i, range(0, 40) t(draw))), n group by all),
s as (select g, count(*) as size, count(*) filter (c) as hits from i group by g),
p as (select g, size, hits, (sum((h >= hits)::int) + 1) / 41.0::double as p from r join s using (g) group by all)
select g, size, hits, round(p, 8) as p, round(least(1, min(p * m / k) over (order by k desc rows unbounded preceding)), 8) as q from (select *, row_number() over (order by p, g) as k, count(*) over () as m from p)
""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 7).alias("g"), (F.col("p_retailprice") > 1500).alias("c"))
    return rs.permutation_enrichment(p, "p_partkey", "g", "c", 40).select("g", "size", "hits", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))


@query("sta42_inverse_propensity", """
with r as (select o_orderkey, o_orderstatus = 'F' as t, o_orderpriority as s from orders), p as (select s, avg(t::int) as p from r group by s), b as (select avg(t::int) as b from r),
w as (select o_orderkey, p, case when p > 0 and p < 1 then case when t then b / p else (1 - b) / (1 - p) end end as w from r join p using (s), b), q as (select quantile_cont(w, 0.01) as lo, quantile_cont(w, 0.99) as hi from w)
select o_orderkey, round(p, 8) as propensity, round(greatest(least(w, hi), lo), 8) as weight from w, q
""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("t"), F.col("o_orderpriority").alias("s"))
    return rs.inverse_propensity(o, "t", ["s"]).select("o_orderkey", F.round("propensity", 8).alias("propensity"), F.round("weight", 8).alias("weight"))


@query("sta25_interpolated_area", """
with p as (select l_returnflag as k, x, ln(x) as lx, round(avg(l_discount * x / (x + l_quantity)), 8) as y from lineitem, unnest([1, 4, 8, 16, 32]) u(x) group by all),
b as (select k, min(lx) as lo, (max(lx) - min(lx)) / 49 as st from p group by k), s as (select p.*, lead(lx) over (partition by k order by lx) as nx, lead(y) over (partition by k order by lx) as ny from p),
g as (select k, g, lo + g * st as ga from b, range(0, 50) t(g)), h as (select k, g, any_value(y + (ny - y) * (ga - lx) / (nx - lx)) as h from g join s using (k) where ga >= lx - 1e-9 and (ga < nx - 1e-9 or g = 49) and nx is not null and (g < 49 or abs(ga - nx) < 1e-6) group by all)
select k as l_returnflag, round(sum(h * case when g in (0, 49) then 0.5 else 1 end) / 49, 7) as area from h group by k
""")
def _(spark, d):
    x = F.explode(F.array(*map(F.lit, (1, 4, 8, 16, 32)))).alias("x")
    c = table(spark, d, "lineitem").select("l_returnflag", "l_discount", "l_quantity", x).groupBy("l_returnflag", "x").agg(F.round(F.avg(F.col("l_discount") * F.col("x") / (F.col("x") + F.col("l_quantity"))), 8).alias("y"))
    return rs.interpolated_area(c, "l_returnflag", "x", "y").select("l_returnflag", F.round("area", 7).alias("area"))
