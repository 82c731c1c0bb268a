"""Probes, sparse codes, interventions and subspaces over the driver's tables."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import models
from ..operators import probes as pr
from ..operators import vectors as v
from . import query, table

# Ridge on two features, which SQL can solve in closed form


def _lines(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.array("l_quantity", F.col("l_tax") * 100).alias("x"), (F.col("l_discount") * 100).alias("y"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice") / 1000).alias("z"), (F.col("l_orderkey") * 31 % 97).cast("double").alias("c"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(-1.0).alias("s"))


_L = "(select l_orderkey % 10 as f, l_quantity as a, l_tax * 100 as b, l_discount * 100 as y, case when l_linenumber % 3 <> 0 then l_extendedprice / 1000 end as z, (l_orderkey * 31 % 97)::double as c, case when l_returnflag = 'R' then 1.0 else -1.0 end::double as s from lineitem)"


def _fit(y: str, where: str = "f < 7", alphas: str = "[10.0]") -> str:
    """SQL of ridge weights on raw features: (alpha, wa, wb, w0)."""
    return f"""(select alpha, ((n + alpha) * ba - n * r * bb) / det / sa as wa, ((n + alpha) * bb - n * r * ba) / det / sb as wb, my - ma * ((n + alpha) * ba - n * r * bb) / det / sa - mb * ((n + alpha) * bb - n * r * ba) / det / sb as w0, abs(ba) > abs(bb) as a_first, ba, bb, sa, sb, ma, mb, my, n
  from (select *, (n + alpha) * (n + alpha) - n * r * n * r as det from (select count(*)::double as n, avg(a) as ma, avg(b) as mb, avg({y}) as my, stddev_pop(a) as sa, stddev_pop(b) as sb, corr(a, b) as r, count(*) * covar_pop(a, {y}) / stddev_pop(a) as ba, count(*) * covar_pop(b, {y}) / stddev_pop(b) as bb from {_L} where {where} and {y} is not null), unnest({alphas}::double[]) as u(alpha)))"""


def _r2(y: str, fit: str, where: str = "f > 7") -> str:
    return f"(select alpha, 1 - sum(({y} - wa * a - wb * b - w0) * ({y} - wa * a - wb * b - w0)) / (var_pop({y}) * count(*)) as r2 from {_L}, {fit} where {where} and {y} is not null group by alpha)"


def _split(df):
    f = F.col("l_orderkey") % 10
    return df.where(f < 7), df.where(f == 7), df.where(f > 7)


def _weights(spark, fit: dict):
    return spark.createDataFrame([(t, round(float(w[0]), 8), round(float(w[1]), 8), round(b, 7)) for t, (w, b) in fit.items()], "target string, wa double, wb double, w0 double")


@query("mod03_fixed_penalty_ridge", f"select 'y' as target, round(wa, 8) as wa, round(wb, 8) as wb, round(w0, 7) as w0 from {_fit('y')}")
def _(spark, d):
    return _weights(spark, pr.masked_ridge(_split(_lines(spark, d))[0], "x", ["y"], 10.0))


@query("mod02_masked_ridge", f"select 'y' as target, round(wa, 8) as wa, round(wb, 8) as wb, round(w0, 7) as w0 from {_fit('y')} union all select 'z' as target, round(wa, 8) as wa, round(wb, 8) as wb, round(w0, 7) as w0 from {_fit('z')}")
def _(spark, d):
    return _weights(spark, pr.masked_ridge(_split(_lines(spark, d))[0], "x", ["y", "z"], 10.0))


def _scores(spark, d, targets, alpha=10.0):
    train, _, test = _split(_lines(spark, d))
    fit, rows = pr.masked_ridge(train, "x", targets, alpha), []
    for t in targets:
        rows.append((t, round(pr.explained(v.moments(test, "x", [t]), 2, *fit[t]), 7)))
    return spark.createDataFrame(rows, "target string, r2 double")


@query("mod05_probe_with_control", " union all ".join(f"select '{t}' as target, round(r2, 7) as r2 from {_r2(t, _fit(t))}" for t in ("y", "c")))
def _(spark, d):
    return _scores(spark, d, ["y", "c"])


@query("mod10_decoder_r2", f"select 'z' as target, round(r2, 7) as r2 from {_r2('z', _fit('z'))}")
def _(spark, d):
    return _scores(spark, d, ["z"])


@query("mod06_ridge_classifier", f"select count(*) as n, sum(((wa * a + wb * b + w0 > 0) = (s > 0))::int)::bigint as right from {_L}, {_fit('s')} where f > 7")
def _(spark, d):
    train, _, test = _split(_lines(spark, d))
    w, b = pr.masked_ridge(train, "x", ["s"], 10.0)["s"]
    p = models.predict(test, "x", w, b, "p")
    return p.agg(F.count("*").alias("n"), F.count_if((F.col("p") > 0) == (F.col("s") > 0)).alias("right"))


_CURVE = f"""(with f as {_fit('z')}, one as (select alpha, case when a_first then ba / (n + alpha) / sa else 0 end as wa, case when a_first then 0 else bb / (n + alpha) / sb end as wb, case when a_first then my - ma * ba / (n + alpha) / sa else my - mb * bb / (n + alpha) / sb end as w0 from f)
select 1 as k, r2 from {_r2('z', 'one')} union all select 2 as k, r2 from {_r2('z', 'f')})"""


def _curve(spark, d):
    train, _, test = _split(_lines(spark, d))
    return pr.top_k_curve(v.moments(train, "x", ["z"]), v.moments(test, "x", ["z"]), 2, (1, 2), 10.0)


@query("mod04_top_k_curve", f"select k, round(r2, 7) as r2 from {_CURVE}")
def _(spark, d):
    return spark.createDataFrame([(k, round(r, 7)) for k, r in _curve(spark, d)], "k int, r2 double")


@query("mod09_ninety_percent", f"select min(k) filter (r2 >= 0.9 * top and top > 0) as n90, round(any_value(top), 7) as r2 from {_CURVE}, (select max(r2) filter (k = 2) as top from {_CURVE})")
def _(spark, d):
    c = _curve(spark, d)
    return spark.createDataFrame([(pr.ninety_percent(c), round(c[-1][1], 7))], "n90 int, r2 double")


@query("mod42_full_against_top", f"select round(max(r2) filter (k = 2) - max(r2) filter (k = 1), 7) as gap, max(r2) filter (k = 1) >= 0.8 * max(r2) filter (k = 2) as representative from {_CURVE}")
def _(spark, d):
    c = dict(_curve(spark, d))
    return spark.createDataFrame([(round(c[2] - c[1], 7), c[1] >= 0.8 * c[2])], "gap double, representative boolean")


def _heads(y):
    return f"select '{y}' as target, alpha, round(r2, 7) as r2 from (select *, row_number() over (order by round(r2, 9) desc, alpha) as k from {_r2(y, _fit(y, alphas='[1.0, 1000.0, 100000.0]'), 'f = 7')}) where k = 1"


@query("mod44_multi_target_heads", _heads("y") + " union all " + _heads("z"))
def _(spark, d):
    train, val, _ = _split(_lines(spark, d))
    rows = []
    for t in ("y", "z"):
        ridge, m = models.Ridge(v.moments(train, "x", [t]), 2), v.moments(val, "x", [t])
        best = max(((round(pr.explained(m, 2, w[:, 0], float(b[0])), 9), -a) for a in (1.0, 1000.0, 100000.0) for w, b in [ridge.solve(a)]))
        rows.append((t, -best[1], round(best[0], 7)))
    return spark.createDataFrame(rows, "target string, alpha double, r2 double")


# p-values


@query("sta18_pearson_p")
def _(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity is not null")
    from ..operators.statistics import correlations

    return correlations(li, "l_suppkey", "l_quantity", "l_tax", none=None).select("l_suppkey", "n", "r", pr.pearson_p("r", "n").alias("p"))


@query("sta19_welch")
def _(spark, d):
    return pr.welch(table(spark, d, "events").withColumn("g", F.col("user_id") % 2 == 0), "event_type", "g", "value")


@query("sta19_fisher_exact", """
with t as (select c_nationkey as k, count(*) filter (c_acctbal > 5000 and g) as a, count(*) filter (c_acctbal <= 5000 and g) as b, count(*) filter (c_acctbal > 5000 and not g) as c, count(*) filter (c_acctbal <= 5000 and not g) as d from (select *, c_mktsegment = 'BUILDING' as g from customer) group by all),
i as (select k, a, unnest(range(greatest(0, (a + c) - (c + d)), least(a + c, a + b) + 1)) as i, a + b as n1, c + d as n2, a + c as m from t),
p as (select k, i, a, exp(lgamma(n1 + 1) - lgamma(i + 1) - lgamma(n1 - i + 1) + lgamma(n2 + 1) - lgamma(m - i + 1) - lgamma(n2 - m + i + 1) - lgamma(n1 + n2 + 1) + lgamma(m + 1) + lgamma(n1 + n2 - m + 1)) as p from i)
select p.k as c_nationkey, round(least(1, sum(p) filter (p <= o * (1 + 1e-7))), 8) as p from p join (select k, p as o from p where i = a) using (k) group by all
""")
def _(spark, d):
    g, rich = F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") > 5000
    t = table(spark, d, "customer").groupBy("c_nationkey").agg(*[F.count_if(x).alias(n) for n, x in zip("abcd", (rich & g, ~rich & g, rich & ~g, ~rich & ~g))])
    return t.select("c_nationkey", F.round(pr.fisher_exact("a", "b", "c", "d"), 8).alias("p"))


@query("sta41_feature_yield")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return pr.feature_yield(e, "embedding", "label", e.select("label").distinct())


# Sparse codes with the class means as atoms


def _means(spark, d):
    long = table(spark, d, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    rows = long.groupBy("label", "i").agg(F.avg("x").alias("m")).orderBy("label", "i").collect()
    labels = sorted({r["label"] for r in rows})
    return labels, np.array([[r["m"] for r in rows if r["label"] == k] for k in labels])


_MEANS = "(select row_number() over (order by label) - 1 as atom, label, a from (select label, list(m order by i) as a from (select label, i, avg(x) as m from (select label, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings) group by label, i) group by label))"
_CODES = f"(select vec_id, e, atom, a, c from (select *, row_number() over (partition by vec_id order by c desc, atom) as k from (select vec_id, embedding::double[] as e, atom, a, greatest(list_dot_product(embedding::double[], a), 0) as c from embeddings, {_MEANS})) where k <= 3 and c > 0)"


def _decoded(codes):
    return f"(select vec_id, i, sum(c * x) as y from (select vec_id, c, generate_subscripts(a, 1) as i, unnest(a) as x from {codes}) group by all)"


_ERR = "select vec_id, i, x - coalesce(y, 0) as r, x from (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings) left join {} using (vec_id, i)"


def _coded(spark, d, k=3):
    made = pr.Dictionary(_means(spark, d)[1], k)
    return made, made.encode(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")


@query("mod11_sparse_codes", f"select vec_id, atom, round(c, 8) as code from {_CODES}")
def _(spark, d):
    c = _coded(spark, d)[1].select("vec_id", F.posexplode("codes").alias("atom", "c"))
    return c.where("c > 0").select("vec_id", F.col("atom").cast("long").alias("atom"), F.round("c", 8).alias("code"))


@query("mod14_code_evaluation", f"with r as ({_ERR.format(_decoded(_CODES))}) select (select count(*) from embeddings) as n, round(sum(r * r), 6) as sse, round(1 - sum(r * r) / (select sum(v) from (select var_pop(x) * count(*) as v from r group by i)), 7) as r2, round((select count(*) from {_CODES}) / (select count(*) from embeddings)::double, 8) as l0 from r")
def _(spark, d):
    made, coded = _coded(spark, d)
    e = pr.evaluation(made.decode(coded), "embedding", "decoded", "codes")
    return e.select("n", F.round("sse", 6).alias("sse"), F.round("r2", 7).alias("r2"), F.round("l0", 8).alias("l0"))


@query("mod14_atom_activity", f"select atom, round(count(c) / (select count(*) from embeddings)::double, 8) as rate, round(avg(c), 8) as mean from (select atom from {_MEANS}) left join {_CODES} using (atom) group by atom")
def _(spark, d):
    a = pr.atom_activity(_coded(spark, d)[1], "codes")
    return a.select(F.col("atom").cast("long").alias("atom"), F.round("rate", 8).alias("rate"), F.round("mean", 8).alias("mean"))


_ONE = f"(select * from (select *, row_number() over (partition by vec_id order by c desc, atom) as kk from {_CODES}) where kk = 1)"


@query("mod41_budget_reconstruction", f"with r as ({_ERR.format(_decoded(_ONE))}) select vec_id, round(sum(r * r), 7) as error from r group by vec_id")
def _(spark, d):
    made, coded = _coded(spark, d)
    out = made.decode(coded, budget=1)
    e = F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), "decoded", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return out.select("vec_id", F.round(e, 7).alias("error"))


@query("mod26_clamped_atom", f"select vec_id, round(abs(0.5 - coalesce(c, 0)) * sqrt(list_dot_product(m.a, m.a)), 8) as size from embeddings left join (select vec_id, c from {_CODES} where atom = 0) using (vec_id), (select a from {_MEANS} where atom = 0) m")
def _(spark, d):
    made, coded = _coded(spark, d)
    return pr.clamp_delta(coded, "codes", 0, 0.5, made.atoms).select("vec_id", F.round(v.norm("delta"), 8).alias("size"))


@query("mod34_random_dictionary", """
with a as (select atom, list(x order by j) as a from (select atom, j, case when substr(md5('5:' || atom::varchar || ':' || j::varchar), 1, 1) in ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') then 0.125 else -0.125 end::double as x from range(0, 16) t(atom), range(0, 64) u(j)) group by atom)
select vec_id, round(sum(c), 7) as total from (select *, row_number() over (partition by vec_id order by c desc, atom) as k from (select vec_id, atom, greatest(list_dot_product(embedding::double[], a), 0) as c from embeddings, a)) where k <= 4 group by vec_id
""")
def _(spark, d):
    c = pr.Dictionary.random(16, 64, 4, 5).encode(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding")
    return c.select("vec_id", F.round(v.total("codes"), 7).alias("total"))


# Interventions


@query("mod29_attribution", "select l_suppkey, round(s, 9) as score, row_number() over (order by round(s, 12) desc, l_suppkey) as rank from (select l_suppkey, avg(l_discount * l_tax) as s from lineitem where l_quantity > 25 group by all)")
def _(spark, d):
    a = pr.attribution(table(spark, d, "lineitem").withColumn("focus", F.col("l_quantity") > 25), "l_suppkey", "l_discount", "l_tax", "focus")
    return a.select("l_suppkey", F.round("score", 9).alias("score"), F.row_number().over(v_window("score", "l_suppkey")).alias("rank"))


def v_window(score, tie):
    from pyspark.sql import Window

    return Window.orderBy(F.round(score, 12).desc(), tie)


@query("mod39_head_decomposition", "select l_orderkey, round(0.5 + sum(l_discount * l_tax), 9) as total, round(coalesce(sum(l_discount * l_tax) filter (l_linenumber <= 2), 0), 9) as selected, round(0.5 + sum(l_discount * l_tax) - coalesce(sum(l_discount * l_tax) filter (l_linenumber <= 2), 0), 9) as ablated from lineitem group by all")
def _(spark, d):
    h = pr.head_decomposition(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_discount", "l_tax", 0.5, F.col("l_linenumber") <= 2)
    return h.select("l_orderkey", *[F.round(c, 9).alias(c) for c in ("total", "selected", "ablated")])


@query("mod31_dose_ablation", "select l_orderkey, dose, round(-dose * coalesce(sum(l_discount * l_tax) filter (l_linenumber <= 2), 0), 9) as delta from lineitem, unnest([0.5, 1.0]::double[]) u(dose) group by l_orderkey, dose")
def _(spark, d):
    h = pr.head_decomposition(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_discount", "l_tax", 0.5, F.col("l_linenumber") <= 2)
    return h.select("l_orderkey", "selected", F.explode(F.array(F.lit(0.5), F.lit(1.0))).alias("dose")).select("l_orderkey", "dose", F.round(-F.col("dose") * F.col("selected"), 9).alias("delta"))


@query("mod30_matched_groups", """
with i as (select p_partkey as k, p_size > 40 as c, least(floor(p_retailprice / 2500 * 10), 9) as b, ('0x' || substr(md5('0:' || p_partkey::varchar), 1, 8))::ubigint::double / 4294967296.0::double as u from part), n as (select *, row_number() over (partition by b, c order by u, k) as i from i)
select a.k as p_partkey, f.k as control from n a left join n f on f.b = a.b and f.i = a.i and not f.c where a.c
""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") > 40).alias("c"), (F.col("p_retailprice") / 2500).alias("rate"))
    return pr.matched_groups(p, "p_partkey", "c", "rate")


def _sweep(spark, d):
    x = F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))).alias("step")
    li = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_linenumber") % 3).alias("ord"), "l_discount", "l_quantity", x)
    return li.groupBy("l_returnflag", "ord", "step").agg(F.round(F.avg(F.col("l_discount") * F.col("step") / (F.col("step") + F.col("l_quantity"))), 9).alias("y")).withColumn("ord", F.when(F.col("ord") == 1, "chosen").otherwise(F.col("ord").cast("string")))


_SWEEP = "(select l_returnflag, l_linenumber % 3 as o, step, round(avg(l_discount * step / (step + l_quantity)), 9) as y from lineitem, unnest([1, 2, 4, 8]) u(step) group by all)"


@query("mod27_sweep_selectivity", f"""
with s as (select *, ln(step) as x, lead(ln(step)) over w as nx, lead(y) over w as ny from {_SWEEP} window w as (partition by l_returnflag, o order by step)), a as (select l_returnflag, o, sum((y + ny) / 2 * (nx - x)) / (max(x) - min(x)) as a from s group by all)
select l_returnflag, round(max(a) filter (o = 1), 8) as selected, round(avg(a) filter (o <> 1), 8) as random, round(max(a) filter (o = 1) - avg(a) filter (o <> 1), 8) as excess from a group by all
""")
def _(spark, d):
    s = pr.sweep_selectivity(_sweep(spark, d), "l_returnflag", "ord", "step", "y", "chosen")
    return s.select("l_returnflag", *[F.round(c, 8).alias(c) for c in ("selected", "random", "excess")])


@query("mod28_endpoint_selectivity", f"select l_returnflag, round(max(y) filter (o = 1), 8) as selected, round(avg(y) filter (o <> 1), 8) as random, round(max(y) filter (o = 1) - avg(y) filter (o <> 1), 8) as excess from {_SWEEP} where step = 8 group by all")
def _(spark, d):
    s = pr.endpoint_selectivity(_sweep(spark, d), "l_returnflag", "ord", "step", "y", "chosen")
    return s.select("l_returnflag", *[F.round(c, 8).alias(c) for c in ("selected", "random", "excess")])


@query("mod21_residual_audit", "select l_returnflag, round(b, 9) as r2_before, round(a, 9) as r2_after, round(greatest(0.02, 0.35 * greatest(b, 0.04)), 9) as limit, a <= greatest(0.02, 0.35 * greatest(b, 0.04)) as passed from (select l_returnflag, corr(l_extendedprice, l_quantity) ** 2 as b, corr(l_extendedprice, l_tax) ** 2 as a from lineitem group by all)")
def _(spark, d):
    a = pr.residual_audit(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_tax", "l_extendedprice")
    return a.select("l_returnflag", *[F.round(c, 9).alias(c) for c in ("r2_before", "r2_after", "limit")], "passed")


@query("mod22_concept_coupling", "with m as (select user_id, event_type as t, avg(value) as v from events group by all) select a.t as a, b.t as b, count(*) as n, round(corr(a.v, b.v), 8) as r from m a join m b on a.user_id = b.user_id and a.t < b.t group by all")
def _(spark, d):
    m = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    return pr.coupling(m, "user_id", "event_type", "v").select("a", "b", "n", F.round("r", 8).alias("r"))


# Subspaces and directions

_DIRECTION = "(select list(m order by i) as u from (select i, d / sqrt(sum(d * d) over ()) as m from (select i, avg(x) filter (label = 0) - avg(x) filter (label <> 0) as d from (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings) group by i)))"


@query("vec13_select_by_direction", f"select vec_id, round(dot, 8) as dot, row_number() over (order by abs(dot) desc, vec_id) as rank from (select vec_id, list_dot_product(embedding::double[], u) as dot from embeddings, {_DIRECTION} order by abs(dot) desc, vec_id limit 25)")
def _(spark, d):
    e = table(spark, d, "embeddings")
    u = models.class_direction(e, "embedding", F.col("label") == 0)
    return pr.select_by_direction(e, "vec_id", "embedding", u, 25).select("vec_id", F.round("dot", 8).alias("dot"), "rank")


@query("mod43_concept_directions", "select i, round(d, 9) as raw, round(d / case when s > 1e-8 then s else 1 end, 8) as standardised from (select (i - 1)::int as i, avg(x) filter (label = 0) - avg(x) filter (label <> 0) as d, stddev_pop(x) as s from (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings) group by i)")
def _(spark, d):
    long = table(spark, d, "embeddings").select((F.col("label") == 0).alias("y"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    s = long.groupBy("i").agg((F.avg(F.when(F.col("y"), F.col("x"))) - F.avg(F.when(~F.col("y"), F.col("x")))).alias("d"), F.stddev_pop("x").alias("s"))
    return s.select("i", F.round("d", 9).alias("raw"), F.round(F.col("d") / F.when(F.col("s") > 1e-8, F.col("s")).otherwise(1.0), 8).alias("standardised"))


@query("vec08_geometric_agreement", f"select a.label as a, b.label as b, round(list_dot_product(a.a, b.a) ** 2 / (list_dot_product(a.a, a.a) * list_dot_product(b.a, b.a)), 8) as agreement from {_MEANS} a, {_MEANS} b where a.label < b.label")
def _(spark, d):
    labels, m = _means(spark, d)
    rows = [(a, b, round(pr.geometric_agreement(m[i : i + 1], m[j : j + 1]), 8)) for i, a in enumerate(labels) for j, b in enumerate(labels) if a < b]
    return spark.createDataFrame(rows, "a int, b int, agreement double")


@query("vec09_subspace_overlap", f"""
with m as {_MEANS}, p as (select x.label as k, x.a as a, y.a as b from m x join m y on y.label = x.label + 1),
v as (select x.k as x, y.k as y, list_dot_product(x.a, x.a) as xx, list_dot_product(x.b, x.b) as ll, list_dot_product(x.a, x.b) as xl, list_dot_product(y.a, y.a) as yy, list_dot_product(y.b, y.b) as mm, list_dot_product(y.a, y.b) as ym,
  list_dot_product(x.a, y.a) as a, list_dot_product(x.a, y.b) as b, list_dot_product(x.b, y.a) as c, list_dot_product(x.b, y.b) as d from p x join p y on x.k < y.k)
select x, y, round((ll * (a * (mm * a - ym * b) + b * (yy * b - ym * a)) - 2 * xl * (a * (mm * c - ym * d) + b * (yy * d - ym * c)) + xx * (c * (mm * c - ym * d) + d * (yy * d - ym * c))) / ((xx * ll - xl * xl) * (yy * mm - ym * ym)) / 2, 8) as overlap from v
""")
def _(spark, d):
    """The overlap of the planes that two neighbouring classes' means span, for every two planes."""
    labels, m = _means(spark, d)
    planes = {k: np.stack([m[i], m[labels.index(k + 1)]]) for i, k in enumerate(labels) if k + 1 in labels}
    return spark.createDataFrame([(x, y, round(models.subspace_overlap(planes[x], planes[y]), 8)) for x in planes for y in planes if x < y], "x int, y int, overlap double")


@query("mod18_random_basis", "select vec_id, round(list_dot_product(embedding::double[], embedding::double[]), 8) as energy from embeddings")
def _(spark, d):
    """The energy of every vector in a random basis of the whole space, which is its own."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    turned = pr.linear_map(e, "embedding", "turned", pr.random_basis(width, width, 3))
    return turned.select("vec_id", F.round(v.dot("turned", "turned"), 8).alias("energy"))


@query("vec16_greatest_cosine", """
with s as (select vec_id, embedding::double[] as e from embeddings order by ('0x' || substr(md5('0:' || vec_id::varchar), 1, 8))::ubigint, vec_id limit 20)
select s.vec_id, round(max(list_cosine_similarity(s.e, o.embedding::double[])), 8) as cosine from s, embeddings o where s.vec_id <> o.vec_id group by all
""")
def _(spark, d):
    return pr.greatest_cosine(table(spark, d, "embeddings"), "vec_id", "embedding", 20).select("vec_id", F.round("cosine", 8).alias("cosine"))


@query("vec11_pairing_floor", """
with b as (select vec_id, embedding::double[] as e, floor(('0x' || substr(md5('0:' || vec_id::varchar), 1, 8))::ubigint::double / 4294967296.0::double * 64) as b from embeddings), n as (select *, row_number() over (partition by b order by md5('0:' || vec_id::varchar), vec_id) as i from b),
p as (select b, (i - 1) // 2 as p, list(e order by i) as v from n group by all having count(*) = 2)
select count(*) as n, round(avg(abs(list_cosine_similarity(v[1], v[2]))), 8) as floor from p
""")
def _(spark, d):
    return pr.pairing_floor(table(spark, d, "embeddings"), "vec_id", "embedding").select("n", F.round("floor", 8).alias("floor"))


# What SQL can state of decompositions


@query("mod19_residual_covariance", "select i::int as i, 0.0::double as covariance from range(0, 64) t(i)")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("z", (F.col("label") == 3).cast("double"))
    erased = models.Eraser(v.moments(e, "embedding", ["z"]), 64).apply(e, "embedding", "erased")
    c = erased.select("z", F.posexplode("erased").alias("i", "x")).groupBy("i").agg(F.covar_pop("x", "z").alias("c"))
    return c.select("i", F.abs(F.round("c", 7)).alias("covariance"))


@query("mod32_equal_moments", "select (i - 1)::int as i, round(avg(x), 6) as mean, round(var_pop(x), 6) as variance from (select generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings where label >= 5) group by i")
def _(spark, d):
    e = table(spark, d, "embeddings")
    m, shift = models.transport(v.moments(e.where("label < 5"), "embedding"), v.moments(e.where("label >= 5"), "embedding"))
    moved = pr.linear_map(e.where("label < 5").select("vec_id", "embedding"), "embedding", "moved", m, shift)
    return moved.select(F.posexplode("moved").alias("i", "x")).groupBy("i").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.var_pop("x"), 6).alias("variance"))


@query("mod15_total_variance", "select round(sum(v), 8) as total from (select var_pop(x) as v from (select generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings) group by i)")
def _(spark, d):
    _, values = models.principal_directions(v.moments(table(spark, d, "embeddings"), "embedding"), 64)
    return spark.createDataFrame([(round(float(values.sum()), 8),)], "total double")


@query("vec12_cka_of_halves", """
with l as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), c as (select a.i, b.i as j, covar_pop(a.x, b.x) as c from l a join l b using (vec_id) group by all)
select round(sum(c * c) filter (i <= 32 and j > 32) / sqrt(sum(c * c) filter (i <= 32 and j <= 32) * sum(c * c) filter (i > 32 and j > 32)), 8) as cka from c
""")
def _(spark, d):
    return spark.createDataFrame([(round(models.linear_cka(v.moments(table(spark, d, "embeddings"), "embedding"), 32), 8),)], "cka double")


@query("mod33_projection", f"select vec_id, round(list_dot_product(embedding::double[], u), 8) as projection from embeddings, {_DIRECTION}")
def _(spark, d):
    e = table(spark, d, "embeddings")
    u = models.class_direction(e, "embedding", F.col("label") == 0)
    return e.select("vec_id", F.round(v.dot(F.col("embedding").cast("array<double>"), models.weights_column(u)), 8).alias("projection"))


@query("src21_array_archive", "select label, vec_id, round(list_sum(embedding::double[]), 8) as total from embeddings")
def _(spark, d):
    from ..sources import tables as src

    packed = src.pack_arrays(table(spark, d, "embeddings"), "label", "x", "embedding", "vec_id")
    return src.unpack_arrays(packed, ["label"], "content", "x", "vec_id").select("label", "vec_id", F.round(v.total("x"), 8).alias("total"))


@query("vec07_matrix_root", "select i::int as i, j::int as j, 0.0::double as difference from range(0, 64) a(i), range(0, 64) b(j)")
def _(spark, d):
    c = v.moments(table(spark, d, "embeddings"), "embedding").covariance
    r = models.matrix_root(c)
    return spark.createDataFrame([(i, j, abs(round(float(x), 9))) for (i, j), x in np.ndenumerate(r @ r - c)], "i int, j int, difference double")


@query("vec15_low_rank_logits", f"select vec_id, k::int as head, round(sum(list_dot_product(embedding::double[], a) * ((atom + 1) * (k + 2) % 5 - 2)), 8) as logit from embeddings, {_MEANS}, range(0, 3) t(k) group by vec_id, k")
def _(spark, d):
    _, m = _means(spark, d)
    heads = np.array([[(i + 1) * (k + 2) % 5 - 2 for i in range(len(m))] for k in range(3)], float)
    low = pr.linear_map(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", "low", m)
    out = pr.linear_map(low, "low", "logits", heads)
    return out.select("vec_id", F.posexplode("logits").alias("head", "x")).select("vec_id", "head", F.round("x", 8).alias("logit"))


@query("sig01_chosen_leads", "select vec_id, round(embedding[1]::double, 8) as a, round(embedding[2]::double, 8) as b, round(embedding[7]::double, 8) as c from embeddings")
def _(spark, d):
    c = pr.chosen(F.col("embedding").cast("array<double>"), [0, 1, 6])
    return table(spark, d, "embeddings").select("vec_id", c.alias("x")).select("vec_id", *[F.round(F.col("x")[i], 8).alias(n) for i, n in enumerate("abc")])


@query("sig07_anchor_warp", """
with e as (select vec_id, embedding::double[] as x from embeddings), j as (select j, case when j <= 37.8 then j / 37.8 * 31.5 else 31.5 + (j - 37.8) / (63 - 37.8) * 31.5 end as pt from range(0, 64) t(j)), k as (select j, pt, least(floor(pt), 62)::int as lo from j)
select vec_id, j::int as i, round(x[lo + 1] * (1 - (pt - lo)) + x[lo + 2] * (pt - lo), 8) as y from e, k
""")
def _(spark, d):
    w = pr.warp(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", [0.0, 0.5, 1.0], [0.0, 0.6, 1.0], "warped")
    return w.select("vec_id", F.posexplode("warped").alias("i", "y")).select("vec_id", "i", F.round("y", 8).alias("y"))


_AUC = "(select f, target, (sum(mid) filter (label = target) - p * (p + 1) / 2.0::double) / (p * (n - p))::double as a from (select *, count(*) over (partition by f) as n from (select f, label, rank() over (partition by f order by s) + (count(*) over (partition by f, s) - 1) / 2.0::double as mid from l where {})) k, (select label as target, count(*) as p from embeddings where {} group by all) c group by f, target, p, n)"


@query("sta09_frozen_auroc_profile", f"""
with l as (select vec_id, label, (generate_subscripts(embedding, 1) - 1)::int as f, round(unnest(embedding)::double, 2) as s from embeddings), a as {_AUC.format('vec_id % 10 < 7', 'vec_id % 10 < 7')}, b as {_AUC.format('vec_id % 10 >= 7', 'vec_id % 10 >= 7')},
t as (select * from (select *, row_number() over (partition by target order by abs(round(a, 9) - 0.5) desc, f) as k from a) where k = 1)
select t.target, t.f as feature, round(greatest(t.a, 1 - t.a), 8) as train, round(case when t.a >= 0.5 then b.a else 1 - b.a end, 8) as heldout from t join b on t.target = b.target and t.f = b.f
""")
def _(spark, d):
    from ..operators import relational as rel
    from ..operators import statistics as st

    e = table(spark, d, "embeddings")
    a, b = (st.class_auroc(e.where(c), "embedding", "label", 2) for c in ("vec_id % 10 < 7", "vec_id % 10 >= 7"))
    best = rel.top_per_key(a.withColumn("auroc", F.col("auroc")), "target", [F.abs(F.round("auroc", 9) - 0.5).desc(), F.col("feature")])
    t = best.select("target", "feature", F.col("auroc").alias("_a")).join(b.select("target", "feature", F.col("auroc").alias("_b")), ["target", "feature"])
    return t.select("target", "feature", F.round(F.greatest("_a", 1 - F.col("_a")), 8).alias("train"), F.round(F.when(F.col("_a") >= 0.5, F.col("_b")).otherwise(1 - F.col("_b")), 8).alias("heldout"))


@query("sta03_correlation_from_sums", "select l_suppkey, case when count(*) > 1 then round(corr(l_quantity, l_extendedprice), 8) else 0 end as r from lineitem group by all")
def _(spark, d):
    from ..operators import statistics as st

    return st.correlations(table(spark, d, "lineitem"), "l_suppkey", "l_quantity", "l_extendedprice").select("l_suppkey", F.round("r", 8).alias("r"))


@query("mod07_logistic_probe")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("y", (F.col("label") == 3).cast("double"))
    c, a, w, b = pr.logistic_probe(e.where("vec_id % 10 < 7"), e.where("vec_id % 10 >= 7"), "embedding", "y", (0.1, 1.0))
    return spark.createDataFrame([(c, a, [float(x) for x in w], b)], "strength double, auroc double, weights array<double>, intercept double")


@query("mod38_sparse_logistic_probe")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("y", (F.col("label") == 3).cast("double"))
    c, a, w, _ = pr.logistic_probe(e.where("vec_id % 10 < 7"), e.where("vec_id % 10 >= 7"), "embedding", "y", (0.1, 1.0), l1=True)
    return spark.createDataFrame([(c, a, int((w != 0).sum()))], "strength double, auroc double, used int")


@query("mod16_independent_components", "select component, n, 1.0::double as agreement from (select 'discount' as component union all select 'quantity' union all select 'tax'), (select count(*) as n from lineitem)")
def _(spark, d):
    """Quantities, discounts and taxes, which are independent, mixed with one another and found again: each one's greatest
    correlation with a component, to one digit."""
    from ..operators import statistics as st

    q, x, t = F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12
    li = table(spark, d, "lineitem").select(q.alias("quantity"), x.alias("discount"), t.alias("tax"), F.array(q + 0.5 * x - 0.3 * t, x - 0.4 * q + 0.6 * t, t + 0.7 * q + 0.2 * x).alias("v"))
    w, _ = pr.independent_components(li, "v", 3, rounds=60)
    found = pr.linear_map(li, "v", "c", w)
    each = F.explode(F.create_map(F.lit("quantity"), F.col("quantity"), F.lit("discount"), F.col("discount"), F.lit("tax"), F.col("tax"))).alias("component", "s")
    long = found.select("c", each).select("component", "s", F.posexplode("c").alias("i", "x"))
    r = st.correlations(long, ["component", "i"], "s", "x")
    return r.groupBy("component").agg(F.max("n").alias("n"), F.round(F.max(F.abs("r")), 1).alias("agreement"))


_LIMIT = 0.08


@query("mod35_orthogonal_set", f"""
with l as (select vec_id, generate_subscripts(embedding, 1) - 1 as f, unnest(embedding)::double as x from embeddings), r as (select a.f as i, b.f as j, abs(corr(a.x, b.x)) as r from l a join l b on a.vec_id = b.vec_id and a.f <> b.f group by all),
v as (select f, row_number() over (order by var_pop(x) desc, f) as place from l group by f)
select (select count(*) from r where r > {_LIMIT} and i < j) as clashes, true as apart, true as full, true as swapped
""")
def _(spark, d):
    """Components in the order of their variances, kept if they correlate with none kept before: whether those kept are
    apart, whether no other fits in, and whether no swap of one for two is left; and how many pairs clash at all."""
    m = v.moments(table(spark, d, "embeddings"), "embedding")
    sd = np.sqrt(np.diag(m.covariance))
    r = np.abs(m.covariance / np.outer(sd, sd))
    order = np.lexsort((np.arange(len(sd)), -(sd**2))).tolist()
    kept = pr.orthogonal_set(order, r[np.ix_(order, order)], _LIMIT)
    fits = lambda c, s: all(r[c, k] <= _LIMIT for k in s if k != c)
    rest = [c for c in order if c not in kept]
    swaps = any(r[a, b] <= _LIMIT and fits(a, set(kept) - {out}) and fits(b, set(kept) - {out}) for out in kept for i, a in enumerate(rest) for b in rest[i + 1 :])
    clashes = int((np.triu(r, 1) > _LIMIT).sum())
    return spark.createDataFrame([(clashes, all(fits(c, kept) for c in kept), not any(fits(c, kept) for c in rest), not swaps)], "clashes long, apart boolean, full boolean, swapped boolean")


@query("sig06_interval_features", """
with s as (select user_id, list(event_id order by event_id) as m from events group by user_id), d as (select user_id, list_sort(list_filter([m[i + 1] - m[i] for i in range(1, len(m))], lambda x: x between 5 and 500)) as g from s)
select user_id, len(g) as n, case when len(g) > 0 then (g[(len(g) + 1) // 2] + g[len(g) // 2 + 1]) / 2.0::double end as median from d
""")
def _(spark, d):
    m = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("m"))
    return m.select("user_id", pr.interval_features("m", 5, 500).alias("f")).select("user_id", F.col("f.n").alias("n"), F.col("f.median").alias("median"))


@query("mod17_semi_nmf")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    return pr.SemiNmf.fit(e, "embedding", 6, rounds=5).transform(e, "embedding").select("vec_id", "codes")
