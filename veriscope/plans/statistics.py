"""Ranking, association and inference over the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import split_by_fraction
from ..operators import relational as rel
from ..operators import statistics as st
from . import query, table

_CORR = "case when vz > 1e-12 and vy > 1e-12 then greatest(least(cov / sqrt(vz * vy), 1), -1) else 0 end"
_LONG = "select vec_id, label, (generate_subscripts(embedding, 1) - 1)::int as feature, unnest(embedding)::double as x from embeddings"
_SPLIT = "case when f < 0.70 then 'train' when f < 0.85 then 'val' else 'test' end"
_SLICE0 = f"""
with e as (select vec_id, label, embedding, ('0x' || substr(sha256('0:' || vec_id::varchar), 1, 8))::ubigint::double / 4294967295.0::double as f from embeddings),
l as (select {_SPLIT} as split, label, (generate_subscripts(embedding, 1) - 1)::int as feature, unnest(embedding)::double as x from e),
c as (select distinct label as target from embeddings),
a as (select split, feature, target, count(*)::bigint as n, sum(x) as sz, sum(x * x) as szz, sum((label = target)::int)::double as sy, sum(case when label = target then x else 0 end) as szy from l, c group by all),
r as (select split, feature, target, n, round(case when szz - sz * sz / n > 1e-12 and sy - sy * sy / n > 1e-12 then greatest(least((szy - sz * sy / n) / sqrt((szz - sz * sz / n) * (sy - sy * sy / n)), 1), -1) else 0 end, 8) as r from a),
s as (select feature, target, r, row_number() over (partition by target order by abs(r) desc, feature) as i from r where split = 'train')
"""


def _selected(spark, d):
    e = table(spark, d, "embeddings").withColumn("split", split_by_fraction("vec_id"))
    classes = e.select("label")
    side = lambda s: st.class_correlations(e.where(F.col("split") == s), "embedding", "label", classes).withColumn("r", F.round("r", 8))
    best = st.select_first_best(side("train"), "target", "feature", "r").select("feature", "target", F.col("r").alias("train_r"))
    return best.join(side("test").select("feature", "target", F.col("r").alias("test_r")), ["feature", "target"])


@query("slice0_selected_association", _SLICE0 + "select s.target, s.feature, s.r as train_r, t.r as test_r from s join r t on t.split = 'test' and t.feature = s.feature and t.target = s.target where s.i = 1")
def _(spark, d):
    """Features selected on train rows, evaluated on held-out rows."""
    return _selected(spark, d).select("target", "feature", "train_r", "test_r")


@query("sta06_selection_summary", _SLICE0 + """select count(*) as n, round(avg(abs(t.r)), 8) as mean_abs, round(quantile_cont(abs(t.r), 0.5), 8) as median_abs, round(avg((sign(s.r) = sign(t.r))::int), 8) as sign_match, round(avg((abs(t.r) >= 0.10)::int), 8) as coverage_10, round(avg((abs(t.r) >= 0.20)::int), 8) as coverage_20
from s join r t on t.split = 'test' and t.feature = s.feature and t.target = s.target where s.i = 1""")
def _(spark, d):
    a = F.abs("test_r")
    return _selected(spark, d).agg(F.count("*").alias("n"), F.round(F.avg(a), 8).alias("mean_abs"), F.round(F.percentile(a, F.lit(0.5)), 8).alias("median_abs"), F.round(F.avg((F.signum("train_r") == F.signum("test_r")).cast("int")), 8).alias("sign_match"), F.round(F.avg((a >= 0.10).cast("int")), 8).alias("coverage_10"), F.round(F.avg((a >= 0.20).cast("int")), 8).alias("coverage_20"))


@query("sta07_oriented_profile", _SLICE0 + """, b as (select feature, target, r, row_number() over (partition by feature order by abs(r) desc, target) as i from r where split = 'train')
select b.feature, b.target, round(sign(b.r) * t.r, 8) as oriented, abs(t.r) as strength from b join r t on t.split = 'test' and t.feature = b.feature and t.target = b.target where b.i = 1""")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("split", split_by_fraction("vec_id"))
    side = lambda s: st.class_correlations(e.where(F.col("split") == s), "embedding", "label", e.select("label")).withColumn("r", F.round("r", 8))
    best = rel.top_per_key(side("train"), "feature", [F.abs("r").desc(), F.col("target")]).select("feature", "target", F.col("r").alias("train_r"))
    return best.join(side("test").select("feature", "target", "r"), ["feature", "target"]).select("feature", "target", F.round(F.signum("train_r") * F.col("r"), 8).alias("oriented"), F.abs("r").alias("strength"))


@query("sta08_candidate_budget", _SLICE0 + """, q as (select feature, target, r, row_number() over (partition by target order by abs(r) desc, feature) as i from r where split = 'train' and feature % 4 = 0) select target, feature, r as train_r from q where i = 1""")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("split", split_by_fraction("vec_id")).where("split = 'train'")
    budget = spark.range(0, 64, 4).select(F.col("id").cast("int").alias("feature"))
    a = st.class_correlations(e, "embedding", "label", table(spark, d, "embeddings").select("label")).withColumn("r", F.round("r", 8)).join(F.broadcast(budget), "feature", "left_semi")
    return st.select_first_best(a, "target", "feature", "r").select("target", "feature", F.col("r").alias("train_r"))


@query("sta01_pearson_degenerate", f"""
select l_returnflag, kind, round({_CORR}, 8) as r from (select l_returnflag, kind, n, szz - sz * sz / n as vz, syy - sy * sy / n as vy, szy - sz * sy / n as cov from (
 select l_returnflag, kind, count(*) as n, sum(z) as sz, sum(z * z) as szz, sum(y) as sy, sum(y * y) as syy, sum(z * y) as szy from (select l_returnflag, 'real' as kind, l_quantity as z, l_discount as y from lineitem union all select l_returnflag, 'flat', l_quantity, 1.0::double from lineitem) group by all))
""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    both = li.select("l_returnflag", F.lit("real").alias("kind"), F.col("l_quantity").alias("z"), F.col("l_discount").alias("y")).unionByName(li.select("l_returnflag", F.lit("flat").alias("kind"), F.col("l_quantity").alias("z"), F.lit(1.0).alias("y")))
    return st.correlations(both, ["l_returnflag", "kind"], "z", "y").select("l_returnflag", "kind", F.round("r", 8).alias("r"))


@query("sta02_feature_by_class", f"""
with l as ({_LONG}), c as (select distinct label as target from embeddings), a as (select feature, target, count(*) as n, sum(x) as sz, sum(x * x) as szz, sum((label = target)::int)::double as sy, sum(case when label = target then x else 0 end) as szy from l, c group by all)
select feature, target, round(case when szz - sz * sz / n > 1e-12 and sy - sy * sy / n > 1e-12 then (szy - sz * sy / n) / sqrt((szz - sz * sz / n) * (sy - sy * sy / n)) else 0 end, 8) as r from a
""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return st.class_correlations(e, "embedding", "label", e.select("label")).select("feature", "target", F.round("r", 8).alias("r"))


@query("sta04_masked_correlation", """
select user_id, round(corr(z, y), 8) as r from (select user_id, case when event_id % 4 <> 0 then value end as z, case when event_id % 5 <> 0 then (event_id * 7919 % 101)::double end as y from events) where z is not null and y is not null group by user_id having count(*) >= 3
""")
def _(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select("user_id", F.when(i % 4 != 0, F.col("value")).alias("z"), F.when(i % 5 != 0, (i * 7919 % 101).cast("double")).alias("y"))
    return st.correlations(e, "user_id", "z", "y", none=None, rows=3).where("n >= 3").select("user_id", F.round("r", 8).alias("r"))


@query("sta10_tie_aware_auroc", """
with l as (select feature, label, round(x, 2) as s from (select label, (generate_subscripts(embedding, 1) - 1)::int as feature, unnest(embedding)::double as x from embeddings)),
k as (select feature, s, label, (rank() over (partition by feature order by s) + (count(*) over (partition by feature, s) - 1) / 2.0::double) as mid from l),
c as (select distinct label as target from embeddings)
select feature, target, round((sum(case when label = target then mid else 0 end) - sum((label = target)::int) * (sum((label = target)::int) + 1) / 2.0::double) / (sum((label = target)::int) * (count(*) - sum((label = target)::int)))::double, 8) as auroc from k, c group by all
""")
def _(spark, d):
    return st.class_auroc(table(spark, d, "embeddings"), "embedding", "label", 2).select("feature", "target", F.round("auroc", 8).alias("auroc"))


@query("sta11_weighted_auroc", """
with w as (select value as s, (event_type = 'purchase') as y, 1 + event_id % 3 as w, user_id % 5 as g from events), a as (select g, s, sum(case when y then w else 0 end) as p, sum(case when y then 0 else w end) as q from w group by all),
c as (select g, p, q, coalesce(sum(q) over (partition by g order by s rows between unbounded preceding and 1 preceding), 0) as below from a)
select g, round(sum(p * (below + q / 2.0::double)) / (sum(p) * sum(q))::double, 8) as auroc from c group by g
""")
def _(spark, d):
    e = table(spark, d, "events").select("value", (F.col("event_type") == "purchase").alias("y"), (1 + F.col("event_id") % 3).alias("w"), (F.col("user_id") % 5).alias("g"))
    return st.weighted_auroc(e, "g", "value", "y", "w").withColumn("auroc", F.round("auroc", 8))


@query("sta12_average_precision", """
with a as (select user_id, round(value, 0) as s, count(*) as n, sum((event_type = 'click')::int)::double as p from events group by all), c as (select user_id, p, sum(p) over w / sum(n) over w as pr from a window w as (partition by user_id order by s desc rows unbounded preceding))
select user_id, round(sum(pr * p) / nullif(sum(p), 0), 8) as ap from c group by all
""")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", F.round("value", 0).alias("s"), (F.col("event_type") == "click").cast("int").alias("y"))
    return st.average_precision(e, "user_id", "s", "y").select("user_id", F.round("ap", 8).alias("ap"))


@query("sta13_variance_mask", "select feature, var_pop(case when feature % 8 = 0 then 1.0 else x end) > 1e-12 as varies from (" + _LONG + ") group by feature")
def _(spark, d):
    long = st.long_vectors(table(spark, d, "embeddings"), "vec_id", "embedding")
    return long.groupBy("feature").agg((F.var_pop(F.when(F.col("feature") % 8 == 0, 1.0).otherwise(F.col("value"))) > 1e-12).alias("varies"))


@query("sta14_specificity_threshold", "select event_type, value as threshold from (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events) where i = ceil((n - 1) * 0.95::double)")
def _(spark, d):
    return st.higher_quantile(table(spark, d, "events"), "event_type", "value", 0.95)


@query("sta15_calibration", """
select g, round(sum(n * abs(p - y)) / sum(n), 8) as ece, round(sum(e) / sum(n), 8) as brier from (select user_id % 4 as g, least(floor(value / 100 * 10), 9) as b, count(*) as n, avg(value / 100) as p, avg((event_type = 'view')::int) as y, sum((value / 100 - (event_type = 'view')::int) ** 2) as e from events where value between 0 and 100 group by all) group by g
""")
def _(spark, d):
    e = table(spark, d, "events").where("value between 0 and 100").select((F.col("user_id") % 4).alias("g"), (F.col("value") / 100).alias("p"), (F.col("event_type") == "view").cast("int").alias("y"))
    return st.calibration_error(e, "g", "p", "y").select("g", F.round("ece", 8).alias("ece"), F.round("brier", 8).alias("brier"))


@query("sta16_spearman", """
with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0::double as a, rank() over (partition by l_returnflag order by l_discount) + (count(*) over (partition by l_returnflag, l_discount) - 1) / 2.0::double as b from lineitem) select l_returnflag, round(corr(a, b), 7) as rho from r group by all
""")
def _(spark, d):
    return st.spearman(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_discount").select("l_returnflag", F.round("r", 7).alias("rho"))


@query("sta17_kendall", """
with m as (select user_id % 3 as g, event_type as item, round(avg(value), 6) as x, count(*) as y from events group by all) select a.g, round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))), 8) as tau from m a join m b on a.g = b.g and a.item < b.item group by all
""")
def _(spark, d):
    m = table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("g"), F.col("event_type").alias("item")).agg(F.round(F.avg("value"), 6).alias("x"), F.count("*").alias("y"))
    return st.kendall(m, "g", "item", "x", "y").select("g", F.round("tau", 8).alias("tau"))


@query("sta20_standardised_difference", """
select event_type, round((avg(value) filter (odd) - avg(value) filter (not odd)) / sqrt((var_samp(value) filter (odd) + var_samp(value) filter (not odd)) / 2), 8) as smd from (select *, user_id % 2 = 1 as odd from events) group by all
""")
def _(spark, d):
    e = table(spark, d, "events").withColumn("odd", F.col("user_id") % 2 == 1)
    return st.smd(e, "event_type", "odd", "value").select("event_type", F.round("smd", 8).alias("smd"))


@query("sta22_benjamini_hochberg", """
with p as (select p_partkey, (p_partkey * 7919 % 1000 + 1) / 1001.0::double as p from part), k as (select p_partkey, p, row_number() over (order by p, p_partkey) as i, count(*) over () as m from p)
select p_partkey, round(p, 10) as p, round(least(1, min(p * m / i) over (order by i desc rows unbounded preceding)), 10) as q from k
""")
def _(spark, d):
    p = table(spark, d, "part").select("p_partkey", ((F.col("p_partkey") * 7919 % 1000 + 1) / 1001).alias("p"))
    return st.adjust_large(p, "p", "p_partkey").select("p_partkey", F.round("p", 10).alias("p"), F.round("q", 10).alias("q"))


@query("sta23_adjust_with_missing", """
with p as (select p_brand, p_partkey, case when p_partkey % 6 <> 0 then (p_partkey * 7919 % 1000 + 1) / 1001.0::double end as p from part), k as (select *, row_number() over (partition by p_brand order by p, p_partkey) as i, count(*) over (partition by p_brand) as m from p where p is not null)
select p_partkey, round(least(1, min(p * m / i) over (partition by p_brand order by i desc rows unbounded preceding)), 10) as q from k union all select p_partkey, null from p where p is null
""")
def _(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_brand", "p_partkey", F.when(k % 6 != 0, (k * 7919 % 1000 + 1) / 1001).alias("p"))
    return st.adjust(p, "p_brand", "p", "p_partkey").select("p_partkey", F.round("q", 10).alias("q"))


@query("sta24_log_scale_area", """
with c as (select l_returnflag, x, round(avg(l_discount * x / (x + l_quantity)), 8) as y from lineitem, unnest([1, 4, 8, 16, 32]) as u(x) group by all), s as (select l_returnflag, ln(x) as lx, y, lead(ln(x)) over w as nx, lead(y) over w as ny from c window w as (partition by l_returnflag order by x))
select l_returnflag, round(sum((y + ny) / 2 * (nx - lx)) / (max(lx) - min(lx)), 8) as area from s group by all
""")
def _(spark, d):
    x = F.explode(F.array(*map(F.lit, (1, 4, 8, 16, 32)))).alias("x")
    c = table(spark, d, "lineitem").select("l_returnflag", "l_discount", "l_quantity", x).groupBy("l_returnflag", "x").agg(F.round(F.avg(F.col("l_discount") * F.col("x") / (F.col("x") + F.col("l_quantity"))), 8).alias("y"))
    return st.log_area(c, "l_returnflag", "x", "y").select("l_returnflag", F.round("area", 8).alias("area"))


_W = "(select draw, c, (u >= 0.367879)::int + (u >= 0.735759)::int + (u >= 0.919699)::int + (u >= 0.981012)::int + (u >= 0.99634)::int + (u >= 0.999406)::int as w from (select draw, c, ('0x' || substr(md5('0:' || draw::varchar || ':' || c::varchar), 1, 8))::ubigint::double / 4294967296.0::double as u from (select distinct user_id as c from events), range(0, 50) r(draw)))"


@query("sta27_cluster_bootstrap_correlation", f"""
with s as (select user_id as c, count(*) as n, sum(z) as sz, sum(z * z) as szz, sum(y) as sy, sum(y * y) as syy, sum(z * y) as szy from (select user_id, value as z, (event_id * 7919 % 101)::double as y from events) group by all),
b as (select draw, sum(w * n) as n, sum(w * sz) as sz, sum(w * szz) as szz, sum(w * sy) as sy, sum(w * syy) as syy, sum(w * szy) as szy from s join {_W} using (c) group by draw)
select draw, round((szy - sz * sy / n) / sqrt((szz - sz * sz / n) * (syy - sy * sy / n)), 8) as r from b
""")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("value").alias("z"), (F.col("event_id") * 7919 % 101).cast("double").alias("y"))
    w = st.draws(spark, e, "user_id", 50)
    return st.bootstrap_correlation(e, "user_id", "z", "y", w).select(F.col("draw").cast("long").alias("draw"), F.round("r", 8).alias("r"))


@query("sta29_record_weighted_mean", f"select draw, round(sum(w * s) / sum(w * n), 8) as mean from (select user_id as c, sum(value) as s, count(*) as n from events group by all) join {_W} using (c) group by draw")
def _(spark, d):
    e = table(spark, d, "events")
    return st.bootstrap_mean(e, "user_id", "value", st.draws(spark, e, "user_id", 50)).select(F.col("draw").cast("long").alias("draw"), F.round("mean", 8).alias("mean"))


@query("sta30_cluster_mean_bootstrap", f"select draw, round(sum(w * m) / sum(w), 8) as mean from (select user_id as c, avg(value) as m from events group by all) join {_W} using (c) group by draw")
def _(spark, d):
    e = table(spark, d, "events")
    return st.bootstrap_mean(e, "user_id", "value", st.draws(spark, e, "user_id", 50), by_record=False).select(F.col("draw").cast("long").alias("draw"), F.round("mean", 8).alias("mean"))


@query("sta26_percentile_interval", f"""
with b as (select draw, sum(w * s) / sum(w * n) - 50 as mean from (select user_id as c, sum(value) as s, count(*) as n from events group by all) join {_W} using (c) group by draw)
select round(avg(mean), 8) as mean, round(quantile_cont(mean, 0.025), 8) as low, round(quantile_cont(mean, 0.975), 8) as high, round((sum((mean <= 0)::int) + 1) / (count(*) + 1)::double, 8) as p_greater, round(least(1, 2 * (least(sum((mean <= 0)::int), sum((mean >= 0)::int)) + 1) / (count(*) + 1)::double), 8) as p_two from b
""")
def _(spark, d):
    e = table(spark, d, "events")
    b = st.bootstrap_mean(e, "user_id", "value", st.draws(spark, e, "user_id", 50)).select((F.col("mean") - 50).alias("v"))
    return st.interval(b, [], "v").select(*[F.round(c, 8).alias(c) for c in ("mean", "low", "high", "p_greater", "p_two")])


@query("sta31_crossed_bootstrap", """
with v as (select l_returnflag as a, l_linestatus as b, avg(l_discount) as m from lineitem group by all), wa as (select a, draw, 1 + (hash_a % 3) as w from (select distinct l_returnflag as a, draw, ('0x' || substr(md5(l_returnflag || draw::varchar), 1, 8))::ubigint as hash_a from lineitem, range(0, 20) r(draw))),
wb as (select b, draw, 1 + (hash_b % 3) as w from (select distinct l_linestatus as b, draw, ('0x' || substr(md5(l_linestatus || draw::varchar), 1, 8))::ubigint as hash_b from lineitem, range(0, 20) r(draw)))
select draw, round(sum(wa.w * wb.w * m)::double / sum(wa.w * wb.w)::double, 8) as mean from v join wa using (a) join wb using (b, draw) group by draw
""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    v = li.groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.avg("l_discount").alias("m"))
    n = spark.range(20).withColumnRenamed("id", "draw")
    factor = lambda c: v.select(c).distinct().crossJoin(F.broadcast(n)).withColumn(f"w_{c}", 1 + F.conv(F.substring(F.md5(F.concat(c, F.col("draw").cast("string"))), 1, 8), 16, 10).cast("long") % 3)
    w = F.col("w_a") * F.col("w_b")
    return v.join(factor("a"), "a").join(factor("b"), ["b", "draw"]).groupBy("draw").agg(F.round(F.sum(w * F.col("m")) / F.sum(w), 8).alias("mean"))


@query("sta39_coupling_slope", """
select l_returnflag, round(b, 9) as slope, round((sy - b * sx) / n, 8) as intercept, round(sqrt((vy - b * cxy) / (n - 2) / vx), 9) as se from (select l_returnflag, n, sx, sy, vx, vy, cxy, cxy / vx as b from (select l_returnflag, count(*) as n, sum(l_quantity) as sx, sum(l_discount) as sy, var_pop(l_quantity) * count(*) as vx, var_pop(l_discount) * count(*) as vy, covar_pop(l_quantity, l_discount) * count(*) as cxy from lineitem group by all))
""")
def _(spark, d):
    s = st.slope(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_discount")
    return s.select("l_returnflag", F.round("slope", 9).alias("slope"), F.round("intercept", 8).alias("intercept"), F.round("se", 9).alias("se"))


@query("sta40_inference_table", """
with m as (select user_id, event_type, avg(value) as v from events group by all), p as (select event_type, count(*) as n, avg(v) as mean, (sum((v <= 50)::int) + 1) / (count(*) + 1)::double as p from m group by all), k as (select *, row_number() over (order by p, event_type) as i, count(*) over () as t from p)
select event_type, n, round(mean, 8) as mean, round(p, 8) as p, round(least(1, min(p * t / i) over (order by i desc rows unbounded preceding)), 8) as q from k
""")
def _(spark, d):
    m = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    p = m.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), ((F.count_if(F.col("v") <= 50) + 1) / (F.count("*") + 1)).alias("p")).withColumn("panel", F.lit(0))
    return st.adjust(p, "panel", "p", "event_type").select("event_type", "n", *[F.round(c, 8).alias(c) for c in ("mean", "p", "q")])


@query("sta43_directionless_auroc", """
with k as (select user_id % 10 as g, (event_type = 'view')::int as y, rank() over (partition by user_id % 10 order by value) + (count(*) over (partition by user_id % 10, value) - 1) / 2.0::double as r from events), a as (select g, (sum(r * y) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * (count(*) - sum(y)))::double as a from k group by g) select g, round(greatest(a, 1 - a), 8) as auroc from a
""")
def _(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("g"), "value", (F.col("event_type") == "view").cast("int").alias("y"))
    return st.auroc(e, "g", "value", "y").select("g", F.round(F.greatest(F.col("auroc"), 1 - F.col("auroc")), 8).alias("auroc"))


# Windows


@query("win01_first_argmax", "select l_orderkey, l_linenumber from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by abs(l_discount - 0.05) desc, l_linenumber, l_partkey) as i from lineitem) where i = 1")
def _(spark, d):
    v = table(spark, d, "lineitem").withColumn("v", F.col("l_discount") - 0.05)
    return rel.top_per_key(v, "l_orderkey", [F.abs("v").desc(), F.col("l_linenumber"), F.col("l_partkey")]).select("l_orderkey", "l_linenumber")


@query("win02_stable_ranking", "select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by abs(c_acctbal) desc, c_custkey) as place from customer")
def _(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.abs("c_acctbal").desc(), "c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("win03_reverse_ties", "select p_brand, p_partkey, row_number() over (partition by p_brand order by p_size desc, p_partkey desc) as place from part")
def _(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.col("p_size").desc(), F.col("p_partkey").desc())
    return table(spark, d, "part").select("p_brand", "p_partkey", F.row_number().over(w).cast("long").alias("place"))


@query("win04_mid_ranks", "select distinct l_returnflag, l_quantity, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0::double as mid_rank from lineitem")
def _(spark, d):
    return st.mid_ranks(table(spark, d, "lineitem"), "l_returnflag", "l_quantity").select("l_returnflag", "l_quantity", F.col("mid_rank").cast("double").alias("mid_rank"))


@query("win05_peak_and_gap", """
with m as (select p_brand, p_size, avg(p_retailprice) as v from part group by all), r as (select p_brand, p_size, v, row_number() over w as i, lead(v) over w as second from m window w as (partition by p_brand order by v desc, p_size)) select p_brand, p_size, round(v, 6) as peak, round(second, 6) as second, round(v - second, 6) as gap from r where i = 1
""")
def _(spark, d):
    m = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.avg("p_retailprice").alias("v"))
    return st.peak_and_gap(m, "p_brand", "p_size", "v").select("p_brand", "p_size", *[F.round(c, 6).alias(c) for c in ("peak", "second", "gap")])


@query("win08_keep_last", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as i from orders) where i = 1")
def _(spark, d):
    return rel.top_per_key(table(spark, d, "orders"), "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")


@query("win09_rank_probabilities", f"""
with v as (select draw, event_type, sum(w * s) / sum(w * n) as m from (select user_id as c, event_type, sum(value) as s, count(*) as n from events group by all) join {_W} using (c) group by all), r as (select draw, event_type, row_number() over (partition by draw order by m desc, event_type) as k from v)
select event_type, round(avg((k = 1)::int), 8) as first, round(avg((k <= 2)::int), 8) as top2, round(avg(k), 8) as mean_rank, quantile_cont(k, 0.5) as median_rank from r group by event_type
""")
def _(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy("user_id", "event_type").agg(F.sum("value").alias("s"), F.count("*").alias("n")).join(st.draws(spark, e, "user_id", 50), "user_id")
    v = s.groupBy("draw", "event_type").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    r = v.withColumn("k", F.row_number().over(Window.partitionBy("draw").orderBy(F.col("m").desc(), "event_type")))
    return r.groupBy("event_type").agg(F.round(F.avg((F.col("k") == 1).cast("int")), 8).alias("first"), F.round(F.avg((F.col("k") <= 2).cast("int")), 8).alias("top2"), F.round(F.avg("k"), 8).alias("mean_rank"), F.percentile("k", F.lit(0.5)).alias("median_rank"))


@query("win10_directed_rank", "select metric, l_suppkey, row_number() over (partition by metric order by case when metric = 'discount' then -v else v end, l_suppkey) as place from (select 'discount' as metric, l_suppkey, round(avg(l_discount), 8) as v from lineitem group by all union all select 'tax', l_suppkey, round(avg(l_tax), 8) from lineitem group by all)")
def _(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(st.rounded_mean("l_discount", 8).alias("discount"), st.rounded_mean("l_tax", 8).alias("tax")).unpivot("l_suppkey", ["discount", "tax"], "metric", "v")
    return st.directed_rank(m, "metric", "v", F.col("metric") == "discount", "l_suppkey").select("metric", "l_suppkey", "place")


@query("win13_successive_differences", "select event_id, epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts) as gap_us from events")
def _(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return st.successive_differences(table(spark, d, "events"), "user_id", ["ts", "event_id"], us, "gap_us").select("event_id", "gap_us")


@query("win15_cumulative_weight", "select g, s, sum(n) over (partition by g order by s)::bigint as below from (select user_id % 3 as g, floor(value)::bigint as s, count(*) as n from events group by all)")
def _(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 3).alias("g"), F.floor("value").alias("s"))
    return st.cumulative_weight(e, "g", "s")


@query("win16_composite_top1", "select p_brand, p_partkey from (select p_brand, p_partkey, row_number() over (partition by p_brand order by (p_size > 25) desc, p_retailprice, p_partkey) as i from part) where i = 1")
def _(spark, d):
    return rel.top_per_key(table(spark, d, "part"), "p_brand", [(F.col("p_size") > 25).desc(), F.col("p_retailprice"), F.col("p_partkey")]).select("p_brand", "p_partkey")


@query("win18_union_of_tops", """
with a as (select p_partkey, p_retailprice, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as i, row_number() over (partition by p_size order by p_retailprice desc, p_partkey) as j from part) select p_partkey from a where i <= 3 or j <= 2
""")
def _(spark, d):
    p, o = table(spark, d, "part"), [F.col("p_retailprice").desc(), F.col("p_partkey")]
    return rel.top_per_key(p, "p_brand", o, 3).select("p_partkey").unionByName(rel.top_per_key(p, "p_size", o, 2).select("p_partkey")).distinct()


@query("win20_round_robin_union", """
with r as (select 0 as member, l_partkey, row_number() over (order by sum(l_quantity) desc, l_partkey) as place from lineitem group by l_partkey union all select 1, l_partkey, row_number() over (order by count(*) desc, l_partkey) from lineitem group by l_partkey), f as (select l_partkey, min(place * 2 + member) as k from r where place <= 50 group by l_partkey)
select l_partkey, row_number() over (order by k) as place from f
""")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    return st.round_robin([(s, "q"), (s, "n")], "l_partkey", 50)


@query("win22_monotonic_dose", "select o_custkey, coalesce(bool_and(step >= -0.000001), true) as monotonic from (select o_custkey, o_totalprice - lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as step from orders) group by all")
def _(spark, d):
    return st.monotonic(table(spark, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


@query("win23_source_precedence", "select p_brand, p_partkey from (select p_brand, p_partkey, row_number() over (partition by p_brand order by case split_part(p_type, ' ', 1) when 'PROMO' then 0 when 'ECONOMY' then 1 else 2 end, p_partkey) as i from part) where i = 1")
def _(spark, d):
    kind = F.substring_index("p_type", " ", 1)
    rank = F.when(kind == "PROMO", 0).when(kind == "ECONOMY", 1).otherwise(2)
    return rel.top_per_key(table(spark, d, "part"), "p_brand", [rank, F.col("p_partkey")]).select("p_brand", "p_partkey")
