"""Vectors, signals, models, audits and streams over the driver's tables."""

import numpy as np
from pyspark.sql import functions as F

from .. import streaming
from ..operators import audit, models
from ..operators import relational as rel
from ..operators import vectors as v
from . import query, table

def _e():
    return F.col("embedding").cast("array<double>")


def _wave(spark, d):
    """Events of each user in order, as a signal."""
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    return table(spark, d, "events").groupBy("user_id").agg(F.transform(steps, lambda s: s["value"]).alias("signal"))


_WAVE = "(select user_id, list(value order by ts, event_id) as signal from events group by all)"


@query("vec01_train_z_score", """
with l as (select vec_id, (generate_subscripts(embedding, 1) - 1)::int as feature, unnest(embedding)::double as x from embeddings), s as (select feature, avg(x) as m, stddev_pop(x) as sd from l where vec_id % 10 < 7 group by all)
select vec_id, feature, round((x - m) / case when sd > 1e-8 then sd else 1 end, 8) as z from l join s using (feature)
""")
def _(spark, d):
    long = table(spark, d, "embeddings").select("vec_id", F.posexplode(_e()).alias("feature", "x"))
    s = long.where("vec_id % 10 < 7").groupBy("feature").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return long.join(F.broadcast(s), "feature").select("vec_id", "feature", F.round((F.col("x") - F.col("m")) / F.when(F.col("sd") > 1e-8, F.col("sd")).otherwise(1.0), 8).alias("z"))


@query("vec02_readout", "select vec_id, round(list_dot_product(embedding::double[], list_transform(range(1, 65), lambda i: 1.0 / i)::double[]), 8) as score from embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(v.dot(_e(), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: 1.0 / i)), 8).alias("score"))


@query("vec03_norms", "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 8) as norm from embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(v.norm(_e()), 8).alias("norm"))


@query("vec04_cosine", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 8) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", _e().alias("a"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id").select("vec_id", F.round(v.cosine("a", "b"), 8).alias("cosine"))


@query("vec05_reconstruction_r2", """
with l as (select label, (generate_subscripts(embedding, 1) - 1)::int as f, unnest(embedding)::double as x from embeddings), c as (select label, f, avg(x) as m from l group by all), t as (select f, avg(x) as m from l group by all)
select round(1 - sum((l.x - c.m) ** 2) / sum((l.x - t.m) ** 2), 8) as r2 from l join c using (label, f) join t using (f)
""")
def _(spark, d):
    from ..operators.statistics import between_classes

    return between_classes(table(spark, d, "embeddings"), "embedding", "label").select(F.round("r2", 8).alias("r2"))


@query("vec06_gram_matrix", """
with l as (select vec_id, (generate_subscripts(embedding, 1) - 1)::int as f, unnest(embedding)::double as x from embeddings) select a.f as i, b.f as j, round(sum(a.x * b.x), 6) as g from l a join l b using (vec_id) group by all
""")
def _(spark, d):
    m = v.moments(table(spark, d, "embeddings"), "embedding")
    return spark.createDataFrame([(i, j, round(float(x), 6)) for (i, j), x in np.ndenumerate(m.gram)], "i int, j int, g double")


@query("vec14_norm_matched", """
select a.vec_id, round(list_dot_product(list_transform(a.embedding, lambda x: x::double), [1.0::double for i in range(0, 64)]) * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[])), 7) as total from embeddings a join embeddings b on b.vec_id = a.vec_id + 1
""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", _e().alias("a"))
    j = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return j.select("vec_id", F.round(v.total(v.norm_matched("a", "b", "b")), 7).alias("total"))


@query("top04_row_top_k", "with l as (select vec_id, (generate_subscripts(embedding, 1) - 1)::int as f, unnest(embedding)::double as x from embeddings) select vec_id, f, x from (select *, row_number() over (partition by vec_id order by x desc, f) as i from l where x > 0) where i <= 5")
def _(spark, d):
    k = table(spark, d, "embeddings").select("vec_id", F.posexplode(v.top_k(_e(), 5)).alias("f", "x"))
    return k.where("x <> 0")


@query("top05_batch_top_k", "with l as (select vec_id // 50 as batch, vec_id, (generate_subscripts(embedding, 1) - 1)::int as f, unnest(embedding)::double as x from embeddings) select batch, vec_id, f, x from (select *, row_number() over (partition by batch order by x desc, vec_id, f) as i from l) where i <= 200")
def _(spark, d):
    long = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("batch"), "vec_id", F.posexplode(_e()).alias("f", "x"))
    return rel.top_per_key(long, "batch", [F.col("x").desc(), F.col("vec_id"), F.col("f")], 200)


@query("top06_top_k_by_size", "with l as (select vec_id, (generate_subscripts(embedding, 1) - 1)::int as f, unnest(embedding)::double as x from embeddings) select vec_id, f, x from (select *, row_number() over (partition by vec_id order by abs(x) desc, f) as i from l) where i <= 4")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(v.top_k(_e(), 4, by_size=True)).alias("f", "x")).where("x <> 0")


@query("sig02_limb_leads", f"select user_id, round(list_sum(list_transform(signal, lambda x: x / 2 - x)), 4) as iii, round(list_sum(list_transform(signal, lambda x: -(x + x / 2) / 2)), 4) as avr, round(list_sum(list_transform(signal, lambda x: x - x / 4)), 4) as avl from {_WAVE}")
def _(spark, d):
    w = _wave(spark, d)
    leads = v.limb_leads("signal", F.transform("signal", lambda x: x / 2))
    return w.select("user_id", F.round(v.total(leads["III"]), 4).alias("iii"), F.round(v.total(leads["aVR"]), 4).alias("avr"), F.round(v.total(leads["aVL"]), 4).alias("avl"))


@query("sig03_z_scored_signal", f"select user_id, i::int as i, round((signal[i + 1] - m) / greatest(sd, 1e-6), 6) as z from (select user_id, signal, list_avg(signal) as m, list_stddev_pop(signal) as sd, unnest(range(0, len(signal))) as i from {_WAVE})")
def _(spark, d):
    return _wave(spark, d).select("user_id", F.posexplode(v.z_scored("signal")).alias("i", "z")).withColumn("z", F.round("z", 6))


@query("sig05_centre_crop", f"select user_id, round(list_sum(case when len(signal) > 20 then signal[(len(signal) - 20) // 2 + 1 : (len(signal) - 20) // 2 + 20] else signal end), 6) as total from {_WAVE}")
def _(spark, d):
    return _wave(spark, d).select("user_id", F.round(v.total(v.centre_crop("signal", 20)), 6).alias("total"))


@query("sig04_fft_resample", f"""
with w as (select user_id, signal, len(signal) as n from {_WAVE} where len(signal) > 0), x as (select user_id, n, generate_subscripts(signal, 1) - 1 as t, unnest(signal)::double as x from w),
f as (select user_id, n, k, sum(x * cos(2 * pi() * k * t / n)) as c, -sum(x * sin(2 * pi() * k * t / n)) as s from x, range(0, 17) r(k) where k <= least(n, 32) // 2 group by all),
g as (select *, case when k = 0 then 1 when 2 * k = least(n, 32) then case when n = 32 then 1 when n > 32 then 2 else 1 end else 2 end as wt from f),
y as (select user_id, i, sum(wt * (c * cos(2 * pi() * k * i / 32) - case when 2 * k = 32 then 0 else s end * sin(2 * pi() * k * i / 32))) / any_value(n) as y from g, range(0, 32) r(i) group by all)
select user_id, i::int as i, round(y, 6) as y from y
""")
def _(spark, d):
    return v.resample(_wave(spark, d), "signal", 32).select("user_id", F.posexplode("signal").alias("i", "y")).select("user_id", "i", F.round("y", 6).alias("y"))


@query("mod20_direction_erasure", """
with e as (select vec_id, embedding::double[] as x from embeddings), u as (select list_transform(range(0, 64), lambda i: 0.125::double)::double[] as u) select vec_id, abs(round(list_dot_product(x, u) - list_dot_product(x, u) * list_dot_product(u, u), 8)) as left_over, round(list_dot_product(x, x) - list_dot_product(x, u) ** 2, 7) as energy from e, u
""")
def _(spark, d):
    u = F.array_repeat(F.lit(0.125), 64)
    e = table(spark, d, "embeddings").select("vec_id", v.without_direction(_e(), u).alias("x"))
    return e.select("vec_id", F.abs(F.round(v.dot("x", u), 8)).alias("left_over"), F.round(v.dot("x", "x"), 7).alias("energy"))


@query("mod23_centroid_shift", """
with l as (select vec_id, label, (generate_subscripts(embedding, 1) - 1)::int as f, unnest(embedding)::double as x from embeddings), q as (select quantile_cont(x, 0.75) as t from l where f = 0), h as (select vec_id from l, q where f = 0 and x >= t)
select f, round(avg(x) filter (vec_id in (select vec_id from h)) - avg(x), 8) as shift from l group by f
""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(_e().alias("x"), _e()[0].alias("x0"))
    q = e.agg(F.percentile("x0", F.lit(0.75)).alias("t"))
    long = e.crossJoin(F.broadcast(q)).select((F.col("x0") >= F.col("t")).alias("high"), F.posexplode("x").alias("f", "x"))
    return long.groupBy("f").agg(F.round(F.avg(F.when(F.col("high"), F.col("x"))) - F.avg("x"), 8).alias("shift"))


@query("mod24_common_effect", """
with e as (select user_id, event_type, round(abs(avg(value) - 50), 8) as effect from events group by all), m as (select user_id, min(effect) as low, count(*) as n from e group by all)
select user_id, least(20.0, low)::double as common, case when n < 5 then 'incomplete' when least(20.0, low) >= 2 then 'eligible' else 'below_floor' end as status from m
""")
def _(spark, d):
    from ..operators.statistics import common_effect

    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.abs(F.avg("value") - 50), 8).alias("effect"))
    return common_effect(e, "user_id", "effect", 5, 20.0, 2.0)


@query("mod25_record_metrics", """
select l_orderkey, max(case when l_linenumber = 1 then d end) as target, round(sqrt(avg(case when l_linenumber > 1 then d * d end)), 8) as cross_rms, round(max(abs(d)), 8) as top, round(sqrt(sum(d * d)), 8) as l2 from (select l_orderkey, l_linenumber, min(l_discount - 0.05) as d from lineitem group by all) group by all
""")
def _(spark, d):
    from ..operators.statistics import record_metrics

    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_discount") - 0.05).alias("d"))
    return record_metrics(li, "l_orderkey", "d", F.col("l_linenumber") == 1).select("l_orderkey", "target", *[F.round(c, 8).alias(c) for c in ("cross_rms", "top", "l2")])


@query("mod36_tier_flags", "select c_custkey, c_acctbal > 0 as tier0, c_acctbal > 2500 as tier1, c_acctbal > 5000 as tier2, (c_acctbal > 0)::int + (c_acctbal > 2500)::int + (c_acctbal > 5000)::int as tiers from customer")
def _(spark, d):
    from ..operators.statistics import tier_flags

    return tier_flags(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", (0, 2500, 5000)).drop("c_acctbal")


@query("mod08_closure_ratio", "select event_type, round(case when abs(m - 45) >= 0.5 then (a - 45) / (m - 45) end, 8) as closure from (select event_type, avg(value) as m, avg(value) filter (user_id % 2 = 0) as a from events group by all)")
def _(spark, d):
    from ..operators.statistics import closure

    return closure(table(spark, d, "events"), "event_type", "value", F.col("user_id") % 2 == 0, 45).select("event_type", F.round("closure", 8).alias("closure"))


@query("mod45_dose_sweep", "select l_suppkey, dose, round(dose * avg(l_discount - 0.05) + 1, 9) as effect from lineitem, unnest([0.25, 0.5, 1.0, 2.0]::double[]) as u(dose) group by l_suppkey, dose")
def _(spark, d):
    from ..operators.statistics import dose_sweep

    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_discount") - 0.05).alias("e"))
    return dose_sweep(li, "l_suppkey", "e", (0.25, 0.5, 1.0, 2.0), 1.0).withColumn("effect", F.round("effect", 9))


@query("mod01_ridge")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("y", (F.col("label") == 3).cast("double"))
    fit = models.fit_ridge(e.where("vec_id % 10 < 7"), e.where("vec_id % 10 = 7"), "embedding", ["y"])
    _, w, b = fit["y"]
    return models.predict(e.where("vec_id % 10 > 7"), "embedding", w, b, "score").select("vec_id", "y", "score")


@query("mod15_principal_components")
def _(spark, d):
    rows, values = models.principal_directions(v.moments(table(spark, d, "embeddings"), "embedding"), 5)
    return spark.createDataFrame([(i, float(x), [float(c) for c in r]) for i, (x, r) in enumerate(zip(values, rows))], "component int, variance double, direction array<double>")


@query("mod19_concept_erasure")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("z", (F.col("label") == 3).cast("double"))
    return models.Eraser(v.moments(e, "embedding", ["z"]), 64).apply(e, "embedding", "erased").select("vec_id", "z", "erased")


@query("mod32_covariance_transport")
def _(spark, d):
    e = table(spark, d, "embeddings")
    m, shift = models.transport(v.moments(e.where("label < 5"), "embedding"), v.moments(e.where("label >= 5"), "embedding"))
    return spark.createDataFrame([(i, [float(x) for x in row], float(s)) for i, (row, s) in enumerate(zip(m, shift))], "i int, row array<double>, shift double")


@query("mod32_diagonal_transport", "with l as (select label < 5 as s, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), m as (select i, avg(x) filter (s) as a, avg(x) filter (not s) as b, stddev_pop(x) filter (s) as sa, stddev_pop(x) filter (not s) as sb from l group by i) select (i - 1)::int as i, round(sb / sa, 8) as scale, round(b - sb / sa * a, 8) as shift from m")
def _(spark, d):
    e = table(spark, d, "embeddings")
    m, shift = models.transport(v.moments(e.where("label < 5"), "embedding"), v.moments(e.where("label >= 5"), "embedding"), diagonal=True)
    return spark.createDataFrame([(i, round(float(m[i, i]), 8), round(float(s), 8)) for i, s in enumerate(shift)], "i int, scale double, shift double")


@query("mod33_direction_controls")
def _(spark, d):
    """How far apart the classes' means lie along the difference of means, the first principal direction and a random one."""
    e = table(spark, d, "embeddings").select("label", "embedding")
    u = models.class_direction(e, "embedding", F.col("label") == 0)
    of = {"class": u, **models.control_directions(v.moments(e, "embedding"), u, 1)}
    c = [F.avg(F.when(F.col("label") == 0, v.dot(_e(), models.weights_column(x)))) - F.avg(F.when(F.col("label") != 0, v.dot(_e(), models.weights_column(x)))) for x in of.values()]
    return e.agg(*[x.alias(k) for k, x in zip(of, c)])


@query("mod33_class_direction", """
with l as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings), u as (select i, d / sqrt(sum(d * d) over ()) as u from (select i, avg(x) filter (label = 0) - avg(x) filter (label <> 0) as d from l group by i))
select vec_id, label, round(sum(x * u), 9) as projection from l join u using (i) group by vec_id, label
""")
def _(spark, d):
    u = models.class_direction(table(spark, d, "embeddings"), "embedding", F.col("label") == 0)
    return table(spark, d, "embeddings").select("vec_id", "label", F.round(v.dot(_e(), models.weights_column(u)), 9).alias("projection"))


@query("vec12_linear_cka", """
with l as (select vec_id, generate_subscripts(embedding, 1) as f, unnest(embedding)::double as x from embeddings), c as (select a.f as i, b.f as j, covar_pop(a.x, b.x) as c from l a join l b using (vec_id) group by all)
select round(sum(c * c) filter (i <= 32 and j > 32) / sqrt(sum(c * c) filter (i <= 32 and j <= 32) * sum(c * c) filter (i > 32 and j > 32)), 9) as cka from c
""")
def _(spark, d):
    return spark.createDataFrame([(round(models.linear_cka(v.moments(table(spark, d, "embeddings"), "embedding"), 32), 9),)], "cka double")


# Audits


@query("aud03_grid_constants", "select l_returnflag, attribute, n from (select l_returnflag, count(distinct l_linestatus) as l_linestatus, count(distinct l_suppkey) as l_suppkey from lineitem group by all) unpivot (n for attribute in (l_linestatus, l_suppkey)) where n > 1")
def _(spark, d):
    return audit.not_constant(table(spark, d, "lineitem"), "l_returnflag", ["l_linestatus", "l_suppkey"])


@query("aud05_cell_reasons", "select o_orderkey, array_to_string(list_filter([case when o_totalprice > 400000 then 'price' end, case when o_orderstatus = 'P' then 'pending' end], lambda x: x is not null), '|') as reasons from orders where o_totalprice > 400000 or o_orderstatus = 'P'")
def _(spark, d):
    r = audit.reasons(table(spark, d, "orders"), "o_orderkey", {"price": F.col("o_totalprice") > 400000, "pending": F.col("o_orderstatus") == "P"})
    return r.select("o_orderkey", F.array_join("reasons", "|").alias("reasons"))


@query("aud08_reproduction", "select 'v' as value, max(abs(a.m - b.m)) as worst from (select l_suppkey, round(avg(l_discount), 6) as m from lineitem group by all) a join (select l_suppkey, round(avg(l_tax), 6) as m from lineitem group by all) b using (l_suppkey) having max(abs(a.m - b.m)) > 0.0001")
def _(spark, d):
    li = table(spark, d, "lineitem")
    side = lambda c: li.groupBy("l_suppkey").agg(F.round(F.avg(c), 6).alias("v"))
    return audit.differing(side("l_discount"), side("l_tax"), "l_suppkey", ["v"], 1e-4)


@query("aud02_gate_counts", "select count(*) as n, sum((o_totalprice > 50000)::int)::bigint as price, sum((o_orderstatus <> 'P')::int)::bigint as settled, sum((o_totalprice > 50000 and o_orderstatus <> 'P')::int)::bigint as all_pass from orders")
def _(spark, d):
    return audit.gates(table(spark, d, "orders"), {"price": F.col("o_totalprice") > 50000, "settled": F.col("o_orderstatus") != "P"})


@query("aud12_not_finite", "select 'y' as \"column\", count(*) as n from orders where o_orderkey % 9 = 0")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_totalprice").alias("x"), F.when(F.col("o_orderkey") % 9 == 0, float("nan")).otherwise(1.0).alias("y"))
    return audit.not_finite(o, ["x", "y"])


# Streams


@query("str01_running_statistics", "select user_id, count(value) as n, round(sum(value), 4) as s, round(sum(value * value), 3) as q from events group by all")
def _(spark, d):
    s = streaming.running_statistics(table(spark, d, "events"), "user_id", "value")
    return s.select("user_id", "n", F.round("s", 4).alias("s"), F.round("q", 3).alias("q"))


@query("str02_windowed_statistics", "select strftime(time_bucket(interval 1 hour, ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(avg(value), 8) as mean, max(value) as top from events group by all")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = streaming.windowed_statistics(e, "ts", "value", "1 hour", "2 hours", "event_type")
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("mean", 8).alias("mean"), "top")
