"""More inference, joins and audits over the driver's tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators import statistics as st
from . import query, table


@query("join16_map_enrichment", "select s_suppkey, case s_nationkey % 3 when 0 then 'north' when 1 then 'south' else 'other' end as area from supplier")
def _(spark, d):
    area = F.create_map(*map(F.lit, (0, "north", 1, "south")))
    return table(spark, d, "supplier").select("s_suppkey", F.coalesce(F.element_at(area, F.col("s_nationkey") % 3), F.lit("other")).alias("area"))


@query("join20_nearest_pool", """
with s as (select l_suppkey, count(*) as f, round(avg(l_quantity), 6) as m from lineitem group by all), p as (select a.l_suppkey as target, b.l_suppkey as other, row_number() over (partition by a.l_suppkey order by round(abs(ln(a.f) - ln(b.f)) + abs(ln(a.m) - ln(b.m)), 9), b.l_suppkey) as i from s a join s b on a.l_suppkey <> b.l_suppkey where a.l_suppkey % 10 = 0 and b.l_suppkey % 10 <> 0)
select target, other, i as place from p where i <= 5
""")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("f"), F.round(F.avg("l_quantity"), 6).alias("m"))
    s = s.select("l_suppkey", F.ln("f").alias("f"), F.ln("m").alias("m"))
    a = s.where("l_suppkey % 10 = 0").withColumnRenamed("l_suppkey", "target")
    b = s.where("l_suppkey % 10 <> 0").withColumnRenamed("l_suppkey", "other")
    return rel.nearest_in_plane(a, b, "target", "other", ["f", "m"], 5).select("target", "other", F.col("place").cast("long").alias("place"))


@query("join23_positional", "select a.c_custkey, b.s_suppkey from (select c_custkey, row_number() over (order by c_custkey) as i from customer) a join (select s_suppkey, row_number() over (order by s_suppkey) as i from supplier) b using (i)")
def _(spark, d):
    return rel.positional(table(spark, d, "customer").select("c_custkey"), table(spark, d, "supplier").select("s_suppkey"), "c_custkey", "s_suppkey")


@query("join24_constant_table", "select n.n_name, e.expected, count(c_custkey) as n from (values (0, 5), (1, 7), (2, 9)) e(k, expected) join nation n on n.n_nationkey = e.k left join customer on c_nationkey = n.n_nationkey group by all")
def _(spark, d):
    e = spark.createDataFrame([(0, 5), (1, 7), (2, 9)], "n_nationkey int, expected int")
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "nation").join(F.broadcast(e), "n_nationkey").join(n, "n_nationkey", "left").select("n_name", "expected", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg09_strict_counts", "select l_suppkey, sum((l_tax > 0.04)::int)::bigint as above, round(sum((l_tax > 0.04)::int) / count(*)::double, 10) as share, max(l_tax) as top from lineitem group by all")
def _(spark, d):
    above = F.count_if(F.col("l_tax") > 0.04)
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(above.alias("above"), F.round(above / F.count("*"), 10).alias("share"), F.max("l_tax").alias("top"))


@query("agg18_max_damage", "select l_returnflag, l_linestatus, max(case when l_quantity <> 50 then l_quantity end) as damage from lineitem group by all")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.max(F.when(F.col("l_quantity") != 50, F.col("l_quantity"))).alias("damage"))


@query("agg20_eligible_seed_mean", "select user_id, count(v) as seeds, round(avg(v), 8) as mean from (select user_id, event_type, case when count(*) >= 10 then avg(value) end as v from events group by all) group by all")
def _(spark, d):
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.when(F.count("*") >= 10, F.avg("value")).alias("v"))
    return s.groupBy("user_id").agg(F.count("v").alias("seeds"), F.round(F.avg("v"), 8).alias("mean"))


@query("agg22_correlation_long", "select 'l_discount' as a, 'l_quantity' as b, round(corr(l_discount, l_quantity), 8) as r from lineitem union all select 'l_discount', 'l_tax', round(corr(l_discount, l_tax), 8) from lineitem union all select 'l_quantity', 'l_tax', round(corr(l_quantity, l_tax), 8) from lineitem")
def _(spark, d):
    names = ["l_discount", "l_quantity", "l_tax"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    # All pairs from one pass over the sums.
    agg = [e for a in names for e in (F.sum(a).alias(f"s_{a}"), F.sum(F.col(a) * F.col(a)).alias(f"q_{a}"))] + [F.sum(F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs]
    s = table(spark, d, "lineitem").agg(F.count("*").alias("n"), *agg)
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(st.correlation("n", f"s_{a}", f"q_{a}", f"s_{b}", f"q_{b}", f"p_{a}_{b}"), 8).alias("r")) for a, b in pairs]
    return s.select(F.inline(F.array(*rows)))


@query("agg32_finite_summary", "select user_id % 5 as g, round(avg(v), 8) as mean, quantile_cont(v, 0.5) as median, round(stddev_samp(v), 8) as sd from (select user_id, case when event_id % 13 <> 0 then value end as v from events) group by all")
def _(spark, d):
    v = F.when(F.col("event_id") % 13 != 0, F.col("value"))
    return table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("g")).agg(F.round(F.avg(v), 8).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"), F.round(F.stddev_samp(v), 8).alias("sd"))


@query("win06_best_layer", "select p_brand, p_size from (select p_brand, p_size, row_number() over (partition by p_brand order by max(p_retailprice) desc, p_size) as i from part group by p_brand, p_size) where i = 1")
def _(spark, d):
    best = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.max("p_retailprice").alias("v"))
    return rel.top_per_key(best, "p_brand", [F.col("v").desc(), F.col("p_size")]).select("p_brand", "p_size")


@query("win07_strongest_per_key", "select l_partkey, l_suppkey from (select l_partkey, l_suppkey, row_number() over (partition by l_partkey order by l_quantity desc, l_suppkey, l_orderkey) as i from lineitem) where i = 1")
def _(spark, d):
    return rel.top_per_key(table(spark, d, "lineitem"), "l_partkey", [F.col("l_quantity").desc(), F.col("l_suppkey"), F.col("l_orderkey")]).select("l_partkey", "l_suppkey")


@query("win14_trapezoid_profile", """
with c as (select user_id % 4 as g, 1 + event_id % 6 as x, round(avg(value), 8) as y from events group by all), s as (select g, ln(x) as lx, y, lead(ln(x)) over w as nx, lead(y) over w as ny from c window w as (partition by g order by x)) select g, round(sum((y + ny) / 2 * (nx - lx)) / (max(lx) - min(lx)), 8) as area from s group by all
""")
def _(spark, d):
    c = table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("g"), (1 + F.col("event_id") % 6).alias("x")).agg(F.round(F.avg("value"), 8).alias("y"))
    return st.log_area(c, "g", "x", "y").select("g", F.round("area", 8).alias("area"))


@query("win17_panel_fdr", """
with p as (select user_id % 7 as panel, user_id, (sum((value > 50)::int) + 1) / (count(*) + 1)::double as p from events group by all), k as (select *, row_number() over (partition by panel order by p, user_id) as i, count(*) over (partition by panel) as m from p)
select user_id, round(least(1, min(p * m / i) over (partition by panel order by i desc rows unbounded preceding)), 10) as q from k
""")
def _(spark, d):
    p = table(spark, d, "events").groupBy((F.col("user_id") % 7).alias("panel"), "user_id").agg(((F.count_if(F.col("value") > 50) + 1) / (F.count("*") + 1)).alias("p"))
    return st.adjust(p, "panel", "p", "user_id").select("user_id", F.round("q", 10).alias("q"))


@query("win19_best_per_family_then_top", """
with f as (select p_brand, p_type, p_partkey, p_retailprice, row_number() over (partition by p_brand, p_type order by p_retailprice desc, p_partkey) as i from part), t as (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as j, count(*) over (partition by p_brand) as n from f where i = 1) select p_brand, p_partkey from t where j <= 5 and n >= 3
""")
def _(spark, d):
    one = rel.top_per_key(table(spark, d, "part"), ["p_brand", "p_type"], [F.col("p_retailprice").desc(), F.col("p_partkey")])
    some = one.withColumn("n", F.count("*").over(Window.partitionBy("p_brand"))).where("n >= 3")
    return rel.top_per_key(some, "p_brand", [F.col("p_retailprice").desc(), F.col("p_partkey")], 5).select("p_brand", "p_partkey")


@query("sta05_plain_pearson", "select o_custkey, round(case when count(*) >= 3 and var_pop(o_totalprice) > 1e-12 and var_pop((o_orderkey % 89)::double) > 1e-12 then corr(o_totalprice, (o_orderkey % 89)::double) end, 7) as r from orders group by all")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") / 1e5).alias("z"), (F.col("o_orderkey") % 89).cast("double").alias("y"))
    return st.correlations(o, "o_custkey", "z", "y", none=None, rows=3).select("o_custkey", F.round("r", 7).alias("r"))


@query("sta21_component_association", """
with l as (select label, (generate_subscripts(embedding, 1) - 1)::int as f, unnest(embedding)::double as x from embeddings) select f, round((avg(x) filter (label = 0) - avg(x) filter (label <> 0)) / sqrt((var_pop(x) filter (label = 0) + var_pop(x) filter (label <> 0)) / 2), 8) as d from l group by f
""")
def _(spark, d):
    long = st.long_vectors(table(spark, d, "embeddings"), "label", "embedding", "x")
    hit, x = F.col("label") == 0, F.col("x")
    a, b = F.when(hit, x), F.when(~hit, x)
    return long.groupBy(F.col("feature").alias("f")).agg(F.round((F.avg(a) - F.avg(b)) / F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2), 8).alias("d"))


@query("sta44_empirical_p", """
with m as (select l_suppkey, count(distinct l_partkey) as n from lineitem group by all) select a.l_suppkey, round((sum((b.n >= a.n)::int) + 1) / (count(*) + 1)::double, 8) as p from m a join m b on b.l_suppkey <> a.l_suppkey group by a.l_suppkey
""")
def _(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("n"))
    # Counts by distinct value tell how many others reach one; nobody meets everybody.
    every = m.count()
    return st.reach(m, "n").select("l_suppkey", F.round(F.col("reach") / every, 8).alias("p"))


@query("sta46_shared_weight_contrast", """
with w as (select draw, c, (u >= 0.367879)::int + (u >= 0.735759)::int + (u >= 0.919699)::int + (u >= 0.981012)::int + (u >= 0.99634)::int + (u >= 0.999406)::int as w from (select draw, c, ('0x' || substr(md5('1:' || draw::varchar || ':' || c::varchar), 1, 8))::ubigint::double / 4294967296.0::double as u from (select distinct user_id as c from events), range(0, 30) r(draw))),
m as (select user_id as c, avg(value) filter (event_type = 'view') as a, avg(value) filter (event_type = 'click') as b from events group by all having count(*) filter (event_type = 'view') > 0 and count(*) filter (event_type = 'click') > 0)
select draw, round(sum(w * (a - b)) / sum(w), 8) as contrast from m join w using (c) where w > 0 group by draw
""")
def _(spark, d):
    e = table(spark, d, "events")
    m = e.groupBy("user_id").pivot("event_type", ["view", "click"]).agg(F.avg("value")).dropna()
    w = st.draws(spark, e, "user_id", 30, seed=1)
    return m.join(w, "user_id").groupBy(F.col("draw").cast("long").alias("draw")).agg(F.round(F.sum(F.col("w") * (F.col("view") - F.col("click"))) / F.sum("w"), 8).alias("contrast"))


@query("aud04_manifest_identity", "select count(distinct h) = 1 as same from (select l_returnflag, sha256(string_agg(k::varchar, chr(10) order by k)) as h from (select distinct l_returnflag, l_linenumber as k from lineitem) group by l_returnflag)")
def _(spark, d):
    from ..operators.relational import ordered_manifest

    k = table(spark, d, "lineitem").select("l_returnflag", "l_linenumber").distinct()
    h = ordered_manifest(k, "l_returnflag", F.col("l_linenumber").cast("string"), "l_linenumber", name="h", whole=True)
    return h.agg((F.countDistinct("h") == 1).alias("same"))


@query("aud07_paired_invariants", "select l_orderkey, count(distinct l_returnflag) = 1 and count(distinct l_linestatus) = 1 as constant from lineitem group by all")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(((F.countDistinct("l_returnflag") == 1) & (F.countDistinct("l_linestatus") == 1)).alias("constant"))


@query("aud01_leaked_tokens", "select p_partkey from part where list_has_any(list_distinct(list_filter(regexp_split_to_array(upper(p_type), '[^A-Z0-9]+'), lambda x: x <> '')), ['BRASS', 'PROMO'])")
def _(spark, d):
    from ..functions import token_set

    return table(spark, d, "part").where(F.arrays_overlap(token_set("p_type"), F.array(F.lit("BRASS"), F.lit("PROMO")))).select("p_partkey")
