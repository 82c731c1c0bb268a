"""Scans, joins, sets, aggregates and top-k over the driver's tables."""

from pyspark.sql import functions as F

from ..operators import relational as rel
from ..sources import binary
from ..sources import tables as src
from . import query, table

# Sources


@query("src02_last_per_key", "select o_custkey, arg_max(o_orderstatus, o_orderkey) as o_orderstatus, max(o_orderkey) as o_orderkey from orders group by o_custkey")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return rel.last_per_key(o, "o_custkey", "o_orderkey")


@query("src03_first_per_key", "select o_custkey, o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_custkey order by o_orderkey) as i from orders) where i = 1")
def _(spark, d):
    return rel.top_per_key(table(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("src05_id_set", "select distinct o_custkey::varchar as id from orders where o_custkey is not null")
def _(spark, d):
    return src.id_set(table(spark, d, "orders"), "o_custkey")


@query("src06_row_counts", "select (select count(*) from orders) as orders, (select count(*) from lineitem) as lineitem")
def _(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("orders")).crossJoin(table(spark, d, "lineitem").agg(F.count("*").alias("lineitem")))


@query("src08_first_filled_column", "select p_partkey, coalesce(nullif(trim(case when p_size > 25 then '  ' else p_brand end), ''), p_type) as value from part")
def _(spark, d):
    from ..functions import first_filled

    return table(spark, d, "part").select("p_partkey", first_filled(F.when(F.col("p_size") > 25, "  ").otherwise(F.col("p_brand")), "p_type").alias("value"))


@query("src11_header_calibration", r"""
select p_partkey, 'L' || (p_partkey % 12)::varchar as lead, nullif(regexp_extract(line, ' (-?[0-9.]+)\(?(-?[0-9]*)\)?/mV', 1), '')::double as gain, coalesce(nullif(regexp_extract(line, ' (-?[0-9.]+)\(?(-?[0-9]*)\)?/mV', 2), ''), '0')::int as baseline
from (select p_partkey, 'rec.mat 16+24 ' || (1000 + p_size)::varchar || case when p_partkey % 3 = 0 then '(' || (-p_size)::varchar || ')' else '' end || '/mV 16 0' as line from part)
""")
def _(spark, d):
    k = F.col("p_partkey")
    line = F.concat(F.lit("rec.mat 16+24 "), (1000 + F.col("p_size")).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("("), (-F.col("p_size")).cast("string"), F.lit(")"))).otherwise(""), F.lit("/mV 16 0"))
    gain, baseline = src.calibration(line)
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("L"), (k % 12).cast("string")).alias("lead"), gain.alias("gain"), baseline.alias("baseline"))


@query("src12_physical_units", """
select 'r' || (vec_id // 50)::varchar as record, 'L' || k::varchar as name, (row_number() over (partition by vec_id // 50, k order by vec_id) - 1)::bigint as place, round((greatest(least(floor(embedding[k + 1]::double * 1000), 2047), -2048) - (k - 3)) / (900 + 10 * k)::double, 9) as value
from embeddings, range(0, 8) t(k)
""")
def _(spark, d):
    """Records of eight leads over some 50 vectors, written with 16 or 12 bits a sample or as an array file, and read back."""
    import struct

    import numpy as np
    import pyarrow as pa

    path = src.scratch_folder(spark)

    def write(t: pa.Table) -> pa.Table:
        t, g = t.sort_by("vec_id"), t["g"][0].as_py()
        x = np.clip(np.floor(np.array(t["v"].to_pylist(), float)[:, :8] * 1000), -2048, 2047).astype(np.int64)
        array = struct.pack("<5i", 30, 8, len(x), 0, 4) + b"val\0" + x.astype("<i2").tobytes()
        file, kind, raw = ((f"r{g}.dat", "212", binary.pack_12(x.ravel())), (f"r{g}.dat", "16", x.astype("<i2").tobytes()), (f"r{g}.mat", "16+24", array), (f"r{g}.mat", "16", array))[g % 4]
        lines = [f"r{g} 8 500 {len(x)}"] + [f"{file} {kind} {900 + 10 * k}({k - 3})/mV 16 0 0 0 0 L{k}" for k in range(8)]
        binary.write(f"{path}/{file}", raw)
        binary.write(f"{path}/r{g}.hea", "\n".join(lines).encode())
        return pa.table({"g": [g]})

    e = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 50).alias("g"), F.col("embedding").alias("v"))
    e.groupBy("g").applyInArrow(write, "g long").count()
    got = binary.read_records(spark, path, samples=120)
    long = got.where("status is null").select("record", "name", "first", F.posexplode("values").alias("i", "value"))
    return long.select("record", "name", (F.col("first") + F.col("i")).alias("place"), F.round("value", 9).alias("value"))


@query("src14_manifest_page", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'O' order by o_orderkey offset 50 limit 25")
def _(spark, d):
    return rel.page(table(spark, d, "orders").where("o_orderstatus = 'O'"), "o_orderkey", 50, 25).select("o_orderkey", "o_totalprice")


@query("src17_contiguous_shards", """
with s as (select o_custkey as shard, count(*) as n from orders group by all), o as (select shard, n, (sum(n) over (order by shard) - n)::bigint as start from s)
select shard, n, start, start = lag(start + n, 1, 0::bigint) over (order by shard) as contiguous from o
""")
def _(spark, d):
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("shard")).agg(F.count("*").alias("n"))
    return src.with_contiguity(src.with_offsets(s, "shard", "n"), "shard", "start", "n")


@query("src19_shard_merge", """
with got as (select l_orderkey as id, count(*) as n from lineitem where l_linenumber = 1 or l_orderkey % 10 = 0 group by all), want as (select o_orderkey as id from orders where o_orderkey % 11 <> 0)
select id, case when n is null then 'missing' when w is null then 'extra' else 'duplicate' end as issue from (select coalesce(got.id, want.id) as id, n, want.id as w from got full join want on got.id = want.id) where n is null or w is null or n > 1
""")
def _(spark, d):
    got = table(spark, d, "lineitem").where("l_linenumber = 1 or l_orderkey % 10 = 0").select(F.col("l_orderkey").alias("id"))
    want = table(spark, d, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("id"))
    return src.merge_report(got, want, "id")


@query("src20_results_by_status", "select event_id, (props->>'$.k')::bigint as k from events where event_type = 'purchase' and props->>'$.k' is not null")
def _(spark, d):
    return src.from_documents(table(spark, d, "events").where("event_type = 'purchase'"), "props", "k long").where("k is not null").select("event_id", "k")


@query("src22_registry", "select l_orderkey, l_linenumber, r.meaning from lineitem left join (values ('R', 'returned'), ('A', 'accepted'), ('N', 'none')) r(flag, meaning) on l_returnflag = r.flag")
def _(spark, d):
    registry = spark.createDataFrame([("R", "returned"), ("A", "accepted"), ("N", "none")], "l_returnflag string, meaning string")
    return table(spark, d, "lineitem").join(F.broadcast(registry), "l_returnflag", "left").select("l_orderkey", "l_linenumber", "meaning")


@query("src26_mean_pooling", "select vec_id, d, round((embedding[d]::double + embedding[d + 16]::double + embedding[d + 32]::double + embedding[d + 48]::double) / 4, 9) as mean from embeddings, range(1, 17) r(d)")
def _(spark, d):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 16 + 1, 16))
    pooled = table(spark, d, "embeddings").select("vec_id", F.posexplode(src.mean_pool(tokens)).alias("i", "m"))
    return pooled.select("vec_id", (F.col("i") + 1).cast("long").alias("d"), F.round("m", 9).alias("mean"))


# Joins


@query("join01_one_to_one", "select s_suppkey, s_name, n from supplier left join (select l_suppkey, count(*) as n from lineitem group by all) on s_suppkey = l_suppkey")
def _(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("n"))
    return rel.join_checked(table(spark, d, "supplier").select("s_suppkey", "s_name"), n, "s_suppkey", one_to_one=True)


@query("join02_many_to_one", "select o_orderkey, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return rel.join_checked(table(spark, d, "orders"), c, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("join03_composite_key", """
select a.l_suppkey, a.l_partkey, a.l_returnflag, a.n as n_a, b.n as n_b from (select l_suppkey, l_partkey, l_returnflag, count(*) as n from lineitem where l_linestatus = 'F' group by all) a
join (select l_suppkey, l_partkey, l_returnflag, count(*) as n from lineitem where l_quantity > 25 group by all) b using (l_suppkey, l_partkey, l_returnflag)
""")
def _(spark, d):
    li, k = table(spark, d, "lineitem"), ["l_suppkey", "l_partkey", "l_returnflag"]
    side = lambda cond, name: li.where(cond).groupBy(*k).agg(F.count("*").alias(name))
    return side("l_linestatus = 'F'", "n_a").join(side("l_quantity > 25", "n_b"), k)


@query("join04_different_names", "select n_name, r_name from nation join region on n_regionkey = r_regionkey")
def _(spark, d):
    n, r = table(spark, d, "nation").alias("n"), table(spark, d, "region").alias("r")
    return n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey")).select("n_name", "r_name")


@query("join05_full_outer_chain", """
select coalesce(a.k, b.k, c.k) as k, a.n as customers, b.n as suppliers, c.n as small from (select c_nationkey as k, count(*) as n from customer where c_acctbal > 9000 group by all) a
full join (select s_nationkey as k, count(*) as n from supplier group by all) b on a.k = b.k full join (select n_nationkey as k, 1::bigint as n from nation where n_nationkey < 5) c on c.k = coalesce(a.k, b.k)
""")
def _(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    c = table(spark, d, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("k"), F.lit(1).cast("long").alias("small"))
    return a.join(b, "k", "full").join(c, "k", "full")


@query("join06_three_way", """
select k, a, b, c from (select l_orderkey as k, sum(l_quantity) as a from lineitem where l_returnflag = 'R' group by all) join (select l_orderkey as k, sum(l_quantity) as b from lineitem where l_returnflag = 'A' group by all) using (k)
join (select l_orderkey as k, sum(l_quantity) as c from lineitem where l_returnflag = 'N' group by all) using (k)
""")
def _(spark, d):
    # One pass: an inner join of three groups of the same key is a conditional aggregate.
    flag = lambda f, name: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(name)
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(flag("R", "a"), flag("A", "b"), flag("N", "c")).dropna()


@query("join07_against_baseline", """
with m as (select event_type as method, user_id, round(avg(value), 6) as score from events group by all) select m.user_id, m.method, m.score, b.score as base_score, m.score - b.score as delta_score from m join m b on b.user_id = m.user_id and b.method = 'view' where m.method <> 'view'
""")
def _(spark, d):
    m = table(spark, d, "events").groupBy(F.col("event_type").alias("method"), "user_id").agg(F.round(F.avg("value"), 6).alias("score"))
    return rel.against_baseline(m, "method", "view", "user_id", "score")


@query("join08_edited_against_identity", """
select a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_quantity as first_quantity from lineitem a join (select l_orderkey, min(l_quantity) as l_quantity from lineitem where l_linenumber = 1 group by all) b on a.l_orderkey = b.l_orderkey where a.l_linenumber > 1
""")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    first = li.where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_quantity").alias("first_quantity"))
    return li.where("l_linenumber > 1").join(first, "l_orderkey")


@query("join09_before_after", """
select k, b.n as n_before, a.n as n_after from (select o_custkey as k, count(*) as n from orders where o_orderdate < timestamp '1996-01-01' group by all) b join (select o_custkey as k, count(*) as n from orders where o_orderdate >= timestamp '1996-01-01' group by all) a using (k)
""")
def _(spark, d):
    o, cut = table(spark, d, "orders"), F.lit("1996-01-01").cast("timestamp_ntz")
    side = lambda c, n: o.where(c).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(n))
    return side(F.col("o_orderdate") < cut, "n_before").join(side(F.col("o_orderdate") >= cut, "n_after"), "k")


@query("join10_first_interval", """
with i as (select user_id, event_id as interval_id, ts as start_ts, ts + interval 6 hour as end_ts from events where event_type = 'signup')
select event_id, interval_id from (select e.event_id, i.interval_id, row_number() over (partition by e.event_id order by i.start_ts, i.interval_id) as r from events e join i on e.user_id = i.user_id and e.ts between i.start_ts and i.end_ts where e.event_type <> 'signup') where r = 1
""")
def _(spark, d):
    e = table(spark, d, "events")
    i = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("interval_id"), F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("interval 6 hours")).alias("end_ts"))
    points = e.where("event_type <> 'signup'").select("event_id", "user_id", "ts")
    return rel.first_interval(points, i, "user_id", "ts", "start_ts", "end_ts", ["start_ts", "interval_id"], width=6 * 3600.0).select("event_id", "interval_id")


@query("join11_id_intersection", "select o_custkey as id from orders intersect select c_custkey from customer where c_acctbal > 0")
def _(spark, d):
    good = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().join(good, "id", "left_semi")


@query("join12_semi", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def _(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("join13_anti", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("join14_anti_tuple", "select l_partkey, l_suppkey from lineitem where l_returnflag = 'R' except select l_partkey, l_suppkey from lineitem where l_returnflag = 'A'")
def _(spark, d):
    li = table(spark, d, "lineitem")
    k = ["l_partkey", "l_suppkey"]
    return li.where("l_returnflag = 'R'").select(*k).join(li.where("l_returnflag = 'A'").select(*k), k, "left_anti").distinct()


@query("join15_lookup", "select l_orderkey, l_linenumber, p_brand from lineitem join part on l_partkey = p_partkey")
def _(spark, d):
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return rel.lookup(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), brands, "l_partkey", "p_brand").select("l_orderkey", "l_linenumber", "p_brand")


@query("join17_manifest", """
select row_number() over (order by f, e, seed) as task, f, e, seed from (select distinct l_returnflag as f from lineitem), unnest([1, 4, 8, 16, 32]) as u(e), unnest([0, 1, 2]) as v(seed)
""")
def _(spark, d):
    one = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} int")
    g = rel.grid(f=table(spark, d, "lineitem").select(F.col("l_returnflag").alias("f")), e=one("e", (1, 4, 8, 16, 32)), seed=one("seed", (0, 1, 2)))
    from pyspark.sql import Window

    return g.select(F.row_number().over(Window.orderBy("f", "e", "seed")).cast("long").alias("task"), "f", "e", "seed")


@query("join18_unordered_pairs", "select a.n_regionkey, a.n_name as a, b.n_name as b from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_name < b.n_name")
def _(spark, d):
    return rel.unordered_pairs(table(spark, d, "nation"), "n_name", "n_regionkey")


@query("join19_nearest_match", """
select p_partkey, other from (select p_partkey, q.p_partkey2 as other, row_number() over (partition by p_partkey order by abs(p_retailprice - price2), q.p_partkey2) as i from part p join (select p_brand, p_partkey as p_partkey2, p_retailprice as price2 from part where p_size <= 10) q on p.p_brand = q.p_brand where p.p_size > 40) where i = 1
""")
def _(spark, d):
    p = table(spark, d, "part")
    left = p.where("p_size > 40").select("p_partkey", "p_brand", "p_retailprice")
    right = p.where("p_size <= 10").select("p_brand", F.col("p_partkey").alias("other"), F.col("p_retailprice").alias("price2"))
    return rel.nearest_match(left, right, "p_brand", "p_retailprice", "price2", "other").select("p_partkey", "other")


_PAIRS = "e as (select a.s_suppkey as a, b.s_suppkey as b from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey and abs(a.s_acctbal - b.s_acctbal) < 4000)"


def _cliques_sql(size: int) -> str:
    """All edges among ``size`` items, by joins."""
    names = [f"i{k}" for k in range(1, size + 1)]
    pairs = [(i, j) for j in range(1, size) for i in range(j)]
    on = " and ".join(f"e{n}.a = {names[i]} and e{n}.b = {names[j]}" for n, (i, j) in enumerate(pairs))
    source = ", ".join(f"e as e{n}" for n in range(len(pairs)))
    picks = ", ".join(f"e{next(n for n, (i, j) in enumerate(pairs) if k in (i, j))}.{'a' if k == next(p for p in pairs if k in p)[0] else 'b'} as {name}" for k, name in enumerate(names))
    for k, name in enumerate(names):
        n = next(n for n, p in enumerate(pairs) if k in p)
        on = on.replace(f"= {name}", f"= e{n}.{'a' if pairs[n][0] == k else 'b'}")
    return f"select {size} as size, concat_ws('|', {', '.join(names)}) as items from (select {picks} from {source} where {on})"


@query("join22_cliques", f"with {_PAIRS} " + " union all ".join(map(_cliques_sql, range(3, 7))))
def _(spark, d):
    # The pair gate: suppliers of one nation whose balances are near; cliques of three to six of them.
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal")
    other = s.select("s_nationkey", F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("_y"))
    edges = s.join(other, "s_nationkey").where((F.col("s_suppkey") < F.col("b")) & (F.abs(F.col("s_acctbal") - F.col("_y")) < 4000)).select(F.col("s_suppkey").alias("a"), "b")
    return rel.cliques(edges, 3, 6).select("size", F.concat_ws("|", F.col("items").cast("array<string>")).alias("items"))


@query("join25_strongest_other", """
with m as (select l_returnflag as g, l_suppkey as item, round(avg(l_discount), 8) as v from lineitem group by all) select g, item, v, (select max(v) from m o where o.g = m.g and o.item <> m.item) as other_max from m
""")
def _(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_suppkey").alias("item")).agg(F.round(F.avg("l_discount"), 8).alias("v"))
    return rel.strongest_other(m, "g", "item", "v")


# Aggregates


@query("agg01_column_summary", """
select concept, count(*) as n, count(v) as non_missing, 1 - count(v) / count(*)::double as missing_frac, round(avg(v), 8) as mean, min(v) as min, max(v) as max from (
 select 'quantity' as concept, case when l_orderkey % 10 <> 0 then l_quantity end as v from lineitem union all select 'tax', l_tax from lineitem) group by concept
""")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 10 != 0, F.col("l_quantity")).alias("quantity"), F.col("l_tax").alias("tax"))
    return rel.column_summary(li, ["quantity", "tax"]).withColumn("mean", F.round("mean", 8))


@query("agg03_two_grain_counters", "select event_type, count(*) as n, count(distinct user_id) as users, sum((value > 50)::int)::bigint as high from events group by event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 50).alias("high"))


@query("agg04_category_counts", "select lang, source, count(*) as n from documents group by all")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("agg05_named_aggregates", """
select l_returnflag, round(avg(l_quantity), 8) as mean, quantile_cont(l_quantity, 0.5) as median, max(l_quantity) as hi, min(l_quantity) as lo, count(distinct l_suppkey) as suppliers, round(stddev_samp(l_quantity), 8) as sd, sum(l_quantity) as total from lineitem group by all
""")
def _(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(q), 8).alias("mean"), F.percentile(q, F.lit(0.5)).alias("median"), F.max(q).alias("hi"), F.min(q).alias("lo"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.stddev_samp(q), 8).alias("sd"), F.sum(q).alias("total"))


@query("agg06_mean_of_means", "select c_mktsegment, round(avg(m), 6) as mean, count(*) as n from (select c_mktsegment, o_custkey, avg(o_totalprice) as m from orders join customer on o_custkey = c_custkey group by all) group by all")
def _(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return rel.mean_of_means(o, ["c_mktsegment", "o_custkey"], "c_mktsegment", "o_totalprice").withColumn("mean", F.round("mean", 6))


@query("agg07_replicate_quantiles", "select event_type, round(quantile_cont(m, 0.025), 8) as low, round(quantile_cont(m, 0.975), 8) as high from (select event_type, user_id, avg(value) as m from events group by all) group by all")
def _(spark, d):
    m = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return m.groupBy("event_type").agg(q.alias("q")).select("event_type", F.round(F.col("q")[0], 8).alias("low"), F.round(F.col("q")[1], 8).alias("high"))


@query("agg08_coverage", "select l_returnflag, round(avg((abs(l_discount) >= 0.05)::int), 10) as inclusive, sum((l_discount > 0.05)::int)::bigint as strict from lineitem group by all")
def _(spark, d):
    v = F.col("l_discount")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg((F.abs(v) >= 0.05).cast("int")), 10).alias("inclusive"), F.count_if(v > 0.05).alias("strict"))


@query("agg10_distinct_across_joins", "select c_mktsegment, count(distinct o_orderkey) as orders, count(distinct l_suppkey) as suppliers from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey group by all")
def _(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return li.join(o, "o_orderkey").join(c, "c_custkey").groupBy("c_mktsegment").agg(F.countDistinct("o_orderkey").alias("orders"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("agg11_feasibility", "select user_id, sum((event_type = 'purchase')::int)::bigint as positive, count(*) - sum((event_type = 'purchase')::int)::bigint as negative, sum((event_type = 'purchase')::int) >= 10 and count(*) - sum((event_type = 'purchase')::int) >= 10 as feasible from events group by all")
def _(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("positive"), F.count("*").alias("n"))
    return e.select("user_id", "positive", (F.col("n") - F.col("positive")).alias("negative"), ((F.col("positive") >= 10) & (F.col("n") - F.col("positive") >= 10)).alias("feasible"))


@query("agg12_label_overlap", """
with k as (select distinct user_id, event_type as t from events where value > 85), s as (select t, count(*) as n from k group by t), b as (select x.t as a, y.t as b, count(*) as n from k x join k y on x.user_id = y.user_id and x.t < y.t group by all)
select p.t as a, q.t as b, p.n as n_a, q.n as n_b, coalesce(b.n, 0) as both, round(coalesce(b.n, 0) / (p.n + q.n - coalesce(b.n, 0))::double, 10) as jaccard, coalesce(b.n, 0) = p.n or coalesce(b.n, 0) = q.n as subset, coalesce(b.n, 0) = p.n and coalesce(b.n, 0) = q.n as identical from s p join s q on p.t < q.t left join b on b.a = p.t and b.b = q.t
""")
def _(spark, d):
    return rel.jaccard_pairs(table(spark, d, "events").where("value > 85"), "user_id", "event_type").withColumn("jaccard", F.round("jaccard", 10))


@query("agg13_cluster_means", "select user_id, round(avg(value), 8) as mean, count(*) as n from events group by all")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 8).alias("mean"), F.count("*").alias("n"))


@query("agg14_sufficient_statistics", """
select o_custkey, count(*) as n, round(sum(z), 4) as s_z, round(sum(z * z), 4) as s_zz, round(sum(y), 4) as s_y, round(sum(y * y), 4) as s_yy, round(sum(z * y), 4) as s_zy from (select o_custkey, o_totalprice / 100000 as z, (o_orderkey % 97) / 10.0::double as y from orders) group by all
""")
def _(spark, d):
    from ..operators.statistics import sufficient

    o = table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") / 100000).alias("z"), (F.col("o_orderkey") % 97 / 10.0).alias("y"))
    s = sufficient(o, "o_custkey", "z", "y")
    return s.select("o_custkey", "n", *[F.round(c, 4).alias(c) for c in ("s_z", "s_zz", "s_y", "s_yy", "s_zy")])


@query("agg15_train_scale", "select round(avg(value), 8) as mean, round(stddev_pop(value), 8) as scale from events where user_id % 10 < 7")
def _(spark, d):
    return table(spark, d, "events").where("user_id % 10 < 7").agg(F.round(F.avg("value"), 8).alias("mean"), F.round(F.stddev_pop("value"), 8).alias("scale"))


@query("agg16_robust_scale", """
select event_type, med as median, case when iqr > 1e-8 then iqr when sd > 1e-8 then sd else 1.0 end as scale from (select event_type, quantile_cont(value, 0.5) as med, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 8) as iqr, round(stddev_pop(value), 8) as sd from events group by all)
""")
def _(spark, d):
    from ..operators.statistics import robust_scale

    s = robust_scale(table(spark, d, "events"), "event_type", "value")
    return s.select("event_type", "median", F.round("scale", 8).alias("scale"))


@query("agg19_status_concat", "select o_custkey, string_agg(o_orderstatus, '|' order by o_orderkey) as path from orders group by all")
def _(spark, d):
    steps = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(steps, lambda s: s["o_orderstatus"]), "|").alias("path"))


@query("agg21_pivot_contrast", "select user_id, round(avg(value) filter (event_type = 'view'), 8) as view, round(avg(value) filter (event_type = 'purchase'), 8) as purchase, round(avg(value) filter (event_type = 'purchase') - avg(value) filter (event_type = 'view'), 8) as contrast from events group by all")
def _(spark, d):
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["view", "purchase"]).agg(F.avg("value"))
    return p.select("user_id", F.round("view", 8).alias("view"), F.round("purchase", 8).alias("purchase"), F.round(F.col("purchase") - F.col("view"), 8).alias("contrast"))


@query("agg23_effective_sample", "select l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 10) as mean, round(sum(l_quantity) * sum(l_quantity) / sum(l_quantity * l_quantity), 4) as n_eff from lineitem group by all")
def _(spark, d):
    return rel.effective_sample(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", "l_discount").select("l_returnflag", F.round("mean", 10).alias("mean"), F.round("n_eff", 4).alias("n_eff"))


@query("agg24_leave_one_out", """
with p as (select o_orderpriority as g, o_orderstatus as l, sum(o_totalprice - 150000) as s, count(*) as n from orders group by all), m as (select g, (sum(s) over (partition by g) - s) / (sum(n) over (partition by g) - n) as m from p)
select g, round(min(m), 4) as low, round(max(m), 4) as high, count(distinct sign(m)) = 1 as same_sign from m group by g
""")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), "o_orderstatus", (F.col("o_totalprice") - 150000).alias("v"))
    return rel.leave_one_out(o, "g", "o_orderstatus", "v").select("g", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "same_sign")


@query("agg25_firing_rates", "select d, sum((x > 0)::int)::bigint / count(*)::double as rate, sum((x > 0)::int) = 0 as dead from (select generate_subscripts(embedding, 1)::int as d, unnest(embedding) as x from embeddings) group by d")
def _(spark, d):
    x = table(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    return x.groupBy((F.col("i") + 1).alias("d")).agg((F.count_if(F.col("x") > 0) / F.count("*")).alias("rate"), (F.count_if(F.col("x") > 0) == 0).alias("dead"))


@query("agg26_distribution", "select event_type, round(avg(value), 8) as mean, quantile_cont(value, 0.5) as median, round(quantile_cont(value, 0.9), 8) as q90, round(quantile_cont(value, 0.95), 8) as q95, max(value) as hi from events group by all")
def _(spark, d):
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    s = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 8).alias("mean"), q.alias("q"), F.max("value").alias("hi"))
    return s.select("event_type", "mean", F.col("q")[0].alias("median"), F.round(F.col("q")[1], 8).alias("q90"), F.round(F.col("q")[2], 8).alias("q95"), "hi")


@query("agg27_target_coverage", """
select target, split, count(v) as valid, sum((v = 1)::int)::bigint as positive, count(distinct case when v = 1 then o_custkey end) as positive_clusters from (
 select 'urgent' as target, o_custkey, case when o_orderkey % 3 = 0 then 'test' else 'train' end as split, (o_orderpriority = '1-URGENT')::int as v from orders union all select 'final', o_custkey, case when o_orderkey % 3 = 0 then 'test' else 'train' end, case when o_orderstatus <> 'P' then (o_orderstatus = 'F')::int end from orders) group by all
""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, "test").otherwise("train").alias("split"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"), F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "F").cast("int")).alias("final"))
    long = o.unpivot(["o_custkey", "split"], ["urgent", "final"], "target", "v")
    return long.groupBy("target", "split").agg(F.count("v").alias("valid"), F.count_if(F.col("v") == 1).alias("positive"), F.countDistinct(F.when(F.col("v") == 1, F.col("o_custkey"))).alias("positive_clusters"))


@query("agg28_eligible_count", "select s_suppkey, s_nationkey, sum((s_acctbal > 0)::int) over (partition by s_nationkey)::bigint as eligible from supplier")
def _(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.count_if(F.col("s_acctbal") > 0).over(Window.partitionBy("s_nationkey")).alias("eligible"))


@query("agg29_all_and_counts", "select c_mktsegment, sum((c_acctbal < 0)::int)::bigint as debtors, bool_and(c_acctbal > -1000) as bounded from customer group by all")
def _(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") < 0).alias("debtors"), F.bool_and(F.col("c_acctbal") > -1000).alias("bounded"))


@query("agg30_tier_counts", "select l_linestatus, coalesce(sum((l_returnflag = 'R')::int), 0)::bigint as \"R\", coalesce(sum((l_returnflag = 'X')::int), 0)::bigint as \"X\" from lineitem group by all")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["R", "X"]).count().na.fill(0)


@query("agg31_crosstab_first_wins", "select b, t, count(*) as n from (select b, t from (select lower(trim(p_brand)) as b, split_part(p_type, ' ', 1) as t, row_number() over (partition by lower(trim(p_name)) order by p_partkey) as i from part) where i = 1) group by all")
def _(spark, d):
    p = table(spark, d, "part").withColumn("name_key", F.lower(F.trim("p_name")))
    once = rel.top_per_key(p, "name_key", "p_partkey")
    return once.groupBy(F.lower(F.trim("p_brand")).alias("b"), F.substring_index("p_type", " ", 1).alias("t")).agg(F.count("*").alias("n"))


# Top and sets


@query("top01_multi_key_sort", "select o_orderkey, o_totalprice from orders order by o_orderpriority, o_totalprice desc, o_orderkey limit 100")
def _(spark, d):
    return table(spark, d, "orders").orderBy("o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("top02_bottom_by_hash", "select o_orderkey from orders order by sha256('s' || o_orderkey::varchar) limit 200")
def _(spark, d):
    return rel.bottom_by_hash(table(spark, d, "orders"), "o_orderkey", 200, "s").select("o_orderkey")


@query("top03_hash_order", "select c_custkey from customer order by ('0x' || substr(sha256(c_custkey::varchar), 1, 16))::ubigint limit 64")
def _(spark, d):
    key = F.conv(F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return table(spark, d, "customer").orderBy(key).limit(64).select("c_custkey")


@query("top08_pareto_front", """
with s as (select l_suppkey, round(avg(l_discount), 6) as a, round(avg(l_quantity), 6) as b, count(*) as n from lineitem group by all)
select * from s where not exists (select 1 from s o where o.a >= s.a and o.b >= s.b and o.n <= s.n and (o.a > s.a or o.b > s.b or o.n < s.n))
""")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 6).alias("a"), F.round(F.avg("l_quantity"), 6).alias("b"), F.count("*").alias("n"))
    return rel.dominated_free(s, "l_suppkey", ["a", "b"], "n")


@query("top09_role_picks", """
with s as (select l_suppkey, round(avg(l_discount), 8) as a, sum(l_quantity) as q, count(*) as n from lineitem group by all),
r as (select 'compact' as role, l_suppkey, row_number() over (order by n, l_suppkey) as i from s union all select 'semantic', l_suppkey, row_number() over (order by a desc, l_suppkey) from s union all select 'faithful', l_suppkey, row_number() over (order by q desc, l_suppkey) from s)
select l_suppkey, string_agg(role, '|' order by role) as roles from r where i = 1 group by l_suppkey
""")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_discount"), 8).alias("a"), F.sum("l_quantity").alias("q"), F.count("*").alias("n"))
    pick = lambda role, *o: s.orderBy(*o, "l_suppkey").limit(1).select(F.lit(role).alias("role"), "l_suppkey")
    picks = pick("compact", "n").unionByName(pick("semantic", F.col("a").desc())).unionByName(pick("faithful", F.col("q").desc()))
    return picks.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_list("role")), "|").alias("roles"))


@query("top11_strided_shard", "select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) where i % 7 = 3")
def _(spark, d):
    return rel.strided(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7, 3)


@query("top13_band_pick", "select l_returnflag, l_suppkey from (select l_returnflag, l_suppkey, row_number() over (partition by l_returnflag order by (a between 0.049 and 0.051) desc, abs(a - 0.05), l_suppkey) as i from (select l_returnflag, l_suppkey, round(avg(l_discount), 8) as a from lineitem group by all)) where i = 1")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.avg("l_discount"), 8).alias("a"))
    return rel.top_per_key(s, "l_returnflag", [F.col("a").between(0.049, 0.051).desc(), F.abs(F.col("a") - 0.05), F.col("l_suppkey")]).select("l_returnflag", "l_suppkey")


@query("set01_membership", """
with u as (select o_custkey::varchar as k, 'orders' as s from orders union select c_custkey::varchar, 'customer' from customer union select s_suppkey::varchar, 'supplier' from supplier), m as (select k, string_agg(s, '|' order by s) as members from u group by k) select members, count(*) as n from m group by members
""")
def _(spark, d):
    one = lambda t, c: table(spark, d, t).select(F.col(c).alias("id"))
    return rel.set_report({"orders": one("orders", "o_custkey"), "customer": one("customer", "c_custkey"), "supplier": one("supplier", "s_suppkey")}, "id")


@query("set02_union_all", "select c_nationkey as k, c_acctbal as v from customer union all select s_nationkey, s_acctbal from supplier")
def _(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("v")).unionByName(table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_acctbal").alias("v")))


@query("set03_replace_part", "select o_orderstatus as part, o_orderkey as id, null::varchar as note from orders where o_orderstatus <> 'P' union all select 'P', o_orderkey, 'new' from orders where o_orderkey < 100")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("part"), F.col("o_orderkey").alias("id"))
    new = o.where("id < 100").select(F.lit("P").alias("part"), "id", F.lit("new").alias("note"))
    return rel.replace_part(o, new, "part")


@query("set04_duplicate_keys", "select l_orderkey, l_suppkey, count(*) as n from lineitem group by all having count(*) > 1")
def _(spark, d):
    return rel.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("set05_distinct", "select distinct p_brand, p_size from part")
def _(spark, d):
    return table(spark, d, "part").select("p_brand", "p_size").dropDuplicates()


@query("set06_grid_gaps", """
with g as (select a.p_brand, b.p_size from (select distinct p_brand from part) a, (select distinct p_size from part) b), h as (select p_brand, p_size, count(*) as n from part where p_partkey % 3 <> 0 group by all)
select coalesce(g.p_brand, h.p_brand) as p_brand, coalesce(g.p_size, h.p_size) as p_size, case when n is null then 'missing' else 'duplicate' end as issue from g full join h on g.p_brand = h.p_brand and g.p_size = h.p_size where n is null or n > 1
""")
def _(spark, d):
    p = table(spark, d, "part")
    return rel.grid_gaps(p.where("p_partkey % 3 <> 0"), rel.grid(p_brand=p, p_size=p), ["p_brand", "p_size"])


@query("set07_common_support", "select l_suppkey from lineitem group by l_suppkey having count(distinct l_tax) = (select count(distinct l_tax) from lineitem)")
def _(spark, d):
    return rel.common_support(table(spark, d, "lineitem"), "l_suppkey", "l_tax")
