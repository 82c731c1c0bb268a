"""Files, hashes, ladders, counters and audits over the driver's tables. Queries on sources write small files of their own to
a shared folder and read these."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import audit
from ..operators import relational as rel
from ..operators import statistics as st
from ..sources import binary, sinks
from ..sources import tables as src
from . import PLACE, placed, query, table

# Sources and sinks


def _customers_csv(spark, d, compress=False, parts=1):
    path = src.scratch_folder(spark)
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    sinks.write_csv(c.repartition(parts), path, ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"], compress)
    return path


_C = "select c_custkey::varchar as c_custkey, c_name, c_mktsegment, c_nationkey::varchar as c_nationkey from customer"


@query("src01_csv_strings", _C)
def _(spark, d):
    return src.read_strings(spark, _customers_csv(spark, d))


@query("snk01_csv_fields", _C)
def _(spark, d):
    return src.read_strings(spark, _customers_csv(spark, d, parts=3), ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])


@query("src07_gzip_csv", _C)
def _(spark, d):
    return src.read_strings(spark, _customers_csv(spark, d, compress=True), ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])


@query("src04_header", "select * from (values (0, 'c_custkey'), (1, 'c_name'), (2, 'c_mktsegment'), (3, 'c_nationkey')) t(i, name)")
def _(spark, d):
    return spark.createDataFrame(list(enumerate(src.header(spark, _customers_csv(spark, d)))), "i int, name string")


@query("src24_preferred_source", _C)
def _(spark, d):
    return src.read_first(spark, src.scratch_folder(spark), _customers_csv(spark, d))


@query("src23_rows_by_file", "select c_mktsegment as name, count(*) as n, count(distinct c_nationkey) as nations from customer group by all")
def _(spark, d):
    path = src.scratch_folder(spark)
    table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment").write.partitionBy("c_mktsegment").option("header", True).csv(path)
    rows = src.read_many(spark, [f"{path}/c_mktsegment={r[0]}" for r in table(spark, d, "customer").select("c_mktsegment").distinct().collect()])
    name = F.regexp_extract("file", "c_mktsegment=([^/]+)/", 1)
    return rows.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("nations"))


@query("src09_file_census", "select '.txt' as suffix, count(*) as files, sum(length(r_name) + 1)::bigint as bytes from region")
def _(spark, d):
    path = src.scratch_folder(spark)
    table(spark, d, "region").select("r_name", F.col("r_regionkey").alias("k")).repartition(5, "k").write.partitionBy("k").text(path)
    return src.file_census(spark, path).where("suffix = '.txt'")


@query("snk07_checksums", "select sha256(r_name || chr(10)) as sha256, length(r_name) + 1 as length from region")
def _(spark, d):
    path = src.scratch_folder(spark)
    table(spark, d, "region").select("r_name", F.col("r_regionkey").alias("k")).repartition(5, "k").write.partitionBy("k").text(path)
    return src.checksums(spark, path).where("name like '%.txt'").select("sha256", "length")


@query("src10_record_headers", "select 'r' || s_suppkey::varchar as record, 2 as leads, 500.0::double as rate, s_nationkey + 100 as samples, i, case i when 0 then 'I' else 'II' end as lead, 1000.0::double + i as gain, s_nationkey as baseline from supplier, range(0, 2) t(i)")
def _(spark, d):
    path = src.scratch_folder(spark)
    s, k, n = table(spark, d, "supplier"), F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    line = [F.concat(F.lit(f"r.mat 16+24 {1000 + i}("), n, F.lit(f")/mV 16 0 0 0 0 {lead}")) for i, lead in enumerate(("I", "II"))]
    head = F.concat(F.lit("r"), k, F.lit(" 2 500 "), (F.col("s_nationkey") + 100).cast("string"))
    files = s.select(F.concat_ws("/", F.pmod("s_suppkey", F.lit(64)).cast("string"), k).alias("name"), F.concat_ws("\n", head, *line).alias("value"))

    def write(batches):
        import pyarrow as pa

        for b in batches:
            for name, text in zip(b.column("name").to_pylist(), b.column("value").to_pylist()):
                binary.write(f"{path}/{name}.txt", text.encode())
            yield pa.RecordBatch.from_pydict({"n": [len(b)]})

    # One file a record, in folders of many that are listed side by side.
    files.repartition(64, "name").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return src.record_headers(spark, f"{path}/*")


@query("src15_waveform_index", "select o_orderkey::varchar as record, 'store/' || (o_orderkey % 7)::varchar || '/' || o_orderkey::varchar || '.mat' as path from orders")
def _(spark, d):
    k = F.col("o_orderkey").cast("string")
    paths = table(spark, d, "orders").select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("x"), F.concat(F.lit("store/"), (F.col("o_orderkey") % 7).cast("string"), F.lit("/"), k, F.lit(".mat")).alias("path"))
    return src.waveform_index(paths)


@query("src13_ordered_leads", "select l_orderkey, array_to_string([coalesce(max(l_quantity) filter (l_linenumber = 2), -1), coalesce(max(l_quantity) filter (l_linenumber = 1), -1)], ',') as leads from (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity from lineitem where l_linenumber < 3 group by all) group by l_orderkey")
def _(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber < 3").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    named = li.select("l_orderkey", F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("lead"), "q")
    out = src.ordered_leads(named, "l_orderkey", "lead", "q", ["V2", "V1"])
    return out.select("l_orderkey", F.array_join(F.transform("leads", lambda x: F.coalesce(x, F.lit(-1.0)).cast("string")), ",").alias("leads"))


@query("src18_shard_index", "select o_orderkey, case when o_orderkey % 10 < 7 then 'train' else 'test' end as split, case when o_orderstatus <> 'P' then o_orderstatus end as shard, case when o_orderstatus <> 'P' then row_number() over (partition by o_orderstatus order by o_orderkey) - 1 end as row from orders")
def _(spark, d):
    o = table(spark, d, "orders")
    shards = o.where("o_orderstatus <> 'P'").groupBy(F.col("o_orderstatus").alias("shard")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    return src.shard_index(o, shards, "o_orderkey", F.when(F.col("o_orderkey") % 10 < 7, "train").otherwise("test"))


@query("src16_matrix_rows", "select vec_id, i, x from (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings) where i between 3 and 6")
def _(spark, d):
    """Matrices of up to 50 rows, of both orders of axes and of bytes, written and read in ranges; four columns are read."""
    import io

    import numpy as np
    import pyarrow as pa

    path = src.scratch_folder(spark)

    def write(t: pa.Table) -> pa.Table:
        t, g = t.sort_by("vec_id"), t["g"][0].as_py()
        x = np.array(t["v"].to_pylist(), dtype=("<f4", ">f4", "<f8", ">f8")[g % 4], order="CF"[g // 4 % 2])
        out = io.BytesIO()
        np.save(out, x)
        binary.write(f"{path}/{g}.npy", out.getvalue())
        return pa.table({"g": [g], "row": [list(range(len(t)))], "vec_id": [t["vec_id"].to_pylist()]})

    e = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 50).alias("g"), F.col("embedding").alias("v"))
    index = e.groupBy("g").applyInArrow(write, "g long, row array<long>, vec_id array<long>")
    places = rel.cut(index).select("g", F.explode(F.arrays_zip("row", "vec_id")).alias("z")).select("g", "z.row", "z.vec_id")
    rows = binary.read_matrices(spark, path, "3:7", range_bytes=4096, task_bytes=binary.RANGE).withColumn("g", F.regexp_extract("file", r"(\d+)\.npy$", 1).cast("long"))
    return rows.join(places, ["g", "row"]).select("vec_id", F.posexplode("values").alias("i", "x")).select("vec_id", (F.col("i") + 3).cast("long").alias("i"), "x")


@query("snk02_not_empty", "select n_nationkey, n_name from nation")
def _(spark, d):
    path = src.scratch_folder(spark)
    sinks.write_not_empty(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.parquet(path)


@query("snk04_transform_write", "select o_orderkey, round(ln(o_totalprice), 8) as x from orders")
def _(spark, d):
    path = src.scratch_folder(spark)
    table(spark, d, "orders").select("o_orderkey", F.round(F.ln("o_totalprice"), 8).alias("x")).write.parquet(path)
    return spark.read.parquet(path)


@query("snk05_significant_digits", "select o_orderkey, (round(o_totalprice * pow(10.0, 4 - floor(log10(o_totalprice)))) / pow(10.0, 4 - floor(log10(o_totalprice))))::double as x from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", sinks.digits("o_totalprice", 5).cast("double").alias("x"))


@query("snk06_markdown", "select '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || r_regionkey::varchar || ' | ' || r_name || ' |', chr(10) order by r_regionkey) as report from region")
def _(spark, d):
    return spark.createDataFrame([(sinks.markdown(table(spark, d, "region").select("r_regionkey", "r_name"), ["r_regionkey"]),)], "report string")


# Ladders


@query("prj14_category", "select p_partkey, case when p_type like '%STEEL%' then 'metal' when p_type like '%BRASS%' or p_type like '%COPPER%' then 'alloy' when p_size > 25 then 'large' else 'other' end as category from part")
def _(spark, d):
    t = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", fn.ladder((t.contains("STEEL"), "metal"), (t.contains("BRASS") | t.contains("COPPER"), "alloy"), (F.col("p_size") > 25, "large"), otherwise="other").alias("category"))


@query("prj22_focus_mask", "select event_id, case when event_type = 'click' then value::int = 1 else value >= 50 end as focus from events")
def _(spark, d):
    e = table(spark, d, "events").withColumn("kind", F.when(F.col("event_type") == "click", "binary").otherwise("continuous"))
    # Halves go to the even number, as in a cast of SQL.
    y = F.when(F.col("kind") == "binary", F.rint("value")).otherwise(F.col("value"))
    return e.withColumn("y", y).select("event_id", fn.focus("kind", "y", 50.0).alias("focus"))


@query("prj25_extraction_status", "select l_suppkey, case when n < 20 then 'too_few' when missing > 0.5 then 'mostly_missing' when q >= 25 and missing <= 0.1 then 'ready' when q >= 25 then 'usable' else 'weak' end as status from (select l_suppkey, count(*) as n, avg((l_discount = 0)::int) as missing, avg(l_quantity) as q from lineitem group by all)")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg((F.col("l_discount") == 0).cast("int")).alias("missing"), F.avg("l_quantity").alias("q"))
    q, m = F.col("q") >= 25, F.col("missing")
    return s.select("l_suppkey", fn.ladder((F.col("n") < 20, "too_few"), (m > 0.5, "mostly_missing"), (q & (m <= 0.1), "ready"), (q, "usable"), otherwise="weak").alias("status"))


@query("prj26_robustness", "select l_partkey, case when n >= 3 then 'robust' when n = 2 then 'suggestive' else 'single' end as label from (select l_partkey, count(distinct l_returnflag) as n from lineitem group by all)")
def _(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_returnflag").alias("n"))
    return n.select("l_partkey", fn.ladder((F.col("n") >= 3, "robust"), (F.col("n") == 2, "suggestive"), otherwise="single").alias("label"))


@query("prj27_reclassified", "select o_orderkey, case when o_totalprice < 20000 then 'low' when o_orderstatus = 'P' then 'open' when o_orderpriority like '1%' then 'urgent' else 'plain' end as class from orders")
def _(spark, d):
    steps = (F.col("o_orderpriority").startswith("1"), "urgent"), (F.col("o_orderstatus") == "P", "open"), (F.col("o_totalprice") < 20000, "low")
    return table(spark, d, "orders").select("o_orderkey", fn.overridden(F.lit("plain"), *steps).alias("class"))


@query("prj28_taxonomy", """
with s as (select l_suppkey, l_returnflag, avg(l_discount) as m from lineitem group by all), t as (select l_suppkey, max(m) as a, max(m) filter (k = 2) as b, count(*) as n from (select *, row_number() over (partition by l_suppkey order by m desc, l_returnflag) as k from s) group by l_suppkey)
select l_suppkey, case when n < 2 then 'dead' when a < 0.04 then 'inactive' when b < 0.9 * a then 'mono' else 'entangled' end as class from t
""")
def _(spark, d):
    s = st.ordered_means(placed(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], PLACE, m="l_discount")
    r = s.withColumn("k", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.col("m").desc(), "l_returnflag")))
    t = r.groupBy("l_suppkey").agg(F.max("m").alias("a"), F.max(F.when(F.col("k") == 2, F.col("m"))).alias("b"), F.count("*").alias("n"))
    return t.select("l_suppkey", fn.ladder((F.col("n") < 2, "dead"), (F.col("a") < 0.04, "inactive"), (F.col("b") < 0.9 * F.col("a"), "mono"), otherwise="entangled").alias("class"))


@query("prj29_flags_and_year", "select o_orderkey, trim(coalesce(o_orderpriority, '')) <> '' as flagged, year(o_orderdate) as year from orders")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("text", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return o.select("o_orderkey", (F.trim(F.coalesce("o_orderpriority", F.lit(""))) != "").alias("flagged"), fn.year_of("text").alias("year"))


@query("prj44_recon_gate", """
with c as (select s_suppkey, r_regionkey from supplier, region), h as (select l_suppkey, r_regionkey, avg(l_discount) * 18 as r from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all)
select c.s_suppkey, c.r_regionkey, case when c.s_suppkey % 10 = 0 then 'missing_checkpoint' when r is null then 'missing_cache' when r >= 0.9 then 'pass' else 'below' end as status from c left join h on c.s_suppkey = h.l_suppkey and c.r_regionkey = h.r_regionkey
""")
def _(spark, d):
    li = placed(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    means = st.ordered_means(li, ["l_suppkey", "n_regionkey"], PLACE, m="l_discount")
    h = means.select(F.col("l_suppkey").alias("s_suppkey"), F.col("n_regionkey").alias("r_regionkey"), (F.col("m") * 18).alias("r"))
    cells = rel.grid(s_suppkey=table(spark, d, "supplier").select("s_suppkey"), r_regionkey=table(spark, d, "region").select("r_regionkey"))
    j = cells.join(h, ["s_suppkey", "r_regionkey"], "left")
    return j.select("s_suppkey", "r_regionkey", fn.ladder((F.col("s_suppkey") % 10 == 0, "missing_checkpoint"), (F.col("r").isNull(), "missing_cache"), (F.isnan("r"), "nonfinite"), (F.col("r") >= 0.9, "pass"), otherwise="below").alias("status"))


@query("prj36_coerced", "select event_id, try_cast(event_type as double) as a, try_cast(value::varchar as double) as b from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", fn.parse_any("event_type").alias("a"), fn.parse_any(F.col("value").cast("string")).alias("b"))


# Counters, windows, tops


@query("agg02_plausible_counters", "select event_type, count(*) as n, count(value) as nonmissing, sum((value between 10 and 90)::int)::bigint as plausible from events group by all")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("nonmissing"), F.count_if(fn.in_range("value", 10, 90)).alias("plausible"))


@query("agg17_robust_scale_floor", "select l_returnflag, round(median(l_tax), 8) as location, round(greatest(quantile_cont(l_tax, 0.75) - quantile_cont(l_tax, 0.25), 1e-8), 8) as scale from lineitem group by all")
def _(spark, d):
    q = F.percentile("l_tax", F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias("q")
    s = table(spark, d, "lineitem").groupBy("l_returnflag").agg(q)
    return s.select("l_returnflag", F.round(F.col("q")[1], 8).alias("location"), F.round(F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(1e-8)), 8).alias("scale"))


@query("join21_record_order", """
with a as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as i from orders), b as (select o_orderkey, row_number() over (order by o_orderdate, o_custkey, o_orderkey) as i from orders where o_orderkey % 50 <> 7 or o_custkey % 2 = 0)
select count(*) filter (a.i is not null and b.i is not null) as n, count(*) filter (a.i <> b.i) as moved, count(*) filter (b.i is null) as only_left, count(*) filter (a.i is null) as only_right from a full join b using (o_orderkey)
""")
def _(spark, d):
    o = table(spark, d, "orders")
    other = o.where("o_orderkey % 50 <> 7 or o_custkey % 2 = 0")
    return rel.order_agreement(o, other, "o_orderkey", ["o_orderdate", "o_orderkey"], ["o_orderdate", "o_custkey", "o_orderkey"])


@query("win11_reverse_running_minimum", "select p_brand, p_partkey, min(p_retailprice) over (partition by p_brand order by p_partkey desc rows unbounded preceding) as low from part")
def _(spark, d):
    w = Window.partitionBy("p_brand").orderBy(F.col("p_partkey").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "part").select("p_brand", "p_partkey", F.min("p_retailprice").over(w).alias("low"))


@query("win12_contiguous_offsets", "with s as (select c_nationkey as shard, count(*) as size from customer group by all) select shard, size, (sum(size) over (order by shard) - size)::bigint as start, true as contiguous from s")
def _(spark, d):
    s = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("shard")).agg(F.count("*").alias("size"))
    return src.with_contiguity(src.with_offsets(s, "shard", "size"), "shard", "start", "size").select("shard", "size", "start", "contiguous")


@query("win21_head_per_group", "select c_mktsegment, c_custkey, c_acctbal from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as k from customer) where k = 1")
def _(spark, d):
    return rel.top_per_key(table(spark, d, "customer"), "c_mktsegment", [F.col("c_acctbal").desc(), F.col("c_custkey")]).select("c_mktsegment", "c_custkey", "c_acctbal")


@query("top07_head_and_tail", "(select o_orderkey, o_totalprice, 'head' as part from orders order by o_totalprice desc, o_orderkey limit 5) union all (select o_orderkey, o_totalprice, 'tail' as part from orders order by o_totalprice, o_orderkey limit 5)")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    part = lambda order, name: o.orderBy(order, "o_orderkey").limit(5).withColumn("part", F.lit(name))
    return part(F.col("o_totalprice").desc(), "head").unionByName(part(F.col("o_totalprice"), "tail"))


@query("top10_operating_point", """
with s as (select l_returnflag, l_suppkey, count(*) as n, avg(l_discount) as dead, avg(l_quantity) as l0 from lineitem group by all), t as (select *, case when dead < 0.048 then 0 when dead < 0.052 then 1 else 2 end as tier from s)
select l_returnflag, l_suppkey, tier from (select *, row_number() over (partition by l_returnflag order by tier, n desc, dead, l0, l_suppkey) as k from t) where k = 1
""")
def _(spark, d):
    s = st.ordered_means(placed(spark, d, "lineitem"), ["l_returnflag", "l_suppkey"], PLACE, dead="l_discount", l0="l_quantity")
    tier = F.when(F.col("dead") < 0.048, 0).when(F.col("dead") < 0.052, 1).otherwise(2)
    return rel.top_per_key(s.withColumn("tier", tier), "l_returnflag", [F.col("tier"), F.col("n").desc(), F.col("dead"), F.col("l0"), F.col("l_suppkey")]).select("l_returnflag", "l_suppkey", "tier")


@query("top12_first_rows", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 100")
def _(spark, d):
    return rel.page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 0, 100)


# Hashes


@query("hsh05_config_hash", """select o_orderkey, sha256('{"o_custkey":' || o_custkey::varchar || ',"o_orderkey":' || o_orderkey::varchar || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') as h from orders""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.config_hash("o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority").alias("h"))


@query("hsh08_design_hash", "select c_mktsegment, sha256('draws=2000;seed=7;' || string_agg(c_custkey::varchar, ',' order by c_custkey)) as h from customer group by all")
def _(spark, d):
    # One hash over ordered ids: its input is the list of clusters of a design.
    return rel.ordered_manifest(table(spark, d, "customer"), "c_mktsegment", F.col("c_custkey").cast("string"), "c_custkey", ",", "draws=2000;seed=7;", name="h", whole=True)


@query("hsh09_stable_seeds", "select c_custkey, ('0x' || substr(h, 1, 8))::ubigint::bigint as most, ('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::ubigint::bigint as least from (select c_custkey, sha256(c_name) as h from customer)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.seed_by_first_bytes("c_name").alias("most"), fn.seed_by_last_first("c_name").alias("least"))


@query("hsh10_feature_subsets", "select k, seed, feature from (select k, seed, feature, row_number() over (partition by k, seed order by md5(k::varchar || ':' || seed::varchar || ':' || feature::varchar), feature) as o from unnest([8, 16]) a(k), unnest([1, 2, 3]) b(seed), (select unnest(range(0, (select max(len(embedding)) from embeddings))) as feature)) where o <= k")
def _(spark, d):
    width = F.max(F.size("embedding"))
    features = table(spark, d, "embeddings").agg(width.alias("w")).select(F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("feature"))
    cells = features.select("feature", F.explode(F.array(F.lit(8), F.lit(16))).alias("k")).select("*", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("seed"))
    h = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ("k", "seed", "feature")]))
    o = F.row_number().over(Window.partitionBy("k", "seed").orderBy(h, "feature"))
    return cells.withColumn("o", o).where("o <= k").select("k", "seed", "feature")


# Audits


@query("aud06_complete_grid", "select l_returnflag, round(avg(l_discount), 8) as m from lineitem group by all")
def _(spark, d):
    li = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(F.avg("l_discount").alias("m"), F.count("*").alias("n"))
    plan = rel.grid(l_returnflag=li.select("l_returnflag").distinct(), l_linenumber=li.select("l_linenumber").distinct())
    whole = audit.complete_grid(li, rel.grid_gaps(li, plan, ["l_returnflag", "l_linenumber"]), "incomplete grid")
    return whole.groupBy("l_returnflag").agg(F.round(F.sum(F.col("m") * F.col("n")) / F.sum("n"), 8).alias("m"))


@query("aud09_release_requirements", "select n_name as name, (n_nationkey % 6 <> 0) as present, case when n_nationkey % 6 <> 0 then length(n_name) else 0 end as size from nation")
def _(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.length("n_name").alias("size"), "n_nationkey")
    return audit.requirements(n.where("n_nationkey % 6 <> 0"), "name", n)


@query("aud09_path_containment", "select n_nationkey, case n_nationkey % 4 when 0 then 'release/' || n_name when 1 then '/etc/' || n_name when 2 then 'release/../' || n_name else 'releases/' || n_name end as path from nation where n_nationkey % 4 <> 0")
def _(spark, d):
    n = table(spark, d, "nation")
    stem = F.element_at(F.array(*map(F.lit, ("release/", "/etc/", "release/../", "releases/"))), F.col("n_nationkey") % 4 + 1)
    return audit.outside(n.select("n_nationkey", F.concat(stem, "n_name").alias("path")), "path", "release")


@query("aud10_arm_agreement", "select l_suppkey, count(m) as n, count(distinct m) as distinct, round(max(m) - min(m), 8) as spread from (select l_suppkey, l_returnflag, round(avg(l_discount), 3) as m from lineitem group by all) group by l_suppkey")
def _(spark, d):
    means = st.ordered_means(placed(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], PLACE, m="l_discount")
    arms = means.withColumn("m", st.rounded_product(F.col("m"), 3))
    return audit.agreement(arms, "l_suppkey", "m").withColumn("spread", F.round("spread", 8))


@query("aud11_vector_width", "select count(*) as n, count(*) filter (embedding is null or len(embedding) <> 64) as wrong from embeddings")
def _(spark, d):
    return audit.widths(table(spark, d, "embeddings"), "embedding", 64)
