"""Projections, predicates and hash splits over the driver's tables."""

from pyspark.sql import functions as F

from .. import functions as fn
from . import query, table

# Projections


@query("prj01_parse_finite", """
select o_orderkey, case when isnan(v) or isinf(v) then null else v end as value from (
 select o_orderkey, try_cast(case when o_orderkey % 7 = 0 then 'nan' when o_orderkey % 5 = 0 then 'inf' when o_orderkey % 3 = 0 then 'abc' else (o_orderkey / 2.0)::double::varchar end as double) as v from orders)
""")
def _(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 7 == 0, "nan").when(k % 5 == 0, "inf").when(k % 3 == 0, "abc").otherwise((k / 2).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", fn.parse_finite(text).alias("value"))


@query("prj02_parse_any", """
select o_orderkey, isinf(v) as infinite, isnan(v) as is_nan, v is null as missing from (
 select o_orderkey, try_cast(case when o_orderkey % 7 = 0 then 'nan' when o_orderkey % 5 = 0 then 'inf' when o_orderkey % 3 = 0 then 'abc' else o_orderkey::varchar end as double) as v from orders)
""")
def _(spark, d):
    k = F.col("o_orderkey")
    text = F.when(k % 7 == 0, "nan").when(k % 5 == 0, "inf").when(k % 3 == 0, "abc").otherwise(k.cast("string"))
    v = fn.parse_any(text)
    return table(spark, d, "orders").select("o_orderkey", (F.abs(v) == float("inf")).alias("infinite"), F.when(v.isNotNull(), F.isnan(v)).alias("is_nan"), v.isNull().alias("missing"))


@query("prj03_signed_absmax", """
select l_orderkey, l_linenumber, case when abs(b) > abs(a) and abs(b) >= abs(c) then b when abs(c) > abs(a) and abs(c) > abs(b) then c else a end as strongest
from (select l_orderkey, l_linenumber, l_quantity - 25 as a, -(l_extendedprice / 4000) as b, 100 * (l_discount - l_tax) as c from lineitem)
""")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.signed_absmax(F.col("l_quantity") - 25, -(F.col("l_extendedprice") / 4000), 100 * (F.col("l_discount") - F.col("l_tax"))).alias("strongest"))


@query("prj04_wrapped_angle", """
select o_orderkey, abs(((x + 180) % 360 + 360) % 360 - 180) as angle from (select o_orderkey, (o_orderkey * 37 % 720) - (o_custkey * 91 % 720) as x from orders)
""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.wrapped_angle(F.col("o_orderkey") * 37 % 720, F.col("o_custkey") * 91 % 720).alias("angle"))


@query("prj05_column_template", """
select p_partkey, lead, 'amp_' || lead || '_' || lower(split_part(p_type, ' ', 1)) as column_name from part, unnest(['I', 'II', 'V1']) as u(lead)
""")
def _(spark, d):
    leads = F.explode(F.split(F.lit("I|II|V1"), "\\|")).alias("lead")
    return table(spark, d, "part").select("p_partkey", "p_type", leads).select("p_partkey", "lead", F.concat(F.lit("amp_"), F.col("lead"), F.lit("_"), F.lower(F.substring_index("p_type", " ", 1))).alias("column_name"))


@query("prj06_aggregation_kinds", """
select l_orderkey, l_linenumber, l_quantity as global_value, case when abs(l_tax) > abs(l_discount) then l_tax else l_discount end as lead_absmax, l_extendedprice * (1 - l_discount) as derived from lineitem
""")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("global_value"), fn.signed_absmax("l_discount", "l_tax").alias("lead_absmax"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("derived"))


@query("prj07_label_flags", """
select p_partkey, (list_has_any(t, ['STEEL', 'BRASS']))::int as metal, (list_has_any(t, ['TIN', 'COPPER', 'NICKEL']))::int as soft
from (select p_partkey, list_filter(regexp_split_to_array(upper(p_type), '[^A-Z0-9]+'), lambda x: x <> '') as t from part)
""")
def _(spark, d):
    t = fn.token_set("p_type")
    flag = lambda *w: F.arrays_overlap(t, F.array(*map(F.lit, w))).cast("int")
    return table(spark, d, "part").select("p_partkey", flag("STEEL", "BRASS").alias("metal"), flag("TIN", "COPPER", "NICKEL").alias("soft"))


@query("prj08_derived_measurements", """
select l_orderkey, l_linenumber, round(60000.0 / rr, 6) as rate, round(qt / sqrt(rr / 1000), 6) as qtc_root, round(qt / pow(rr / 1000, 1.0 / 3), 6) as qtc_cube, round(qt + 0.154 * (1000 - rr), 6) as qtc_linear
from (select l_orderkey, l_linenumber, case when l_extendedprice / 50 > 300 then l_extendedprice / 50 end as rr, 300 + l_quantity as qt from lineitem)
""")
def _(spark, d):
    rr, qt = F.col("rr"), F.col("qt")
    base = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_extendedprice") / 50 > 300, F.col("l_extendedprice") / 50).alias("rr"), (300 + F.col("l_quantity")).alias("qt"))
    return base.select("l_orderkey", "l_linenumber", F.round(60000.0 / rr, 6).alias("rate"), F.round(qt / F.sqrt(rr / 1000), 6).alias("qtc_root"), F.round(qt / F.pow(rr / 1000, F.lit(1.0 / 3)), 6).alias("qtc_cube"), F.round(qt + 0.154 * (1000 - rr), 6).alias("qtc_linear"))


@query("prj09_plausible_ranges", """
select concept, count(*) as n, sum((v between low and high)::int)::bigint as plausible
from (select 'quantity' as concept, l_quantity as v from lineitem union all select 'discount', l_discount from lineitem) join (values ('quantity', 5.0::double, 45.0::double), ('discount', 0.01::double, 0.08::double)) r(concept, low, high) using (concept) group by concept
""")
def _(spark, d):
    ranges = spark.createDataFrame([("quantity", 5.0, 45.0), ("discount", 0.01, 0.08)], "concept string, low double, high double")
    long = table(spark, d, "lineitem").select(F.explode(F.create_map(F.lit("quantity"), "l_quantity", F.lit("discount"), "l_discount")).alias("concept", "v"))
    return long.join(F.broadcast(ranges), "concept").groupBy("concept").agg(F.count("*").alias("n"), F.count_if(F.col("v").between(F.col("low"), F.col("high"))).alias("plausible"))


@query("prj10_range_of_size", "select c_custkey, abs(c_acctbal) between 100 and 900 as by_size, c_acctbal between 100 and 900 as by_value from customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.in_range("c_acctbal", 100, 900, size=True).alias("by_size"), fn.in_range("c_acctbal", 100, 900).alias("by_value"))


@query("prj11_code_prefix", "select p_partkey, (starts_with(upper(replace(p_brand, '#', '.')), 'BRAND.1') or starts_with(upper(replace(replace(p_brand, '#', '.'), '.', '')), 'BRAND2'))::boolean as positive from part")
def _(spark, d):
    code = F.replace(F.col("p_brand"), F.lit("#"), F.lit("."))
    return table(spark, d, "part").select("p_partkey", fn.has_prefix(code, "BRAND1", "BRAND2").alias("positive"))


@query("prj12_rule_classes", """
select p_partkey, case when p_type like '%BRASS' then 'brass' when p_size >= 40 then 'large' when p_retailprice < 1000 then 'cheap' else 'other' end as class from part
""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.ladder((F.col("p_type").endswith("BRASS"), "brass"), (F.col("p_size") >= 40, "large"), (F.col("p_retailprice") < 1000, "cheap"), otherwise="other").alias("class"))


@query("prj13_required_columns", """
select n_nationkey, len(list_filter(['A', 'N'], lambda x: not list_contains(regexp_split_to_array(upper(n_name), ''), x))) = 0 as eligible from nation
""")
def _(spark, d):
    have = F.split(F.upper("n_name"), "")
    return table(spark, d, "nation").select("n_nationkey", (F.size(F.array_except(F.array(F.lit("A"), F.lit("N")), have)) == 0).alias("eligible"))


@query("prj15_record_id", "select o_orderkey, regexp_replace(o_orderpriority, '^[^-]*-', '') as plain, regexp_replace('study:' || o_orderkey::varchar, '^[^:]*:', '') as record from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.regexp_replace("o_orderpriority", "^[^-]*-", "").alias("plain"), fn.after_colon(F.concat(F.lit("study:"), F.col("o_orderkey").cast("string"))).alias("record"))


@query("prj16_record_name", "select o_orderkey, 'HR' || case when length(o_orderkey::varchar) >= 5 then o_orderkey::varchar else lpad(o_orderkey::varchar, 5, '0') end as name from orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.record_name("o_orderkey").alias("name"))


@query("prj17_canonical_names", """
select n_nationkey, coalesce(a.alias, lower(trim(replace(n_name, ' ', '_')))) as name from nation left join (values ('united_states', 'us'), ('united_kingdom', 'uk')) a(long_name, alias) on a.long_name = lower(trim(replace(n_name, ' ', '_')))
""")
def _(spark, d):
    name = F.lower(F.trim(F.replace(F.col("n_name"), F.lit(" "), F.lit("_"))))
    alias = F.element_at(F.create_map(*map(F.lit, ("united_states", "us", "united_kingdom", "uk"))), name)
    return table(spark, d, "nation").select("n_nationkey", F.coalesce(alias, name).alias("name"))


@query("prj18_token_set", "select p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(upper(p_name || '/' || p_type), '[^A-Z0-9]+'), lambda x: x <> ''))), ' ') as tokens from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(fn.token_set(F.concat("p_name", F.lit("/"), "p_type")), " ").alias("tokens"))


@query("prj19_code_list", """
select c_custkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(translate(raw, ',', ';'), ';'), lambda x: trim(x)), lambda y: y <> ''))), '|') as codes
from (select c_custkey, (c_custkey % 7)::varchar || ', ' || (c_custkey % 3)::varchar || ';;' || (c_custkey % 7)::varchar as raw from customer)
""")
def _(spark, d):
    k = F.col("c_custkey")
    raw = F.concat((k % 7).cast("string"), F.lit(", "), (k % 3).cast("string"), F.lit(";;"), (k % 7).cast("string"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(fn.code_list(raw), "|").alias("codes"))


@query("prj20_literal_list", "select event_id, array_to_string(regexp_extract_all(props, '[0-9]+'), ',') as numbers from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(F.regexp_extract_all("props", F.lit("[0-9]+"), 0), ",").alias("numbers"))


@query("prj21_complete_rows", "select o_orderkey, (o_totalprice is not null and case when o_orderkey % 4 = 0 then null else o_custkey end is not null) as complete from orders")
def _(spark, d):
    some = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey")).cast("double")
    return table(spark, d, "orders").select("o_orderkey", fn.all_filled(F.col("o_totalprice"), some).alias("complete"))


@query("prj23_status_ladder", """
select user_id, n, round(share, 8) as share, case when n < 20 then 'not_assessable' when share >= 0.25 then 'pass' when share >= 0.15 then 'borderline' else 'fail' end as status
from (select user_id, count(*) as n, sum((event_type = 'click')::int)::bigint / count(*)::double as share from events group by user_id)
""")
def _(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.count_if(F.col("event_type") == "click") / F.count("*")).alias("share"))
    return per.withColumn("status", fn.ladder((F.col("n") < 20, "not_assessable"), (F.col("share") >= 0.25, "pass"), (F.col("share") >= 0.15, "borderline"), otherwise="fail")).withColumn("share", F.round("share", 8))


@query("prj24_family_gate", """
with s as (select o_orderpriority as family, o_orderstatus as status, count(*) as n from orders group by all),
f as (select family, sum(case when status = 'F' then n else 0 end)::bigint as failed, sum(case when status = 'O' then n else 0 end)::bigint as passed from s group by family)
select family, failed, passed, case when failed = 0 and passed > 0 then 'pass' when passed > failed then 'mixed' else 'fail' end as gate from f
""")
def _(spark, d):
    f = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("family")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("failed"), F.count_if(F.col("o_orderstatus") == "O").alias("passed"))
    return f.withColumn("gate", fn.ladder(((F.col("failed") == 0) & (F.col("passed") > 0), "pass"), (F.col("passed") > F.col("failed"), "mixed"), otherwise="fail"))


@query("prj30_safe_ratio", "select l_orderkey, l_linenumber, case when abs(l_discount) > 1e-12 then l_tax / l_discount end as ratio from lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.ratio("l_tax", "l_discount").alias("ratio"))


@query("prj31_sigmoid", "select event_id, round(1 / (1 + exp(-greatest(least(value - 50, 50), -50))), 10) as p from events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(fn.sigmoid(F.col("value") - 50), 10).alias("p"))


@query("prj32_off_target_forms", """
select l_orderkey, l_linenumber, round(l_tax / (l_discount + 0.000001), 4) as plain, round(l_tax / (l_discount + 0.05), 8) as wide, round(l_tax / greatest(abs(l_discount), 0.00000001), 1) as floored, round(l_tax / (abs(l_discount) + 0.01), 8) as sized from lineitem
""")
def _(spark, d):
    f = lambda form, eps: fn.off_target_index("l_tax", "l_discount", form, eps)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(f("plain", 1e-6), 4).alias("plain"), F.round(f("plain", 0.05), 8).alias("wide"), F.round(f("floor", 1e-8), 1).alias("floored"), F.round(f("size", 0.01), 8).alias("sized"))


@query("prj33_depth_layers", "select n_nationkey, q, floor(q * (n_nationkey + 12 - 1) + 0.5)::int as layer from nation, unnest([0.0, 0.25, 0.5, 0.75, 1.0]::double[]) as u(q)")
def _(spark, d):
    q = F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q")
    return table(spark, d, "nation").select("n_nationkey", q).withColumn("layer", fn.half_up_layer("q", F.col("n_nationkey") + 12))


@query("prj34_capacity_arms", "select p_partkey, greatest(1, round_even(p_size / 8.0, 0))::int as k_width, greatest(1, round_even(p_size * 4 / 64.0, 0))::int as k_code from part")
def _(spark, d):
    arm = lambda x: F.greatest(F.lit(1), F.bround(x).cast("int"))
    return table(spark, d, "part").select("p_partkey", arm(F.col("p_size") / 8).alias("k_width"), arm(F.col("p_size") * 4 / 64).alias("k_code"))


@query("prj35_error_class", "select event_type, count(*) as n from (select split_part(event_type || ': at ' || user_id::varchar, ':', 1) as event_type from events) group by event_type")
def _(spark, d):
    err = F.concat("event_type", F.lit(": at "), F.col("user_id").cast("string"))
    return table(spark, d, "events").groupBy(fn.before_colon(err).alias("event_type")).agg(F.count("*").alias("n"))


@query("prj37_status_precedence", """
select o_custkey, case when bool_or(o_orderstatus = 'F') and bool_or(o_orderstatus = 'O') then 'partial' when bool_and(o_orderstatus = 'F') then 'done' when bool_and(o_orderstatus = 'O') then 'open' else 'other' end as status from orders group by o_custkey
""")
def _(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy("o_custkey").agg(fn.ladder((F.bool_or(s == "F") & F.bool_or(s == "O"), "partial"), (F.bool_and(s == "F"), "done"), (F.bool_and(s == "O"), "open"), otherwise="other").alias("status"))


@query("prj38_three_valued_label", "select p_partkey, case when p_type like '%STEEL' then 1 when p_type like 'PROMO%' then null else 0 end as label from part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", fn.three_valued(F.col("p_type").endswith("STEEL"), F.col("p_type").startswith("PROMO")).alias("label"))


@query("prj39_text_flags", "select o_orderkey, lower(trim(f)) in ('true', '1', 'yes') as flag from (select o_orderkey, case o_orderkey % 5 when 0 then ' TRUE ' when 1 then '1' when 2 then 'no' when 3 then 'Yes' else '' end as f from orders)")
def _(spark, d):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, " TRUE ").when(k == 1, "1").when(k == 2, "no").when(k == 3, "Yes").otherwise("")
    return table(spark, d, "orders").select("o_orderkey", fn.parse_flag(text).alias("flag"))


@query("prj40_target_kind", """
select concept, case when count(distinct v) <= 2 and bool_and(v in (0, 1)) then 'binary' else 'continuous' end as kind
from (select 'is_return' as concept, (l_returnflag = 'R')::int::double as v from lineitem union all select 'quantity', l_quantity from lineitem) group by concept
""")
def _(spark, d):
    long = table(spark, d, "lineitem").select(F.explode(F.create_map(F.lit("is_return"), (F.col("l_returnflag") == "R").cast("int").cast("double"), F.lit("quantity"), F.col("l_quantity"))).alias("concept", "v"))
    return long.groupBy("concept").agg(F.when((F.countDistinct("v") <= 2) & F.bool_and(F.col("v").isin(0, 1)), "binary").otherwise("continuous").alias("kind"))


@query("prj41_median_binarised", """
with m as (select quantile_cont(value, 0.5) as t from events where user_id % 2 = 0) select event_id, (value >= t)::int as high from events, m
""")
def _(spark, d):
    e = table(spark, d, "events")
    m = e.where("user_id % 2 = 0").agg(F.percentile("value", F.lit(0.5)).alias("t"))
    return e.crossJoin(F.broadcast(m)).select("event_id", (F.col("value") >= F.col("t")).cast("int").alias("high"))


@query("prj42_risk_label", """
select c_custkey, case when c_acctbal < 0 and c_mktsegment = 'BUILDING' then 'debt+building' when c_acctbal < 0 then 'debt' when c_mktsegment = 'BUILDING' then 'building' else 'low' end as risk from customer
""")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.joined_reasons((F.col("c_acctbal") < 0, "debt"), (F.col("c_mktsegment") == "BUILDING", "building")).alias("risk"))


@query("prj43_number_in_name", "select s_suppkey, nullif(regexp_extract(s_name, '([0-9]+)', 1), '')::int as number from supplier")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.nullif(F.regexp_extract("s_name", "([0-9]+)", 1), F.lit("")).cast("int").alias("number"))


@query("prj45_attenuation", """
select l_orderkey, l_linenumber, round(abs(a) - abs(a - b), 10) as attenuation, sign(a) = sign(b) as concordant from (select l_orderkey, l_linenumber, l_discount - 0.055 as a, l_tax - 0.045 as b from lineitem)
""")
def _(spark, d):
    b = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") - 0.055).alias("a"), (F.col("l_tax") - 0.045).alias("b"))
    return b.select("l_orderkey", "l_linenumber", F.round(fn.attenuation("a", "b"), 10).alias("attenuation"), (F.signum("a") == F.signum("b")).alias("concordant"))


# Hash splits

_HEX = "('0x' || substr({}, 1, {}))::ubigint"


@query("hsh01_split_fraction", f"""
select o_orderkey, case when f < 0.70 then 'train' when f < 0.85 then 'val' else 'test' end as split from (select o_orderkey, {_HEX.format("sha256('0:' || o_orderkey::varchar)", 8)}::double / 4294967295.0::double as f from orders)
""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.split_by_fraction("o_orderkey").alias("split"))


@query("hsh02_split_tenths", f"""
select o_orderkey, case when b < 7 then 'train' when b < 8 then 'val' else 'test' end as split from (select o_orderkey, {_HEX.format("sha256('external-head-v1:' || o_orderkey::varchar)", 16)} % 10 as b from orders)
""")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fn.split_by_tenths("o_orderkey").alias("split"))


def _hundred(digest: str, n: int) -> str:
    """A long hexadecimal number modulo 100, in pieces of 8 digits (2^32 is 96 modulo 100)."""
    out = "0"
    for i in range(0, n, 8):
        out = f"(({out}) * 96 + ('0x' || substr({digest}, {i + 1}, 8))::ubigint % 100) % 100"
    return out


@query("hsh03_split_sha1", f"select c_custkey, case when b < 70 then 'train' when b < 80 then 'val' else 'test' end as split from (select c_custkey, {_hundred('h', 40)} as b from (select c_custkey, sha1('closure::' || c_custkey::varchar) as h from customer))")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.split_sha1("c_custkey", "closure::").alias("split"))


@query("hsh04_split_md5", f"select c_custkey, case when b < 70 then 'train' when b < 80 then 'val' else 'test' end as split from (select c_custkey, {_hundred('h', 32)} as b from (select c_custkey, md5(c_custkey::varchar) as h from customer))")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", fn.split_md5("c_custkey").alias("split"))


@query("hsh06_ordered_manifest", "select n_regionkey, sha256(string_agg(n_nationkey::varchar || chr(9) || n_name, chr(10) order by n_nationkey)) as manifest from nation group by n_regionkey")
def _(spark, d):
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit("\t"), F.col("n_name"))
    from ..operators.relational import ordered_manifest

    return ordered_manifest(table(spark, d, "nation"), "n_regionkey", line, "n_nationkey", whole=True)


@query("hsh07_cluster_hash", "select c, n, sha256(c::varchar || ':' || n::varchar) as id from (select o_custkey as c, count(*) as n from orders group by o_custkey)")
def _(spark, d):
    from ..operators.relational import cluster_hash

    return cluster_hash(table(spark, d, "orders").select(F.col("o_custkey").alias("c")), "c")


@query("hsh12_stratified_subset", """
with r as (select o_orderkey, o_orderstatus, row_number() over (partition by o_orderstatus order by sha256(o_orderkey::varchar)) as i from orders),
kept as (select o_orderkey, o_orderstatus from r where i <= 20), filler as (select o_orderkey, o_orderstatus from orders where o_orderkey not in (select o_orderkey from kept) order by sha256(o_orderkey::varchar) limit 40)
select * from kept union all select * from filler
""")
def _(spark, d):
    from ..operators.relational import stratified_subset

    return stratified_subset(table(spark, d, "orders"), "o_orderkey", "o_orderstatus", 20, 40)