"""Fits of many targets, audits by erasure, directions, matched sets and signals, over the driver's tables."""

import numpy as np
from pyspark.sql import functions as F

from ..operators import heads as h
from ..operators import models
from ..operators import signals as sg
from ..operators import vectors as v
from . import query, table
from .probes import _L, _lines, _split
from .vectors import _wave

# Matched sets of directions

_HALVES = "(select side, label, list(m order by i) as a from (select vec_id % 2 as side, label, i, avg(x) as m from (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings where label < 5) group by all) group by side, label)"
_COSINES = f"(select a.label as i, b.label as j, list_cosine_similarity(a.a, b.a) as c from {_HALVES} a, {_HALVES} b where a.side = 0 and b.side = 1)"


def _best(c: str) -> str:
    return f"(select max(a.c + b.c + c.c + d.c + e.c) / 5 from k a, k b, k c, k d, k e where a.i = 0 and b.i = 1 and c.i = 2 and d.i = 3 and e.i = 4 and len(list_distinct([a.j, b.j, c.j, d.j, e.j])) = 5)".replace("k ", f"{c} ")


@query("vec10_matched_directions", f"with s as {_COSINES}, u as (select i, j, abs(c) as c from s) select round({_best('s')}, 8) as signed, round({_best('u')}, 8) as unsigned")
def _(spark, d):
    """Class means of even and of odd vectors under their best matching, by cosine and by its size."""
    long = table(spark, d, "embeddings").where("label < 5").select((F.col("vec_id") % 2).alias("side"), "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    rows = long.groupBy("side", "label", "i").agg(F.avg("x").alias("m")).orderBy("side", "label", "i").collect()
    a, b = (np.array([[r["m"] for r in rows if r["side"] == s and r["label"] == k] for k in range(5)]) for s in (0, 1))
    return spark.createDataFrame([tuple(round(models.matched_cosine(a, b, signed), 8) for signed in (True, False))], "signed double, unsigned double")


@query("mod40_functional_stability", """
with p as (select label, vec_id % 3 as s, vec_id // 6 as g, vec_id // 3 % 2 as k, embedding::double[] as e from embeddings), n as (select g, s, max(e) filter (k = 0) as a, max(e) filter (k = 1) as b from p group by all having count(*) = 2),
c as (select x.g, x.s as i, y.s as j, list_cosine_similarity(x.a, y.a) as aa, list_cosine_similarity(x.a, y.b) as ab, list_cosine_similarity(x.b, y.a) as ba, list_cosine_similarity(x.b, y.b) as bb, list_cosine_similarity(x.a, x.b) as xx, list_cosine_similarity(y.a, y.b) as yy from n x join n y on x.g = y.g and x.s < y.s),
m as (select g, i, j, greatest(aa + bb, ab + ba) / 2 as mean, case when aa + bb >= ab + ba then least(aa, bb) else least(ab, ba) end as low,
  ((aa * aa + ab * ab + ba * ba + bb * bb) - 2 * yy * (aa * ab + ba * bb) - 2 * xx * (aa * ba + ab * bb) + 2 * xx * yy * (aa * bb + ab * ba)) / ((1 - xx * xx) * (1 - yy * yy)) / 2 as over from c),
s as (select i, j, mean, low, over from m where g = 0)
select m.i as seed_i, m.j as seed_j, round(any_value(s.mean), 8) as selected_cosine, round(any_value(s.low), 8) as selected_cosine_min, round(any_value(s.over), 8) as selected_overlap, round(avg(m.mean), 8) as random_cosine, round(avg(m.over), 8) as random_overlap, round(quantile_cont(m.over, 0.95), 8) as random_overlap_q95, round((1 + count(*) filter (m.over >= s.over)) / (1 + count(*)), 8) as p, count(*) as random_groups
from m join s on m.i = s.i and m.j = s.j where m.g <> 0 group by m.i, m.j
""")
def _(spark, d):
    """Pairs of vectors as atoms, in three "seeds"; the first pair of each is the selected one, all others are its controls."""
    e = table(spark, d, "embeddings")
    k = F.col("vec_id")
    picks = e.select(F.lit("u").alias("unit"), (k % 3).alias("seed"), F.floor(k / 6).alias("g"), (F.floor(k / 3) % 2).alias("atom"), "embedding")
    # The last six may lack one; a pair that is not whole is left out, as in the other seeds.
    whole = picks.groupBy("seed", "g").agg(F.count("*").alias("n")).where("n = 2").select("seed", "g")
    s = h.functional_stability(picks.join(whole, ["seed", "g"]), ["unit"], "seed", "g", "atom", "embedding")
    return s.select("seed_i", "seed_j", *[F.round(c, 8).alias(c) for c in ("selected_cosine", "selected_cosine_min", "selected_overlap", "random_cosine", "random_overlap", "random_overlap_q95", "p")], "random_groups")


# Erasing one concept, probing the others: here SQL erases rows, where the query maps moments

_T = ("y", "c", "s")


def _without(source: str) -> str:
    """SQL of the rows without what two columns tell of ``source``, 0.001 of the mean variance added to the covariance."""
    return f"""(select f, a - ca * p as a, b - cb * p as b, y, c, s from (select l.*, ca, cb, ((a - ma) * qa + (b - mb) * qb) / (ca * qa + cb * qb) as p from {_L} l,
  (select *, (vb * ca - ab * cb) / (va * vb - ab * ab) as qa, (va * cb - ab * ca) / (va * vb - ab * ab) as qb from (select ma, mb, ab, ca, cb, aa + 0.0005 * (aa + bb) as va, bb + 0.0005 * (aa + bb) as vb from
  (select avg(a) as ma, avg(b) as mb, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, {source}) as ca, covar_pop(b, {source}) as cb from {_L} where f < 7)))))"""


def _probed(rows: str, t: str) -> str:
    """SQL of the test R² of a ridge probe with a penalty of 10 on rows' two columns, scaled by their training part."""
    return f"""(select 1 - sum(({t} - my - (a - ma) / sa * ((n + 10) * ba - n * r * bb) / det - (b - mb) / sb * ((n + 10) * bb - n * r * ba) / det) ** 2) / (var_pop({t}) * count(*)) from {rows}, (select *, (n + 10) * (n + 10) - n * r * n * r as det from
  (select n, ma, mb, my, sa, sb, case when sa * sb > 0 then cab / (sa * sb) else 0 end as r, n * cay / sa as ba, n * cby / sb as bb from (select count(*)::double as n, avg(a) as ma, avg(b) as mb, avg({t}) as my, stddev_pop(a) as sa, stddev_pop(b) as sb, covar_pop(a, b) as cab, covar_pop(a, {t}) as cay, covar_pop(b, {t}) as cby from {rows} where f < 7))) where f > 7)"""


_AUDIT = " union all ".join(f"select '{s}' as source, '{t}' as target, {_probed(_L, t)} as before, {_probed(_without(s), t)} as after" for s in ("y", "s") for t in _T)


@query("mod22_erase_and_probe", f"select source, target, round(before, 8) as r2_before, round(after, 8) as r2_after, round(before - after, 8) as drop, round(greatest(0.02, 0.35 * greatest(before, 0.04)), 8) as limit, after < greatest(0.02, 0.35 * greatest(before, 0.04)) as effective from ({_AUDIT})")
def _(spark, d):
    train, _, test = _split(_lines(spark, d))
    a, b = (v.masked_moments(x, "x", list(_T)) for x in (train, test))
    out = [(s, t, *(round(x, 8) for x in (before, after, drop, limit)), ok) for s, t, before, after, drop, limit, ok in h.erase_and_probe(a, b, ["y", "s"], alpha=10.0, ridge=1e-3)]
    return spark.createDataFrame(out, "source string, target string, r2_before double, r2_after double, drop double, limit double, effective boolean")


# Directions in several spaces, of two columns in closed form

_DIRECTIONS = f"""
with m as (select count(*)::double as n, var_pop(a) as aa, var_pop(b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as ca, covar_pop(b, y) as cb from {_L}),
r as (select *, sqrt(aa) as sa, sqrt(bb) as sb, n * ab / sqrt(aa * bb) as nr, n * ca / sqrt(aa) as ba, n * cb / sqrt(bb) as bc, aa + 0.05 * (aa + bb) as va, bb + 0.05 * (aa + bb) as vb from m),
w as (select *, ((n + 10) * ba - nr * bc) as w1, ((n + 10) * bc - nr * ba) as w2, sqrt(va * vb - ab * ab) as det, sqrt(va + vb + 2 * sqrt(va * vb - ab * ab)) as t from r),
x as (select *, ((vb + det) * ca - ab * cb) as u1, ((va + det) * cb - ab * ca) as u2 from w),
d as (select 'probe_standardised' as direction, w1 as p, w2 as q from x union all select 'probe_raw', w1 / sa, w2 / sb from x union all select 'erased_whitened', u1, u2 from x union all select 'erased_raw', ca, cb from x union all select 'erased_code', ca / 2, cb / 3 from x)
select direction, round(p / sqrt(p * p + q * q), 8) as a, round(q / sqrt(p * p + q * q), 8) as b from d
"""


@query("mod43_four_spaces", _DIRECTIONS)
def _(spark, d):
    m = v.moments(_lines(spark, d), "x", ["y"])
    got = h.concept_directions(m, 10.0, 0.1, np.array([2.0, 3.0]))
    return spark.createDataFrame([(k, *(round(float(x), 8) for x in u)) for k, u in got.items()], "direction string, a double, b double")


# Logistic heads: one feature and an intercept, by Newton steps in SQL


def _newton(rows: str, keys: str, steps: int, c: float, balanced: bool, both: bool) -> str:
    """SQL of (keys, w0, w1) that fit y on x by ``steps`` Newton steps; ``both``: the intercept is penalised, too."""
    weight = "case when y = 1 then n / (2 * p) else n / (2 * (n - p)) end" if balanced else "1.0::double"
    k = f"{keys}, " if keys else ""
    on = f" using ({keys})" if keys else " on true"
    group = f" group by {keys}" if keys else ""
    pen = 1 if both else 0
    out = f"(select {k}0.0::double as w0, 0.0::double as w1 from {rows}{group or ' limit 1'})"
    base = f"(select r.*, {weight} as cw from {rows} r join (select {k}count(*)::double as n, sum(y)::double as p from {rows}{group}){on})"
    ctes = [f"base as materialized {base}", f"w_0 as {out}"]
    for i in range(steps):
        ctes.append(f"""w_{i + 1} as (select {k}w0 - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) as w0, w1 - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) as w1 from (
  select {k}any_value(w0) as w0, any_value(w1) as w1, {c} * sum(cw * (q - y)) + {pen} * any_value(w0) as g0, {c} * sum(cw * (q - y) * x) + any_value(w1) as g1, {c} * sum(cw * q * (1 - q)) + {pen} as h00, {c} * sum(cw * q * (1 - q) * x) as h01, {c} * sum(cw * q * (1 - q) * x * x) + 1 as h11
  from (select base.*, w0, w1, 1 / (1 + exp(-(w0 + w1 * x))) as q from base join w_{i}{on}){group}))""")
    return f"(with {', '.join(ctes)} select * from w_{steps})"


_ONE = "(select l_quantity / 50 as x, {} as y from lineitem)"
_Y = {"returned": "(l_returnflag = 'R')::int", "high": "(l_discount > 0.07)::int", "long": "(l_quantity + l_tax * 200 > 34)::int"}


@query("mod44_logistic_heads", " union all ".join(f"select '{t}' as target, {c}::double as strength, round(w0, 5) as intercept, round(w1, 5) as weight from {_newton(_ONE.format(y), '', 9, c, True, False)}" for t, y in _Y.items() for c in (0.01, 1.0)))
def _(spark, d):
    """Three targets at two strengths, all in one scan a step."""
    li = table(spark, d, "lineitem").select(F.array(F.col("l_quantity") / 50).alias("x"), *[F.expr(y.replace("::int", "")).cast("double").alias(t) for t, y in _Y.items()])
    fits = h.LogisticFits((0.01, 1.0)).fit(li, "x", list(_Y))
    return spark.createDataFrame([(t, c, *(round(float(x), 5) for x in fits.of(t, c))) for t in _Y for c in (0.01, 1.0)], "target string, strength double, intercept double, weight double")


_CARS = "(select o_orderkey, o_orderpriority as g, (o_orderstatus = 'F')::int as y, (o_totalprice - avg(o_totalprice) over (partition by o_orderpriority)) / stddev_pop(o_totalprice) over (partition by o_orderpriority) as x from orders)"


@query("sta42_fitted_propensity", f"""
with p as (select o_orderkey, r.g, y, 1 / (1 + exp(-(w0 + w1 * x))) as p from {_CARS} r join {_newton(_CARS, 'g', 8, 1.0, False, True)} w on r.g = w.g),
q as (select *, avg(y) over (partition by g) / greatest(least(p, 0.98), 0.02) as w from p), e as (select g, quantile_cont(w, 0.01) as lo, quantile_cont(w, 0.99) as hi from q where y = 1 group by g)
select o_orderkey, round(p, 6) as selection_probability, case when y = 1 then round(greatest(least(w, hi), lo), 5) end as stabilized_ipw from q join e on q.g = e.g
""")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").alias("ok"), "o_totalprice")
    rows, _ = h.fitted_propensity(o, "o_orderkey", ["o_orderpriority"], "ok", ["o_totalprice"])
    return rows.select("o_orderkey", F.round("selection_probability", 6).alias("selection_probability"), F.round("stabilized_ipw", 5).alias("stabilized_ipw"))


@query("mod05_shuffled_controls")
def _(spark, d):
    """A probe's R² beside those of a hundred permuted targets and of noise."""
    train, val, _ = _split(_lines(spark, d).withColumn("k", F.col("l_orderkey") * 8 + F.col("l_linenumber")))
    got = h.probe_with_controls(train, val, "k", "x", "y", 10.0)
    rows = [("true", 0, got["r2"]), *(("shuffled", i, r) for i, r in enumerate(got["shuffled"])), *(("gaussian", i, r) for i, r in enumerate(got["gaussian"]))]
    return spark.createDataFrame([(k, i, float(r)) for k, i, r in rows], "kind string, i int, r2 double")


# The first component of a spectrum that falls, in SQL by squaring the covariance

_FALLING = "(select vec_id, i, x / i as x from (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings))"


@query("mod15_first_component", f"""
with recursive c as (select a.i as i, b.i as j, covar_pop(a.x, b.x) as v from {_FALLING} a join {_FALLING} b using (vec_id) group by all),
n as (select i, j, v / sum(v) filter (i = j) over () as v from c),
p as (select 0 as k, i, j, v from n union all select k + 1, i, j, v / sum(v) filter (i = j) over () from (select a.k, a.i, b.j, sum(a.v * b.v) as v from p a join p b on a.j = b.i and a.k = b.k where a.k < 9 group by all)),
u as (select i, v / sqrt(sum(v * v) over ()) as v from p where k = 9 and j = (select i from p where k = 9 and i = j order by v desc limit 1)),
s as (select i, v * sign(first_value(v) over (order by abs(v) desc)) as v from u)
select (i - 1)::int as i, round(v, 6) as loading, (select round(sum(a.v * c.v * b.v), 8) from s a join c on a.i = c.i join s b on b.i = c.j) as variance from s
""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x / (i + 1)).alias("v"))
    rows, values = h.randomised_components(e, "v", 1)
    return spark.createDataFrame([(i, round(float(x), 6), round(float(values[0]), 8)) for i, x in enumerate(rows[0])], "i int, loading double, variance double")


# Signals


@query("sig05_protocol_inputs", """
with w as (select vec_id, embedding::double[] as x from embeddings), l as (select vec_id, k, list_slice(x, 4 * k + 1, 4 * k + 16) as y from w, range(0, 12) t(k)),
f as (select vec_id, case when k = 0 then 0 when k = 1 then 1 else k - 4 end as k, y from l where k in (0, 1, 6, 7, 8, 9, 10, 11)),
r as (select a.vec_id, d.k, list_transform(range(1, 17), lambda i: case d.k when 2 then b.y[i] - a.y[i] when 3 then -(a.y[i] + b.y[i]) / 2 when 4 then a.y[i] - b.y[i] / 2 else b.y[i] - a.y[i] / 2 end) as y from l a join l b on a.vec_id = b.vec_id and a.k = 0 and b.k = 1, range(2, 6) d(k)),
v as (select vec_id, 'eight' as interface, p as protocol, k, y from f, unnest(['native', 'lead', 'temporal', 'joint']) u(p) union all select vec_id, 'twelve', p, k, y from l, unnest(['native', 'temporal']) u(p)
  union all select vec_id, 'twelve', p, k, y from (select * from r union all select * from l where k in (0, 1, 6, 7, 8, 9, 10, 11)), unnest(['lead', 'joint']) u(p))
select vec_id, interface, protocol, k::int as lead, round((y[5] - list_avg(y)) / greatest(list_stddev_pop(y), 1e-6), 7) as fifth from v
""")
def _(spark, d):
    """Twelve overlapping stretches of a vector as a record's leads; interfaces of its own length."""
    x = F.col("embedding").cast("array<double>")
    # The last stretches are shorter in the vector than in the record: they are cut to the same sixteen.
    records = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.slice(x, 4 * k + 1, 16)).alias("record"))
    faces = spark.createDataFrame([("eight", 8, 16, False, False), ("twelve", 12, 16, False, False)], "interface string, leads int, samples int, crop boolean, flatten boolean")
    got = sg.model_inputs(records, "record", faces, canonical=16)
    return got.select("vec_id", "interface", "protocol", F.posexplode("input").alias("lead", "v")).select("vec_id", "interface", "protocol", "lead", F.round(F.col("v")[4], 7).alias("fifth"))


@query("sig06_landmarks")
def _(spark, d):
    """Peaks and wave limits of each user's values in order, as if sampled ten times a second."""
    return sg.landmarks(_wave(spark, d), "signal", 10.0).drop("signal")


@query("sig07_landmark_warp", """
with a as (select vec_id, embedding::double[] as x, [0.0, 9.0 + vec_id % 5, 30.0 - vec_id % 3, 50.0, 63.0]::double[] as p, [0.0, 12.0, 28.0, 50.0 + vec_id % 4, 63.0]::double[] as q from embeddings),
j as (select vec_id, x, i, (select max(k) from range(1, 5) t(k) where p[k] <= i) as k, p, q from a, range(0, 64) r(i)),
s as (select vec_id, x, i, q[k] + (i - p[k]) / (p[k + 1] - p[k]) * (q[k + 1] - q[k]) as src from j), f as (select *, least(floor(src), 62)::int as lo from s)
select vec_id, i::int as i, round(x[lo + 1] * (1 - (src - lo)) + x[lo + 2] * (src - lo), 8) as y from f
""")
def _(spark, d):
    """Vectors as signals, each warped by anchors of its own."""
    k = F.col("vec_id")
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.array(9.0 + k % 5, 30.0 - k % 3, F.lit(50.0)).alias("new"), F.array(F.lit(12.0), F.lit(28.0), 50.0 + k % 4).alias("old"))
    w = sg.warp_by_landmarks(e, "embedding", "new", "old")
    return w.select("vec_id", F.posexplode("warped").alias("i", "y")).select("vec_id", "i", F.round("y", 8).alias("y"))
