"""Fitting sparse codes over the driver's tables: a whole batch's codes, and one step from a stated start."""

from pyspark.sql import functions as F

from ..operators import probes as pr
from ..operators import sparse
from . import query, table

# Sixteen atoms of equal length with signs by hash, as encoder and as atoms; no offsets, no standardisation.
_ATOMS = "(select atom, list(x order by j) as a from (select atom, j, case when substr(md5('5:' || atom::varchar || ':' || j::varchar), 1, 1) in ('8', '9', 'a', 'b', 'c', 'd', 'e', 'f') then 0.125 else -0.125 end::double as x from range(0, 16) t(atom), range(0, 64) u(j)) group by atom)"
_KEPT = f"(select * from (select *, row_number() over (order by c desc, vec_id, atom) as place from (select vec_id, embedding::double[] as e, atom, a, list_dot_product(embedding::double[], a) as c from embeddings, {_ATOMS})) where c > 0 and place <= 2 * (select count(*) from embeddings))"


def _stated() -> sparse.Parameters:
    p = sparse.Parameters.start(16, 64)
    p.atoms = pr.Dictionary.random(16, 64, 2, 5).atoms
    p.encoder = p.atoms.copy()
    return p


@query("mod12_batch_codes", f"select vec_id, atom::int as atom, round(c, 8) as code from {_KEPT}")
def _(spark, d):
    codes = sparse.batch_codes(table(spark, d, "embeddings"), "vec_id", "embedding", _stated(), 2)
    return codes.select("vec_id", F.posexplode("codes").alias("atom", "c")).where("c > 0").select("vec_id", "atom", F.round("c", 8).alias("code"))


@query("mod13_sparse_step", f"""
with k as {_KEPT}, size as (select count(*) * 64.0::double as s from embeddings),
x as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as x from embeddings),
y as (select vec_id, i, sum(c * w) as y from (select vec_id, c, generate_subscripts(a, 1) as i, unnest(a) as w from k) group by all),
g as (select vec_id, i, x, x - coalesce(y, 0) as r, -2 * (x - coalesce(y, 0)) / s as g from x left join y using (vec_id, i), size),
d as (select k.atom, i, k.a[i] as w, sum(c * g) as gd from k join g using (vec_id) group by all),
q as (select atom, i, w, gd, gd - w * sum(gd * w) over (partition by atom) as pd from d),
m as (select atom, sum(w * n) / sqrt(sum(n * n)) as kept, sqrt(sum(gd * gd)) as atom_slope from (select *, w - 0.01 * pd / (abs(pd) + 1e-8) as n from q) group by atom),
b as (select vec_id, k.atom, sum(g * k.a[i]) as back from k join g using (vec_id) group by all),
e as (select atom, sqrt(sum(ge * ge)) as encoder_slope from (select atom, i, sum(back * x) as ge from b join g using (vec_id) group by all) group by atom)
select k.atom::int as atom, count(*) as fired, round(any_value(atom_slope), 9) as atom_slope, round(any_value(encoder_slope), 9) as encoder_slope, round(any_value(kept), 7) as kept, (select round(sum(r * r) / any_value(s), 9) from g, size) as loss
from k join m using (atom) join e using (atom) group by k.atom
""")
def _(spark, d):
    """Of each atom that fires: how often, the lengths of its gradients, its cosine with itself after the step; and the loss."""
    import numpy as np

    e = table(spark, d, "embeddings")
    rows, n = sparse.Rows(e, "vec_id", "embedding", e.count(), 16, 0).batch(0)
    fit = sparse.SparseFit(16, 2, rate=0.01)
    fit.parameters = _stated()
    loss, _, g, fired = fit.gradient(spark, rows, n)
    before, slopes = fit.parameters.atoms, {k: np.linalg.norm(g[k], axis=1) for k in ("atoms", "encoder")}
    fit.adam.update(fit.parameters, g)
    kept = (before * fit.parameters.atoms).sum(1)
    out = [(i, int(fired[i]), *(round(float(x), k) for x, k in ((slopes["atoms"][i], 9), (slopes["encoder"][i], 9), (kept[i], 7), (loss, 9)))) for i in np.flatnonzero(fired).tolist()]
    return spark.createDataFrame(out, "atom int, fired long, atom_slope double, encoder_slope double, kept double, loss double")


@query("mod13_sparse_fit")
def _(spark, d):
    """Three passes over all rows in batches: the loss of each step."""
    e = table(spark, d, "embeddings")
    fit = sparse.SparseFit(32, 4, rate=0.02, batch=max(1, e.count() // 3), slots=8).fit(e, "vec_id", "embedding", 9)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(fit.losses)], "step int, loss double")
