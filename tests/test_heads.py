"""Fits of many targets in one pass against numpy and Spark's own: heads, propensities, controls, audits, directions, components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.operators import heads, models, probes
from veriscope.operators import vectors as v
from veriscope.operators.audit import Rejected


def rows(n=600, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) @ np.diag([1, 2, 0.5, 3][:d]) + 1
    y = x @ [0.5, -1, 2, 0.1][:d] + rng.normal(size=n)
    return x, y, (y + rng.normal(size=n) > 1).astype(float), (x[:, 0] > 1.4).astype(float)


def frame(spark, x, **columns):
    names = list(columns)
    f = lambda c: None if c is None or isinstance(c, float) and np.isnan(c) else (float(c) if not isinstance(c, str) else c)
    data = [(i, [float(z) for z in r], *(f(columns[k][i]) for k in names)) for i, r in enumerate(x)]
    kinds = ", ".join(f"{k} {'string' if isinstance(columns[k][0], str) else 'double'}" for k in names)
    return spark.createDataFrame(data, "id long, x array<double>" + (", " + kinds if names else "")).repartition(4)


def plain_logistic(x, y, c, balanced=True, free=True):
    w, a = np.zeros(x.shape[1] + 1), np.column_stack([np.ones(len(x)), x])
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    weight = (len(y) / (2 * n))[y.astype(int)] if balanced else np.ones(len(y))
    pen = np.ones(len(w))
    pen[0] = 0.0 if free else 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve(c * (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pen), c * a.T @ (weight * (p - y)) + pen * w)
    return w


def test_logistic_fits(spark):
    x, _, s, t = rows()
    t[:50] = np.nan
    df = frame(spark, x, s=s, t=t)
    fits = heads.LogisticFits((0.01, 1.0, 10.0)).fit(df, "x", ["s", "t"])
    for c in (0.01, 1.0, 10.0):
        assert np.allclose(fits.of("s", c), plain_logistic(x, s, c), atol=1e-7)
        assert np.allclose(fits.of("t", c), plain_logistic(x[50:], t[50:], c), atol=1e-6)
    # One scan a step for all six fits, and one to count.
    assert fits.scans <= 40
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n, p = len(s), s.sum()
    own = df.select(array_to_vector("x").alias("features"), F.col("s").alias("label"), F.when(F.col("s") == 1, n / (2 * p)).otherwise(n / (2 * (n - p))).alias("w"))
    ml = LogisticRegression(regParam=1 / n, weightCol="w", standardization=False, maxIter=500, tol=1e-12).fit(own)
    assert np.allclose(fits.of("s", 1.0), np.append(ml.intercept, ml.coefficients.toArray()), atol=1e-6)


def test_logistic_one_class_and_separable(spark):
    x, _, _, _ = rows(80)
    df = frame(spark, x, one=np.ones(80), apart=(x[:, 0] > 1).astype(float))
    fits = heads.LogisticFits((10.0,)).fit(df, "x", ["one", "apart"])
    assert fits.skipped == [(0, "one", -1)] and np.allclose(fits.of("apart"), plain_logistic(x, (x[:, 0] > 1).astype(float), 10.0), atol=1e-5)
    with pytest.raises(Rejected):
        heads.LogisticFits().fit(df.limit(0), "x", ["one"])
    with pytest.raises(Rejected):
        heads.fit_heads(df, df, "x", [], ["one"])


def test_heads(spark):
    x, y, s, t = rows(900)
    y[:30] = np.nan
    df = frame(spark, x, y=y, s=s, t=t)
    train, val = df.where("id % 3 < 2"), df.where("id % 3 = 2")
    got = heads.fit_heads(train, val, "x", ["y"], ["s", "t"])
    i = np.arange(900)
    a, b = (i % 3 < 2) & ~np.isnan(y), (i % 3 == 2) & ~np.isnan(y)
    best = None
    for alpha in (0.1, 1.0, 10.0, 100.0, 1000.0):
        z = (x[a] - x[a].mean(0)) / x[a].std(0)
        w = np.linalg.solve(z.T @ z + alpha * np.eye(4), z.T @ (y[a] - y[a].mean()))
        p = (x[b] - x[a].mean(0)) / x[a].std(0) @ w + y[a].mean()
        r2 = 1 - ((y[b] - p) ** 2).sum() / ((y[b] - y[b].mean()) ** 2).sum()
        best = (alpha, r2) if best is None or r2 > best[1] else best
    assert got["y"][0] == best[0] and got["y"][1] == pytest.approx(best[1])
    best = None
    for c in (0.01, 0.1, 1.0, 10.0):
        w = plain_logistic(x[i % 3 < 2], s[i % 3 < 2], c)
        q = x[i % 3 == 2] @ w[1:]
        one, zero = q[s[i % 3 == 2] == 1], q[s[i % 3 == 2] == 0]
        area = (one[:, None] > zero).mean() + 0.5 * (one[:, None] == zero).mean()
        best = (c, area) if best is None or area > best[1] + 1e-12 else best
    assert got["s"][0] == best[0] and got["s"][1] == pytest.approx(best[1])


def test_propensity(spark):
    x, _, s, _ = rows(700, 2)
    g = ["a" if i % 3 else "b" for i in range(700)]
    x[5::9, 1] = np.nan
    df = frame(spark, np.zeros((700, 1)), p=x[:, 0], q=x[:, 1], s=s, g=g)
    got, told = heads.fitted_propensity(df, "id", ["g"], "s", ["p", "q"])
    got = {r["id"]: r for r in got.collect()}
    for name in "ab":
        at = np.array([i for i in range(700) if g[i] == name])
        z = np.column_stack([x[at, 0], np.where(np.isnan(x[at, 1]), np.nanmedian(x[at, 1]), x[at, 1]), np.isnan(x[at, 1])])
        sd = z.std(0)
        z = (z - z.mean(0)) / np.where(sd > 1e-12, sd, 1)
        w = plain_logistic(z, s[at], 1.0, False, False)
        p = 1 / (1 + np.exp(-(w[0] + z @ w[1:])))
        assert np.allclose([got[i]["selection_probability"] for i in at], p, atol=1e-7)
        raw = s[at].mean() / np.clip(p, 0.02, 0.98)
        raw = np.clip(raw, *np.quantile(raw[s[at] == 1], [0.01, 0.99]))
        assert all(got[i]["stabilized_ipw"] is None if not s[i] else got[i]["stabilized_ipw"] == pytest.approx(r, abs=1e-6) for i, r in zip(at, raw))
        d = told.where(F.col("g") == name).first()
        w1 = raw[s[at] == 1]
        assert d["records"] == len(at) and d["effective_size"] == pytest.approx(w1.sum() ** 2 / (w1**2).sum(), rel=1e-6) and 0.5 < d["cross_fitted_auroc"] <= 1


def test_controls(spark):
    x, y, _, _ = rows(500)
    df = frame(spark, x, y=y)
    m = heads.control_moments(df, "id", "x", "y", 100, 3, block=200)
    assert np.allclose(m.mean[4:105], y.mean()) and np.allclose(np.diag(m.covariance)[4:105], y.var())
    c = np.corrcoef(x.T, y)[4, :4]
    null = m.covariance[:4, 5:105] / np.sqrt(np.outer(np.diag(m.covariance)[:4], np.diag(m.covariance)[5:105]))
    assert abs(null.mean()) < 0.01 and null.std() == pytest.approx(1 / np.sqrt(500), rel=0.2) and np.abs(c).max() > 0.3
    assert np.allclose(heads.control_moments(df.repartition(7), "id", "x", "y", 100, 3, block=200).covariance, m.covariance)
    got = heads.probe_with_controls(df.where("id < 350"), df.where("id >= 350"), "id", "x", "y", 1.0)
    assert got["r2"] > 0.5 and max(got["shuffled"]) < 0.3 and got["p"] == 1 / 101 and len(got["gaussian"]) == 1


def test_erasing_one_probing_others(spark):
    x, y, s, t = rows(800)
    y[:100] = np.nan
    df = frame(spark, x, y=y, s=s, t=t)
    targets = ["y", "s", "t"]
    train, test = (v.masked_moments(df.where(c), "x", targets) for c in ("id % 4 < 3", "id % 4 = 3"))
    got = heads.erase_and_probe(train, test, ["s", "t"], alpha=2.0, ridge=1e-3)
    assert len(got) == 6
    values = {"y": y, "s": s, "t": t}
    i = np.arange(800)

    def r2(a, b, ya, yb):
        sd = a.std(0)
        sd = np.where(sd > 1e-8, sd, 1)
        z, q = (a - a.mean(0)) / sd, (b - a.mean(0)) / sd
        w = np.linalg.solve(z.T @ z + 2.0 * np.eye(4), z.T @ (ya - ya.mean()))
        return 1 - ((yb - q @ w - ya.mean()) ** 2).sum() / ((yb - yb.mean()) ** 2).sum()

    for source, target, before, after, drop, limit, effective in got:
        z = values[source]
        tr = (i % 4 < 3) & ~np.isnan(z)
        c = np.cov(x[tr].T, bias=True)
        c = c + 1e-3 * np.trace(c) / 4 * np.eye(4)
        e, q = np.linalg.eigh(c)
        root, inv = (q * np.sqrt(e)) @ q.T, (q / np.sqrt(e)) @ q.T
        u = inv @ ((x[tr] - x[tr].mean(0)).T @ (z[tr] - z[tr].mean()) / tr.sum())
        u /= np.linalg.norm(u)
        erased = x - (x - x[tr].mean(0)) @ (root @ np.outer(u, u) @ inv).T
        w = values[target]
        a, b = (i % 4 < 3) & ~np.isnan(w), (i % 4 == 3) & ~np.isnan(w)
        assert before == pytest.approx(r2(x[a], x[b], w[a], w[b])) and after == pytest.approx(r2(erased[a], erased[b], w[a], w[b]), abs=1e-8)
        assert drop == pytest.approx(before - after) and limit == pytest.approx(max(0.02, 0.35 * max(before, 0.04))) and effective == (after < limit)
    assert next(a for s_, t_, _, a, *_ in got if s_ == t_ == "s") < 0.02


def test_masked_ridge_takes_one_pass(spark):
    x, y, s, _ = rows(300)
    y[::5] = np.nan
    df = frame(spark, x, y=y, s=s)
    got = probes.masked_ridge(df, "x", ["y", "s"], 1.0)
    for name, z in (("y", y), ("s", s)):
        m = v.moments(df.where(F.col(name).isNotNull()), "x", [name])
        w, b = models.Ridge(m, 4).solve(1.0)
        assert np.allclose(got[name][0], w[:, 0]) and got[name][1] == pytest.approx(float(b[0]))


def test_directions_in_four_spaces(spark):
    x, y, _, _ = rows(500)
    m = v.moments(frame(spark, x, y=y), "x", ["y"])
    scale = np.array([1.0, 0.5, 2.0, 4.0])
    got = heads.concept_directions(m, 3.0, 0.1, scale)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 3.0 * np.eye(4), z.T @ (y - y.mean()))
    c = np.cov(x.T, bias=True)
    c = c + 0.1 * np.trace(c) / 4 * np.eye(4)
    e, q = np.linalg.eigh(c)
    white = (q / np.sqrt(e)) @ q.T @ ((x - x.mean(0)).T @ (y - y.mean()) / 500)
    white /= np.linalg.norm(white)
    raw = (q * np.sqrt(e)) @ q.T @ white
    want = {"probe_standardised": w, "probe_raw": w / x.std(0), "erased_whitened": white, "erased_raw": raw, "erased_code": raw / scale}
    for k, u in want.items():
        assert np.allclose(got[k], u / np.linalg.norm(u), atol=1e-9), k
    spaces = heads.Spaces(m, 4, 0.0, scale)
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=4), rng.normal(size=4)
    for p in ("raw", "standardised", "whitened", "code"):
        for r in ("raw", "standardised", "whitened", "code"):
            assert spaces.covector(b, p, r) @ spaces.vector(a, p, r) == pytest.approx(a @ b)
            assert np.allclose(spaces.vector(spaces.vector(a, p, r), r, p), a)
    with pytest.raises(Rejected):
        heads.concept_directions(v.Moments.of(np.column_stack([x, np.ones(500)])), 1.0)


def test_randomised_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 64)) * 0.8 ** np.arange(64) * 5 + 100
    rows_, values = heads.randomised_components(frame(spark, x), "x", 6)
    e, q = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(values, e[::-1][:6], rtol=1e-8)
    gap = rows_.T - q[:, ::-1][:, :6] @ (q[:, ::-1][:, :6].T @ rows_.T)
    assert np.abs(gap).max() < 1e-6
    assert np.allclose(np.abs((rows_ * q[:, ::-1][:, :6].T).sum(1)), 1, atol=1e-8)
    few, _ = heads.randomised_components(frame(spark, x[:3]), "x", 6)
    assert np.allclose(few @ few.T, np.eye(len(few)), atol=1e-8)


def test_components_of_wide_vectors(spark):
    rng = np.random.default_rng(3)
    d = np.linalg.qr(rng.normal(size=(20_000, 3)))[0].T
    x = rng.normal(size=(120, 3)) * [30, 20, 10] @ d + 0.01 * rng.normal(size=(120, 20_000))
    df = spark.createDataFrame([(x[i].tolist(),) for i in range(120)], "x array<double>").repartition(4)
    rows_, values = heads.randomised_components(df, "x", 3, extra=4)
    y = x - x.mean(0)
    e, u = np.linalg.eigh(y @ y.T / 120)
    assert np.allclose(values, e[::-1][:3], rtol=1e-8) and np.allclose(np.abs((rows_ @ d.T)).max(1), 1, atol=1e-2)


def test_matched_cosines_take_the_size_of_the_cosine():
    rng = np.random.default_rng(4)
    a = np.linalg.qr(rng.normal(size=(64, 10)))[0].T
    assert models.matched_cosine(a, -a[::-1], signed=False) == pytest.approx(1) and models.matched_cosine(a, -a) < 0.01
    x, y = rng.normal(size=(2, 5, 64))
    assert models.matched_cosine(x, y, signed=False) < 0.3


def test_functional_stability(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(5, 16))
    vectors = {(s, g, k): (base[k] + 0.1 * rng.normal(size=16) if g == 0 else rng.normal(size=16)) for s in (1, 2, 3) for g in range(21) for k in range(5)}
    df = spark.createDataFrame([("u", s, g, k if s != 2 else 4 - k, [float(x) for x in vec]) for (s, g, k), vec in vectors.items()], "unit string, seed int, grp int, atom int, v array<double>").repartition(3)
    got = heads.functional_stability(df, ["unit"], "seed", "grp", "atom", "v").collect()
    assert {(r["seed_i"], r["seed_j"]) for r in got} == {(1, 2), (1, 3), (2, 3)}
    for r in got:
        a, b = (np.array([vectors[r[s], 0, k] for k in range(5)]) for s in ("seed_i", "seed_j"))
        over = [models.subspace_overlap(*(np.array([vectors[r[s], g, k] for k in range(5)]) for s in ("seed_i", "seed_j"))) for g in range(1, 21)]
        assert r["selected_overlap"] == pytest.approx(models.subspace_overlap(a, b)) and r["selected_cosine"] == pytest.approx(models.matched_cosine(a, b)) and r["selected_cosine"] > 0.95
        assert r["random_overlap_q95"] == pytest.approx(np.quantile(over, 0.95)) and r["p"] == pytest.approx((1 + sum(o >= r["selected_overlap"] for o in over)) / 21) and r["random_groups"] == 20
        assert r["overlap_excess"] == pytest.approx(r["selected_overlap"] - np.mean(over))
