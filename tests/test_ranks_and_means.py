"""Running sums by range, sums about means, and neighbours in order, against numpy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.operators import relational as rel
from veriscope.operators import resampling
from veriscope.operators import statistics as st
from veriscope.operators import vectors as v


@pytest.fixture
def hot(spark):
    """One key with most rows, ties in it, a null key, and keys of a row."""
    rng = np.random.default_rng(2)
    rows = [("hot", float(x), bool(x + rng.normal() > 0)) for x in np.round(rng.normal(size=3000), 2)]
    rows += [(f"k{i}", float(i), i % 2 == 0) for i in range(40)] + [(None, float(x), bool(x > 0)) for x in rng.normal(size=50)]
    return rows, spark.createDataFrame(rows, "g string, s double, y boolean").repartition(4)


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < a).sum() + ((x == a).sum() + 1) / 2 for a in x])


@pytest.mark.parametrize("small", [0, 1 << 62])
def test_ranks_by_range(spark, hot, monkeypatch, small):
    monkeypatch.setattr(rel, "SMALL", small)
    rows, df = hot
    s = np.array([r[1] for r in rows if r[0] == "hot"])
    y = np.array([r[2] for r in rows if r[0] == "hot"])
    got = {r["s"]: r["mid_rank"] for r in st.mid_ranks(df, "g", "s").where("g = 'hot'").collect()}
    assert got == dict(zip(s.tolist(), ranks(s).tolist()))
    area = (ranks(s)[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    got = {r["g"]: r["auroc"] for r in st.auroc(df, "g", "s", "y").collect()}
    assert got["hot"] == pytest.approx(area) and got["k3"] is None and None in got and len(got) == 42
    assert {r["g"]: r["auroc"] for r in st.weighted_auroc(df.withColumn("w", F.lit(2.0)), "g", "s", "y", "w").collect()}["hot"] == pytest.approx(area)
    order = np.argsort(-s, kind="stable")
    values = np.unique(s)[::-1]
    hits, seen = np.array([y[s >= a].sum() for a in values]), np.array([(s >= a).sum() for a in values])
    ap = (np.diff(hits, prepend=0) * hits / seen).sum() / y.sum()
    assert {r["g"]: r["ap"] for r in st.average_precision(df, "g", "s", "y").collect()}["hot"] == pytest.approx(ap) and len(order)
    assert {r["g"]: r["threshold"] for r in st.higher_quantile(df, "g", "s", 0.9).where("g is not null").collect()}["hot"] == np.quantile(s, 0.9, method="higher")
    assert {r["s"]: r["reach"] for r in st.reach(df.where("g = 'hot'"), "s").collect()} == {a: int((s >= a).sum()) for a in s}
    below = {r["s"]: r["below"] for r in st.cumulative_weight(df.where("g = 'hot'"), "g", "s").collect()}
    assert below == {a: int((s <= a).sum()) for a in s}
    w = spark.createDataFrame([(d, g, 1 + d) for d in range(2) for g in ("hot", "k1")], "draw int, g string, w int")
    assert {r["draw"] for r in resampling.bootstrap_auroc(df, "g", "s", "y", w).collect()} == {0, 1}


def test_large_means_keep_their_digits(spark):
    rng = np.random.default_rng(1)
    z = 1e8 + rng.normal(size=2000)
    y = z + 0.1 * rng.normal(size=2000)
    df = spark.createDataFrame([(i % 7, float(a), float(b), [float(a), float(b), 5.0]) for i, (a, b) in enumerate(zip(z, y))], "g int, z double, y double, v array<double>").repartition(5)
    want = np.corrcoef(z, y)[0, 1]
    one = df.withColumn("k", F.lit(1))
    assert st.correlations(one, "k", "z", "y").first()["r"] == pytest.approx(want, abs=1e-9)
    m = v.moments(df, "v")
    assert np.allclose(m.covariance, np.cov(np.stack([z, y, np.full(2000, 5.0)]), bias=True), rtol=1e-9, atol=1e-12)
    assert m.mean == pytest.approx([z.mean(), y.mean(), 5.0])
    line = st.slope(one, "k", "z", "y").first()
    b, a = np.polyfit(z - 1e8, y - 1e8, 1)
    assert line["slope"] == pytest.approx(b, rel=1e-8) and line["intercept"] == pytest.approx(a + 1e8 * (1 - b), rel=1e-6)
    w = spark.createDataFrame([(0, g, 1) for g in range(7)], "draw int, g int, w int")
    assert st.bootstrap_correlation(df, "g", "z", "y", w).first()["r"] == pytest.approx(want, abs=1e-8)
    fit = resampling.fit_metrics(df, "g", "y", "z", w).first()
    assert fit["r"] == pytest.approx(want, abs=1e-8) and fit["r2"] == pytest.approx(1 - ((y - z) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-8)
    per = {(r["feature"], r["target"]): r["r"] for r in st.class_correlations(df, "v", "g", df.select("g")).collect()}
    g = np.arange(2000) % 7
    assert all(per[0, c] == pytest.approx(np.corrcoef(z, g == c)[0, 1], abs=1e-9) and per[2, c] == 0 for c in range(7))
    means = np.array([z[g == c].mean() for c in range(7)])[g]
    part = st.between_classes(df.withColumn("one", F.array("z")), "one", "g").first()["r2"]
    assert part == pytest.approx(1 - ((z - means) ** 2).sum() / ((z - z.mean()) ** 2).sum(), abs=1e-9)


def test_moments_of_parts_and_nothing(spark):
    x = np.random.default_rng(3).normal(size=(50, 4)) + 1e6
    whole, a, b = v.Moments.of(x), v.Moments.of(x[:17]), v.Moments.of(x[17:])
    both = v.Moments.frombytes(a.merge(b).tobytes())
    assert np.allclose(both.scatter, whole.scatter) and np.allclose(both.mean, whole.mean) and both.n == 50
    assert np.allclose(whole.part([2, 0]).covariance, np.cov(x[:, [2, 0]].T, bias=True))
    assert v.moments(spark.createDataFrame([(None,)], "v array<double>"), "v").n == 0


def test_nearest_match_is_linear(spark):
    n = 100_000
    left = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.xxhash64("id") % 1_000_000).cast("double").alias("v"))
    right = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("t"), (F.xxhash64(F.col("id") + n) % 1_000_000).cast("double").alias("w"))
    began = time.time()
    out = rel.nearest_match(left, right, "k", "v", "w", "t").agg(F.count("*"), F.max(F.abs(F.col("v") - F.col("w")))).first()
    assert out[0] == n and time.time() - began < 60
    x, y = (np.array([r[0] for r in d.collect()]) for d in (left.select("v").limit(200), right.select("w")))
    got = {r["v"]: abs(r["v"] - r["w"]) for r in rel.nearest_match(left.join(left.select("i").limit(200), "i", "left_semi"), right, "k", "v", "w", "t").collect()}
    assert all(abs(y - a).min() == got[a] for a in got)
    assert len(x) == 200


def test_last_of_equals_is_stated(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("", 3, "w"), (None, 9, "u")], "k string, o int, c string")
    for parts in (1, 5):
        assert [tuple(r) for r in rel.last_per_key(df.repartition(parts), "k", "o").collect()] == [("a", 2, "z")]


def test_resample_of_mixed_lengths(spark):
    rng = np.random.default_rng(0)
    rows = [(i, None if i == 3 else [float(x) for x in rng.normal(size=int(n))]) for i, n in enumerate([8, 9, 8, 4, 0, 16, 9])]
    got = {r["i"]: r["x"] for r in v.resample(spark.createDataFrame(rows, "i int, x array<double>"), "x", 8).collect()}
    assert got[3] is None and got[4] is None and got[0] == pytest.approx(rows[0][1])
    f = np.fft.rfft(rows[5][1])[:5]
    f[4] = 2 * f[4].real
    assert got[5] == pytest.approx(np.fft.irfft(f, 8) / 2)
