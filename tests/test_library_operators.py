"""Operators on small inputs: ties, nulls, empty tables, single classes, and numpy as the judge of matrices."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope import functions as fn
from veriscope import streaming
from veriscope.operators import audit, models, probes, resampling
from veriscope.operators import relational as rel
from veriscope.operators import statistics as st
from veriscope.operators import vectors as v
from veriscope.sources import tables as src


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_parsing(spark):
    texts = ["1.5", "", "abc", "nan", "inf", None, " 2 "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(fn.parse_finite("t")).collect()]
    assert got == [1.5, None, None, None, None, None, 2.0]
    assert [r[0] for r in df.orderBy("i").select(fn.parse_whole(F.lit("8.0"))).limit(1).collect()] == [8]
    assert one(spark, fn.after_colon(F.lit("study_f:123")), fn.record_name(F.lit(1234567))) == ("123", "HR1234567")
    assert one(spark, fn.wrapped_angle(F.lit(-170), F.lit(170))) == (20,)
    assert one(spark, fn.signed_absmax(F.lit(-3.0), F.lit(None), F.lit(3.0))) == (-3.0,)
    assert one(spark, fn.three_valued(F.lit(False), F.lit(True))) == (None,)


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,a\n2,\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("id,x\n3,c\n")
    df = src.read_strings(spark, str(tmp_path / "a.csv"))
    assert df.dtypes == [("id", "string"), ("x", "string")] and src.header(spark, str(tmp_path / "a.csv")) == ["id", "x"]
    assert src.read_strings(spark, str(tmp_path / "b.csv.gz"), ["id", "x"]).collect()[0] == ("3", "c")
    assert src.read_first(spark, str(tmp_path / "none.csv"), str(tmp_path / "a.csv")).count() == 2
    assert src.read_many(spark, [str(tmp_path / "a.csv")]).select("file").distinct().count() == 1
    assert {r["suffix"]: r["files"] for r in src.file_census(spark, str(tmp_path)).collect()} == {".csv": 1, ".gz": 1}
    assert src.checksums(spark, str(tmp_path)).count() == 2


def test_record_header(spark, tmp_path):
    (tmp_path / "r.hea").write_text("r 2 500 5000\nr.mat 16+24 1000/mV 16 0 0 0 0 I\nr.mat 16+24 2000(-10)/mV 16 0 0 0 0 II\n")
    rows = src.record_headers(spark, str(tmp_path / "r.hea")).orderBy("i").collect()
    assert [(r["lead"], r["gain"], r["baseline"]) for r in rows] == [("I", 1000.0, 0), ("II", 2000.0, -10)]


def test_joins_check_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, s string")
    b = spark.createDataFrame([(1, 10)], "k int, n int")
    assert rel.join_checked(a, b, "k").count() == 3
    with pytest.raises(rel.NotUnique):
        rel.join_checked(b, a, "k")
    with pytest.raises(Exception, match="no n for a key"):
        rel.lookup(a, b, "k", "n").collect()


def test_first_interval_closed_and_overlapping(spark):
    p = spark.createDataFrame([(1, 1, 5), (2, 1, 10), (3, 1, 11), (4, 2, 5)], "id int, k int, t int")
    i = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 5, 10)], "k int, name string, s int, e int")
    got = {r["id"]: r["name"] for r in rel.first_interval(p, i, "k", "t", "s", "e", ["s", "name"]).collect()}
    assert got == {1: "a", 2: "b"}
    for width in (1.0, 3.0, 100.0):
        assert {r["id"]: r["name"] for r in rel.first_interval(p, i, "k", "t", "s", "e", ["s", "name"], width).collect()} == got


def test_grid_gaps_and_front(spark):
    have = spark.createDataFrame([(1, "a"), (1, "a"), (3, "a")], "x int, y string")
    plan = spark.createDataFrame([(1, "a"), (2, "a")], "x int, y string")
    assert {(r["x"], r["issue"]) for r in rel.grid_gaps(have, plan, ["x", "y"]).collect()} == {(1, "duplicate"), (2, "missing"), (3, "unexpected")}
    df = spark.createDataFrame([(1, 1.0, 5), (2, 2.0, 5), (3, 2.0, 4), (4, 0.5, 1)], "k int, a double, n int")
    assert {r["k"] for r in rel.dominated_free(df, "k", "a", "n").collect()} == {3, 4}


def test_auroc_ties_and_single_class(spark):
    rows = [(0, 1), (0, 0), (1, 1), (1, 0), (3, 1), (3, 1)]
    df = spark.createDataFrame([("g", float(s), y) for s, y in rows] + [("one", 1.0, 1)], "g string, s double, y int")
    pairs = [(a, b) for a, ya in rows for b, yb in rows if ya == 1 and yb == 0]
    want = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    got = {r["g"]: r["auroc"] for r in st.auroc(df, "g", "s", "y").collect()}
    assert got["g"] == pytest.approx(want) and got["one"] is None


def test_correlation_degenerate(spark):
    df = spark.createDataFrame([("c", 1.0, float(i)) for i in range(4)] + [("v", float(i), float(i * i)) for i in range(4)], "g string, z double, y double")
    got = {r["g"]: r["r"] for r in st.correlations(df, "g", "z", "y").collect()}
    assert got["c"] == 0.0 and got["v"] == pytest.approx(np.corrcoef(range(4), [i * i for i in range(4)])[0, 1])


def test_adjust_matches_definition(spark):
    p = [0.01, 0.04, 0.03, None, 0.04]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(p)], "g int, i int, p double")
    got = {r["i"]: r["q"] for r in st.adjust(df, "g", "p", "i").collect()}
    have = sorted((x, i) for i, x in enumerate(p) if x is not None)
    want = {i: min(1.0, min(x2 * len(have) / (k2 + 1) for k2, (x2, _) in enumerate(have) if k2 >= k)) for k, (x, i) in enumerate(have)}
    assert got[3] is None and all(got[i] == pytest.approx(q) for i, q in want.items())


def test_bootstrap_repeats_and_is_poisson(spark):
    c = spark.range(400).select(F.col("id").alias("c"))
    w = st.draws(spark, c, "c", 20, seed=3)
    assert w.exceptAll(st.draws(spark, c.repartition(3), "c", 20, seed=3)).isEmpty()
    total = w.agg(F.sum("w")).first()[0] / (400 * 20)
    assert abs(total - 1) < 0.05


def test_moments_ridge_pca_eraser(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    y = x @ rng.normal(size=6) + 0.01 * rng.normal(size=300)
    z = (x[:, 0] > 0).astype(float)
    df = spark.createDataFrame([(i, x[i].tolist(), float(y[i]), float(z[i])) for i in range(300)], "i int, v array<double>, y double, z double").repartition(3)
    m = v.moments(df, "v", ["y"])
    full = np.column_stack([x, y])
    assert np.allclose(m.gram, full.T @ full) and np.allclose(m.mean, full.mean(0))
    a, w, b = models.fit_ridge(df, df, "v", ["y"], (0.1, 1.0))["y"]
    assert np.corrcoef(x @ w + b, y)[0, 1] > 0.99
    rows, values = models.principal_directions(v.moments(df, "v"), 3)
    assert np.allclose(values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:3]) and np.allclose(rows @ rows.T, np.eye(3))
    erased = np.array([r[0] for r in models.Eraser(v.moments(df, "v", ["z"]), 6).apply(df, "v", "e").orderBy("i").select("e").collect()])
    assert np.abs(((erased - erased.mean(0)) * (z - z.mean())[:, None]).mean(0)).max() < 1e-8
    shift, off = models.transport(v.moments(df.where("i < 150"), "v"), v.moments(df.where("i >= 150"), "v"))
    moved = x[:150] @ shift.T + off
    assert np.allclose(np.cov(moved.T, bias=True), np.cov(x[150:].T, bias=True)) and np.allclose(moved.mean(0), x[150:].mean(0))


def test_assignment_and_tests():
    rng = np.random.default_rng(1)
    import itertools

    for n in (1, 3, 5):
        c = rng.random((n, n))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert c[np.arange(n), models.assignment(c)].sum() == pytest.approx(best)
    # Student's t by integration of its density.
    df, t = 18, 0.5 * math.sqrt(18 / 0.75)
    x = np.linspace(0, t, 100_001)
    density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    assert models.pearson_p(0.5, 20) == pytest.approx(1 - 2 * np.trapezoid(density, x), abs=1e-9)
    assert models.betainc(2, 3, 0.4) == pytest.approx(0.5248)


def test_arrays(spark):
    a, b = F.array(*map(F.lit, (1.0, 2.0, 2.0))), F.array(*map(F.lit, (0.0, 0.0, 1.0)))
    assert one(spark, v.norm(a), v.dot(a, b)) == (3.0, 2.0)
    assert one(spark, v.top_k(a, 1))[0] == [0.0, 2.0, 0.0]
    assert one(spark, v.limb_leads(a, b)["aVF"])[0] == [-0.5, -1.0, 0.0]
    assert one(spark, v.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == (None,)
    t = np.sin(np.arange(16) * 2 * np.pi / 16)
    df = spark.createDataFrame([(1, t.tolist()), (2, None)], "i int, x array<double>")
    got = {r["i"]: r["x"] for r in v.resample(df, "x", 32).collect()}
    assert got[2] is None and np.allclose(got[1], np.sin(np.arange(32) * 2 * np.pi / 32), atol=1e-9)


def test_audit(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, float("nan"))], "b string, x int, y double")
    assert [r["attribute"] for r in audit.not_constant(df, "b", ["x"]).collect()] == ["x"]
    assert audit.not_finite(df, ["y"]).first()["n"] == 1
    with pytest.raises(audit.Rejected):
        audit.require_columns(df, "q")
    with pytest.raises(audit.Rejected):
        audit.require_empty(df, "rows")
    assert audit.differing(df.where("x = 1"), df.where("x = 1"), "x", ["y"], 1e-6).isEmpty()


def test_empty_tables(spark):
    e = spark.createDataFrame([], "g int, s double, y int, k int")
    for df in (st.auroc(e, "g", "s", "y"), st.adjust(e, "g", "s", "k"), st.correlations(e, "g", "s", "y"), rel.top_per_key(e, "g", "k"), rel.column_summary(e, ["s"])):
        assert df.isEmpty()
    assert math.isclose(v.moments(e.select(F.array("s").alias("v")), "v").n, 0)


def test_stream(spark, tmp_path):
    src_dir = str(tmp_path / "in")
    spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0)], "c int, x double").write.parquet(src_dir)
    stream = spark.readStream.schema("c int, x double").parquet(src_dir)
    q = streaming.running_statistics(stream, "c", "x").writeStream.outputMode("complete").format("memory").queryName("stats").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["c"], r["n"], r["s"], r["q"]) for r in spark.table("stats").collect()} == {(1, 2, 5.0, 13.0), (2, 1, 5.0, 25.0)}


def test_p_values_as_columns(spark):
    rows = [(r, n) for r in (-0.9, -0.2, 0.0, 0.01, 0.5, 0.999) for n in (3, 4, 10, 57, 1000)] + [(1.0, 5), (0.5, 2), (None, 9)]
    df = spark.createDataFrame(rows, "r double, n int")
    for r, n, p in df.select("r", "n", probes.pearson_p("r", "n")).collect():
        if n < 3:
            assert p is None
        elif r is not None:
            assert p == pytest.approx(models.pearson_p(r, n), rel=1e-6, abs=1e-12)
    rng = np.random.default_rng(4)
    a, b = rng.normal(0.4, 1, 30), rng.normal(0, 2, 50)
    df = spark.createDataFrame([(True, float(x)) for x in a] + [(False, float(x)) for x in b], "g boolean, x double")
    got = probes.welch(df, [], "g", "x").first()
    assert got["p"] == pytest.approx(models.welch_p(a.mean(), a.var(ddof=1), 30, b.mean(), b.var(ddof=1), 50), rel=1e-6)
    # The lady tasting tea, and a table of which both tails count.
    tea = spark.createDataFrame([(3, 1, 1, 3), (10, 2, 3, 15), (0, 0, 5, 5)], "a int, b int, c int, d int")
    assert [r[0] for r in tea.select(probes.fisher_exact("a", "b", "c", "d")).collect()] == pytest.approx([0.4857142857, 0.0005367241, 1.0], abs=1e-9)


def test_maps_of_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [0.0, -1.0])], "k int, v array<double>")
    m = np.array([[1.0, 0.0], [0.0, 2.0], [1.0, 1.0]])
    assert {r["k"]: r["w"] for r in probes.linear_map(df, "v", "w", m, np.array([0.0, 0.0, 1.0])).collect()} == {1: [1.0, 4.0, 4.0], 2: None, 3: [0.0, -2.0, 0.0]}
    assert probes.linear_map(df.limit(0), "v", "w", m).isEmpty()
    made = probes.Dictionary(np.eye(2), 1)
    coded = made.encode(df, "v")
    assert {r["k"]: r["codes"] for r in coded.collect()} == {1: [0.0, 2.0], 2: None, 3: [0.0, 0.0]}
    assert {r["k"]: r["decoded"] for r in made.decode(coded).collect()}[1] == [0.0, 2.0]


def test_ridge_on_moments(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 5))
    y = x @ [1.0, 0.0, -2.0, 0.0, 0.3] + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(a.tolist(), float(b), float(b) if i % 3 else None) for i, (a, b) in enumerate(zip(x, y))], "x array<double>, y double, z double")
    fit = probes.masked_ridge(df, "x", ["y", "z"], 1.0)
    for name, rows in (("y", np.arange(300)), ("z", np.flatnonzero(np.arange(300) % 3))):
        a, b = x[rows], y[rows]
        s = (a - a.mean(0)) / a.std(0)
        w = np.linalg.solve(s.T @ s + np.eye(5), s.T @ (b - b.mean())) / a.std(0)
        assert fit[name][0] == pytest.approx(w) and fit[name][1] == pytest.approx(b.mean() - a.mean(0) @ w)
    m = v.moments(df, "x", ["y"])
    p = x @ fit["y"][0] + fit["y"][1]
    assert probes.explained(m, 5, *fit["y"]) == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    curve = probes.top_k_curve(m, m, 5, (1, 2, 3, 5), 1e-6)
    assert [r for _, r in curve] == sorted(r for _, r in curve) and probes.ninety_percent(curve) == 2
    with pytest.raises(audit.Rejected):
        probes.masked_ridge(df, "x", ["z"], 1.0, least=250)


def test_subspaces():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(3, 10))
    assert probes.geometric_agreement(a, rng.normal(size=(3, 3)) @ a) == pytest.approx(1.0)
    assert probes.geometric_agreement(a[:2], np.vstack([a[0], a[0]])) == pytest.approx(1.0)
    q = probes.random_basis(4, 10, 2)
    assert q @ q.T == pytest.approx(np.eye(4)) and (q == probes.random_basis(4, 10, 2)).all()


def test_draws_follow_their_distributions(spark):
    levels = spark.createDataFrame([(c,) for c in "abcdef"], "k string")
    w = resampling.multinomial_draws(spark, levels, "k", 400).groupBy("draw").agg(F.sum("w").alias("n")).collect()
    assert len(w) == 400 and {r["n"] for r in w} == {6}
    e = resampling.exponential_draws(levels, "k", 400).agg(F.avg("w"), F.stddev("w"), F.min("w")).first()
    assert e[0] == pytest.approx(1, abs=0.1) and e[1] == pytest.approx(1, abs=0.15) and e[2] >= 0
    cells = spark.createDataFrame([("a", "x", 1.0), ("a", "y", None), ("b", "x", float("nan")), ("b", "y", 3.0)], "f string, g string, m double")
    draws = {c: resampling.multinomial_draws(spark, cells, c, 30, i) for i, c in enumerate("fg")}
    means = [r["mean"] for r in resampling.crossed_mean(cells, draws, "m").collect()]
    assert means and all(x is None or 1 <= x <= 3 for x in means)


def test_bootstrap_skips_one_class(spark):
    df = spark.createDataFrame([(1, 0.1, True), (2, 0.9, False)], "c int, s double, y boolean")
    w = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 2)], "draw int, c int, w int")
    assert {r["draw"]: r["auroc"] for r in resampling.bootstrap_auroc(df, "c", "s", "y", w).collect()} == {0: 0.0, 1: None}
    assert [r["draw"] for r in resampling.auroc_difference(df, "c", "s", "s", "y", w).collect()] == [0]


def test_paths_and_seeds(spark):
    df = spark.createDataFrame([("a/b",), ("a/../b",), ("/etc/x",), ("a..b/c",), (None,), ("ab/c",)], "p string")
    assert {r["p"] for r in audit.outside(df, "p", "a").collect()} == {"a/../b", "/etc/x", "a..b/c", None, "ab/c"}
    import hashlib

    h = hashlib.sha256(b"x").digest()
    got = spark.range(1).select(fn.seed_by_first_bytes(F.lit("x")), fn.seed_by_last_first(F.lit("x"))).first()
    assert tuple(got) == (int.from_bytes(h[:4], "big"), int.from_bytes(h[:8], "little") % 2**32)
    assert spark.range(1).select(fn.year_of(F.lit("2020-01-02 03:04:05")), fn.year_of(F.lit("no"))).first() == (2020, None)


def test_logistic_probe(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=300) > 0).astype(float)
    df = spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k int, x array<double>, y double")
    for l1 in (False, True):
        c, auc, w, _ = probes.logistic_probe(df.where("k < 200"), df.where("k >= 200"), "x", "y", l1=l1)
        assert auc > 0.95 and w[0] > 0 > w[1] and abs(w[2]) < abs(w[0]) / 3 and c in (0.01, 0.1, 1.0, 10.0)
    with pytest.raises(audit.Rejected):
        probes.logistic_probe(df.where("y = 1"), df, "x", "y")


def test_independent_components_are_found(spark):
    rng = np.random.default_rng(7)
    s = rng.uniform(-1, 1, size=(2000, 3))
    x = s @ rng.normal(size=(3, 3)).T + 5
    df = spark.createDataFrame([(a.tolist(),) for a in x], "x array<double>")
    w, mean = probes.independent_components(df, "x", 3)
    c = np.abs(np.corrcoef(((x - mean) @ w.T).T, s.T)[:3, 3:])
    assert (c.max(1) > 0.95).all() and len(set(c.argmax(1))) == 3


def test_warp_and_sets(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0],)], "x array<double>")
    assert probes.warp(df, "x", [0, 0.5, 1], [0, 0.25, 1], "y").first()["y"] == pytest.approx([0, 2, 2 + 2 / 3, 2 + 4 / 3, 4])
    assert probes.orthogonal_set(["a", "b", "c"], {("a", "b"): 0.9, ("b", "c"): 0.1, ("a", "c"): 0.9}, 0.3) == ["b", "c"]


def test_numbered_and_matches(spark):
    rng = np.random.default_rng(9)
    rows = [(int(i), int(x)) for i, x in enumerate(rng.integers(0, 50, 400))]
    df = spark.createDataFrame(rows, "k int, x int").repartition(5)
    got = {r["k"]: r["i"] for r in rel.numbered(df, ["x", "k"]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda t: t[1])] == [k for k, _ in sorted(rows, key=lambda t: (t[1], t[0]))]
    assert sorted(got.values()) == list(range(1, 401)) and rel.numbered(df.limit(0), "x").isEmpty()
    p = [(k, x / 50 + k / 1e6) for k, x in rows]
    df = spark.createDataFrame([*p, (999, None)], "k int, p double").repartition(3)
    want = {r["k"]: r["q"] for r in st.adjust(df.withColumn("g", F.lit(1)), "g", "p", "k").collect()}
    assert {r["k"]: r["q"] for r in st.adjust_large(df, "p", "k").collect()} == pytest.approx(want)
    left = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 0.0), ("b", 3, 1.0), ("c", 4, 1.0)], "g string, id int, v double")
    right = spark.createDataFrame([("a", 9, 4.0), ("a", 7, 6.0), ("a", 8, 6.0), ("b", 1, 9.0)], "g string, t int, w double")
    assert {(r["id"], r["w"], r["t"]) for r in rel.nearest_match(left, right, "g", "v", "w", "t").collect()} == {(1, 6.0, 7), (2, 4.0, 9), (3, 9.0, 1)}
    pool = spark.createDataFrame([(i, float(i)) for i in range(30)], "t int, w double")
    near = rel.nearest_in_pool(left.where("id < 3"), pool, "id", "t", F.abs(F.col("v") - F.col("w")), 2, block=7)
    assert {(r["id"], r["place"], r["t"]) for r in near.collect()} == {(1, 1, 5), (1, 2, 4), (2, 1, 0), (2, 2, 1)}


def test_semi_nmf(spark):
    rng = np.random.default_rng(12)
    x = np.abs(rng.normal(size=(400, 3))) @ rng.normal(size=(3, 8))
    df = spark.createDataFrame([(a.tolist(),) for a in x], "x array<double>")
    fits = [probes.SemiNmf.fit(df, "x", 3, rounds=r) for r in (1, 15)]
    rest = [((x - f.codes(x) @ f.parts) ** 2).sum() / (x**2).sum() for f in fits]
    assert rest[1] < min(0.1, rest[0]) and (fits[1].codes(x) >= 0).all()
    assert spark.createDataFrame([([],), ([1, 2],), ([1, 3, 9, 10],)], "m array<int>").select(probes.interval_features("m", 2, 9).alias("f")).select("f.n", "f.median").collect() == [(0, None), (0, None), (2, 4.0)]
