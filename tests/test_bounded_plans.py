"""Operators that deal out what one task or the driver held: manifests, packs, fronts, draws, permutations, record order."""

import hashlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.operators import models, probes, resampling
from veriscope.operators import relational as rel
from veriscope.operators import vectors as v
from veriscope.sources import tables as src


@pytest.mark.parametrize("small", [0, 1 << 62])
def test_ordered_manifest(spark, monkeypatch, small):
    monkeypatch.setattr(rel, "SMALL", small)
    df = spark.range(25).select(F.when(F.col("id") < 20, "a").otherwise("b").alias("k"), (-F.col("id")).alias("o"), F.concat(F.lit("x"), F.col("id")).alias("line")).repartition(5)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    a, b = [f"x{i}" for i in range(19, -1, -1)], [f"x{i}" for i in range(24, 19, -1)]
    got = {r["k"]: r["manifest"] for r in rel.ordered_manifest(df, "k", "line", "o", prefix="p;").collect()}
    assert got == {"a": sha("p;" + "\n".join(a)), "b": sha("p;" + "\n".join(b))}
    got = {r["k"]: r["manifest"] for r in rel.ordered_manifest(df, "k", "line", "o", prefix="p;", rows=8).collect()}
    parts = [sha("p;" + "\n".join(a[:8])), sha("\n".join(a[8:16])), sha("\n".join(a[16:]))]
    assert got == {"a": sha("p;" + "\n".join(parts)), "b": sha("p;" + "\n".join(b))}


def test_arrays_in_parts(spark):
    df = spark.range(50).select((F.col("id") % 3).cast("int").alias("g"), F.col("id").alias("i"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("x")).repartition(4)
    packed = src.pack_arrays(df, "g", "m", "x", "i", rows=4)
    assert packed.groupBy("g").count().orderBy("g").collect()[0]["count"] == 5
    back = src.unpack_arrays(packed, ["g"], "content", "m", "i")
    assert sorted((r["g"], r["i"], r["m"][0]) for r in back.collect()) == sorted((i % 3, i, float(i)) for i in range(50))


def test_front_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2)).round(2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k int, a double, b double").repartition(6)
    want = {i for i, p in enumerate(x) if not any((q >= p).all() and (q > p).any() for q in x)}
    for front in (200_000, 2):
        monkeypatch.setattr(rel, "FRONT", front)
        assert {r["k"] for r in rel.dominated_free(df, "k", ["a", "b"], []).collect()} == want
    monkeypatch.setattr(rel, "MOST_ITEMS", 10)
    with pytest.raises(ValueError, match="all pairs"):
        rel.unordered_pairs(df, "k")
    assert rel.unordered_pairs(df.where("k < 10"), "k").count() == 45


def test_permutations_by_bins(spark, monkeypatch):
    rng = np.random.default_rng(1)
    items = [(i, int(rng.integers(0, 4)), bool(rng.random() < 0.2)) for i in range(200)] + [(200, 9, False)]
    df = spark.createDataFrame(items, "i int, g int, c boolean").repartition(3)
    k = sum(c for *_, c in items)
    hits = {g: sum(c for _, h, c in items if h == g) for g in (0, 1, 2, 3, 9)}
    u = lambda d, i: int(hashlib.md5(f"0:{d}:{i}".encode()).hexdigest()[:8], 16)
    reached = dict.fromkeys(hits, 0)
    for d in range(20):
        drawn = sorted(items, key=lambda r: (u(d, r[0]), r[0]))[:k]
        for g in hits:
            reached[g] += sum(h == g for _, h, _ in drawn) >= hits[g]
    for bins in (4096, 2):
        monkeypatch.setattr(resampling, "BINS", bins)
        got = {r["g"]: r["p"] for r in resampling.permutation_enrichment(df, "i", "g", "c", 20).collect()}
        assert got == pytest.approx({g: (n + 1) / 21 for g, n in reached.items()})


def test_draws_of_many_levels(spark, monkeypatch):
    levels = spark.range(30).select(F.concat(F.lit("k"), F.col("id")).alias("k")).repartition(4)
    few = {tuple(r) for r in resampling.multinomial_draws(spark, levels, "k", 5).collect()}
    monkeypatch.setattr(rel, "SMALL", 0)
    monkeypatch.setattr(resampling, "MOST_LEVELS", 3)
    assert {tuple(r) for r in resampling.multinomial_draws(spark, levels, "k", 5).collect()} == few
    assert sum(w for *_, w in few) == 150


def test_record_order(spark):
    a = spark.createDataFrame([(k, k) for k in range(10)], "k int, o int").repartition(3)
    b = spark.createDataFrame([(k, k if k not in (3, 4) else 7 - k) for k in range(10) if k != 9] + [(11, 11)], "k int, o int").repartition(2)
    assert tuple(rel.order_agreement(a, b, "k", "o", "o").first()) == (9, 2, 1, 1)
    assert tuple(rel.order_agreement(a, a, "k", "o", "o").first()) == (10, 0, 0, 0)


def test_diagonal_transport_and_controls():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(400, 3)) * [1, 2, 0], rng.normal(size=(300, 3)) @ rng.normal(size=(3, 3)) + 5
    m, shift = models.transport(v.Moments.of(x), v.Moments.of(y), diagonal=True)
    z = x @ m.T + shift
    assert np.allclose(z.mean(0), y.mean(0)) and np.allclose(z.std(0)[:2], y.std(0)[:2])
    u = np.array([0.0, -1.0, 0.0])
    got = models.control_directions(v.Moments.of(x), u, 1)
    assert set(got) == {"principal", "random"} and all(np.linalg.norm(d) == pytest.approx(1) and d @ u >= 0 for d in got.values())
    assert abs(got["principal"] @ u) > 0.99


def test_orthogonal_set_against_all_swaps():
    rng = np.random.default_rng(3)
    for _ in range(20):
        r = np.abs(np.corrcoef(rng.normal(size=(9, 5))))
        kept = probes.orthogonal_set(list(range(9)), r, 0.45)
        apart = lambda s: all(r[a, b] <= 0.45 for a in s for b in s if a < b)
        assert apart(kept) and not any(apart([*kept, c]) for c in range(9) if c not in kept)
        rest = [c for c in range(9) if c not in kept]
        assert not any(apart([k for k in kept if k != out] + [a, b]) for out in kept for a in rest for b in rest if a < b)
        table = {(a, b): r[a, b] for a in range(9) for b in range(a + 1, 9)}
        assert probes.orthogonal_set(list(range(9)), table, 0.45) == kept


def test_cliques_grow_within_tasks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    names = [f"n{i:02d}" for i in range(24)]
    linked = {p for p in combinations(names, 2) if rng.random() < 0.6}
    edges = spark.createDataFrame([*linked, *list(linked)[:9]], "a string, b string").repartition(3)
    want = {c for k in range(2, 6) for c in combinations(names, k) if all(p in linked for p in combinations(c, 2))}
    got = [(r["size"], tuple(r["items"])) for r in rel.cliques(edges, 2, 5).collect()]
    assert len(got) == len(want) and set(got) == {(len(c), c) for c in want}
    assert rel.cliques(edges.limit(0), 3, 6).isEmpty()
    # All tasks share the work, however few bytes the edges have.
    assert rel.cliques(edges, 2, 5).rdd.getNumPartitions() == 4
    # Larger sets take no further shuffle, and no step holds more than some.
    shuffles = lambda most: rel.cliques(edges, 3, most)._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert shuffles(3) == shuffles(9)
    a = np.triu(np.ones((12, 12), bool), 1)
    grow = lambda: [x for x in rel._grown(np.zeros((1, 0), np.int32), np.ones((1, 12), bool), a, 3, 6)]
    whole = sorted(map(tuple, (r for x in grow() for r in x.tolist())))
    monkeypatch.setattr(rel, "CLIQUE_CELLS", 288)
    parts = grow()
    assert max(map(len, parts)) <= 24 and sorted(map(tuple, (r for x in parts for r in x.tolist()))) == whole
