"""Whitening and spelling variants against plain versions, on hard small inputs and on the small tables."""

import zlib
from collections import Counter
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.llm import variants, whitening
from veriscope.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def table(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# Whitening


def plain_whitening(x, k=8):
    x = np.floor(1024.0 * x).astype(np.int64) + 100000
    n, s = len(x), x.sum(0)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    y = x - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return dev, y @ v / np.sqrt(e), e / np.trace(y.T @ y / n)


def test_op11(spark):
    got = QUERIES["op11_whitening"](spark, SF)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = table(spark, "embeddings").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    dev, white, explained = plain_whitening(x)
    got = got.orderBy("vec_id", "component").collect()
    assert len(got) == 8 * len(x)
    a = np.array([r["whitened"] for r in got]).reshape(-1, 8)
    assert [r["deviation"] for r in got[::8]] == dev and {r["n"] for r in got} == {len(x)}
    assert np.allclose(a * np.sign(a[0]), white * np.sign(white[0]), atol=1e-8)
    assert np.allclose([r["explained"] for r in got[:8]], explained, rtol=1e-10) and got[0]["identity_error"] < 1e-9


def test_whitening_of_hard_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5)) * [9, 4, 2, 1, 0.5] + 1e6
    rows = [(i, [float(c) for c in v], str(i), -i) for i, v in enumerate(x)]
    odd = [(None, rows[0][1], None, None), (1000, None, "a", 1), (1001, [1.0, None, 1.0, 1.0, 1.0], "b", 1), (1002, [1.0, float("nan"), 1.0, 1.0, 1.0], "c", 1), (1003, [float("inf")] * 5, "d", 1), rows[5]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, White string, n long").repartition(7)
    got = whitening.whiten(df, components=3).orderBy("vec_id")
    assert got.columns == ["vec_id", "embedding", "n", "white", "white_deviation", "white_n", "white_explained", "white_identity_error"]
    got = got.collect()
    assert len(got) == 302 and got[0]["vec_id"] is None and got[6]["white"] == got[7]["white"]
    full = np.array([r["embedding"] for r in got])
    dev, white, explained = plain_whitening(full, 3)
    a = np.array([r["white"] for r in got])
    # A mean of a billion on the grid leaves nine digits of the plain version's.
    assert np.allclose(a * np.sign(a[0]), white * np.sign(white[0]), atol=1e-5)
    assert [int(r["white_deviation"]) for r in got] == dev and got[0]["white_identity_error"] < 1e-9
    assert np.allclose(got[0]["white_explained"], explained)


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [float("nan")])]):
        got = whitening.whiten(spark.createDataFrame(rows, schema))
        assert got.isEmpty() and "white" in got.columns
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r["white"], r["white_deviation"], r["white_explained"], r["white_identity_error"]) for r in got] == [([None, None], Decimal(0), [None, None], None)] * 2
    got = whitening.whiten(spark.createDataFrame([(1, [0.0, 2.0]), (2, [1.0, 2.0])], schema)).orderBy("vec_id").collect()
    assert got[0]["white"] == [-1.0, None] and got[1]["white"] == [1.0, None] and got[0]["white_explained"] == [1.0, 0.0] and got[0]["white_identity_error"] < 1e-12
    with pytest.raises(Exception, match="vectors of"):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema)).collect()


def test_deviations_beyond_longs():
    rest = np.array([-(2**35), 12345], np.int64)
    w = whitening.Whitening("v", 1, 0, 2**36, np.zeros(2, np.int64), rest, np.ones(2), np.ones(2), np.eye(2))
    x = np.array([[3, -4], [2**20, 0]], np.int64)
    assert [int(v) for v in w.deviations(x).to_pylist()] == [sum((2**36 * int(a) - int(b)) ** 2 for a, b in zip(r, rest)) for r in x]


def test_moments_merge_like_one_pass():
    x = np.random.default_rng(1).integers(-9, 9, (500, 4)) + 10**12
    parts = [whitening.Moments.of(x[lo : lo + 97]) for lo in range(0, 500, 97)]
    m = None
    for p in parts:
        m = whitening._merged(m, p)
    y = x - x[0]
    assert m.n == 500 and (m.origin * 500 + m.rest == x.sum(0)).all()
    assert np.allclose(m.scatter / 500, np.cov(y.T, bias=True), rtol=1e-12, atol=1e-12)


# Spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    import re

    n = Counter()
    for k, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return n


def plain_variants(n):
    form, out = {}, {}
    for w in n:
        others = [v for v in n if near(v, w)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = (n[w], len(others), form[w], n[form[w]] if form[w] else None)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return {(w, *v) for w, v in out.items()}


def test_words(spark, docs, none):
    for d in (docs, table(spark)):
        want = plain_words([tuple(r) for r in d.select("doc_id", "text").collect()])
        want.pop("", None)
        got = {r["word"]: r["n"] for r in variants.words(d, 199).where("word <> ''").collect()}
        assert got == want
    assert variants.words(none, 199).isEmpty() and variants.spelling_variants(none).isEmpty()


def test_words_beside_clashing_columns(spark, docs):
    extra = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("word", "N", "run", "h", "key", "form"))])
    of = lambda d: {tuple(r) for r in variants.spelling_variants(d, 1, 1, 2, 7).collect()}
    assert of(extra) == of(docs) != set()


def test_variants_are_exact(spark):
    rng = np.random.default_rng(5)
    letters = ["a", "b", "é", "ÿ"]
    n = {}
    for _ in range(400):
        n["".join(rng.choice(letters, rng.integers(3, 7)))] = int(5 ** rng.integers(1, 6) + rng.integers(0, 2))
    counts = spark.createDataFrame(list(n.items()), "word string, n long").repartition(5)
    got = variants.variants(counts)
    assert {tuple(r) for r in got.collect()} == plain_variants(n)
    pairs = variants.near_pairs(counts)
    assert pairs.count() == pairs.distinct().count() == sum(near(a, b) for a in n for b in n)


def test_roots_of_a_chain(spark):
    forms = spark.createDataFrame([(f"w{i:03}", f"w{i + 1:03}") for i in range(70)], "word string, form string")
    assert {r["root"] for r in variants.roots(forms).collect()} == {"w070"}
    with pytest.raises(ValueError, match="circles"):
        variants.roots(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "word string, form string"), 8)
    with pytest.raises(ValueError, match="ratio"):
        variants.variants(spark.createDataFrame([("a", 1)], "word string, n long"), 1)


def test_op13_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got = QUERIES["op13_spelling_variants"](spark, SF)
    want = c.sql(ORACLE_SQL["op13_spelling_variants"])
    assert sorted(got.columns) == sorted(want.columns)
    rows = {tuple(r) for r in got.select(*want.columns).collect()}
    assert rows == set(want.fetchall()) and got.where(F.col("form").isNotNull()).count() > 0
    words = plain_words([tuple(r) for r in table(spark).select("doc_id", "text").collect()])
    kept = {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}
    assert {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got.collect()} == plain_variants(kept)
