"""The Jaccard join against plain code: every link, families of near copies, dense groups, hard rows."""

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.llm import jaccard
from veriscope.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows, k, num, den):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both) and rows[i][0] is not None and rows[j][0] is not None:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(((key, len(s), least.get(find(i))) for i, ((key, _), s) in enumerate(zip(rows, sets))), key=str)


def held(spark, df, k, num, den):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = jaccard.jaccard_components(df, k, num, den)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    want = plain(rows, k, num, den)
    assert sorted(map(tuple, got.collect()), key=str) == want
    return want


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (1, 1, 2), (3, 1, 1)])
def test_hard_rows(spark, docs, k, num, den):
    held(spark, docs, k, num, den)


def test_small_table(spark):
    want = held(spark, spark.read.parquet(f"{SF}/documents.parquet"), 3, 90, 100)
    assert any(c != d for d, _, c in want)


@pytest.mark.parametrize("lists", [2048, 4])
def test_families(spark, monkeypatch, lists):
    """Near copies that chain, that differ in shared or in own words, short texts at the threshold, and texts that share a passage."""
    monkeypatch.setattr(jaccard, "LIST", lists)
    rng = np.random.default_rng(11)
    texts = []
    for size, copies in ((60, 60), (120, 60), (12, 25), (10, 25), (4, 10)):
        base = [f"w{x}" for x in rng.integers(0, 10**6, size)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(0, size)] = str(rng.choice(["x", "y", f"u{rng.integers(0, 10**9)}"]))
            texts.append(" ".join(t[: size - rng.integers(0, 2)]))
    passage = [f"p{x}" for x in range(50)]
    texts += [" ".join([*passage, *(f"q{x}" for x in rng.integers(0, 10**6, 30))]) for _ in range(40)]
    texts += ["one", "one", "One two", "one two", "two one", "", None, " \n"]
    step = [f"s{x}" for x in range(200)]
    texts += [" ".join([*(f"t{i}" for i in range(j)), *step[j:]]) for j in range(0, 60, 2)]  # each near the next only
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string").repartition(5)
    want = held(spark, df, 3, 90, 100)
    assert len({c for _, _, c in want}) > 40


def test_lost_rows_and_ties(spark, none):
    assert jaccard.jaccard_components(none).isEmpty()
    rows = [(7, "a b c d"), (7, "a b c d"), (7, "e f g h"), (5, "e f g h"), (None, "a b c d"), (None, None), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(df, 3, 90, 100)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(7, 2, 7), (7, 2, 7), (7, 2, 5), (5, 2, 5), (None, 2, None), (None, 0, None), (9, 0, 9)], key=str)
    with pytest.raises(ValueError):
        jaccard.jaccard_components(df, 3, 0, 100)


def test_clashing_columns(spark, docs):
    extra = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("vid", "GID", "hi", "lo", "n", "rest", "component_id", "block", "root"))])
    plain_ = sorted(map(tuple, jaccard.jaccard_components(docs, 3, 90, 100).collect()), key=str)
    assert sorted(map(tuple, jaccard.jaccard_components(extra, 3, 90, 100).collect()), key=str) == plain_


def test_op12_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    got, want = QUERIES["op12_ngram_jaccard"](spark, SF), c.sql(ORACLE_SQL["op12_ngram_jaccard"])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
