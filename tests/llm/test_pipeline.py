"""The pipeline's stages, each against plain code over what the stage before it kept."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veriscope.llm import mixing, rules, simhash
from veriscope.llm.shared import scratch_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "test")
        stage(spark, kept[-1], SF).write.parquet(path)
        kept.append(spark.read.parquet(path))
    ids = [sorted(r["doc_id"] for r in k.select("doc_id").collect()) for k in kept]
    assert all(k.columns == columns for k in kept[:-1])
    assert ids[1] == sorted(r["doc_id"] for r in rules.judge(docs).where("kept").collect())
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(kept[1], **corpus_pipeline.COPIES).collect()}
    assert ids[2] == sorted(set(group.values()))
    assert ids[3] == ids[2] and set(ids[4]) <= set(ids[3]) and set(ids[5]) == set(ids[4])
    before, after = ({r["doc_id"]: r["text"] for r in k.collect()} for k in (kept[2], kept[3]))
    first = {}
    for k in sorted(before):
        w = before[k].split()
        drop = [False] * len(w)
        for i in range(len(w) - 12):
            if first.setdefault(tuple(w[i : i + 13]), k) < k:
                drop[i : i + 13] = [True] * 13
        assert after[k] == (before[k] if not any(drop) else " ".join(a for a, z in zip(w, drop) if not z))


def test_near_dedup_decides_on_rows(spark):
    a, b, c, d = (" ".join(f"{p}{i * 31 % 41}" for i in range(60)) for p in "abcd")
    rows = [(5, a), (5, a), (7, a), (None, a), (None, b), (None, b), (8, c), (8, d), (2, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [tuple(r) for r in corpus_pipeline.simhash_near_dedup(spark, docs, SF).select("doc_id", "text").collect()]
    assert sorted(out, key=str) == sorted([(5, a), (None, b), (2, c), (8, d)], key=str)


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, SF).count() > 0


CLASHING = ["n_words", "quality", "QUALITY_", "block", "dedup_words", "mix_copies", "mix_rate", "near_row", "component_id", "others", "kept", "fp"]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_hostile_rows(spark, docs, empty):
    """Null, empty, blank, repeated, very long and copied texts, null ids and sources, columns of clashing names."""
    # Two names that differ in case only cannot be looked up by name in Spark, nor written; each alone can.
    for upper in (False, True):
        made = docs.select("doc_id", "text", "lang", "source", F.lit(7).alias("n_chars"), *[F.lit(i).alias(c.upper() if upper else c) for i, c in enumerate(CLASHING)])
        made = made.limit(0) if empty else made
        path = scratch_path(spark, "test")
        made.write.parquet(path)
        d = spark.read.parquet(path)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, SF)
            assert out.dtypes == d.dtypes
            path = scratch_path(spark, "test")
            out.write.parquet(path)
            d = spark.read.parquet(path)
            for row in d.collect():
                assert [row[c.upper() if upper else c] for c in CLASHING] == list(range(len(CLASHING)))
                assert row["n_chars"] in (7, len(row["text"] or ""))
        assert corpus_pipeline.packing(spark, d, SF).select("doc_id").distinct().count() == d.select("doc_id").distinct().count()
        assert d.isEmpty() == empty


def test_mixing_and_substrings_take_all_rows(spark, docs):
    d = docs.withColumn("n_chars", F.lit(0))
    out = corpus_pipeline.substring_dedup(spark, d, SF)
    assert out.count() == d.count() and out.where("text is null").count() == d.where("text is null").count()
    copies = {(r["doc_id"], r["text"]): 0 for r in d.collect()}
    for r in corpus_pipeline.source_mixing(spark, d, SF).collect():
        copies[r["doc_id"], r["text"]] += 1
    rate = {(r["doc_id"], r["text"]): r["mix_copies"] for r in mixing.copies(d).collect()}
    repeated = Counter((r["doc_id"], r["text"]) for r in d.collect())
    assert copies == {k: n * repeated[k] for k, n in rate.items()}
