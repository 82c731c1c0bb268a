"""A corpus pipeline: judge, drop near copies, drop repeated passages, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``.

Stages need doc_id, text and source (the last one doc_id and text); ``n_chars`` follows the text where there is one. Any
other columns, whatever their names, go through untouched: the operators see them as one value. Empty tables stay empty.
Null texts count as empty, null sources are a source of their own, and null doc_ids come after all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriscope.llm.exchange import scanned
from veriscope.llm.mixing import mix
from veriscope.llm.packing import pack
from veriscope.llm.rules import judge
from veriscope.llm.shared import cut_lineage, scratch_path, small
from veriscope.llm.simhash import near_duplicates
from veriscope.llm.substrings import dedup_substrings

#: Dropped rows up to this many are sent to every task by their numbers (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Four fingerprints of near copies: one of them differs by ``near`` bits or fewer, the other three by ``second`` in all.
COPIES = {"near": 7, "second": 28, "prints": 4, "search": 4}
NEEDED = ("doc_id", "text", "source")


def bundled(docs: DataFrame) -> DataFrame:
    """The needed columns and a struct ``others`` of all the rest, taken by place, so that no name can clash."""
    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = {c: docs.columns.index(c) for c in NEEDED if c in docs.columns}
    rest = [F.col(f"c{i}") for i in range(len(docs.columns)) if i not in at.values()]
    return flat.select(*[F.col(f"c{i}").alias(c) for c, i in at.items()], F.struct(*rest, F.lit(True).alias("end")).alias("others"))


def unbundled(df: DataFrame, docs: DataFrame, n_chars=None) -> DataFrame:
    """The columns of ``docs`` again, in their order, with ``n_chars`` in place of that column if it is given."""
    out = []
    for i, f in enumerate(docs.schema.fields):
        if f.name in NEEDED:
            col = F.col(f.name)
        elif f.name == "n_chars" and n_chars is not None:
            col = n_chars(F.col(f"others.c{i}")).cast(f.dataType)
        else:
            col = F.col(f"others.c{i}")
        out.append(col.alias(f.name))
    return df.select(*out)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps. Null, empty and blank texts fail; repeated rows are judged alike, once
    each; very long texts are judged whole."""
    return unbundled(judge(bundled(docs)).where("kept"), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row of smallest doc_id, those without one last. Near are five-word shingles of
    which one fingerprint of four differs by 7 bits of 64 or fewer and the other three by 28 of 192. Rows have a number of
    their own, so that repeated rows and copies without a doc_id are told apart; one of them stays. Texts without words
    are copies of each other."""
    rows = scanned(docs)
    rows = bundled(rows).withColumn("near_row", F.monotonically_increasing_id())
    near = near_duplicates(rows.select(F.col("near_row").alias("doc_id"), "text"), shingle=5, **COPIES).withColumnRenamed("doc_id", "near_row")
    known = cut_lineage(near.join(rows.select("near_row", "doc_id"), "near_row").select("near_row", "doc_id", "component_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "near_row")
    kept = known.groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first.near_row").alias("near_row"))
    dropped = cut_lineage(known.join(kept, "near_row", "left_anti").select("near_row"))
    return unbundled(rows.join(small(dropped, BROADCAST_IDS), "near_row", "left_anti"), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word passages that a document of smaller id has; what loses nothing stays as it is, null texts
    too. Rows that share a doc_id, or have none, are one document here: what they repeat of each other stays."""
    out = dedup_substrings(bundled(docs), keep_layout=True)
    return unbundled(out, docs, lambda old: F.when(F.col("dedup_removed") > 0, F.char_length("text")).otherwise(old))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight wants it; repeated rows fare alike. Documents of a source without
    words are not taken."""
    return unbundled(mix(bundled(docs)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 4096 tokens: one row per piece, with its ids. A null or empty text is its end mark;
    repeated rows are packed once each; a long text takes several sequences."""
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mixing),
    ("packing", packing),
]

#: EM, shingle hashing and tokenizing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
