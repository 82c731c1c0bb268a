"""Mixing sources to target weights by repeating and thinning documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, cut_lineage, small, word_count

#: Sources up to this many are sent to every task (some 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 200_000
TOP = float(2**52)


def coin(key: Column, seed: int) -> Column:
    """A number in [0, 1) that a key and a seed determine: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(TOP)


def source_targets(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3, source: str = "source", text: str = "text") -> DataFrame:
    """One row per source: its words, its target and the repetition rate.

    Sources are taken by code point, null last, and get the weights in turn. Targets share all words by weight, but stop
    at ``most`` times their source's words; the rest is shared anew by weight until no target is above. That is
    ``min(most * words, level * weight)`` for one level, found by going through the sources in order of
    ``words / weight``. The two ordered windows run over one row per source, never over documents.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(word_count(F.col(text))).alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * float(most)
    s = sizes.withColumn("weight", weight)
    s = s.select(
        "source", "source_size", "weight",
        F.coalesce(F.sum(cap).over(before), F.lit(0.0)).alias("spent"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open_weight"),
        F.sum("source_size").over(every).cast("double").alias("total"),
    )
    level = (F.col("total") - F.col("spent")) / F.col("open_weight")
    s = s.withColumn("level", F.when(cap > level * F.col("weight"), level))
    s = s.withColumn("level", F.max("level").over(every))
    target = F.least(cap, F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)))
    return s.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def copies(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies``.

    A document is taken ``floor(rate)`` times, and once more if its coin (hash of seed and doc_id, so that reruns agree
    and repeated rows fare alike; without a doc_id, of the text) falls below the fraction. A null text counts no words; a source without words has the
    rate 0; an empty table gives an empty one. Columns of ``docs`` stay as they are; those named mix_*, in any case, are
    replaced.
    """
    own = [c for c in docs.columns if not c.lower().startswith("mix_")]
    sources = cut_lineage(source_targets(docs, weights, most))
    rates = sources.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("rate").alias("mix_rate"))
    rates = small(rates, BROADCAST_SOURCES)
    base = docs.select(*own)
    rate, extra = F.col("mix_rate"), F.col("mix_rate") - F.floor("mix_rate")
    return base.join(rates, base["source"].eqNullSafe(rates["mix_source"])).select(
        *[base[c] for c in own], word_count(base["text"]).alias("mix_size"), "mix_source_size", "mix_target",
        (F.floor(rate) + F.when(coin(F.coalesce(base["doc_id"].cast("string"), F.md5(base["text"]), F.lit("")), seed) < extra, 1).otherwise(0)).cast("long").alias("mix_copies"),
    )


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = (5, 2, 1), most: float = 3) -> DataFrame:
    """The mixture: each document as often as it is taken, with its own columns and ``mix_copy`` from 1."""
    taken = copies(docs, seed, weights, most)
    own = [c for c in docs.columns if not c.lower().startswith("mix_")]
    times = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1), F.col("mix_copies").cast("int")))
    return taken.select(*own, F.explode(times).alias("mix_copy"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the mixture of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return copies(docs).select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


OP6_SQL = f"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, (list_value(5.0, 2.0, 1.0))[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w from d group by source),
o as (select *, coalesce(sum(source_size * 3.0::double) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as spent,
  sum(w) over () - coalesce(sum(w) over (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as ow,
  (sum(source_size) over ())::double as total from s),
l as (select max((total - spent) / ow) as level from o where source_size * 3.0::double > (total - spent) / ow * w),
t as (select source, source_size, least(source_size * 3.0::double, coalesce(level * w, 0)) as target from o, l)
select doc_id, size, source_size, target,
  size * (floor(case when source_size > 0 then target / source_size else 0 end)
    + case when ('0x' || substr(md5('0:' || doc_id::varchar), 1, 13))::ubigint::double / 4503599627370496.0::double
        < (case when source_size > 0 then target / source_size else 0 end) - floor(case when source_size > 0 then target / source_size else 0 end)
      then 1 else 0 end)::bigint as taken
from d join t on d.source is not distinct from t.source
"""
