"""Spelling variants: words one edit apart, met by their single deletions, and the roots that forms lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut_lineage

RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _lowered(word: Column) -> Column:
    """A-Z alone are lower-cased; most words have none and are left as they are."""
    return F.when(word.rlike("[A-Z]"), F.translate(word, _UPPER, _UPPER.lower())).otherwise(word)


def _without(word: Column, at: Column) -> Column:
    """``word`` without the code point at ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))


def words(docs: DataFrame, every: int | None = None) -> DataFrame:
    """``word`` and ``n``: how often each word stands in all texts.

    Words are the longest runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased. With ``every``, a run whose h, the
    crc32 of ``<doc_id>:<run>``, ``every`` divides loses its code point number h % length (planted misspellings; without
    a doc_id nothing stands before the colon). Null and empty texts have no words. Counts are made in each partition
    before words are shuffled, so that a frequent word is one row a partition.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).select("doc_id", _lowered(F.col("run")).alias("run"))
    if every:
        h = F.crc32(F.encode(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")), "UTF-8"))
        runs = runs.select("run", h.alias("h"))
        run = F.when(F.col("h") % every == 0, _without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    else:
        run = F.col("run")
    return runs.select(run.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def near_pairs(counts: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for all pairs one insertion, deletion or replacement of a code point apart, both ways.

    Each word emits itself and its distinct single deletions as keys. Words one edit apart share exactly one key: the
    shorter one, or what both leave without the code point in which they differ; so that no pair comes twice. Words that
    share a key are two edits apart at most, and exact distance is verified. A key has no more words than the alphabet
    allows (90 letters at each of its places), however many texts there are.
    """
    places = F.sequence(F.lit(0), F.length("word") - 1)
    keys = F.array_union(F.array("word"), F.array_distinct(F.transform(places, lambda i: _without(F.col("word"), i.cast("int")))))
    keyed = counts.where(F.length("word") > 0).select("word", "n", F.explode(keys).alias("key"))
    other = keyed.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = keyed.join(other, "key").where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    return pairs.select("word", "n", "other", "other_n")


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """(word, root) of rows (word, form): the last word that forms lead to.

    Each round joins a word's root with that root's own, which doubles the way, until none moves. Forms must not run in
    circles; where each form is more frequent than its word they can't.
    """
    state = cut_lineage(forms.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        step = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut_lineage(state.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state
    raise ValueError("forms run in circles")


def variants(counts: DataFrame, ratio: int = 5) -> DataFrame:
    """Rows (word, n) with ``n_near``, ``form``, ``form_n`` and ``root``.

    ``form`` is the near word of largest n (ties: smallest by code points) if that is ``ratio`` times the word's n or
    more, else null; ``root`` follows forms to the last (the word itself if it has none). Words must be distinct; an
    empty one has no near words here; no rows give no rows. ``ratio`` is 2 or more, so that forms can't run in circles.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    counts = cut_lineage(counts.select("word", "n"))
    # Strings compare by UTF-8 bytes, which is the order of code points.
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = near_pairs(counts).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = counts.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.minus") >= ratio * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))).alias("of"))
    found = cut_lineage(found.select("word", "n", "n_near", F.col("of.form").alias("form"), F.col("of.form_n").alias("form_n")))
    led = roots(found.where(F.col("form").isNotNull()))
    return found.join(led, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5, every: int | None = None) -> DataFrame:
    """The variants among the words of all texts that have ``least_length`` code points and occur ``least_count`` times.

    Needs ``doc_id`` and ``text``; other columns are ignored, whatever their names. See ``words`` for nulls and empty
    texts, ``variants`` for ties; a repeated row counts again; an empty table gives no rows; long texts are read whole.
    """
    counts = words(docs.select("doc_id", "text"), every)
    return variants(counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count)), ratio)


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Contract columns for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spelling_variants(docs, every=199).select("word", "form", "root", "n", "n_near", "form_n")


OP13_SQL = r"""
with recursive
bits as (select i, i::bigint as v from range(256) t(i)),
tbl as (select list(list_reduce(list_prepend(v, [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from bits),
r as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
d as (select doc_id, run, count(*) as c from r group by all),
b as (select doc_id, run, c, flatten(list_transform(range(1, len(coalesce(doc_id::varchar, '')) + len(run) + 2), lambda i: (case when unicode(substr(coalesce(doc_id::varchar, '') || ':' || run, i, 1)) < 128
  then [unicode(substr(coalesce(doc_id::varchar, '') || ':' || run, i, 1))::bigint]
  else [192 + (unicode(substr(coalesce(doc_id::varchar, '') || ':' || run, i, 1)) >> 6)::bigint, 128 + (unicode(substr(coalesce(doc_id::varchar, '') || ':' || run, i, 1)) & 63)::bigint] end))) as bytes from d),
h as (select run, c, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda x, y: xor(x >> 8, t[xor(x & 255, y) + 1])), 4294967295::bigint) as h from b, tbl),
w as (select case when h % 199 = 0 then substr(run, 1, (h % len(run))::int) || substr(run, (h % len(run))::int + 2) else run end as word, sum(c)::bigint as n from h group by 1),
v as (select word, n from w where len(word) >= 6 and n >= 5),
e as (select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) as rest from v, range(0, 200) k(i) where i < len(word)),
p as (select distinct a.word, b.word as other, b.n as other_n from e a join e b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select e.word, v.word, v.n from e join v on e.rest = v.word
  union select v.word, e.word, e.n from e join v on e.rest = v.word),
f as (select word, count(*)::bigint as n_near, max(other_n) as most from p group by word),
o as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when most >= 5 * v.n then (select min(other) from p where p.word = v.word and p.other_n = f.most) end as form, case when most >= 5 * v.n then most end as form_n from v left join f using (word)),
g as (select word, word as here, 0 as step from o union all select g.word, o.form, step + 1 from g join o on g.here = o.word where o.form is not null)
select o.word, o.form, z.root, o.n, o.n_near, o.form_n from o join (select word, arg_max(here, step) as root from g group by word) z using (word)
"""
