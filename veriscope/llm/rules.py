"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, a posterior decides."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import IS_WHITE, Words, chunks, mix, others, runs, strings, window_hashes, window_rows, word_hashes

# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_plain_words", "n_distinct_words")
WINDOW = 5
_WHITE = " \t\n\x0b\x0c\r"


def _per_doc(first: np.ndarray, flags: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def _repeats(h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which entries have an equal in the same document."""
    key = mix(h ^ mix(docs.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    s = key[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    out = np.zeros(len(s), bool)
    out[order] = same
    return out


def _measure(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The features of each text, in the order of FEATURES."""
    w = Words(data, off)
    docs = len(off) - 1
    n_words = np.diff(w.first)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    lead = (data & 0xC0) != 0x80
    word_chars = _per_doc(off, lead & ~IS_WHITE[data])
    n_symbols = _per_doc(off, symbol[data])
    doc_of = np.repeat(np.arange(docs), n_words)
    h = word_hashes(w, 11)
    # Words of windows that the text has twice.
    at, win_doc = window_rows(w.first, WINDOW)
    twice = _repeats(window_hashes(h, WINDOW, 12)[at], win_doc) if len(at) else np.zeros(0, bool)
    step = np.zeros(len(w) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + WINDOW, -1)
    n_repeat = _per_doc(w.first, np.cumsum(step[:-1]) > 0) if len(w) else np.zeros(docs, np.int64)
    # Kinds of words.
    solid, first = w.solid, np.cumsum(w.length) - w.length
    upper, lower = (solid >= 0x41) & (solid <= 0x5A), (solid >= 0x61) & (solid <= 0x7A)
    if len(w):
        ups, lows = np.add.reduceat(upper.astype(np.int64), first), np.add.reduceat(lower.astype(np.int64), first)
        odd = ~(upper | lower | (solid >= 0x80))
        marks = np.add.reduceat(odd.astype(np.int64), first)
        ends = odd[first + w.length - 1]
        shout, plain = (ups >= 2) & (lows == 0), (marks == 0) | ((marks == 1) & ends & (w.length > 1))
        order = np.argsort(mix(h ^ mix(doc_of.astype(np.uint64) + np.uint64(1))))
        new = runs(h[order], doc_of[order])
        distinct = np.bincount(doc_of[order][new], minlength=docs)
    else:
        shout = plain = np.zeros(0, bool)
        distinct = np.zeros(docs, np.int64)
    n_dup, n_lines = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    for d in range(docs):
        text = data[off[d] : off[d + 1]].tobytes()
        lines = [x for x in text.split(b"\n") if x.strip(_WHITE.encode())]
        n_lines[d], n_dup[d] = len(lines), len(lines) - len(set(lines))
    return [n_words, word_chars, n_symbols, n_dup, n_repeat, n_lines, _per_doc(w.first, shout), _per_doc(w.first, plain), distinct]


def features(docs: DataFrame) -> DataFrame:
    """``docs`` with the features of every whole text; null counts as empty. Columns of these names, in any case, are
    replaced."""
    own = others(docs, FEATURES)
    docs = docs.select(*own)
    schema = T.StructType(docs.schema.fields + [T.StructField(c, T.LongType()) for c in FEATURES])

    def run(batches):
        for b in batches:
            data, off = strings(b.column("text"))
            for lo, hi in chunks(off):
                measured = _measure(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns, *(pa.array(x, pa.int64()) for x in measured)], [*own, *FEATURES])

    return docs.mapInArrow(run, schema)


def share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Each rule votes -1 (bad), 1 (good) or 0 (abstains)."""
    n, length = F.col("n_words"), share("word_chars", "n_words")
    return {
        "long_enough": vote(n < 10, n >= 25),
        "few_repeats": vote(F.col("n_repeat_words") * 100 > 20 * n, F.col("n_repeat_words") * 100 <= 5 * n),
        "few_symbols": vote(F.col("n_symbols") * 10 > n, F.col("n_symbols") * 100 <= n),
        "few_equal_lines": vote(F.col("n_dup_lines") * 3 > F.col("n_lines"), F.col("n_dup_lines") * 10 <= F.col("n_lines")),
        "word_length": vote((length < 2.5) | (length > 12), (length >= 3) & (length <= 10)),
        "not_shouting": vote(F.col("n_upper_words") * 10 > 3 * n, F.col("n_upper_words") * 20 <= n),
        "plain_words": vote(F.col("n_plain_words") * 10 < 7 * n, F.col("n_plain_words") * 10 >= 9 * n),
        "varied_words": vote((n >= 20) & (F.col("n_distinct_words") * 5 < n) & (F.col("n_distinct_words") < 200), F.col("n_distinct_words") * 3 >= n),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100, smooth: float = 1.0) -> tuple[np.ndarray, float]:
    """EM over counted vote patterns: log odds of good for each rule's vote (columns bad, abstain, good), and of the prior.

    Votes are independent given the class, with a probability for each vote in either class. The first guess takes the
    share of bad votes. A vote for good never counts against a document, nor one for bad in its favour.
    """
    m = len(patterns[0][0])
    votes, n = np.array([p for p, _ in patterns]), np.array([c for _, c in patterns], float)
    bad, cast = (votes < 0).sum(1), np.maximum((votes != 0).sum(1), 1)
    good = np.where(bad == 0, 0.99, np.clip(0.5 - bad / cast, 0.01, 0.5))
    weight, prior = np.zeros((m, 3)), 0.0
    for _ in range(rounds):
        total = np.array([(n * (1 - good)).sum(), (n * good).sum()])
        prior = math.log((total[1] + smooth) / (total[0] + smooth))
        for v in (-1, 0, 1):
            seen = np.stack([(n * (1 - good)) @ (votes == v), (n * good) @ (votes == v)]) + smooth
            rate = seen / (total[:, None] + 3 * smooth)
            weight[:, v + 1] = np.log(rate[1] / rate[0])
        weight[:, 0], weight[:, 2] = np.minimum(weight[:, 0], 0), np.maximum(weight[:, 2], 0)
        odds = prior + sum(weight[j, votes[:, j] + 1] for j in range(m))
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return weight, prior


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` with the features, ``base_failed``, each rule's vote, ``quality`` (posterior probability of good), ``kept``.

    Needs ``text``; other columns pass through, those of the added names (in any case, ``vote_`` with a rule's name among
    them) are replaced. Texts are measured twice, once to
    count the vote patterns and once to judge, so that nothing has to be kept or joined between. Only the counts of
    patterns come to the driver: at most three to the power of the number of rules, whatever the input. Empty and null
    texts fail the base; repeated rows are judged alike, once each; an empty table gives no rows.
    """
    names = list(rules())

    def voted(df):
        return features(df).withColumns({f"vote_{k}": v.cast("byte") for k, v in rules().items()})

    counted = voted(docs.select("text")).groupBy(*[f"vote_{k}" for k in names]).count().collect()
    patterns = sorted((tuple(int(r[f"vote_{k}"]) for k in names), r["count"]) for r in counted)
    weight, prior = estimate(patterns) if patterns else (np.zeros((len(names), 3)), 0.0)
    odds = F.lit(prior)
    for j, k in enumerate(names):
        odds = odds + F.element_at(F.array(*[F.lit(float(x)) for x in weight[j]]), F.col(f"vote_{k}").cast("int") + 2)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > 20 * F.col("n_words"))
    docs = docs.select(*others(docs, ["base_failed", "quality", "kept", *(f"vote_{k}" for k in names)]))
    out = voted(docs).withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the verdict on all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
