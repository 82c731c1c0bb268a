"""A quality classifier: an interpolated modified Kneser-Ney model of bytes, trained on trusted text."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .exchange import ANSWER, answers, opened, scanned, shard_bits, tagged, texts
from .shared import cut_lineage, mix, pack_ints, pack_sorted, runs, small, unpack_ints, unpack_sorted

#: Trusted documents up to this many are sent to every task by their ids (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
BROADCAST_LANGS = 100_000
#: Orders up to this are known to every task: at most 256 ** LOW n-grams, whatever the corpus. Higher ones stay in shards.
LOW = 3
_COUNTS, _OF_COUNTS, _LOW = 0, 1, 2


def grams(data: np.ndarray, off: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each byte, as a number, with zero bytes before each text."""
    n = np.diff(off)
    before = np.repeat(np.arange(len(n)) * (order - 1), n)
    padded = np.zeros(len(data) + (order - 1) * len(n), np.uint8)
    padded[np.arange(len(data)) + before + order - 1] = data
    key = np.zeros(max(0, len(padded) - order + 1), np.uint64)
    for j in range(order):
        key <<= np.uint64(8)
        key |= padded[j : len(padded) - order + 1 + j]
    return key[np.arange(len(data)) + before]


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The different numbers among some, in order."""
    return np.sort(pa.array(np.concatenate(parts)).unique().to_numpy()) if parts else np.zeros(0, np.uint64)


def by_shard(g: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in order of their shards, and where each shard's begin and end."""
    s = shard_of(g, bits)
    order = np.argsort(s, kind="stable")
    return g[order], np.searchsorted(s[order], np.arange((1 << bits) + 1))


def asked(docs, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a partition's texts, once each, by shard."""
    held: list[np.ndarray] = []
    for b in docs:
        for _, _, data, off in texts(b, 4 << 20):
            held.append(distinct([grams(data, off, order)]))
            if sum(map(len, held)) > 4_000_000:
                held = [distinct(held)]
    return by_shard(distinct(held), bits)


def _end(g: np.ndarray, size: int) -> np.ndarray:
    """The last bytes of n-grams."""
    return g & np.uint64((1 << 8 * size) - 1)


def shard_of(g: np.ndarray, bits: int) -> np.ndarray:
    """Shards go by the ``LOW`` bytes before the last one. An n-gram of more than ``LOW`` bytes, its context, and all
    longer n-grams that end in it agree in these, so that all they have to do with each other is in one shard."""
    return (mix(_end(g >> np.uint64(8), LOW)) >> np.uint64(64 - bits)).astype(np.int64)


def discounts(of_counts: dict[int, int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = (of_counts.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def lower(g: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``size`` bytes of distinct n-grams, and how many different n-grams end in them."""
    return np.unique(_end(g, size), return_counts=True)


class Order:
    """The n-grams of one order: the interpolated probability of each that was seen, and the weight that each context
    leaves to the order below."""

    def __init__(self, size: int, keys: np.ndarray, n: np.ndarray, d: tuple[float, float, float], below: list[Order]):
        self.size, self.keys = size, keys
        first = runs(keys >> np.uint64(8))
        self.context = (keys >> np.uint64(8))[first]
        off = np.choose(np.minimum(n, 3) - 1, d) if len(n) else np.zeros(0)
        each = np.diff(np.append(first, len(keys)))
        total, taken = (np.add.reduceat(x, first) if len(first) else np.zeros(0) for x in (n.astype(float), off))
        self.left = taken / total
        self.p = np.maximum(n - off, 0) / np.repeat(total, each) + np.repeat(self.left, each) * probability(keys, below)

    def __call__(self, g: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The probability of each n-gram's last byte, given that of the order below."""
        own = _end(g, self.size)
        at, seen = _find(self.context, own >> np.uint64(8))
        out = np.where(seen, self.left[at], 1.0) * p if len(self.left) else p.copy()
        at, seen = _find(self.keys, own)
        out[seen] = self.p[at[seen]]
        return out


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def probability(g: np.ndarray, orders: list[Order]) -> np.ndarray:
    p = np.full(len(g), 1 / 256)
    for order in orders:
        p = order(g, p)
    return p


def _folded(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g, n = (np.concatenate(x) for x in zip(*parts))
    u, at = np.unique(g, return_inverse=True)
    return u, np.bincount(at, n, len(u)).astype(np.int64)


def _two(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(8, "little") + a + b


def _apart(b: bytes) -> tuple[bytes, bytes]:
    n = int.from_bytes(b[:8], "little")
    return b[8 : 8 + n], b[8 + n :]


def counts(docs: DataFrame, order: int, bits: int) -> DataFrame:
    """By shard, in packed form: the n-grams of all texts with their counts (``_COUNTS``); for each order above ``LOW`` how
    many n-grams have counts 1 to 4 (``_OF_COUNTS``); and the ends of ``LOW`` bytes with the number of n-grams before them
    (``_LOW``)."""

    def run(batches):
        held = []
        for b in batches:
            for _, _, data, off in texts(b, 4 << 20):
                seen = pa.array(grams(data, off, order)).value_counts()
                held.append((seen.field("values").to_numpy(), seen.field("counts").to_numpy()))
                if sum(len(x) for x, _ in held) > 4_000_000:
                    held = [_folded(held)]
        if held:
            g, n = _folded(held)
            s = shard_of(g, bits)
            by = np.argsort(s, kind="stable")
            edge = np.searchsorted(s[by], np.arange((1 << bits) + 1))
            for x in np.flatnonzero(np.diff(edge)):
                mine = by[edge[x] : edge[x + 1]]
                yield from answers([(0, _COUNTS, int(x), _two(pack_sorted(g[mine]), pack_ints(n[mine])))]).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        shard, parts = table["shard"][0].as_py(), []
        for payload in table["payload"].to_pylist():
            g, n = _apart(payload)
            parts.append((unpack_sorted(g), unpack_ints(n, np.int64)))
            if sum(len(g) for g, _ in parts) > 4_000_000:
                parts = [_folded(parts)]
        g, n = _folded(parts)
        out, size, of = [(0, _COUNTS, shard, _two(pack_sorted(g), pack_ints(n)))], order, np.zeros((order + 1, 5), np.int64)
        while size > LOW:
            of[size] = np.bincount(np.minimum(n, 5) - 1, minlength=5)
            size -= 1
            g, n = lower(g, size)
        return answers([*out, (0, _OF_COUNTS, shard, pack_ints(of.ravel())), (0, _LOW, shard, _two(pack_sorted(g), pack_ints(n)))])

    return cut_lineage(docs.select("doc_id", "text").mapInArrow(run, ANSWER).groupBy("shard").applyInArrow(merge, ANSWER))


class Model:
    """What every task knows: the discounts of all orders and the orders up to ``LOW``."""

    def __init__(self, counted: DataFrame, order: int):
        self.order, of = order, np.zeros((order + 1, 5), np.int64)
        for r in counted.where(F.col("kind") == _OF_COUNTS).select("payload").toLocalIterator():
            of += unpack_ints(bytes(r["payload"]), np.int64).reshape(order + 1, 5)
        self.discounts = {k: discounts({i + 1: int(of[k, i]) for i in range(4)}) for k in range(LOW + 1, order + 1)}

        def unpacked(batches):
            for b in batches:
                for payload in b.column("payload").to_pylist():
                    g, n = _apart(payload)
                    yield pa.RecordBatch.from_arrays([pa.array(unpack_sorted(g).view(np.int64)), pa.array(unpack_ints(n, np.int64))], ["gram", "n"])

        rows = counted.where(F.col("kind") == _LOW).select("payload").mapInArrow(unpacked, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy("gram").toArrow()
        keys, n = rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        tables = []
        for size in range(min(LOW, order), 0, -1):
            tables.append((size, keys, n, discounts(dict(enumerate(np.bincount(np.minimum(n, 5), minlength=6).tolist())))))
            keys, n = lower(keys, size - 1)
        self.low: list[Order] = []
        for size, keys, n, d in reversed(tables):
            self.low.append(Order(size, keys, n, d, self.low))

    def orders(self, g: np.ndarray, n: np.ndarray) -> list[Order]:
        """All orders, those above ``LOW`` of a shard's n-grams."""
        tables = []
        for size in range(self.order, LOW, -1):
            tables.append((size, g, n, self.discounts[size]))
            g, n = lower(g, size - 1)
        out = list(self.low)
        for size, g, n, d in reversed(tables):
            out.append(Order(size, g, n, d, out))
        return out


def score(docs: DataFrame, trusted: DataFrame, order: int = 6, heldout: int = 10) -> DataFrame:
    """``doc_id``, ``lang``, ``n_bytes``, ``nll`` (negative log likelihood of the whole text's bytes) of every document.

    The model is trained on all documents of ``trusted`` (doc_id) but those that ``heldout_fold`` sets aside. N-grams are
    dealt to shards by the bytes before their last one, which keeps all orders above ``LOW`` of an n-gram together: a shard
    counts them once and builds its part of the model by itself. Each partition asks the shards for the n-grams it has,
    once, and scores its documents with the answers.
    """
    spark = docs.sparkSession
    docs = scanned(docs.select("doc_id", "text", "lang"))
    ids = cut_lineage(trusted.select("doc_id").where(F.col("doc_id").isNotNull() & ~heldout_fold("doc_id", heldout)).distinct())
    bits = shard_bits(spark, 4)
    counted = counts(docs.join(small(ids, BROADCAST_IDS), "doc_id", "left_semi"), order, bits)
    model = Model(counted, order)

    def ask(batches):
        block = TaskContext.get().partitionId()
        g, edge = asked(batches, order, bits)
        for x in np.flatnonzero(np.diff(edge)):
            yield from answers([(block, 0, int(x), pack_sorted(g[edge[x] : edge[x + 1]]))]).to_batches()

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        g, n = _apart(right["payload"][0].as_py()) if len(right) else (pack_sorted(np.zeros(0, np.uint64)), pack_ints(np.zeros(0, np.int64)))
        orders = model.orders(unpack_sorted(g), unpack_ints(n, np.int64))
        out = []
        for block, s, payload in zip(*(left[c].to_pylist() for c in ("block", "shard", "payload"))):
            p = np.log(probability(unpack_sorted(payload), orders)).astype(np.float32)
            out.append((block, 1, s, pack_ints(p.view(np.uint32))))
        return answers(out)

    known = counted.where(F.col("kind") == _COUNTS)
    told = docs.mapInArrow(ask, ANSWER).groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(tell, ANSWER)
    schema = T.StructType([docs.schema["doc_id"], docs.schema["lang"], T.StructField("n_bytes", T.LongType()), T.StructField("nll", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return arrow.empty_table()
        docs_ = opened(left)
        # Answers come in the order of the questions, which the texts give again.
        keys, edge = asked([docs_], order, bits)
        values = np.zeros(len(keys), np.float32)
        for shard, payload in zip(right["shard"].to_pylist(), right["payload"].to_pylist()):
            values[edge[shard] : edge[shard + 1]] = unpack_ints(payload, np.uint32).view(np.float32)
        order_ = np.argsort(keys)
        keys, values = keys[order_], values[order_]
        size, nll = [np.zeros(0, np.int64)], [np.zeros(0)]
        for _, _, data, off in texts(docs_, 4 << 20):
            coded = pa.array(grams(data, off, order)).dictionary_encode()
            own = values[np.searchsorted(keys, coded.dictionary.to_numpy())]
            at = coded.indices.to_numpy()
            total = np.concatenate(([0.0], np.cumsum(own[at], dtype=np.float64)))
            size.append(np.diff(off))
            nll.append(-np.diff(total[off]))
        return pa.table([docs_["doc_id"].cast(arrow.field("doc_id").type), docs_["lang"].cast(arrow.field("lang").type), pa.array(np.concatenate(size), pa.int64()), pa.array(np.concatenate(nll), pa.float64())], schema=arrow)

    return tagged(docs).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(add_up, schema)


def heldout_fold(doc_id: str, one_in: int):
    """One in so many documents, by hash: they set thresholds and don't train."""
    return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(one_in)) == 0


def classify(docs: DataFrame, trusted: DataFrame, order: int = 6, quantile: float = 0.99, prior_bytes: float = 100.0, slack: float = 1.05, heldout: int = 10) -> DataFrame:
    """``doc_id``, ``lang``, ``n_bytes``, ``perplexity`` (per byte), ``threshold``, ``kept``, for every document.

    Needs doc_id, text, lang; ``trusted`` has the doc_ids of trusted texts, which must be among the documents. A
    document is kept if its score is at most its language's threshold, the ``quantile`` of the scores of the trusted
    documents held out (one in ``heldout``, by hash), times ``slack``. The score is the perplexity with ``prior_bytes``
    bytes of the language's mean log likelihood added, as that of a short text says little. Quantiles come from sketches
    of bounded size. A language without held-out documents, null among them, gets the threshold of all. Null and empty
    texts have perplexity 1 and are not kept. Without trusted documents nothing is kept. Rows that repeat a doc_id are
    scored by their own texts and judged by their own languages; rows without one are scored, too, and train nothing; very
    long texts are scored whole; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    base = cut_lineage(score(docs, trusted, order, heldout))
    held = base.join(trusted.select("doc_id").distinct().where(heldout_fold("doc_id", heldout)), "doc_id", "left_semi").where(F.col("n_bytes") > 0)
    mean = F.sum("nll") / F.sum("n_bytes")
    sums = cut_lineage(held.groupBy("lang").agg(mean.alias("mean")))
    overall = held.agg(mean.alias("mean")).first()["mean"]
    overall = overall if overall is not None else math.log(256)
    adjusted = F.exp((F.col("nll") + F.coalesce("mean", F.lit(overall)) * prior_bytes) / (F.col("n_bytes") + prior_bytes))

    def with_mean(df):
        return df.join(small(sums.select(F.col("lang").alias("mean_lang"), "mean"), BROADCAST_LANGS), F.col("lang").eqNullSafe(F.col("mean_lang")), "left").withColumn("score", adjusted)

    top = F.percentile_approx("score", quantile, 10_000)
    limits = cut_lineage(with_mean(held).groupBy("lang").agg(top.alias("own_limit")))
    limit = with_mean(held).agg(top.alias("x")).first()["x"]
    out = with_mean(base).join(small(limits.select(F.col("lang").alias("limit_lang"), "own_limit"), BROADCAST_LANGS), F.col("lang").eqNullSafe(F.col("limit_lang")), "left")
    threshold = F.coalesce("own_limit", F.lit(limit if limit is not None else 0.0)) * slack
    perplexity = F.when(F.col("n_bytes") > 0, F.exp(F.col("nll") / F.col("n_bytes"))).otherwise(1.0)
    return out.select("doc_id", "lang", "n_bytes", perplexity.alias("perplexity"), "score", threshold.alias("threshold"), ((F.col("n_bytes") > 0) & (F.col("score") <= threshold)).alias("kept"))


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Verdicts on all documents; trusted are those labelled good and not toxic."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels.where("quality = 1 and toxic = 0"))
