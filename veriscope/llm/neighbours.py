"""Approximate nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut_lineage, member, mix, runs

#: Bytes of base vectors in a group of buckets, and queries that visit it, as far as estimates from samples can tell. Each
#: group returns up to k rows for each query that visits it, so that small groups would cost more than they save.
BLOCK_BYTES, VISITORS = 32 << 20, 1 << 16
#: Norms within a factor of 2 ** (1 / BANDS) are hashed together; the vectors of bands of fewer than RARE are looked at by every query.
BANDS, RARE = 4, 256
#: Queries whose exact neighbours set the probing radius, and base rows from which the sizes of groups are estimated.
SAMPLE_QUERIES, SAMPLE_ROWS = 96, 2048
#: Widest rotation that is kept as a matrix.
FOLDED = 256
#: Rows of a bucket from which its pairs are scored by a product of matrices.
DENSE = 32
NEAR = "query_id long, vec_id long, score double"
_ROW = "grp long, part int, slice int, query boolean, vec_id long, vec binary, codes array<int>"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


class Hashes:
    """``tables`` x ``functions`` cross-polytope hashes of vectors of ``dim``: three rounds of random signs and a Hadamard
    transform, then the nearest signed axis. ``longest`` is the greatest norm of a band; where its norms differ, one more
    coordinate brings all its base vectors to it, so that the nearest by angle are the nearest by inner product.

    A bucket's code joins the axes of all functions. What a query loses by looking into a bucket is, over the functions,
    the sum of the squared gaps between its best axis and the bucket's."""

    def __init__(self, dim: int, tables: int, functions: int, longest: float, equal: bool, seed: int):
        self.dim, self.tables, self.functions, self.longest, self.equal = dim, tables, functions, longest, equal
        self.width = 1 << max(0, (dim + (not equal) - 1).bit_length())
        n = tables * functions * 3 * self.width
        bits = mix(np.arange(n, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(63)
        self.signs = (1.0 - 2.0 * bits.astype(np.float64)).reshape(tables, functions, 3, self.width)
        self.buckets = (2 * self.width) ** functions
        # Narrow rotations are folded into one matrix by rotating the axes: the same map, in one product.
        self.folded = np.stack([[self._rotated(np.eye(self.width), t, f) for f in range(functions)] for t in range(tables)]) if self.width <= FOLDED else None

    def _rotated(self, x: np.ndarray, t: int, f: int) -> np.ndarray:
        for s in self.signs[t, f]:
            x = hadamard(x * s)
        return x

    def padded(self, x: np.ndarray, base: bool) -> np.ndarray:
        """Base vectors within the unit ball, or on its sphere by one more coordinate; queries at unit length."""
        out = np.zeros((len(x), self.width))
        out[:, : self.dim] = x / (self.longest if base else np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) * np.abs(x).max(1, keepdims=True))
        if not self.equal and base:
            out[:, self.dim] = np.sqrt(np.maximum(0, 1 - (out[:, : self.dim] ** 2).sum(1)))
        return out

    def _axes(self, x: np.ndarray, t: int, f: int) -> np.ndarray:
        x = x @ self.folded[t, f] if self.folded is not None else self._rotated(x, t, f)
        return np.concatenate([x, -x], axis=1)

    def base(self, padded: np.ndarray, t: int) -> np.ndarray:
        """Each row's bucket."""
        out = np.zeros(len(padded), np.int64)
        for f in range(self.functions):
            out = out * (2 * self.width) + self._axes(padded, t, f).argmax(1)
        return out

    def losses(self, padded: np.ndarray, t: int) -> list[np.ndarray]:
        """Of each function the squared gap of each axis, by query."""
        y = [self._axes(padded, t, f) for f in range(self.functions)]
        return [(x.max(1)[:, None] - x) ** 2 for x in y]

    def loss_of(self, losses: list[np.ndarray], row: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What queries ``row`` lose in buckets ``code``."""
        out = np.zeros(len(row))
        for g in reversed(losses):
            out += g[row, code % (2 * self.width)]
            code = code // (2 * self.width)
        return out

    def probes(self, padded: np.ndarray, t: int, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, code): all buckets in which a query loses ``radius`` or less, in order."""
        first, *others = self.losses(padded, t)
        row, code = np.nonzero(first <= radius)
        loss = first[row, code]
        for g in others:
            got = []
            for lo in range(0, len(row), 1 << 14):
                c = slice(lo, lo + (1 << 14))
                at, axis = np.nonzero(loss[c, None] + g[row[c]] <= radius)
                got.append((row[c][at], code[c][at] * (2 * self.width) + axis, loss[c][at] + g[row[c][at], axis]))
            row, code, loss = (np.concatenate(x) for x in zip(*got)) if got else (row, code, loss)
        return row, code


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of numbers as binaries, without a Python object for each."""
    x = np.ascontiguousarray(x)
    off = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off), pa.py_buffer(x)])


def _matrix(column, kind: str) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1).astype(np.float64)


def _near_top(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's ``k`` largest, and of what rounding may have put below them."""
    if s.shape[1] > k:
        edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        return np.nonzero((s >= (edge - 1e-9 * np.maximum(1, np.abs(edge)))[:, None]) & (s > -np.inf))
    return np.nonzero(s > -np.inf)


def _keep(row: np.ndarray, col: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of scored pairs each row's ``k`` best, and what rounding may have put below them."""
    order = np.lexsort((-score, row))
    row, col, score = row[order], col[order], score[order]
    first = runs(row)
    n = np.diff(np.append(first, len(row)))
    edge = np.where(n > k, score[np.minimum(first + k - 1, len(row) - 1)], -np.inf)
    keep = score >= np.repeat(edge - 1e-9 * np.maximum(1, np.abs(edge)), n)
    return row[keep], col[keep], score[keep]


def _finish(q, q_ids, b, b_ids, got: list[tuple[np.ndarray, ...]], k: int) -> pa.Table:
    """The ``k`` best of each query among scored pairs, scored anew pair by pair; ties to the smaller id."""
    row, col, _ = _keep(*(np.concatenate(x) for x in zip(*got)), k)
    exact = np.einsum("ij,ij->i", q[row], b[col])
    order = np.lexsort((b_ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.table({"query_id": pa.array(q_ids[row[keep]], pa.int64()), "vec_id": pa.array(b_ids[col[keep]], pa.int64()), "score": pa.array(exact[keep], pa.float64())})


def _best(q: np.ndarray, q_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, k: int) -> pa.Table:
    """The ``k`` best base rows of each query, among all."""
    got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for lo in range(0, len(q), 256):
        s = q[lo : lo + 256] @ b.T
        s[q_ids[lo : lo + 256, None] == b_ids[None, :]] = -np.inf
        row, col = _near_top(s, k)
        got.append((row + lo, col, s[row, col]))
    return _finish(q, q_ids, b, b_ids, got, k)


def _probed(q: np.ndarray, q_ids: np.ndarray, row: np.ndarray, code: np.ndarray, b: np.ndarray, b_ids: np.ndarray, b_code: np.ndarray, k: int) -> tuple[pa.Table, int]:
    """The ``k`` best of each query among the base rows of its buckets (``row``, ``code``); and how many pairs were scored."""
    order = np.argsort(b_code, kind="stable")
    b, b_ids, b_code = b[order], b_ids[order], b_code[order]
    begin = runs(b_code)
    here, end = b_code[begin], np.append(begin[1:], len(b_code))
    hit = member(here, code)
    row, code = row[hit], code[hit]
    size = end - begin
    got, at = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], np.searchsorted(here, code)
    scored = int(size[at].sum())
    # Pairs of small buckets one by one, queries in order.
    few = np.flatnonzero(size[at] < DENSE)
    few = few[np.argsort(row[few], kind="stable")]
    upto = np.cumsum(size[at[few]])
    cut = np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, 1 << 15))
    for lo, hi in zip(cut, np.append(cut[1:], len(few))):
        n = size[at[few[lo:hi]]]
        i = np.repeat(row[few[lo:hi]], n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at[few[lo:hi]]], n)
        other = q_ids[i] != b_ids[j]
        i, j = i[other], j[other]
        if len(i):
            got.append(_keep(i, j, np.einsum("ij,ij->i", q[i], b[j]), k))
    # Larger ones by products of matrices.
    many = np.flatnonzero(size[at] >= DENSE)
    many = many[np.argsort(at[many], kind="stable")]
    edges = runs(at[many])
    for lo, hi in zip(edges, np.append(edges[1:], len(many))):
        a, z = begin[at[many[lo]]], end[at[many[lo]]]
        for c in range(a, z, 4096):
            for r in range(lo, hi, 1024):
                own, some = row[many[r : min(hi, r + 1024)]], slice(c, min(z, c + 4096))
                s = q[own] @ b[some].T
                s[q_ids[own, None] == b_ids[None, some]] = -np.inf
                i, j = _near_top(s, k)
                got.append((own[i], j + c, s[i, j]))
    return _finish(q, q_ids, b, b_ids, got, k), scored


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` of the vectors that are neither null nor zero and hold only finite numbers."""
    v = F.col("embedding")
    if not isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType):
        v = v.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


class Index:
    """What every task knows of the index: the bands and their hashes, the probing radius, and how buckets are dealt to
    groups, groups to parts and their visitors to slices. Its size is bounded by the parameters and the samples."""

    def __init__(self, bands: list[tuple[int, int, Hashes]], others: int, queries: int, radius: float, block: int):
        self.bands, self.others, self.queries, self.radius, self.block = bands, others, queries, radius, block
        #: Groups of buckets that a table of each band has; the last group of all holds the rare bands.
        self.groups = [min(h.buckets, max(1, -(-n // block))) for _, n, h in bands]
        self.first = np.cumsum([0, *(g * h.tables for g, (_, _, h) in zip(self.groups, bands))])
        self.parts: dict[int, int] = {}
        self.slices: dict[int, int] = {}

    def group(self, i: int, t: int, code: np.ndarray) -> np.ndarray:
        h = self.bands[i][2]
        return self.first[i] + t * self.groups[i] + code * self.groups[i] // h.buckets

    def tables(self):
        for i, (band, _, h) in enumerate(self.bands):
            for t in range(h.tables):
                yield i, band, h, t

    def fit(self, x: np.ndarray, band: np.ndarray, q: np.ndarray):
        """Sizes of groups from samples: those that a share of the sample says are too large for a task are dealt out.
        Rows go somewhere whatever the estimate; it decides only how much a task holds."""
        share = self.queries / max(1, len(q))
        for i, at, h, t in self.tables():
            n = self.bands[i][1]
            own = h.padded(x[band == at], True)
            if len(own):
                g, c = np.unique(self.group(i, t, h.base(own, t)), return_counts=True)
                self.parts |= {int(a): -(-int(b * n) // (len(own) * 2 * self.block)) for a, b in zip(g, c) if b >= 8 and b * n > 2 * self.block * len(own)}
            row, code = h.probes(h.padded(q, False), t, self.radius)
            g, c = np.unique(np.unique(np.stack([row, self.group(i, t, code)]), axis=1)[1], return_counts=True)
            self.slices |= {int(a): -(-int(b * share) // VISITORS) for a, b in zip(g, c) if b * share > VISITORS}
        self.parts[int(self.first[-1])] = max(1, -(-self.others // self.block))
        self.slices[int(self.first[-1])] = max(1, -(-self.queries // VISITORS))

    @staticmethod
    def count(of: dict[int, int], g: np.ndarray) -> np.ndarray:
        keys, at = np.unique(g, return_inverse=True)
        return np.array([of.get(int(k), 1) for k in keys], np.int64)[at] if len(keys) else np.zeros(0, np.int64)


def search(vectors: DataFrame, every: int, k: int, tables: int = 16, functions: int = 2, recall: float = 0.94, seed: int = 7) -> DataFrame:
    """The ``k`` nearest found of each vector whose vec_id is divisible by ``every``, by inner product, itself left out.

    ``vectors`` needs vec_id and embedding (all of one length; other lengths than the commonest raise); other columns are
    ignored. Null, zero and non-finite vectors take no part. Rows that repeat a vec_id count once, by their best score.
    Of equal vectors the ``k + 1`` smallest ids can be among anyone's nearest, so only these are indexed, which keeps a
    vector that a third of the rows repeat from filling a bucket; all other vectors are indexed, in ``tables`` tables of
    their band of norms, so that a few long vectors don't spoil the others' hashes.

    ``functions`` hashes name a bucket. A query looks into every bucket in which it loses no more than a radius. That
    radius is measured in each run, at any size of the table: ``SAMPLE_QUERIES`` queries drawn by hash meet every vector,
    in one pass, and the radius is the least at which the share ``recall`` of their true neighbours lies in a probed
    bucket. So no setting is tied to a size, and where the data have no structure more is probed instead of lost.

    Rows are dealt by groups of neighbouring buckets (``BLOCK_BYTES`` or so); a query goes once to each group in which it
    probes, with its buckets' codes there. Groups that a sample of ``SAMPLE_ROWS`` rows says are much larger are dealt out
    in parts that all their queries visit. Vectors of rare norms are one group that every query visits. Queries that found
    fewer than there are, up to ``k``, meet every vector, in blocks. The driver gets counts by band (whose number the
    exponents of doubles bound) and the samples, never a count by bucket. Candidates are scored in double precision on the
    original vectors. Ties go to the smaller vec_id. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    valid = valid_vectors(vectors)
    single = isinstance(valid.schema["v"].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # Unit vectors, as rounded, lie within a band.
    band = F.floor(F.greatest(F.lit(-2000.0), F.least(F.lit(2000.0), F.coalesce(F.log2("norm"), F.lit(-2000.0)))) * BANDS + 0.37).cast("int")
    rows = valid.withColumn("norm", norm).withColumn("band", band)
    is_query = F.col("vec_id") % every == 0
    stats = rows.groupBy("band").agg(F.count("*").alias("n"), F.count_if(is_query).alias("queries"), F.min(F.size("v")).alias("dim"), F.max(F.size("v")).alias("top_dim"), F.min("norm").alias("low"), F.max("norm").alias("high")).orderBy("band").collect()
    queries = sum(s["queries"] for s in stats)
    if not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = stats[0]["dim"], sum(s["n"] for s in stats)
    if any(s[c] != dim for s in stats for c in ("dim", "top_dim")):
        raise ValueError("vectors of different lengths")
    rows, block = rows.select("vec_id", "v", "band"), max(256, BLOCK_BYTES // (8 * max(dim, 1)))
    often = [s for s in stats if s["n"] >= RARE or len(stats) == 1]
    bands = [(s["band"], s["n"], Hashes(dim, tables, functions, max(s["high"], 1e-300), s["low"] > 0.999 * s["high"], seed)) for s in often]
    usual = [s["band"] for s in often]

    def plain(b) -> np.ndarray:
        return b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def drawn(df: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        got = df.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).collect()
        return np.array([r["vec_id"] for r in got], np.int64), np.array([r["v"] for r in got], float).reshape(-1, dim), np.array([r["band"] for r in got])

    q_ids, q, _ = drawn(rows.where(is_query), SAMPLE_QUERIES)

    def exact_sample(batches):
        held = None
        for b in batches:
            ids, x, own = b.column("vec_id").to_numpy(), plain(b), b.column("band").to_numpy()
            held = (ids, x, own) if held is None else tuple(np.concatenate(p) for p in zip(held, (ids, x, own)))
            if len(held[0]) < 16_384:
                continue
            yield from best_of(held)
            held = None
        if held is not None and len(held[0]):
            yield from best_of(held)

    def best_of(held):
        ids, x, own = held
        s = q @ x.astype(np.float64).T
        s[q_ids[:, None] == ids[None, :]] = -np.inf
        row, col = _near_top(s, k)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(s[row, col]), pa.array(ids[col]), pa.array(own[col], pa.int32()), _binary(x[col])], ["q", "score", "vec_id", "band", "vec"])

    true = rows.mapInArrow(exact_sample, "q int, score double, vec_id long, band int, vec binary")
    true = true.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k).collect()
    near_q, near_band = np.array([r["q"] for r in true], np.int64), np.array([r["band"] for r in true])
    near_x = np.frombuffer(b"".join(r["vec"] for r in true), kind).reshape(-1, dim).astype(np.float64)
    lost = np.where(np.isin(near_band, usual), np.inf, 0.0)
    for at, _, h in bands:
        of = np.flatnonzero(near_band == at)
        base, mine = h.padded(near_x[of], True), h.padded(q, False)
        for t in range(tables):
            lost[of] = np.minimum(lost[of], h.loss_of(h.losses(mine, t), near_q[of], h.base(base, t)))
    radius = float(np.sort(lost)[min(len(lost) - 1, math.ceil(recall * len(lost)))]) if len(lost) else 0.0
    index = Index(bands, sum(s["n"] for s in stats if s["band"] not in usual), queries, radius, block)
    _, some, some_band = drawn(rows, SAMPLE_ROWS)
    index.fit(some, some_band, q)

    def dealt(g, own, codes, off, query, ids, x):
        """Rows ``own`` (by ascending place) of groups ``g``; of base rows and of queries each part meets each slice."""
        p, s = index.count(index.parts, g), index.count(index.slices, g)
        spread = mix(ids[own].astype(np.uint64))
        mine, others = (s, p) if query else (p, s)
        fixed = (spread % mine.astype(np.uint64)).astype(np.int64)
        at = np.repeat(np.arange(len(g)), others)
        other = np.arange(len(at)) - np.repeat(np.cumsum(others) - others, others)
        size = np.diff(off)
        for lo in range(0, len(at), 10_000):
            c = at[lo : lo + 10_000]
            n = size[c]
            flat = codes[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[c], n)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat, pa.int32()))
            part, slice_ = (other[lo : lo + 10_000], fixed[c]) if query else (fixed[c], other[lo : lo + 10_000])
            yield pa.RecordBatch.from_arrays(
                [pa.array(g[c], pa.int64()), pa.array(part, pa.int32()), pa.array(slice_, pa.int32()), pa.array(np.full(len(c), query)), pa.array(ids[own[c]], pa.int64()), _binary(x[own[c]]), lists],
                ["grp", "part", "slice", "query", "vec_id", "vec", "codes"],
            )

    def deal_base(batches):
        for b in batches:
            ids, x, own = b.column("vec_id").to_numpy(), plain(b), b.column("band").to_numpy()
            for at, _, h in bands:
                of = np.flatnonzero(own == at)
                padded, i = h.padded(x[of], True), usual.index(at)
                for t in range(tables if len(of) else 0):
                    code = h.base(padded, t)
                    yield from dealt(index.group(i, t, code), of, code, np.arange(len(of) + 1), False, ids, x)
            of = np.flatnonzero(~np.isin(own, usual))
            yield from dealt(np.full(len(of), index.first[-1]), of, np.zeros(len(of), np.int64), np.arange(len(of) + 1), False, ids, x)

    def deal_queries(batches):
        for b in batches:
            ids_, x_ = b.column("vec_id").to_numpy(), plain(b)
            for lo in range(0, len(ids_), 512):
                ids, x = ids_[lo : lo + 512], x_[lo : lo + 512]
                for i, (_, _, h) in enumerate(bands):
                    padded = h.padded(x, False)
                    for t in range(tables):
                        row, code = h.probes(padded, t, radius)
                        g = index.group(i, t, code)
                        first = runs(row, g)
                        yield from dealt(g[first], row[first], code, np.append(first, len(row)), True, ids, x)
                if len(often) < len(stats):
                    yield from dealt(np.full(len(ids), index.first[-1]), np.arange(len(ids)), np.zeros(len(ids), np.int64), np.arange(len(ids) + 1), True, ids, x)

    def rank(table: pa.Table) -> pa.Table:
        mine = table["query"].to_numpy()
        ids, x = table["vec_id"].to_numpy(), _matrix(table["vec"], kind)
        codes = table["codes"].combine_chunks()
        n, flat = np.diff(codes.offsets.to_numpy()), codes.flatten().to_numpy()
        row, base = np.repeat(np.cumsum(mine) - 1, n)[np.repeat(mine, n)], flat[np.repeat(~mine, n)]
        return _probed(x[mine], ids[mine], row, flat[np.repeat(mine, n)], x[~mine], ids[~mine], base, k)[0]

    # Of equal vectors no more than the k + 1 smallest ids can be wanted.
    same = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    base = rows.withColumn("same", same).where(F.col("same") <= k + 1).drop("same")
    sides = base.mapInArrow(deal_base, _ROW).unionByName(rows.where(is_query).mapInArrow(deal_queries, _ROW))
    near = sides.groupBy("grp", "part", "slice").applyInArrow(rank, NEAR)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    best = cut_lineage(ranked(near))
    full = best.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
    short = cut_lineage(rows.where(is_query).join(full, "vec_id", "left_anti").select("vec_id", "v"))
    n_short = short.count()
    if not n_short:
        return best
    n_part, n_slice = -(-total // block), -(-n_short // block)
    of_part, of_slice = (F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int") for n in (n_part, n_slice))
    every_part, every_slice = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (n_part, n_slice))

    def packed(batches):
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column(c) for c in ("part", "slice", "query", "vec_id")] + [_binary(plain(b))], ["part", "slice", "query", "vec_id", "vec"])

    def compare(table: pa.Table) -> pa.Table:
        mine = table["query"].to_numpy()
        ids, x = table["vec_id"].to_numpy(), _matrix(table["vec"], kind)
        return _best(x[mine], ids[mine], x[~mine], ids[~mine], k)

    sides = base.select(of_part.alias("part"), every_slice.alias("slice"), F.lit(False).alias("query"), "vec_id", "v").unionByName(short.select(every_part.alias("part"), of_slice.alias("slice"), F.lit(True).alias("query"), "vec_id", "v"))
    exact = sides.mapInArrow(packed, "part int, slice int, query boolean, vec_id long, vec binary").groupBy("part", "slice").applyInArrow(compare, NEAR)
    return best.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(ranked(exact))


def op4_cross_polytope(spark, sf_dir: str) -> DataFrame:
    """Contract columns: the 20 nearest of every vector whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)
