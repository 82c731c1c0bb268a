"""Probes, sparse codes and interventions. Small matrices are solved on the driver; rows meet them as Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .audit import Rejected
from .models import Ridge
from .relational import _keys
from .resampling import uniform
from .statistics import adjust, class_correlations, correlations, log_area
from .vectors import Moments, masked_moments, moments

# Maps of vectors


def map_vectors(df: DataFrame, vector: str, name: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``df`` with ``name``: what ``f`` makes of the vectors, a matrix of one row each; null vectors stay null."""
    own = [c for c in df.columns if c != name]
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(name, T.ArrayType(T.DoubleType()))])
    given = df.select(*own, F.col(vector).cast("array<double>").alias("_v"))

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            v = b.column("_v")
            there = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            out = np.zeros((0, 1))
            if len(there):
                kept = v.drop_null()
                out = f(kept.flatten().to_numpy(zero_copy_only=False).reshape(len(kept), -1))
            size = np.zeros(len(b) + 1, np.int32)
            size[there + 1] = out.shape[1]
            mask = np.append(~v.is_valid().to_numpy(zero_copy_only=False), False)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(size), pa.int32(), mask=mask), pa.array(out.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in own] + [lists], [*own, name])

    return given.mapInArrow(run, schema)


def linear_map(df: DataFrame, vector: str, name: str, matrix: np.ndarray, shift: np.ndarray | float = 0.0) -> DataFrame:
    """``matrix @ v + shift`` of each vector."""
    return map_vectors(df, vector, name, lambda x: x @ matrix.T + shift)


# Ridge


def masked_ridge(train: DataFrame, vector: str, targets: list[str], alpha: float, least: int = 50) -> dict[str, tuple[np.ndarray, float]]:
    """For each target (weights, intercept) at one penalty, from the rows that have it; all targets need ``least`` rows. One
    pass for all targets."""
    found, out = masked_moments(train, vector, targets), {}
    if short := {t: int(m.n) for t, m in found.items() if m.n < least}:
        raise Rejected(f"too few rows: {short}")
    for t, m in found.items():
        w, b = Ridge(m, len(m.shift) - 1).solve(alpha)
        out[t] = (w[:, 0], float(b[0]))
    return out


def explained(m: Moments, features: int, w: np.ndarray, b: float, target: int = 0) -> float:
    """R² of a linear prediction on rows of which the moments are known; rows are not needed."""
    c, mean, y = m.covariance, m.mean, features + target
    bias = mean[y] - (mean[:features] @ w + b)
    rest = c[y, y] - 2 * w @ c[:features, y] + w @ c[:features, :features] @ w + bias * bias
    return float(1 - rest / c[y, y]) if c[y, y] > 0 else float("nan")


def part(m: Moments, at: list[int]) -> Moments:
    """The moments of some of the columns."""
    return m.part(at)


def top_k_curve(train: Moments, test: Moments, features: int, ks, alpha: float) -> list[tuple[int, float]]:
    """(k, R² on test) of ridge on the ``k`` features that correlate most in training, the first of equals."""
    c = train.covariance
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    r = np.where(sd[:features] > 1e-12, np.abs(c[:features, features]) / np.maximum(sd[:features] * sd[features], 1e-300), 0.0)
    order, out = np.lexsort((np.arange(features), -r)), []
    for k in ks:
        at = [*order[:k].tolist(), features]
        w, b = Ridge(part(train, at), len(at) - 1).solve(alpha)
        out.append((k, explained(part(test, at), len(at) - 1, w[:, 0], float(b[0]))))
    return out


def ninety_percent(curve: list[tuple[int, float]]) -> int | None:
    """The least k whose R² is nine tenths of the last one's."""
    return next((k for k, r in curve if r >= 0.9 * curve[-1][1]), None) if curve and curve[-1][1] > 0 else None


# p-values as columns


def _incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of many arguments, by Gauss's rule in the angle t, x = sin² t, where the
    integrand is smooth for a, b of a half or more."""
    t, w = np.polynomial.legendre.leggauss(400)
    end = np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    none, end = end <= 0, np.maximum(end, 1e-12)
    s = end[:, None] * (t + 1) / 2
    front = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b)])
    with np.errstate(divide="ignore"):
        logs = np.log(2.0) + (2 * a - 1)[:, None] * np.log(np.sin(s)) + (2 * b - 1)[:, None] * np.log(np.cos(s)) + front[:, None]
    return np.where(none, 0.0, np.clip((np.exp(logs) * w).sum(1) * end / 2, 0, 1))


def _t_tails(t2: pd.Series, df: pd.Series) -> pd.Series:
    x, n = t2.to_numpy(float), df.to_numpy(float)
    ok = np.isfinite(x) & np.isfinite(n) & (n > 0)
    out = np.full(len(x), np.nan)
    # The tail is wide near zero and narrow far out: the shorter side is integrated.
    share = n[ok] / (n[ok] + x[ok])
    small = share <= 0.5
    p = np.empty(len(share))
    half = np.full(len(share), 0.5)
    p[small] = _incomplete_beta(n[ok][small] / 2, half[small], share[small])
    p[~small] = 1 - _incomplete_beta(half[~small], n[ok][~small] / 2, 1 - share[~small])
    out[ok] = p
    return pd.Series(out)


def _t_tail(t2: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t from its square."""
    return F.pandas_udf(_t_tails, "double")(t2, df)


def pearson_p(r, n) -> Column:
    """Two-sided p-value of a Pearson correlation of ``n`` pairs; null below three pairs."""
    r, n = (c if isinstance(c, Column) else F.col(c) for c in (r, n))
    n = n.cast("double")
    t2 = F.when(F.abs(r) < 1, r * r * (n - 2) / (1 - r * r))
    return F.when(n < 3, F.lit(None).cast("double")).when(F.abs(r) >= 1, 0.0).otherwise(F.nanvl(_t_tail(F.coalesce(t2, F.lit(0.0)), n - 2), F.lit(None).cast("double")))


def welch(df: DataFrame, keys, group: str, value: str) -> DataFrame:
    """(keys, t, df, p): Welch's test of group true against false."""
    k, g, v = _keys(keys), F.col(group), F.col(value)
    s = df.groupBy(*k).agg(*[f(F.when(c, v)).alias(f"_{n}{i}") for i, c in enumerate((g, ~g)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    a, b = F.col("_v0") / F.col("_n0"), F.col("_v1") / F.col("_n1")
    s = s.withColumn("t", (F.col("_m0") - F.col("_m1")) / F.sqrt(F.nullif(a + b, F.lit(0.0)))).withColumn("df", (a + b) * (a + b) / F.nullif(a * a / (F.col("_n0") - 1) + b * b / (F.col("_n1") - 1), F.lit(0.0)))
    return s.select(*k, "t", "df", F.when(F.col("t").isNotNull(), _t_tail(F.col("t") * F.col("t"), F.col("df"))).alias("p"))


def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    out = []
    for w, x, y, z in zip(*(s.to_numpy(float) for s in (a, b, c, d))):
        n1, n2, k = int(w + x), int(y + z), int(w + y)
        i = np.arange(max(0, k - n2), min(k, n1) + 1)
        lg = np.frompyfunc(math.lgamma, 1, 1)
        choose = lambda n, r: math.lgamma(n + 1) - lg(r + 1.0).astype(float) - lg(n - r + 1.0).astype(float)
        p = np.exp(choose(n1, i) + choose(n2, k - i) - (math.lgamma(n1 + n2 + 1) - math.lgamma(k + 1) - math.lgamma(n1 + n2 - k + 1)))
        out.append(min(1.0, float(p[p <= p[int(w) - i[0]] * (1 + 1e-7)].sum())))
    return pd.Series(out)


def fisher_exact(a, b, c, d) -> Column:
    """Two-sided p-value of a 2 x 2 table: the sum over all tables of its margins that are no likelier."""
    return F.pandas_udf(_fisher, "double")(a, b, c, d)


def feature_yield(rows: DataFrame, vector: str, label: str, classes: DataFrame, least: float = 0.2, alpha: float = 0.05) -> DataFrame:
    """(target, tested, found): of each class how many features are live, and how many of these correlate by ``least`` or
    more at a false discovery rate of ``alpha`` over the class's features."""
    r = class_correlations(rows, vector, label, classes).withColumn("p", pearson_p("r", "n"))
    q = adjust(r.withColumn("p", F.when(F.col("r") != 0, F.col("p"))), "target", "p", "feature")
    return q.groupBy("target").agg(F.count("p").alias("tested"), F.count_if((F.abs("r") >= least) & (F.col("q") <= alpha)).alias("found"))


# Sparse codes


class Dictionary:
    """Atoms (rows of a matrix) and an offset; a code is the rectified product with the atoms, of which a row keeps its
    ``k`` largest values, the first of equals."""

    def __init__(self, atoms: np.ndarray, k: int, offset: np.ndarray | float = 0.0):
        self.atoms, self.k, self.offset = np.asarray(atoms, float), k, np.asarray(offset, float)

    @classmethod
    def random(cls, atoms: int, dim: int, k: int, seed: int = 0) -> Dictionary:
        """Atoms of equal length with signs by hash; training has no part in them."""
        from hashlib import md5

        sign = [[1 if md5(f"{seed}:{i}:{j}".encode()).digest()[0] & 128 else -1 for j in range(dim)] for i in range(atoms)]
        return cls(np.array(sign) / math.sqrt(dim), k)

    def codes(self, x: np.ndarray) -> np.ndarray:
        c = np.maximum((x - self.offset) @ self.atoms.T, 0)
        order = np.argsort(-c, axis=1, kind="stable")[:, : self.k]
        out = np.zeros_like(c)
        np.put_along_axis(out, order, np.take_along_axis(c, order, 1), 1)
        return out

    def encode(self, df: DataFrame, vector: str, name: str = "codes") -> DataFrame:
        return map_vectors(df, vector, name, self.codes)

    def decode(self, df: DataFrame, codes: str = "codes", name: str = "decoded", budget: int | None = None) -> DataFrame:
        """Codes times atoms, plus the offset; with ``budget`` only the largest codes of a row count."""

        def run(c: np.ndarray) -> np.ndarray:
            if budget is not None and budget < c.shape[1]:
                order = np.argsort(-np.abs(c), axis=1, kind="stable")[:, budget:]
                c = c.copy()
                np.put_along_axis(c, order, 0.0, 1)
            return c @ self.atoms + self.offset

        return map_vectors(df, codes, name, run)


def evaluation(df: DataFrame, vector: str, decoded: str, codes: str) -> DataFrame:
    """(n, sse, sst, r2, l0): sums over rows; the total is taken about the mean of each component."""
    v, w = F.col(vector).cast("array<double>"), F.col(decoded)
    zip_ = F.zip_with(v, w, lambda x, y: (x - y) * (x - y))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    one = df.select(total(zip_).alias("_e"), F.size(F.filter(codes, lambda x: x != 0)).alias("_l0"))
    s = one.agg(F.count("*").alias("n"), F.sum("_e").alias("sse"), F.avg("_l0").alias("l0"))
    per = df.select(F.posexplode(v).alias("i", "x")).groupBy("i").agg((F.var_pop("x") * F.count("x")).alias("_t"))
    return s.crossJoin(F.broadcast(per.agg(F.sum("_t").alias("sst")))).select("n", "sse", "sst", (1 - F.col("sse") / F.nullif(F.col("sst"), F.lit(0.0))).alias("r2"), "l0")


def atom_activity(df: DataFrame, codes: str) -> DataFrame:
    """(atom, rate, mean): how often an atom fires, and how strongly when it does."""
    long = df.select(F.posexplode(codes).alias("atom", "c"))
    return long.groupBy("atom").agg(F.avg((F.col("c") != 0).cast("double")).alias("rate"), F.avg(F.when(F.col("c") != 0, F.col("c"))).alias("mean"))


def clamp_delta(df: DataFrame, codes: str, atom: int, value, atoms: np.ndarray, name: str = "delta") -> DataFrame:
    """What setting one atom's code to a value adds to the reconstruction."""
    step = (value if isinstance(value, Column) else F.lit(float(value))) - F.element_at(codes, atom + 1)
    return df.withColumn(name, F.transform(F.array(*[F.lit(float(x)) for x in atoms[atom]]), lambda a: a * step))


# Attribution and interventions, over long tables


def attribution(df: DataFrame, atom: str, code: str, gradient: str, focus: str) -> DataFrame:
    """(atom, score, rank): the mean over rows in focus of code times gradient, largest first, ties by atom."""
    s = df.where(focus).groupBy(atom).agg(F.avg(F.col(code) * F.col(gradient)).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), atom)))


def head_decomposition(df: DataFrame, key: str, atom: str, code: str, gradient: str, constant: float, selected: Column) -> DataFrame:
    """(key, total, selected, ablated): a linear head as constant and code times gradient; the selected atoms' share, and
    what is left without it."""
    c = F.col(code) * F.col(gradient)
    s = df.groupBy(key).agg((F.lit(constant) + F.sum(c)).alias("total"), F.coalesce(F.sum(F.when(selected, c)), F.lit(0.0)).alias("selected"))
    return s.withColumn("ablated", F.col("total") - F.col("selected"))


def matched_groups(items: DataFrame, item: str, chosen: str, rate: str, bins: int = 10, seed: int = 0) -> DataFrame:
    """(item, control): for each chosen item another one that is not, of its rate's bin, dealt by hash; null where a bin
    has no more of these."""
    b = items.withColumn("_b", F.least(F.floor(F.col(rate) * bins), F.lit(bins - 1)))
    turn = F.row_number().over(Window.partitionBy("_b", chosen).orderBy(uniform(seed, F.col(item)), item))
    numbered = b.withColumn("_i", turn)
    free = numbered.where(~F.col(chosen)).select("_b", "_i", F.col(item).alias("control"))
    return numbered.where(F.col(chosen)).join(free, ["_b", "_i"], "left").select(item, "control")


def sweep_selectivity(df: DataFrame, keys, order: str, step: str, value: str, chosen: str) -> DataFrame:
    """(keys, selected, random, excess): areas over ln step under the curve of the chosen order and, on average, under
    those of the others."""
    k = _keys(keys)
    a = log_area(df, [*k, order], step, value)
    s = a.groupBy(*k).agg(F.max(F.when(F.col(order) == chosen, F.col("area"))).alias("selected"), F.avg(F.when(F.col(order) != chosen, F.col("area"))).alias("random"))
    return s.withColumn("excess", F.col("selected") - F.col("random"))


def endpoint_selectivity(df: DataFrame, keys, order: str, step: str, value: str, chosen: str) -> DataFrame:
    """(keys, selected, random, excess) of the values at the last step of each order."""
    k = _keys(keys)
    last = df.withColumn("_k", F.row_number().over(Window.partitionBy(*k, order).orderBy(F.col(step).desc()))).where("_k = 1")
    s = last.groupBy(*k).agg(F.max(F.when(F.col(order) == chosen, F.col(value))).alias("selected"), F.avg(F.when(F.col(order) != chosen, F.col(value))).alias("random"))
    return s.withColumn("excess", F.col("selected") - F.col("random"))


def residual_audit(df: DataFrame, keys, before: str, after: str, target: str, floor: float = 0.02, share: float = 0.35, least: float = 0.04) -> DataFrame:
    """(keys, r2_before, r2_after, limit, passed): whether an erased score still tells the target: its R² must not exceed
    the larger of ``floor`` and ``share`` of the R² before."""
    k = _keys(keys)
    one = df if k else df.withColumn("_all", F.lit(1))
    k_ = k or ["_all"]
    a = correlations(one, k_, before, target).select(*k_, (F.col("r") * F.col("r")).alias("r2_before"))
    b = correlations(one, k_, after, target).select(*k_, (F.col("r") * F.col("r")).alias("r2_after"))
    out = a.join(b, k_).withColumn("limit", F.greatest(F.lit(floor), share * F.greatest("r2_before", F.lit(least))))
    return out.withColumn("passed", F.col("r2_after") <= F.col("limit")).select(*k, "r2_before", "r2_after", "limit", "passed")


def coupling(df: DataFrame, key: str, concept: str, value: str) -> DataFrame:
    """(a, b, n, r): the correlation of every two concepts over the keys that have both. Keys hold few concepts each, so
    that pairs form within a key only."""
    a, b = df.select(key, F.col(concept).alias("a"), F.col(value).alias("_x")), df.select(key, F.col(concept).alias("b"), F.col(value).alias("_y"))
    return correlations(a.join(b, key).where("a < b"), ["a", "b"], "_x", "_y", none=None)


# Subspaces


def geometric_agreement(q: np.ndarray, u: np.ndarray) -> float:
    """How much of the row space of ``u`` lies in that of ``q``, by its rank."""
    a, b = (_span(x) for x in (q, u))
    return float(((a.T @ b) ** 2).sum() / b.shape[1]) if b.shape[1] else float("nan")


def _span(rows: np.ndarray) -> np.ndarray:
    left, s, _ = np.linalg.svd(np.atleast_2d(rows).T, full_matrices=False)
    return left[:, s > 1e-10 * max(1e-300, s.max())] if len(s) else left


def random_basis(k: int, dim: int, seed: int = 0) -> np.ndarray:
    """``k`` orthonormal rows from normal numbers of a seeded generator; the largest component of each is positive."""
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, k)))[0].T
    return q * np.sign(q[np.arange(k), np.abs(q).argmax(1)])[:, None]


def select_by_direction(df: DataFrame, item: str, vector: str, direction: np.ndarray, k: int) -> DataFrame:
    """(item, dot, rank): the ``k`` items whose vectors lie most along a direction, by size, ties by item."""
    u = F.array(*[F.lit(float(x)) for x in direction])
    dot = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), u, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    d = df.select(item, dot.alias("dot")).orderBy(F.abs("dot").desc(), item).limit(k)
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("dot").desc(), item)))


def greatest_cosine(df: DataFrame, item: str, vector: str, sample: int, seed: int = 0) -> DataFrame:
    """(item, cosine): for ``sample`` items drawn by hash (a stated bound) the largest cosine with any other item. The
    sampled vectors go to every task; each partition keeps one maximum for each."""
    v = F.col(vector).cast("array<double>")
    drawn = df.select(item, v.alias("v")).orderBy(uniform(seed, F.col(item)), item).limit(sample).collect()
    ids, q = [r[item] for r in drawn], np.array([r["v"] for r in drawn], float).reshape(len(drawn), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    kind = dict(df.dtypes)[item]

    def run(batches):
        best = np.full(len(ids), -np.inf)
        for b in batches:
            if not len(b):
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            c = q @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T
            place = {k: i for i, k in enumerate(b.column(item).to_pylist())}
            for i, k in enumerate(ids):
                if k in place:
                    c[i, place[k]] = -np.inf
            best = np.maximum(best, c.max(1))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best)], [item, "cosine"])

    return df.select(item, v.alias("v")).where("v is not null").mapInArrow(run, f"{item} {kind}, cosine double").groupBy(item).agg(F.max("cosine").alias("cosine"))


def pairing_floor(df: DataFrame, item: str, vector: str, seed: int = 0) -> DataFrame:
    """(n, floor): the mean absolute cosine of items paired by hash: what matching must beat. Items fall into buckets by
    hash and are paired within; one item of a bucket may stay alone."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    b = df.select(item, F.transform(v, lambda x: x / norm).alias("v"), F.floor(uniform(seed, F.col(item)) * 64).alias("_b"))
    turn = F.row_number().over(Window.partitionBy("_b").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(item).cast("string"))), item))
    numbered = b.withColumn("_i", turn)
    pair = numbered.groupBy("_b", F.floor((F.col("_i") - 1) / 2).alias("_p")).agg(F.collect_list("v").alias("_vs")).where(F.size("_vs") == 2)
    cos = F.abs(F.aggregate(F.zip_with(F.col("_vs")[0], F.col("_vs")[1], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    return pair.agg(F.count("*").alias("n"), F.avg(cos).alias("floor"))


# Logistic probes


def logistic_probe(train: DataFrame, val: DataFrame, vector: str, label: str, strengths=(0.01, 0.1, 1.0, 10.0), l1: bool = False, balanced: bool = True) -> tuple[float, float, np.ndarray, float]:
    """(C, validation AUROC, weights, intercept): a logistic regression for each C, the inverse of the penalty on the sum of
    losses; the best validation AUROC, of equals the first C. Rows are weighted so that classes count alike. Without ``l1``
    all strengths share each step's scan (``heads.LogisticFits``); with it each is a fit of its own."""
    if not l1:
        from .heads import fit_heads

        c, a, w = fit_heads(train, val, vector, [], [label], strengths=tuple(strengths), balanced=balanced)[label]
        return c, -1.0 if a is None else a, w[1:], float(w[0])
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from .statistics import auroc

    y = F.col(label).cast("double")
    rows = train.where(F.col(vector).isNotNull() & y.isNotNull()).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), y.alias("label"))
    n, p = rows.agg(F.count("*"), F.sum("label")).first()
    if not n or not 0 < p < n:
        raise Rejected("one class only")
    weight = F.when(F.col("label") == 1, n / (2 * p)).otherwise(n / (2 * (n - p))) if balanced else F.lit(1.0)
    rows, best = rows.withColumn("weight", weight), None
    for c in strengths:
        fit = LogisticRegression(regParam=1 / (c * n), elasticNetParam=1.0, weightCol="weight", standardization=False, maxIter=200, tol=1e-8).fit(rows)
        w = fit.coefficients.toArray()
        score = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in w]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        a = auroc(val.select(F.lit(1).alias("_k"), score.alias("_s"), label), "_k", "_s", label).first()["auroc"]
        if best is None or a is not None and a > best[1]:
            best = (c, -1.0 if a is None else a, w, float(fit.intercept))
    return best


# Independent components


def independent_components(df: DataFrame, vector: str, k: int, rounds: int = 30, tolerance: float = 1e-6, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(unmixing rows, mean) by FastICA: vectors are whitened by their moments, and each round is one pass that sums up
    k x k numbers in every partition."""
    from .models import principal_directions

    m = moments(df, vector)
    rows, values = principal_directions(m, k)
    white = rows / np.sqrt(np.maximum(values, 1e-12))[:, None]
    v, mean = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null"), m.mean
    w = random_basis(k, k, seed)
    for _ in range(rounds):
        def one(batches, w=w):
            total, slope, n = np.zeros((k, k)), np.zeros(k), 0
            for b in batches:
                if len(b):
                    z = (b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1) - mean) @ white.T
                    g = np.tanh(z @ w.T)
                    total, slope, n = total + g.T @ z, slope + (1 - g * g).sum(0), n + len(b)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total.ravel(), slope, [n]]).tobytes()], pa.binary())], ["sums"])

        sums = sum(np.frombuffer(bytes(r["sums"])) for r in v.mapInArrow(one, "sums binary").repartition(16).collect())
        new = sums[: k * k].reshape(k, k) / sums[-1] - np.diag(sums[k * k : -1] / sums[-1]) @ w
        left, _, right = np.linalg.svd(new)
        new = left @ right
        moved = np.abs(np.abs((new * w).sum(1)) - 1).max()
        w = new
        if moved < tolerance:
            break
    return w @ white, mean


# Signals


def warp(df: DataFrame, signal: str, source: list[float], target: list[float], name: str) -> DataFrame:
    """``df`` with ``name``: signals whose anchors, as shares of their length, move from ``source`` to ``target``; between
    anchors time runs evenly, and values are interpolated."""

    def run(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        at = np.interp(np.arange(n), np.array(target) * (n - 1), np.array(source) * (n - 1))
        lo = np.minimum(np.floor(at).astype(int), max(n - 2, 0))
        share = at - lo
        return x[:, lo] * (1 - share) + x[:, np.minimum(lo + 1, n - 1)] * share

    return map_vectors(df, signal, name, run)


def chosen(v, places: list[int]) -> Column:
    """The components of a vector, or the leads of a signal, at some places."""
    c = v if isinstance(v, Column) else F.col(v)
    return F.array(*[F.try_element_at(c, F.lit(i + 1)) for i in places])


def orthogonal_set(concepts: list, correlation: dict[tuple, float] | np.ndarray, limit: float) -> list:
    """Concepts in order of preference, each kept if it correlates with none kept before by more than ``limit``; then, while
    swapping one for a later pair that fits makes room, it is swapped. Correlations come as a table of pairs (missing ones are
    0) or as a matrix in the order of the concepts, of a few thousand at most, on the driver."""
    if isinstance(correlation, np.ndarray):
        place = {c: i for i, c in enumerate(concepts)}
        r = lambda a, b: abs(float(correlation[place[a], place[b]]))
    else:
        r = lambda a, b: abs(correlation.get((a, b), correlation.get((b, a), 0.0)))
    kept = []
    for c in concepts:
        if all(r(c, k) <= limit for k in kept):
            kept.append(c)
    improved = True
    while improved:
        improved = False
        for out in kept:
            rest = [k for k in kept if k != out]
            free = [c for c in concepts if c not in kept and all(r(c, k) <= limit for k in rest)]
            pair = next(((a, b) for i, a in enumerate(free) for b in free[i + 1 :] if r(a, b) <= limit), None)
            if pair:
                kept, improved = sorted([*rest, *pair], key=concepts.index), True
                break
    return kept


def interval_features(marks, low: float, high: float) -> Column:
    """Of landmarks in order: how many successive intervals lie within closed bounds, and the median of these (null if
    none), as a struct."""
    m = marks if isinstance(marks, Column) else F.col(marks)
    steps = F.zip_with(F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0))), F.slice(m, 1, F.greatest(F.size(m) - 1, F.lit(0))), lambda b, a: b - a)
    good = F.array_sort(F.filter(steps, lambda x: x.between(low, high)))
    n = F.size(good)
    middle = (F.try_element_at(good, F.floor((n + 1) / 2).cast("int")) + F.try_element_at(good, F.floor(n / 2).cast("int") + 1)) / 2
    return F.struct(n.alias("n"), F.when(n > 0, middle).alias("median"))


# Factors with codes that are not negative


class SemiNmf:
    """Vectors as sums of ``parts`` (rows) with codes of zero or more. Codes follow from a vector and the parts alone, by a
    fixed number of multiplicative steps, so that no round has to keep them."""

    def __init__(self, parts: np.ndarray, steps: int = 20):
        self.parts, self.steps = parts, steps

    def codes(self, x: np.ndarray) -> np.ndarray:
        f = self.parts
        a, b = x @ f.T, f @ f.T
        up, down = np.maximum(a, 0), np.maximum(-a, 0)
        g = up + 0.2 * np.abs(a).mean(1, keepdims=True) + 1e-9
        for _ in range(self.steps):
            g = g * np.sqrt((up + g @ np.maximum(-b, 0) + 1e-12) / (down + g @ np.maximum(b, 0) + 1e-12))
        return g

    @classmethod
    def fit(cls, df: DataFrame, vector: str, k: int, rounds: int = 10, seed: int = 0, steps: int = 20) -> SemiNmf:
        """Each round is one pass: partitions sum up k x k and k x d numbers, from which the parts follow by least squares."""
        v = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
        dim = len(v.first()["v"])
        own = cls(random_basis(k, dim, seed), steps)
        for _ in range(rounds):
            def one(batches, own=own):
                gg, gx = np.zeros((k, k)), np.zeros((k, dim))
                for b in batches:
                    if len(b):
                        x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                        g = own.codes(x)
                        gg, gx = gg + g.T @ g, gx + g.T @ x
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([gg.ravel(), gx.ravel()]).tobytes()], pa.binary())], ["sums"])

            sums = sum(np.frombuffer(bytes(r["sums"])) for r in v.mapInArrow(one, "sums binary").repartition(16).collect())
            own = cls(np.linalg.pinv(sums[: k * k].reshape(k, k)) @ sums[k * k :].reshape(k, dim), steps)
        return own

    def transform(self, df: DataFrame, vector: str, name: str = "codes") -> DataFrame:
        return map_vectors(df, vector, name, self.codes)
