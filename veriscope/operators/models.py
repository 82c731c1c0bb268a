"""Linear models and decompositions from moments: rows are read in Spark, small matrices are solved on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import Moments, dot, moments


def weights_column(w: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in w])


class Ridge:
    """Ridge regression of several targets on standardised features, for any penalty from one set of moments."""

    def __init__(self, m: Moments, features: int):
        self.mean, self.scale = m.mean[:features], np.sqrt(np.maximum(np.diag(m.covariance)[:features], 0))
        self.scale = np.where(self.scale > 1e-8, self.scale, 1.0)
        self.target_mean = m.mean[features:]
        c = m.covariance * m.n
        self.xx = c[:features, :features] / np.outer(self.scale, self.scale)
        self.xy = c[:features, features:] / self.scale[:, None]
        self.values, self.vectors = np.linalg.eigh(self.xx)
        self.rotated = self.vectors.T @ self.xy

    def solve(self, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """Weights on raw features (one column per target), and intercepts."""
        w = self.vectors @ (self.rotated / (np.maximum(self.values, 0) + alpha)[:, None]) / self.scale[:, None]
        return w, self.target_mean - self.mean @ w


def fit_ridge(train: DataFrame, val: DataFrame, vector: str, targets: list[str], alphas=(0.1, 1.0, 10.0, 100.0)) -> dict[str, tuple[float, np.ndarray, float]]:
    """For each target (alpha, weights, intercept): the penalty whose validation correlation is largest in size, the first of
    equals. Validation needs its moments only."""
    d = len(train.select(vector).where(F.col(vector).isNotNull()).first()[0])
    ridge, v = Ridge(moments(train, vector, targets), d), moments(val, vector, targets)
    c, out = v.covariance, {}
    for j, t in enumerate(targets):
        best = (-1.0, None)
        for a in alphas:
            w, b = ridge.solve(a)
            var = w[:, j] @ c[:d, :d] @ w[:, j] * c[d + j, d + j]
            r = abs(w[:, j] @ c[:d, d + j]) / math.sqrt(var) if var > 1e-24 else 0.0
            if r > best[0]:
                best = (r, (a, w[:, j], float(b[j])))
        out[t] = best[1]
    return out


def predict(df: DataFrame, vector: str, w: np.ndarray, b: float, name: str) -> DataFrame:
    return df.withColumn(name, dot(F.col(vector).cast("array<double>"), weights_column(w)) + F.lit(b))


def principal_directions(m: Moments, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` principal directions (rows; largest component positive) and their variances."""
    values, vectors = np.linalg.eigh(m.covariance)
    at = np.argsort(-values, kind="stable")[:k]
    rows = vectors[:, at].T
    sign = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])
    return rows * sign[:, None], values[at]


def linear_cka(m: Moments, first: int) -> float:
    """Linear CKA of the first columns with the others."""
    c = m.covariance
    xy, xx, yy = c[:first, first:], c[:first, :first], c[first:, first:]
    return float((xy**2).sum() / (np.linalg.norm(xx) * np.linalg.norm(yy)))


def subspace_overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Mean squared cosine between two row spaces."""
    q, u = np.linalg.qr(a.T)[0], np.linalg.qr(b.T)[0]
    return float((np.abs(q.T @ u) ** 2).sum() / min(q.shape[1], u.shape[1]))


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a cheapest one-to-one assignment (rows at most columns); shortest augmenting paths."""
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0, free = match[j0], ~used[1:]
            gap = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (gap < low[1:])
            low[1:][better], back[1:][better] = gap[better], j0
            j1 = 1 + int(np.where(free, low[1:], np.inf).argmin())
            step = low[j1]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[back[j0]]
            j0 = back[j0]
    out = np.empty(n, int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def matched_cosines(a: np.ndarray, b: np.ndarray, signed: bool = True) -> np.ndarray:
    """The cosines of two sets of directions under their best matching; without ``signed`` their sizes count, so that a
    direction and its opposite are one."""
    a, b = a / np.linalg.norm(a, axis=1, keepdims=True), b / np.linalg.norm(b, axis=1, keepdims=True)
    c = a @ b.T
    c = c if signed else np.abs(c)
    return c[np.arange(len(a)), assignment(-c)]


def matched_cosine(a: np.ndarray, b: np.ndarray, signed: bool = True) -> float:
    """Their mean."""
    return float(matched_cosines(a, b, signed).mean())


def _root(c: np.ndarray, inverse: bool, least: float = 1e-10) -> np.ndarray:
    w, q = np.linalg.eigh(c)
    good = w > least * max(w.max(), 1e-300)
    p = np.where(good, np.where(good, w, 1.0) ** (-0.5 if inverse else 0.5), 0.0)
    return (q * p) @ q.T


def matrix_root(c: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The symmetric square root of a covariance, or its pseudo-inverse."""
    return _root(c, inverse)


class Eraser:
    """Least-squares concept erasure: after ``apply`` no linear function of the vector covaries with the labels. ``ridge`` adds
    a share of the mean variance to the covariance."""

    def __init__(self, m: Moments, features: int, ridge: float = 0.0):
        c = m.covariance
        xx, xz = c[:features, :features], c[:features, features:]
        xx = xx + ridge * np.trace(xx) / max(1, features) * np.eye(features)
        white, colour = _root(xx, True), _root(xx, False)
        u, s, _ = np.linalg.svd(white @ xz, full_matrices=False)
        u = u[:, s > 1e-10]
        self.mean, self.matrix = m.mean[:features], np.eye(features) - colour @ u @ u.T @ white

    def apply(self, df: DataFrame, vector: str, name: str) -> DataFrame:
        """Erased vectors: one product of a batch with the matrix, which is sent once."""
        from .probes import linear_map

        return linear_map(df, vector, name, self.matrix, self.mean - self.matrix @ self.mean)


def transport(source: Moments, target: Moments, diagonal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The linear map that gives source rows the target's mean and covariance: (matrix, shift). With ``diagonal`` each
    component is scaled by itself, which gives the target's variances; a flat source component is not scaled."""
    if diagonal:
        a, b = (np.sqrt(np.maximum(np.diag(x.covariance), 0)) for x in (source, target))
        m = np.diag(np.where(a > 1e-12, b / np.where(a > 1e-12, a, 1.0), 1.0))
    else:
        m = _root(target.covariance, False) @ _root(source.covariance, True)
    return m, target.mean - m @ source.mean


def control_directions(m: Moments, u: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Unit directions to hold a direction ``u`` against: the first principal one, and one drawn by a seed, each turned to
    the side of ``u``."""
    out = {"principal": principal_directions(m, 1)[0][0], "random": np.random.default_rng(seed).normal(size=len(u))}
    return {k: d / np.linalg.norm(d) * (-1.0 if d @ u < 0 else 1.0) for k, d in out.items()}


def class_direction(df: DataFrame, vector: str, positive: Column) -> np.ndarray:
    """Unit difference of class means."""
    long = df.select(positive.alias("y"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    rows = long.groupBy("i").agg(F.avg(F.when(F.col("y"), F.col("x"))).alias("a"), F.avg(F.when(~F.col("y"), F.col("x"))).alias("b")).orderBy("i").collect()
    d = np.array([r["a"] - r["b"] for r in rows])
    return d / np.linalg.norm(d)


def betainc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(400):
        k = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))
        else:
            n = -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))
        d = 1 / (1 + n * d if abs(1 + n * d) > tiny else tiny)
        c = 1 + n / c if abs(1 + n / c) > tiny else tiny
        f *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def pearson_p(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson correlation."""
    if n < 3 or not -1 < r < 1:
        return 0.0 if n >= 3 else float("nan")
    return betainc((n - 2) / 2, 0.5, 1 - r * r)


def welch_p(mean_a: float, var_a: float, n_a: int, mean_b: float, var_b: float, n_b: int) -> float:
    """Two-sided p-value of Welch's test from sample moments."""
    sa, sb = var_a / n_a, var_b / n_b
    if sa + sb == 0:
        return float("nan")
    t2, df = (mean_a - mean_b) ** 2 / (sa + sb), (sa + sb) ** 2 / (sa**2 / (n_a - 1) + sb**2 / (n_b - 1))
    return betainc(df / 2, 0.5, df / (df + t2))
