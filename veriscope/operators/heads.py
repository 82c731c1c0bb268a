"""Fits of many targets in one pass: logistic heads, propensities, controls, erasure audits, directions, wide components.

Rows are read in Spark; what comes to the driver are sums whose size follows from the width and the number of targets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audit import Rejected
from .models import Eraser, Ridge, matched_cosines, matrix_root, subspace_overlap
from .probes import explained, map_vectors
from .relational import _keys, cut
from .statistics import auroc
from .vectors import WIDEST, Moments, masked_moments, summed

# Logistic fits


@dataclass
class Problem:
    """One fit: rows of a group with a value of ``target`` that are not of ``fold``, at a strength C."""

    group: object
    target: int
    strength: float
    fold: int
    counts: np.ndarray
    weights: np.ndarray
    step: np.ndarray = field(default_factory=lambda: np.zeros(0))
    loss: float = np.inf
    best: np.ndarray | None = None
    done: bool = False


def _sigmoid(x: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(x))
    return np.where(x >= 0, 1 / (1 + e), e / (1 + e))


class LogisticFits:
    """Logistic regressions of all targets, strengths, groups and folds, by Newton steps whose losses, gradients and Hessians
    come from one scan a step. ``strength`` is the inverse penalty on the sum of losses; ``balanced`` weighs rows so that
    classes count alike. A step that raises a problem's loss is halved. ``scans`` counts the passes over the rows."""

    def __init__(self, strengths=(0.01, 0.1, 1.0, 10.0), balanced: bool = True, penalise_intercept: bool = False, rounds: int = 60, tolerance: float = 1e-11):
        self.strengths, self.balanced, self.penalise_intercept = tuple(strengths), balanced, penalise_intercept
        self.rounds, self.tolerance, self.scans = rounds, tolerance, 0
        self.problems: list[Problem] = []
        self.skipped: list[tuple] = []

    def fit(self, df: DataFrame, vector: str, targets: list[str], group: str | None = None, fold: str | None = None, folds: int = 0) -> LogisticFits:
        """Fits for every group and target with both classes (others are in ``skipped``); with ``folds``, also one without
        each fold. Groups and targets should be few: each fit keeps width squared numbers."""
        y = [F.when(F.col(t).cast("double") > 0, 1.0).when(F.col(t).isNotNull() & ~F.isnan(F.col(t).cast("double")), 0.0) for t in targets]
        g = F.col(group) if group else F.lit(0)
        f = F.col(fold).cast("int") if fold else F.lit(0)
        rows = df.select(g.alias("g"), f.alias("f"), F.col(vector).cast("array<double>").alias("v"), F.array(*y).alias("y")).where("v is not null and g is not null")
        parts = list(range(folds)) if folds else []
        each = rows.groupBy("g", "f").agg(*[F.count(F.col("y")[t]).alias(f"n{t}") for t in range(len(targets))], *[F.sum(F.col("y")[t]).alias(f"p{t}") for t in range(len(targets))], F.max(F.size("v")).alias("d"))
        counts = each.collect()
        self.scans += 1
        if not counts:
            raise Rejected("no rows to fit")
        width = max(r["d"] for r in counts) + 1
        self.problems, self.targets = [], targets
        for own in sorted({r["g"] for r in counts}, key=str):
            for t in range(len(targets)):
                for out in (-1, *parts):
                    n = sum(r[f"n{t}"] for r in counts if r["g"] == own and r["f"] != out)
                    p = sum(r[f"p{t}"] or 0 for r in counts if r["g"] == own and r["f"] != out)
                    if not 0 < p < n:
                        self.skipped.append((own, targets[t], out))
                        continue
                    self.problems += [Problem(own, t, c, out, np.array([n - p, p]), np.zeros(width)) for c in self.strengths]
        # Each step scans the rows: they are computed once, and their groups are numbers.
        number = {own: i for i, own in enumerate(dict.fromkeys(p.group for p in self.problems))}
        rows = cut(rows.withColumn("g", F.create_map(*[F.lit(x) for pair in number.items() for x in pair])[F.col("g")]).where("g is not null")) if self.problems else rows
        self.numbers = number
        # As many at a time as their Hessians may take.
        most = max(1, WIDEST**2 // (width * (width + 1)))
        for lo in range(0, len(self.problems), most):
            self._newton(rows, self.problems[lo : lo + most], width)
        return self

    def _scan(self, rows: DataFrame, some: list[Problem], width: int) -> np.ndarray:
        """Of each problem: loss, gradient, Hessian, without penalty."""
        weigh = self.balanced
        sent = rows.sparkSession.sparkContext.broadcast([(self.numbers[p.group], p.target, p.fold, p.weights, p.counts.sum() / (2 * p.counts) if weigh else np.ones(2)) for p in some])
        size = 1 + width + width * width

        def run(batches):
            total = np.zeros((len(sent.value), size))
            for b in batches:
                if not len(b):
                    continue
                groups, folds = b.column("g").to_numpy(zero_copy_only=False), b.column("f").to_numpy(zero_copy_only=False)
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                x = np.column_stack([np.ones(len(b)), v])
                y = b.column("y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1)
                for i, (group, target, fold, w, by_class) in enumerate(sent.value):
                    on = (groups == group) & (folds != fold) & ~np.isnan(y[:, target])
                    if not on.any():
                        continue
                    xo, yo = x[on], y[on, target]
                    weight = by_class[yo.astype(int)]
                    eta = xo @ w
                    p = _sigmoid(eta)
                    total[i, 0] += float(weight @ (np.logaddexp(0, eta) - yo * eta))
                    total[i, 1 : 1 + width] += xo.T @ (weight * (p - yo))
                    total[i, 1 + width :] += ((xo * (weight * p * (1 - p))[:, None]).T @ xo).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        raw = summed(rows.mapInArrow(run, "sums binary"), lambda a, b: (np.frombuffer(a) + np.frombuffer(b)).tobytes())
        sent.destroy()
        self.scans += 1
        return sum(np.frombuffer(r) for r in raw).reshape(len(some), size)

    def _newton(self, rows: DataFrame, some: list[Problem], width: int) -> None:
        penalty = np.ones(width)
        penalty[0] = float(self.penalise_intercept)
        for _ in range(self.rounds):
            left = [p for p in some if not p.done]
            if not left:
                return
            for p, sums in zip(left, self._scan(rows, left, width)):
                loss = p.strength * sums[0] + 0.5 * float(penalty @ p.weights**2)
                if p.best is not None and loss > p.loss + 1e-10 * abs(p.loss):
                    p.step = p.step / 2
                    p.weights = p.best + p.step
                    p.done = np.abs(p.step).max() < 1e-14
                    continue
                grad = p.strength * sums[1 : 1 + width] + penalty * p.weights
                hess = p.strength * sums[1 + width :].reshape(width, width) + np.diag(penalty)
                p.loss, p.best = loss, p.weights
                p.done = bool(np.abs(grad).max() <= self.tolerance * max(1.0, p.strength * p.counts.sum()))
                if not p.done:
                    p.step = -np.linalg.lstsq(hess, grad, rcond=None)[0]
                    p.weights = p.best + p.step
        raise Rejected("logistic fits did not settle")

    def of(self, target: str, strength: float | None = None, group=0, fold: int = -1) -> np.ndarray:
        """Intercept, then weights."""
        return next(p.best for p in self.problems if self.targets[p.target] == target and p.group == group and p.fold == fold and strength in (None, p.strength))

    def scores(self, df: DataFrame, vector: str, names: dict[str, np.ndarray]) -> DataFrame:
        """``df`` with ``_scores``: the linear scores of some fits, in the order of ``names``."""
        w = np.stack(list(names.values()))
        return map_vectors(df, vector, "_scores", lambda x: x @ w[:, 1:].T + w[:, 0])


def fit_heads(train: DataFrame, val: DataFrame, vector: str, continuous: list[str], binary: list[str], alphas=(0.1, 1.0, 10.0, 100.0, 1000.0), strengths=(0.01, 0.1, 1.0, 10.0), balanced: bool = True) -> dict[str, tuple[float, float, np.ndarray]]:
    """For each target (strength, validation score, intercept and weights): ridge by validation R² for continuous ones,
    balanced logistic fits by validation AUROC for binary ones, of equals the first strength. Rows without a target have no
    part in it. Ridge reads train and validation once each; all logistic fits share each step's scan, and all their
    validation scores one more pass."""
    out: dict[str, tuple[float, float, np.ndarray]] = {}
    if continuous:
        a, b = masked_moments(train, vector, continuous), masked_moments(val, vector, continuous)
        for t in continuous:
            d = len(a[t].shift) - 1
            if a[t].n < 2 or b[t].n < 2 or a[t].covariance[d, d] < 1e-16:
                raise Rejected(f"{t}: nearly constant or too few rows")
            ridge, best = Ridge(a[t], d), None
            for alpha in alphas:
                w, w0 = ridge.solve(alpha)
                r2 = explained(b[t], d, w[:, 0], float(w0[0]))
                if best is None or r2 > best[1]:
                    best = (alpha, r2, np.append(w0[0], w[:, 0]))
            out[t] = best
    if binary:
        fits = LogisticFits(strengths, balanced).fit(train, vector, binary)
        if fits.skipped:
            raise Rejected(f"one class only: {fits.skipped}")
        names = {f"{i}:{c}": fits.of(t, c) for i, t in enumerate(binary) for c in strengths}
        scored = fits.scores(val.select(vector, *binary).where(F.col(vector).isNotNull()), vector, names)
        each = F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("head"), F.col("_scores").alias("score"), F.array(*[F.col(t).cast("double") for t in binary for _ in strengths]).alias("y")))
        long = scored.select(each.alias("z")).select("z.head", "z.score", "z.y").where("y is not null and not isnan(y)")
        areas = {r["head"]: r["auroc"] for r in auroc(long.withColumn("y", F.col("y") > 0), "head", "score", "y").collect()}
        for i, t in enumerate(binary):
            at = max(strengths, key=lambda c: (areas.get(f"{i}:{c}") if areas.get(f"{i}:{c}") is not None else -1.0, -strengths.index(c)))
            out[t] = (at, areas.get(f"{i}:{at}"), names[f"{i}:{at}"])
    return out


def prepared(df: DataFrame, columns: list[str], keys=()) -> DataFrame:
    """``df`` with ``features``: each column with its group's median where it is missing, an indicator for each column that
    lacks values anywhere, all scaled to mean 0 and deviation 1 within the group (a flat column stays 0)."""
    k = _keys(keys)
    known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    lacking = df.agg(*[F.count_if(known(c).isNull()).alias(c) for c in columns]).first()
    mid = df.groupBy(*k).agg(*[F.percentile(known(c), F.lit(0.5)).alias(f"_m{i}") for i, c in enumerate(columns)])
    meet = lambda a, b: a.join(b, k) if k else a.crossJoin(F.broadcast(b))
    full = meet(df, mid).withColumns({f"_x{i}": F.coalesce(known(c), F.col(f"_m{i}"), F.lit(0.0)) for i, c in enumerate(columns)} | {f"_y{i}": known(c).isNull().cast("double") for i, c in enumerate(columns) if lacking[c]})
    used = [c for c in full.columns if c.startswith(("_x", "_y"))]
    scale = full.groupBy(*k).agg(*[F.avg(c).alias(f"a{c}") for c in used], *[F.stddev_pop(c).alias(f"s{c}") for c in used])
    out = meet(full, scale)
    return out.select(*df.columns, F.array(*[(F.col(c) - F.col(f"a{c}")) / F.when(F.col(f"s{c}") > 1e-12, F.col(f"s{c}")).otherwise(1.0) for c in used]).alias("features"))


def fitted_propensity(df: DataFrame, key: str, groups: list[str], success: str, covariates: list[str], folds: int = 5, seed: int = 0, low: float = 0.01, high: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(rows, diagnostics): within each group a logistic model of success on imputed and scaled covariates (C of 1, intercept
    penalised, too). ``rows`` is ``df`` with ``selection_probability`` and ``stabilized_ipw``: the group's success rate over
    the probability (kept within 0.02 and 0.98), clipped to the successes' quantiles, null for failures. ``diagnostics``
    has counts, the AUROC of cross-fitted probabilities, and the weights' range and effective size. Groups with one
    outcome only are left out. Folds are dealt by hash; all groups' and folds' fits share each step's scan."""
    g = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in groups])
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(folds)).cast("int")
    # Medians and scales are taken once: fits, scores and rates all read the features.
    base = cut(prepared(df.where(F.col(success).isNotNull()), covariates, groups).withColumns({"_g": g, "_f": u, "_s": F.col(success).cast("double")}))
    fits = LogisticFits((1.0,), balanced=False, penalise_intercept=True).fit(base, "features", ["_s"], "_g", "_f", folds)
    rows = [(p.group, p.fold, [float(x) for x in p.best]) for p in fits.problems]
    spark = df.sparkSession
    table = spark.createDataFrame(rows, "_g string, _k int, _w array<double>")
    own = table.where("_k = -1").select("_g", F.col("_w").alias("_w0"))
    cross = table.where("_k >= 0").select("_g", F.col("_k").alias("_f"), F.col("_w").alias("_w1"))
    p = lambda w: 1 / (1 + F.exp(-F.aggregate(F.zip_with(F.slice(w, 2, F.size(w) - 1), "features", lambda a, b: a * b), F.element_at(w, 1), lambda s, x: s + x)))
    # One row a group, and one a group and fold: as many as there were fits.
    scored = base.join(F.broadcast(own), "_g").join(F.broadcast(cross), ["_g", "_f"], "left").withColumns({"selection_probability": p("_w0"), "_cross": p("_w1")})
    rate = base.groupBy("_g").agg(F.avg("_s").alias("_rate"))
    raw = scored.join(rate, "_g").withColumn("_raw", F.col("_rate") / F.greatest(F.least("selection_probability", F.lit(0.98)), F.lit(0.02)))
    ends = raw.where("_s > 0").groupBy("_g").agg(F.percentile("_raw", F.array(F.lit(low), F.lit(high))).alias("_q"))
    weighed = raw.join(ends, "_g").withColumn("stabilized_ipw", F.when(F.col("_s") > 0, F.greatest(F.least("_raw", F.col("_q")[1]), F.col("_q")[0])))
    w = F.col("stabilized_ipw")
    areas = auroc(weighed.withColumn("_y", F.col("_s") > 0), "_g", "_cross", "_y").select("_g", F.col("auroc").alias("cross_fitted_auroc"))
    d = weighed.groupBy("_g", *groups).agg(F.count("*").alias("records"), F.sum(1 - F.col("_s")).cast("long").alias("failed"), F.avg("_s").alias("success_rate"), F.min(w).alias("ipw_min"), F.max(w).alias("ipw_max"), F.avg(w).alias("ipw_mean"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_size"))
    return weighed.select(*df.columns, "selection_probability", "stabilized_ipw"), d.join(areas, "_g").drop("_g")


# Controls


def control_moments(train: DataFrame, key: str, vector: str, target: str, shuffled: int, gaussian: int, seed: int = 0, block: int = 4096) -> Moments:
    """Moments of vector, target, ``shuffled`` permutations of the target and ``gaussian`` columns of noise, in one pass.

    Rows are dealt by hash to blocks of about ``block`` rows, and each permutation is drawn within the blocks, so that no
    column is sorted or shuffled as a whole; up to that number of rows it is a permutation of all. Draws follow from the
    seed, the block and the order of keys."""
    y = F.nanvl(F.col(target).cast("double"), F.lit(None))
    rows = train.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), y.alias("y")).where("v is not null and y is not null and k is not null")
    blocks = max(1, rows.count() // block)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        v, own = table["v"].combine_chunks(), table["y"].to_numpy()
        rng = np.random.default_rng([seed, table["b"][0].as_py()])
        m = Moments.of(np.column_stack([v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1), own, *(rng.permutation(own) for _ in range(shuffled)), *(rng.normal(size=len(own)) for _ in range(gaussian))]))
        return pa.table({"sums": pa.array([m.tobytes()], pa.binary())})

    parts = rows.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "k"), F.lit(blocks)).cast("int")).groupBy("b").applyInArrow(run, "sums binary")
    total = Moments(0, np.zeros(0), np.zeros(0), np.zeros((0, 0)))
    for raw in summed(parts, lambda a, b: Moments.frombytes(a).merge(Moments.frombytes(b)).tobytes()):
        total = total.merge(Moments.frombytes(raw))
    return total


def probe_with_controls(train: DataFrame, val: DataFrame, key: str, vector: str, target: str, alpha: float, shuffled: int = 100, gaussian: int = 1, seed: int = 0) -> dict:
    """{r2, shuffled, gaussian, p}: the validation R² of a ridge probe, those of probes fitted to permuted targets and to
    noise (all held against the true validation target), and how often, add one, a permuted one reaches the first."""
    m, v = control_moments(train, key, vector, target, shuffled, gaussian, seed), masked_moments(val, vector, [target])[target]
    if m.n < 2 or v.n < 2:
        raise Rejected("too few rows")
    d = len(v.shift) - 1
    w, b = Ridge(m, d).solve(alpha)
    r2 = [explained(v, d, w[:, j], float(b[j])) for j in range(w.shape[1])]
    null = r2[1 : 1 + shuffled]
    return {"r2": r2[0], "shuffled": null, "gaussian": r2[1 + shuffled :], "p": (1 + sum(x >= r2[0] for x in null)) / (1 + shuffled)}


# Erasing one concept, probing the others


def erase_and_probe(train: dict[str, Moments], test: dict[str, Moments], sources: list[str], alpha: float = 1.0, ridge: float = 0.0, floor: float = 0.02, share: float = 0.35, least: float = 0.04) -> list[tuple]:
    """(source, target, r2_before, r2_after, drop, limit, effective) for every source and target: the test R² of a ridge probe
    on the vectors, and on those from which the source is erased, scaled anew and fitted again. ``effective``: what is left
    is below the larger of ``floor`` and ``share`` of the R² before (``least`` at least).

    All follows from the targets' moments (``masked_moments``), since erased rows have mapped moments: no row is erased."""
    d = len(next(iter(train.values())).shift) - 1
    before = {t: _probe(train[t], test[t], d, alpha) for t in train}
    out = []
    for s in sources:
        eraser = Eraser(train[s], d, ridge)
        for t in train:
            after = _probe(train[t].mapped(eraser.matrix, eraser.mean), test[t].mapped(eraser.matrix, eraser.mean), d, alpha)
            limit = max(floor, share * max(before[t], least))
            out.append((s, t, before[t], after, before[t] - after, limit, bool(after < limit)))
    return out


def _probe(train: Moments, test: Moments, d: int, alpha: float) -> float:
    w, b = Ridge(train, d).solve(alpha)
    return explained(test, d, w[:, 0], float(b[0]))


# Directions in several spaces


class Spaces:
    """Raw, standardised, whitened and code space of a vector. A vector is something that is added to points, a covector
    something that reads them out; both keep what they do when the space changes."""

    def __init__(self, m: Moments, features: int, ridge: float = 0.0, code_scale: np.ndarray | None = None):
        c = m.covariance[:features, :features]
        self.shrunk = c + ridge * np.trace(c) / max(1, features) * np.eye(features)
        sd = np.sqrt(np.maximum(np.diag(c), 0))
        self.scale = {"raw": np.ones(features), "standardised": np.where(sd > 1e-8, sd, 1.0), "code": np.maximum(np.ones(features) if code_scale is None else code_scale, 1e-6)}
        self.root, self.inverse = matrix_root(self.shrunk), matrix_root(self.shrunk, True)

    def vector(self, u: np.ndarray, source: str, target: str) -> np.ndarray:
        raw = self.root @ u if source == "whitened" else u * self.scale[source]
        return self.inverse @ raw if target == "whitened" else raw / self.scale[target]

    def covector(self, w: np.ndarray, source: str, target: str) -> np.ndarray:
        raw = self.inverse @ w if source == "whitened" else w / self.scale[source]
        return self.root @ raw if target == "whitened" else raw * self.scale[target]


def concept_directions(m: Moments, alpha: float, ridge: float = 0.0, code_scale: np.ndarray | None = None, least: int = 100) -> dict[str, np.ndarray]:
    """Unit directions of the last column's concept: what a ridge probe reads (``probe_standardised``, ``probe_raw``:
    covectors), and what erasing it takes off (``erased_whitened``, ``erased_raw``, ``erased_code``: vectors), with the
    covariance shrunk by ``ridge``. ``code_scale``: the deviations by which codes were standardised."""
    d = len(m.shift) - 1
    if m.n < least:
        raise Rejected("too few rows")
    spaces = Spaces(m, d, ridge, code_scale)
    w = Ridge(m, d).solve(alpha)[0][:, 0]
    white = spaces.inverse @ m.covariance[:d, d]
    out = {"probe_standardised": spaces.covector(w, "raw", "standardised"), "probe_raw": w, "erased_whitened": white, "erased_raw": spaces.vector(white, "whitened", "raw"), "erased_code": spaces.vector(white, "whitened", "code")}
    for name, u in out.items():
        size = float(np.linalg.norm(u))
        if not np.isfinite(size) or size <= 1e-12:
            raise Rejected(f"{name} has no direction")
        out[name] = u / size
    return out


# Components of wide vectors


def randomised_components(df: DataFrame, vector: str, k: int, extra: int = 10, rounds: int = 30, tolerance: float = 1e-10, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(directions as rows, variances): the first ``k`` principal components of vectors of any width, without a square matrix.

    A random block of ``k + extra`` directions is turned towards the range: each round is one pass that sums up width x
    block numbers in each partition, made orthonormal on the driver, until the first ``k`` stand still. A last pass
    decomposes each partition's coordinates (a tall, narrow matrix) into Q and R; R factors are merged in tasks, and the
    last one's singular values are the deviations. The largest component of each direction is positive."""
    v = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    add = lambda a, b: (np.frombuffer(a) + np.frombuffer(b)).tobytes()

    def matrix(b) -> np.ndarray:
        return b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)

    def sums(batches):
        total, n = None, 0
        for b in batches:
            if len(b):
                x = matrix(b)
                total = x.sum(0) if total is None else total + x.sum(0)
                n += len(b)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(total, n).tobytes()], pa.binary())], ["sums"])

    got = summed(v.mapInArrow(sums, "sums binary"), add)
    if not got:
        raise Rejected("no vectors")
    flat = sum(np.frombuffer(r) for r in got)
    mean, n = flat[:-1] / flat[-1], flat[-1]
    block = min(k + extra, len(mean))
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), block)))[0]
    sc = df.sparkSession.sparkContext
    for _ in range(rounds):
        sent = sc.broadcast((mean, q))

        def turn(batches, sent=sent):
            total = None
            for b in batches:
                if len(b):
                    x = matrix(b) - sent.value[0]
                    own = x.T @ (x @ sent.value[1])
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        z = sum(np.frombuffer(r) for r in summed(v.mapInArrow(turn, "sums binary"), add)).reshape(q.shape)
        sent.destroy()
        # Rayleigh-Ritz within the block: the first k of it are what is looked for.
        _, inner = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        top = q @ inner[:, ::-1][:, :k]
        new = np.linalg.qr(z @ inner[:, ::-1])[0]
        rest = top - new @ (new.T @ top)
        q = new
        if np.abs(rest).max() < tolerance:
            break
    sent = sc.broadcast((mean, q))

    def narrow(batches):
        r = None
        for b in batches:
            if len(b):
                y = (matrix(b) - sent.value[0]) @ sent.value[1]
                r = np.linalg.qr(y if r is None else np.vstack([r, y]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["sums"])

    width = q.shape[1]

    def stack(a: bytes, b: bytes) -> bytes:
        return np.linalg.qr(np.vstack([np.frombuffer(x).reshape(-1, width) for x in (a, b)]), mode="r").tobytes()

    r = np.linalg.qr(np.vstack([np.frombuffer(x).reshape(-1, width) for x in summed(v.mapInArrow(narrow, "sums binary"), stack)]), mode="r")
    sent.destroy()
    _, s, right = np.linalg.svd(r, full_matrices=False)
    rows = (q @ right.T).T[:k]
    sign = np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])
    return rows * sign[:, None], s[:k] ** 2 / n


# Stability of selected atoms


def functional_stability(picks: DataFrame, unit: list[str], seed: str, group: str, atom: str, vector: str) -> DataFrame:
    """(unit, seed_i, seed_j, selected_cosine, selected_cosine_min, random_cosine, cosine_excess, selected_overlap,
    random_overlap, random_overlap_q95, overlap_excess, p, random_groups) for every two seeds of a unit.

    ``picks`` has the atoms' vectors of each unit, seed and group: group 0 the selected ones, others drawn at random, paired
    by number. Cosines are signed, under the best matching; overlap is that of the spans; ``p`` counts, add one, the random
    groups whose overlap reaches the selected one's. A group holds few atoms (they are matched in one task); a seed
    without a group has no part in it."""
    v = F.col(vector).cast("array<double>")
    sets = picks.groupBy(*unit, seed, group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(atom).alias("a"), v.alias("v")))), lambda x: x["v"]).alias("_v"))
    a, b = (sets.select(*unit, group, F.col(seed).alias(f"seed_{i}"), F.col("_v").alias(f"_{i}")) for i in "ij")
    pairs = a.join(b, [*unit, group]).where("seed_i < seed_j")

    def run(batches):
        for t in batches:
            rows = []
            for x, y in zip(t.column("_i").to_pylist(), t.column("_j").to_pylist()):
                x, y = np.array(x, float), np.array(y, float)
                c = matched_cosines(x, y) if len(x) <= len(y) else matched_cosines(y, x)
                rows.append((float(c.mean()), float(c.min()), subspace_overlap(x, y)))
            mean, low, over = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(t.column(c) for c in keys), pa.array(mean, pa.float64()), pa.array(low, pa.float64()), pa.array(over, pa.float64())], [*keys, "_mean", "_low", "_over"])

    keys = [*unit, group, "seed_i", "seed_j"]
    kinds = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keys)
    m = pairs.select(*keys, "_i", "_j").mapInArrow(run, f"{kinds}, _mean double, _low double, _over double")
    chosen = m.where(F.col(group) == 0).select(*unit, "seed_i", "seed_j", F.col("_mean").alias("selected_cosine"), F.col("_low").alias("selected_cosine_min"), F.col("_over").alias("selected_overlap"))
    both = m.where(F.col(group) != 0).join(chosen, [*unit, "seed_i", "seed_j"])
    s = both.groupBy(*unit, "seed_i", "seed_j", "selected_cosine", "selected_cosine_min", "selected_overlap").agg(
        F.avg("_mean").alias("random_cosine"), F.avg("_over").alias("random_overlap"), F.percentile("_over", F.lit(0.95)).alias("random_overlap_q95"),
        ((1 + F.count_if(F.col("_over") >= F.col("selected_overlap"))) / (1 + F.count("*"))).alias("p"), F.count("*").alias("random_groups"),
    )
    return s.withColumns({"cosine_excess": F.col("selected_cosine") - F.col("random_cosine"), "overlap_excess": F.col("selected_overlap") - F.col("random_overlap")})


