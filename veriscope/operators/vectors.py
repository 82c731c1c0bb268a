"""Vectors and signals as arrays: column expressions, and Gram matrices summed up by partition."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def total(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda a, x: a + x)


def given(value: Column, f) -> Column:
    """``f(value)``, of a value that is computed once: what a lambda takes from outside is computed anew for each element."""
    return F.transform(F.array(value), f)[0]


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a, b, least: float = 1e-12) -> Column:
    d = norm(a) * norm(b)
    return F.when(d > least, dot(a, b) / d)


def scaled(v, k) -> Column:
    return given(k if isinstance(k, Column) else F.lit(k), lambda own: F.transform(_c(v), lambda x: x * own))


def added(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def without_direction(v, u) -> Column:
    """``v`` less its part along the unit vector ``u``."""
    return given(dot(v, u), lambda d: F.zip_with(_c(v), _c(u), lambda x, y: x - d * y))


def norm_matched(v, target, fallback, least: float = 1e-10) -> Column:
    """``v`` at the length of ``target``; ``fallback``'s direction where ``v`` has none."""
    n = norm(v)
    return F.when(n > least, scaled(v, norm(target) / n)).otherwise(scaled(fallback, norm(target) / norm(fallback)))


def z_scored(v, least: float = 1e-6) -> Column:
    """Each value less the mean, by the population deviation, at least ``least``."""
    n = F.nullif(F.size(_c(v)), F.lit(0))
    # Mean and deviation are each computed once a row, not once a value.
    def centred(mean: Column) -> Column:
        sd = F.greatest(F.sqrt(total(F.transform(_c(v), lambda x: (x - mean) * (x - mean))) / n), F.lit(least))
        return given(sd, lambda s: F.transform(_c(v), lambda x: (x - mean) / s))

    return given(total(v) / n, centred)


def top_k(v, k: int, by_size: bool = False) -> Column:
    """The ``k`` largest values kept in place, others 0; positives only unless by size; the first of equals."""
    placed = F.transform(_c(v), lambda x, i: F.struct((F.abs(x) if by_size else x).alias("s"), (-i).alias("i")))
    kept = F.slice(F.sort_array(placed if by_size else F.filter(placed, lambda p: p["s"] > 0), asc=False), 1, k)
    return given(F.transform(kept, lambda p: -p["i"]), lambda where: F.transform(_c(v), lambda x, i: F.when(F.array_contains(where, i), x).otherwise(0.0)))


def limb_leads(i, ii) -> dict[str, Column]:
    """The four leads that two others give."""
    two = lambda f: F.zip_with(_c(i), _c(ii), f)
    return {"III": two(lambda a, b: b - a), "aVR": two(lambda a, b: -(a + b) / 2), "aVL": two(lambda a, b: a - b / 2), "aVF": two(lambda a, b: b - a / 2)}


def centre_crop(v, n: int) -> Column:
    c = _c(v)
    return F.when(F.size(c) > n, F.slice(c, F.floor((F.size(c) - n) / 2).cast("int") + 1, n)).otherwise(c)


def resample(df: DataFrame, vector: str, n: int) -> DataFrame:
    """Vectors resampled to ``n`` values through their Fourier transform; null stays null, an empty vector becomes null.
    Vectors of one length are transformed together."""

    def some(x: np.ndarray) -> np.ndarray:
        size = x.shape[1]
        f = np.fft.rfft(x, axis=1)
        keep = np.zeros((len(x), n // 2 + 1), complex)
        m = min(size, n) // 2 + 1
        keep[:, :m] = f[:, :m]
        if min(size, n) % 2 == 0 and n != size:
            keep[:, min(size, n) // 2] *= 2 if n < size else 0.5
            if n < size:
                keep[:, n // 2] = keep[:, n // 2].real
        return np.fft.irfft(keep, n, axis=1) * n / size

    own = [c for c in df.columns if c != vector]
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == vector else f for f in df.schema])

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            v = b.column("_v")
            size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
            end = np.cumsum(size)
            flat = v.flatten().to_numpy(zero_copy_only=False)
            out = np.zeros((len(b), n))
            for length in np.unique(size[size > 0]):
                at = np.flatnonzero(size == length)
                out[at] = some(flat[(end[at] - length)[:, None] + np.arange(length)])
            there = size > 0
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(there, n, 0))), pa.int32()), pa.array(out[there].ravel()), mask=pa.array(~there))
            yield pa.RecordBatch.from_arrays([lists if f.name == vector else b.column(f.name) for f in schema], schema.names)

    return df.select(*own, F.col(vector).cast("array<double>").alias("_v")).mapInArrow(run, schema)


class Moments:
    """Count, means and centred scatter of rows (features, then targets), and what follows from them. ``d`` columns make a
    d x d matrix, whatever the number of rows. Means are kept as an origin, one of the rows, and what is left to it, so that
    nothing is lost where they are large beside the deviations."""

    def __init__(self, n: float, origin: np.ndarray, shift: np.ndarray, scatter: np.ndarray):
        self.n, self.origin, self.shift, self.scatter = n, origin, shift, scatter

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        y = rows - rows[0]
        shift = y.mean(0)
        y -= shift
        return cls(len(rows), rows[0].copy(), shift, y.T @ y)

    def merge(self, other: Moments) -> Moments:
        """Of both sets of rows, by Chan's formula."""
        if not self.n or not other.n:
            return self if self.n else other
        moved = (other.origin - self.origin) + (other.shift - self.shift)
        n = self.n + other.n
        return Moments(n, self.origin, self.shift + moved * (other.n / n), self.scatter + other.scatter + np.outer(moved, moved) * (self.n * other.n / n))

    def part(self, at: list[int]) -> Moments:
        """The moments of some of the columns."""
        return Moments(self.n, self.origin[at], self.shift[at], self.scatter[np.ix_(at, at)])

    def mapped(self, matrix: np.ndarray, about: np.ndarray) -> Moments:
        """The moments once the first columns are mapped by ``matrix`` about a point; the others stay. No row is read."""
        d, k = len(about), len(self.shift)
        full = np.eye(k)
        full[:d, :d] = matrix
        origin = self.origin.copy()
        origin[:d] = about
        shift = self.mean - origin
        return Moments(self.n, origin, full @ shift, full @ self.scatter @ full.T)

    def tobytes(self) -> bytes:
        return np.concatenate([[self.n], self.origin, self.shift, self.scatter.ravel()]).tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> Moments:
        x = np.frombuffer(raw)
        d = math.isqrt(len(x)) - 1  # d * d + 2 * d + 1 numbers
        return cls(x[0], x[1 : d + 1], x[d + 1 : 2 * d + 1], x[2 * d + 1 :].reshape(d, d))

    @property
    def mean(self) -> np.ndarray:
        return self.origin + self.shift

    @property
    def covariance(self) -> np.ndarray:
        return self.scatter / max(self.n, 1)

    @property
    def gram(self) -> np.ndarray:
        """Sums of products, not centred."""
        return self.scatter + self.n * np.outer(self.mean, self.mean)


#: Columns that a Gram matrix may have (its square comes to the driver).
WIDEST = 4096


def summed(parts: DataFrame, merge, most: int = 16) -> list[bytes]:
    """Rows of one binary ``sums`` merged by some tasks; the driver gets ``most`` at most. ``merge(a, b)`` of two of them."""

    def add(batches):
        total = None
        for b in batches:
            for raw in b.column("sums").to_pylist():
                total = raw if total is None else merge(total, raw)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.binary())], ["sums"])

    return [bytes(r["sums"]) for r in parts.repartition(most).mapInArrow(add, "sums binary").collect()]


def masked_moments(df: DataFrame, vector: str, targets: list[str]) -> dict[str, Moments]:
    """For each target the moments of vector and target over the rows that have both, all from one pass. Targets times
    squared width are bounded by ``WIDEST`` squared."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), *[F.nanvl(F.col(t).cast("double"), F.lit(None)).alias(f"t{i}") for i, t in enumerate(targets)]).where("v is not null")
    empty = Moments(0, np.zeros(0), np.zeros(0), np.zeros((0, 0)))

    def pack(own: list[Moments]) -> bytes:
        raw = [m.tobytes() for m in own]
        return np.array([len(r) for r in raw], np.int64).tobytes() + b"".join(raw)

    def unpack(raw: bytes) -> list[Moments]:
        size = np.frombuffer(raw[: 8 * len(targets)], np.int64)
        end = 8 * len(targets) + np.cumsum(size)
        return [Moments.frombytes(raw[e - n : e]) for n, e in zip(size, end)]

    def run(batches):
        held = [empty] * len(targets)
        for b in batches:
            if not len(b):
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            if (x.shape[1] + 1) ** 2 * len(targets) > WIDEST**2:
                raise ValueError("vectors too wide for so many targets")
            for i in range(len(targets)):
                y = b.column(f"t{i}").to_numpy(zero_copy_only=False).astype(float)
                there = ~np.isnan(y)
                if there.any():
                    held[i] = held[i].merge(Moments.of(np.column_stack([x[there], y[there]])))
        yield pa.RecordBatch.from_arrays([pa.array([pack(held)], pa.binary())], ["sums"])

    def merge(a: bytes, b: bytes) -> bytes:
        return pack([x.merge(y) for x, y in zip(unpack(a), unpack(b))])

    total = [empty] * len(targets)
    for raw in summed(rows.mapInArrow(run, "sums binary"), merge):
        total = [x.merge(y) for x, y in zip(total, unpack(raw))]
    return dict(zip(targets, total))


def moments(df: DataFrame, vector: str, targets: list[str] | None = None) -> Moments:
    """One pass: each partition sums up its rows' products, some tasks add these matrices up, the driver the last of them.
    Rows with a null in the vector or a target are left out."""
    targets = targets or []
    rows = df.select(F.col(vector).cast("array<double>").alias("v"), *[F.col(t).cast("double") for t in targets]).dropna()

    def run(batches):
        held = None
        for b in batches:
            if not len(b):
                continue
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            if x.shape[1] + len(targets) > WIDEST:
                raise ValueError("vectors too wide for a Gram matrix")
            own = Moments.of(np.column_stack([x, *(b.column(t).to_numpy(zero_copy_only=False) for t in targets)]))
            held = own if held is None else held.merge(own)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["sums"])

    # One scatter a partition, merged by some tasks, then on the driver.
    total = Moments(0, np.zeros(0), np.zeros(0), np.zeros((0, 0)))
    for raw in summed(rows.mapInArrow(run, "sums binary"), lambda a, b: Moments.frombytes(a).merge(Moments.frombytes(b)).tobytes()):
        total = total.merge(Moments.frombytes(raw))
    return total
