"""Embedding whitening: centred moments merged pairwise in a tree, axes on the driver, a second pass that checks them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import others

#: Vectors may be so wide: the driver holds a few matrices of this many rows and columns (134 MB each).
WIDEST = 4096
#: Bytes of a block of rows within a batch, as doubles.
BLOCK = 8 << 20
#: Partial moments that a task of the tree merges.
FAN = 4
#: A component whose variance is less than this share of the greatest, times the width, has none.
FLAT = 1e-14
ADDED = ("white", "white_deviation", "white_n")


@dataclass
class Moments:
    """Count, sums about an origin and centred scatter of some rows. On integers, counts and sums are exact in any order."""

    n: int
    origin: np.ndarray
    rest: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        origin = x[0].copy()
        y = x - origin
        rest = y.sum(0)
        y = y - rest / len(x)
        return cls(len(x), origin, rest, y.T @ y)

    def merge(self, other: Moments) -> Moments:
        """Chan's formula; the difference of the means is that of the origins, exact on integers, and of the small rests."""
        moved = other.origin - self.origin
        gap = moved + (other.rest / other.n - self.rest / self.n)
        n = self.n + other.n
        scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, self.origin, self.rest + other.rest + other.n * moved, scatter)


def _merged(a: Moments | None, b: Moments | None) -> Moments | None:
    if a is None or b is None:
        return a if b is None else b
    if len(a.origin) != len(b.origin):
        raise ValueError(f"vectors of {len(a.origin)} and of {len(b.origin)} entries")
    return a.merge(b)


def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix in double): vectors that are not null and hold no null or non-finite entry."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.take(pa.array(rows))
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls turn into NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    end = np.cumsum(size)
    good = bad[end] == bad[end - size]
    if len(set(size[good].tolist())) > 1:
        raise ValueError(f"vectors of {size[good].min()} and of {size[good].max()} entries")
    width = int(size[good][0]) if good.any() else 0
    if width > WIDEST:
        raise ValueError(f"vectors of {width} entries; {WIDEST} are the most")
    return rows[good], flat[np.repeat(good, size)].reshape(len(rows[good]), width)


def on_grid(x: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """``floor(scale * x) + shift`` as integers."""
    y = np.floor(scale * x)
    if y.size and np.abs(y).max() >= 2.0**52:
        raise ValueError("an entry is too large for whole numbers on the grid")
    return y.astype(np.int64) + shift


def _blocks(x: np.ndarray):
    """(first row, rows) of some rows at a time."""
    step = max(1, BLOCK // (8 * max(1, x.shape[1])))
    for lo in range(0, len(x), step):
        yield lo, x[lo : lo + step]


def _moments(df: DataFrame, vector: str, values) -> Moments | None:
    """Of what ``values`` makes of the usable vectors: one partial a partition, merged by ``FAN`` in a tree of tasks."""

    def partial(batches):
        held = None
        for b in batches:
            for _, x in _blocks(usable(b.column(0))[1]):
                held = _merged(held, Moments.of(values(x)))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.n], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (held.origin, held.rest, held.scatter)), pa.array([held.origin.dtype.str])], ["n", "origin", "rest", "scatter", "kind"])

    def read(row) -> Moments:
        origin, rest = (np.frombuffer(row[c], row["kind"]) for c in ("origin", "rest"))
        return Moments(row["n"], origin, rest, np.frombuffer(row["scatter"], np.float64).reshape(len(origin), -1))

    parts = df.select(vector).mapInArrow(partial, "n long, origin binary, rest binary, scatter binary, kind string").rdd.map(read)
    depth = max(2, math.ceil(math.log(max(2, parts.getNumPartitions()), FAN)))
    return parts.treeAggregate(None, _merged, _merged, depth)


@dataclass
class Whitening:
    """A fitted map: ``axes`` has the components as columns, by falling variance; ``center + rest / n`` is the mean."""

    vector: str
    scale: int
    shift: int
    n: int
    center: np.ndarray
    rest: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    axes: np.ndarray

    @property
    def live(self) -> np.ndarray:
        """Which components have a variance at all."""
        return self.variances > FLAT * max(1, len(self.center)) * self.variances.max(initial=0.0)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of vectors on the grid; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.live, 1 / np.sqrt(self.variances), np.nan)
        return ((x - self.center) - self.rest / self.n) @ self.axes * scale

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of ``(n * x - S) ** 2``, exact."""
        y = x - self.center
        most = self.n * int(np.abs(y).max(initial=0)) + int(np.abs(self.rest).max(initial=0))
        if most * most * max(1, x.shape[1]) < 2**63:
            return pa.array(((self.n * y - self.rest) ** 2).sum(1), pa.int64()).cast(pa.decimal128(38))
        from decimal import Decimal

        gap = self.n * y.astype(object) - self.rest.astype(object)
        return pa.array([Decimal(int(v)) for v in (gap * gap).sum(1)], pa.decimal128(38))

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows with a usable vector, with ``white`` (array, null entries where a component has no variance),
        ``white_deviation`` and ``white_n``; columns of these names, in any case, are replaced."""
        own = others(df, ADDED)
        base = df.select(*own)
        at = own.index(self.vector)

        def run(batches):
            for b in batches:
                rows, x = usable(b.column(at))
                for lo, of in _blocks(x):
                    some = rows[lo : lo + len(of)]
                    grid = on_grid(of, self.scale, self.shift)
                    white = self.projected(grid)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * white.shape[1], pa.int32()), pa.array(white.ravel(), pa.float64(), from_pandas=True))
                    kept = b.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([*kept.columns, lists, self.deviations(grid), pa.array(np.full(len(some), self.n), pa.int64())], [*own, *ADDED])

        schema = T.StructType([*base.schema.fields, T.StructField("white", T.ArrayType(T.DoubleType())), T.StructField("white_deviation", T.DecimalType(38, 0)), T.StructField("white_n", T.LongType())])
        return base.mapInArrow(run, schema)

    def identity_error(self, df: DataFrame) -> float | None:
        """A second pass: how far the whitened covariance of ``df`` is from the identity, over components with variance."""
        live = self.live
        found = _moments(df, self.vector, lambda x: self.projected(on_grid(x, self.scale, self.shift))[:, live]) if live.any() else None
        return None if found is None else float(np.abs(found.scatter / found.n - np.eye(int(live.sum()))).max())


def fit(df: DataFrame, vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """The first ``components`` principal axes of all usable vectors of ``df``; None if there are none.

    Entries become whole numbers ``floor(scale * c) + shift``, so that counts, sums and deviations are exact whatever the
    order of rows. Each partition makes its count, mean and centred scatter block by block; partials meet pairwise by
    Chan's formula in a tree of tasks, and the driver gets the last few, of d x d numbers each (d at most ``WIDEST``), and
    takes the eigenvectors. An axis's greatest entry is positive.
    """
    m = _moments(df, vector, lambda x: on_grid(x, scale, shift))
    if m is None:
        return None
    # The centre is the whole number next to the mean.
    step = np.rint(m.rest / m.n).astype(np.int64)
    v = m.scatter / m.n
    values, axes = np.linalg.eigh((v + v.T) / 2)
    keep = slice(None, -min(components, len(values)) - 1, -1) if len(values) else slice(0, 0)
    values, axes = np.maximum(values[keep], 0.0), axes[:, keep]
    top = np.abs(axes).argmax(0) if axes.size else np.zeros(0, np.int64)
    axes = axes * np.where(axes[top, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    return Whitening(vector, scale, shift, m.n, m.origin + step, m.rest - m.n * step, values, explained, axes)


def whiten(df: DataFrame, vector: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``df`` with its whitened vectors: ``Whitening.transform`` and, on each row, ``white_explained`` (array) and
    ``white_identity_error``.

    Rows whose vector is null or holds null or non-finite entries go. Other columns pass through, null or not, and columns
    named as the added ones, in any case, are replaced; repeated rows count as often as they come; equal eigenvalues have
    any axes of their space. A component without variance (one row, equal rows, too few rows) has null coordinates, and
    ``white_explained`` is null where nothing varies. No usable vector: no rows. Vectors of different widths, of more
    than ``WIDEST`` entries, or with entries of 2 ** 52 / ``scale`` or more raise an error.
    """
    own = others(df, (*ADDED, "white_explained", "white_identity_error"))
    df = df.select(*own)
    found = fit(df, vector, components, scale, shift)
    # Without a fit no row is usable, and the same job gives none.
    w = found or Whitening(vector, scale, shift, 1, *np.zeros((2, 0), np.int64), *np.zeros((2, 0)), np.zeros((0, 0)))
    error = w.identity_error(df)
    explained = F.array(*[F.lit(None if math.isnan(e) else float(e)).cast("double") for e in w.explained]).cast("array<double>")
    return w.transform(df).withColumns({"white_explained": explained, "white_identity_error": F.lit(error).cast("double")})


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """Contract columns for all embeddings."""
    df = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip(F.col("white").alias("w"), F.col("white_explained").alias("e"))).alias("at", "of")
    return df.select("vec_id", F.col("white_n").alias("n"), F.col("white_deviation").cast("long").alias("deviation"), "white_identity_error", each).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("of.w").alias("whitened"), F.col("of.e").alias("explained"), F.col("white_identity_error").alias("identity_error"),
    )
