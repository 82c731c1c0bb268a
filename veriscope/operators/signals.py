"""Signals of records: model inputs by protocol, peaks and wave limits, warps by each record's landmarks.

Records are rows; a batch's signals of one length are worked on as one matrix. Filters and thresholds look at a bounded
stretch of a signal only, so that a long one may be cut into overlapping pieces and gives the same marks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The order of leads, and those from which the others follow.
LEADS = ("I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6")
INDEPENDENT = ("I", "II", "V1", "V2", "V3", "V4", "V5", "V6")
PROTOCOLS = ("native", "lead", "temporal", "joint")


def by_length(column: pa.Array):
    """(rows, matrix) of the lists of one length each; null and empty lists have no part."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    end = np.cumsum(size)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        yield at, flat[(end[at] - n)[:, None] + np.arange(n)]


def lists(rows: list) -> pa.Array:
    """Arrays, or None, as a list column."""
    size = np.array([0 if r is None else len(r) for r in rows], np.int64)
    flat = np.concatenate([np.asarray(r, float) for r in rows if r is not None]) if size.any() else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(flat, pa.float64()), mask=pa.array([r is None for r in rows]))


# Model inputs by protocol


def fourier(x: np.ndarray, n: int) -> np.ndarray:
    """The last axis resampled to ``n`` values through its Fourier transform."""
    size = x.shape[-1]
    if size == n:
        return x
    f = np.fft.rfft(x)
    keep = np.zeros((*x.shape[:-1], n // 2 + 1), complex)
    m = min(size, n) // 2 + 1
    keep[..., :m] = f[..., :m]
    if min(size, n) % 2 == 0:
        edge = min(size, n) // 2
        keep[..., edge] = 2 * keep[..., edge].real if n < size else keep[..., edge] / 2
    return np.fft.irfft(keep, n) * n / size


def _z_scored(x: np.ndarray) -> np.ndarray:
    x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
    return (x - x.mean(-1, keepdims=True)) / np.maximum(x.std(-1, keepdims=True), 1e-6)


def protocol_input(x: np.ndarray, protocol: str, leads: int, samples: int, crop: bool = False, canonical: int = 2500) -> np.ndarray:
    """What an interface of ``leads`` (8 or 12) and ``samples`` gets of records (record, 12 leads, time) under a protocol.

    In order: the eight independent leads (for 8, and as the source of the others where leads are harmonised), scaling by
    lead, the canonical length where time is harmonised, then the interface's length, which is cut out of the middle of the
    canonical one where ``crop`` and time is not harmonised."""
    if protocol not in PROTOCOLS or leads not in (8, 12):
        raise ValueError(f"unknown protocol or leads: {protocol}, {leads}")
    if x.ndim != 3 or x.shape[1] != 12:
        raise ValueError("records have twelve leads")
    own = x[:, [LEADS.index(n) for n in INDEPENDENT]]
    if leads == 8:
        x = own
    elif protocol in ("lead", "joint"):
        i, ii = own[:, 0], own[:, 1]
        x = np.concatenate([np.stack([i, ii, ii - i, -(i + ii) / 2, i - ii / 2, ii - i / 2], 1), own[:, 2:]], 1)
    x = _z_scored(x)
    if protocol in ("temporal", "joint"):
        x = fourier(x, canonical)
    elif crop:
        x = fourier(x, canonical)
        first = (canonical - samples) // 2
        return x[..., first : first + samples]
    return fourier(x, samples)


def model_inputs(df: DataFrame, record: str, interfaces: DataFrame, protocols=PROTOCOLS, canonical: int = 2500) -> DataFrame:
    """(``df``'s columns but ``record``, interface, protocol, input): every record under every interface and protocol.

    ``record`` is twelve leads of one length (array of arrays, in the order of ``LEADS``); ``interfaces`` is a small table
    (interface, leads, samples, crop, flatten), collected. ``input`` is an array of leads, or one lead of all values in turn
    where ``flatten``. A null record, one without twelve leads of one length or without samples has a null input."""
    table = [r.asDict() for r in interfaces.select("interface", "leads", "samples", "crop", "flatten").collect()]
    for r in table:
        if r["leads"] not in (8, 12) or r["crop"] and r["samples"] > canonical:
            raise ValueError(f"an interface that can't be built: {r}")
    own = [c for c in df.columns if c not in (record, "interface", "protocol", "input")]
    wide = df.select(*own, F.col(record).cast("array<array<double>>").alias("_w"))
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField("interface", T.StringType()), T.StructField("protocol", T.StringType()), T.StructField("input", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def run(batches):
        for b in batches:
            w = b.column("_w")
            leads = pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False)
            inner = w.flatten()
            length = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, stop, first = inner.flatten().to_numpy(zero_copy_only=False), np.cumsum(length), np.cumsum(leads) - leads
            groups: dict[int, list[int]] = {}
            for i in np.flatnonzero(leads == 12).tolist():
                n = length[first[i] : first[i] + 12]
                if n[0] > 0 and (n == n[0]).all():
                    groups.setdefault(int(n[0]), []).append(i)
            for spec in table:
                for protocol in protocols:
                    out: list = [None] * len(b)
                    for n, rows in groups.items():
                        begin = (stop - length)[first[rows]]
                        x = flat[begin[:, None] + np.arange(12 * n)].reshape(len(rows), 12, n)
                        for i, y in zip(rows, protocol_input(x, protocol, spec["leads"], spec["samples"], spec["crop"], canonical)):
                            out[i] = [y.ravel()] if spec["flatten"] else list(y)
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array([spec["interface"]] * len(b)), pa.array([protocol] * len(b)), pa.array(out, pa.list_(pa.list_(pa.float64())))], schema.names)

    return wide.mapInArrow(run, schema)


# Peaks and wave limits


def _smoothed(x: np.ndarray, width: int) -> np.ndarray:
    """A Hann window's weighted mean about each value, the ends held."""
    half = max(1, width // 2)
    w = np.hanning(2 * half + 3)[1:-1]
    w /= w.sum()
    wide = np.pad(x, [(0, 0), (half, half)], mode="edge")
    out = np.zeros_like(x)
    for k in range(2 * half + 1):
        out += w[k] * wide[:, k : k + x.shape[1]]
    return out


def _sliding_max(x: np.ndarray, half: int) -> np.ndarray:
    """The largest value within ``half`` of each, in doubling steps."""
    y = np.pad(x, [(0, 0), (half, half)], constant_values=-np.inf)
    have, want = 1, 2 * half + 1
    while have * 2 <= want:
        y = np.maximum(y[:, :-have], y[:, have:])
        have *= 2
    rest = want - have
    return np.maximum(y[:, : x.shape[1]], y[:, rest : rest + x.shape[1]])


class Delineation:
    """Peaks of a filter bank, and the limits of the waves about them. ``reach`` is how far it looks, in samples."""

    def __init__(self, rate: float):
        self.rate = rate
        self.reach = self._of(7.0)

    def _of(self, seconds: float) -> int:
        return max(1, int(round(seconds * self.rate)))

    def band(self, x: np.ndarray) -> np.ndarray:
        """Without drift (slower than about two a second) and without noise (faster than about thirty)."""
        return _smoothed(x, self._of(0.03)) - _smoothed(x, self._of(0.4))

    def peaks(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each row the samples of its peaks. The energy of the band's slope must be largest within the refractory time of
        0.2 s and reach 0.3 of the middle one of the maxima of five stretches of 2 s about it; the mark is the band's
        largest deflection, most of all upwards, within 0.08 s."""
        n = x.shape[1]
        y = self.band(x)
        slope = np.zeros_like(y)
        slope[:, 1:-1] = y[:, 2:] - y[:, :-2]
        energy = _smoothed(slope * slope, self._of(0.12))
        top = _sliding_max(energy, self._of(1.0))
        step = self._of(2.0)
        about = np.stack([top[:, np.clip(np.arange(n) + k * step, 0, n - 1)] for k in (-2, -1, 0, 1, 2)])
        limit = 0.3 * np.median(about, axis=0)
        at = (energy >= _sliding_max(energy, self._of(0.2))) & (energy > limit) & (energy > 1e-18)
        out, near = [], self._of(0.08)
        for row, deflection in zip(at, y):
            marks = []
            for i in np.flatnonzero(row).tolist():
                lo = max(0, i - near)
                piece = deflection[lo : i + near + 1]
                size = np.where(piece > 0, piece, -0.6 * piece)
                mark = lo + int(size.argmax())
                # A plateau of equal energy gives one mark.
                if not marks or mark - marks[-1] > self._of(0.2):
                    marks.append(mark)
            out.append(np.array(marks, np.int64))
        return out

    def limits(self, x: np.ndarray, peaks: list[np.ndarray]) -> list[dict[str, np.ndarray]]:
        """Of each row and peak (NaN where there is none): ``r_on`` and ``r_off``, where the slope at the finer scale (12 ms)
        falls below a twelfth of its largest by the peak; ``t_peak`` and ``t_off`` and ``p_on``, at the coarser scale
        (50 ms), where it falls below a sixth of that wave's."""
        fine, coarse = _smoothed(x, self._of(0.024)), _smoothed(x, self._of(0.1))
        grad = lambda y: np.pad((y[:, 2:] - y[:, :-2]) / 2, [(0, 0), (1, 1)])
        fast, slow = np.abs(grad(fine)), np.abs(grad(coarse))
        out = []
        for row, marks in enumerate(peaks):
            got = {k: np.full(len(marks), np.nan) for k in ("r_on", "r_off", "t_peak", "t_off", "p_on")}
            n = x.shape[1]
            for k, r in enumerate(marks.tolist()):
                before, after = self._quiet(fast[row], r, -1, 0.12, 1 / 12), self._quiet(fast[row], r, 1, 0.12, 1 / 12)
                if before is not None:
                    got["r_on"][k] = before
                if after is not None:
                    got["r_off"][k] = after
                nxt = marks[k + 1] if k + 1 < len(marks) else r + self._of(1.0)
                base = fine[row, before if before is not None else max(0, r - self._of(0.1))]
                lo = (after if after is not None else r) + self._of(0.05)
                hi = min(n - 1, r + min(self._of(0.55), int(0.65 * (nxt - r))))
                if hi - lo > self._of(0.06):
                    t = lo + int(np.abs(coarse[row, lo:hi] - base).argmax())
                    if lo < t < hi - 1:
                        got["t_peak"][k] = t
                        end = self._quiet(slow[row], t, 1, 0.25, 1 / 6)
                        if end is not None:
                            got["t_off"][k] = end
                hi, lo = (before if before is not None else r) - self._of(0.03), r - self._of(0.3)
                prev = marks[k - 1] if k else -n
                lo = max(0, lo, prev + self._of(0.35))
                if hi - lo > self._of(0.06):
                    p = lo + int(np.abs(coarse[row, lo:hi] - base).argmax())
                    if lo < p < hi - 1:
                        begin = self._quiet(slow[row], p, -1, 0.12, 1 / 6)
                        if begin is not None:
                            got["p_on"][k] = begin
            out.append(got)
        return out

    def _quiet(self, slope: np.ndarray, at: int, way: int, seconds: float, share: float) -> int | None:
        """The first sample, going from ``at`` beyond the steepest within the stretch, whose slope is below ``share`` of it."""
        reach = self._of(seconds)
        path = slope[at : at + reach] if way > 0 else slope[max(0, at - reach + 1) : at + 1][::-1]
        if len(path) < 3:
            return None
        # The steepest part of the wave itself lies within the first half of the stretch.
        steep = int(path[: max(2, len(path) // 2)].argmax())
        below = np.flatnonzero(path[steep:] < share * path[steep])
        return at + way * (steep + int(below[0])) if len(below) else None


MARKS = ("peaks", "r_on", "r_off", "t_peak", "t_off", "p_on")


def landmarks(df: DataFrame, signal: str, rate: float) -> DataFrame:
    """``df`` with ``peaks`` and, of each peak, ``r_on``, ``r_off``, ``t_peak``, ``t_off``, ``p_on`` in samples (arrays; null
    entries where a limit is not found). Values that are not finite count as 0; null and empty signals have null marks."""
    own = [c for c in df.columns if c not in MARKS]
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(m, T.ArrayType(T.DoubleType())) for m in MARKS])
    base = df.select(*own, F.col(signal).cast("array<double>").alias("_landmark_signal"))

    def run(batches):
        finder = Delineation(rate)
        for b in batches:
            marks: dict[str, list] = {m: [None] * len(b) for m in MARKS}
            for at, x in by_length(b.column("_landmark_signal")):
                x = np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)
                if x.shape[1] < 3:
                    x = np.pad(x, [(0, 0), (0, 3 - x.shape[1])], mode="edge")
                peaks = finder.peaks(x)
                for i, p, limits in zip(at.tolist(), peaks, finder.limits(x, peaks)):
                    for m, values in {"peaks": p.astype(float), **limits}.items():
                        marks[m][i] = values
            cols = []
            for m in MARKS:
                c = lists(marks[m])
                flat = pc.if_else(pc.is_nan(c.values), None, c.values)
                cols.append(pa.ListArray.from_arrays(c.offsets, flat, mask=pa.array([r is None for r in marks[m]])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), *cols], schema.names)

    return base.mapInArrow(run, schema)


def long_peaks(df: DataFrame, key: str, signal: str, rate: float, seconds: float = 60.0) -> DataFrame:
    """(key, peaks) of signals of any length: each is cut into pieces of ``seconds`` that look beyond both ends as far as
    peaks can depend on, the pieces are dealt to tasks, and each gives the peaks of its own stretch."""
    reach, core = Delineation(rate).reach, max(1, int(seconds * rate))
    v = F.col(signal).cast("array<double>")
    pieces = df.select(key, v.alias("_v"), F.explode(F.sequence(F.lit(0), F.greatest(F.floor((F.size(v) - 1) / core).cast("int"), F.lit(0)))).alias("_i")).where(F.size("_v") > 0)
    first = F.greatest(F.col("_i") * core - reach, F.lit(0))
    cut = pieces.select(key, "_i", first.alias("_first"), F.slice("_v", first + 1, (F.col("_i") + 1) * core + reach - first).alias("_x"))
    marks = landmarks(cut.repartition(key, "_i"), "_x", rate).select(key, "_i", F.explode(F.transform("peaks", lambda p: p + F.col("_first"))).alias("p"))
    own = marks.where((F.col("p") >= F.col("_i") * core) & (F.col("p") < (F.col("_i") + 1) * core))
    found = own.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("peaks"))
    return df.where(F.size(v) > 0).select(key).join(found, key, "left").select(key, F.coalesce("peaks", F.array().cast("array<double>")).alias("peaks"))


# Warps by landmarks


def warp_rows(x: np.ndarray, new: list, old: list) -> list:
    """Each row's signal with its samples at ``old`` moved to ``new``: anchors in order, both ends among them, those that do
    not move on by more than half a sample left out; fewer than four are too few, and give None."""
    out, n = [], x.shape[1]
    for row, a, b in zip(x, new, old):
        if a is None or b is None or len(a) != len(b):
            out.append(None)
            continue
        ends = [0.0, float(n - 1)]
        kept: list[tuple[float, float]] = []
        for p, q in sorted(zip([*a, *ends], [*b, *ends])):
            p, q = min(max(p, 0.0), n - 1.0), min(max(q, 0.0), n - 1.0)
            if not kept or p > kept[-1][0] + 0.5 and q > kept[-1][1] + 0.5:
                kept.append((p, q))
        if len(kept) < 4:
            out.append(None)
            continue
        p, q = np.array(kept).T
        out.append(np.interp(np.interp(np.arange(n, dtype=float), p, q), np.arange(n), row))
    return out


def warp_by_landmarks(df: DataFrame, signal: str, new: str, old: str, name: str = "warped") -> DataFrame:
    """``df`` with ``name``: each record's signal warped by its own anchors (arrays ``new`` and ``old``, samples from 0), of
    its own length; null where ``warp_rows`` has none, and for null signals or anchors."""
    own = [c for c in df.columns if c != name]
    schema = T.StructType([df.schema[c] for c in own] + [T.StructField(name, T.ArrayType(T.DoubleType()))])
    base = df.select(*own, *[F.col(c).cast("array<double>").alias(f"_w{i}") for i, c in enumerate((signal, new, old))])

    def run(batches):
        for b in batches:
            out: list = [None] * len(b)
            a, z = (b.column(f"_w{i}").to_pylist() for i in (1, 2))
            for at, x in by_length(b.column("_w0")):
                for i, y in zip(at.tolist(), warp_rows(x, [a[i] for i in at], [z[i] for i in at])):
                    out[i] = y
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), lists(out)], schema.names)

    return base.mapInArrow(run, schema)


def _sums(v):
    """Running sums of an array, from 0."""
    return F.aggregate(v, F.array(F.lit(0.0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))


def _median(v):
    s = F.array_sort(v)
    n = F.size(s)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, (F.floor(n / 2) + 1).cast("int"))) / 2


def rr_anchors(df: DataFrame, peaks: str, strength: float, direction: int) -> DataFrame:
    """``df`` with ``new`` and ``old``: peaks whose intervals turn irregular (``direction`` above 0) or draw near their
    median, the sum kept. Fewer than two peaks have null anchors."""
    r = F.col(peaks).cast("array<double>")
    n = F.size(r)
    gap = F.zip_with(F.slice(r, 2, F.greatest(n - 1, F.lit(0))), F.slice(r, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    if direction > 0:
        wave = F.transform(gap, lambda _, i: F.sin(i * F.lit(math.pi * (3 - math.sqrt(5)))))
        centred = F.transform(wave, lambda x: x - total(wave) / F.size(wave))
        sd = F.sqrt(total(F.transform(centred, lambda x: x * x)) / F.size(centred))
        target = F.zip_with(gap, centred, lambda g, c: g * F.greatest(F.lit(0.45), 1 + strength * c / F.greatest(sd, F.lit(1e-8))))
    else:
        target = F.transform(gap, lambda g: (1 - strength) * g + strength * _median(gap))
    scaled = F.transform(target, lambda t: t * total(gap) / F.greatest(total(target), F.lit(1e-8)))
    new = F.transform(_sums(scaled), lambda s: F.element_at(r, 1) + s)
    return df.withColumns({"new": F.when(n >= 2, new), "old": F.when(n >= 2, r)})


def qrs_anchors(df: DataFrame, peaks: str, onset: str, offset: str, strength: float, direction: int) -> DataFrame:
    """``df`` with ``new`` and ``old``: onset, peak and offset of each wave that has them in order, its limits moved away
    from the peak (or nearer) by a share of their distance."""
    f = 1.0 + direction * strength
    each = F.filter(F.arrays_zip(F.col(peaks).alias("r"), F.col(onset).alias("a"), F.col(offset).alias("b")), lambda w: (w["a"] < w["r"]) & (w["r"] < w["b"]))
    new = F.flatten(F.transform(each, lambda w: F.array(w["r"] - (w["r"] - w["a"]) * f, w["r"], w["r"] + (w["b"] - w["r"]) * f)))
    return df.withColumns({"new": new, "old": F.flatten(F.transform(each, lambda w: F.array(w["a"], w["r"], w["b"])))})


def qt_anchors(df: DataFrame, onset: str, end: str, strength: float, direction: int) -> DataFrame:
    """``df`` with ``new`` and ``old``: each wave's onset, and the end of its T wave moved by a share of their distance."""
    f = 1.0 + direction * strength
    each = F.filter(F.arrays_zip(F.col(onset).alias("a"), F.col(end).alias("b")), lambda w: w["a"] < w["b"])
    new = F.flatten(F.transform(each, lambda w: F.array(w["a"], w["a"] + (w["b"] - w["a"]) * f)))
    return df.withColumns({"new": new, "old": F.flatten(F.transform(each, lambda w: F.array(w["a"], w["b"])))})
