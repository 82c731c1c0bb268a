"""Fitting sparse codes over rows: a first-order optimiser whose gradients are summed up in Spark.

Parameters live on the driver and go to the tasks once a step; rows never leave the tasks. Rows are dealt to batches, and
within a batch to slots, by hash; sums are made by slot in the order of row ids and added up in the order of slots, so that
reruns and resumed runs agree to the bit.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import scratch_folder
from .audit import Rejected
from .probes import Dictionary
from .vectors import moments

#: Values of one bin that may come to the driver; a fuller bin is cut into 65536 finer ones first.
BIN = 1 << 20
#: Partial sums that one task adds up.
FAN = 8
#: A batch's choice of codes: pre-activations above ``above`` are kept, and of those equal to ``at`` the first, ``quota`` by slot.
Cut = tuple[float, dict[int, int]]


@dataclass
class Parameters:
    """Encoder and atoms (rows of matrices), offsets, standardisation, and for how many batches each atom has been silent."""

    encoder: np.ndarray
    encoder_offset: np.ndarray
    atoms: np.ndarray
    offset: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    silent: np.ndarray

    @classmethod
    def start(cls, atoms: int, dim: int, seed: int = 0) -> Parameters:
        e = np.random.default_rng(seed).uniform(-1, 1, (atoms, dim)) / np.sqrt(dim)
        return cls(e, np.zeros(atoms), unit(e), np.zeros(dim), np.zeros(dim), np.ones(dim), np.zeros(atoms))

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def pre(self, x: np.ndarray, centred: bool) -> np.ndarray:
        """Rectified products with the encoder, of standardised rows."""
        return np.maximum((x - self.offset if centred else x) @ self.encoder.T + self.encoder_offset, 0)


LEARNT = ("encoder", "encoder_offset", "atoms", "offset")


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-8)


def largest(pre: np.ndarray, k: int) -> np.ndarray:
    """Each row's ``k`` largest values, the first of equals; zeros elsewhere."""
    at = np.argsort(-pre, axis=1, kind="stable")[:, :k]
    out = np.zeros_like(pre)
    np.put_along_axis(out, at, np.take_along_axis(pre, at, 1), 1)
    return out


def cut_codes(pre: np.ndarray, at: float, quota: int) -> np.ndarray:
    """What a cut leaves of some rows' values: those above ``at``, and the first ``quota`` of those equal to it."""
    keep = pre > at
    ties = np.flatnonzero(pre.ravel() == at)[: quota if at > 0 else 0]
    keep.ravel()[ties] = True
    return np.where(keep, pre, 0.0)


def loss_and_gradient(p: Parameters, x: np.ndarray, z: np.ndarray, rows: int, centred: bool, dead: np.ndarray | None = None, spare: int = 512, penalty: float = 1 / 32) -> tuple[float, float, dict[str, np.ndarray]]:
    """(loss, auxiliary loss, gradients) of standardised rows with codes ``z``, as parts of means over ``rows`` rows.

    The auxiliary loss holds what the ``spare`` largest values of ``dead`` atoms rebuild against what the codes leave.
    Which codes are kept and what they leave count as given.
    """
    size = rows * x.shape[1]
    left = x - (z @ p.atoms + p.offset)
    g = -2 * left / size
    back = np.where(z > 0, g @ p.atoms.T, 0.0)
    grad = {"atoms": z.T @ g, "offset": g.sum(0)}
    auxiliary = 0.0
    if dead is not None and dead.any():
        zd = np.zeros_like(z)
        zd[:, dead] = largest(p.pre(x, centred)[:, dead], min(spare, int(dead.sum())))
        miss = zd @ p.atoms - left
        auxiliary = penalty * float((miss**2).sum()) / size
        ga = 2 * penalty * miss / size
        grad["atoms"] = grad["atoms"] + zd.T @ ga
        back = back + np.where(zd > 0, ga @ p.atoms.T, 0.0)
    grad["encoder"] = back.T @ (x - p.offset if centred else x)
    grad["encoder_offset"] = back.sum(0)
    if centred:
        grad["offset"] = grad["offset"] - grad["encoder_offset"] @ p.encoder
    return float((left**2).sum()) / size, auxiliary, grad


@dataclass
class Adam:
    rate: float
    betas: tuple[float, float] = (0.9, 0.99)
    clip: float = 1e5
    step: int = 0
    first: dict = field(default_factory=dict)
    second: dict = field(default_factory=dict)

    def update(self, p: Parameters, grad: dict[str, np.ndarray]) -> None:
        """One step. Atoms keep unit length: their gradient's part along them is taken off before."""
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        grad = {k: g * min(1.0, self.clip / (norm + 1e-6)) for k, g in grad.items()}
        p.atoms = unit(p.atoms)
        grad["atoms"] = grad["atoms"] - (grad["atoms"] * p.atoms).sum(1, keepdims=True) * p.atoms
        self.step += 1
        a, b = self.betas
        for k in LEARNT:
            self.first[k] = a * self.first.get(k, 0.0) + (1 - a) * grad[k]
            self.second[k] = b * self.second.get(k, 0.0) + (1 - b) * grad[k] ** 2
            setattr(p, k, getattr(p, k) - self.rate * (self.first[k] / (1 - a**self.step)) / (np.sqrt(self.second[k] / (1 - b**self.step)) + 1e-8))
        p.atoms = unit(p.atoms)


class Rows:
    """Rows dealt to batches and slots, written to a folder that driver and executors share, one folder a batch."""

    def __init__(self, df: DataFrame, key: str, vector: str, batch: int, slots: int, seed: int):
        v = F.col(vector).cast("array<double>")
        rows = df.select(F.col(key).alias("id"), v.alias("v")).where(v.isNotNull() & F.col(key).isNotNull())
        self.n = rows.count()
        if not self.n:
            raise Rejected("no rows to fit")
        self.batches, self.slots, self.spark = max(1, self.n // batch), slots, df.sparkSession
        self.schema = f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, slot int"
        h = lambda salt, m: F.pmod(F.xxhash64(F.lit(f"{seed}:{salt}"), "id"), F.lit(m)).cast("int")
        self.path = scratch_folder(self.spark)
        dealt = rows.withColumn("batch", h("batch", self.batches)).withColumn("slot", h("slot", slots))
        dealt.repartition(max(slots, self.batches), "batch", "slot").write.partitionBy("batch").parquet(self.path)
        # Hashing leaves a batch empty only where rows are few; its turn is skipped then.
        self.sizes = {r["batch"]: r["n"] for r in self.spark.read.parquet(self.path).groupBy("batch").agg(F.count("*").alias("n")).collect()}
        self.order = sorted(self.sizes)

    def batch(self, step: int) -> tuple[DataFrame, int]:
        b = self.order[step % len(self.order)]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={b}"), self.sizes[b]


def _matrix(table: pa.Table) -> np.ndarray:
    """A slot's vectors in the order of ids."""
    table = table.sort_by("id")
    v = table["v"].combine_chunks()
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _by_slot(rows: DataFrame, f, schema: str) -> DataFrame:
    return rows.groupBy("slot").applyInArrow(f, schema)


def batch_cut(rows: DataFrame, n: int, k: int, values) -> Cut:
    """The exact cut that leaves the ``n * k`` largest positive values of a whole batch: (threshold, of values equal to it
    how many each slot keeps). ``values(matrix)`` gives the values of a slot's rows.

    No task or driver holds the batch's values: slots count values by the first 16 bits of their pattern, which for
    positive numbers order as the numbers do, then by the next 16 within the one bin in which the threshold lies, until
    that holds ``BIN`` values or fewer, which are looked at. Of equal values the first are kept, by slot, row id and atom.
    """
    want, prefix, shift = n * k, np.uint64(0), 48

    def bits(table: pa.Table) -> np.ndarray:
        v = values(_matrix(table))
        return v[v > 0].view(np.uint64)

    while True:
        def count(table: pa.Table) -> pa.Table:
            b = bits(table)
            if shift < 48:
                b = b[b >> np.uint64(shift + 16) == prefix]
            bins, c = np.unique((b >> np.uint64(shift)).astype(np.int64), return_counts=True)
            return pa.table({"bin": bins, "n": c})

        seen = _by_slot(rows, count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy(F.col("bin").desc()).collect()
        if shift == 48 and sum(r["n"] for r in seen) <= want:
            return 0.0, {}
        for r in seen:
            if r["n"] >= want:
                prefix, inside = np.uint64(r["bin"]), r["n"]
                break
            want -= r["n"]
        if inside <= BIN or shift == 0:
            break
        shift -= 16

    def within(table: pa.Table) -> pa.Table:
        b = bits(table)
        value, c = np.unique(b[b >> np.uint64(shift) == prefix], return_counts=True)
        return pa.table({"slot": pa.array([table["slot"][0].as_py()] * len(value), pa.int32()), "value": value.view(np.int64), "n": c})

    left = _by_slot(rows, within, "slot int, value long, n long").orderBy(F.col("value").desc(), "slot").collect()
    quota: dict[int, int] = {}
    at = None
    for r in left:
        if at is not None and r["value"] != at:
            if want <= 0:
                break
            quota = {}
        at = r["value"]
        quota[r["slot"]] = max(0, min(r["n"], want))
        want -= r["n"]
    return float(np.array([at], np.int64).view(np.float64)[0]), quota


def batch_codes(df: DataFrame, key: str, vector: str, p: Parameters, k: int, slots: int = 16) -> DataFrame:
    """(key, codes): the codes of all rows of ``df`` as one batch, which keeps its ``n * k`` largest. Rows without a key or a
    vector have none; of equal values at the cut the first are kept, by slot (a hash of the key), key and atom."""
    dealt = Rows(df, key, vector, df.count() or 1, slots, 0)
    rows, n = dealt.batch(0)
    at, quota = batch_cut(rows, n, k, lambda x: p.pre(p.standardised(x), True))

    def run(table: pa.Table) -> pa.Table:
        z = cut_codes(p.pre(p.standardised(_matrix(table)), True), at, quota.get(table["slot"][0].as_py(), 0))
        return pa.table({key: table.sort_by("id")["id"], "codes": pa.array(list(z), pa.list_(pa.float64()))})

    return _by_slot(rows, run, f"{key} {df.schema[key].dataType.simpleString()}, codes array<double>")


class SparseFit:
    """An autoencoder of ``atoms`` unit directions, of which a row keeps ``k`` codes: its own largest, or with ``whole_batch``
    the batch's n * k largest. Whole batches come with the auxiliary loss of atoms that were silent for ``patience``
    batches; otherwise such atoms are drawn anew from what the codes leave of rows, likelier where more is left."""

    def __init__(self, atoms: int, k: int, whole_batch: bool = True, patience: int = 5, spare: int = 512, penalty: float = 1 / 32, rate: float = 1e-3, batch: int = 4096, slots: int = 16, seed: int = 0):
        if not 0 < k < atoms:
            raise ValueError("k must be above 0 and below the number of atoms")
        self.atoms, self.k, self.whole_batch, self.patience, self.spare, self.penalty = atoms, k, whole_batch, patience, spare, penalty
        self.rate, self.batch, self.slots, self.seed = rate, batch, slots, seed
        self.parameters: Parameters | None = None
        self.adam = Adam(rate)
        self.losses: list[float] = []

    @property
    def config(self) -> str:
        return json.dumps({k: getattr(self, k) for k in ("atoms", "k", "whole_batch", "patience", "spare", "penalty", "rate", "batch", "slots", "seed")}, sort_keys=True)

    def dictionary(self) -> Dictionary:
        """The fitted atoms and per-row codes, on standardised vectors."""
        return Dictionary(self.parameters.atoms, self.k, self.parameters.offset)

    def fit(self, df: DataFrame, key: str, vector: str, steps: int, state: str | None = None, every: int = 0) -> SparseFit:
        """``steps`` steps over the rows of ``df`` with a key and a vector. With ``state``, a folder, parameters are kept there
        every ``every`` steps and at the end, and a run that finds some goes on from the last; a state of other settings
        is refused. A step reads its batch only: one pass sums up gradients; whole batches take a few more to find the
        cut. Partial sums of the parameters' size are added up by ``FAN`` in tasks, and the driver gets the last ones."""
        rows = Rows(df, key, vector, self.batch, self.slots, self.seed)
        if not (state and self._load(rows.spark, state)):
            m = moments(df.where(F.col(key).isNotNull()), vector)
            self.parameters = self.parameters or Parameters.start(self.atoms, len(m.mean), self.seed)
            self.parameters.mean, self.parameters.scale = m.mean, np.maximum(np.sqrt(np.maximum(np.diag(m.covariance), 0)), 1e-6)
        while self.adam.step < steps:
            some, n = rows.batch(self.adam.step)
            self._step(rows.spark, some, n)
            done = self.adam.step
            if state and (done == steps or every and done % every == 0):
                self._save(rows.spark, state)
        return self

    def gradient(self, spark, rows: DataFrame, n: int) -> tuple[float, float, dict[str, np.ndarray], np.ndarray]:
        """(loss, auxiliary loss, gradients, how often each atom fired) of one batch of ``n`` rows (id, v, slot)."""
        sent = spark.sparkContext.broadcast(self.parameters)
        k, whole, spare, penalty = self.k, self.whole_batch, self.spare, self.penalty
        dead = None

        def values(x: np.ndarray) -> np.ndarray:
            return sent.value.pre(sent.value.standardised(x), whole)

        at, quota = batch_cut(rows, n, k, values) if whole else (0.0, {})

        def codes(x: np.ndarray, slot: int) -> np.ndarray:
            pre = sent.value.pre(x, whole)
            return cut_codes(pre, at, quota.get(slot, 0)) if whole else largest(pre, k)

        # An atom that stays silent in this batch, too, may be dead with it.
        if whole and (self.parameters.silent + 1 >= self.patience).any():
            dead = self._silent(self._fired(rows, codes, sent)) >= self.patience

        def run(table: pa.Table) -> pa.Table:
            p, slot = sent.value, table["slot"][0].as_py()
            x = p.standardised(_matrix(table))
            z = codes(x, slot)
            loss, auxiliary, g = loss_and_gradient(p, x, z, n, whole, dead, spare, penalty)
            flat = np.concatenate([[loss, auxiliary], *(g[name].ravel() for name in LEARNT), (z > 0).sum(0)])
            return pa.table({"slot": pa.array([slot], pa.int32()), "sums": pa.array([flat.tobytes()], pa.binary())})

        def add(table: pa.Table) -> pa.Table:
            parts = sorted(zip(table["slot"].to_pylist(), table["sums"].to_pylist()))
            total = sum(np.frombuffer(b) for _, b in parts)
            return pa.table({"slot": pa.array([parts[0][0]], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        parts = _by_slot(rows, run, "slot int, sums binary").groupBy(F.floor(F.col("slot") / FAN)).applyInArrow(add, "slot int, sums binary").collect()
        sent.destroy()
        flat = sum(np.frombuffer(bytes(r["sums"])) for r in sorted(parts, key=lambda r: r["slot"]))
        grad, here = {}, 2
        for name in LEARNT:
            shape = getattr(self.parameters, name).shape
            grad[name] = flat[here : here + int(np.prod(shape))].reshape(shape)
            here += int(np.prod(shape))
        return float(flat[0]), float(flat[1]), grad, flat[here:]

    def _fired(self, rows: DataFrame, codes, sent) -> np.ndarray:
        """Which atoms fire in a batch: bits of each slot, or-ed."""

        def run(table: pa.Table) -> pa.Table:
            z = codes(sent.value.standardised(_matrix(table)), table["slot"][0].as_py())
            return pa.table({"atom": np.flatnonzero((z > 0).any(0))})

        out = np.zeros(self.atoms, bool)
        out[[r["atom"] for r in _by_slot(rows, run, "atom long").distinct().collect()]] = True
        return out

    def _silent(self, fired: np.ndarray) -> np.ndarray:
        return np.where(fired, 0, self.parameters.silent + 1)

    def _step(self, spark, rows: DataFrame, n: int) -> None:
        loss, auxiliary, grad, fired = self.gradient(spark, rows, n)
        p = self.parameters
        p.silent = self._silent(fired > 0)
        self.adam.update(p, grad)
        self.losses.append(loss + auxiliary)
        if not self.whole_batch and (p.silent >= self.patience).any():
            self._redraw(spark, rows, np.flatnonzero(p.silent >= self.patience))

    def _redraw(self, spark, rows: DataFrame, dead: np.ndarray) -> None:
        """Dead atoms turn to what the codes leave of some rows of the batch, one row each while there are enough: those
        whose hash, an exponential number by row and step, is least for the size of what is left. As many rows come to the
        driver as atoms are dead."""
        sent, k, step = spark.sparkContext.broadcast(self.parameters), self.k, self.adam.step

        def run(table: pa.Table) -> pa.Table:
            p, table = sent.value, table.sort_by("id")
            x = p.standardised(_matrix(table))
            left = x - (largest(p.pre(x, False), k) @ p.atoms + p.offset)
            return pa.table({"id": table["id"], "left": pa.array(list(left), pa.list_(pa.float64())), "size": np.linalg.norm(left, axis=1)})

        kind = rows.schema["id"].dataType.simpleString()
        u = (F.pmod(F.xxhash64(F.lit(f"{self.seed}:redraw:{step}"), "id"), F.lit(2**52)) + 0.5) / float(2**52)
        drawn = _by_slot(rows, run, f"id {kind}, left array<double>, size double").where("size > 0").orderBy(-F.log(u) / F.col("size"), "id").limit(len(dead)).collect()
        sent.destroy()
        if drawn:
            p, turn = self.parameters, np.arange(len(dead)) % len(drawn)
            to = unit(np.array([r["left"] for r in drawn]))[turn]
            p.atoms[dead], p.encoder[dead], p.encoder_offset[dead], p.silent[dead] = to, 0.2 * to, 0.0, 0

    # State

    def _arrays(self) -> dict[str, np.ndarray]:
        own = {f"p.{k}": getattr(self.parameters, k) for k in Parameters.__dataclass_fields__}
        own |= {f"{m}.{k}": getattr(self.adam, m)[k] for m in ("first", "second") for k in self.adam.first}
        return own | {"losses": np.array(self.losses)}

    def _save(self, spark, state: str) -> None:
        rows = [(self.adam.step, self.config, k, list(a.shape), a.astype(np.float64).tobytes()) for k, a in self._arrays().items()]
        spark.createDataFrame(rows, "step int, config string, name string, shape array<int>, data binary").repartition(len(rows)).write.mode("append").parquet(state)

    def _load(self, spark, state: str) -> bool:
        from pyspark.errors import AnalysisException

        try:
            kept = spark.read.parquet(state)
        except AnalysisException:
            return False
        if not (last := kept.agg(F.max("step")).first()[0]):
            return False
        rows = kept.where(F.col("step") == last).collect()
        if rows[0]["config"] != self.config:
            raise Rejected("the state has other settings")
        a = {r["name"]: np.frombuffer(bytes(r["data"])).reshape(r["shape"]).copy() for r in rows}
        self.parameters = Parameters(**{k: a[f"p.{k}"] for k in Parameters.__dataclass_fields__})
        self.adam.step, self.losses = last, a["losses"].tolist()
        self.adam.first, self.adam.second = ({k: a[f"{m}.{k}"] for k in LEARNT} for m in ("first", "second"))
        return True
