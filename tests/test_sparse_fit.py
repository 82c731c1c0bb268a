"""Fitting sparse codes against plain numpy: gradients, the cut over a batch, planted atoms, resumed runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope.operators import sparse
from veriscope.operators.audit import Rejected


def frame(spark, x, parts=3):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(parts)


def slotted(spark, x, slots=4):
    return frame(spark, x).withColumn("slot", (F.col("id") % slots).cast("int"))


def planted(n=1000, dim=8, k=2, seed=0):
    """Orthonormal atoms, and rows that mix ``k`` of them."""
    rng = np.random.default_rng(seed)
    d = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    x = np.array([rng.uniform(1, 3, k) @ d[rng.choice(dim, k, replace=False)] for _ in range(n)])
    return d, x + rng.normal(size=x.shape) * 0.01


def numeric(f, a, h=1e-6):
    out = np.zeros_like(a)
    for i in np.ndindex(*a.shape):
        old = a[i]
        a[i] = old + h
        up = f()
        a[i] = old - h
        out[i] = (up - f()) / (2 * h)
        a[i] = old
    return out


@pytest.mark.parametrize("centred", [True, False])
def test_gradients(centred):
    rng = np.random.default_rng(4)
    p = sparse.Parameters.start(9, 5, 1)
    p.offset, p.encoder_offset = rng.normal(size=5), rng.normal(size=9) * 0.1
    x = rng.normal(size=(7, 5))
    dead = np.zeros(9, bool)
    dead[[1, 4, 5]] = True
    z = sparse.largest(p.pre(x, centred), 3)
    kept, left = z > 0, x - (z @ p.atoms + p.offset)
    spare = np.zeros_like(z)
    spare[:, dead] = sparse.largest(p.pre(x, centred)[:, dead], 2)
    chosen = spare > 0

    def loss():
        pre = p.pre(x, centred)
        main = ((np.where(kept, pre, 0) @ p.atoms + p.offset - x) ** 2).mean()
        return main + ((np.where(chosen, pre, 0) @ p.atoms - left) ** 2).mean() / 32

    a, b, grad = sparse.loss_and_gradient(p, x, z, 7, centred, dead, 2)
    assert np.isclose(a + b, loss())
    for name in sparse.LEARNT:
        assert np.allclose(grad[name], numeric(loss, getattr(p, name)), atol=1e-7), name


@pytest.mark.parametrize("limit", [1 << 20, 3, 1])
def test_cut_equals_a_sort(spark, monkeypatch, limit):
    monkeypatch.setattr(sparse, "BIN", limit)
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(60, 6)), 1)
    x[20:40] = x[:20]
    rows = slotted(spark, x)
    for k in (1, 2, 5):
        at, quota = sparse.batch_cut(rows, 60, k, lambda v: np.maximum(v, 0))
        kept = np.zeros(0)
        got = np.zeros_like(x)
        for slot in range(4):
            own = np.arange(60)[np.arange(60) % 4 == slot]
            got[own] = sparse.cut_codes(np.maximum(x[own], 0), at, quota.get(slot, 0))
        kept = np.sort(got[got > 0])[::-1]
        want = np.sort(x[x > 0])[::-1][: 60 * k]
        assert np.array_equal(kept, want)
    # Ties go to the first slots.
    same = slotted(spark, np.ones((8, 2)))
    assert sparse.batch_cut(same, 8, 1, lambda v: v) == (1.0, {0: 4, 1: 4, 2: 0, 3: 0})
    assert sparse.batch_cut(slotted(spark, -np.ones((8, 2))), 8, 1, lambda v: np.maximum(v, 0)) == (0.0, {})


@pytest.mark.parametrize("whole", [True, False])
def test_batch_gradient_equals_numpy(spark, whole):
    _, x = planted(200)
    rows = slotted(spark, x)
    fit = sparse.SparseFit(16, 2, whole_batch=whole, patience=2)
    fit.parameters = sparse.Parameters.start(16, 8, 3)
    fit.parameters.silent[:] = 1
    pre = fit.parameters.pre(x, whole)
    if whole:
        z = np.where(pre >= np.sort(pre.ravel())[::-1][2 * 200 - 1], pre, 0)
    else:
        z = sparse.largest(pre, 2)
    dead = ~(z > 0).any(0)
    a, b, want = sparse.loss_and_gradient(fit.parameters, x, z, 200, whole, dead if whole else None)
    loss, auxiliary, grad, fired = fit.gradient(spark, rows, 200)
    assert np.isclose(loss, a) and np.isclose(auxiliary, b) and np.array_equal(fired, (z > 0).sum(0))
    assert all(np.allclose(grad[k], want[k], atol=1e-12) for k in sparse.LEARNT)


def test_planted_atoms_are_found(spark):
    d, x = planted()
    fit = sparse.SparseFit(24, 2, rate=0.05, batch=500, slots=2, seed=1).fit(frame(spark, x), "id", "v", 40)
    p = fit.parameters
    found = sparse.unit(p.atoms * p.scale)  # back from standardised to raw
    assert fit.losses[-1] < 0.1 * fit.losses[0] and (found @ d.T).max(0).min() > 0.95


def test_resumed_runs_agree(spark, tmp_path):
    _, x = planted(400)
    df, make = frame(spark, x), lambda: sparse.SparseFit(16, 2, whole_batch=False, patience=1, rate=0.01, batch=100, slots=3)
    whole = make().fit(df, "id", "v", 6)
    make().fit(df, "id", "v", 3, str(tmp_path / "s"))
    later = make().fit(df.repartition(5), "id", "v", 6, str(tmp_path / "s"), every=2)
    assert later.losses == whole.losses and len(later.losses) == 6
    assert all(np.array_equal(getattr(later.parameters, k), getattr(whole.parameters, k)) for k in ("encoder", "encoder_offset", "atoms", "offset", "silent"))
    with pytest.raises(Rejected):
        sparse.SparseFit(16, 3, whole_batch=False).fit(df, "id", "v", 1, str(tmp_path / "s"))
    assert np.allclose(np.linalg.norm(whole.parameters.atoms, axis=1), 1)


def test_dead_atoms_are_drawn_anew(spark):
    _, x = planted(100)
    fit = sparse.SparseFit(16, 1, whole_batch=False, patience=1, batch=100, slots=2)
    fit.parameters = sparse.Parameters.start(16, 8)
    fit.parameters.encoder_offset[3:] = -100.0
    fit._step(spark, slotted(spark, x), 100)
    p = fit.parameters
    assert (p.silent == 0).all() and np.allclose(p.encoder_offset[5:], 0) and np.allclose(np.linalg.norm(p.encoder[5:], axis=1), 0.2)


def test_nothing_to_fit(spark):
    with pytest.raises(Rejected):
        sparse.SparseFit(4, 1).fit(spark.createDataFrame([(1, None)], "id long, v array<double>"), "id", "v", 1)
    with pytest.raises(ValueError):
        sparse.SparseFit(4, 4)
