"""Peaks and limits on made leads whose marks are known, protocols and warps against numpy."""

import numpy as np
import pytest

from veriscope.operators import signals as sg

RATE = 250.0
CANONICAL = 2500


def lead(seconds=40, noise=0.02, drift=0.3, seed=0, rate=RATE):
    """(signal, R peaks): waves P, Q, R, S, T at uneven intervals, white noise and a slow drift."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * rate)) / rate
    beats, at = [], 0.6
    while at < seconds - 0.8:
        beats.append(at)
        at += rng.uniform(0.65, 1.15)
    x = drift * np.sin(2 * np.pi * 0.25 * t + seed) + noise * rng.normal(size=len(t))
    for b in beats:
        size = rng.uniform(0.8, 1.3)
        for shift, height, width in ((-0.16, 0.12, 0.02), (-0.03, -0.12, 0.008), (0, 1.0, 0.01), (0.03, -0.2, 0.009), (0.25, 0.25, 0.04)):
            x += size * height * np.exp(-((t - b - shift) ** 2) / (2 * width**2))
    return x, np.round(np.array(beats) * rate).astype(int)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [float(v) for v in x]) for i, x in enumerate(rows)], "id int, x array<double>").repartition(3)


def test_peaks_within_two_samples(spark):
    made = [lead(seed=s, seconds=20 + s) for s in range(12)]
    got = {r["id"]: r for r in sg.landmarks(frame(spark, [x for x, _ in made]), "x", RATE).collect()}
    hit = total = extra = 0
    qrs, qt, pr = [], [], []
    for i, (_, want) in enumerate(made):
        found = np.array(got[i]["peaks"])
        gap = np.abs(found[None] - want[:, None]).min(1)
        hit, total, extra = hit + (gap <= 2).sum(), total + len(want), extra + (np.abs(found[:, None] - want[None]).min(1) > 2).sum()
        for a, b, e, p, r in zip(*(got[i][k] for k in ("r_on", "r_off", "t_off", "p_on", "peaks"))):
            qrs += [(b - a) / RATE] if a is not None and b is not None else []
            qt += [(e - a) / RATE] if a is not None and e is not None else []
            pr += [(r - p) / RATE] if p is not None else []
    assert hit >= 0.99 * total and extra <= 0.01 * total
    assert len(qrs) > 0.9 * total and 0.06 < np.median(qrs) < 0.14
    assert len(qt) > 0.8 * total and 0.3 < np.median(qt) < 0.5 and np.std(qt) < 0.08
    assert len(pr) > 0.8 * total and 0.17 < np.median(pr) < 0.28


def test_inverted_flat_and_missing(spark):
    x, want = lead(seconds=15, drift=0)
    y = x.copy()
    y[100] = np.nan
    got = {r["id"]: r["peaks"] for r in sg.landmarks(frame(spark, [-x, np.zeros(500), None, [], [1.0], y]), "x", RATE).collect()}
    assert np.abs(np.array(got[0])[None] - want[:, None]).min(1).max() <= 10
    assert got[1] == [] and got[2] is None and got[3] is None and got[4] == [] and len(got[5]) == pytest.approx(len(want), abs=1)


def test_long_signals_in_pieces(spark):
    x, want = lead(seconds=130, seed=3)
    df = frame(spark, [x, x[:2000], None, np.zeros(100)])
    whole = {r["id"]: r["peaks"] for r in sg.landmarks(df, "x", RATE).collect()}
    cut = {r["id"]: r["peaks"] for r in sg.long_peaks(df, "id", "x", RATE, seconds=11.0).collect()}
    assert cut[0] == whole[0] and cut[1] == whole[1] and cut[3] == [] and 2 not in cut


def plain_input(x, protocol, leads, samples, crop):
    def z(a):
        a = np.nan_to_num(a, nan=0, posinf=0, neginf=0)
        return np.array([(r - r.mean()) / max(r.std(), 1e-6) for r in a])

    def to(a, n):
        f = [np.fft.fft(r) for r in a]
        out = []
        for r in f:
            m, size = min(n, len(r)), len(r)
            g = np.zeros(n, complex)
            half = m // 2 + 1
            g[:half] = r[:half]
            g[n - (m - half) :] = r[size - (m - half) :]
            if m % 2 == 0 and n != size:
                if n < size:
                    g[m // 2] += r[size - m // 2]
                else:
                    g[m // 2] /= 2
                    g[n - m // 2] = g[m // 2]
            out.append(np.fft.ifft(g).real * n / size)
        return np.array(out)

    own = x[[0, 1, 6, 7, 8, 9, 10, 11]]
    if leads == 8:
        y = own
    elif protocol in ("lead", "joint"):
        y = np.array([x[0], x[1], x[1] - x[0], -(x[0] + x[1]) / 2, x[0] - x[1] / 2, x[1] - x[0] / 2, *x[6:]])
    else:
        y = x
    y = z(y)
    if protocol in ("temporal", "joint"):
        y = to(y, CANONICAL)
    if crop and protocol in ("native", "lead"):
        y = to(y, CANONICAL)
        first = (CANONICAL - samples) // 2
        return y[:, first : first + samples]
    return y if y.shape[1] == samples else to(y, samples)


def test_protocols(spark):
    rng = np.random.default_rng(5)
    records = [rng.normal(size=(12, n)) for n in (500, 500, 501)]
    records[1][3, 7] = np.nan
    rows = [(i, [[float(v) for v in r] for r in x]) for i, x in enumerate(records)]
    rows += [(3, None), (4, rows[0][1][:5]), (5, [[1.0]] * 11 + [[1.0, 2.0]])]
    table = [("a", 12, 5000, False, False), ("b", 12, 2500, False, True), ("c", 8, 2500, False, False), ("d", 12, 2250, True, False), ("e", 8, 250, False, True), ("f", 12, 333, False, False)]
    faces = spark.createDataFrame(table, "interface string, leads int, samples int, crop boolean, flatten boolean")
    got = sg.model_inputs(spark.createDataFrame(rows, "id int, leads12 array<array<double>>").repartition(2), "leads12", faces).collect()
    assert len(got) == 6 * 6 * 4
    spec = {r[0]: r[1:] for r in table}
    for r in got:
        leads, samples, crop, flat = spec[r["interface"]]
        if r["id"] > 2:
            assert r["input"] is None
            continue
        want = plain_input(records[r["id"]], r["protocol"], leads, samples, crop)
        assert np.allclose(np.array(r["input"]), want.reshape(1, -1) if flat else want, atol=1e-9), (r["interface"], r["protocol"])
    with pytest.raises(ValueError):
        sg.protocol_input(records[0][None], "other", 12, 10)


def test_warps(spark):
    x, r = lead(seconds=12, noise=0)
    n = len(x)
    on, off, end = r - 10.0, r + 11.0, r + 90.0
    rows = [(0, x, r, on, off, end), (1, x, r[:1], on[:1], off[:1], end[:1]), (2, None, r, on, off, end), (3, x, None, None, None, None)]
    f = lambda a: None if a is None else [float(v) for v in a]
    df = spark.createDataFrame([(i, *map(f, rest)) for i, *rest in rows], "id int, x array<double>, r array<double>, a array<double>, b array<double>, e array<double>")

    def peaks_of(y):
        return sg.Delineation(RATE).peaks(np.array([y]))[0]

    even = {q["id"]: q for q in sg.warp_by_landmarks(sg.rr_anchors(df, "r", 1.0, -1), "x", "new", "old").collect()}
    assert len(even[0]["warped"]) == n and even[1]["warped"] is None and even[2]["warped"] is None and even[3]["warped"] is None
    gaps = np.diff(peaks_of(even[0]["warped"]))
    assert abs(gaps - np.median(np.diff(r)) * np.diff(r).sum() / (np.median(np.diff(r)) * (len(r) - 1))).max() <= 2
    uneven = sg.rr_anchors(df, "r", 0.2, 1).where("id = 0").first()
    p = np.sin(np.arange(len(r) - 1) * 2.399963229728653)
    p = (p - p.mean()) / p.std()
    t = np.diff(r) * np.maximum(0.45, 1 + 0.2 * p)
    assert np.allclose(uneven["new"], np.concatenate([[r[0]], r[0] + np.cumsum(t * np.diff(r).sum() / t.sum())]))
    wide = sg.qrs_anchors(df, "r", "a", "b", 0.5, 1)
    q = wide.where("id = 0").first()
    assert np.allclose(np.array(q["new"]).reshape(-1, 3), np.stack([r - 15, r, r + 16.5], 1)) and np.allclose(np.array(q["old"]).reshape(-1, 3), np.stack([on, r, off], 1))
    got = np.array(sg.warp_by_landmarks(wide, "x", "new", "old").where("id = 0").first()["warped"])
    assert np.allclose(got[r], x[r]) and np.allclose(got[(r + 16.5).astype(int)], x[(r + 11 - 0.5 / 1.5).astype(int)], atol=0.1)
    long = sg.qt_anchors(df, "a", "e", 0.2, 1).where("id = 0").first()
    assert np.allclose(np.array(long["new"]).reshape(-1, 2), np.stack([on, on + 120], 1))
