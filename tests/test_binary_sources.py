"""Readers of binary files against files that numpy or the test itself wrote."""

import struct
import zlib

import numpy as np
import pytest

from veriscope.sources import binary


def rows_of(df):
    return {(r["file"].rsplit("/", 1)[1], r["row"]): r["values"] for r in df.collect()}


@pytest.mark.parametrize("dtype", ["<f4", ">f8", "<i2", "|u1"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_matrices(spark, tmp_path, dtype, order):
    rng = np.random.default_rng(1)
    full = {}
    for name, shape in (("a", (23, 7)), ("b", (5, 7)), ("c", (0, 7))):
        x = np.array(rng.integers(0, 200, shape), dtype=dtype, order=order)
        np.save(tmp_path / f"{name}.npy", x)
        full |= {(f"{name}.npy", i): [float(v) for v in r] for i, r in enumerate(x)}
    (tmp_path / "other.txt").write_text("no matrix")
    size = np.dtype(dtype).itemsize
    df = binary.read_matrices(spark, str(tmp_path), range_bytes=4 * 7 * size)
    assert rows_of(df) == full and df.rdd.getNumPartitions() == 6 + 2
    assert rows_of(binary.read_matrices(spark, str(tmp_path), "2:5")) == {k: v[2:5] for k, v in full.items()}
    assert rows_of(binary.read_matrices(spark, str(tmp_path / "a.npy"), "5:")) == {k: v[5:] for k, v in full.items() if k[0] == "a.npy"}


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives(spark, tmp_path, save):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(31, 3)), np.asfortranarray(rng.normal(size=(6, 4)))
    save(tmp_path / "z.npz", first=x, second=y, third=np.arange(5))
    for name, want in (("first", x), ("second", y), ("third", np.arange(5)[:, None]), (None, x)):
        got = binary.read_matrices(spark, str(tmp_path), array=name, range_bytes=100)
        assert [r["values"] for r in got.orderBy("row").collect()] == want.tolist()
    assert binary.read_matrices(spark, str(tmp_path), array="first", range_bytes=100).rdd.getNumPartitions() == (8 if save is np.savez else 1)


def test_not_matrices(spark, tmp_path):
    np.save(tmp_path / "cube.npy", np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="two dimensions"):
        binary.read_matrices(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="nothing"):
        binary.read_matrices(spark, str(tmp_path / "nothing.npy")).collect()


def test_twelve_bits():
    x = np.array([0, 1, -1, 2047, -2048, 5, -700])
    assert binary.unpack_12(binary.pack_12(x), 7).tolist() == x.tolist()
    # Two samples as the published layout has them: low bytes, and a byte of both high halves.
    assert binary.unpack_12(bytes([0x34, 0xA2, 0x56]), 2).tolist() == [0x234, 0xA56 - 0x1000]


def level_5(name, x, squeeze, order="<"):
    """A level 5 file of one int16 matrix, compressed or not."""

    def element(kind, body):
        if len(body) <= 4 and body and kind != 14:
            return struct.pack(order + "I", len(body) << 16 | kind) + body.ljust(4, b"\0")
        return struct.pack(order + "II", kind, len(body)) + body + b"\0" * (-len(body) % 8)

    body = element(6, struct.pack(order + "II", 10, 0)) + element(5, struct.pack(order + "2i", *x.shape)) + element(1, name.encode()) + element(3, x.astype(order + "i2").tobytes("F"))
    whole = element(14, body)
    if squeeze:
        packed = zlib.compress(whole)
        whole = struct.pack(order + "II", 15, len(packed)) + packed
    return b"text".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI") + whole


def header_of(name, x, file, kind, gains):
    n, leads = x.shape
    lines = [f"{name} {leads} 500 {n}"] + [f"{file} {kind} {g} 16 0 0 0 0 L{k}" for k, g in zip(range(leads), gains)]
    return "\n".join(lines) + "\n# a remark\n"


def test_records(spark, tmp_path):
    rng = np.random.default_rng(3)
    gains = ["1000(-10)/mV", "200/mV", "50.5(3)/uV"]
    x = rng.integers(-2000, 2000, (101, 3))
    want = (x - [-10, 0, 3]) / [1000, 200, 50.5]
    mat4 = struct.pack("<5i", 30, 3, 101, 0, 4) + b"val\0" + x.astype("<i2").tobytes()
    files = {
        "a": ("a.dat", "16", x.astype("<i2").tobytes()), "b": ("b.dat", "212", binary.pack_12(x.ravel())), "c": ("c.mat", "16+24", mat4), "d": ("d.mat", "16", mat4),
        "e": ("e.mat", "16", level_5("val", x.T, True)), "f": ("f.mat", "16", level_5("val", x.T, False, ">")),
        "big": ("big.mat", "16", struct.pack(">5i", 1030, 3, 101, 0, 4) + b"val\0" + x.astype(">i2").tobytes()),
    }
    for name, (file, kind, raw) in files.items():
        (tmp_path / file).write_bytes(raw)
        (tmp_path / f"{name}.hea").write_text(header_of(name, x, file, kind, gains))
    bad = {"g": ("none.dat", "16"), "h": ("a.dat", "80"), "j": ("short.dat", "212")}
    (tmp_path / "short.dat").write_bytes(b"\1\2\3")
    for name, (file, kind) in bad.items():
        (tmp_path / f"{name}.hea").write_text(header_of(name, x, file, kind, gains))
    (tmp_path / "k.hea").write_text("k 3 500 10\nonly.dat 16 1/mV\n")
    (tmp_path / "m.hea").write_text(header_of("m", x, "a.dat", "16", ["0/mV", "200/mV", "50.5(3)/uV"]))
    df = binary.read_records(spark, str(tmp_path), samples=50)
    rows = df.collect()
    for name in files:
        own = [r for r in rows if r["record"] == name]
        assert all(r["status"] is None for r in own), own[0]
        assert len(own) == (3 if name in ("d", "e", "f", "big") else 3 * 7)
        for k in range(3):
            got = [v for r in sorted(own, key=lambda r: r["first"]) if r["lead"] == k for v in r["values"]]
            assert np.allclose(got, want[:, k]), name
        assert {r["name"] for r in own} == {"L0", "L1", "L2"}
    for name in ("g", "h", "j", "k"):
        own = [r for r in rows if r["record"] == name]
        assert own and all(r["values"] is None and r["status"] for r in own)
    assert {r["lead"]: r["status"] for r in rows if r["record"] == "m"} == {0: "gain", 1: None, 2: None}
