"""The run-length index of suspected strings, and what is removed by it."""

import numpy as np
import pytest

from veriscope.llm import runindex, suffixes
from veriscope.llm.shared import ordered


@pytest.mark.parametrize("most", [300, 1 << 18])
def test_strings_alone_in_their_group_are_not_indexed(monkeypatch, most):
    rng, built, build = np.random.default_rng(7), [], runindex.build
    monkeypatch.setattr(runindex, "build", lambda data, length: built.append(int((length + 1).sum())) or build(data, length))
    # Each group has two letters of its own, so that no two share anything; half of the groups have one string.
    group = rng.permutation(np.concatenate([np.arange(40), np.repeat(np.arange(20), rng.integers(1, 9, 20))]))
    strings = [rng.integers(2 * g, 2 * g + 2, rng.integers(8, 40)).astype(np.uint8) for g in group]
    length, doc = np.array([len(s) for s in strings]), rng.integers(0, 1000, len(strings))
    best, begin = runindex.earliest(np.concatenate(strings), length, doc, group.astype(np.uint32), 8, most)
    want = {}
    for s, k in zip(strings, doc):
        for i in range(len(s) - 7):
            want[bytes(s[i : i + 8])] = min(want.get(bytes(s[i : i + 8]), 1000), k)
    for s, b in zip(strings, begin):
        assert [want[bytes(s[i : i + 8])] for i in range(len(s) - 7)] == best[b : b + len(s) - 7].tolist()
    sizes = np.bincount(group, length + 1)
    assert sum(built) == sizes[:20].sum() and max(built) <= max(most, sizes.max())


@pytest.mark.parametrize("bits", [3, 40, 63])
def test_order_of_numbers(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64)
    assert (ordered(x, bits) == np.argsort(x, kind="stable")).all() and len(ordered(x[:0], bits)) == 0


def test_spans_end_with_their_document(spark):
    a, b = (" ".join(str(k * k) for k in range(n, n + 20)) for n in (100, 500))
    texts = [a + b, a, b, "", a + "-" + b, None, "-" + b]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: ([tuple(s) for s in r["dedup_spans"]], bytes(r["dedup_kept"]).decode()) for r in suffixes.dedup_bytes(d).collect()}
    m, n = len(a), len(b)
    assert got == {0: ([], a + b), 1: ([(0, m)], ""), 2: ([(0, n)], ""), 3: ([], ""), 4: ([(0, m), (m + 1, m + 1 + n)], "-"), 5: ([], ""), 6: ([(0, n + 1)], "")}
