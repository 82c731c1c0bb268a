"""Small helpers that several operators share: scratch folders, Arrow buffers, word splitting, packed integers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The ASCII white space that separates words.
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
#: Bytes of text that the vectorised kernels take at a time; a longer document makes a chunk of its own.
CHUNK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where the session names none, as in local tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder, so that a lost executor costs nothing but a read."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def others(docs: DataFrame, added) -> list[str]:
    """The columns of ``docs`` but those of the names that an operator adds, in whatever case."""
    taken = {c.lower() for c in added}
    return [c for c in docs.columns if c.lower() not in taken]


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` to be sent to every task if it is counted to have ``most`` rows or fewer; else as it is, for a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(col):
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def strings(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and int64 offsets of its rows; null rows are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    arr = arr.cast(pa.large_binary() if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else pa.large_string())
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_large_binary(arr.type) else "")
    n = len(arr)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK):
    """Ranges of rows whose bytes make about ``size``; at least one row each."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


class Words:
    """Words of some documents, as arrays: ``norm`` holds each word followed by one space; word i starts at
    ``start[i]`` there and has ``length[i]`` bytes; document d has the words ``first[d]`` to ``first[d + 1]``."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        n, docs = len(data), len(off) - 1
        white = IS_WHITE[data]
        begins = ~white
        begins[1:] &= white[:-1]
        inner = off[1:-1]
        inner = inner[inner < n]
        begins[inner] = ~white[inner]
        at = np.flatnonzero(begins)
        self.first = np.searchsorted(at, off).astype(np.int64)
        # A word ends before the next white byte or the next beginning.
        solid = np.zeros(n + 1, np.int32 if n < 2**31 else np.int64)
        np.cumsum(~white, out=solid[1:])
        bounds = np.append(at, n)
        self.length = np.diff(solid[bounds]).astype(np.int64)
        self.solid = data[~white]
        self.start = np.cumsum(self.length + 1) - (self.length + 1)
        self._norm = None
        self.docs = docs

    @property
    def norm(self) -> np.ndarray:
        if self._norm is None:
            out = np.full(len(self.solid) + len(self.length), 0x20, np.uint8)
            spaces = self.start + self.length
            mask = np.ones(len(out), bool)
            mask[spaces] = False
            out[mask] = self.solid
            self._norm = out
        return self._norm

    def __len__(self):
        return len(self.length)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def table(seed: int) -> np.ndarray:
    """256 odd 64-bit numbers by rule."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(words: Words, seed: int) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(words):
        return np.zeros(0, np.uint64)
    first = np.cumsum(words.length) - words.length
    place = np.arange(len(words.solid), dtype=np.int64) - np.repeat(first, words.length)
    value = table(seed)[words.solid] * powers(0xD6E8FEB86659FD93 + 2 * seed, int(words.length.max()))[place]
    return mix(np.add.reduceat(value, first) + words.length.astype(np.uint64))


def window_hashes(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive values, documents not regarded; put together from runs of powers of two."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = table(0x5EED + seed)
    out, have, power, size = None, 0, h, 1
    while True:
        if k & size:
            out = power[:n].copy() if out is None else out[:n] * factor[2 * size.bit_length()] + power[have : have + n]
            have += size
        if size * 2 > k:
            return mix(out)
        power = power[:-size] * factor[2 * size.bit_length() + 1] + power[size:]
        size *= 2


def window_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``k`` that lie within one document, and those documents."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    docs = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n), docs


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each ``w`` consecutive values."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[w - have : w - have + n]) if have < w else x[:n]


_CODEC = "zstd"


def pack_ints(x: np.ndarray) -> bytes:
    """Integers as bytes: planes of equal significance, compressed."""
    x = np.ascontiguousarray(x)
    raw = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(raw, codec=_CODEC, asbytes=True) if raw else b"")


def unpack_ints(b: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.zeros(0, dtype)
    raw = pa.decompress(b[8:], decompressed_size=n * size, codec=_CODEC, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending unsigned integers, as differences."""
    x = x.astype(np.uint64)
    return pack_ints(np.diff(x, prepend=np.uint64(0)) if len(x) else x)


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(b, np.uint64), dtype=np.uint64)


def member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among ``sorted_values``."""
    if not len(sorted_values) or not len(x):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    n = len(keys[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each ``first`` on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first, n)


def ordered(x: np.ndarray, bits: int) -> np.ndarray:
    """The order of whole numbers of so many bits, equal ones in turn. Number and place are sorted as one where 64 bits hold
    both, which takes a fraction of the time of sorting places by numbers."""
    places = len(x).bit_length()
    if bits + places > 64:
        return np.argsort(x, kind="stable")
    both = (x.astype(np.uint64) << np.uint64(places)) | np.arange(len(x), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << places) - 1)).astype(np.int64)
