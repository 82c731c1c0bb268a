"""Binary files read in ranges: matrices of arrays, and signal records of interleaved samples.

A file's header is read once; what follows is cut into ranges of rows or samples, each read by its own task with one seek (or
one a column), so that no file has to fit into a task. Paths are local ones or URIs of a store that Arrow can open.
"""

from __future__ import annotations

import io
import math
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that a range of a file has, about.
RANGE = 32 << 20
#: Bytes that opening a file counts for where ranges share a task.
OPENING = 64 << 10
#: Values that a batch of a range has, about.
BATCH = 1 << 20


def opened(path: str):
    """(file system, path there) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def matching(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The files that a path names: itself, or those of a folder, in order."""
    from pyarrow import fs

    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    root = path.rstrip("/")
    found = [f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(suffixes)]
    return sorted(root + f[len(at.rstrip("/")) :] for f in found)


def write(path: str, content: bytes) -> None:
    """A file of some bytes, and the folders above it."""
    store, at = opened(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at) as f:
        f.write(content)


# Matrices


class Layout:
    """Where a matrix lies in a file: numbers of ``dtype`` from byte ``start``, rows or columns in turn."""

    def __init__(self, shape: tuple[int, ...], fortran: bool, dtype: np.dtype, start: int):
        if len(shape) > 2:
            raise ValueError(f"a matrix has two dimensions, not {len(shape)}")
        if dtype.kind not in "fiub":
            raise ValueError(f"no numbers: {dtype}")
        self.rows, self.columns = (*shape, 1)[:2] if shape else (1, 1)
        self.fortran, self.dtype, self.start = fortran and len(shape) == 2, dtype, start

    @classmethod
    def read(cls, file) -> Layout:
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        return cls(*read(file), file.tell())

    def block(self, file, first: int, rows: int, columns: range) -> np.ndarray:
        """Some rows of a range of columns, as doubles. Of rows in turn, one read; of columns in turn, one a column."""
        size = self.dtype.itemsize
        if self.fortran:
            out = np.empty((rows, len(columns)))
            for j, c in enumerate(columns):
                file.seek(self.start + (c * self.rows + first) * size)
                out[:, j] = np.frombuffer(file.read(rows * size), self.dtype)
            return out
        file.seek(self.start + first * self.columns * size)
        full = np.frombuffer(file.read(rows * self.columns * size), self.dtype).reshape(rows, self.columns)
        return full[:, columns.start : columns.stop].astype(np.float64)


def _member(store, at: str, name: str | None) -> tuple[str, int | None]:
    """(name, first byte) of an archive's array; no byte where it is compressed."""
    with store.open_input_file(at) as f, zipfile.ZipFile(f) as z:
        names = [n for n in z.namelist() if n.endswith(".npy")]
        own = f"{name}.npy" if name else names[0] if names else None
        if own not in names:
            raise ValueError(f"no array {name} in {at}")
        info = z.getinfo(own)
        if info.compress_type != zipfile.ZIP_STORED:
            return own, None
        f.seek(info.header_offset + 26)
        a, b = struct.unpack("<HH", f.read(4))
        return own, info.header_offset + 30 + a + b


class _Shifted(io.RawIOBase):
    """A file seen from some byte on."""

    def __init__(self, file, first: int):
        self.file, self.first = file, first
        file.seek(first)

    def readable(self):
        return True

    def read(self, n=-1):
        return self.file.read(n) if n is None or n >= 0 else self.file.read()

    def seek(self, at, whence=0):
        return self.file.seek(self.first + at) - self.first if whence == 0 else self.file.seek(at, whence)

    def tell(self):
        return self.file.tell() - self.first


class MatrixRange:
    def __init__(self, path: str, member: str | None, begin: int | None, first: int, rows: int):
        self.path, self.member, self.begin, self.first, self.rows = path, member, begin, first, rows


class MatrixRanges(InputPartition):
    """Ranges that one task reads, one after the other."""

    def __init__(self, ranges: list[MatrixRange]):
        self.ranges = ranges


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.array = options["path"], options.get("array")
        lo, _, hi = options.get("columns", ":").partition(":")
        self.low, self.high = int(lo or 0), int(hi) if hi else None
        self.bytes = int(options.get("range", RANGE))
        self.task = int(options.get("task", self.bytes))

    def partitions(self):
        # Small ranges share a task, as Spark's own readers let small files do.
        out, room = [], 0
        for r, size in self._ranges():
            if out and size <= room:
                out[-1].ranges.append(r)
            else:
                out.append(MatrixRanges([r]))
                room = self.task
            room -= size
        return out

    def _ranges(self):
        """(range, what it counts for in a task: its bytes, and ``OPENING`` for opening its file)."""
        for path in matching(self.path, (".npy", ".npz")):
            store, at = opened(path)
            member, begin = _member(store, at, self.array) if path.endswith(".npz") else (None, 0)
            if begin is None:
                # A compressed array can be read from its beginning only: one task, some rows at a time.
                yield MatrixRange(path, member, None, 0, -1), self.task
                continue
            with store.open_input_file(at) as f:
                layout = Layout.read(_Shifted(f, begin))
            width = max(1, layout.columns * layout.dtype.itemsize)
            step = max(1, self.bytes // width)
            for first in range(0, layout.rows, step):
                rows = min(step, layout.rows - first)
                yield MatrixRange(path, member, begin, first, rows), rows * width + OPENING

    def _emit(self, path: str, first: int, block: np.ndarray):
        n, d = block.shape
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(block).ravel()))
        return pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(first, first + n)), lists], ["file", "row", "values"])

    def read(self, parts: MatrixRanges):
        for part in parts.ranges:
            yield from self._read(part)

    def _read(self, part: MatrixRange):
        store, at = opened(part.path)
        with store.open_input_file(at) as f:
            if part.begin is None:
                with zipfile.ZipFile(f) as z, z.open(part.member) as inner:
                    yield from self._streamed(part.path, inner)
                return
            source = _Shifted(f, part.begin)
            layout = Layout.read(source)
            columns = range(self.low, min(layout.columns, self.high if self.high is not None else layout.columns))
            step = max(1, BATCH // max(1, layout.columns if not layout.fortran else len(columns)))
            for first in range(part.first, part.first + part.rows, step):
                yield self._emit(part.path, first, layout.block(source, first, min(step, part.first + part.rows - first), columns))

    def _streamed(self, path: str, inner):
        layout = Layout.read(inner)
        columns = slice(self.low, self.high)
        if layout.fortran:
            # Columns in turn don't give rows before the end.
            full = np.frombuffer(inner.read(), layout.dtype).reshape(layout.columns, layout.rows).T
            yield self._emit(path, 0, full[:, columns].astype(np.float64))
            return
        step = max(1, BATCH // max(1, layout.columns))
        for first in range(0, layout.rows, step):
            rows = min(step, layout.rows - first)
            raw = inner.read(rows * layout.columns * layout.dtype.itemsize)
            yield self._emit(path, first, np.frombuffer(raw, layout.dtype).reshape(rows, layout.columns)[:, columns].astype(np.float64))


class MatrixSource(DataSource):
    """Rows (file, row, values) of matrices in ``.npy`` files, or of one array of ``.npz`` archives, of any order of axes, byte
    order and kind of number. Options: ``columns`` (``first:end``, of which only these are kept, and read where columns lie
    in turn), ``array`` (the archive's; else its first), ``range`` (bytes a range), ``task`` (bytes a task, of ranges that
    share it; else those of a range). A vector is a matrix of one column;
    more than two dimensions, and files that aren't arrays, are errors. Compressed arrays take one task each, some rows at
    a time (all at once where columns lie in turn)."""

    @classmethod
    def name(cls):
        return "matrix"

    def schema(self):
        return "file string, row long, values array<double>"

    def reader(self, schema):
        return MatrixReader(self.options)


def read_matrices(spark: SparkSession, path: str, columns: str | None = None, array: str | None = None, range_bytes: int = RANGE, task_bytes: int | None = None) -> DataFrame:
    spark.dataSource.register(MatrixSource)
    reader = spark.read.format("matrix").option("range", range_bytes)
    for k, v in (("columns", columns), ("array", array), ("task", task_bytes)):
        reader = reader.option(k, v) if v is not None else reader
    return reader.load(path)


# Records of signals


def pack_12(x: np.ndarray) -> bytes:
    """Samples of 12 bits, two in three bytes."""
    x = np.append(x, 0)[: len(x) + len(x) % 2].astype(np.int64) & 0xFFF
    a, b = x[::2], x[1::2]
    return np.stack([a & 0xFF, (a >> 8) | (b >> 8 << 4), b & 0xFF], 1).astype(np.uint8).tobytes()


def unpack_12(raw: bytes, n: int) -> np.ndarray:
    """The first ``n`` samples of 12 bits."""
    b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int64)
    x = np.stack([b[:, 0] | (b[:, 1] & 0x0F) << 8, b[:, 2] | (b[:, 1] & 0xF0) << 4], 1).ravel()[:n]
    return np.where(x > 0x7FF, x - 0x1000, x)


# Kinds of number in array files of level 4 and 5.
LEVEL_4 = {0: "f8", 1: "f4", 2: "i4", 3: "i2", 4: "u2", 5: "u1"}
LEVEL_5 = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15


def level_4(head: bytes) -> tuple[str, int, int, str, int]:
    """(name, rows, columns, dtype, first byte) of the first matrix of a level 4 file, from its first bytes."""
    for order in "<>":
        kind, rows, columns, imaginary, length = struct.unpack(order + "5i", head[:20])
        if 0 <= kind < 5000 and kind // 1000 == (order == ">") and kind // 10 % 10 in LEVEL_4 and kind % 10 == 0 and 0 < length < 256 and not imaginary:
            return head[20 : 20 + length].split(b"\0")[0].decode("ascii"), rows, columns, order + LEVEL_4[kind // 10 % 10], 20 + length
    raise ValueError("no matrix of level 4")


def _element(raw: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """(kind, first byte, bytes, next element) of a level 5 element; small ones hold their data in the tag."""
    kind, size = struct.unpack(order + "II", raw[at : at + 8])
    if kind >> 16:
        return kind & 0xFFFF, at + 4, kind >> 16, at + 8
    return kind, at + 8, size, at + 8 + (size if kind == COMPRESSED else -(-size // 8) * 8)


def level_5(raw: bytes, name: str) -> np.ndarray:
    """A real matrix of a level 5 file by its name."""
    if len(raw) < 128 or raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("no file of level 5")
    order, at = "<" if raw[126:128] == b"IM" else ">", 128
    while at + 8 <= len(raw):
        kind, first, size, after = _element(raw, at, order)
        body = raw[first : first + size]
        if kind == COMPRESSED:
            body = zlib.decompress(body)
            kind, first, size, _ = _element(body, 0, order)
            body = body[first : first + size]
        if kind == MATRIX:
            _, _, _, here = _element(body, 0, order)
            _, first, size, here = _element(body, here, order)
            shape = struct.unpack(order + f"{size // 4}i", body[first : first + size])
            _, first, size, here = _element(body, here, order)
            if body[first : first + size].decode("ascii") == name:
                kind, first, size, _ = _element(body, here, order)
                return np.frombuffer(body[first : first + size], np.dtype(order + LEVEL_5[kind])).reshape(shape, order="F")
        at = after
    raise ValueError(f"no matrix {name}")


RECORD = "record string, leads int, rate double, samples long, lead int, name string, file string, format string, gain double, baseline double"


def parse_header(text: str, folder: str) -> list[tuple]:
    """Rows of ``RECORD`` from a record's header. A lead without a gain has 1, without a baseline 0."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    first = lines[0].split()
    n, out = int(first[1]), []
    if len(lines) < n + 1:
        raise ValueError("fewer lines than leads")
    for i, line in enumerate(lines[1 : n + 1]):
        f = line.split()
        gain, baseline = 1.0, 0.0
        if len(f) > 2:
            number, _, rest = f[2].split("/")[0].partition("(")
            gain, baseline = float(number), float(rest.rstrip(")") or 0) if rest else 0.0
        out.append((first[0].split("/")[0], n, float(first[2].split("/")[0].split("(")[0]) if len(first) > 2 else 250.0, int(first[3]) if len(first) > 3 else 0, i, f[8] if len(f) > 8 else f"lead{i}", f"{folder}/{f[0]}", f[1], gain, baseline))
    return out


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(``RECORD``, status): one row a lead of every ``.hea`` file below a folder; a header that can't be read has one row with
    its name and what is wrong. Files are read by Spark, whatever the store."""
    texts = spark.read.option("pathGlobFilter", "*.hea").option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for text, at in zip(b.column("value").to_pylist(), b.column("path").to_pylist()):
                at = at.removeprefix("file://") if at.startswith("file:///") else at.removeprefix("file:")
                folder, _, file = at.rpartition("/")
                try:
                    rows += [(*r, None) for r in parse_header(text, folder)]
                except (ValueError, IndexError) as e:
                    rows.append((file.removesuffix(".hea"), *[None] * (len(names) - 1), f"header: {e}"[:200]))
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip([*names, "status"], r)) for r in rows], schema=arrow)

    schema = T.StructType.fromDDL(RECORD + ", status string")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return texts.mapInArrow(run, schema)


def read_samples(raw_of, format_: str, first: int, n: int, leads: int) -> np.ndarray:
    """``n`` samples of each lead from sample ``first`` on (samples, leads). ``raw_of(byte, bytes)`` reads the file."""
    code, _, offset = format_.partition("+")
    start, total = int(offset or 0), n * leads
    if code == "16":
        raw = raw_of(start + 2 * first * leads, 2 * total)
        x = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.int64)
    elif code == "212":
        odd = first * leads % 2
        raw = raw_of(start + (first * leads - odd) // 2 * 3, -(-(total + odd) // 2) * 3)
        x = unpack_12(raw, total + odd)[odd:]
    else:
        raise ValueError(f"format {format_}")
    if len(x) < total:
        raise ValueError("the file is too short")
    return x.reshape(n, leads)


def read_records(spark: SparkSession, path: str, samples: int = 1 << 20) -> DataFrame:
    """(record, name, lead, first, values, status): the signals of every record below a folder, in physical units, (raw -
    baseline) / gain, in stretches of about ``samples`` samples of all leads from sample ``first`` on.

    Leads lie interleaved in one file a record, with 16 or 12 bits a sample (formats 16 and 212, with an offset or not), or
    as the matrix ``val`` of a level 4 or 5 array file where the header names one. Each stretch is read by its own task, but
    for level 5 files, which may be compressed and are read whole. What can't be read has a status instead of values: bad
    headers, unknown formats, files that lack or are too short, gains of zero."""
    found = headers(spark, path)
    each = F.struct("lead", "name", "gain", "baseline")
    records = found.where("status is null").groupBy("record", "file", "format", "leads", "samples").agg(F.array_sort(F.collect_list(each)).alias("of"))
    step = F.greatest(F.floor(F.lit(samples) / F.col("leads")), F.lit(1))
    whole = F.col("file").endswith(".mat") & ~F.col("format").contains("+")
    first = F.when(whole | (F.col("samples") <= 0), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("samples") - 1, step))
    ranges = records.withColumn("whole", whole).withColumn("first", F.explode(first)).withColumn("n", F.when(whole, F.col("samples")).otherwise(F.least(step, F.col("samples") - F.col("first"))))
    schema = T.StructType.fromDDL("record string, name string, lead int, first long, values array<double>, status string")

    def matrix(f, leads: int) -> np.ndarray:
        head = f.read(300)
        if head[126:128] in (b"IM", b"MI") and not head[:4] == b"\0\0\0\0":
            f.seek(0)
            x = level_5(f.read(), "val")
        else:
            name, rows, columns, kind, start = level_4(head)
            if name != "val":
                raise ValueError(f"matrix {name}")
            f.seek(start)
            x = np.frombuffer(f.read(rows * columns * np.dtype(kind).itemsize), kind).reshape(rows, columns, order="F")
        return x.T if x.shape[0] == leads else x

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                try:
                    store, at = opened(r["file"])
                    with store.open_input_file(at) as f:
                        if r["whole"]:
                            x = matrix(f, r["leads"])
                        else:
                            def raw_of(byte: int, size: int, f=f) -> bytes:
                                f.seek(byte)
                                return f.read(size)

                            x = read_samples(raw_of, r["format"], r["first"], r["n"], r["leads"])
                    if x.ndim != 2 or x.shape[1] < len(r["of"]):
                        raise ValueError("fewer signals than leads")
                    rows = []
                    for k, lead in enumerate(r["of"]):
                        bad = not math.isfinite(lead["gain"]) or abs(lead["gain"]) < 1e-12
                        y = None if bad else np.nan_to_num((x[:, k] - lead["baseline"]) / lead["gain"], nan=0.0, posinf=0.0, neginf=0.0).tolist()
                        rows.append((lead["name"], lead["lead"], y, "gain" if bad else None))
                except (OSError, ValueError, KeyError, struct.error, zlib.error) as e:
                    rows = [(lead["name"], lead["lead"], None, f"{type(e).__name__}: {e}"[:200]) for lead in r["of"]]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array([r["record"]] * len(rows)), pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array([r["first"]] * len(rows), pa.int64()), pa.array(cols[2], pa.list_(pa.float64())), pa.array(cols[3], pa.string())], schema.names)

    read = ranges.repartition("record", "first").mapInArrow(run, schema)
    bad = found.where("status is not null").select("record", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("lead"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("array<double>").alias("values"), "status")
    return read.unionByName(bad)
