"""Blocks of documents that ask shards, and get answers, without a row per window.

A block is what one partition of the scan reads, or a part of that. It packs sorted values for each shard into one binary; shards merge those
of all blocks and answer each block. Blocks meet their answers by a cogroup on the block's number, for which the documents
are dealt out once more by block; what a task holds is one block, bounded by ``spark.sql.files.maxPartitionBytes``, or one
shard, a share of all values that gets smaller with ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, cut_lineage, member, mix, ordered, pack_ints, pack_sorted, parallelism, runs, scratch_path, strings, unpack_ints, unpack_sorted

ANSWER = "block int, kind int, shard int, payload binary"
NO_ID = np.int64(2**63 - 1)


def answers(rows: list[tuple]) -> pa.Table:
    block, kind, shard, payload = zip(*rows) if rows else ((),) * 4
    return pa.table({"block": pa.array(block, pa.int32()), "kind": pa.array(kind, pa.int32()), "shard": pa.array(shard, pa.int32()), "payload": pa.array(payload, pa.binary())})


def shard_bits(spark, per_task: int = 2) -> int:
    return max(4, (parallelism(spark) * per_task - 1).bit_length())


def ids(column) -> np.ndarray:
    """Document ids; rows without one come after all others."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def in_order(table: pa.Table) -> pa.Table:
    """A block's documents, in an order that does not depend on how they came."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def texts(table, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of some texts at a time."""
    data, off = strings(table.column("text"))
    for lo, hi in chunks(off, *([size] if size else [])):
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def tagged(docs: DataFrame, parts: int = 1) -> DataFrame:
    """Rows (block, docs) that hold some documents each, all their columns packed and compressed: texts take half the room
    of plain rows in a shuffle. A block is the number of the partition that reads its documents, the same in every pass over
    a DataFrame that scans files (see ``scanned``), dealt into ``parts`` by doc_id, which lets a task hold less."""

    def run(batches):
        first, options = TaskContext.get().partitionId() * parts, pa.ipc.IpcWriteOptions(compression="zstd")
        for b in batches:
            off = strings(b.column("text"))[1]
            for lo, hi in chunks(off, 4 << 20):
                some = b.slice(lo, hi - lo)
                part = ids(some.column("doc_id")) % parts
                for i in range(parts):
                    own = some.filter(pa.array(part == i)) if parts > 1 else some
                    if len(own):
                        sink = pa.BufferOutputStream()
                        with pa.ipc.new_stream(sink, own.schema, options=options) as w:
                            w.write_batch(own)
                        yield pa.RecordBatch.from_arrays([pa.array([first + i], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])

    return docs.mapInArrow(run, "block int, docs binary")


def opened(table: pa.Table) -> pa.Table:
    """The documents of a block."""
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table["docs"].to_pylist()]).combine_chunks()


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` if it scans files without a shuffle, so that every pass deals its rows to the same partitions; else what a
    scan of a copy in the shared folder gives."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    # Only projections and filters of one file relation are sure to keep rows where the scan puts them.
    if all(re.match(r"[\s:+-]*(Project|Filter|Relation) \[?", line) for line in plan.strip().splitlines()) and docs.inputFiles():
        return docs
    path = scratch_path(docs.sparkSession, "documents")
    docs.write.parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)


def sketch_width(docs: DataFrame, bytes_a_value: int) -> int:
    """Bits of a sketch's cells: a thousand cells for each value that the texts can have, so that false alarms stay below
    one in a thousand a row at any size. Only cells that are not zero are kept, so that width costs no memory."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(62, max(24, (1000 * size // bytes_a_value).bit_length()))


class Sketch:
    """A count-min sketch of ``depth`` rows of ``2 ** width`` cells, kept as the cells that are not zero.

    It counts in how many documents a value occurs, and stops at two.
    """

    def __init__(self, depth: int, width: int, bits: int):
        self.depth, self.width, self.bits = depth, width, min(bits, width)

    def cells(self, values: np.ndarray, row: int) -> np.ndarray:
        return mix(values ^ np.uint64(0xC2B2AE3D27D4EB4F * (row + 1) % 2**64)) >> np.uint64(64 - self.width)

    def shard(self, cells: np.ndarray) -> np.ndarray:
        return (cells >> np.uint64(self.width - self.bits)).astype(np.int64)

    def among(self, some: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Which of ``cells`` are among ``some``, sorted ones. Looked up about in order, they meet what is in the cache."""
        spare = max(0, self.width + len(cells).bit_length() - 64)
        by = ordered(cells >> np.uint64(spare), self.width - spare)
        out = np.zeros(len(cells), bool)
        out[by] = member(some, cells[by])
        return out

    def of(self, values: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(row, shard, packed cells) of a partition: each cell doubled, plus one if two documents share it here."""
        for row in range(self.depth):
            cells = self.cells(values, row)
            order = ordered(cells, self.width)
            cells, d = cells[order], docs[order]
            first = runs(cells)
            if not len(first):
                continue
            many = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
            out = cells[first] * np.uint64(2) + many
            edges = np.searchsorted(self.shard(cells[first]), np.arange((1 << self.bits) + 1))
            for s in np.flatnonzero(np.diff(edges)):
                yield row, int(s), pack_sorted(out[edges[s] : edges[s + 1]])


def repeated(docs: DataFrame, items: Callable, sketch: Sketch, hot_blocks: int | None = None, parts: int = 1, chunk: int | None = None) -> DataFrame:
    """First pass: for each block the cells (``kind``: the row) that the merged sketches count twice or more.

    ``items(bytes, offsets)`` gives values and their documents. Cells of row 0 that ``hot_blocks`` blocks or more share are
    told apart, as kind ``depth``. ``chunk``: bytes of text taken at a time.
    """

    def make(batches):
        first, seen = TaskContext.get().partitionId() * parts, 0
        held: list[list[tuple]] = [[] for _ in range(parts)]
        for b in batches:
            part = ids(b.column("doc_id")) % parts
            for lo, hi, data, off in texts(b, chunk):
                v, d = items(data, off)
                d = d + lo
                for i in range(parts):
                    mine = part[d] == i if parts > 1 else slice(None)
                    held[i].append((v[mine], (d[mine] + seen).astype(np.int32)))
            seen += len(b)
        for i, own in enumerate(held):
            if own:
                rows = [(first + i, row, shard, payload) for row, shard, payload in sketch.of(*(np.concatenate(x) for x in zip(*own)))]
                own.clear()
                for lo in range(0, len(rows), 64):
                    yield from answers(rows[lo : lo + 64]).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        row, shard = table["kind"][0].as_py(), table["shard"][0].as_py()
        each = [unpack_sorted(p) for p in table["payload"].to_pylist()]
        every = np.sort(np.concatenate(each))
        cells = every >> np.uint64(1)
        first = runs(cells)
        n = np.diff(np.append(first, len(cells)))
        last = every[first + n - 1]
        twice = cells[first][(n > 1) | ((last & np.uint64(1)) == 1)]
        hot = cells[first][n >= hot_blocks] if hot_blocks and row == 0 else None
        out = []
        for block, own in zip(table["block"].to_pylist(), each):
            own = own >> np.uint64(1)
            out.append((block, row, shard, pack_sorted(np.intersect1d(own, twice, assume_unique=True))))
            if hot is not None and len(own := np.intersect1d(own, hot, assume_unique=True)):
                out.append((block, sketch.depth, shard, pack_sorted(own)))
        return answers(out)

    # Two later passes read the answers.
    return cut_lineage(docs.select("doc_id", "text").mapInArrow(make, ANSWER).groupBy("kind", "shard").applyInArrow(merge, ANSWER))


def read_answers(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """(shard, payload) of one kind, by shard."""
    rows = [(s, p) for k, s, p in zip(*(table[c].to_pylist() for c in ("kind", "shard", "payload"))) if k == kind]
    return sorted(rows)


def flagged(table: pa.Table, kinds: int) -> list[np.ndarray]:
    """Sorted cells of each kind."""
    out = []
    for k in range(kinds):
        got = [unpack_sorted(p) for _, p in read_answers(table, k)]
        out.append(np.sort(np.concatenate(got)) if got else np.zeros(0, np.uint64))
    return out


def bits_of(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes()


def flags_of(b: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b[8:], np.uint8), count=int.from_bytes(b[:8], "little")).astype(bool)


__all__ = ["ANSWER", "Sketch", "answers", "bits_of", "flagged", "flags_of", "ids", "in_order", "opened", "pack_ints", "read_answers", "repeated", "scanned", "shard_bits", "sketch_width", "tagged", "texts", "unpack_ints"]
