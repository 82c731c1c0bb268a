"""Removing byte strings that repeat across documents, by run-length indexes of what may repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .exchange import ANSWER, Sketch, answers, bits_of, flagged, flags_of, ids, in_order, opened, pack_ints, read_answers, repeated, scanned, shard_bits, sketch_width, tagged, texts, unpack_ints
from .runindex import earliest
from .shared import mix, others, sliding_min, spread, table, window_hashes

_TEXT = 100
#: Bytes of text taken at a time: what is computed of them stays in a processor's cache.
_CHUNK = 1 << 18
#: Blocks that a partition's documents make.
PARTS = 4


class _Strings:
    """The ``size``-byte strings of some texts, by runs of neighbours in a document with the same least hash of the shorter
    strings in them: a run's first byte, number of strings, document and that hash."""

    def __init__(self, data: np.ndarray, off: np.ndarray, size: int):
        short = size // 2 - 1
        least = sliding_min(window_hashes(table(41)[data], short, 42), size - short + 1)
        new = np.ones(len(least), bool)
        new[1:] = least[1:] != least[:-1]
        # Runs also end with a document's strings; what starts beyond these crosses documents.
        for edge in (off, off[1:] - size + 1):
            new[edge[(edge >= 0) & (edge < len(new))]] = True
        first = np.flatnonzero(new)
        doc = np.searchsorted(off, first, "right") - 1
        inside = first + size <= off[doc + 1]
        self.first, self.doc, self.n = first[inside], doc[inside], np.diff(np.append(first, len(new)))[inside]
        self.least = least[self.first]


def _several(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _apart(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 8], "little")
        out.append(b[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def dedup_bytes(docs: DataFrame, length: int = 50, width: int | None = None, hot_blocks: int = 256) -> DataFrame:
    """``docs`` without the bytes that a string of ``length`` bytes covers which also starts in a document of smaller id.

    Needs ``doc_id`` (long) and ``text`` (string; its UTF-8 bytes; null: empty); all other columns pass through. Adds
    ``dedup_bytes`` and ``dedup_removed`` (longs), ``dedup_spans`` (maximal removed byte ranges, end exclusive) and
    ``dedup_kept`` (binary: the bytes left, which may cut characters). Strings do not cross documents, are judged on the
    input, and may overlap; repeats within one document, or between rows that share a doc_id, stay; a null doc_id comes
    after all others; columns of the added names, in any case, are replaced; an empty table gives no rows; a very long text
    is a chunk of its own.

    First pass: equal strings have the same least hash of the strings of half that length in them; a sketch of these
    leaves out what only one document has. Second pass: each run of strings that share a suspected least hash goes, as
    bytes, to that hash's shard, once for each partition with its smallest document. A shard builds a run-length index
    (run-compressed Burrows-Wheeler transform with suffixes sampled at run ends) of its distinct strings, streams their
    matching statistics and marks long matches, which gives each string the smallest document that has it. Third pass:
    bytes are removed. A least hash that ``hot_blocks`` partitions or more share is dealt out further by each string's own
    hash, so that a passage in a third of all documents doesn't fill one shard with its surroundings.
    """
    spark = docs.sparkSession
    own = others(docs, ("dedup_bytes", "dedup_removed", "dedup_spans", "dedup_kept"))
    docs = scanned(docs.select(*own))
    width = width or sketch_width(docs, 8)
    sketch, text_bits = Sketch(1, width, shard_bits(spark)), shard_bits(spark, 4)
    shards = 1 << text_bits

    def items(data, off):
        s = _Strings(data, off, length)
        return s.least, s.doc

    def suspects(table_: pa.Table, cells: list[np.ndarray]):
        """Of a block's documents in order: the suspected runs as (document row, first byte, strings), the number of each
        run's text, and of each distinct text its key, bytes and smallest document; and where each chunk's runs end."""
        doc_ids = ids(table_["doc_id"])
        numbers: dict[bytes, int] = {}
        rows, starts, counts, names, keys, upto = [], [], [], [], [], [0]
        for lo, hi, data, off in texts(table_, _CHUNK):
            s = _Strings(data, off, length)
            cell = sketch.cells(s.least, 0)
            ok = sketch.among(cells[0], cell)
            hot = ok & sketch.among(cells[1], cell)
            ok &= ~hot
            first, count, key, doc = s.first[ok], s.n[ok], s.least[ok], s.doc[ok]
            if hot.any():
                n = s.n[hot]
                each = spread(s.first[hot], n)
                alone = window_hashes(table(43)[data], length, 44)[each]
                first, count, key, doc = np.concatenate([first, each]), np.concatenate([count, np.ones(len(each), np.int64)]), np.concatenate([key, alone]), np.concatenate([doc, np.repeat(s.doc[hot], n)])
            raw = data.tobytes()
            name = np.fromiter((numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(first.tolist(), (first + count + length - 1).tolist())), np.int64, len(first))
            rows.append(lo + doc)
            starts.append(first - off[doc])
            counts.append(count)
            names.append(name)
            # Least hashes are small numbers: mixed, they spread over the shards.
            keys.append(mix(key))
            upto.append(upto[-1] + len(first))
        rows, starts, counts, names, keys = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, starts, counts, names, keys))
        least = np.full(len(numbers), 2**63 - 1, np.int64)
        np.minimum.at(least, names, doc_ids[rows])
        key = np.zeros(len(numbers), np.uint64)
        key[names] = keys
        return rows, starts, counts, names, key, numbers, least, doc_ids, upto

    def dealt(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of distinct texts by shard, and each one's shard in that order."""
        shard = (key >> np.uint64(64 - text_bits)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return order, shard[order]

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return answers([])
        block = left["block"][0].as_py()
        *_, key, numbers, least, _, _ = suspects(in_order(opened(left)), flagged(right, 2))
        found = list(numbers)
        order, shard = dealt(key)
        edge, out = np.searchsorted(shard, np.arange(shards + 1)), []
        for s in np.flatnonzero(np.diff(edge)):
            some = order[edge[s] : edge[s + 1]]
            mine = [found[i] for i in some.tolist()]
            text = np.frombuffer(b"".join(mine), np.uint8)
            out.append((block, _TEXT, int(s), _several([pack_ints(np.fromiter(map(len, mine), np.int32, len(mine))), pack_ints(least[some]), pack_ints(key[some].astype(np.uint32)), pack_ints(text)])))
        return answers(out)

    def index(table_: pa.Table) -> pa.Table:
        """Of each block's texts, string by string: whether a smaller document has it than any of that block."""
        numbers: dict[bytes, int] = {}
        names, docs_, keys, sizes = [], [], [], []
        for payload in table_["payload"].to_pylist():
            size, least, key, text = _apart(payload)
            size, least, text = unpack_ints(size, np.int32).astype(np.int64), unpack_ints(least, np.int64), unpack_ints(text, np.uint8).tobytes()
            ends = np.cumsum(size)
            names.append(np.fromiter((numbers.setdefault(text[a:b], len(numbers)) for a, b in zip((ends - size).tolist(), ends.tolist())), np.int64, len(size)))
            docs_.append(least)
            keys.append(unpack_ints(key, np.uint32))
            sizes.append(size)
        distinct = list(numbers)
        first, group = np.full(len(distinct), 2**63 - 1, np.int64), np.zeros(len(distinct), np.uint32)
        for n, d, key in zip(names, docs_, keys):
            np.minimum.at(first, n, d)
            group[n] = key
        # Equal strings of so many bytes have the same least hash, so that texts of different keys share none.
        best, begin = earliest(np.frombuffer(b"".join(distinct), np.uint8), np.fromiter(map(len, distinct), np.int64, len(distinct)), first, group, length)
        out = []
        for block, shard, n, d, size in zip(table_["block"].to_pylist(), table_["shard"].to_pylist(), names, docs_, sizes):
            many = size - length + 1
            out.append((block, _TEXT, shard, bits_of(best[spread(begin[n], many)] < np.repeat(d, many))))
        return answers(out)

    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType(docs.schema.fields + [T.StructField("dedup_bytes", T.LongType()), T.StructField("dedup_removed", T.LongType()), T.StructField("dedup_spans", T.ArrayType(span)), T.StructField("dedup_kept", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return arrow.empty_table()
        table_ = in_order(opened(left))
        rows, starts, counts, names, key, numbers, least, doc_ids, upto = suspects(table_, flagged(right, 2))
        many = np.fromiter(map(len, numbers), np.int64, len(numbers)) - length + 1
        numbers.clear()
        order = dealt(key)[0]
        told = {s: flags_of(p) for s, p in read_answers(right, _TEXT)}
        smaller = np.concatenate([told[s] for s in sorted(told)]) if told else np.zeros(0, bool)
        begin = np.zeros(len(many), np.int64)
        begin[order] = np.cumsum(many[order]) - many[order]
        n_bytes, n_removed, n_spans, kept, from_, upto_ = [], [], [], [], [], []
        for c, (lo, hi, data, off) in enumerate(texts(table_, _CHUNK)):
            # Each string of each run: removed if a smaller document outside or inside the block has it.
            own_runs = slice(upto[c], upto[c + 1])
            n, name, row = counts[own_runs], names[own_runs], rows[own_runs]
            gone = smaller[spread(begin[name], n)] | np.repeat(doc_ids[row] != least[name], n)
            place = spread(starts[own_runs] + off[row - lo], n)[gone]
            # No two strings start at one place.
            step = np.zeros(len(data) + 1, np.int8)
            step[place] = 1
            step[place + length] -= 1
            drop = np.cumsum(step[:-1], dtype=np.int32) > 0
            total = np.concatenate(([0], np.cumsum(drop)))[off]
            left_over, ends = data[~drop].tobytes(), off - total
            kept += [left_over[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            # A span begins, and ends, where removal does or a document does.
            edge = np.zeros(len(data) + 1, bool)
            edge[off] = True
            change = np.flatnonzero(np.diff(drop, prepend=False, append=False) | edge)
            inside = drop[change[:-1]]
            first, last = change[:-1][inside], change[1:][inside]
            row = np.searchsorted(off, first, "right") - 1
            from_.append(first - off[row])
            upto_.append(last - off[row])
            n_spans.append(np.bincount(row, minlength=hi - lo))
            n_bytes.append(np.diff(off))
            n_removed.append(np.diff(total))
        from_, upto_, bounds = np.concatenate(from_), np.concatenate(upto_), np.concatenate([[0], *n_spans]).cumsum()
        spans = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(from_, pa.int64()), pa.array(upto_, pa.int64())], ["start", "end"]))
        cols = {c: table_[c] for c in own}
        cols |= {"dedup_bytes": pa.array(np.concatenate(n_bytes), pa.int64()), "dedup_removed": pa.array(np.concatenate(n_removed), pa.int64()), "dedup_spans": spans, "dedup_kept": pa.array(kept, pa.binary())}
        return pa.table([cols[f.name].cast(f.type) for f in arrow], schema=arrow)

    cells = repeated(docs, items, sketch, hot_blocks, PARTS, _CHUNK)
    blocks = tagged(docs, PARTS)
    asked = tagged(docs.select("doc_id", "text"), PARTS).groupBy("block").cogroup(cells.groupBy("block")).applyInArrow(ask, ANSWER)
    told = asked.groupBy("shard").applyInArrow(index, ANSWER)
    return blocks.groupBy("block").cogroup(cells.unionByName(told).groupBy("block")).applyInArrow(apply, schema)


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract columns for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_bytes(docs).select("doc_id", F.col("dedup_bytes").alias("n_bytes"), F.col("dedup_removed").alias("n_removed"), F.size("dedup_spans").cast("long").alias("n_spans"), F.sha2("dedup_kept", 256).alias("kept_sha256"))
