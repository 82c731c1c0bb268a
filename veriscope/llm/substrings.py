"""Removing passages that repeat across documents: a count-min prefilter, then exact grouping of what it leaves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .exchange import ANSWER, Sketch, answers, bits_of, flagged, flags_of, ids, in_order, opened, pack_ints, read_answers, repeated, scanned, shard_bits, sketch_width, tagged, texts, unpack_ints
from .shared import WORD, Words, others, pack_sorted, runs, sliding_min, unpack_sorted, window_hashes, window_rows, word_hashes

_EXACT = 100
#: Blocks that a partition's documents make.
PARTS = 4


class _Windows:
    """The windows of some documents: first words, documents, and the least hash of the shorter windows in each, which
    equal windows share. A value that occurs in one document only rules out every window that has it."""

    def __init__(self, data: np.ndarray, off: np.ndarray, size: int):
        short = (size + 1) // 2
        self.words, self.size = Words(data, off), size
        self.hash = word_hashes(self.words, 31)
        self.at, self.doc = window_rows(self.words.first, size)
        least = sliding_min(window_hashes(self.hash, short, 32), size - short + 1)
        self.least = least[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.run = runs(self.least, self.doc)

    def keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits that name each of some windows by its words."""
        high = window_hashes(self.hash, self.size, 33)[self.at[which]]
        low = window_hashes(word_hashes(self.words, 34), self.size, 35)[self.at[which]]
        return high, (low >> np.uint64(32)).astype(np.uint32)


def dedup_substrings(docs: DataFrame, window: int = 13, depth: int = 2, width: int | None = None, keep_layout: bool = False) -> DataFrame:
    """``docs`` without the words that a window of ``window`` words covers which also starts in a document of smaller id.

    Needs ``doc_id`` (long) and ``text``; all other columns pass through. Adds ``dedup_words``, ``dedup_removed`` (longs) and
    ``dedup_spans`` (removed word ranges, end exclusive); columns of these names, in any case, are replaced. ``text`` becomes the kept
    words joined by one space (with ``keep_layout``, a document that loses nothing keeps its text as it is). Null texts have
    no words and become empty (null with ``keep_layout``). A window repeated within one document, or between rows that share
    a doc_id, is not removed; of equal texts the one with the smallest id stays; a null doc_id comes after all others; an
    empty table gives no rows; a very long text is a chunk of its own.

    First pass: each partition sketches the windows it has; the merged sketches (``depth`` rows of ``2 ** width`` cells)
    never count too few, so windows counted once are left out. Second pass: the others are grouped exactly, each partition
    sending a window once, with its smallest document. Third pass: words are removed. ``width`` follows from the size of
    the texts unless it is given; too small a width costs time, not results. A window is named by 96 bits of two hashes
    of its words: of n different suspected windows some two are taken for one with a probability below n ** 2 / 2 ** 97
    (for 10 ** 12 of them, a whole 100 TB in which a tenth repeats, 6e-6).
    """
    spark = docs.sparkSession
    own = others(docs, ("dedup_words", "dedup_removed", "dedup_spans"))
    docs = scanned(docs.select(*own))
    width = width or sketch_width(docs, 4)
    sketch, exact_bits = Sketch(depth, width, shard_bits(spark)), shard_bits(spark)
    shards = 1 << exact_bits

    def items(data, off):
        w = _Windows(data, off, window)
        return w.least[w.run], w.doc[w.run]

    def suspects(table: pa.Table, cells: list[np.ndarray]):
        """Of a block's documents in order: for each chunk the suspected windows; then their distinct names, ascending,
        each window's number among these, its document and the smallest document of each name."""
        doc_ids = ids(table["doc_id"])
        spots, owner, high, low = [], [], [], []
        for lo, hi, data, off in texts(table):
            w = _Windows(data, off, window)
            value = w.least[w.run]
            ok = np.ones(len(value), bool)
            for row in range(depth):
                ok[ok] = sketch.among(cells[row], sketch.cells(value[ok], row))
            which = np.flatnonzero(np.repeat(ok, np.diff(np.append(w.run, len(w.at)))))
            h, l_ = w.keys(which)
            spots.append((lo, hi, w.at[which]))
            owner.append(doc_ids[lo + w.doc[which]])
            high.append(h)
            low.append(l_)
        owner, high, low = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((owner, np.int64), (high, np.uint64), (low, np.uint32)))
        order = np.lexsort((low, high))
        first = runs(high[order], low[order])
        name = np.empty(len(order), np.int64)
        name[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        least = np.minimum.reduceat(owner[order], first) if len(first) else owner[:0]
        return spots, owner, name, high[order][first], low[order][first], least

    def shard_edges(high):
        return np.searchsorted((high >> np.uint64(64 - exact_bits)).astype(np.int64), np.arange(shards + 1))

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return answers([])
        block = left["block"][0].as_py()
        _, _, _, high, low, least = suspects(in_order(opened(left)), flagged(right, depth))
        edge, rows = shard_edges(high), []
        for s in np.flatnonzero(np.diff(edge)):
            c = slice(edge[s], edge[s + 1])
            parts = [pack_sorted(high[c]), pack_ints(low[c]), pack_ints(least[c])]
            rows.append((block, _EXACT, int(s), b"".join(len(p).to_bytes(8, "little") + p for p in parts)))
        return answers(rows)

    def group(table: pa.Table) -> pa.Table:
        """Whether a smaller document has the window than any that the block has."""
        high, low, least, size = [], [], [], []
        for p in table["payload"].to_pylist():
            parts, at = [], 0
            for _ in range(3):
                n = int.from_bytes(p[at : at + 8], "little")
                parts.append(p[at + 8 : at + 8 + n])
                at += 8 + n
            high.append(unpack_sorted(parts[0]))
            low.append(unpack_ints(parts[1], np.uint32))
            least.append(unpack_ints(parts[2], np.int64))
            size.append(len(high[-1]))
        h, l_, d = np.concatenate(high), np.concatenate(low), np.concatenate(least)
        order = np.lexsort((l_, h))
        first = runs(h[order], l_[order])
        best = np.empty(len(order), np.int64)
        best[order] = np.repeat(np.minimum.reduceat(d[order], first), np.diff(np.append(first, len(order))))
        smaller, at, out = best < d, np.cumsum([0, *size]), []
        for i, (block, shard) in enumerate(zip(table["block"].to_pylist(), table["shard"].to_pylist())):
            out.append((block, _EXACT, shard, bits_of(smaller[at[i] : at[i + 1]])))
        return answers(out)

    schema = T.StructType([f for f in docs.schema.fields] + [T.StructField("dedup_words", T.LongType()), T.StructField("dedup_removed", T.LongType()), T.StructField("dedup_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    arrow = to_arrow_schema(schema)

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return arrow.empty_table()
        table = in_order(opened(left))
        spots, owner, name, high, _, least = suspects(table, flagged(right, depth))
        smaller = np.zeros(len(high), bool)
        edge = shard_edges(high)
        for s, payload in read_answers(right, _EXACT):
            smaller[edge[s] : edge[s + 1]] = flags_of(payload)
        gone = smaller[name] | (owner != least[name])
        kept_text, n_words, n_removed, spans, at = [], [], [], [], 0
        originals = table["text"].combine_chunks() if keep_layout else None
        for (lo, hi, start), (_, _, data, off) in zip(spots, texts(table)):
            w = Words(data, off)
            hit = start[gone[at : at + len(start)]]
            at += len(start)
            step = np.zeros(len(w) + 1, np.int64)
            np.add.at(step, hit, 1)
            np.add.at(step, hit + window, -1)
            drop = np.cumsum(step[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(drop)))
            lost = total[w.first[1:]] - total[w.first[:-1]]
            size = w.length + 1
            text = w.norm[np.repeat(~drop, size)].tobytes()
            ends = np.concatenate(([0], np.cumsum(np.where(drop, 0, size))))[w.first]
            for d in range(hi - lo):
                if keep_layout and not lost[d]:
                    kept_text.append(originals[lo + d].as_py())
                    spans.append([])
                    continue
                kept_text.append(text[ends[d] : max(ends[d], ends[d + 1] - 1)].decode())
                if lost[d]:
                    mine = drop[w.first[d] : w.first[d + 1]].astype(np.int8)
                    edges = np.flatnonzero(np.diff(mine, prepend=0, append=0))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
                else:
                    spans.append([])
            n_words.append(np.diff(w.first))
            n_removed.append(lost)
        cols = {c: table[c] for c in own}
        cols["text"] = pa.array(kept_text, pa.string())
        cols |= {"dedup_words": pa.array(np.concatenate(n_words), pa.int64()), "dedup_removed": pa.array(np.concatenate(n_removed), pa.int64()), "dedup_spans": pa.array(spans, arrow.field("dedup_spans").type)}
        return pa.table([cols[f.name].cast(f.type) for f in arrow], schema=arrow)

    cells = repeated(docs, items, sketch, parts=PARTS)
    blocks = tagged(docs, PARTS)
    asked = tagged(docs.select("doc_id", "text"), PARTS).groupBy("block").cogroup(cells.groupBy("block")).applyInArrow(ask, ANSWER)
    told = asked.groupBy("shard").applyInArrow(group, ANSWER)
    return blocks.groupBy("block").cogroup(cells.unionByName(told).groupBy("block")).applyInArrow(apply, schema)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract columns for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", F.col("dedup_words").alias("n_words"), F.col("dedup_removed").alias("n_removed"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP8_SQL = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
g as (select doc_id, i, list_slice(w, i, i + 12) as v from d, unnest(range(1, len(w) - 11)) t(i)),
f as (select v, min(doc_id) as first from g group by v having min(doc_id) < max(doc_id)),
c as (select distinct doc_id, i + k as i from g join f using (v), range(0, 13) r(k) where g.doc_id > f.first),
x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from d),
k as (select x.doc_id, count(*) as n_words, count(c.i) as n_removed, string_agg(word, ' ' order by i) filter (c.i is null) as kept from x left join c using (doc_id, i) group by x.doc_id)
select doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""
