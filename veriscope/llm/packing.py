"""Packing documents into fixed-length token sequences, online and with bounded space."""

from __future__ import annotations

import bisect
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Words, chunks, scratch_path, strings

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean, group int"
#: Words, or runs of letters or marks in them, that a Python worker keeps encoded, for its next tasks, too.
CACHE = 400_000
# The normalizer and the splits of tokenizers whose runs of letters and marks the model may take directly.
DIRECT = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
# Plain words are letters that one lower-case rule and no composition touches, then marks that make one token run: the bytes of
# ASCII letters and of the marks, and what may follow 0xC3 in the letters from À to ÿ.
LETTER, MARK, LATIN = np.zeros((3, 256), bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = True
MARK[list(b".,;:!?|*#%&$()")] = True
LATIN[[i for i in range(0x80, 0xC0) if i not in (0x97, 0xB7)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _byte_letters() -> list[str]:
    """The letters by which byte-level models name the 256 bytes: printable ones name themselves, the others follow."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Plain words as lower-case runs of letters and of marks, other words as they are: (bytes, where each unit begins, which
    units are plain, where each word's units begin)."""
    data, n = words.solid, len(words)
    first = np.cumsum(words.length) - words.length
    mark, letter = MARK[data], LETTER[data]
    two = np.flatnonzero(data[:-1] == 0xC3) + 1
    two = two[LATIN[data[two]]]
    letter[two] = True
    # A letter after a mark, and bytes that are neither, make a word odd; so does half a letter.
    wrong = ~(mark | letter)
    turn = letter[1:] & mark[:-1]
    turn[first[1:] - 1] = False
    wrong[1:] |= turn
    odd = np.zeros(n, bool)
    odd[np.searchsorted(first, np.flatnonzero(wrong), "right") - 1] = True
    begins = np.zeros(len(data), bool)
    begins[1:] = mark[1:] & letter[:-1]
    out = LOWER[data]
    high = two[(data[two] < 0x9F) & (data[two] != 0x97)]
    out[high] += 0x20
    for w in np.flatnonzero(odd):
        own = slice(first[w], first[w] + words.length[w])
        begins[own], out[own] = False, data[own]
    begins[first] = True
    at = np.flatnonzero(begins)
    begin = np.searchsorted(at, first)
    plain = np.ones(len(at), bool)
    plain[begin[odd]] = False
    return out, at, plain, begin


class _Encoder:
    """Token ids of words, by a tokenizer that drops white space, so that no token spans two words.

    If the file states the rules of ``DIRECT``, words fall into runs of letters and of marks, which the model encodes alone.
    Under any other rules each word goes through the whole tokenizer. Runs and words are encoded once per worker while they
    fit its cache. ``whole`` is for tokenizers that look across white space: each text is then encoded by itself.
    """

    def __init__(self, path: str, whole: bool):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.whole = Tokenizer.from_file(path), whole
        self.letters, self.model = _byte_letters(), self.tokenizer.model
        self.known: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        self.direct = all(stated.get(k) == v for k, v in DIRECT.items())

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(i)}I", *i) for i in (e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))]

    def units(self, units: list[str], plain: np.ndarray) -> list[bytes]:
        """Little-endian ids of each unit; plain ones are of letters or marks alone, which the model takes as they are."""
        known, letters, tokens, odd = self.known, self.letters, self.model.tokenize, []
        out = list(map(known.get, units))
        new = [i for i, own in enumerate(out) if own is None]
        if len(known) + len(new) > CACHE:
            known.clear()
        for i, p in zip(new, plain[new].tolist()):
            if p:
                u = units[i]
                ids = [t.id for t in tokens(u if u.isascii() else "".join([letters[b] for b in u.encode()]))]
                known[u] = out[i] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                odd.append(i)
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            for i, own in zip(part, self._encoded([units[i] for i in part])):
                known[units[i]] = out[i] = own
        return out

    def words(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of each word."""
        ids, ends = self.documents(pa.array(words, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]

    def documents(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts, and where each begins."""
        data, off = strings(arr)
        if self.whole:
            ids = self.texts([data[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:])])
            ends = np.cumsum([0, *map(len, ids)])
            return np.concatenate([np.zeros(0, np.uint32), *ids]), ends
        words = Words(data, off)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        if self.direct:
            solid, at, plain, begin = _units(words)
        else:
            solid, at = np.ascontiguousarray(words.solid), np.cumsum(words.length) - words.length
            plain, begin = np.zeros(len(at), bool), np.arange(len(at))
        bounds = np.append(at, len(solid))
        column = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(solid))
        coded = column.dictionary_encode()
        codes = coded.indices.to_numpy()
        simple = np.zeros(len(coded.dictionary), bool)
        simple[codes[plain]] = True
        each = self.units(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), simple)
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        flat, where = np.frombuffer(b"".join(each), np.uint32), np.cumsum(size) - size
        n = size[codes]
        ends = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.arange(ends[-1]) + np.repeat(where[codes] - ends[:-1], n)]
        return ids, ends[np.append(begin, len(at))[words.first]]


#: A worker's encoders, which serve one task after another.
_ENCODERS: dict[tuple[str, bool], _Encoder | None] = {}


class Windows:
    """A fixed number of open windows. A piece goes to the window that it fills best; where it fits none, the fullest
    is closed, filled up from the piece if at least ``cut`` tokens fit there."""

    def __init__(self, size: int, many: int, cut: int):
        self.size, self.many, self.cut = size, many, cut
        self.free: list[tuple[int, int]] = []  # (room, key), ascending
        self.held: dict[int, list] = {}
        self.next = 0

    def _place(self, room: int, key: int, piece, n: int):
        self.held[key].append(piece)
        if room == n:
            return self.held.pop(key)
        bisect.insort(self.free, (room - n, key))
        return None

    def add(self, tag, start: int, length: int) -> Iterator[list]:
        """Take tokens ``start`` to ``start + length`` of a document; yield the windows that this closes."""
        while length >= self.size:
            yield [(tag, start, self.size)]
            start, length = start + self.size, length - self.size
        while length:
            at = bisect.bisect_left(self.free, (length, -1))
            if at < len(self.free):
                room, key = self.free.pop(at)
                if (done := self._place(room, key, (tag, start, length), length)) is not None:
                    yield done
                return
            if len(self.free) < self.many:
                self.held[self.next] = [(tag, start, length)]
                bisect.insort(self.free, (self.size - length, self.next))
                self.next += 1
                return
            room, key = self.free.pop(0)
            if room >= self.cut:
                self.held[key].append((tag, start, room))
                start, length = start + room, length - room
            yield self.held.pop(key)

    def rest(self) -> list[list]:
        out, self.held, self.free = list(self.held.values()), {}, []
        return out


def _columns(rows: list[tuple], open_: bool, group: int) -> pa.RecordBatch:
    doc, start, length, ids, total, seq, offset = zip(*rows) if rows else ((),) * 7
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(seq, pa.int64()), pa.array(offset, pa.int64()), pa.array([open_] * n, pa.bool_()), pa.array([group] * n, pa.int32())],
        ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open", "group"],
    )


class _Writer:
    """Rows of closed windows; ids of sequences are the task's number and a count."""

    def __init__(self, high: int):
        self.high, self.count = high, 0

    def rows(self, window: list, number: int | None = None) -> list[tuple]:
        seq, offset, out = (self.high << 32) + self.count, 0, []
        self.count += 1
        for (doc, base, ids, total), start, length in window:
            out.append((doc, base + start, length, ids[start : start + length].tobytes(), total, seq, offset))
            offset += length
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, open_windows: int = 32, cut: int = 16, whole_texts: bool = False, merge: int = 64) -> DataFrame:
    """Pack every document into sequences of at most ``size`` tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A document is its text's ids and ``end_id``; a
    null or empty text is ``end_id`` alone; repeated rows are packed once each. Each partition keeps ``open_windows``
    windows (best fit; the fullest is emitted when none fits), so memory does not grow with the partition. The windows
    left open by up to ``merge`` partitions are then packed together in the same way, and only the windows that remain
    there are short. ``cut`` is the least room worth cutting a document for.

    An empty table gives no rows; a very long text is encoded whole and cut wherever windows end; columns of any other
    names change nothing.

    ``tokenizer`` is a file of the ``tokenizers`` library. Unless ``whole_texts``, it must not join tokens across white
    space; words are then encoded once and reused.

    Returns one row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id,
    offset. The pieces are written to the session's shared folder once, as their texts cost more to encode than to keep.
    """
    spark = docs.sparkSession

    def place(batches):
        task = TaskContext.get().partitionId()
        encoder = _ENCODERS.setdefault((tokenizer, whole_texts), None) or _Encoder(tokenizer, whole_texts)
        _ENCODERS[tokenizer, whole_texts] = encoder
        windows, writer = Windows(size, open_windows, cut), _Writer(task)
        for b in batches:
            off, keys = strings(b.column("text"))[1], b.column("doc_id").to_pylist()
            for lo, hi in chunks(off, 2 << 20):
                ids, begin = encoder.documents(b.column("text").slice(lo, hi - lo))
                rows = []
                for d in range(hi - lo):
                    own = np.append(ids[begin[d] : begin[d + 1]], np.uint32(end_id))
                    for done in windows.add((keys[lo + d], 0, own, len(own)), 0, len(own)):
                        rows += writer.rows(done)
                    if len(rows) > 500:
                        yield _columns(rows, False, 0)
                        rows = []
                yield _columns(rows, False, 0)
        for left in windows.rest():
            yield _columns(writer.rows(left), True, task // merge)

    def again(table: pa.Table) -> pa.Table:
        group = table["group"][0].as_py()
        windows, writer = Windows(size, open_windows, 1), _Writer((1 << 30) + group)
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        rows = []
        for doc, start, length, ids, total in zip(*(table[c].to_pylist() for c in ("doc_id", "start", "length", "ids", "doc_tokens"))):
            for done in windows.add((doc, start, np.frombuffer(ids, np.uint32), total), 0, length):
                rows += writer.rows(done)
        # What is still open is joined up: only the last sequence of the group is short.
        last = Windows(size, 1, 1)
        for left in sorted(windows.rest(), key=lambda w: -sum(p[2] for p in w)):
            for tag, start, length in left:
                for done in last.add(tag, start, length):
                    rows += writer.rows(done)
        for left in last.rest():
            rows += writer.rows(left)
        return pa.Table.from_batches([_columns(rows, False, group)])

    path = scratch_path(spark, "packed")
    docs.select("doc_id", "text").mapInArrow(place, PIECES).write.option("compression", "zstd").partitionBy("open").parquet(path)
    out = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    names = [f.strip().split()[0] for f in PIECES.split(",")]
    pieces = spark.read.schema(PIECES).parquet(path)
    closed = pieces.where(~F.col("open")).select(*out)
    merged = pieces.where(F.col("open")).select(*names).groupBy("group").applyInArrow(again, PIECES)
    return closed.unionByName(merged.select(*out))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """Contract columns of the packing of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
