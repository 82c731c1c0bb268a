"""Documents whose shingle sets overlap: a grouped prefix join, its links verified exactly, and their components.

Shingles that stand in one document only can't be shared. What is left of a set, and how many such shingles it had, decides
all its links; sets alike in both are one vertex. The rarest shared shingles that a linked set must hold, its prefix, are
the keys of the join. Vertices with equal prefixes and sizes are one group; pairs of groups are filtered by length and
position, then expanded to their members. Links are found in two turns, so that a dense group isn't taken apart into all
its pairs: first every member is held against its list's leader; then only vertices that are still in different
components meet.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import ANSWER, answers, ids, opened, read_answers, scanned, shard_bits, tagged, texts
from .shared import WORD, Words, cut_lineage, mix, pack_ints, pack_sorted, runs, scratch_path, strings, unpack_ints, unpack_sorted, window_hashes, window_rows, word_hashes
from .simhash import _lowered

#: Blocks that a partition's documents make.
PARTS = 4
#: Bits of a vertex's parity map, by which most pairs that are no links are told before their sets are fetched.
MAP = 256
#: Groups of a list that a task holds against the list's stragglers; longer lists are dealt into parts.
LIST = 2048
_SETS = "doc_id long, n int, single int, hi long, lo long, rest array<long>, bits array<long>"


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each text, ascending; those of text d are ``first[d]`` to ``first[d + 1]``."""
    w = Words(_lowered(data), off)
    h = word_hashes(w, 51)
    at, doc = window_rows(w.first, k)
    values, docs = [window_hashes(h, k, 52)[at]], [doc]
    n = np.diff(w.first)
    for few in range(1, k):
        short = np.flatnonzero(n == few)
        values.append(window_hashes(h, few, 52 + few)[w.first[short]] if len(short) else np.zeros(0, np.uint64))
        docs.append(short)
    value, doc = np.concatenate(values), np.concatenate(docs)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    one = runs(doc, value)
    value, doc = value[one], doc[one]
    return value, np.searchsorted(doc, np.arange(len(off)))


def _least(n, num: int, den: int):
    """The smallest overlap that a set of ``n`` has with any set that it links to."""
    return -(-n * num // den)


class _Counter:
    """In how many documents each hash occurs, by cells of ``width`` bits: never too few, and with a thousand cells for a
    hash seldom too many. Where a count is too high, a shingle comes later in the order or is taken for a shared one,
    which costs time and changes no result."""

    def __init__(self, docs: DataFrame, k: int):
        # The plan's statistics bound the size of the texts: files are compressed some four times at most.
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        self.width = min(62, max(24, (1000 * size).bit_length()))
        self.bits = min(shard_bits(docs.sparkSession), self.width)
        self.k = k

    def cells(self, values: np.ndarray) -> np.ndarray:
        return values >> np.uint64(64 - self.width)

    def edges(self, cells: np.ndarray) -> np.ndarray:
        return np.searchsorted((cells >> np.uint64(self.width - self.bits)).astype(np.int64), np.arange((1 << self.bits) + 1))

    def asked(self, docs: DataFrame) -> DataFrame:
        """For each block and shard the cells and in how many documents of the block they are."""

        def run(batches):
            first = TaskContext.get().partitionId() * PARTS
            held: list[list[np.ndarray]] = [[] for _ in range(PARTS)]
            for b in batches:
                known, part = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False), ids(b.column("doc_id")) % PARTS
                for lo, hi, data, off in texts(b):
                    value, start = shingle_sets(data, off, self.k)
                    of = np.repeat(np.where(known, part, -1)[lo:hi], np.diff(start))
                    for i in range(PARTS):
                        held[i].append(self.cells(value[of == i]))
            for i, own in enumerate(held):
                cells, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64),) * 2
                own.clear()
                edge, rows = self.edges(cells), []
                for s in np.flatnonzero(np.diff(edge)):
                    c = slice(edge[s], edge[s + 1])
                    packed = pack_sorted(cells[c])
                    rows.append((first + i, 0, int(s), len(packed).to_bytes(8, "little") + packed + pack_ints(np.minimum(n[c], 65535).astype(np.uint16))))
                for lo in range(0, len(rows), 64):
                    yield from answers(rows[lo : lo + 64]).to_batches()

        return docs.mapInArrow(run, ANSWER)

    @staticmethod
    def told(table: pa.Table) -> pa.Table:
        """Each block's cells' places in the order of frequency: 0 for one document, then eight steps for each doubling."""
        cells, n = [], []
        for p in table["payload"].to_pylist():
            size = int.from_bytes(p[:8], "little")
            cells.append(unpack_sorted(p[8 : 8 + size]))
            n.append(unpack_ints(p[8 + size :], np.uint16).astype(np.int64))
        every, total = np.concatenate(cells), np.concatenate(n)
        order = np.argsort(every)
        first = runs(every[order])
        total = np.add.reduceat(total[order], first)
        code = np.empty(len(every), np.uint8)
        step = np.where(total == 1, 0, np.minimum(255, 1 + (8 * np.log2(np.maximum(total, 2) / 2)).astype(np.int64)))
        code[order] = np.repeat(step, np.diff(np.append(first, len(every)))).astype(np.uint8)
        at = np.cumsum([0, *map(len, cells)])
        return answers([(b, 0, s, pack_ints(code[at[i] : at[i + 1]])) for i, (b, s) in enumerate(zip(table["block"].to_pylist(), table["shard"].to_pylist()))])


def _lists(values: np.ndarray, start: np.ndarray, on: np.ndarray) -> pa.Array:
    """A list a row, null where ``on`` is not set; ``values`` has the rows' values in turn."""
    return pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(values.view(np.int64)), mask=pa.array(~on))


def document_sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``doc_id`` and ``n`` (distinct shingles) of every document. Those that may have links also have ``single`` (shingles
    of no other document), ``rest`` (the hashes of the others, rarest first), ``bits`` (parities of ``rest``), and
    ``hi`` and ``lo``, 128 bits that name ``rest`` and ``single``."""
    docs = scanned(docs.select("doc_id", "text"))
    counter = _Counter(docs, k)

    def order(left: pa.Table, right: pa.Table) -> pa.Table:
        table, out = opened(left) if len(left) else pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), []
        known = table["doc_id"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        sets = [(lo, hi, *shingle_sets(data, off, k)) for lo, hi, data, off in texts(table)]
        cells = [counter.cells(value[np.repeat(known[lo:hi], np.diff(start))]) for lo, hi, value, start in sets]
        cells = np.unique(np.concatenate(cells)) if cells else np.zeros(0, np.uint64)
        codes = [unpack_ints(p, np.uint8) for _, p in read_answers(right, 0)]
        codes = np.concatenate(codes) if codes else np.zeros(0, np.uint8)
        for lo, hi, value, start in sets:
            n = np.diff(start)
            doc = np.repeat(np.arange(hi - lo), n)
            on = known[lo:hi][doc]
            value, doc = value[on], doc[on]
            code = codes[np.searchsorted(cells, counter.cells(value))]
            single = np.bincount(doc[code == 0], minlength=hi - lo)
            may = known[lo:hi] & (n > 0) & (single <= n - _least(n, num, den))
            shared = may[doc] & (code > 0)
            value, doc, code = value[shared], doc[shared], code[shared]
            by = np.lexsort((value, code, doc))
            value, first = value[by], np.searchsorted(doc, np.arange(hi - lo + 1))
            begin = first[:-1][may]
            names = []
            for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                total = np.zeros(hi - lo, np.uint64)
                total[may] = mix(np.add.reduceat(mix(value ^ np.uint64(seed)), begin) + single[may].astype(np.uint64)) if len(begin) else 0
                names.append(pa.array(total.view(np.int64), mask=~may))
            odd = np.bincount(doc * MAP + (value % np.uint64(MAP)).astype(np.int64), minlength=(hi - lo) * MAP).reshape(-1, MAP) & 1
            bits = np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8").ravel()
            width = MAP // 64
            out.append(pa.table([table["doc_id"].slice(lo, hi - lo).combine_chunks(), pa.array(n, pa.int32()), pa.array(single, pa.int32()), *names, _lists(value, first, may), _lists(bits, np.arange(hi - lo + 1) * width, may)], names=["doc_id", "n", "single", "hi", "lo", "rest", "bits"]))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n": pa.array([], pa.int32()), "single": pa.array([], pa.int32()), "hi": pa.array([], pa.int64()), "lo": pa.array([], pa.int64()), "rest": pa.array([], pa.list_(pa.int64())), "bits": pa.array([], pa.list_(pa.int64()))})

    told = counter.asked(docs).groupBy("shard").applyInArrow(counter.told, ANSWER)
    return tagged(docs, PARTS).groupBy("block").cogroup(told.groupBy("block")).applyInArrow(order, _SETS)


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: several steps read columns of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Join:
    """The two turns over vertices (vid, label, copies, n, single, rest, bits, gid) for overlap / union >= num / den."""

    def __init__(self, vertices: DataFrame, num: int, den: int):
        self.vertices, self.num, self.den = vertices, num, den
        prefix = (F.col("n") - F.ceil(F.col("n") * num / den) + 1 - F.col("single")).cast("int")
        # A group is named by 64 bits; should two share a name, members of both are verified, and none is lost.
        groups = vertices.groupBy("gid", "n", "single", F.slice("rest", F.lit(1), prefix).alias("prefix")).agg(F.min(F.struct((-F.col("copies")).alias("copies"), F.col("vid").alias("rep"))).alias("first"), F.count("*").alias("members"))
        self.groups = cut_lineage(groups.select("gid", "n", "single", "prefix", "first.copies", "first.rep", "members"))
        self.index = self.groups.select("gid", "n", "single", "copies", "rep", F.posexplode("prefix").alias("i", "token")).withColumn("place", F.col("single") + F.col("i"))

    def may(self, n: str, m: str, overlap: Column) -> Column:
        """Whether an overlap is enough for sets of n and m."""
        return overlap * (self.num + self.den) >= (F.col(n) + F.col(m)) * self.num

    def near(self, a: str, b: str) -> Column:
        """The most that two vertices can share, by size, unshared shingles and parity maps."""
        apart = sum(F.bit_count(F.element_at(f"{a}bits", i + 1).bitwiseXOR(F.element_at(f"{b}bits", i + 1))) for i in range(MAP // 64))
        return self.may(f"{a}n", f"{b}n", (F.col(f"{a}n") + F.col(f"{b}n") - apart - F.col(f"{a}single") - F.col(f"{b}single")) / 2)

    def side(self, mark: str, *columns: str) -> DataFrame:
        return self.vertices.select(F.col("vid").alias(mark), *[F.col(c).alias(f"{mark}_{c}") for c in columns])

    def verified(self, pairs: DataFrame, told: bool = False) -> DataFrame:
        """Those of ``pairs`` (a, b) that are links."""
        light = ("n", "single", "bits")
        if not told:
            pairs = pairs.join(self.side("a", *light), "a").join(self.side("b", *light), "b").where(self.near("a_", "b_")).select("a", "b")
        both = pairs.join(self.side("b", "n", "rest"), "b").join(self.side("a", "n", "rest"), "a")
        return both.where(self.may("a_n", "b_n", F.size(F.array_intersect("a_rest", "b_rest")))).select("a", "b")

    def leaders(self) -> DataFrame:
        """First turn: links of vertices to the leader of their list, which has the fewest unshared shingles and the most
        copies among the groups of like size, and to their group's first. One pair a vertex and leader."""
        like = F.floor(F.log(F.col("n").cast("double")) / math.log(self.den / self.num)) if self.num < self.den else F.col("n")
        index = self.index.withColumn("like", like)
        lead = index.groupBy("token", "like").agg(F.min(F.struct("single", "copies", "gid", "rep", "n")).alias("lead"), F.count("*").alias("m")).where("m > 1").select("token", "like", "lead")
        met = index.join(lead, ["token", "like"]).where(F.col("lead.gid") != F.col("gid")).where(self.may("n", "lead.n", F.least("n", "lead.n"))).select(F.col("lead.rep").alias("a"), "gid")
        own = self.groups.where("members > 1").select(F.col("rep").alias("a"), "gid")
        pairs = met.unionByName(own).distinct().join(self.vertices.select("gid", F.col("vid").alias("b")), "gid").where("a <> b").select("a", "b")
        return cut_lineage(self.verified(pairs))

    def stragglers(self, found: DataFrame) -> DataFrame:
        """Second turn: links between vertices of different components, ``found`` (node, root). In each list whose groups
        are not all of one component, those outside its largest component meet all others; pairs of groups are filtered
        by length and position, then expanded to their members in these components."""
        members = self.vertices.select("vid", "gid", "n", "single", "bits").join(found.select(F.col("node").alias("vid"), "root"), "vid", "left")
        members = _kept(members.select("vid", "gid", "n", "single", "bits", F.coalesce("root", "vid").alias("comp")), "members")
        units = self.index.select("gid", "token", "n", "place").join(members.select("gid", "comp").distinct(), "gid")
        by = units.groupBy("token", "comp").agg(F.count("*").alias("c"))
        lists = by.groupBy("token").agg(F.max(F.struct("c", "comp")).alias("most"), F.count("*").alias("comps"), F.sum("c").alias("m")).where("comps > 1")
        lists = lists.select("token", F.col("most.comp").alias("most"), F.ceil(F.col("m") / LIST).cast("int").alias("parts"))
        still = _kept(units.join(lists, "token"), "lists")
        if still.isEmpty():
            return self.vertices.select(F.col("vid").alias("a"), F.col("vid").alias("b")).limit(0)
        x = still.where("comp <> most").select("token", *[F.col(c).alias(f"x_{c}") for c in ("gid", "comp", "n", "place")], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        y = still.select("token", "most", *[F.col(c).alias(f"y_{c}") for c in ("gid", "comp", "n", "place")], F.pmod(F.xxhash64("gid", "comp"), F.col("parts")).cast("int").alias("part"))
        once = (F.col("y_comp") == F.col("most")) | (F.col("x_comp") < F.col("y_comp"))
        rest = F.least(F.col("x_n") - F.col("x_place"), F.col("y_n") - F.col("y_place"))
        met = x.join(y, ["token", "part"]).where(F.col("x_comp") != F.col("y_comp")).where(once).where(self.may("x_n", "y_n", rest)).select("x_gid", "x_comp", "y_gid", "y_comp").distinct()
        of = lambda mark: members.select(F.col("vid").alias(f"{mark}_vid"), *[F.col(c).alias(f"{mark}_{c}") for c in ("gid", "comp", "n", "single", "bits")])
        pairs = met.join(of("x"), ["x_gid", "x_comp"]).join(of("y"), ["y_gid", "y_comp"]).where(self.near("x_", "y_"))
        return cut_lineage(self.verified(pairs.select(F.col("x_vid").alias("a"), F.col("y_vid").alias("b")).distinct(), told=True))


def jaccard_components(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (the smallest doc_id that links reach, itself included) of every row.

    Two rows link when ``den`` times the overlap of their sets is ``num`` times their union or more. A row's set has its
    distinct shingles of ``shingle`` words (between ASCII white space, A-Z lower-cased); with fewer words, all of them as
    one; texts without words, null or empty, have an empty set and link to nothing. Needs ``doc_id`` (long) and ``text``;
    other columns are ignored, whatever their names. Rows are judged one by one, so that rows that share a doc_id may lie in
    different components; those without a doc_id link nothing and have no component; an empty table gives no rows; long
    texts are taken whole. Shingles are named by 64 bits of a hash of their words.
    """
    if not 0 < num <= den:
        raise ValueError("num / den must be above 0 and 1 at most")
    sets = _kept(document_sets(docs, shingle, num, den), "sets")
    grouped = sets.where(F.col("hi").isNotNull()).groupBy("hi", "lo").agg(F.min("doc_id").alias("label"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "single", "rest", "bits")])
    prefix = (F.col("n") - F.ceil(F.col("n") * num / den) + 1 - F.col("single")).cast("int")
    vertices = _kept(grouped.select(F.monotonically_increasing_id().alias("vid"), "*", F.xxhash64("n", "single", F.slice("rest", F.lit(1), prefix)).alias("gid")), "vertices")
    join = _Join(vertices, num, den)
    links = join.leaders()
    more = join.stragglers(components(links))
    found = components(links.unionByName(more))
    linked = vertices.select("vid", "hi", "lo", "label").join(found.select(F.col("node").alias("vid"), "root"), "vid")
    least = linked.groupBy("root").agg(F.min("label").alias("component_id"))
    # Copies of a vertex without other links are linked if what they share is enough beside their own unshared shingles.
    alike = vertices.where("copies > 1").where(F.size("rest") * den >= (F.size("rest") + 2 * F.col("single")) * num)
    alone = alike.join(linked.select("vid"), "vid", "left_anti").select("hi", "lo", F.col("label").alias("component_id"))
    named = linked.join(least, "root").select("hi", "lo", "component_id").unionByName(alone)
    return sets.select("doc_id", "n", "hi", "lo").join(named, ["hi", "lo"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op12_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Contract columns for all documents."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, num=90)


OP12_SQL = f"""
with recursive
d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
s as (select distinct doc_id, case when len(w) < 3 then array_to_string(w, ' ') else w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] end as g
  from d, unnest(range(1, greatest(len(w) - 1, 2))) t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
f as (select s.*, n, row_number() over (partition by s.doc_id order by df, g) as p, n - (90 * n + 99) // 100 + 1 as most from s join (select g, count(*) as df from s group by g) using (g) join n using (doc_id)),
c as (select distinct a.doc_id as x, b.doc_id as y, a.n as nx, b.n as ny from f a join f b on a.g = b.g and a.doc_id < b.doc_id and a.p <= a.most and b.p <= b.most and 10 * a.n >= 9 * b.n and 10 * b.n >= 9 * a.n),
o as (select x, y, nx, ny, count(*) as k from c join s a on a.doc_id = x join s b on b.doc_id = y and a.g = b.g group by all),
e as (select x, y from o where 100 * k >= 90 * (nx + ny - k) union all select y, x from o where 100 * k >= 90 * (nx + ny - k)),
r as (select doc_id as a, doc_id as b from documents union select r.a, e.y from r join e on r.b = e.x)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, m as component_id from d left join n using (doc_id) join (select a, min(b) as m from r group by a) on a = d.doc_id
"""
