"""SimHash near-duplicates: fingerprints, vantage-point trees over them, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Words, chunks, cut_lineage, member, mix, strings

#: Fingerprints that a leaf holds on average, as far as the number of leaves allows.
LEAF = 512
#: Leaves of a tree at most; a tree takes one byte a leaf in every task. A value goes to no more leaves than it has
#: neighbours within one bit of the mask, itself among them: 22 or so, however many leaves there are.
MOST_LEAVES = 1 << 20
#: A fingerprint that more than one row in so many has is hot: its component is sent to every task.
HOT = 1000
#: Values of the sample that serve as vantage points, in turn.
POINTS = 4096
#: Leaders of a dense shard, about.
LEADERS = 128
#: The trees' thresholds are taken from one in so many fingerprints, drawn by hash, and from so many at most.
ONE_IN, SAMPLE = 8, 1 << 17


def _lowered(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    upper = (out >= 0x41) & (out <= 0x5A)
    out[upper] += 32
    return out


def _prints(data: np.ndarray, off: np.ndarray, shingle: int, seed: int, more: int = 0) -> np.ndarray:
    """The fingerprint of each text, and ``more`` others beside it, of the same hashes mixed."""
    import xxhash

    w = Words(_lowered(data), off)
    n = np.diff(w.first)
    many = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(np.int64))
    total = int(many.sum())
    out = np.zeros((1 + more, len(n)), np.uint64)
    if not total:
        return out
    begin = np.cumsum(many) - many
    first = np.arange(total) - np.repeat(begin, many) + np.repeat(w.first[:-1], many)
    last = first + np.repeat(np.minimum(n, shingle), many) - 1
    a, b = w.start[first].tolist(), (w.start + w.length)[last].tolist()
    text, digest = w.norm.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[i:j], seed) for i, j in zip(a, b)), np.uint64, total)
    used = np.flatnonzero(many)
    edge = np.append(begin[used], total)
    for i in range(1 + more):
        out[i] = _majority(mix(h ^ np.uint64((i - 1) * 0x9E3779B97F4A7C15 % 2**64)) if i else h, used, edge, many, len(n))
    return out


def _majority(h: np.ndarray, used: np.ndarray, edge: np.ndarray, many: np.ndarray, texts: int) -> np.ndarray:
    """The bits that more than half of each text's hashes have."""
    out = np.zeros(texts, np.uint64)
    # Bits are counted for some thousand shingles at a time.
    counts = np.zeros((len(used), 64), np.int64)
    lo = 0
    while lo < len(used):
        hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + 65536, "right")) - 1)
        for s in range(edge[lo], edge[hi], 1 << 18) if hi == lo + 1 else (edge[lo],):
            e = min(edge[hi], s + (1 << 18)) if hi == lo + 1 else edge[hi]
            bits = np.unpackbits(h[s:e].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            if hi == lo + 1:
                counts[lo] += bits.sum(0, dtype=np.int64)
            else:
                counts[lo:hi] = np.add.reduceat(bits, edge[lo:hi] - s, axis=0, dtype=np.int32)
        lo = hi
    over = 2 * counts > many[used][:, None]
    out[used] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def _names(more: int) -> list[str]:
    return ["fp", *("check" if i == 1 else f"check{i}" for i in range(1, more + 1))]


def fingerprints(docs: DataFrame, shingle: int = 5, seed: int = 42, more: int = 0) -> DataFrame:
    """``doc_id`` and ``fp`` (64 bits as a long) of every whole text: A-Z lower-cased, words between ASCII white space,
    shingles of ``shingle`` words with repeats, XXH64; a bit is set if more than half the hashes have it. Texts with fewer
    words are one shingle; those without words, null among them, have 0. ``more`` adds so many others of 64 bits: ``check``,
    ``check2`` and so on."""
    names = _names(more)

    def run(batches):
        for b in batches:
            data, off = strings(b.column("text"))
            for lo, hi in chunks(off):
                fp = _prints(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], shingle, seed, more)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *(pa.array(x.view(np.int64)) for x in fp)], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in names))


class Tree:
    """A vantage-point tree over the bits of one mask.

    Node i has a vantage point and a radius; values within the radius go to node 2i + 1, others to 2i + 2; the last level
    are leaves. Vantage points are values of the sample, another for each node; they follow from the node's number, so that
    only the radii are kept. A pair that differs by one bit of the mask at most can only be parted where a branch's border
    lies between the two distances, which the triangle inequality bounds: ``route`` follows those borders.
    """

    def __init__(self, mask: int, sample: np.ndarray, levels: int, seed: int):
        self.mask, self.levels, self.seed = np.uint64(mask), levels, np.uint64(seed << 32)
        self.points = np.unique(sample)[:: max(1, len(sample) // POINTS)] & self.mask
        self.radius = np.full((1 << levels) - 1, int(self.mask).bit_count() // 2, np.int8)
        at = np.zeros(len(sample), np.int64)
        for level in range(levels):
            first = (1 << level) - 1
            d = self._distance(sample, at)
            # The median distance of each node's sample.
            own, here = np.unique(at - first, return_inverse=True)
            hist = np.zeros((len(own), 66), np.int64)
            np.add.at(hist, (here, d), 1)
            total = np.cumsum(hist, axis=1)
            if len(own):
                middle = (total * 2 >= total[:, -1:]).argmax(1)
                # Of the two borders next to the median, the more even one.
                lower = np.maximum(middle - 1, 0)
                row = np.arange(len(own))
                uneven = lambda r: np.abs(2 * total[row, r] - total[:, -1])
                self.radius[first + own] = np.where(uneven(lower) < uneven(middle), lower, middle)
            at = 2 * at + 1 + (d > self.radius[at])

    def _distance(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.bitwise_count((x & self.mask) ^ self._point(node)).astype(np.int64)

    def _point(self, node: np.ndarray) -> np.ndarray:
        drawn = mix(node.astype(np.uint64) + self.seed)
        return self.points[drawn % np.uint64(len(self.points))] if len(self.points) else drawn & self.mask

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): the leaf of each value, and the other leaves in which a value may lie that differs from it by
        one bit of the mask. Of each path the bits are kept whose change leads there."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        home, bits = np.ones(len(x), bool), np.full(len(x), self.mask)
        for _ in range(self.levels):
            v, radius = x[row] & self.mask, self.radius[node]
            differ = v ^ self._point(node)
            d = np.bitwise_count(differ).astype(np.int64)
            # Changing a bit that agrees adds one to the distance, changing another takes one off.
            agree, differ = bits & ~differ, bits & differ
            near = np.where(d + 1 <= radius, agree, 0) | np.where(d - 1 <= radius, differ, 0)
            far = bits & ~near
            inside = d <= radius
            stay, leave = np.where(inside, near, far), np.where(inside, far, near)
            side = np.where(inside, 2 * node + 1, 2 * node + 2)
            other = np.where(inside, 2 * node + 2, 2 * node + 1)
            # The home path stays with the value itself; other paths go where they have a bit left.
            a, b = home | (stay != 0), leave != 0
            row = np.concatenate([row[a], row[b]])
            node = np.concatenate([side[a], other[b]])
            bits = np.concatenate([stay[a], leave[b]])
            home = np.concatenate([home[a], np.zeros(int(b.sum()), bool)])
        return row, node - ((1 << self.levels) - 1), home


def _spanning(h: np.ndarray, q: np.ndarray, near: int, check: tuple[np.ndarray, np.ndarray, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index in h, index in q) that tie together whatever ``near`` bits tie, without all pairs of a clump. ``check``
    has other fingerprints of both, a row each, and how many bits all of these may differ by."""
    got_a, got_b = [], []
    for lo in range(0, len(h), 256):
        rows = h[lo : lo + 256]
        for at in range(0, len(q), 1 << 14):
            hit = np.bitwise_count(rows[:, None] ^ q[None, at : at + (1 << 14)]) <= near
            some = np.flatnonzero(hit.any(0))
            if len(some) and check is not None:
                r, c = np.nonzero(hit[:, some])
                apart = sum(np.bitwise_count(a[lo + r] ^ b[at + some[c]]).astype(np.int64) for a, b in zip(check[0], check[1]))
                hit = np.zeros((len(rows), len(some)), bool)
                hit[r, c] = apart <= check[2]
                alive = hit.any(0)
                hit, some = hit[:, alive], some[alive]
            else:
                hit = hit[:, some]
            if not len(some):
                continue
            first = hit.argmax(0)
            got_a.append(first + lo)
            got_b.append(some + at)
            # A row is tied to the first rows of its other columns through one column each.
            r, c = np.nonzero(hit)
            other = first[c] != r
            if other.any():
                r, c = r[other], c[other]
                _, one = np.unique(r * 256 + first[c], return_index=True)
                got_a.append(r[one] + lo)
                got_b.append(some[c[one]] + at)
    return (np.concatenate(got_a), np.concatenate(got_b)) if got_a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few pairs as connect what the pairs (a, b) connect: each vertex with the least that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (apart := root[x] != root[y]).any():
        p, q = root[x[apart]], root[y[apart]]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while (root[root] != root).any():
            root = root[root]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _masks(near: int) -> list[int]:
    """Bits dealt to so many masks that two values within ``near`` bits differ by one bit at most in one of them."""
    n = near // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def links(prints: DataFrame, near: int = 4, second: int | None = None) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints that chains of links connect; a link is ``near`` bits or fewer.

    ``prints`` has distinct ``fp`` and a ``node`` for each; with ``second``, distinct rows of ``fp`` and columns ``check...``,
    and a link's ``check...`` differ by ``second`` bits or fewer in all, too. The 64 bits are dealt to ``near // 2 + 1``
    masks; two linked values differ by one bit at most in one mask, so for each mask a vantage-point tree puts every value
    into its leaf, a shard, and sends it to those other shards whose border it may lie across. Each shard compares its own
    values with all it gets, in 64 bits. Thresholds come from a sample drawn by hash (one in ``ONE_IN``, ``SAMPLE`` at
    most); all values are routed. A value visits no more shards of a mask than it has values within one bit there, which
    bounds what is sent at any size.

    Shards of more than 8 times ``LEAF`` values are dealt out in parts, and found out in two turns, so that a dense group
    makes no pairs of all its values. First each part's values are held against some ``LEADERS`` of the shard, which ties
    most of a dense group into one component. Then, whatever is not of the shard's largest component visits all parts; what
    is of it stays in one. Values that stay apart from it, however near, are all compared.
    """
    spark = prints.sparkSession
    total = prints.count()
    levels = min(max(0, (total // LEAF).bit_length()), MOST_LEAVES.bit_length() - 1)
    share = min(1 / ONE_IN, 0.9 * SAMPLE / max(total, 1))
    drawn = prints.where(F.shiftrightunsigned(F.xxhash64("fp"), 1) <= int(share * (2**63 - 1)))
    sample = np.array([r["fp"] for r in drawn.select("fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    trees = [Tree(m, sample, levels, i + 1) for i, m in enumerate(_masks(near))]

    def routed(b):
        fp = b.column("fp").to_numpy().view(np.uint64)
        for t, tree in enumerate(trees):
            row, leaf, home = tree.route(fp)
            yield t, row, (t << levels) + leaf, home

    def census(batches):
        n = np.zeros(len(trees) << levels, np.int64)
        for b in batches:
            for _, _, shard, home in routed(b):
                n += np.bincount(shard[home], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["shard", "n"])

    part = 8 * LEAF
    sizes = {r["shard"]: r["n"] for r in prints.mapInArrow(census, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > part).collect()}
    large = np.array(sorted(sizes), np.int64)
    many = np.array([-(-sizes[s] // part) for s in large.tolist()], np.int64)
    # The leaders of a shard of n values are those whose hash is below LEADERS / n of all.
    below = np.array([min(2**64 - 1, LEADERS * 2**64 // sizes[s]) for s in large.tolist()], np.uint64)
    checks = [c for c in prints.columns if c.startswith("check")] if second is not None else []
    names = ["fp", "node", *checks]
    schema = "shard int, part int, own boolean, visit boolean, " + ", ".join(f"{c} long" for c in names)

    def dealt(b, cols, shard, row, own_of, visits, pieces):
        """Rows of some routes: each goes to its own part if ``own_of``, and as a visitor to all parts if ``visits``."""
        n = np.where(visits, pieces, own_of.astype(np.int64))
        at = np.repeat(np.arange(len(row)), n)
        mine = (mix(cols[0].view(np.uint64))[row] % pieces.astype(np.uint64)).astype(np.int64)
        piece = np.where(visits[at], np.arange(len(at)) - np.searchsorted(at, at), mine[at])
        own = own_of[at] & (piece == mine[at])
        for lo in range(0, len(at), 1 << 17):
            c = slice(lo, lo + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(shard[at[c]], pa.int32()), pa.array(piece[c], pa.int32()), pa.array(own[c]), pa.array(visits[at[c]]), *(pa.array(x[row[at[c]]]) for x in cols)], ["shard", "part", "own", "visit", *names])

    def to_leaders(batches):
        for b in batches:
            cols = [b.column(c).to_numpy() for c in names]
            hashes = mix(cols[0].view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93))
            for _, row, shard, home in routed(b):
                on = home & member(large, shard)
                row, shard = row[on], shard[on]
                spot = np.searchsorted(large, shard)
                yield from dealt(b, cols, shard, row, np.ones(len(row), bool), hashes[row] < below[spot], many[spot])

    def compare(table: pa.Table) -> pa.Table:
        order = np.argsort(table["node"].to_numpy(), kind="stable")
        fp, node, own, visit = (table[c].to_numpy()[order] for c in ("fp", "node", "own", "visit"))
        fp = fp.view(np.uint64)
        other = np.stack([table[c].to_numpy().view(np.uint64)[order] for c in checks]) if checks else None
        a, b = _spanning(fp[own], fp[visit], near, None if other is None else (other[:, own], other[:, visit], second))
        a, b = _forest(node[own][a], node[visit][b])
        return pa.table({"a": a, "b": b})

    def met(df: DataFrame, f) -> DataFrame:
        return df.mapInArrow(f, schema).groupBy("shard", "part").applyInArrow(compare, "a long, b long").distinct()

    first, base, most = None, prints.select(*names), np.zeros(0, np.int64)
    if len(large):
        first = cut_lineage(met(base, to_leaders))
        found = components(first)
        base = cut_lineage(base.join(found, "node", "left").select(*names, F.coalesce("root", "node").alias("root")))

        def roots(batches):
            for b in batches:
                root = b.column("root").to_numpy()
                for _, row, shard, home in routed(b):
                    on = home & member(large, shard)
                    pair, n = np.unique(np.stack([shard[on], root[row[on]]]), axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0], pa.int64()), pa.array(pair[1], pa.int64()), pa.array(n, pa.int64())], ["shard", "root", "n"])

        by = base.mapInArrow(roots, "shard long, root long, n long").groupBy("shard", "root").agg(F.sum("n").alias("n"))
        top = {r["shard"]: r["top"]["root"] for r in by.groupBy("shard").agg(F.max(F.struct("n", "root")).alias("top")).collect()}
        most = np.array([top[s] for s in large.tolist()], np.int64)

    def deal(batches):
        for b in batches:
            cols = [b.column(c).to_numpy() for c in names]
            root = b.column("root").to_numpy() if len(large) else None
            for _, row, shard, home in routed(b):
                pieces, own, visits = np.ones(len(shard), np.int64), home, np.ones(len(shard), bool)
                if len(large):
                    dense = member(large, shard)
                    spot = np.searchsorted(large, shard[dense])
                    pieces[dense], own = many[spot], home | dense
                    visits[dense] = root[row[dense]] != most[spot]
                yield from dealt(b, cols, shard, row, own, visits, pieces)

    second_turn = met(base, deal)
    return second_turn if first is None else first.unionByName(second_turn).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, near: int = 4, seed: int = 42, second: int | None = None, prints: int = 2, search: int = 1) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` (the smallest doc_id that links reach) of every document.

    Needs ``doc_id`` (long) and ``text``; other columns are ignored. Equal fingerprints are one vertex, so that copies
    cost nothing further; texts without words, null among them, share the fingerprint zero and are linked like any other;
    rows that repeat a doc_id give equal rows if their texts are equal; rows without a doc_id link nothing and have no
    component; an empty table gives no rows. Fingerprints that more than one row in ``HOT`` has (fewer than ``HOT``) get
    their component by a broadcast, all others by a join.

    ``second`` takes ``prints`` fingerprints of each text and asks that the others differ by so many bits in all as well:
    that lets ``near`` be wider without links by chance, however many documents there are. The first ``search`` of them are
    searched in turn for values within ``near`` bits, so that near copies that one of them parts are found by another.
    """
    key = _names(prints - 1 if second is not None else 0)
    taken = cut_lineage(fingerprints(docs, shingle, seed, len(key) - 1))
    nodes = cut_lineage(taken.where(F.col("doc_id").isNotNull()).groupBy(*key).agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    total = nodes.agg(F.sum("n")).first()[0]
    found = nodes.select("node", F.col("node").alias("root"))
    if total:
        edges = None
        for i in range(search if second is not None else 1):
            turned = [key[i], *key[:i], *key[i + 1 :]]
            own = links(nodes.select("node", *[F.col(c).alias(name) for c, name in zip(turned, key)]), near, second)
            edges = own if edges is None else edges.unionByName(own)
        found = components(edges)
    rooted = nodes.join(found, "node", "left").select(*key, "n", F.coalesce("root", "node").alias("component_id"))
    is_hot = F.col("n") * HOT > F.lit(total or 0)
    hot = F.broadcast(cut_lineage(rooted.where(is_hot).drop("n")))
    cold = rooted.where(~is_hot).drop("n")
    with_id, without = taken.where(F.col("doc_id").isNotNull()), taken.where(F.col("doc_id").isNull())
    out = with_id.join(hot, key).unionByName(with_id.join(hot, key, "left_anti").join(cold, key))
    return out.unionByName(without.withColumn("component_id", F.lit(None).cast("long"))).select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract columns for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, shingle=4).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
