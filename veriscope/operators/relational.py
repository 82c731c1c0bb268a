"""Keys, joins, sets and reports over DataFrames. Each function declares a plan and lets the optimizer place it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.tables import scratch_folder


def _keys(k) -> list[str]:
    return [k] if isinstance(k, str) else list(k)


def ordered(*order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def cut(df: DataFrame) -> DataFrame:
    """``df`` as it is now, written to the shared folder and read again: later steps don't compute it anew."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Keys and ranking


def top_per_key(df: DataFrame, key, order, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; ``order`` should be total. Ranks are cut before the shuffle."""
    w = Window.partitionBy(*_keys(key)).orderBy(*ordered(*_keys(order) if isinstance(order, (str, list, tuple)) else [order]))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def last_per_key(df: DataFrame, key, order: str) -> DataFrame:
    """The row of each key that comes last, of equals the one whose other columns are greatest; blank keys are left out. One
    aggregate, no sort; columns that have no order (maps) break no ties."""
    keys = _keys(key)
    rest = [c for c in df.columns if c not in keys]
    full = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys]))
    ties = [c for c in rest if "map<" not in df.schema[c].dataType.simpleString() and "variant" not in df.schema[c].dataType.simpleString()]
    return full.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(order), *ties)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def duplicate_keys(df: DataFrame, key) -> DataFrame:
    return df.groupBy(*_keys(key)).agg(F.count("*").alias("n")).where("n > 1")


def page(df: DataFrame, order, skip: int, take: int) -> DataFrame:
    return df.orderBy(*ordered(*_keys(order))).offset(skip).limit(take)


def numbered(df: DataFrame, order, name: str = "i", part: str | None = None) -> DataFrame:
    """``df`` with each row's place in order, from 1; ``part`` keeps the number of its range, too.

    Rows are dealt into ranges and sorted there; each range's rows are counted, and a window over one row per range tells
    how many come before. The ranges are written to the shared folder first, so that both passes see the same ones."""
    keys = ordered(*_keys(order))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_part"), within.alias("_within"))
    placed = cut(placed)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    out = placed.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_within") + 1).drop("_before", "_within")
    return out.withColumnRenamed("_part", part) if part else out.drop("_part")


#: Bytes that a plan may be estimated at for its keys to be ordered in one task each.
SMALL = 64 << 20


def is_small(df: DataFrame) -> bool:
    """Whether the plan's statistics bound a DataFrame by ``SMALL``; what they don't know counts as large."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL


def running(df: DataFrame, keys, order, sums: dict[str, Column]) -> DataFrame:
    """``df`` with sums over the rows of its key that come before it in order; the order must be total within a key.

    Small tables take a window by key. In larger ones a key may hold any share of the rows: they are dealt into ranges of
    (keys, order) and written, so that both passes see the same ones; each range sums up its keys, and what a key that goes
    on from the range before brings along, one row a range at most, is added to the running sums within the range."""
    k, by = _keys(keys), ordered(*(order if isinstance(order, (list, tuple)) else [order]))
    own = [f"_run_{i}" for i in range(len(sums))]
    df = df.withColumns(dict(zip(own, sums.values())))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(df.schema[c].dataType))
    if is_small(df):
        w = Window.partitionBy(*k).orderBy(*by)
        return df.withColumns({name: before(c, w) for name, c in zip(sums, own)}).drop(*own)
    placed = df.repartitionByRange(*k, *by).withColumn("_run_range", F.spark_partition_id())
    placed = cut(placed)
    per = placed.groupBy("_run_range", *k).agg(*[F.sum(c).alias(c) for c in own])
    w = Window.partitionBy(*k).orderBy("_run_range")
    carried = per.withColumn("_run_turn", F.row_number().over(w)).select("_run_turn", F.col("_run_range").alias("_run_in"), *[F.col(c).alias(f"_run_key_{c}") for c in k], *[before(c, w).alias(f"_run_before{c}") for c in own]).where("_run_turn > 1").drop("_run_turn")
    w = Window.partitionBy("_run_range", *k).orderBy(*by)
    within = placed.withColumns({name: before(c, w) for name, c in zip(sums, own)})
    same = [F.col("_run_range") == F.col("_run_in"), *[F.col(c).eqNullSafe(F.col(f"_run_key_{c}")) for c in k]]
    out = within.join(F.broadcast(carried), same, "left")
    out = out.withColumns({name: F.col(name) + F.coalesce(f"_run_before{c}", F.lit(0)) for name, c in zip(sums, own)})
    return out.select(*[c for c in df.columns if c not in own], *sums)


def strided(df: DataFrame, order, shards: int, shard: int) -> DataFrame:
    """Every ``shards``-th row in order."""
    return numbered(df, order, "_at").where(F.pmod(F.col("_at") - 1, F.lit(shards)) == shard).drop("_at")


def positional(left: DataFrame, right: DataFrame, left_order, right_order) -> DataFrame:
    """Rows that have the same place in their tables' orders."""
    return numbered(left, left_order, "_at").join(numbered(right, right_order, "_at"), "_at").drop("_at")


def ordered_manifest(df: DataFrame, keys, line: str | Column, order: str, separator: str = "\n", prefix: str = "", rows: int = 65536, name: str = "manifest", whole: bool = False) -> DataFrame:
    """(keys, manifest): the SHA-256 of each key's lines in order, after a prefix. Keys of more than ``rows`` lines have the
    SHA-256 of the prefix and the digests of their blocks of so many lines, so that no key's lines stand in one row; ``order``
    must be distinct within a key. With ``whole`` every key has the SHA-256 of all its lines, null where it has none: lines
    are sorted and joined in small blocks, and a key's blocks stream through the hash one after the other, since SHA-256
    can't be computed in parts; no more than a batch of blocks is held."""
    k = _keys(keys)
    if whole:
        return _whole_manifest(df, k, line if isinstance(line, Column) else F.col(line), order, separator, prefix, name)
    text = line if isinstance(line, Column) else F.col(line)
    placed = running(df.select(*k, F.col(order).alias("_order"), text.alias("_line")), k, "_order", {"_before": F.lit(1).cast("long")})
    block = placed.groupBy(*k, F.floor(F.col("_before") / rows).alias("_block")).agg(F.array_sort(F.collect_list(F.struct(F.col("_order").alias("o"), F.col("_line").alias("v")))).alias("_lines"))
    joined = F.array_join(F.transform("_lines", lambda p: p["v"]), separator)
    each = block.select(*k, "_block", F.sha2(F.concat(F.when(F.col("_block") == 0, F.lit(prefix)).otherwise(""), joined), 256).alias("_digest"))
    all_ = each.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("_block", "_digest"))).alias("_d"))
    digests = F.transform("_d", lambda d: d["_digest"])
    return all_.select(*k, F.when(F.size("_d") == 1, digests[0]).otherwise(F.sha2(F.concat(F.lit(prefix), F.array_join(digests, separator)), 256)).alias(name))


#: Lines that a block of a whole manifest has; a batch of blocks holds some megabytes.
LINES = 128


def _whole_manifest(df: DataFrame, k: list[str], line: Column, order: str, separator: str, prefix: str, name: str) -> DataFrame:
    import hashlib

    said = df.select(*k, F.col(order).alias("_order"), line.alias("_line"))
    # Lines that are null say nothing, but their key stays.
    placed = running(said, k, "_order", {"_before": F.col("_line").isNotNull().cast("long")})
    block = placed.groupBy(*k, F.floor(F.col("_before") / LINES).alias("_block")).agg(F.array_sort(F.collect_list(F.when(F.col("_line").isNotNull(), F.struct(F.col("_order").alias("o"), F.col("_line").alias("v"))))).alias("_lines"))
    text = F.when(F.size("_lines") > 0, F.array_join(F.transform("_lines", lambda p: p["v"]), separator))
    schema = T.StructType([*block.select(*k).schema, T.StructField(name, T.StringType())])
    arrow = to_arrow_schema(schema)

    def digests(batches):
        own, state = None, None
        for b in batches:
            out = []
            for *key, said in zip(*(b.column(c).to_pylist() for c in (*k, "_text"))):
                if key != own:
                    if own is not None:
                        out.append((*own, state and state.hexdigest()))
                    own, state = key, None
                if said is not None:
                    if state is None:
                        state = hashlib.sha256(prefix.encode())
                    else:
                        state.update(separator.encode())
                    state.update(said.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=arrow)
        if own is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*own, state and state.hexdigest())))], schema=arrow)

    return block.select(*k, "_block", text.alias("_text")).repartition(*k).sortWithinPartitions(*k, "_block").select(*k, "_text").mapInArrow(digests, schema)


def order_agreement(left: DataFrame, right: DataFrame, key: str, left_order, right_order) -> DataFrame:
    """(n, moved, only_left, only_right): whether two tables hold the same records in the same order, before they are joined
    by place: how many keys they share, how many of these have another place, and how many one side lacks."""
    a = numbered(left.select(key, *[c for c in _keys(left_order) if c != key]), left_order, "_a").select(key, "_a")
    b = numbered(right.select(key, *[c for c in _keys(right_order) if c != key]), right_order, "_b").select(key, "_b")
    both = a.join(b, key, "full")
    return both.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n"), F.count_if(F.col("_a") != F.col("_b")).alias("moved"), F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"))


def bottom_by_hash(df: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """The ``n`` rows whose SHA-256 is smallest: a sample that reruns repeat."""
    return df.orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)).limit(n)


# Joins


class NotUnique(ValueError):
    pass


def _unique(df: DataFrame, key, side: str) -> None:
    if not duplicate_keys(df, key).isEmpty():
        raise NotUnique(f"{side} key is not unique: {key}")


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "left", one_to_one: bool = False) -> DataFrame:
    """An equi-join whose right side (and left, if one to one) must not repeat a key."""
    _unique(right, on, "right")
    if one_to_one:
        _unique(left, on, "left")
    return left.join(right, on, how)


def lookup(left: DataFrame, right: DataFrame, on, value: str) -> DataFrame:
    """Left rows with a looked-up value; a key that the right side lacks is an error."""
    out = join_checked(left, right, on)
    return out.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.lit(f"no {value} for a key"))).otherwise(F.col(value)))


def against_baseline(df: DataFrame, method: str, baseline: str, keys, values) -> DataFrame:
    """Each method's rows beside the baseline's of the same key, with differences ``delta_*``."""
    base = df.where(F.col(method) == baseline).select(*_keys(keys), *[F.col(v).alias(f"base_{v}") for v in _keys(values)])
    out = df.where(F.col(method) != baseline).join(base, _keys(keys))
    return out.withColumns({f"delta_{v}": F.col(v) - F.col(f"base_{v}") for v in _keys(values)})


def first_interval(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, order, width: float | None = None) -> DataFrame:
    """Points with the first interval of their key that holds them, ends included; points that no interval holds are
    dropped. With ``width`` (of numbers, or seconds), time is cut into pieces: intervals stand in each piece that they
    touch, and a point meets those of its own piece only, so that a key of many rows makes no pairs of all of them."""
    on, left, right = [key], points, intervals
    if width:
        def piece(df: DataFrame, c: str) -> Column:
            x = F.col(c).cast("timestamp") if dict(df.dtypes)[c].startswith("timestamp") else F.col(c)
            return F.floor(x.cast("double") / width)

        left = points.withColumn("_piece", piece(points, at))
        right = intervals.where(F.col(start) <= F.col(end)).withColumn("_piece", F.explode(F.sequence(piece(intervals, start), piece(intervals, end))))
        on.append("_piece")
    hit = left.join(right, on).where(F.col(at).between(F.col(start), F.col(end))).drop("_piece")
    return top_per_key(hit, points.columns, order)


def unordered_pairs(df: DataFrame, item: str, within=None) -> DataFrame:
    """(a, b) of items with a < b that stand together within a key; for small dimension tables."""
    keys = _keys(within or [])
    a, b = df.select(*keys, F.col(item).alias("a")), df.select(*keys, F.col(item).alias("b"))
    pairs = a.join(b, keys) if keys else a.crossJoin(few(b))
    return pairs.where("a < b")


def nearest_match(left: DataFrame, right: DataFrame, key, value: str, other: str, tie: str) -> DataFrame:
    """For each left row the right row of its key whose value is nearest; ties to the smaller ``tie``. Keys without a right
    row are left out.

    Only the neighbours below and above in order can be nearest, so that both sides are sorted by value within a key, once
    up and once down, and no pairs are made; each row takes what the running order last saw. Of right rows of one value the
    smallest ``tie`` stands for all."""
    k = _keys(key)
    r = right.groupBy(*k, F.col(other).alias("_v")).agg(F.min(tie).alias("_t")).select(*k, "_v", F.struct(F.col("_v").alias("v"), F.col("_t").alias("t")).alias("_r"), F.lit(None).alias("_l"))
    both = left.select(*k, F.col(value).alias("_v"), F.lit(None).alias("_r"), F.struct(*left.columns).alias("_l")).unionByName(r)
    # Right rows come first among equal values, both ways.
    seen = lambda v: F.last("_r", True).over(Window.partitionBy(*k).orderBy(v, F.col("_r").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    near = both.withColumn("_a", seen(F.col("_v").asc())).withColumn("_b", seen(F.col("_v").desc())).where("_l is not null and (_a is not null or _b is not null)")
    gap = lambda c: F.abs(F.col("_v") - F.col(f"{c}.v"))
    first = (F.col("_b").isNull()) | (gap("_a") < gap("_b")) | ((gap("_a") == gap("_b")) & (F.col("_a.t") <= F.col("_b.t")))
    pick = F.when(F.col("_a").isNotNull() & first, F.col("_a")).otherwise(F.col("_b"))
    return near.select("_l.*", pick["v"].alias(other), pick["t"].alias(tie))


def nearest_in_pool(targets: DataFrame, pool: DataFrame, key: str, tie: str, gap: Column, n: int, block: int = 50_000) -> DataFrame:
    """(targets' columns, pool's columns, place): the ``n`` pool rows of least ``gap`` for each target. Targets are the
    query set: the pool is cut into blocks of about ``block`` rows, each target meets each block once, and a block answers
    with ``n`` rows at most."""
    parts = max(1, -(-pool.count() // block))
    b = pool.withColumn("_p", F.pmod(F.xxhash64(tie), F.lit(parts)).cast("int"))
    q = targets.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = q.join(b, "_p").withColumn("_gap", gap)
    own = met.withColumn("_k", F.row_number().over(Window.partitionBy(key, "_p").orderBy("_gap", tie))).where(F.col("_k") <= n).drop("_k", "_p")
    return own.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_gap", tie))).where(F.col("place") <= n).drop("_gap")


#: Pairs of points that meet without cells; and points that a cell of the first level may have, about, for each one sought.
MEET, DENSE = 1 << 20, 16


def nearest_in_plane(targets: DataFrame, pool: DataFrame, key: str, tie: str, at: list[str], n: int, digits: int = 9) -> DataFrame:
    """(key, tie, gap, place): the ``n`` pool rows nearest to each target by the sum of the distances in two columns (``at``, of
    both tables), rounded to ``digits``; ties to the smaller ``tie``. Rows without both coordinates take no part.

    Equal targets ask once, and of equal pool rows the ``n`` of smallest ``tie`` answer for all. Turned by an eighth, the
    sum of distances is the larger of two: all points within a cell's width stand in the nine cells around. Cells begin so
    small that the fullest has few points; a target whose ``n``-th gap is within the width is done, and only the others
    go on to cells four times as wide, until all are done or the width spans the table. Exact whatever the width."""
    x, y = at
    there = F.col(x).isNotNull() & F.col(y).isNotNull()
    p = top_per_key(pool.where(there).select(F.col(tie), *[(F.col(c) + 0.0).alias(f"_p{i}") for i, c in enumerate(at)]), ["_p0", "_p1"], tie, n)
    p = cut(p.withColumns({"_u": F.col("_p0") + F.col("_p1"), "_v": F.col("_p0") - F.col("_p1")}))
    own = cut(targets.where(there).select(key, *[(F.col(c) + 0.0).alias(f"_q{i}") for i, c in enumerate(at)]))
    q = cut(own.select("_q0", "_q1").distinct().withColumns({"_u": F.col("_q0") + F.col("_q1"), "_v": F.col("_q0") - F.col("_q1")}))
    ends = [f(c) for c in ("_u", "_v") for f in (F.min, F.max)]
    a, b = p.agg(*ends, F.count("*")).first(), q.agg(*ends, F.count("*")).first()
    if not a[4] or not b[4]:
        return own.join(p, F.lit(False)).select(key, tie, F.lit(0.0).alias("gap"), F.lit(0).alias("place"))
    reach = max(1e-6, *[max(a[i + 1], b[i + 1]) - min(a[i], b[i]) for i in (0, 2)])
    cell = lambda c, h: F.floor(F.col(c) / h)
    h = reach
    if a[4] * b[4] > MEET:
        while h > 1e-6 and p.groupBy(cell("_u", h), cell("_v", h)).count().agg(F.max("count")).first()[0] > DENSE * n:
            h /= 4
    done, left = None, q
    gap = F.round(F.abs(F.col("_q0") - F.col("_p0")) + F.abs(F.col("_q1") - F.col("_p1")), digits)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    while True:
        asked = left.select("_q0", "_q1", cell("_u", h).alias("_a"), cell("_v", h).alias("_b")).withColumn("_a", F.explode(F.transform(around, lambda i: F.col("_a") + i))).withColumn("_b", F.explode(F.transform(around, lambda i: F.col("_b") + i)))
        met = asked.join(p.select("*", cell("_u", h).alias("_a"), cell("_v", h).alias("_b")), ["_a", "_b"]).select("_q0", "_q1", tie, gap.alias("gap"))
        near = met.withColumn("place", F.row_number().over(Window.partitionBy("_q0", "_q1").orderBy("gap", tie))).where(F.col("place") <= n)
        if h >= reach:
            return own.join(near if done is None else done.unionByName(near), ["_q0", "_q1"]).select(key, tie, "gap", "place")
        near = cut(near)
        # Rounding may bring a gap nearer by half a digit.
        settled = near.where((F.col("place") == n) & (F.col("gap") < h - 2 * 10.0**-digits)).select("_q0", "_q1")
        sure = near.join(settled, ["_q0", "_q1"], "left_semi")
        done, left = sure if done is None else done.unionByName(sure), cut(left.join(settled, ["_q0", "_q1"], "left_anti"))
        if left.isEmpty():
            return own.join(done, ["_q0", "_q1"]).select(key, tie, "gap", "place")
        h = min(4 * h, reach)


def strongest_other(df: DataFrame, within, item: str, value: str) -> DataFrame:
    """Each row with the largest value of any other item of its group. The two best of a group tell it, so that no row meets
    all others."""
    w = Window.partitionBy(*_keys(within)).orderBy(F.col(value).desc(), F.col(item))
    best = df.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy(*_keys(within)).agg(
        F.max(F.when(F.col("_r") == 1, F.col(item))).alias("_top"), F.max(F.when(F.col("_r") == 1, F.col(value))).alias("_v1"), F.max(F.when(F.col("_r") == 2, F.col(value))).alias("_v2")
    )
    return df.join(best, _keys(within)).withColumn("other_max", F.when(F.col(item) == F.col("_top"), F.col("_v2")).otherwise(F.col("_v1"))).drop("_top", "_v1", "_v2")


#: Cells that a step of ``cliques`` holds at a time.
CLIQUE_CELLS = 1 << 22


def cliques(edges: DataFrame, least: int, most: int) -> DataFrame:
    """(size, items): sets of ``least`` to ``most`` items, two at least, all of whose pairs (a < b) are edges.

    An item's later neighbours come together in one row, each with its own; sets that begin with the item grow within that
    row's task, some at a time, so that they cross no shuffle and memory grows with the square of an item's neighbours only."""
    e = edges.select("a", "b").distinct()
    later = e.groupBy(F.col("a").alias("b")).agg(F.collect_list("b").alias("later"))
    # As many tasks as there may be: few bytes make many sets. Dealt before the rows are grouped, else the optimizer takes it out.
    dealt = e.join(later, "b", "left").repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "a")
    near = dealt.groupBy("a").agg(F.collect_list(F.struct("b", "later")).alias("near"))

    def run(batches):
        for batch in batches:
            for i, own in enumerate(batch.column("near")):
                items, lists = own.values.field("b"), own.values.field("later")
                d = len(items)
                owner = np.repeat(np.arange(d), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                place = pc.index_in(lists.flatten(), items)
                inside = place.is_valid().to_numpy(zero_copy_only=False)
                linked = np.zeros((d, d), bool)
                linked[owner[inside], place.drop_null().to_numpy()] = True
                names = pa.concat_arrays([batch.column("a")[i : i + 1], items])
                for sets in _grown(np.zeros((1, 0), np.int32), np.ones((1, d), bool), linked, least, most):
                    flat = np.column_stack([np.zeros(len(sets), np.int32), sets + 1])
                    found = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), names.take(pa.array(flat.ravel())))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), flat.shape[1], np.int32)), found], ["size", "items"])

    return near.mapInArrow(run, f"size int, items array<{dict(edges.dtypes)['a']}>")


def _grown(sets: np.ndarray, more: np.ndarray, linked: np.ndarray, least: int, most: int):
    """``sets`` (of neighbours of a first item, which isn't written) and all that grow from them: ``more`` says by which."""
    size = sets.shape[1] + 1
    if size >= least:
        yield sets
    if size == most:
        return
    step = max(1, CLIQUE_CELLS // max(1, linked.size))
    for i in range(0, len(sets), step):
        row, item = np.nonzero(more[i : i + step])
        if len(row):
            rest = more[i : i + step][row] & linked[item] if size + 1 < most else more[:0]
            yield from _grown(np.column_stack([sets[i : i + step][row], item.astype(np.int32)]), rest, linked, least, most)


def dominated_free(df: DataFrame, key: str, larger, smaller) -> DataFrame:
    """The Pareto front: rows that no other row equals or beats in everything and beats in something.

    Each partition first drops what its own rows beat; a row that is beaten is beaten by one of the front, so that the rest
    meet only each other."""
    names = [*_keys(larger), *_keys(smaller)]
    sign = np.array([1.0] * len(_keys(larger)) + [-1.0] * len(_keys(smaller)))

    def local(batches):
        kept = None
        for b in batches:
            rows = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            x = np.column_stack([rows[n].to_numpy().astype(float) for n in names]) * sign if len(rows) else np.zeros((0, len(names)))
            x = np.where(np.isnan(x), -np.inf, x)
            alive = np.ones(len(x), bool)
            for i in np.argsort(-x.sum(1), kind="stable"):
                if alive[i]:
                    alive &= ~((x[i] >= x).all(1) & (x[i] > x).any(1))
            kept = rows.filter(pa.array(alive))
        if kept is not None:
            yield from kept.to_batches()

    df = cut(df.mapInArrow(local, df.schema))
    other = df.select(*[F.col(n).alias(f"_{n}") for n in names], F.col(key).alias("_key"))
    no_worse = reduce(lambda a, b: a & b, [F.col(f"_{n}") >= F.col(n) for n in _keys(larger)] + [F.col(f"_{n}") <= F.col(n) for n in _keys(smaller)])
    better = reduce(lambda a, b: a | b, [F.col(f"_{n}") > F.col(n) for n in _keys(larger)] + [F.col(f"_{n}") < F.col(n) for n in _keys(smaller)])
    # What the rest are held against goes to every task in chunks of a checked size.
    chunks = max(1, -(-df.count() // FRONT))
    for i in range(chunks):
        some = other.where(F.pmod(F.xxhash64("_key"), F.lit(chunks)) == i)
        df = df.join(F.broadcast(some), no_worse & better & (F.col("_key") != F.col(key)), "left_anti")
    return df


#: Rows that a chunk of a front has, about, and items that may meet in all pairs.
FRONT, MOST_ITEMS = 200_000, 20_000


def few(df: DataFrame) -> DataFrame:
    """``df``, to be sent to every task, once it is counted to have ``MOST_ITEMS`` rows or fewer; else an error."""
    if df.limit(MOST_ITEMS + 1).count() > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items can't meet in all pairs; give a key within which they do")
    return F.broadcast(df)


# Sets


def set_report(named: dict[str, DataFrame], key: str) -> DataFrame:
    """For each pattern of membership the number of keys: one union and two aggregates, whatever the number of sets."""
    tagged = [df.select(F.col(key).cast("string").alias("k"), F.lit(n).alias("s")) for n, df in named.items()]
    every = reduce(DataFrame.unionByName, tagged).distinct()
    return every.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("s")), "|").alias("members")).groupBy("members").agg(F.count("*").alias("n"))


def replace_part(old: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """Rows of ``old`` but for the parts that ``new`` has, and ``new``; columns that either lacks are null."""
    return old.join(new.select(part).distinct(), part, "left_anti").unionByName(new, allowMissingColumns=True)


def grid(**dimensions: DataFrame) -> DataFrame:
    """All combinations of some dimensions, which are small by nature."""
    return reduce(lambda a, b: a.crossJoin(b), [df.select(c).distinct() for c, df in dimensions.items()])


def grid_gaps(have: DataFrame, planned: DataFrame, keys) -> DataFrame:
    """Combinations that are ``missing`` or ``unexpected``, or ``duplicate``."""
    k = _keys(keys)
    got = have.groupBy(*k).agg(F.count("*").alias("_n"))
    both = planned.select(*k).withColumn("_p", F.lit(1)).join(got, k, "full_outer")
    return both.withColumn("issue", F.when(F.col("_n").isNull(), "missing").when(F.col("_p").isNull(), "unexpected").when(F.col("_n") > 1, "duplicate")).where("issue is not null").drop("_n", "_p")


def common_support(df: DataFrame, level: str, item: str) -> DataFrame:
    """Levels at which every item has a row."""
    n = df.select(item).distinct().agg(F.count("*").alias("_all"))
    return df.groupBy(level).agg(F.countDistinct(item).alias("_n")).join(F.broadcast(n), F.col("_n") == F.col("_all")).select(level)


# Aggregates


def column_summary(df: DataFrame, columns) -> DataFrame:
    """n, non_missing, missing_frac, mean, min, max of numeric columns, one row each; one pass."""
    long = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("concept", "value"))
    n, have = F.count("*"), F.count("value")
    return long.groupBy("concept").agg(n.alias("n"), have.alias("non_missing"), (1 - have / n).alias("missing_frac"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))


def mean_of_means(df: DataFrame, first, then, value: str) -> DataFrame:
    """Values averaged over ``first`` keys, then those means over ``then``."""
    return df.groupBy(*_keys(first)).agg(F.avg(value).alias("_m")).groupBy(*_keys(then)).agg(F.avg("_m").alias("mean"), F.count("*").alias("n"))


def leave_one_out(df: DataFrame, group, level: str, value: str) -> DataFrame:
    """Mean without each level in turn: envelope and whether all have one sign."""
    per = df.groupBy(*_keys(group), level).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    w = Window.partitionBy(*_keys(group))
    out = per.withColumn("_m", (F.sum("_s").over(w) - F.col("_s")) / F.nullif(F.sum("_n").over(w) - F.col("_n"), F.lit(0)))
    return out.groupBy(*_keys(group)).agg(F.min("_m").alias("low"), F.max("_m").alias("high"), (F.countDistinct(F.signum("_m")) == 1).alias("same_sign"))


def jaccard_pairs(df: DataFrame, key: str, label: str) -> DataFrame:
    """Overlap of the key sets of each pair of labels: sizes, Jaccard, subset, identical."""
    once = df.select(key, label).distinct()
    size = once.groupBy(label).agg(F.count("*").alias("n"))
    both = once.select(key, F.col(label).alias("a")).join(once.select(key, F.col(label).alias("b")), key).where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))
    pairs = size.select(F.col(label).alias("a"), F.col("n").alias("n_a")).crossJoin(few(size.select(F.col(label).alias("b"), F.col("n").alias("n_b")))).where("a < b")
    out = pairs.join(both, ["a", "b"], "left").na.fill(0, ["both"])
    return out.withColumn("jaccard", F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))).withColumn("subset", (F.col("both") == F.col("n_a")) | (F.col("both") == F.col("n_b"))).withColumn("identical", (F.col("both") == F.col("n_a")) & (F.col("both") == F.col("n_b")))


def effective_sample(df: DataFrame, group, weight: str, value: str) -> DataFrame:
    """Weighted mean and the sample size that the weights are worth."""
    w = F.col(weight)
    return df.groupBy(*_keys(group)).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("mean"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("n_eff"))


def cluster_hash(df: DataFrame, cluster: str) -> DataFrame:
    """(cluster, n, id): each cluster's rows and a SHA-256 of its name and their number."""
    per = df.groupBy(cluster).agg(F.count("*").alias("n"))
    return per.withColumn("id", F.sha2(F.concat_ws(":", F.col(cluster).cast("string"), F.col("n").cast("string")), 256))


def stratified_subset(df: DataFrame, key: str, stratum: str, each: int, more: int) -> DataFrame:
    """(key, stratum): the ``each`` rows of smallest hash in every stratum, and ``more`` of all that are left."""
    rows = df.select(key, stratum)
    kept = top_per_key(rows, stratum, [F.sha2(F.col(key).cast("string"), 256)], each)
    return kept.unionByName(bottom_by_hash(rows.join(kept.select(key), key, "left_anti"), key, more).select(key, stratum))
