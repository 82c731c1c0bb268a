"""Bootstraps and permutations: clusters or cells are summed up first, then meet the draws; rows are read once.

Draws are numbers that a hash of seed, draw and key gives, so that every engine and rerun gets the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .relational import _keys, is_small, numbered, running
from .statistics import adjust, pilot


#: Levels that are sent to every task.
MOST_LEVELS = 1_000_000
#: Bins of a hash in which the chosen number of items is looked for.
BINS = 4096


def uniform(*parts) -> Column:
    """A number in [0, 1) from a hash of some values: 32 bits of an MD5."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def multinomial_draws(spark: SparkSession, levels: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, key, w): as many picks with replacement as there are levels, in each of ``n`` draws. For factors of few
    levels: each draw has a pick per level. Levels that a draw doesn't pick have no row."""
    names = levels.select(key).distinct()
    placed = names.withColumn("_i", F.row_number().over(Window.orderBy(key))) if is_small(levels) else numbered(names, key, "_i")
    turned = placed.withColumn("_i", (F.col("_i") - 1).cast("int"))
    many = turned.count()
    picks = spark.range(n * many).select((F.col("id") / many).cast("long").alias("draw"), (F.col("id") % many).alias("_slot"))
    picked = picks.select("draw", F.floor(uniform(seed, F.col("draw"), F.col("_slot")) * many).cast("int").alias("_i"))
    return picked.groupBy("draw", "_i").agg(F.count("*").alias("w")).join(F.broadcast(turned) if many <= MOST_LEVELS else turned, "_i").select("draw", key, "w")


def exponential_draws(levels: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, key, w): Bayesian bootstrap weights, exponential with mean 1."""
    rows = levels.select(key).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select("draw", key, (-F.log(1 - uniform(seed, F.col("draw"), F.col(key)))).alias("w"))


def crossed_mean(cells: DataFrame, factors: dict[str, DataFrame], value: str, keys=()) -> DataFrame:
    """(draw, keys, mean, cells): the mean of cells under the product of each factor's weights; cells without a value have
    no part in numerator or denominator. ``factors`` maps a column of ``cells`` to its draws."""
    k, out, w = _keys(keys), cells.where(F.col(value).isNotNull() & ~F.isnan(value)), F.lit(1.0)
    for i, (factor, draws) in enumerate(factors.items()):
        named = draws.withColumnRenamed("w", f"_w{i}")
        out = out.join(named, factor if not i else [factor, "draw"])
        w = w * F.col(f"_w{i}")
    return out.withColumn("_w", w).groupBy("draw", *k).agg((F.sum(F.col("_w") * F.col(value)) / F.nullif(F.sum("_w"), F.lit(0.0))).alias("mean"), F.count("*").alias("cells"))


def bootstrap_sums(df: DataFrame, cluster: str, sums: dict[str, Column], weights: DataFrame, keys=()) -> DataFrame:
    """(draw, keys, each sum): weighted by cluster. Whatever metric follows from sums, follows from these."""
    k = _keys(keys)
    per = df.groupBy(cluster, *k).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    return per.join(weights, cluster).groupBy("draw", *k).agg(*[F.sum(F.col("w") * F.col(name)).alias(name) for name in sums])


def bootstrap_auroc(df: DataFrame, cluster: str, score: str, label: str, weights: DataFrame, keys=()) -> DataFrame:
    """(draw, keys, auroc): tie-aware, by weighted sums of distinct scores; draws with one class only have none."""
    k, y = _keys(keys), F.col(label).cast("double")
    per = df.groupBy(cluster, *k, score).agg(F.sum(y).alias("_p"), F.sum(1 - y).alias("_n"))
    by = per.join(weights, cluster).groupBy("draw", *k, score).agg(F.sum(F.col("w") * F.col("_p")).alias("_p"), F.sum(F.col("w") * F.col("_n")).alias("_n"))
    s = running(by, ["draw", *k], score, {"_below": F.col("_n")}).withColumn("_u", F.col("_p") * (F.col("_below") + F.col("_n") / 2)).groupBy("draw", *k).agg(F.sum("_u").alias("_u"), F.sum("_p").alias("_p"), F.sum("_n").alias("_n"))
    return s.select("draw", *k, (F.col("_u") / F.nullif(F.col("_p") * F.col("_n"), F.lit(0.0))).alias("auroc"))


def auroc_difference(df: DataFrame, cluster: str, first: str, second: str, label: str, weights: DataFrame) -> DataFrame:
    """(draw, delta): AUROC of the first score less that of the second under identical weights; one-class draws are left
    out."""
    a = bootstrap_auroc(df, cluster, first, label, weights).withColumnRenamed("auroc", "_a")
    b = bootstrap_auroc(df, cluster, second, label, weights).withColumnRenamed("auroc", "_b")
    return a.join(b, "draw").select("draw", (F.col("_a") - F.col("_b")).alias("delta")).where("delta is not null")


def fit_metrics(df: DataFrame, cluster: str, actual: str, predicted: str, weights: DataFrame, keys=()) -> DataFrame:
    """(draw, keys, r2, r): explained variance and correlation of a prediction, from cluster sums."""
    x0, y0 = pilot(df, predicted, actual)
    x, y, one = F.col(predicted) - x0, F.col(actual) - y0, F.lit(1.0)
    s = bootstrap_sums(df, cluster, {"n": one, "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y, "sse": (F.col(actual) - F.col(predicted)) * (F.col(actual) - F.col(predicted))}, weights, keys)
    n, vy, vx = F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n"), F.col("xx") - F.col("x") * F.col("x") / F.col("n")
    r = (F.col("xy") - F.col("x") * F.col("y") / n) / F.sqrt(F.nullif(vx * vy, F.lit(0.0)))
    return s.select("draw", *_keys(keys), (1 - F.col("sse") / F.nullif(vy, F.lit(0.0))).alias("r2"), r.alias("r"))


def beyond_random(df: DataFrame, cluster: str, effect: str, random: list[str], weights: DataFrame) -> DataFrame:
    """(draw, selected, random, excess): the mean effect, the mean of its random controls, and the difference."""
    sums = {"_n": F.lit(1.0), "_s": F.col(effect), "_r": sum((F.col(c) for c in random), F.lit(0.0)) / len(random)}
    s = bootstrap_sums(df, cluster, sums, weights)
    return s.select("draw", (F.col("_s") / F.col("_n")).alias("selected"), (F.col("_r") / F.col("_n")).alias("random"), ((F.col("_s") - F.col("_r")) / F.col("_n")).alias("excess"))


def steering_metrics(df: DataFrame, cluster: str, target: str, others: list[str], weights: DataFrame, eps: float = 1e-6) -> DataFrame:
    """(draw, effect, off_target, index): mean target change, root mean square of the other changes, and the share of
    the whole that misses the target."""
    sums = {"_n": F.lit(1.0), "_t": F.col(target), "_o": sum((F.col(c) * F.col(c) for c in others), F.lit(0.0)) / len(others)}
    s = bootstrap_sums(df, cluster, sums, weights)
    effect, off = F.col("_t") / F.col("_n"), F.sqrt(F.col("_o") / F.col("_n"))
    return s.select("draw", effect.alias("effect"), off.alias("off_target"), (off / (F.abs(effect) + off + eps)).alias("index"))


def by_protocol(df: DataFrame, cluster: str, effect: str, passed: str, weights: DataFrame) -> DataFrame:
    """(draw, all_records, passing): the mean effect on every record, and on those that passed quality control."""
    ok = F.col(passed).cast("double")
    s = bootstrap_sums(df, cluster, {"_n": F.lit(1.0), "_s": F.col(effect), "_m": ok, "_p": ok * F.col(effect)}, weights)
    return s.select("draw", (F.col("_s") / F.col("_n")).alias("all_records"), (F.col("_p") / F.nullif(F.col("_m"), F.lit(0.0))).alias("passing"))


def wrong_target_margin(df: DataFrame, cluster: str, target: str, effect: str, wanted: str, weights: DataFrame) -> DataFrame:
    """(draw, own, worst_other, margin): the wanted target's mean effect, the largest of any other target, and how far the
    own one is ahead. ``df`` has a row per record and target; ``wanted`` says which rows are of the wanted one."""
    s = bootstrap_sums(df, cluster, {"_n": F.lit(1.0), "_s": F.col(effect)}, weights, [target, wanted])
    m = s.withColumn("_m", F.col("_s") / F.col("_n"))
    out = m.groupBy("draw").agg(F.max(F.when(F.col(wanted), F.col("_m"))).alias("own"), F.max(F.when(~F.col(wanted), F.col("_m"))).alias("worst_other"))
    return out.withColumn("margin", F.col("own") - F.col("worst_other"))


def signed_improvement(df: DataFrame, unit: str, method: str, better: str, baseline: str, value: str, weights: DataFrame, higher: bool = True) -> DataFrame:
    """(draw, improvement): the mean over units of how much better one method is than the other; positive is better."""
    v = df.groupBy(unit).agg(F.avg(F.when(F.col(method) == better, F.col(value))).alias("_b"), F.avg(F.when(F.col(method) == baseline, F.col(value))).alias("_a"))
    d = v.select(unit, ((F.col("_b") - F.col("_a")) * (1 if higher else -1)).alias("_d")).where("_d is not null")
    return d.join(weights, unit).groupBy("draw").agg((F.sum(F.col("w") * F.col("_d")) / F.sum("w")).alias("improvement"))


def permutation_enrichment(items: DataFrame, item: str, group: str, chosen: str, n: int = 200, seed: int = 0) -> DataFrame:
    """(group, size, hits, p, q): whether chosen items are more frequent in a group than among items of equal number that a
    hash draws from all, in ``n`` permutations; add-one p, Benjamini-Hochberg over groups.

    A permutation takes the items of smallest hash. Items are counted by bins of the hash first, which tells the bin in
    which the last one lies; only that bin's items, one in ``BINS``, are ranked, and all before it count as they are."""
    k = items.where(F.col(chosen)).count()
    u = uniform(seed, F.col("draw"), F.col(item))
    drawn = items.select(item, group).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_u", u).withColumn("_bin", F.floor(F.col("_u") * BINS).cast("int"))
    upto = running(drawn.groupBy("draw", "_bin").agg(F.count("*").alias("_n")), "draw", "_bin", {"_before": F.col("_n")})
    last = upto.where((F.col("_before") < k) & (F.col("_before") + F.col("_n") >= k)).select("draw", F.col("_bin").alias("_last"), (k - F.col("_before")).alias("_left"))
    # One row a draw.
    met = drawn.join(F.broadcast(last), "draw", "left")
    before = met.where("_bin < _last").groupBy("draw", group).agg(F.count("*").alias("_h"))
    within = met.where("_bin = _last").withColumn("_k", F.row_number().over(Window.partitionBy("draw").orderBy("_u", item))).where("_k <= _left").groupBy("draw", group).agg(F.count("*").alias("_h"))
    seen = items.groupBy(group).agg(F.count("*").alias("size"), F.count_if(chosen).alias("hits"))
    hit = before.unionByName(within).groupBy("draw", group).agg(F.sum("_h").alias("_h"))
    # A draw without an item of a group has no row, and reaches its hits only if these are none.
    reached = seen.join(hit, group, "left").groupBy(group, "size", "hits").agg(F.when(F.col("hits") == 0, n).otherwise(F.count_if(F.col("_h") >= F.col("hits"))).alias("_r"))
    p = reached.select(group, "size", "hits", ((F.col("_r") + 1) / F.lit(n + 1.0)).alias("p"))
    return adjust(p.withColumn("_all", F.lit(1)), "_all", "p", group).drop("_all")


def inverse_propensity(df: DataFrame, treated: str, strata: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``df`` with ``propensity`` (the share treated in its stratum) and ``weight``: stabilised, and clipped to its own
    quantiles. The model is saturated in the strata, so that it is their means; a stratum of one kind only has no weight."""
    y = F.col(treated).cast("double")
    share = df.groupBy(*strata).agg(F.avg(y).alias("propensity"))
    p, base = F.col("propensity"), df.agg(F.avg(y)).first()[0]
    w = F.when((p > 0) & (p < 1), F.when(F.col(treated), F.lit(base) / p).otherwise(F.lit(1 - base) / (1 - p)))
    out = df.join(share, strata).withColumn("_w", w)
    a, b = out.agg(F.percentile("_w", F.array(F.lit(low), F.lit(high)))).first()[0]
    return out.withColumn("weight", F.greatest(F.least("_w", F.lit(b)), F.lit(a))).drop("_w")


def interpolated_area(df: DataFrame, keys, x: str, y: str, points: int = 50) -> DataFrame:
    """(keys, area): the mean height over an even grid in ln x of the line through the points, by key; trapezoids, divided
    by the range. Each piece of the line takes the grid's places within it, so that no point meets all places."""
    k = _keys(keys)
    w = Window.partitionBy(*k)
    lx = df.withColumn("_x", F.ln(x))
    s = lx.withColumn("_lo", F.min("_x").over(w)).withColumn("_step", (F.max("_x").over(w) - F.col("_lo")) / (points - 1))
    s = s.withColumn("_nx", F.lead("_x").over(w.orderBy("_x"))).withColumn("_ny", F.lead(y).over(w.orderBy("_x"))).where("_nx > _x")
    at = (F.col("_x") - F.col("_lo")) / F.col("_step"), (F.col("_nx") - F.col("_lo")) / F.col("_step")
    first, last = F.ceil(at[0] - 1e-9), F.when(at[1] > points - 1 - 1e-6, F.lit(points - 1)).otherwise(F.ceil(at[1] - 1e-9) - 1)
    g = s.withColumn("_g", F.explode(F.when(last >= first, F.sequence(first.cast("int"), last.cast("int")))))
    height = F.col(y) + (F.col("_ny") - F.col(y)) * (F.col("_lo") + F.col("_g") * F.col("_step") - F.col("_x")) / (F.col("_nx") - F.col("_x"))
    half = F.when(F.col("_g").isin(0, points - 1), 0.5).otherwise(1.0)
    return g.groupBy(*k).agg((F.sum(height * half) / (points - 1)).alias("area"))
