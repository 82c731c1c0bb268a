"""Association, ranking, inference: sufficient statistics first, then small tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import _keys, few, is_small, numbered, running, top_per_key

# Correlation


def sufficient(df: DataFrame, cluster, z: str, y: str) -> DataFrame:
    """Per cluster n, sums, sums of squares and products, over rows where both values are there."""
    zz, yy = F.col(z), F.col(y)
    both = df.where(zz.isNotNull() & yy.isNotNull())
    return both.groupBy(*_keys(cluster)).agg(F.count("*").alias("n"), F.sum(zz).alias("s_z"), F.sum(zz * zz).alias("s_zz"), F.sum(yy).alias("s_y"), F.sum(yy * yy).alias("s_yy"), F.sum(zz * yy).alias("s_zy"))


def correlation(n, s_z, s_zz, s_y, s_yy, s_zy, least: float = 1e-12, none: float | None = 0.0, rows: int = 2) -> Column:
    """Pearson from sums, within ±1; ``none`` where there are too few rows, or where a variance is as good as zero: the sum of
    squares about the mean is below ``least``, or below what is left of the raw sum after rounding."""
    n, s_z, s_zz, s_y, s_yy, s_zy = (c if isinstance(c, Column) else F.col(c) for c in (n, s_z, s_zz, s_y, s_yy, s_zy))
    vz, vy = s_zz - s_z * s_z / n, s_yy - s_y * s_y / n
    r = (s_zy - s_z * s_y / n) / F.sqrt(vz * vy)
    flat = lambda var, raw: (var <= least) | (var <= 1e-14 * raw)
    return F.when((n >= rows) & ~flat(vz, s_zz) & ~flat(vy, s_yy), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(none).cast("double"))


SUMS = ("n", "s_z", "s_zz", "s_y", "s_yy", "s_zy")


def correlations(df: DataFrame, keys, z: str, y: str, none: float | None = 0.0, rows: int = 2, least: float = 1e-12) -> DataFrame:
    """(keys, n, r): Pearson over rows where both values are there; ``none`` as in ``correlation``. Variances and covariance
    are merged about their means, so that large means cost no digits."""
    zz, yy = (F.when(F.col(z).isNotNull() & F.col(y).isNotNull(), F.col(c)).cast("double") for c in (z, y))
    s = df.groupBy(*_keys(keys)).agg(F.count(zz + yy).alias("n"), F.var_pop(zz).alias("_vz"), F.var_pop(yy).alias("_vy"), F.covar_pop(zz, yy).alias("_c")).where("n > 0")
    r = F.col("_c") / F.sqrt(F.col("_vz") * F.col("_vy"))
    there = (F.col("n") >= rows) & (F.col("_vz") * F.col("n") > least) & (F.col("_vy") * F.col("n") > least)
    return s.select(*_keys(keys), "n", F.when(there, F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0))).otherwise(F.lit(none).cast("double")).alias("r"))


def pilot(df: DataFrame, *columns: str) -> list[float]:
    """One row's values, to be taken off before raw sums are made: sums about a value near the mean keep the digits that
    sums about zero lose where the mean is large. Zeros without such a row."""
    first = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).dropna().first()
    return [x if math.isfinite(x) else 0.0 for x in first] if first else [0.0] * len(columns)


def long_vectors(df: DataFrame, key, vector: str, value: str = "value") -> DataFrame:
    """One row per component: (key, feature from 0, value)."""
    return df.select(*_keys(key), F.posexplode(F.col(vector).cast("array<double>")).alias("feature", value))


def _about_first(rows: DataFrame, key, vector: str, value: str = "value") -> DataFrame:
    """``long_vectors`` less the components of one row's vector (a row a component, sent to every task), so that what is
    averaged is of the size of the deviations."""
    first = rows.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").limit(1)
    about = {r["i"]: r["x"] for r in first.select(F.posexplode("v").alias("i", "x")).collect()}
    table = rows.sparkSession.createDataFrame([(i, x if x is not None and math.isfinite(x) else 0.0) for i, x in about.items()], "feature int, _about double")
    long = long_vectors(rows, key, vector, value).join(F.broadcast(table), "feature", "left")
    return long.withColumn(value, F.col(value) - F.coalesce("_about", F.lit(0.0))).drop("_about")


def select_first_best(assoc: DataFrame, target: str, feature: str, value: str) -> DataFrame:
    """For each target the feature of largest size, the first of equals."""
    return top_per_key(assoc, target, [F.abs(F.col(value)).desc(), F.col(feature)])


def class_correlations(rows: DataFrame, vector: str, label: str, classes: DataFrame) -> DataFrame:
    """Pearson of each feature with each one-vs-rest class: (feature, target, n, r).

    Only n, mean and variance per feature and class are needed, so that no row meets every class; they are merged about
    the features' means.
    """
    long = _about_first(rows.select(label, vector), label, vector)
    per = long.groupBy("feature", label).agg(F.count("*").alias("_n"), F.avg("value").alias("_m"), F.var_pop("value").alias("_v"))
    over = Window.partitionBy("feature")
    mean = (F.sum(F.col("_n") * F.col("_m")).over(over) / F.sum("_n").over(over)).alias("_mean")
    per = per.select("feature", label, "_n", "_v", F.sum("_n").over(over).alias("n"), (F.col("_m") - mean).alias("_gap"))
    total = per.groupBy("feature").agg(F.max("n").alias("n"), F.sum(F.col("_n") * (F.col("_v") + F.col("_gap") * F.col("_gap"))).alias("_sz"))
    mine = per.select("feature", F.col(label).alias("target"), "_n", (F.col("_n") * F.col("_gap")).alias("_c"))
    named = classes.select(F.col(label).alias("target")).distinct()
    every = total.crossJoin(F.broadcast(named) if named.limit(MOST_CLASSES + 1).count() <= MOST_CLASSES else named)
    joined = every.join(mine, ["feature", "target"], "left").na.fill(0, ["_n", "_c"])
    sy = F.col("_n") - F.col("_n") * F.col("_n") / F.col("n")
    r = F.when((F.col("n") >= 2) & (F.col("_sz") > 1e-12) & (sy > 1e-12), F.col("_c") / F.sqrt(F.col("_sz") * sy)).otherwise(0.0)
    return joined.select("feature", "target", "n", F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)).alias("r"))


#: Classes that are sent to every task beside the features; more are joined without.
MOST_CLASSES = 100_000


# Ranks


def mid_ranks(df: DataFrame, keys, value: str) -> DataFrame:
    """Average ranks of ties within a key: by distinct value first, so that ties are counted, not sorted; distinct values are
    ranked by ``running``, so that a key of any number of them is no single task's."""
    k = _keys(keys)
    n = df.groupBy(*k, value).agg(F.count("*").alias("_n"))
    return running(n, k, value, {"_below": F.col("_n")}).withColumn("mid_rank", F.col("_below") + (F.col("_n") + 1) / 2).drop("_below")


def auroc(df: DataFrame, keys, score: str, label: str) -> DataFrame:
    """Tie-aware area under the ROC curve by key; null with one class only."""
    k = _keys(keys)
    n = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*k, score).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("double")).alias("_p"))
    ranked = running(n, k, score, {"_below": F.col("_n")}).withColumn("_rank", F.col("_below") + (F.col("_n") + 1) / 2)
    s = ranked.groupBy(*k).agg(F.sum("_p").alias("p"), F.sum("_n").alias("n"), F.sum(F.col("_rank") * F.col("_p")).alias("rank_sum"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return s.select(*k, "n", F.when((p > 0) & (q > 0), (F.col("rank_sum") - p * (p + 1) / 2) / (p * q)).alias("auroc"))


def class_auroc(rows: DataFrame, vector: str, label: str, digits: int | None = None) -> DataFrame:
    """(feature, target, n, auroc) of each feature as a score of each class against the rest. Ranks are made once a feature,
    by distinct value; a class then needs its own rank sum only, so that no row meets every class."""
    long = long_vectors(rows.select(label, vector), label, vector)
    long = long.withColumn("value", F.round("value", digits)) if digits is not None else long
    per = long.groupBy("feature", "value", label).agg(F.count("*").alias("_p"))
    n = per.groupBy("feature", "value").agg(F.sum("_p").alias("_n"))
    ranked = running(n, "feature", "value", {"_below": F.col("_n")}).select("feature", "value", (F.col("_below") + (F.col("_n") + 1) / 2).alias("_mid"))
    every = n.groupBy("feature").agg(F.sum("_n").alias("n"))
    s = per.join(ranked, ["feature", "value"]).groupBy("feature", F.col(label).alias("target")).agg(F.sum("_p").alias("_p"), F.sum(F.col("_mid") * F.col("_p")).alias("_m"))
    p, q = F.col("_p"), F.col("n") - F.col("_p")
    return s.join(every, "feature").select("feature", "target", "n", F.when((p > 0) & (q > 0), (F.col("_m") - p * (p + 1) / 2) / (p * q)).alias("auroc"))


def reach(df: DataFrame, value: str, name: str = "reach") -> DataFrame:
    """``df`` with the number of rows whose value is as large or larger, itself among them. Rows are counted by distinct
    value first, and these are summed up by ``running``."""
    n = df.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    at_least = running(n, [], F.col("_v").desc(), {"_above": F.col("_n")}).select("_v", (F.col("_above") + F.col("_n")).alias(name))
    return df.join(at_least, F.col(value) == F.col("_v")).drop("_v")


def average_precision(df: DataFrame, keys, score: str, label: str) -> DataFrame:
    """Area under precision and recall, ties taken together."""
    k = _keys(keys)
    n = df.groupBy(*k, score).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("double")).alias("_p"))
    cum = running(n, k, F.col(score).desc(), {"_pa": F.col("_p"), "_na": F.col("_n")}).withColumn("_precision", (F.col("_pa") + F.col("_p")) / (F.col("_na") + F.col("_n")))
    return cum.groupBy(*k).agg((F.sum(F.col("_precision") * F.col("_p")) / F.nullif(F.sum("_p"), F.lit(0.0))).alias("ap"))


def spearman(df: DataFrame, keys, x: str, y: str, rows: int = 2) -> DataFrame:
    """Pearson of average ranks."""
    k = _keys(keys)
    a = mid_ranks(df, k, x).select(*k, x, F.col("mid_rank").alias("_rx"))
    b = mid_ranks(df, k, y).select(*k, y, F.col("mid_rank").alias("_ry"))
    return correlations(df.join(a, [*k, x]).join(b, [*k, y]), k, "_rx", "_ry", none=None, rows=rows)


def kendall(df: DataFrame, keys, item: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-b over the items of a key, for short rankings: items meet in pairs."""
    k = _keys(keys)
    a, b = df.select(*k, F.col(item).alias("ia"), F.col(x).alias("xa"), F.col(y).alias("ya")), df.select(*k, F.col(item).alias("ib"), F.col(x).alias("xb"), F.col(y).alias("yb"))
    s = (a.join(b, k) if k else a.crossJoin(few(b))).where("ia < ib").select(*k, F.signum(F.col("xa") - F.col("xb")).alias("sx"), F.signum(F.col("ya") - F.col("yb")).alias("sy"))
    tau = F.sum(F.col("sx") * F.col("sy")) / F.sqrt(F.nullif(F.sum(F.abs("sx")) * F.sum(F.abs("sy")), F.lit(0.0)))
    return s.groupBy(*k).agg(tau.alias("tau"))


# Curves, thresholds, errors


def log_area(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Trapezoid area over ln x, divided by the range."""
    k = _keys(keys)
    w = Window.partitionBy(*k).orderBy(x)
    step = df.withColumn("_lx", F.ln(x)).withColumn("_nx", F.lead("_lx").over(w)).withColumn("_ny", F.lead(y).over(w))
    area = F.sum((F.col(y) + F.col("_ny")) / 2 * (F.col("_nx") - F.col("_lx")))
    return step.groupBy(*k).agg((area / F.nullif(F.max("_lx") - F.min("_lx"), F.lit(0.0))).alias("area"))


def higher_quantile(df: DataFrame, keys, value: str, q: float) -> DataFrame:
    """The order statistic at or above the quantile, by distinct value first."""
    k = _keys(keys)
    n = df.groupBy(*k, value).agg(F.count("*").alias("_n"))
    upto = running(n, k, value, {"_below": F.col("_n")}).withColumn("_upto", F.col("_below") + F.col("_n"))
    total = n.groupBy(*k).agg(F.sum("_n").alias("_all"))
    r = upto.join(total, k) if k else upto.crossJoin(F.broadcast(total))
    return r.where(F.col("_upto") > F.ceil((F.col("_all") - 1) * F.lit(q))).groupBy(*k).agg(F.min(value).alias("threshold"))


def calibration_error(df: DataFrame, keys, p: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins (the last one closed) and the Brier score."""
    k = _keys(keys)
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    y = F.col(label).cast("double")
    per = df.groupBy(*k, b.alias("_b")).agg(F.count("*").alias("n"), F.avg(p).alias("_p"), F.avg(y).alias("_y"), F.sum((F.col(p) - y) * (F.col(p) - y)).alias("_e"))
    return per.groupBy(*k).agg((F.sum(F.col("n") * F.abs(F.col("_p") - F.col("_y"))) / F.sum("n")).alias("ece"), (F.sum("_e") / F.sum("n")).alias("brier"))


def adjust(df: DataFrame, panel, p: str, tie) -> DataFrame:
    """Benjamini-Hochberg q-values within a panel; rows without p keep none and don't count."""
    k, t = _keys(panel), _keys(tie)
    w = Window.partitionBy(*k)
    have = df.where(F.col(p).isNotNull())
    raw = have.withColumn("_rk", F.row_number().over(w.orderBy(p, *t))).withColumn("_m", F.count("*").over(w))
    raw = raw.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rk"))
    q = F.min("_raw").over(w.orderBy(F.col("_rk").desc()).rowsBetween(Window.unboundedPreceding, 0))
    done = raw.withColumn("q", F.least(q, F.lit(1.0))).drop("_rk", "_m", "_raw")
    return done.unionByName(df.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def adjust_large(df: DataFrame, p: str, tie) -> DataFrame:
    """``adjust`` of one panel of any size: places come from ranges, and so does the reverse running minimum, which takes a
    window within each range and the least of the later ones. A small panel is one window's."""
    if is_small(df):
        return adjust(df.withColumn("_panel", F.lit(1)), "_panel", p, tie).drop("_panel")
    have = df.where(F.col(p).isNotNull())
    at = numbered(have, [p, *_keys(tie)], "_i", "_part")
    sizes = at.groupBy("_part").agg(F.count("*").alias("_n"), F.min(F.col(p) / F.col("_i")).alias("_least"))
    later = sizes.select("_part", F.min("_least").over(Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)).alias("_later"), F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_m"))
    own = F.min(F.col(p) / F.col("_i")).over(Window.partitionBy("_part").orderBy(F.col("_i").desc()))
    done = at.withColumn("_own", own).join(F.broadcast(later), "_part").withColumn("q", F.least(F.least("_own", "_later") * F.col("_m"), F.lit(1.0)))
    return done.drop("_i", "_part", "_own", "_later", "_m").unionByName(df.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def smd(df: DataFrame, keys, group: str, value: str) -> DataFrame:
    """Standardised mean difference between group true and false, by sample variances."""
    g, v = F.col(group), F.col(value)
    s = df.groupBy(*_keys(keys)).agg(F.avg(F.when(g, v)).alias("_a"), F.avg(F.when(~g, v)).alias("_b"), F.var_samp(F.when(g, v)).alias("_va"), F.var_samp(F.when(~g, v)).alias("_vb"))
    return s.select(*_keys(keys), ((F.col("_a") - F.col("_b")) / F.sqrt(F.nullif((F.col("_va") + F.col("_vb")) / 2, F.lit(0.0)))).alias("smd"))


def slope(df: DataFrame, keys, x: str, y: str) -> DataFrame:
    """Least squares line with the slope's standard error, from sums about the means."""
    zz, yy = (F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(c)).cast("double") for c in (x, y))
    s = df.groupBy(*_keys(keys)).agg(F.count(zz + yy).alias("n"), F.avg(zz).alias("_x"), F.avg(yy).alias("_y"), F.var_pop(zz).alias("_vx"), F.var_pop(yy).alias("_vy"), F.covar_pop(zz, yy).alias("_c")).where("n > 0")
    n, vx = F.col("n"), F.nullif("_vx", F.lit(0.0))
    b = F.col("_c") / vx
    rest = F.greatest(F.col("_vy") - b * F.col("_c"), F.lit(0.0))
    return s.select(*_keys(keys), "n", b.alias("slope"), (F.col("_y") - b * F.col("_x")).alias("intercept"), F.sqrt(rest / F.nullif(n - 2, F.lit(0)) / vx).alias("se"))


# Bootstrap


def draws(spark, clusters: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, cluster, w): Poisson weights of mean 1 by hash, which every engine and every rerun gets alike.

    The weight is where a hash fraction falls in the Poisson distribution, cut at 6 (one case in twelve thousand).
    """
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    edges, total = [], 0.0
    for k in range(6):
        total += math.exp(-1) / math.factorial(k)
        edges.append(round(total, 6))
    weight = sum(((u >= e).cast("int") for e in edges[1:]), (u >= edges[0]).cast("int"))
    return clusters.select(key).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("draw", key, weight.cast("int").alias("w")).where("w > 0")


def bootstrap_correlation(df: DataFrame, cluster: str, z: str, y: str, weights: DataFrame) -> DataFrame:
    """(draw, r): clusters are summed up before they meet the draws, so that rows are read once. Sums
    are taken about one row's values."""
    z0, y0 = pilot(df, z, y)
    s = sufficient(df.withColumns({z: F.col(z) - z0, y: F.col(y) - y0}), cluster, z, y).join(weights, cluster)
    w = F.col("w")
    sums = s.groupBy("draw").agg(*[F.sum(w * F.col(c)).alias(c) for c in SUMS])
    return sums.select("draw", correlation(*SUMS).alias("r"))


def bootstrap_mean(df: DataFrame, cluster: str, value: str, weights: DataFrame, by_record: bool = True) -> DataFrame:
    """(draw, mean): weighted by records, or each cluster's mean alike."""
    per = df.groupBy(cluster).agg(F.avg(value).alias("_m"), F.count(value).alias("_n")).join(weights, cluster)
    w = F.col("w") * F.col("_n") if by_record else F.col("w")
    return per.groupBy("draw").agg((F.sum(w * F.col("_m")) / F.sum(w)).alias("mean"))


def interval(df: DataFrame, keys, value: str, null: float = 0.0) -> DataFrame:
    """Percentile interval and add-one p-values of draws."""
    k = _keys(keys)
    v, n = F.col(value), F.count(value)
    above, below = F.count_if(v >= null), F.count_if(v <= null)
    q = F.percentile(v, F.array(F.lit(0.025), F.lit(0.975)))
    s = df.groupBy(*k).agg(F.avg(v).alias("mean"), q.alias("_q"), ((below + 1) / (n + 1)).alias("p_greater"), F.least(F.lit(1.0), 2 * (F.least(above, below) + 1) / (n + 1)).alias("p_two"))
    return s.select(*k, "mean", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"), "p_greater", "p_two")


# Contracts over grouped values


def robust_scale(df: DataFrame, keys, value: str, least: float = 1e-8, fallback: float | None = 1.0) -> DataFrame:
    """(keys, median, scale): the interquartile range; where it is as good as zero the deviation, then ``fallback``. With
    ``fallback`` None the range itself, at least ``least``."""
    k = _keys(keys)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = df.groupBy(*k).agg(q.alias("_q"), F.stddev_pop(value).alias("_sd"))
    iqr = F.col("_q")[2] - F.col("_q")[0]
    scale = F.greatest(iqr, F.lit(least)) if fallback is None else F.when(iqr > least, iqr).when(F.col("_sd") > least, F.col("_sd")).otherwise(fallback)
    return s.select(*k, F.col("_q")[1].alias("median"), scale.alias("scale"))


def weighted_auroc(df: DataFrame, keys, score: str, label: str, weight: str) -> DataFrame:
    """(keys, auroc): tie-aware, each row with its weight; null with one class only."""
    k, y, w = _keys(keys), F.col(label), F.col(weight)
    a = df.groupBy(*k, score).agg(F.sum(F.when(y, w).otherwise(0)).alias("_p"), F.sum(F.when(y, 0).otherwise(w)).alias("_q"))
    s = running(a, k, score, {"_below": F.col("_q")}).groupBy(*k).agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_q") / 2)).alias("_u"), F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    return s.select(*k, (F.col("_u") / F.nullif((F.col("_p") * F.col("_q")).cast("double"), F.lit(0.0))).alias("auroc"))


def peak_and_gap(df: DataFrame, keys, item: str, value: str) -> DataFrame:
    """(keys, item, peak, second, gap): each group's largest value, the next one, and their distance; first of equals."""
    k = _keys(keys)
    w = Window.partitionBy(*k).orderBy(F.col(value).desc(), item)
    r = df.withColumn("_i", F.row_number().over(w)).withColumn("second", F.lead(value).over(w)).where("_i = 1")
    return r.select(*k, item, F.col(value).alias("peak"), "second", (F.col(value) - F.col("second")).alias("gap"))


def rounded_mean(value: str, digits: int) -> Column:
    """The mean of numbers of up to ten decimal places, rounded half up. Sums are decimals: sums of doubles depend on the order
    of rows in their last bit, and means on a rounding edge, or equal ones, with them. Numbers that aren't finite, or are of
    1e10 or more, are averaged as doubles."""
    exact = F.col(value).try_cast("decimal(20,10)")
    n = F.count(value)
    mean = F.sum(exact) / F.nullif(n, F.lit(0)).cast("decimal(10,0)")
    return F.when(F.count(exact) == n, F.round(mean, digits).cast("double")).otherwise(F.round(F.avg(value), digits))


def ordered_means(df: DataFrame, keys, order, **values: str) -> DataFrame:
    """(keys, n, a mean for each name): plain means of doubles, added up one by one in the order given, which must be total
    within a key, so that they don't hang on how rows are dealt over tasks: for means that meet an edge, where the last bit
    decides, and must agree with a reader that takes the rows in turn. n counts rows. A key's rows are sorted and may spill."""
    k = _keys(keys)
    w = Window.partitionBy(*k).orderBy(*_keys(order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    each = df.select(*k, *[F.avg(c).over(w).alias(name) for name, c in values.items()])
    return each.groupBy(*k).agg(F.count("*").alias("n"), *[F.max(name).alias(name) for name in values])


def rounded_product(value: Column, digits: int) -> Column:
    """``value`` rounded by its product with a power of ten, as other engines do: this may lift a double just below an edge."""
    return F.round(value * 10.0**digits) / 10.0**digits


def directed_rank(df: DataFrame, keys, value: str, larger_first: Column, tie: str) -> DataFrame:
    """``df`` with ``place`` from 1 within a group: the largest first where ``larger_first``, else the smallest."""
    v = F.col(value)
    w = Window.partitionBy(*_keys(keys)).orderBy(F.when(larger_first, -v).otherwise(v), tie)
    return df.withColumn("place", F.row_number().over(w).cast("long"))


def successive_differences(df: DataFrame, keys, order, value: Column, name: str = "gap") -> DataFrame:
    """``df`` with the next row's value of the group less its own; null at the last."""
    w = Window.partitionBy(*_keys(keys)).orderBy(*_keys(order))
    return df.withColumn(name, F.lead(value).over(w) - value)


def cumulative_weight(df: DataFrame, keys, value: str) -> DataFrame:
    """(keys, value, below): how many rows of the group have this value or a smaller one, by distinct value."""
    k = _keys(keys)
    n = df.groupBy(*k, value).agg(F.count("*").alias("_n"))
    return running(n, k, value, {"_before": F.col("_n")}).select(*k, value, (F.col("_before") + F.col("_n")).alias("below"))


def round_robin(rankings: list[tuple[DataFrame, str]], item: str, most: int) -> DataFrame:
    """(item, place): the first ``most`` of several rankings (table, column; largest first), taken in turn; an item counts
    where it comes first."""
    parts = None
    for member, (df, value) in enumerate(rankings):
        top = df.orderBy(F.col(value).desc(), item).limit(most)
        turn = F.row_number().over(Window.orderBy(F.col(value).desc(), item)) * len(rankings) + member
        parts = top.select(item, turn.alias("_k")) if parts is None else parts.unionByName(top.select(item, turn.alias("_k")))
    first = parts.groupBy(item).agg(F.min("_k").alias("_k"))
    return first.select(item, F.row_number().over(Window.orderBy("_k")).cast("long").alias("place"))


def monotonic(df: DataFrame, keys, order, value: str, slack: float = 1e-6) -> DataFrame:
    """(keys, monotonic): whether no value falls below the one before by more than ``slack``."""
    k = _keys(keys)
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*k).orderBy(*_keys(order)))
    return df.select(*k, step.alias("_step")).groupBy(*k).agg(F.coalesce(F.bool_and(F.col("_step") >= -slack), F.lit(True)).alias("monotonic"))


def closure(df: DataFrame, keys, value: str, part: Column, reference: float, least: float = 0.5) -> DataFrame:
    """(keys, closure): how much of a group's distance from a reference its part closes; null where there is none to close."""
    s = df.groupBy(*_keys(keys)).agg(F.avg(value).alias("_m"), F.avg(F.when(part, F.col(value))).alias("_a"))
    whole = F.col("_m") - reference
    return s.select(*_keys(keys), F.when(F.abs(whole) >= least, (F.col("_a") - reference) / whole).alias("closure"))


def common_effect(df: DataFrame, key: str, effect: str, cells: int, cap: float, floor: float) -> DataFrame:
    """(key, common, status): the least effect of a key's cells, capped; whether all cells are there and it reaches the
    floor."""
    m = df.groupBy(key).agg(F.least(F.lit(cap), F.min(effect)).alias("common"), F.count("*").alias("_n"))
    status = F.when(F.col("_n") < cells, "incomplete").when(F.col("common") >= floor, "eligible").otherwise("below_floor")
    return m.select(key, "common", status.alias("status"))


def record_metrics(df: DataFrame, key: str, change: str, wanted: Column) -> DataFrame:
    """(key, target, cross_rms, top, l2) of a record's changes: the wanted one, the root mean square of the others, the
    largest in size, and the length of all."""
    x = F.col(change)
    return df.groupBy(key).agg(F.max(F.when(wanted, x)).alias("target"), F.sqrt(F.avg(F.when(~wanted, x * x))).alias("cross_rms"), F.max(F.abs(x)).alias("top"), F.sqrt(F.sum(x * x)).alias("l2"))


def tier_flags(df: DataFrame, value: str, limits) -> DataFrame:
    """``df`` with a flag for each limit that a value is above, and ``tiers``, how many these are."""
    flags = {f"tier{i}": F.col(value) > x for i, x in enumerate(limits)}
    return df.withColumns(flags).withColumn("tiers", sum((F.col(c).cast("int") for c in flags), F.lit(0)))


def dose_sweep(df: DataFrame, key: str, effect: str, doses, offset: float = 0.0) -> DataFrame:
    """(key, dose, effect): mean effects, linear in the dose, so that doses meet one row per key."""
    m = df.groupBy(key).agg(F.avg(effect).alias("_m"))
    return m.select(key, "_m", F.explode(F.array(*map(F.lit, doses))).alias("dose")).select(key, "dose", (F.col("dose") * F.col("_m") + offset).alias("effect"))


def between_classes(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(r2,): the share of the variance of all components that class means explain, from sums by class and component; rows
    are read once and joined with nothing."""
    per = _about_first(df.select(label, vector), label, vector, "_x").groupBy(label, "feature").agg(F.count("*").alias("_n"), F.avg("_x").alias("_m"), F.var_pop("_x").alias("_v"))
    over = Window.partitionBy("feature")
    gap = F.col("_m") - F.sum(F.col("_n") * F.col("_m")).over(over) / F.sum("_n").over(over)
    s = per.withColumn("_gap", gap).agg(F.sum(F.col("_n") * F.col("_v")).alias("_e"), F.sum(F.col("_n") * F.col("_gap") * F.col("_gap")).alias("_b"))
    return s.select((1 - F.col("_e") / (F.col("_e") + F.col("_b"))).alias("r2"))
