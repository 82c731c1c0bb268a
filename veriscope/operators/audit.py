"""Checks that return what is wrong, as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rejected(ValueError):
    pass


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise Rejected(f"missing columns: {missing}")
    return df


def require_empty(problems: DataFrame, what: str) -> None:
    if rows := problems.limit(5).collect():
        raise Rejected(f"{what}: {[r.asDict() for r in rows]}")


def reasons(df: DataFrame, key, rules: dict[str, Column]) -> DataFrame:
    """Keys with the names of the rules that they break."""
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    keys = [key] if isinstance(key, str) else list(key)
    return df.select(*keys, broken.alias("reasons")).where(F.size("reasons") > 0)


def not_constant(df: DataFrame, block, attributes) -> DataFrame:
    """Blocks in which an attribute has more than one value: (block, attribute, n)."""
    b = [block] if isinstance(block, str) else list(block)
    n = df.groupBy(*b).agg(*[F.countDistinct(F.coalesce(F.col(a).cast("string"), F.lit("\0"))).alias(a) for a in attributes])
    return n.unpivot(b, list(attributes), "attribute", "n").where("n > 1")


def not_finite(df: DataFrame, columns) -> DataFrame:
    """Columns with nulls, NaN or infinities, and how many."""
    bad = [F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).alias(c) for c in columns]
    return df.agg(*bad).unpivot([], list(columns), "column", "n").where("n > 0")


def differing(a: DataFrame, b: DataFrame, keys, values, tolerance: float) -> DataFrame:
    """Largest absolute difference of each value over common keys, where above the tolerance; and keys without a partner."""
    k = [keys] if isinstance(keys, str) else list(keys)
    j = a.select(*k, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(1).alias("_l")).join(b.select(*k, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(1).alias("_r")), k, "full")
    worst = [F.max(F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}"))).alias(v) for v in values]
    alone = F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).cast("double").alias("unmatched")
    return j.agg(*worst, alone).unpivot([], [*values, "unmatched"], "value", "worst").where(F.col("worst") > F.when(F.col("value") == "unmatched", 0.0).otherwise(tolerance))


def gates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows pass each rule, and all of them."""
    every = reduce(lambda a, b: a & b, rules.values())
    return df.agg(F.count("*").alias("n"), *[F.count_if(r).alias(k) for k, r in rules.items()], F.count_if(every).alias("all_pass"))


def complete_grid(df: DataFrame, problems: DataFrame, what: str) -> DataFrame:
    """``df``, unless its grid has problems: nothing is inferred from a part."""
    require_empty(problems, what)
    return df


def outside(paths: DataFrame, path: str, root: str) -> DataFrame:
    """Paths that are not below ``root``: absolute elsewhere, or climbing out."""
    p = F.col(path)
    inside = p.startswith(root.rstrip("/") + "/") & ~p.rlike(r"(^|/)\.\.(/|$)")
    return paths.where(~inside | p.isNull())


def requirements(have: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(key, present, size): each wanted artifact with whether it is there and not empty."""
    return wanted.select(key).join(have.select(key, "size"), key, "left").select(key, (F.coalesce("size", F.lit(0)) > 0).alias("present"), F.coalesce("size", F.lit(0)).alias("size"))


def agreement(df: DataFrame, keys, value: str) -> DataFrame:
    """(keys, n, distinct, spread): whether the arms of a cell agree."""
    k = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*k).agg(F.count(value).alias("n"), F.countDistinct(value).alias("distinct"), (F.max(value) - F.min(value)).alias("spread"))


def widths(df: DataFrame, vector: str, width: int) -> DataFrame:
    """(n, wrong): rows, and those whose vector has another width."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(vector).isNull() | (F.size(vector) != width)).alias("wrong"))
