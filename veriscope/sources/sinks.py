"""Writers that check what they write, and text forms of small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, fields: list[str], compress: bool = False) -> None:
    """CSV with a header and the fields in this order."""
    df.select(*fields).write.option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def write_not_empty(df: DataFrame, path: str) -> None:
    """Parquet, unless there is nothing to write."""
    if df.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    df.write.parquet(path)


def digits(c, n: int) -> Column:
    """A number as text of ``n`` significant digits."""
    x = c if isinstance(c, Column) else F.col(c)
    places = F.when(x == 0, 0).otherwise(n - 1 - F.floor(F.log10(F.abs(x))))
    # Scaling by powers of ten and rounding leaves no more digits than asked for.
    scale = F.pow(F.lit(10.0), places)
    return (F.round(x * scale) / scale).cast("string")


def markdown(df: DataFrame, order: list[str], most: int = 200) -> str:
    """The first ``most`` rows as a table for a report."""
    rows = df.orderBy(*order).limit(most).collect()
    lines = [df.columns, ["---"] * len(df.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
