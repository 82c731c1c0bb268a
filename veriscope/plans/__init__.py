"""Named queries over the driver's tables, and the same in DuckDB SQL."""

from pyspark.sql import functions as F

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` under a name, with the SQL that gives the same rows."""

    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where a row of ``placed`` stands.
PLACE = ["_file", "_row"]


def placed(spark, sf_dir: str, name: str):
    """The table and each row's place in it, which is total: its file, then its row there."""
    return table(spark, sf_dir, name).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


from . import artifacts, expressions, heads, inference, probes, relations, resampling, sparse, statistics, vectors  # noqa: E402, F401
