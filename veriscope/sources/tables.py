"""Scans and their checks: text tables with explicit schemas, shards, headers, documents, waveforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_strings(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """CSV, also gzipped, with every column a string; without ``columns`` the header names them."""
    reader = spark.read.option("header", True).option("escape", '"')
    return reader.schema(", ".join(f"`{c}` string" for c in columns)).csv(path) if columns else reader.option("inferSchema", False).csv(path)


def header(spark: SparkSession, path) -> list[str]:
    return read_strings(spark, path).columns


def read_first(spark: SparkSession, *paths: str) -> DataFrame:
    """The first source that has rows."""
    for path in paths[:-1]:
        try:
            df = read_strings(spark, path)
            if not df.isEmpty():
                return df
        except Exception as e:  # a source that is not there
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return read_strings(spark, paths[-1])


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several files with the file of each row, for checks by file."""
    return read_strings(spark, paths).withColumn("file", F.input_file_name())


def id_set(df: DataFrame, column: str) -> DataFrame:
    """Distinct ids that are not blank."""
    return df.select(F.col(column).cast("string").alias("id")).where(F.col("id") != "").distinct()


def file_census(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder by suffix: number and bytes; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.groupBy(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("suffix")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def record_headers(spark: SparkSession, path: str) -> DataFrame:
    """Signal headers, one file each: record, leads, rate, samples, and a row of the file per lead."""
    whole = spark.read.text(path, wholetext=True).select(F.split(F.trim("value"), "\n").alias("lines"))
    first = F.split(F.col("lines")[0], r"\s+")
    named = whole.select(first[0].alias("record"), first[1].cast("int").alias("leads"), first[2].cast("double").alias("rate"), first[3].cast("long").alias("samples"), F.slice("lines", 2, first[1].cast("int")).alias("rows"))
    line = named.select("record", "leads", "rate", "samples", F.posexplode("rows").alias("i", "line"))
    gain, baseline = calibration(F.col("line"))
    return line.select("record", "leads", "rate", "samples", "i", F.element_at(F.split("line", r"\s+"), -1).alias("lead"), gain.alias("gain"), baseline.alias("baseline"))


def calibration(line: Column) -> tuple[Column, Column]:
    """Gain and baseline of a header line, as in ``1000(-10)/mV``; baseline 0 where there is none."""
    pattern = r" (-?[0-9.]+)\(?(-?[0-9]*)\)?/mV"
    gain = F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).cast("double")
    return gain, F.coalesce(F.nullif(F.regexp_extract(line, pattern, 2), F.lit("")), F.lit("0")).cast("int")


def physical_units(raw: Column, gain: Column, baseline: Column) -> Column:
    return F.transform(raw, lambda x: (x - baseline) / gain)


def mean_pool(tokens: Column) -> Column:
    """The mean of some equally long vectors; null where lengths differ."""
    n = F.size(tokens)
    total = F.aggregate(F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), tokens[0], lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return F.transform(total, lambda x: x / n)


def from_documents(df: DataFrame, column: str, schema: str) -> DataFrame:
    """A JSON column's fields beside the others; what does not parse is null."""
    return df.withColumn("_doc", F.from_json(column, schema)).select(*df.columns, "_doc.*")


def with_offsets(shards: DataFrame, order: str, size: str) -> DataFrame:
    """Where each shard's rows begin. One window over the shards' table."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)))


def shard_index(rows: DataFrame, shards: DataFrame, key: str, split: Column) -> DataFrame:
    """(key, split, shard, row): where each key's row is. ``shards`` has ``shard`` and ``keys`` (array, in the order of the
    shard's rows); rows that no shard has keep nulls."""
    place = shards.select("shard", F.posexplode("keys").alias("row", key))
    return rows.select(key, split.alias("split")).join(place, key, "left").select(key, "split", "shard", "row")


def waveform_index(paths: DataFrame, path: str = "path") -> DataFrame:
    """(record, path): the file of each record, by its name; of several the first."""
    named = paths.select(F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1).alias("record"), F.col(path).alias("path")).where("record <> ''")
    return named.groupBy("record").agg(F.min("path").alias("path"))


def ordered_leads(signals: DataFrame, key: str, lead: str, signal: str, order: list[str]) -> DataFrame:
    """(key, leads): the signals of each record in the given order of leads; a record without one of them has null there."""
    named = signals.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.upper(lead), signal))).alias("_m"))
    return named.select(key, F.array(*[F.try_element_at("_m", F.lit(x.upper())) for x in order]).alias("leads"))


def scratch_folder(spark: SparkSession) -> str:
    """A new path that driver and executors share, below spark.checkpoint.dir, or a local folder in local mode. What is
    written there goes when the session's JVM ends."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="spark-")
    folder = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return f"{folder}/data"


def with_contiguity(shards: DataFrame, order: str, start: str, size: str) -> DataFrame:
    end = F.lag(F.col(start) + F.col(size), 1, 0).over(Window.orderBy(order))
    return shards.withColumn("contiguous", F.col(start) == end)


def merge_report(got: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """Keys that are missing, extra or duplicate among merged shards."""
    n = got.groupBy(key).agg(F.count("*").alias("_n"))
    both = n.join(want.select(key).distinct().withColumn("_w", F.lit(1)), key, "full")
    return both.select(key, F.when(F.col("_n").isNull(), "missing").when(F.col("_w").isNull(), "extra").when(F.col("_n") > 1, "duplicate").alias("issue")).where("issue is not null")


def pack_arrays(df: DataFrame, group: str, name: str, vector: str, order: str, rows: int = 65536) -> DataFrame:
    """(group, part, content): archives of a matrix each, a group's rows in order, ``rows`` of them to an archive, so that no
    group has to fit into one task. ``order`` must be distinct within a group."""
    import io

    import numpy as np
    import pyarrow as pa

    from ..operators.relational import running

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by(order)
        x = np.array(t[vector].to_pylist(), float)
        out = io.BytesIO()
        np.savez_compressed(out, **{name: x, order: t[order].to_numpy()})
        return pa.table({group: t[group][:1], "part": t["part"][:1], "content": pa.array([out.getvalue()], pa.binary())})

    kind = dict(df.dtypes)[group]
    at = running(df.select(group, order), group, order, {"_before": F.lit(1).cast("long")}).select(group, order, F.floor(F.col("_before") / rows).cast("long").alias("part"))
    placed = df.select(group, order, F.col(vector).cast("array<double>").alias(vector)).join(at, [group, order])
    return placed.groupBy(group, "part").applyInArrow(run, f"{group} {kind}, part long, content binary")


def unpack_arrays(df: DataFrame, keys: list[str], content: str, array: str, ids: str) -> DataFrame:
    """(keys, ids, array): the rows of the matrices in archives, each with its id."""
    import io

    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for i, raw in enumerate(b.column(content).to_pylist()):
                with np.load(io.BytesIO(raw)) as z:
                    x, at = z[array], z[ids]
                cols = [pa.array([b.column(k)[i].as_py()] * len(x), b.column(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(at), pa.array(list(x), pa.list_(pa.float64()))], [*keys, ids, array])

    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    return df.select(*keys, content).mapInArrow(run, f"{kinds}, {ids} long, {array} array<double>")
