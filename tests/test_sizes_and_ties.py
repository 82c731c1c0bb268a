"""Queries on ties and counts that only larger tables have, against their SQL; and plans whose tasks or steps once grew too fast."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veriscope import plans
from veriscope.operators import heads
from veriscope.operators import relational as rel
from veriscope.operators import statistics as st
from veriscope.operators import vectors as v
from veriscope.plans import artifacts
from veriscope.sources import binary


def both(spark, tmp_path, name, **tables):
    """Rows of a query and of its SQL, over tables of DuckDB's SELECTs."""
    duck = duckdb.connect()
    duck.execute("set timezone = 'UTC'")
    for t, sql in tables.items():
        duck.execute(f"copy ({sql}) to '{tmp_path}/{t}.parquet' (format parquet)")
        duck.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    df = plans.queries()[name](spark, str(tmp_path))
    names = ", ".join(f'"{c}"' for c in df.columns)
    key = lambda r: tuple(map(str, r))
    return sorted(map(tuple, df.collect()), key=key), sorted(duck.sql(f"select {names} from ({plans.oracle_sql()[name]})").fetchall(), key=key)


def test_focus_of_halves(spark, tmp_path):
    got, want = both(spark, tmp_path, "prj22_focus_mask", events="select i as event_id, 'click' as event_type, i / 4.0::double as value from range(-8, 12) t(i)")
    assert got == want and (2, False) in got and (5, True) in got


def test_z_scores_in_one_pass(spark, tmp_path):
    # A signal of 3,000 values: each value once took all sums anew, and each of these all means.
    x = np.random.default_rng(0).normal(5, 2, 3000)
    df = spark.createDataFrame([(1, x.tolist()), (2, [3.0, 3.0]), (3, []), (4, None)], "i int, x array<double>")
    got = {r["i"]: r["z"] for r in df.select("i", v.z_scored("x").alias("z")).collect()}
    assert got[1] == pytest.approx((x - x.mean()) / x.std()) and got[2] == [0.0, 0.0] and got[3] == [] and got[4] is None
    # Neither sum is left within the lambda over the values.
    deep = df.select(v.z_scored("x").alias("z"))._jdf.queryExecution().optimizedPlan().toString()
    assert deep.count("aggregate(") == 2


@pytest.mark.parametrize("small", [0, 1 << 62])
def test_manifests_of_many_lines(spark, tmp_path, monkeypatch, small):
    # One segment of more lines than a block of digests once had; the hash is that of all of them.
    monkeypatch.setattr(rel, "SMALL", small)
    got, want = both(spark, tmp_path, "hsh08_design_hash", customer="select (i * 7919) % 70001 as c_custkey, case when i % 70 = 0 then 'b' end as c_mktsegment from range(70001) t(i) union all select 80000, 'c'")
    assert got == want and len(got) == 3
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 3, "y"), ("b", 1, None)], "k string, o int, line string")
    rows = {r["k"]: r["manifest"] for r in rel.ordered_manifest(df, "k", "line", "o", prefix="p;", whole=True).collect()}
    assert rows == {"a": hashlib.sha256(b"p;x\ny").hexdigest(), "b": None}


def test_means_on_a_rounding_edge(spark):
    # 0.015625 * k / 2 and the like: doubles summed in two orders differ in the last bit; 640 values of two places meet edges at the eighth.
    values = np.random.default_rng(0).integers(0, 11, 640) / 100
    values[0] += (1 - round(values.sum() * 100) % 2) / 100
    exact = (2 * 10**6 * int(np.rint(values * 100).sum()) + 640) // (2 * 640) / 10**8
    for order in (np.sort(values), np.sort(values)[::-1], values):
        for parts in (1, 7):
            df = spark.createDataFrame([(float(x),) for x in order], "x double").repartition(parts)
            assert df.agg(st.rounded_mean("x", 8)).collect()[0][0] == exact
    odd = spark.createDataFrame([(1, float("inf")), (2, None), (3, 1.0), (3, None)], "k int, x double").groupBy("k").agg(st.rounded_mean("x", 8).alias("m"))
    assert {r["k"]: r["m"] for r in odd.collect()} == {1: float("inf"), 2: None, 3: 1.0}


def test_small_ranges_share_a_task(spark, tmp_path):
    x = np.arange(60.0).reshape(20, 3)
    for i in range(30):
        np.save(tmp_path / f"{i}.npy", x + i)
    df = binary.read_matrices(spark, str(tmp_path), range_bytes=96, task_bytes=binary.RANGE)
    assert df.rdd.getNumPartitions() == 1
    got = {(r["file"].rsplit("/", 1)[1], r["row"]): r["values"] for r in df.collect()}
    assert got == {(f"{i}.npy", j): (x[j] + i).tolist() for i in range(30) for j in range(20)}


def test_records_need_no_folder_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(artifacts.src, "scratch_folder", lambda s: str(tmp_path / "records"))
    got, want = both(spark, tmp_path, "src10_record_headers", supplier="select i as s_suppkey, (i % 25)::int as s_nationkey from range(300) t(i)")
    assert got == want and len(list(tmp_path.glob("records/*/*.txt"))) == 300 and len(list(tmp_path.glob("records/*"))) == 64


@pytest.mark.parametrize("meet", [0, 1 << 20])
def test_nearest_in_plane(spark, monkeypatch, meet):
    # Crowds of equal points, ties, and points far off, against all pairs.
    monkeypatch.setattr(rel, "MEET", meet)
    rng = np.random.default_rng(3)
    xy = np.concatenate([rng.normal(0, 1, (300, 2)).round(1), rng.normal(5, 0.001, (200, 2)), np.full((200, 2), 0.5), [[1000.0, -40.0], [-7.0, 300.0]]])
    pool = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)], "other int, f double, m double").repartition(3)
    asked = np.concatenate([xy[::9] + 0.05, xy[500:505], [[990.0, 0.0]]])
    targets = spark.createDataFrame([*((i, *map(float, p)) for i, p in enumerate(asked)), (10_000, None, 1.0)], "target int, f double, m double")
    want = {(i, int(j), k + 1) for i, p in enumerate(asked) for k, j in enumerate(np.lexsort((np.arange(len(xy)), np.abs(xy - p).sum(1).round(9)))[:5])}
    assert {(r["target"], r["other"], r["place"]) for r in rel.nearest_in_plane(targets, pool, "target", "other", ["f", "m"], 5).collect()} == want
    assert rel.nearest_in_plane(targets, pool.where("other < 3"), "target", "other", ["f", "m"], 5).count() == 3 * len(asked)
    assert rel.nearest_in_plane(targets, pool.where("false"), "target", "other", ["f", "m"], 5).isEmpty()


def test_fits_compute_their_rows_once(spark):
    rng = np.random.default_rng(4)
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        reads.add(1)
        yield from batches

    x = rng.normal(size=400)
    df = spark.createDataFrame([(["a", "b", None][i % 3], [float(v)], float(rng.random() < 1 / (1 + np.exp(-v)))) for i, v in enumerate(x)], "g string, v array<double>, y double").coalesce(1)
    fits = heads.LogisticFits((1.0,), balanced=False).fit(df.mapInArrow(count, df.schema), "v", ["y"], "g")
    assert {p.group for p in fits.problems} == {"a", "b"} and fits.scans > 4 and reads.value <= 2


@pytest.mark.parametrize("name, mean", [("aud10_arm_agreement", 0.0625), ("prj44_recon_gate", 0.05), ("prj28_taxonomy", 0.04)])
def test_means_that_meet_an_edge(spark, tmp_path, name, mean):
    # Groups whose mean is just on the edge, in many row groups, each a task's: the order in which doubles are added decides.
    import pyarrow as pa
    import pyarrow.parquet as pq

    side, each, i = 40, 400, np.arange(16000)
    half = np.random.default_rng(0).integers(0, round(mean * 200) + 1, (each // 4, 2, side))
    four = np.concatenate([half, round(mean * 200) - half], axis=1)
    four[:, 3] += round(mean * 400) - four.sum(axis=1)
    flag = np.array(list("ANRXY"))[i // 8 % 5]
    tables = {
        "lineitem": {"l_orderkey": i // 8 % 50, "l_suppkey": i % 8, "l_returnflag": flag, "l_discount": four.reshape(-1) / 100},
        "orders": {"o_orderkey": np.arange(50), "o_custkey": np.arange(50)},
        "customer": {"c_custkey": np.arange(50), "c_nationkey": np.arange(50) % 5},
        "nation": {"n_nationkey": np.arange(5), "n_regionkey": np.arange(5)},
        "region": {"r_regionkey": np.arange(5)},
        "supplier": {"s_suppkey": np.arange(8)},
    }
    duck = duckdb.connect()
    duck.execute("set threads = 1")
    for t, columns in tables.items():
        pq.write_table(pa.table(columns), f"{tmp_path}/{t}.parquet", row_group_size=500)
        duck.execute(f"create view {t} as from '{tmp_path}/{t}.parquet'")
    want = sorted(duck.sql(plans.oracle_sql()[name]).fetchall())
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (1 << 12, 1 << 27):
            for c in kept:
                spark.conf.set(c, size)
            df = plans.queries()[name](spark, str(tmp_path))
            assert sorted(map(tuple, df.select(duck.sql(plans.oracle_sql()[name]).columns).collect())) == want
    finally:
        for c, v_ in kept.items():
            spark.conf.set(c, v_)


def test_rounding_lifts_what_its_product_lifts(spark):
    x = [0.058499999999999996, 0.0585, 0.05849999, -0.058499999999999996, 0.0, float("nan"), None]
    df = spark.createDataFrame([(v_,) for v_ in x], "x double").select(st.rounded_product(F.col("x"), 3).alias("y"))
    got = [r["y"] for r in df.collect()]
    want = [r[0] for r in duckdb.sql("select round(x, 3) from (select unnest([0.058499999999999996::double, 0.0585, 0.05849999, -0.058499999999999996, 0])) t(x)").fetchall()]
    assert got[:5] == want == [0.059, 0.059, 0.058, -0.059, 0.0] and np.isnan(got[5]) and got[6] is None
