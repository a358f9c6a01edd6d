"""Reuse of finished steps, and layouts that a probe reads in part."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellwalk.operators import raster
from fellwalk.plans.bake import run
from fellwalk.plans.config import Config
from fellwalk.plans.store import content


def grid(spark, z):
    return spark.createDataFrame([(0, int(r), int(c), float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])], "grid_id int, r int, c int, z double")


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(f)}


def test_a_second_run_writes_nothing(spark, tmp_path):
    z = 1000 + np.add.outer(np.arange(12) * 3.0, np.arange(12) * 2.0)
    points = spark.createDataFrame([(1, i, 45 + i * 1e-4, 7.0, 1000.0 + i) for i in range(80)], "track_id long, seq int, lat double, lon double, ele double")
    pixels = spark.range(16).select(F.lit(0).alias("grid_id"), (F.col("id") / 4).cast("int").alias("py"), (F.col("id") % 4).cast("int").alias("px"), *[F.lit(v).alias(k) for k, v in (("red", 90), ("green", 120), ("blue", 30))])
    canopy = grid(spark, z).select("grid_id", "r", "c", F.lit(70).alias("tcd"))

    def bake(config=Config(route_step_m=50.0), dem=z, points=points):
        return run(points, grid(spark, dem), grid(spark, dem), config, 10.0, f"file://{tmp_path}/b", pixels, canopy).collect()

    first = bake()
    assert not any(s.reused for s in first) and all(s.rows for s in first)
    before = files(tmp_path)
    again = bake(points=points.repartition(3))  # the same rows in another order
    assert all(s.reused for s in again) and [s.rows for s in again] == [s.rows for s in first] and [s.tables for s in again] == [s.tables for s in first]
    assert files(tmp_path) == before
    # settings and inputs redo what depends on them: steps by number
    fresh = lambda steps: [k for k, s in enumerate(steps) if not s.reused]
    assert fresh(bake(Config(route_step_m=50.0, contrast=1.3))) == [3]
    assert fresh(bake(Config(route_step_m=50.0, slope_sigma=0.9))) == [4, 5]
    assert fresh(bake(Config(route_step_m=50.0, forest_min_cover=60.0))) == [5]
    assert fresh(bake(dem=z + 1)) == [1, 2, 4, 5]
    assert fresh(bake(points=points.where("seq < 70"))) == [0, 2, 6]


def test_a_step_without_marker_is_done_again(spark, tmp_path):
    """As a lost driver leaves it: a table, whole or in part, and no marker."""
    z = 1000 + np.add.outer(np.arange(6) * 3.0, np.arange(6) * 2.0)
    points = spark.createDataFrame([(1, i, 45 + i * 1e-4, 7.0, 1000.0 + i) for i in range(70)], "track_id long, seq int, lat double, lon double, ele double")
    bake = lambda: run(points, grid(spark, z), grid(spark, z), Config(), 10.0, f"file://{tmp_path}/b").collect()
    key = os.path.basename(bake()[4].tables[0])
    for f in glob.glob(f"{tmp_path}/b/done/{key}/*.parquet") + glob.glob(f"{tmp_path}/b/relief/{key}/*.parquet")[:1]:
        os.unlink(f)
    again = bake()
    assert [s.reused for s in again if s.tables] == [True, True, True, False, True]
    assert spark.read.parquet(again[4].tables[0]).count() == again[4].rows == 36


def test_content(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    assert content(df) == content(df.orderBy(F.desc("x")))
    others = [df.where("x = 1"), df.distinct(), df.withColumn("x", F.col("x") + 1), df.withColumnRenamed("x", "z"), df.withColumn("x", F.col("x").cast("long"))]
    assert len({content(d) for d in [df, *others]}) == 6


def test_probe_reads_a_part(spark, tmp_path):
    z = np.arange(130.0 * 130).reshape(130, 130)
    g = grid(spark, z)
    raster.write_lattice(g, f"file://{tmp_path}/l")
    sizes = {int(os.path.basename(d).split("=")[1]): sum(os.path.getsize(f) for f in glob.glob(f"{d}/*.parquet")) for d in glob.glob(f"{tmp_path}/l/spacing=*")}
    assert set(sizes) == set(raster.SPACINGS)
    for every in raster.SPACINGS:
        got = raster.lattice(spark, f"file://{tmp_path}/l", every)
        rows = {(r.r, r.c, r.z) for r in got.collect()}
        assert rows == {(r, c, z[r, c]) for r in range(0, 130, every) for c in range(0, 130, every)}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert f"PartitionFilters: [isnotnull(spacing" in plan and f">= {every})" in plan
    read = lambda every: sum(v for k, v in sizes.items() if k >= every)
    assert read(8) < read(1) / 5
    with pytest.raises(ValueError):
        raster.lattice(spark, f"file://{tmp_path}/l", 3)
    assert raster.coverage(raster.lattice(spark, f"file://{tmp_path}/l", 8)).select("covered").collect() == raster.coverage(g, 8).select("covered").collect()
