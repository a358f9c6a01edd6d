"""Exact percentiles and nearest points of routes against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellwalk.operators import nearest, raster


@pytest.mark.parametrize("accuracy, few", [(raster.ACCURACY, raster.FEW), (200, 50), (40, 0)])
def test_percentiles(spark, accuracy, few):
    """Brackets of a coarse sketch, many equal heights, an outlier that stretches the range, small and empty grids."""
    rng = np.random.default_rng(2)
    grids = [rng.normal(0, 1, 4000), np.round(rng.normal(0, 1, 3000)), np.r_[rng.uniform(0, 1, 2999), 1e12], np.full(500, 7.0), np.arange(3.0), np.array([5.0]), rng.exponential(1, 100)]
    rows = [(g, k // 50, k % 50, float(z)) for g, zs in enumerate(grids) for k, z in enumerate(zs)] + [(g, 99, k, None) for g in range(7) for k in range(30)] + [(50, 0, 0, None)]
    grid = spark.createDataFrame(rows, "grid_id int, r int, c int, z double").repartition(5)
    for low, high in ((0.02, 0.98), (0.0, 1.0), (0.5, 0.999)):
        got = {x.grid_id: (x.p_low, x.p_high) for x in raster.percentile_bounds(grid, low, high, accuracy, few).collect()}
        assert got.pop(50) == (0.0, 0.0) and set(got) == set(range(7))
        for g, zs in enumerate(grids):
            np.testing.assert_allclose(got[g], np.percentile(zs, [100 * low, 100 * high]), rtol=1e-12, atol=1e-12)


def test_percentiles_sort_little(spark):
    """Of a grid of 200,000 heights only those in the brackets reach the sort."""
    grid = spark.range(200_000).select(F.lit(0).alias("grid_id"), F.rand(1).alias("z"))
    df = raster.percentile_bounds(grid, few=1000)
    df.collect()
    window = [n for n in _nodes(df._jdf.queryExecution().executedPlan()) if n.nodeName() == "Window"]
    sorts = [n for n in _nodes(window[0]) if n.nodeName() == "Sort"]
    assert sorts and len(window) == 1
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "percentile_approx" in plan


def _nodes(node):
    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.executedPlan()
    while node.nodeName().endswith("QueryStage"):
        node = node.plan()
    yield node
    children = node.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))


def test_nearest_points(spark):
    rng = np.random.default_rng(3)
    routes = {1: rng.normal(0, 1, (1000, 2)).cumsum(0), 2: rng.normal(0, 1, (300, 2)), 3: np.array([[4.0, 4.0]]), 4: np.repeat([[1.0, 2.0], [3.0, 4.0]], 40, 0), 5: rng.normal(0, 1, (17, 2)).cumsum(0)}
    rows = [(t, 2 * k + 5, float(x), float(y)) for t, p in routes.items() for k, (x, y) in enumerate(p)] + [(1, 1, None, 0.0), (6, 0, None, None)]
    at = np.r_[rng.normal(0, 30, (60, 2)), [[2.0, 3.0], [1e6, -1e6]]]
    places = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)] + [(900, None, 1.0)], "place_id int, x double, y double")
    points = spark.createDataFrame(rows, "track_id int, seq int, x double, y double").repartition(4)
    got = {(r.place_id, r.track_id): (r.seq, r.dist) for r in nearest.nearest_points(places, points).collect()}
    assert len(got) == len(at) * len(routes)
    for k, xy in enumerate(at):
        for t, p in routes.items():
            d = np.sqrt(((p - xy) ** 2).sum(1))
            seq, dist = got[k, t]
            assert dist == pytest.approx(d.min(), rel=1e-12) and seq == 2 * int(np.argmin(np.round(d, 12))) + 5
    assert nearest.nearest_points(places, points.limit(0)).count() == 0 and nearest.nearest_points(places.limit(0), points).count() == 0


def test_places_open_few_boxes(spark):
    """A long route: what the last join opens is far less than places x points, and no route is collected or broadcast whole."""
    points = spark.range(20_000).select(F.lit(1).alias("track_id"), F.col("id").alias("seq"), (F.col("id") / 100.0).alias("x"), F.sin(F.col("id") / 500.0).alias("y"))
    places = spark.range(200).select(F.col("id").alias("place_id"), F.col("id").cast("double").alias("x"), F.lit(0.5).alias("y"))
    df = nearest.nearest_points(places, points)
    assert df.count() == 200
    df.collect()
    joins = [n.metrics().apply("numOutputRows").value() for n in _nodes(df._jdf.queryExecution().executedPlan()) if "Join" in n.nodeName() and n.metrics().contains("numOutputRows")]
    assert max(joins) < 200 * 20_000 / 50


def test_places_and_routes_are_not_shuffled_as_pairs(spark):
    """Blocks and groups of any size give the same rows, and the rows shuffled are places and points, not places x routes."""
    points = spark.range(6000).select((F.col("id") % 300).alias("track_id"), F.col("id").alias("seq"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 103).cast("double").alias("y"))
    places = spark.range(500).select(F.col("id").alias("place_id"), (F.col("id") % 50).cast("double").alias("x"), (F.col("id") * 7 % 90).cast("double").alias("y"))
    whole, parts = nearest.nearest_points(places, points), nearest.nearest_points(places, points, 150, 900)
    want = {(r.place_id, r.track_id): (r.dist, r.seq) for r in places.crossJoin(points.withColumnsRenamed({"x": "px", "y": "py"})).groupBy("place_id", "track_id").agg(F.min(F.struct(F.sqrt((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2).alias("dist"), "seq")).alias("b")).select("place_id", "track_id", "b.dist", "b.seq").collect()}
    for df in (whole, parts):
        assert {(r.place_id, r.track_id): (r.dist, r.seq) for r in df.collect()} == want and len(want) == 150_000
    shuffled = [n.metrics().apply("shuffleRecordsWritten").value() for n in _nodes(whole._jdf.queryExecution().executedPlan()) if n.metrics().contains("shuffleRecordsWritten")]
    assert shuffled and sum(shuffled) == 6500


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_places_and_points_are_shuffled_once(spark, broadcast):
    """With many blocks and groups, too, a place and a point are shuffled once. Places share locations, routes come in several parts."""
    points = spark.range(6000).select((F.col("id") % 13).alias("track_id"), F.col("id").alias("seq"), (F.col("id") * 37 % 101).cast("double").alias("x"), (F.col("id") * 53 % 103).cast("double").alias("y"))
    places = spark.range(500).select(F.col("id").alias("place_id"), (F.col("id") % 4).cast("double").alias("x"), (F.col("id") * 7 % 6).cast("double").alias("y"))
    want = {(r.place_id, r.track_id): (r.dist, r.seq) for r in places.crossJoin(points.withColumnsRenamed({"x": "px", "y": "py"})).groupBy("place_id", "track_id").agg(F.min(F.struct(F.sqrt((F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2).alias("dist"), "seq")).alias("b")).select("place_id", "track_id", "b.dist", "b.seq").collect()}
    conf = {"spark.sql.autoBroadcastJoinThreshold": broadcast, "spark.sql.execution.arrow.maxRecordsPerBatch": "64"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = nearest.nearest_points(places, points, 60, 900)
        rows = df.collect()
        nodes = list(_nodes(df._jdf.queryExecution().executedPlan()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == len(want) == 6500 and {(r.place_id, r.track_id): (r.dist, r.seq) for r in rows} == want
    shuffled = [n.metrics().apply("shuffleRecordsWritten").value() for n in nodes if n.metrics().contains("shuffleRecordsWritten")]
    assert sorted(shuffled) == [500, 6000]
    assert any(n.nodeName() == "CartesianProduct" for n in nodes) == (broadcast == "-1")


def test_nearest_points_without_numbers(spark):
    """Places and points whose number is missing, points at no number, routes named by text."""
    nan = float("nan")
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, nan, 1.0), (3, -0.0, 0.0), (None, 5.0, 5.0)], "place_id long, x double, y double")
    points = spark.createDataFrame([("a", 1, 1.0, 0.0), ("a", 2, 0.0, 1.0), ("b", 7, nan, 0.0), ("c", None, 2.0, 2.0), ("c", 3, 2.0, 2.0), ("c", None, 5.0, 4.0)], "track_id string, seq int, x double, y double")
    for sizes in ((), (2, 3)):
        got = {(r.place_id, r.track_id): (r.seq, r.dist) for r in nearest.nearest_points(places, points, *sizes).collect()}
        assert len(got) == 12 and all(np.isnan(got[k][1]) for k in got if k[0] == 2 or k[1] == "b")
        assert [got[k, "a"] for k in (1, 3)] == [(1, 1.0)] * 2 and got[None, "c"] == (None, 1.0)
        assert got[1, "c"] == got[3, "c"] == (3, 8**0.5) and got[None, "a"] == (1, 41**0.5)
