"""Tiles and reprojection against plain numpy on whole grids, and what their plans shuffle."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellwalk.functions import geo
from fellwalk.operators import raster, reproject, tiles
from fellwalk.plans.bake import layers
from fellwalk.plans.config import Config

RNG = np.random.default_rng(7)
Z = RNG.normal(1000, 50, (50, 50))
Z[RNG.random(Z.shape) < 0.03] = np.nan


def cells(spark, z, grid_id=0):
    rows = [(grid_id, int(r), int(c), None if math.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "grid_id int, r int, c int, z double").repartition(3)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"^[\s:+-]*Exchange ", plan, re.M))


def square(df, name, shape):
    out = np.full(shape, np.nan)
    for x in df.collect():
        out[x.r, x.c] = np.nan if x[name] is None else x[name]
    return out


def test_packed(spark):
    got = tiles.packed(cells(spark, Z), 16, 2).orderBy("tr", "tc").collect()
    assert len(got) == 16  # 50 cells are four tiles of 16 on a side
    for t in got:
        rows = slice(max(0, t.tr * 16 - 2), min(50, t.tr * 16 + 18))
        columns = slice(max(0, t.tc * 16 - 2), min(50, t.tc * 16 + 18))
        assert (t.r0, t.c0) == (rows.start, columns.start)
        np.testing.assert_array_equal(np.array(t.cells).reshape(-1, t["columns"]), Z[rows, columns])


def bilinear(z, y, x):
    n = len(z) - 1
    y, x = min(max(y, 0), n), min(max(x, 0), n)
    r, c = int(y), int(x)
    u, v = min(r + 1, n), min(c + 1, n)
    fy, fx = y - r, x - c
    return (1 - fy) * ((1 - fx) * z[r, c] + fx * z[r, v]) + fy * ((1 - fx) * z[u, c] + fx * z[u, v])


@pytest.mark.parametrize("side", [7, 64])
def test_sampled(spark, side):
    places = [(k, 0, float(y), float(x)) for k, (y, x) in enumerate([*RNG.uniform(-2, 52, (300, 2)), (0, 0), (49, 49), (7, 14), (6.999, 20)])]
    at = spark.createDataFrame([*places, (1000, 5, 1.0, 1.0)], "k int, grid_id int, y double, x double")
    df = tiles.sampled(tiles.packed(cells(spark, Z), side, 1), at, 50, ["k"], side)
    got = {x.k: x.z for x in df.collect()}
    assert set(got) == {p[0] for p in places}  # grid 5 has no tiles
    for k, _, y, x in places:
        want = bilinear(Z, y, x)
        assert (got[k] is None) if math.isnan(want) else abs(got[k] - want) < 1e-9


def test_sampling_shuffles_tiles_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        at = spark.range(100).select(F.col("id").alias("k"), F.lit(0).alias("grid_id"), F.lit(3.5).alias("y"), F.lit(2.5).alias("x"))
        assert exchanges(tiles.sampled(tiles.packed(cells(spark, Z), 16, 1), at, 50, ["k"], 16)) <= 3  # the input's own, cells to tiles, places
        grid = spark.range(2500).select(F.lit(0).alias("grid_id"), (F.col("id") / 50).cast("int").alias("r"), (F.col("id") % 50).cast("int").alias("c"), F.col("id").cast("double").alias("z"))
        assert exchanges(layers(grid, Config(), 10.0)) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("tile", [6, 13, 256])
def test_stencils_on_tiles(spark, tile):
    z = np.where(np.isnan(Z), 900, Z)
    config = Config(relief_sigma=0.7, slope_sigma=1.3)
    got = layers(cells(spark, z), config, 10.0, tile)
    wide = tiles.convolved(z, raster.gaussian_kernel(0.7))
    dx, dy = tiles.slopes(wide, 10.0)
    for name, want in (("z", wide), ("dx", dx), ("dy", dy)):
        np.testing.assert_allclose(square(got, name, z.shape), want, atol=1e-9)
    sx, sy = tiles.slopes(tiles.convolved(z, raster.gaussian_kernel(1.3)), 10.0)
    np.testing.assert_allclose(square(got, "slope", z.shape), np.degrees(np.arctan(np.hypot(sx, sy))), atol=1e-8)
    np.testing.assert_allclose(square(tiles.blurred(cells(spark, z), raster.gaussian_kernel(2.0), tile), "z", z.shape), square(raster.gaussian(cells(spark, z), 2.0), "z", z.shape), atol=1e-9)


def test_blur_of_small_grids_and_missing_cells(spark):
    """Mirrored more than once on a side shorter than the kernel; a missing height is missing in its neighbourhood only."""
    z = RNG.normal(0, 1, (2, 3))
    w = raster.gaussian_kernel(2.0)
    np.testing.assert_allclose(square(tiles.blurred(cells(spark, z), w, 4), "z", z.shape), square(raster.gaussian(cells(spark, z), 2.0), "z", z.shape), atol=1e-9)
    z = np.zeros((9, 9))
    z[0, 0] = np.nan
    got = square(tiles.blurred(cells(spark, z), raster.gaussian_kernel(0.6), 4), "z", z.shape)
    assert np.isnan(got[:3, :3]).all() and not np.isnan(got[3:]).any()
    assert tiles.blurred(cells(spark, z), [1.0]).count() == 81
    assert tiles.blurred(cells(spark, z).limit(0), w).count() == 0 and tiles.packed(cells(spark, z).limit(0)).count() == 0


# --- reprojection

EAST, NORTH = 400_000.0, 5_000_000.0


def metres(spark, z, cell, down=False):
    """A raster of cells `cell` metres wide; with `down`, its rows go south."""
    y = (lambda r: NORTH + (z.shape[0] - 1 - r) * cell) if down else (lambda r: NORTH + r * cell)
    rows = [(0, r, c, EAST + c * cell, y(r), None if math.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])]
    return spark.createDataFrame(rows, "grid_id int, r int, c int, x double, y double, z double").repartition(3)


def nodes(spark, n, west=7.727, east=7.737, south=45.149, north=45.156):
    rows = [(0, r, c, south + (north - south) / (n - 1) * r, west + (east - west) / (n - 1) * c) for r in range(n) for c in range(n)]
    return spark.createDataFrame(rows, "grid_id int, r int, c int, lat double, lon double")


def in_metres(at):
    e, n = geo.utm(F.col("lat"), F.col("lon"))
    return {(x.r, x.c): (x.e, x.n) for x in at.select("r", "c", e.alias("e"), n.alias("n")).collect()}


def brute(z, places, n, cell):
    """Node by node: all cells in reach of the widened kernel."""
    curve = lambda d: (1.5 * d - 2.5) * d * d + 1 if d < 1 else ((-0.5 * d + 2.5) * d - 4) * d + 2 if d < 2 else 0.0
    xs = {k: ((e - EAST) / cell, (m - NORTH) / cell) for k, (e, m) in places.items()}
    wide = [max(1.0, (max(v[i] for v in xs.values()) - min(v[i] for v in xs.values())) / (n - 1)) for i in (0, 1)]
    out = np.full((n, n), np.nan)
    for (r, c), (x, y) in xs.items():
        if -0.5 <= x <= z.shape[1] - 0.5 and -0.5 <= y <= z.shape[0] - 0.5:
            s = w = 0.0
            for i in range(z.shape[0]):
                for j in range(z.shape[1]):
                    k = curve(abs(j - x) / wide[0]) * curve(abs(i - y) / wide[1])
                    if not math.isnan(z[i, j]):
                        s, w = s + k * z[i, j], w + k
            if w >= 0.5 * wide[0] * wide[1]:
                out[r, c] = s / w
    return out


@pytest.mark.parametrize("cell, n, down", [(20.0, 9, False), (100.0, 15, False), (20.0, 9, True)])
def test_reprojected(spark, cell, n, down):
    """Shrinking by about five and two, growing, holes, nodes outside, rows that go south."""
    z = RNG.normal(500, 20, (30, 36))
    z[4:9, 10:14] = np.nan
    at = nodes(spark, n)
    got = square(reproject.reprojected(metres(spark, z[::-1] if down else z, cell, down), at, tile=8), "z", (n, n))
    want = brute(z, in_metres(at), n, cell)
    np.testing.assert_allclose(got, want, atol=1e-6)
    assert np.isnan(want).any() and not np.isnan(want).all()


def test_reprojection_keeps_a_plane(spark):
    """Cubic convolution gives back a plane; so does the widened kernel far from the edges, nearly."""
    r, c = np.mgrid[:60, :60]
    at = nodes(spark, 6, 7.7312, 7.7355, 45.1512, 45.1545)
    got = square(reproject.reprojected(metres(spark, 3.0 * c + 2.0 * r, 20.0), at, tile=16), "z", (6, 6))
    for (i, j), (e, m) in in_metres(at).items():
        assert abs(got[i, j] - (3 * (e - EAST) + 2 * (m - NORTH)) / 20) < 0.2
    assert reproject.reprojected(metres(spark, np.zeros((4, 4)), 20.0).limit(0), at).count() == 0
    assert reproject.reprojected(metres(spark, np.zeros((4, 4)), 20.0), at.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["sightline_occlusion", "side_offset", "bilinear_sample", "cubic_resample", "reproject_nodes"])
def test_places_and_tiles_are_not_broadcast(spark, name):
    """The planner takes exploded places and packed tiles for small at any size: no join of them may bring a side to the driver."""
    from fellwalk.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan
