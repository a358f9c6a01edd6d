"""Known values and analytic properties of single operators."""

import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fellwalk.functions import geo, numeric, text
from fellwalk.operators import jobs, overlay, raster, relief, replay, reproject, sinks, tiles, track
from fellwalk.plans.bake import bake, run
from fellwalk.plans.bake import layers as bake_layers
from fellwalk.plans.config import Config
from fellwalk.sources import gpx, grids, tiff


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def grid(spark, z):
    z = np.asarray(z, float)
    return spark.createDataFrame([(0, r, c, None if math.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])], "grid_id int, r int, c int, z double")


def back(df, column="z"):
    p = df.select("r", "c", column).toPandas()
    out = np.full((p.r.max() + 1, p.c.max() + 1), np.nan)
    out[p.r, p.c] = p[column].astype(float)
    return out


def line(spark, points):
    return spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(points)], "track_id long, seq int, lat double, lon double, ele double")


def test_distances(spark):
    d = lambda *p: geo.haversine(*(F.lit(float(x)) for x in p))
    r = one(spark, d(45, 7, 46, 7), d(45, 7, 45, 7))
    assert abs(r[0] - 111_195) < 112 and r[1] == 0


def test_rounding_and_numbers(spark):
    q = lambda x, n: numeric.rounded(F.lit(float(x)), n)
    assert tuple(one(spark, q(12.3456, 2), q(12.3456, 0), q(-12.345, 1), q(0.0, 2))) == (12.35, 12.0, -12.3, 0.0)
    knots = lambda x: numeric.piecewise(F.lit(float(x)), (0, 10), (0, 100))
    assert tuple(one(spark, *map(knots, (0, 5, 10, 99)))) == (0, 50, 100, 100)
    u = lambda x: relief.normalised(F.lit(float(x)), F.lit(0.0), F.lit(100.0))
    assert tuple(one(spark, *map(u, (0, 50, 100, 150, -10)))) == (0, 128, 255, 255, 0)
    lum = lambda *c: relief.luma(*map(F.lit, c))
    assert tuple(one(spark, lum(255, 255, 255), lum(0, 0, 0), lum(255, 0, 0), lum(0, 255, 0))) == (255, 0, 76, 150)
    b = lambda f: relief.blend(F.lit(0), F.lit(100), f)
    assert tuple(one(spark, b(0.0), b(1.0), b(0.5), relief.blend(F.lit(0), F.lit(255), 2.0))) == (0, 100, 50, 255)


def test_strings(spark):
    s = lambda x: text.slug(F.lit(x))
    t = lambda x: text.title(F.lit(x))
    m = lambda x: text.minutes_label(F.lit(x))
    assert tuple(one(spark, s("Morning Hike"), s("  "), t("morning_hike-1"), t(""), m(42.2), m(73.4))) == ("morning-hike", "imported-route", "Morning Hike 1", "Imported route", "42 min", "1h 13")
    assert one(spark, text.stem(F.lit("a/b.tar.gpx")), text.redacted(F.lit("http://x/y?k=1&z=2")))[:] == ("b.tar", "http://x/y?...")


def test_tiles_and_projection(spark):
    x, y = geo.tile_xy(F.lit(45.0), F.lit(7.0), 8)
    e, n = geo.utm(F.lit(45.0), F.lit(7.0))
    r = one(spark, F.floor(x), F.floor(y), e, n)
    assert (r[0], r[1]) == (132, 92) and abs(r[2] - 342_369.36) < 0.01 and abs(r[3] - 4_984_896.17) < 0.01


def test_deadband_and_walking_time(spark):
    gain = lambda xs: deadband(spark, xs)

    def deadband(spark, xs):
        return one(spark, track.deadband_gain(F.array(*(F.lit(float(x)) for x in xs))))[0]

    assert gain([0, 1, 2, 1, 2]) == 0 and gain([0, 5, 4, 9]) == 10
    p = spark.createDataFrame([(1, 0, 0.0, 100.0), (1, 1, 750.0, 130.0), (1, 2, 1500.0, 120.0)], "track_id long, seq int, d double, ele double")
    assert [r.minutes for r in track.with_minutes(p).orderBy("seq").collect()] == [0, 13, 23]


def test_simplify(spark):
    p = line(spark, [(45, 7 + 0.05 * i / 49, 0) for i in range(50)])
    s = [r.seq for r in track.route(p, 200.0).orderBy("seq").collect()]
    assert s[0] == 0 and s[-1] == 49 and len(s) < 50 and s == sorted(set(s))
    assert [r.seq for r in track.route(line(spark, [(45, 7, 0), (45, 7, 0)]), 200.0).orderBy("seq").collect()] == [0, 1]
    rng = np.random.default_rng(0)
    d = np.cumsum(rng.choice([0.0, 1.0, 2.5, 7.0], 200))
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(d)], "track_id long, seq int, d double")
    want = sorted({*np.searchsorted(d, np.arange(0, d[-1], 3.0)), len(d) - 1})
    assert sorted(r.seq for r in track.simplified(df, 3.0).collect()) == want


@pytest.mark.parametrize("window", [5, 15])
def test_smoothing(spark, window):
    rng = np.random.default_rng(window)
    noisy = rng.standard_normal(40)
    p = line(spark, [(2 * i + 1, 5.0, noisy[i]) for i in range(40)])
    out = track.savgol(p, {"lat": window, "lon": window, "ele": window}).orderBy("seq").toPandas()
    assert np.allclose(out["lat"], 2 * np.arange(40) + 1) and np.allclose(out["lon"], 5)
    half, want = window // 2, np.empty(40)
    for i in range(40):
        at = min(max(i - half, 0), 40 - window)
        k = np.arange(window)
        want[i] = np.polyval(np.polyfit(k, noisy[at : at + window], 2), i - at)
    assert np.allclose(out["ele"], want)
    arr = one(spark, track.savgol_array(F.array(*(F.lit(float(x)) for x in noisy)), window))[0]
    assert np.allclose(arr, want)
    for w in (41, 4, 1):  # too short, even, one
        assert np.allclose(track.savgol(p, {"ele": w}).orderBy("seq").toPandas()["ele"], noisy)


def test_bilinear_cubic_crop(spark):
    g = grid(spark, [[0, 10], [20, 30]])
    at = spark.createDataFrame([(i, 0, y, x) for i, (y, x) in enumerate([(0.5, 0.5), (0.0, 0.5), (-1.0, -1.0), (5.0, 5.0)])], "k int, grid_id int, y double, x double")
    assert [r.z for r in raster.sampled(g, at, 2, ["k"]).orderBy("k").collect()] == [15, 5, 0, 30]
    plane = grid(spark, np.add.outer(np.arange(8) * 3.0, np.arange(8) * 2.0))
    at = spark.createDataFrame([(0, 0, 3.25, 2.5), (1, 0, 9.0, 1.0)], "k int, grid_id int, y double, x double")
    got = [r.z for r in raster.cubic(plane, at, 8, ["k"]).orderBy("k").collect()]
    assert abs(got[0] - (3.25 * 3 + 5)) < 1e-9 and got[1] is None
    assert back(raster.cropped(grid(spark, np.arange(16).reshape(4, 4)), 1, 2)).ravel().tolist() == [5, 6, 9, 10]


def test_missing_heights(spark):
    z = np.array([[3, np.nan], [1, 5.0]])
    r = raster.ranges(grid(spark, z)).first()
    assert (r.min_z, r.max_z) == (1, 5)
    r = raster.ranges(grid(spark, z * np.nan)).first()
    assert (r.min_z, r.max_z) == (0, 0)
    a, b = np.full((4, 4), 500.0), np.full((4, 4), 100.0)
    a[:, :2], b[0, 0] = -9999, -99999
    f = back(raster.fused(grid(spark, a), grid(spark, b)))
    assert (f[:, :2] == 100).all() and (f[:, 2:] == 500).all()


def test_stencils(spark):
    rng = np.random.default_rng(1)
    z = rng.random((9, 7)) * 100
    g = raster.gradient(grid(spark, z))
    dy, dx = np.gradient(z)
    assert np.allclose(back(g, "dx"), dx) and np.allclose(back(g, "dy"), dy)
    w = np.array(raster.gaussian_kernel(0.6))
    r = len(w) // 2
    pad = np.pad(z, r, mode="symmetric")
    want = sum(w[i] * w[j] * pad[i : i + 9, j : j + 7] for i in range(len(w)) for j in range(len(w)))
    assert np.allclose(back(raster.gaussian(grid(spark, z), 0.6)), want)
    same = grid(spark, z)
    assert raster.gaussian(same, 0.1) is same and raster.gaussian(same, 0) is same
    assert np.allclose(back(raster.gaussian(grid(spark, np.full((5, 5), 3.0)), 1.0)), 3)
    wide = tiles.own(raster.unsharp(tiles.tiled(grid(spark, z), 4, 1).withColumn("g", F.col("grid_id")).withColumn("grid_id", F.struct("g", "tr", "tc"))).withColumn("grid_id", F.col("g")), 4)
    assert np.allclose(back(wide), back(raster.unsharp(grid(spark, z))))


def test_shading_and_percentiles(spark):
    flat = spark.range(1).select(F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"))
    assert flat.select(relief.shade(0, 90, 0.3)).first()[0] == pytest.approx(1) and flat.select(*relief.normal_map()).first()[:] == (127, 255, 127)
    p = lambda lo, hi: raster.percentile_bounds(grid(spark, [[1, 2, 3, 4, 5]]), lo, hi).first()[1:]
    assert p(0.0, 1.0) == (1, 5) and p(0.25, 0.5) == (2, 3) and raster.percentile_bounds(grid(spark, [[np.nan]])).first()[1:] == (0, 0)
    q = sorted(r.q for r in relief.heightmap(grid(spark, [[10, 20], [30, 40]])).collect())
    assert q[0] == 0 and q[-1] == 65535


def test_replay(spark):
    p = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 10.0, 100.0), (1, 2, 10.0, 150.0), (1, 3, 20.0, 250.0)], "track_id long, seq int, d double, x double")
    at = spark.createDataFrame([(1, k, float(a)) for k, a in enumerate((-5, 0, 5, 15, 20, 99))], "track_id long, k int, at double")
    assert [r.x for r in replay.at_distance(p, at, ["x"], ["track_id", "k"]).orderBy("k").collect()] == [0, 0, 50, 200, 250, 250]
    w, d, low = F.lit(1000.0), F.lit(800.0), F.lit(100.0)
    s = one(spark, *replay.to_scene(F.lit(625.0), F.lit(250.0), F.lit(180.0), w, d, low, 1.5))
    assert s[:] == (125, 120, 150) and one(spark, *replay.to_local(*map(F.lit, s), w, d, low, 1.5))[:] == (625, 250, 180)


def test_regions_and_jobs(spark):
    p = spark.createDataFrame([(1, 7.68, 45.07), (1, 7.7, 45.1), (2, 0.0, 0.0), (2, 0.0, 0.1), (3, 7.0, 45.0), (4, None, 45.0), (4, 7.0, 45.0)], "k int, lon double, lat double")
    got = {r.k: (r.ok, r.reason) for r in jobs.validated(p, "k").collect()}
    assert got == {1: (True, ""), 2: (False, "unsupported area"), 3: (False, "too few points"), 4: (False, "invalid coordinates")}
    e = spark.createDataFrame([(1, 0, "progress", 40), (1, 1, "cancel", 0), (1, 2, "finish", 0), (2, 0, "progress", 120), (2, 1, "progress", 5), (3, 0, "submit", 0), (4, 0, "finish", 0)], "job_id long, seq int, kind string, pct int")
    assert {r.job_id: (r.status, r.progress) for r in jobs.states(e).collect()} == {1: ("error", 40), 2: ("processing", 99), 3: ("queued", 2), 4: ("ready", 100)}


def test_gpx(spark, tmp_path):
    body = '<gpx>\n<trkpt lat="45.0" lon="7.0"><ele>100</ele></trkpt>\n<trkpt lat="45.1" lon="7.1"></trkpt><trkpt lat="45.2" lon="7.2"><ele>9</ele></trkpt></gpx>'
    (tmp_path / "a.gpx").write_text(body)
    docs = gpx.read(spark, str(tmp_path / "a.gpx"))
    assert [(r.lat, r.ele) for r in gpx.points(docs, "path").orderBy("seq").collect()] == [(45.0, 100), (45.1, 9)]
    assert gpx.loose_points(docs, "path").count() == 3
    assert [(r.lat, r.ele) for r in gpx.strict_points(spark, str(tmp_path / "a.gpx")).collect()] == [(45.0, 100), (45.1, None), (45.2, 9)]


def test_overlays(spark):
    docs = spark.createDataFrame([(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 1}, "geometry": {"type": "LineString", "coordinates": [[7, 45], [7.1, 45]]}}, {"type": "Feature", "properties": {"id": 2}, "geometry": {"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]], [[5, 6]], [[7, 8], [9, 10], [11, 12]]]}}]}),)], "json string")
    assert sorted((r.line_id, r.part, r.n) for r in overlay.geojson_lines(docs).collect()) == [(1, 0, 2), (2, 0, 2), (2, 2, 3)]
    ways = spark.createDataFrame([(json.dumps({"elements": [{"type": "way", "id": 5, "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 3.0, "lon": 4.0}]}, {"type": "node", "id": 6}]}),)], "json string")
    made = overlay.ways(ways).select(F.col("geojson").alias("json"))
    assert [(r.line_id, r.n, r.lon) for r in overlay.geojson_lines(made).collect()] == [(5, 2, 2.0)]


def test_images_and_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    for a in (rng.integers(0, 256, (5, 4)).astype(np.uint8), rng.integers(0, 256, (3, 6, 3)).astype(np.uint8), rng.integers(0, 65536, (4, 3)).astype(np.uint16)):
        assert (sinks.unpng(sinks.png(a)) == a).all() and sinks.png(a)[:4] == b"\x89PNG"
    z = rng.random((6, 5)).astype(np.float32)
    (tmp_path / "g.grid").write_bytes(grids.encode_grid(z))
    (tmp_path / "broken.grid").write_bytes(grids.encode_grid(z)[:-1])
    (tmp_path / "old.grid").write_bytes(b"OTHER" + grids.encode_grid(z)[5:])
    assert np.allclose(back(grids.read_cache(spark, str(tmp_path / "*.grid"))), z)
    (tmp_path / "r.bil").write_bytes(z.astype("<f4").tobytes())
    assert np.allclose(back(grids.read_raw(spark, str(tmp_path / "r.bil"), 5)), z)
    (tmp_path / "t.png").write_bytes(sinks.png(rng.integers(0, 256, (4, 4, 3)).astype(np.uint8)))
    assert grids.read_tiles(spark, str(tmp_path / "t.png")).count() == 16
    png = sinks.images(grid(spark, [[1, 2], [3, 4]]).withColumn("v", F.col("z").cast("int")), ["v"]).first().png
    assert sinks.unpng(bytes(png)).tolist() == [[3, 4], [1, 2]]


def test_config():
    c = Config.of({"BAKE_GRID_MAX": "1200", "BAKE_CONTOURS": "yes", "BAKE_TILE_ZOOM": " "})
    assert (c.grid_max, c.contours, c.tile_zoom) == (1200, True, 17)
    for bad in ({"BAKE_GRID_MIN": "1"}, {"BAKE_TILE_ZOOM": "23"}, {"BAKE_CONTOURS": "maybe"}, {"BAKE_FOREST_MIN_COVER": "100"}):
        with pytest.raises(ValueError):
            Config.of(bad)


def test_bake(spark):
    z = 1000 + np.add.outer(np.arange(20) * 3.0, np.arange(20) * 2.0)
    b = bake(line(spark, [(45 + i * 1e-4, 7, 1000 + i) for i in range(80)]), grid(spark, z), grid(spark, z), Config(route_step_m=50.0), 10.0)
    assert b.route.count() > 2 and b.summary.first().points == 80
    r = b.relief.toPandas()
    assert np.allclose(back(b.relief, "slope")[3:-3, 3:-3], math.degrees(math.atan(math.hypot(0.3, 0.2)))) and r["hill"].between(0, 1).all()


def test_bake_steps(spark, tmp_path):
    z = 1000 + np.add.outer(np.arange(12) * 3.0, np.arange(12) * 2.0)
    p, g, seen = line(spark, [(45 + i * 1e-4, 7, 1000 + i) for i in range(80)]), grid(spark, z), []
    steps = run(p, g, g, Config(route_step_m=50.0, edge_pad_cells=3), 10.0, f"file://{tmp_path}/b", inner=6, report=lambda pct, label: seen.append(pct)).collect()
    assert seen == [8, 22, 58, 70, 82, 90, 97] == [s.pct for s in steps]
    assert [steps[i].rows for i in (0, 1, 3, 4, 5, 6)] == [1, 144, 0, 36, 0, 1]
    assert np.allclose(back(spark.read.parquet(steps[4].tables[0]), "slope"), math.degrees(math.atan(math.hypot(0.3, 0.2))))


def test_geotiff(spark, tmp_path):
    rng = np.random.default_rng(4)
    z = rng.normal(500, 90, (7, 5)).astype(np.float32).astype(float)
    z[2, 3] = np.nan
    (tmp_path / "h.tif").write_bytes(tiff.encode(z, 1000.0, 2000.0, 10.0, rows=3))
    got = grids.read_geotiff(spark, str(tmp_path / "h.tif"))
    assert np.allclose(back(got), z, equal_nan=True) and got.where("z is null").count() == 1
    assert {(r.x, r.y) for r in got.where("r = 0 and c = 1").collect()} == {(1015.0, 2005.0)}
    with pytest.raises(ValueError):
        tiff.decode(b"II+\0" + bytes(20))
    # predictors: differences of whole numbers, and of the bytes of floats by significance
    whole = rng.integers(0, 60_000, (4, 6)).astype("<u2")
    parts = np.diff(whole, axis=1, prepend=np.zeros((4, 1), "<u2")).astype("<u2").tobytes()
    assert (tiff.block(zlib.compress(parts), (4, 6), np.dtype("<u2"), tiff.DEFLATE, 2) == whole).all()
    real = rng.normal(0, 5, (3, 4)).astype(">f4")
    planes = real.view(np.uint8).reshape(3, 4, 4).transpose(0, 2, 1).reshape(3, -1)
    parts = np.diff(planes, axis=1, prepend=np.zeros((3, 1), np.uint8)).astype(np.uint8).tobytes()
    assert (tiff.block(parts, (3, 4), np.dtype("<f4"), tiff.NONE, 3) == real).all()
    with pytest.raises(ValueError, match="compression 5"):
        tiff.block(b"", (1, 1), np.dtype("u1"), 5, 1)


def test_build_log(spark, tmp_path):
    lines = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "job_id int, line string")
    sinks.build_log(lines, f"file://{tmp_path}/log")
    assert sorted((r.job_id, r.value) for r in spark.read.text(f"file://{tmp_path}/log").collect()) == [(1, "a"), (1, "b"), (2, "c")]


def test_one_exchange_for_track_windows(spark):
    p = line(spark, [(45 + i * 1e-4, 7, 0) for i in range(9)])
    plan = track.with_minutes(p)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_entry_without_the_optional_part(tmp_path):
    """The entry module works when the optional subpackage is gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "fellwalk"), tmp_path / "fellwalk", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1:] == ["False", "True"]


def test_slope_has_a_surface_of_its_own(spark):
    """On a rough grid, classes come from the blurred surface and shades from the heights themselves."""
    z = np.random.default_rng(3).normal(1000, 30, (24, 24))
    got = {(r.r, r.c): r for r in bake_layers(grid(spark, z), Config(), 10.0).collect()}

    def steep(a):
        dy, dx = np.gradient(a, 10.0)
        return np.degrees(np.arctan(np.hypot(dx, dy)))

    w = np.array(raster.gaussian_kernel(0.6))
    blur = lambda a, axis: np.apply_along_axis(lambda v: np.convolve(np.pad(v, 2, "symmetric"), w, "valid"), axis, a)
    smooth, rough = steep(blur(blur(z, 0), 1)), steep(z)
    assert all(abs(got[r, c].slope - smooth[r, c]) < 1e-6 for r in range(24) for c in range(24))
    assert np.abs(smooth - rough).max() > 5


def test_apron_makes_crops_equal(spark):
    """Two crops of one surface that overlap agree where they do: edges are taken with their neighbours."""
    z = np.random.default_rng(4).normal(1000, 30, (40, 40))
    whole = {(r.r, r.c): (r.hill, r.slope) for r in bake_layers(grid(spark, z), Config(), 10.0).collect()}
    points = line(spark, [(45 + i * 1e-4, 7, 1000 + i) for i in range(80)])
    b = bake(points, grid(spark, z), grid(spark, z), Config(edge_pad_cells=8), 10.0, inner=24)
    part = {(r.r, r.c): (r.hill, r.slope) for r in b.relief.collect()}
    assert len(part) == 24 * 24 and all(part[r, c] == whole[r + 8, c + 8] for r, c in part)


def test_contours_are_closed_around_a_peak(spark):
    """Each end of a segment inside the grid is the end of just one other, saddles included."""
    y, x = np.mgrid[0:12, 0:12]
    z = 100 * np.exp(-((x - 4) ** 2 + (y - 6) ** 2) / 9) + 80 * np.exp(-((x - 8) ** 2 + (y - 5) ** 2) / 6) + 0.01 * x
    z[9:11, 2:4] = [[33.3, 0.1], [0.2, 32.9]]
    ends = Counter()
    rows = raster.contour_segments(grid(spark, z), 10.0, 50.0).collect()
    for s in rows:
        for p in ((s.x1, s.y1), (s.x2, s.y2)):
            ends[s.level, round(p[0], 9), round(p[1], 9)] += 1
    inner = {k: n for k, n in ends.items() if 0 < k[1] < 11 and 0 < k[2] < 11}
    assert inner and set(inner.values()) == {2} and {s.level for s in rows if s.major} == {50.0, 100.0}


def test_resizing(spark):
    z = np.random.default_rng(2).normal(0, 1, (8, 8))
    for kernel in raster.KERNELS:
        assert np.allclose(back(raster.resized(grid(spark, z), (8, 8), (8, 8), kernel)), z)
        assert np.allclose(back(raster.resized(grid(spark, np.full((8, 8), 7.0)), (8, 8), (5, 13), kernel)), 7)
        for size, to in ((8, 3), (8, 20)):
            sums = Counter()
            for i, _, w in raster.resize_weights(size, to, kernel):
                sums[i] += w
            assert len(sums) == to and all(abs(w - 1) < 1e-12 for w in sums.values())


def test_packages_with_missing_parts(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)

    put("manifest.json", '{"id": "a", "terrain": {"path": "terrain.json"}, "routes": [{"id": "r", "path": "route.json"}]}')
    put("terrain.json", '{"gridSize": 2, "heights": [1, 2, 3, 4]}')
    with pytest.raises(ValueError, match="route.json is missing"):
        sinks.load_package(spark, f"file://{tmp_path}")
    put("route.json", '{"id": "r", "points": [{"x": 1.0}]}')
    (got,) = sinks.load_package(spark, f"file://{tmp_path}").collect()
    assert got.id == "a" and got.gridSize == 2 and got.heights == [1, 2, 3, 4] and len(got.points) == 1
    put("manifest.json", '{"id": "a", "terrain": {"path": null}, "routes": []}')
    with pytest.raises(ValueError, match="names no"):
        sinks.load_package(spark, f"file://{tmp_path}")


def test_upload_limit(spark):
    rows = spark.createDataFrame([("multipart/form-data; boundary=XX", "x" * 200)], "content_type string, body string")
    assert gpx.uploads(rows, 100).first().error == "too large" and gpx.uploads(rows).first().error == "no file"


def test_folds_stream_over_long_tracks(spark):
    n = 60_000
    rows = spark.range(2 * n).select((F.col("id") % 2).alias("track_id"), (F.col("id") / 2).cast("int").alias("seq"))
    rows = rows.select("*", F.when(F.col("seq") % 5 == 3, 0.0).otherwise(F.col("seq") * 2.0).alias("d"), (F.col("seq") * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    got = replay.monotone(rows).groupBy("track_id").agg(F.count("*").alias("n"), F.max("d").alias("d"), F.sum((F.col("seq") % 5 == 3).cast("int") * (F.col("d") - 2 * F.col("seq") + 1)).alias("off")).collect()
    assert [(r.n, r.d, r.off) for r in got] == [(n, 2.0 * (n - 1), 0.0)] * 2


def test_no_grid_goes_through_one_task(spark):
    g = grid(spark, np.zeros((6, 6)))
    for df in (raster.gaussian(g, 0.6), raster.fused(g, g), relief.heightmap(g), raster.mesh_vertices(g, 6, 1.0, 1.0, 1.0)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"windowspecdefinition\(grid_id#\d+, (r#\d+ ASC|c#\d+ ASC|specified)", plan)


def test_fixed_digits_are_those_of_c(spark):
    """Halves by the exact binary value, exact halves to even; neighbours of halves on both sides."""
    import math

    from fellwalk.functions.text import coordinate_label

    half = [s * (k + 0.5) / 100 for k in range(0, 20000, 37) for s in (1, -1)]
    values = [0.125, 0.375, 45.125, 45.375, -0.125, 7.005, 1.005, 45.015, -0.001, 0.0, 0.995, 999999.995, *half]
    values += [math.nextafter(v, to) for v in values for to in (math.inf, -math.inf) if v]
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    got = {r.v: (r.two, r.four, r.none) for r in rows.select("v", coordinate_label("v", digits=2).alias("two"), coordinate_label("v").alias("four"), coordinate_label("v", digits=0).alias("none")).collect()}
    assert {v: (f"{v:.2f}", f"{v:.4f}", f"{v:.0f}") for v in values} == got
