"""The engine's queries over the analogue views: (spark, sf_dir) to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, text
from ..functions.numeric import clamp, fit_inside, rounded
from ..operators import contours, jobs, nearest, overlay, raster, relief, replay, reproject, sinks, tiles, track
from ..sources import gpx, grids, tiff
from ..sources.shared import new_folder
from ..sources.views import read
from . import bake
from .config import Config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Cells of the analogue rasters on a side, and their spacing.
N, CELL = 64, 100.0
CLIP = (6.97, 44.97, 7.03, 45.03)
#: Side of a tile, less than a grid, so that these have several; first cell of the projected rasters; meshes over them, and
#: one of the rasters' size: west, east, south, north, nodes on a side.
SIDE, PROJECTED = 24, (300_050.0, 5_000_050.0)
MESHES = {"coarse": (6.452, 6.536, 45.128, 45.192, 17), "fine": (6.47, 6.495, 45.14, 45.158, 41)}
BAKED = (6.456, 6.53, 45.13, 45.186, N)
#: A made-up projected raster over all places, and the viewer's choices of layers.
WARP_ORIGIN, WARP_CELL = (-800_000.0, 4_600_000.0), 30_000.0
LAYERS = [("ultra", "Topo"), ("high", "Slope"), ("fast", "Forest")]


def query(*views: str):
    """Registers a function of DataFrames as a query over the named tables or views."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(read(spark, sf_dir, v) for v in views))
        return f

    return wrap


# --- tracks


@query("track_points")
def haversine_segments(p):
    return track.with_segments(p).select("track_id", "seq", rounded(F.col("seg_m"), 3).alias("seg_m"))


@query("track_points")
def cumulative_distance(p):
    return track.with_distance(p).select("track_id", "seq", rounded(F.col("d"), 3).alias("d"))


@query("track_points")
def naismith_minutes(p):
    return track.with_minutes(p).select("track_id", "seq", rounded(F.col("minutes"), 4).alias("minutes"))


@query("track_points")
def format_minutes(p):
    m = track.with_minutes(p).groupBy("track_id").agg(F.max("minutes").alias("m"))
    return m.select("track_id", text.minutes_label(F.col("m")).alias("label"))


@query("track_points")
def savgol_lat_lon(p):
    return track.smoothed(p, 15, 1).select("track_id", "seq", rounded(F.col("lat"), 6).alias("lat"), rounded(F.col("lon"), 6).alias("lon"))


@query("track_points")
def savgol_ele(p):
    return track.smoothed(p, 1, 61).select("track_id", "seq", rounded(F.col("ele"), 4).alias("v"))


@query("track_points")
def ascent_deadband(p):
    return track.ascent(p).select("track_id", rounded(F.col("gain_m"), 3).alias("gain_m"))


@query("track_points")
def simplify_route(p):
    return track.route(p, 100.0).select("track_id", "seq", rounded(F.col("d"), 3).alias("d"))


@query("track_points")
def route_summary(p):
    return track.summary(p, 100.0)


def _rounded(df, digits, *columns):
    return df.select(*(rounded(F.col(c), digits).alias(c) if c in columns else c for c in df.columns))


@query("track_points")
def track_bounds(p):
    return _rounded(track.bounds(p, 0.0025).drop("lat0"), 6, "lo_lo", "lo_hi", "la_lo", "la_hi")


@query("track_points")
def bbox_key(p):
    return track.bbox_key(p)


@query("track_points")
def mean_latitude(p):
    return track.bounds(p).select("track_id", rounded(F.col("lat0"), 6).alias("lat0"))


@query("track_points")
def local_xy(p):
    return _rounded(track.local_positions(p), 3, "x", "y")


@query("track_points")
def grid_sizing(p):
    g = track.grid_sizes(track.bounds(p, 0.0025), F.lit(5.0), F.lit(100), F.lit(3000))
    return g.select("track_id", "n", rounded(F.col("cell_m"), 4).alias("cell_m"))


@query("track_points")
def preset_sizing(p):
    b = track.bounds(p, 0.0025).crossJoin(F.broadcast(jobs.presets(p.sparkSession)))  # three presets
    return track.grid_sizes(b, F.col("resolution"), F.lit(100), F.col("most")).select("track_id", "quality", "n", rounded(F.col("cell_m"), 4).alias("cell_m"))


@query("track_points")
def meshgrid_nodes(p):
    return _rounded(track.nodes(track.bounds(p), 5, 1), 7, "lon", "lat")


@query("track_points")
def geotransforms(p):
    g = track.geotransforms(track.bounds(p, 0.0025), 64)
    return _rounded(_rounded(g, 7, *(c for c in g.columns if c[:2] in ("px", "no"))), 2, "width_m", "depth_m")


@query("track_points")
def tile_keys(p):
    return track.tiles(track.bounds(p), 15)


@query("track_points")
def utm_positions(p):
    e, n = geo.utm(F.col("lat"), F.col("lon"))
    return p.select("track_id", "seq", rounded(e, 2).alias("easting"), rounded(n, 2).alias("northing"))


@query("track_points")
def projected_envelope(p):
    """Box of the four projected corners of each track's box."""
    b = track.bounds(p, 0.0025)
    corner = lambda a, o: F.struct(F.col(a).alias("lat"), F.col(o).alias("lon"))
    c = b.select("track_id", F.explode(F.array(*(corner(a, o) for a in ("la_lo", "la_hi") for o in ("lo_lo", "lo_hi")))).alias("k"))
    e, n = geo.utm(F.col("k.lat"), F.col("k.lon"))
    c = c.select("track_id", e.alias("e"), n.alias("n")).groupBy("track_id").agg(F.min("e").alias("e_lo"), F.max("e").alias("e_hi"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    return _rounded(c, 1, "e_lo", "e_hi", "n_lo", "n_hi")


@query("places")
def region_validation(p):
    return jobs.validated(p, "group_id")


# --- rasters


@query("dem_primary")
def raster_minmax(g):
    return raster.ranges(raster.cleaned(g))


@query("dem_secondary")
def coverage(g):
    return raster.coverage(g)


@query("dem_primary", "dem_secondary")
def raster_fill(a, b):
    return _rounded(raster.fused(a, b), 6, "z")


def _on_grids(p, g):
    """Places dealt to all grids, with rows and columns."""
    grids_ = g.select(F.count_distinct("grid_id")).scalar()
    return p.select("place_id", (F.col("place_id") % grids_).cast("int").alias("grid_id"), ((F.col("lon") + 6) * 4).alias("x"), ((F.col("lat") - 43) * 10).alias("y"))


@query("dem_grid", "places")
def bilinear_sample(g, p):
    return _rounded(tiles.sampled(tiles.packed(g, SIDE), _on_grids(p, g), N, ["place_id"], SIDE), 6, "z")


@query("dem_grid", "places")
def cubic_resample(g, p):
    return _rounded(tiles.cubic(tiles.packed(g, SIDE), _on_grids(p, g), N, ["place_id"], SIDE), 5, "z")


def _projected(g):
    """The primary rasters with the metres of their cells."""
    east, north = PROJECTED
    return raster.cleaned(g).withColumns({"x": east + F.col("c") * CELL, "y": north + F.col("r") * CELL})


def _meshes(g, meshes):
    """Nodes of each mesh over every grid."""
    n = F.explode(F.array(*(F.struct(F.lit(name).alias("mesh"), *(F.lit(v).alias(k) for k, v in zip(("west", "east", "south", "north", "n"), box, strict=True))) for name, box in meshes.items())))
    m = g.groupBy("grid_id").agg(F.lit(0)).select("grid_id", n.alias("m")).select("grid_id", "m.*")
    side = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    m = m.withColumn("r", side).withColumn("c", side)
    at = lambda low, high, k: F.col(low) + (F.col(high) - F.col(low)) / (F.col("n") - 1) * F.col(k)
    return m.select("grid_id", "mesh", "r", "c", at("west", "east", "c").alias("lon"), at("south", "north", "r").alias("lat"))


@query("dem_primary")
def reproject_nodes(g):
    """Rasters in metres at the nodes of a coarse mesh (four cells a step) and a fine one (half a cell)."""
    return _rounded(reproject.reprojected(_projected(g), _meshes(g, MESHES), ["mesh"], tile=SIDE), 4, "z")


@query("dem_primary", "dem_secondary")
def projected_terrain(a, b):
    """The surface of a bake whose primary raster is projected: reprojected, filled from the secondary and smoothed."""
    primary = reproject.reprojected(_projected(a), _meshes(a, {"bake": BAKED}).drop("mesh"), tile=SIDE)
    return _rounded(bake.terrain(primary, b, Config(mesh_sigma=0.6)), 5, "z")


@query("dem_grid")
def gradient(g):
    return _rounded(raster.gradient(g).drop("z"), 6, "dx", "dy")


@query("dem_grid")
def gaussian_blur(g):
    return _rounded(raster.gaussian(g, 0.6), 5, "z")


def _steep(g):
    return raster.gradient(g, CELL, CELL)


@query("dem_grid")
def slope_degrees(g):
    return _steep(g).select("grid_id", "r", "c", rounded(relief.slope_degrees(), 5).alias("slope"))


@query("dem_grid")
def slope_classes(g):
    return _steep(g).groupBy("grid_id", relief.slope_class(relief.slope_degrees()).alias("class")).agg(F.count("*").alias("n"))


@query("dem_grid")
def slope_class_rollup(g):
    s = _steep(g).withColumn("class", relief.slope_class(relief.slope_degrees()))
    return s.rollup("grid_id", "class").agg(F.count("*").alias("n"))


@query("dem_grid")
def hillshade(g):
    return _steep(g).select("grid_id", "r", "c", rounded(relief.hillshade(), 6).alias("shade"))


@query("dem_grid")
def multishade(g):
    return _steep(g).select("grid_id", "r", "c", rounded(relief.multishade(), 6).alias("shade"))


@query("dem_grid")
def reference_shade(g):
    return _steep(g).select("grid_id", "r", "c", rounded(relief.reference_shade(), 6).alias("shade"))


def _rgb(df, colours, *keys):
    return df.select(*keys, *(c.alias(k) for c, k in zip(colours, relief.CHANNELS, strict=True)))


@query("dem_grid")
def normal_map(g):
    return _rgb(raster.flipped(_steep(g), N), relief.normal_map(), "grid_id", "r", "c")


@query("dem_grid")
def slope_rgb(g):
    return _rgb(raster.flipped(_steep(g), N), relief.slope_rgb(relief.slope_degrees(), relief.multishade()), "grid_id", "r", "c")


@query("dem_grid")
def hypso_tint(g):
    s = raster.with_figures(_steep(g), low=F.min("z"), high=F.max("z")).withColumn("u8", relief.normalised(F.col("z"), F.col("low"), F.col("high")))
    return _rgb(raster.flipped(s, N), relief.hypso_rgb(F.col("u8"), relief.reference_shade()), "grid_id", "r", "c")


@query("dem_grid")
def percentile_bounds(g):
    return _rounded(raster.percentile_bounds(g), 6, "p_low", "p_high")


@query("dem_grid")
def u8_normalize(g):
    j = g.join(raster.percentile_bounds(g), "grid_id")
    return j.select("grid_id", "r", "c", relief.normalised(F.col("z"), F.col("p_low"), F.col("p_high")).alias("u8"))


@query("dem_grid")
def heightmap_u16(g):
    return relief.heightmap(g).select("grid_id", "r", "c", "q")


@query("canopy")
def forest_colorize(c):
    shading = F.lit(0.8)
    return _rgb(c, relief.forest_rgb(F.col("tcd"), shading), "grid_id", "r", "c")


@query("canopy")
def forest_share(c):
    pct = F.avg((relief.canopy_density(F.col("tcd")) > 0).cast("double")) * 100
    return c.groupBy("grid_id").agg(rounded(pct, 6).alias("pct"))


@query("pixels")
def enhance_rgb(p):
    return relief.enhanced(p)


@query("pixels")
def image_quality_gate(p):
    return _rounded(relief.quality_gate(p), 5, "mean", "deviation")


@query("pixels")
def image_quality_sample(p):
    return _rounded(relief.quality_gate(p, 10.0, 40, 7), 5, "mean", "deviation")


@query("pixels")
def shade_bake(p):
    return relief.baked(p, (F.col("px") + F.col("py")) / 126.0)


@query("pixels")
def tile_mosaic_crop(p):
    t = p.select((F.col("grid_id") % 2).alias("tx"), F.floor(F.col("grid_id") / 2).cast("int").alias("ty"), "px", "py", *relief.CHANNELS)
    return relief.mosaic(t, 0, 0, N, (20, 30, 80, 60))


@query("pixels")
def thumbnail_sizes(p):
    s = p.groupBy("grid_id").agg((F.max("px") + 1).alias("w"), (F.max("py") + 1 + F.first("grid_id")).alias("h"))
    scale = fit_inside(F.col("w"), F.col("h"), 48.0, 36.0)
    side = lambda c: F.greatest(F.floor(F.col(c) * scale + 0.5), F.lit(1)).cast("int")
    return s.select("grid_id", side("w").alias("width"), side("h").alias("height"))


@query("dem_grid")
def contour_crossings(g):
    return _rounded(raster.contours(g, 40.0), 6, "x")


@query("dem_grid")
def contour_counts(g):
    c = raster.contours(g, 40.0)
    return c.groupBy("grid_id", "level").agg(F.count("*").alias("n")).withColumn("major", F.pmod(F.col("level"), F.lit(200.0)) == 0)


@query("dem_grid")
def unsharp_mask(g):
    return _rounded(raster.unsharp(g), 6, "z")


@query("dem_grid")
def lod_decimate(g):
    return _rounded(raster.unsharp(raster.decimated(g, 2)), 6, "z")


@query("dem_grid")
def mesh_vertices(g):
    v = raster.mesh_vertices(g, N, 6300.0, 6300.0, 1.5)
    return _rounded(v, 6, "x", "y", "zz", "u", "v")


@query("dem_grid")
def mesh_triangles(g):
    return raster.mesh_triangles(g, N)


@query("dem_grid")
def apron_crop(g):
    """The gradient of the inner cells, taken on the padded grid: exact at the crop's edges."""
    return _rounded(raster.cropped(raster.gradient(g), 8, 48).drop("z"), 6, "dx", "dy")


@query("dem_grid")
def tiled_unsharp(g):
    """The unsharp mask tile by tile with a halo: the same result as on whole grids."""
    t = tiles.tiled(g, 16, 2).withColumn("grid", F.col("grid_id"))
    t = t.withColumn("grid_id", F.struct("grid", "tr", "tc"))
    s = raster.unsharp(t).withColumn("grid_id", F.col("grid")).drop("grid")
    return _rounded(tiles.own(s, 16).select("grid_id", "r", "c", "z"), 6, "z")


# --- overlays


@query("border_vertices")
def border_islands(v):
    return overlay.islands(v, CLIP)


@query("border_vertices", "dem_grid")
def border_overlay(v, g):
    return _rounded(overlay.draped(v, CLIP, g, 0, N), 6, "z")


@query("border_vertices")
def geojson_lines(v):
    return overlay.geojson_lines(overlay.geojson(v))


# --- replay


def _scene(p):
    """Track points in a scene: x east, z south, y up."""
    return track.with_distance(p).select("track_id", "seq", "d", F.col("ele").alias("y"), ((F.col("lon") - 7) * 78_000).alias("x"), ((F.col("lat") - 45) * -111_000).alias("z"))


def _wanted(s, parts):
    end = s.groupBy("track_id").agg(F.max("d").alias("total"))
    return end.select("track_id", "total", F.explode(F.sequence(F.lit(0), F.lit(parts))).alias("part")).select("track_id", (F.col("part") * int(100 / parts)).alias("pct"), (F.col("total") * F.col("part") / float(parts)).alias("at"))


@query("track_points")
def distance_sampler(p):
    s = _scene(p)
    return _rounded(replay.at_distance(s, _wanted(s, 4), ["x", "y", "z"], ["track_id", "pct"]), 3, "x", "y", "z")


@query("track_points")
def monotone_distance(p):
    s = track.with_distance(p).select("track_id", "seq", F.when(F.col("seq") % 5 == 3, 0.0).otherwise(rounded(F.col("d"), 6)).alias("d"), F.col("ele").alias("y"), (F.col("seq") * 1.0).alias("x"), F.lit(0.0).alias("z"))
    return replay.monotone(s).select("track_id", "seq", rounded(F.col("d"), 3).alias("d"))


@query("track_points")
def route_heading(p):
    s = _scene(p)
    return _rounded(replay.headings(s, _wanted(s, 4), ["track_id", "pct"]), 4, "hx", "hz", "degrees")


@query("places", "track_points")
def nearest_route_point(places, p):
    """The nearest point of every track to every place."""
    route = p.select("track_id", "seq", F.col("lon").alias("x"), F.col("lat").alias("y"))
    at = places.select("place_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return nearest.dealt(_rounded(nearest.nearest_of_lists(at, route), 6, "dist"))


def _sights(p):
    k = F.col("place_id")
    eye = {"x": (k * 7 % 63).cast("double"), "z": (k * 11 % 63).cast("double"), "y": (k * 13 % 900 + 700).cast("double")}
    target = {"x": (k * 17 % 63).cast("double"), "z": (k * 19 % 63).cast("double"), "y": (k * 23 % 400 + 800).cast("double")}
    return p.select("place_id", F.lit(0).alias("grid_id"), *(v.alias(f"eye_{c}") for c, v in eye.items()), *(v.alias(f"target_{c}") for c, v in target.items()), F.cos(k.cast("double")).alias("hx"), F.sin(k.cast("double")).alias("hz"))


@query("places", "dem_grid")
def sightline_occlusion(p, g):
    return _rounded(replay.occlusion(_sights(p), g, N, ["place_id"]), 4, "score")


@query("places", "dem_grid")
def side_offset(p, g):
    return _rounded(replay.side_offsets(_sights(p), g, N, "place_id", 6.8), 4, "offset")


@query("places")
def camera_rig(p):
    d = {c: (F.col("place_id") * m % 4001 - 2000).cast("double") for c, m in (("dx", 37), ("dy", 53), ("dz", 71))}
    radius, theta, phi = replay.rig(d["dx"], d["dy"], d["dz"])
    r = p.select("place_id", radius.alias("radius"), theta.alias("theta"), phi.alias("phi"))
    back = replay.rig_offset(F.col("radius"), F.col("theta"), F.col("phi"))
    r = r.select("*", *(c.alias(k) for c, k in zip(back, ("bx", "by", "bz"), strict=True)), replay.follow_distance(F.col("radius")).alias("follow"))
    return _rounded(r, 5, "radius", "theta", "phi", "bx", "by", "bz", "follow")


@query("track_points")
def default_camera(p):
    b = track.geotransforms(track.bounds(p), 2).select("track_id", "width_m", "depth_m").join(p.groupBy("track_id").agg(F.min("ele").alias("low"), F.max("ele").alias("high")), "track_id")
    position, target = replay.default_camera(F.col("width_m"), F.col("depth_m"), F.col("low"), F.col("high"))
    return b.select("track_id", *(rounded(c, 2).alias(f"{n}{i}") for n, cs in (("p", position), ("t", target)) for i, c in enumerate(cs)))


@query("track_points")
def scene_roundtrip(p):
    w, d, low = F.lit(8000.0), F.lit(6000.0), F.lit(900.0)
    x, y = (F.col("lon") - 7) * 78_000, (F.col("lat") - 45) * 111_000
    s = replay.to_scene(x, y, F.col("ele"), w, d, low, 1.5)
    back = replay.to_local(*s, w, d, low, 1.5)
    return p.select("track_id", "seq", *(rounded(c, 4).alias(k) for c, k in zip((*s, *back), ("sx", "sy", "sz", "x", "y", "z"), strict=True)))


@query("track_points")
def route_centroid(p):
    s = _scene(p).groupBy("track_id").agg(*(F.avg(c).alias(c) for c in "xyz"))
    return _rounded(s, 3, "x", "y", "z")


@query("track_points")
def replay_position(p):
    n = p.groupBy("track_id").agg(F.max("seq").alias("last")).select("*", F.explode(F.array(*(F.lit(v) for v in (0, 33, 66, 100)))).alias("pct"))
    n = n.select("track_id", "pct", F.floor(F.col("pct") / 100.0 * F.col("last") + 0.5).cast("int").alias("seq"))
    return n.join(p, ["track_id", "seq"]).select("track_id", "pct", "seq", "lat", "lon")


@query("events")
def replay_clock(e):
    f = e.select(F.col("user_id").alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), (F.col("event_id") % 200).cast("double").alias("dt"))
    return _rounded(replay.replay_clock(f), 6, "pct")


@query("track_points")
def camera_damping(p):
    f = p.select(F.col("track_id").alias("id"), "seq", (F.col("seq") % 7 / 100.0).alias("dt"), (F.col("ele") * 10).alias("target"))
    return _rounded(replay.damped(f, 1.85, 1100.0), 5, "value")


# --- imports


@query("gpx_docs")
def gpx_parse(d):
    return gpx.points(d, "track_id")


@query("gpx_docs")
def gpx_bounds(d):
    p = gpx.loose_points(d, "track_id")
    return p.groupBy("track_id").agg(F.count("*").alias("n"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


@query("uploads")
def multipart_upload(u):
    body = F.concat(F.lit('--XX\r\nContent-Disposition: form-data; name="file"; filename="'), "filename", F.lit('"\r\n\r\n'), F.regexp_replace("text", "</gpx>", "<trkpt/></gpx>"), F.lit("\r\n--XX--"))
    kind = F.when(F.col("page_id") % 9 == 0, "text/plain").otherwise("multipart/form-data; boundary=XX")
    return gpx.uploads(u.select("page_id", kind.alias("content_type"), F.when(F.col("page_id") % 10 == 0, "--XX nothing").otherwise(body).alias("body")))


@query("part", "uploads")
def slug_title(p, u):
    names = p.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name")).union(u.select(F.concat(F.lit("u"), F.col("page_id").cast("string")), text.stem(F.col("filename"))))
    return names.select("id", text.slug(F.col("name")).alias("slug"), text.title(F.col("name")).alias("title"))


@query("uploads")
def import_job_id(u):
    return jobs.with_job_id(u).select("page_id", text.quality(F.col("quality")).alias("quality"), "job_id")


@query("uploads")
def dedup_uploads(u):
    return jobs.deduplicated(u)


@query("job_events")
def job_state(e):
    return jobs.states(e)


@query("job_events")
def job_progress(e):
    return jobs.progress(e)


@query("job_events")
def job_prune(e):
    s = jobs.states(e).withColumn("created_at", F.col("job_id") * 60_000)
    return jobs.kept(s, 10_000_000).select("job_id", "status", "created_at")


@query("job_events")
def import_stage(e):
    return jobs.staged(jobs.states(e)).select("job_id", "progress", "stage")


@query("uploads")
def cache_hits(u):
    done = jobs.with_job_id(u.where("page_id % 3 = 0"))
    return jobs.cache_hits(u, done)


@query("log_lines")
def log_progress(lines):
    return jobs.progress_lines(lines)


@query("log_lines")
def last_error_line(lines):
    return jobs.last_errors(lines)


@query("pages")
def redact_urls(p):
    url = F.concat("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("?token="), F.col("page_id").cast("string"))).otherwise(""))
    return p.select("page_id", text.redacted(url).alias("url"), text.trace_endpoint(F.concat(F.lit("http://host"), F.when(F.col("page_id") % 3 == 0, "/v1/traces/").otherwise("/"))).alias("endpoint"))


@query("uploads")
def share_link(u):
    return u.select("page_id", text.share_url(F.lit("http://host/view"), route=F.col("filename"), mode=F.col("quality"), shot=F.lit(None).cast("string")).alias("url"))


# --- packages


def _routes(p):
    s = track.route(p, 100.0)
    xy = track.local_positions(p)
    return s.join(xy, ["track_id", "seq"]).withColumn("z", F.col("ele"))


@query("track_points")
def route_json(p):
    s = track.summary(p, 100.0).withColumnRenamed("points", "points_n")
    return sinks.route_json(_routes(p), s)


@query("dem_grid")
def terrain_json(g):
    return sinks.terrain_json(g, 6300.0, 6300.0)


@query("track_points")
def manifest_json(p):
    return bake.manifest(p, track.summary(p, 100.0))


@query("border_vertices", "dem_grid")
def border_json(v, g):
    w, s, e, n = CLIP
    z = overlay.draped(v, CLIP, g, 0, N)
    xy = overlay.runs_inside(v, CLIP).select("line_id", "run", "vseq", ((F.col("lon") - w) * 78_000).alias("x"), ((F.col("lat") - s) * 111_000).alias("y"))
    return sinks.border_json(z.join(xy, ["line_id", "run", "vseq"]))


@query("dem_grid")
def hillshade_png(g):
    """The images are encoded and read back, so that pixels can be compared."""
    return sinks.image_pixels(sinks.images(_steep(g).withColumn("v", clamp(F.floor(relief.hillshade() * 255 + 0.5), 0.0, 255.0).cast("int")), ["v"]), ["v"])


@query("dem_grid")
def normal_png(g):
    return sinks.image_pixels(sinks.images(_rgb(_steep(g), relief.normal_map(), "grid_id", "r", "c"), list(relief.CHANNELS)), list(relief.CHANNELS))


# --- raster files: written as bytes and read back


def _by_id(cells):
    return cells.withColumn("grid_id", F.col("path").cast("int")).drop("path")


@query("dem_grid")
def grid_cache_cells(g):
    """Grids through the cache's format; the bytes of grid 2 are cut short, which is a miss."""
    contents = grids.encoded(g, lambda name, z: grids.encode_grid(z)[: -4 if name == "2" else None])
    return _rounded(_by_id(grids.cache_cells(contents)), 3, "z")


@query("dem_grid")
def raw_raster_cells(g):
    return _rounded(_by_id(grids.raw_cells(grids.encoded(g, lambda _, z: z.astype("<f4").tobytes()), N)), 3, "z")


@query("dem_primary")
def geotiff_cells(g):
    """Heights in a projection as GeoTIFFs; a sentinel is no data."""
    return _rounded(_by_id(grids.geotiff_cells(grids.encoded(g, lambda _, z: tiff.encode(z, 300_000.0, 5_000_000.0, CELL)))), 3, "z")


@query("canopy")
def tree_cover_cells(g):
    """Tree cover as GeoTIFFs of bytes, read into the forest's density; numbers above 100 count as none."""
    contents = grids.encoded(g.withColumn("z", F.col("tcd").cast("double")), lambda _, z: tiff.encode(z.astype("u1"), 300_000.0, 5_000_000.0, CELL, 255.0))
    return _by_id(grids.geotiff_cells(contents)).select("grid_id", "r", "c", rounded(relief.canopy_density(F.col("z")), 6).alias("density"))


# --- bake layers, contours, resizing, viewer


@query("dem_grid")
def bake_layers(g):
    """Relief of a bake without its apron: shade from the heights, slope from a surface smoothed for it."""
    out = raster.cropped(bake.layers(g, Config(edge_pad_cells=8), CELL), 8, N - 16)
    return _rounded(out.select("grid_id", "r", "c", "hill", "slope", "slope_class"), 5, "hill", "slope")


@query("dem_grid")
def contour_segments(g):
    return _rounded(raster.contour_segments(g, 40.0, 200.0), 6, "x1", "y1", "x2", "y2")


@query("dem_grid")
def contour_lines(g):
    """Segments joined into lines, point by point."""
    return _rounded(contours.lines(g, 80.0, 400.0), 6, "x", "y")


@query("dem_grid")
def resize_bicubic(g):
    return _rounded(raster.resized(g, (N, N), (40, 27), "bicubic"), 5, "z")


@query("dem_grid")
def resize_lanczos(g):
    return _rounded(raster.resized(g, (N, N), (24, 96), "lanczos"), 5, "z")


@query("dem_grid", "places")
def warp_projected(g, p):
    """Heights at places from a grid whose nodes lie in UTM metres."""
    at = p.select("place_id", F.lit(0).alias("grid_id"), "lat", "lon")
    return _rounded(raster.warped(g, at, N, WARP_ORIGIN, WARP_CELL, ["place_id"]), 4, "z")


@query("pixels")
def shader_colours(p):
    """Map colours under relief and forest as the viewer mixes them."""
    unit = lambda c: F.pmod(c, F.lit(256)).cast("double") / 255.0
    x, y = F.col("px"), F.col("py")
    rgb = relief.papery(*(F.col(c).cast("double") / 255.0 for c in relief.CHANNELS), F.lit(0.8))
    factor = relief.relief_factor(unit(x * 3 + y * 5), F.lit(1.3), F.lit(0.8))
    out = relief.forested(tuple(c * factor for c in rgb), (unit(x * 7), unit(y * 11 + 90), unit(x + y)), F.lit(0.6))
    return _rounded(_rgb(p, out, "grid_id", "py", "px"), 6, *relief.CHANNELS)


@query("uploads")
def layer_lookup(u):
    return u.select("page_id", jobs.looked_up(u, "quality", LAYERS).alias("label"))


@query("job_events")
def newest_first(e):
    return jobs.newest_first(e.where("kind = 'finish'").select("job_id", "seq"), "job_id", "seq")


@query("track_points")
def coordinate_labels(p):
    b = track.bounds(p)
    position = [(F.col("lo_hi") - F.col("lo_lo")) * 100_000.0, (F.col("la_hi") - F.col("la_lo")) * -100_000.0]
    return b.select("track_id", text.coordinate_label(rounded((F.col("la_lo") + F.col("la_hi")) / 2, 6), rounded((F.col("lo_lo") + F.col("lo_hi")) / 2, 6), digits=2).alias("centre"), text.vector_label(*(rounded(v, 3) for v in position)).alias("vector"))


@query("log_lines")
def log_details(lines):
    return jobs.details(lines)


@query("gpx_docs")
def gpx_errors(d):
    return gpx.point_errors(d, "track_id")


def bake_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven steps of a bake of all grids and tracks, with the rows that each has written."""
    views = (read(spark, sf_dir, v) for v in ("track_points", "dem_primary", "dem_secondary", "pixels", "canopy"))
    points, primary, secondary, pixels, canopy = views
    return bake.run(points, primary, secondary, Config(route_step_m=100.0), CELL, new_folder(spark, "bake"), pixels, canopy).select("pct", "label", "rows")


QUERIES["bake_progress"] = bake_progress


def coverage_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether one cell in 64 of a grid has data, from a layout of which these cells are a part of their own."""
    folder = new_folder(spark, "lattice")
    raster.write_lattice(read(spark, sf_dir, "dem_secondary"), folder)
    return raster.coverage(raster.lattice(spark, folder, 8)).select("grid_id", "covered")


QUERIES["coverage_probe"] = coverage_probe


def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state fold as a stream over a written log whose events are dealt over its files; the same rows as job_state."""
    from ..streaming.jobs import replay as run

    folder = new_folder(spark, "job-log")
    events = read(spark, sf_dir, "job_events").select("job_id", "seq", "kind", "pct")
    events.repartition(4, F.hash("job_id", "seq", "kind")).write.parquet(f"{folder}/log")
    return run(spark, "job_id long, seq int, kind string, pct int", f"{folder}/log", folder, 2)


QUERIES["job_stream"] = job_stream
