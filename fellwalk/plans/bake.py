"""One bake: as a lazily composed plan of track, fused heights, relief layers and figures, or step by step into a folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import jobs, raster, relief, sinks, tiles, track
from .config import Config
from .store import Store, content, digest

#: Percent and label of the steps after the worker's start.
STEPS = jobs.STAGES[1:]


@dataclass
class Bake:
    """Lazy results; heights and relief feed several layers, so persist them before writing more than one."""

    route: DataFrame
    summary: DataFrame
    heights: DataFrame
    relief: DataFrame


def covered(grid: DataFrame, every: int = 16) -> bool:
    """Cheap probe of a raw raster: whether any sampled cell has data. Decides before the full read is planned."""
    return bool(raster.coverage(grid, every).where("covered").limit(1).count())


def layers(heights: DataFrame, config: Config, cell_m: float, tile: int = tiles.WIDE) -> DataFrame:
    """grid_id, r, c, z, dx, dy, hill, multi, reference, slope, slope_class.

    Shades come from the gradient of the relief surface. Slope has a surface of its own, smoothed by
    slope_sigma, so that classes do not follow the noise of single cells. Blurs and gradients are one stencil on tiles, in one exchange.
    """
    relief_w, slope_w = (raster.gaussian_kernel(s) for s in (config.relief_sigma, config.slope_sigma))

    def surfaces(z):
        z, smooth = tiles.convolved(z, relief_w), tiles.convolved(z, slope_w)
        (dx, dy), (sx, sy) = tiles.slopes(z, cell_m), tiles.slopes(smooth, cell_m)
        return {"z": z, "dx": dx, "dy": dy, "_sx": sx, "_sy": sy}

    g = tiles.stencil(heights, surfaces, ["z"], ["z", "dx", "dy", "_sx", "_sy"], max(len(relief_w), len(slope_w)) // 2 + 1, tile)
    slope = relief.slope_degrees(F.col("_sx"), F.col("_sy"))
    g = g.select("grid_id", "r", "c", "z", "dx", "dy", relief.hillshade().alias("hill"), relief.multishade().alias("multi"), relief.reference_shade().alias("reference"), slope.alias("slope"))
    return g.withColumn("slope_class", relief.slope_class(F.col("slope")))


def terrain(primary: DataFrame, secondary: DataFrame, config: Config) -> DataFrame:
    """The surface of a bake: the primary raster where it has data, else the secondary, smoothed by mesh_sigma."""
    return tiles.blurred(raster.fused(primary if covered(primary) else secondary, secondary), raster.gaussian_kernel(config.mesh_sigma))


def manifest(points: DataFrame, summary: DataFrame) -> DataFrame:
    """id, json: the manifest of each track's package."""
    size = track.geotransforms(track.bounds(points), 2).select("track_id", F.col("width_m").alias("width"), F.col("depth_m").alias("depth"))
    name = F.col("track_id").cast("string")
    b = size.join(summary, "track_id")
    return sinks.manifest_json(b.select(name.alias("id"), F.concat(F.lit("Track "), name).alias("title"), "width", "depth", F.col("min_e").alias("low"), F.col("max_e").alias("high"), "km", "gain", "points"))


def bake(points: DataFrame, primary: DataFrame, secondary: DataFrame, config: Config, cell_m: float, inner: int | None = None) -> Bake:
    """One bake. With `inner`, the grids carry an apron of config.edge_pad_cells around inner x inner cells: blurs and
    gradients see it, the results do not hold it."""
    smooth = track.smoothed(points, config.smooth_horizontal, config.smooth_vertical)
    heights = terrain(primary, secondary, config)
    found = layers(heights, config, cell_m)
    if inner:
        heights, found = (raster.cropped(x, config.edge_pad_cells, inner) for x in (heights, found))
    return Bake(track.route(smooth, config.route_step_m), track.summary(points, config.route_step_m, config.gain_threshold_m), heights, found)


def run(points: DataFrame, primary: DataFrame, secondary: DataFrame, config: Config, cell_m: float, folder: str, pixels: DataFrame | None = None, canopy: DataFrame | None = None, inner: int | None = None, report: Callable[[int, str], None] | None = None) -> DataFrame:
    """A bake written as Parquet tables below `folder`, step by step, so that a lost executor costs a step at most and
    later steps read what earlier ones made. report(percent, label) is called as a step begins.

    Gives pct, label, rows (of the step's tables), reused and tables (their folders) of the seven steps; one without its
    input (pixels, canopy) has none. Steps are kept by the content of their inputs and the settings that they read: a
    further run into the same folder, also after a lost driver, makes only what is not there.
    """
    spark, done, store = points.sparkSession, [], Store(points.sparkSession, folder)
    inputs = {"points": points, "primary": primary, "secondary": secondary, "pixels": pixels, "canopy": canopy}
    keys = {name: content(df) for name, df in inputs.items() if df is not None}
    read = lambda name: spark.read.parquet(store.path(name, keys[name]))
    crop = lambda g: raster.cropped(g, config.edge_pad_cells, inner) if inner else g
    cut = (config.edge_pad_cells, inner) if inner else ()

    def step(needs: str, settings: tuple, **tables: Callable[[], DataFrame]) -> None:
        """A step from the named inputs and tables; settings are all values that it reads."""
        pct, label = STEPS[len(done)]
        if report:
            report(pct, label)
        if not all(n in keys for n in needs.split()):
            done.append((pct, label, 0, False, []))
            return
        key = digest(label, settings, [keys[n] for n in needs.split()])
        keys.update(dict.fromkeys(tables, key))
        done.append((pct, label, *store.made(key, tables), [store.path(n, key) for n in tables]))

    def forest() -> DataFrame:
        rgb = relief.forest_rgb(F.col("tcd"), F.col("reference"), config.forest_min_cover)
        return canopy.join(read("relief"), ["grid_id", "r", "c"]).select("grid_id", "r", "c", *(v.alias(k) for k, v in zip(relief.CHANNELS, rgb, strict=True)))

    smoothing, colours = (config.smooth_horizontal, config.smooth_vertical), (config.saturation, config.brightness, config.contrast)
    step("points", (config.route_step_m, config.gain_threshold_m), summary=lambda: track.summary(points, config.route_step_m, config.gain_threshold_m))
    step("primary secondary", (config.mesh_sigma,), surface=lambda: terrain(primary, secondary, config))
    step("points surface", (*smoothing, config.route_step_m, *cut), route=lambda: track.route(track.smoothed(points, *smoothing), config.route_step_m), heights=lambda: crop(read("surface")))
    step("pixels", colours, texture=lambda: relief.enhanced(pixels, *colours))
    step("surface", (config.relief_sigma, config.slope_sigma, cell_m, *cut), relief=lambda: crop(layers(read("surface"), config, cell_m)))
    step("canopy relief", (config.forest_min_cover,), forest=forest)
    step("points summary", (), manifest=lambda: manifest(points, read("summary")))
    return spark.createDataFrame(done, "pct int, label string, rows long, reused boolean, tables array<string>")
