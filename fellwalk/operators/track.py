"""Trajectory operators: windows and ordered folds over (track_id, seq, lat, lon, ele).

Windows are partitioned by track and ordered by seq; a chain of them costs one exchange and one sort.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE_M, haversine, local_xy, tile_xy
from ..functions.numeric import rounded
from .fold import Fold, Form, gains



def by_track():
    return Window.partitionBy("track_id").orderBy("seq")


def upto():
    return by_track().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole_track():
    return Window.partitionBy("track_id")


def with_segments(points: DataFrame) -> DataFrame:
    """Adds seg_m, the metres from the point before (0 for the first)."""
    before = lambda c: F.lag(c).over(by_track())
    return points.withColumn("seg_m", F.coalesce(haversine(before("lat"), before("lon"), F.col("lat"), F.col("lon")), F.lit(0.0)))


def with_distance(points: DataFrame) -> DataFrame:
    """Adds d, the metres since the start."""
    return with_segments(points).withColumn("d", F.sum("seg_m").over(upto())).drop("seg_m")


def with_minutes(points: DataFrame, metres_a_minute: float = 75.0, climb_a_minute: float = 10.0) -> DataFrame:
    """Adds minutes of walking by Naismith's rule: forward distance and climb count, descent does not."""
    p = points if "d" in points.columns else with_distance(points)
    step = lambda c: F.greatest(F.coalesce(F.col(c) - F.lag(c).over(by_track()), F.lit(0.0)), F.lit(0.0))
    return p.withColumn("_own", step("d") / metres_a_minute + step("ele") / climb_a_minute).withColumn("minutes", F.sum("_own").over(upto())).drop("_own")


def savgol_weights(window: int) -> np.ndarray:
    """window x window weights: row p gives the value at place p of the quadratic fitted to a window."""
    x = np.arange(window, dtype=float) - window // 2
    a = np.stack([np.ones(window), x, x * x], 1)
    return a @ np.linalg.pinv(a)


def savgol_array(values: Column, window: int) -> Column:
    """Savitzky-Golay smoothing (order 2) of an array; edges take the fit of the first or last window.

    Arrays shorter than the window, and even windows, are returned unchanged.
    """
    if window < 3 or window % 2 == 0:
        return values
    half, w = window // 2, savgol_weights(window)
    rows = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in w))
    n = F.size(values)

    def at(x, i):
        start = F.greatest(F.least(i - half, n - window), F.lit(0))
        return F.aggregate(F.zip_with(F.slice(values, start + 1, window), F.element_at(rows, i - start + 1), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    return F.when(n < window, values).otherwise(F.transform(values, at))


def savgol(points: DataFrame, windows: dict[str, int]) -> DataFrame:
    """Savitzky-Golay smoothing (order 2) of columns, each with its window, in long form.

    A quadratic fitted to a window needs three sums over it: of the values, and of the values times their
    place and its square. All come from sliding frames over one partitioning by track. Points near an end
    take the fit of the first or last whole window. Tracks shorter than the window stay as they are.
    """
    p = points.withColumn("_n", F.count("*").over(whole_track()))
    done = {}
    for name, window in windows.items():
        if window < 3 or window % 2 == 0:
            continue
        h, m2, m4 = window // 2, sum(k * k for k in range(-(window // 2), window // 2 + 1)), sum(k**4 for k in range(-(window // 2), window // 2 + 1))
        frame, i = by_track().rowsBetween(-h, h), F.col("seq").cast("double")
        # relative to the track's first value, which keeps the products small
        p = p.withColumn("_y0", F.first(name).over(by_track())).withColumn("_y", F.col(name) - F.col("_y0"))
        p = p.select("*", *(F.sum(F.col("_y") * w).over(frame).alias(f"_t{k}") for k, w in enumerate((F.lit(1.0), i, i * i))))
        p = p.withColumn("_s", F.struct(F.col("_t0").alias("a"), (F.col("_t1") - i * F.col("_t0")).alias("b"), (F.col("_t2") - i * 2 * F.col("_t1") + i * i * F.col("_t0")).alias("c")))
        center = F.greatest(F.least(F.col("seq"), F.col("_n") - 1 - h), F.lit(h))
        at = lambda where: F.max(F.when(where, F.col("_s"))).over(whole_track())
        p = p.withColumn("_s", F.when(F.col("seq") < h, at(F.col("seq") == h)).when(F.col("seq") > F.col("_n") - 1 - h, at(F.col("seq") == F.col("_n") - 1 - h)).otherwise(F.col("_s")))
        x, s = (F.col("seq") - center).cast("double"), lambda k: F.col(f"_s.{k}")
        bend = (s("c") * window - s("a") * m2) / float(window * m4 - m2 * m2)
        fit = (s("a") - bend * m2) / window + s("b") / float(m2) * x + bend * x * x
        p = p.withColumn(f"_fit_{name}", F.when(F.col("_n") < window, F.col(name)).otherwise(F.col("_y0") + fit)).drop("_y0", "_y", "_t0", "_t1", "_t2", "_s")
        done[name] = F.col(f"_fit_{name}")
    return p.select(*(done[c].alias(c) if c in done else F.col(c) for c in points.columns))


def smoothed(points: DataFrame, horizontal: int = 15, vertical: int = 61) -> DataFrame:
    """The track with lat, lon and ele smoothed."""
    return savgol(points.select("track_id", "seq", "lat", "lon", "ele"), {"lat": horizontal, "lon": horizontal, "ele": vertical})


def deadband_gain(elevations: Column, threshold: float = 3.0) -> Column:
    """Climb that counts only rises of more than the threshold above the lowest point since the last one."""
    start = F.struct(F.lit(0.0).alias("total"), F.element_at(elevations, 1).alias("low"))

    def step(s, v):
        rise = v > s["low"] + threshold
        return F.struct(F.when(rise, s["total"] + v - s["low"]).otherwise(s["total"]).alias("total"), F.when(rise | (v < s["low"]), v).otherwise(s["low"]).alias("low"))

    return F.when(F.size(elevations) > 0, F.aggregate(elevations, start, step, lambda s: s["total"])).otherwise(F.lit(0.0))


def ascent(points: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Metres climbed by each track: a rise counts once it exceeds the lowest height since the last by `threshold`.
    Missing heights are passed over; a track without any has 0."""

    def first(row, before, low):
        v = float(row[0])
        return low if before is not None and (np.isnan(v) or low <= v <= low + threshold) else v

    def form(m: np.ndarray) -> Form:
        v = m[1:, 0]
        none, one = np.isnan(v), np.ones(len(v))
        return Form(np.where(none, -np.inf, v), np.where(none, np.inf, v), v, one, one * 0, v)

    return gains(points, "track_id", "seq", Fold(["ele"], first, form, reach=threshold), "gain_m")


def with_shown(points: DataFrame, step: float) -> DataFrame:
    """Adds `shown`: points that are the first at or beyond a multiple of `step` metres, and the last point.

    Closed form: a point stays if it passes a multiple that the point before had not passed. Needs d.
    """
    p = points.withColumn("_before", F.lag("d").over(by_track())).withColumn("_total", F.max("d").over(whole_track())).withColumn("_last", F.max("seq").over(whole_track()))
    passes = F.least(F.floor(F.col("d") / step), F.ceil(F.col("_total") / step) - 1) > F.floor(F.col("_before") / step)
    return p.withColumn("shown", (F.col("seq") == 0) | (F.col("seq") == F.col("_last")) | F.coalesce(passes, F.lit(False))).drop("_before", "_total", "_last")


def simplified(points: DataFrame, step: float) -> DataFrame:
    """The points that are shown."""
    return with_shown(points, step).where("shown").drop("shown")


def route(points: DataFrame, step: float) -> DataFrame:
    """The simplified track with distances measured anew along it."""
    return with_distance(simplified(with_distance(points), step).drop("d"))


def summary(points: DataFrame, step: float = 2.0, threshold: float = 3.0) -> DataFrame:
    """Points, display points, km, gain and elevation range of every smoothed track."""
    s = with_shown(with_distance(smoothed(points)), step)
    stats = s.groupBy("track_id").agg(F.count("*").alias("points"), F.count_if("shown").alias("display_points"), (F.max("d") / 1000).alias("km"), F.min("ele").alias("min_e"), F.max("ele").alias("max_e"), F.array_sort(F.collect_list(F.struct("seq", "ele"))).alias("e"))
    stats = stats.withColumn("gain", deadband_gain(F.col("e.ele"), threshold))
    return stats.select("track_id", "points", "display_points", rounded(F.col("km"), 2).alias("km"), rounded(F.col("gain"), 0).alias("gain"), rounded(F.col("min_e"), 1).alias("min_e"), rounded(F.col("max_e"), 1).alias("max_e"))


def bounds(points: DataFrame, margin: float = 0.0) -> DataFrame:
    b = points.groupBy("track_id").agg((F.min("lon") - margin).alias("lo_lo"), (F.max("lon") + margin).alias("lo_hi"), (F.min("lat") - margin).alias("la_lo"), (F.max("lat") + margin).alias("la_hi"), F.avg("lat").alias("lat0"))
    return b


def bbox_key(points: DataFrame, margin: float = 0.0025, pad: int | None = None) -> DataFrame:
    """Cache key of a track: its raw box to three places (rounded as everywhere, half up) and the margin."""
    b = bounds(points)
    tail = "" if pad is None else f"_p{pad}"
    return b.select("track_id", F.format_string(f"%.3f_%.3f_%.3f_%.3f_m%.4f{tail}", *(rounded(F.col(c), 3) for c in ("la_lo", "la_hi", "lo_lo", "lo_hi")), F.lit(margin)).alias("key"))


def local_positions(points: DataFrame) -> DataFrame:
    """x, y in metres from the lower left corner of the track's box."""
    b = bounds(points).withColumnRenamed("lat0", "mean_lat")
    j = points.join(b, "track_id")
    x, y = local_xy(F.col("lat"), F.col("lon"), F.col("mean_lat"), F.col("lo_lo"), F.col("la_lo"))
    return j.select("track_id", "seq", x.alias("x"), y.alias("y"))


def grid_sizes(boxes: DataFrame, resolution: Column, least: Column, most: Column) -> DataFrame:
    """n nodes on a side for a ground resolution, within limits, and the resulting cell in metres."""
    wide = (F.col("lo_hi") - F.col("lo_lo")) * DEGREE_M * F.cos(F.radians(F.col("lat0")))
    span = F.greatest(wide, (F.col("la_hi") - F.col("la_lo")) * DEGREE_M)
    n = F.least(F.greatest(F.floor(span / resolution + 0.5), least), most).cast("int")
    return boxes.withColumn("n", n).withColumn("cell_m", span / (F.col("n") - 1))


def nodes(boxes: DataFrame, n: int, pad: int = 0) -> DataFrame:
    """Endpoint-inclusive mesh of n x n nodes for each box, `pad` more on every side; south to north."""
    i = F.sequence(F.lit(-pad), F.lit(n - 1 + pad))
    g = boxes.select("*", F.explode(i).alias("r")).select("*", F.explode(i).alias("c"))
    lon = F.col("lo_lo") + (F.col("lo_hi") - F.col("lo_lo")) / float(n - 1) * F.col("c")
    lat = F.col("la_lo") + (F.col("la_hi") - F.col("la_lo")) / float(n - 1) * F.col("r")
    return g.select("track_id", "r", "c", lon.alias("lon"), lat.alias("lat"))


def geotransforms(boxes: DataFrame, n: int) -> DataFrame:
    """Pixel size and origin for pixel-extent (px) and node-based (nx) rasters, and the box in metres."""
    w, h = F.col("lo_hi") - F.col("lo_lo"), F.col("la_hi") - F.col("la_lo")
    nx, ny = w / float(n - 1), h / float(n - 1)
    width, depth = local_xy(F.col("la_hi"), F.col("lo_hi"), F.col("lat0"), F.col("lo_lo"), F.col("la_lo"))
    return boxes.select("track_id", F.col("lo_lo").alias("px_x"), (w / float(n)).alias("px_w"), F.col("la_hi").alias("px_y"), (-h / float(n)).alias("px_h"), (F.col("lo_lo") - nx / 2).alias("node_x"), nx.alias("node_w"), (F.col("la_hi") + ny / 2).alias("node_y"), (-ny).alias("node_h"), width.alias("width_m"), depth.alias("depth_m"))


def tiles(boxes: DataFrame, zoom: int) -> DataFrame:
    """Tiles that cover each box, and the crop window of their mosaic in pixels."""
    x0, y0 = tile_xy(F.col("la_hi"), F.col("lo_lo"), zoom)
    x1, y1 = tile_xy(F.col("la_lo"), F.col("lo_hi"), zoom)
    b = boxes.select("track_id", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    f = lambda c: F.floor(c).cast("int")
    tx0, ty0 = f(F.col("x0")), f(F.col("y0"))
    left, top = f((F.col("x0") - tx0) * 256), f((F.col("y0") - ty0) * 256)
    b = b.select("*", left.alias("crop_x"), top.alias("crop_y"), F.greatest(f((F.col("x1") - tx0) * 256) - left, F.lit(1)).alias("crop_w"), F.greatest(f((F.col("y1") - ty0) * 256) - top, F.lit(1)).alias("crop_h"))
    b = b.select("*", F.explode(F.sequence(tx0, f(F.col("x1")))).alias("tx")).select("*", F.explode(F.sequence(ty0, f(F.col("y1")))).alias("ty"))
    return b.select("track_id", "tx", "ty", "crop_x", "crop_y", "crop_w", "crop_h")
