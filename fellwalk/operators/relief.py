"""Shading, classes and colours of rasters: per-cell expressions that stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, lerp, piecewise, u8, u8_cut
from .raster import with_figures

# Fixed values of the map style.
AZIMUTHS = (0, 45, 90, 135, 225, 270, 315)
SLOPE_COLOURS = ((20.0, (244, 226, 130)), (27.0, (237, 167, 64)), (30.0, (224, 91, 53)), (35.0, (180, 61, 116)), (40.0, (94, 52, 118)), (45.0, (38, 35, 48)))
HYPSO_KNOTS = (0, 80, 150, 255)
HYPSO = {"red": (62, 118, 184, 245), "green": (94, 142, 178, 239), "blue": (88, 94, 132, 230)}
FOREST_CREAM, FOREST_LOW, FOREST_HIGH = (243, 239, 226), (120, 162, 104), (42, 86, 44)
PAPER_LUMA, PAPER_DRAIN, PAPER_TINT, PAPER_SHARE = (0.299, 0.587, 0.114), 0.55, (1.05, 1.0, 0.88), 0.65
RELIEF_BASE, RELIEF_SPAN = 0.72, 0.56
FOREST_GAIN, FOREST_TINT = 6.0, (0.66, 0.92, 0.58)
CHANNELS = ("red", "green", "blue")


def slope_degrees(dx: Column | None = None, dy: Column | None = None) -> Column:
    dx, dy = F.col("dx") if dx is None else dx, F.col("dy") if dy is None else dy
    return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))


def slope_class(degrees: Column) -> Column:
    """Number of class limits at or below the slope."""
    out = F.lit(0)
    for i, (limit, _) in enumerate(SLOPE_COLOURS, 1):
        out = F.when(degrees >= limit, F.lit(i)).otherwise(out)
    return out


def light(azimuth: float, altitude: float) -> tuple[float, float, float]:
    az, alt = math.radians(azimuth), math.radians(altitude)
    return math.cos(alt) * math.sin(az), math.cos(alt) * math.cos(az), math.sin(alt)


def shade(azimuth: float, altitude: float, ambient: float) -> Column:
    """Lambert shading of the surface with gradient dx, dy."""
    lx, ly, lz = light(azimuth, altitude)
    norm = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + 1)
    lit = clamp((-F.col("dx") * lx - F.col("dy") * ly + lz) / norm, 0.0, 1.0)
    return lit * (1 - ambient) + ambient


def hillshade() -> Column:
    return shade(315, 36, 0.34)


def multishade() -> Column:
    return sum((shade(az, 38, 0.28) for az in AZIMUTHS), F.lit(0.0)) / float(len(AZIMUTHS))


def reference_shade() -> Column:
    return clamp(hillshade() * 0.68 + multishade() * 0.32, 0.0, 1.0)


def normalised(z: Column, low: Column, high: Column) -> Column:
    """0..255 between two bounds."""
    return u8((z - low) / F.greatest(high - low, F.lit(1e-9)) * 255)


def heightmap(grid: DataFrame) -> DataFrame:
    """Heights as 16-bit numbers between the grid's extremes."""
    g, low, high = with_figures(grid, _low=F.min("z"), _high=F.max("z")), F.col("_low"), F.col("_high")
    return g.withColumn("q", F.floor(clamp((F.col("z") - low) / F.greatest(high - low, F.lit(1e-9)), 0.0, 1.0) * 65535 + 0.5).cast("int")).drop("_low", "_high")


def normal_map() -> tuple[Column, Column, Column]:
    """Surface normal as a colour; the north-south channel is turned, as images are stored north up."""
    norm = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + 1)
    code = lambda v: u8_cut((v * 0.5 + 0.5) * 255)
    return code(-F.col("dx") / norm), code(F.lit(1.0) / norm), code(F.col("dy") / norm)


def slope_rgb(degrees: Column, multi: Column) -> tuple[Column, ...]:
    """Grey shading below the first class limit, the class colour times the shading above. Colours are looked up by
    class: chains of conditions for each channel make code too long for the JVM to compile."""
    at = slope_class(degrees)
    colour = lambda k: F.element_at(F.array(*(F.lit(float(rgb[k])) for rgb in ((255, 255, 255), *(c for _, c in SLOPE_COLOURS)))), at + 1)
    factor = F.when(at > 0, multi * 0.34 + 0.72).otherwise(multi)
    return tuple(u8(colour(k) * factor) for k in range(3))


def hypso_rgb(height_u8: Column, reference: Column) -> tuple[Column, ...]:
    return tuple(u8_cut(piecewise(height_u8.cast("double"), HYPSO_KNOTS, HYPSO[c]) * (reference * 0.5 + 0.5)) for c in CHANNELS)


def canopy_density(cover: Column, threshold: float = 50.0) -> Column:
    """Share of the way from the threshold to full cover; numbers above 100 are no data."""
    c = F.when(cover > 100, 0.0).otherwise(cover.cast("double"))
    return clamp((c - threshold) / (100.0 - threshold), 0.0, 1.0)


def forest_rgb(cover: Column, shading: Column, threshold: float = 50.0) -> tuple[Column, ...]:
    d = canopy_density(cover, threshold)
    seen = F.least(d * 3, F.lit(1.0))
    return tuple(u8((F.lit(float(cream)) * (1 - seen) + (d * float(high - low) + float(low)) * seen) * (shading * 0.62 + 0.55)) for cream, low, high in zip(FOREST_CREAM, FOREST_LOW, FOREST_HIGH, strict=True))


def luma(red: Column, green: Column, blue: Column) -> Column:
    return F.floor((red * 299 + green * 587 + blue * 114 + 500) / 1000).cast("int")


def blend(from_: Column, to: Column, factor: float) -> Column:
    return u8_cut(from_ + (to - from_) * factor)


def enhanced(pixels: DataFrame, saturation: float = 1.45, brightness: float = 0.82, contrast: float = 1.16) -> DataFrame:
    """Saturation against the pixel's luma, brightness against black, contrast against the image's mean luma."""
    p = pixels.withColumn("_l", luma(*map(F.col, CHANNELS)))
    p = p.select("*", *(blend(F.lit(0), blend(F.col("_l"), F.col(c), saturation), brightness).alias(f"_{c}") for c in CHANNELS))
    p = with_figures(p, _m=F.floor(F.avg(luma(*(F.col(f"_{c}") for c in CHANNELS))) + 0.5).cast("int"))
    kept = [c for c in pixels.columns if c not in CHANNELS]
    return p.select(*kept, *(blend(F.col("_m"), F.col(f"_{c}"), contrast).alias(c) for c in CHANNELS))


def quality_gate(pixels: DataFrame, least_deviation: float = 8.0, least_bins: int = 24, stride: int = 1) -> DataFrame:
    """Whether an image has contrast and colours: deviation of luma and number of 4-bit colours."""
    p = pixels if stride == 1 else pixels.where((F.col("py") * 64 + F.col("px")) % stride == 0)
    l_ = F.col("red") * 0.299 + F.col("green") * 0.587 + F.col("blue") * 0.114
    bins = F.floor(F.col("red") / 16) * 256 + F.floor(F.col("green") / 16) * 16 + F.floor(F.col("blue") / 16)
    g = p.groupBy("grid_id").agg(F.avg(l_).alias("mean"), F.stddev_pop(l_).alias("deviation"), F.count_distinct(bins).alias("bins"))
    return g.withColumn("ok", (F.col("deviation") >= least_deviation) & (F.col("bins") >= least_bins))


def baked(pixels: DataFrame, shading: Column) -> DataFrame:
    """Shading multiplied into the colours."""
    return pixels.select(*[c for c in pixels.columns if c not in CHANNELS], *(u8_cut(F.col(c) * (clamp(shading, 0.0, 1.0) * 0.78 + 0.5)).alias(c) for c in CHANNELS))


def papery(red: Column, green: Column, blue: Column, intensity: Column) -> tuple[Column, ...]:
    """Map colours (0..1) drained toward their luma and warmed toward cream, where the relief is on."""
    grey = red * PAPER_LUMA[0] + green * PAPER_LUMA[1] + blue * PAPER_LUMA[2]
    return tuple(F.when(intensity > 0, lerp(c, lerp(c, grey, F.lit(PAPER_DRAIN)) * tint, F.lit(PAPER_SHARE))).otherwise(c) for c, tint in zip((red, green, blue), PAPER_TINT, strict=True))


def relief_factor(relief: Column, contrast: Column, intensity: Column) -> Column:
    """What the relief (0..1) multiplies colours with: 1 on average, so it neither lightens nor darkens a map."""
    return lerp(F.lit(1.0), clamp((relief - 0.5) * contrast + 0.5, 0.0, 1.0) * RELIEF_SPAN + RELIEF_BASE, intensity)


def forested(rgb: tuple[Column, ...], texel: tuple[Column, ...], intensity: Column) -> tuple[Column, ...]:
    """Colours with a green tint where the forest layer's green stands out from its other channels."""
    mask = clamp((texel[1] - F.greatest(texel[0], texel[2])) * FOREST_GAIN, 0.0, 1.0) * intensity
    return tuple(F.when(intensity > 0, lerp(c, c * tint, mask)).otherwise(c) for c, tint in zip(rgb, FOREST_TINT, strict=True))


def mosaic(tiles: DataFrame, tx0: int, ty0: int, size: int, crop: tuple[int, int, int, int]) -> DataFrame:
    """Pixels of tiles (tx, ty, px, py) placed side by side and cropped to (x, y, width, height)."""
    x, y, w, h = crop
    gx, gy = (F.col("tx") - tx0) * size + F.col("px"), (F.col("ty") - ty0) * size + F.col("py")
    t = tiles.withColumn("_x", gx - x).withColumn("_y", gy - y).where(F.col("_x").between(0, w - 1) & F.col("_y").between(0, h - 1))
    return t.select(F.col("_x").alias("px"), F.col("_y").alias("py"), *CHANNELS)
