"""Replay of a route: positions by distance, headings, lines of sight, camera rigs and clocks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp, lerp
from .fold import BLOCK, Fold, Form, folded
from .raster import sampled

# Fixed values of the follow camera, in metres.
BACK, AHEAD, CLEARANCE, SIDE, TARGET_SHARE = 500.0, 740.0, 140.0, 680.0, 0.2
LEAST_DISTANCE, MOST_DISTANCE = 1450.0, 2050.0


def monotone(points: DataFrame) -> DataFrame:
    """Distances that never fall: one that does not grow is replaced by the one before plus the step in
    space. Fold over (track_id, seq, d, x, y, z); a missing d does not grow, a step with a missing end is 0."""

    def steps(m: np.ndarray) -> np.ndarray:
        return np.nan_to_num(np.sqrt((np.diff(m[:, 1:], axis=0) ** 2).sum(axis=1)))

    def first(row, before, value):
        if before is None or not value >= row[0] and not np.isnan(row[0]):
            return float(row[0])
        return value + float(steps(np.stack([before, row]))[0])

    def form(m: np.ndarray) -> Form:
        s, d = steps(m), m[1:, 0]
        way = np.cumsum(s)
        lo = np.where(np.isnan(d), -np.inf, d - np.append(0.0, way)[: len(d)])
        return Form(lo, np.full(len(d), np.inf), d - way, np.ones(len(d)), way, d)

    return folded(points, "track_id", "seq", Fold(["d", "x", "y", "z"], first, form), "d")


def at_distance(points: DataFrame, wanted: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Values interpolated at distances (track_id, at); clamped to both ends.

    As-of join by one window: points and wanted distances are sorted together, each wanted one sees the
    last point at or before it, which carries its successor. No range join, no blow-up.
    """
    w = Window.partitionBy("track_id").orderBy("seq")
    p = points.select("track_id", F.col("d").alias("_d"), F.struct("d", F.lead("d").over(w).alias("next_d"), *values, *(F.lead(v).over(w).alias(f"next_{v}") for v in values)).alias("_here"), *(F.lit(None).cast(wanted.schema[k].dataType).alias(k) for k in keys if k != "track_id"), F.lit(0).alias("_asks"), F.col("seq").alias("_seq"))
    first = F.min(F.when(F.col("_asks") == 0, F.col("_d"))).over(Window.partitionBy("track_id"))
    q = wanted.select("track_id", F.col("at").alias("_d"), F.lit(None).cast(p.schema["_here"].dataType).alias("_here"), *[k for k in keys if k != "track_id"], F.lit(1).alias("_asks"), F.lit(None).cast("int").alias("_seq"))
    both = p.unionByName(q).withColumn("_d", F.when(F.col("_asks") == 1, F.greatest("_d", first)).otherwise(F.col("_d")))
    order = Window.partitionBy("track_id").orderBy("_d", "_asks", "_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_here", F.last("_here", ignorenulls=True).over(order)).where("_asks = 1")
    h = lambda k: F.col(f"_here.{k}")
    t = F.when(h("next_d").isNull(), 0.0).otherwise((F.col("_d") - h("d")) / F.greatest(h("next_d") - h("d"), F.lit(0.001)))
    return both.select(*keys, *(F.when(h("next_d").isNull(), h(v)).otherwise(lerp(h(v), h(f"next_{v}"), t)).alias(v) for v in values))


def headings(points: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Unit heading (hx, hz) and degrees at distances, from a place behind to one ahead; (0, -1) where these
    are within a metre. Needs x and z of the scene."""
    behind = at_distance(points, wanted.withColumn("at", F.col("at") - BACK), ["x", "z"], keys).select(*keys, F.col("x").alias("bx"), F.col("z").alias("bz"))
    ahead = at_distance(points, wanted.withColumn("at", F.col("at") + AHEAD), ["x", "z"], keys)
    j = ahead.join(behind, keys).withColumn("dx", F.col("x") - F.col("bx")).withColumn("dz", F.col("z") - F.col("bz"))
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dz") * F.col("dz"))
    still = length * length < 1
    j = j.select(*keys, F.when(still, 0.0).otherwise(F.col("dx") / length).alias("hx"), F.when(still, -1.0).otherwise(F.col("dz") / length).alias("hz"))
    return j.withColumn("degrees", F.pmod(F.degrees(F.atan2("hx", -F.col("hz"))) + 360, F.lit(360.0)))


def occlusion(cases: DataFrame, grid: DataFrame, n: int, keys: list[str], samples: int = 14, parts: int = 16, clearance: float = CLEARANCE) -> DataFrame:
    """How far terrain plus clearance rises above the line from eye to target (both x, y, z in cells and
    metres of grid grid_id); 0 if nowhere."""
    s = cases.select("*", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("i")).withColumn("t", F.col("i") / float(parts))
    at = lambda k: lerp(F.col(f"eye_{k}"), F.col(f"target_{k}"), F.col("t"))
    s = s.select(*keys, "grid_id", at("x").alias("x"), at("z").alias("y"), at("y").alias("line_y"))
    z = sampled(grid, s, n, [*keys, "line_y"])  # samples bring their height of the line along: no second join
    return z.groupBy(*keys).agg(F.greatest(F.max(F.col("z") + clearance - F.col("line_y")), F.lit(0.0)).alias("score"))


def side_offsets(cases: DataFrame, grid: DataFrame, n: int, key: str, side: float, strong: float = 260.0, samples: int = 14) -> DataFrame:
    """Sideways step of eye and target that sees best, damped by how bad the straight view is; 0 if that is
    free or no side is better. Needs the heading (hx, hz)."""
    c = cases.select("*", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))).alias("side"))
    length = F.sqrt(F.col("hx") * F.col("hx") + F.col("hz") * F.col("hz"))
    rx, rz, step = F.col("hz") / length, -F.col("hx") / length, F.col("side") * side
    c = c.select(key, "side", "grid_id", *((F.col(f"{p}_{k}") + r * step * share).alias(f"{p}_{k}") for p, share in (("eye", 1.0), ("target", TARGET_SHARE)) for k, r in (("x", rx), ("z", rz))), "eye_y", "target_y")
    s = occlusion(c, grid, n, [key, "side"], samples)
    b = s.groupBy(key).agg(F.max(F.when(F.col("side") == 0, F.col("score"))).alias("straight"), F.min_by("side", F.struct("score", F.abs("side").alias("a"), "side")).alias("best"))
    strength = clamp(F.col("straight") / strong, 0.25, 1.0)
    return b.select(key, F.when(F.col("straight") <= 0, 0.0).otherwise(F.col("best") * side * strength).alias("offset"))


def rig(dx: Column, dy: Column, dz: Column) -> tuple[Column, Column, Column]:
    """(radius, theta, phi) of a camera at an offset from its target."""
    radius = F.greatest(F.lit(10.0), F.sqrt(dx * dx + dy * dy + dz * dz))
    return radius, F.atan2(dx, dz), F.acos(clamp(dy / radius, 0.08, 0.98))


def rig_offset(radius: Column, theta: Column, phi: Column) -> tuple[Column, Column, Column]:
    return radius * F.sin(phi) * F.sin(theta), radius * F.cos(phi), radius * F.sin(phi) * F.cos(theta)


def follow_distance(distance: Column) -> Column:
    """Factor that brings a follow camera's offset into its range."""
    return F.when(distance < 1, 1.0).otherwise(clamp(distance, LEAST_DISTANCE, MOST_DISTANCE) / distance)


def to_scene(x: Column, y: Column, z: Column, width: Column, depth: Column, low: Column, exaggeration: float) -> tuple[Column, Column, Column]:
    return x - width / 2, (z - low) * exaggeration, depth / 2 - y


def to_local(x: Column, y: Column, z: Column, width: Column, depth: Column, low: Column, exaggeration: float) -> tuple[Column, Column, Column]:
    return x + width / 2, depth / 2 - z, y / exaggeration + low


def default_camera(width: Column, depth: Column, low: Column, high: Column) -> tuple[list[Column], list[Column]]:
    """Position and target of the first view."""
    return [width * 0.55, depth * -0.7, (high - low) * 2.2], [width * 0.52, depth * 0.52, (low + high) / 2]


def replay_clock(frames: DataFrame, duration_ms: float = 68_000.0, most_ms: float = 120.0) -> DataFrame:
    """Per cent of the replay after each frame (id, seq, dt in ms): long gaps count as most_ms, it stops at 100."""
    w = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frames.select("id", "seq", F.least(F.sum(F.least("dt", F.lit(most_ms))).over(w) / duration_ms * 100, F.lit(100.0)).alias("pct"))


def damped(frames: DataFrame, damping: float, reset: float = 1100.0, most_s: float = 0.05) -> DataFrame:
    """Value that follows its target (id, seq, dt in seconds, target) exponentially; it jumps where the gap
    exceeds `reset`. Fold over each id's frames; a frame without a target changes nothing, one without dt takes no time."""

    def shares(dt: np.ndarray) -> np.ndarray:
        return np.clip(np.nan_to_num(dt), 0.0, most_s) * damping

    def first(row, before, value):
        target = float(row[1])
        if before is None or np.isnan(value) or abs(target - value) > reset:
            return target
        return value if np.isnan(target) else value + (target - value) * (1.0 - math.exp(-float(shares(row[:1])[0])))

    def form(m: np.ndarray) -> Form:
        k, target = shares(m[1:, 0]), m[1:, 1]
        none = np.isnan(target)
        k = np.where(none, 0.0, k)
        scale = np.exp(-np.cumsum(k))
        shift = scale * np.cumsum(np.where(none, 0.0, target) * -np.expm1(-k) / scale)
        p, q = np.append(1.0, scale)[: len(k)], np.append(0.0, shift)[: len(k)]  # of the row before
        wide = reset * (1 + 1e-9)  # a gap of just `reset` does not exceed it, in spite of rounding
        lo, hi = (np.where(none, far, (target + gap - q) / p) for gap, far in ((-wide, -np.inf), (wide, np.inf)))
        sure = np.append(False, ~(np.abs(np.diff(target)) <= reset))[: len(k)] & ~none
        return Form(lo, hi, (target - shift) / scale, scale, shift, target, sure)

    # exp(-600) is well inside the range of doubles
    block = max(1, min(BLOCK, int(600 / max(damping * most_s, 1e-9))))
    return folded(frames, "id", "seq", Fold(["dt", "target"], first, form, block), "value").drop("dt", "target")
