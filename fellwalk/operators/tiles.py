"""Rasters packed into tiles: one row holds a square of heights with a halo of its neighbours' cells.

A grid (grid_id, r, c, z) is cut once, by one exchange. Places then meet tiles, not cells: one equi-join on
the tile's key, and the heights around a place are read by index. Stencils run on whole tiles with numpy, exact where
the halo is at least as wide as they reach. Memory is bounded by the side of a tile, not by the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp

#: Cells on a side of a packed tile, and of one that a stencil works on; cells of the halo of a packed one.
SIDE, WIDE, HALO = 64, 256, 2
KEY = ["grid_id", "tr", "tc"]


def tiled(grid: DataFrame, tile: int = WIDE, halo: int = 8) -> DataFrame:
    """Adds (tr, tc): each cell goes to its tile and to the neighbours that need it as their edge. A stencil
    partitioned by (grid_id, tr, tc) is exact inside the tile; own() drops the halo."""
    of = lambda v, by: F.floor((F.col(v) + by) / tile).cast("int")

    def places(v: str) -> Column:
        return F.explode(F.sequence(of(v, -halo), of(v, halo)))  # every tile in reach, also with a halo wider than a tile

    return grid.withColumn("tr", places("r")).withColumn("tc", places("c"))


def own(grid: DataFrame, tile: int = WIDE) -> DataFrame:
    return grid.where((F.floor(F.col("r") / tile) == F.col("tr")) & (F.floor(F.col("c") / tile) == F.col("tc"))).drop("tr", "tc")


def _runs(batches) -> Iterator[list[np.ndarray]]:
    """The columns of each run of rows with one key (the first three columns)."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns[:3]], 0)) + 1
        for s, e in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
            part = [c[s:e] for c in columns]
            if held and any(held[0][k][0] != part[k][0] for k in range(3)):
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _square(r: np.ndarray, c: np.ndarray, values: list[np.ndarray]) -> tuple[int, int, list[np.ndarray]]:
    """First row and column, and the values as squares; NaN where there is no cell or no value."""
    r0, c0 = int(r.min()), int(c.min())
    out = [np.full((int(r.max()) - r0 + 1, int(c.max()) - c0 + 1), np.nan) for _ in values]
    for square, v in zip(out, values, strict=True):
        square[r - r0, c - c0] = v
    return r0, c0, out


def _own(tr: np.ndarray, tc: np.ndarray, r: np.ndarray, c: np.ndarray, tile: int) -> np.ndarray:
    """Which cells are a tile's own, not of its halo."""
    return (r // tile == tr) & (c // tile == tc)


def _dealt(grid: DataFrame, tile: int, halo: int, values: list[str]) -> DataFrame:
    cells = tiled(grid.select("grid_id", "r", "c", *(F.col(v).cast("double").alias(v) for v in values)), tile, halo)
    return cells.select(*KEY, "r", "c", *values).repartition(*KEY).sortWithinPartitions(*KEY)


def packed(grid: DataFrame, tile: int = SIDE, halo: int = HALO) -> DataFrame:
    """grid_id, tr, tc, r0, c0, columns, cells: the heights of a tile and its halo, row by row from (r0, c0); NaN where
    there is none. Tiles without any cell of their own are not made."""

    def pack(batches):
        for grid_id, tr, tc, r, c, z in _runs(batches):
            if not _own(tr, tc, r, c, tile).any():
                continue  # beyond the grid: a halo alone
            r0, c0, (square,) = _square(r, c, [z])
            yield pa.RecordBatch.from_pydict({"grid_id": pa.array([grid_id[0]], pa.int32()), "tr": pa.array([tr[0]], pa.int32()), "tc": pa.array([tc[0]], pa.int32()), "r0": pa.array([r0], pa.int32()), "c0": pa.array([c0], pa.int32()), "columns": pa.array([square.shape[1]], pa.int32()), "cells": pa.array([square.ravel()], pa.list_(pa.float64()))})

    return _dealt(grid, tile, halo, ["z"]).mapInArrow(pack, "grid_id int, tr int, tc int, r0 int, c0 int, columns int, cells array<double>")


def _cell(r: Column, c: Column) -> Column:
    """The height of a cell in the tile of the row; NaN where it has none."""
    return F.coalesce(F.get("cells", (r - F.col("r0")) * F.col("columns") + c - F.col("c0")), F.lit(float("nan")))


def at_tiles(tiles: DataFrame, at: DataFrame, how: str = "inner") -> DataFrame:
    """Places (..., KEY) with their tiles. Neither side is sent to the driver: the planner takes what explode and Arrow make for no larger than
    their input, and would broadcast millions of places, or a whole raster. A tile that most places are in is split at run time."""
    return at.join(tiles.hint("merge"), KEY, how)


def sampled(tiles: DataFrame, at: DataFrame, n: int, keys: list[str], tile: int = SIDE) -> DataFrame:
    """Bilinear height at (grid_id, y, x) in cells, clamped to a grid of n x n cells; NULL next to a missing height.
    Needs a halo of one cell. Places of a grid without tiles drop out."""
    p = at.select(*keys, "grid_id", clamp(F.col("y"), 0.0, float(n - 1)).alias("_y"), clamp(F.col("x"), 0.0, float(n - 1)).alias("_x"))
    p = p.withColumn("tr", F.floor(F.floor("_y") / tile).cast("int")).withColumn("tc", F.floor(F.floor("_x") / tile).cast("int"))
    p = at_tiles(tiles, p).withColumn("_r", F.floor("_y").cast("int")).withColumn("_c", F.floor("_x").cast("int"))
    fy, fx = F.col("_y") - F.col("_r"), F.col("_x") - F.col("_c")
    up, right = F.least(F.col("_r") + 1, F.lit(n - 1)), F.least(F.col("_c") + 1, F.lit(n - 1))
    r, c = F.col("_r"), F.col("_c")
    z = (1 - fy) * (1 - fx) * _cell(r, c) + (1 - fy) * fx * _cell(r, right) + fy * (1 - fx) * _cell(up, c) + fy * fx * _cell(up, right)
    return p.select(*keys, F.nanvl(z, F.lit(None)).alias("z"))


def cubic_weights(f: Column) -> list[Column]:
    """Cubic convolution (a = -1/2) weights of the four neighbours around a fraction f."""
    return [((-f + 2) * f - 1) * f / 2, ((f * 3 - 5) * f * f + 2) / 2, ((f * -3 + 4) * f + 1) * f / 2, (f - 1) * f * f / 2]


def cubic(tiles: DataFrame, at: DataFrame, n: int, keys: list[str], tile: int = SIDE) -> DataFrame:
    """Cubic height at (grid_id, y, x); missing neighbours drop out and the rest are weighted anew, and a
    place outside the grid, or with less than half its weight, is NULL. Needs a halo of two cells."""
    inside = F.col("y").between(0, n - 1) & F.col("x").between(0, n - 1)
    edge = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
    p = at.select(*keys, "grid_id", "y", "x", F.floor(F.when(inside, F.col("y"))).cast("int").alias("_r"), F.floor(F.when(inside, F.col("x"))).cast("int").alias("_c"))
    heights = F.array(*[_cell(edge(F.col("_r") + (i - 1)), edge(F.col("_c") + (j - 1))) for i in range(4) for j in range(4)])
    near = at_tiles(tiles, p.withColumn("tr", F.floor(F.col("_r") / tile).cast("int")).withColumn("tc", F.floor(F.col("_c") / tile).cast("int")), "left")
    near = near.select(*keys, "y", "x", "_r", "_c", heights.alias("_z"))
    wy, wx = cubic_weights(F.col("y") - F.col("_r")), cubic_weights(F.col("x") - F.col("_c"))
    near = near.select(*keys, "_z", F.array(*[wy[i] * wx[j] for i in range(4) for j in range(4)]).alias("_w"))
    full = F.filter(F.zip_with("_z", "_w", lambda z, w: F.struct(z.alias("z"), w.alias("w"))), lambda x: ~F.isnan(x["z"]))
    total = F.aggregate(full, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w")), lambda a, x: F.struct((a["s"] + x["z"] * x["w"]).alias("s"), (a["w"] + x["w"]).alias("w")))
    near = near.select(*keys, total.alias("_t"))
    return near.select(*keys, F.when(F.col("_t.w") >= 0.5, F.col("_t.s") / F.col("_t.w")).alias("z"))


def stencil(grid: DataFrame, work: Callable[..., dict[str, np.ndarray]], values: list[str], names: list[str], halo: int, tile: int = WIDE) -> DataFrame:
    """grid_id, r, c and the named results of work(*squares) for every cell: squares of `values` with NaN for NULL.

    work may treat the border of what it gets as the border of the grid: where it is not, the halo is cut off again,
    so results are those of the whole grid if each depends on cells within `halo` rows and columns.
    """

    def run(batches):
        for grid_id, tr, tc, r, c, *found in _runs(batches):
            inner = _own(tr, tc, r, c, tile)
            if not inner.any():
                continue
            r0, c0, squares = _square(r, c, found)
            made = work(*squares)
            r, c = r[inner], c[inner]
            columns = [made[k][r - r0, c - c0] for k in names]
            yield pa.RecordBatch.from_arrays([pa.array(grid_id[inner]), pa.array(r), pa.array(c), *(pa.array(v, from_pandas=True) for v in columns)], ["grid_id", "r", "c", *names])

    return _dealt(grid, tile, halo, values).mapInArrow(run, "grid_id int, r int, c int, " + ", ".join(f"{k} double" for k in names))


def convolved(z: np.ndarray, weights: list[float]) -> np.ndarray:
    """The same weights along rows, then along columns, mirrored at the edges."""
    reach = len(weights) // 2
    for axis in (1, 0) if reach else ():
        wide = np.pad(z, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], "symmetric")
        n = z.shape[axis]
        z = sum(w * wide.take(range(k, k + n), axis) for k, w in enumerate(weights))
    return z


def slopes(z: np.ndarray, cell: float) -> tuple[np.ndarray, np.ndarray]:
    """Changes along the rows and along the columns per metre: central differences, one-sided at the edges, 0 along a side of one cell."""
    return tuple(np.gradient(z, cell, axis=k) if z.shape[k] > 1 else np.zeros_like(z) for k in (1, 0))


def blurred(grid: DataFrame, weights: list[float], tile: int = WIDE) -> DataFrame:
    """A separable blur of z in one exchange; a kernel of one weight is no step at all."""
    if len(weights) == 1:
        return grid
    return stencil(grid, lambda z: {"z": convolved(z, weights)}, ["z"], ["z"], len(weights) // 2, tile)
