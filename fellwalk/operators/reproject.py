"""Reprojection of a raster in UTM metres onto nodes in degrees: inverse mapping and a footprint join.

Every node is taken back into the raster's rows and columns. Its kernel, widened where nodes lie farther apart than
cells, covers a rectangle of cells; the node goes to the tiles that this rectangle touches, each tile gives a weighted
sum of what it holds, and the sums of a node are added up. No cell is copied for a node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import utm
from .tiles import SIDE, at_tiles, packed

#: Reach of the kernel in cells, before it is widened; least share of its weight on cells with heights.
REACH, LEAST_SHARE = 2.0, 0.5


def kernel(d: Column) -> Column:
    """Cubic convolution (a = -1/2) at a distance in cells."""
    d = F.abs(d)
    return F.when(d < 1, (d * 1.5 - 2.5) * d * d + 1).when(d < REACH, ((d * -0.5 + 2.5) * d - 4) * d + 2).otherwise(0.0)


def geometry(cells: DataFrame) -> DataFrame:
    """grid_id, x0, dx, columns, y0, dy, rows of each regular raster (grid_id, r, c, x, y, z), from its own coordinates:
    the centre of cell (0, 0), the steps (a falling side has a negative one) and the size. A side of one cell has a step of 1."""
    ends = []
    for v, k, n in (("x", "c", "columns"), ("y", "r", "rows")):
        low, high = F.min(k), F.max(k)
        step = F.coalesce((F.max_by(v, k) - F.min_by(v, k)) / F.nullif(high - low, F.lit(0)), F.lit(1.0))
        ends += [(F.min_by(v, k) - low * step).alias(f"{v}0"), step.alias(f"d{v}"), (high + 1).alias(n)]
    return cells.groupBy("grid_id").agg(*ends)


def placed(nodes: DataFrame, frames: DataFrame, keys: list[str], zone: int) -> DataFrame:
    """Nodes with their place (x, y) in cells and the widths (wide_x, wide_y) of the kernel: how many cells a step of the
    target is, from the sizes of the whole target in both, 1 at least. Nodes, which are many more than the planner
    takes them for, are joined where they are; frames and widths have one row a grid or mesh."""
    east, north = utm(F.col("lat"), F.col("lon"), zone)
    p = nodes.join(frames.hint("shuffle_hash"), "grid_id").withColumns({"x": (east - F.col("x0")) / F.col("dx"), "y": (north - F.col("y0")) / F.col("dy")})
    span = lambda v, k: F.greatest(F.lit(1.0), F.coalesce((F.max(v) - F.min(v)) / F.nullif(F.max(k) - F.min(k), F.lit(0)), F.lit(1.0)))
    widths = p.groupBy("grid_id", *keys).agg(span("x", "c").alias("wide_x"), span("y", "r").alias("wide_y"))
    return p.join(widths.hint("shuffle_hash"), ["grid_id", *keys]).select("grid_id", *keys, "r", "c", "x", "y", "wide_x", "wide_y", "rows", "columns")


def _inside(tile_start: Column, tile_size: Column, first: str, last: str) -> Column:
    """Rows (or columns) of a footprint that lie in a tile."""
    return F.sequence(F.greatest(F.col(first), tile_start), F.least(F.col(last), tile_start + tile_size - 1))


def _weighted(rows: Column, columns: Column) -> Column:
    """(s, w) of a tile: the weighted sum of the heights in the rectangle, and of the weights on cells that have one."""
    across = F.transform(columns, lambda c: kernel((c - F.col("x")) / F.col("wide_x")))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))

    def row(r: Column, weights: Column) -> Column:
        first = (r - F.col("r0")) * F.col("tile_columns") + F.element_at(columns, 1) - F.col("c0") + 1
        both = F.zip_with(F.slice("cells", first, F.size(columns)), weights, lambda z, w: F.struct(z.alias("z"), w.alias("w")))
        return F.aggregate(F.filter(both, lambda e: ~F.isnan(e["z"])), zero, lambda a, e: F.struct((a["s"] + e["z"] * e["w"]).alias("s"), (a["w"] + e["w"]).alias("w")))

    def add(a: Column, e: Column) -> Column:
        return F.struct((a["s"] + e["k"] * e["p"]["s"]).alias("s"), (a["w"] + e["k"] * e["p"]["w"]).alias("w"))

    def summed(weights: Column) -> Column:
        parts = F.transform(rows, lambda r: F.struct(kernel((r - F.col("y")) / F.col("wide_y")).alias("k"), row(r, weights).alias("p")))
        return F.aggregate(parts, zero, add)

    return F.transform(F.array(across), summed)[0]  # the weights across are made once for all rows


def reprojected(cells: DataFrame, nodes: DataFrame, keys: list[str] | None = None, zone: int = 32, tile: int = SIDE) -> DataFrame:
    """grid_id, *keys, r, c, z of every node (grid_id, *keys, r, c, lat, lon) from rasters (grid_id, r, c, x, y, z) in metres.

    Cells without heights, and those beyond the edge, drop out and the rest are weighted anew; a node outside the
    raster (by more than half a cell), or with less than half of its kernel's weight on heights, is NULL. Nodes of a grid
    without a raster drop out.
    """
    keys = keys or []
    p = placed(nodes, geometry(cells), keys, zone)
    inside = F.col("x").between(-0.5, F.col("columns") - 0.5) & F.col("y").between(-0.5, F.col("rows") - 0.5)
    for v, n, name in (("x", "columns", "c"), ("y", "rows", "r")):
        reach = F.col(f"wide_{v}") * REACH
        p = p.withColumn(f"{name}_first", F.when(inside, F.greatest(F.ceil(F.col(v) - reach), F.lit(0)).cast("int")))
        p = p.withColumn(f"{name}_last", F.when(inside, F.least(F.floor(F.col(v) + reach), F.col(n) - 1).cast("int")))
    tiles_of = lambda k: F.explode_outer(F.sequence(F.floor(F.col(f"{k}_first") / tile).cast("int"), F.floor(F.col(f"{k}_last") / tile).cast("int")))
    p = p.withColumn("tr", tiles_of("r")).withColumn("tc", tiles_of("c")).drop("rows", "columns")
    met = at_tiles(packed(cells.select("grid_id", "r", "c", "z"), tile, 0).withColumnRenamed("columns", "tile_columns"), p, "left")
    rows = _inside(F.col("r0"), F.expr("size(cells) div tile_columns").cast("int"), "r_first", "r_last")
    columns = _inside(F.col("c0"), F.col("tile_columns"), "c_first", "c_last")
    # a tile at the edge of a raster with holes may end before the footprint begins
    meets = (F.greatest("r_first", "r0") <= F.least(F.col("r_last"), F.col("r0") + F.expr("size(cells) div tile_columns").cast("int") - 1)) & (F.greatest("c_first", "c0") <= F.least(F.col("c_last"), F.col("c0") + F.col("tile_columns") - 1))
    met = met.select("grid_id", *keys, "r", "c", (F.col("wide_x") * F.col("wide_y")).alias("full"), F.when(meets, _weighted(rows, columns)).alias("p"))
    sums = met.groupBy("grid_id", *keys, "r", "c").agg(F.first("full").alias("full"), F.sum("p.s").alias("s"), F.sum("p.w").alias("w"))
    return sums.select("grid_id", *keys, "r", "c", F.when(F.col("w") >= LEAST_SHARE * F.col("full"), F.col("s") / F.col("w")).alias("z"))
