"""Raster operators on (grid_id, r, c, z); r grows to the north, NULL is missing.

Windows are partitioned by grid row or grid column, never by the whole grid; figures of a grid
are aggregated and joined back. tiles.py cuts large grids into tiles with a halo, for places and for stencils.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import utm
from ..functions.numeric import missing
from . import tiles


def along_row():
    return Window.partitionBy("grid_id", "r").orderBy("c")


def along_column():
    return Window.partitionBy("grid_id", "c").orderBy("r")


def with_figures(grid: DataFrame, **figures: Column) -> DataFrame:
    """Adds figures of each grid: aggregated first, then joined back as one row a grid, so that no grid goes
    through one task."""
    return grid.join(grid.groupBy("grid_id").agg(*(f.alias(name) for name, f in figures.items())), "grid_id")


def cleaned(grid: DataFrame) -> DataFrame:
    return grid.withColumn("z", missing(F.col("z")))


def ranges(grid: DataFrame) -> DataFrame:
    """Least and greatest height; (0, 0) for a grid without any."""
    return grid.groupBy("grid_id").agg(F.coalesce(F.min("z"), F.lit(0.0)).alias("min_z"), F.coalesce(F.max("z"), F.lit(0.0)).alias("max_z"))


#: Spacings of the nested lattices of a layout, coarsest first.
SPACINGS = (64, 16, 8, 4, 2, 1)


def write_lattice(grid: DataFrame, folder: str, tile: int = 256) -> None:
    """Writes a grid as nested lattices: each cell lies in the folder of the coarsest lattice that it is on (rows and columns
    at multiples of the spacing), and there by tile. A probe of every n-th row and column reads the folders from n up and no
    other; the finer a read, the more it adds, and all folders are the whole grid."""
    on = lambda s: (F.col("r") % s == 0) & (F.col("c") % s == 0)
    spacing = F.coalesce(*[F.when(on(s), s) for s in SPACINGS])
    cells = grid.select("grid_id", "r", "c", "z", spacing.alias("spacing"), F.floor(F.col("r") / tile).alias("_tr"), F.floor(F.col("c") / tile).alias("_tc"))
    order = ["spacing", "grid_id", "_tr", "_tc"]
    cells.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tr", "_tc").write.partitionBy("spacing").parquet(folder)


def lattice(spark: SparkSession, folder: str, every: int) -> DataFrame:
    """The cells of a layout at every n-th row and column, n being one of SPACINGS; other folders are not read."""
    if every not in SPACINGS:
        raise ValueError(f"no lattice of {every}")
    schema = "grid_id int, r int, c int, z double, spacing int"
    return spark.read.schema(schema).parquet(folder).where(F.col("spacing") >= every).drop("spacing")


def coverage(grid: DataFrame, sample: int | None = None) -> DataFrame:
    """Cells with data of a raw grid, all cells, and whether any sampled cell lies above the sentinel.

    With `sample`, only every so many rows and columns are looked at; of a layout by write_lattice, lattice() reads no more
    than these.
    """
    g = grid if sample is None else grid.where((F.col("r") % sample == 0) & (F.col("c") % sample == 0))
    z = missing(F.col("z"))
    return g.groupBy("grid_id").agg(F.count(z).alias("valid"), F.count("*").alias("cells"), F.coalesce(F.bool_or((F.col("z") > -1000) & ~F.isnan("z")), F.lit(False)).alias("covered"))


def fused(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The primary where it has data, else the secondary (its own holes filled with its least height first),
    else the grid's least height, else 0."""
    s = with_figures(cleaned(secondary), _low=F.min("z")).select("grid_id", "r", "c", F.coalesce("z", "_low").alias("z2"))
    g = cleaned(primary).join(s, ["grid_id", "r", "c"], "left").withColumn("z", F.coalesce("z", "z2")).drop("z2")
    return with_figures(g, _low=F.min("z")).withColumn("z", F.coalesce("z", "_low", F.lit(0.0))).drop("_low")


def sampled(grid: DataFrame, at: DataFrame, n: int, keys: list[str], side: int = tiles.SIDE) -> DataFrame:
    """tiles.sampled of a grid of n x n cells that is packed for it."""
    return tiles.sampled(tiles.packed(grid, side, 1), at, n, keys, side)


def cubic(grid: DataFrame, at: DataFrame, n: int, keys: list[str], side: int = tiles.SIDE) -> DataFrame:
    """tiles.cubic of a grid of n x n cells that is packed for it."""
    return tiles.cubic(tiles.packed(grid, side, 2), at, n, keys, side)


def central(grid: DataFrame, rows: bool, cell: float, name: str, value: str = "z") -> DataFrame:
    """Adds the change of a value along the rows or the columns per metre: central differences inside, one-sided at
    the ends, 0 along a side of one cell. Neighbours are columns first, so that each is fetched once."""
    order, along = (along_row(), "c") if rows else (along_column(), "r")
    g = grid.select("*", *(f(c).over(order).alias(n + k) for f, n in ((F.lag, "_b"), (F.lead, "_a")) for c, k in ((value, "z"), (along, "n"))))
    before, after = F.col("_bn").isNotNull(), F.col("_an").isNotNull()
    rise = F.when(after, F.col("_az")).otherwise(F.col(value)) - F.when(before, F.col("_bz")).otherwise(F.col(value))
    run = F.when(before & after, 2 * cell).otherwise(float(cell))
    return g.withColumn(name, F.when(before | after, rise / run).otherwise(0.0)).drop("_bz", "_bn", "_az", "_an")


def gradient(grid: DataFrame, cell_x: float = 1.0, cell_y: float = 1.0) -> DataFrame:
    """dx, dy: central differences inside, one-sided at the edges, 0 along a side of one cell."""
    return central(central(grid, True, cell_x, "dx"), False, cell_y, "dy")


def gaussian_kernel(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5) if sigma > 0 else 0
    w = [math.exp(-0.5 * (o / sigma) ** 2) for o in range(-radius, radius + 1)] if radius else [1.0]
    return [x / sum(w) for x in w]


def blurred(grid: DataFrame, rows: bool, w: list[float], value: str = "z") -> DataFrame:
    """One pass of a blur with weights w, along the rows or the columns. Each cell takes its neighbours by lag and
    lead, and those beyond an edge from the mirrored place, which is never farther than the kernel reaches."""
    order = along_row() if rows else along_column()
    radius = len(w) // 2
    if not radius:
        return grid
    near = F.array(*(F.lag(value, -o).over(order) if o else F.col(value) for o in range(-radius, radius + 1)))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # the same order: one window step for all
    grid = grid.select("*", near.alias("_near"), (F.row_number().over(order) - 1).alias("_at"), F.count("*").over(whole).cast("int").alias("_n"))
    out = F.lit(0.0)
    for k, x in enumerate(w):
        j = F.pmod(F.col("_at") + (k - radius), F.col("_n") * 2)
        j = F.when(j < F.col("_n"), j).otherwise(F.col("_n") * 2 - 1 - j)
        out = out + F.element_at("_near", (j - F.col("_at") + (radius + 1)).cast("int")) * F.lit(x)
    return grid.withColumn(value, out).drop("_near", "_at", "_n")


def gaussian(grid: DataFrame, sigma: float) -> DataFrame:
    """Separable Gaussian blur, reflected at the edges; a kernel of radius 0 is no step at all in the plan."""
    w = gaussian_kernel(sigma)
    return blurred(blurred(grid, True, w), False, w)


def unsharp(grid: DataFrame, amount: float = 0.5) -> DataFrame:
    """z + amount (z - mean of the 3 x 3 cells that exist)."""
    row, column = along_row().rowsBetween(-1, 1), along_column().rowsBetween(-1, 1)
    g = grid.withColumn("_s", F.sum("z").over(row)).withColumn("_n", F.count("z").over(row))
    g = g.withColumn("_s", F.sum("_s").over(column)).withColumn("_n", F.sum("_n").over(column))
    return g.withColumn("z", F.col("z") + (F.col("z") - F.col("_s") / F.col("_n")) * amount).drop("_s", "_n")


def decimated(grid: DataFrame, skip: int) -> DataFrame:
    """Every skip-th row and column, numbered anew."""
    return grid.where((F.col("r") % skip == 0) & (F.col("c") % skip == 0)).withColumn("r", (F.col("r") / skip).cast("int")).withColumn("c", (F.col("c") / skip).cast("int"))


def cropped(grid: DataFrame, pad: int, n: int) -> DataFrame:
    """The inner n x n cells of a padded grid."""
    keep = F.col("r").between(pad, pad + n - 1) & F.col("c").between(pad, pad + n - 1)
    return grid.where(keep).withColumn("r", F.col("r") - pad).withColumn("c", F.col("c") - pad)


def flipped(grid: DataFrame, height: int, row: str = "r") -> DataFrame:
    return grid.withColumn(row, F.lit(height - 1) - F.col(row))


def map_grid(grid: DataFrame, f) -> DataFrame:
    """Applies a Column function to every height."""
    return grid.withColumn("z", f(F.col("z")))


def contours(grid: DataFrame, step: float) -> DataFrame:
    """grid_id, level, r, c, x: where lines of constant height cross the edges between neighbours of a row."""
    g = grid.withColumn("z1", F.lead("z").over(along_row())).where("z is not null and z1 is not null")
    low, high = F.least("z", "z1"), F.greatest("z", "z1")
    levels = F.sequence((F.floor(low / step) + 1).cast("int"), F.floor(high / step).cast("int"))
    g = g.where(F.floor(high / step) > F.floor(low / step)).select("*", F.explode(levels).alias("k"))
    level = F.col("k") * float(step)
    return g.select("grid_id", level.alias("level"), "r", "c", (F.col("c") + (level - F.col("z")) / (F.col("z1") - F.col("z"))).alias("x"))


def contour_segments(grid: DataFrame, step: float, major: float | None = None) -> DataFrame:
    """grid_id, level, r, c, x1, y1, x2, y2, major: pieces of lines of constant height, see edge_segments."""
    return edge_segments(grid, step, major).drop("k", "e1", "e2")


def edge_segments(grid: DataFrame, step: float, major: float | None = None) -> DataFrame:
    """grid_id, k, level, r, c, x1, y1, e1, x2, y2, e2, major: pieces of the k-th lines of constant height in each square of four
    nodes (c to c + 1, r to r + 1), in cells. A level is crossed where one node lies below it and the other
    does not; in a saddle, the mean of the nodes decides which corners belong together. e1 and e2 number the edges between
    nodes on which the ends lie.
    """
    major = 5 * step if major is None else major
    g = grid.select("grid_id", "r", "c", "z", F.lead("z").over(along_row()).alias("zr"))
    g = g.select("*", F.lead("z").over(along_column()).alias("zu"), F.lead("zr").over(along_column()).alias("zur"))
    g = g.where("z is not null and zr is not null and zu is not null and zur is not null")
    low, high = F.least("z", "zr", "zu", "zur"), F.greatest("z", "zr", "zu", "zur")
    first, last = F.floor(low / step).cast("int") + 1, F.floor(high / step).cast("int")
    g = g.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("k")).withColumn("level", F.col("k") * float(step))
    above = lambda z: F.col(z) >= F.col("level")

    def edge(r, c, upward: int):
        return (r.cast("long") * (1 << 31) + c) * 2 + upward

    def crossing(a, b, x, y, number):
        return F.when(above(a) != above(b), F.struct(x((F.col("level") - F.col(a)) / (F.col(b) - F.col(a))).alias("x"), y((F.col("level") - F.col(a)) / (F.col(b) - F.col(a))).alias("y"), number.alias("e")))

    c, r = F.col("c").cast("double"), F.col("r").cast("double")
    bottom = crossing("z", "zr", lambda t: c + t, lambda t: r, edge(F.col("r"), F.col("c"), 0))
    right = crossing("zr", "zur", lambda t: c + 1, lambda t: r + t, edge(F.col("r"), F.col("c") + 1, 1))
    top = crossing("zu", "zur", lambda t: c + t, lambda t: r + 1, edge(F.col("r") + 1, F.col("c"), 0))
    left = crossing("z", "zu", lambda t: c, lambda t: r + t, edge(F.col("r"), F.col("c"), 1))
    g = g.select("grid_id", "k", "level", "r", "c", bottom.alias("b"), right.alias("e"), top.alias("t"), left.alias("l"), ((F.col("z") + F.col("zr") + F.col("zu") + F.col("zur")) / 4 >= F.col("level")).alias("mid"), above("z").alias("corner"))
    line = lambda p, q: F.struct(F.col(p).alias("p"), F.col(q).alias("q"))
    saddle = F.when(F.col("mid") == F.col("corner"), F.array(line("b", "e"), line("l", "t"))).otherwise(F.array(line("l", "b"), line("e", "t")))
    ends = F.filter(F.array("l", "b", "e", "t"), lambda p: p.isNotNull())
    lines = F.when(F.size(ends) == 4, saddle).otherwise(F.array(F.struct(ends[0].alias("p"), F.element_at(ends, 2).alias("q"))))
    g = g.where(F.size(ends) >= 2).select("grid_id", "k", "level", "r", "c", F.explode(lines).alias("s"))
    ratio = F.col("level") / float(major)
    return g.select("grid_id", "k", "level", "r", "c", F.col("s.p.x").alias("x1"), F.col("s.p.y").alias("y1"), F.col("s.p.e").alias("e1"), F.col("s.q.x").alias("x2"), F.col("s.q.y").alias("y2"), F.col("s.q.e").alias("e2"), (F.abs(ratio - F.round(ratio)) < 1e-6).alias("major"))


def resize_weights(size: int, to: int, kernel: str) -> list[tuple[int, int, float]]:
    """(new place, old place, weight) of a resampling along one side. The kernel widens when the side shrinks, and
    weights are scaled to a sum of one where the edge cuts it off."""
    reach, f = KERNELS[kernel]
    scale = size / to
    wide = max(scale, 1.0)
    out = []
    for i in range(to):
        centre = (i + 0.5) * scale
        taps = range(max(0, int(centre - reach * wide + 0.5)), min(size, int(centre + reach * wide + 0.5)))
        w = [f((k - centre + 0.5) / wide) for k in taps]
        out += [(i, k, x / sum(w)) for k, x in zip(taps, w, strict=True) if x]
    return out


def _bicubic(x: float) -> float:
    x = abs(x)
    return (1.5 * x - 2.5) * x * x + 1 if x < 1 else ((-0.5 * x + 2.5) * x - 4) * x + 2 if x < 2 else 0.0


def _lanczos(x: float) -> float:
    return 1.0 if x == 0 else math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * math.pi * x * x / 3) if abs(x) < 3 else 0.0


#: Reach and curve of the resampling kernels.
KERNELS = {"bicubic": (2.0, _bicubic), "lanczos": (3.0, _lanczos)}


def resized(grid: DataFrame, shape: tuple[int, int], to: tuple[int, int], kernel: str = "bicubic", values: tuple[str, ...] = ("z",)) -> DataFrame:
    """The grid at another size (rows, columns): one weighted sum along each row, then one along each column.

    Each is a join with a table of weights, a few for each new row or column, so it is broadcast.
    """

    def along(g: DataFrame, side: str, other: str, size: int, n: int) -> DataFrame:
        weights = grid.sparkSession.createDataFrame(resize_weights(size, n, kernel), f"_new int, {side} int, _w double")
        g = g.join(F.broadcast(weights), side).groupBy("grid_id", other, "_new").agg(*(F.sum(F.col(v) * F.col("_w")).alias(v) for v in values))
        return g.withColumnRenamed("_new", side)

    return along(along(grid.select("grid_id", "r", "c", *values), "c", "r", shape[1], to[1]), "r", "c", shape[0], to[0])


def warped(grid: DataFrame, at: DataFrame, n: int, origin: tuple[float, float], cell: float, keys: list[str], zone: int = 32) -> DataFrame:
    """Cubic height at places (grid_id, lat, lon) from a grid in UTM metres whose node (0, 0) lies at `origin` (east,
    north); NULL outside."""
    east, north = utm(F.col("lat"), F.col("lon"), zone)
    p = at.select(*keys, "grid_id", ((east - origin[0]) / cell).alias("x"), ((north - origin[1]) / cell).alias("y"))
    return cubic(grid, p, n, keys)


#: Accuracy of the sketch that brackets a percentile, and heights of a grid that need no bracket.
ACCURACY, FEW = 10_000, 40_000


def percentile_bounds(grid: DataFrame, low: float = 0.02, high: float = 0.98, accuracy: int = ACCURACY, few: int = FEW) -> DataFrame:
    """Interpolated percentiles of each grid, exact; 0 where it has no heights.

    A mergeable sketch brackets both ranks between two heights. A second pass counts what lies below the brackets and the
    different heights inside, some 4 / accuracy of a grid, and only these are sorted. No task holds a grid.
    """
    error, few = 2.0 / accuracy, max(few, 4 * accuracy)  # below that, ranks are coarser than the brackets
    marks = [min(max(p + e, 0.0), 1.0) for p in (low, high) for e in (-error, error)]
    first = grid.where("z is not null").groupBy("grid_id").agg(F.count("*").alias("n"), F.percentile_approx("z", F.array(*map(F.lit, marks)), accuracy).alias("b"))

    def bracket(k: int, p: float) -> Column:
        rank = (F.col("n") - 1) * p
        below = F.when((F.col("n") > few) & F.lit(marks[2 * k] > 0), F.col("b")[2 * k])
        above = F.when((F.col("n") > few) & F.lit(marks[2 * k + 1] < 1), F.col("b")[2 * k + 1])
        return F.struct(F.lit(k).alias("which"), F.floor(rank).alias("lower"), F.ceil(rank).alias("upper"), (rank - F.floor(rank)).alias("part"), below.alias("from"), above.alias("to"))

    brackets = first.select("grid_id", F.inline(F.array(bracket(0, low), bracket(1, high))))
    held = grid.where("z is not null").select("grid_id", "z").join(brackets, "grid_id").where("to is null or z <= to")
    # all that lies below a bracket is one row, before any height
    held = held.groupBy("grid_id", "which", "lower", "upper", "part", F.when(~F.coalesce(F.col("z") < F.col("from"), F.lit(False)), F.col("z")).alias("z")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("grid_id", "which").orderBy(F.col("z").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = held.withColumn("_upto", upto)
    at = lambda rank: F.min(F.when(F.col("_upto") > F.col(rank), F.col("z")))
    found = held.groupBy("grid_id", "which").agg((at("lower") + (at("upper") - at("lower")) * F.first("part")).alias("v"))
    both = grid.select("grid_id").distinct().join(found, "grid_id", "left").groupBy("grid_id")
    return both.agg(*(F.coalesce(F.max(F.when(F.col("which") == k, F.col("v"))), F.lit(0.0)).alias(name) for k, name in enumerate(("p_low", "p_high"))))


def mesh_vertices(grid: DataFrame, n: int, width: float, depth: float, exaggeration: float) -> DataFrame:
    """Scene position and texture place of every node."""
    u, v = F.col("c") / float(n - 1), F.col("r") / float(n - 1)
    return with_figures(grid, _low=F.min("z")).select("grid_id", "r", "c", (u * width - width / 2).alias("x"), ((F.col("z") - F.col("_low")) * exaggeration).alias("y"), (F.lit(depth / 2) - v * depth).alias("zz"), u.alias("u"), v.alias("v"))


def mesh_triangles(grid: DataFrame, n: int) -> DataFrame:
    """Two triangles for each square of nodes: (a, b, d) and (b, e, d), by vertex number."""
    a = F.col("r") * n + F.col("c")
    b, d = a + 1, a + n
    tri = lambda i, *v: F.struct(F.lit(i).alias("t"), *(x.cast("int").alias(k) for k, x in zip("ijk", v, strict=True)))
    g = grid.where((F.col("r") < n - 1) & (F.col("c") < n - 1)).select("grid_id", "r", "c", F.explode(F.array(tri(0, a, b, d), tri(1, b, d + 1, d))).alias("q"))
    return g.select("grid_id", "r", "c", "q.t", "q.i", "q.j", "q.k")
