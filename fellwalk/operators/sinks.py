"""Asset packages: JSON documents as expressions, images as bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rounded


def route_json(points: DataFrame, stats: DataFrame) -> DataFrame:
    """track_id, json: the route's figures and its points (x, y, z, d, lat, lon) in order."""
    p = F.struct("seq", *(rounded(F.col(c), 2).alias(c) for c in ("x", "y", "z", "d")), *(rounded(F.col(c), 7).alias(c) for c in ("lat", "lon")))
    rows = points.groupBy("track_id").agg(F.array_sort(F.collect_list(p)).alias("p"))
    rows = rows.select("track_id", F.transform("p", lambda q: q.dropFields("seq")).alias("points")).join(stats, "track_id")
    body = F.struct(F.col("track_id").cast("string").alias("id"), F.col("km").alias("distanceKm"), F.col("gain").alias("elevationGainM"), F.col("min_e").alias("minElevationM"), F.col("max_e").alias("maxElevationM"), F.col("points_n").alias("pointCount"), F.size("points").alias("displayPointCount"), "points")
    return rows.select("track_id", F.to_json(body).alias("json"))


def packed_rows(grid: DataFrame, value: str = "z") -> DataFrame:
    """One row per grid row: zs, its values from west to east."""
    return grid.groupBy("grid_id", "r").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", F.col(value).alias("v")))), lambda q: q["v"]).alias("zs"))


def terrain_json(grid: DataFrame, width: float, depth: float) -> DataFrame:
    """grid_id, json: all heights row by row from south to north, to millimetres. One document per grid is
    the format; for large grids write packed_rows() as Parquet instead."""
    g = grid.withColumn("v", rounded(F.col("z"), 3))
    rows = packed_rows(g, "v").groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("r", "zs"))).alias("rows"))
    heights = F.flatten(F.transform("rows", lambda q: q["zs"]))
    body = F.struct(F.size("rows").alias("gridSize"), F.lit(width).alias("widthM"), F.lit(depth).alias("depthM"), F.array_min(heights).alias("minHeightM"), F.array_max(heights).alias("maxHeightM"), heights.alias("heights"))
    return rows.select("grid_id", F.to_json(body).alias("json"))


def border_json(runs: DataFrame, name: str = "border", colour: str = "#b54a3c") -> DataFrame:
    """line_id, json: polylines of a line, each a list of (x, y, z)."""
    point = F.struct("vseq", *(rounded(F.col(c), 2).alias(c) for c in ("x", "y", "z")))
    r = runs.groupBy("line_id", "run").agg(F.array_sort(F.collect_list(point)).alias("p"))
    r = r.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("run", "p"))).alias("lines"))
    lines = F.transform("lines", lambda q: F.transform(q["p"], lambda v: F.array(v["x"], v["y"], v["z"])))
    return r.select("line_id", F.to_json(F.struct(F.col("line_id").cast("string").alias("id"), F.lit(name).alias("name"), F.lit(colour).alias("color"), lines.alias("lines"))).alias("json"))


def manifest_json(packages: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """id, json: figures of a package (id, title, width, depth, low, high, km, gain, points) with its layers;
    layers that were not made stay as nulls. Sizes are rounded where they are written, not before the camera is set."""
    from .replay import default_camera

    position, target = default_camera(F.col("width"), F.col("depth"), F.col("low"), F.col("high"))
    two = lambda cs: F.array(*(rounded(c, 2) for c in cs))
    layers = F.struct(*(F.lit(f"terrain-{k}.png").alias(k) for k in ("hillshade", "multishade", "slope", "hypso", "normal")), F.lit(None).cast("string").alias("forest"))
    route = F.struct("id", F.lit("route.json").alias("path"), F.col("km").alias("distanceKm"), F.col("gain").alias("elevationGainM"), F.col("points").alias("pointCount"))
    body = F.struct("id", "title", F.struct(F.lit("terrain.json").alias("path"), *(rounded(F.col(k), 2).alias(k) for k in ("width", "depth")), "low", "high").alias("terrain"), layers.alias("layers"), F.array(route).alias("routes"), F.struct(F.lit(None).cast("string").alias("border")).alias("overlays"), F.struct(two(position).alias("position"), two(target).alias("target"), F.lit(42).alias("fov")).alias("defaultCamera"))
    return packages.select("id", F.to_json(body, options or {"ignoreNullFields": "false"}).alias("json"))


def load_package(spark, folder: str) -> DataFrame:
    """The manifest of an asset folder with its terrain and routes read in. A manifest that names no terrain or no
    route, and a document that it names but that is not there, are errors."""
    from pyspark.errors import AnalysisException

    m = spark.read.json(f"{folder}/manifest.json", multiLine=True)
    has = lambda *path: path[0] in m.columns and (len(path) == 1 or path[1] in getattr(m.schema[path[0]].dataType, "names", ()))
    row = m.select(F.col("terrain.path") if has("terrain", "path") else F.lit(None).alias("path"), (F.size("routes") if has("routes") else F.lit(0)).alias("routes")).first()
    if row is None or not row["path"] or row["routes"] < 1:
        raise ValueError(f"{folder}: the manifest names no {'terrain' if row is None or not row['path'] else 'route'}")
    paths = [row["path"], *(r["path"] for r in m.select(F.explode("routes.path").alias("path")).collect())]  # a package has a handful
    found = {}
    for path in paths:
        try:
            found[path] = spark.read.json(f"{folder}/{path}", multiLine=True)
        except AnalysisException as error:
            raise ValueError(f"{folder}: {path} is missing") from error
    routes = [found[p].select(F.lit(p).alias("path"), "points") for p in paths[1:]]
    r = routes[0]
    for other in routes[1:]:
        r = r.unionByName(other)
    t = found[paths[0]].select("gridSize", "heights")
    return m.select("id", F.explode("routes").alias("route")).join(r, F.col("route.path") == r["path"]).drop("path").crossJoin(t)  # one terrain document


def png(rows: np.ndarray) -> bytes:
    """PNG of height x width (x 3) numbers of 8 or 16 bits."""
    height, width = rows.shape[:2]
    deep = rows.dtype.itemsize == 2
    body = rows.astype(">u2").tobytes() if deep else rows.astype(np.uint8).tobytes()
    line = len(body) // height
    raw = b"".join(b"\0" + body[i * line : (i + 1) * line] for i in range(height))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 16 if deep else 8, 2 if rows.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """Numbers of a PNG whose lines use no filter or the difference to the left, above or both (no interlace)."""
    at, body, head = 8, b"", b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        head, body = (part, body) if kind == b"IHDR" else (head, body + part if kind == b"IDAT" else body)
        at += 12 + n
    width, height, depth, colour = struct.unpack(">IIBB", head[:10])
    channels, size = {0: 1, 2: 3, 4: 2, 6: 4}[colour], depth // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels * size)
    out, step = np.zeros((height, width * channels * size), np.uint8), channels * size
    for y in range(height):
        line, kind = raw[y, 1:].copy(), raw[y, 0]
        up = out[y - 1] if y else np.zeros_like(line)
        if kind == 2:
            line += up
        elif kind:
            for x in range(len(line)):
                left, above = int(line[x - step]) if x >= step else 0, int(up[x])
                corner = int(up[x - step]) if x >= step else 0
                guess = min((left, above, corner), key=lambda v, p=left + above - corner: abs(p - v))
                line[x] = (int(line[x]) + {1: left, 3: (left + above) // 2, 4: guess}[int(kind)]) & 255
        out[y] = line
    shape = (height, width) if channels == 1 else (height, width, channels)
    return (out.view(">u2").astype(np.uint16) if size == 2 else out).reshape(shape)


def images(pixels: DataFrame, values: list[str], deep: bool = False) -> DataFrame:
    """grid_id, png: an image per grid of (grid_id, r, c) with one or three channels, north up."""
    rows = pixels.groupBy("grid_id", "r").agg(F.array_sort(F.collect_list(F.struct("c", *values))).alias("p"))
    rows = rows.groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("r", F.array(*(F.col(f"p.{v}") for v in values)).alias("v")))).alias("rows"))
    rows = rows.select("grid_id", F.reverse(F.transform("rows", lambda q: q["v"])).alias("rows"))
    kind = np.uint16 if deep else np.uint8

    def encode(batches):
        for b in batches:
            out = [png(np.moveaxis(np.array(x, kind), 1, 2).squeeze() if len(values) > 1 else np.array(x, kind)[:, 0]) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["grid_id", "png"])

    return rows.mapInArrow(encode, "grid_id int, png binary")


def image_pixels(images: DataFrame, values: list[str]) -> DataFrame:
    """grid_id, r, c and the channels of (grid_id, png), r counted from the top: images() read back. Bytes that are
    no PNG raise an error, as a package must not hold them."""

    def decode(batches):
        for b in batches:
            for grid_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z = unpng(data)
                z = z.reshape(*z.shape[:2], -1).astype(np.int32)
                r, c = np.divmod(np.arange(z.shape[0] * z.shape[1], dtype=np.int32), np.int32(z.shape[1]))
                flat = z.reshape(len(r), -1).T
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), grid_id, np.int32)), pa.array(r), pa.array(c), *(pa.array(np.ascontiguousarray(v)) for v in flat)], ["grid_id", "r", "c", *values])

    return images.select("grid_id", "png").mapInArrow(decode, f"grid_id int, r int, c int, {', '.join(f'{v} int' for v in values)}")


def build_log(lines: DataFrame, path: str) -> None:
    """Log lines as text files, a folder for each job."""
    lines.select("job_id", "line").write.partitionBy("job_id").mode("append").text(path)
