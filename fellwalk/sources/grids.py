"""Raster files: the grid cache, raw float rasters and image tiles, read through the binaryFile source."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sinks import packed_rows, unpng
from . import tiff

MAGIC, VERSION = b"FWGRID\0\0", 1


def encode_grid(z: np.ndarray) -> bytes:
    """Head (magic, version, width, height; little endian), then 32-bit floats row by row."""
    return MAGIC + struct.pack("<III", VERSION, z.shape[1], z.shape[0]) + z.astype("<f4").tobytes()


def decode_grid(data: bytes) -> np.ndarray | None:
    """None for anything that is not a whole grid of this version: a miss, not an error."""
    if len(data) < 20 or data[:8] != MAGIC:
        return None
    version, width, height = struct.unpack("<III", data[8:20])
    if version != VERSION or len(data) != 20 + 4 * width * height:
        return None
    return np.frombuffer(data, "<f4", offset=20).reshape(height, width)


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def encoded(grid: DataFrame, encode) -> DataFrame:
    """path (the grid's id), content: each grid as the bytes of one file, as encode(id, heights) writes them. One grid
    is one file by the format, so it fits a task."""
    rows = packed_rows(grid).groupBy("grid_id").agg(F.array_sort(F.collect_list(F.struct("r", "zs"))).alias("rows"))
    rows = rows.select(F.col("grid_id").cast("string").alias("path"), F.transform("rows", lambda q: q["zs"]).alias("z"))

    def run(batches):
        for b in batches:
            out = [encode(name, np.array(z, float)) for name, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


def cells(contents: DataFrame, decode, columns: str) -> DataFrame:
    """path, r, c and columns of (path, content), as decode reads them; None leaves a file out."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                z = decode(data)
                if z is None:
                    continue
                for r in range(0, z.shape[0], 256):  # some rows at a time
                    part = z[r : r + 256]
                    rr, cc = np.divmod(np.arange(part.shape[0] * part.shape[1]), part.shape[1])
                    values = part.reshape(len(rr), -1).T
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rr), pa.string()), pa.array((rr + r).astype(np.int32)), pa.array(cc.astype(np.int32)), *(pa.array(np.ascontiguousarray(v)) for v in values)], ["path", "r", "c", *[x.split()[0] for x in columns.split(", ")]])

    return contents.mapInArrow(run, f"path string, r int, c int, {columns}")


def cache_cells(contents: DataFrame) -> DataFrame:
    """path, r, c, z of grid-cache contents; broken ones are left out."""
    return cells(contents, lambda d: None if (z := decode_grid(d)) is None else z.astype(float), "z double")


def raw_cells(contents: DataFrame, width: int) -> DataFrame:
    """path, r, c, z of headless 32-bit floats of a known width."""
    return cells(contents, lambda d: np.frombuffer(d, "<f4").astype(float).reshape(-1, width), "z double")


def geotiff_cells(contents: DataFrame) -> DataFrame:
    """path, r, c, x, y, z of GeoTIFFs: heights in a projection, or tree cover; no data is NULL. raster.warped() takes
    them to other nodes. A file that cannot be read is an error."""
    return cells(contents, tiff.decode, "x double, y double, z double").withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """path, r, c, z of grid-cache files; broken files are left out."""
    return cache_cells(files(spark, path))


def read_raw(spark: SparkSession, path: str, width: int) -> DataFrame:
    """path, r, c, z of headless 32-bit float rasters of a known width."""
    return raw_cells(files(spark, path), width)


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """path, r, c, x, y, z of GeoTIFF files."""
    return geotiff_cells(files(spark, path))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """path, r, c, red, green, blue of PNG tiles."""
    return cells(files(spark, path), lambda d: unpng(d)[..., :3].astype(np.int32), "red int, green int, blue int")
