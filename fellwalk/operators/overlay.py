"""Polylines: clipping into runs, drape on terrain, GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import inside
from ..functions.numeric import rounded
from .raster import sampled


def runs_inside(vertices: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Vertices (line_id, vseq, lon, lat) inside the box with their run: consecutive ones share a number,
    counted from 1 along the line. Runs of a single vertex go."""
    w = Window.partitionBy("line_id").orderBy("vseq")
    v = vertices.where(inside(F.col("lon"), F.col("lat"), box))
    v = v.withColumn("_island", F.col("vseq") - F.row_number().over(w))
    v = v.withColumn("_n", F.count("*").over(Window.partitionBy("line_id", "_island"))).where("_n >= 2")
    return v.withColumn("run", F.dense_rank().over(Window.partitionBy("line_id").orderBy("_island")).cast("int")).drop("_island", "_n")


def islands(vertices: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    return runs_inside(vertices, box).groupBy("line_id", "run").agg(F.count("*").alias("n"))


def draped(vertices: DataFrame, box: tuple[float, float, float, float], grid: DataFrame, grid_id: int, n: int) -> DataFrame:
    """Runs with the height of the terrain under each vertex; the box is the grid's extent."""
    west, south, east, north = box
    at = runs_inside(vertices, box).select("line_id", "run", "vseq", F.lit(grid_id).alias("grid_id"), ((F.col("lon") - west) / (east - west) * (n - 1)).alias("x"), ((F.col("lat") - south) / (north - south) * (n - 1)).alias("y"))
    return sampled(grid, at, n, ["line_id", "run", "vseq"])


GEOJSON = "struct<type:string,features:array<struct<type:string,properties:struct<id:bigint>,geometry:struct<type:string,coordinates:string>>>>"


def geojson(vertices: DataFrame) -> DataFrame:
    """One FeatureCollection per line; lines of four vertices or more as a MultiLineString of two halves."""
    v = vertices.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("vseq", "lon", "lat"))).alias("p"))
    v = v.withColumn("p", F.transform("p", lambda q: F.array(rounded(q["lon"], 5), rounded(q["lat"], 5))))
    half, n = F.floor(F.size("p") / 2).cast("int"), F.size("p")
    many = F.to_json(F.array(F.slice("p", 1, half), F.slice("p", half + 1, n - half)))
    kind = F.when(n >= 4, "MultiLineString").otherwise("LineString")
    text = F.concat(F.lit('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":'), F.col("line_id").cast("string"), F.lit('},"geometry":{"type":"'), kind, F.lit('","coordinates":'), F.when(n >= 4, many).otherwise(F.to_json("p")), F.lit("}}]}"))
    return v.select("line_id", text.alias("json"))


def geojson_lines(documents: DataFrame, column: str = "json") -> DataFrame:
    """line_id, part, n, lon, lat: the segments of LineStrings and MultiLineStrings with two vertices or
    more; lon and lat are those of the first vertex."""
    f = documents.select(F.explode(F.from_json(column, GEOJSON)["features"]).alias("f")).select(F.col("f.properties.id").alias("line_id"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("raw"))
    one, many = F.from_json("raw", "array<array<double>>"), F.from_json("raw", "array<array<array<double>>>")
    segments = F.when(F.col("type") == "LineString", F.array(one)).when(F.col("type") == "MultiLineString", many)
    s = f.select("line_id", F.posexplode(segments).alias("part", "p")).where("size(p) > 1")
    return s.select("line_id", "part", F.size("p").alias("n"), F.col("p")[0][0].alias("lon"), F.col("p")[0][1].alias("lat"))


def ways(documents: DataFrame, column: str = "json") -> DataFrame:
    """Map-query responses (elements of type way with a geometry of lat, lon) as FeatureCollections."""
    shape = "struct<elements:array<struct<type:string,id:bigint,geometry:array<struct<lat:double,lon:double>>>>>"
    kept = F.filter(F.from_json(column, shape)["elements"], lambda e: (e["type"] == "way") & (F.size(e["geometry"]) > 1))
    feature = lambda e: F.struct(F.lit("Feature").alias("type"), F.struct(e["id"].alias("id")).alias("properties"), F.struct(F.lit("LineString").alias("type"), F.transform(e["geometry"], lambda g: F.array(g["lon"], g["lat"])).alias("coordinates")).alias("geometry"))
    return documents.withColumn("geojson", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.transform(kept, feature).alias("features"))))
