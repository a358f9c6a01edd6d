"""GPX tracks and their uploads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How points are found in a track, and the largest upload in bytes.
POINT = r'(?s)<trkpt\s+lat="([^"]+)"\s+lon="([^"]+)"[^>]*>.*?<ele>([^<]+)</ele>'
LOOSE_POINT = r'<trkpt[^>]*lat="([^"]+)"[^>]*lon="([^"]+)"'
MOST_BYTES = 30 << 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def points(documents: DataFrame, key: str, pattern: str = POINT) -> DataFrame:
    """key, seq, lat, lon, ele of every track point with an elevation.

    A point without one takes the next point's, which is then lost: the pattern is lazy across tags, as the
    importer's. Numbers that do not parse are NULL.
    """
    group = lambda i: F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(("lat", "lon", "ele")[i - 1])
    d = documents.select(key, group(1), group(2), group(3))
    e = d.select(key, F.posexplode(F.arrays_zip("lat", "lon", "ele")).alias("seq", "p"))
    return e.select(key, "seq", *(F.col(f"p.{c}").try_cast("double").alias(c) for c in ("lat", "lon", "ele")))


def loose_points(documents: DataFrame, key: str) -> DataFrame:
    """key, lat, lon as the upload check reads them: no elevation needed, so it may count more points."""
    group = lambda i: F.regexp_extract_all("text", F.lit(LOOSE_POINT), F.lit(i)).alias(("lat", "lon")[i - 1])
    d = documents.select(key, group(1), group(2)).select(key, F.explode(F.arrays_zip("lat", "lon")).alias("p"))
    return d.select(key, F.col("p.lat").try_cast("double").alias("lat"), F.col("p.lon").try_cast("double").alias("lon"))


def strict_points(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, ele by the XML reader: a point without elevation keeps its place."""
    return spark.read.format("xml").option("rowTag", "trkpt").schema("_lat double, _lon double, ele double").load(path).select(F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "ele")


def point_errors(documents: DataFrame, key: str) -> DataFrame:
    """key, n, error: points that points() finds in each document; fewer than two are no track."""
    n = F.size(F.regexp_extract_all("text", F.lit(POINT), F.lit(1)))
    return documents.select(key, n.cast("int").alias("n"), F.when(n < 2, "fewer than two points").otherwise("").alias("error"))


def uploads(requests: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """filename, text, error of multipart requests (content_type, body)."""
    boundary = F.regexp_extract("content_type", "boundary=([^;]+)", 1)
    part = F.get(F.filter(F.split("body", F.concat(F.lit(r"\Q--"), boundary, F.lit(r"\E"))), lambda p: p.contains('name="file"')), F.lit(0))
    r = requests.withColumn("_b", boundary).withColumn("_p", F.when(boundary != "", part))
    name = F.coalesce(F.nullif(F.regexp_extract("_p", 'filename="([^"]+)"', 1), F.lit("")), F.lit("imported-route.gpx"))
    text = F.regexp_replace(F.expr(r"substring(_p, instr(_p, '\r\n\r\n') + 4)"), r"\r\n$", "")
    error = F.when(F.octet_length("body") > most_bytes, "too large").when(F.col("_b") == "", "no boundary").when(F.col("_p").isNull(), "no file").when(F.instr("_p", "\r\n\r\n") == 0, "malformed").when(~(text.contains("<gpx") & text.contains("<trkpt")), "not a track").otherwise("")
    keep = [c for c in requests.columns if c not in ("content_type", "body")]
    return r.select(*keep, F.when(error == "", name).alias("filename"), F.when(error == "", text).alias("text"), error.alias("error"))
