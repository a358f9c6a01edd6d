"""Import jobs: validation, content hashes, the state fold and the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import inside
from ..functions.text import ERROR_LINE, PROGRESS_LINE, job_id, quality

# Supported regions (west, south, east, north), stages and presets of the importer.
FRANCE, PIEMONTE, MOST_POINTS = (-5.3, 41.2, 9.75, 51.3), (6.55, 44.0, 9.25, 46.55), 250_000
STAGES = ((5, "Starting worker"), (8, "Reading GPX track"), (22, "Fetching elevation (DEM)"), (58, "Sampling route & terrain"), (70, "Building map textures"), (82, "Rendering relief & slope"), (90, "Adding forest layer"), (97, "Finalizing assets"))
PRESETS = (("fast", 8.0, 1200), ("high", 5.0, 2200), ("ultra", 3.0, 3200))
TTL_MS = 3_600_000


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRESETS), "quality string, resolution double, most int")


def validated(points: DataFrame, key: str) -> DataFrame:
    """ok, reason of each upload (key, lon, lat): checks in the order points, numbers, count, region."""
    b = points.groupBy(key).agg(F.count("*").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"), F.min("lat").alias("s"), F.max("lat").alias("t"), F.bool_or(F.col("lon").isNull() | F.col("lat").isNull()).alias("bad"))
    both = lambda box: inside(F.col("w"), F.col("s"), box) & inside(F.col("e"), F.col("t"), box)
    reason = F.when(F.col("n") < 2, "too few points").when(F.col("bad"), "invalid coordinates").when(F.col("n") > MOST_POINTS, "too many points").when(~(both(FRANCE) | both(PIEMONTE)), "unsupported area").otherwise("")
    return b.select(key, (reason == "").alias("ok"), reason.alias("reason"))


def with_job_id(uploads: DataFrame) -> DataFrame:
    return uploads.withColumn("job_id", job_id(F.col("text"), quality(F.col("quality"))))


def deduplicated(uploads: DataFrame) -> DataFrame:
    """One row per content hash: the first upload starts the job, n counts all."""
    return with_job_id(uploads).groupBy("job_id").agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


def states(events: DataFrame) -> DataFrame:
    """Latest state of every job from its log (job_id, seq, kind, pct).

    The first cancel or finish decides; a cancelled job stays in error. Progress never falls, starts at 2
    and stays below 100 until the job is ready.
    """
    by = Window.partitionBy("job_id")
    e = events.withColumn("end_seq", F.min(F.when(F.col("kind").isin("cancel", "finish"), F.col("seq"))).over(by))
    s = e.groupBy("job_id").agg(
        F.max(F.when(F.col("seq") == F.col("end_seq"), F.col("kind"))).alias("end_kind"),
        F.max(F.when((F.col("kind") == "progress") & (F.col("end_seq").isNull() | (F.col("seq") < F.col("end_seq"))), F.least(F.col("pct"), F.lit(99)))).alias("p"),
    )
    status = F.when(F.col("end_kind") == "cancel", "error").when(F.col("end_kind") == "finish", "ready").when(F.col("p").isNotNull(), "processing").otherwise("queued")
    return s.select("job_id", status.alias("status"), F.when(status == "ready", 100).otherwise(F.greatest(F.coalesce("p", F.lit(2)), F.lit(2))).cast("int").alias("progress"))


def progress(events: DataFrame) -> DataFrame:
    """Progress that a client sees after each event: the running maximum, at most 99."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.select("job_id", "seq", F.coalesce(F.max(F.when(F.col("kind") == "progress", F.least(F.col("pct"), F.lit(99)))).over(w), F.lit(2)).cast("int").alias("progress"))


def kept(jobs: DataFrame, now_ms: int, ttl_ms: int = TTL_MS) -> DataFrame:
    """Jobs (status, created_at in ms) without the ended ones that are too old."""
    return jobs.where(~(F.col("status").isin("ready", "error") & (F.lit(now_ms) - F.col("created_at") > ttl_ms)))


def staged(jobs: DataFrame) -> DataFrame:
    """Label of the last stage that the progress has reached; the stages are eight literals, no join."""
    label = F.lit(None).cast("string")
    for pct, text in STAGES:
        label = F.when(F.col("progress") >= pct, text).otherwise(label)
    return jobs.withColumn("stage", label)


def cache_hits(uploads: DataFrame, done: DataFrame) -> DataFrame:
    """Jobs asked for, and whether an earlier result (done: job_id) answers them."""
    u = with_job_id(uploads).select("job_id").distinct()
    return u.join(done.select("job_id", F.lit(True).alias("hit")).distinct(), "job_id", "left").select("job_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def progress_lines(lines: DataFrame) -> DataFrame:
    """Progress reports of a log (job_id, line_no, line)."""
    x = lines.where(F.col("line").rlike(PROGRESS_LINE))
    return x.select("job_id", "line_no", F.regexp_extract("line", PROGRESS_LINE, 1).cast("int").alias("pct"), F.substring(F.regexp_extract("line", PROGRESS_LINE, 2), 1, 80).alias("label"))


def details(lines: DataFrame) -> DataFrame:
    """job_id, line_no, detail: what a client sees of every other line that is not blank; 160 characters."""
    line = F.trim("line")
    return lines.where(~line.rlike(PROGRESS_LINE) & (line != "")).select("job_id", "line_no", F.substring(line, 1, 160).alias("detail"))


def newest_first(shots: DataFrame, key: str, order: str) -> DataFrame:
    """Adds `place`: 1 for the shot of each key that was saved last."""
    return shots.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc())).cast("int"))


def looked_up(requests: DataFrame, wanted: str, choices: list[tuple[str, str]]) -> Column:
    """Label of the choice (id, label) that is asked for, the first one's where none is."""
    label = F.lit(choices[0][1])
    for name, text in choices:
        label = F.when(requests[wanted] == name, text).otherwise(label)
    return label


def last_errors(lines: DataFrame) -> DataFrame:
    """The last line that names an error, else the last that is not blank; trimmed, 300 characters."""
    line = F.trim("line")
    found = F.coalesce(F.max_by("line", F.when(line.rlike(ERROR_LINE), F.col("line_no"))), F.max_by("line", F.when(line != "", F.col("line_no"))), F.lit(""))
    return lines.groupBy("job_id").agg(F.substring(F.trim(found), 1, 300).alias("line"))
