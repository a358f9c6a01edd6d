"""Inputs in the shapes of the engine: tracks, rasters, polylines, uploads and job logs, derived from the
star-schema and event tables by integer arithmetic, so that two SQL engines agree on every bit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: {name} is a table or another view. A pair holds the Spark and the DuckDB text.
VIEWS: dict[str, str | tuple[str, str]] = {
    "track_points": """SELECT user_id AS track_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS seq,
  CAST(45 AS DOUBLE) + CAST(SUM((event_id * 37) % 11 - 5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(10000 AS DOUBLE) AS lat,
  CAST(7 AS DOUBLE) + CAST(SUM((event_id * 53) % 13 - 6) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(10000 AS DOUBLE) AS lon,
  CAST(1000 AS DOUBLE) + value AS ele FROM {events}""",
    "dem_grid": (
        """SELECT CAST(vec_id DIV 64 AS INT) AS grid_id, CAST(vec_id % 64 AS INT) AS r, CAST(t.pos AS INT) AS c, CAST(1000 AS DOUBLE) + CAST(500 AS DOUBLE) * CAST(t.e AS DOUBLE) AS z
  FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS pos, e WHERE vec_id DIV 64 < (SELECT COUNT(*) DIV 64 FROM {embeddings})""",
        """SELECT CAST(vec_id // 64 AS INT) AS grid_id, CAST(vec_id % 64 AS INT) AS r, CAST(i AS INT) AS c, CAST(1000 AS DOUBLE) + CAST(500 AS DOUBLE) * CAST(embedding[i + 1] AS DOUBLE) AS z
  FROM {embeddings}, range(64) AS s(i) WHERE vec_id // 64 < (SELECT COUNT(*) // 64 FROM {embeddings})""",
    ),
    "dem_primary": "SELECT grid_id, r, c, CASE WHEN (r * 7 + c * 3) % 13 = 0 THEN CAST(-9999 AS DOUBLE) ELSE z END AS z FROM {dem_grid}",
    "dem_secondary": "SELECT grid_id, r, c, CASE WHEN (r + 2 * c) % 7 = 0 OR grid_id = 2 THEN CAST(-99999 AS DOUBLE) ELSE z + CAST(25 AS DOUBLE) END AS z FROM {dem_grid}",
    "canopy": "SELECT grid_id, r, c, CAST(FLOOR(ABS(z - CAST(1000 AS DOUBLE)) * CAST(4 AS DOUBLE)) AS INT) % 130 AS tcd FROM {dem_grid}",
    "pixels": """SELECT grid_id, r AS py, c AS px, CAST(LEAST(GREATEST(FLOOR((z - CAST(750 AS DOUBLE)) / CAST(2 AS DOUBLE)), 0), 255) AS INT) AS red,
  (r * 5 + c * 3) % 256 AS green, (r * 11 + c * 7 + grid_id) % 256 AS blue FROM {dem_grid}""",
    "places": """SELECT c_custkey AS place_id, CAST(c_custkey % 50 AS INT) AS group_id,
  CAST(-6 AS DOUBLE) + CAST((c_custkey % 50) * 3 AS DOUBLE) / CAST(8 AS DOUBLE) + CAST((c_custkey * 7919) % 100 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon,
  CAST(43 AS DOUBLE) + CAST((c_custkey % 50) AS DOUBLE) / CAST(8 AS DOUBLE) + CAST((c_custkey * 104729) % 100 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat FROM {customer}""",
    "border_vertices": """SELECT o_custkey AS line_id, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS vseq,
  CAST(7 AS DOUBLE) + CAST(SUM((o_orderkey * 31) % 9 - 4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(100 AS DOUBLE) AS lon,
  CAST(45 AS DOUBLE) + CAST(SUM((o_orderkey * 17) % 7 - 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(100 AS DOUBLE) AS lat FROM {orders}""",
    "job_events": """SELECT user_id AS job_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS seq,
  CASE event_type WHEN 'signup' THEN 'submit' WHEN 'error' THEN 'cancel' WHEN 'purchase' THEN 'finish' ELSE 'progress' END AS kind, CAST(FLOOR(value) AS INT) % 100 AS pct, event_id FROM {events}""",
    "log_lines": """SELECT job_id, seq AS line_no, CASE kind WHEN 'progress' THEN CONCAT('progress:', CAST(pct AS STRING), ' stage ', CAST(pct % 7 AS STRING))
  WHEN 'cancel' THEN CONCAT('ValueError: bad tile ', CAST(event_id AS STRING)) WHEN 'finish' THEN '# exit=0' ELSE '' END AS line FROM {job_events}""",
    "uploads": """SELECT page_id, CONCAT('track_', CAST(page_id % 20 AS STRING), '-day.gpx') AS filename, CASE page_id % 4 WHEN 0 THEN 'fast' WHEN 1 THEN 'ultra' WHEN 2 THEN 'high' ELSE 'unknown' END AS quality,
  CONCAT('<gpx>', CAST(page_id % 60 AS STRING), '</gpx>') AS text FROM {pages}""",
    "gpx_docs": (
        """SELECT track_id, CONCAT('<gpx><trk><trkseg>', ARRAY_JOIN(TRANSFORM(ARRAY_SORT(COLLECT_LIST(STRUCT(seq, s))), x -> x.s), ''), '</trkseg></trk></gpx>') AS text
  FROM (SELECT track_id, seq, CONCAT('<trkpt lat="', FORMAT_STRING('%.7f', lat), '" lon="', FORMAT_STRING('%.7f', lon), '">',
    CASE WHEN seq % 9 = 8 THEN '' ELSE CONCAT('<ele>', FORMAT_STRING('%.2f', ele), '</ele>') END, '</trkpt>') AS s FROM {track_points}) q GROUP BY track_id""",
        """SELECT track_id, CONCAT('<gpx><trk><trkseg>', STRING_AGG(s, '' ORDER BY seq), '</trkseg></trk></gpx>') AS text
  FROM (SELECT track_id, seq, CONCAT('<trkpt lat="', PRINTF('%.7f', lat), '" lon="', PRINTF('%.7f', lon), '">',
    CASE WHEN seq % 9 = 8 THEN '' ELSE CONCAT('<ele>', PRINTF('%.2f', ele), '</ele>') END, '</trkpt>') AS s FROM {track_points}) q GROUP BY track_id""",
    ),
}


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view over the tables in sf_dir."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][0]
    return spark.sql(text, **{n: read(spark, sf_dir, n) for n in _needs(text)})


def with_views(sql: str) -> str:
    """DuckDB text with the views that it names ({name}) spelled out in front; tables keep their names."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in order:
            text = VIEWS[name] if isinstance(VIEWS[name], str) else VIEWS[name][1]
            for n in _needs(text):
                visit(n)
            order.append(name)

    for n in [*_needs(sql), *(v for v in VIEWS if re.search(rf"\b(FROM|JOIN) {v}\b", sql))]:
        visit(n)
    named = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)  # noqa: E731  (struct literals have more than a word in braces)
    parts = [f"{n} AS ({named(VIEWS[n] if isinstance(VIEWS[n], str) else VIEWS[n][1])})" for n in order]
    body = named(sql).strip()
    if not parts:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(parts)}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body[5:]}"
    return f"WITH {', '.join(parts)} {body}"
