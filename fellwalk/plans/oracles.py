"""SQL for DuckDB that says each query's result independently of the engine; {name} is a view."""

from __future__ import annotations

import math

from ..operators.jobs import PRESETS, STAGES
from ..operators.relief import AZIMUTHS, FOREST_CREAM, FOREST_HIGH, FOREST_LOW, HYPSO, HYPSO_KNOTS, SLOPE_COLOURS
from ..operators.track import savgol_weights
from ..operators.raster import gaussian_kernel
from ..sources.views import with_views

R = "6371000::DOUBLE"


def q(x: str, digits: int) -> str:
    k = f"{10**digits}::DOUBLE"
    return f"(CASE WHEN ({x}) < 0 THEN -(floor(-({x}) * {k} + 0.5::DOUBLE) / {k}) ELSE floor(({x}) * {k} + 0.5::DOUBLE) / {k} END + 0::DOUBLE)"


def f(x: float) -> str:
    return f"({x!r})::DOUBLE"


def hav(lat1, lon1, lat2, lon2) -> str:
    a, b = f"sin(radians({lat2} - {lat1}) / 2)", f"sin(radians({lon2} - {lon1}) / 2)"
    return f"asin(sqrt({a} * {a} + cos(radians({lat1})) * cos(radians({lat2})) * {b} * {b})) * 2 * {R}"


def clamp(x, lo, hi) -> str:
    return f"least(greatest({x}, {lo}), {hi})"


def u8(x) -> str:
    return f"CAST(floor({clamp(x, '0::DOUBLE', '255::DOUBLE')} + 0.5::DOUBLE) AS INT)"


def cut(x) -> str:
    return f"CAST(floor({clamp(x, '0::DOUBLE', '255::DOUBLE')}) AS INT)"


ORD = "PARTITION BY track_id ORDER BY seq"


def segments(source: str) -> str:
    return f"SELECT *, COALESCE({hav('LAG(lat) OVER w', 'LAG(lon) OVER w', 'lat', 'lon')}, 0) AS seg_m FROM {source} WINDOW w AS ({ORD})"


def distance(source: str) -> str:
    return f"SELECT *, SUM(seg_m) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d FROM ({segments(source)})"


def simplified(source: str, step: int) -> str:
    return f"""SELECT * FROM (SELECT *, LAG(d) OVER ({ORD}) AS pd, MAX(d) OVER (PARTITION BY track_id) AS tot, MAX(seq) OVER (PARTITION BY track_id) AS mx FROM ({source}))
      WHERE seq = 0 OR seq = mx OR least(floor(d / {step}), ceil(tot / {step}) - 1) > floor(pd / {step})"""


def savgol(column: str, window: int) -> str:
    w = savgol_weights(window)
    values = ", ".join(f"({p}, {o}, {f(float(w[p, o]))})" for p in range(window) for o in range(window))
    half = window // 2
    return f"""SELECT t.track_id, t.seq, SUM(k.wgt * y.{column}) AS v FROM
      (SELECT *, COUNT(*) OVER (PARTITION BY track_id) AS n FROM track_points) t
      JOIN (VALUES {values}) k(pos, off, wgt) ON k.pos = t.seq - greatest(least(t.seq - {half}, t.n - {window}), 0)
      JOIN track_points y ON y.track_id = t.track_id AND y.seq = greatest(least(t.seq - {half}, t.n - {window}), 0) + k.off
      WHERE t.n >= {window} GROUP BY t.track_id, t.seq
      UNION ALL SELECT track_id, seq, {column} FROM (SELECT *, COUNT(*) OVER (PARTITION BY track_id) AS n FROM track_points) WHERE n < {window}"""


SMOOTH = f"lats AS ({savgol('lat', 15)}), lons AS ({savgol('lon', 15)}), eles AS ({savgol('ele', 61)}), sm AS (SELECT a.track_id, a.seq, a.v AS lat, b.v AS lon, c.v AS ele FROM lats a JOIN lons b USING (track_id, seq) JOIN eles c USING (track_id, seq))"


def bounds(margin: float = 0.0) -> str:
    m = f(margin)
    return f"SELECT track_id, MIN(lon) - {m} AS lo_lo, MAX(lon) + {m} AS lo_hi, MIN(lat) - {m} AS la_lo, MAX(lat) + {m} AS la_hi, AVG(lat) AS lat0 FROM track_points GROUP BY track_id"


def sizes(source: str, res: str, least: int, most: str) -> str:
    span = "greatest((lo_hi - lo_lo) * 111320::DOUBLE * cos(radians(lat0)), (la_hi - la_lo) * 111320::DOUBLE)"
    return f"SELECT *, {span} / (n - 1) AS cell_m FROM (SELECT *, CAST(least(greatest(floor({span} / {res} + 0.5::DOUBLE), {least}), {most}) AS INT) AS n FROM {source})"


def grad(source: str, cell: float = 1.0) -> str:
    def one(w, name):
        return f"CASE WHEN LAG(z) OVER {w} IS NOT NULL AND LEAD(z) OVER {w} IS NOT NULL THEN (LEAD(z) OVER {w} - LAG(z) OVER {w}) / {f(2 * cell)} WHEN LEAD(z) OVER {w} IS NOT NULL THEN (LEAD(z) OVER {w} - z) / {f(cell)} ELSE (z - LAG(z) OVER {w}) / {f(cell)} END AS {name}"

    return f"SELECT *, {one('rw', 'dx')}, {one('cw', 'dy')} FROM {source} WINDOW rw AS (PARTITION BY grid_id, r ORDER BY c), cw AS (PARTITION BY grid_id, c ORDER BY r)"


def shade(az: float, alt: float, ambient: float) -> str:
    a, h = math.radians(az), math.radians(alt)
    x, y, z = math.cos(h) * math.sin(a), math.cos(h) * math.cos(a), math.sin(h)
    return f"({clamp(f'(-dx * {f(x)} - dy * {f(y)} + {f(z)}) / sqrt(dx * dx + dy * dy + 1)', '0::DOUBLE', '1::DOUBLE')} * {f(1 - ambient)} + {f(ambient)})"


HILL = shade(315, 36, 0.34)
MULTI = "((" + " + ".join(shade(a, 38, 0.28) for a in AZIMUTHS) + f") / {f(float(len(AZIMUTHS)))})"
REFERENCE = clamp(f"{HILL} * {f(0.68)} + {MULTI} * {f(0.32)}", "0::DOUBLE", "1::DOUBLE")
SLOPE = "degrees(atan(sqrt(dx * dx + dy * dy)))"
CLASS = "(" + " + ".join(f"(CASE WHEN {SLOPE} >= {lim} THEN 1 ELSE 0 END)" for lim, _ in SLOPE_COLOURS) + ")"
STEEP = grad("dem_grid", 100.0)


def piecewise(x, values) -> str:
    out = f"CASE WHEN {x} <= {HYPSO_KNOTS[0]} THEN {f(float(values[0]))}"
    for k0, k1, v0, v1 in zip(HYPSO_KNOTS, HYPSO_KNOTS[1:], values, values[1:], strict=False):
        out += f" WHEN {x} <= {k1} THEN {f(float(v0))} + ({x} - {f(float(k0))}) / {f(float(k1 - k0))} * {f(float(v1 - v0))}"
    return out + f" ELSE {f(float(values[-1]))} END"


def slope_channel(k: int) -> str:
    out = "CASE"
    for lim, colour in reversed(SLOPE_COLOURS):
        out += f" WHEN {SLOPE} >= {lim} THEN {u8(f'{f(float(colour[k]))} * ({MULTI} * {f(0.34)} + {f(0.72)})')}"
    return out + f" ELSE {u8(f'{MULTI} * 255')} END"


def forest_channel(k: int) -> str:
    d = clamp("((CASE WHEN tcd > 100 THEN 0 ELSE tcd END) - 50::DOUBLE) / 50::DOUBLE", "0::DOUBLE", "1::DOUBLE")
    vis = f"least({d} * 3, 1::DOUBLE)"
    return u8(f"({f(float(FOREST_CREAM[k]))} * (1 - {vis}) + ({d} * {f(float(FOREST_HIGH[k] - FOREST_LOW[k]))} + {f(float(FOREST_LOW[k]))}) * {vis}) * ({f(0.8)} * {f(0.62)} + {f(0.55)})")


def sample(at: str, keys: str, grid: str = "dem_grid") -> str:
    """Bilinear heights at (keys, grid_id, x, y), corner by corner."""
    on = f"SELECT *, {clamp('y', '0::DOUBLE', '63::DOUBLE')} AS yy, {clamp('x', '0::DOUBLE', '63::DOUBLE')} AS xx FROM ({at})"
    k = ", ".join(f"a.{c.strip()}" for c in keys.split(","))
    return f"""SELECT {k}, SUM((CASE WHEN o.dr = 0 THEN 1 - (yy - floor(yy)) ELSE yy - floor(yy) END) * (CASE WHEN o.dc = 0 THEN 1 - (xx - floor(xx)) ELSE xx - floor(xx) END) * g.z) AS z
      FROM ({on}) a, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc), {grid} g
      WHERE g.grid_id = a.grid_id AND g.r = least(CAST(floor(yy) AS INT) + o.dr, 63) AND g.c = least(CAST(floor(xx) AS INT) + o.dc, 63) GROUP BY {k}"""


AT = "SELECT place_id, CAST(place_id % (SELECT COUNT(DISTINCT grid_id) FROM dem_grid) AS INT) AS grid_id, (lon + 6) * 4 AS x, (lat - 43) * 10 AS y FROM places"
CUBIC = ["((-{f} + 2) * {f} - 1) * {f} / 2", "(({f} * 3 - 5) * {f} * {f} + 2) / 2", "(({f} * -3 + 4) * {f} + 1) * {f} / 2", "({f} - 1) * {f} * {f} / 2"]


def cubic_case(v: str, o: str) -> str:
    fr = f"({v} - floor({v}))"
    return "CASE " + " ".join(f"WHEN {o} = {i - 1} THEN {w.format(f=fr)}" for i, w in enumerate(CUBIC)) + " END"


KERNEL = ", ".join(f"({i - len(gaussian_kernel(0.6)) // 2}, {f(w)})" for i, w in enumerate(gaussian_kernel(0.6)))


def mirror(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN -({x}) - 1 WHEN {x} > 63 THEN 127 - ({x}) ELSE {x} END"


INSIDE = "lon BETWEEN 6.97::DOUBLE AND 7.03::DOUBLE AND lat BETWEEN 44.97::DOUBLE AND 45.03::DOUBLE"
ISLANDS = f"""isl AS (SELECT *, vseq - ROW_NUMBER() OVER (PARTITION BY line_id ORDER BY vseq) AS island FROM border_vertices WHERE {INSIDE}),
  runs AS (SELECT *, DENSE_RANK() OVER (PARTITION BY line_id ORDER BY island) AS run FROM (SELECT *, COUNT(*) OVER (PARTITION BY line_id, island) AS m FROM isl) WHERE m >= 2)"""

SCENE = f"scene AS (SELECT track_id, seq, d, ele AS y, (lon - 7) * 78000 AS x, (lat - 45) * -111000 AS z FROM ({distance('track_points')}))"
WANTED = "wanted AS (SELECT track_id, p * 25 AS pct, MAX(d) * p / 4::DOUBLE AS pos FROM scene, range(5) t(p) GROUP BY track_id, p)"
STEPS = "steps AS (SELECT track_id, d, LEAD(d) OVER w AS nd, x, y, z, LEAD(x) OVER w AS nx, LEAD(y) OVER w AS ny, LEAD(z) OVER w AS nz, seq FROM scene WINDOW w AS (PARTITION BY track_id ORDER BY seq))"


def at_distance(wanted: str, keys: str, values: list[str]) -> str:
    """The last step that starts at or before the distance; ends clamp."""
    cols = ", ".join(f"CASE WHEN s.nd IS NULL THEN s.{v} ELSE s.{v} + (s.n{v} - s.{v}) * ((greatest(w.pos, 0::DOUBLE) - s.d) / greatest(s.nd - s.d, {f(0.001)})) END AS {v}" for v in values)
    k = ", ".join(f"w.{c.strip()}" for c in keys.split(","))
    return f"SELECT {k}, {cols} FROM ({wanted}) w JOIN steps s ON s.track_id = w.track_id AND s.d <= greatest(w.pos, 0::DOUBLE) AND (s.nd IS NULL OR greatest(w.pos, 0::DOUBLE) < s.nd)"


SIGHTS = """sights AS (SELECT place_id, 0 AS grid_id, CAST(place_id * 7 % 63 AS DOUBLE) AS eye_x, CAST(place_id * 11 % 63 AS DOUBLE) AS eye_z, CAST(place_id * 13 % 900 + 700 AS DOUBLE) AS eye_y,
  CAST(place_id * 17 % 63 AS DOUBLE) AS target_x, CAST(place_id * 19 % 63 AS DOUBLE) AS target_z, CAST(place_id * 23 % 400 + 800 AS DOUBLE) AS target_y, cos(CAST(place_id AS DOUBLE)) AS hx, sin(CAST(place_id AS DOUBLE)) AS hz FROM places)"""


def occlusion(source: str, keys: str) -> str:
    at = f"SELECT {keys}, i, grid_id, eye_x + (target_x - eye_x) * (i / 16::DOUBLE) AS x, eye_z + (target_z - eye_z) * (i / 16::DOUBLE) AS y, eye_y + (target_y - eye_y) * (i / 16::DOUBLE) AS line_y FROM {source}, range(1, 15) t(i)"
    return f"SELECT {keys}, greatest(MAX(s.z + 140 - l.line_y), 0::DOUBLE) AS score FROM ({sample(at, keys + ', i, line_y')}) s JOIN (SELECT {keys}, i, line_y FROM ({at})) l USING ({keys}, i, line_y) GROUP BY {keys}"


def utm(zone: int = 32) -> tuple[str, str]:
    n = (1 / 298.257223563) / (2 - 1 / 298.257223563)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * 0.9996
    s = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    t = f"sinh(atanh(sin(radians(lat))) - {f(e)} * atanh({f(e)} * sin(radians(lat))))"
    lam = f"radians(lon - {f(float(zone * 6 - 183))})"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt({t} * {t} + 1))"
    x = " + ".join([eta] + [f"{f(c)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, c in enumerate(s, 1)])
    y = " + ".join([xi] + [f"{f(c)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, c in enumerate(s, 1)])
    return f"(({x}) * {f(radius)} + 500000)", f"(({y}) * {f(radius)})"


STATES = """ends AS (SELECT job_id, MIN(CASE WHEN kind IN ('cancel', 'finish') THEN seq END) AS e FROM job_events GROUP BY job_id),
  st AS (SELECT j.job_id, MAX(CASE WHEN j.seq = ends.e THEN kind END) AS k, MAX(CASE WHEN kind = 'progress' AND (ends.e IS NULL OR j.seq < ends.e) THEN least(pct, 99) END) AS p FROM job_events j JOIN ends USING (job_id) GROUP BY j.job_id),
  states AS (SELECT job_id, CASE WHEN k = 'cancel' THEN 'error' WHEN k = 'finish' THEN 'ready' WHEN p IS NOT NULL THEN 'processing' ELSE 'queued' END AS status, CAST(CASE WHEN k = 'finish' THEN 100 ELSE greatest(COALESCE(p, 2), 2) END AS INT) AS progress FROM st)"""
QUALITY = "CASE WHEN quality IN ('fast', 'ultra') THEN quality ELSE 'high' END"
JOB = f"left(sha256(concat(text, {QUALITY}, 'import-v1')), 16)"
LUMA = "CAST(floor((red * 299 + green * 587 + blue * 114 + 500) / 1000) AS INT)"


def blend(a, b, k) -> str:
    return cut(f"{a} + ({b} - {a}) * {f(k)}")


def utm_box() -> str:
    e, n = utm()
    return f"SELECT track_id, {q(f'MIN({e})', 1)} AS e_lo, {q(f'MAX({e})', 1)} AS e_hi, {q(f'MIN({n})', 1)} AS n_lo, {q(f'MAX({n})', 1)} AS n_hi FROM (SELECT track_id, CASE WHEN i < 2 THEN la_lo ELSE la_hi END AS lat, CASE WHEN i % 2 = 0 THEN lo_lo ELSE lo_hi END AS lon FROM ({bounds(0.0025)}), range(4) t(i)) GROUP BY track_id"


def gate(where: str, deviation: int, bins: int) -> str:
    y = f"(red * {f(0.299)} + green * {f(0.587)} + blue * {f(0.114)})"
    b = "COUNT(DISTINCT (red // 16) * 256 + (green // 16) * 16 + blue // 16)"
    return f"SELECT grid_id, {q(f'AVG({y})', 5)} AS mean, {q(f'STDDEV_POP({y})', 5)} AS deviation, {b} AS bins, STDDEV_POP({y}) >= {deviation} AND {b} >= {bins} AS ok FROM {{pixels}} {where} GROUP BY grid_id"


def tile(x: str, lon: bool) -> str:
    return f"(({x} + 180) / 360 * 32768)" if lon else f"((1 - asinh(tan(radians({x}))) / pi()) / 2 * 32768)"


_E, _N = utm()
SQL: dict[str, str] = {
    "haversine_segments": f"SELECT track_id, seq, {q('seg_m', 3)} AS seg_m FROM ({segments('{track_points}')})",
    "cumulative_distance": f"SELECT track_id, seq, {q('d', 3)} AS d FROM ({distance('{track_points}')})",
    "naismith_minutes": f"SELECT track_id, seq, {q('minutes', 4)} AS minutes FROM (SELECT *, SUM(own) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS minutes FROM (SELECT *, greatest(COALESCE(d - LAG(d) OVER w, 0), 0) / 75 + greatest(COALESCE(ele - LAG(ele) OVER w, 0), 0) / 10 AS own FROM ({distance('{track_points}')}) WINDOW w AS ({ORD})))",
    "format_minutes": f"SELECT track_id, CASE WHEN floor(m / 60) > 0 THEN printf('%dh %02d', CAST(floor(m / 60) AS BIGINT), CAST(floor(m - floor(m / 60) * 60 + 0.5::DOUBLE) AS BIGINT)) ELSE printf('%d min', CAST(floor(m + 0.5::DOUBLE) AS BIGINT)) END AS label FROM (SELECT track_id, SUM(own) AS m FROM (SELECT track_id, greatest(COALESCE(d - LAG(d) OVER w, 0), 0) / 75 + greatest(COALESCE(ele - LAG(ele) OVER w, 0), 0) / 10 AS own FROM ({distance('{track_points}')}) WINDOW w AS ({ORD})) GROUP BY track_id)",
    "savgol_lat_lon": f"WITH lats AS ({savgol('lat', 15)}), lons AS ({savgol('lon', 15)}) SELECT track_id, seq, {q('lats.v', 6)} AS lat, {q('lons.v', 6)} AS lon FROM lats JOIN lons USING (track_id, seq) WHERE track_id IN (SELECT track_id FROM {{track_points}})",
    "savgol_ele": f"WITH eles AS ({savgol('ele', 61)}) SELECT track_id, seq, {q('v', 4)} AS v FROM eles WHERE track_id IN (SELECT track_id FROM {{track_points}})",
    "ascent_deadband": f"SELECT track_id, {q('g.t', 3)} AS gain_m FROM (SELECT track_id, list_reduce(list({{'t': 0::DOUBLE, 'low': ele}} ORDER BY seq), lambda a, x: CASE WHEN x.low > a.low + 3 THEN {{'t': a.t + x.low - a.low, 'low': x.low}} WHEN x.low < a.low THEN {{'t': a.t, 'low': x.low}} ELSE a END) AS g FROM {{track_points}} GROUP BY track_id)",
    "simplify_route": f"WITH s AS (SELECT track_id, seq, lat, lon FROM ({simplified(distance('{track_points}'), 100)})) SELECT track_id, seq, {q('d', 3)} AS d FROM ({distance('s')})",
    "route_summary": f"WITH {SMOOTH}, dist AS ({distance('sm')}), shown AS (SELECT track_id, COUNT(*) AS display_points FROM ({simplified('SELECT * FROM dist', 100)}) GROUP BY track_id), gain AS (SELECT track_id, list_reduce(list({{'t': 0::DOUBLE, 'low': ele}} ORDER BY seq), lambda a, x: CASE WHEN x.low > a.low + 3 THEN {{'t': a.t + x.low - a.low, 'low': x.low}} WHEN x.low < a.low THEN {{'t': a.t, 'low': x.low}} ELSE a END) AS g FROM sm GROUP BY track_id) SELECT track_id, COUNT(*) AS points, ANY_VALUE(display_points) AS display_points, {q('MAX(d) / 1000', 2)} AS km, {q('ANY_VALUE(g.t)', 0)} AS gain, {q('MIN(ele)', 1)} AS min_e, {q('MAX(ele)', 1)} AS max_e FROM dist JOIN shown USING (track_id) JOIN gain USING (track_id) WHERE track_id IN (SELECT track_id FROM {{track_points}}) GROUP BY track_id",
    "track_bounds": f"SELECT track_id, {', '.join(f'{q(c, 6)} AS {c}' for c in ('lo_lo', 'lo_hi', 'la_lo', 'la_hi'))} FROM ({bounds(0.0025).replace('track_points', '{track_points}')})",
    "bbox_key": f"SELECT track_id, printf('%.3f_%.3f_%.3f_%.3f_m%.4f', {q('la_lo', 3)}, {q('la_hi', 3)}, {q('lo_lo', 3)}, {q('lo_hi', 3)}, {f(0.0025)}) AS key FROM ({bounds().replace('track_points', '{track_points}')})",
    "mean_latitude": f"SELECT track_id, {q('AVG(lat)', 6)} AS lat0 FROM {{track_points}} GROUP BY track_id",
    "local_xy": f"SELECT t.track_id, t.seq, {q(f'radians(t.lon - b.lo_lo) * cos(radians(b.lat0)) * {R}', 3)} AS x, {q(f'radians(t.lat - b.la_lo) * {R}', 3)} AS y FROM {{track_points}} t JOIN ({bounds()}) b USING (track_id)",
    "grid_sizing": f"WITH b AS ({bounds(0.0025)}) SELECT track_id, n, {q('cell_m', 4)} AS cell_m FROM ({sizes('b', '5::DOUBLE', 100, '3000')}) WHERE track_id IN (SELECT track_id FROM {{track_points}})",
    "preset_sizing": f"WITH b AS (SELECT * FROM ({bounds(0.0025)}), (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {f(r)}, {m})' for n, r, m in PRESETS)}) p(quality, res, most)) SELECT track_id, quality, n, {q('cell_m', 4)} AS cell_m FROM ({sizes('b', 'res', 100, 'most')}) WHERE track_id IN (SELECT track_id FROM {{track_points}})",
    "meshgrid_nodes": f"SELECT track_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, {q('lo_lo + (lo_hi - lo_lo) / 4::DOUBLE * c', 7)} AS lon, {q('la_lo + (la_hi - la_lo) / 4::DOUBLE * r', 7)} AS lat FROM ({bounds().replace('track_points', '{track_points}')}), range(-1, 6) a(r), range(-1, 6) b(c)",
    "geotransforms": "SELECT track_id, "
    + ", ".join(f"{q(x, 7)} AS {k}" for k, x in {"px_x": "lo_lo", "px_w": "(lo_hi - lo_lo) / 64::DOUBLE", "px_y": "la_hi", "px_h": "-(la_hi - la_lo) / 64::DOUBLE", "node_x": "lo_lo - (lo_hi - lo_lo) / 63::DOUBLE / 2", "node_w": "(lo_hi - lo_lo) / 63::DOUBLE", "node_y": "la_hi + (la_hi - la_lo) / 63::DOUBLE / 2", "node_h": "-((la_hi - la_lo) / 63::DOUBLE)"}.items())
    + f", {q(f'radians(lo_hi - lo_lo) * cos(radians(lat0)) * {R}', 2)} AS width_m, {q(f'radians(la_hi - la_lo) * {R}', 2)} AS depth_m FROM ({bounds(0.0025).replace('track_points', '{track_points}')})",
    "tile_keys": f"WITH b AS (SELECT track_id, {tile('lo_lo', True)} AS x0, {tile('lo_hi', True)} AS x1, {tile('la_hi', False)} AS y0, {tile('la_lo', False)} AS y1 FROM ({bounds()})), k AS (SELECT *, CAST(floor((x0 - floor(x0)) * 256) AS INT) AS crop_x, CAST(floor((y0 - floor(y0)) * 256) AS INT) AS crop_y FROM b) SELECT track_id, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, crop_x, crop_y, greatest(CAST(floor((x1 - floor(x0)) * 256) AS INT) - crop_x, 1) AS crop_w, greatest(CAST(floor((y1 - floor(y0)) * 256) AS INT) - crop_y, 1) AS crop_h FROM (SELECT *, UNNEST(range(CAST(floor(x0) AS BIGINT), CAST(floor(x1) AS BIGINT) + 1)) AS tx FROM k) CROSS JOIN LATERAL (SELECT UNNEST(range(CAST(floor(y0) AS BIGINT), CAST(floor(y1) AS BIGINT) + 1)) AS ty) WHERE track_id IN (SELECT track_id FROM {{track_points}})",
    "utm_positions": f"SELECT track_id, seq, {q(_E, 2)} AS easting, {q(_N, 2)} AS northing FROM {{track_points}}",
    "projected_envelope": utm_box().replace("track_points", "{track_points}"),
    "region_validation": "WITH b AS (SELECT group_id, COUNT(*) AS n, MIN(lon) AS w, MAX(lon) AS e, MIN(lat) AS s, MAX(lat) AS t FROM {places} GROUP BY group_id), v AS (SELECT group_id, CASE WHEN n < 2 THEN 'too few points' WHEN n > 250000 THEN 'too many points' WHEN (w >= -5.3::DOUBLE AND e <= 9.75::DOUBLE AND s >= 41.2::DOUBLE AND t <= 51.3::DOUBLE) OR (w >= 6.55::DOUBLE AND e <= 9.25::DOUBLE AND s >= 44::DOUBLE AND t <= 46.55::DOUBLE) THEN '' ELSE 'unsupported area' END AS reason FROM b) SELECT group_id, reason = '' AS ok, reason FROM v",
    "raster_minmax": "SELECT grid_id, COALESCE(MIN(CASE WHEN z >= -1000 THEN z END), 0) AS min_z, COALESCE(MAX(CASE WHEN z >= -1000 THEN z END), 0) AS max_z FROM {dem_primary} GROUP BY grid_id",
    "coverage": "SELECT grid_id, COUNT(CASE WHEN z >= -1000 THEN 1 END) AS valid, COUNT(*) AS cells, BOOL_OR(z > -1000) AS covered FROM {dem_secondary} GROUP BY grid_id",
    "coverage_probe": "SELECT grid_id, BOOL_OR(z > -1000) AS covered FROM {dem_secondary} WHERE r % 8 = 0 AND c % 8 = 0 GROUP BY grid_id",
    "raster_fill": f"WITH p AS (SELECT grid_id, r, c, CASE WHEN z >= -1000 THEN z END AS z FROM {{dem_primary}}), s AS (SELECT grid_id, r, c, COALESCE(z, MIN(z) OVER (PARTITION BY grid_id)) AS z FROM (SELECT grid_id, r, c, CASE WHEN z >= -1000 THEN z END AS z FROM {{dem_secondary}})), j AS (SELECT p.grid_id, p.r, p.c, COALESCE(p.z, s.z) AS z FROM p LEFT JOIN s USING (grid_id, r, c)) SELECT grid_id, r, c, {q('COALESCE(z, MIN(z) OVER (PARTITION BY grid_id), 0)', 6)} AS z FROM j",
    "bilinear_sample": f"SELECT place_id, {q('z', 6)} AS z FROM ({sample(AT, 'place_id', '{dem_grid}').replace('FROM places', 'FROM {places}')})",
    "cubic_resample": f"WITH a AS ({AT.replace('places', '{places}')}), i AS (SELECT * FROM a WHERE x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63), s AS (SELECT i.place_id, SUM(({cubic_case('y', 'o.k')}) * ({cubic_case('x', 'p.k')}) * g.z) AS s, SUM(({cubic_case('y', 'o.k')}) * ({cubic_case('x', 'p.k')})) AS w FROM i, range(-1, 3) o(k), range(-1, 3) p(k), {{dem_grid}} g WHERE g.grid_id = i.grid_id AND g.r = least(greatest(CAST(floor(y) AS INT) + o.k, 0), 63) AND g.c = least(greatest(CAST(floor(x) AS INT) + p.k, 0), 63) GROUP BY i.place_id) SELECT a.place_id, CASE WHEN w >= 0.5 THEN {q('s / w', 5)} END AS z FROM a LEFT JOIN s USING (place_id)",
    "gradient": f"SELECT grid_id, r, c, {q('dx', 6)} AS dx, {q('dy', 6)} AS dy FROM ({grad('{dem_grid}')})",
    "gaussian_blur": f"WITH k AS (SELECT * FROM (VALUES {KERNEL}) t(o, w)), h AS (SELECT g.grid_id, g.r, g.c, SUM(k.w * n.z) AS z FROM {{dem_grid}} g, k, {{dem_grid}} n WHERE n.grid_id = g.grid_id AND n.r = g.r AND n.c = {mirror('g.c + k.o')} GROUP BY g.grid_id, g.r, g.c) SELECT g.grid_id, g.r, g.c, {q('SUM(k.w * n.z)', 5)} AS z FROM h g, k, h n WHERE n.grid_id = g.grid_id AND n.c = g.c AND n.r = {mirror('g.r + k.o')} GROUP BY g.grid_id, g.r, g.c",
    "slope_degrees": f"SELECT grid_id, r, c, {q(SLOPE, 5)} AS slope FROM ({STEEP.replace('dem_grid', '{dem_grid}')})",
    "slope_classes": f"SELECT grid_id, {CLASS} AS class, COUNT(*) AS n FROM ({STEEP.replace('dem_grid', '{dem_grid}')}) GROUP BY 1, 2",
    "slope_class_rollup": f"SELECT grid_id, class, COUNT(*) AS n FROM (SELECT grid_id, {CLASS} AS class FROM ({STEEP.replace('dem_grid', '{dem_grid}')})) GROUP BY ROLLUP (grid_id, class)",
    "hillshade": f"SELECT grid_id, r, c, {q(HILL, 6)} AS shade FROM ({STEEP.replace('dem_grid', '{dem_grid}')})",
    "multishade": f"SELECT grid_id, r, c, {q(MULTI, 6)} AS shade FROM ({STEEP.replace('dem_grid', '{dem_grid}')})",
    "reference_shade": f"SELECT grid_id, r, c, {q(REFERENCE, 6)} AS shade FROM ({STEEP.replace('dem_grid', '{dem_grid}')})",
    "normal_map": "SELECT grid_id, 63 - r AS r, c, " + ", ".join(f"{cut(f'(({v}) * {f(0.5)} + {f(0.5)}) * 255')} AS {k}" for k, v in (("red", "-dx / sqrt(dx * dx + dy * dy + 1)"), ("green", "1::DOUBLE / sqrt(dx * dx + dy * dy + 1)"), ("blue", "dy / sqrt(dx * dx + dy * dy + 1)"))) + f" FROM ({STEEP.replace('dem_grid', '{dem_grid}')})",
    "slope_rgb": f"SELECT grid_id, 63 - r AS r, c, {', '.join(f'{slope_channel(k)} AS {n}' for k, n in enumerate(('red', 'green', 'blue')))} FROM ({STEEP.replace('dem_grid', '{dem_grid}')})",
    "hypso_tint": f"WITH s AS (SELECT *, {u8('(z - MIN(z) OVER (PARTITION BY grid_id)) / greatest(MAX(z) OVER (PARTITION BY grid_id) - MIN(z) OVER (PARTITION BY grid_id), 1e-9::DOUBLE) * 255')} AS h FROM ({STEEP.replace('dem_grid', '{dem_grid}')})) SELECT grid_id, 63 - r AS r, c, {', '.join(f'{cut(f"({piecewise("h", v)}) * ({REFERENCE} * {f(0.5)} + {f(0.5)})")} AS {k}' for k, v in HYPSO.items())} FROM s",
    "percentile_bounds": f"SELECT grid_id, {q('quantile_cont(z, 0.02)', 6)} AS p_low, {q('quantile_cont(z, 0.98)', 6)} AS p_high FROM {{dem_grid}} GROUP BY grid_id",
    "u8_normalize": f"WITH b AS (SELECT grid_id, quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi FROM {{dem_grid}} GROUP BY grid_id) SELECT g.grid_id, g.r, g.c, {u8('(g.z - lo) / greatest(hi - lo, 1e-9::DOUBLE) * 255')} AS u8 FROM {{dem_grid}} g JOIN b USING (grid_id)",
    "heightmap_u16": "SELECT grid_id, r, c, CAST(floor(least(greatest((z - MIN(z) OVER g) / greatest(MAX(z) OVER g - MIN(z) OVER g, 1e-9::DOUBLE), 0), 1) * 65535 + 0.5::DOUBLE) AS INT) AS q FROM {dem_grid} WINDOW g AS (PARTITION BY grid_id)",
    "forest_colorize": f"SELECT grid_id, r, c, {', '.join(f'{forest_channel(k)} AS {n}' for k, n in enumerate(('red', 'green', 'blue')))} FROM {{canopy}}",
    "forest_share": f"SELECT grid_id, {q('AVG(CASE WHEN tcd > 50 AND tcd <= 100 THEN 1::DOUBLE ELSE 0::DOUBLE END) * 100', 6)} AS pct FROM {{canopy}} GROUP BY grid_id",
    "enhance_rgb": f"WITH l AS (SELECT *, {LUMA} AS l FROM {{pixels}}), s AS (SELECT grid_id, py, px, {', '.join(f'{blend("0", blend("l", c, 1.45), 0.82)} AS {c}' for c in ('red', 'green', 'blue'))} FROM l), m AS (SELECT *, CAST(floor(AVG({LUMA}) OVER (PARTITION BY grid_id) + 0.5::DOUBLE) AS INT) AS m FROM s) SELECT grid_id, py, px, {', '.join(f'{blend("m", c, 1.16)} AS {c}' for c in ('red', 'green', 'blue'))} FROM m",
    "image_quality_gate": gate("", 8, 24),
    "image_quality_sample": gate("WHERE (py * 64 + px) % 7 = 0", 10, 40),
    "shade_bake": f"SELECT grid_id, py, px, {', '.join(f'{cut(f"{c} * (least(greatest((px + py) / 126::DOUBLE, 0), 1) * {f(0.78)} + {f(0.5)})")} AS {c}' for c in ('red', 'green', 'blue'))} FROM {{pixels}}",
    "tile_mosaic_crop": "SELECT * FROM (SELECT (grid_id % 2) * 64 + px - 20 AS px, (grid_id // 2) * 64 + py - 30 AS py, red, green, blue FROM {pixels}) WHERE px BETWEEN 0 AND 79 AND py BETWEEN 0 AND 59",
    "thumbnail_sizes": "WITH s AS (SELECT grid_id, MAX(px) + 1 AS w, MAX(py) + 1 + grid_id AS h FROM {pixels} GROUP BY grid_id), k AS (SELECT *, least(48::DOUBLE / w, 36::DOUBLE / h, 1) AS k FROM s) SELECT grid_id, CAST(greatest(floor(w * k + 0.5::DOUBLE), 1) AS INT) AS width, CAST(greatest(floor(h * k + 0.5::DOUBLE), 1) AS INT) AS height FROM k",
    "contour_crossings": f"WITH g AS (SELECT *, LEAD(z) OVER (PARTITION BY grid_id, r ORDER BY c) AS n FROM {{dem_grid}}), l AS (SELECT k * 40::DOUBLE AS level FROM range(-200, 200) t(k)) SELECT grid_id, level, r, c, {q('c + (level - z) / (n - z)', 6)} AS x FROM g JOIN l ON (z < level AND level <= n) OR (n < level AND level <= z)",
    "contour_counts": "WITH g AS (SELECT *, LEAD(z) OVER (PARTITION BY grid_id, r ORDER BY c) AS n FROM {dem_grid}), l AS (SELECT k * 40::DOUBLE AS level, k % 5 = 0 AS major FROM range(-200, 200) t(k)) SELECT grid_id, level, COUNT(*) AS n, ANY_VALUE(major) AS major FROM g JOIN l ON (z < level AND level <= g.n) OR (g.n < level AND level <= z) GROUP BY grid_id, level",
    "mesh_vertices": f"SELECT grid_id, r, c, {q('c / 63::DOUBLE * 6300 - 3150', 6)} AS x, {q('(z - MIN(z) OVER (PARTITION BY grid_id)) * 1.5::DOUBLE', 6)} AS y, {q('3150 - r / 63::DOUBLE * 6300', 6)} AS zz, {q('c / 63::DOUBLE', 6)} AS u, {q('r / 63::DOUBLE', 6)} AS v FROM {{dem_grid}}",
    "mesh_triangles": "SELECT grid_id, r, c, CAST(t AS INT) AS t, CAST(CASE WHEN t = 0 THEN a ELSE a + 1 END AS INT) AS i, CAST(CASE WHEN t = 0 THEN a + 1 ELSE a + 65 END AS INT) AS j, CAST(a + 64 AS INT) AS k FROM (SELECT grid_id, r, c, r * 64 + c AS a FROM {dem_grid} WHERE r < 63 AND c < 63), range(2) x(t)",
    "apron_crop": f"SELECT grid_id, r - 8 AS r, c - 8 AS c, {q('dx', 6)} AS dx, {q('dy', 6)} AS dy FROM ({grad('{dem_grid}')}) WHERE r BETWEEN 8 AND 55 AND c BETWEEN 8 AND 55",
    "border_islands": f"WITH {ISLANDS.replace('border_vertices', '{border_vertices}')} SELECT line_id, CAST(run AS INT) AS run, COUNT(*) AS n FROM runs GROUP BY line_id, run",
    "border_overlay": f"WITH {ISLANDS.replace('border_vertices', '{border_vertices}')} SELECT line_id, CAST(run AS INT) AS run, vseq, {q('z', 6)} AS z FROM ({sample(f'SELECT line_id, run, vseq, 0 AS grid_id, (lon - 6.97::DOUBLE) / {f(7.03 - 6.97)} * 63 AS x, (lat - 44.97::DOUBLE) / {f(45.03 - 44.97)} * 63 AS y FROM runs', 'line_id, run, vseq', '{dem_grid}')})",
    "geojson_lines": f"WITH v AS (SELECT *, COUNT(*) OVER (PARTITION BY line_id) AS n FROM {{border_vertices}}), p AS (SELECT line_id, CASE WHEN n >= 4 AND vseq >= n // 2 THEN 1 ELSE 0 END AS part, vseq, lon, lat FROM v) SELECT line_id, CAST(part AS INT) AS part, CAST(COUNT(*) AS INT) AS n, {q('arg_min(lon, vseq)', 5)} AS lon, {q('arg_min(lat, vseq)', 5)} AS lat FROM p GROUP BY line_id, part HAVING COUNT(*) > 1",
    "distance_sampler": f"WITH {SCENE.replace('track_points', '{track_points}')}, {WANTED}, {STEPS} SELECT track_id, CAST(pct AS INT) AS pct, {q('x', 3)} AS x, {q('y', 3)} AS y, {q('z', 3)} AS z FROM ({at_distance('SELECT * FROM wanted', 'track_id, pct', ['x', 'y', 'z'])})",
    "route_heading": f"WITH {SCENE.replace('track_points', '{track_points}')}, {WANTED}, {STEPS}, b AS ({at_distance('SELECT track_id, pct, pos - 500 AS pos FROM wanted', 'track_id, pct', ['x', 'z'])}), a AS ({at_distance('SELECT track_id, pct, pos + 740 AS pos FROM wanted', 'track_id, pct', ['x', 'z'])}), d AS (SELECT track_id, pct, a.x - b.x AS dx, a.z - b.z AS dz FROM a JOIN b USING (track_id, pct)), h AS (SELECT track_id, pct, CASE WHEN dx * dx + dz * dz < 1 THEN 0 ELSE dx / sqrt(dx * dx + dz * dz) END AS hx, CASE WHEN dx * dx + dz * dz < 1 THEN -1 ELSE dz / sqrt(dx * dx + dz * dz) END AS hz FROM d) SELECT track_id, CAST(pct AS INT) AS pct, {q('hx', 4)} AS hx, {q('hz', 4)} AS hz, {q('(degrees(atan2(hx, -hz)) + 360) - 360 * floor((degrees(atan2(hx, -hz)) + 360) / 360)', 4)} AS degrees FROM h",
    "nearest_route_point": f"SELECT place_id, track_id, s.seq AS seq, {q('s.dist', 6)} AS dist FROM (SELECT place_id, track_id, MIN(struct_pack(dist := sqrt((t.lon - p.lon) * (t.lon - p.lon) + (t.lat - p.lat) * (t.lat - p.lat)), seq := seq)) AS s FROM {{places}} p, {{track_points}} t GROUP BY place_id, track_id)",
    "sightline_occlusion": f"WITH {SIGHTS.replace('places', '{places}')} SELECT place_id, {q('score', 4)} AS score FROM ({occlusion('sights', 'place_id').replace('dem_grid', '{dem_grid}')})",
    "side_offset": f"WITH {SIGHTS.replace('places', '{places}')}, moved AS (SELECT place_id, side, grid_id, eye_x + hz * side * 6.8::DOUBLE AS eye_x, eye_z - hx * side * 6.8::DOUBLE AS eye_z, eye_y, target_x + hz * side * 6.8::DOUBLE * 0.2::DOUBLE AS target_x, target_z - hx * side * 6.8::DOUBLE * 0.2::DOUBLE AS target_z, target_y FROM sights, (VALUES (0), (-1), (1)) s(side)), sc AS ({occlusion('moved', 'place_id, side').replace('dem_grid', '{dem_grid}')}), b AS (SELECT place_id, MAX(CASE WHEN side = 0 THEN score END) AS straight, MAX(CASE WHEN side = -1 THEN score END) AS l, MAX(CASE WHEN side = 1 THEN score END) AS r FROM sc GROUP BY place_id) SELECT place_id, {q('CASE WHEN straight <= 0 THEN 0 ELSE (CASE WHEN l < straight AND l <= r THEN -1 WHEN r < straight THEN 1 ELSE 0 END) * 6.8::DOUBLE * least(greatest(straight / 260, 0.25::DOUBLE), 1) END', 4)} AS offset FROM b",
    "camera_rig": f"WITH d AS (SELECT place_id, CAST(place_id * 37 % 4001 - 2000 AS DOUBLE) AS dx, CAST(place_id * 53 % 4001 - 2000 AS DOUBLE) AS dy, CAST(place_id * 71 % 4001 - 2000 AS DOUBLE) AS dz FROM {{places}}), g AS (SELECT *, greatest(10, sqrt(dx * dx + dy * dy + dz * dz)) AS radius FROM d), p AS (SELECT *, atan2(dx, dz) AS theta, acos(least(greatest(dy / radius, 0.08::DOUBLE), 0.98::DOUBLE)) AS phi FROM g) SELECT place_id, {', '.join(f'{q(x, 5)} AS {k}' for k, x in (('radius', 'radius'), ('theta', 'theta'), ('phi', 'phi'), ('bx', 'radius * sin(phi) * sin(theta)'), ('by', 'radius * cos(phi)'), ('bz', 'radius * sin(phi) * cos(theta)'), ('follow', 'CASE WHEN radius < 1 THEN 1 ELSE least(greatest(radius, 1450), 2050) / radius END')))} FROM p",
    "default_camera": f"WITH b AS (SELECT track_id, radians(MAX(lon) - MIN(lon)) * cos(radians(AVG(lat))) * {R} AS w, radians(MAX(lat) - MIN(lat)) * {R} AS d, MIN(ele) AS lo, MAX(ele) AS hi FROM {{track_points}} GROUP BY track_id) SELECT track_id, {', '.join(f'{q(x, 2)} AS {k}' for k, x in (('p0', 'w * 0.55::DOUBLE'), ('p1', 'd * -0.7::DOUBLE'), ('p2', '(hi - lo) * 2.2::DOUBLE'), ('t0', 'w * 0.52::DOUBLE'), ('t1', 'd * 0.52::DOUBLE'), ('t2', '(lo + hi) / 2')))} FROM b",
    "scene_roundtrip": f"SELECT track_id, seq, {', '.join(f'{q(x, 4)} AS {k}' for k, x in (('sx', '(lon - 7) * 78000 - 4000'), ('sy', '(ele - 900) * 1.5::DOUBLE'), ('sz', '3000 - (lat - 45) * 111000'), ('x', '(lon - 7) * 78000'), ('y', '(lat - 45) * 111000'), ('z', 'ele')))} FROM {{track_points}}",
    "route_centroid": f"WITH {SCENE.replace('track_points', '{track_points}')} SELECT track_id, {q('AVG(x)', 3)} AS x, {q('AVG(y)', 3)} AS y, {q('AVG(z)', 3)} AS z FROM scene GROUP BY track_id",
    "replay_position": "WITH n AS (SELECT track_id, MAX(seq) AS last FROM {track_points} GROUP BY track_id), k AS (SELECT track_id, pct, CAST(floor(pct / 100::DOUBLE * last + 0.5::DOUBLE) AS INT) AS seq FROM n, (VALUES (0), (33), (66), (100)) p(pct)) SELECT track_id, pct, seq, lat, lon FROM k JOIN {track_points} USING (track_id, seq)",
    "replay_clock": f"WITH e AS (SELECT user_id AS id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, least(event_id % 200, 120) AS dt FROM events) SELECT id, CAST(seq AS INT) AS seq, {q('least(SUM(dt) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 68000::DOUBLE * 100, 100)', 6)} AS pct FROM e",
    "gpx_parse": """WITH m AS (SELECT track_id, regexp_extract_all(text, '<trkpt\\s+lat="([^"]+)"\\s+lon="([^"]+)"[^>]*>.*?<ele>([^<]+)</ele>', 1, 's') AS a, regexp_extract_all(text, '<trkpt\\s+lat="([^"]+)"\\s+lon="([^"]+)"[^>]*>.*?<ele>([^<]+)</ele>', 2, 's') AS b, regexp_extract_all(text, '<trkpt\\s+lat="([^"]+)"\\s+lon="([^"]+)"[^>]*>.*?<ele>([^<]+)</ele>', 3, 's') AS e FROM {gpx_docs}) SELECT track_id, CAST(i - 1 AS INT) AS seq, CAST(a[i] AS DOUBLE) AS lat, CAST(b[i] AS DOUBLE) AS lon, CAST(e[i] AS DOUBLE) AS ele FROM (SELECT *, UNNEST(range(1, len(a) + 1)) AS i FROM m)""",
    "gpx_bounds": "SELECT track_id, COUNT(*) AS n, CAST(MIN(o) AS DOUBLE) AS west, CAST(MIN(a) AS DOUBLE) AS south, CAST(MAX(o) AS DOUBLE) AS east, CAST(MAX(a) AS DOUBLE) AS north FROM (SELECT track_id, CAST(printf('%.7f', lat) AS DOUBLE) AS a, CAST(printf('%.7f', lon) AS DOUBLE) AS o FROM {track_points}) GROUP BY track_id",
    "multipart_upload": "SELECT page_id, CASE WHEN ok THEN filename END AS filename, CASE WHEN ok THEN replace(text, '</gpx>', '<trkpt/></gpx>') END AS text, CASE WHEN page_id % 9 = 0 THEN 'no boundary' WHEN page_id % 10 = 0 THEN 'no file' ELSE '' END AS error FROM (SELECT *, page_id % 9 <> 0 AND page_id % 10 <> 0 AS ok FROM {uploads})",
    "slug_title": "WITH n AS (SELECT concat('p', CAST(p_partkey AS VARCHAR)) AS id, p_name AS name FROM part UNION ALL SELECT concat('u', CAST(page_id AS VARCHAR)), replace(filename, '.gpx', '') FROM {uploads}), t AS (SELECT id, COALESCE(NULLIF(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'imported-route') AS slug, trim(regexp_replace(name, '[_-]+', ' ', 'g')) AS w FROM n) SELECT id, slug, CASE WHEN w = '' THEN 'Imported route' ELSE array_to_string(list_transform(string_split(w, ' '), lambda x: concat(upper(x[1]), lower(x[2:]))), ' ') END AS title FROM t",
    "import_job_id": f"SELECT page_id, {QUALITY} AS quality, {JOB} AS job_id FROM {{uploads}}",
    "dedup_uploads": f"SELECT {JOB} AS job_id, COUNT(*) AS n, MIN(page_id) AS first_page FROM {{uploads}} GROUP BY 1",
    "job_state": f"WITH {STATES.replace('job_events', '{job_events}')} SELECT job_id, status, progress FROM states",
    "job_stream": f"WITH {STATES.replace('job_events', '{job_events}')} SELECT job_id, status, progress FROM states",
    "job_progress": "SELECT job_id, seq, CAST(COALESCE(MAX(CASE WHEN kind = 'progress' THEN least(pct, 99) END) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS INT) AS progress FROM {job_events}",
    "job_prune": f"WITH {STATES.replace('job_events', '{job_events}')} SELECT job_id, status, job_id * 60000 AS created_at FROM states WHERE NOT (status IN ('ready', 'error') AND 10000000 - job_id * 60000 > 3600000)",
    "import_stage": f"WITH {STATES.replace('job_events', '{job_events}')}, g AS (SELECT * FROM (VALUES {', '.join(f'({p}, {chr(39)}{t}{chr(39)})' for p, t in STAGES)}) t(pct, label)) SELECT job_id, progress, (SELECT arg_max(label, pct) FROM g WHERE g.pct <= states.progress) AS stage FROM states",
    "cache_hits": f"WITH u AS (SELECT page_id, {JOB} AS job_id FROM {{uploads}}) SELECT job_id, BOOL_OR(page_id % 3 = 0) AS hit FROM u GROUP BY job_id",
    "log_progress": "SELECT job_id, line_no, CAST(regexp_extract(line, '^progress:(\\d+)\\s+(.*)$', 1) AS INT) AS pct, left(regexp_extract(line, '^progress:(\\d+)\\s+(.*)$', 2), 80) AS label FROM {log_lines} WHERE regexp_matches(line, '^progress:(\\d+)\\s+(.*)$')",
    "last_error_line": "SELECT job_id, left(trim(COALESCE(arg_max(line, CASE WHEN regexp_matches(trim(line), '^\\w[\\w.]*(Error|Exception|Warning):') THEN line_no END), arg_max(line, CASE WHEN trim(line) <> '' THEN line_no END), '')), 300) AS line FROM {log_lines} GROUP BY job_id",
    "redact_urls": "SELECT page_id, regexp_replace(concat(url, CASE WHEN page_id % 2 = 0 THEN concat('?token=', CAST(page_id AS VARCHAR)) ELSE '' END), '\\?.*$', '?...') AS url, 'http://host/v1/traces' AS endpoint FROM pages",
    "share_link": "SELECT page_id, concat('http://host/view?route=', filename, '&mode=', quality, '&shot=') AS url FROM {uploads}",
}
AROUND = "SELECT g.grid_id, g.r, g.c, g.z + (g.z - SUM(n.z) / COUNT(*)) * 0.5::DOUBLE AS z FROM {s} g, range(-1, 2) a(i), range(-1, 2) b(j), {s} n WHERE n.grid_id = g.grid_id AND n.r = g.r + i AND n.c = g.c + j GROUP BY g.grid_id, g.r, g.c, g.z"
SQL |= {
    "unsharp_mask": f"SELECT grid_id, r, c, {q('z', 6)} AS z FROM ({AROUND.replace('{s}', '{dem_grid}')})",
    "tiled_unsharp": f"SELECT grid_id, r, c, {q('z', 6)} AS z FROM ({AROUND.replace('{s}', '{dem_grid}')})",
    "lod_decimate": f"WITH s AS (SELECT grid_id, r // 2 AS r, c // 2 AS c, z FROM {{dem_grid}} WHERE r % 2 = 0 AND c % 2 = 0) SELECT grid_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, {q('z', 6)} AS z FROM ({AROUND.replace('{s}', 's')})",
}
SQL |= {
    "monotone_distance": f"WITH RECURSIVE s AS (SELECT track_id, seq, CASE WHEN seq % 5 = 3 THEN 0 ELSE {q('d', 6)} END AS d, ele FROM ({distance('{track_points}')})), m AS (SELECT track_id, seq, d, ele FROM s WHERE seq = 0 UNION ALL SELECT s.track_id, s.seq, CASE WHEN s.d > m.d THEN s.d ELSE m.d + sqrt(1 + (s.ele - m.ele) * (s.ele - m.ele)) END, s.ele FROM m JOIN s ON s.track_id = m.track_id AND s.seq = m.seq + 1) SELECT track_id, seq, {q('d', 3)} AS d FROM m",
    "camera_damping": f"WITH RECURSIVE s AS (SELECT track_id AS id, seq, least(seq % 7 / 100::DOUBLE, 0.05::DOUBLE) AS dt, ele * 10 AS target FROM {{track_points}}), m AS (SELECT id, seq, target AS v FROM s WHERE seq = 0 UNION ALL SELECT s.id, s.seq, CASE WHEN abs(s.target - m.v) > 1100 THEN s.target ELSE m.v + (s.target - m.v) * (1 - exp(-1.85::DOUBLE * s.dt)) END FROM m JOIN s ON s.id = m.id AND s.seq = m.seq + 1) SELECT id, seq, {q('v', 5)} AS value FROM m",
}


BLURRED = f"WITH k AS (SELECT * FROM (VALUES {KERNEL}) t(o, w)), h AS (SELECT g.grid_id, g.r, g.c, SUM(k.w * n.z) AS z FROM {{dem_grid}} g, k, {{dem_grid}} n WHERE n.grid_id = g.grid_id AND n.r = g.r AND n.c = {mirror('g.c + k.o')} GROUP BY g.grid_id, g.r, g.c), blurred AS (SELECT g.grid_id, g.r, g.c, SUM(k.w * n.z) AS z FROM h g, k, h n WHERE n.grid_id = g.grid_id AND n.c = g.c AND n.r = {mirror('g.r + k.o')} GROUP BY g.grid_id, g.r, g.c)"


def resize(rows: int, columns: int, reach: int, kernel: str) -> str:
    """Resampling of 64 x 64 cells as one weighted sum over all cells near each new one; `kernel` is a curve of d."""

    def side(name: str, n: int) -> str:
        scale = 64 / n
        wide = max(scale, 1.0)
        centre = f"(i + 0.5::DOUBLE) * {f(scale)}"
        taps = f"SELECT i, k, (k - {centre} + 0.5::DOUBLE) / {f(wide)} AS d FROM range({n}) a(i), range(64) b(k) WHERE k >= CAST(trunc({centre} - {f(reach * wide)} + 0.5::DOUBLE) AS INT) AND k < CAST(trunc({centre} + {f(reach * wide)} + 0.5::DOUBLE) AS INT)"
        return f"{name} AS (SELECT i, k, w / SUM(w) OVER (PARTITION BY i) AS w FROM (SELECT i, k, {kernel} AS w FROM ({taps})))"

    return f"WITH {side('wy', rows)}, {side('wx', columns)} SELECT grid_id, CAST(wy.i AS INT) AS r, CAST(wx.i AS INT) AS c, {q('SUM(g.z * wx.w * wy.w)', 5)} AS z FROM {{dem_grid}} g JOIN wy ON wy.k = g.r JOIN wx ON wx.k = g.c GROUP BY grid_id, wy.i, wx.i"


BICUBIC = "CASE WHEN abs(d) < 1 THEN 1.5::DOUBLE * pow(abs(d), 3) - 2.5::DOUBLE * d * d + 1 WHEN abs(d) < 2 THEN -0.5::DOUBLE * pow(abs(d), 3) + 2.5::DOUBLE * d * d - 4 * abs(d) + 2 ELSE 0::DOUBLE END"
LANCZOS = "CASE WHEN d = 0 THEN 1::DOUBLE WHEN abs(d) < 3 THEN sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) ELSE 0::DOUBLE END"


def contour_lines() -> str:
    """Segments of each square from its edges, joined as a list of the edges that a level crosses."""
    corners = "SELECT a.grid_id, a.r, a.c, a.z AS z00, b.z AS z01, u.z AS z10, v.z AS z11 FROM {dem_grid} a JOIN {dem_grid} b ON b.grid_id = a.grid_id AND b.r = a.r AND b.c = a.c + 1 JOIN {dem_grid} u ON u.grid_id = a.grid_id AND u.r = a.r + 1 AND u.c = a.c JOIN {dem_grid} v ON v.grid_id = a.grid_id AND v.r = a.r + 1 AND v.c = a.c + 1"
    levels = "SELECT k, k * 40::DOUBLE AS level FROM range(-200, 200) t(k)"
    edge = lambda n, a, b, x, y: f"SELECT grid_id, r, c, level, {n} AS e, {x} AS x, {y} AS y FROM s WHERE ({a} >= level) <> ({b} >= level)"
    t = lambda a, b: f"(level - {a}) / ({b} - {a})"
    parts = " UNION ALL ".join((edge(0, "z00", "z10", "c::DOUBLE", f"r + {t('z00', 'z10')}"), edge(1, "z00", "z01", f"c + {t('z00', 'z01')}", "r::DOUBLE"), edge(2, "z01", "z11", "c + 1::DOUBLE", f"r + {t('z01', 'z11')}"), edge(3, "z10", "z11", f"c + {t('z10', 'z11')}", "r + 1::DOUBLE")))
    pair = "list_extract({}, {})"
    return f"""WITH s AS (SELECT * FROM ({corners}) g JOIN ({levels}) l ON l.level <= greatest(z00, z01, z10, z11) AND l.level > least(z00, z01, z10, z11)),
      e AS ({parts}), n AS (SELECT grid_id, r, c, level, list({{'x': x, 'y': y}} ORDER BY e) AS p FROM e GROUP BY grid_id, r, c, level),
      m AS (SELECT n.*, ((z00 + z01 + z10 + z11) / 4 >= n.level) = (z00 >= n.level) AS same FROM n JOIN s ON s.grid_id = n.grid_id AND s.r = n.r AND s.c = n.c AND s.level = n.level),
      o AS (SELECT grid_id, r, c, level, {pair.format('p', 1)} AS a, {pair.format('p', 2)} AS b FROM m WHERE len(p) = 2
        UNION ALL SELECT grid_id, r, c, level, CASE WHEN same THEN p[2] ELSE p[1] END, CASE WHEN same THEN p[3] ELSE p[2] END FROM m WHERE len(p) = 4
        UNION ALL SELECT grid_id, r, c, level, CASE WHEN same THEN p[1] ELSE p[3] END, p[4] FROM m WHERE len(p) = 4)
      SELECT grid_id, level, r, c, {q('a.x', 6)} AS x1, {q('a.y', 6)} AS y1, {q('b.x', 6)} AS x2, {q('b.y', 6)} AS y2, CAST(level AS BIGINT) % 200 = 0 AS major FROM o"""


def paper(c: str, tint: float) -> str:
    grey = "(red * 0.299::DOUBLE + green * 0.587::DOUBLE + blue * 0.114::DOUBLE)"
    return f"({c} + (({c} + ({grey} - {c}) * 0.55::DOUBLE) * {f(tint)} - {c}) * 0.65::DOUBLE)"


def shader(c: str, tint: float, forest: float) -> str:
    relief = f"(1 + ({clamp('(relief - 0.5::DOUBLE) * 1.3::DOUBLE + 0.5::DOUBLE', '0::DOUBLE', '1::DOUBLE')} * 0.56::DOUBLE + 0.72::DOUBLE - 1) * 0.8::DOUBLE)"
    mask = f"({clamp('(fg - greatest(fr, fb)) * 6', '0::DOUBLE', '1::DOUBLE')} * 0.6::DOUBLE)"
    lit = f"({paper(c, tint)} * {relief})"
    return q(f"{lit} + ({lit} * {f(forest)} - {lit}) * {mask}", 6)


#: The queries' meshes (west, east, south, north, nodes on a side).
MESHES = {"coarse": (6.452, 6.536, 45.128, 45.192, 17), "fine": (6.47, 6.495, 45.14, 45.158, 41)}
BAKED = (6.456, 6.53, 45.13, 45.186, 64)


def curve(d: str) -> str:
    return f"(CASE WHEN abs({d}) < 1 THEN (abs({d}) * 1.5::DOUBLE - 2.5::DOUBLE) * abs({d}) * abs({d}) + 1 WHEN abs({d}) < 2 THEN ((abs({d}) * -0.5::DOUBLE + 2.5::DOUBLE) * abs({d}) - 4) * abs({d}) + 2 ELSE 0::DOUBLE END)"


def reprojected(meshes: dict[str, tuple]) -> str:
    """warped (grid_id, mesh, r, c, z): every node against every cell in reach of its widened kernel."""
    boxes = ", ".join(f"('{k}', {f(w)}, {f(e)}, {f(s)}, {f(n)}, {m})" for k, (w, e, s, n, m) in meshes.items())
    tap = lambda v, wide: f"UNNEST(range(CAST(greatest(ceil({v} - 2 * {wide}), 0) AS BIGINT), CAST(least(floor({v} + 2 * {wide}), 63) AS BIGINT) + 1))"
    return f"""projected AS (SELECT grid_id, r, c, CASE WHEN z >= -1000 THEN z END AS z FROM {{dem_primary}}),
      nodes AS (SELECT grid_id, mesh, r, c, west + (east - west) / (n - 1) * c AS lon, south + (north - south) / (n - 1) * r AS lat
        FROM (SELECT DISTINCT grid_id FROM projected), (VALUES {boxes}) b(mesh, west, east, south, north, n), range(64) y(r), range(64) x(c) WHERE r < n AND c < n),
      metres AS (SELECT grid_id, mesh, r, c, ({_E} - 300050) / 100 AS x, ({_N} - 5000050) / 100 AS y FROM nodes),
      widths AS (SELECT grid_id, mesh, greatest((MAX(x) - MIN(x)) / (MAX(c) - MIN(c)), 1) AS wx, greatest((MAX(y) - MIN(y)) / (MAX(r) - MIN(r)), 1) AS wy FROM metres GROUP BY grid_id, mesh),
      inner_nodes AS (SELECT * FROM metres JOIN widths USING (grid_id, mesh) WHERE x BETWEEN -0.5 AND 63.5 AND y BETWEEN -0.5 AND 63.5),
      columns_of AS (SELECT *, {tap('x', 'wx')} AS cc FROM inner_nodes), taps AS (SELECT *, {tap('y', 'wy')} AS rr FROM columns_of),
      weighted AS (SELECT t.grid_id, t.mesh, t.r, t.c, {curve('((cc - x) / wx)')} * {curve('((rr - y) / wy)')} AS k, wx * wy AS whole, p.z FROM taps t JOIN projected p ON p.grid_id = t.grid_id AND p.r = rr AND p.c = cc),
      sums AS (SELECT grid_id, mesh, r, c, SUM(k * z) AS s, SUM(CASE WHEN z IS NOT NULL THEN k END) AS w, ANY_VALUE(whole) AS whole FROM weighted GROUP BY grid_id, mesh, r, c),
      warped AS (SELECT n.grid_id, n.mesh, n.r, n.c, CASE WHEN w >= 0.5 * whole THEN s / w END AS z FROM nodes n LEFT JOIN sums USING (grid_id, mesh, r, c))"""


WARP = f"SELECT place_id, ({_E} + 800000) / 30000 AS x, ({_N} - 4600000) / 30000 AS y FROM {{places}}"
SQL |= {
    "bake_layers": f"{BLURRED}, s AS (SELECT grid_id, r, c, {SLOPE} AS slope, CAST({CLASS} AS INT) AS slope_class FROM ({grad('blurred', 100.0)})), g AS (SELECT grid_id, r, c, {HILL} AS hill FROM ({grad('{dem_grid}', 100.0)})) SELECT grid_id, r - 8 AS r, c - 8 AS c, {q('hill', 5)} AS hill, {q('slope', 5)} AS slope, slope_class FROM g JOIN s USING (grid_id, r, c) WHERE r BETWEEN 8 AND 55 AND c BETWEEN 8 AND 55",
    "contour_segments": contour_lines(),
    "resize_bicubic": resize(40, 27, 2, BICUBIC),
    "resize_lanczos": resize(24, 96, 3, LANCZOS),
    "warp_projected": f"WITH a AS ({WARP}), i AS (SELECT * FROM a WHERE x BETWEEN 0 AND 63 AND y BETWEEN 0 AND 63), s AS (SELECT i.place_id, SUM(({cubic_case('y', 'o.k')}) * ({cubic_case('x', 'p.k')}) * g.z) AS s, SUM(({cubic_case('y', 'o.k')}) * ({cubic_case('x', 'p.k')})) AS w FROM i, range(-1, 3) o(k), range(-1, 3) p(k), {{dem_grid}} g WHERE g.grid_id = 0 AND g.r = least(greatest(CAST(floor(y) AS INT) + o.k, 0), 63) AND g.c = least(greatest(CAST(floor(x) AS INT) + p.k, 0), 63) GROUP BY i.place_id) SELECT a.place_id, CASE WHEN w >= 0.5 THEN {q('s / w', 4)} END AS z FROM a LEFT JOIN s USING (place_id)",
    "reproject_nodes": f"WITH {reprojected(MESHES)} SELECT grid_id, mesh, CAST(r AS INT) AS r, CAST(c AS INT) AS c, {q('z', 4)} AS z FROM warped",
    "projected_terrain": f"WITH {reprojected({'bake': BAKED})}, f AS (SELECT grid_id, r, c, COALESCE(MIN(z) OVER (PARTITION BY grid_id), 0) AS low, z FROM (SELECT grid_id, r, c, COALESCE(w.z, s.z) AS z FROM warped w LEFT JOIN (SELECT grid_id, r, c, COALESCE(z, MIN(z) OVER (PARTITION BY grid_id)) AS z FROM (SELECT grid_id, r, c, CASE WHEN z >= -1000 THEN z END AS z FROM {{dem_secondary}})) s USING (grid_id, r, c))), filled AS (SELECT grid_id, r, c, COALESCE(z, low) AS z FROM f), {BLURRED[5:].replace('{dem_grid}', 'filled')} SELECT grid_id, CAST(r AS INT) AS r, CAST(c AS INT) AS c, {q('z', 5)} AS z FROM blurred",
    "shader_colours": f"SELECT grid_id, py, px, {shader('red', 1.05, 0.66)} AS red, {shader('green', 1.0, 0.92)} AS green, {shader('blue', 0.88, 0.58)} AS blue FROM (SELECT grid_id, py, px, red / 255::DOUBLE AS red, green / 255::DOUBLE AS green, blue / 255::DOUBLE AS blue, (px * 3 + py * 5) % 256 / 255::DOUBLE AS relief, px * 7 % 256 / 255::DOUBLE AS fr, (py * 11 + 90) % 256 / 255::DOUBLE AS fg, (px + py) % 256 / 255::DOUBLE AS fb FROM {{pixels}})",
    "layer_lookup": "SELECT page_id, COALESCE((SELECT label FROM (VALUES ('ultra', 'Topo'), ('high', 'Slope'), ('fast', 'Forest')) t(id, label) WHERE id = quality), 'Topo') AS label FROM {uploads}",
    "newest_first": "SELECT a.job_id, a.seq, CAST(COUNT(*) AS INT) AS place FROM {job_events} a JOIN {job_events} b ON b.job_id = a.job_id AND b.kind = 'finish' AND b.seq >= a.seq WHERE a.kind = 'finish' GROUP BY a.job_id, a.seq",
    "coordinate_labels": f"SELECT track_id, printf('%.2f, %.2f', {q('(la_lo + la_hi) / 2', 6)}, {q('(lo_lo + lo_hi) / 2', 6)}) AS centre, concat(CAST(CAST(floor({q('(lo_hi - lo_lo) * 100000', 3)} + 0.5::DOUBLE) AS BIGINT) AS VARCHAR), ', ', CAST(CAST(floor({q('(la_hi - la_lo) * -100000', 3)} + 0.5::DOUBLE) AS BIGINT) AS VARCHAR)) AS vector FROM ({bounds(0.0).replace('track_points', '{track_points}')})",
    "log_details": "SELECT job_id, line_no, left(trim(line), 160) AS detail FROM {log_lines} WHERE NOT regexp_matches(trim(line), '^progress:(\\d+)\\s+(.*)$') AND trim(line) <> ''",
    "gpx_errors": "SELECT track_id, CAST(len(regexp_extract_all(text, '<ele>')) AS INT) AS n, CASE WHEN len(regexp_extract_all(text, '<ele>')) < 2 THEN 'fewer than two points' ELSE '' END AS error FROM {gpx_docs}",
}


def document(**parts: str) -> str:
    return "CAST(to_json({" + ", ".join(f"'{k}': {v}" for k, v in parts.items()) + "}) AS VARCHAR)"


_SUMMARY = SQL["route_summary"].replace("{track_points}", "track_points")
_XYZ = {"x": f"radians(lon - lo_lo) * cos(radians(lat0)) * {R}", "y": f"radians(lat - la_lo) * {R}", "z": "ele", "d": "d"}
_POINT = ", ".join(f"'{k}': {q(x, 2)}" for k, x in _XYZ.items()) + f", 'lat': {q('lat', 7)}, 'lon': {q('lon', 7)}"
_SHOWN = f"SELECT * FROM ({distance(f'(SELECT track_id, seq, lat, lon, ele FROM ({simplified(distance("{track_points}"), 100)}))')}) JOIN ({bounds()}) USING (track_id)"
_BORDER_AT = f"SELECT line_id, run, vseq, 0 AS grid_id, (lon - 6.97::DOUBLE) / {f(7.03 - 6.97)} * 63 AS x, (lat - 44.97::DOUBLE) / {f(45.03 - 44.97)} * 63 AS y FROM runs"
_LAYERS = "{" + ", ".join(f"'{k}': 'terrain-{k}.png'" for k in ("hillshade", "multishade", "slope", "hypso", "normal")) + ", 'forest': NULL}"
#: Rows of the tables that each step of a bake writes.
_WRITTEN = (
    "SELECT COUNT(DISTINCT track_id) FROM {track_points}", "SELECT COUNT(*) FROM {dem_primary}", f"SELECT SUM(display_points) + (SELECT COUNT(*) FROM {{dem_primary}}) FROM ({_SUMMARY})",
    "SELECT COUNT(*) FROM {pixels}", "SELECT COUNT(*) FROM {dem_primary}", "SELECT COUNT(*) FROM {canopy}", "SELECT COUNT(DISTINCT track_id) FROM {track_points}",
)


def camera(*places: str) -> str:
    return "[" + ", ".join(q(x, 2) for x in places) + "]"


SQL |= {
    "route_json": f"WITH pts AS (SELECT track_id, list({{{_POINT}}} ORDER BY seq) AS pts FROM ({_SHOWN}) GROUP BY track_id) SELECT track_id, "
    + document(id="CAST(track_id AS VARCHAR)", distanceKm="km", elevationGainM="gain", minElevationM="min_e", maxElevationM="max_e", pointCount="points", displayPointCount="len(pts)", points="pts")
    + f" AS json FROM pts JOIN ({_SUMMARY}) USING (track_id)",
    "terrain_json": f"WITH g AS (SELECT grid_id, list({q('z', 3)} ORDER BY r, c) AS h FROM {{dem_grid}} GROUP BY grid_id) SELECT grid_id, "
    + document(gridSize="64", widthM="6300::DOUBLE", depthM="6300::DOUBLE", minHeightM="list_min(h)", maxHeightM="list_max(h)", heights="h")
    + " AS json FROM g",
    "manifest_json": f"WITH b AS (SELECT track_id, radians(lo_hi - lo_lo) * cos(radians(lat0)) * {R} AS w, radians(la_hi - la_lo) * {R} AS d FROM ({bounds().replace('track_points', '{track_points}')})), p AS (SELECT *, CAST(track_id AS VARCHAR) AS id FROM b JOIN ({_SUMMARY}) USING (track_id)) SELECT id, "
    + document(
        id="id", title="concat('Track ', id)", terrain=f"{{'path': 'terrain.json', 'width': {q('w', 2)}, 'depth': {q('d', 2)}, 'low': min_e, 'high': max_e}}", layers=_LAYERS,
        routes="[{'id': id, 'path': 'route.json', 'distanceKm': km, 'elevationGainM': gain, 'pointCount': points}]", overlays="{'border': NULL}",
        defaultCamera=f"{{'position': {camera('w * 0.55::DOUBLE', 'd * -0.7::DOUBLE', '(max_e - min_e) * 2.2::DOUBLE')}, 'target': {camera('w * 0.52::DOUBLE', 'd * 0.52::DOUBLE', '(min_e + max_e) / 2')}, 'fov': 42}}",
    )
    + " AS json FROM p",
    "border_json": f"WITH {ISLANDS.replace('border_vertices', '{border_vertices}')}, zs AS ({sample(_BORDER_AT, 'line_id, run, vseq', '{dem_grid}')}), l AS (SELECT line_id, run, list([{q('(lon - 6.97::DOUBLE) * 78000', 2)}, {q('(lat - 44.97::DOUBLE) * 111000', 2)}, {q('z', 2)}] ORDER BY vseq) AS p FROM runs JOIN zs USING (line_id, run, vseq) GROUP BY line_id, run), m AS (SELECT line_id, list(p ORDER BY run) AS lines FROM l GROUP BY line_id) SELECT line_id, "
    + document(id="CAST(line_id AS VARCHAR)", name="'border'", color="'#b54a3c'", lines="lines")
    + " AS json FROM m",
    "grid_cache_cells": f"SELECT grid_id, r, c, {q('z', 3)} AS z FROM (SELECT grid_id, r, c, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM {{dem_grid}}) WHERE grid_id <> 2",
    "raw_raster_cells": f"SELECT grid_id, r, c, {q('z', 3)} AS z FROM (SELECT grid_id, r, c, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM {{dem_grid}})",
    "geotiff_cells": f"SELECT grid_id, r, c, 300050::DOUBLE + c * 100 AS x, 5000050::DOUBLE + r * 100 AS y, CASE WHEN z >= -1000 THEN {q('z', 3)} END AS z FROM (SELECT grid_id, r, c, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z FROM {{dem_primary}})",
    "tree_cover_cells": f"SELECT grid_id, r, c, {q('CASE WHEN tcd > 100 THEN 0::DOUBLE ELSE least(greatest((tcd - 50) / 50::DOUBLE, 0), 1) END', 6)} AS density FROM {{canopy}}",
    "bake_progress": "SELECT pct, label, CAST(n AS BIGINT) AS rows FROM (VALUES "
    + ", ".join(f"({pct}, '{label}', ({rows}))" for (pct, label), rows in zip(STAGES[1:], _WRITTEN, strict=True))
    + ") t(pct, label, n)",
    "hillshade_png": f"SELECT grid_id, 63 - r AS r, c, {u8(f'{HILL} * 255')} AS v FROM ({STEEP.replace('dem_grid', '{dem_grid}')})",
    "normal_png": SQL["normal_map"],
}


def _views(sql: str) -> str:
    # struct literals of DuckDB also use braces; only names of views are replaced
    return with_views(sql)


ORACLES = {name: _views(sql) for name, sql in SQL.items()}
