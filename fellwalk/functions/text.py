"""String Column functions of the import layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(x: Column, default: str = "imported-route") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def title(stem: Column, default: str = "Imported route") -> Column:
    s = F.trim(F.regexp_replace(stem, "[_-]+", " "))
    return F.coalesce(F.nullif(F.initcap(s), F.lit("")), F.lit(default))


def stem(filename: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filename, "^.*/", ""), r"(.)\.[^.]*$", "$1")


def quality(x: Column) -> Column:
    return F.when(x.isin("fast", "ultra"), x).otherwise("high")


def job_id(text: Column, quality_: Column, salt: str = "import-v1") -> Column:
    """Content hash: the same upload at the same quality is the same job."""
    return F.substring(F.sha2(F.concat(text, quality_, F.lit(salt)), 256), 1, 16)


def minutes_label(minutes: Column) -> Column:
    hours, rest = F.floor(minutes / 60), F.floor(minutes - F.floor(minutes / 60) * 60 + 0.5)
    return F.when(hours > 0, F.format_string("%dh %02d", hours, rest)).otherwise(F.format_string("%d min", rest))


def redacted(url: Column) -> Column:
    return F.regexp_replace(url, r"\?.*$", "?...")


def trace_endpoint(base: Column) -> Column:
    s = F.regexp_replace(base, "/+$", "")
    return F.when(s.endswith("/v1/traces"), s).otherwise(F.concat(s, F.lit("/v1/traces")))


def share_url(base: Column, **params: Column) -> Column:
    """Address with its query; nulls are empty values."""
    return F.concat(base, F.lit("?"), F.concat_ws("&", *(F.concat(F.lit(f"{k}="), F.url_encode(F.coalesce(v, F.lit("")))) for k, v in params.items())))


ERROR_LINE = r"^\w[\w.]*(Error|Exception|Warning):"
PROGRESS_LINE = r"^progress:(\d+)\s+(.*)$"


def fixed(v: Column | str, digits: int) -> Column:
    """A number with `digits` digits after the point, as C prints it: rounded by its exact binary value, halves to even. (The JVM
    rounds the shortest decimal that names the number, halves up: 0.125 is 0.13 there.)"""
    k = 2.0 * 10**digits
    cut = lambda x: x * 134217729.0 - (x * 134217729.0 - x)  # noqa: E731  (upper half of the bits)
    v = F.col(v) if isinstance(v, str) else v
    x = F.abs(v)
    k_high = 134217729.0 * k - (134217729.0 * k - k)
    high, p = cut(x), x * k
    low, k_low = x - high, k - k_high
    rest = ((high * k_high - p) + high * k_low + low * k_high) + low * k_low  # x * k is p + rest, exactly
    down = F.floor(x * float(10**digits))
    down = down - F.when(p + rest < down * 2, 1).otherwise(0)  # the product may have been rounded up
    over = (p - (down * 2 + 1).cast("double")) + rest
    n = down + F.when((over > 0) | ((over == 0) & (down % 2 == 1)), 1).otherwise(0)
    unit = 10**digits
    whole = F.floor(n / unit) if digits else n
    text = whole.cast("string") if not digits else F.concat(whole.cast("string"), F.lit("."), F.lpad((n - whole * unit).cast("string"), digits, "0"))
    return F.when(x * unit < float(1 << 50), F.concat(F.when(v < 0, "-").otherwise(""), text)).otherwise(F.format_string(f"%.{digits}f", v))


def coordinate_label(*values: Column | str, digits: int = 4) -> Column:
    """Numbers with a fixed count of digits, joined by a comma: "45.0012, 7.0310"."""
    return F.concat_ws(", ", *(fixed(v, digits) for v in values))


def vector_label(*values: Column) -> Column:
    """Numbers rounded to integers, halves up, joined by a comma."""
    return F.concat_ws(", ", *(F.floor(v + 0.5).cast("string") for v in values))
