"""Document fingerprints by a randomised edit embedding.

A pointer walks over the characters of a text: at every step it writes down the character it stands on, and a random
bit, shared by all texts and fixed by the step and the character, says whether it moves on. Two texts a few edits
apart soon walk in step again, so their edit distance becomes a Hamming distance of what is written. A fingerprint
samples that at steps shared by all texts, as many in every doubling of the length. Bands of samples
find candidates, and their fingerprints are compared.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, stored, table
from .graph import Forest, components

SEED = 17
#: Characters share the random bits of a class; the bits of a class repeat after PERIOD steps.
CLASSES, PERIOD = 64, 1 << 16
#: Samples of a stretch of steps; the k-th stretch has SAMPLES * 2**k steps. A sample is one of 64 symbols, or END past the end.
SAMPLES, END = 64, "."
SYMBOLS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", np.uint8)
#: Parts of the order of documents for each shuffle partition.
SLOTS = 4
#: Likeness of near copies, and the share of them that bands miss, if their edits are spread evenly.
SIMILAR, MISSED = 0.8, 0.005
#: A text is found by its last STRETCHES stretches. Two unlike texts agree in a sample with a probability of up to CHANCE.
STRETCHES, CHANCE = 3, 0.1
#: Fingerprints of a group that are compared in one task; larger groups are cut into blocks.
BLOCK = 1024
#: Number of texts that the bands counted for a text and its edited one are made for.
BANDED = 1 << 20
_U = np.uint64
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, bands_edited int, bands_next int"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("bands_edited", pa.int32()), ("bands_next", pa.int32())])


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Class and symbol of every code point."""
    mixed = mix64(np.arange(0x110000, dtype=_U) + _U(SEED << 32))
    return (mixed % _U(CLASSES)).astype(np.uint8), SYMBOLS[(mixed >> _U(58)).astype(np.int64)]


@functools.cache
def _moves() -> list[bytes]:
    """For each class and step (modulo PERIOD): steps until the pointer has moved on."""
    moves = np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    at = np.where(np.tile(moves, 2) > 0, np.arange(2 * PERIOD), 4 * PERIOD)
    following = np.minimum.accumulate(at[:, ::-1], 1)[:, ::-1][:, :PERIOD]
    return [row.tobytes() for row in (following - np.arange(PERIOD) + 1).astype(np.uint8)]


def walk(points: np.ndarray, step: int = 0) -> np.ndarray:
    """The step at which the pointer leaves each character (code points), starting at `step`."""
    moves, wrap = _moves(), PERIOD - 1
    return np.array([step := step + own[step & wrap] for own in map(moves.__getitem__, _characters()[0][points].tobytes())], np.int64)


@functools.cache
def _steps(stretch: int) -> np.ndarray:
    """Sampled steps of a stretch, one in each of SAMPLES equal pieces."""
    piece = 1 << stretch
    inside = mix64(np.arange(SAMPLES, dtype=_U) + _U((SEED << 40) + (stretch << 20))) % _U(piece)
    return SAMPLES * (piece - 1) + np.arange(SAMPLES) * piece + inside.astype(np.int64)


def sampled(points: np.ndarray, left: np.ndarray) -> str:
    """The fingerprint of a walk: SAMPLES symbols for every stretch that it enters; the empty text has none."""
    if not len(points):
        return ""
    stretches = int(-(-int(left[-1]) // SAMPLES)).bit_length()
    steps = np.concatenate([_steps(k) for k in range(stretches)])
    at = np.searchsorted(left, steps, "right")
    out = np.full(len(steps), ord(END), np.uint8)
    inside = at < len(points)
    out[inside] = _characters()[1][points[at[inside]]]
    return out.tobytes().decode("ascii")


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), "<u4")


def fingerprint(text: str | None) -> str:
    """The fingerprint of a text; null and empty texts have the empty one. Equal texts have equal ones."""
    points = code_points(text)
    return sampled(points, walk(points))


def likeness(a: str, b: str) -> float:
    """Share of steps at which both walks have written the same, of the steps of the longer one, estimated from
    the samples: 1 for equal fingerprints, 0 for an empty and a full one."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(n, END).encode("ascii"), np.uint8) for s in (a, b))
    weight = np.repeat(2.0 ** np.arange(n // SAMPLES), SAMPLES)
    held = weight[(x != ord(END)) | (y != ord(END))].sum()
    return float(weight[(x == y) & (x != ord(END))].sum() / held)


def _missed(width: int, bands: int, similar: float) -> float:
    """Share of stretches with no equal band, if each sample agrees with a probability of `similar`."""
    agree = np.array([math.comb(SAMPLES, a) * similar**a * (1 - similar) ** (SAMPLES - a) for a in range(SAMPLES + 1)])
    equal = np.array([math.comb(a, width) / math.comb(SAMPLES, width) for a in range(SAMPLES + 1)])
    return float((agree * (1 - equal) ** bands).sum())


@functools.cache
def band_plan(n: int, similar: float = SIMILAR) -> tuple[int, int]:
    """Samples of a band, and bands of a stretch, for n fingerprints: so wide that a text meets 0.01 others by chance,
    and so many that two full stretches miss no more than MISSED of the pairs at the likeness."""
    width = 4
    while True:
        bands = 4
        while _missed(width, bands, similar) > MISSED**0.5:
            bands += 1 + bands // 8
        if n * bands * STRETCHES * CHANCE**width < 0.01 or width == SAMPLES // 4:
            return width, bands
        width += 1


@functools.cache
def _places(stretch: int, width: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of each band of a stretch, and odd weights for a hash of them."""
    rng = np.random.default_rng([SEED, stretch, width])
    return np.argsort(rng.random((bands, SAMPLES)), 1)[:, :width], rng.integers(1, 1 << 62, (bands, width)).astype(_U) * _U(2) + _U(1)


def band_keys(fp: str, width: int, bands: int) -> np.ndarray:
    """Hashes of the bands of a fingerprint, each of another stretch and other samples. Bands past the end are left out; a
    text of one stretch also has those with half of their samples before the end."""
    symbols = np.frombuffer(fp.encode("ascii"), np.uint8).reshape(-1, SAMPLES)
    out = []
    for k in range(max(0, len(symbols) - STRETCHES), len(symbols)):
        at, weights = _places(k, width, bands)
        own = symbols[k][at]
        full = (own != ord(END)).sum(1) >= (width if len(symbols) > 1 else (width + 1) // 2)
        out.append(mix64((own[full].astype(_U) * weights[full]).sum(1, dtype=_U) + _U(k << 40) + np.flatnonzero(full).astype(_U)))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _compared(batches, similar: float) -> Iterator[pa.RecordBatch]:
    """Rows (component, lo, hi, own, id, fingerprint) in order to edges: a row of the part lo against the rows before it, in another part if lo < hi."""
    forest, key, rows = Forest(), None, []

    def links():
        for i, (own, doc_id, fp) in enumerate(rows):
            for other_own, other_id, other in rows[:i]:
                if (key[1] == key[2] or own != other_own) and likeness(fp, other) >= similar:
                    forest.add(np.array([doc_id]), np.array([other_id]))

    for b in batches:
        for *at, own, doc_id, fp in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != key:
                links()
                key, rows = at, []
            rows.append((own, doc_id, fp))
    links()
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest.edges()], ["a", "b"])


def near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, fingerprint, component_id (least doc_id reachable by links) of every row of `docs`.

    Texts are linked if their fingerprints have a likeness of `similar` or more; of those, bands find all but a share of
    MISSED (0.995 of pairs at 0.8 with even edits). Equal fingerprints are one, the empty one of null and empty texts too. Bands only
    bring texts into groups: what bands connect is compared in blocks, so that no task holds a large group, and
    a task gives one edge a text. Null ids are never the least; fingerprints that only such rows have are components
    without id. An empty table gives no rows.
    """

    def made(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t) for t in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    fps = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id long, fingerprint string"), "edit-fingerprints")
    distinct = stored(fps.groupBy("fingerprint").agg(F.min("doc_id").alias("id")).where("id is not null"), "edit-distinct")
    width, bands = band_plan(1 << distinct.count().bit_length(), similar)

    def keys(batches):
        for b in batches:
            held = [band_keys(fp, width, bands) for fp in b.column(1).to_pylist()]
            ids = np.repeat(b.column(0).to_numpy(), [len(k) for k in held])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held) if held else []).cast(pa.int64()), pa.array(ids)], ["key", "id"])

    posts = distinct.select("id", "fingerprint").mapInArrow(keys, "key long, id long")
    shared = posts.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    groups = components(posts.join(shared, "key").select(F.col("least").alias("a"), F.col("id").alias("b")))
    met = distinct.join(groups, F.col("id") == F.col("node")).select("component", "id", "fingerprint")
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    met = met.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "fingerprint")
    edges = met.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(lambda b: _compared(b, similar), "a long, b long")
    labels = components(edges)
    found = distinct.join(labels, F.col("id") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "id").alias("component_id"))
    return fps.join(found, "fingerprint", "left").select("doc_id", "fingerprint", "component_id")


def _range_of(n: Column) -> Column:
    """Which of n equal ranges of 64-bit numbers holds the key: grows with the key."""
    return F.shiftright((F.shiftright("key", 32) + (1 << 31)) * n, 32)


def _in_order(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (part, sub, guest, last, down, key, id, text), and the first row of each slot as a guest at the end of the slot before.

    The order is that of descending doc_id, nulls last, then of the hash of the text. Slots are ranges of it, from
    quantiles of doc_id; an id that fills several slots is dealt by the hash. The driver gets a row for each
    slot: their number is set by the shuffle partitions.
    """
    slots = SLOTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n, ids = rows.agg(F.count("*"), F.count("id")).first()
    bounds = rows.approxQuantile("id", [k / slots for k in range(1, slots)], 0.25 / slots) if ids else []
    times = {int(v): bounds.count(v) for v in set(bounds)}
    splits = [-float("inf"), *sorted(set(bounds)), float("inf")]
    nulls = max(1, (n - ids) * slots // max(1, n))
    rows = rows.withColumns({"number": F.coalesce(F.col("id").cast("double"), F.lit(float("nan"))), "key": F.xxhash64("text")})
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="number", outputCol="bucket", handleInvalid="keep").transform(rows)
        hot = {len(splits) - 1 - k: v for k, v in enumerate(splits[1:-1], 1) if times[int(v)] > 1}
    else:
        rows, hot = rows.withColumn("bucket", F.lit(0.0)), {}
    part = F.when(F.col("id").isNull(), len(splits)).otherwise(F.lit(len(splits) - 1) - F.col("bucket").cast("int"))
    rows = rows.withColumns({"part": part, "last": F.col("id").isNull(), "down": F.coalesce(F.bitwise_not("id"), F.lit(0))})
    sub = F.when(F.col("last"), _range_of(F.lit(nulls)))
    if hot:
        own = F.create_map(*[F.lit(x) for p, v in hot.items() for x in (p, int(v))])[F.col("part")]
        many = F.create_map(*[F.lit(x) for p, v in hot.items() for x in (p, times[int(v)])])[F.col("part")]
        sub = sub.when(F.col("id") == own, _range_of(many)).when(F.col("id") < own, many)
    rows = rows.withColumn("sub", F.coalesce(sub.cast("long"), F.lit(0))).select("part", "sub", F.lit(False).alias("guest"), "last", "down", "key", "id", "text")
    firsts = rows.groupBy("part", "sub").agg(F.min(F.struct("last", "down", "key")).alias("first")).orderBy("part", "sub").collect()
    if not firsts:
        return rows, None
    heads = [(*before[:2], *own[:2], *own.first) for before, own in zip([firsts[-1], *firsts[:-1]], firsts, strict=True)]
    sent = docs.sparkSession.createDataFrame(heads, "to_part int, to_sub long, part int, sub long, last boolean, down long, key long")
    guests = rows.join(F.broadcast(sent), ["part", "sub", "last", "down", "key"]).groupBy("to_part", "to_sub").agg(F.min("text").alias("text"))
    return rows, guests.select(F.col("to_part").alias("part"), F.col("to_sub").alias("sub"), F.lit(True).alias("guest"), F.lit(False).alias("last"), F.lit(0).cast("long").alias("down"), F.lit(0).cast("long").alias("key"), F.lit(None).cast("long").alias("id"), "text")


def edited(batches) -> Iterator[pa.RecordBatch]:
    """Rows (guest, id, text) in order to results: each row with the row behind it. Guests give none."""
    held, plan = None, band_plan(BANDED)
    for b in batches:
        out = []
        for guest, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            points = code_points(text)
            left = walk(points)
            own = sampled(points, left)
            keys = set(band_keys(own, *plan).tolist())
            if held is not None:
                before_id, before, before_points, before_left, before_own, before_keys = held
                n = len(before_points)
                cut = n - n // 3
                added = points[: n - cut]
                changed = before[:cut] + text[: n - cut]
                rest = walk(added, int(before_left[cut - 1]) if cut else 0)
                other = sampled(np.concatenate((before_points[:cut], added)), np.concatenate((before_left[:cut], rest)))
                out.append((before_id, n, hashlib.sha256(changed.encode()).hexdigest(), before_own, other, likeness(before_own, other), likeness(before_own, own), len(before_keys.intersection(band_keys(other, *plan).tolist())), len(before_keys & keys)))
            held = None if guest else (doc_id, text, points, left, own, keys)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), SCHEMA.types, strict=True)], SCHEMA.names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, bands_edited, bands_next of
    every row of `docs`; the last two count the bands (for BANDED texts) in which near_copies would meet both.

    The edited text has its last third replaced by the beginning of the next text in descending doc_id (after the
    last one: the first). Null texts are empty. Rows with a null doc_id come last; rows that share a doc_id come in the
    order of a hash of their texts, then of the texts, so repeated rows are each other's next. Texts are shuffled once
    and streamed through their slot in order; one text and the one before it are held, of any length. A
    table of one row is its own next; an empty table gives no rows.
    """
    rows, guests = _in_order(docs)
    rows = rows if guests is None else rows.union(guests)
    dealt = rows.repartition("part", "sub").sortWithinPartitions("part", "sub", "guest", "last", "down", "key", "text")
    return dealt.select("guest", "id", "text").mapInArrow(edited, RESULT)


def op11_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, see `fingerprints`."""
    return fingerprints(table(spark, sf_dir, "documents"))
