"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame operations only.

Van der Corput points are mapped through the cumulative targets, so that every stretch of the schedule
holds the sources in their shares. The k-th slot of a source takes the k-th block of its documents,
laid end to end in shuffled order; a source that owes more than it has starts over (up to three times).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table, whole_rows

#: Weights by rank of the source, and how often a source may be taken.
WEIGHTS, MOST = 3, 3
#: The schedule has 2**bits slots: this many at least, and more as soon as a slot would pass SLOT_WORDS.
LEAST_BITS, SLOT_WORDS = 14, 1 << 16
#: Hex digits of the shuffle key that cut a source into buckets; slots ranked together.
DIGITS, SLOTS_TOGETHER = 3, 1 << 10


def bit_reverse(x: Column, bits: int) -> Column:
    """Reverses the lowest `bits` (32 at most) bits of a non-negative long."""
    for shift, mask in ((1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF)):
        x = F.shiftleft(x.bitwiseAND(mask), shift).bitwiseOR(F.shiftright(x, shift).bitwiseAND(mask))
    return F.shiftright(x, 32 - bits)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and shuffle key of every row; written once, as it is read thrice."""
    doc_id = F.col("doc_id").cast("long")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return stored(docs.select(doc_id.alias("doc_id"), "source", words.alias("size"), F.coalesce(F.md5(doc_id.cast("string").cast("binary")), F.lit("")).alias("key")), "mix-sizes")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_id, source_size, weight, target, take (whole words), total: one row per source.

    Water filling in closed form: sources in order of cap by weight; up to some place all stop at their
    caps, and the rest share what is left by weight. The windows span the sources, not the documents: one row
    for each different source goes through one task, which suits sources by the million, not one a document.
    """
    everything = Window.partitionBy()
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    s = s.withColumn("weight", F.pmod(F.col("source_id") - 1, F.lit(WEIGHTS)) + 1).withColumn("cap", MOST * F.col("source_size"))
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("ratio", F.col("cap").cast("double") / F.col("weight").cast("double"))
    order = Window.orderBy("ratio", "source_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("place", F.row_number().over(order))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    fits = F.col("left").cast("double") / F.col("left_weight").cast("double") <= F.col("ratio")
    s = s.withColumn("free", F.min(F.when(fits, F.struct("place", "left", "left_weight"))).over(everything))
    share = (F.col("weight") * F.col("free.left")).cast("double") / F.col("free.left_weight").cast("double")
    s = s.withColumn("target", F.when(F.col("place") < F.col("free.place"), F.col("cap").cast("double")).otherwise(share))
    return s.select("source", "source_id", "source_size", "weight", "target", F.least(F.floor("target"), F.col("cap")).alias("take"), "total")


def runs_of(goals: DataFrame, bits: int) -> DataFrame:
    """`goals` with lo, slots, block: the run of integers whose reversals are the source's slots in a schedule of
    2**bits slots, how many they are (0 if nothing is taken), and how many words each takes.

    Slot i holds the source whose share of the cumulative targets covers the van der Corput point of i.
    Points are the reversed bits of i, so a source's slots are the reversals of a run of integers. A source
    with a target below one slot gets one all the same, which it shares with its neighbour.
    """
    upto = F.sum("take").over(Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    all_ = F.greatest(F.sum("take").over(Window.partitionBy()), F.lit(1)).cast("double")
    cell = lambda x: F.floor(x.cast("double") / all_ * float(1 << bits))
    g = goals.withColumn("hi", cell(upto)).withColumn("lo", F.least(cell(upto - F.col("take")), F.lit((1 << bits) - 1)))
    g = g.withColumn("slots", F.when(F.col("take") > 0, F.greatest(F.col("hi") - F.col("lo"), F.lit(1))).otherwise(F.lit(0)))
    return g.drop("hi").withColumn("block", F.expr("if(slots > 0, (take + slots - 1) div slots, 0)"))


def schedule(runs: DataFrame, bits: int) -> DataFrame:
    """source_id, k, slot: the k-th slot of each source; every source makes its own."""
    g = runs.where("slots > 0").select("source_id", "lo", F.col("slots").alias("n"))
    runs = g.select("source_id", "lo", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SLOTS_TOGETHER}"))).alias("run")).repartition("source_id", "run")
    first = F.col("run") * SLOTS_TOGETHER
    cells = runs.select("source_id", "n", F.explode(F.sequence(F.col("lo") + first, F.col("lo") + F.least(F.col("n"), first + SLOTS_TOGETHER) - 1)).alias("cell"))
    slots = cells.select("source_id", "n", bit_reverse(F.col("cell"), bits).alias("slot")).withColumn("part", F.expr(f"slot div {SLOTS_TOGETHER}"))
    # ranks in two steps, so that no source is ranked in one task
    counted = slots.groupBy("source_id", "part").agg(F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("source_id").orderBy("part")) - F.col("held")
    ranked = slots.join(counted.select("source_id", "part", before.alias("before")), ["source_id", "part"])
    rank = F.row_number().over(Window.partitionBy("source_id", "part").orderBy("slot")) - 1
    return ranked.select("source_id", (F.col("before") + rank).alias("k"), "slot")


def laid_out(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Every document with its source's figures and its place `start` in the source's shuffled order.

    The running sum goes in two steps, over buckets of the shuffle key and inside each, so that a source
    with a third of all rows is not summed in one task. bucket and row tell rows of one doc_id apart.
    """
    d = sized.withColumn("bucket", F.substring("key", 1, DIGITS)).join(goals.withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    filled = d.groupBy("source_id", "bucket").agg(F.sum("size").alias("held"))
    filled = filled.select("source_id", "bucket", (F.sum("held").over(Window.partitionBy("source_id").orderBy("bucket")) - F.col("held")).alias("before"))
    inside = Window.partitionBy("source_id", "bucket").orderBy("key", "doc_id", "size")
    d = d.join(filled, ["source_id", "bucket"])
    d = d.withColumn("start", F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    return d.withColumn("row", F.row_number().over(inside)).drop("before", "key")


def mixture(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). pieces: slot, source_id, bucket, row, doc_id, lap, offset, length — words
    [offset, offset + length) of the document, in that lap of its source, belong to that slot of the mixed stream."""
    sized = sizes(docs)
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = min(31, max(LEAST_BITS, (max(1, total) // SLOT_WORDS).bit_length()))
    goals = stored(runs_of(targets(sized), bits), "mix-goals")
    slots = schedule(goals, bits)
    d = laid_out(sized, goals)
    lap = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(take - start - 1) div source_size"))).alias("lap")
    laps = d.where("size > 0 and take > start").select("source_id", "bucket", "row", "doc_id", "size", "start", "source_size", "take", "block", lap)
    laps = laps.withColumn("at", F.col("start") + F.col("lap") * F.col("source_size")).withColumn("stop", F.least(F.col("at") + F.col("size"), F.col("take")))
    parts = laps.select("*", F.explode(F.sequence(F.expr("at div block"), F.expr("(stop - 1) div block"))).alias("k")).join(slots, ["source_id", "k"])
    begin, end = F.greatest(F.col("at"), F.col("k") * F.col("block")), F.least(F.col("stop"), (F.col("k") + 1) * F.col("block"))
    return d, parts.select("slot", "source_id", "bucket", "row", "doc_id", "lap", (begin - F.col("at")).alias("offset"), (end - begin).alias("length"))


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, slot_1, slot_2, slot_3 of every row of `docs`.

    slot_m: the slot of the schedule at which the document's m-th lap begins (null: not taken that often).
    A null or empty text has size 0 and is taken 0 times; a null source is a source of its own, the last.
    Rows with the same doc_id are mixed as separate documents. An empty table gives no rows. The order
    that decides is by a hash of doc_id, so a rerun gives the same mix.
    """
    d, pieces = mixture(docs)
    key = ["source_id", "bucket", "row"]
    used = pieces.groupBy(*key).agg(F.sum("length").alias("words"), *[F.min(F.when(F.col("lap") == m, F.col("slot"))).alias(f"slot_{m + 1}") for m in range(MOST)])
    return d.join(used, key, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), *[f"slot_{m + 1}" for m in range(MOST)])


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus with the columns of `docs`: every document as often as the mix takes it, each copy at
    the slot at which its lap begins. Partitions are stretches of the schedule, sorted; copies of one slot come in the
    order of doc_id, source and a hash of the text.

    Only the one document of each source at which its last lap ends is taken in part; it is rounded to
    whole copies. Rows that share doc_id, source and size share their copies evenly, also rounded, and
    their slots. Documents without words (null, empty) are in no mix and go; null doc_ids and sources are
    values like others. Columns may have any names. An empty table gives an empty mix.
    """
    n = F.floor(F.sum("taken") / (F.count("*") * F.greatest("size", F.lit(1))) + F.lit(0.5)).cast("int")
    laps = [F.min(f"slot_{m + 1}") for m in range(MOST)]
    slots = F.array(*[F.coalesce(*reversed(laps[: m + 1])) for m in range(MOST)])
    t = taken(docs).groupBy("doc_id", "source", "size").agg(n.alias("copies"), slots.alias("slots")).where("copies > 0")
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    rows = docs.select(whole_rows(docs), F.col("doc_id").cast("long").alias("id"), F.col("source").alias("of"), words.alias("words"), F.xxhash64("text").alias("key"))
    joined = rows.join(t, F.col("id").eqNullSafe(t["doc_id"]) & F.col("of").eqNullSafe(t["source"]) & (F.col("words") == t["size"]))
    placed = joined.select("whole", "id", "of", "key", F.explode(F.slice("slots", F.lit(1), F.col("copies"))).alias("slot"))
    return placed.repartitionByRange("slot").sortWithinPartitions("slot", "id", "of", "key").select("whole.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taken() of all documents; a lap that does not begin has slot -1."""
    out = taken(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", *[F.coalesce(f"slot_{m + 1}", F.lit(-1)).cast("long").alias(f"slot_{m + 1}") for m in range(MOST)])


#: The same targets and schedule spelled out: cells, their reversed bits, ranks, whole laps and the words of the last one.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS source_id, (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap, CAST(SUM(source_size) OVER () AS BIGINT) AS total FROM s),
o AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM r),
p AS (SELECT *, ROW_NUMBER() OVER w AS place,
        CAST(total - COALESCE(SUM(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
        CAST(SUM(weight) OVER () - COALESCE(SUM(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest_weight
      FROM o WINDOW w AS (ORDER BY ratio, source NULLS LAST)),
f AS (SELECT place, rest, rest_weight FROM p WHERE CAST(rest AS DOUBLE) / CAST(rest_weight AS DOUBLE) <= ratio ORDER BY place LIMIT 1),
g AS (SELECT p.source, source_id, source_size, total, CASE WHEN p.place < f.place THEN CAST(cap AS DOUBLE) ELSE CAST(weight * f.rest AS DOUBLE) / CAST(f.rest_weight AS DOUBLE) END AS target FROM p, f),
t AS (SELECT *, LEAST(CAST(FLOOR(target) AS BIGINT), 3 * source_size) AS take, GREATEST(14, CASE WHEN total // 65536 > 0 THEN length(bin(total // 65536)) ELSE 0 END) AS bits FROM g),
b AS (SELECT *, CAST(FLOOR(CAST(SUM(take) OVER (ORDER BY source_id) - take AS DOUBLE) / SUM(take) OVER () * (1 << bits)) AS BIGINT) AS first_cell,
        CAST(FLOOR(CAST(SUM(take) OVER (ORDER BY source_id) AS DOUBLE) / SUM(take) OVER () * (1 << bits)) AS BIGINT) AS end_cell FROM t),
c AS (SELECT *, LEAST(first_cell, (1 << bits) - 1) AS lo, GREATEST(end_cell - LEAST(first_cell, (1 << bits) - 1), 1) AS slots FROM b WHERE take > 0),
e AS (SELECT source_id, CAST(list_sum(list_transform(range(CAST(bits AS BIGINT)), lambda i: ((cell >> CAST(i AS INTEGER)) & 1) << CAST(bits - 1 - i AS INTEGER))) AS BIGINT) AS slot
      FROM (SELECT source_id, bits, UNNEST(range(lo, lo + slots)) AS cell FROM c)),
k AS (SELECT source_id, slot, ROW_NUMBER() OVER (PARTITION BY source_id ORDER BY slot) - 1 AS k FROM e),
l AS (SELECT d.doc_id, d.size, t.source_id, t.source_size, t.target, t.take, c.slots, (t.take + c.slots - 1) // c.slots AS block,
        CAST(SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON c.source_id = t.source_id)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE (take // source_size) * size + LEAST(GREATEST(take % source_size - start, 0), size) END AS taken,
  COALESCE(k1.slot, -1) AS slot_1, COALESCE(k2.slot, -1) AS slot_2, COALESCE(k3.slot, -1) AS slot_3
FROM l
LEFT JOIN k k1 ON k1.source_id = l.source_id AND size > 0 AND start < take AND k1.k = start // block
LEFT JOIN k k2 ON k2.source_id = l.source_id AND size > 0 AND start + source_size < take AND k2.k = (start + source_size) // block
LEFT JOIN k k3 ON k3.source_id = l.source_id AND size > 0 AND start + 2 * source_size < take AND k3.k = (start + 2 * source_size) // block
"""
