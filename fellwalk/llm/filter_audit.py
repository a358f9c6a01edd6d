"""Filter interaction audit by a subset-zeta transform; DataFrame operations only.

Every document becomes a mask of the filters it fails. Masks are counted per part; a zeta transform over
the subsets of filters turns the counts into the survivors of every subset. A step of an order is then
the difference between the subsets before and after it, for all documents as for labelled ones.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table

#: Filters by letter; bit k of a mask is filter k.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PCT, MAX_CAPITAL_PCT, SYMBOLS = 200, 50, 2, "[#$%&*|]"
#: What is counted: all documents, those labelled good, those labelled toxic.
KINDS = ("all", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D, which look at one text. Null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def of(words: Column) -> Column:
        # F.transform evaluates the words once for both counts
        n, different = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
        few, same = (n < MIN_WORDS).cast("int"), (100 * different < MIN_DISTINCT_PCT * n).cast("int")
        return few + 2 * same

    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > MAX_CAPITAL_PCT * F.char_length(text).cast("long")
    return F.transform(F.array(words), of)[0] + 4 * capitals.cast("int") + 8 * text.rlike(SYMBOLS).cast("int")


def label_flags(labels: DataFrame) -> DataFrame:
    """label_id, good, toxic (0 or 1): a document is good, or toxic, if any of its label rows says so."""
    rows = labels.where("doc_id is not null and (quality = 1 or toxic = 1)")
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    return rows.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (5 bits), good, toxic, n: documents by what they fail.

    Texts travel as 32-byte digests. Repeated rows are one row with a count before anything is shuffled twice, and
    the rows of one text are counted by part and label before they meet, so a text that is a third of
    the table brings a few rows a task to its group.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = rows.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    # null ids have no label: they go round the join, where they would be one key
    known = rows.where("id is not null").join(label_flags(labels), F.col("id") == F.col("label_id"), "left")
    known = known.select("id", "part", "mask", "digest", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    unknown = rows.where("id is null").select("id", "part", "mask", "digest", "n", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    same = known.union(unknown).groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), F.min(F.struct("id", "n")).alias("least"))
    # of a group, only the rows with the least id of the whole text, and rows without an id, pass the filter E
    least = F.min("first").over(Window.partitionBy("digest"))
    first = F.when(F.col("first") == least, F.col("least_n")).otherwise(0)
    same = same.withColumn("least_n", F.coalesce(F.col("least.n"), F.lit(0))).withColumn("passing", first + F.col("no_id"))
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    split = same.select("part", "good", "toxic", both.alias("x")).select("part", F.col("x.mask").alias("mask"), "good", "toxic", F.col("x.n").alias("n"))
    return split.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def zeta(df: DataFrame, columns: tuple[str, ...], bits: int) -> DataFrame:
    """Turns arrays over masks into their sums over all submasks, one bit after the other."""

    def added(c: str, bit: int) -> Column:
        return F.transform(c, lambda x, m: x + F.when(m.bitwiseAND(bit) > 0, F.get(F.col(c), m.bitwiseXOR(bit))).otherwise(0))

    for b in range(bits):
        df = df.withColumns({c: added(c, 1 << b) for c in columns})
    return df


def survivors(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, and for each kind an array over subsets of filters (by mask): the documents that none of the subset removes.

    A document survives a subset if its mask lies in the complement, so survivors are the zeta transform of
    the mask counts, read backwards.
    """
    own = {"all": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    masks = counts.groupBy("part", "mask").agg(*[F.sum(own[k]).alias(k) for k in KINDS])
    held = masks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*KINDS)))).alias("held"))  # a mask is one entry
    every = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))

    def laid_out(kind: str) -> Column:
        return F.transform(every, lambda m: F.coalesce(F.try_element_at("held", m)[kind], F.lit(0))).alias(kind)

    wide = held.select("part", *[laid_out(k) for k in KINDS])
    return zeta(wide, KINDS, len(filters)).select("part", *[F.reverse(k).alias(k) for k in KINDS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (source; null: empty string), order of the filters and step.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley, as the
    query's contract has them. Null texts are empty texts. A document repeats another if that has a
    smaller doc_id and the same text; rows that share doc_id and text do not repeat each other, and rows with a null
    doc_id neither repeat nor are repeated, and have no label. Conflicting labels of a document count as both. Texts of any
    length are read whole. Other columns of the tables are not looked at. An empty table gives no rows.
    """
    full, size = (1 << len(FILTERS)) - 1, len(FILTERS)
    at = lambda kind, mask: F.get(F.col(kind), mask)
    lost = lambda kind, before, own: at(kind, before) - at(kind, before + own)

    def share(f: int) -> Column:
        """What filter f removes, over all orders: each subset before it counts as often as orders begin with it."""
        times = [factorial(m.bit_count()) * factorial(size - 1 - m.bit_count()) if not m >> f & 1 else 0 for m in range(full + 1)]
        times = [t or -times[m - (1 << f)] for m, t in enumerate(times)]
        return F.aggregate(F.zip_with("all", F.lit(times), lambda x, w: x * w), F.lit(0).cast("long"), lambda a, x: a + x)

    def masked(letters: Column) -> Column:
        return F.lit(0) + sum(F.contains(letters, F.lit(f)).cast("int") * (1 << k) for k, f in enumerate(FILTERS))

    orders = ["".join(o) for o in permutations(FILTERS)]
    rows = survivors(mask_counts(docs, labels)).withColumn("shares", F.array(*[share(f) for f in range(size)]))
    rows = rows.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.lit(list(range(1, size + 1)))))
    letter = F.substr("filter_order", F.col("step"), F.lit(1))
    rows = rows.withColumns({"letter": letter, "own": masked(letter), "before": masked(F.substr("filter_order", F.lit(1), F.col("step") - 1))})
    own, before = F.col("own"), F.col("before")
    removed = lost("all", before, own)
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("all", before + own).alias("kept"),
        removed.alias("removed"),
        (lost("all", F.lit(0), own) - removed).alias("redundant"),
        lost("all", full - own, own).alias("unique_fails"),
        lost("good", before, own).alias("good_lost"),
        lost("toxic", before, own).alias("toxic_lost"),
        F.get("shares", F.instr(F.lit(FILTERS), F.col("letter")) - 1).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of five filters over all documents: 600 rows for each source, see `audit`."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every document through every order: no subset sums.
OP12_SQL = r"""
WITH t AS (SELECT doc_id, COALESCE(source, '') AS part, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, MAX(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, MAX(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT t.part, COALESCE(good, 0) AS good, COALESCE(toxic, 0) AS toxic,
    MAP {'A': len(words) < 200, 'B': 100 * list_unique(words) < 50 * len(words), 'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
      'D': regexp_matches(text, '[#$%&*|]'), 'E': COALESCE(MIN(t.doc_id) OVER (PARTITION BY text) < t.doc_id, FALSE)} AS fails
  FROM t LEFT JOIN l USING (doc_id)),
b AS (SELECT part, good, toxic, fails, COUNT(*) AS n FROM f GROUP BY ALL),
x AS (SELECT UNNEST(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT [p.c, q.c, r.c, s.c, v.c] AS o FROM x AS p, x AS q, x AS r, x AS s, x AS v WHERE len(list_distinct([p.c, q.c, r.c, s.c, v.c])) = 5),
z AS (SELECT o, step, o[step] AS own FROM o, (SELECT UNNEST([1, 2, 3, 4, 5]) AS step)),
w AS (
  SELECT part, array_to_string(o, '') AS filter_order, step, own, n, good, toxic, fails[own] AS fail,
    len(list_filter(o[:step - 1], lambda c: fails[c])) AS earlier, len(list_filter(o, lambda c: fails[c])) AS every
  FROM b, z),
g AS (
  SELECT part, filter_order, step, own,
    SUM(CASE WHEN NOT fail AND earlier = 0 THEN n ELSE 0 END) AS kept, SUM(CASE WHEN fail AND earlier = 0 THEN n ELSE 0 END) AS removed,
    SUM(CASE WHEN fail AND earlier > 0 THEN n ELSE 0 END) AS redundant, SUM(CASE WHEN fail AND every = 1 THEN n ELSE 0 END) AS unique_fails,
    SUM(CASE WHEN fail AND earlier = 0 THEN n * good ELSE 0 END) AS good_lost, SUM(CASE WHEN fail AND earlier = 0 THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM w GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
"""
