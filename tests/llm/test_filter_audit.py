"""The audit against documents that walk through every order, and its transform against sums over subsets."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from fellwalk.llm import filter_audit

DOCS = "doc_id long, text string, source string, good int, step int, mask int"
LABELS = "doc_id long, quality int, toxic int"
WORDS = " ".join(f"w{k}" for k in range(210))
#: Texts at the borders of the filters.
TEXTS = [None, "", " \n\x0b ", WORDS, WORDS + " ÄÖ", "a b " * 100, "a " * 199, "a " * 200, " ".join(f"x{k % 100}" for k in range(200)), " ".join(f"x{k % 99}" for k in range(200)), "Abcdefghij" * 5, "A" + "b" * 49, "A" + "b" * 48, WORDS + " $", "x|y", "#", WORDS + " #", WORDS.upper(), "long " * 50_000]


def mask(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def brute(docs, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    least = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(least.get(t or "", k), k)
    rows = []
    for k, t, source in docs:
        fails = mask(t or "")
        fails["E"] = k is not None and k > least[t or ""]
        rows.append((source or "", fails, k in good, k in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            for i, f in enumerate(order):
                c = Counter()
                for p, fails, g, x in rows:
                    if p == part:
                        early = any(fails[e] for e in order[:i])
                        gone = fails[f] and not early
                        c.update({"kept": not fails[f] and not early, "removed": gone, "redundant": fails[f] and early, "unique": fails[f] and sum(fails.values()) == 1, "good": gone and g, "toxic": gone and x})
                out[part, "".join(order), i + 1] = [int(c[n]) for n in ("kept", "removed", "redundant", "unique", "good", "toxic")]
    shares = Counter()
    for (part, order, step), v in out.items():
        shares[part, order[step - 1]] += v[1]
    return {(*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit(spark):
    rng = random.Random(3)
    docs = [(k, t, rng.choice(["a", "b", None])) for k, t in enumerate(TEXTS + rng.choices(TEXTS, k=40))]
    docs += [(3, TEXTS[3], "a"), (3, TEXTS[3], "b"), (3, "other text of one id", "b"), (None, TEXTS[3], "b"), (None, "without id", "c"), (None, "without id", "c")]
    rng.shuffle(docs)
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(40)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    out = filter_audit.audit(spark.createDataFrame([(*d, 5, 6, 7) for d in docs], DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    rows = [tuple(r) for r in out.collect()]
    want = brute(docs, labels)
    assert len(rows) == len(want) and set(rows) == want


def test_hot_text(spark):
    """A third of all rows with one text, in one source or in many."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("t "), F.col("id"))).alias("text"), (F.col("id") % 7).cast("string").alias("source"))
    counts = filter_audit.mask_counts(docs, spark.createDataFrame([], LABELS)).groupBy("mask").agg(F.sum("n").alias("n")).collect()
    assert {r["mask"]: r["n"] for r in counts} == {1: 2001, 17: 999}


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_zeta(spark, bits):
    rng = random.Random(bits)
    values = [rng.randrange(100) for _ in range(1 << bits)]
    (row,) = filter_audit.zeta(spark.createDataFrame([(values,)], "x array<long>"), ("x",), bits).collect()
    assert row.x == [sum(v for m, v in enumerate(values) if m & s == m) for s in range(1 << bits)]


def test_empty(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
