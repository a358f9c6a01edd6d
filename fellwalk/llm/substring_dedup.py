"""Substring deduplication on Rabin-Karp hashes of fixed-length word windows.

Every window of every document is hashed. A window is known to occur once, and needs no counting, if
its anchor (the least hash among its half-length sub-windows) occurs once; equal windows have equal
anchors. The others are counted in Spark with the smallest doc_id they start in, and windows seen in a
smaller document merge into maximal intervals that are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .common import OTHER, Tokens, chunks, mix64, stored, table, whole_rows

WINDOW = 50
#: Bits of the second hash of a window.
CHECK_BITS = 24
#: Bits of the filter over repeated anchors: 16 for each anchor, up to this many (32 MB). With more
#: anchors than that the filter passes more windows on to be counted; the result stays the same.
MOST_BITS = 1 << 28
#: Bases (odd) of the window hash and of its check.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of windows over a run of hashed words."""

    def __init__(self, words: np.ndarray, base: int = _BASES[0]):
        n = len(words)
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))
        self.inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:n])))

    def windows(self, n: int) -> np.ndarray:
        if len(self.sums) <= n:
            return np.zeros(0, np.uint64)
        return mix64((self.sums[n:] - self.sums[:-n]) * self.inverse[: len(self.sums) - n])


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every n neighbours, by doubling."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def window_hashes(tok: Tokens, n: int, check: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(row, position in the document, window hash, anchor, check) of every window of n words inside a
    document. check: the upper 24 bits of a hash of the window on another base and other hashes of its words' bytes."""
    words = tok.hashes()
    if len(words) < n:
        none = np.zeros(0, np.int64)
        return none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64) if check else None
    roll = Rolling(words)
    full, half = roll.windows(n), max(1, n // 2)
    anchor = sliding_least(roll.windows(half), n - half + 1)
    lengths = np.diff(tok.offsets)
    row = np.repeat(np.arange(len(lengths)), np.maximum(lengths - n + 1, 0))
    at = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(lengths - n + 1, 0)) - np.maximum(lengths - n + 1, 0), np.maximum(lengths - n + 1, 0))
    place = tok.offsets[row] + at
    other = Rolling(tok.word_hashes(OTHER)[tok.codes], _BASES[1]).windows(n)[place] >> np.uint64(40) if check else None
    return row, at, full[place], anchor[place], other


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text (which tells rows of one doc_id apart) and the text; other columns go."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")


def repeated_anchors(keyed: DataFrame, n: int) -> DataFrame:
    """Anchors that occur in at least two documents."""

    def anchors(batches):
        for b in chunks(batches):
            row, _, _, anchor, _ = window_hashes(Tokens(b.column(1)), n)
            first = np.ones(len(row), bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(ids[row[first]])], ["anchor", "doc_id"])

    rows = keyed.where("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(anchors, "anchor long, doc_id long")
    return rows.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("anchor")


def anchor_filter(anchors: DataFrame) -> np.ndarray:
    """Bits set for the anchors, as longs; at most MOST_BITS of them come to the driver."""
    kept = stored(anchors, "anchors")
    bits = max(1 << 12, min(MOST_BITS, 1 << (16 * kept.count()).bit_length()))
    at = F.col("anchor").bitwiseAND(bits - 1)
    bit = F.expr("shiftleft(1L, cast(anchor & 63 as int))")
    rows = kept.select(F.shiftright(at, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    got = rows.toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def window_rows(keyed: DataFrame, n: int, sent) -> DataFrame:
    """window, tail, doc_id, row_key, times: windows whose anchors are in the filter that is sent. tail: position << CHECK_BITS | check,
    times: equal windows in a row."""

    def windows(batches):
        held = sent.value
        mask = np.uint64(64 * len(held) - 1)
        for b in chunks(batches):
            row, at, full, anchor, check = window_hashes(Tokens(b.column(2)), n, True)
            bit = anchor & mask
            maybe = np.flatnonzero((held[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1))
            row, at, full, check = row[maybe], at[maybe], full[maybe], check[maybe].astype(np.int64)
            # a word repeated over and over makes the same window at one place after another: one row
            again = (full[1:] == full[:-1]) & (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), ~again)))
            times = np.diff(np.append(first, len(row)))
            row, at, full, check = row[first], at[first], full[first], check[first]
            # what differs from row to row stands together, so that the shuffle's compression finds all else in the row before
            tail = at << CHECK_BITS | check
            ids, keys = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(full.view(np.int64)), pa.array(tail), pa.array(ids[row]), pa.array(keys[row]), pa.array(times)], ["window", "tail", "doc_id", "row_key", "times"])

    return keyed.where("doc_id is not null and text is not null").mapInArrow(windows, "window long, tail long, doc_id long, row_key long, times long")


def removable(keyed: DataFrame, n: int) -> DataFrame:
    """doc_id, row_key, starts: where windows begin that also start in a document with a smaller doc_id, as
    position << 32 | number of equal windows in a row.

    Windows are equal if 88 bits agree: a 64-bit hash and 24 bits of another, on another hash of the words. Among
    1.5e13 windows (100 TB), 0.4 pairs are expected to agree by chance.
    """
    sent = keyed.sparkSession.sparkContext.broadcast(anchor_filter(repeated_anchors(keyed, n)))
    rows = window_rows(keyed, n, sent)
    check = F.col("tail").bitwiseAND((1 << CHECK_BITS) - 1)
    least = rows.groupBy("window", check.alias("check")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("window", "check", "least")
    # stored, so that both sides of the join are plain exchanges, and a window that is everywhere can be split
    least = stored(least, "windows").withColumnRenamed("window", "_window")
    late = rows.join(least, (F.col("window") == F.col("_window")) & (check == F.col("check"))).where("doc_id > least")
    span = F.shiftleft(F.shiftright("tail", CHECK_BITS), 32).bitwiseOR(F.col("times"))
    return late.groupBy("doc_id", "row_key").agg(F.collect_set(span).alias("starts"))  # a set, as repeated rows bring each window again


def intervals(starts: np.ndarray, n: int, times: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Maximal intervals [begin, end) that windows of n words cover; each entry stands for `times` windows in a row."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    s = np.asarray(starts, np.int64)[order]
    ends = np.maximum.accumulate(s + n + (0 if times is None else np.asarray(times, np.int64)[order] - 1))
    cut = np.flatnonzero(s[1:] > ends[:-1])
    return list(zip(s[np.concatenate(([0], cut + 1))].tolist(), ends[np.concatenate((cut, [len(s) - 1]))].tolist(), strict=True))


def _gone(starts: pa.Scalar, n: int) -> list[tuple[int, int]]:
    if not starts.is_valid:
        return []
    span = starts.values.to_numpy()
    return intervals(span >> 32, n, span & 0xFFFFFFFF)


def _with_starts(docs: DataFrame, n: int) -> DataFrame:
    keyed = _keyed(docs)
    found = removable(keyed, n)
    return found.select(F.col("doc_id").alias("r_doc_id"), F.col("row_key").alias("r_row_key"), "starts")


def removed_words(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed intervals (in words) of every row.

    Null and empty texts have no words. Rows that share a doc_id do not count as smaller than each other,
    so a repeated row is not removed on account of its twin. A null doc_id is smaller than none and keeps
    all its words. Windows are judged on the input, not on what is left.
    """
    found = _with_starts(docs, n)
    keyed = _keyed(docs)
    rows = keyed.join(found, (keyed["doc_id"] == found["r_doc_id"]) & (keyed["row_key"] == found["r_row_key"]), "left").select("doc_id", "text", "starts")

    def cut(batches):
        for b in chunks(batches):
            out = []
            for text, starts in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                words = (text or "").encode().split()
                gone = _gone(starts, n)
                kept, last = [], 0
                for begin, end in gone:
                    kept += words[last:begin]
                    last = end
                kept += words[last:]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [list(x) for x in gone]))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.list_(pa.int32())))], ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    return rows.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<array<int>>")


def _kept_text(text: str, gone: list[tuple[int, int]]) -> str:
    """The text without the words of the intervals; white space before a removed word goes with it."""
    import re

    ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    out, last = [], 0
    for begin, end in gone:
        out.append(text[last : ends[begin - 1] if begin else 0])
        last = ends[end - 1]
    out.append(text[last:])
    return "".join(out)


def dedup_documents(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """`docs` with the repeated words cut out of each text; n_chars, if there, is counted anew.

    Rows that lose every word are left out. Null and empty texts, and rows with a null doc_id, stay as they
    are. Rows that share a doc_id are not cut on account of each other. Columns may have any names. An empty
    table stays empty.
    """
    found = _with_starts(docs, n)
    rows = docs.select(whole_rows(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), F.col("text").alias("own"))
    joined = rows.join(found, (F.col("id") == F.col("r_doc_id")) & (F.col("key") == F.col("r_row_key")), "left")

    def cut(batches):
        for batch in batches:
            for b in chunks([batch], "own"):
                texts = []
                for text, starts in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                    texts.append(_kept_text(text, _gone(starts, n)) if text is not None and starts.is_valid else text)
                cut = pa.array([s.is_valid for s in b.column(2)])
                gone = pa.array([s.is_valid and not t.strip(" \t\n\x0b\x0c\r") for t, s in zip(texts, b.column(2), strict=True)])
                cols = [b.column(0), pa.array(texts, pa.string()), cut, pa.array([None if t is None else len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["whole", "own", "cut", "n"]).filter(pc.invert(gone))

    whole = next(f for f in rows.schema if f.name == "whole")
    schema = StructType([whole, StructField("own", StringType()), StructField("cut", BooleanType()), StructField("n", LongType())])
    out = joined.select("whole", "own", "starts").mapInArrow(cut, schema)

    def column(c: str):
        kept = F.col(f"whole.`{c}`")
        if c == "text":
            return F.col("own").alias(c)
        if c == "n_chars":
            return F.when(F.col("cut"), F.col("n").cast(docs.schema[c].dataType)).otherwise(kept).alias(c)
        return kept

    return out.select(*[column(c) for c in docs.columns])


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated windows take from every document, see `removed_words`; texts of any length are cut whole."""
    return removed_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The windows spelled out.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h FROM (SELECT doc_id, words, UNNEST(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50)),
f AS (SELECT h, MIN(doc_id) AS least FROM w GROUP BY h),
s AS (SELECT w.doc_id, w.i FROM w JOIN f USING (h) WHERE w.doc_id > f.least),
x AS (SELECT DISTINCT doc_id, UNNEST(range(i, i + 50)) AS p FROM s),
k AS (SELECT doc_id, UNNEST(words) AS word, generate_subscripts(words, 1) AS p FROM d),
j AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.p) AS kept, COUNT(*) AS n FROM k LEFT JOIN x ON k.doc_id = x.doc_id AND k.p = x.p WHERE x.p IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - COALESCE(j.n, 0) AS BIGINT) AS n_removed, sha256(COALESCE(j.kept, '')) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)
"""
