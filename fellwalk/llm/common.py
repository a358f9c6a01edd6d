"""Helpers shared by the corpus operators: input columns, tokens, shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = b" \t\n\x0b\x0c\r"
#: Text bytes handled at once inside a Python worker.
CHUNK_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col, n: int):
    """Remainder of the CRC-32 of a key written as text."""
    return F.crc32(col.cast("string").cast("binary")) % n


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, quality (0 or 1) of at most `most` labelled documents, chosen by a hash of doc_id.

    Labels without a document, and documents without a label or doc_id, are left out before the choice. Of
    conflicting labels 1 holds; of rows that share a doc_id the least text.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = known.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's spark.checkpoint.dir; where that is unset (tests, a notebook) a local
    temporary folder is set, which is only good for local mode.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        found = "file://" + tempfile.mkdtemp(prefix="fellwalk-checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it back; cuts the lineage of wide data."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_rows(docs: DataFrame) -> Column:
    """All columns as one struct `whole`, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches into slices of about `size` text bytes; a single row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


#: Base of the polynomial hashes (odd), and one for a second, independent hash.
_BASE, OTHER = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


class Tokens:
    """The words of a slice of documents: codes into a dictionary, and where each document starts."""

    def __init__(self, text: pa.Array, lower: bool = False):
        text = pc.fill_null(text, "").cast(pa.large_string())
        if lower:
            # a compact copy: the lower-casing kernel misreads a slice that starts inside its buffer
            text = pc.ascii_lower(text.take(pa.array(np.arange(len(text)))))
        lists = pc.ascii_split_whitespace(text)
        flat = lists.flatten()
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        if not full.all():  # leading, trailing or only white space
            ends = np.cumsum(lengths)
            held = np.concatenate(([0], np.cumsum(full)))
            lengths = held[ends] - held[ends - lengths]
            flat = flat.filter(pa.array(full))
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.words: pa.Array = coded.dictionary
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.flat = flat

    def word_hashes(self, base: int = _BASE) -> np.ndarray:
        """64-bit hash of every dictionary word: a polynomial of its bytes modulo 2**64, then mixed."""
        words = self.words.cast(pa.large_binary())
        if not len(words):
            return np.zeros(0, np.uint64)
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
        ends = ends - ends[0]
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(raw), base, np.uint64))))
        inverse = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(raw), pow(base, -1, 1 << 64), np.uint64))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(raw * power[:-1])))
        return mix64((sums[ends[1:]] - sums[ends[:-1]]) * inverse[ends[:-1]] ^ mix64(np.diff(ends).view(np.uint64)))

    def hashes(self) -> np.ndarray:
        """64-bit hash of every token."""
        return self.word_hashes()[self.codes]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3 (public domain): spreads every input bit over the result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def local_path(uri: str) -> str | None:
    """The path of a file: URI or a bare path; None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri and os.path.isabs(uri) else None
