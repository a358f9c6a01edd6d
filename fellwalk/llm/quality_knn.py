"""Quality classifier: neighbours vote in a latent-semantic space.

Texts become hashed counts of raw and of shape n-grams, weighted by tf-idf and projected on the leading
singular vectors of a labelled sample. Every document is compared with all labelled vectors, a block of
documents at a time; its nearest ones vote with weights by cosine.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, labelled, table

#: Hash bins of either kind of n-gram; latent dimensions; voters.
BINS, LATENT, VOTERS = 1 << 12, 48, 25
#: Levels of each of the six habits of a text, and the weight of a habit beside all n-grams together.
LEVELS, HABITS, HABIT = 16, 6, 0.5
TERMS = 2 * BINS + HABITS * LEVELS
#: Labelled rows kept as neighbours, drawn by a hash of doc_id from the rows that may be learned from.
MAX_LABELLED = 4096
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else 32 if c in b" \t\r\x0b\x0c" else c for c in range(256))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'-")
_CAPITALS = bytes(range(65, 91))


def habits(raw: bytes) -> np.ndarray:
    """One term for the level of: log length, words repeated at once, distinct words, repeated lines, symbols, capitals."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x]
    n = max(1, len(words))
    again = sum(map(eq, words, words[1:])) / n
    share = (min(1.0, np.log2(1 + len(words)) / LEVELS), np.sqrt(again), len(set(words)) / n, 1 - len(set(lines)) / max(1, len(lines)))
    share += tuple(np.sqrt(1 - len(raw.translate(None, held)) / len(raw)) for held in (_MARKS, _CAPITALS))
    return 2 * BINS + LEVELS * np.arange(HABITS) + np.minimum(LEVELS - 1, (np.array(share) * LEVELS).astype(int))


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bins and log counts of the text's n-grams (three bytes of shape, two raw bytes), and its habits."""
    raw = b"\n" + (text or "").encode() + b"\n"
    s = np.frombuffer(raw.translate(_SHAPE), np.uint8).astype(np.uint32)
    r = np.frombuffer(raw, np.uint8).astype(np.uint32)
    shape = (((s[:-2] << np.uint32(16)) | (s[1:-1] << np.uint32(8)) | s[2:]) * np.uint32(2654435761)) >> np.uint32(20) if len(s) > 2 else np.zeros(0, np.uint32)
    pair = ((((r[:-1] << np.uint32(8)) | r[1:]) * np.uint32(2246822519)) >> np.uint32(20)) + np.uint32(BINS)
    full = np.bincount(np.concatenate((shape, pair)), minlength=2 * BINS)
    at = np.flatnonzero(full)
    w = np.log1p(full[at])
    return np.concatenate((at, habits(raw))), np.concatenate((w / np.sqrt(w @ w), np.full(HABITS, HABIT)))


@dataclass
class Voters:
    """Projection of the bins (idf included), and the labelled vectors: at most MAX_LABELLED rows."""

    project: np.ndarray  # TERMS x LATENT
    vectors: np.ndarray
    labels: np.ndarray
    voters: int = VOTERS
    sharpness: float = 8.0

    def latent(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.project.shape[1]), np.float32)
        for i, t in enumerate(texts):
            at, w = counts(t)
            out[i] = w.astype(np.float32) @ self.project[at]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    def score(self, texts: list[str | None], block: int = 256) -> np.ndarray:
        """Share of the neighbours' weight that label 1 holds; 0.5 if nothing was learned."""
        out = np.full(len(texts), 0.5)
        if not len(self.labels):
            return out
        k = min(self.voters, len(self.labels))
        for i in range(0, len(texts), block):
            near = self.latent(texts[i : i + block]) @ self.vectors.T
            near = near - 1e-13 * np.arange(len(self.labels))  # ties at the last place: the first of them
            at = np.argpartition(-near, k - 1, axis=1)[:, :k]
            w = np.clip(np.take_along_axis(near, at, 1), 0, 1).astype(float) ** self.sharpness + 1e-9
            out[i : i + block] = (w * self.labels[at]).sum(1) / w.sum(1)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, latent: int = LATENT) -> Voters:
    """Voters from at most `max_labelled` labelled documents; see labelled()."""
    rows = labelled(docs, labels, max_labelled).select("text", "doc_id", "quality")

    def sparse(batches):
        for b in chunks(batches):
            rows = [counts(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([a.astype(np.int32) for a, _ in rows], pa.list_(pa.int32())), pa.array([w.astype(np.float32) for _, w in rows], pa.list_(pa.float32()))], ["doc_id", "quality", "at", "w"])

    got = rows.mapInArrow(sparse, "doc_id long, quality int, at array<int>, w array<float>").toPandas().sort_values("doc_id")
    x = np.zeros((len(got), TERMS), np.float32)
    for i, (at, w) in enumerate(zip(got["at"], got["w"], strict=True)):
        x[i, at] = w
    y = got["quality"].to_numpy(float)
    if not len(y):
        return Voters(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    x *= idf
    rng = np.random.default_rng(7)  # randomised SVD: a few power rounds, then a small exact one
    q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], latent + 16), np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    _, s, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    keep = min(latent, int((s > 1e-4 * max(s[0], 1e-9)).sum()) or 1)
    project = (vt[:keep].T * idf[:, None]).astype(np.float32)
    found = Voters(project, np.zeros((0, keep), np.float32), y)
    own = x @ vt[:keep].T
    norm = np.linalg.norm(own, axis=1, keepdims=True)
    found.vectors = np.ascontiguousarray(own / np.where(norm > 0, norm, 1), np.float32)
    return found


def score_documents(docs: DataFrame, model: Voters) -> DataFrame:
    """doc_id, score and predicted of every row of `docs`.

    Null and empty texts are scored like any other by their (blank) n-grams; rows with the same text
    get the same score; without labelled rows every score is 0.5. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # sizes fixed by BINS, LATENT and MAX_LABELLED

    def vote(batches):
        for b in chunks(batches):
            s = sent.value.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(vote, "doc_id long, score double, predicted int")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without doc_id is no training row and is not held out."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 3) == 1
    out = score_documents(docs, fit(docs.where(~held), table(spark, sf_dir, "labels").where(~held)))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
