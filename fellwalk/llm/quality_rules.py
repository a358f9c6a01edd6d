"""Quality rules: gradient-boosted trees over document statistics.

The statistics are counted in one pass over whole texts. The trees are grown on histograms with
monotonic constraints, flattened into numpy node arrays and scored a block of documents at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Tokens, chunks, labelled, table

#: Base columns and the shapes the trees look at; the sign is the monotonic constraint on "good".
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": -1, "digit_share": 0,
    "shout_share": -1, "distinct_share": 0, "punct_share": 0, "words_per_line": 0, "pipe_share": -1,
}
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Labelled rows that the trees may be fitted on; the sample is drawn by a hash of doc_id.
MAX_LABELLED = 20_000
_UPPER, _DIGITS, _SHOUT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!?"
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def repeated_words(codes: np.ndarray) -> int:
    """Words that lie in a 3-word window found at least twice in this document."""
    if len(codes) < 4:
        return 0
    c = codes.astype(np.int64)
    pairs = np.unique(c[:-1] * (int(c.max()) + 1) + c[1:], return_inverse=True)[1].astype(np.int64)
    keys = pairs[:-1] * (int(c.max()) + 1) + c[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    found = np.zeros(len(keys), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    covered = np.zeros(len(c), bool)
    for k in range(3):
        covered[k : k + len(found)] |= found
    return int(covered.sum())


def statistics(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features) of a slice of texts; a null counts as no words."""
    tok = Tokens(text)
    base = np.zeros((len(text), len(BASE)), np.int64)
    feats = np.zeros((len(text), len(FEATURES)))
    for i, t in enumerate(text.to_pylist()):
        codes = tok.codes[tok.offsets[i] : tok.offsets[i + 1]]
        if not len(codes):
            continue
        b = t.encode()
        held = lambda chars, b=b: len(b) - len(b.translate(None, chars))
        chars = len(t) - held(SPACES)
        lines = [x for x in b.split(b"\n") if x.strip(SPACES)]
        dup = len(lines) - len(set(lines))
        base[i] = n, _, sym, _, rep = len(codes), chars, held(SYMBOLS), dup, repeated_words(codes)
        feats[i] = (
            np.log1p(n), chars / n, sym / chars, dup / len(lines), rep / n, held(_UPPER) / chars, held(_DIGITS) / chars,
            held(_SHOUT) / chars, len(np.unique(codes)) / n, held(_PUNCT) / chars, n / len(lines), held(b"|") / chars,
        )
    return base, feats


@dataclass
class Trees:
    """A forest as flat node arrays. Leaves point to themselves, so every walk takes `depth` steps."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -50, 50)))


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 3, bins: int = 48, rate: float = 0.2, l2: float = 2.0, least: float = 1.0) -> Trees:
    """Boosted trees for a 0/1 label by Newton steps on histograms.

    A split on a constrained feature is refused if its child values break the constraint, and the
    middle of both values bounds all later splits on either side, which keeps the whole tree monotone.
    """
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) if n else np.zeros(0) for j in range(m)]
    codes = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], 1) if n else np.zeros((0, m), int)
    mean = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    prior = float(np.log(mean / (1 - mean)))
    nodes: list[list] = []
    roots, margin = [], np.full(n, prior)

    def leaf(value: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), value * rate])
        return len(nodes) - 1

    def build(rows: np.ndarray, g: np.ndarray, h: np.ndarray, lo: float, hi: float, level: int) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + l2), lo, hi))
        if level == depth:
            return leaf(value)
        best = (1e-6, None)
        for j in range(m):
            k = len(cuts[j])
            if not k:
                continue
            gl = np.cumsum(np.bincount(codes[rows, j], g[rows], k + 1))[:-1]
            hl = np.cumsum(np.bincount(codes[rows, j], h[rows], k + 1))[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
            loss = lambda v, a, b: -(a * v + 0.5 * (b + l2) * v * v)
            gain = loss(vl, gl, hl) + loss(vr, gr, hr) - loss(value, gs, hs)
            gain[(hl < least) | (hr < least) | (signs[j] * (vr - vl) < 0)] = 0
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), j, at, float(vl[at]), float(vr[at]))
        if best[1] is None:
            return leaf(value)
        _, j, at, vl, vr = best
        mid, own = (vl + vr) / 2, len(nodes)
        nodes.append([j, float(cuts[j][at]), 0, 0, 0.0])
        bound = {1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid)), 0: ((lo, hi), (lo, hi))}[int(signs[j])]
        goes = codes[rows, j] <= at
        nodes[own][2] = build(rows[goes], g, h, *bound[0], level + 1)
        nodes[own][3] = build(rows[~goes], g, h, *bound[1], level + 1)
        return own

    if n and 0 < y.sum() < n:
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            first = len(nodes)
            roots.append(build(np.arange(n), p - y, p * (1 - p), -np.inf, np.inf, 0))
            a = [np.array(c) for c in zip(*nodes, strict=True)]
            margin += Trees(a[0].astype(int), a[1], a[2].astype(int), a[3].astype(int), a[4], np.array([first]), depth, 0.0).margin(x)
    else:  # no rows, or one class only: nothing to tell apart
        prior = 50.0 if not n or y.sum() == n else prior
        roots.append(leaf(0.0))
    f, t, left, right, value = (np.array(c) for c in zip(*nodes, strict=True))
    return Trees(f.astype(int), t, left.astype(int), right.astype(int), value, np.array(roots), depth, prior)


_STATS_SCHEMA = "doc_id long, " + ", ".join(f"{b} long" for b in BASE)


def labelled_statistics(docs: DataFrame, labels: DataFrame, max_labelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most `max_labelled` documents; see labelled()."""
    def features(batches):
        for b in chunks(batches):
            f = statistics(b.column(0))[1]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(f), pa.list_(pa.float64()))], ["quality", "x"])

    got = labelled(docs, labels, max_labelled).select("text", "quality").mapInArrow(features, "quality int, x array<double>").toPandas()
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["quality"].to_numpy()))  # the same sums in every run
    return x[order], got["quality"].to_numpy(float)[order]


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Trees:
    x, y = labelled_statistics(docs, labels, max_labelled)
    return grow(x, y, np.array(list(FEATURES.values())))


def apply_rules(docs: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the forest's score of every document.

    A null or empty text has no words and so fails the base rule. Rows with the same doc_id are judged
    one by one. Other columns of `docs` are ignored.
    """

    def judge(batches):
        for b in chunks(batches):
            base, feats = statistics(b.column(1))
            score = trees.score(feats)
            failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > 50 * base[:, 0])
            cols = [b.column(0), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *BASE, "base_failed", "kept", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, _STATS_SCHEMA + ", base_failed boolean, kept boolean, score double")


def filter_documents(docs: DataFrame, trees: Trees, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs` that the rules keep, all columns unchanged, under any names.

    Null and empty texts have no words and go; rows with the same doc_id, or a null one, are judged one by
    one; an empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    at = docs.columns.index("text")
    schema = to_arrow_schema(docs.schema)

    def judge(batches):
        for b in batches:
            for part in chunks([b], b.schema.names[at]):
                base, feats = statistics(part.column(at))
                ok = (base[:, 0] >= MIN_WORDS) & (100 * base[:, 4] <= 50 * base[:, 0]) & (trees.score(feats) >= threshold)
                yield part.filter(pa.array(ok)).cast(schema)

    return docs.mapInArrow(judge, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; null texts have no words, texts of any length are counted whole, repeated rows one by one."""
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, fit(docs, table(spark, sf_dir, "labels")))
