"""Language identification by multilingual mixture inference.

A document is a mixture of languages: each byte n-gram was drawn from one of them. Expectation-
maximisation estimates the proportions; a language enters the set only if it improves the penalised
likelihood. Training and prediction see the text alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, table

#: n-grams of three bytes of letters, hashed into this many bins.
BINS = 1 << 15
UNKNOWN = "und"
#: Bytes kept as they are: ASCII lower-case letters and every byte of a longer code point.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")  # also numbers that are no digits


def gram_bins(text: str) -> np.ndarray:
    """Bin of every 3-gram of the folded text that holds a letter byte; one blank on either side."""
    b = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    key = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    key = key[(b[1:-1] != 32) | ((b[:-2] != 32) & (b[2:] != 32))]
    return (key * np.uint32(2654435761)) >> np.uint32(32 - 15)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    full = np.bincount(gram_bins(text), minlength=BINS)
    at = np.flatnonzero(full)
    return at, full[at].astype(float)


def has_letter(text: str) -> bool:
    """Whether a character is in one of the Unicode categories of letters (not, like a half or a Roman number, of numbers)."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


@dataclass
class Mixture:
    """Log-probability of each bin in each language, and the settings of the inference."""

    languages: list[str]
    logp: np.ndarray  # languages x BINS
    penalty: float = 3.0  # times log(n-grams), for each further language
    rounds: int = 12
    shares: tuple[float, ...] = (0.01, 0.03, 0.1, 0.3)  # shares at which a further language is screened

    def __post_init__(self):
        self.p = np.exp(self.logp)

    def proportions(self, text: str | None) -> dict[str, float]:
        """Share of each selected language; empty if the text has no letter or nothing was learned."""
        if not self.languages or text is None or not has_letter(text):
            return {}
        at, n = gram_counts(text)
        logp, p, total = self.logp[:, at], self.p[:, at], n.sum()
        if not total:
            return {self.languages[0]: 1.0}
        single = logp @ n
        chosen, best, share = [int(np.argmax(single))], float(single.max()), np.ones(1)
        while len(chosen) < len(self.languages):
            mixed = share @ p[chosen]
            # The likelihood is concave in the share of a further language, so one that gains at its best share
            # gains at every smaller one: of the languages with a share of 0.01 or more, none that the penalty lets in is
            # screened out. Smaller shares are not looked for.
            tries = []
            for k in range(len(p)):
                if k not in chosen:
                    gain, s = max((float(n @ np.log((1 - s) * mixed + s * p[k])), s) for s in self.shares)
                    if gain > best:
                        tries.append((k, s))
            found = None
            for k, first in tries:
                own = p[[*chosen, k]]
                s = np.append(share * (1 - first), first)
                for _ in range(self.rounds):  # E: who drew each n-gram; M: their shares
                    mix = s @ own
                    s = s * (own @ (n / mix)) / total
                likely = float(n @ np.log(s @ own))
                if likely - best > self.penalty * np.log(total) and (found is None or likely > found[0]):
                    found = (likely, k, s)
            if not found:
                break
            best, chosen, share = found[0], [*chosen, int(found[1])], found[2]
        return {self.languages[k]: float(s) for k, s in zip(chosen, share, strict=True)}


def fit(docs: DataFrame, smoothing: float = 0.5) -> Mixture:
    """n-gram likelihoods of every language from all rows with a text and a lang.

    Counts are summed in Spark; the driver gets at most BINS numbers for each language.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in chunks(batches):
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BINS, np.int64)
                sums[lang] += np.bincount(gram_bins(t), minlength=BINS)
        for lang, full in sums.items():
            at = np.flatnonzero(full)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(full[at])], ["lang", "bin", "n"])

    rows = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(count, "lang string, bin int, n long")
    got = rows.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    logp = np.zeros((len(languages), BINS))
    for i, lang in enumerate(languages):
        own = got[got["lang"] == lang]
        logp[i, own["bin"].to_numpy()] = own["n"].to_numpy()
    if len(languages):
        logp = np.log((logp + smoothing) / (logp.sum(1, keepdims=True) + smoothing * BINS))
    return Mixture([str(x) for x in languages], logp)


def identify(docs: DataFrame, model: Mixture) -> DataFrame:
    """doc_id, lang_pred, score and all proportions of every row of `docs`.

    The predicted language is the one with the largest share, which is the score. It is `und` with
    score 0 if the text is null or has no letter, or if no language was learned (empty training set).
    Equal shares go to the language that was selected first. Repeated rows are answered one by one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BINS numbers for each language

    def predict(batches):
        m = sent.value
        for b in chunks(batches):
            found = [m.proportions(t) for t in b.column(1).to_pylist()]
            top = [max(f, key=f.get) if f else UNKNOWN for f in found]
            score = [min(1.0, f[k]) if f else 0.0 for f, k in zip(found, top, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(top, pa.string()), pa.array(score, pa.float64()), pa.array([list(f.items()) for f in found], pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "shares"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, shares map<string, double>")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without doc_id is no training row and is not held out."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    out = identify(docs, fit(docs.where(~held)))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
