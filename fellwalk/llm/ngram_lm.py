"""Language-model scoring with a sharded Elias-Fano n-gram trie.

Unigrams, bigrams and trigrams are counted over all training documents; those seen `least_count` times or
more stay in the model. Words of a level are numbered relative to their context (a trigram's last
word is its rank among the successors of the middle word), pointers and numbers are Elias-Fano coded,
smoothed probabilities are quantised, and every shard is a file of levels that tasks memory-map.

What a task counts travels as one packed block for each shard, not as rows. There are as many shards as
the corpus needs for each to hold about TOKENS of it, so no task grows with the corpus.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tokens, chunks, crc_mod, local_path, mix64, shared_dir, table
from .elias_fano import EliasFano

#: The end of a text, as a token; no word hashes to it but by chance (1 in 2**64).
END = np.uint64(1)
DISCOUNT, LEAST_COUNT = 0.75, 1
#: Tokens a shard (words take twice as many), characters a token, and least shards.
TOKENS, CHARACTERS, SHARDS = 1 << 21, 6, 8
#: Tokens a unit of level 3, and bits of a word's number in keys; the rest holds a context or a place in a shard.
UNIT, WORD_BITS = 1 << 22, 33
#: Shards of a level that a worker keeps mapped.
MAPPED = 256
#: Quantisation of log10 probabilities: 16 bits over [LOWEST, 0].
LOWEST = -16.0
#: Keys that a task gathers before it sends them on.
GATHER = 4 << 20
_U = np.uint64


def quantise(logs: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(logs, LOWEST, 0) / LOWEST * 65535).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (LOWEST / 65535)


# --- files in the shared folder


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file: a JSON head, then the arrays, each at a multiple of 64 bytes. A task that runs again
    replaces the file in one step."""
    place, heads = 0, {}
    for name, a in arrays.items():
        heads[name] = [place, a.dtype.str, len(a)]
        place += -(-a.nbytes // 64) * 64
    head = json.dumps(heads).encode()
    head += b" " * (-(len(head) + 8) % 64)
    fs, path = _store(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * (-a.nbytes % 64))
    fs.move(part, path)


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped. From a store without local paths the file is fetched first
    and unlinked once it is mapped, so nothing stays behind."""
    path = local_path(uri)
    gone = path is None
    if gone:
        fs, far = _store(uri)
        handle, path = tempfile.mkstemp()
        with os.fdopen(handle, "wb") as out, fs.open_input_stream(far) as f:
            while block := f.read(1 << 24):
                out.write(block)
    raw = np.asarray(np.memmap(path, np.uint8, "r"))
    if gone:
        os.unlink(path)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    return {name: raw[8 + size + at : 8 + size + at + n * np.dtype(kind).itemsize].view(kind) for name, (at, kind, n) in json.loads(raw[8 : 8 + size].tobytes()).items()}


# --- counting: packed blocks of (key, count) for each shard


def pack_block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences of their upper halves and plain lower halves, and counts, all byte by byte: first bytes,
    second bytes and so on, most of which are zeros and compress to nothing. A count of 2**32 and more takes
    several entries of its key, which add up."""
    most = (1 << 32) - 1
    if len(counts) and counts.max() > most:
        times = np.maximum(1, -(-counts // most))
        last = np.cumsum(times) - 1
        keys, rest = np.repeat(keys, times), counts - (times - 1) * most
        counts = np.full(len(keys), most, np.int64)
        counts[last] = rest
    high = (keys >> _U(32)).astype(np.uint32)
    rows = np.stack((np.diff(high, prepend=np.uint32(0)), keys.astype(np.uint32), counts.astype(np.uint32)))
    return rows.view(np.uint8).reshape(3, len(keys), 4).transpose(0, 2, 1).tobytes()


def unpack_block(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(3, 4, -1).transpose(0, 2, 1)).view(np.uint32)[..., 0]
    return np.cumsum(a[0], dtype=np.uint32).astype(np.uint64) << _U(32) | a[1].astype(np.uint64), a[2].astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        u, n = np.unique(keys, return_counts=True)
        return u, n
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def cut_by(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a sorted array, with where it lies; nothing is looped over but the values that are there."""
    if len(values):
        begin = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1))
        for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(values)], strict=True):
            yield int(values[s]), slice(s, e)


def rows_by(numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each number that is there, with the rows that have it."""
    small = numbers.astype(np.uint16) if len(numbers) and numbers.max() < 1 << 16 else numbers  # 16 bits sort by radix
    order = np.argsort(small, kind="stable")
    for n, at in cut_by(numbers[order]):
        yield n, order[at]


def gathered(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Adds up (owner, key, count) as they come and sends them on: one row (shard, block) for each owner."""
    held, size = [], 0

    def flush():
        owner, keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((keys, owner.astype(np.uint16) if owner.max() < 1 << 16 else owner))
        owner, keys, counts = owner[order], keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1]))))
        owner, keys, counts = owner[first], keys[first], np.add.reduceat(counts, first)
        for s, at in cut_by(owner):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([pack_block(keys[at], counts[at])], pa.binary())], ["shard", "block"])

    for part in parts:
        if len(part[0]):
            held.append(part)
            size += len(part[0])
        if size >= GATHER:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


BLOCKS = "shard int, block binary"


def each_shard(blocks: DataFrame, shards: int, work: Callable[[int, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Brings the blocks of a shard together and calls work(shard, keys, counts) with their sums."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now, size, most = None, 0, GATHER

        def together():
            keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            return summed(keys, counts)

        for b in batches:
            for s, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if s != now and held:
                    yield from work(now, *together())
                    size, most = 0, GATHER
                now = s
                held.append(unpack_block(raw.as_buffer()))
                size += len(held[-1][0])
                if size > most:  # keys that came before take no further room
                    held.append(together())
                    size = len(held[-1][0])
                    most = max(GATHER, 2 * size)
        if held:
            yield from work(now, *together())

    return blocks.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


# --- the model


class Mapped:
    """Opens shards on use and keeps the latest ones mapped."""

    def __init__(self, make: Callable, most: int | None = None):
        self.make, self.most, self.held = make, most or MAPPED, OrderedDict()

    def __getitem__(self, key):
        if key in self.held:
            self.held.move_to_end(key)
        else:
            self.held[key] = self.make(key)
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        return self.held[key]


class Vocabulary:
    """All training words by hash, in shards by the top bits: counts, and numbers of the words that stay."""

    def __init__(self, root: str, shards: int, sizes: dict[int, tuple[int, int]], least_count: int):
        self.bits, self.least_count, self.known = shards.bit_length() - 1, least_count, sizes
        self.files = Mapped(lambda s: map_arrays(f"{root}/words-{s}"))
        held = np.array([sizes.get(s, (0, 0))[1] for s in range(shards)], np.int64)
        self.first = np.concatenate(([0], np.cumsum(held)))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, number or -1) of each hash."""
        count, number = np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        for s, rows in rows_by((hashes >> _U(64 - self.bits)).astype(np.int64)):
            if s not in self.known:
                continue
            f = self.files[s]
            at = np.minimum(np.searchsorted(f["hash"], hashes[rows]), len(f["hash"]) - 1)
            hit = f["hash"][at] == hashes[rows]
            count[rows] = np.where(hit, f["count"][at], 0)
            number[rows] = np.where(hit & (f["count"][at] >= self.least_count), self.first[s] + f["rank"][at], -1)
        return count, number

    def counts_of(self, numbers: np.ndarray) -> np.ndarray:
        shard = np.searchsorted(self.first, numbers, "right") - 1
        out = np.zeros(len(numbers), np.int64)
        for s, rows in rows_by(shard):
            out[rows] = self.files[s]["kept"][numbers[rows] - self.first[s]]
        return out


class Level2:
    """Bigrams of one shard. Context number c holds the words c * shards + shard."""

    def __init__(self, arrays: dict[str, np.ndarray], words: int):
        self.words, self.a = words, arrays
        self.next, self.start = EliasFano.of(arrays, "next"), EliasFano.of(arrays, "start")

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.next.successor(context * self.words + word)


class Level3:
    """Trigrams of one unit: under each middle word its first words, under these the last words, numbered
    by their rank among the middle word's successors."""

    def __init__(self, arrays: dict[str, np.ndarray], words: int):
        self.words, self.a = words, arrays
        self.before, self.start, self.base, self.last = (EliasFano.of(arrays, k) for k in ("before", "start", "base", "last"))


def log_unigram(count: np.ndarray, tokens: int, words: int) -> np.ndarray:
    return np.log10((count + 1.0) / (tokens + words + 1.0))


def build2(vocabulary: Vocabulary, shard: int, shards: int, words: int, total: tuple[int, int], keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Level 2 of a shard from bigram keys (context number << WORD_BITS | second word) and counts."""
    context, second = (keys >> _U(WORD_BITS)).astype(np.int64), (keys & _U((1 << WORD_BITS) - 1)).astype(np.int64)
    n_context = (words - shard + shards - 1) // shards
    start = np.searchsorted(context, np.arange(n_context + 1))
    seen = vocabulary.counts_of(np.arange(n_context) * shards + shard).astype(float)
    left = counts - DISCOUNT
    kept = np.add.reduceat(np.append(left, 0.0), np.minimum(start[:-1], len(left))) * (np.diff(start) > 0) if n_context else np.zeros(0)
    back = np.clip(1 - kept / np.maximum(seen, 1), 1e-12, 1)
    p1 = 10 ** log_unigram(vocabulary.counts_of(second).astype(float), *total)
    p = left / seen[context] + back[context] * p1
    out = {"p": quantise(np.log10(p)), "back": quantise(np.log10(back)), "n": counts.astype(np.uint32 if not len(counts) or counts.max() < 1 << 32 else np.uint64)}
    for name, ef in (("next", EliasFano.encode(context * words + second)), ("start", EliasFano.encode(start))):
        out |= {f"{name}.{k}": v for k, v in ef.arrays().items()}
    return out


def build3(level2: Level2, n_context: int, keys: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Level 3 from keys (place of the bigram (middle, last) in its shard of level 2 << WORD_BITS | first word)."""
    bigram, first = (keys >> _U(WORD_BITS)).astype(np.int64), (keys & _U((1 << WORD_BITS) - 1)).astype(np.int64)
    start2 = level2.start.access(np.arange(n_context + 1))
    middle = np.searchsorted(start2, bigram, "right") - 1
    rank = bigram - start2[middle]
    order = np.lexsort((rank, first, middle))
    middle, first, rank, bigram, counts = (x[order] for x in (middle, first, rank, bigram, counts))
    opens = np.concatenate(([True], (middle[1:] != middle[:-1]) | (first[1:] != first[:-1]))) if len(middle) else np.zeros(0, bool)
    at = np.flatnonzero(opens)
    group = np.cumsum(opens) - 1
    c_middle, c_first = middle[at], first[at]
    start = np.searchsorted(c_middle, np.arange(n_context + 1))
    successors = np.diff(start2)
    base = np.concatenate(([0], np.cumsum(np.diff(start) * successors)))
    value = base[middle] + (group - start[middle]) * successors[middle] + rank
    return {"value": value, "middle": c_middle, "first": c_first, "group": group, "bigram": bigram, "counts": counts, "start": start, "base": base}


def _finish3(level2: Level2, t: dict[str, np.ndarray], words: int, seen: np.ndarray) -> dict[str, np.ndarray]:
    left = t["counts"] - DISCOUNT
    kept = np.bincount(t["group"], left, len(t["middle"])) if len(left) else np.zeros(0)
    back = np.clip(1 - kept / np.maximum(seen, 1), 1e-12, 1)
    p2 = 10 ** dequantise(level2.a["p"][t["bigram"]])
    p = left / seen[t["group"]] + back[t["group"]] * p2
    out = {"p": quantise(np.log10(p)), "back": quantise(np.log10(back))}
    parts = {"before": t["middle"] * words + t["first"], "start": t["start"], "base": t["base"], "last": t["value"]}
    for name, values in parts.items():
        out |= {f"{name}.{k}": v for k, v in EliasFano.encode(values).arrays().items()}
    return out


class Model:
    """Handles of all shards. root, shards and sizes are what travels; files are mapped on first use."""

    def __init__(self, root: str, shards: int, word_shards: int, sizes: dict[int, tuple[int, int]], tokens: int, least_count: int = LEAST_COUNT):
        self.least_count = least_count
        self.root, self.shards, self.word_shards, self.sizes = root, shards, word_shards, sizes
        self.tokens, self.distinct = tokens, sum(n for n, _ in sizes.values())
        self.words = max(1, sum(k for _, k in sizes.values()))
        self.two, self.three = np.zeros(shards, bool), np.zeros(0, bool)  # shards and units that have a file
        self.units = np.arange(shards + 1)  # the first unit of each shard
        self._vocabulary = self._levels = None

    def cut(self, tokens: np.ndarray) -> None:
        """Cuts level 3 of each shard, by tokens, into units: those of a middle word that is a large part of the corpus are
        dealt by first word, so that no unit grows with it."""
        self.units = np.concatenate(([0], np.cumsum(np.maximum(1, -(-tokens // UNIT)))))

    def unit_of(self, first: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """The unit of level 3 that holds the context (first, middle)."""
        shard = middle % self.shards
        parts = (self.units[shard + 1] - self.units[shard]).astype(np.uint64)
        return self.units[shard] + (mix64(first.astype(np.uint64)) % parts).astype(np.int64)

    def shard_of(self, unit: int) -> int:
        return int(np.searchsorted(self.units, unit, "right")) - 1

    def __getstate__(self):
        return self.__dict__ | {"_vocabulary": None, "_levels": None}

    @property
    def vocabulary(self) -> Vocabulary:
        if self._vocabulary is None:
            self._vocabulary = Vocabulary(self.root, self.word_shards, self.sizes, self.least_count)
        return self._vocabulary

    def level(self, order: int, shard: int):
        if self._levels is None:
            self._levels = {n: Mapped(lambda s, n=n, kind=kind: kind(map_arrays(f"{self.root}/level{n}-{s}"), self.words)) for n, kind in ((2, Level2), (3, Level3))}
        return self._levels[order][shard]

    def contexts(self, shard: int) -> int:
        return (self.words - shard + self.shards - 1) // self.shards

    def find2(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the level of the first word's shard or -1, log10 probability of the second given the first)."""
        place, logp = np.full(len(first), -1, np.int64), np.full(len(first), np.nan)
        for s, rows in self._by_shard(first):
            level = self.level(2, s)
            at, hit = level.find(first[rows] // self.shards, second[rows])
            place[rows[hit]] = at[hit]
            logp[rows[hit]] = dequantise(level.a["p"][at[hit]])
        return place, logp

    def back2(self, word: np.ndarray) -> np.ndarray:
        """log10 of the mass that a context word leaves to unigrams."""
        out = np.zeros(len(word))
        for s, rows in self._by_shard(word):
            out[rows] = dequantise(self.level(2, s).a["back"][word[rows] // self.shards])
        return out

    def seen2(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), np.int64)
        for s, rows in self._by_shard(first):
            level = self.level(2, s)
            at, hit = level.find(first[rows] // self.shards, second[rows])
            out[rows[hit]] = level.a["n"][at[hit]]
        return out

    def find_context(self, first: np.ndarray, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the context or -1, log10 of the mass it leaves to bigrams)."""
        place, back = np.full(len(first), -1, np.int64), np.zeros(len(first))
        for s, rows in rows_by(self.unit_of(first, middle)):
            if not self.three[s]:
                continue
            level = self.level(3, s)
            at, hit = level.before.successor(middle[rows] // self.shards * self.words + first[rows])
            place[rows[hit]] = at[hit]
            back[rows[hit]] = dequantise(level.a["back"][at[hit]])
        return place, back

    def find3(self, context: np.ndarray, first: np.ndarray, middle: np.ndarray, bigram: np.ndarray) -> np.ndarray:
        """log10 probability of the trigrams under known contexts (places of (first, middle)), NaN where there is none.
        bigram: place of (middle, last)."""
        out = np.full(len(context), np.nan)
        for s, rows in rows_by(self.unit_of(first, middle)):
            level, level2 = self.level(3, s), self.level(2, self.shard_of(s))
            c = middle[rows] // self.shards
            words, of = np.unique(c, return_inverse=True)
            left, begin, end, base = level2.start.access(words)[of], level.start.access(words)[of], level2.start.access(words + 1)[of], level.base.access(words)[of]
            at, hit = level.last.successor(base + (context[rows] - begin) * (end - left) + bigram[rows] - left)
            out[rows[hit]] = dequantise(level.a["p"][at[hit]])
        return out

    def _by_shard(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        return ((s, rows) for s, rows in rows_by(words % self.shards) if self.two[s])


class Stream:
    """The tokens of a slice of documents with their ends, as counts and word numbers."""

    def __init__(self, text: pa.Array, model: Model | None = None):
        tok = Tokens(text, lower=True)
        own = tok.word_hashes()
        self.lengths = np.diff(tok.offsets) + 1
        self.ends = np.cumsum(self.lengths)
        self.hash = np.full(int(self.ends[-1]) if len(self.ends) else 0, END, np.uint64)
        inner = np.ones(len(self.hash), bool)
        inner[self.ends - 1] = False
        if model is None:
            self.hash[inner] = own[tok.codes]
            return
        count, number = model.vocabulary.find(np.append(own, END))
        at = np.full(len(self.hash), len(own))
        at[inner] = tok.codes
        self.count, self.number = count[at], number[at]
        # places with a token before them in the same document, both words numbered; each different pair of the slice once
        self.first = np.zeros(len(self.hash), bool)
        self.first[self.ends - self.lengths] = True
        j = np.flatnonzero(~self.first)
        self.pair_at = j[(self.number[j] >= 0) & (self.number[j - 1] >= 0)]
        pairs, self.pair, self.pair_count = np.unique(at[self.pair_at - 1] * (len(own) + 1) + at[self.pair_at], return_inverse=True, return_counts=True)
        self.left, self.right = number[pairs // (len(own) + 1)], number[pairs % (len(own) + 1)]

    def pairs(self, model: Model) -> np.ndarray:
        """Looks every different pair up: gives its place or -1, and sets place and log10 p of each token (-1 and NaN where there is none)."""
        place, logp = model.find2(self.left, self.right)
        self.bigram, self.logp2 = np.full(len(self.hash), -1, np.int64), np.full(len(self.hash), np.nan)
        self.bigram[self.pair_at], self.logp2[self.pair_at] = place[self.pair], logp[self.pair]
        self.pair_number = np.zeros(len(self.hash), np.int64)
        self.pair_number[self.pair_at] = self.pair
        return place

    def triples(self) -> np.ndarray:
        """Places whose last two pairs are both in the model."""
        t = self.pair_at[self.bigram[self.pair_at] >= 0]
        t = t[t >= 2]
        return t[(self.bigram[t - 1] >= 0) & ~self.first[t - 1]]


def train(docs: DataFrame, shards: int | None = None, least_count: int = LEAST_COUNT) -> Model:
    """Counts the documents and writes the model into the shared folder. Null texts are empty: an end alone.

    Words, bigrams and trigrams that occur fewer than `least_count` times are counted, but have no entry of
    their own in the trie; 1 keeps all. Every one of them still has a probability, by the shorter context.
    Each order is counted once: a task adds up what it reads and sends it straight to the shard that keeps it.
    """
    spark = docs.sparkSession
    root = f"{shared_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    if not shards:
        characters = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        shards = max(SHARDS, -(-characters // (CHARACTERS * TOKENS)))
    word_shards = 1 << max(3, (shards // 2).bit_length())
    bits = word_shards.bit_length() - 1
    texts = docs.select("text")

    def words(batches):
        def parts():
            for b in chunks(batches):
                keys, counts = summed(Stream(b.column(0)).hash)
                yield (keys >> _U(64 - bits)).astype(np.int64), keys, counts

        yield from gathered(parts())

    def write_words(s, keys, counts):
        kept = counts >= least_count
        write_arrays(f"{root}/words-{s}", {"hash": keys, "count": counts, "rank": (np.cumsum(kept) - kept).astype(np.uint32), "kept": counts[kept]})
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(kept.sum())], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["shard", "n", "kept", "tokens"])

    rows = each_shard(texts.mapInArrow(words, BLOCKS), word_shards, write_words, "shard int, n long, kept long, tokens long").collect()  # a row for each shard
    model = Model(root, shards, word_shards, {r["shard"]: (r["n"], r["kept"]) for r in rows}, sum(r["tokens"] for r in rows), least_count)
    if model.words >= 1 << WORD_BITS:
        raise OverflowError(f"more than 2**{WORD_BITS} different words: raise least_count")

    def bigrams(batches):
        def parts():
            for b in chunks(batches):
                s = Stream(b.column(0), model)
                yield s.left % shards, (s.left // shards).astype(np.uint64) << _U(WORD_BITS) | s.right.astype(np.uint64), s.pair_count

        yield from gathered(parts())

    def write2(s, keys, counts):
        kept = counts >= least_count
        keys, counts = keys[kept], counts[kept]
        if len(keys) >= 1 << (64 - WORD_BITS):
            raise OverflowError(f"more than 2**{64 - WORD_BITS} bigrams in a shard: take more shards")
        if len(keys):
            write_arrays(f"{root}/level2-{s}", build2(model.vocabulary, s, shards, model.words, (model.tokens, model.distinct), keys, counts))
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([int(counts.sum())], pa.int64())], ["shard", "tokens"])

    rows = each_shard(texts.mapInArrow(bigrams, BLOCKS), shards, write2, "shard int, tokens long").collect()
    tokens = np.zeros(shards, np.int64)
    for r in rows:
        tokens[r["shard"]] = r["tokens"]
    model.two = tokens > 0
    model.cut(tokens)

    def trigrams(batches):
        def parts():
            for b in chunks(batches):
                s = Stream(b.column(0), model)
                s.pairs(model)
                t = s.triples()
                # each different triple of the slice once: its first pair and its last
                _, at, counts = np.unique(s.pair_number[t - 1] * len(s.left) + s.pair_number[t], return_index=True, return_counts=True)
                t = t[at]
                first, middle = s.number[t - 2], s.number[t - 1]
                yield model.unit_of(first, middle), s.bigram[t].astype(np.uint64) << _U(WORD_BITS) | first.astype(np.uint64), counts

        yield from gathered(parts())

    def write3(unit, keys, counts):
        kept = counts >= least_count
        if kept.any():
            s = model.shard_of(unit)
            level2 = model.level(2, s)
            t = build3(level2, model.contexts(s), keys[kept], counts[kept])
            # a token follows every pair of a text but the last, so with all n-grams kept a context was seen as often as what follows it
            seen = np.bincount(t["group"], t["counts"]) if least_count == 1 else model.seen2(t["first"], t["middle"] * shards + s).astype(float)
            write_arrays(f"{root}/level3-{unit}", _finish3(level2, t, model.words, seen))
            yield pa.RecordBatch.from_arrays([pa.array([unit], pa.int32())], ["unit"])

    units = int(model.units[-1])
    rows = each_shard(texts.mapInArrow(trigrams, BLOCKS), units, write3, "unit int").collect()
    model.three = np.isin(np.arange(units), [r["unit"] for r in rows])
    return model


def score_stream(text: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, known tokens, base score, model score) of each text."""
    s = Stream(text, model)
    base = log_unigram(s.count.astype(float), model.tokens, model.distinct)
    place = s.pairs(model)
    logp = base.copy()
    # a numbered word before: its bigram, or what it leaves to the unigram
    follows = np.flatnonzero(~s.first)
    follows = follows[s.number[follows - 1] >= 0]
    w, of = np.unique(s.number[follows - 1], return_inverse=True)
    two = s.logp2[follows]
    logp[follows] = np.where(np.isnan(two), model.back2(w)[of] + base[follows], two)
    # a known pair before: its trigram, or what it leaves to the above
    some = np.flatnonzero(place >= 0)
    context, back = np.full(len(place), -1, np.int64), np.zeros(len(place))
    context[some], back[some] = model.find_context(s.left[some], s.right[some])
    context_at, back_at = np.full(len(s.hash), -1, np.int64), np.zeros(len(s.hash))
    context_at[s.pair_at], back_at[s.pair_at] = context[s.pair], back[s.pair]
    under = follows[context_at[follows - 1] >= 0]
    three = np.full(len(under), np.nan)
    hit = np.flatnonzero(s.bigram[under] >= 0)
    t = under[hit]
    if len(t):
        # each different triple is looked up once
        _, one, back_to = np.unique(s.pair_number[t - 1] * len(place) + s.pair_number[t], return_index=True, return_inverse=True)
        one = t[one]
        three[hit] = model.find3(context_at[one - 1], s.number[one - 2], s.number[one - 1], s.bigram[one])[back_to]
    logp[under] = np.where(np.isnan(three), back_at[under - 1] + logp[under], three)
    begin = s.ends - s.lengths
    total = lambda x: np.add.reduceat(x, begin) if len(x) else np.zeros(0)
    return s.lengths, total((s.count > 0).astype(np.int64)), total(base), total(logp)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`.

    A null or empty text is its end alone. Without training documents every token has the probability of
    an unknown word, 1. Repeated rows are scored one by one; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # paths and sizes, no counts

    def run(batches):
        for b in chunks(batches):
            n, known, base, own = score_stream(b.column(1), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(known.astype(np.int64)), pa.array(np.full(len(n), sent.value.tokens, np.int64)), pa.array(base), pa.array(own)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of those not held out, see `train` and `score`; texts of any length are scored whole."""
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 7) == 2
    # a null doc_id is no training document, but is scored
    out = score(docs, train(docs.where(~held)))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
