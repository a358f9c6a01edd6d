"""SimHash near-duplicates by the generalised pigeonhole principle.

The bits are grouped into parts of correlated bits. For every fingerprint a dynamic programme gives
the parts unequal thresholds (-1: not probed) whose sum still guarantees that any fingerprint within the
distance agrees with it in some part, at the least estimated number of candidates. Fingerprints are
indexed under each part, probed and verified; links become components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mix64, stored, table, whole_rows
from .graph import Forest, components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Parts of the 64 bits; a histogram of each part's values goes to every task (parts * 2**(64/parts) counts:
#: 2 MB for four parts, 64 MB for three, which suit more than MANY fingerprints). Both find the same links.
PARTS, MANY = 4, 1 << 27
#: Fingerprints of one bucket compared in one task; larger buckets are cut into blocks.
BLOCK = 4096
#: Cost of sending a probe, in comparisons.
PROBE_COST = 12.0


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit k is set if bit k is set in over half of the shingles' hashes."""
    return fingerprint_words(text, shingle, (seed,))[0]


def shingles_of(text: str | None, shingle: int) -> list[bytes]:
    """Every run of `shingle` lower-case words; all words as one if there are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    return [line[s:e] for s, e in zip(starts.tolist(), ends[k - 1 :].tolist(), strict=False)]


def fingerprint_words(text: str | None, shingle: int, seeds: tuple[int, ...]) -> list[int]:
    """64 bits of fingerprint for each seed of the hash."""
    shingles = shingles_of(text, shingle)
    if not shingles:
        return [0] * len(seeds)
    digest, out = xxhash.xxh64_intdigest, []
    for seed in seeds:
        ones = np.zeros(64, np.int64)
        for i in range(0, len(shingles), 1 << 16):
            hashes = np.array([digest(x, seed) for x in shingles[i : i + (1 << 16)]], np.uint64)
            ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big"))
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """doc_id and fp0, fp1, ... (a long for each seed) of every row of `docs`; no words give 0."""
    names = [f"fp{k}" for k in range(len(seeds))]

    def run(batches):
        for b in chunks(batches):
            fp = np.array([fingerprint_words(t, shingle, seeds) for t in b.column(1).to_pylist()], np.uint64).reshape(-1, len(seeds))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fp.T)], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def group_bits(both: np.ndarray, ones: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Parts of bits: each starts with the most correlated pair left and takes the bits closest to it."""
    p = ones / max(1, n)
    cov = both / max(1, n) - np.outer(p, p)
    sd = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    near = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(near, -1)
    total = len(ones)
    left, out = list(range(total)), []
    for k in range(parts):
        width = (total * (k + 1)) // parts - (total * k) // parts
        sub = near[np.ix_(left, left)]
        i, j = np.unravel_index(int(np.argmax(sub)), sub.shape)
        part = [left[i], left[j]]
        while len(part) < width:
            rest = [b for b in left if b not in part]
            part.append(rest[int(np.argmax(near[np.ix_(rest, part)].mean(1)))])
        left = [b for b in left if b not in part]
        out.append(sorted(part))
    return out


def part_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """fp: rows of 64-bit words; bit b is bit b % 64 of word b // 64."""
    out = np.zeros(len(fp), np.int64)
    for k, b in enumerate(bits):
        out |= ((fp[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64) << k
    return out


class Index:
    """The parts, the histograms of their values, and the estimated candidates of each threshold."""

    def __init__(self, parts: list[list[int]], counts: list[np.ndarray], units: int, most: int = 2):
        self.parts, self.units, self.counts = parts, units, counts
        self.most = min(most, units - 1)  # largest threshold of a part
        self._near = None

    def __getstate__(self):
        return self.__dict__ | {"_near": None}

    @property
    def near(self) -> list[list[np.ndarray]]:
        """Indexed fingerprints within each threshold of a value; derived from the counts where it is used, not sent."""
        if self._near is None:
            self._near = []
            for bits, c in zip(self.parts, self.counts, strict=True):
                held, at = [c.astype(np.float64)], np.arange(len(c))
                for t in range(1, self.most + 1):
                    more = held[-1].copy()
                    for m in self.masks(len(bits), t):
                        more += c[at ^ m]
                    held.append(more)
                self._near.append(held)
        return self._near

    @staticmethod
    def masks(width: int, t: int) -> list[int]:
        return [sum(1 << b for b in c) for c in combinations(range(width), t)]

    def thresholds(self, values: list[np.ndarray]) -> np.ndarray:
        """Thresholds (parts x fingerprints, -1: none) of least cost. A part with threshold t uses t + 1 units;
        distance + 1 units make sure of every pair within the distance."""
        n, units = len(values[0]), self.units
        if units == len(self.parts) * (self.most + 1):  # enough for every part
            return np.full((len(self.parts), n), self.most, np.int64)
        cost = np.full((units + 1, n), np.inf)
        cost[0] = 0
        choice = np.zeros((len(self.parts), units + 1, n), np.int8)
        for i, v in enumerate(values):
            probes = np.cumsum([0] + [len(self.masks(len(self.parts[i]), t)) for t in range(1, self.most + 1)])
            new = np.full((units + 1, n), np.inf)
            for use in range(self.most + 2):
                own = 0.0 if not use else self.near[i][use - 1][v] + PROBE_COST * probes[use - 1]
                for u in range(use, units + 1):
                    c = cost[u - use] + own
                    better = c < new[u]
                    new[u][better] = c[better]
                    choice[i, u][better] = use
            cost = new
        out, u = np.zeros((len(self.parts), n), np.int64), np.full(n, units)
        for i in reversed(range(len(self.parts))):
            use = choice[i, u, np.arange(n)]
            out[i] = use - 1
            u = u - use
        return out

    def posts(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket, kind, row): kind 0 is indexed, 1 probes, 2 does both."""
        values = [part_values(fp, bits) for bits in self.parts]
        limits = self.thresholds(values)
        rows = np.arange(len(fp))
        for i, v in enumerate(values):
            yield from self.placed(i, v, v, rows, np.where(limits[i] >= 0, 2, 0), fp)
            for t in range(1, self.most + 1):
                far = np.flatnonzero(limits[i] >= t)
                if len(far):
                    for m in self.masks(len(self.parts[i]), t):
                        held = far[self.counts[i][v[far] ^ m] > 0]
                        yield from self.placed(i, v[held] ^ m, v[held], held, np.ones(len(held), np.int64), fp)

    def placed(self, i, at, own, rows, kind, fp):
        """Buckets of at most BLOCK indexed fingerprints by BLOCK probing ones: large ones are a grid of blocks."""
        size = self.counts[i][at]
        key = (np.int64(i) << np.int64(40)) + at
        small = size <= BLOCK
        yield mix64(key[small].view(np.uint64)).view(np.int64), kind[small], rows[small]
        big = np.flatnonzero(~small)
        if not len(big):
            return
        spread = mix64(fp[rows[big], 0] ^ np.uint64(0x5BD1E995)).astype(np.float64) / 2.0**64
        down = -(-size[big] // BLOCK)
        across = np.maximum(1, np.ceil(self.near[i][min(1, self.most)][at[big]] / BLOCK)).astype(np.int64)
        for acts, lines, mine, others in ((kind[big] != 1, 0, down, across), (kind[big] != 0, 1, across, down)):
            b = np.flatnonzero(acts)
            copies = others[b]
            r = np.repeat(b, copies)
            other = np.arange(len(r)) - np.repeat(np.cumsum(copies) - copies, copies)
            block = (spread[r] * mine[r]).astype(np.int64)
            d, a = (block, other) if lines == 0 else (other, block)
            cell = mix64(key[big][r].view(np.uint64)) + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + a.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            yield mix64(cell + np.uint64(1)).view(np.int64), np.full(len(r), lines, np.int64), rows[big][r]


def build_index(distinct: DataFrame, n: int, units: int, parts: int, names: list[str]) -> Index:
    """Counts over all distinct fingerprints: pairs of bits first, then the values of each part.

    The driver gets a number for each pair of bits, and at most 2**width for each part.
    """
    total = 64 * len(names)
    fps = distinct.select(*names)

    def words(b):
        return np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).view(np.uint64)

    def pairs(batches):
        sums = np.zeros((total, total), np.int64)
        for b in batches:
            fp = words(b)
            for i in range(0, len(fp), 1 << 14):
                part = fp[i : i + (1 << 14)]
                bits = ((part[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).reshape(len(part), total).astype(np.float32)
                sums += (bits.T @ bits).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total * total, dtype=np.int32)), pa.array(sums.ravel())], ["cell", "n"])

    got = fps.mapInArrow(pairs, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros(total * total)
    both[got["cell"].to_numpy(int)] = got["n"].to_numpy(float)
    both = both.reshape(total, total)
    bits = group_bits(both, np.diag(both), n, parts)

    def values(batches):
        sums = [np.zeros(1 << len(b), np.int64) for b in bits]
        for b in batches:
            fp = words(b)
            for s, own in zip(sums, bits, strict=True):
                s += np.bincount(part_values(fp, own), minlength=len(s))
        for i, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(s[at])], ["part", "value", "n"])

    got = fps.mapInArrow(values, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
    counts = [np.zeros(1 << len(b), np.int64) for b in bits]
    for i, c in enumerate(counts):
        own = got[got["part"] == i]
        c[own["value"].to_numpy(int)] = own["n"].to_numpy(int)
    return Index(bits, counts, units)


def verified(key: np.ndarray, fp: np.ndarray, ids: np.ndarray, kind: np.ndarray, distance: int, forest: Forest, step: int = 1 << 21) -> None:
    """Compares probing with indexed fingerprints of each bucket (equal keys, sorted) and adds the links."""
    cut = np.flatnonzero(np.diff(key)) + 1
    begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
    order = np.lexsort((kind, key))  # indexed, probing, both
    fp, ids, kind = fp[order], ids[order], kind[order]
    n0 = np.add.reduceat((kind == 0).astype(np.int64), begin)
    n1 = np.add.reduceat((kind == 1).astype(np.int64), begin)
    # a bucket lies as [indexed][probing][both]: probes are the last two, what they meet the first and the last
    probes, met = end - begin - n0, end - begin - n1
    pairs = probes * met
    todo = np.flatnonzero((pairs > 0) & (end - begin > 1))
    at = 0
    while at < len(todo):
        total = np.cumsum(pairs[todo[at : at + 100_000]])
        k = max(1, int(np.searchsorted(total, step, "right")))
        some = todo[at : at + k]
        at += k
        if k == 1 and pairs[some[0]] > step:
            g = int(some[0])
            p = np.arange(begin[g] + n0[g], end[g])
            d = np.concatenate((np.arange(begin[g], begin[g] + n0[g]), np.arange(begin[g] + n0[g] + n1[g], end[g])))
            own = Forest()
            for i in range(0, len(p), max(1, step // len(d))):
                q = p[i : i + max(1, step // len(d))]
                x, y = np.nonzero(sum(np.bitwise_count(w[q][:, None] ^ w[d][None, :]).astype(np.int16) for w in fp.T) <= distance)
                own.add(ids[q[x]], ids[d[y]])
            forest.add(*own.edges())
            continue
        width = pairs[some]
        g = np.repeat(some, width)
        j = np.arange(len(g)) - np.repeat(np.cumsum(width) - width, width)
        p = begin[g] + n0[g] + j // met[g]
        d = j % met[g]
        d = begin[g] + np.where(d < n0[g], d, d + n1[g])
        hit = np.flatnonzero(sum(np.bitwise_count(w[p] ^ w[d]).astype(np.int16) for w in fp.T) <= distance)
        hit = hit[ids[p[hit]] != ids[d[hit]]]
        forest.add(ids[p[hit]], ids[d[hit]])


def links(distinct: DataFrame, n: int, distance: int = DISTANCE, parts: int | None = None) -> DataFrame:
    """Edges a, b that connect all fingerprints (columns fp0, fp1, ... and id) within the distance of each other."""
    names = [c for c in distinct.columns if c.startswith("fp")]
    index = build_index(distinct, n, distance + 1, parts or len(names) * (PARTS if n < MANY else PARTS - 1), names)
    return met(distinct, names, index, distance)


def met(distinct: DataFrame, names: list[str], index: Index, distance: int, compared: int | None = None) -> DataFrame:
    """Edges a, b that connect the fingerprints that meet in a part and differ in at most `distance` bits of
    the first `compared` words (all by default).

    A task gives one edge for each fingerprint it can link, not the pairs, so a large group of near
    copies stays linear in its size.
    """
    sent = distinct.sparkSession.sparkContext.broadcast(index)  # histograms, size fixed by the parts
    carried = names[:compared]
    row = ", ".join(f"{c} long" for c in carried)

    def post(batches):
        for b in batches:
            for i in range(0, b.num_rows, 10_000):
                ids, *fps = (c.to_numpy(zero_copy_only=False) for c in b.slice(i, 10_000).columns)
                fp = np.stack(fps, 1)
                for bucket, kind, rows in sent.value.posts(fp.view(np.uint64)):
                    if len(rows):
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ids[rows]), pa.array(kind.astype(np.int8)), *(pa.array(c[rows]) for c in fps[:compared])], ["bucket", "id", "kind", *carried])

    def meet(batches):
        forest, held = Forest(), None

        def check(cols):
            verified(cols[0], np.stack(cols[3:], 1).view(np.uint64), cols[1], cols[2], distance, forest)

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last bucket may go on
            if last:
                check([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None and len(held[0]):
            check(held)
        a, b = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    posts = distinct.select("id", *names).mapInArrow(post, f"bucket long, id long, kind byte, {row}")
    return posts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long")


def clusters(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """doc_id, fp0, ..., component_id of every row of `docs`.

    Equal fingerprints meet first, as one entry with their smallest doc_id; texts without words have the
    fingerprint 0 and are linked like any other. Rows with the same doc_id keep their own fingerprints,
    and are linked through their id. A null doc_id is never the smallest; a fingerprint that only such
    rows have is a component without id. An empty table gives no rows.
    """
    names = [f"fp{k}" for k in range(len(seeds))]
    fps = stored(fingerprints(docs, shingle, seeds), "fingerprints")
    distinct = stored(fps.groupBy(*names).agg(F.min("doc_id").alias("id")).where("id is not null"), "distinct-fingerprints")
    labels = components(links(distinct, distinct.count(), distance))
    found = distinct.join(labels, F.col("id") == F.col("node"), "left").select(*names, F.coalesce("component", "id").alias("component_id"))
    return fps.join(found, names, "left").select("doc_id", *names, "component_id")


#: For similar texts rather than nearly equal fingerprints: five-word shingles.
WIDE_SHINGLE, SIMILARITY = 5, 0.8
#: Words of 64 bits; of these, words compared; parts drawn from all bits (a bit is in one or two), and their width.
WIDE_WORDS, COMPARED, WIDE_PARTS, WIDTH = 8, 4, 56, 14
#: Standard deviations above the mean distance of texts at the similarity that a candidate may have.
SPREAD = 3.0
#: One in so many fingerprints is counted to foresee large buckets; what meets does not depend on it.
COUNTED = 16
#: Texts, and hashes of shingles, of a block in which texts are held against each other.
TEXTS, HASHES = 1024, 1 << 21
_SALTS = mix64(np.arange(1, WIDE_WORDS + 1, dtype=np.uint64))


def bits_apart(similarity: float, bits: int, spread: float = 0.0) -> int:
    """Bits in which two texts with this Jaccard similarity of shingle sets (of one size, the worst case) differ
    on average, and `spread` standard deviations more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * p + spread * math.sqrt(bits * p * (1 - p)))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(x, SEED) for x in set(shingles_of(text, shingle))], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE_WORDS words: bit k is set if bit k is set in over half of the hashes, each mixed anew for every word."""
    ones = np.zeros(64 * WIDE_WORDS, np.int64)
    for i in range(0, len(hashes), 4080):
        bits = np.unpackbits(mix64(hashes[i : i + 4080, None] ^ _SALTS).view(np.uint8), axis=1)
        for j in range(0, len(bits), 255):
            ones += bits[j : j + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(np.uint64)


def wide_index(distinct: DataFrame, names: list[str]) -> Index:
    """Parts of random bits, probed as they are; the histograms come from one in COUNTED fingerprints."""
    rng = np.random.default_rng(SEED)
    total = 64 * len(names)
    drawn = np.concatenate([rng.permutation(total)[: total - total % WIDTH] for _ in range(-(-WIDE_PARTS * WIDTH // total) + 1)])
    bits = drawn[: WIDE_PARTS * WIDTH].reshape(WIDE_PARTS, WIDTH).tolist()

    def values(batches):
        for b in batches:
            fp = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).view(np.uint64)
            for i, own in enumerate(bits):
                at, n = np.unique(part_values(fp, own), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at), pa.array(n)], ["part", "value", "n"])

    some = distinct.where(F.pmod(F.xxhash64("id"), F.lit(COUNTED)) == 0).select(*names)
    got = some.mapInArrow(values, "part int, value long, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toPandas()
    counts = [np.zeros(1 << WIDTH, np.int64) for _ in bits]
    for i, c in enumerate(counts):
        own = got[got["part"] == i]
        c[own["value"].to_numpy(int)] = COUNTED * own["n"].to_numpy(int)
    return Index(bits, counts, WIDE_PARTS, 0)


def similar_in(sets: list[np.ndarray], fp: np.ndarray, ids: np.ndarray, right: np.ndarray | None, similarity: float, distance: int, forest: Forest) -> None:
    """Adds links that connect all texts of a group that are similar: each against each, or, if `right` marks
    some, those that are not marked against those that are. Texts connected before are not compared."""
    size = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begin = np.cumsum(size) - size
    mark = np.zeros(len(codes) + 1, bool)
    label = np.unique(ids, return_inverse=True)[1]
    for i in range(len(sets)) if right is None else np.flatnonzero(~right).tolist():
        j = np.arange(i + 1, len(sets)) if right is None else np.flatnonzero(right)
        j = j[label[j] != label[i]]
        j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i]) - 1e-9]
        j = j[np.bitwise_count(fp[j] ^ fp[i]).sum(1, dtype=np.int64) <= distance]
        own = codes[begin[i] : begin[i] + size[i]]
        mark[own] = True
        for k in range(0, len(j), 256):
            part = j[k : k + 256]
            ends = np.cumsum(size[part])
            at = np.arange(ends[-1]) + np.repeat(begin[part] - ends + size[part], size[part])
            both = np.add.reduceat(mark[codes[at]].astype(np.int64), ends - size[part]) if size[i] else np.zeros(len(part), np.int64)
            hit = part[both >= similarity * (size[i] + size[part] - both) - 1e-9]
            forest.add(np.full(len(hit), ids[i]), ids[hit])
            for old in np.unique(label[hit]):
                label[label == old] = label[i]
        mark[own] = False


def similar(docs: DataFrame, groups: DataFrame, similarity: float, shingle: int, distance: int) -> DataFrame:
    """Edges a, b that connect the texts of one group (groups: node, component) whose shingle sets have a
    Jaccard similarity of at least `similarity`.

    A large group is a triangle of blocks: a text goes to every pair of blocks that holds its own. A task
    gives one edge for each text it can link.
    """

    def sets(batches):
        for b in chunks(batches):
            found = [shingle_set(t, shingle) for t in b.column(2).to_pylist()]
            fp = [wide_fingerprint(s)[:COMPARED].tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array(fp, pa.binary())], ["component", "id", "n", "hashes", "fp"])

    def hold(batches):
        forest, rest = Forest(), None

        def work(t: pa.Table):
            component, lo, hi, own, ids = (t.column(k).to_numpy() for k in range(5))
            raw = t.column(5).to_pylist()
            fp = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint64).reshape(len(raw), COMPARED)
            change = np.flatnonzero((np.diff(component) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), len(raw)], strict=True):
                if e - s > 1:
                    right = own[s:e] == hi[s] if lo[s] != hi[s] else None
                    similar_in([np.frombuffer(r, np.uint64) for r in raw[s:e]], fp[s:e], ids[s:e], right, similarity, distance, forest)

        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks()
            key = [t.column(k).to_numpy() for k in range(3)]
            cut = int(np.flatnonzero(np.any([k != k[-1] for k in key], 0))[-1]) + 1 if any((k != k[-1]).any() for k in key) else 0
            if cut:
                work(t.slice(0, cut))
            rest = t.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            work(rest)
        a, b = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(groups, F.col("id") == F.col("node")).select("component", "id", "text")
    made = stored(texts.mapInArrow(sets, "component long, id long, n long, hashes binary, fp binary"), "shingle-sets")
    sizes = made.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / TEXTS), F.ceil(F.sum("n") / HASHES)).cast("int").alias("parts"))
    full = made.join(sizes, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    full = full.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "hashes", "fp")
    return full.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").mapInArrow(hold, "a long, b long")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """`docs` with one document of each group of similar texts: the one with the smallest doc_id.

    Fingerprints only find candidates: texts that agree in one of the parts and differ in no more compared bits
    than SPREAD standard deviations above the mean at that similarity. All texts that candidates connect are
    then held against each other, and two are linked only if the Jaccard similarity of their sets of
    shingles (as 64-bit hashes) is at least `similarity`. The parts are the same for a table of any size;
    a pair at 0.8 without others like it is found with a probability of 0.995. Equal sets are one text, and so
    are texts without words. Rows that repeat the kept doc_id are one document and all stay; rows with a
    null doc_id stay.
    """
    names = [f"fp{k}" for k in range(WIDE_WORDS)]

    def run(batches):
        for b in chunks(batches):
            found = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            fp = np.array([wide_fingerprint(s) for s in found], np.uint64).reshape(-1, WIDE_WORDS)
            key = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), key, *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fp.T)], ["doc_id", "key", *names])

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key binary, " + ", ".join(f"{n} long" for n in names))
    fps = stored(made, "fingerprints")
    distinct = stored(fps.groupBy("key").agg(F.min("doc_id").alias("id"), *(F.first(n).alias(n) for n in names)).where("id is not null"), "distinct-fingerprints")
    distance = bits_apart(similarity, 64 * COMPARED, SPREAD)
    groups = components(met(distinct.select("id", *names), names, wide_index(distinct, names), distance, COMPARED))
    labels = components(similar(docs, groups, similarity, shingle, distance))
    found = distinct.join(labels, F.col("id") == F.col("node"), "left").select("key", F.coalesce("component", "id").alias("component_id"))
    gone = fps.join(found, "key").where("component_id <> doc_id").select(F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(whole_rows(docs), F.col("doc_id").cast("long").alias("row_id"))
    return rows.join(gone, F.col("row_id") == F.col("gone_id"), "left_anti").select("whole.*")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, see `clusters`; texts of any length are shingled whole."""
    out = clusters(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")
