"""Embedding near-duplicates by lattice hashing.

Every vector is projected at random into a few blocks of eight dimensions, in several tables; each block
is decoded to the nearest point of the E8 lattice. A vector is posted under its own cell and under
neighbouring cells; vectors that share a cell are compared by cosine in double precision.
"""

from __future__ import annotations

import hashlib
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import mix64, stored, table
from .graph import HUBS, Forest, components

COSINE = 0.95
#: Tables; blocks of a table, the same for every number of vectors; vectors of a cell compared in one task.
TABLES, BLOCKS, BLOCK = 5, 2, 512
#: Scale of a unit vector of LENGTH entries and more against the lattice.
SCALE, LENGTH = 4.0, 64


def scale_of(length: int) -> float:
    """Shorter vectors keep more of their distance in eight dimensions, so their scale is smaller."""
    return SCALE * min(1.0, (max(length, 8) / LENGTH) ** 0.5)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


ROOTS = _roots()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer vectors with an even sum: round, and where the sum is odd turn the worst entry."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(np.mod(r.sum(1), 2) == 1)
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by halves: the closer of both answers."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


class Lattice:
    """Random projections of vectors of one length, and the cells of a vector in every table."""

    def __init__(self, length: int, blocks: int, tables: int = TABLES, scale: float | None = None, seed: int = 11):
        self.blocks, self.tables = blocks, tables
        rng = np.random.default_rng([seed, length])
        wide = max(length, 8)
        scale = scale_of(length) if scale is None else scale
        self.frames = [np.linalg.qr(rng.standard_normal((wide, 8)))[0][:length] * scale for _ in range(blocks * tables)]
        self.weights = rng.integers(1, 1 << 62, (blocks, 8)).astype(np.uint64) | np.uint64(1)
        self.salt = rng.integers(1, 1 << 62, tables).astype(np.uint64)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """n x tables x (1 + blocks + pairs of blocks) cell numbers: the own cell, then those with the
        nearest neighbouring lattice point in one block, or in two."""
        out = []
        for t in range(self.tables):
            own, other = [], []
            for k in range(self.blocks):
                y = unit @ self.frames[t * self.blocks + k]
                p = nearest_e8(y)
                q = p + ROOTS[np.argmax((y - p) @ ROOTS.T, 1)]
                for held, c in ((own, p), (other, q)):
                    held.append(((2 * c).astype(np.int64).view(np.uint64) * self.weights[k]).sum(1, dtype=np.uint64))
            swaps = [(), *((k,) for k in range(self.blocks)), *combinations(range(self.blocks), 2)]
            out.append(np.stack([mix64(sum(other[k] if k in s else own[k] for k in range(self.blocks)) + self.salt[t]) for s in swaps], 1))
        return np.stack(out, 1).view(np.int64)


def usable(rows: pa.Array) -> list[np.ndarray | None]:
    """Vectors in double precision; None for null, empty, zero, or null or non-finite components."""
    out = []
    for v in rows:
        x = None
        if v.is_valid and len(v.values) and not v.values.null_count:
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            x = x if np.isfinite(x).all() and x.any() else None
        out.append(x)
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _keyed(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """vec_id, key (a digest of the exact vector, null if unusable) and v (its entries, as doubles, or as
    floats where the column holds floats)."""
    kind = "<f4" if vectors.schema[column].dataType == ArrayType(FloatType(), vectors.schema[column].dataType.containsNull) else "<f8"

    def run(batches):
        for b in batches:
            xs = usable(b.column(1))
            raw = [None if x is None else (x + 0.0).astype(kind).tobytes() for x in xs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary()), pa.array(raw, pa.binary()), pa.array([kind] * len(xs))], ["vec_id", "key", "v", "kind"])

    return vectors.select(F.col(id_column).cast("long").alias("vec_id"), column).mapInArrow(run, "vec_id long, key binary, v binary, kind string")


def unit_vectors(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit rows, in double precision, of vectors of one length."""
    return unit_rows(np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64))


def _pairs_in(groups, bucket, block, unit, cells, ids, weight, cosine, forest, count):
    """Compares the rows of each group, and counts a link only in the first cell in which a pair meets."""

    def link(i, j):
        hit = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
        i, j = i[hit], j[hit]
        if not len(i):
            return
        here = bucket[i]
        shared = cells[i][:, :, :, None] == cells[j][:, :, None, :]  # pairs x tables x cells x cells
        first = shared.any((2, 3)).argmax(1)
        at = np.arange(len(i))
        least = np.where(shared[at, first].any(2), cells[i][at, first], np.iinfo(np.int64).max).min(1)
        forest.add(ids[i], ids[j])
        own = np.flatnonzero(least == here)
        np.add.at(count, i[own], weight[j[own]])
        np.add.at(count, j[own], weight[i[own]])

    held_i, held_j, size = [], [], 0
    for begin, end, cross in groups:
        rows = np.arange(begin, end)
        left = rows[block[begin:end] == 0] if cross else rows
        right = rows[block[begin:end] == 1] if cross else rows
        for k in range(0, len(left), 256):  # bounds what is held of a large group
            a = left[k : k + 256]
            if len(a) * len(right) > 20_000:  # a matrix product first, pairs only for what may link
                x, y = np.nonzero(unit[a] @ unit[right].T >= cosine - 1e-9)
            else:
                x, y = np.divmod(np.arange(len(a) * len(right)), len(right))
            i, j = a[x], right[y]
            if not cross:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 40_000):
                held_i.append(i[s : s + 40_000])
                held_j.append(j[s : s + 40_000])
                size += len(held_i[-1])
                if size >= 40_000:
                    link(np.concatenate(held_i), np.concatenate(held_j))
                    held_i, held_j, size = [], [], 0
    if size:
        link(np.concatenate(held_i), np.concatenate(held_j))


def with_cells(classes: DataFrame, blocks: int, tables: int) -> DataFrame:
    """`classes` (id, w, v, kind) and their cells, a list of tables * (cells of a table) numbers."""

    def run(batches):
        lattices: dict[int, Lattice] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                b = batch.slice(i, 2000)
                raw, kinds = b.column(2).to_pylist(), b.column(3).to_pylist()
                lengths = np.array([len(r) // np.dtype(k).itemsize for r, k in zip(raw, kinds, strict=True)])
                cells: list = [None] * len(raw)
                for n in np.unique(lengths).tolist():
                    rows = np.flatnonzero(lengths == n)
                    lattice = lattices.setdefault(n, Lattice(n, blocks, tables))
                    for r, c in zip(rows, lattice.cells(unit_vectors([raw[r] for r in rows], kinds[0])).reshape(len(rows), -1), strict=True):
                        cells[r] = c
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(pa.int64()))], ["id", "w", "v", "kind", "cells"])

    return classes.select("id", "w", "v", "kind").mapInArrow(run, "id long, w long, v binary, kind string, cells array<long>")


def links(classes: DataFrame, blocks: int, tables: int, cosine: float, most: int = BLOCK) -> DataFrame:
    """a, b, n: rows with b connect linked classes (a spanning forest for each task); the others add n to
    the number of vectors that class a links with. classes: id, v, kind, w (vectors in the class).

    Cells are matched by number and id alone; vectors join the ids whose cell holds another vector.
    """

    def meet(batches):
        forest, counts, rest = Forest(), {}, None

        def work(t: pa.Table):
            bucket, lo, hi, own, ids, w = (t.column(k).to_numpy() for k in range(6))
            raw, kind = t.column(6).to_pylist(), t.column(7)[0].as_py()
            lengths = np.array([len(r) for r in raw])
            cells = t.column(8).combine_chunks().flatten().to_numpy().reshape(len(raw), tables, -1)
            change = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0)) + 1
            edges = np.concatenate(([0], change, [len(bucket)]))
            keep = np.flatnonzero(np.diff(edges) > 1)
            count = np.zeros(len(ids), np.int64)
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                unit = np.zeros((len(raw), n // np.dtype(kind).itemsize))
                unit[at] = unit_vectors([raw[r] for r in at], kind)
                # cells of different lengths differ by the seed, so a group holds one length
                groups = [(int(edges[k]), int(edges[k + 1]), bool(lo[edges[k]] != hi[edges[k]])) for k in keep if lengths[edges[k]] == n]
                _pairs_in(groups, bucket, (own == hi).astype(int), unit, cells, ids, w, cosine, forest, count)
            some = np.flatnonzero(count)
            for i, c in zip(ids[some].tolist(), count[some].tolist(), strict=True):
                counts[i] = counts.get(i, 0) + c

        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])]).combine_chunks()
            last = t.column("bucket")[t.num_rows - 1].as_py()
            cut = int(np.searchsorted(t.column("bucket").to_numpy(), last, "left"))
            if cut:
                work(t.slice(0, cut))
            rest = t.slice(cut).combine_chunks()
        if rest is not None and rest.num_rows:
            work(rest)
        a, b = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(len(a), np.int64))], ["a", "b", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array([None] * len(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["a", "b", "n"])

    source = stored(with_cells(classes, blocks, tables), "vector-cells")
    posts = source.select(F.explode(F.array_distinct("cells")).alias("bucket"), "id")
    sizes = stored(posts.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "cell-sizes")
    # cells with more than 1 in HUBS posts are HUBS at most: their size goes by broadcast, not their posts to one task
    least = max(most, source.count() * tables * (1 + blocks + blocks * (blocks - 1) // 2) // HUBS)
    large = F.broadcast(sizes.where(F.col("size") > least))
    others = posts.join(large.select("bucket"), "bucket", "left_anti").join(sizes.where(F.col("size") <= least), "bucket")
    held = posts.join(large, "bucket").unionByName(others)
    # a large cell is a triangle of blocks: a row goes to every pair of blocks that holds its own
    held = held.withColumn("parts", F.ceil(F.col("size") / most).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = held.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id")
    full = held.join(source, "id").select("bucket", "lo", "hi", "own", "id", "w", "v", "kind", "cells")
    return full.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(meet, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", cosine: float = COSINE, tables: int = TABLES, blocks: int = BLOCKS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `vectors`.

    Equal vectors form one class, compared once. Vectors that are null, empty, zero or hold null or
    non-finite components, and vectors of different lengths, link with nothing. A repeated row counts as
    another vector. Rows with one vec_id and different vectors are linked through their id. An empty
    table gives no rows.
    """
    keyed = stored(_keyed(vectors, id_column, column), "vectors")
    classes = stored(keyed.where("key is not null and vec_id is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("v").alias("v"), F.first("kind").alias("kind")), "vector-classes")
    found = stored(links(classes, blocks, tables, cosine), "vector-links")
    linked = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others"))
    labels = components(found.where("b is not null").select("a", "b"))
    known = classes.select("key", "id", "w").join(linked, F.col("id") == F.col("a"), "left").drop("a").join(labels, F.col("id") == F.col("node"), "left")
    known = known.select(F.col("key").alias("class_key"), (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component"))
    out = keyed.select("vec_id", "key").join(known, F.col("key") == F.col("class_key"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector of `embeddings`; unusable ones (null, zero, non-finite) link with nothing, repeated rows are one class."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs, in double precision.
OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v WHERE list_inner_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.a),
c AS (SELECT a, MIN(c) AS component_id FROM r GROUP BY a),
l AS (SELECT a, COUNT(*) AS n FROM p GROUP BY a)
SELECT e.vec_id, COALESCE(l.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN l ON l.a = e.vec_id
"""
