"""Lloyd's clustering on integers with an exact annulus search for the nearest centroid.

Centroids are sorted by norm. A vector's distance to the centroid of the nearest norm bounds its distance
to the nearest one; by the triangle inequality only centroids whose norms differ from the vector's by no more
than that can be nearer. Binary searches find this annulus, and the vector is compared exactly with what lies in it.
Partitions send sums for each cluster, not vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LENGTH, CLUSTERS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Largest component that is certain to keep squared distances of LENGTH components within 64 bits.
LARGEST = 1 << 27
#: Vectors handled at once.
ROWS = 1 << 14
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(rows: pa.Array, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and their components as floor(SCALE * x): exactly `length` components, all finite numbers."""
    full = pc.equal(pc.fill_null(pc.list_value_length(rows), -1), length).to_numpy(zero_copy_only=False)
    x = rows.filter(pa.array(full)).flatten().cast(pa.float64())
    x = pc.fill_null(x, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, length)
    finite = np.isfinite(x).all(1)
    x = np.floor(SCALE * x[finite])
    if len(x) and np.abs(x).max() > LARGEST:
        raise OverflowError(f"a component above {LARGEST // SCALE}: squared distances would not fit into 64 bits")
    full[np.flatnonzero(full)[~finite]] = False
    return np.flatnonzero(full), x.astype(np.int64)


class Annulus:
    """Centroids (rows of integers) in the order of their norms."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids * centroids).sum(1)
        self.order = np.argsort(squares, kind="stable")
        self.sorted, self.norms = centroids[self.order], np.sqrt(squares[self.order].astype(np.float64))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of every row; of equally near ones the smallest number."""
        norm = np.sqrt((x * x).sum(1).astype(np.float64))
        above = np.searchsorted(self.norms, norm).clip(0, len(self.norms) - 1)
        below = (above - 1).clip(0)
        first = np.where(norm - self.norms[below] < self.norms[above] - norm, below, above)
        gap = x - self.sorted[first]
        best, number = (gap * gap).sum(1), self.order[first]
        # roots are rounded: the annulus is a little wider, so that ties on its border stay inside
        reach = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (norm + reach) + 1e-6
        low = np.searchsorted(self.norms, norm - reach - slack, "left")
        high = np.searchsorted(self.norms, norm + reach + slack, "right")
        for j in range(len(self.order)):
            rows = np.flatnonzero((low <= j) & (j < high))
            if len(rows):
                gap = x[rows] - self.sorted[j]
                far = (gap * gap).sum(1)
                nearer = (far < best[rows]) | ((far == best[rows]) & (self.order[j] < number[rows]))
                best[rows[nearer]], number[rows[nearer]] = far[nearer], self.order[j]
        return number, best


def slices(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of (id, vector) in slices: the slice, its kept rows and their integers."""
    for b in batches:
        for i in range(0, b.num_rows, ROWS):
            part = b.slice(i, ROWS)
            yield part, *integers(part.column(1))


def starts(vectors: DataFrame) -> np.ndarray:
    """The kept vectors with the least hashes of their ids, in the order of hashes; of repeated ids the one with the lesser
    components comes first. Rows with a null id are no starts. At most CLUSTERS rows come to the driver."""

    def keyed(batches):
        for part, kept, x in slices(batches):
            ids = part.column(0).take(pa.array(kept))
            keys = [None if i is None else hashlib.sha256(f"{SEED}:{i}".encode()).hexdigest() for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(x), pa.list_(pa.int64()))], ["key", "x"])

    least = vectors.mapInArrow(keyed, "key string, x array<long>").where("key is not null").orderBy("key", "x").limit(CLUSTERS)
    return np.array([r.x for r in least.collect()], np.int64).reshape(-1, LENGTH)


def totals(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, sum of squared distances and sums of components for every centroid; each task sends a row for each."""
    k, search = len(centroids), Annulus(centroids)
    names = [f"s{i}" for i in range(LENGTH)]

    def add(batches):
        n, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, LENGTH), np.int64)
        for _, _, x in slices(batches):
            number, far = search.nearest(x)
            np.add.at(n, number, 1)
            np.add.at(inertia, number, far)
            np.add.at(sums, number, x)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own]), pa.array(inertia[own]), *(pa.array(np.ascontiguousarray(c)) for c in sums[own].T)], ["cluster", "n", "inertia", *names])

    rows = vectors.mapInArrow(add, "cluster long, n long, inertia long, " + ", ".join(f"{c} long" for c in names))
    n, inertia, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, LENGTH), np.int64)
    for r in rows.groupBy("cluster").agg(F.sum("n"), F.sum("inertia"), *[F.sum(c) for c in names]).collect():
        n[r[0]], inertia[r[0]], sums[r[0]] = r[1], r[2], r[3:]
    return n, inertia, sums


def clusters(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept row of `vectors`.

    Kept are vectors with exactly LENGTH components, none null or non-finite; every such row counts, also
    repeated ones and those with a null id (which never start a centroid). With fewer rows than CLUSTERS
    there are as many centroids as rows, and equal ones leave the later ones empty, where they stay. An empty table
    gives no rows. Components beyond LARGEST / SCALE are an error, as distances would overflow. Each round
    is one pass that brings CLUSTERS rows to the driver.
    """
    rows = vectors.select(F.col(id_column).cast("long"), column)
    centroids = starts(rows)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], OUT)
    for _ in range(ROUNDS):
        n, _, sums = totals(rows, centroids)
        centroids = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
    _, inertia, _ = totals(rows, centroids)
    search, total = Annulus(centroids), int(inertia.sum())
    digests = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()], object)

    def assign(batches):
        for part, kept, x in slices(batches):
            number, far = search.nearest(x)
            cols = [part.column(0).take(pa.array(kept)), pa.array(number.astype(np.int32)), pa.array(far), pa.array(inertia[number]), pa.array(np.full(len(x), total, np.int64)), pa.array(digests[number], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return rows.mapInArrow(assign, OUT)


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of `embeddings`, see `clusters`."""
    return clusters(table(spark, sf_dir, "embeddings"))


def _round(k: int) -> str:
    """Centroids c{k} from c{k - 1}: every vector against every centroid, then floored means."""
    return f"""
a{k} AS MATERIALIZED (SELECT r, arg_min(k, struct_pack(far := far, k := k)) AS k FROM (
  SELECT r, k, list_sum(list_transform(range(1, {LENGTH + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS far FROM v, c{k - 1} AS c) GROUP BY r),
s{k} AS (SELECT k, i, SUM(x[i])::BIGINT AS s, COUNT(*) AS n FROM a{k} JOIN v USING (r), (SELECT UNNEST(range(1, {LENGTH + 1})) AS i) GROUP BY k, i),
m{k} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY k),
c{k} AS MATERIALIZED (SELECT c.k, COALESCE(m{k}.x, c.x) AS x FROM c{k - 1} AS c LEFT JOIN m{k} USING (k)),"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {LENGTH} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e::DOUBLE))) = {LENGTH}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {CLUSTERS})),
{"".join(_round(k) for k in range(1, ROUNDS + 1))}
f AS (SELECT r, arg_min(k, struct_pack(far := far, k := k)) AS k, MIN(far) AS far FROM (
  SELECT r, k, list_sum(list_transform(range(1, {LENGTH + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS far FROM v, c{ROUNDS} AS c) GROUP BY r)
SELECT v.vec_id, f.k::INTEGER AS cluster, f.far AS distance, (SUM(f.far) OVER (PARTITION BY f.k))::BIGINT AS cluster_inertia, (SUM(f.far) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM f JOIN v USING (r) JOIN c{ROUNDS} AS c USING (k)
"""
