"""Clusters around centroids, found by equal-average equal-variance search.

Vectors become whole numbers, ``floor(SCALE * x)``, and all sums and distances
are exact.  For a vector x and a centroid c of n components with sums s, and
deviations v (the root of n times the sum of squares less the squared sum),

    n * |x - c|^2  >=  (s(x) - s(c))^2 + (v(x) - v(c))^2.

Centroids are sorted by s, which is their component mean times n.  From the
place of the vector's own mean the search goes outward, always to the nearer
side; it ends when the first term alone exceeds the best distance found, and
measures only centroids that both terms do not exclude.  The first term is
exact; the second is rounded down, so no centroid is lost to rounding; and
equal distances go to the smaller number.

Each round is one pass: tasks search their vectors and send one sum per
centroid; the driver holds the centroids only (k times n numbers).  The last
pass is written as a narrow table, from which inertia is added up.

Left out: vectors that are null, have not exactly n components, or have a null
or non-finite one.  Components beyond ``LARGEST`` after scaling are held there,
which keeps distances within 64 bits; inertia above that range is its end.  A
null ``vec_id`` is a vector like any other, but among the starting centroids
comes after all ids; rows with one id are told apart by their components.  With
fewer than k vectors there are fewer centroids, with none no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forage.session import cut

CLUSTERS, ROUNDS, WIDTH, SCALE = 16, 3, 64, 64
#: Largest size of a scaled component: n times a squared distance stays below 2^63 for 64 of them.
LARGEST = 1 << 24
_END = (1 << 63) - 1
#: Vectors searched at a time.
SLICE = 4096


def whole(vectors: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Of a list column: which rows are vectors, and their components as whole numbers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sized = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False)
    values = pc.list_flatten(vectors.filter(sized)).cast(pa.float64())
    values = values.to_numpy(zero_copy_only=False).reshape(-1, width)  # null becomes NaN
    finite = np.isfinite(values).all(axis=1)
    kept = sized.to_numpy(zero_copy_only=False).astype(bool)
    kept[kept] = finite
    with np.errstate(over="ignore"):
        scaled = np.floor(values[finite] * SCALE)
    return kept, np.clip(scaled, -LARGEST, LARGEST).astype(np.int64)


class Search:
    """Centroids sorted by their sums, for nearest-centroid search."""

    def __init__(self, centroids: np.ndarray):
        sums = centroids.sum(axis=1)
        self.number = np.lexsort((np.arange(len(centroids)), sums))
        self.sorted = centroids[self.number]
        self.sums = sums[self.number]
        self.deviations = self._deviations(self.sorted, self.sums)

    @staticmethod
    def _deviations(vectors: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return np.sqrt((vectors.shape[1] * (vectors * vectors).sum(axis=1) - sums * sums).astype(np.float64))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of and squared distance to each vector's nearest centroid, and how many distances were measured."""
        n, k, width = len(vectors), len(self.sums), vectors.shape[1]
        sums = vectors.sum(axis=1)
        deviations = self._deviations(vectors, sums)
        best = np.full(n, _END // width, dtype=np.int64)
        number, measured = np.full(n, k, dtype=np.int64), np.zeros(n, dtype=np.int64)
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        active = np.arange(n)
        while len(active):
            a, b = left[active], right[active]
            below = np.where(a >= 0, np.abs(sums[active] - self.sums[np.maximum(a, 0)]), _END)
            above = np.where(b < k, np.abs(sums[active] - self.sums[np.minimum(b, k - 1)]), _END)
            go_left = below <= above
            gap = np.where(go_left, below, above)
            # The nearer side's mean already excludes it, and with it all that are further out.
            near = gap != _END
            near[near] = gap[near] * gap[near] <= best[active[near]] * width
            active, at, gap, go_left = active[near], np.where(go_left, a, b)[near], gap[near], go_left[near]
            left[active] -= go_left
            right[active] += ~go_left
            spread = np.maximum(np.abs(deviations[active] - self.deviations[at]) - 1e-6, 0.0)
            bound = (gap.astype(np.float64) ** 2 + spread**2) * (1 - 1e-12)
            open_ = bound <= best[active].astype(np.float64) * width
            rows, at = active[open_], at[open_]
            apart = vectors[rows] - self.sorted[at]
            distance = (apart * apart).sum(axis=1)
            measured[rows] += 1
            better = (distance < best[rows]) | ((distance == best[rows]) & (self.number[at] < number[rows]))
            best[rows[better]], number[rows[better]] = distance[better], self.number[at[better]]
        return number, best, measured


def _searched(batch: pa.RecordBatch, column: str, search: Search) -> Iterator[tuple]:
    """Kept rows of a batch by slices: their places, components, and what the search found."""
    kept, vectors = whole(batch.column(column), search.sorted.shape[1])
    places = np.flatnonzero(kept)
    for start in range(0, len(places), SLICE):
        part = slice(start, start + SLICE)
        yield places[part], vectors[part], *search.nearest(vectors[part])


def starting(vectors: DataFrame, clusters: int = CLUSTERS, width: int = WIDTH) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in the order of the hashes.

    ``vectors`` has vec_id and embedding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, components = whole(batch.column("embedding"), width)
            lists = pa.ListArray.from_arrays(np.arange(len(components) + 1, dtype=np.int32) * width, components.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("_order").filter(pa.array(kept)), lists], names=["_order", "components"])

    order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("_order")
    schema = T.StructType([T.StructField("_order", T.StringType()), T.StructField("components", T.ArrayType(T.LongType()))])
    found = vectors.select(order, "embedding").mapInArrow(run, schema)
    first = found.orderBy(F.col("_order").asc_nulls_last(), "components").limit(clusters).collect()
    return np.array([r.components for r in first], dtype=np.int64).reshape(len(first), width)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after a round: the floor of the mean of their vectors; empty ones stay."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, sizes = Search(centroids), np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for _, components, number, _, _ in _searched(batch, "embedding", search):
                order = np.argsort(number, kind="stable")
                present, starts = np.unique(number[order], return_index=True)
                sums[present] += np.add.reduceat(components[order], starts, axis=0)
                sizes += np.bincount(number, minlength=k)
        for c in np.flatnonzero(sizes):
            yield pa.RecordBatch.from_pydict({"cluster": [c], "size": [sizes[c]], **{f"s{i}": [sums[c, i]] for i in range(width)}})

    names = ["size", *(f"s{i}" for i in range(width))]
    parts = vectors.select("embedding").mapInArrow(run, T.StructType([T.StructField(c, T.LongType()) for c in ("cluster", *names)]))
    result = centroids.copy()
    for row in parts.groupBy("cluster").agg(*(F.sum(c).alias(c) for c in names)).collect():
        result[row["cluster"]] = [row[f"s{i}"] // row["size"] for i in range(width)]
    return result


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH) -> np.ndarray:
    """Centroids after ``rounds`` passes over the vectors (vec_id, embedding)."""
    centroids = starting(vectors, clusters, width)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Rows of ``vectors`` that are vectors, all columns, with ``cluster``, ``distance`` and ``measured``.

    ``measured`` is the number of distances the search computed.  Input columns of these names are replaced.
    """
    names = ["cluster", "distance", "measured"]
    vectors = vectors.drop(*names)
    column = next(c for c in vectors.columns if c.lower() == "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in batches:
            for places, _, *found in _searched(batch, column, search):
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(places)).columns, *map(pa.array, found)], names=[*batch.schema.names, *names])

    schema = T.StructType([*vectors.schema.fields, *(T.StructField(c, T.LongType()) for c in names)])
    return vectors.mapInArrow(run, schema) if len(centroids) else vectors.sparkSession.createDataFrame([], schema)


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector."""
    vectors = vectors.select("vec_id", "embedding")
    centroids = fit(vectors)
    found = cut(assign(vectors, centroids).select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance"), "assigned")
    sums = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    lists = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = [(c, min(_END, sums.get(c, 0)), min(_END, sum(sums.values())), s) for c, s in enumerate(lists)]
    known = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # One row per centroid: k rows.
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
