"""Centroid clustering in exact integers, with a LAESA table of pivot distances.

The distances of every vector to a few fixed pivots are stored once. In each round the
differences between those and the pivot distances of the centroids bound every distance
from below (triangle inequality); only centroids whose bound does not exceed the distance
to the likeliest one get an exact distance. Sums of a cluster are partial sums of tasks,
added up by Spark, so a cluster of any size never meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lullspark.llm.common import stored

SCALE = 256
DIMENSIONS = 64
# Below it the squared distance of two vectors fits a long.
LARGEST = 1 << 27
# Vectors whose distances are computed at once in a task.
STEP = 1024


def integer_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``vec_id, x``: vectors of that many components, none null or non-finite, each
    component as floor(scale * component). One of 2^27 or more is an error, as its
    distances need not fit a long."""
    finite = F.forall(
        "embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))
    )
    kept = vectors.select("vec_id", "embedding").where((F.size("embedding") == dimensions) & finite)
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale))
    large = F.exists("embedding", lambda v: F.abs(v.cast("double") * scale) >= LARGEST)
    return kept.select("vec_id", F.when(large, F.raise_error(F.lit("component too large"))).otherwise(whole).alias("x"))


def _matrix(column: pa.ListArray, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def first_centroids(points: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``seed:vec_id``; equal ones by vector."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = points.orderBy(key, "x").limit(k).select("x").collect()
    return np.array([row["x"] for row in rows], np.int64)


def far_pivots(centroids: np.ndarray, count: int) -> np.ndarray:
    """``count`` of the first centroids, each as far as can be from those before it."""
    chosen, gap = [0], np.full(len(centroids), np.inf)
    while len(chosen) < min(count, len(centroids)):
        gap = np.minimum(gap, ((centroids - centroids[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(gap.argmax()))
    return centroids[chosen]


def distances(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, exact."""
    return (x**2).sum(1)[:, None] - 2 * (x @ others.T) + (others**2).sum(1)[None, :]


def nearest(
    x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector: number of the nearest centroid (ties: the smaller), its squared
    distance, and how many exact distances that took."""
    known = np.sqrt(distances(centroids, pivots))
    bound = np.zeros((len(x), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - known[None, :, p]), out=bound)
    rows = np.arange(len(x))
    likely = bound.argmin(1)
    best = ((x - centroids[likely]) ** 2).sum(1)
    # The roots are rounded, so a bound counts only where it is clearly above.
    alive = bound * (1 - 1e-9) - 1e-6 <= np.sqrt(best)[:, None]
    alive[rows, likely] = False
    exact = np.full(bound.shape, np.iinfo(np.int64).max)
    exact[rows, likely] = best
    i, c = np.nonzero(alive)
    exact[i, c] = ((x[i] - centroids[c]) ** 2).sum(1)
    cluster = exact.argmin(1)
    return cluster, exact[rows, cluster], alive.sum(1) + 1


def _steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            part = batch.slice(start, STEP)
            x = _matrix(part.column("x"), width, np.int64)
            pivots = part.column("to_pivots")
            yield part, x, _matrix(pivots, len(pivots[0]), np.float64)


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, pivots: int = 8, seed: str = "2", dimensions: int = DIMENSIONS
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_exact``
    for every vector that ``integer_vectors`` keeps; the others have no row.

    ``n_exact`` is the number of exact distances that its last assignment took. Equal
    vectors go to one cluster; of equally near centroids the smaller number wins. A
    cluster without vectors keeps its centroid. Rows with the same id are vectors of their
    own; a null id is hashed as an empty one. With fewer vectors than ``k`` every vector
    is a first centroid. An empty table gives an empty result. Other columns are not read.
    The driver and the tasks hold ``k`` centroids, a parameter, and no more.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    points = integer_vectors(vectors, dimensions)
    centroids = first_centroids(points, k, seed)
    result = f"vec_id {kind}, cluster int, distance long, n_exact long"
    more = "cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, {more}, n_exact long")
    fixed = far_pivots(centroids, pivots)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = np.sqrt(distances(_matrix(batch.column("x"), dimensions, np.int64), fixed))
            column = pa.FixedSizeListArray.from_arrays(pa.array(roots.ravel()), len(fixed)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], ["vec_id", "x", "to_pivots"])

    measured = points.mapInArrow(measure, f"vec_id {kind}, x array<bigint>, to_pivots array<double>")
    laesa = stored(measured, "laesa")
    for _ in range(rounds):
        centroids = _moved(laesa, centroids, fixed)
    last = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, to_pivots in _steps(batches, dimensions):
            cluster, distance, n_exact = nearest(x, to_pivots, last, fixed)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(n_exact)],
                ["vec_id", "cluster", "distance", "n_exact"],
            )

    assigned = stored(laesa.mapInArrow(assign, result), "clusters")
    inertia = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [
        (c, s, sum(inertia.values()), sha256(",".join(map(str, last[c].tolist())).encode()).hexdigest())
        for c, s in inertia.items()
    ]
    # At most k rows.
    clusters = F.broadcast(vectors.sparkSession.createDataFrame(rows, f"cluster int, {more}"))
    return assigned.join(clusters, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_exact"
    )


def _moved(laesa: DataFrame, centroids: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of each non-empty cluster."""
    width = centroids.shape[1]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(centroids.shape, np.int64)
        counts = np.zeros(len(centroids), np.int64)
        for _, x, to_pivots in _steps(batches, width):
            cluster, _, _ = nearest(x, to_pivots, centroids, fixed)
            np.add.at(sums, cluster, x)
            counts += np.bincount(cluster, minlength=len(centroids))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    parts = laesa.select("x", "to_pivots").mapInArrow(add_up, "cluster int, n long, sums array<bigint>")
    # A task's sums are longs; those of all tasks may be larger.
    totals = [F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(width)]
    moved = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect():
        moved[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(width)]
    return moved
