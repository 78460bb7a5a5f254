"""Centroid clustering by sort-means: k-means whose scans go through the other centroids by their distance from the last one.

A vector at distance d from the centroid p that it had is never nearer to a centroid c with |pc| > 2 d. So each round
sorts, for each p, the others by distance; a vector's scan starts at p and ends at the first centroid strictly beyond
2 d (one at just 2 d may tie, and a smaller number wins). All numbers are integers, so every comparison is exact.

The assigned vectors are a written table of their own in each round (the last round's table is deleted): a scan starts from
it, and a lost executor costs one round's tasks. What a round sends to the driver is one sum for each centroid and component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, stored
from .vectors import integers, matrix, means, total_rows, totals, whole

CLUSTERS, DIMS, ROUNDS, SEED = 8, 64, 10, 3
STATE_DDL = "vec_id long, x array<long>, cluster int, distance long"


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    return np.square(x - y).sum(-1)


def neighbours(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid all of them by distance from it (itself first), and these squared distances."""
    between = squared(centroids[:, None], centroids[None])
    between[np.diag_indices(len(centroids))] = -1
    order = np.argsort(between, 1, kind="stable")
    return order, np.maximum(np.take_along_axis(between, order, 1), 0)


def scan(x: np.ndarray, last: np.ndarray, centroids: np.ndarray, order: np.ndarray, beyond: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many distances were computed."""
    best, least = last.astype(np.int64), squared(x, centroids[last])
    start, live, computed = least.copy(), np.arange(len(x)), len(x)
    for rank in range(1, len(centroids)):
        live = live[beyond[last[live], rank] <= 4 * start[live]]
        if not len(live):
            break
        c = order[last[live], rank]
        d = squared(x[live], centroids[c])
        computed += len(live)
        nearer = (d < least[live]) | ((d == least[live]) & (c < best[live]))
        best[live[nearer]], least[live[nearer]] = c[nearer], d[nearer]
    return best, least, computed


def _assign(batches, centroids: np.ndarray):
    order, beyond = neighbours(centroids)
    for batch in batches:
        best, least, _ = scan(matrix(batch, "x", centroids.shape[1]), batch.column("cluster").to_numpy(), centroids, order, beyond)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(best.astype(np.int32)), pa.array(least)], ["vec_id", "x", "cluster", "distance"])


def _sums(batches, k: int, dims: int):
    out = np.zeros((k, dims + 1), np.int64)
    for batch in batches:
        out += totals(matrix(batch, "x", dims), batch.column("cluster").to_numpy(), k)
    yield total_rows(out)


def starts(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors whose ids hash least, in that order; equal ids by their components, rows without an id never."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.where("vec_id is not null").select(name.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def clustered(vectors: DataFrame, k: int = CLUSTERS, dims: int = DIMS, rounds: int = ROUNDS, seed: int = SEED, scratch: Scratch | None = None) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, x, cluster, distance), x as integers, and the final centroids.

    Of ``vectors`` (vec_id, embedding) rows are kept whose vector has exactly ``dims`` components, none null or not finite;
    components beyond 65,536 in size end the job. Repeated rows and ids are clustered row by row. Rows without an id
    are clustered too but start no centroid. With fewer than k vectors that can start one there are fewer centroids; with none
    there is no cluster and no row. Other columns are not read.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    kept = vectors.select("vec_id", "embedding").where(whole(F.col("embedding")) & (F.size("embedding") == dims))
    state = scratch.stored(kept.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("x"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    centroids = starts(state, k, seed)
    if not len(centroids):
        return state.where("false"), centroids
    n = len(centroids)
    for turn in range(rounds + 1):
        now = centroids
        done = scratch.stored(state.mapInArrow(lambda it, c=now: _assign(it, c), STATE_DDL))
        scratch.drop(state)
        state = done
        if turn < rounds:
            centroids = means(state.select("x", "cluster").mapInArrow(lambda it: _sums(it, n, dims), "at long, total long"), n, dims, centroids)
    return state, centroids


def assigned(vectors: DataFrame, k: int = CLUSTERS, dims: int = DIMS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``clustered`` with the distances summed over each cluster and over all, and the hash of each row's centroid."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows, centroids = clustered(vectors, k, dims, rounds, seed, scratch)
    rows = stored(rows.select("vec_id", "cluster", "distance"))
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    scratch.clear()
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(c, s, sum(sums.values()), names[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
