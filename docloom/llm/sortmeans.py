"""Centroid clustering by sort-means on integer vectors.

Each round orders, for every centroid, the others by their distance from it. A vector starts at the centroid it was
assigned to before and looks at the others in that order; it stops at the first that lies strictly beyond twice its
distance from its own centroid, as by the triangle inequality neither that one nor any after it can be as near.
All arithmetic is in integers, so rounds, ties and results are exact. A round reads the vectors with their
clusters and writes them with the new ones to the shared folder, so that a lost executor costs tasks and no rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, forget, stored
from .vectors import exact_sums, integers, lists, rows_of, vector_batches


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, before: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances computed) of the rows of x, last assigned to ``before``; of equally near ones the smaller number."""
    widest = max(int(np.abs(x).max(initial=0)), *(abs(e) for c in centroids for e in c))
    wide = 16 * x.shape[1] * widest**2 >= 1 << 63  # four times a squared distance might not fit a long
    x, c = (x.astype(object), np.array(centroids, object)) if wide else (x, np.array(centroids, np.int64))
    apart = np.array([_squared(c, row) for row in c])
    order = np.array([sorted(set(range(len(c))) - {i}, key=lambda j: (apart[i][j], j)) for i in range(len(c))], np.int64).reshape(len(c), -1)
    own = _squared(x, c[before])
    best, near, looked = before.copy(), own.copy(), len(x)
    left = np.arange(len(x))
    for rank in range(len(c) - 1):
        other = order[before[left], rank]
        within = (apart[before[left], other] <= 4 * own[left]).astype(bool)
        left, other = left[within], other[within]
        if not len(left):
            break
        looked += len(left)
        d = _squared(x[left], c[other])
        better = ((d < near[left]) | ((d == near[left]) & (other < best[left]))).astype(bool)
        best[left[better]], near[left[better]] = other[better], d[better]
    return best, near, looked


def _assigned(x: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """x (id, x, cluster) with new clusters and squared distances; a distance that a long can't hold is null."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            rows = rows_of(b.column("x"))
            best, near, _ = nearest(rows, b.column("cluster").to_numpy().astype(np.int64), centroids)
            if near.dtype == object:
                near = pa.array([int(d) if d < 1 << 63 else None for d in near], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(best.astype(np.int32)), pa.array(near, pa.int64())], names=["id", "x", "cluster", "distance"])

    kind = x.schema["id"].dataType.simpleString()
    with vector_batches(x):
        return stored(x.select("id", "x", "cluster").mapInArrow(batches, f"id {kind}, x array<long>, cluster int, distance long"), "assigned")


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of every vector of ``dims`` finite entries.

    Entries become floor(scale * entry). The first centroids are the k vectors with the smallest sha256 of ``seed`` and
    the id in decimal, a null id being the empty string; of repeated ids the smaller vector comes first. Fewer
    vectors than k give as many centroids. A round assigns every vector to the nearest centroid (squared Euclidean
    distance, ties to the smaller number) and replaces each centroid that has vectors by their floored mean; after the
    last one vectors are assigned once more. distance, and inertia over a cluster and over all, are exact, and null
    where a long can't hold them; entries beyond 2^53 / scale count as that. Null vectors, those of another length and
    those with null or non-finite entries have no row; repeated rows count each. An empty table gives an empty one.
    """
    spark = bounded(vectors.sparkSession)
    x = integers(vectors, id_col, F.col(vector_col), dims, scale)
    mark = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = [list(r["x"]) for r in x.select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()]
    now = x.withColumn("cluster", F.lit(0))
    if centroids:
        for round_ in range(rounds + 1):
            after = _assigned(now, centroids)
            forget(now if round_ else x)
            now = after
            if round_ < rounds:
                for g, (n, sums) in exact_sums(now, F.col("cluster")).items():
                    centroids[g] = [s // n for s in sums]
    else:
        now = now.withColumn("distance", F.lit(None).cast("long"))
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = now.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), whole).alias("s")).collect()
    total = sum(int(r["s"]) for r in sums) if all(r["s"] is not None for r in sums) else None

    def held(n: int | None) -> int | None:
        return n if n is not None and n < 1 << 63 else None

    facts = spark.createDataFrame(  # k rows at most
        [(r["cluster"], held(r["s"] if r["s"] is None else int(r["s"])), held(total), centroids[r["cluster"]]) for r in sums],
        "cluster int, cluster_inertia long, inertia long, centroid array<long>",
    )
    return now.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
