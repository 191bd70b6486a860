"""Centroid clustering in whole numbers, with a LAESA table of distances to fixed pivots.

Vectors become integers, and every distance that decides is an exact integer. The distances of each vector to a few pivots, chosen once
among the first centroids, are stored once beside the vector. In each round the distances of the centroids to the pivots are computed
anew, and by the triangle inequality the largest difference of two such distances bounds a vector's distance to a centroid from below. A
vector first meets the centroid of the smallest bound; only centroids whose bound does not exceed that distance are met as well.

A round is one map over the stored table: a task hands on the sums and counts of its clusters, which Spark adds, and the driver gets one row
for each cluster. Nothing but the centroids, of fixed number and size, is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masklake.llm.common import bound_batches
from masklake.session import discard, materialize

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
PIVOTS = 8
SCALE = 64
SEED = 1
#: Scaled components are held within this bound, beyond which a squared distance of 64 components does not fit 64 bits.
LARGEST = 1 << 27
#: What rounding may take from a bound, relative to the distances it is computed from.
_SLACK = 1e-9


def integers(embedding: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have exactly `dimensions` finite components, these as floor(SCALE * x))."""
    length = pc.list_value_length(embedding).fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dimensions)
    x = embedding.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), dimensions)
    good = np.isfinite(x).all(1)
    return rows[good], np.clip(np.floor(x[good] * SCALE), -LARGEST, LARGEST).astype(np.int32)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a.astype(np.int64) - b
    return np.einsum("...i,...i->...", d, d)


def spread_pivots(first: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """`count` of the first centroids, each the one farthest from those before it."""
    chosen, near = [0], _squared(first, first[0])
    while len(chosen) < min(count, len(first)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _squared(first, first[chosen[-1]]))
    return first[chosen]


def nearest(vectors: np.ndarray, table: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, number of exact distances) of each vector; `table` holds its distances to the pivots."""
    to_pivots = np.sqrt(_squared(centroids[:, None], pivots[None]).astype(np.float64))
    bound = np.zeros((len(vectors), len(centroids)))
    for k in range(len(pivots)):
        apart = np.abs(table[:, k, None] - to_pivots[None, :, k]) - _SLACK * (1 + table[:, k, None] + to_pivots[None, :, k])
        np.maximum(bound, apart, out=bound)
    cluster = bound.argmin(1)
    best = _squared(vectors, centroids[cluster])
    met, start = np.ones(len(vectors), np.int64), cluster.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= np.sqrt(best.astype(np.float64)) * (1 + _SLACK) + _SLACK) & (start != c))
        exact = _squared(vectors[rows], centroids[c])
        met[rows] += 1
        closer = (exact < best[rows]) | (exact == best[rows]) & (c < cluster[rows])
        best[rows[closer]], cluster[rows[closer]] = exact[closer], c
    return cluster, best, met


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    _, _, data = column.buffers()
    size = np.dtype(kind).itemsize * width
    return np.frombuffer(data, np.uint8)[column.offset * size:(column.offset + len(column)) * size].view(kind).reshape(len(column), width)


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance (squared), exact (centroids met) for each kept vector; the final centroids as rows).

    Kept are vectors of exactly `dimensions` components, none null, NaN or infinite; all others have no row. Rows are vectors of their own,
    repeated ones too. The first centroids are the kept vectors of the smallest SHA-256 of `seed:vec_id` (a null id counts as empty text; of
    equal digests the smaller components come first); fewer vectors than `clusters` give as many centroids. Ties go to the smaller number. A
    centroid without vectors stays. Components beyond 2 ** 27 after scaling are held at that bound. An empty table gives an empty result.
    Columns other than vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = integers(batch.column("embedding"), dimensions)
            yield pa.record_batch({"vec_id": batch.column("vec_id").take(pa.array(kept)), "v": pa.array([r.tobytes() for r in x], pa.binary())})

    ready = rows.mapInArrow(scaled, f"vec_id {id_type}, v binary")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = ready.select(key.alias("key"), "v").orderBy("key", "v").limit(clusters).collect()
    centroids = np.array([np.frombuffer(r["v"], np.int32) for r in first], np.int64).reshape(len(first), dimensions)
    if not len(centroids):
        return ready.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.lit(0).cast("bigint").alias("exact")), centroids
    fixed = spread_pivots(centroids, pivots)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), "<i4", dimensions)
            table = np.sqrt(_squared(x[:, None], fixed[None]).astype(np.float64))
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "v": batch.column("v"), "pivots": pa.array([r.tobytes() for r in table], pa.binary())})

    stored = materialize(ready.mapInArrow(measured, f"vec_id {id_type}, v binary, pivots binary"), "pivot-table")

    def found(batch: pa.RecordBatch, now: np.ndarray):
        x = _matrix(batch.column("v"), "<i4", dimensions)
        return x, *nearest(x, _matrix(batch.column("pivots"), "<f8", len(fixed)), now, fixed)

    def sums(now: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros(now.shape, np.int64), np.zeros(len(now), np.int64)
            for batch in batches:
                x, to, _, _ = found(batch, now)
                np.add.at(total, to, x)
                count += np.bincount(to, minlength=len(now))
            some = np.flatnonzero(count)
            yield pa.record_batch({"cluster": pa.array(np.repeat(some, dimensions).astype(np.int32)), "component": pa.array(np.tile(np.arange(dimensions, dtype=np.int32), len(some))),
                                   "total": pa.array(total[some].ravel()), "count": pa.array(np.repeat(count[some], dimensions))})

        return run

    for _ in range(rounds):
        added = stored.select("v", "pivots").mapInArrow(sums(centroids), "cluster int, component int, total bigint, count bigint")
        added = added.groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
        new = centroids.copy()
        for r in added.collect():  # clusters x dimensions rows
            new[r["cluster"], r["component"]] = r["total"] // r["count"]
        centroids = new

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, to, distance, met = found(batch, centroids)
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "cluster": pa.array(to.astype(np.int32)), "distance": pa.array(distance), "exact": pa.array(met)})

    answer = materialize(stored.mapInArrow(assigned, f"vec_id {id_type}, cluster int, distance bigint, exact bigint"), "clustered")
    discard(stored)
    return answer, centroids


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, exact for each vector."""
    spark = found.sparkSession
    texts = [(k, ",".join(map(str, c))) for k, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(texts, "cluster int, components string").select("cluster", F.sha2("components", 256).alias("centroid_sha256"))
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = inertia.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = named.join(inertia, "cluster").crossJoin(whole)  # a row for each cluster
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "exact")
