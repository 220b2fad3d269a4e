"""Centroid clustering with a LAESA pivot table and exact integer distances.

Components become whole numbers.  Each vector's distances to a few fixed pivots are stored once,
beside the vector.  In a round the difference between a vector's and a centroid's distance to a
pivot bounds their own distance from below; only centroids whose bound is not above the best
distance found so far get an exact one.  New centroids are exact floors of exact means.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlake.llm.common import stored

#: Components of a vector, clusters, rounds, pivots.
DIMENSIONS, CLUSTERS, ROUNDS, PIVOTS = 64, 40, 5, 12
#: Whole numbers per unit of a component; largest whole number whose squared distances fit 64 bits.
SCALE, LARGEST = 256, 1 << 27
#: Vectors compared in one numpy pass.
BLOCK = 1 << 14
#: Rounding of the pivots' distances, relative to them.
_SLACK = 1e-9


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                  dimensions: int = DIMENSIONS) -> DataFrame:
    """``(vec_id, v)``: vectors of ``dimensions`` finite components as whole numbers.

    Other rows are left out: null vectors, other lengths, null or non-finite components.  A
    component beyond 2**27 as a whole number is an error, as its squares do not fit 64 bits.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # An `and` of Spark SQL may be checked in any order; all parts are safe on any row.
    kept = rows.where(F.col(vector_col).isNotNull() & (F.size(F.col(vector_col)) == dimensions) & F.coalesce(finite, F.lit(False)))
    value = lambda c: F.when(F.abs(c) * SCALE < float(LARGEST), F.floor(c * float(SCALE))).otherwise(
        F.raise_error(F.lit(f"a component of {LARGEST // SCALE} or more")).cast("long"))
    return kept.select(F.col(id_col).alias("vec_id"), F.transform(x, value).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``2:<vec_id>``, in that order.

    Rows of one id follow each other by their components; a null id comes last.
    """
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    found = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").toArrow()["v"].to_pylist()
    return np.array(found, np.int64).reshape(len(found), len(found[0]) if found else 0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``(vec_id, v, d)``: the vectors with their distances to the pivots, stored once."""
    def run(batches):
        for b in batches:
            v = _matrix(b.column(1)) if len(b) else np.zeros((0, pivots.shape[1]), np.int64)
            d = np.stack([np.sqrt(((v - p) ** 2).sum(1).astype(np.float64)) for p in pivots], axis=1)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), len(pivots)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["vec_id", "v", "d"])

    schema = T.StructType([vectors.schema["vec_id"], T.StructField("v", T.ArrayType(T.LongType())),
                           T.StructField("d", T.ArrayType(T.DoubleType()))])
    return stored(vectors.mapInArrow(run, schema), "pivots")


def spread_pivots(candidates: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """``n`` of the candidates that lie far from each other: each next one is the farthest from those before."""
    chosen, gap = [0], ((candidates - candidates[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(candidates)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((candidates - candidates[chosen[-1]]) ** 2).sum(1))
    return candidates[chosen]


def nearest(v: np.ndarray, d: np.ndarray, centroids: np.ndarray, of_centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``(cluster, squared distance, exact distances made)``; equal distances go to the smaller number.

    ``d`` and ``of_centroids`` are the distances to the pivots.  Centroids are taken by rising
    bound, and a vector is done as soon as the bound passes its best distance.
    """
    bound = np.zeros((len(v), len(centroids)))
    for p in range(d.shape[1]):
        gap = np.abs(d[:, p, None] - of_centroids[None, :, p])
        np.maximum(bound, gap - _SLACK * (d[:, p, None] + of_centroids[None, :, p]), out=bound)
    order = bound.argsort(axis=1, kind="stable")
    best = np.full(len(v), np.iinfo(np.int64).max)
    cluster = np.full(len(v), len(centroids), np.int64)
    alive, made = np.arange(len(v)), 0
    for rank in range(len(centroids)):
        c = order[alive, rank]
        low = bound[alive, c]
        alive, c = (x[low * low * (1 - _SLACK) <= best[alive]] for x in (alive, c))
        if not len(alive):
            break
        exact = ((v[alive] - centroids[c]) ** 2).sum(1)
        made += len(alive)
        better = (exact < best[alive]) | ((exact == best[alive]) & (c < cluster[alive]))
        best[alive[better]], cluster[alive[better]] = exact[better], c[better]
    return cluster, best, made


def _pivot_distances(centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(((centroids[:, None, :] - pivots[None, :, :]) ** 2).sum(2).astype(np.float64))


def _blocks(batches):
    for b in batches:
        for i in range(0, len(b), BLOCK):
            part = b.slice(i, BLOCK)
            yield part, _matrix(part.column(1)), _matrix(part.column(2))


def new_centroids(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """One round: exact floors of the means of each cluster's vectors; an empty cluster keeps its centroid.

    Sums are made in each block and added up as 38-digit decimals, one row for each cluster and
    component; the number of rows that come back does not depend on the vectors.
    """
    of_centroids = _pivot_distances(centroids, pivots)
    k, dims = centroids.shape

    def run(batches):
        for _, v, d in _blocks(batches):
            cluster = nearest(v, d, centroids, of_centroids)[0]
            sums = np.zeros((k, dims), np.int64)
            np.add.at(sums, cluster, v)
            n = np.bincount(cluster, minlength=k)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(some, dims), pa.int64()), pa.array(np.tile(np.arange(dims), len(some)), pa.int64()),
                 pa.array(sums[some].ravel()), pa.array(np.repeat(n[some], dims), pa.int64())], ["c", "j", "s", "n"])

    big = "decimal(38,0)"
    found = (table.mapInArrow(run, "c long, j long, s long, n long").groupBy("c", "j")
             .agg(F.sum(F.col("s").cast(big)).alias("s"), F.sum(F.col("n").cast(big)).alias("n")).collect())
    out = centroids.copy()
    for r in found:
        out[r["c"], r["j"]] = int(r["s"]) // int(r["n"])
    return out


@dataclass
class Clustering:
    """A stored pivot table, the pivots, and the final centroids."""

    table: DataFrame
    pivots: np.ndarray
    centroids: np.ndarray

    def assign(self) -> DataFrame:
        """``(vec_id, cluster, distance, n_exact)``; ``n_exact`` counts the exact distances of the vector's block, on its first row."""
        centroids, of_centroids = self.centroids, _pivot_distances(self.centroids, self.pivots)

        def run(batches):
            for b, v, d in _blocks(batches):
                cluster, best, made = nearest(v, d, centroids, of_centroids)
                exact = np.zeros(len(v), np.int64)
                exact[:1] = made
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster.astype(np.int32)), pa.array(best), pa.array(exact)],
                                                 ["vec_id", "cluster", "distance", "n_exact"])

        schema = T.StructType([self.table.schema["vec_id"], T.StructField("cluster", T.IntegerType()),
                               T.StructField("distance", T.LongType()), T.StructField("n_exact", T.LongType())])
        return self.table.mapInArrow(run, schema)


def cluster(rows: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, pivots: int = PIVOTS, id_col: str = "vec_id",
            vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> Clustering | None:
    """Cluster the vectors of ``rows``; None where there is none.

    Repeated rows count each time; fewer vectors than ``k`` give as many clusters; other columns are left behind.
    """
    vectors = whole_vectors(rows, id_col, vector_col, dimensions)
    centroids = first_centroids(vectors, k)
    if not len(centroids):
        return None
    fixed = spread_pivots(centroids, pivots)
    table = pivot_table(vectors, fixed)
    for _ in range(rounds):
        centroids = new_centroids(table, centroids, fixed)
    return Clustering(table, fixed, centroids)


def report(found: Clustering | None, spark) -> DataFrame:
    """Per vector its cluster, distance and what holds of its cluster; the clusters' rows are at most ``k`` and broadcast."""
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = stored(found.assign(), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]
    total = sum(sums.values())
    side = pa.table({"cluster": pa.array(list(sums), pa.int32()), "cluster_inertia": pa.array(list(sums.values()), pa.int64()),
                     "inertia": pa.array([total] * len(sums), pa.int64()), "centroid_sha256": [sha[c] for c in sums]})
    return rows.drop("n_exact").join(F.broadcast(spark.createDataFrame(side)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
