import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlake.llm import centroids as C


def brute(rows, k, rounds, dims):
    """The contract row by row, in Python's own whole numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, tuple(math.floor(256 * float(x)) for x in v)))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [v for _, v in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            d, c = min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(centres))
            out.append((i, v, c, d))
        return out

    for _ in range(rounds):
        groups = {}
        for _, v, c, _ in assign():
            groups.setdefault(c, []).append(v)
        centres = [tuple(sum(x) // len(groups[c]) for x in zip(*groups[c])) if c in groups else m for c, m in enumerate(centres)]
    rows = assign()
    inertia = {}
    for _, _, c, d in rows:
        inertia[c] = inertia.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in centres]
    return sorted((str(i), c, d, inertia[c], sum(inertia.values()), sha[c]) for i, _, c, d in rows)


@pytest.mark.parametrize("n, k, dims", [(400, 7, 6), (3, 5, 4), (60, 12, 2)])
def test_clusters_equal_brute_force(spark, n, k, dims):
    r = random.Random(n)
    middle = [[r.uniform(-2, 2) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [x + r.choice([0, 0, r.gauss(0, 0.2)]) for x in r.choice(middle)]) for i in range(n)]
    rows += rows[: n // 5]  # repeated rows, and ties by them
    rows += [(n + 1, None), (n + 2, []), (n + 3, [0.0] * (dims - 1)), (n + 4, [None] + [0.0] * (dims - 1)),
             (n + 5, [math.nan] * dims), (n + 6, [math.inf] + [0.0] * (dims - 1)), (None, [0.25] * dims), (n + 7, [1.0] * dims), (n + 8, [1.0] * dims)]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, d double").repartition(4)
    got = C.report(C.cluster(table, k, 4, 3, dimensions=dims), spark).collect()
    assert sorted((str(x[0]), *x[1:]) for x in got) == brute(rows, k, 4, dims)


def test_no_vectors(spark):
    empty = spark.createDataFrame([(1, [math.nan] * 64)], "vec_id long, embedding array<float>")
    assert C.cluster(empty) is None and C.report(None, spark).count() == 0
    assert C.cluster(empty.limit(0)) is None


def test_too_large_components_are_an_error(spark):
    table = spark.createDataFrame([(1, [1e300] + [0.0] * 63)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="component of"):
        C.cluster(table)


def test_bounds_spare_exact_distances(spark):
    """On vectors in clusters most centroids are ruled out by the pivots, and none of the nearest."""
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 2, (40, 64))
    rows = [(i, (middle[i % 40] + rng.normal(0, 0.05, 64)).tolist()) for i in range(2000)]
    found = C.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = found.assign().agg(F.count("*").alias("n"), F.sum("n_exact").alias("exact")).first()
    assert out["n"] == 2000 and out["exact"] < 0.4 * 2000 * 40


def test_bounds_are_safe_for_random_whole_numbers():
    rng = np.random.default_rng(5)
    for top in (3, 1000, C.LARGEST):
        v, m = rng.integers(-top, top, (300, 8)), rng.integers(-top, top, (9, 8))
        m[4] = m[2]
        pivots = C.spread_pivots(m, 3)
        cluster, best, _ = C.nearest(v, C._pivot_distances(v, pivots), m, C._pivot_distances(m, pivots))
        exact = ((v[:, None, :] - m[None]) ** 2).sum(2)
        assert (cluster == exact.argmin(1)).all() and (best == exact.min(1)).all()
