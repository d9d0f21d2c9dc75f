import hashlib
import math
import random

import numpy as np

from editlake.llm.centroids import centroid_clusters, nearest, rotation

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, clusters, rounds, dimensions):
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and len(v) == dimensions and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(x, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centres)) for _, v in x]

    for _ in range(rounds):
        met = {}
        for (_, k), (_, v) in zip(assign(), x, strict=True):
            met.setdefault(k, []).append(v)
        centres = [[sum(c) // len(met[k]) for c in zip(*met[k], strict=True)] if k in met else old for k, old in enumerate(centres)]
    at = assign()
    sums = {}
    for d, k in at:
        sums[k] = sums.get(k, 0) + d
    long = lambda n: n if n < 1 << 63 else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    some = any(long(d) is None for d, _ in at)
    bad = {k for d, k in at if long(d) is None}
    return sorted((str(i), k, str(long(d)), str(None if k in bad else long(sums[k])), str(None if some else long(sum(sums.values()))), digest[k]) for (i, _), (d, k) in zip(x, at, strict=True))


def result(spark, rows, clusters, rounds, dimensions, leading):
    df = spark.createDataFrame([(*r, 7, "c") for r in rows], SCHEMA + ", cluster long, x string").repartition(3)
    got = centroid_clusters(df, clusters, rounds, dimensions, leading).collect()
    return sorted((str(r.vec_id), r.cluster, str(r.distance), str(r.cluster_inertia), str(r.inertia), r.centroid_sha256) for r in got)


def drawn(n, dimensions, seed, spread=0.05):
    draw = random.Random(seed)
    middle = [[draw.uniform(-1, 1) for _ in range(dimensions)] for _ in range(7)]
    return [(i, [c + draw.gauss(0, spread) for c in draw.choice(middle)]) for i in range(n)]


def test_against_brute_force(spark):
    for leading in (1, 4, 16):
        rows = drawn(300, 16, leading)
        assert result(spark, rows, 9, 3, 16, leading) == brute(rows, 9, 3, 16)


def test_ties_and_one_common_vector(spark):
    """A third of the rows is one vector, others lie between centroids on a grid."""
    rows = [(i, [0.25, 0.25] if i % 3 == 0 else [(i % 5) / 256, (i % 4) / 256]) for i in range(200)] + [(3, [0.25, 0.25])] * 2
    assert result(spark, rows, 6, 4, 2, 1) == brute(rows, 6, 4, 2)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [0.5, -0.001]), (7, [-0.001, 0.5]), (7, [-0.001, 0.5]), (8, [0.0, -0.0])]
    assert result(spark, rows, 40, 2, 2, 2) == brute(rows, 40, 2, 2)
    assert result(spark, rows[:6], 40, 2, 2, 2) == []
    assert result(spark, rows[:0], 40, 2, 2, 2) == []


def test_large_components_are_exact(spark):
    """Beyond what a long holds, distances are null, and clusters and centroids are still exact."""
    rows = [(i, [float(2**20 + i), -float(i) * 2**19, 3.0]) for i in range(30)]
    assert result(spark, rows, 4, 3, 3, 2) == brute(rows, 4, 3, 3)
    rows = [(i, [1e30 * i, float(i), -1e38]) for i in range(20)]
    assert result(spark, rows, 3, 2, 3, 2) == brute(rows, 3, 2, 3)


def test_bounds_leave_out_most_centroids(spark):
    rows = drawn(2000, 32, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    axes = rotation(df.selectExpr("embedding x"), 32, 6)
    x = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    lead = x @ axes
    rest = np.sqrt(np.maximum((x * x).sum(1) - (lead * lead).sum(1), 0))
    centres = x[:40]
    cluster, distance, compared = nearest(x, lead, rest, centres, axes)
    every = ((x[:, None, :] - centres[None]) ** 2).sum(2)
    assert (distance == every.min(1)).all() and (cluster == every.argmin(1)).all()
    assert compared < 0.35 * every.size
