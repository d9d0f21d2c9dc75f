"""Centroid clustering in whole numbers; distances in a rotated space leave out most centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlake.llm.common import checkpointed

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Rotated coordinates stored of each vector.
LEADING = 12
#: Whole components below this keep every distance of up to 4096 of them inside a long; larger ones are worked out in Python's integers.
WIDE = 1 << 25
#: Vectors compared at once, and the base of the parts in which sums leave a task.
BATCH, LIMB = 4096, 10**18


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as longs where all fit, else as Python integers."""
    scaled = np.floor(values * float(SCALE))
    if not len(scaled) or np.abs(scaled).max() < WIDE:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled.tolist()], object)


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimensions)


def kept_vectors(rows: DataFrame, dimensions: int, id_col: str, vector_col: str) -> DataFrame:
    """id, x (doubles): vectors of the right length whose components are all finite numbers."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) < float("inf")))
    return rows.select(F.col(id_col).alias("id"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") == dimensions)).where(fine)


def rotation(kept: DataFrame, dimensions: int, leading: int) -> np.ndarray:
    """(dimensions, leading): the axes of largest variance, from sums of products over all vectors.

    A task returns one row of sums; the result decides how many centroids are left out, never which one is nearest.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimensions + 1, dimensions))
        for batch in batches:
            x = np.clip(_vectors(batch.column(0), dimensions), -1e100, 1e100)
            total[:-1] += x.T @ x
            total[-1] += x.sum(axis=0)
        flat = total.reshape(-1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["at", "v"])

    found = dict(kept.select("x").mapInArrow(sums, "at int, v double").groupBy("at").agg(F.sum("v")).collect())  # DIMENSIONS + 1 rows of DIMENSIONS numbers
    if not found:
        return np.eye(dimensions)[:, :leading]
    total = np.array([found[i] for i in range(len(found))]).reshape(dimensions + 1, dimensions)
    n = max(kept.count(), 1)
    spread = total[:-1] / n - np.outer(total[-1], total[-1]) / n**2
    if not np.isfinite(spread).all():
        return np.eye(dimensions)[:, :leading]
    return np.linalg.eigh(spread)[1][:, ::-1][:, :leading]


def _projected(x: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates and the norm of what they leave."""
    x = x.astype(float)
    lead = x @ axes
    return lead, np.sqrt(np.maximum(np.einsum("ij,ij->i", x, x) - np.einsum("ij,ij->i", lead, lead), 0))


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, squared distance, centroids compared in full) of each vector, exact; ties go to the smaller number.

    |x - c|^2 is at least the squared distance of the leading coordinates plus the squared difference of the norms of
    the rest. The centroid with the smallest bound gives a distance; those whose bound is not above it are compared in
    whole numbers. The slack is above the rounding error of the bounds.
    """
    c_lead, c_rest = _projected(centroids, axes)
    bound = np.maximum((lead * lead).sum(1)[:, None] + (c_lead * c_lead).sum(1)[None, :] - 2 * lead @ c_lead.T, 0) + (rest[:, None] - c_rest[None, :]) ** 2
    size = (lead * lead).sum(1) + rest**2
    slack = 1e-9 * (size[:, None] + ((c_lead * c_lead).sum(1) + c_rest**2)[None, :]) + 1e-6

    def distances(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = x[i] - centroids[j]
        return (d * d).sum(axis=1)

    every, guess = np.arange(len(x)), bound.argmin(axis=1)
    first = distances(every, guess)
    limit = first.astype(float) if first.dtype != object else np.array([float(min(d, 1 << 1000)) for d in first])
    row, centre = np.nonzero(~(bound - slack > limit[:, None] * (1 + 1e-9)))  # what overflows is compared in full
    exact = distances(row, centre)
    starts = np.searchsorted(row, every)
    least = np.minimum.reduceat(exact, starts) if len(x) else exact
    hit = np.flatnonzero(exact == least[row])
    at = hit[np.searchsorted(row[hit], every)]
    return centre[at], exact[at], len(row)


def _prepare(dimensions: int, axes: np.ndarray):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = _projected(_whole(_vectors(batch.column(1), dimensions)), axes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lead) + 1, dtype=np.int32) * lead.shape[1]), pa.array(lead.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(rest)], ["id", "x", "lead", "rest"])

    return of


def _assign(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, axes: np.ndarray) -> Iterator[tuple]:
    """(ids, whole vectors, clusters, distances) of slices of BATCH rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH):
            part = batch.slice(i, BATCH)
            x = _whole(_vectors(part.column(1), centroids.shape[1]))
            c = centroids.astype(object) if x.dtype == object else centroids
            lead = part.column(2).flatten().to_numpy().reshape(len(x), -1)
            cluster, distance, _ = nearest(x, lead, part.column(3).to_numpy(), c, axes)
            yield part.column(0), x, cluster, distance


def _moved(prepared: DataFrame, centroids: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floor of the mean; a task returns one row for each cluster that it met."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(centroids), object), np.zeros(centroids.shape, object)
        for _, x, cluster, _ in _assign(batches, centroids, axes):
            order = np.argsort(cluster, kind="stable")
            met, starts = np.unique(cluster[order], return_index=True)
            count[met] += np.diff(np.append(starts, len(order))).astype(object)
            total[met] += np.add.reduceat(x[order], starts, axis=0).astype(object)
        met = [k for k in range(len(centroids)) if count[k]]
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([int(count[k]) for k in met], pa.int64()), pa.array([[_limbs(int(v)) for v in total[k]] for k in met], pa.list_(pa.list_(pa.int64())))], ["cluster", "n", "total"])

    parts = checkpointed(prepared.mapInArrow(sums, "cluster int, n long, total array<array<long>>"))
    sizes = dict(parts.groupBy("cluster").agg(F.sum("n")).collect())  # one row for each cluster
    long = parts.select("cluster", F.posexplode("total").alias("at", "limbs")).select("cluster", "at", F.posexplode("limbs").alias("limb", "v"))
    added = long.groupBy("cluster", "at", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # clusters x dimensions rows, more for sums above LIMB
    total, moved = {}, centroids.astype(object)
    for r in added:
        total[r["cluster"], r["at"]] = total.get((r["cluster"], r["at"]), 0) + int(r["v"]) * LIMB ** r["limb"]
    for (k, at), v in total.items():
        moved[k, at] = v // sizes[k]
    return _narrow(moved)


def _limbs(v: int) -> list[int]:
    """v in base LIMB, the lowest part first; the last one has the sign."""
    parts = []
    while not -LIMB < v < LIMB:
        v, low = divmod(v, LIMB)
        parts.append(low)
    return [*parts, v]


def _narrow(c: np.ndarray) -> np.ndarray:
    return c.astype(np.int64) if not c.size or max(abs(int(v)) for v in c.reshape(-1)) < WIDE else c.astype(object)


def centroid_clusters(rows: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, leading: int = LEADING, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector, after `rounds` rounds.

    Vectors are stored with their leading coordinates in a basis of principal axes and the norm of the rest, which bound
    distances from below; what the bound leaves is compared in whole numbers. The driver holds the centroids only.

    Kept are vectors of `dimensions` components, none null, NaN or infinite (nor infinite when scaled); others have no row. The first centroids are
    the vectors with the smallest hashes of their ids (a null id is hashed as empty; equal ids in the order of their
    components); of fewer vectors than `clusters` each is one. Repeated rows are rows of their own. A distance or sum
    that exceeds a long is null. An empty table gives no rows; other columns are ignored.
    """
    kept = kept_vectors(rows, dimensions, id_col, vector_col)
    axes = rotation(kept, dimensions, leading)
    kind = rows.schema[id_col].dataType.simpleString()
    prepared = checkpointed(kept.mapInArrow(_prepare(dimensions, axes), f"id {kind}, x array<double>, lead array<double>, rest double"))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = prepared.select(hashed.alias("h"), "x").orderBy("h", "x").limit(clusters).collect()
    centroids = _narrow(_whole(np.array([r["x"] for r in first], float).reshape(-1, dimensions)).astype(object))
    if len(first):
        for _ in range(rounds):
            centroids = _moved(prepared, centroids, axes)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in _assign(batches, centroids, axes):
            fits = [int(d) if d < 1 << 63 else None for d in distance] if distance.dtype == object else distance
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(fits, pa.int64())], ["id", "cluster", "distance"])

    placed = checkpointed(prepared.mapInArrow(last, f"id {kind}, cluster int, distance long"))
    fits = lambda s: F.when(F.count("*") == F.count("distance"), F.expr(f"try_cast({s} as long)"))
    sums = placed.groupBy("cluster").agg(fits("sum(cast(distance as decimal(38,0)))").alias("cluster_inertia"))
    whole = placed.agg(fits("sum(cast(distance as decimal(38,0)))").alias("inertia"))
    hashes = [(k, ",".join(str(int(v)) for v in c)) for k, c in enumerate(centroids)]
    named = rows.sparkSession.createDataFrame(hashes, "cluster int, numbers string").select("cluster", F.sha2("numbers", 256).alias("centroid_sha256"))
    known = F.broadcast(sums.join(named, "cluster"))  # one row for each cluster
    return placed.join(known, "cluster").crossJoin(F.broadcast(whole)).select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
