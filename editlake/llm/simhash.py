"""SimHash near-duplicates, linked by a distributed vantage-point tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlake.llm.common import bounded_sample, checkpointed, text_of
from editlake.llm.wordbatch import Words, chunks
from editlake.operators.clustering import components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Two fingerprints within 3 bits are within 1 bit in one of their halves; each half has a vantage-point tree of its own.
HALVES = (0x00000000FFFFFFFF, 0xFFFFFFFF00000000)
#: Fingerprints for a leaf of the distributed tree; the vantage points are chosen from a sample of SAMPLE fingerprints, or PER_LEAF
#: for each leaf where these are more: 8 bytes for each LEAF / PER_LEAF = 3125 distinct fingerprints.
LEAF, SAMPLE, PER_LEAF = 50_000, 1 << 14, 16
#: Points at which the tree inside a leaf compares all, and links held before they are thinned to a forest.
FEW, LINKS = 64, 1 << 20


def _fingerprints(texts: list[bytes], shingle: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = Words(texts, lower=True)
    flat = words.buffer.tobytes()
    n = np.where(words.n > 0, np.maximum(words.n - shingle + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = words.first[text] + place
    last = np.minimum(first + shingle, words.first[text + 1]) - 1
    h = np.array([xxh64_intdigest(flat[s:e], SEED) for s, e in zip(words.start[first].tolist(), words.end[last].tolist(), strict=True)], np.uint64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(n) - n)[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp: the SimHash of each text over its word shingles, repeats included, as a signed 64-bit number."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            found = [_fingerprints(some, shingle) for some in chunks(iter(texts), len)]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).mapInArrow(of, f"id {kind}, fp long")


def _distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def build_tree(sample: np.ndarray, leaves: int) -> list:
    """Nodes (vantage point, median distance, near child, far child); a leaf is its number. The root comes last."""
    nodes, numbers = [], iter(range(1 << 62))

    def grow(points: np.ndarray, wanted: int) -> tuple:
        if wanted > 1 and len(points) > 1:
            d = _distance(points, points[0])
            mid = int(np.median(d))
            if (d > mid).any():
                near, far = grow(points[d <= mid], (wanted + 1) // 2), grow(points[d > mid], wanted // 2)
                nodes.append((int(points[0]), mid, near, far))
                return ("node", len(nodes) - 1)
        return ("leaf", next(numbers))

    nodes.append(grow(sample, leaves))
    return nodes


def shards_of(tree: list, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, home): each fingerprint's own leaf and every leaf that its ball crosses into."""
    rows, leaves, homes = [], [], []

    def walk(node: tuple, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if node[0] == "leaf":
            rows.append(at), leaves.append(np.full(len(at), node[1])), homes.append(home)
            return
        point, mid, near, far = tree[node[1]]
        d = _distance(fps[at], np.uint64(point))
        into = d - radius <= mid
        walk(near, at[into], home[into] & (d <= mid)[into])
        into = d + radius > mid
        walk(far, at[into], home[into] & (d > mid)[into])

    walk(tree[-1], np.arange(len(fps)), np.ones(len(fps), bool))
    return tuple(map(np.concatenate, (rows, leaves, homes))) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) of a graph on 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def leaf_components(fps: np.ndarray, home: np.ndarray, radius: int, mask: int = HALVES[0] | HALVES[1], reach: int | None = None) -> np.ndarray:
    """Labels of the components among the rows of a leaf, links being those between home rows and any row.

    A vantage-point tree over the masked bits of the home rows is searched by all rows at once: a branch is left where
    the triangle bound shows that it holds nothing within `reach` of those bits. What is left is compared in full.
    """
    n, a, b, held = len(fps), [], [], 0
    part, reach = fps & np.uint64(mask), radius if reach is None else reach

    def link(q: np.ndarray, p: np.ndarray) -> None:
        nonlocal a, b, held
        a.append(q), b.append(p)
        held += len(q)
        if held > LINKS:
            label = _forest(n, np.concatenate(a), np.concatenate(b))
            tied = np.flatnonzero(label != np.arange(n))
            a, b, held = [tied], [label[tied]], len(tied)

    stack = [(np.flatnonzero(home), np.arange(n))]
    while stack:
        points, queries = stack.pop()
        if not len(points) or not len(queries):
            continue
        d = _distance(part[points], part[points[0]])
        mid = int(np.median(d))
        if len(points) <= FEW or not (d > mid).any():
            for i in range(0, len(points), FEW):
                some = points[i : i + FEW]
                for j in range(0, len(queries), 1 << 14):
                    asked = queries[j : j + (1 << 14)]
                    q, p = np.nonzero(np.bitwise_count(fps[asked][:, None] ^ fps[some][None, :]) <= radius)
                    apart = asked[q] != some[p]
                    if apart.any():
                        link(asked[q][apart], some[p][apart])
            continue
        dq = _distance(part[queries], part[points[0]])
        stack.append((points[d <= mid], queries[dq - reach <= mid]))
        stack.append((points[d > mid], queries[dq + reach > mid]))
    return _forest(n, np.concatenate(a), np.concatenate(b)) if a else np.arange(n)


def near_links(points: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect exactly what lies within `radius` bits, a forest for each leaf.

    Each half of the fingerprint has a vantage-point tree, searched with half the radius: a ball of one bit crosses far
    fewer borders than one of three. Its top is built from a sample in proportion to the leaves, which hold about `leaf`
    fingerprints at any size of the input. Every fingerprint goes to its own leaf and, as a query, to each leaf that its ball reaches; there
    it meets all fingerprints within the radius.
    """
    leaves, reach = max(1, -(-points.count() // leaf)), radius // len(HALVES)
    sample = np.array([r[0] for r in bounded_sample(points.select("fp"), "fp", "tree", max(SAMPLE, PER_LEAF * leaves)).collect()], np.int64).view(np.uint64)
    trees = [build_tree(sample & np.uint64(mask), leaves) for mask in HALVES]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for half, (tree, mask) in enumerate(zip(trees, HALVES, strict=True)):
                row, at, home = shards_of(tree, fps & np.uint64(mask), reach)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), half, np.int32)), pa.array(at.astype(np.int64)), pa.array(fps[row].view(np.int64)), pa.array(home)], ["half", "leaf", "fp", "home"])

    def search(key, group):
        import pandas as pd

        group = group.sort_values("fp", ignore_index=True)
        fp = group["fp"].to_numpy(np.int64)
        label = leaf_components(fp.view(np.uint64), group["home"].to_numpy(bool), radius, HALVES[int(key[0])], reach)
        tied = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": fp[tied], "b": fp[label[tied]]})

    return points.select("fp").mapInArrow(deal, "half int, leaf long, fp long, home boolean").groupBy("half", "leaf").applyInPandas(search, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """Groups documents whose fingerprints are linked by steps of at most `radius` bits.

    Copies share a fingerprint and are one point of the tree; links are kept as forests, and components are found by
    distributed rounds, so neither the pairs of a group nor its members ever stand together in one task.

    Returns id, fingerprint (16 hex digits), component_id (smallest id reachable), one row per input row. Words are
    lower-cased in A-Z only; a text with fewer words than a shingle is one shingle; null and empty texts have
    fingerprint zero, linked like any other. Null ids are no smallest id unless a group has no other. Repeated rows
    are in one group. An empty table gives no rows; other columns are ignored.
    """
    marked = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    points = checkpointed(marked.groupBy("fp").agg(F.min("id").alias("least")))
    labels = components(near_links(points, radius, leaf), "a", "b")
    placed = points.join(labels, points.fp == labels.id, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    named = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    where = placed.join(named, "label").select("fp", "component_id")
    return marked.join(where, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates_removed(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id is the smallest of its group, one row for each id.

    Where ids are null or shared by different texts, `id_col` has to be a key of rows (`with_row_key`).
    """
    firsts = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__id")).distinct()
    return docs.join(firsts, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi").dropDuplicates([id_col])
