"""Clusters and neighbours from links that joins have found."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editlake.operators.shared import checkpointed

#: Query rows of a block and rows of a part in the neighbour search.
BLOCK, PART = 2048, 20_000
#: Rows to which the centres of an inverted file are fitted, points whose neighbours are found exactly to choose the number of lists, and
#: the share of them that the lists have to hold.
FIT, PROBE, RECALL = 20_000, 256, 0.95


def _both_ways(links: DataFrame, a: str, b: str) -> DataFrame:
    return links.select(F.col(a).alias("x"), F.col(b).alias("y")).union(links.select(F.col(b), F.col(a))).distinct()


def leader_clusters(nodes: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """nodes (id, order) and links -> (id, leader): sequential leader clustering, in rounds.

    The node that is first in `order` (then id) leads, its unassigned neighbours join it, and so on. Each link points
    from the earlier to the later node. In a round the nodes that no open link points to lead and the nodes that
    they point to become members, which gives the same leaders as going through them one by one; the links of both are
    closed, so a round reads and writes only what is still open. A member ends with the first leader among its neighbours.
    """
    both = checkpointed(_both_ways(links, a, b))
    ranked = nodes.select("id", F.struct("order", "id").alias("r"))
    side = lambda s: ranked.select(F.col("id").alias(s), F.col("r").alias(f"r_{s}"))
    open_links = checkpointed(both.join(side("x"), "x").join(side("y"), "y").where("r_x < r_y").select("x", "y"))
    ids = lambda df, s: df.select(F.col(s).alias("id"))
    taken = None
    while not open_links.isEmpty():
        leads = ids(open_links, "x").distinct().join(ids(open_links, "y"), "id", "left_anti")
        members = checkpointed(ids(open_links.join(leads.withColumnRenamed("id", "x"), "x", "left_semi"), "y").distinct())
        taken = members if taken is None else taken.unionByName(members)
        left = open_links.join(leads.withColumnRenamed("id", "x"), "x", "left_anti")
        for s in ("x", "y"):
            left = left.join(members.withColumnRenamed("id", s), s, "left_anti")
        open_links = checkpointed(left.select("x", "y"))
    if taken is None:
        return ranked.select("id", F.col("id").alias("leader"))
    own = ranked.join(taken, "id", "left_anti")
    first = both.join(own.select(F.col("id").alias("y"), "r"), "y").groupBy(F.col("x").alias("id")).agg(F.min("r").alias("first"))
    return own.select("id", F.col("id").alias("leader")).unionByName(taken.join(first, "id").select("id", F.col("first.id").alias("leader")))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, label): the smallest id that each linked node reaches; minima travel and paths halve in each round."""
    both = checkpointed(_both_ways(links, a, b))
    label = checkpointed(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("x")).alias("label")))
    while True:
        near = both.join(label.select(F.col("id").alias("y"), "label"), "y").groupBy(F.col("x").alias("id")).agg(F.min("label").alias("least"))
        step = label.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "least").alias("via"))
        label = checkpointed(step.join(label.select(F.col("id").alias("via"), F.col("label").alias("far")), "via", "left").select("id", "old", F.least("via", "far").alias("label")))
        if label.where("label <> old").isEmpty():
            return label.select("id", "label")


def density_series(links: DataFrame, a: str, b: str, min_samples: int, min_size: int) -> DataFrame:
    """(id, series): density clusters. A node with min_samples nodes in reach, itself too, is a core; cores that are
    linked share a series, other nodes join the smallest series of a linked core, the rest is noise and left out."""
    both = _both_ways(links, a, b)
    core = checkpointed(both.groupBy(F.col("x").alias("id")).agg((F.count("*") + 1).alias("n")).where(F.col("n") >= min_samples).select("id"))
    inner = both.join(core.select(F.col("id").alias("x")), "x").join(core.select(F.col("id").alias("y")), "y").where("x < y")
    label = core.join(components(inner, "x", "y"), "id", "left").select("id", F.coalesce("label", "id").alias("series"))
    border = both.join(label.select(F.col("id").alias("y"), "series"), "y").join(core.select(F.col("id").alias("x")), "x", "left_anti").groupBy(F.col("x").alias("id")).agg(F.min("series").alias("series"))
    every = label.unionByName(border)
    return every.join(every.groupBy("series").count().where(F.col("count") >= min_size).select("series"), "series", "left_semi").select("id", "series")


def knn_cosine(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """(query, neighbour, similarity, rank): the k nearest rows of every query by cosine, itself left out; exact.

    Queries come in blocks of about BLOCK and rows in parts of about PART; each (block, part) is one matrix product in
    a task of bounded size and returns k rows a query, of which the best k of all parts stay.
    """
    blocks, parts = max(1, -(-queries.count() // BLOCK)), max(1, -(-rows.count() // PART))
    dealt = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")  # noqa: E731  of the type that a sequence has: cogroup casts no keys, and others would not meet
    asked = queries.select(F.col(key).alias("id"), F.col(vector).alias("v"), dealt(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    given = rows.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), dealt(parts).alias("part"))

    def unit(v: pd.Series) -> np.ndarray:
        x = np.array(v.tolist(), float)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if q.empty or r.empty:
            return pd.DataFrame({"query": [], "neighbour": [], "similarity": []})
        ids, out = r["id"].to_numpy(), []
        for one, scores in zip(q["id"], np.round(unit(q["v"]) @ unit(r["v"]).T, 6), strict=True):
            order = np.lexsort((ids, -scores))[: k + 1]
            out += [(one, ids[j], scores[j]) for j in order if ids[j] != one][:k]
        return pd.DataFrame(out, columns=["query", "neighbour", "similarity"])

    kind = rows.schema[key].dataType.simpleString()
    found = asked.groupBy("block", "part").cogroup(given.groupBy("block", "part")).applyInPandas(best, f"query {kind}, neighbour {kind}, similarity double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "neighbour"))).where(F.col("rank") <= k)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _sample(rows: DataFrame, key: str, seed: str, most: int) -> list:
    """The first rows in a seeded order of keys, at most `most`."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(most).collect()


def centres_of(rows: DataFrame, key: str, vector: str, lists: int, rounds: int = 5) -> np.ndarray:
    """Unit vectors for an inverted file, by spherical k-means on a sample of at most FIT rows."""
    x = _unit(np.array([r[vector] for r in _sample(rows, key, "lists", max(FIT, lists))], float))
    centres = x[:lists].copy()
    for _ in range(rounds):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        met = np.bincount(home, minlength=len(centres)) > 0
        centres[met] = _unit(sums[met])
    return centres


def knn_cosine_all(rows: DataFrame, key: str, vector: str, k: int = 5, recall: float = RECALL) -> DataFrame:
    """(query, neighbour, similarity, rank): k near rows of every row by cosine, itself left out; similarities are exact.

    Equal vectors are one point with their k + 1 smallest keys, so a vector that many rows have costs one. Points are
    filed under the nearest of about sqrt(n) centres; each looks into the lists of its nearest centres and is compared
    with all points there, in blocks and parts of bounded size. How many lists is measured: for PROBE points the exact
    neighbours are found over all points, and as many lists are taken as hold `recall` of them. Vectors of one length
    with neighbourhoods need few lists; where vectors lie at random, nearly half of them have to be searched.
    """
    keyed = checkpointed(rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")))
    first = keyed.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1)
    points = checkpointed(first.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("v", "id").alias("v")))
    n = points.count()
    centres = centres_of(points, "id", "v", math.ceil(math.sqrt(n))) if n else np.zeros((1, 1))
    kind = rows.schema[key].dataType.simpleString()

    def filed(lists: int):
        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                near = np.argsort(-(_unit(np.array(batch["v"].tolist(), float)) @ centres.T), axis=1, kind="stable")[:, :lists] if len(batch) else np.zeros((0, 1), int)
                yield batch.assign(near=near.astype(np.int32).tolist())

        return points.select("id", "v").mapInPandas(of, f"id {kind}, v array<double>, near array<int>")

    asked = points.sparkSession.createDataFrame([(r["id"], r["v"]) for r in _sample(points.select("id", "v"), "id", "probe", PROBE)], f"id {kind}, v array<double>")
    truth = knn_cosine(points.select("id", "v"), asked, "id", "v", k)
    homes = filed(1).select(F.col("id").alias("neighbour"), F.col("near")[0].alias("home"))
    wanted = truth.join(homes, "neighbour").join(asked.select(F.col("id").alias("query"), "v"), "query").select("v", "home").collect()  # k rows for each of PROBE points
    probes = 1
    if wanted:
        order = np.argsort(-(_unit(np.array([r["v"] for r in wanted])) @ centres.T), axis=1, kind="stable")
        places = np.sort((order == np.array([r["home"] for r in wanted])[:, None]).argmax(axis=1))
        probes = int(places[min(len(places) - 1, math.ceil(recall * len(places)) - 1)]) + 1
    dealt = checkpointed(filed(probes))
    looks = dealt.select("id", "v", F.posexplode("near").alias("no", "list"))
    sizes = looks.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.count_if(F.col("no") == 0) / PART)).alias("parts"))
    sized = looks.join(F.broadcast(sizes), "list")  # a row for each list, sqrt(n)
    spread = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    queries = sized.select("id", "v", "list", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), spread("parts").alias("part"))
    renewed = [F.col(c).alias(c) for c in ("id", "v", "list")]  # columns of their own: both sides come from one frame
    members = sized.where("no = 0").select(*renewed, spread("blocks").alias("block"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))

    def best(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            r = r.sort_values("id", ignore_index=True)
            ids = r["id"].to_numpy()
            for i in range(0, len(q), 256):
                scores = np.round(_unit(np.array(q["v"][i : i + 256].tolist())) @ _unit(np.array(r["v"].tolist())).T, 6)
                top = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
                out.append(pd.DataFrame({"query": np.repeat(q["id"].to_numpy()[i : i + 256], top.shape[1]), "other": ids[top].reshape(-1), "similarity": np.take_along_axis(scores, top, 1).reshape(-1)}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "other": [], "similarity": []})

    at = ["list", "block", "part"]
    met = queries.groupBy(*at).cogroup(members.groupBy(*at)).applyInPandas(best, f"query {kind}, other {kind}, similarity double")
    apart = met.where("query <> other").withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "other"))).where(F.col("r") <= k)
    named = apart.join(points.select(F.col("id").alias("other"), "ids"), "other").select("query", "similarity", "ids")
    own = points.select(F.col("id").alias("query"), F.lit(1.0).alias("similarity"), "ids")
    listed = named.unionByName(own).select("query", "similarity", F.explode("ids").alias("neighbour"))
    ranked = listed.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("similarity").desc(), "neighbour"))).where(F.col("r") <= k + 1)
    of_point = ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "neighbour", "similarity"))).alias("near"))
    row_of = keyed.select("id", "h1", "h2").join(points.select("h1", "h2", F.col("id").alias("query")), ["h1", "h2"]).select("id", "query")
    others = row_of.join(of_point, "query").select(F.col("id").alias("query"), F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k).alias("near"))
    return others.select("query", F.posexplode("near").alias("i", "x")).select("query", "x.neighbour", "x.similarity", (F.col("i") + 1).alias("rank"))


def neighbour_delta(neighbours: DataFrame, rows: DataFrame, key: str, value: str) -> DataFrame:
    """(query, gap): the mean absolute difference of a value between a query row and its neighbours."""
    own = rows.select(F.col(key).alias("query"), F.col(value).alias("__own"))
    theirs = rows.select(F.col(key).alias("neighbour"), F.col(value).alias("__theirs"))
    return neighbours.join(own, "query").join(theirs, "neighbour").groupBy("query").agg(F.avg(F.abs(F.col("__theirs") - F.col("__own"))).alias("gap"))
