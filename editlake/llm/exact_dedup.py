"""Exact deduplication by a tree of merged digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlake.llm.common import SPACE, checkpointed, text_of

#: What has to agree before two rows merge: the SHA-256, a second hash and the length of the normalised text.
SAME = ["digest", "second", "n_normal"]


def _slice(bits: int) -> Column:
    """The leading bits of a digest: the part of the digest range that a task of a round holds."""
    return F.shiftright(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), 32 - bits)


def merged(runs: DataFrame, tasks: int, bits: int) -> DataFrame:
    """Sorted runs (run, digest, ...) that share a number become one sorted run, cut into 2^bits ranges of the digest.

    What a task receives is one range of one run; it is sorted and equal verified digests collapse to the smallest
    (shorter, id, row), so each run holds a digest once.
    """
    placed = runs.withColumn("slice", _slice(bits)).repartition(tasks, "run", "slice").sortWithinPartitions("run", "slice", *SAME)
    return placed.groupBy("run", "slice", *SAME).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size")).drop("slice")


def run_tree(leaves: DataFrame, runs: int) -> DataFrame:
    """Runs (run from 0, one row for each digest) -> one run, in ceil(log2(runs)) binomial rounds.

    In a round the runs 2 i and 2 i + 1 exchange halves of their digest ranges: run i of the next level is cut into twice
    as many ranges, so every task of every round holds one range of one run and none ever holds a whole level.
    """
    level, bits = leaves, 0
    tasks = max(1, runs)
    while runs > 1:
        runs, bits = (runs + 1) // 2, bits + 1
        level = merged(level.withColumn("run", F.shiftright("run", 1)), tasks, min(bits, 31))
    return level


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups texts that are equal but for white space and marks the row of each group that stays.

    Every input partition sorts its digests into a run, in which equal digests are one entry with a count. Binomial
    rounds of `run_tree` merge the runs pairwise until one is left. Rows merge only if SHA-256, a second 64-bit hash
    and the length of the normalised text all agree: each level verifies the digest. What stays goes back to the leaf
    runs and from there to the rows of each partition, so the copies of a large group never meet in one task, and the
    text itself is never shuffled.

    Returns one row per input row: id, keep_id, group_size, kept, text_sha256. Of equal texts stays the row with most
    code points in the original text, then the smallest id. Null text counts as empty; empty texts form one group.
    A null id sorts before any other. Of rows repeated with the same id and length exactly one is kept. An empty
    table gives an empty result; other columns of the input play no part.
    """
    normal = F.regexp_replace(text_of(text_col), SPACE, "")
    rows = checkpointed(
        docs.select(
            F.col(id_col).alias("id"),
            F.length(text_of(text_col)).alias("n"),
            normal.alias("normal"),
        ).select(
            "id",
            (-F.col("n")).alias("shorter"),
            F.monotonically_increasing_id().alias("row"),
            F.spark_partition_id().cast("long").alias("run"),
            F.unhex(F.sha2("normal", 256)).alias("digest"),
            F.xxhash64("normal").alias("second"),
            F.length("normal").alias("n_normal"),
        )
    )
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    entries = rows.select("run", *SAME, F.struct("shorter", "id", "row").alias("best"), F.lit(1).cast("long").alias("group_size"))
    leaves = checkpointed(entries.groupBy("run", *SAME).agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size")))
    groups = run_tree(leaves, runs).select(*SAME, "best", "group_size")
    placed = leaves.select("run", *SAME).join(groups, SAME)
    return rows.join(placed, ["run", *SAME]).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
