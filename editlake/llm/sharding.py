"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editlake.llm.common import WORD, checkpointed, hex_digits, running_sum, shuffle_key, text_digest, text_of
from editlake.llm.mixing import SEED as MIX_SEED
from editlake.llm.mixing import curriculum_times

SHARDS = 40
SEED = "shard"
#: Bytes that a row takes beside its text.
OVERHEAD = 16


def interleaved_shards(docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slopes: tuple | None = None) -> DataFrame:
    """Deals rows into shards that all hold the mixture of the whole.

    Rows of a source are ranked in a seeded random order of id and text; the fractional rank (rank + offset) / (rows of
    the source), with an offset of 0 to 1 drawn for each source, spreads each source evenly over 0 to 1, and sources of
    one row too. All rows are ordered by it and cut into `shards` pieces, so that shard counts are at most one apart
    (law `rows`) and each of a few sources is in each shard within a row or two of its share; many tiny sources are
    spread at random. Equal rows are ranked as one entry with a count. Both rankings are running sums over buckets of the order: no task holds a whole source or the
    copies of a row, and no text is shuffled.

    With `slopes` the rows are uses of a curriculum (see curriculum_mix): each gets the `position` at which training comes to
    it, and the slots of a shard rise with it, so that every shard, read from its start, follows the curriculum.

    Returns id, size (UTF-8 bytes and 16), text_crc32, law, shard, slot (from 0 without gaps in each shard),
    grown_shard (null: this law does not fix where rows go when a shard is added). Null texts have no bytes and
    checksum 0; null sources are a source; null ids and repeated rows are dealt like any other row. Fewer rows than
    shards leave shards empty; an empty table gives no rows.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("crc"),
        shuffle_key(id_col, seed, text_digest(text_col)).alias("key"),
        *([F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"), shuffle_key(id_col, MIX_SEED, text_digest(text_col)).alias("mixed")] if slopes else []),
    )
    more = ["words", "mixed"] if slopes else []
    entries = checkpointed(rows.groupBy("id", "source", "size", "crc", "key", *more).agg(F.count("*").alias("copies")))
    total = entries.agg(F.sum("copies")).first()[0] or 0
    digits = hex_digits(total)
    order = [F.col("key"), F.col("id"), F.col("crc"), F.col("size")]
    ranked = running_sum(entries.withColumn("bucket", F.substring("key", 1, digits)), ["source"], "bucket", order, F.col("copies"), "rank")
    drawn = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce("__source", F.lit(""))))
    counts = entries.groupBy(F.col("source").alias("__source")).agg(F.sum("copies").alias("n")).withColumn("offset", F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / 2**32)
    spread = (
        ranked.join(counts, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("at", (F.col("rank") + F.col("copy") + F.col("offset")) / F.col("n"))
        .withColumn("slice", F.floor(F.col("at") * 16**digits).cast("long"))
        .select("id", "source", "size", "crc", "key", "copy", "at", "slice", *more)
    )
    placed = running_sum(spread, [], "slice", [F.col("at"), *order, F.col("source"), F.col("copy")], F.lit(1), "place")
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    dealt = placed.withColumn("shard", shard.cast("long")).withColumn("slot", (F.col("place") - first).cast("long"))
    if slopes:
        timed = curriculum_times(dealt.withColumnRenamed("key", "own").withColumnRenamed("mixed", "key"), slopes)
        cut = timed.withColumn("slice", F.floor(F.col("position") * 16**digits).cast("long")).drop("slot")
        dealt = running_sum(cut, ["shard"], "slice", [F.col(c) for c in ("position", "key", "id", "crc", "source", "copy")], F.lit(1), "slot")
    return dealt.select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        *(["position"] if slopes else []),
    )
