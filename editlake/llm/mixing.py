"""Mixing sources to target weights along a curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editlake.llm.common import WORD, checkpointed, hex_digits, running_sum, shuffle_key, text_digest, text_of

SEED = "mix"
WEIGHTS = (3, 1, 2)
#: Size of the mix and most uses of a source, as multiples of what there is.
SHARE, MOST = 1.5, 2.0
#: How a source's weight changes from the start to the end of training: the weight at time t (0 to 1) is its mean weight times 1 + slope (2 t - 1).
SLOPES = (0.5, 0.0, -0.5)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> also place (0, 1, ... by code point, null last), weight and target.

    Targets share `share` times all sizes by weight. A target above `most` times its source's size is cut to that
    and the excess goes to the others by weight, until none is above: sorted by limit / weight, the sources before
    the first one whose limit lies above its part of what is left are the cut ones. One row per source: small.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("place", F.row_number().over(every) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, whole = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = (
        placed.withColumn("limit", most * F.col("source_size"))
        .withColumn("left_size", share * F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("each", F.when(F.col("limit") * F.col("left_weight") > F.col("left_size") * F.col("weight"), F.col("left_size") / F.col("left_weight")))
        .withColumn("level", F.first("each", ignorenulls=True).over(whole))
    )
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return left.select("source", "source_size", "place", "weight", target.cast("double").alias("target"))


def curriculum_mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, slopes: tuple = SLOPES, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document a weighted mix takes, and when in training each of its uses comes.

    The documents of a source make one stream in a seeded random order of id and text; the mix reads that stream, again
    from its start where the target is larger than the source, up to the target in words: the last document may be
    used in part. The weight of a source changes in time; its integral D(t) is the words asked of the source up to
    time t, and a use in the middle of whose words the stream stands at c gets the position t with D(t) = c. Rows come
    range-sorted by the position of their first use. Equal rows are one entry with a count until they have their
    places; streams are running sums over buckets of the order: no task holds a whole source or the copies of a row.

    Returns id, size (words), source_size, target, taken, uses (array of position, 0 to 1, and words taken, in order) and
    position (of the first use, null where nothing is taken). Null and empty texts have size 0 and are never taken;
    null sources are a source, the last; repeated rows count as rows of their own. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        shuffle_key(id_col, seed, text_digest(text_col)).alias("key"),
    )
    entries = checkpointed(rows.groupBy("id", "source", "size", "key").agg(F.count("*").alias("copies")))
    targets = source_targets(entries.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, most)
    digits = hex_digits(entries.count())
    streams = running_sum(entries.withColumn("bucket", F.substring("key", 1, digits)), ["source"], "bucket", [F.col("key"), F.col("id"), F.col("size")], F.col("size") * F.col("copies"), "first")
    rest = F.col("asked") % F.col("source_size")
    a = F.col("slope")

    def at(before: Column, words: Column) -> Column:
        y = F.least(F.lit(1.0), (before + words / 2) / F.col("target"))
        time = F.when(a == 0, y).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * y) - (1 - a)) / (2 * a))
        return F.struct(F.round(time, 9).alias("position"), words.cast("long").alias("words"))

    none = F.array().cast("array<struct<position:double,words:bigint>>")
    full = F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1), lambda p: at(p * F.col("source_size") + F.col("start"), F.col("size")))
    whole = F.when((F.col("passes") > 0) & (F.col("size") > 0), full).otherwise(none)
    last = F.when(F.col("part") > 0, F.array(at(F.col("passes") * F.col("source_size") + F.col("start"), F.col("part")))).otherwise(none)
    return (
        streams.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("asked", F.floor("target").cast("long"))
        .withColumn("slope", F.element_at(F.array(*map(F.lit, slopes)), (F.col("place") % len(slopes) + 1).cast("int")))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("asked div source_size")).otherwise(0).cast("long"))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("start", F.col("first") + F.col("copy") * F.col("size"))
        .withColumn("part", F.when(F.col("source_size") > 0, F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("start")))).otherwise(0).cast("long"))
        .withColumn("uses", F.concat(whole, last))
        .select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("passes") * F.col("size") + F.col("part")).alias("taken"), F.get("uses", F.lit(0))["position"].alias("position"), "uses")
        .orderBy(F.col("position").asc_nulls_last(), id_col)
    )


def curriculum_times(uses: DataFrame, slopes: tuple = SLOPES) -> DataFrame:
    """Adds `position`, the time (0 to 1) at which the curriculum comes to each row of an already mixed table.

    uses has source, key (the seeded order of a stream), copy (0 for the first use of a row, 1 for the next, ...) and
    words. A source's stream is its rows by copy and key; the use in whose middle it stands at a share y of its words
    gets the position t with D(t) = y, as in curriculum_mix. Streams are running sums over buckets: no task holds a source.
    """
    digits = hex_digits(uses.count())
    bucketed = uses.withColumn("__piece", F.concat(F.lpad(F.col("copy").cast("string"), 10, "0"), F.substring("key", 1, digits)))
    streams = running_sum(bucketed, ["source"], "__piece", [F.col("copy"), F.col("key")], F.col("words"), "__before")
    totals = uses.groupBy(F.col("source").alias("__source")).agg(F.sum("words").alias("__total")).withColumn("__place", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1)
    sloped = totals.withColumn("__slope", F.element_at(F.array(*map(F.lit, slopes)), (F.col("__place") % len(slopes) + 1).cast("int")))
    a, y = F.col("__slope"), F.least(F.lit(1.0), (F.col("__before") + F.col("words") / 2) / F.greatest("__total", F.lit(1)))
    time = F.when(a == 0, y).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * y) - (1 - a)) / (2 * a))
    return streams.join(sloped, F.col("source").eqNullSafe(F.col("__source"))).select(*uses.columns, F.round(time, 9).alias("position"))


def mixed_documents(docs: DataFrame, mix: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents as the mix uses them: a row for each use, range-sorted by position; a use in part counts from one half on.

    Rows that share `id_col` have to be equal (`with_row_key`): one of them stands for all of their uses. Columns are
    those of `docs`.
    """
    uses = mix.select(F.col(id_col).alias("__id"), "size", F.explode("uses").alias("use")).where("2 * use.words >= size").select("__id", F.col("use.position").alias("__position"))
    once = docs.dropDuplicates([id_col])
    return once.join(uses, F.col(id_col).eqNullSafe(F.col("__id"))).orderBy("__position", id_col).select(*docs.columns)
