"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editlake.operators.shared import checkpointed  # noqa: F401  for the operators of this folder

#: A word, in Java, RE2 and Python syntax alike: anything but space and the control white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Marked for broadcast where its counted rows are at most `most`; else joined by a shuffle."""
    return F.broadcast(df) if rows <= most else df


def with_row_key(docs: DataFrame, id_col: str = "doc_id", name: str = "__row") -> DataFrame:
    """Adds a key that tells apart rows of one id or of none: the id, null ids last, and a 128-bit hash of the row.

    Only wholly equal rows share a key. Its order is that of ids, so the smallest key of a group has its smallest id.
    """
    row = [F.col(c) for c in docs.columns]
    return docs.withColumn(name, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(*row, *(c.isNull() for c in row)).alias("a"), F.xxhash64(F.lit("b"), *row, *(c.isNull() for c in row)).alias("b")))


def shuffle_key(id_column: str, seed: str, *more: Column) -> Column:
    """A seeded pseudo-random order as 32 hex digits, the same in every engine; a null id counts as empty.

    `more` (such as a digest of the text) tells apart rows of one id or of none, which would share a place otherwise.
    """
    parts = [F.coalesce(F.col(id_column).cast("string"), F.lit("")), *more]
    return F.md5(F.concat_ws("|", F.lit(seed), *parts))


def text_digest(column: str = "text") -> Column:
    """MD5 of a text, null as empty."""
    return F.md5(text_of(column))


def bounded_sample(df: DataFrame, id_column: str, seed: str, most: int) -> DataFrame:
    """At most `most` rows, the first in a seeded order of ids; for fitting only.

    A threshold on the order's leading digits leaves about a third more rows than asked for before they are sorted, so
    that what tasks send for the sort does not grow with their number.
    """
    key, total = shuffle_key(id_column, seed), df.count()
    if total > 2 * most:
        share = (1.3 * most + 100) / total
        df = df.where(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") < F.lit(int(share * 16**8)))
    return df.withColumn("__key", key).orderBy("__key", id_column).limit(most).drop("__key")


def hex_digits(rows: int, per_bucket: int = 20_000) -> int:
    """How many leading hex digits of a shuffle key make buckets of about `per_bucket` rows; two at least."""
    digits = 2
    while 16**digits * per_bucket < rows:
        digits += 1
    return digits


def running_sum(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the same `keys` that come before in (bucket, order).

    A key may hold any share of the rows. Sums per (key, bucket) are small and get their offsets by a window over
    buckets; rows are then ordered only inside their own bucket, so no task ever holds a whole key. Null keys are
    keys of their own.
    """
    at = [F.col(k) for k in keys]
    sums = df.groupBy(*at, bucket).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*at).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(bucket).alias("__bucket"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*at, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("__local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = F.col(bucket) == F.col("__bucket")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = local.join(offsets, same).withColumn(name, (F.col("__offset") + F.col("__local")).cast("long"))
    return joined.select(*df.columns, name)
