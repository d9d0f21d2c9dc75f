"""Seeded orders, exact ranks and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editlake.operators.shared import checkpointed


def md5_key(seed: str, *columns: str) -> Column:
    """A pseudo-random order: md5 of the seed and the key columns joined by '|'."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


#: Rows that a bucket of a rank is to hold.
BUCKET_ROWS = 50_000


def exact_rank(df: DataFrame, key: Column, ties: list[str], name: str = "rank", strata: tuple[str, ...] = (), digits: int | None = None) -> DataFrame:
    """Adds the 0-based rank of rows, within `strata` if given, in the order of a hex `key` and `ties`.

    Rows are ranked inside buckets of the key's leading digits, as many as their number asks for, and counts per bucket
    give the offsets, so no task holds all rows or all of a stratum. Also adds `<name>_of`, the number of rows of the
    stratum.
    """
    if digits is None:
        n, digits = df.count(), 2
        while 16**digits * BUCKET_ROWS < n:
            digits += 1
    keyed = df.withColumn("__key", key).withColumn("__bucket", F.substring("__key", 1, digits))
    counts = keyed.groupBy(*strata, "__bucket").count()
    whole = Window.partitionBy(*strata)
    before = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(c).alias(f"__{c}") for c in strata), F.col("__bucket").alias("__at"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__offset"), F.sum("count").over(whole).alias(f"{name}_of"))
    same = F.col("__bucket") == F.col("__at")
    for c in strata:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    within = Window.partitionBy(*strata, "__bucket").orderBy("__key", *ties)
    ranked = keyed.withColumn("__row", F.row_number().over(within)).join(offsets, same)
    return ranked.withColumn(name, F.col("__offset") + F.col("__row") - 1).select(*df.columns, name, f"{name}_of")


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows that come before in `order`.

    Rows are range-sorted and written down; sums per partition give the offsets, which are one row for each partition.
    """
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").agg(F.sum(value).alias("__sum")).select("__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("__local", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(offsets), "__part")
    return summed.withColumn(name, F.col("__offset") + F.col("__local")).select(*df.columns, name)


def value_positions(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Distinct (keys, values) with `__n` rows and `__before`, the rows of the same keys that come before them.

    Values are counted and get running totals, so neither all rows nor those of a key meet in one task. Rows with null
    keys are left out.
    """
    counts = df.dropna(subset=keys).groupBy(*keys, *values).agg(F.count("*").alias("__n")) if keys else df.groupBy(*values).agg(F.count("*").alias("__n"))
    summed = running_total(counts, [*keys, *values], "__n", "__all")
    if not keys:
        return summed.select(*values, "__n", F.col("__all").alias("__before"))
    starts = summed.groupBy(*keys).agg(F.min("__all").alias("__start"))
    return summed.join(starts, keys).select(*keys, *values, "__n", (F.col("__all") - F.col("__start")).alias("__before"))


def exact_quantiles(df: DataFrame, value: str, shares: dict[str, float], keys: tuple[str, ...] = ()) -> DataFrame:
    """Quantiles of a column by linear interpolation, each under its name; one row, or one for each of `keys`."""
    known = value_positions(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v")), list(keys), ["__v"])
    counts = known.groupBy(*keys).agg(F.sum("__n").alias("__count"))
    sized = known.join(counts, list(keys)) if keys else known.crossJoin(F.broadcast(counts))
    columns = []
    for name, share in shares.items():
        at = (F.col("__count") - 1) * F.lit(share)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda p: (F.col("__before") <= p) & (p < F.col("__before") + F.col("__n"))
        a, b = F.max(F.when(holds(low), F.col("__v"))), F.max(F.when(holds(high), F.col("__v")))
        columns.append((a + (b - a) * F.max(at - low)).alias(name))
    return sized.groupBy(*keys).agg(*columns)


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row: the inner edges of `bins` quantile bins."""
    names = {f"__e{i}": i / bins for i in range(1, bins)}
    return exact_quantiles(df, value, names).select(F.array(*names).alias("__edges"))


def quantile_bins(df: DataFrame, value: str, bins: int, name: str = "bin", over: DataFrame | None = None) -> DataFrame:
    """Bin = number of inner edges <= value; the edges come from `over` (default: the rows themselves)."""
    return df.crossJoin(F.broadcast(quantile_edges(over if over is not None else df, value, bins))).withColumn(name, F.size(F.filter("__edges", lambda e: F.col(value) >= e))).drop("__edges")


def equal_width_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Bin of n equal intervals from smallest to largest value, the right edge in the last bin."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    index = F.when(F.col("__hi") == F.col("__lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(value) - F.col("__lo"), width))))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, index.cast("int")).drop("__lo", "__hi")
