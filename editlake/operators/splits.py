"""Train, validation and test splits; each returns its input and a `split` column.

Fractions are whole percents: (70, 15) trains on n * 70 div 100 rows, validates on n * 15 div 100, tests on the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlake.operators.ordering import exact_rank, md5_key, quantile_bins, running_total, value_positions

FRACTIONS = (70, 15)


def _cut(rank: str, n: str, fractions: tuple[int, int]) -> Column:
    train, val = (F.expr(f"{n} * {f} div 100") for f in fractions)
    return F.when(F.col(rank) < train, "train").when(F.col(rank) < train + val, "val").otherwise("test")


def random_split(df: DataFrame, key: list[str], seed: str = "split", strata: tuple[str, ...] = (), fractions: tuple[int, int] = FRACTIONS, least: int = 0) -> DataFrame:
    """Rows in seeded order, cut at counts; within each stratum if given. Strata of fewer than `least` rows train."""
    ranked = exact_rank(df, md5_key(seed, *key), key, "__rank", strata)
    split = F.when(F.col("__rank_of") < least, "train").otherwise(_cut("__rank", "__rank_of", fractions))
    return ranked.withColumn("split", split).select(*df.columns, "split")


def group_allocation(df: DataFrame, group: list[str], seed: str = "split", fractions: tuple = FRACTIONS) -> DataFrame:
    """One row per group: size, rows before it in seeded order, and its split.

    Groups train until the wanted number of rows is reached, the next ones validate likewise, the rest test: in closed
    form from running sums over the groups, which are range-sorted, so that no task holds them all.
    """
    if max(fractions) < 1:
        fractions = tuple(round(100 * f) for f in fractions)
    sizes = df.groupBy(*group).agg(F.count("*").alias("size")).withColumn("__key", md5_key(seed, *group))
    placed = running_total(sizes, ["__key", *group], "size", "before")
    every = placed.agg(F.sum("size").alias("__n")).withColumn("__train", F.expr(f"__n * {fractions[0]} div 100")).withColumn("__val", F.expr(f"__n * {fractions[1]} div 100"))
    placed = placed.crossJoin(F.broadcast(every))
    reached = placed.agg(F.min(F.when(F.col("before") + F.col("size") >= F.col("__train"), F.col("before") + F.col("size"))).alias("__reached"))
    placed = placed.crossJoin(F.broadcast(reached))
    split = F.when(F.col("before") < F.col("__train"), "train").when(F.col("before") - F.col("__reached") < F.col("__val"), "val").otherwise("test")
    return placed.withColumn("split", split).select(*group, "size", "before", "split")


def group_split(df: DataFrame, group: list[str], seed: str = "split", fractions: tuple = FRACTIONS) -> DataFrame:
    """Whole groups go to one split; rows with a null group are dropped."""
    known = df.dropna(subset=group)
    return known.join(group_allocation(known, group, seed, fractions).select(*group, "split"), group).select(*df.columns, "split")


def quantile_split(df: DataFrame, key: list[str], value: str, bins: int, seed: str = "split", more: tuple[str, ...] = (), fractions: tuple[int, int] = FRACTIONS) -> DataFrame:
    """Stratified by quantile bins of a value, and by `more` columns; strata of fewer than three rows train."""
    binned = quantile_bins(df, value, bins, "__bin")
    return random_split(binned, key, seed, ("__bin", *more), fractions, least=3).drop("__bin")


def holdout_split(df: DataFrame, test: Column, key: list[str], seed: str = "split", fractions: tuple[int, int] = FRACTIONS) -> DataFrame:
    """Rows that meet `test` are the test set; of the rest, val is carved in the proportion of the fractions."""
    marked = df.withColumn("__test", F.coalesce(test, F.lit(False)))
    ranked = exact_rank(marked, md5_key(seed, *key), key, "__rank", ("__test",))
    val = F.expr(f"__rank_of * {fractions[1]} div {fractions[0] + fractions[1]}")
    return ranked.withColumn("split", F.when(F.col("__test"), "test").when(F.col("__rank") < val, "val").otherwise("train")).select(*df.columns, "split")


def listed_split(df: DataFrame, column: str, train: list, test: list, key: list[str], seed: str = "split", fractions: tuple[int, int] = FRACTIONS) -> DataFrame:
    """Rows whose value is in one of two lists: those of `test` test, val is carved from those of `train`; all others are dropped."""
    return holdout_split(df.where(F.col(column).isin(train + test)), F.col(column).isin(test), key, seed, fractions)


def rare_holdout_split(df: DataFrame, column: str, key: list[str], common: int = 70, seed: str = "split", fractions: tuple[int, int] = FRACTIONS) -> DataFrame:
    """The rarer values test: all but the first `common` percent of the values, by number of rows, then value."""
    counts = df.groupBy(column).agg((-F.count("*")).alias("__fewer"))
    placed = value_positions(counts, [], ["__fewer", column])
    m = placed.agg(F.count("*").alias("__m"))
    held = placed.crossJoin(F.broadcast(m)).where(F.expr(f"__before + 1 > __m * {common} div 100")).select(F.col(column).alias("__rare"))
    marked = df.join(held, F.col(column) == F.col("__rare"), "left").withColumn("__held", F.col("__rare").isNotNull()).drop("__rare")
    return holdout_split(marked, F.col("__held"), key, seed, fractions).drop("__held")


def ordered_split(df: DataFrame, by: str, key: list[str], fractions: tuple[int, int] = FRACTIONS) -> DataFrame:
    """Rows in the order of a time column, then of the key, cut at counts."""
    order = list(dict.fromkeys([by, *key, *df.columns]))
    placed = value_positions(df, [], order)
    ranked = placed.crossJoin(F.broadcast(placed.agg(F.sum("__n").alias("__of"))))
    each = ranked.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))).withColumn("__rank", F.col("__before") + F.col("__i") - 1)
    return each.withColumn("split", _cut("__rank", "__of", fractions)).select(*df.columns, "split")


def few_shot_split(df: DataFrame, group: str, key: list[str], shots: int, percent: int = 30, seed: str = "split", fractions: tuple[int, int] = FRACTIONS) -> DataFrame:
    """A share of the groups has only `shots` training rows, the rest of its rows validates or tests; other groups go whole."""
    groups = df.select(group).distinct()
    few = exact_rank(groups, md5_key(seed + "few", group), [group], "__g").where(F.expr(f"__g < __g_of * {percent} div 100")).select(group)
    scarce = exact_rank(df.join(few, group, "left_semi"), md5_key(seed, *key), key, "__rank", (group,))
    rest = F.expr(f"(__rank_of - {shots}) * {fractions[1]} div {100 - fractions[0]}")
    scarce = scarce.withColumn("split", F.when(F.col("__rank") < shots, "train").when(F.col("__rank") - shots < rest, "val").otherwise("test"))
    whole = group_split(df.join(few, group, "left_anti"), [group], seed, fractions)
    return scarce.select(*df.columns, "split").unionByName(whole.select(*df.columns, "split"))


def entity_split(df: DataFrame, entity: str, seed: str = "split", fractions: tuple[int, int] = (80, 10)) -> DataFrame:
    """Whole entities, cut by the number of entities."""
    ranked = exact_rank(df.select(entity).distinct(), md5_key(seed, entity), [entity], "__rank")
    return df.join(ranked.withColumn("split", _cut("__rank", "__rank_of", fractions)).select(entity, "split"), entity).select(*df.columns, "split")


def member_split(pairs: DataFrame, members: DataFrame, a: str, b: str, member: str) -> DataFrame:
    """Pairs by their members' splits: train if either trains, else val if either validates, else test."""
    left = members.select(F.col(member).alias(a), F.col("split").alias("__sa"))
    right = members.select(F.col(member).alias(b), F.col("split").alias("__sb"))
    both = pairs.join(left, a).join(right, b)
    either = lambda s: (F.col("__sa") == s) | (F.col("__sb") == s)
    return both.withColumn("split", F.when(either("train"), "train").when(either("val"), "val").otherwise("test")).select(*pairs.columns, "split")
