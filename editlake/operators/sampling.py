"""Class balancing by seeded, matched sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlake.operators.ordering import exact_quantiles, exact_rank, md5_key, quantile_edges


def sample_count(df: DataFrame, key: list[str], n: int | Column, seed: str = "sample", strata: tuple[str, ...] = ()) -> DataFrame:
    """The first n rows of a seeded order, in each stratum if given; n may be a column."""
    ranked = exact_rank(df, md5_key(seed, *key), key, "__rank", strata)
    return ranked.where(F.col("__rank") < n).select(*df.columns)


def sample_fraction(df: DataFrame, key: list[str], percent: int, seed: str = "sample") -> DataFrame:
    """Exactly n * percent div 100 rows."""
    ranked = exact_rank(df, md5_key(seed, *key), key, "__rank")
    return ranked.where(F.expr(f"__rank < __rank_of * {percent} div 100")).select(*df.columns)


def positives_and(df: DataFrame, label: str, key: list[str], negatives: int, positives: int | None = None, seed: str = "sample") -> DataFrame:
    """All positives (or a number of them) and a number of negatives."""
    quota = F.when(F.col(label) == 1, F.lit(positives if positives is not None else 1 << 62)).otherwise(F.lit(negatives))
    return sample_count(df, key, quota, seed, (label,))


def ratio_negatives(df: DataFrame, label: str, key: list[str], ratio: int, seed: str = "sample") -> DataFrame:
    """All positives and `ratio` negatives for each of them, as far as there are any."""
    n = df.agg(F.count_if(F.col(label) == 1).alias("__n"))
    joined = df.crossJoin(F.broadcast(n))
    return sample_count(joined, key, F.when(F.col(label) == 1, F.lit(1 << 62)).otherwise(F.col("__n") * ratio), seed, (label,)).drop("__n")


def matched_negatives(df: DataFrame, label: str, key: list[str], n: int, strata: list[str], seed: str = "sample") -> DataFrame:
    """Negatives in the proportions of the positives: n * (positives of a stratum) div (all positives) from each stratum."""
    positives = df.where(F.col(label) == 1)
    quota = positives.groupBy(*strata).agg(F.count("*").alias("__k")).crossJoin(F.broadcast(positives.agg(F.count("*").alias("__all"))))
    quota = quota.withColumn("__quota", F.expr(f"{n} * __k div __all")).drop("__k", "__all")
    negatives = df.where(F.col(label) != 1).join(quota, strata)
    return sample_count(negatives, key, F.col("__quota"), seed, tuple(strata)).select(*df.columns)


def positive_bins(df: DataFrame, label: str, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Quantile bins whose edges come from the positives."""
    edges = quantile_edges(df.where(F.col(label) == 1), value, bins)
    return df.crossJoin(F.broadcast(edges)).withColumn(name, F.size(F.filter("__edges", lambda e: F.col(value) >= e))).drop("__edges")


def within_positive_range(df: DataFrame, label: str, value: str) -> DataFrame:
    """Positives, and negatives whose value lies between the positives' extremes."""
    ends = df.where(F.col(label) == 1).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return df.crossJoin(F.broadcast(ends)).where((F.col(label) == 1) | F.col(value).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def hard_negatives(df: DataFrame, label: str, value: str, key: list[str], n: int, condition: Column, seed: str = "sample") -> DataFrame:
    """Negatives with at least the positives' median value that meet a condition, n at most."""
    median = exact_quantiles(df.where(F.col(label) == 1), value, {"__median": 0.5})
    good = df.where((F.col(label) != 1) & condition).crossJoin(F.broadcast(median)).where(F.col(value) >= F.col("__median")).drop("__median")
    return sample_count(good, key, n, seed)


def variance_weights(df: DataFrame, mean_a: str, std_a: str, mean_b: str, std_b: str) -> DataFrame:
    """Weight of a log2 ratio: one over its propagated variance from the two coefficients of variation, mean 1."""
    square = lambda m, s: F.pow(F.try_divide(F.col(s), F.col(m)), 2)
    variance = (square(mean_a, std_a) + square(mean_b, std_b)) / (F.ln(F.lit(2.0)) * F.ln(F.lit(2.0)))
    raw = df.withColumn("__w", 1 / F.greatest(variance, F.lit(1e-6)))
    return raw.crossJoin(F.broadcast(raw.agg(F.avg("__w").alias("__mean")))).withColumn("weight", F.col("__w") / F.col("__mean")).drop("__w", "__mean")
