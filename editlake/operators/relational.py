"""Extraction from relational measurement data: selection, joins, dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from editlake.operators.ordering import value_positions


def with_activity(molecules: DataFrame, activity: DataFrame, key: str, condition: Column) -> DataFrame:
    """Molecules for which an activity exists that meets `condition`."""
    return molecules.join(activity.where(condition).select(key).distinct(), key, "left_semi")


def target_counts(measurements: DataFrame, group: list[str], molecule: str) -> DataFrame:
    """Distinct molecules and measurements of each target."""
    return measurements.groupBy(*group).agg(F.countDistinct(molecule).alias("n_molecules"), F.count("*").alias("n_measurements"))


def top_by(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order; Spark keeps n rows per task, never all of them in one."""
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: list[str], n: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first n rows of each group in a total order, with their rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)


def first_per_key(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in an explicit order."""
    return top_per_group(df, key, 1, *order, name="__first").drop("__first")


def unpivot_descriptors(df: DataFrame, key: str, columns: list[str], unit: str = "computed") -> DataFrame:
    """Wide descriptor columns as long measurement rows without nulls."""
    wide = df.select(key, *(F.col(c).cast("double").alias(c) for c in columns))
    return wide.unpivot(key, columns, "property_name", "value").where("value is not null").withColumn("units", F.lit(unit))


def name_slug(name: Column, kind: Column, width: int = 20) -> Column:
    """Lower case, blanks and dashes as underscores, cut to `width`, and the activity type."""
    return F.concat(F.substring(F.translate(F.lower(name), " -", "__"), 1, width), F.lit("_"), kind)


def keyword_any(columns: list[str], keywords: list[str]) -> Column:
    """Whether any keyword is in any of the columns, whatever the case."""
    import re

    return F.lower(F.concat_ws(" ", *columns)).rlike("|".join(re.escape(k.lower()) for k in keywords))


def dictionary(values: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """Dense ids (value, id) in the order of values; those of `known` stay and new values follow."""
    distinct = values.select(F.col(column).alias("value")).where("value is not null").distinct()
    start = F.lit(0)
    if known is not None:
        distinct = distinct.join(known, "value", "left_anti")
        start = F.lit(known.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0])
    new = value_positions(distinct, [], ["value"]).select("value", (start + F.col("__before")).cast("long").alias("id"))
    return known.select("value", "id").unionByName(new) if known is not None else new


def encode(df: DataFrame, words: DataFrame, column: str, to: str) -> DataFrame:
    return df.join(words.select(F.col("value").alias(column), F.col("id").alias(to)), column, "left").drop(column)


def decode(df: DataFrame, words: DataFrame, column: str, to: str, unknown: str = "Unknown") -> DataFrame:
    return df.join(words.select(F.col("id").alias(column), F.col("value").alias(to)), column, "left").withColumn(to, F.coalesce(to, F.lit(unknown))).drop(column)


def resolve_columns(df: DataFrame, synonyms: dict[str, list[str]]) -> DataFrame:
    """Canonical columns from the first synonym that is not null; absent ones are null. Zero is a value."""
    chosen = {to: [c for c in names if c in df.columns] for to, names in synonyms.items()}
    return df.select(*(F.coalesce(*names).alias(to) if names else F.lit(None).cast("string").alias(to) for to, names in chosen.items()))


def project_present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns in order, without those that are absent."""
    return df.select(*(c for c in wanted if c in df.columns))


def optional_filters(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """All conditions that are given."""
    for c in conditions:
        df = df if c is None else df.where(c)
    return df
