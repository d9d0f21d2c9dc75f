"""Structured Streaming jobs that continue where they ended."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches of changed totals after which they are merged into one table, and buckets of cores that a batch of fragments may touch.
COMPACT, BUCKETS = 16, 64
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def _folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the finished folders <prefix>N below a path, by the file system that Spark uses for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [(f.getPath().getName(), f.getPath()) for f in fs.listStatus(at)]
    done = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(n[len(prefix) :]) for n, p in names if n.startswith(prefix) and done(p))


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def incremental_totals(spark: SparkSession, source: str, schema, key: list[str], sums: list[str], out: str, checkpoint: str, files_per_batch: int = 100, compact: int = COMPACT) -> DataFrame:
    """Sums by key over files that arrive bit by bit, the same as over all at once.

    State is kept by RocksDB in the checkpoint, and a batch writes only the keys that it changed, to a folder of its own.
    The newest total of a key counts. After `compact` batches they are merged: a table of all totals up to a batch is
    written, and the folders that it replaces are removed once it is whole. A batch that runs again writes its folder
    again. A run without new files gives what the last one gave; without any file there are no rows.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    totals = stream.groupBy(*key).agg(*(F.sum(c).alias(c) for c in sums), F.count("*").alias("n"))
    names = totals.columns

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changed={number}")
        bases, changed = _folders(spark, out, "upto="), _folders(spark, out, "changed=")
        if len(changed) >= compact:
            _newest(spark, out, totals.schema, key, names).write.mode("overwrite").parquet(f"{out}/upto={number}")
            for name, numbers in (("changed", changed), ("upto", bases)):
                for k in numbers:
                    if name == "changed" or k < number:
                        _remove(spark, f"{out}/{name}={k}")

    with _setting(spark, _PROVIDER, _ROCKSDB):
        query = totals.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return _newest(spark, out, totals.schema, key, names)


def _newest(spark: SparkSession, out: str, schema, key: list[str], names: list[str]) -> DataFrame:
    """The totals of the newest merged table, replaced by those of later batches."""
    upto = max(_folders(spark, out, "upto="), default=-1)
    paths = [(k, f"{out}/changed={k}") for k in _folders(spark, out, "changed=") if k > upto]
    paths += [(upto, f"{out}/upto={upto}")] if upto >= 0 else []
    if not paths:
        return spark.createDataFrame([], schema)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:changed|upto)(?:=|%3D)(\d+)/", 1).cast("long")
    rows = spark.read.schema(schema).parquet(*(p for _, p in paths)).select(*names, number.alias("__batch"))
    values = [c for c in names if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "__batch").alias("v")).select(*key, *(F.col(f"v.{c}").alias(c) for c in values))


def incremental_pairs(spark: SparkSession, source: str, schema, out: str, checkpoint: str, files_per_batch: int = 100, buckets: int = BUCKETS) -> DataFrame:
    """Pairs of fragments that share a core, built as fragments arrive: new ones with the earlier and with each other.

    Fragments seen are kept in buckets of their cores, so a batch reads only the buckets that its own cores fall into.
    A batch that runs again writes its own folders again, so nothing is doubled after a failure.
    """
    pairs_schema, seen = "core string, mol_a long, mol_b long", f"{out}/seen"
    bucket = F.pmod(F.xxhash64("core"), F.lit(buckets)).cast("int")

    def put(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        new = batch.select("mol_id", "core", bucket.alias("bucket"), F.lit(number).alias("batch"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(seen)
        met = pairs_of_batch(spark, seen, number)
        met.write.mode("overwrite").parquet(f"{out}/pairs/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not _folders(spark, f"{out}/pairs", "batch="):
        return spark.createDataFrame([], pairs_schema)
    return spark.read.schema(pairs_schema).parquet(f"{out}/pairs").select("core", "mol_a", "mol_b")


def pairs_of_batch(spark: SparkSession, seen: str, number: int) -> DataFrame:
    """Pairs of a batch's fragments with earlier ones and each other; only the buckets that the batch touched are listed."""
    every = spark.read.schema("mol_id long, core string, bucket int, batch int").parquet(seen)
    new = every.where(F.col("batch") == number).select("mol_id", "core", "bucket")
    touched = [r[0] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets, at most
    known = every.where(F.col("bucket").isin(touched) & (F.col("batch") <= number)).select(F.col("mol_id").alias("other"), "core", "bucket", "batch")
    met = new.join(known, ["bucket", "core"]).where((F.col("mol_id") != F.col("other")) & ((F.col("batch") < number) | (F.col("mol_id") < F.col("other"))))
    return met.select("core", F.least("mol_id", "other").alias("mol_a"), F.greatest("mol_id", "other").alias("mol_b"))
