"""The corpus pipeline: stages over documents, each reading what the one before it kept.

A stage is called with (spark, docs, sf_dir) and its result is written as Parquet and read again for the next one.
All but the last return the columns of documents. Nulls, empty texts, repeated rows and empty tables behave as each
operator says; labels and benchmark are read beside documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editlake.llm.common import table, with_row_key
from editlake.llm.decontaminate import contaminated, decontaminated
from editlake.llm.mixing import SLOPES, curriculum_mix, mixed_documents
from editlake.llm.quality import quality_scores
from editlake.llm.sharding import interleaved_shards
from editlake.llm.simhash import near_duplicates_removed, simhash_groups
from editlake.operators.shared import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    rows = with_row_key(docs)
    rejected = quality_scores(rows, table(spark, sf_dir, "labels"), key_col="__row").where("predicted = 0").select("__row").distinct()
    return rows.join(rejected, "__row", "left_anti").select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id, then row key, of each near-duplicate group."""
    rows = with_row_key(docs)
    return near_duplicates_removed(rows, simhash_groups(rows, id_col="__row"), "__row").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    rows = with_row_key(docs)
    return decontaminated(rows, contaminated(rows, table(spark, sf_dir, "benchmark"), id_col="__row"), "__row").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each use of a document, in the order of training."""
    rows = with_row_key(docs)
    return mixed_documents(rows, curriculum_mix(rows, id_col="__row"), "__row").select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each use of a document; the slots of a shard follow the order of training, which comes as `position`."""
    return interleaved_shards(docs, slopes=SLOPES)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", sharding),
]

#: The classifier is a trained model, which SQL can't express; the stages are tested against plain re-statements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage returns is written as Parquet in the shared folder and read again by the next one."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = scratch_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
