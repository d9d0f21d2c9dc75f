"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editlake.llm.common import WORD, checkpointed, small, text_of

SHINGLE = 5
THRESHOLD = 0.8
#: Rows of a benchmark's sketches (16 bytes), or its shingles (some 40), up to which they are broadcast, and documents with candidates (16); more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_DOCS = 500_000, 2_000_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _places(words: Column, shingle: int) -> Column:
    """First word of each shingle; a text with fewer words than a shingle is one shingle."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - shingle, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column, shingle: int) -> Column:
    return F.transform(_places(words, shingle), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(shingle))))


def _strings(words: Column, shingle: int) -> Column:
    return F.array_distinct(F.transform(_places(words, shingle), lambda i: F.array_join(F.slice(words, i + 1, shingle), " ")))


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a benchmark item of whose distinct word shingles it holds `threshold` or more.

    A short item in a long document has a tiny Jaccard similarity, so whole-document MinHash signatures would miss it.
    Instead each item keeps a MinHash sketch of its own: of n shingles the floor((1 - threshold) n) + 1 with the
    smallest hashes. A document with containment `threshold` lacks fewer than that many, hence holds at least one of
    them: the search loses nothing. Items are partitioned by size (powers of two). A partition has the largest sketch
    hash of its items as cut-off and the smallest number of shingles that its items ask for; a document probes with
    its hashes up to the largest cut-off among the partitions that it is long enough for. Documents with candidates are
    read again and their shingles compared with those of the items as strings; their ids are broadcast if they are
    counted to be few, so that no text is shuffled, else joined by a shuffle.

    Returns id, item_id, n_item_shingles, n_shared, containment; distinct. Words are lower-cased. A text of fewer words
    than a shingle is one shingle, found only in a document of the same words. Null and empty texts hold nothing and
    are in nothing. Rows repeated with one id give one pair, with the larger count where texts differ; null ids can be
    in pairs. No rows on either side, no pairs.
    """
    items = (
        benchmark.select(F.col(item_col).alias("item"), _words(text_of(item_text_col)).alias("words"))
        .select("item", _strings(F.col("words"), shingle).alias("strings"), F.array_distinct(_hashes(F.col("words"), shingle)).alias("hashes"))
        .withColumn("n", F.size("strings"))
        .where("n > 0")
        .withColumn("need", F.ceil(F.col("n") * threshold - 1e-9).cast("int"))
        .withColumn("kind", F.floor(F.log2("n")).cast("int"))
        .withColumn("sketch", F.slice(F.sort_array("hashes"), F.lit(1), F.col("n") - F.col("need") + 1))
    )
    items = checkpointed(items)
    kinds = items.groupBy("kind").agg(F.max(F.element_at("sketch", -1)).alias("cut"), F.min("need").alias("need")).orderBy("kind").collect()
    if not kinds:
        cut = F.lit(None).cast("long")
    else:
        cut = F.greatest(*(F.when(F.col("n_doc") >= k["need"], F.lit(k["cut"])) for k in kinds), F.lit(None).cast("long"))
    sizes = items.agg(F.sum(F.size("sketch")).alias("sketch"), F.sum("n").alias("shingles")).first()
    sketch = small(items.select("item", "need", F.explode("sketch").alias("hash")), sizes["sketch"] or 0, BROADCAST_ROWS)
    index = small(items.select("item", "n", "need", F.explode("strings").alias("string")), sizes["shingles"] or 0, BROADCAST_ROWS)
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("k"), text_of(text_col).alias("text"))
    probes = (
        given.select("id", "k", _words(F.col("text")).alias("words"))
        .select("id", "k", _hashes(F.col("words"), shingle).alias("hashes"))
        .withColumn("n_doc", F.size("hashes"))
        .withColumn("cut", cut)
        .select("id", "k", "n_doc", F.explode(F.filter("hashes", lambda h: h <= F.col("cut"))).alias("hash"))
    )
    found = checkpointed(probes.join(sketch, "hash").where(F.col("n_doc") >= F.col("need")).select(F.col("id").alias("__id"), F.col("k").alias("__k")).distinct())
    asked = small(found, found.count(), BROADCAST_DOCS)
    held = (
        given.join(asked, (F.col("k") == F.col("__k")) & F.col("id").eqNullSafe(F.col("__id")), "left_semi")
        .select("id", "k", _words(F.col("text")).alias("words"))
        .select("id", "k", F.explode(_strings(F.col("words"), shingle)).alias("string"))
        .join(index, "string")
        .groupBy("id", "k", "item", "n", "need")
        .agg(F.countDistinct("string").alias("shared"))
        .where("shared >= need")
    )
    best = held.groupBy("id", "item", "n").agg(F.max("shared").alias("shared"))
    return best.select(
        F.col("id").alias(id_col),
        F.col("item").alias("item_id"),
        F.col("n").cast("long").alias("n_item_shingles"),
        F.col("shared").cast("long").alias("n_shared"),
        F.round(F.col("shared") / F.col("n"), 6).alias("containment"),
    )


def decontaminated(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` that are in no pair; where ids are null or shared, `id_col` has to be a key of rows (`with_row_key`)."""
    hit = pairs.select(F.col(id_col).alias("__id")).distinct()
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col("__id")), "left_anti")
