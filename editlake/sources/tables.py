"""Readers and writers of the file formats that measurement data comes in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

from editlake.operators.ordering import running_total


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, plain or gzip, by a declared schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_delimited(spark: SparkSession, path: str, sep: str, comment: str | None = None) -> DataFrame:
    """Separated text with a header whose names may have spaces around them; lines that begin with `comment` are skipped."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    return df.toDF(*(c.strip() for c in df.columns))


def read_json_records(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Records of files that hold a JSON array of objects (or one object) each, or with `lines` of files with one record a line.

    A file of either form is read by as many tasks as it has blocks; a record has to fit into one. A record that is
    no JSON has null fields.
    """
    if lines:
        return spark.read.schema(schema).json(path)
    kind = StructType.fromDDL(schema)
    return json_texts(spark, path, maps=False).select(F.from_json("text", kind).alias("r")).select("r.*")


def read_json_map(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(id, record) of files that hold one object of records (objects too) by id each, read by as many tasks as they have blocks."""
    kind = MapType(StringType(), StructType.fromDDL(schema))
    texts = json_texts(spark, path, maps=True).select(F.concat(F.lit("{"), "text", F.lit("}")).alias("text"))
    return texts.select(F.explode(F.from_json("text", kind)).alias("id", "record"))


def json_texts(spark: SparkSession, path: str, maps: bool) -> DataFrame:
    """text: each object of the arrays in some files (or the one object of a file), or with `maps` each entry `"id": {...}` of an object.

    Files are read in pieces that end with a closing brace, which Spark splits between tasks. A running count of
    unescaped quotes says whether a piece begins inside a string, a running sum of brackets outside strings how deep it
    ends; the pieces between two ends at the depth of the records are one record. An escape is never cut, since no
    brace is escaped in JSON.
    """
    order = ["file", "block", "at"]
    pieces = spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    bare = F.regexp_replace("value", r"\\.", "")
    parts = F.split(bare, '"', -1)
    outside = lambda first: F.array_join(F.transform(parts, lambda x, i: F.when((i % 2) == first, x).otherwise("")), "")
    count = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    quotes = (F.size(parts) - 1).cast("long")
    quoted = running_total(pieces.withColumn("quotes", quotes), order, "quotes", "before")
    files = quoted.groupBy("file").agg(F.min("before").alias("start"), F.min_by(F.regexp_extract("value", r"^\s*(.)", 1), F.struct("block", "at")).alias("opens"))
    placed = quoted.join(files, "file").withColumn("inside", (F.col("before") - F.col("start")) % 2)
    plain = outside(F.col("inside"))
    closes = F.when((F.col("inside") + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    sized = placed.withColumn("step", (count(plain, "{[") - count(plain, "]") - closes).cast("long")).withColumn("closes", closes)
    deep = running_total(sized, order, "step", "above")
    least = deep.groupBy("file").agg(F.min_by("above", F.struct("block", "at")).alias("first"))
    level = F.lit(1) if maps else F.when(F.col("opens") == "[", 1).otherwise(0)
    ended = deep.join(least, "file").withColumn("ends", ((F.col("closes") == 1) & (F.col("above") + F.col("step") - F.col("first") == level)).cast("long"))
    numbered = running_total(ended, order, "ends", "record")
    whole = numbered.groupBy("file", "record").agg(F.max("ends").alias("ends"), F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("p")).where("ends = 1")
    text = F.concat(F.array_join(F.col("p.value"), "}"), F.lit("}"))
    lead = r"^\s*[{,]?\s*" if maps else r"^\s*[\[,]?\s*"
    return whole.select(F.regexp_replace(text, lead, "").alias("text"))


def flatten_records(records: DataFrame, columns: dict[str, str], needed: list[str]) -> DataFrame:
    """Nested fields as columns; records that lack one of the `needed` fields are dropped."""
    kept = records
    for path in needed:
        kept = kept.where(F.col(path).isNotNull())
    return kept.select(*(F.col(path).alias(name) for name, path in columns.items()))


def parse_json_column(df: DataFrame, column: str, schema: str, to: str) -> DataFrame:
    """A JSON text column as a struct, array or map; bad text is null."""
    return df.withColumn(to, F.from_json(column, schema))


def read_relational(spark: SparkSession, location: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """A table of a database (jdbc: location, read in ranges of a numeric key) or of a folder of Parquet tables."""
    if not location.startswith("jdbc:"):
        return spark.read.parquet(f"{location}/{table}.parquet")
    reader = spark.read.format("jdbc").option("url", location).option("dbtable", table).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def embedded_database(spark: SparkSession, name: str) -> str:
    """The address of an empty database in the memory of this JVM, made by the driver that Spark brings along.

    It serves one JVM, so reading it needs a local master.
    """
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("an embedded database serves one JVM; on a cluster give the address of a server")
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return f"jdbc:derby:memory:{name}-{uuid.uuid4().hex};create=true"


def write_relational(df: DataFrame, url: str, table: str, types: dict[str, str] | None = None, mode: str = "error") -> None:
    """A table of a database; `types` gives columns their database types (text that is compared needs varchar(n))."""
    writer = df.write.mode(mode).format("jdbc").option("url", url).option("dbtable", table)
    (writer.option("createTableColumnTypes", ", ".join(f"{c} {t}" for c, t in types.items())) if types else writer).save()


def read_annotation(spark: SparkSession, path: str, features: tuple[str, ...] = ("transcript", "exon")) -> DataFrame:
    """Tab-separated interval annotation: comment lines and short lines are skipped, ids come from the attribute text."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(parts.alias("p")).where(F.size("p") >= 9)
    col = lambda i: F.get("p", F.lit(i))
    named = lambda n: F.nullif(F.regexp_extract(col(8), f'(?:^|[; ]){n} "([^"]*)"', 1), F.lit(""))
    rows = rows.where(col(2).isin(*features))
    return rows.select(col(0).alias("chrom"), col(2).alias("feature"), col(3).try_cast("long").alias("lo"), col(4).try_cast("long").alias("hi"), col(6).alias("strand"), *(named(n).alias(n) for n in ("gene_id", "gene_name", "transcript_id")))


def read_pileup(spark: SparkSession, path: str, min_coverage: int = 10) -> DataFrame:
    """Pileup text of one or many samples: at least 11 fields, enough coverage, reference A or T."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 11)
    col = lambda i: F.get("p", F.lit(i))
    picked = rows.select(col(0).alias("chrom"), col(3).try_cast("long").alias("pos"), F.upper(col(4)).alias("ref_base"), *(col(i).try_cast("long").alias(n) for i, n in ((5, "coverage"), (6, "a"), (7, "c"), (8, "g"), (9, "t"))))
    return picked.where((F.col("coverage") >= min_coverage) & F.col("ref_base").isin("A", "T"))


def read_genome_chunks(spark: SparkSession, path: str, width: int) -> DataFrame:
    """FASTA text as (chrom, chunk_no, chunk): the name up to the first blank, upper case, chunks of `width` bases.

    Lines keep their order by file, block and place. Running totals give each line its record and its offset there, and
    a line gives its part of each chunk that it reaches, so that no row ever holds a record.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where("value <> ''")
    header = F.startswith("value", F.lit(">"))
    sized = lines.withColumns({"head": header.cast("long"), "bases": F.when(header, 0).otherwise(F.length("value")).cast("long")})
    placed = running_total(running_total(sized, ["file", "block", "at"], "head", "heads"), ["file", "block", "at"], "bases", "offset")
    records = placed.where("head = 1").select((F.col("heads") + 1).alias("record"), F.regexp_extract("value", r"^>(\S+)", 1).alias("chrom"), F.col("offset").alias("start"))
    body = placed.where("head = 0").withColumn("record", F.col("heads")).join(records, "record")
    at = F.col("offset") - F.col("start")
    body = body.select("record", "chrom", F.upper("value").alias("line"), at.alias("first"))
    spread = body.withColumn("chunk_no", F.explode(F.sequence(F.expr(f"first div {width}"), F.expr(f"(first + length(line) - 1) div {width}"))))
    begin = F.greatest(F.col("first"), F.col("chunk_no") * width)
    end = F.least(F.col("first") + F.length("line"), (F.col("chunk_no") + 1) * width)
    part = F.col("line").substr((begin - F.col("first") + 1).cast("int"), (end - begin).cast("int"))
    pieces = spread.select("record", "chrom", "chunk_no", F.struct(begin.alias("begin"), part.alias("part")).alias("piece"))
    chunks = pieces.groupBy("record", "chrom", "chunk_no").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    return chunks.select("chrom", F.col("chunk_no").cast("int").alias("chunk_no"), F.array_join(F.col("pieces.part"), "").alias("chunk"))


def write_table(df: DataFrame, path: str, format: str = "parquet", partition: str | None = None, mode: str = "error") -> None:
    """CSV with a header or Parquet; any other format is an error."""
    if format not in ("csv", "parquet"):
        raise ValueError(f"unknown format: {format}")
    writer = df.write.mode(mode).format(format)
    writer = writer.option("header", True) if format == "csv" else writer
    (writer.partitionBy(partition) if partition else writer).save(path)
