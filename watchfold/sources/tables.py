"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from watchfold.schemas import MESSAGE


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a given schema, or Parquet (which carries its own)."""
    if schema is not None:
        return spark.read.schema(schema).csv(path, header=True)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def read_terms(spark: SparkSession, path: str, tier: str) -> DataFrame:
    """Term list, one per line, as (tier, ord, term, kind); blank and # lines are skipped.

    A term with a space is a phrase, any other a word.  ``ord`` follows the order
    of the lines within a file.
    """
    line = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    kept = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), line.alias("line"))
    kept = kept.where((F.col("line") != "") & ~F.col("line").startswith("#"))
    term = F.lower("line")
    kind = F.when(F.instr(term, " ") > 0, "phrase").otherwise("word")
    return kept.select(F.lit(tier).alias("tier"), "ord", term.alias("term"), kind.alias("kind"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Chat messages as JSON lines, the whole line kept beside the parsed fields."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = text.select(F.col("value").alias("raw_json"), F.from_json("value", MESSAGE).alias("m"))
    return parsed.select("raw_json", "m.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Event documents of any shape: each JSON line as a VARIANT."""
    text = spark.read.text(path).where(F.trim("value") != "")
    return text.select(F.try_parse_json("value").alias("doc"))


def read_binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files as (path, modificationTime, length, content)."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def read_jdbc(
    spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None,
    column: str | None = None, lower: int | None = None, upper: int | None = None, partitions: int | None = None,
) -> DataFrame:
    """A relational table; with ``column`` and bounds it is read in parallel ranges."""
    if column:
        return spark.read.jdbc(
            url, table, column=column, lowerBound=lower, upperBound=upper, numPartitions=partitions,
            properties=properties or {},
        )
    return spark.read.jdbc(url, table, properties=properties or {})
