"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest.  A batch of documents is digested,
reduced to one row per digest, anti-joined with the index (a sort-merge join in which
the index side is not shuffled) and appended.  The index remembers which batch brought a
digest, so a batch that is run again after its append gets the answer it got before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from watchfold.llm.common import written
from watchfold.session import shared_dir

SALTS = 64


def normalised(text: Column) -> Column:
    """The text without the characters ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_sha256, points, tag): digest of the normalised text, code points of the original, a number for the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("text_sha256"),
        F.length(text).cast("bigint").alias("points"),
        F.monotonically_increasing_id().alias("tag"),
    )


class DigestIndex:
    """A digest table of the catalog: ``text_sha256``, the ``keep_id`` and size of its first group, and the ``batch`` that brought it."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64, path: str | None = None):
        """Open the index ``table``, or let ``prepare`` create it; ``buckets`` and ``path`` (else the warehouse) count only then."""
        self.spark, self.table, self.buckets, self.path = spark, table, buckets, path

    def prepare(self, id_type: str) -> None:
        """Create the table, empty, if it is not there."""
        if not self.spark.catalog.tableExists(self.table):
            empty = self.spark.createDataFrame([], f"text_sha256 string, keep_id {id_type}, group_size bigint, batch string")
            self._write(empty, self.path)

    def _write(self, rows: DataFrame, path: str | None = None) -> None:
        writer = rows.write.mode("append").format("parquet")
        writer = writer.option("path", path) if path else writer
        writer.bucketBy(self.buckets, "text_sha256").sortBy("text_sha256").saveAsTable(self.table)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def new(self, groups: DataFrame, batch: str | None = None) -> DataFrame:
        """Rows of ``groups`` (text_sha256 and more, one row per digest) that no batch, or no other than ``batch``, has brought."""
        known = self.read() if batch is None else self.read().where(F.col("batch") != batch)
        return groups.join(known.hint("merge"), "text_sha256", "left_anti")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Append those rows (text_sha256, keep_id, group_size) whose digest is not there, bucketed and sorted by digest."""
        ready = self.new(rows).withColumn("batch", F.lit(batch))
        self._write(ready.repartition(self.buckets, "text_sha256").sortWithinPartitions("text_sha256"))


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: its group's size and the id and number of the row that stays.

    Most code points win, then the least id, then the first row.  Counts are combined before the shuffle,
    so a digest with a third of all rows is a few rows per task.
    """
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("tag").alias("t")))
    return rows.groupBy("text_sha256").agg(best.getField("i").alias("keep_id"), F.count("*").alias("group_size"), best.getField("t").alias("keep_tag"))


def deduplicate(spark: SparkSession, docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """Digest a batch, append what the index lacks, and say of every row what stays.

    Columns: id, text_sha256, keep_id, group_size, kept.  A digest that an earlier batch brought keeps
    the document named there and its first group's size, and no row of this batch is kept.
    ``batch`` names the batch (else its ids and digests do): the same batch again, as after a failure, gets the same answer.
    Null texts are empty ones and equal to them; of rows repeating an id and a text one is kept; a null id is
    kept only if no row of its group has one.  Very long texts are digested whole.  An empty batch gives no rows; other
    columns are ignored.
    """
    return _decided(spark, docs, index, id_col, text_col, batch).select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256")


def _decided(spark: SparkSession, docs: DataFrame, index: DigestIndex, id_col: str, text_col: str, batch: str | None) -> DataFrame:
    rows = written(digests(docs, id_col, text_col), spark, "digests")
    if batch is None:
        batch = str(tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("id", "text_sha256", "points").cast("decimal(38,0)"))).first()))
    index.prepare(docs.schema[id_col].dataType.simpleString())
    fresh = written(index.new(groups(rows), batch), spark, "fresh")
    index.append(fresh.select("text_sha256", "keep_id", "group_size"), batch)
    # (digest, salt) pairs of the batch meet the index; documents meet those, evenly dealt.
    salted = rows.withColumn("__salt", F.pmod(F.col("tag"), F.lit(SALTS)).cast("int"))
    pairs = salted.select(F.col("text_sha256").alias("d"), F.col("__salt").alias("s")).distinct()
    known = pairs.join(index.read().hint("merge"), F.col("d") == F.col("text_sha256")).select("d", "s", "keep_id", "group_size")
    known = known.join(fresh.select(F.col("text_sha256").alias("f"), "keep_tag"), F.col("d") == F.col("f"), "left").drop("f")
    out = salted.join(known, (salted["text_sha256"] == known["d"]) & (salted["__salt"] == known["s"]))
    return out.select("id", "keep_id", "group_size", F.coalesce(F.col("tag") == F.col("keep_tag"), F.lit(False)).alias("kept"), "text_sha256", "points")


def fresh_index(spark: SparkSession) -> DigestIndex:
    """A new, empty index under a name of its own, kept in the shared folder."""
    name = f"digest_index_{uuid.uuid4().hex}"
    return DigestIndex(spark, name, path=shared_dir(spark, name))


def keep_first(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose text neither the index nor a better row of ``docs`` has; one of rows that repeat each other.

    A row is known by its id, its digest and its length, so rows that only share an id are judged each.
    """
    found = _decided(spark, docs, index or fresh_index(spark), id_col, text_col, batch)
    by_row = written(found.groupBy("id", "text_sha256", "points").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), spark, "decisions")
    own = docs.withColumns({"__d": F.sha2(normalised(F.col(text_col)).cast("binary"), 256), "__p": F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint")})
    same = lambda x: own[id_col].eqNullSafe(x["id"]) & (own["__d"] == x["text_sha256"]) & (own["__p"] == x["points"])
    out_of_it, repeated = by_row.where("not kept or rows > 1"), by_row.where("kept and rows > 1")
    once = own.join(out_of_it, same(out_of_it), "left_anti")
    if not repeated.isEmpty():
        again = own.join(repeated, same(repeated), "left_semi")
        once = once.union(again.groupBy(id_col, "__d", "__p").agg(*[F.any_value(F.struct(*docs.columns)).alias("r")]).select(*[F.col("r")[c].alias(c) for c in docs.columns], "__d", "__p"))
    return once.select(docs.columns)
