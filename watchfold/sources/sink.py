"""Create-only event sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def new_documents(
    df: DataFrame, existing: DataFrame | None, key: str, order: str, within: Sequence[str] = ()
) -> DataFrame:
    """Rows of ``df`` to create: one per key (least ``order``), none that exist already.

    One row per key is found by aggregation, which combines copies on the map
    side, so many copies of one document never meet in one task.  ``within`` names
    the partition columns a document always falls into (source and day): then
    only those partitions of ``existing`` are read that the batch touches.
    """
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(order)).alias("r")).select(key, "r.*")
    first = first.select(*df.columns)
    if existing is None:
        return first
    if within:
        existing = existing.join(df.select(*within).distinct(), list(within), "left_semi")
    return first.join(existing.select(key), key, "left_anti")


def append_new(
    df: DataFrame, existing: DataFrame | None, key: str, order: str, within: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(rows to create, one-row count of records in, created and duplicate)."""
    fresh = new_documents(df, existing, key, order, within)
    total = df.agg(F.count(F.lit(1))).scalar()
    counts = fresh.agg(F.count(F.lit(1)).alias("created")).select(
        total.alias("records_in"), "created", (total - F.col("created")).alias("duplicates")
    )
    return fresh, counts


def write_events(df: DataFrame, path: str) -> None:
    """Append, one folder per source and day."""
    df.write.mode("append").partitionBy("source_system", "day").parquet(path)


# --- a store with a commit log -------------------------------------------------------

_COMMIT = "run STRING, records_in BIGINT, created BIGINT, duplicates BIGINT, committed_at TIMESTAMP"


class EventStore:
    """A create-only table of documents, written run by run.

    A run's rows go to a folder of their own (``data/run=...``), and one row in ``commits`` says that it is whole and holds its
    counts.  Readers see committed runs only.  A run that died before its commit leaves a folder that nobody reads and that its
    next attempt replaces; a run that is repeated after its commit changes nothing and returns its counts.  One writer at a time.

    ``key`` names a document's id, ``within`` the columns that an id always falls into (source and day): they are the
    folders below a run, and ids are looked up only in those that a batch touches.  All other columns are ``schema``'s.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, within: Sequence[str] = ()):
        self.spark, self.path, self.key, self.within = spark, path.rstrip("/"), key, list(within)
        inner = [f for f in schema.fields if f.name not in self.within]
        self.schema = StructType([*inner, StructField("run", StringType()), *[schema[c] for c in self.within]])

    def _table(self, name: str, schema: StructType | str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """One row per committed run, with its counts."""
        return self._table("commits", _COMMIT)

    def read(self) -> DataFrame:
        """The documents of all committed runs, and the ``run`` that brought each."""
        return self._table("data", self.schema).join(self.commits().select("run"), "run", "left_semi").select(*self.schema.names)

    def commit(self, run: str, rows: DataFrame, order: str) -> DataFrame:
        """Add those of ``rows`` whose id is new, one for each id (the least ``order``), as the run ``run``.

        Returns the run's row of ``commits``, which is on disk and stays as it is whatever is added later.
        Rows without an id are not documents: they count as duplicates of nothing and are left out.
        """
        done = self.commits().where(F.col("run") == run)
        if not done.isEmpty():
            return done
        folder = f"{self.path}/data/run={run}"
        known = self.read() if not self.commits().isEmpty() else None
        fresh = new_documents(rows.where(F.col(self.key).isNotNull()), known, self.key, order, self.within)
        writer = fresh.write.mode("overwrite")
        (writer.partitionBy(*self.within) if self.within else writer).parquet(folder)
        # Counted on what was written, not on a plan that would look at the store again.
        inner = StructType([f for f in self.schema.fields if f.name != "run"])
        try:
            created = self.spark.read.schema(inner).parquet(folder).count()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            created = 0
        total = rows.count()
        row = self.spark.range(1).select(
            F.lit(run).alias("run"), F.lit(total).cast("bigint").alias("records_in"), F.lit(created).cast("bigint").alias("created"),
            F.lit(total - created).cast("bigint").alias("duplicates"), F.current_timestamp().alias("committed_at"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return self.commits().where(F.col("run") == run)


def commit_stream(stream: DataFrame, store: EventStore, name: str, order: str):
    """A writer of a stream into the store: each micro-batch is the run ``<name>-<batch>``.

    A batch that is delivered again after a failure is skipped, and an id that comes again after any delay is found in the
    store, so each document is there once.  The caller adds trigger and checkpoint and starts it.
    """

    def add(batch: DataFrame, number: int) -> None:
        store.commit(f"{name}-{number}", batch, order)

    return stream.writeStream.foreachBatch(add)
