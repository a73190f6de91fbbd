"""Register of runnable queries: name -> (Spark plan, SQL for the same answer)."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F


class Query(NamedTuple):
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Query(plan, sql)
        return plan

    return register


class Tables:
    """The input tables of one scale factor."""

    def __init__(self, spark: SparkSession, folder: str):
        # Timestamps in the tables carry no zone; read them as UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        """Events with their time also in microseconds and the device number ``k``."""
        raw = self.spark.read.parquet(f"{self.folder}/events.parquet")
        return raw.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn(
            "k", F.get_json_object("props", "$.k").cast("int")
        )


# SQL for the same columns; prefix of many oracles.
EVENTS_SQL = """ev AS (
  SELECT *, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""
