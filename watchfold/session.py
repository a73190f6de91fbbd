"""Session helpers: a local session for tests, and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", app: str = "watchfold", **conf: str) -> SparkSession:
    """A small single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WATCHFOLD_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared folder (``spark.checkpoint.dir``).

    Only where a session on one machine names none, as in tests, is a temporary
    folder made, and then remembered in the session for the next caller.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder all executors share in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


ROWS_BETWEEN_CHECKS = 8
_PARQUET_CHECKS = ("parquet.page.size.row.check.min", "parquet.page.size.row.check.max")


def wide_rows(spark: SparkSession) -> None:
    """For results whose rows may be megabytes each: Parquet's writer looks at what it holds after every few rows.

    By its own limits it looks after 100 rows first, and after up to 10,000 where the rows before were small, so each task
    would hold so many lists at once.  Values that the session names itself stay.
    """
    for key in _PARQUET_CHECKS:
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, str(ROWS_BETWEEN_CHECKS))
