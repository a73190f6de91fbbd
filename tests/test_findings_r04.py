"""Findings of round 4: wide rows and hits at sizes beyond the test tables."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from watchfold.operators import detection as D, ingest as I


def test_an_event_meets_lists_of_assets(spark, monkeypatch):
    monkeypatch.setattr(D, "ASSETS_IN_A_LIST", 7)
    monkeypatch.setattr(D, "HITS_PER_BLOCK", 60)
    events = spark.range(90).select(
        F.col("id").alias("event_id"), F.lit("s").alias("source_system"), F.lit("u").alias("user"),
        F.when(F.col("id") % 3 > 0, F.format_string("h%d", F.col("id") % 2)).alias("host"), F.when(F.col("id") % 4 > 0, "ip").alias("ip"),
    )
    things = [(f"a{i}", f"h{i % 3}" if i % 5 else None, "ip" if i % 7 == 0 else None, i % 2 == 0) for i in range(50)]
    assets = spark.createDataFrame(things, "asset STRING, host STRING, ip STRING, critical BOOLEAN")
    users = spark.createDataFrame([("v",)], "user STRING")
    out = D.entity_hits(events, users, assets, users)
    want = set()
    for e in events.collect():
        want |= {(e.event_id, a, c) for a, h, p, c in things if (h is not None and h == e.host) or (p is not None and p == e.ip)}
    got = [(r.event_id, r.entity_id, r.is_asset_critical) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    # the last join has a few rows for each event, not its hits
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "inline(" in plan


@pytest.fixture
def parquet_checks(spark):
    keys = ("parquet.page.size.row.check.min", "parquet.page.size.row.check.max")
    before = {k: spark.conf.get(k, None) for k in keys}
    yield keys
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_writer_of_wide_rows_does_not_hold_many(spark, tmp_path, parquet_checks):
    for key in parquet_checks:
        spark.conf.unset(key)
    # messages without a list come first: the writer would take the rows after them for as small
    msgs = spark.range(360).select(F.col("id").alias("msg"), F.when(F.col("id") % 3 == 0, "dm").otherwise("quiet").alias("space_name"))
    members = spark.range(9000).select(
        F.lit("dm").alias("space_name"), F.sha2(F.col("id").cast("string"), 256).alias("email"), F.lit("x").alias("displayName"), F.lit("HUMAN").alias("type")
    )
    out = I.with_members(msgs, members, form=lambda people: F.array_join(people["email"], " "))
    row = 9000 * 65
    path = f"{tmp_path}/out"
    block = 2 << 20
    late = out.coalesce(1).sortWithinPartitions(F.col("space_members").isNotNull())
    late.write.option("parquet.block.size", block).option("parquet.enable.dictionary", "false").option("compression", "none").parquet(path)
    groups = [f.metadata.row_group(g) for f in map(pq.ParquetFile, glob.glob(f"{path}/*.parquet")) for g in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 360
    assert max(g.total_byte_size for g in groups) <= block + 9 * row  # by the writer's own limits one group has all 120 lists


def test_a_session_that_names_the_checks_keeps_them(spark, parquet_checks):
    for key in parquet_checks:
        spark.conf.set(key, "50")
    msgs = spark.range(3).select("id", F.lit("dm").alias("space_name"))
    I.with_members(msgs, spark.createDataFrame([("dm", "e", "d", "t")], "space_name STRING, email STRING, displayName STRING, type STRING"))
    assert [spark.conf.get(key) for key in parquet_checks] == ["50", "50"]
