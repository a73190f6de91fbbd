"""The event store: killed and repeated runs, late repeats, hot ids, streams that deliver again."""

import pytest
from pyspark.sql import functions as F

from watchfold.sources import sink

SCHEMA = "id STRING, at BIGINT, body STRING, source STRING, day STRING"


def rows(spark, ids, day="2024-01-01"):
    return spark.createDataFrame([(i, n, f"body {n}", "web", day) for n, i in enumerate(ids)], SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return sink.EventStore(spark, str(tmp_path / "store"), rows(spark, ["a"]).schema, "id", ("source", "day"))


def ids_of(store):
    return sorted((r.id, r.run) for r in store.read().collect())


def test_a_repeated_run_changes_nothing(spark, store):
    assert store.read().collect() == [] and store.commits().collect() == []
    first = store.commit("r1", rows(spark, ["a", "b", "a"]), "at").first()
    assert (first.records_in, first.created, first.duplicates) == (3, 2, 1)
    again = store.commit("r1", rows(spark, ["a", "b", "a", "z"]), "at")
    assert again.collect() == [first] and ids_of(store) == [("a", "r1"), ("b", "r1")]
    assert {r.id: r.body for r in store.read().collect()}["a"] == "body 0"


def test_a_killed_run_is_not_seen_and_replaced(spark, store):
    store.commit("r1", rows(spark, ["a"]), "at")
    rows(spark, ["b", "x"]).write.partitionBy("source", "day").parquet(f"{store.path}/data/run=r2")
    assert ids_of(store) == [("a", "r1")]
    store.commit("r2", rows(spark, ["a", "b"]), "at")
    assert ids_of(store) == [("a", "r1"), ("b", "r2")]


def test_counts_stay_after_later_runs(spark, store):
    store.commit("r1", rows(spark, ["hot"] * 100 + [f"k{n}" for n in range(200)]), "at")
    store.commit("r2", rows(spark, ["hot"] * 50 + ["new", None]), "at")
    store.commit("r3", rows(spark, []), "at")
    store.commit("r4", rows(spark, ["hot"], "2024-01-02"), "at")  # an id belongs to one day; another day is another document
    got = {r.run: (r.records_in, r.created, r.duplicates) for r in store.commits().collect()}
    assert got == {"r1": (300, 201, 99), "r2": (52, 1, 51), "r3": (0, 0, 0), "r4": (1, 1, 0)}
    assert store.read().count() == 203


def test_lookups_read_only_the_days_of_the_batch(spark, store):
    store.commit("r1", rows(spark, ["a"]), "at")
    store.commit("r2", rows(spark, ["b"], "2024-01-02"), "at")
    plan = store.read().where("day = '2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_a_stream_delivered_twice_leaves_one_row_each(spark, store, tmp_path):
    folder = tmp_path / "in"
    for k in range(3):
        rows(spark, [f"k{n}" for n in range(k * 5, k * 5 + 10)]).coalesce(1).write.mode("append").parquet(str(folder))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    for checkpoint in ("one", "two"):  # the second run has lost its checkpoint: every batch comes again
        query = sink.commit_stream(stream(), store, "feed", "at").option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(i for i, _ in ids_of(store)) == sorted({f"k{n}" for n in range(20)})
    late = sink.commit_stream(stream(), store, "later", "at").option("checkpointLocation", str(tmp_path / "three")).trigger(availableNow=True).start()
    late.awaitTermination()
    assert store.read().count() == 20 and store.commits().agg(F.sum("created")).first()[0] == 20
