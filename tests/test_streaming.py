"""Streams over several files and batches against their batch twins."""

import tempfile

import pytest
from pyspark.sql import functions as F

from watchfold.operators import detection as D, features as X
from watchfold.streaming import flows as S

WINDOWS = {"1h": 3600, "24h": 86400}
SOURCES = ["click", "error", "purchase", "signup", "view"]


@pytest.fixture(scope="module")
def events(spark):
    raw = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev = raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    return ev.withColumn("us", F.unix_micros("ts"))


@pytest.fixture(scope="module")
def files(events):
    """The events in six files in order of time, and a far later one to close all windows."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/events"
    for day in range(0, 30, 5):  # one after another: the file source reads the oldest file first
        part = events.where(F.dayofmonth("ts").between(day + 1, day + 5 if day < 25 else 31))
        part.coalesce(1).write.mode("append").parquet(path)
    last = events.limit(1).withColumns(
        {"ts": F.lit("2030-01-01").cast("timestamp"), "event_id": F.lit(-1).cast("bigint"), "us": F.unix_micros(F.lit("2030-01-01").cast("timestamp")), "user_id": F.lit(-1).cast("bigint")}
    )
    last.coalesce(1).write.mode("append").parquet(path)
    return path


def replay(spark, df, trigger_files=1):
    out, state = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") for _ in range(2))
    q = df.writeStream.format("parquet").option("path", out + "/o").option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out + "/o"), q


def source(spark, events, files, per_batch=2):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", per_batch).parquet(files)


def crowded(df):
    """A third of the events under one user, some under none; a row of the closing file keeps its own."""
    user = F.when(F.col("event_id") < 0, F.col("user_id")).when(F.col("event_id") % 3 == 0, 7).when(F.col("event_id") % 50 != 1, F.col("user_id"))
    return df.withColumn("user_id", user)


def test_velocity_over_batches_equals_batch(spark, events, files):
    S.use_rocksdb(spark)
    ev = crowded(source(spark, events, files, 1)).where("user_id IS NOT NULL")
    got, q = replay(spark, S.velocity_stream(ev, "user_id", "event_id", "ts", "value", WINDOWS))
    assert len(q.recentProgress) > 6
    want = X.velocity(crowded(events).where("user_id IS NOT NULL"), "user_id", "us", "value", WINDOWS)
    cols = [f"velocity_{k}_{w}" for k in ("count", "value") for w in WINDOWS]
    got = {r.event_id: [round(r[c], 4) for c in cols] for r in got.where("event_id >= 0").collect()}
    assert got == {r.event_id: [round(r[c], 4) for c in cols] for r in want.collect()}
    # the closing event's key alone has state left: totals, rows and one timer
    assert q.lastProgress.stateOperators[0].numRowsTotal < 10


def test_velocity_state_is_that_of_its_reach(spark, events, files):
    S.use_rocksdb(spark)
    _, q = replay(spark, S.velocity_stream(source(spark, events, files, 1), "user_id", "event_id", "ts", "value", {"1h": 3600}))
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.numInputRows]
    assert max(held) < 6 * events.count() / 2  # of thirty days no more than the two batches that the watermark spans


def test_corroboration_over_batches_equals_batch(spark, events, files):
    ev = crowded(source(spark, events, files))
    got, q = replay(spark, S.corroborate_stream(ev, ev, "user_id", "event_id", "ts", "event_type", 900, "1 hour"))
    assert len(q.recentProgress) > 1
    base = crowded(events)
    want = D.corroborate(base, base, "event_id", "user_id", "us", "event_type", SOURCES, 900)
    got = {r.hit_id: (r.matches, r.single_source) for r in got.where("hit_id >= 0").collect()}
    assert got == {r.event_id: (r.matches, r.single_source) for r in want.collect()}


def test_threshold_closed_by_a_later_event_equals_batch(spark, events, files):
    df = S.threshold_stream(source(spark, events, files), F.lit(True), "user_id", "ts", "1 hour", "12 hours", 1)
    got, _ = replay(spark, df)
    want = D.threshold_rule(events, F.lit(True), "user_id", "ts", "12 hours", 1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_redelivery_over_batches_comes_out_once(spark, events, files):
    twice = source(spark, events, files).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    got, _ = replay(spark, S.dedup_stream(twice, ["event_id"], "ts", "1 hour"))
    ids = [r.event_id for r in got.collect()]
    assert len(ids) == len(set(ids)) == events.count() + 1


def test_batch_run_again_leaves_the_same_output(spark, events, files):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for _ in range(2):  # a lost checkpoint makes the same batches run again
        state = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        q = S.write_batches(source(spark, events, files, 3), lambda b: {"all": b, "big": b.where("value > 50")}, folder, state, availableNow=True)
        q.awaitTermination()
    assert spark.read.parquet(f"{folder}/all").count() == events.count() + 1
    assert spark.read.parquet(f"{folder}/big").count() in (events.where("value > 50").count(), events.where("value > 50").count() + 1)


class _Held:
    """A state store that counts what it is asked."""

    def __init__(self):
        self.calls, self.lists, self.maps = 0, {}, {}

    def getListState(self, name, schema):
        return _Cell(self, self.lists.setdefault(name, []))

    def getMapState(self, name, keys, values):
        return _Cell(self, self.maps.setdefault(name, {}))

    def registerTimer(self, at):
        self.calls += 1


class _Cell:
    def __init__(self, held, content):
        self.held, self.content = held, content

    def __getattr__(self, name):
        def call(*args):
            self.held.calls += 1
            c = self.content
            if name == "appendList":
                c.extend(args[0])
            elif name == "updateValue":
                c[args[0]] = args[1]
            return {"get": lambda: iter(list(c)), "iterator": lambda: iter(list(c.items())), "getValue": lambda: c.get(args[0]), "clear": c.clear}.get(name, lambda: None)()

        return call


def test_a_key_of_few_rows_asks_the_state_a_few_times():
    """each bucket of a key was written by two calls of its own."""
    import pandas as pd

    class Clock:
        getCurrentWatermarkInMs = staticmethod(lambda: 0)

    held, hour = _Held(), 3_600_000_000
    velocity = S._Velocity({"1h": 3600}, 3600)
    velocity.init(held)
    for first in (100, 160):
        rows = pd.DataFrame({"event_id": range(60), "us": [(first + i) * hour for i in range(60)], "amount": 1.0})
        [out] = velocity.handleInputRows((1,), iter([rows]), Clock)
        assert out["velocity_count_1h"].sum() == 60 - (first == 100)
    assert held.calls < 10


def test_velocity_of_keys_with_many_rows_equals_batch(spark, events, files, monkeypatch):
    """Lists that are dealt to buckets again and again give what whole lists give."""
    monkeypatch.setattr(S._Velocity.__init__, "__defaults__", (5,))
    test_velocity_over_batches_equals_batch(spark, events, files)
