"""Structured Streaming forms of the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from watchfold.operators.evaluation import psi_against

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State kept on disk beside the executor; the custom processors need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def dedup_stream(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Each id once across redelivery, with state dropped after the delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def threshold_stream(
    stream: DataFrame, where: Column, key: str, ts: str, delay: str, window: str, n: int, slide: str | None = None
) -> DataFrame:
    """Keys above n selected events per event-time window; rows later than the delay are dropped."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    counted = (
        stream.withWatermark(ts, delay).where(where).groupBy(span.alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.where(F.col("n") > n).select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"
    )


# --- two outputs per batch -----------------------------------------------------------------


def write_batches(
    stream: DataFrame, outputs: Callable[[DataFrame], Mapping[str, DataFrame]], folder: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Write several results of each micro-batch under ``folder/<name>/batch=<id>``.

    A batch that is run again after a failure overwrites its own folders, so
    every output is exactly once.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, df in outputs(batch).items():
                df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def moderate_stream(
    stream: DataFrame, decide: Callable[[DataFrame], tuple[DataFrame, DataFrame]], folder: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Continuous moderation: decisions to one sink, undecodable payloads to another.

    ``decide`` takes a batch of pushed events and returns (decisions, dead letters).
    """

    def outputs(batch: DataFrame) -> Mapping[str, DataFrame]:
        decided, dead = decide(batch)
        return {"decisions": decided, "dead_letters": dead}

    return write_batches(stream, outputs, folder, checkpoint, **trigger)


def drift_stream(
    stream: DataFrame, baseline: DataFrame, cols: Sequence[str], folder: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """PSI of every micro-batch against a fixed baseline (output of ``psi_baseline``).

    The baseline has one row per column and is worked out once, not per batch.
    """
    rows = baseline.where(F.col("feature").isin(*cols)).collect()
    if missing := set(cols) - {r["feature"] for r in rows}:
        raise ValueError(f"the baseline lacks {sorted(missing)}")
    fixed = stream.sparkSession.createDataFrame(rows, baseline.schema)
    return write_batches(
        stream, lambda batch: {"drift": psi_against(fixed, batch, cols)}, folder, checkpoint, **trigger
    )


def observe_stream(stream: DataFrame, name: str, metrics: Mapping[str, Column]) -> DataFrame:
    """Count as the rows pass by; read the result with ``observed``."""
    return stream.observe(name, *[c.alias(n) for n, c in metrics.items()])


def account_stream(
    stream: DataFrame, name: str, metrics: Mapping[str, Column], folder: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """One accounting row per micro-batch under ``folder``/``name``, however many batches there are."""
    totals = [c.alias(n) for n, c in metrics.items()]
    return write_batches(stream, lambda batch: {name: batch.agg(*totals)}, folder, checkpoint, **trigger)


def observed(query: StreamingQuery, name: str) -> list[dict]:
    """Metrics of the batches whose progress Spark still holds (the last 100 unless set otherwise).

    For the accounting of a whole run use ``account_stream``.
    """
    out = []
    for progress in query.recentProgress:
        row = progress.observedMetrics.get(name)
        if row is not None:
            out.append({"batch_id": progress.batchId, **row.asDict()})
    return out


# --- running velocity ---------------------------------------------------------------------


class _Velocity(StatefulProcessor):
    """A key's rows until no accepted row can look back at them.

    The rows of most keys are few: they are one list, read and added to in one call each.  Once a key has more than
    ``few``, they go to maps, by bucket of time, with each bucket's totals; the list then begins anew.
    """

    def __init__(self, windows: Mapping[str, int], bucket_seconds: int, few: int = 4096):
        self.windows = {label: seconds * 1_000_000 for label, seconds in windows.items()}
        self.step = bucket_seconds * 1_000_000
        self.reach = max(self.windows.values())
        self.few = few

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.loose = handle.getListState("loose", "us BIGINT, amount DOUBLE")
        self.totals = handle.getMapState("totals", "bucket BIGINT", "n BIGINT, total DOUBLE")
        self.rows = handle.getMapState("rows", "bucket BIGINT", "us ARRAY<BIGINT>, amount ARRAY<DOUBLE>")

    def _alive(self, watermark_ms: int) -> tuple[dict[int, tuple[int, float]], list[tuple[int, float]]]:
        """Totals by bucket and the listed rows, after those that ended before the reach of the watermark are dropped."""
        floor = watermark_ms * 1000 - self.reach
        known = {k[0]: (v[0], v[1]) for k, v in self.totals.iterator()}
        for bucket in [b for b in known if (b + 1) * self.step <= floor]:
            del known[bucket]
            self.totals.removeKey((bucket,))
            self.rows.removeKey((bucket,))
        listed = [(r[0], r[1]) for r in self.loose.get()]
        loose = [r for r in listed if (r[0] // self.step + 1) * self.step > floor]
        if len(loose) < len(listed):
            if loose:
                self.loose.put(loose)
            else:
                self.loose.clear()
        return known, loose

    def _wake(self, buckets) -> None:
        """One timer a key, for when its newest bucket is out of reach."""
        self.handle.registerTimer(((max(buckets) + 1) * self.step + self.reach) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("us", kind="stable")
        known, loose = self._alive(timerValues.getCurrentWatermarkInMs())
        at, value = new["us"].to_numpy(np.int64), new["amount"].fillna(0.0).to_numpy(np.float64)
        own = at // self.step
        # The buckets where a window begins or ends are read row by row, those between by their totals.
        ends = np.unique(np.concatenate([own] + [(at - w) // self.step for w in self.windows.values()])) if known else own[:0]
        stored = {b: self.rows.getValue((b,)) for b in ends.tolist() if b in known}
        if not known and not loose:
            self._wake(own.tolist())
        few_us = np.concatenate([np.array([r[0] for r in loose], np.int64), at])
        few_amount = np.concatenate([np.array([r[1] for r in loose], np.float64), value])
        us = np.concatenate([np.array(r[0], np.int64) for r in stored.values()] + [few_us])
        amount = np.concatenate([np.array(r[1], np.float64) for r in stored.values()] + [few_amount])
        filed = len(few_us) > self.few
        if filed:
            self.loose.clear()
        else:
            self.loose.appendList(list(zip(at.tolist(), value.tolist())))
        few_own = few_us // self.step
        by_bucket = np.argsort(few_own, kind="stable")
        touched, first = np.unique(few_own[by_bucket], return_index=True)
        for bucket, mine in zip(touched.tolist(), np.split(by_bucket, first[1:])):
            n, total = known.get(bucket, (0, 0.0))
            if filed:
                was = (stored[bucket] if bucket in stored else self.rows.getValue((bucket,))) if bucket in known else ([], [])
                self.rows.updateValue((bucket,), ([*was[0], *few_us[mine].tolist()], [*was[1], *few_amount[mine].tolist()]))
            known[bucket] = (n + len(mine), total + float(few_amount[mine].sum()))
            if filed:
                self.totals.updateValue((bucket,), known[bucket])
        order = np.argsort(us, kind="stable")
        us = us[order]
        sums = np.concatenate([[0.0], np.cumsum(amount[order])])
        buckets = np.array(sorted(known), np.int64)
        counted = np.concatenate([[0], np.cumsum([known[b][0] for b in buckets.tolist()])])
        summed = np.concatenate([[0.0], np.cumsum([known[b][1] for b in buckets.tolist()])])
        out = {"key": key[0], "event_id": new["event_id"].to_numpy()}
        for label, w in self.windows.items():
            first = (at - w) // self.step
            inner = np.searchsorted(buckets, first, "right"), np.searchsorted(buckets, own, "left")
            inner = inner[0], np.maximum(*inner)
            tail = np.searchsorted(us, at - w, "left"), np.searchsorted(us, np.minimum((first + 1) * self.step, at), "left")
            head = np.searchsorted(us, np.where(first < own, own * self.step, at), "left"), np.searchsorted(us, at, "left")
            out[f"velocity_count_{label}"] = sum(hi - lo for lo, hi in (tail, head)) + counted[inner[1]] - counted[inner[0]]
            parts = sum(np.where(hi > lo, sums[hi] - sums[lo], 0.0) for lo, hi in (tail, head))
            out[f"velocity_value_{label}"] = parts + np.where(inner[1] > inner[0], summed[inner[1]] - summed[inner[0]], 0.0)
        yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known, loose = self._alive(timerValues.getCurrentWatermarkInMs())
        if known or loose:
            self._wake([*known, *(r[0] // self.step for r in loose)])
        yield from ()

    def close(self) -> None:
        pass


def velocity_stream(
    stream: DataFrame, key: str, event_id: str, ts: str, amount: str, windows: Mapping[str, int], delay: str = "1 hour", bucket_seconds: int = 3600
) -> DataFrame:
    """Running velocity per key: count and sum of strictly earlier rows in each window.

    State per key is a list of its rows while they are few.  More are kept by bucket of time, with one total a bucket: a batch reads
    the list, the rows of the buckets where its windows begin or end and the totals of those between, and adds to the list; the
    list is dealt to its buckets when it is long.  A bucket, and a listed row, is dropped when the watermark
    has left it behind by the longest window, and a timer drops the last of a key that gets no more rows, so
    state ends with its reach.  A key's rows of one batch, and those of its buckets read, are one group: rows that repeat one
    (key, bucket) without bound are held by one task.

    Rows of one micro-batch are put in order of time; a row that arrives within the delay still sees its whole window, and is
    counted for the rows after it; later ones are dropped.  A null amount counts as a row of sum 0; rows without a time are dropped.
    """
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, delay).select(
        F.col(key).alias("key"), F.col(event_id).alias("event_id"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("us"),
        F.col(amount).cast("double").alias("amount"),
    )
    types = dict(rows.dtypes)
    cols = ", ".join(f"velocity_count_{w} BIGINT, velocity_value_{w} DOUBLE" for w in windows)
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Velocity(windows, bucket_seconds),
        outputStructType=f"key {types['key']}, event_id {types['event_id']}, {cols}",
        outputMode="Append",
        timeMode="EventTime",
    )


# --- running corroboration ----------------------------------------------------------------


LAST = "2262-04-01 00:00:00"


class _Corroboration:
    """The hits and events of one cell of keys and one bucket of time, held until no hit that is or may come can need them.

    Whatever they number, they are one row of state: an Arrow stream of (us, ask, id, key, source, blank).
    """

    def __init__(self, half_us: int):
        self.half = half_us

    def _counted(self, facts_at, facts_code, at, code) -> np.ndarray:
        """Per (at, code), the facts of that code no further away than half a window: those up to its end less those before it."""
        f, m = len(facts_at), len(at)
        side = np.repeat(np.array([1, 0, 2], np.int8), [f, m, m])
        order = np.lexsort((side, np.concatenate([facts_at, at - self.half, at + self.half]), np.concatenate([facts_code, code, code])))
        seen = np.empty(f + 2 * m, np.int64)
        seen[order] = np.cumsum(order < f)
        return seen[f + m :] - seen[f : f + m]

    def _matches(self, facts: pd.DataFrame, due: pd.DataFrame) -> np.ndarray:
        """Events of the key in the window, less those of the hit's own source."""
        f = len(facts)
        both = pd.concat([facts, due])
        keys, _ = pd.factorize(both["key"], use_na_sentinel=False)
        sources, found = pd.factorize(both["source"], use_na_sentinel=False)
        blank = both["blank"].to_numpy()
        keys = np.where(blank & 2, -1, keys)
        own = np.where((blank & 6) > 0, -1, keys * max(1, len(found)) + sources)
        at = both["us"].to_numpy(np.int64)
        return self._counted(at[:f], keys[:f], at[f:], keys[f:]) - self._counted(at[:f], own[:f], at[f:], own[f:])

    def __call__(self, cell, frames, state) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        rows = [frame[["us", "ask", "id", "key", "source", "blank"]] for frame in frames]
        if state.exists:
            rows.insert(0, pa.ipc.open_stream(state.get[0]).read_pandas())
        if not rows:
            return
        known = pd.concat(rows, ignore_index=True)
        closed = state.getCurrentWatermarkMs() * 1000
        at, ask = known["us"].to_numpy(np.int64), known["ask"].to_numpy(bool)
        answered = ask & (at + self.half < closed)
        if answered.any():
            due = known[answered]
            matches = self._matches(known[~ask], due)
            yield pd.DataFrame({"id": due["id"], "blank": due["blank"], "matches": matches})
        # An open hit, and one yet to come, is no earlier than half a window before the watermark; its window as much again.
        kept = np.where(ask, ~answered, at + 2 * self.half >= closed)
        if not kept.any():
            state.remove()
            return
        if len(rows) > 1 or not state.exists or not kept.all():
            sink = pa.BufferOutputStream()
            table = pa.Table.from_pandas(known[kept], preserve_index=False)
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            state.update((sink.getvalue().to_pybytes(),))
        open_hits = at[kept & ask]
        wake = open_hits.min() + self.half if len(open_hits) else at[kept].max() + 2 * self.half
        state.setTimeoutTimestamp(max(1, int(wake) // 1000))


def corroborate_stream(
    hits: DataFrame, events: DataFrame, key: str, hit_id: str, ts: str, source: str, window_seconds: float, delay: str, cells: int = 16
) -> DataFrame:
    """Per hit, the events of other sources within the window centred on it; none is single-source.

    Both sides go to (cell, time bucket), a cell being one of ``cells`` parts of the keys: a hit to the bucket of its own time, an
    event to the one or two that its window touches, so each pair meets once.  A bucket is 16 windows long.  The rows of a group are
    one row of state, and the matches are counted by order of time, no pair is formed.  So the groups number the
    buckets times ``cells``, not the rows; a key's rows are spread over its buckets.  A group's state is written anew in each
    batch that adds to it or answers one of its hits; more cells make smaller groups.

    A hit is answered once, when the watermark has passed the end of its window; late matches up to then are in the count.  Then it is
    dropped, and an event once the watermark is a window past it, so state ends with its reach.

    A hit without a key has no matches, one without a source is met by any; events without a source, and rows without a time,
    meet nothing.  A hit given twice is answered twice.  ``hits`` and ``events`` may be the same table, read twice; a hit's own row is
    never of another source.  Rows of times from ``LAST`` on are late once the watermark has
    passed it.
    """
    half = int(window_seconds * 500_000)
    step = max(1, 32 * half)
    types = dict(hits.select(F.col(hit_id).alias("id"), F.col(key).alias("key"), F.col(source).alias("source")).dtypes)

    def bucket(us: Column) -> Column:
        return F.floor(us / F.lit(step)).cast("bigint")

    def filled(name: str) -> Column:
        """No null among integers: they would reach Python as floats.  ``blank`` says where nulls were."""
        whole = types[name] in ("tinyint", "smallint", "int", "bigint")
        return F.coalesce(F.col(name), F.lit(0).cast(types[name])).alias(name) if whole else F.col(name)

    def timed(df: DataFrame) -> DataFrame:
        return df.where(F.col(ts).isNotNull()).withWatermark(ts, delay)

    def rows(df: DataFrame, ask: bool, at: Column) -> DataFrame:
        named = df.select(
            at.alias("at"), F.unix_micros(ts).alias("us"), F.lit(ask).alias("ask"),
            (F.col(hit_id) if ask else F.lit(None)).cast(types["id"]).alias("id"),
            F.col(key).cast(types["key"]).alias("key"), F.col(source).cast(types["source"]).alias("source"),
        )
        if ask:
            return named.withColumn("bucket", bucket(F.col("us")))
        touched = F.array_distinct(F.array(bucket(F.col("us") - half), bucket(F.col("us") + half)))
        return named.where(F.col("key").isNotNull() & F.col("source").isNotNull()).withColumn("bucket", F.explode(touched))

    # A worker holds no time beyond 2262: ``at``, which only says whether a row is late, stops there, while ``us`` is the row's own.
    # The first part gives ``at`` its watermark, so it has the column itself.
    last, asks = F.lit(LAST).cast("timestamp"), timed(hits)
    both = rows(asks.where(F.col(ts) < last), True, F.col(ts)).unionByName(rows(asks.where(F.col(ts) >= last), True, last))
    both = both.unionByName(rows(timed(events), False, F.least(F.col(ts), last)))
    nulls = sum((F.col(n).isNull().cast("tinyint") * F.lit(bit) for n, bit in (("key", 2), ("source", 4))), F.col("id").isNull().cast("tinyint"))
    spread = F.when(F.col("key").isNull(), F.xxhash64("id")).otherwise(F.xxhash64("key"))
    placed = both.select(
        F.pmod(spread, F.lit(cells)).cast("int").alias("cell"), "bucket", "at", "us", "ask", filled("id"), filled("key"), filled("source"),
        nulls.cast("tinyint").alias("blank"),
    )
    answers = placed.groupBy("cell", "bucket").applyInPandasWithState(
        _Corroboration(half), f"id {types['id']}, blank TINYINT, matches BIGINT", "rows BINARY", "append", "EventTimeTimeout"
    )
    known = F.when(F.col("blank").bitwiseAND(F.lit(1).cast("tinyint")) == 0, F.col("id"))
    return answers.select(known.alias("hit_id"), "matches", (F.col("matches") == 0).alias("single_source"))
