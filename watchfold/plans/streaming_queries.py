"""K: the streaming forms, run over the tables as file streams until all is read."""

from pyspark.sql import functions as F

from watchfold.operators import evaluation as V, moderation as M
from watchfold.plans import evaluation_queries as EQ, feature_queries as FQ, moderation_queries as MQ
from watchfold.plans.registry import EVENTS_SQL, Tables, query
from watchfold.session import shared_dir
from watchfold.streaming import flows as S


def stream_of(spark, sf, name):
    """A table of the folder as a file stream.

    The table may be one file or a folder of files.  A pattern (of one alternative) takes both: a plain path to a file
    is no source of a stream, and a filter on file names misses those inside a folder.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}.parquet}}")


def event_stream(spark, sf):
    ev = stream_of(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.withColumns({"us": F.unix_micros("ts"), "k": F.get_json_object("props", "$.k").cast("int")})


def batched_events(spark, sf, batches):
    """The events in so many files, one to a micro-batch."""
    folder = shared_dir(spark, "event-files")
    spark.read.parquet(f"{sf}/events.parquet").repartition(batches, "event_id").write.parquet(folder)
    raw = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    ev = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.withColumns({"us": F.unix_micros("ts"), "k": F.get_json_object("props", "$.k").cast("int")})


def run_to_table(df, name):
    """Run a streaming frame over what there is and read its output back."""
    spark = df.sparkSession
    out, checkpoint = shared_dir(spark, name), shared_dir(spark, f"{name}-state")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    q = q.outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def read_batches(spark, folder, name):
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}/batch=*").drop("batch")


@query(
    "k1_moderate_stream",
    f"""WITH p AS ({MQ.PUSH_SQL}), c AS (SELECT message_name, text, CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])haha($|[^\\p{{L}}\\p{{N}}_])') OR contains(lower(text), 'of at') THEN 1 ELSE 0 END AS hard,
          regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])(ndon|estion|ingor|os)($|[^\\p{{L}}\\p{{N}}_])') OR contains(lower(text), 'with and') OR contains(lower(text), 'was and') AS soft
          FROM p WHERE kind LIKE '%created' AND turn % 5 <> 4)
        SELECT message_name, CASE WHEN trim(text, E' \\t\\n\\r') = '' THEN 'pass' WHEN hard = 1 THEN 'true_positive' WHEN soft THEN 'flagged_fallback' ELSE 'pass' END AS text_result,
          CASE WHEN hard = 1 OR soft THEN 'block' ELSE 'pass' END AS final_action FROM c""",
)
def k1(spark, sf):
    class Pushed:
        conversations = stream_of(spark, sf, "conversations")

    def decide(batch):
        decided, bad = M.moderate(batch, "kind", "body", MQ.TERMS, F.current_timestamp())
        return decided.select("message_name", "text_result", "final_action", "case_id"), bad

    folder = shared_dir(spark, "moderated")
    S.moderate_stream(MQ.pushed(Pushed), decide, folder, shared_dir(spark, "moderated-state"), availableNow=True).awaitTermination()
    return read_batches(spark, folder, "decisions").select("message_name", "text_result", "final_action")


@query("k2_dedup_stream", f"WITH {EVENTS_SQL} SELECT event_id, user_id, value FROM ev")
def k2(spark, sf):
    """Every event delivered two or three times comes out once."""
    ev = event_stream(spark, sf).select("event_id", "ts", "user_id", "value")
    copies = ev.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(1) + (F.col("event_id") % 2).cast("int"))))
    return run_to_table(S.dedup_stream(copies, ["event_id"], "ts", "1 hour"), "dedup").select("event_id", "user_id", "value")


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query(
    "k3_threshold_stream",
    f"""WITH {EVENTS_SQL}, w AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n FROM ev WHERE event_type <> 'view' GROUP BY 1, 2)
        SELECT user_id, epoch_us(start) AS window_start, n FROM w WHERE n > 2 AND start + INTERVAL 6 HOUR <= {_CLOSED}""",
)
def k3(spark, sf):
    out = S.threshold_stream(event_stream(spark, sf), F.col("event_type") != "view", "user_id", "ts", "1 hour", "6 hours", 2)
    return run_to_table(out, "threshold").select("user_id", F.unix_micros("window_start").alias("window_start"), "n")


@query(
    "k4_corroborate_stream",
    f"""WITH {EVENTS_SQL}, n AS (SELECT a.event_id AS hit_id, any_value(a.us) AS us, count(b.event_id) AS matches FROM ev a LEFT JOIN ev b ON b.user_id = a.user_id AND b.event_type <> a.event_type
          AND b.us BETWEEN a.us - 450000000 AND a.us + 450000000 GROUP BY a.event_id)
        SELECT hit_id, matches, matches = 0 AS single_source FROM n WHERE us + 450000000 < floor(epoch_us({_CLOSED}) / 1000) * 1000""",
)
def k4(spark, sf):
    ev = event_stream(spark, sf)
    out = S.corroborate_stream(ev, ev, "user_id", "event_id", "ts", "event_type", 900, "1 hour")
    per_hit = run_to_table(out, "corroborated").groupBy("hit_id").agg(F.sum("matches").alias("matches"))  # an id given twice is one hit here
    return per_hit.select("hit_id", "matches", (F.col("matches") == 0).alias("single_source"))


@query(
    "k5_velocity_stream",
    f"""WITH {FQ.VELOCITY_SQL} SELECT event_id, velocity_count_1h, round(velocity_value_1h, 4) AS velocity_value_1h, velocity_count_24h, round(velocity_value_24h, 4) AS velocity_value_24h FROM vel""",
)
def k5(spark, sf):
    S.use_rocksdb(spark)
    out = run_to_table(S.velocity_stream(event_stream(spark, sf), "user_id", "event_id", "ts", "value", FQ.WINDOWS), "velocity")
    return out.select(
        "event_id",
        "velocity_count_1h",
        F.round("velocity_value_1h", 4).alias("velocity_value_1h"),
        "velocity_count_24h",
        F.round("velocity_value_24h", 4).alias("velocity_value_24h"),
    )


@query(
    "k6_drift_stream",
    f"""WITH {EQ._PSI_SQL.replace("SELECT ts < TIMESTAMP '2024-01-16', 'skewed', CASE WHEN event_type = 'error' AND ts >= TIMESTAMP '2024-01-16' THEN value / 2 ELSE value END FROM ev", "SELECT NULL, NULL, NULL WHERE false")
        .replace("SELECT ts < TIMESTAMP '2024-01-16' AS base, 'value'", "SELECT ts < TIMESTAMP '2024-01-16' AS base, 'value'")},
        out AS (SELECT feature, sum((z - x) * ln(z / x)) AS psi FROM shares GROUP BY feature)
        SELECT feature, nc AS current_rows, round(psi, 9) AS psi FROM out JOIN sizes USING (feature)""",
)
def k6(spark, sf):
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    fixed = V.psi_baseline(Tables(spark, sf).events.where(cut), ["value", "k"])
    stream = event_stream(spark, sf).where(F.col("ts") >= F.lit("2024-01-16").cast("timestamp"))
    folder = shared_dir(spark, "drift")
    S.drift_stream(stream, fixed, ["value", "k"], folder, shared_dir(spark, "drift-state"), availableNow=True).awaitTermination()
    return read_batches(spark, folder, "drift").select("feature", "current_rows", F.round("psi", 9).alias("psi"))


@query(
    "k7_observe_stream",
    f"WITH {EVENTS_SQL} SELECT count(*) AS records_in, count(*) FILTER (k <= 90) AS records_out, count(*) FILTER (k > 90) AS dead_lettered FROM ev",
)
def k7(spark, sf):
    metrics = {
        "records_in": F.count(F.lit(1)),
        "records_out": F.count_if(F.col("k") <= 90),
        "dead_lettered": F.count_if(F.col("k") > 90),
    }
    folder = shared_dir(spark, "accounting")
    S.account_stream(
        batched_events(spark, sf, 4), "batches", metrics, folder, shared_dir(spark, "accounting-state"), availableNow=True
    ).awaitTermination()
    per_batch = read_batches(spark, folder, "batches")
    return per_batch.agg(*[F.sum(m).alias(m) for m in metrics])
