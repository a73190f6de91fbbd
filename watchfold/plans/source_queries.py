"""A: tables written to the shared folder in each format and read back."""

from pyspark.sql import functions as F

from watchfold.plans import moderation_queries as MQ
from watchfold.plans.registry import EVENTS_SQL, Tables, query
from watchfold.session import shared_dir
from watchfold.sources import sink, tables as S


@query("a1_csv_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def a1(spark, sf):
    orders = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    path = shared_dir(spark, "csv")
    orders.write.csv(path, header=True)
    return S.read_table(spark, path, orders.schema)


@query("a2_parquet_table", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def a2(spark, sf):
    lines = Tables(spark, sf).lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    path = shared_dir(spark, "parquet")
    S.write_table(lines, path, ("l_returnflag",))
    return S.read_table(spark, path).where(F.col("l_returnflag") == "R")


@query(
    "a3_term_list",
    """SELECT 'soft' AS tier, lower(p_name) AS term, CASE WHEN contains(p_name, ' ') THEN 'phrase' ELSE 'word' END AS kind, count(*) AS n FROM part WHERE p_partkey % 7 NOT IN (1, 2) GROUP BY ALL
       UNION ALL SELECT 'soft', 'lone', 'word', count(*) FROM part WHERE p_partkey % 7 = 3""",
)
def a3(spark, sf):
    key = F.col("p_partkey") % 7
    first = F.when(key == 1, "# a remark").when(key == 2, "   ").otherwise(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")))
    lines = F.when(key == 3, F.array(first, F.lit("Lone"))).otherwise(F.array(first))
    path = shared_dir(spark, "terms")
    Tables(spark, sf).part.select(F.explode(lines)).write.text(path)
    return S.read_terms(spark, path, "soft").groupBy("tier", "term", "kind").agg(F.count(F.lit(1)).alias("n"))


def _message_file(spark, sf):
    path = shared_dir(spark, "messages")
    good = MQ.pushed(Tables(spark, sf)).where(F.col("turn") % 5 != 4)
    good.select(F.get_json_object("body", "$.message").alias("value")).write.text(path)
    return path


@query(
    "a4_event_documents",
    f"""WITH p AS ({MQ.PUSH_SQL}) SELECT message_name AS name, 'users/' || (conv_id % 40) AS sender_name, turn % 4 + 1 AS attachments,
        CASE WHEN turn % 2 = 0 THEN text ELSE '' END AS text FROM p WHERE turn % 5 <> 4""",
)
def a4(spark, sf):
    out = S.read_events(spark, _message_file(spark, sf))
    return out.select("name", F.col("sender.name").alias("sender_name"), F.size("attachment").cast("bigint").alias("attachments"), "text")


@query(
    "a4_variant_documents",
    f"""WITH p AS ({MQ.PUSH_SQL}) SELECT message_name AS name, 'file0' AS first_file FROM p WHERE turn % 5 <> 4""",
)
def a4_variant(spark, sf):
    docs = S.read_documents(spark, _message_file(spark, sf))
    return docs.select(
        F.try_variant_get("doc", "$.name", "string").alias("name"),
        F.try_variant_get("doc", "$.attachment[0].name", "string").alias("first_file"),
    )


@query("a5_binary_files", "SELECT CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes FROM documents")
def a5(spark, sf):
    path = shared_dir(spark, "binary")
    Tables(spark, sf).documents.select("text").write.text(path)
    files = S.read_binary(spark, path, "*.txt")
    return files.agg(F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


@query("a7_written_events", f"WITH {EVENTS_SQL} SELECT event_id, value, event_type AS source_system, strftime(ts, '%Y-%m-%d') AS day FROM ev WHERE event_type = 'click'")
def a7_written(spark, sf):
    """Routed to one folder per source and day, read back by source."""
    path = shared_dir(spark, "events")
    ev = Tables(spark, sf).events.select(
        "event_id", "value", F.col("event_type").alias("source_system"), F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    sink.write_events(ev, path)
    out = spark.read.parquet(path).where(F.col("source_system") == "click")
    return out.withColumn("day", F.col("day").cast("string"))


@query(
    "a7_commit_log",
    f"""WITH {EVENTS_SQL} SELECT event_id, value, event_type AS source_system, strftime(ts, '%Y-%m-%d') AS day,
        CASE WHEN event_id % 3 = 0 THEN 'run-0' WHEN event_id % 3 = 1 THEN 'run-1' ELSE 'run-2' END AS run FROM ev""",
)
def a7_log(spark, sf):
    """Three overlapping runs: one repeated after its commit, one that died before it, ids that come again much later."""
    ev = Tables(spark, sf).events.select(
        "event_id", "value", F.col("event_type").alias("source_system"), F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    store = sink.EventStore(spark, shared_dir(spark, "store"), ev.schema, "event_id", ("source_system", "day"))
    first, second = ev.where("event_id % 3 = 0"), ev.where("event_id % 3 < 2")
    store.commit("run-0", first, "value")
    store.commit("run-1", second, "value")
    ev.write.partitionBy("source_system", "day").parquet(f"{store.path}/data/run=run-2")  # no commit follows
    store.commit("run-1", ev, "value")
    store.commit("run-2", ev.union(first), "value")
    return store.read().select("event_id", "value", "source_system", "day", "run")


@query(
    "a7_commit_counts",
    f"""WITH {EVENTS_SQL}, n AS (SELECT count(*) FILTER (event_id % 3 = 0) AS a, count(*) FILTER (event_id % 3 = 1) AS b FROM ev)
        SELECT 'run-0' AS run, a AS records_in, a AS created, CAST(0 AS BIGINT) AS duplicates FROM n UNION ALL SELECT 'run-1', 2 * a + b, b, 2 * a FROM n""",
)
def a7_log_counts(spark, sf):
    """What each run recorded, read after the store has grown."""
    ev = Tables(spark, sf).events.select(
        "event_id", "value", F.col("event_type").alias("source_system"), F.date_format("ts", "yyyy-MM-dd").alias("day")
    )
    store = sink.EventStore(spark, shared_dir(spark, "store"), ev.schema, "event_id", ("source_system", "day"))
    first = ev.where("event_id % 3 = 0")
    store.commit("run-0", first, "value")
    store.commit("run-1", ev.where("event_id % 3 < 2").union(first), "value")
    return store.commits().drop("committed_at")


@query("a8_json_export", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a8(spark, sf):
    path = shared_dir(spark, "json")
    S.write_json(Tables(spark, sf).events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("event_type STRING, n BIGINT").json(path)
