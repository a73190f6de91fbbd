"""B and A7: events as deliveries, orders as runs, nations and customers as spaces and members."""

from pyspark.sql import functions as F

from watchfold.functions import hashing as H
from watchfold.functions.text import index_name
from watchfold.operators import ingest as I
from watchfold.plans.registry import EVENTS_SQL, Tables, query
from watchfold.sources.sink import append_new, new_documents

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'partial' ELSE 'running' END"
RUNS_SQL = f"""runs AS (SELECT o_orderkey AS run_id, o_custkey AS pipeline_run_id, o_orderpriority AS stage, {_STATUS} AS status, o_orderdate AS completed_at_utc,
   o_orderdate + to_hours(o_custkey % 48) AS watermark_end, 'src' || (o_orderkey % 3) || ':abc' AS config_hash FROM orders)"""


def runs(t):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "partial").otherwise("running")
    return t.orders.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("pipeline_run_id"),
        F.col("o_orderpriority").alias("stage"),
        status.alias("status"),
        F.col("o_orderdate").alias("completed_at_utc"),
        F.timestamp_add("HOUR", (F.col("o_custkey") % 48).cast("int"), F.col("o_orderdate")).alias("watermark_end"),
        F.concat(F.lit("src"), (F.col("o_orderkey") % 3).cast("string"), F.lit(":abc")).alias("config_hash"),
    )


def ntz(text):
    return F.lit(text).cast("timestamp_ntz")


@query(
    "b1_resolve_watermark",
    f"""WITH {RUNS_SQL}, last AS (SELECT watermark_end FROM runs WHERE stage = '1-URGENT' AND status IN ('completed', 'partial') AND contains(config_hash, 'src1')
          ORDER BY completed_at_utc DESC, run_id DESC LIMIT 1)
        SELECT 'known' AS which, watermark_end AS start, TIMESTAMP '2030-01-01' AS "end" FROM last
        UNION ALL SELECT 'first', TIMESTAMP '2029-12-31', TIMESTAMP '2030-01-01' UNION ALL SELECT 'given', TIMESTAMP '2029-06-01', TIMESTAMP '2030-01-01'""",
)
def b1(spark, sf):
    r, end = runs(Tables(spark, sf)), ntz("2030-01-01")
    known = I.resolve_watermark(r, "1-URGENT", "src1", end).withColumn("which", F.lit("known"))
    first = I.resolve_watermark(r, "no such stage", "src1", end).withColumn("which", F.lit("first"))
    given = I.resolve_watermark(r, "1-URGENT", "src1", end, ntz("2029-06-01")).withColumn("which", F.lit("given"))
    return known.unionByName(first).unionByName(given)


_EDGE = "(SELECT ts FROM events ORDER BY ts LIMIT 1 OFFSET 40)"


@query(
    "b2_in_window",
    """SELECT 'half_open' AS bounds, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
       UNION ALL SELECT 'open', o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'""",
)
def b2(spark, sf):
    orders = Tables(spark, sf).orders
    lo, hi = ntz("1997-01-01"), ntz("1998-01-01")
    a = I.in_window(orders, "o_orderdate", lo, hi).select(F.lit("half_open").alias("bounds"), "o_orderkey")
    b = I.in_window(orders, "o_orderdate", lo, hi, "()").select(F.lit("open").alias("bounds"), "o_orderkey")
    return a.unionByName(b)


@query(
    "b3_payload_sha256",
    """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || CAST(to_json(lang) AS VARCHAR) || ',"quality":' || coalesce(CAST(quality AS VARCHAR), 'null')
        || ',"text":' || CAST(to_json(text) AS VARCHAR) || '}') AS sha256 FROM documents LEFT JOIN labels USING (doc_id)""",
)
def b3(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.join(t.labels, "doc_id", "left")
    return j.select("doc_id", H.payload_sha256(["text", "lang", "quality", "doc_id"]).alias("sha256"))


_ROUTE_SQL = """SELECT event_id, sha256(event_type || '.feed:' || event_id) AS doc_id, 'raw-' || event_type || '_feed-' || strftime(ts, '%Y.%m.%d') AS index_name,
   CASE WHEN event_id % 3 = 0 THEN sha256('app' || strftime(ts, '%Y-%m-%d %H:%M:%S') || user_id) ELSE CAST(event_id AS VARCHAR) END AS native_id FROM events"""


def routed(t):
    source = F.concat("event_type", F.lit(".feed"))
    native = F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string"))
    return t.events.withColumns(
        {
            "source_system": source,
            "doc_id": H.doc_id(source, "event_id"),
            "index_name": index_name("raw", source, "ts"),
            "native_id": H.event_id_or_hash(native, F.lit("app"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "user_id"),
        }
    )


@query("b4_doc_id", f"SELECT event_id, doc_id FROM ({_ROUTE_SQL})")
def b4(spark, sf):
    return routed(Tables(spark, sf)).select("event_id", "doc_id")


@query("b5_index_name", f"SELECT event_id, index_name FROM ({_ROUTE_SQL})")
def b5(spark, sf):
    return routed(Tables(spark, sf)).select("event_id", "index_name")


@query("b8_event_id_or_hash", f"SELECT event_id, native_id FROM ({_ROUTE_SQL})")
def b8(spark, sf):
    return routed(Tables(spark, sf)).select("event_id", "native_id")


SPACES_SQL = """spaces AS (SELECT n_name AS space_name, n_nationkey, ['SPACE', 'GROUP_CHAT', 'DIRECT_MESSAGE', 'DIRECT_MESSAGE', 'OTHER'][n_nationkey % 5 + 1] AS space_type FROM nation),
  members AS (SELECT n_name AS space_name, c_name || '@example.com' AS email, c_mktsegment AS displayName, 'HUMAN' AS type FROM customer JOIN nation ON c_nationkey = n_nationkey
              WHERE n_nationkey % 5 IN (2, 3))"""


def spaces(t):
    kinds = F.array(*[F.lit(k) for k in ("SPACE", "GROUP_CHAT", "DIRECT_MESSAGE", "DIRECT_MESSAGE", "OTHER")])
    sp = t.nation.select(F.col("n_name").alias("space_name"), "n_nationkey", F.element_at(kinds, F.col("n_nationkey") % 5 + 1).alias("space_type"))
    direct = sp.where(F.col("space_type") == "DIRECT_MESSAGE")
    mem = t.customer.join(direct, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "space_name", F.concat("c_name", F.lit("@example.com")).alias("email"), F.col("c_mktsegment").alias("displayName"), F.lit("HUMAN").alias("type")
    )
    return sp, mem


_MEMBER_JOIN = """SELECT s_suppkey, space_name, (SELECT string_agg(email || '/' || displayName, ' ' ORDER BY email) FROM members m WHERE m.space_name = sp.space_name) AS members
   FROM supplier JOIN spaces sp ON s_nationkey = n_nationkey"""


@query("b6_with_members", f"WITH {SPACES_SQL} {_MEMBER_JOIN}")
def b6(spark, sf):
    t = Tables(spark, sf)
    sp, mem = spaces(t)
    msgs = t.supplier.join(sp, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "space_name")

    def listed(people):
        return F.array_join(F.transform(people, lambda m: F.concat(m["email"], F.lit("/"), m["displayName"])), " ")

    return I.with_members(msgs, mem, form=listed).withColumnRenamed("space_members", "members").select("s_suppkey", "space_name", "members")


@query(
    "b6_large_spaces",
    f"""WITH {SPACES_SQL} SELECT space_name, email FROM members QUALIFY count(*) OVER (PARTITION BY space_name) > 62""",
)
def b6_large(spark, sf):
    t = Tables(spark, sf)
    sp, mem = spaces(t)
    return I.members_of_large(mem, 62).select("space_name", "email")


@query(
    "b7_select_sources",
    f"""WITH {SPACES_SQL}, poi AS (SELECT upper(c_name) || '@EXAMPLE.COM' AS email FROM customer WHERE c_acctbal > 9800)
        SELECT space_name, space_type FROM spaces WHERE space_type IN ('SPACE', 'GROUP_CHAT') OR (space_type = 'DIRECT_MESSAGE' AND space_name IN
          (SELECT space_name FROM members WHERE lower(email) IN (SELECT lower(email) FROM poi)))""",
)
def b7(spark, sf):
    t = Tables(spark, sf)
    sp, mem = spaces(t)
    poi = t.customer.where(F.col("c_acctbal") > 9800).select(F.concat(F.upper("c_name"), F.lit("@EXAMPLE.COM")).alias("email"))
    return I.select_sources(sp, mem, poi).select("space_name", "space_type")


_DEAD_SQL = EVENTS_SQL + """, marked AS (SELECT *, CASE WHEN k > 90 THEN 'ValidationError' WHEN value < 0.5 THEN 'RangeError' END AS error_class FROM ev)"""


def split(t):
    rules = [
        ("ValidationError", "k above 90", F.col("k") > 90),
        ("RangeError", "value too small", F.col("value") < 0.5),
    ]
    return I.split_dead_letters(t.events, rules, "ingest", ["event_id", "props"])


@query(
    "b9_dead_letters",
    f"""WITH {_DEAD_SQL} SELECT event_id, 'ingest' AS stage, 1 AS attempt, error_class, CASE error_class WHEN 'ValidationError' THEN 'k above 90' ELSE 'value too small' END AS error_message,
        sha256('{{"event_id":' || event_id || ',"props":' || CAST(to_json(props) AS VARCHAR) || '}}') AS payload_sha256 FROM marked WHERE error_class IS NOT NULL""",
)
def b9(spark, sf):
    return split(Tables(spark, sf))[1].select("event_id", "stage", "attempt", "error_class", "error_message", "payload_sha256")


@query("b9_good_rows", f"WITH {_DEAD_SQL} SELECT event_id, user_id, value FROM marked WHERE error_class IS NULL")
def b9_good(spark, sf):
    return split(Tables(spark, sf))[0].select("event_id", "user_id", "value")


@query(
    "b10_classify_error",
    f"""WITH {EVENTS_SQL}, a AS (SELECT event_id, [200, 401, 403, 404, 429, 500, 503][k % 7 + 1] AS status, CASE WHEN k % 2 = 0 THEN '{{"reason": "rateLimitExceeded"}}' END AS body FROM ev),
        c AS (SELECT event_id, CASE WHEN status = 429 OR (status = 403 AND body IS NOT NULL) THEN 'rate_limit' WHEN status IN (401, 403) THEN 'auth'
              WHEN status IN (500, 502, 503, 504) THEN 'transient' ELSE 'other' END AS error_class FROM a)
        SELECT *, error_class IN ('rate_limit', 'transient') AS retryable FROM c""",
)
def b10(spark, sf):
    status = F.element_at(F.array(*[F.lit(s) for s in (200, 401, 403, 404, 429, 500, 503)]), F.col("k") % 7 + 1)
    body = F.when(F.col("k") % 2 == 0, '{"reason": "rateLimitExceeded"}')
    return Tables(spark, sf).events.select("event_id", I.classify_error(status, body).alias("e")).select("event_id", "e.*")


@query(
    "b11_run_summary",
    f"""WITH {_DEAD_SQL}, o AS (SELECT event_type, CASE WHEN error_class IS NOT NULL AND event_type <> 'view' THEN 'dead_letter' WHEN event_id % 4 = 0 THEN 'duplicate' ELSE 'created' END AS outcome FROM marked)
        SELECT event_type, count(*) AS records_in, count(*) FILTER (outcome = 'created') AS records_out, count(*) FILTER (outcome = 'duplicate') AS duplicates,
          count(*) FILTER (outcome = 'dead_letter') AS dead_lettered, CASE WHEN dead_lettered > 0 THEN 'partial' ELSE 'completed' END AS status FROM o GROUP BY event_type""",
)
def b11(spark, sf):
    bad = ((F.col("k") > 90) | (F.col("value") < 0.5)) & (F.col("event_type") != "view")
    outcome = F.when(bad, "dead_letter").when(F.col("event_id") % 4 == 0, "duplicate").otherwise("created")
    return I.run_summary(Tables(spark, sf).events.withColumn("outcome", outcome), by=["event_type"])


_UP_SQL = """run AS (SELECT o_orderkey AS pipeline_run_id, o_orderpriority AS stage, 'running' AS status, o_custkey AS records_in FROM orders WHERE o_orderkey % 3 <> 0),
  upd AS (SELECT o_orderkey AS pipeline_run_id, o_orderpriority AS stage, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS status, -o_custkey AS records_in, 2 AS seq FROM orders WHERE o_orderkey % 2 = 0
          UNION ALL SELECT o_orderkey, o_orderpriority, 'started', 7, 1 FROM orders WHERE o_orderkey % 4 = 0)"""


@query(
    "b12_upsert_runs",
    f"""WITH {_UP_SQL}, l AS (SELECT pipeline_run_id, stage, max_by(status, seq) AS status, min_by(records_in, seq) AS records_in FROM upd GROUP BY 1, 2)
        SELECT coalesce(r.pipeline_run_id, l.pipeline_run_id) AS pipeline_run_id, coalesce(r.stage, l.stage) AS stage, coalesce(l.status, r.status) AS status,
          CASE WHEN r.stage IS NOT NULL THEN r.records_in ELSE l.records_in END AS records_in FROM run r FULL JOIN l ON r.pipeline_run_id = l.pipeline_run_id AND r.stage = l.stage""",
)
def b12(spark, sf):
    return I.upsert_runs(*run_updates(spark, sf))


def run_updates(spark, sf):
    o = Tables(spark, sf).orders
    key = [F.col("o_orderkey").alias("pipeline_run_id"), F.col("o_orderpriority").alias("stage")]
    known = o.where(F.col("o_orderkey") % 3 != 0).select(*key, F.lit("running").alias("status"), F.col("o_custkey").alias("records_in"))
    last = F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed")
    upd = o.where(F.col("o_orderkey") % 2 == 0).select(*key, last.alias("status"), (-F.col("o_custkey")).alias("records_in"), F.lit(2).alias("seq"))
    early = o.where(F.col("o_orderkey") % 4 == 0).select(*key, F.lit("started").alias("status"), F.lit(7).cast("bigint").alias("records_in"), F.lit(1).alias("seq"))
    return known, upd.unionByName(early)


@query(
    "b12_run_completion",
    f"""WITH {_UP_SQL}, l AS (SELECT pipeline_run_id, stage, max_by(status, seq) AS status, min_by(records_in, seq) AS first, max_by(records_in, seq) AS last FROM upd GROUP BY 1, 2)
        SELECT coalesce(r.pipeline_run_id, l.pipeline_run_id) AS pipeline_run_id, coalesce(r.stage, l.stage) AS stage, coalesce(l.status, r.status) AS status,
          CASE WHEN l.status IN ('failed', 'completed') THEN l.last WHEN r.stage IS NOT NULL THEN r.records_in ELSE l.first END AS records_in
        FROM run r FULL JOIN l ON r.pipeline_run_id = l.pipeline_run_id AND r.stage = l.stage""",
)
def b12_ends(spark, sf):
    """The end of a run writes its counts too."""
    return I.upsert_runs(*run_updates(spark, sf), ends=["records_in"])


@query(
    "b13_mark_stale",
    f"""WITH {RUNS_SQL} SELECT run_id, CASE WHEN status = 'running' AND completed_at_utc < TIMESTAMP '1998-06-01' - INTERVAL 24 HOUR THEN 'failed' ELSE status END AS status,
        CASE WHEN status = 'running' AND completed_at_utc < TIMESTAMP '1998-06-01' - INTERVAL 24 HOUR THEN 'stale run'
          WHEN run_id % 5 = 0 THEN 'disk full' END AS error_message FROM runs""",
)
def b13(spark, sf):
    told = runs(Tables(spark, sf)).withColumn("error_message", F.when(F.col("run_id") % 5 == 0, "disk full"))
    return I.mark_stale(told, "completed_at_utc", ntz("1998-06-01"), 24).select("run_id", "status", "error_message")


@query(
    "b14_normalise",
    """SELECT 'web' AS source_system, CAST(user_id AS VARCHAR) AS user, CAST(NULL AS VARCHAR) AS host, event_type AS action, ts, CAST(event_id AS VARCHAR) AS event_id FROM events
       UNION ALL SELECT 'shop', CAST(o_custkey AS VARCHAR), 'till', 'order', o_orderdate, CAST(o_orderkey AS VARCHAR) FROM orders""",
)
def b14(spark, sf):
    t = Tables(spark, sf)
    web = I.normalise(t.events, {"user": "user_id", "action": "event_type", "ts": "ts", "event_id": "event_id"}, "web")
    shop = I.normalise(t.orders, {"user": "o_custkey", "host": F.lit("till"), "action": F.lit("order"), "ts": "o_orderdate", "event_id": "o_orderkey"}, "shop")
    return web.unionByName(shop).drop("ip", "dataset")


_REDELIVERED = """first AS (SELECT * FROM ev WHERE ts < TIMESTAMP '2024-01-12'), again AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-10' UNION ALL SELECT * FROM ev WHERE event_id % 3 = 0 AND ts >= TIMESTAMP '2024-01-10')"""


def deliveries(t):
    ev = t.events.select("event_id", "ts", "user_id", "event_type", "value").withColumn("doc_id", H.doc_id("event_type", "event_id"))
    first = ev.where(F.col("ts") < ntz("2024-01-12"))
    again = ev.where(F.col("ts") >= ntz("2024-01-10"))
    return first, again.unionByName(again.where(F.col("event_id") % 3 == 0))


@query(
    "a7_append_new",
    f"WITH {EVENTS_SQL}, {_REDELIVERED} SELECT DISTINCT event_id, sha256(event_type || ':' || event_id) AS doc_id, value FROM again WHERE event_id NOT IN (SELECT event_id FROM first)",
)
def a7(spark, sf):
    first, again = deliveries(Tables(spark, sf))
    fresh, _ = append_new(again, first, "doc_id", "ts")
    return fresh.select("event_id", "doc_id", "value")


@query(
    "a7_append_counts",
    f"""WITH {EVENTS_SQL}, {_REDELIVERED}, n AS (SELECT count(*) AS records_in, count(DISTINCT event_id) FILTER (ts >= TIMESTAMP '2024-01-12') AS created FROM again)
        SELECT *, records_in - created AS duplicates FROM n""",
)
def a7_counts(spark, sf):
    first, again = deliveries(Tables(spark, sf))
    return append_new(again, first, "doc_id", "ts")[1]


_RUN_SQL = EVENTS_SQL + """, win AS (SELECT *, CASE WHEN k = 13 THEN NULL ELSE '{"k":' || k || '}' END AS body FROM ev WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25')"""


def ingest_run(t):
    ev = t.events.withColumn("raw", F.when(F.col("k") == 13, "{broken").otherwise(F.col("props")))
    store = I.documents(ev.where((F.col("event_id") % 4 == 0) & (F.col("k") != 13)), "app.feed", "event_id", "ts", "raw")
    twice = ev.unionByName(ev.where(F.col("event_id") % 3 == 0))
    return I.ingest(twice, store, "app.feed", "event_id", "ts", "raw", ntz("2024-01-05"), ntz("2024-01-25"))


@query(
    "b_ingest_documents",
    f"""WITH {_RUN_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, sha256(body) AS sha256, sha256('app.feed:' || event_id) AS doc_id, 'raw-app_feed-' || strftime(ts, '%Y.%m.%d') AS index_name
        FROM win WHERE body IS NOT NULL AND event_id % 4 <> 0""",
)
def b_ingest(spark, sf):
    return ingest_run(Tables(spark, sf))[0].select("event_id", "sha256", "doc_id", "index_name")


@query(
    "b_ingest_summary",
    f"""WITH {_RUN_SQL}, twice AS (SELECT * FROM win UNION ALL SELECT * FROM win WHERE event_id % 3 = 0),
        n AS (SELECT count(*) AS records_in, count(DISTINCT event_id) FILTER (body IS NOT NULL AND event_id % 4 <> 0) AS records_out, count(*) FILTER (body IS NULL) AS dead_lettered FROM twice)
        SELECT records_in, records_out, records_in - dead_lettered - records_out AS duplicates, dead_lettered, CASE WHEN dead_lettered > 0 THEN 'partial' ELSE 'completed' END AS status FROM n""",
)
def b_ingest_counts(spark, sf):
    return ingest_run(Tables(spark, sf))[2]
