"""Findings of round 3: tables of several files, and results and plans at sizes beyond the test tables."""

import os
import tempfile

from pyspark.sql import functions as F

from oracle import compare, connect
from watchfold.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


def folder_with(**tables):
    """The smallest tables, with some of them given anew: name -> a frame, written as a folder of files."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for f in os.listdir(SMALL):
        if f.endswith(".parquet") and f[:-8] not in tables:
            os.symlink(f"{SMALL}/{f}", f"{path}/{f}")
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return path


def duck(path):
    """The SQL's view of such a folder."""
    con = connect(SMALL)
    for f in os.listdir(path):
        if os.path.isdir(f"{path}/{f}"):
            con.sql(f"CREATE OR REPLACE VIEW {f[:-8]} AS SELECT * FROM '{path}/{f}/*.parquet'")
    return con


def test_streams_read_tables_of_several_files(spark):
    conversations = spark.read.parquet(f"{SMALL}/conversations.parquet")
    path = folder_with(conversations=conversations.repartition(3))
    q = QUERIES["k1_moderate_stream"]
    assert compare(q.plan(spark, path), q.sql, duck(path)) == []


def test_no_threshold_fits_the_capacity(spark):
    events = spark.range(4000).select(
        F.col("id").alias("event_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"),
        F.when(F.col("id") % 4 == 0, "error").otherwise("view").alias("event_type"), F.lit(200.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    )
    path = folder_with(events=events)
    q = QUERIES["j10_capacity_threshold"]
    assert q.plan(spark, path).collect() == duck(path).sql(q.sql).fetchall() == []


def test_hits_of_one_place_are_made_by_many_tasks_and_once(spark, monkeypatch):
    from watchfold.operators import detection as D

    monkeypatch.setattr(D, "HITS_PER_BLOCK", 50)
    # a third of the events at one place; addresses and hosts may lack; event 5 comes with two places, event 6 twice
    rows = [(i, "s", f"u{i % 7}", "h0" if i % 3 else (None if i % 2 else f"h{i % 5}"), None if i % 4 == 1 else f"ip{i % 3}") for i in range(300)]
    rows += [(5, "s", "u1", "h1", "ip1"), rows[6], (None, "s", "u1", "h0", None), (None, "s", "u2", "h0", "ip2")]
    things = [(f"a{i}", f"h{i % 5}" if i % 6 else None, f"ip{i % 3}" if i % 4 else None, bool(i % 9 == 0)) for i in range(60)]
    things += [(a, h, None, True) for a, h, _, _ in things[:10]]
    events = spark.createDataFrame(rows, "event_id BIGINT, source_system STRING, user STRING, host STRING, ip STRING").repartition(4)
    assets = spark.createDataFrame(things, "asset STRING, host STRING, ip STRING, critical BOOLEAN")
    users = spark.createDataFrame([(f"u{i}",) for i in range(5)], "user STRING")
    out = D.entity_hits(events, users, assets, users.where("user = 'u1'"))
    want = {(e, s, "user", u, u == "u1"): False for e, s, u, _, _ in rows if u in {f"u{i}" for i in range(5)}}
    for e, s, _, host, ip in rows:
        for a, h, p, critical in things:
            if (h is not None and h == host) or (p is not None and p == ip):
                key = (e, s, "asset", a, False)
                want[key] = want.get(key, False) or critical
    got = out.collect()
    assert len(got) == len(want) and {tuple(r)[:5]: r[5] for r in got} == want
    # what joins the assets has the tasks of the session, not one for each place's partition
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    sizes = out.where("entity_type = 'asset'").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 6


def test_large_spaces_are_many_tasks(spark, monkeypatch):
    from watchfold.operators import ingest as I

    monkeypatch.setattr(I, "CELLS_PER_BLOCK", 500)
    msgs = spark.range(2400).select(F.col("id").alias("msg"), F.when(F.col("id") % 8 == 0, F.lit(None)).when(F.col("id") % 3 == 0, "quiet").otherwise("dm").alias("space_name"))
    members = spark.range(40).select(
        F.lit("dm").alias("space_name"), F.format_string("p%02d", F.col("id") % 30).alias("email"), F.lit("x").alias("displayName"), F.lit("HUMAN").alias("type")
    )
    out = I.with_members(msgs, members)
    got = out.collect()
    assert sorted(r.msg for r in got) == list(range(2400))
    want = [(f"p{i:02d}", "x", "HUMAN") for i in range(30)]
    assert all(([tuple(m) for m in r.space_members] == want) if r.space_name == "dm" else r.space_members is None for r in got)
    tasks = out.where("space_members IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) >= 4


def test_known_cases_are_found_without_a_sort_of_the_items(spark):
    from watchfold.operators import ledger as E

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = spark.range(500).select(F.when(F.col("id") % 10 > 0, F.col("id") % 50).alias("case_id"), "id")
        cases = spark.range(60).where("id % 3 = 0").select(F.col("id").alias("case_id"))
        ok, bad = E.require_case(items, cases.union(cases))
        known = {r.id for r in ok.collect()}
        assert known == {i for i in range(500) if i % 10 and i % 50 % 3 == 0}
        assert sorted(r.id for r in bad.collect()) == sorted(set(range(500)) - known)
        for df in (ok, bad):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def largest_share(df):
    """The share of the rows that the fullest of the session's partitions holds."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(counts) / sum(counts)


class plain_joins:
    """Joins as they are on large tables: none is broadcast unless marked, none adapted."""

    def __init__(self, spark):
        self.spark, self.conf = spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}

    def __enter__(self):
        self.was = {k: self.spark.conf.get(k) for k in self.conf}
        for k, v in self.conf.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.was.items():
            self.spark.conf.set(k, v)


def test_requests_of_one_case_are_spread(spark):
    from watchfold.operators import ledger as E

    text = {c: F.lit(v) for c, v in {
        "source_system": "doc.store", "collection_method": "api", "query": "doc", "collector_principal": "svc", "collected_at_utc": "2024-06-01T00:00:00Z",
        "original_tz": "UTC", "mime_type": "text/plain", "retention_class": "standard_7y",
    }.items()}
    known, unknown = "00000000-0000-4000-8000-000000000001", "00000000-0000-4000-8000-000000000002"
    case = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 < 3, known).otherwise(unknown)
    requests = spark.range(2000).select(F.col("id").cast("string").alias("request_id"), case.alias("case_id"), F.col("id").cast("string").alias("content")).withColumns(text)
    cases = spark.createDataFrame([(known,), (known,), (None,)], "case_id STRING")
    with plain_joins(spark):
        r = E.record_evidence(requests, cases, "s3://vault", "k1")
        assert sorted(int(x.request_id) for x in r.rejected.collect()) == [i for i in range(2000) if i % 5 in (0, 3, 4)]
        assert {x.reason for x in r.rejected.collect()} == {"case_id:known"}
        assert r.items.count() == 800
        assert largest_share(r.items) < 0.3 and largest_share(r.rejected) < 0.3
        plan = r.items._jdf.queryExecution().optimizedPlan().toString()
        assert "content" not in plan.split("Join")[1].split("\n")[0]


def test_messages_without_a_case_are_spread(spark):
    from watchfold import constants as K
    from watchfold.operators import moderation as M

    decided = spark.range(2000).select(
        F.col("id").cast("string").alias("message_name"), F.lit("t").alias("text"),
        F.when(F.col("id") % 20 == 0, "review").otherwise("pass").alias("final_action"),
        F.when(F.col("id") % 20 == 0, F.concat(F.lit("c"), F.col("id").cast("string"))).alias("case_id"),
    )
    cases = decided.where("case_id IS NOT NULL").select("case_id", F.when(F.col("message_name") % 40 == 0, "true_positive").otherwise("open").alias("disposition"))
    with plain_joins(spark):
        out = M.tombstone(decided, cases)
        got = {int(r.message_name): (r.removed, r.text) for r in out.collect()}
        assert got == {i: (i % 40 == 0, K.TOMBSTONE if i % 40 == 0 else "t") for i in range(2000)}
        assert largest_share(out) < 0.3


def test_texts_are_not_cut_beyond_their_segments(spark, monkeypatch):
    """every text was cut into its runs of one to three characters; now each distinct segment is, however many texts have it."""
    from watchfold.operators import moderation as M

    terms = [("hard", 0, "beta", "word"), ("soft", 1, "ta gam", "phrase"), ("soft", 2, "+", "phrase"), ("soft", 3, "a+", "word"), ("hard", 4, "  ", "phrase")]
    terms += [("soft", 5, "é", "word"), ("soft", 6, "psi", "phrase"), ("hard", 7, "nothing here", "phrase"), ("soft", 8, " ", "phrase"), ("soft", 9, "é. x", "word")]
    table = spark.createDataFrame(terms, "tier STRING, ord BIGINT, term STRING, kind STRING")
    lines = ["alpha Beta gamma", "beta+ a+b", "É. x  epsilon", "", "+", None, "betagamma", "ta gam", "é.x"]
    cut, whole = [], M.text_pieces

    def spied(texts, low):
        cut.append(texts.count())
        return whole(texts, low)

    monkeypatch.setattr(M, "text_pieces", spied)
    seen = []
    for copies in (1, 40):
        cut.clear()
        msgs = spark.createDataFrame([(i * 100 + c, t) for i, t in enumerate(lines) for c in range(copies)], "id INT, text STRING")
        got = {r.id: (list(r.hard_terms), list(r.soft_terms)) for r in M.keyword_scan(msgs, "text", table, "id").collect()}
        plain = [M.Term(tier, term, kind) for tier, _, term, kind in terms]
        want = {r.id: (list(r.hard_terms), list(r.soft_terms)) for r in M.keyword_scan(msgs, "text", plain, "id").collect()}
        # the list's scan gives the words of a tier before its phrases, as the table's does
        assert got == want
        seen.append(sum(cut))
    assert seen[0] == seen[1] > 0


def test_corroboration_state_grows_with_buckets_not_rows(spark):
    """Eight hours of 6,000 events: a third of one key, keys, sources and ids that are null, ids beyond 2**53, rows twice."""
    from watchfold.streaming import flows as S

    big = 1 << 60
    events = spark.range(6000).select(
        F.when(F.col("id") % 997 == 0, None).otherwise(F.col("id") + big).alias("event_id"),
        F.timestamp_micros(F.lit(1704067200000000) + F.col("id") * 4_800_000).alias("ts"),
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 != 1, big + F.col("id") % 40).alias("user_id"),
        F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit(None)), (F.col("id") % 7 % 3 + 1).cast("int")).alias("event_type"),
    )
    events = events.union(events.where("event_id % 100 = 5"))
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    last = events.limit(1).withColumns({"ts": F.lit("9999-01-01").cast("timestamp"), "user_id": F.lit(-1).cast("bigint"), "event_id": F.lit(-1).cast("bigint")})
    events.union(last).repartition(3).write.parquet(f"{path}/events")
    ev = spark.readStream.schema(events.schema).parquet(f"{path}/events")
    out = S.corroborate_stream(ev, ev, "user_id", "event_id", "ts", "event_type", 900, "1 hour")
    q = out.writeStream.format("parquet").option("path", f"{path}/o").option("checkpointLocation", f"{path}/s").trigger(availableNow=True).start()
    q.awaitTermination()
    held = [sum(s.numRowsTotal for s in p.stateOperators) for p in q.recentProgress]
    assert max(held) <= 16 * 5  # cells times buckets of four hours, for six thousand rows
    assert held[-1] <= 2  # of the closing event alone: its hit, and its bucket and the next one
    got = sorted(spark.read.schema(out.schema).parquet(f"{path}/o").where("hit_id IS NULL OR hit_id >= 0").select(F.coalesce("hit_id", F.lit(-2)), "matches", "single_source").collect())
    con = connect(SMALL)
    con.sql(f"CREATE VIEW e AS SELECT row_number() OVER () AS n, * FROM '{path}/events/*.parquet' WHERE event_id IS NULL OR event_id >= 0")
    want = con.sql("""SELECT coalesce(any_value(a.event_id), -2), count(b.n), count(b.n) = 0 FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.event_type IS DISTINCT FROM a.event_type
        AND b.event_type IS NOT NULL AND b.ts BETWEEN a.ts - INTERVAL 450 SECOND AND a.ts + INTERVAL 450 SECOND GROUP BY a.n""").fetchall()
    assert [tuple(r) for r in got] == sorted(want) and len(got) > 6000
