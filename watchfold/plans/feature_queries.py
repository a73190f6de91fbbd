"""I: features over events (card = user_id, device = k), documents, lineitem and pages."""

from pyspark.sql import functions as F

from watchfold.operators import evaluation as V, features as X
from watchfold.plans.registry import EVENTS_SQL, Tables, query

WINDOWS = {"1h": 3600, "24h": 86400}


def velocity_frame(spark, sf):
    return X.velocity(Tables(spark, sf).events, "user_id", "us", "value", WINDOWS)


VELOCITY_SQL = EVENTS_SQL + """, vel AS (
  SELECT *, count(*) OVER h AS velocity_count_1h, coalesce(sum(value) OVER h, 0) AS velocity_value_1h,
         count(*) OVER d AS velocity_count_24h, coalesce(sum(value) OVER d, 0) AS velocity_value_24h
  FROM ev
  WINDOW h AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING),
         d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))"""


@query(
    "flagship_risky_users",
    f"""WITH {VELOCITY_SQL}, linked AS (SELECT *, count(*) OVER (PARTITION BY k) AS device_linkage_count FROM vel)
        SELECT user_id, count(*) AS busy_events, round(sum(value), 4) AS amount,
               max(device_linkage_count) AS widest_device, max(velocity_count_24h) AS peak_24h
        FROM linked WHERE velocity_count_24h >= 3 GROUP BY user_id ORDER BY sum(value) DESC, user_id LIMIT 20""",
)
def flagship(spark, sf):
    # devices are counted on the events themselves, so that the windows are built once
    counted = X.linkage_count(Tables(spark, sf).events, "k", "device_linkage_count")
    linked = X.velocity(counted, "user_id", "us", "value", WINDOWS)
    per_user = (
        linked.where(F.col("velocity_count_24h") >= 3)
        .groupBy("user_id")
        .agg(
            F.count(F.lit(1)).alias("busy_events"),
            F.round(F.sum("value"), 4).alias("amount"),
            F.max("device_linkage_count").alias("widest_device"),
            F.max("velocity_count_24h").alias("peak_24h"),
        )
    )
    return per_user.orderBy(F.desc("amount"), "user_id").limit(20)


@query(
    "i1_join_identity",
    """SELECT d.doc_id, d.lang, l.quality, CAST(l.quality IS NOT NULL AS INTEGER) AS has_identity
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def i1(spark, sf):
    t = Tables(spark, sf)
    labels = t.labels.select("doc_id", "quality")
    return X.join_identity(t.documents.select("doc_id", "lang"), labels, "doc_id", "quality")


@query(
    "i2_impute_median",
    """WITH j AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN CAST(d.n_chars AS DOUBLE) END AS dist1
                  FROM documents d LEFT JOIN labels l USING (doc_id))
       SELECT doc_id, coalesce(dist1, (SELECT quantile_cont(dist1, 0.5) FROM j)) AS dist1,
              CAST(dist1 IS NULL AS INTEGER) AS dist1_missing FROM j""",
)
def i2(spark, sf):
    t = Tables(spark, sf)
    known = t.labels.select("doc_id", F.lit(True).alias("known"))
    j = t.documents.select("doc_id", "n_chars").join(known, "doc_id", "left")
    j = j.select("doc_id", F.when(F.col("known"), F.col("n_chars").cast("double")).alias("dist1"))
    return X.impute_median(j, "dist1")


@query(
    "i3_velocity",
    f"""WITH {VELOCITY_SQL} SELECT event_id, velocity_count_1h, round(velocity_value_1h, 4) AS velocity_value_1h,
        velocity_count_24h, round(velocity_value_24h, 4) AS velocity_value_24h FROM vel""",
)
def i3(spark, sf):
    return velocity_frame(spark, sf).select(
        "event_id",
        "velocity_count_1h",
        F.round("velocity_value_1h", 4).alias("velocity_value_1h"),
        "velocity_count_24h",
        F.round("velocity_value_24h", 4).alias("velocity_value_24h"),
    )


@query(
    "i4_counter_totals",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
       round(l_quantity + l_extendedprice + l_discount + l_tax, 4) AS c_total,
       greatest(l_quantity, l_extendedprice, l_discount, l_tax) AS c_max FROM lineitem""",
)
def i4(spark, sf):
    counters = {"l_quantity": "C1", "l_extendedprice": "C2", "l_discount": "C3", "l_tax": "C4"}
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
    lines = Tables(spark, sf).lineitem.select(*keys, *[F.col(c).alias(a) for c, a in counters.items()])
    return X.counter_totals(lines).select(*keys, F.round("c_total", 4).alias("c_total"), "c_max")


@query(
    "i5_missing_flags",
    """SELECT d.doc_id, CAST(l.quality IS NULL AS INTEGER) AS r_email_missing, CAST(d.lang IS NULL AS INTEGER) AS p_email_missing
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def i5(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return X.missing_flags(j, {"r_email_missing": "quality", "p_email_missing": "lang"}).drop("lang", "quality")


@query(
    "i6_interactions",
    f"""WITH {EVENTS_SQL}, a AS (SELECT event_id, value, event_type, coalesce(CASE WHEN k < 80 THEN CAST(k AS DOUBLE) * 6 END, 999) AS age FROM ev)
        SELECT event_id, CAST(age < 7 AND value > 20 AND event_type = 'purchase' AS INTEGER) AS new_acct_highval_express,
               CAST(age < 7 AS INTEGER) AS new_acct_flag, least(age, 365) AS addr_age_days FROM a""",
)
def i6(spark, sf):
    ev = Tables(spark, sf).events.withColumn("age", F.when(F.col("k") < 80, F.col("k") * 6))
    return X.interactions(ev, "age", "value", "event_type", express="purchase", high=20).select(
        "event_id", "new_acct_highval_express", "new_acct_flag", "addr_age_days"
    )


_HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query(
    "i7_tld_mismatch",
    f"""WITH h AS (SELECT page_id, {_HOST_SQL} AS host FROM pages),
        p AS (SELECT a.page_id, a.host AS a, b.host AS b FROM h a LEFT JOIN h b ON b.page_id = a.page_id + 1),
        t AS (SELECT page_id, lower(string_split(coalesce(a, ''), '.')[-1]) AS x, lower(string_split(coalesce(b, ''), '.')[-1]) AS y FROM p)
        SELECT page_id, CAST(x <> y AND x <> '' AND y <> '' AS INTEGER) AS email_domain_mismatch FROM t""",
)
def i7(spark, sf):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    pages = Tables(spark, sf).pages.select("page_id", host.alias("a"))
    following = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("a").alias("b"))
    return X.tld_mismatch(pages.join(following, "page_id", "left"), "a", "b").select("page_id", "email_domain_mismatch")


@query(
    "i8_linkage_count",
    f"""WITH {EVENTS_SQL}, d AS (SELECT event_id, CASE WHEN k % 10 <> 0 THEN k END AS device FROM ev)
        SELECT event_id, CASE WHEN device IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY device) END AS device_linkage_count,
               1::BIGINT AS absent_linkage_count FROM d""",
)
def i8(spark, sf):
    ev = Tables(spark, sf).events.select("event_id", F.when(F.col("k") % 10 != 0, F.col("k")).alias("device"))
    out = X.linkage_count(ev, "device", "device_linkage_count")
    return X.linkage_count(out, "not_there", "absent_linkage_count").drop("device")


@query(
    "i9_select_features",
    f"""WITH {EVENTS_SQL} SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS y, CASE WHEN event_id % 7 <> 0 THEN value END AS value, k, event_type, 0 AS dist1 FROM ev""",
)
def i9(spark, sf):
    ev = Tables(spark, sf).events.withColumn("y", (F.col("event_type") == "error").cast("int"))
    ev = ev.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value")))
    return X.select_features(ev, "y", ["ts", "props", "user_id", "not_there"], ["event_id", "value", "k", "event_type", "dist1"])


@query(
    "i10_category_codes",
    """WITH fit AS (SELECT event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS code
                    FROM (SELECT DISTINCT event_type FROM events WHERE ts < TIMESTAMP '2024-01-16')),
       seen AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'new' ELSE event_type END AS event_type FROM events)
       SELECT event_id, coalesce(code, -1) AS code FROM seen LEFT JOIN fit USING (event_type)""",
)
def i10(spark, sf):
    ev = Tables(spark, sf).events
    codes = X.fit_codes(ev.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")), "event_type")
    seen = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, "new").otherwise(F.col("event_type"))
    return X.apply_codes(ev.select("event_id", seen.alias("event_type")), codes, "event_type").select("event_id", "code")


@query(
    "i11_select_by_id",
    f"""WITH {EVENTS_SQL}, ids AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS pos FROM ev WHERE event_type = 'error')
        SELECT e.event_id, e.user_id, e.value, i.pos FROM ev e JOIN ids i USING (event_id)""",
)
def i11(spark, sf):
    from watchfold.scale import prefix_sum

    ev = Tables(spark, sf).events.select("event_id", "user_id", "value", "event_type")
    key = F.struct((-F.col("value")).alias("v"), F.col("event_id").alias("event_id"))
    errors = ev.where(F.col("event_type") == "error").select(key.alias("o"), F.lit(1).alias("n"))
    ids = prefix_sum(errors, "o", ["n"]).select(F.col("o.event_id").alias("event_id"), F.col("cum_n").alias("pos"))
    return X.select_by_id(ev.drop("event_type"), ids, "event_id")


@query(
    "i_fraud_features",
    f"""WITH {VELOCITY_SQL}, tx AS (SELECT *, CASE WHEN event_id % 3 <> 0 THEN value END AS dist0, CASE WHEN k % 5 <> 0 THEN k END AS age FROM vel),
      med AS (SELECT quantile_cont(dist0, 0.5) AS m FROM tx), codes AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM ev))
    SELECT event_id, CAST(c_custkey IS NOT NULL AS INTEGER) AS has_identity, c_mktsegment AS segment, coalesce(dist0, m) AS dist, CAST(dist0 IS NULL AS INTEGER) AS dist_missing,
      CAST(coalesce(age, 999) < 20 AS INTEGER) AS new_acct_flag, CAST(coalesce(age, 999) < 20 AND value > 50 AND event_type = 'purchase' AS INTEGER) AS new_acct_highval_express,
      CAST(least(coalesce(age, 999), 365) AS DOUBLE) AS addr_age_days, count(*) OVER (PARTITION BY k) AS device_linkage_count, CAST(code AS INTEGER) AS event_type_code,
      velocity_count_1h, round(velocity_value_1h, 4) AS velocity_value_1h, velocity_count_24h, round(velocity_value_24h, 4) AS velocity_value_24h
    FROM tx CROSS JOIN med JOIN codes USING (event_type) LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) c ON c_custkey = user_id""",
)
def i_run(spark, sf):
    """All features of a transaction in one run."""
    t = Tables(spark, sf)
    tx = t.events.withColumns(
        {"dist": F.when(F.col("event_id") % 3 != 0, F.col("value")), "age": F.when(F.col("k") % 5 != 0, F.col("k"))}
    ).select("event_id", "user_id", "us", "value", "k", "event_type", "dist", "age")
    identity = t.customer.where(F.col("c_custkey") % 4 != 0).select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    out = X.fraud_features(
        tx, identity, "user_id", "segment", "user_id", "us", "value", WINDOWS, "dist", "age", "event_type", "k", ["event_type"], "purchase", 20, 50
    )
    rounded = {c: F.round(c, 4) for c in ("velocity_value_1h", "velocity_value_24h")}
    return out.withColumns(rounded).drop("user_id", "us", "value", "k", "event_type", "age")
