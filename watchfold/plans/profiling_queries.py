"""H: profiling over events and the partly labelled documents."""

from pyspark.sql import functions as F

from watchfold.operators import profiling as P
from watchfold.plans.registry import EVENTS_SQL, Tables, query


@query(
    "h1_label_profile",
    """SELECT count(*) AS rows, 7 AS columns, round(avg(y), 9) AS label_rate, CAST(sum(y) AS BIGINT) AS label_count,
       round(avg(value), 6) AS mean_amount, round(quantile_cont(value, 0.5), 6) AS median_amount
       FROM (SELECT *, CAST(event_type = 'error' AS INTEGER) AS y FROM events)""",
)
def h1(spark, sf):
    ev = Tables(spark, sf).events.drop("us", "k").withColumn("y", (F.col("event_type") == "error").cast("int"))
    out = P.label_profile(ev, "y", "value")
    return out.withColumns({c: F.round(c, d) for c, d in (("label_rate", 9), ("mean_amount", 6), ("median_amount", 6))})


@query(
    "h2_join_coverage",
    """SELECT count(*) AS rows, count(l.doc_id) AS matched, round(avg(CAST(l.doc_id IS NOT NULL AS INTEGER)), 9) AS coverage
       FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""",
)
def h2(spark, sf):
    t = Tables(spark, sf)
    return P.join_coverage(t.documents, t.labels, "doc_id").withColumn("coverage", F.round("coverage", 9))


@query(
    "h3_null_rates",
    """WITH j AS (SELECT d.doc_id, d.lang, l.quality, CASE WHEN l.quality = 1 THEN l.toxic END AS toxic
                  FROM documents d LEFT JOIN labels l USING (doc_id))
       SELECT * FROM (
         SELECT 'quality' AS "column", round(avg(CAST(quality IS NULL AS INTEGER)), 9) AS null_rate FROM j
         UNION ALL SELECT 'toxic', round(avg(CAST(toxic IS NULL AS INTEGER)), 9) FROM j
         UNION ALL SELECT 'lang', round(avg(CAST(lang IS NULL AS INTEGER)), 9) FROM j) WHERE null_rate > 0""",
)
def h3(spark, sf):
    t = Tables(spark, sf)
    j = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    j = j.withColumn("toxic", F.when(F.col("quality") == 1, F.col("toxic")))
    return P.null_rates(j, 20).withColumn("null_rate", F.round("null_rate", 9))


@query("h4_value_counts", "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def h4(spark, sf):
    return P.value_counts(Tables(spark, sf).events, "event_type")


_PCTS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query(
    "h5_quantiles",
    "SELECT " + ", ".join(f"round(quantile_cont(value, {p}), 6) AS {n}" for n, p in _PCTS.items()) + " FROM events",
)
def h5(spark, sf):
    out = P.quantiles(Tables(spark, sf).events, "value", _PCTS)
    return out.select(*[F.round(c, 6).alias(c) for c in _PCTS])


@query(
    "h6_describe_by",
    """SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS p25,
       round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75
       FROM events GROUP BY event_type""",
)
def h6(spark, sf):
    out = P.describe_by(Tables(spark, sf).events, "event_type", "value", groups=1_000)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "p25", "p50", "p75")})
