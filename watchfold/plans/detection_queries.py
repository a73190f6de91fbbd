"""F and G: events against users, assets and orders; case lookup over the same rows."""

from pyspark.sql import functions as F

from watchfold.functions import levels as L
from watchfold.functions.text import redact_email, techniques
from watchfold.operators import detection as D, lookup as G
from watchfold.plans.registry import EVENTS_SQL, Tables, query
from watchfold.sources.sink import new_documents

SOURCES = ["click", "error", "purchase", "signup", "view"]

HITS_SQL = EVENTS_SQL + """, acts AS (SELECT event_id, us, ts, user_id, event_type AS source_system, 'u' || user_id AS "user", 'h' || k AS host, '10.0.0.' || (user_id % 100) AS ip FROM ev),
  assets AS (SELECT 'a' || s_suppkey AS asset, 'h' || s_suppkey AS host, '10.0.0.' || (s_suppkey * 3 % 1009) AS ip, s_acctbal > 5000 AS critical FROM supplier
    UNION ALL SELECT 'a' || s_suppkey, 'h' || (s_suppkey % 50), NULL, false FROM supplier UNION ALL SELECT 'a' || s_suppkey, 'h' || (s_suppkey % 50), NULL, s_suppkey % 3 = 0 FROM supplier),
  hits AS (SELECT event_id, source_system, 'user' AS entity_type, 'u' || user_id AS entity_id, c_nationkey < 5 AS is_privileged, false AS is_asset_critical FROM acts JOIN customer ON c_custkey = user_id
    UNION ALL SELECT event_id, source_system, 'asset', asset, false, bool_or(critical) FROM acts JOIN assets ON assets.host = acts.host OR assets.ip = acts.ip GROUP BY ALL)"""


def acts(t):
    return t.events.select(
        "event_id", "us", "ts", "user_id",
        F.col("event_type").alias("source_system"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("h"), F.col("k").cast("string")).alias("host"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 100).cast("string")).alias("ip"),
    )


def hits(t):
    key = F.col("s_suppkey")
    assets = t.supplier.select(
        F.concat(F.lit("a"), key.cast("string")).alias("asset"),
        F.concat(F.lit("h"), key.cast("string")).alias("host"),
        F.concat(F.lit("10.0.0."), (key * 3 % 1009).cast("string")).alias("ip"),
        (F.col("s_acctbal") > 5000).alias("critical"),
    )
    # every asset also under a second host, listed twice
    for critical in (F.lit(False), key % 3 == 0):
        assets = assets.union(t.supplier.select(
            F.concat(F.lit("a"), key.cast("string")), F.concat(F.lit("h"), (key % 50).cast("string")), F.lit(None).cast("string"), critical
        ))
    users = t.customer.select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user"), "c_nationkey")
    return D.entity_hits(acts(t), users, assets, users.where(F.col("c_nationkey") < 5))


@query("f1_entity_hits", f"WITH {HITS_SQL} SELECT * FROM hits")
def f1(spark, sf):
    return hits(Tables(spark, sf))


_RULE_SQL = EVENTS_SQL + """, rule AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS n FROM ev WHERE event_type <> 'view'
   AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1, 2 HAVING count(*) > 2)"""


def rule_hits(t):
    allow = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("user_id"))
    return D.threshold_rule(t.events, F.col("event_type") != "view", "user_id", "ts", "6 hours", 2, allow)


@query("f2_threshold_rule", f"WITH {_RULE_SQL} SELECT user_id, window_start, window_start + INTERVAL 6 HOUR AS window_end, n FROM rule")
def f2(spark, sf):
    return rule_hits(Tables(spark, sf))


@query(
    "f3_threshold_trailing",
    f"""WITH {EVENTS_SQL}, t AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS n FROM ev
          WHERE event_type <> 'view' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
        SELECT event_id, user_id, n FROM t WHERE n > 2""",
)
def f3(spark, sf):
    t = Tables(spark, sf)
    allow = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("user_id"))
    out = D.threshold_trailing(t.events, F.col("event_type") != "view", "user_id", "us", 21600, 2, allow)
    return out.select("event_id", "user_id", "n")


@query(
    "f4_severity",
    f"""WITH {EVENTS_SQL}, a AS (SELECT event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS r, k, value FROM ev),
        b AS (SELECT *, CASE WHEN k < 30 THEN least(3, r + 1) ELSE r END AS r1 FROM a), c AS (SELECT *, CASE WHEN value > 60 THEN greatest(0, r1 - 2) ELSE r1 END AS r2 FROM b)
        SELECT event_id, ['low', 'medium', 'high', 'critical'][r2 + 1] AS severity FROM c""",
)
def f4(spark, sf):
    level = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "click", "medium").otherwise("low")
    bumps = [(F.col("k") < 30, 1), (F.col("value") > 60, -2)]
    ev = Tables(spark, sf).events.withColumn("level", level)
    return ev.select("event_id", L.severity("level", bumps).alias("severity"))


NEAR_SQL = EVENTS_SQL + """, near AS (SELECT a.event_id, count(b.event_id) AS matches FROM ev a LEFT JOIN ev b ON b.user_id = a.user_id AND b.event_type <> a.event_type
    AND b.us BETWEEN a.us - 450000000 AND a.us + 450000000 GROUP BY a.event_id)"""


def corroborated(t):
    ev = t.events
    return D.corroborate(ev, ev, "event_id", "user_id", "us", "event_type", SOURCES, 900)


@query("f7_corroborate", f"WITH {NEAR_SQL} SELECT event_id, matches, matches = 0 AS single_source FROM near")
def f7(spark, sf):
    return corroborated(Tables(spark, sf)).select("event_id", "matches", "single_source")


_PAIRS_SQL = EVENTS_SQL + """, pairs AS (SELECT a.event_id, b.event_id AS corroborating_id FROM ev a JOIN ev b ON b.user_id = a.user_id AND b.event_type <> a.event_type
    AND b.us BETWEEN a.us - 450000000 AND a.us + 450000000)"""


@query("f7_corroborating_events", f"WITH {_PAIRS_SQL} SELECT event_id, corroborating_id FROM pairs")
def f7_pairs(spark, sf):
    ev = Tables(spark, sf).events
    return D.corroborating_events(ev, ev, "event_id", "event_id", "user_id", "us", "event_type", SOURCES, 900)


@query(
    "f11_evidence_links",
    f"""WITH {_PAIRS_SQL}, hot AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS w FROM ev WHERE event_type <> 'view' GROUP BY 1, 2 HAVING count(*) > 2),
        own AS (SELECT 'f-' || e.user_id || '-' || epoch_us(w) AS finding_id, event_id FROM ev e JOIN hot ON hot.user_id = e.user_id AND hot.w = time_bucket(INTERVAL 6 HOUR, e.ts) WHERE event_type <> 'view'),
        links AS (SELECT finding_id, event_id AS artefact_id, 0 AS r FROM own UNION ALL SELECT finding_id, corroborating_id, 1 FROM own JOIN pairs USING (event_id))
        SELECT finding_id, artefact_id, CASE WHEN min(r) = 0 THEN 'hit' ELSE 'corroborating' END AS role FROM links GROUP BY 1, 2""",
)
def f11_links(spark, sf):
    ev = Tables(spark, sf).events
    chosen, start = ev.where("event_type <> 'view'"), F.window("ts", "6 hours")["start"]
    found = D.threshold_rule(ev, F.col("event_type") != "view", "user_id", "ts", "6 hours", 2).select("user_id", "window_start")
    name = F.concat_ws("-", F.lit("f"), F.col("user_id").cast("string"), F.unix_micros(F.col("window_start").cast("timestamp")).cast("string"))
    own = chosen.withColumn("window_start", start).join(found, ["user_id", "window_start"]).withColumn("finding_id", name)
    pairs = D.corroborating_events(own, ev, "event_id", "event_id", "user_id", "us", "event_type", SOURCES, 900)
    return D.evidence_links(own.select("finding_id", "event_id"), pairs, "event_id")


_RULE_SET = 50
_RULE_SET_SQL = EVENTS_SQL + """, rules AS (SELECT i, 'rule-' || i AS rule_id, (1 + i % 6) * 3600000000 AS step, 1 + i % 3 AS n, i % 10 = 9 AS moves FROM range(50) t(i)),
  tagged AS (SELECT rule_id, step, n AS most, moves, CASE WHEN i % 2 = 0 THEN user_id ELSE k END AS key, us FROM ev JOIN rules ON k % 10 = i % 10 AND (i % 4 > 0 OR event_type = 'error')),
  fixed AS (SELECT rule_id, CAST(key AS VARCHAR) AS key, us - us % step AS window_start_us, us - us % step + step AS window_end_us, count(*) AS n FROM tagged WHERE NOT moves GROUP BY rule_id, key, step, most, us - us % step HAVING count(*) > most),
  moving AS (SELECT rule_id, CAST(key AS VARCHAR) AS key, us - step AS window_start_us, us AS window_end_us, most,
    count(*) OVER (PARTITION BY rule_id, key ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS n6,
    count(*) OVER (PARTITION BY rule_id, key ORDER BY us RANGE BETWEEN 14399999999 PRECEDING AND CURRENT ROW) AS n4,
    count(*) OVER (PARTITION BY rule_id, key ORDER BY us RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW) AS n2, step FROM tagged WHERE moves),
  m AS (SELECT rule_id, key, window_start_us, window_end_us, most, CASE step WHEN 21600000000 THEN n6 WHEN 14400000000 THEN n4 ELSE n2 END AS n FROM moving)"""


def rule_set():
    """Fifty rules over users or devices, every tenth with a trailing window."""
    def one(i):
        chosen = F.col("k") % 10 == i % 10
        if i % 4 == 0:
            chosen = chosen & (F.col("event_type") == "error")
        return D.Rule(f"rule-{i}", chosen, F.col("user_id" if i % 2 == 0 else "k"), (1 + i % 6) * 3600, 1 + i % 3, i % 10 == 9)

    return [one(i) for i in range(_RULE_SET)]


@query(
    "f2_rule_set",
    f"WITH {_RULE_SET_SQL} SELECT * FROM fixed UNION ALL SELECT rule_id, key, window_start_us, window_end_us, n FROM m WHERE n > most",
)
def f2_rules(spark, sf):
    return D.run_rules(Tables(spark, sf).events, rule_set(), "us")


_CONF_SQL = NEAR_SQL + """, flags AS (SELECT e.event_id, matches = 0 AS single_source, coalesce(c_nationkey < 5, false) AS is_privileged, k < 20 AS is_asset_critical, least(k, 60) AS base FROM ev e JOIN near USING (event_id)
    LEFT JOIN customer ON c_custkey = user_id),
  conf AS (SELECT event_id, CASE WHEN single_source THEN -10 ELSE 30 END AS corroboration, CASE WHEN is_privileged THEN 10 ELSE 0 END AS privileged, CASE WHEN is_asset_critical THEN 10 ELSE 0 END AS critical FROM flags)"""


@query(
    "f5_confidence",
    f"""WITH {_CONF_SQL} SELECT event_id, 55 AS base, corroboration, privileged, critical, greatest(1, least(100, 55 + corroboration + privileged + critical)) AS confidence_score,
        CASE WHEN confidence_score <= 39 THEN 'weak' WHEN confidence_score <= 69 THEN 'mixed' WHEN confidence_score <= 89 THEN 'strong' ELSE 'multi_source' END AS confidence_band FROM conf""",
)
def f5(spark, sf):
    t = Tables(spark, sf)
    who = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") < 5).alias("p"))
    flagged = corroborated(t).join(who, "user_id", "left").withColumns(
        {"is_privileged": F.coalesce("p", F.lit(False)), "is_asset_critical": F.col("k") < 20}
    )
    return D.confidence(flagged).select("event_id", "terms.*", "confidence_score", "confidence_band")


@query(
    "f6_confidence_band",
    f"""WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k <= 39 THEN 'weak' WHEN k <= 69 THEN 'mixed' WHEN k <= 89 THEN 'strong' ELSE 'multi_source' END AS band FROM ev""",
)
def f6(spark, sf):
    return Tables(spark, sf).events.select("event_id", L.confidence_band("k").alias("band"))


@query(
    "f8_techniques",
    f"""WITH {EVENTS_SQL} SELECT event_id, CASE WHEN k % 3 = 0 THEN 'T' || (1500 + k) WHEN k % 3 = 1 THEN 'T' || (1500 + k) || '.00' || (k % 10) || ',T1059' ELSE '' END AS techniques FROM ev""",
)
def f8(spark, sf):
    k = F.col("k").cast("string")
    number = (F.col("k") + 1500).cast("string")
    sub = F.concat(F.lit("attack.t"), number, F.lit(".00"), (F.col("k") % 10).cast("string"))
    tags = (
        F.when(F.col("k") % 3 == 0, F.array(F.lit("attack.exfiltration"), F.concat(F.lit("attack.t"), number)))
        .when(F.col("k") % 3 == 1, F.array(sub, F.lit("car.t1001"), F.lit("attack.t1059")))
        .otherwise(F.array(F.lit("attack.persistence"), F.concat(F.lit("attack.t"), number, F.lit("x"))))
    )
    return Tables(spark, sf).events.select("event_id", F.array_join(techniques(tags), ",").alias("techniques"))


_FIND_SQL = _RULE_SQL + """, findings AS (SELECT *, sha256('IT-0001' || strftime(window_start, '%Y-%m-%dT%H:%M:%S') || user_id) AS finding_id FROM rule)"""


def findings(t):
    start = F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss")
    return rule_hits(t).withColumn("finding_id", D.finding_id(F.lit("IT-0001"), start, F.col("user_id").cast("string")))


@query("f9_finding_ids", f"WITH {_FIND_SQL} SELECT finding_id, user_id, n FROM findings WHERE window_start >= TIMESTAMP '2024-01-15'")
def f9(spark, sf):
    """A second run adds only what the first did not have."""
    f = findings(Tables(spark, sf))
    first = f.where(F.col("window_start") < F.lit("2024-01-15").cast("timestamp_ntz"))
    return new_documents(f, first, "finding_id", "window_start").select("finding_id", "user_id", "n")


@query(
    "f10_rule_windows",
    """SELECT p_partkey AS rule_id, CAST(greatest(p_size * 20, 300) + 900 AS INTEGER) AS lookback_s,
       coalesce(o_orderdate, TIMESTAMP '2025-01-01') - to_seconds(greatest(p_size * 20, 300) + 900) AS read_from, TIMESTAMP '2025-01-01' AS read_to
       FROM part LEFT JOIN orders ON o_orderkey = p_partkey AND o_orderstatus = 'F'""",
)
def f10(spark, sf):
    t = Tables(spark, sf)
    rules = t.part.select(F.col("p_partkey").alias("rule_id"), (F.col("p_size") * 20).alias("timeframe_s"), F.lit(900).alias("corroboration_s"))
    state = t.orders.where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("rule_id"), F.col("o_orderdate").alias("last_run_at"))
    return D.rule_windows(state, rules, F.lit("2025-01-01").cast("timestamp_ntz"))


@query(
    "f11_finding_links",
    f"""WITH {_FIND_SQL} SELECT DISTINCT finding_id, 'art-' || event_id AS artefact_id FROM findings f JOIN ev e ON e.user_id = f.user_id AND time_bucket(INTERVAL 6 HOUR, e.ts) = f.window_start""",
)
def f11(spark, sf):
    t = Tables(spark, sf)
    ev = t.events.withColumn("artefact_id", F.concat(F.lit("art-"), F.col("event_id").cast("string")))
    return D.finding_links(findings(t), ev, "user_id", "ts", "6 hours")


@query(
    "f12_rule_precision",
    f"""WITH {EVENTS_SQL}, f AS (SELECT 'r' || (k % 20) AS rule_id, CASE WHEN event_type IN ('error', 'click') THEN 'true_positive' WHEN event_type = 'view' THEN 'inconclusive' ELSE 'false_positive' END AS disposition, ts FROM ev
          WHERE ts >= TIMESTAMP '2024-02-05' - INTERVAL 30 DAY AND ts < TIMESTAMP '2024-02-05'),
        c AS (SELECT rule_id, count(*) FILTER (disposition = 'true_positive') AS tp, count(*) FILTER (disposition = 'false_positive') AS fp FROM f GROUP BY 1)
        SELECT rule_id, tp, fp, round(tp / (tp + fp), 9) AS precision FROM c""",
)
def f12(spark, sf):
    word = F.when(F.col("event_type").isin("error", "click"), "true_positive").when(F.col("event_type") == "view", "inconclusive").otherwise("false_positive")
    f = Tables(spark, sf).events.select(
        F.concat(F.lit("r"), (F.col("k") % 20).cast("string")).alias("rule_id"), word.alias("disposition"), F.col("ts").alias("closed_at")
    )
    out = D.rule_precision(f, F.lit("2024-02-05").cast("timestamp_ntz"))
    return out.withColumn("precision", F.round("precision", 9))


REPORT_CASE = "case-7"
_REP_SQL = EVENTS_SQL + """, items AS (SELECT 'art-' || event_id AS artefact_id, 'case-' || (user_id % 40) AS case_id, sha256(props || event_id) AS sha256, strftime(ts, '%Y-%m-%d %H:%M:%S') AS collected_at_utc, event_type AS source_system FROM ev),
  finds AS (SELECT 'f-' || (user_id % 40) || '-' || k AS finding_id, 'case-' || (user_id % 40) AS case_id, count(*) < 2 AS single_source FROM ev GROUP BY user_id % 40, k),
  links AS (SELECT DISTINCT 'f-' || (user_id % 40) || '-' || k AS finding_id, 'art-' || event_id AS artefact_id FROM ev),
  custody AS (SELECT 'art-' || (event_id - event_id % 3) AS artefact_id, ts FROM ev)"""


def report(t):
    case = F.concat(F.lit("case-"), (F.col("user_id") % 40).cast("string"))
    find = F.concat(F.lit("f-"), (F.col("user_id") % 40).cast("string"), F.lit("-"), F.col("k").cast("string"))
    art = F.concat(F.lit("art-"), F.col("event_id").cast("string"))
    ev = t.events
    items = ev.select(
        art.alias("artefact_id"), case.alias("case_id"),
        F.sha2(F.concat("props", F.col("event_id").cast("string")), 256).alias("sha256"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("collected_at_utc"), F.col("event_type").alias("source_system"),
    )
    finds = ev.groupBy(find.alias("finding_id"), case.alias("case_id")).agg((F.count(F.lit(1)) < 2).alias("single_source"))
    links = ev.select(find.alias("finding_id"), art.alias("artefact_id")).distinct()
    custody = ev.select(
        F.concat(F.lit("art-"), (F.col("event_id") - F.col("event_id") % 3).cast("string")).alias("artefact_id"), F.col("ts").alias("event_time_utc")
    )
    cases = ev.select(case.alias("case_id")).distinct()
    return D.case_report(REPORT_CASE, cases, finds, links, items, custody)


@query(
    "f13_report_findings",
    f"WITH {_REP_SQL} SELECT CASE WHEN single_source THEN 'suppressed' ELSE 'main' END AS part, finding_id FROM finds WHERE case_id = '{REPORT_CASE}'",
)
def f13(spark, sf):
    r = report(Tables(spark, sf))
    main = r["findings"].select(F.lit("main").alias("part"), "finding_id")
    return main.unionByName(r["suppressed"].select(F.lit("suppressed").alias("part"), "finding_id"))


@query(
    "f13_report_inventory",
    f"""WITH {_REP_SQL}, c AS (SELECT artefact_id, count(*) AS custody_events FROM custody GROUP BY 1)
        SELECT artefact_id, sha256, source_system, coalesce(custody_events, 0) AS custody_events FROM items LEFT JOIN c USING (artefact_id) WHERE case_id = '{REPORT_CASE}'""",
)
def f13_inventory(spark, sf):
    return report(Tables(spark, sf))["inventory"].select("artefact_id", "sha256", "source_system", "custody_events")


@query(
    "f13_report_evidence",
    f"WITH {_REP_SQL} SELECT finding_id, artefact_id, sha256 FROM finds JOIN links USING (finding_id) JOIN items USING (artefact_id) WHERE finds.case_id = '{REPORT_CASE}'",
)
def f13_evidence(spark, sf):
    return report(Tables(spark, sf))["finding_evidence"]


@query(
    "f13_report_timeline",
    f"WITH {_REP_SQL} SELECT artefact_id, sha256, collected_at_utc, source_system FROM items WHERE case_id = '{REPORT_CASE}' ORDER BY collected_at_utc, artefact_id",
)
def f13_timeline(spark, sf):
    return report(Tables(spark, sf))["timeline"]


_EMAIL_SQL = "CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 9 = 1 THEN c_mktsegment[1:(c_custkey % 2 + 1)] || '@x.example' ELSE c_name || '@' || c_mktsegment END"
_MASK_SQL = f"""CASE WHEN c_custkey % 9 = 0 THEN '' WHEN c_custkey % 9 = 1 THEN repeat('*', c_custkey % 2 + 1) || '@x.example'
   ELSE c_name[1] || repeat('*', length(c_name) - 2) || c_name[-1] || '@' || c_mktsegment END"""


def emails():
    short = F.concat(F.substring("c_mktsegment", F.lit(1), (F.col("c_custkey") % 2 + 1).cast("int")), F.lit("@x.example"))
    return F.when(F.col("c_custkey") % 9 == 0, "").when(F.col("c_custkey") % 9 == 1, short).otherwise(F.concat_ws("@", "c_name", "c_mktsegment"))


@query("g4_redact_email", f"SELECT c_custkey, {_MASK_SQL} AS email FROM customer")
def g4(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", redact_email(emails()).alias("email"))


@query(
    "f14_redact",
    """SELECT 'hr_handover' AS class, c_custkey, c_name[1] || repeat('*', length(c_name) - 2) || c_name[-1] || '@' || c_mktsegment AS email, CAST(NULL AS INTEGER) AS nation, 'ref-' || c_custkey AS subject FROM customer
       UNION ALL SELECT 'internal_ir_only', c_custkey, c_name || '@' || c_mktsegment, c_nationkey, 'ref-' || c_custkey FROM customer
       UNION ALL SELECT 'external_regulator', c_custkey, NULL, NULL, 'ref-' || c_custkey FROM customer""",
)
def f14(spark, sf):
    rows = Tables(spark, sf).customer.select(
        "c_custkey",
        F.concat_ws("@", "c_name", "c_mktsegment").alias("email"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_name").alias("subject"),
        F.concat(F.lit("ref-"), F.col("c_custkey").cast("string")).alias("subject_ref"),
    )
    tags = {"email": "contact", "nation": "network"}
    out = None
    for cls in ("hr_handover", "internal_ir_only", "external_regulator"):
        part = D.redact(rows, cls, tags, "subject").withColumn("class", F.lit(cls)).drop("subject_ref")
        out = part if out is None else out.unionByName(part)
    return out


# --- lookup ------------------------------------------------------------------------------

LOOK_SQL = EVENTS_SQL + """, viol AS (SELECT event_id AS violation_id, ts AS detected_at_utc, 'host' || (k % 10) AS hostname, 'os' || user_id AS os_username, 'U' || (user_id % 30) || '@Example.com' AS chrome_email,
     'p' || (k % 5) AS pattern_name, CASE WHEN k % 2 = 0 THEN 'removed' ELSE 'failed' END AS action_taken FROM ev WHERE event_type <> 'error'),
  hit AS (SELECT event_id, k AS run_id, event_type AS source_system, 'user' AS entity_type, 'os' || user_id AS entity_id, ts AS matched_at_utc FROM ev),
  run AS (SELECT p_partkey AS run_id, p_type AS pipeline_stage, p_brand AS pipeline_status FROM part WHERE p_partkey < 50),
  v AS (SELECT * FROM viol WHERE os_username = 'os7' OR chrome_email ILIKE 'u11@example.com'),
  h AS (SELECT * FROM hit JOIN run USING (run_id) WHERE entity_id = 'os7' AND entity_type = 'user')"""


def _lookup(t):
    user = F.concat(F.lit("os"), F.col("user_id").cast("string"))
    viol = t.events.where(F.col("event_type") != "error").select(
        F.col("event_id").alias("violation_id"),
        F.col("ts").alias("detected_at_utc"),
        F.concat(F.lit("host"), (F.col("k") % 10).cast("string")).alias("hostname"),
        user.alias("os_username"),
        F.concat(F.lit("U"), (F.col("user_id") % 30).cast("string"), F.lit("@Example.com")).alias("chrome_email"),
        F.concat(F.lit("p"), (F.col("k") % 5).cast("string")).alias("pattern_name"),
        F.when(F.col("k") % 2 == 0, "removed").otherwise("failed").alias("action_taken"),
    )
    hit = t.events.select(
        "event_id", F.col("k").cast("bigint").alias("run_id"), F.col("event_type").alias("source_system"), F.lit("user").alias("entity_type"),
        user.alias("entity_id"), F.col("ts").alias("matched_at_utc"),
    )
    none = F.lit(None).cast("timestamp_ntz")
    run = t.part.where(F.col("p_partkey") < 50).select(
        F.col("p_partkey").alias("run_id"), F.col("p_type").alias("stage"), F.col("p_brand").alias("status"),
        none.alias("watermark_start"), none.alias("watermark_end"),
    )
    return G.lookup_violations(viol, "os7", "u11@example.com"), G.lookup_hits(hit, run, "os7")


@query("g1_lookup_violations", f"WITH {LOOK_SQL} SELECT violation_id, detected_at_utc, hostname, os_username, chrome_email, pattern_name, action_taken FROM v")
def g1(spark, sf):
    return _lookup(Tables(spark, sf))[0]


@query("g2_lookup_hits", f"WITH {LOOK_SQL} SELECT event_id, source_system, matched_at_utc, pipeline_stage, pipeline_status FROM h")
def g2(spark, sf):
    return _lookup(Tables(spark, sf))[1].select("event_id", "source_system", "matched_at_utc", "pipeline_stage", "pipeline_status")


@query(
    "g3_timeline",
    f"""WITH {LOOK_SQL} SELECT strftime(detected_at_utc, '%Y-%m-%dT%H:%M:%SZ') AS ts, 'bookmark_violations' AS source,
          'BOOKMARK_VIOLATION  pattern=' || pattern_name || '  action=' || action_taken || '  host=' || hostname AS label FROM v
        UNION ALL SELECT strftime(matched_at_utc, '%Y-%m-%dT%H:%M:%SZ'), 'entity_hits', 'ENTITY_HIT  source=' || source_system || '  event_id=' || event_id || '  stage=' || pipeline_stage FROM h""",
)
def g3(spark, sf):
    return G.timeline(*_lookup(Tables(spark, sf))).select("ts", "source", "label")


@query("g5_lookup_counts", f"WITH {LOOK_SQL} SELECT (SELECT count(*) FROM v) AS violations, (SELECT count(*) FROM h) AS entity_hits")
def g5(spark, sf):
    return G.lookup_counts(*_lookup(Tables(spark, sf)))


_RUN_SQL = EVENTS_SQL + """, sel AS (SELECT user_id, time_bucket(INTERVAL 6 HOUR, ts) AS w, event_type, event_id FROM ev),
  hot AS (SELECT user_id, w, count(*) AS n FROM sel WHERE event_type = 'click' GROUP BY 1, 2 HAVING count(*) > 1),
  seen AS (SELECT user_id, w, count(*) AS matches FROM sel WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2),
  fnd AS (SELECT h.*, coalesce(matches, 0) AS matches, coalesce(c_nationkey < 5, false) AS is_privileged,
     sha256('clicks' || CAST(epoch_us(w) AS VARCHAR) || CAST(h.user_id AS VARCHAR)) AS finding_id FROM hot h LEFT JOIN seen USING (user_id, w) LEFT JOIN customer ON c_custkey = h.user_id),
  fresh AS (SELECT * FROM fnd WHERE user_id % 6 <> 0)"""


def _detection_run(spark, sf):
    t = Tables(spark, sf)
    ev = t.events.withColumns({"source_system": F.col("event_type"), "artefact_id": F.concat(F.lit("e"), F.col("event_id").cast("string"))})
    entities = t.customer.select(F.col("c_custkey").alias("user_id"), (F.col("c_nationkey") < 5).alias("is_privileged"), F.lit(False).alias("is_asset_critical"))
    args = ("clicks", F.col("event_type") == "click", "user_id", "ts", "6 hours", 1, entities, ["error", "purchase"])
    known, _ = D.detection_run(ev.where(F.col("user_id") % 6 == 0), *args)
    return D.detection_run(ev, *args, known=known)


@query(
    "f_detection_findings",
    f"""WITH {_RUN_SQL}, s AS (SELECT *, 55 + CASE WHEN matches = 0 THEN -10 ELSE 30 END + CASE WHEN is_privileged THEN 10 ELSE 0 END AS score FROM fresh)
      SELECT finding_id, user_id, n, matches, matches = 0 AS single_source, is_privileged, CAST(score AS INTEGER) AS confidence_score,
        CASE WHEN score <= 39 THEN 'weak' WHEN score <= 69 THEN 'mixed' WHEN score <= 89 THEN 'strong' ELSE 'multi_source' END AS confidence_band FROM s""",
)
def f_findings(spark, sf):
    """A rule over the events, corroborated, scored; findings of an earlier run left out."""
    return _detection_run(spark, sf)[0].select(
        "finding_id", "user_id", "n", "matches", "single_source", "is_privileged", "confidence_score", "confidence_band"
    )


@query("f_detection_links", f"WITH {_RUN_SQL} SELECT finding_id, 'e' || event_id AS artefact_id FROM fresh JOIN sel USING (user_id, w) WHERE event_type = 'click'")
def f_links(spark, sf):
    return _detection_run(spark, sf)[1]
