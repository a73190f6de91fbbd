"""E: documents as artefacts, conversations as custody chains, orders and lineitem as cases and items."""

from pyspark.sql import functions as F

from watchfold.constants import ZERO_HASH
from watchfold.operators import ledger as E
from watchfold.plans.registry import Tables, query


@query(
    "e1_fingerprint",
    "SELECT doc_id, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents",
)
def e1(spark, sf):
    return E.fingerprint(Tables(spark, sf).documents, "text").select("doc_id", "sha256", "bytes")


@query(
    "e2_manifest_digest",
    """SELECT d.doc_id, sha256('{"bytes":' || n_chars || ',"case_id":' || CAST(to_json(source) AS VARCHAR) || coalesce(',"ecs_doc_id":' || CAST(to_json('q' || quality) AS VARCHAR), '')
        || ',"manifest_version":1,"pii_tags":["PII:sender_email"],"query":' || CAST(to_json(text) AS VARCHAR) || '}') AS manifest_sha256 FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def e2(spark, sf):
    t = Tables(spark, sf)
    m = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.col("n_chars").alias("bytes"),
        F.col("source").alias("case_id"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("ecs_doc_id"),
        F.lit(1).alias("manifest_version"),
        F.array(F.lit("PII:sender_email")).alias("pii_tags"),
        F.col("text").alias("query"),
        F.lit("sig").alias("signature"),
        F.lit("key").alias("signing_key_id"),
        F.lit("ed25519").alias("signature_alg"),
    )
    fields = [c for c in m.columns if c != "doc_id"]
    return E.manifest_digest(m, fields).select("doc_id", "manifest_sha256")


_BREAKS = ["artefact_id:uuid", "collection_method:known", "query:length", "collected_at_utc:iso",
           "collected_at_utc:utc", "sha256:hex", "s3_uri:scheme", "manifest_version:current"]


def manifests(t):
    d, h = F.col("doc_id"), F.sha2("text", 256)

    def uuid(x):
        return F.concat_ws("-", *[F.substring(x, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])

    return t.documents.select(
        "doc_id",
        F.when(d % 10 == 1, F.substring(h, 1, 20)).otherwise(uuid(h)).alias("artefact_id"),
        uuid(F.sha2("source", 256)).alias("case_id"),
        F.lit("chat.moderation").alias("source_system"),
        F.when(d % 10 == 2, "scrape").otherwise("api").alias("collection_method"),
        F.when(d % 15 == 3, F.lit("")).when(F.length("text") > 16384, F.col("text")).otherwise(F.lit("q")).alias("query"),
        F.lit("svc").alias("collector_principal"),
        F.when(d % 10 == 4, "yesterday").when(d % 10 == 5, "2024-05-06T07:08:09+02:00").when(d % 2 == 0, "2024-05-06T07:08:09.123Z")
        .otherwise("2024-05-06T07:08:09+00:00").alias("collected_at_utc"),
        F.lit("UTC").alias("original_tz"),
        F.col("n_chars").alias("bytes"),
        F.when(d % 10 == 6, F.upper(h)).otherwise(h).alias("sha256"),
        F.lit("text/plain").alias("mime_type"),
        F.when(d % 21 == 7, "http://x").otherwise("s3://vault/x").alias("s3_uri"),
        F.lit("standard_7y").alias("retention_class"),
        F.lit("ed25519").alias("signature_alg"),
        F.lit("k1").alias("signing_key_id"),
        F.when(d % 10 == 8, 2).otherwise(1).alias("manifest_version"),
    )


@query(
    "e3_validate_manifests",
    f"""WITH b AS (SELECT doc_id, list_filter([CASE WHEN doc_id % 10 = 1 THEN '{_BREAKS[0]}' END, CASE WHEN doc_id % 10 = 2 THEN '{_BREAKS[1]}' END,
         CASE WHEN doc_id % 15 = 3 OR length(text) > 16384 THEN '{_BREAKS[2]}' END, CASE WHEN doc_id % 10 = 4 THEN '{_BREAKS[3]}' END, CASE WHEN doc_id % 10 = 5 THEN '{_BREAKS[4]}' END,
         CASE WHEN doc_id % 10 = 6 THEN '{_BREAKS[5]}' END, CASE WHEN doc_id % 21 = 7 THEN '{_BREAKS[6]}' END, CASE WHEN doc_id % 10 = 8 THEN '{_BREAKS[7]}' END],
         lambda x: x IS NOT NULL) AS broken FROM documents) SELECT doc_id, array_to_string(broken, '; ') AS broken, broken[1] AS first_broken FROM b""",
)
def e3(spark, sf):
    out = E.validate_manifests(manifests(Tables(spark, sf)))
    return out.select("doc_id", F.array_join("broken", "; ").alias("broken"), "first_broken")


# --- chains ----------------------------------------------------------------------------


def custody(t):
    conv = F.col("conv_id").cast("string")
    return t.conversations.select(
        F.concat(conv, F.lit(":"), F.col("turn").cast("string")).alias("event_id"),
        F.concat(F.lit("conv-"), conv).alias("artefact_id"),
        F.col("role").alias("event_type"),
        F.concat(F.col("role"), F.lit("@example.com")).alias("actor"),
        F.lit(None).cast("string").alias("actor_ip"),
        F.concat(F.lit("h"), (F.col("conv_id") % 5).cast("string")).alias("host"),
        F.col("text").alias("purpose"),
        F.concat(F.lit("2024-01-01T00:"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("event_time_utc"),
        "conv_id",
        "turn",
    )


CHAIN_SQL = f"""ev AS (SELECT conv_id, turn, conv_id || ':' || turn AS event_id, 'conv-' || conv_id AS artefact_id,
    '{{"actor":' || CAST(to_json(role || '@example.com') AS VARCHAR) || ',"actor_ip":null,"artefact_id":"conv-' || conv_id || '","event_id":"' || conv_id || ':' || turn
    || '","event_time_utc":"2024-01-01T00:' || lpad(CAST(turn AS VARCHAR), 6, '0') || '","event_type":' || CAST(to_json(role) AS VARCHAR) || ',"host":"h' || (conv_id % 5) || '","prev_event_hash":"' AS head,
    '","purpose":' || CAST(to_json(text) AS VARCHAR) || '}}' AS tail, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
  chain AS (SELECT e.*, '{ZERO_HASH}' AS prev, sha256(head || '{ZERO_HASH}' || tail) AS hash FROM ev e WHERE rn = 1
            UNION ALL SELECT e.*, c.hash, sha256(e.head || c.hash || e.tail) FROM chain c JOIN ev e ON e.conv_id = c.conv_id AND e.rn = c.rn + 1)"""


@query(
    "e5_build_chain",
    f"WITH RECURSIVE {CHAIN_SQL} SELECT artefact_id, event_id, prev AS prev_event_hash, hash AS this_event_hash FROM chain",
)
def e5(spark, sf):
    return E.build_chain(custody(Tables(spark, sf))).select("artefact_id", "event_id", "prev_event_hash", "this_event_hash")


@query("e5_continue_chain", f"WITH RECURSIVE {CHAIN_SQL} SELECT event_id, hash AS this_event_hash FROM chain WHERE turn >= 2")
def e5_more(spark, sf):
    """A second batch goes on from the tips of the first."""
    ev = custody(Tables(spark, sf))
    first = E.build_chain(ev.where(F.col("turn") < 2))
    tips = E.chain_tips(first, ev.select("artefact_id").distinct())
    return E.build_chain(ev.where(F.col("turn") >= 2), tips).select("event_id", "this_event_hash")


@query(
    "e4_chain_tips",
    f"""WITH RECURSIVE {CHAIN_SQL}, tips AS (SELECT artefact_id, hash FROM chain QUALIFY row_number() OVER (PARTITION BY artefact_id ORDER BY turn DESC) = 1),
        a AS (SELECT DISTINCT 'conv-' || conv_id AS artefact_id FROM conversations UNION SELECT 'conv-x' || n_nationkey FROM nation)
        SELECT artefact_id, coalesce(hash, '{ZERO_HASH}') AS tip FROM a LEFT JOIN tips USING (artefact_id)""",
)
def e4(spark, sf):
    t = Tables(spark, sf)
    ev = custody(t)
    none = t.nation.select(F.concat(F.lit("conv-x"), F.col("n_nationkey").cast("string")).alias("artefact_id"))
    return E.chain_tips(E.build_chain(ev), ev.select("artefact_id").distinct().unionByName(none))


def altered(t):
    """Chains with one text changed in every fifth and one link zeroed in every seventh conversation."""
    chain = E.build_chain(custody(t))
    flip = (F.col("conv_id") % 5 == 0) & (F.col("turn") == 1)
    cut = (F.col("conv_id") % 7 == 0) & (F.col("turn") == 2)
    return chain.withColumns(
        {
            "purpose": F.when(flip, F.concat("purpose", F.lit("!"))).otherwise(F.col("purpose")),
            "prev_event_hash": F.when(cut, ZERO_HASH).otherwise(F.col("prev_event_hash")),
        }
    )


REPLAY_SQL = CHAIN_SQL + f""", alt AS (SELECT artefact_id, event_id, turn, CASE WHEN conv_id % 7 = 0 AND turn = 2 THEN '{ZERO_HASH}' ELSE prev END AS prev, hash,
     sha256(head || CASE WHEN conv_id % 7 = 0 AND turn = 2 THEN '{ZERO_HASH}' ELSE prev END || CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN tail[:-3] || '!"}}' ELSE tail END) AS again,
     coalesce(lag(hash) OVER (PARTITION BY artefact_id ORDER BY turn), '{ZERO_HASH}') AS before FROM chain),
  kinds AS (SELECT *, CASE WHEN prev <> before THEN 'link' WHEN again <> hash THEN 'hash' END AS kind FROM alt),
  replay AS (SELECT artefact_id, count(*) AS events, count(kind) = 0 AS ok, min_by(event_id, turn) FILTER (kind IS NOT NULL) AS first_break,
     min_by(kind, turn) FILTER (kind IS NOT NULL) AS break_kind FROM kinds GROUP BY artefact_id)"""


@query("e6_replay_chain", f"WITH RECURSIVE {REPLAY_SQL} SELECT * FROM replay")
def e6(spark, sf):
    return E.replay_chain(altered(Tables(spark, sf)))


@query(
    "e6_signature_break",
    f"""WITH RECURSIVE {REPLAY_SQL} SELECT event_id, CASE WHEN kind IS NULL AND substr(sha256(event_id), 1, 1) = '0' THEN 'signature' ELSE kind END AS break_kind FROM kinds""",
)
def e6_signed(spark, sf):
    good = F.substring(F.sha2("event_id", 256), 1, 1) != "0"
    return E.check_chain(altered(Tables(spark, sf)).withColumn("signature_ok", good), signed="signature_ok").select("event_id", "break_kind")


@query("e6_check_chain", f"WITH RECURSIVE {REPLAY_SQL} SELECT event_id, kind AS break_kind FROM kinds")
def e6_events(spark, sf):
    return E.check_chain(altered(Tables(spark, sf))).select("event_id", "break_kind")


# --- verification ------------------------------------------------------------------------

VERIFY_SQL = REPLAY_SQL + """, docs AS (SELECT doc_id, text, CASE WHEN doc_id % 50 = 0 THEN text || '!' WHEN doc_id % 50 = 1 THEN NULL ELSE text END AS stored FROM documents),
  v AS (SELECT d.doc_id, d.doc_id % 50 <> 2 AS known, stored IS NOT NULL AS present, sha256(text) = sha256(stored) AS rehash,
     d.doc_id % 50 NOT IN (3, 6) AS signed, CASE d.doc_id % 50 WHEN 6 THEN true WHEN 4 THEN false ELSE sha256(text) = sha256(stored) END AS agrees,
     coalesce(r.ok, true) AS chained FROM docs d LEFT JOIN replay r ON r.artefact_id = 'conv-' || d.doc_id)"""


@query(
    "e7_verify_evidence",
    f"""WITH RECURSIVE {VERIFY_SQL} SELECT 'conv-' || doc_id AS artefact_id,
        CASE WHEN NOT known THEN 'lookup_evidence_items=false' WHEN NOT present THEN 'lookup_evidence_items=true get_artefact=false'
          ELSE 'lookup_evidence_items=true rehash_artefact=' || rehash || ' verify_manifest_signature=' || signed || ' manifest_vs_rehash=' || agrees || ' replay_custody_chain=' || chained END AS steps,
        CASE WHEN NOT known THEN 'item:missing' WHEN NOT present THEN 'blob:missing' WHEN NOT agrees THEN 'manifest:differs'
          WHEN NOT signed THEN 'manifest:unsigned' WHEN NOT rehash THEN 'blob:differs' WHEN NOT chained THEN 'chain:broken' END AS error,
        error IS NULL AS ok FROM v""",
)
def e7(spark, sf):
    t = Tables(spark, sf)
    kind = F.col("doc_id") % 50
    docs = t.documents.select("doc_id", F.concat(F.lit("conv-"), F.col("doc_id").cast("string")).alias("artefact_id"), "text")
    items = E.fingerprint(docs.where(kind != 2), "text")
    blobs = docs.where(kind != 1).select(
        "artefact_id", F.when(kind == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content")
    )
    said = F.when(kind == 4, F.sha2(F.concat("text", F.lit("?")), 256)).otherwise(F.sha2("text", 256))
    mans = docs.where(kind != 6).select("artefact_id", said.alias("sha256"), (kind != 3).alias("signature_ok"))
    out = E.verify_evidence(docs.select("artefact_id"), items, blobs, mans, E.replay_chain(altered(t)))
    text = F.transform("steps", lambda s: F.concat(s["step"], F.lit("="), s["ok"].cast("string")))
    return out.select("artefact_id", F.array_join(text, " ").alias("steps"), "error", "ok")


@query(
    "e16_tampered",
    "SELECT doc_id, sha256(text) AS sha256, sha256(text || '!') AS actual_sha256 FROM documents WHERE doc_id % 50 = 0",
)
def e16(spark, sf):
    docs = Tables(spark, sf).documents.select(F.col("doc_id").alias("artefact_id"), "text")
    blobs = docs.select("artefact_id", F.when(F.col("artefact_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    out = E.tampered(E.fingerprint(docs, "text").drop("text"), blobs)
    return out.select(F.col("artefact_id").alias("doc_id"), "sha256", "actual_sha256")


_CLASSES = ["demo_24h", "demo_7d", "demo_90d", "standard_7y", "legal_hold", "moderation_evidence"]
_RET_SQL = f"""r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, {_CLASSES!r}[l_linenumber % 6 + 1] AS retention_class FROM lineitem),
  k AS (SELECT *, CASE retention_class WHEN 'demo_24h' THEN 1 WHEN 'demo_7d' THEN 7 WHEN 'demo_90d' THEN 90 WHEN 'standard_7y' THEN 2555 WHEN 'legal_hold' THEN 2555 END AS days FROM r)"""


def _retained(t):
    cls = F.element_at(F.array(*[F.lit(c) for c in _CLASSES]), F.col("l_linenumber") % 6 + 1)
    items = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", cls.alias("retention_class"))
    return E.retention(items, "l_shipdate", F.lit("2001-01-01").cast("timestamp_ntz"))


@query(
    "e8_retention",
    f"""WITH {_RET_SQL} SELECT l_orderkey, l_partkey, l_suppkey, retention_class, strftime(l_shipdate + to_days(days), '%Y-%m-%d') AS retain_until,
        l_shipdate + to_days(days) < TIMESTAMP '2001-01-01' AS expired FROM k WHERE days IS NOT NULL""",
)
def e8(spark, sf):
    kept, _ = _retained(Tables(spark, sf))
    return kept.select("l_orderkey", "l_partkey", "l_suppkey", "retention_class", F.date_format("retain_until", "yyyy-MM-dd").alias("retain_until"), "expired")


@query("e8_unknown_class", f"WITH {_RET_SQL} SELECT l_orderkey, l_partkey, l_suppkey, retention_class FROM k WHERE days IS NULL")
def e8_bad(spark, sf):
    return _retained(Tables(spark, sf))[1].drop("l_shipdate")


def items_of(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("case_id"),
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("artefact_id"),
        "l_quantity",
        "l_shipmode" if "l_shipmode" in t.lineitem.columns else "l_returnflag",
    )


_ITEMS_SQL = """items AS (SELECT l_orderkey AS case_id, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS artefact_id, l_quantity, l_returnflag FROM lineitem)"""


@query(
    "e9_require_case",
    f"""WITH {_ITEMS_SQL}, c AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
        SELECT case_id, artefact_id, EXISTS (SELECT 1 FROM c WHERE o_orderkey = case_id) AS known FROM items""",
)
def e9(spark, sf):
    t = Tables(spark, sf)
    cases = t.orders.where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("case_id"))
    ok, bad = E.require_case(items_of(t), cases)
    both = ok.withColumn("known", F.lit(True)).unionByName(bad.withColumn("known", F.lit(False)))
    return both.select("case_id", "artefact_id", "known")


@query(
    "e10_audit_rows",
    """SELECT o_orderkey, a.details, a.outcome, sha256(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '|svc|verify_evidence|order-' || o_orderkey || '|' || a.outcome || '|' || a.details) AS audit_id
       FROM (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'fail' END AS outcome, '{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS details FROM orders) a""",
)
def e10(spark, sf):
    orders = Tables(spark, sf).orders
    out = E.audit_rows(
        orders,
        F.lit("svc"),
        "verify_evidence",
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")),
        F.col("o_orderstatus") == "F",
        {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")},
        F.col("o_orderdate"),
    )
    return out.select(F.element_at(F.split("target", "-"), -1).cast("bigint").alias("o_orderkey"), "details", "outcome", "audit_id")


@query(
    "e11_check_constraints",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, unnest(list_filter([CASE WHEN l_quantity > 45 THEN 'quantity in range' END,
       CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'flag is known' END, CASE WHEN l_discount >= 0.09 THEN 'discount in range' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem""",
)
def e11(spark, sf):
    return E.check_constraints(
        Tables(spark, sf).lineitem,
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
        {
            "quantity in range": F.col("l_quantity").between(1, 45),
            "flag is known": F.col("l_returnflag").isin("A", "N"),
            "discount in range": F.col("l_discount") < 0.09,
        },
    )


@query("e11_unique_but_null", "SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' AND l_linenumber < 6 GROUP BY ALL HAVING count(*) > 1")
def e11_null(spark, sf):
    li = Tables(spark, sf).lineitem.withColumn("l_returnflag", F.nullif(F.col("l_returnflag"), F.lit("N")))
    return E.check_unique(li.withColumn("l_orderkey", F.when(F.col("l_linenumber") < 6, F.col("l_orderkey"))), ["l_orderkey", "l_returnflag"])


@query("e11_check_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def e11_unique(spark, sf):
    return E.check_unique(Tables(spark, sf).lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "e11_check_reference",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)",
)
def e11_reference(spark, sf):
    t = Tables(spark, sf)
    return E.check_reference(t.orders, "o_custkey", t.customer.where(F.col("c_acctbal") > 0), "c_custkey").select("o_orderkey", "o_custkey")


_CASE = "(SELECT l_orderkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def _busiest(t):
    """The case with most items, as a scalar."""
    n = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.max_by("l_orderkey", F.struct("n", -F.col("l_orderkey")))).scalar()


@query("e12_case_evidence_list", f"WITH {_ITEMS_SQL} SELECT * FROM items WHERE case_id = {_CASE}")
def e12(spark, sf):
    t = Tables(spark, sf)
    return E.case_evidence_list(items_of(t), _busiest(t))


@query("e13_custody_list", f"WITH RECURSIVE {CHAIN_SQL} SELECT artefact_id, event_id, hash AS this_event_hash FROM chain WHERE conv_id = 0")
def e13(spark, sf):
    chain = E.build_chain(custody(Tables(spark, sf)))
    return E.custody_list(chain, "conv-0").select("artefact_id", "event_id", "this_event_hash")


@query(
    "e14_case_violations",
    f"""WITH {_ITEMS_SQL}, v AS (SELECT p_partkey, s_suppkey, p_partkey % 7 AS kind FROM part JOIN supplier ON s_suppkey = p_partkey % 10)
        SELECT p_partkey, kind FROM v WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = {_CASE})""",
)
def e14(spark, sf):
    t = Tables(spark, sf)
    viol = t.part.select("p_partkey", (F.col("p_partkey") % 7).alias("kind"))
    items = t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("artefact_id"))
    return E.of_case(viol, "p_partkey", items, _busiest(t))


@query(
    "e15_case_audit",
    f"SELECT s_suppkey AS target, s_name AS actor FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey = {_CASE})",
)
def e15(spark, sf):
    t = Tables(spark, sf)
    audit = t.supplier.select(F.col("s_suppkey").alias("target"), F.col("s_name").alias("actor"))
    items = t.lineitem.select(F.col("l_orderkey").alias("case_id"), F.col("l_suppkey").alias("artefact_id"))
    return E.of_case(audit, "target", items, _busiest(t))


# --- recording ---------------------------------------------------------------------------

_AT = "2024-05-06T07:08:09Z"


def uuid_sql(h):
    return f"{h}[1:8] || '-' || {h}[9:12] || '-' || {h}[13:16] || '-' || {h}[17:20] || '-' || {h}[21:32]"


def recorded(t):
    """Every document as a request; one language in four has no case, and some requests have faults."""
    d = F.col("doc_id")
    requests = t.documents.select(
        d.cast("string").alias("request_id"),
        F.concat(F.lit("case-"), F.coalesce("lang", F.lit("none"))).alias("__c"),
        F.lit("doc.store").alias("source_system"),
        F.when(d % 10 == 2, "scrape").otherwise("api").alias("collection_method"),
        F.concat(F.lit("doc "), d.cast("string")).alias("query"),
        F.lit("svc").alias("collector_principal"),
        F.when(d % 10 == 4, "yesterday").otherwise(_AT).alias("collected_at_utc"),
        F.lit("UTC").alias("original_tz"),
        F.col("text").alias("content"),
        F.lit("text/plain").alias("mime_type"),
        F.when(d % 7 == 1, "forever").otherwise("standard_7y").alias("retention_class"),
        F.array(F.lit("PII:body")).alias("pii_tags"),
        F.lit("h1").alias("host"),
    )
    requests = requests.withColumn("case_id", E.uuid_form(F.sha2("__c", 256))).drop("__c")
    cases = t.documents.where(F.col("lang") != "de").select(E.uuid_form(F.sha2(F.concat(F.lit("case-"), "lang"), 256)).alias("case_id"))
    return E.record_evidence(requests, cases, "s3://vault", "k1")


RECORD_SQL = f"""req AS (SELECT *, sha256('case-' || coalesce(lang, 'none')) AS ch, {uuid_sql("ch")} AS case_id, sha256('artefact:' || case_id || ':' || doc_id) AS ah, {uuid_sql("ah")} AS artefact_id,
     CASE WHEN doc_id % 10 = 2 THEN 'scrape' ELSE 'api' END AS method, coalesce(text, '') AS body,
     CASE WHEN lang = 'de' OR lang IS NULL THEN 'case' WHEN doc_id % 7 = 1 THEN 'retention' WHEN doc_id % 10 IN (2, 4) THEN 'manifest' END AS stage,
     CASE stage WHEN 'case' THEN 'case_id:known' WHEN 'retention' THEN 'retention_class:known' WHEN 'manifest' THEN CASE WHEN doc_id % 10 = 2 THEN 'collection_method:known' ELSE 'collected_at_utc:iso' END END AS reason FROM documents),
  rec AS (SELECT artefact_id, case_id, octet_length(encode(body)) AS bytes, sha256(body) AS sha, sha256('collected:' || artefact_id) AS eh, {uuid_sql("eh")} AS event_id,
     sha256('{{"artefact_id":"' || artefact_id || '","bytes":' || bytes || ',"case_id":"' || case_id || '","collected_at_utc":"{_AT}","collection_method":"api","collector_principal":"svc","manifest_version":1,"mime_type":"text/plain","original_tz":"UTC","pii_tags":["PII:body"],"query":"doc ' || doc_id
       || '","retention_class":"standard_7y","s3_uri":"s3://vault/artefacts/' || case_id || '/' || artefact_id || '","sha256":"' || sha || '","source_system":"doc.store"}}') AS manifest_sha256,
     sha256('{{"actor":"svc","actor_ip":null,"artefact_id":"' || artefact_id || '","event_id":"' || event_id || '","event_time_utc":"{_AT}","event_type":"collected","host":"h1","prev_event_hash":"{ZERO_HASH}","purpose":"collected by api from doc.store"}}') AS this_event_hash
     FROM req WHERE stage IS NULL)"""


@query(
    "e_record_evidence",
    f"""WITH {RECORD_SQL} SELECT artefact_id, case_id, bytes, manifest_sha256, event_id, this_event_hash,
        '{{"case_id":"' || case_id || '","source_system":"doc.store","bytes":' || bytes || ',"sha256":"' || sha || '"}}' AS details FROM rec""",
)
def e_record(spark, sf):
    """Item, first custody event and audit row of every recorded artefact, side by side."""
    r = recorded(Tables(spark, sf))
    audit = r.audit.select(F.col("target").alias("artefact_id"), "details")
    events = r.events.select("artefact_id", "event_id", "this_event_hash")
    items = r.items.select("artefact_id", "case_id", "bytes", "manifest_sha256")
    return items.join(events, "artefact_id").join(audit, "artefact_id")


@query("e_record_rejected", f"WITH {RECORD_SQL} SELECT CAST(doc_id AS VARCHAR) AS request_id, case_id, stage, reason FROM req WHERE stage IS NOT NULL")
def e_record_rejected(spark, sf):
    return recorded(Tables(spark, sf)).rejected


@query(
    "e7_record_access",
    f"""WITH {RECORD_SQL}, ev AS (SELECT *, sha256('accessed:' || artefact_id || ':' || artefact_id) AS vh, {uuid_sql("vh")} AS access_id FROM rec)
        SELECT artefact_id, this_event_hash AS prev_event_hash, sha256('{{"actor":"reader","actor_ip":null,"artefact_id":"' || artefact_id || '","event_id":"' || access_id
          || '","event_time_utc":"2024-06-01T00:00:00Z","event_type":"accessed","host":null,"prev_event_hash":"' || this_event_hash || '","purpose":"audit"}}') AS this_event_hash,
          'ok' AS outcome, '{{"steps":5}}' AS details FROM ev""",
)
def e7_access(spark, sf):
    """Every recorded artefact is verified and read once; the access follows its first event."""
    t = Tables(spark, sf)
    r = recorded(t)
    body = t.documents.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.coalesce("text", F.lit("")).alias("content")).dropDuplicates(["sha256"])
    blobs = r.items.select("artefact_id", "sha256").join(body, "sha256").select("artefact_id", "content")
    asked = r.items.select(
        "artefact_id", F.col("artefact_id").alias("request_id"), F.lit("reader").alias("accessor"), F.lit("audit").alias("purpose"),
        F.lit("2024-06-01T00:00:00Z").alias("accessed_at_utc"),
    )
    signed = r.items.select("artefact_id", "sha256", F.lit(True).alias("signature_ok"))
    report = E.verify_evidence(asked, r.items, blobs, signed, E.replay_chain(r.events))
    events, audit = E.record_access(report, E.chain_tips(r.events, r.items))
    told = audit.select(F.col("target").alias("artefact_id"), "outcome", "details")
    return events.select("artefact_id", "prev_event_hash", "this_event_hash").join(told, "artefact_id")
