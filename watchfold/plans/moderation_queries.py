"""D: moderation with documents as messages, labels as the second stage, lineitem as image frames."""

from pyspark.sql import functions as F

from watchfold.constants import TOMBSTONE
from watchfold.functions import levels as L
from watchfold.operators import moderation as M
from watchfold.operators.moderation import Term
from watchfold.plans.registry import Tables, query

TERMS = [
    Term("hard", "haha", "word"),
    Term("hard", "of at", "phrase"),
    Term("soft", "ndon", "word"),
    Term("soft", "estion", "word"),
    Term("soft", "ingor", "word"),
    Term("soft", "os", "word"),
    Term("soft", "with and", "phrase"),
    Term("soft", "was and", "phrase"),
]
KEY = b"review-secret"


def messages(t):
    doc = F.col("doc_id").cast("string")
    return t.documents.select(
        "doc_id",
        F.concat(F.lit("spaces/"), F.col("source"), F.lit("/messages/"), doc).alias("message_name"),
        F.concat(F.lit("spaces/"), F.col("source")).alias("space_name"),
        F.concat(F.lit("user"), (F.col("doc_id") % 97).cast("string"), F.lit("@example.com")).alias("sender_email"),
        "text",
        F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("received_at"),
    )


MSG_SQL = """msg AS (SELECT doc_id, 'spaces/' || source || '/messages/' || doc_id AS message_name, 'spaces/' || source AS space_name,
    'user' || (doc_id % 97) || '@example.com' AS sender_email, text, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS received_at FROM documents)"""


def _words_sql(words):
    quoted = ", ".join(f"'{w}'" for w in words)
    return (
        f"list_filter([{quoted}]::VARCHAR[], lambda w: regexp_matches(lower(text), "
        "'(^|[^\\p{L}\\p{N}_])' || w || '($|[^\\p{L}\\p{N}_])'))"
    )


def _phrases_sql(phrases):
    quoted = ", ".join(f"'{p}'" for p in phrases)
    return f"list_filter([{quoted}]::VARCHAR[], lambda p: contains(lower(text), p))"


def _tier(tier, kind):
    return [x.term for x in TERMS if x.tier == tier and x.kind == kind]


SCAN_SQL = MSG_SQL + f""", scan AS (SELECT *,
    list_concat({_words_sql(_tier('hard', 'word'))}, {_phrases_sql(_tier('hard', 'phrase'))}) AS hard_terms,
    list_concat({_words_sql(_tier('soft', 'word'))}, {_phrases_sql(_tier('soft', 'phrase'))}) AS soft_terms FROM msg)"""


def scanned(t):
    return M.keyword_scan(messages(t), "text", TERMS, "message_name")


@query(
    "d3_scan_words",
    f"WITH {MSG_SQL} SELECT doc_id, array_to_string({_words_sql(_tier('soft', 'word'))}, ',') AS terms FROM msg",
)
def d3(spark, sf):
    found = M.scan_words(F.col("low"), _tier("soft", "word"))
    docs = Tables(spark, sf).documents.select("doc_id", F.lower("text").alias("low"))
    return docs.select("doc_id", F.array_join(found, ",").alias("terms"))


@query(
    "d4_scan_phrases",
    f"WITH {MSG_SQL} SELECT doc_id, array_to_string({_phrases_sql(_tier('soft', 'phrase'))}, ',') AS terms FROM msg",
)
def d4(spark, sf):
    found = M.scan_phrases(F.col("low"), _tier("soft", "phrase"))
    docs = Tables(spark, sf).documents.select("doc_id", F.lower("text").alias("low"))
    return docs.select("doc_id", F.array_join(found, ",").alias("terms"))


_SCAN_OUT = """SELECT doc_id, array_to_string(hard_terms, ',') AS hard_terms, array_to_string(soft_terms, ',') AS soft_terms,
    array_to_string(list_concat(hard_terms, soft_terms), ',') AS all_terms FROM scan"""


def _joined_terms(df):
    return df.select("doc_id", *[F.array_join(c, ",").alias(c) for c in ("hard_terms", "soft_terms", "all_terms")])


@query("d5_keyword_scan", f"WITH {SCAN_SQL} {_SCAN_OUT}")
def d5(spark, sf):
    return _joined_terms(scanned(Tables(spark, sf)))


def term_table(spark):
    rows = [(t.tier, i, t.term, t.kind) for i, t in enumerate(TERMS)]
    return spark.createDataFrame(rows, "tier STRING, ord BIGINT, term STRING, kind STRING")


@query("d5_keyword_scan_large_list", f"WITH {SCAN_SQL} {_SCAN_OUT}")
def d5_join(spark, sf):
    """The same scan by the plan that serves term tables of any length."""
    msgs = messages(Tables(spark, sf))
    return _joined_terms(M.keyword_scan(msgs, "text", term_table(spark), "message_name"))


RAW_SQL = """raw AS (SELECT doc_id, CASE WHEN doc_id % 9 = 3 THEN 'no json at all ' || doc_id WHEN doc_id % 9 = 4 THEN '{"verdict": "MAYBE"}'
    WHEN doc_id % 9 = 5 THEN '{"verdict": "true_positive"}' WHEN doc_id % 9 = 6 THEN '{"verdict": "FALSE_POSITIVE"} {"x": ' || doc_id || '}'
    WHEN doc_id % 9 = 7 THEN '{"verdict": "FALSE_POSITIVE"}}' WHEN doc_id % 9 = 8 THEN '{"verdict": "FALSE_POSITIVE"}, {}'
    ELSE '{"verdict": "' || CASE WHEN toxic = 1 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END || '", "rationale": "why ' || doc_id || '"}' END AS raw FROM labels),
  parsed AS (SELECT doc_id, raw, CASE WHEN doc_id % 9 IN (3, 4, 6, 7, 8) THEN 'TRUE_POSITIVE' ELSE upper(json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.verdict')) END AS verdict,
    CASE WHEN doc_id % 9 IN (3, 4, 6, 7, 8) THEN 'unreadable answer: ' || raw[1:100]
         ELSE coalesce(json_extract_string(CASE WHEN json_valid(raw) THEN raw END, '$.rationale'), '') END AS rationale FROM raw)"""


def raw_verdicts(t):
    doc, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 9
    word = F.when(F.col("toxic") == 1, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE")
    raw = (
        F.when(kind == 3, F.concat(F.lit("no json at all "), doc))
        .when(kind == 4, '{"verdict": "MAYBE"}')
        .when(kind == 5, '{"verdict": "true_positive"}')
        .when(kind == 6, F.concat(F.lit('{"verdict": "FALSE_POSITIVE"} {"x": '), doc, F.lit("}")))
        .when(kind == 7, '{"verdict": "FALSE_POSITIVE"}}')
        .when(kind == 8, '{"verdict": "FALSE_POSITIVE"}, {}')
        .otherwise(F.concat(F.lit('{"verdict": "'), word, F.lit('", "rationale": "why '), doc, F.lit('"}')))
    )
    return t.labels.select("doc_id", raw.alias("raw"))


@query("d6_parse_verdict", f"WITH {RAW_SQL} SELECT doc_id, verdict, rationale FROM parsed")
def d6(spark, sf):
    return M.parse_verdict(raw_verdicts(Tables(spark, sf)), "raw").drop("raw")


TEXT_SQL = SCAN_SQL + ", " + RAW_SQL + """, texts AS (SELECT s.*,
    CASE WHEN trim(text, E' \\t\\n\\r') = '' OR (len(hard_terms) = 0 AND len(soft_terms) = 0) THEN 'pass' WHEN len(hard_terms) > 0 THEN 'true_positive'
         WHEN verdict = 'TRUE_POSITIVE' THEN 'true_positive' WHEN verdict IS NOT NULL THEN 'false_positive' ELSE 'flagged_fallback' END AS text_result,
    CASE WHEN len(hard_terms) > 0 THEN list_concat(hard_terms, soft_terms) ELSE soft_terms END AS matched_terms,
    CASE WHEN len(hard_terms) = 0 AND len(soft_terms) > 0 THEN rationale END AS rationale
  FROM scan s LEFT JOIN parsed USING (doc_id))"""


def texts(t):
    verdicts = M.parse_verdict(raw_verdicts(t), "raw")
    return M.text_verdict(scanned(t), "text", verdicts.union(verdicts), "doc_id")  # each delivered twice


@query(
    "d7_text_verdict",
    f"WITH {TEXT_SQL} SELECT doc_id, text_result, array_to_string(matched_terms, ',') AS matched_terms, rationale FROM texts",
)
def d7(spark, sf):
    out = texts(Tables(spark, sf))
    return out.select("doc_id", "text_result", F.array_join("matched_terms", ",").alias("matched_terms"), "rationale")


@query(
    "d8_text_action",
    f"WITH {TEXT_SQL} SELECT doc_id, CASE WHEN text_result IN ('true_positive', 'flagged_fallback') THEN 'block' ELSE 'pass' END AS action FROM texts",
)
def d8(spark, sf):
    return texts(Tables(spark, sf)).select("doc_id", L.text_action("text_result").alias("action"))


# --- pushed messages -----------------------------------------------------------------

PUSH_SQL = """SELECT conv_id, turn,
  CASE WHEN role = 'system' THEN 'google.workspace.chat.message.v1.deleted' ELSE 'google.workspace.chat.message.v1.created' END AS kind,
  'spaces/' || conv_id || '/messages/' || turn AS message_name, 'spaces/' || conv_id AS space_name,
  CASE WHEN turn % 3 = 0 THEN 'u' || (conv_id % 40) || '@example.com' ELSE 'users/' || (conv_id % 40) END AS sender, text FROM conversations"""


def pushed(t):
    conv = t.conversations
    name = F.concat(F.lit("spaces/"), F.col("conv_id").cast("string"), F.lit("/messages/"), F.col("turn").cast("string"))
    user = (F.col("conv_id") % 40).cast("string")
    email = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("u"), user, F.lit("@example.com")))
    attachment = F.transform(
        F.sequence(F.lit(0), (F.col("turn") % 4).cast("int")),
        lambda i: F.struct(
            F.concat(F.lit("file"), i.cast("string")).alias("name"),
            F.element_at(F.array(*[F.lit(m) for m in ("image/png", "application/pdf", "image/gif", "image/bmp")]), i + 1).alias("contentType"),
            F.struct(F.when(i != 3, F.lit("blob")).otherwise(F.lit("")).alias("resourceName")).alias("attachmentDataRef"),
        ),
    )
    message = F.struct(
        name.alias("name"),
        F.lit("2024-02-03T04:05:06Z").alias("createTime"),
        F.struct(F.concat(F.lit("users/"), user).alias("name"), email.alias("email")).alias("sender"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.lit("")).alias("text"),
        F.col("text").alias("argumentText"),
        attachment.alias("attachment"),
    )
    body = F.to_json(F.struct(message.alias("message")))
    # cut short, or a good body with more text behind it
    cut = F.when(F.col("conv_id") % 2 == 0, F.substring(body, F.lit(1), F.length(body) - 7)).otherwise(F.concat(body, F.lit(' {"x": 1}')))
    broken = F.when(F.col("turn") % 5 == 4, cut).otherwise(body)
    kind = F.when(F.col("role") == "system", "google.workspace.chat.message.v1.deleted").otherwise(
        "google.workspace.chat.message.v1.created"
    )
    return conv.select("conv_id", "turn", kind.alias("kind"), broken.alias("body"))


def decoded(t):
    return M.decode_messages(pushed(t), "kind", "body", F.lit("2024-01-01T00:00:00Z").cast("timestamp"))


@query(
    "d1_decode_messages",
    f"""WITH p AS ({PUSH_SQL}) SELECT message_name, space_name, sender, text, 1706933106::BIGINT AS received FROM p
        WHERE kind LIKE '%created' AND turn % 5 <> 4""",
)
def d1(spark, sf):
    good, _ = decoded(Tables(spark, sf))
    return good.select("message_name", "space_name", "sender", "text", F.unix_seconds("received_at_utc").alias("received"))


@query("d1_undecodable", f"WITH p AS ({PUSH_SQL}) SELECT conv_id, turn FROM p WHERE kind LIKE '%created' AND turn % 5 = 4")
def d1_bad(spark, sf):
    _, bad = decoded(Tables(spark, sf))
    return bad.select("conv_id", "turn")


@query(
    "d2_resolve_sender",
    f"""WITH p AS ({PUSH_SQL}), d AS (SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name || '@' || c_mktsegment AS email FROM customer WHERE c_custkey < 30)
        SELECT message_name, CASE WHEN contains(sender, '@') THEN sender ELSE coalesce(email, sender) END AS sender_email
        FROM p LEFT JOIN d ON NOT contains(sender, '@') AND string_split(sender, '/')[-1] = user_id WHERE kind LIKE '%created' AND turn % 5 <> 4""",
)
def d2(spark, sf):
    t = Tables(spark, sf)
    directory = t.customer.where(F.col("c_custkey") < 30).select(
        F.col("c_custkey").cast("string").alias("user_id"), F.concat_ws("@", "c_name", "c_mktsegment").alias("email")
    )
    return M.resolve_sender(decoded(t)[0], directory.union(directory)).select("message_name", "sender_email")


@query(
    "d9_image_attachments",
    f"""WITH p AS ({PUSH_SQL}), a AS (SELECT message_name, unnest(range(0, turn % 4 + 1)) AS i FROM p WHERE kind LIKE '%created' AND turn % 5 <> 4),
        f AS (SELECT message_name, i, ['image/png', 'application/pdf', 'image/gif', 'image/bmp'][i + 1] AS mime_type FROM a WHERE i NOT IN (1, 3))
        SELECT message_name, CAST(row_number() OVER (PARTITION BY message_name ORDER BY i) - 1 AS INTEGER) AS image_idx, 'file' || i AS filename,
          mime_type, CASE WHEN contains(mime_type, 'gif') THEN 'gif' WHEN contains(mime_type, 'bmp') THEN 'bmp' ELSE 'jpeg' END AS image_format,
          'blob' AS resource_name FROM f""",
)
def d9(spark, sf):
    return M.image_attachments(decoded(Tables(spark, sf))[0])


# --- frames ------------------------------------------------------------------------

_ORDER = ["frame_idx", "l_partkey", "l_suppkey", "l_extendedprice"]


def frames(t):
    q = F.col("l_quantity")
    name = (
        F.when(q <= 10, "VERY_UNLIKELY").when(q <= 20, "UNLIKELY").when(q <= 28, "POSSIBLE").when(q <= 33, "OTHER")
        .when(q <= 36, "LIKELY").when(q <= 38, "VERY_LIKELY")
    )
    return t.lineitem.select(
        F.col("l_orderkey").alias("attachment_id"),
        (F.col("l_linenumber") - 1).alias("frame_idx"),
        F.when(F.col("l_partkey") % 40 == 11, 0).when(F.col("l_partkey") % 40 != 7, 25 + 25 * (F.col("l_partkey") % 4)).cast("int").alias("duration_ms"),
        name.alias("likelihood"),
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


FRAMES_SQL = """frames AS (SELECT l_orderkey AS attachment_id, l_linenumber - 1 AS frame_idx, CAST(CASE WHEN l_partkey % 40 = 11 THEN 0 WHEN l_partkey % 40 <> 7 THEN 25 + 25 * (l_partkey % 4) END AS INTEGER) AS duration_ms,
    CASE WHEN l_quantity <= 10 THEN 'VERY_UNLIKELY' WHEN l_quantity <= 20 THEN 'UNLIKELY' WHEN l_quantity <= 28 THEN 'POSSIBLE' WHEN l_quantity <= 33 THEN 'OTHER'
      WHEN l_quantity <= 36 THEN 'LIKELY' WHEN l_quantity <= 38 THEN 'VERY_LIKELY' END AS likelihood, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
  scored AS (SELECT *, CASE likelihood WHEN 'VERY_UNLIKELY' THEN 10 WHEN 'UNLIKELY' THEN 30 WHEN 'POSSIBLE' THEN 60 WHEN 'LIKELY' THEN 80 WHEN 'VERY_LIKELY' THEN 95
      WHEN 'OTHER' THEN 55 END AS score FROM frames),
  sampled AS (SELECT *, CAST(row_number() OVER (PARTITION BY attachment_id ORDER BY frame_idx, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS sample_no
      FROM scored WHERE coalesce(duration_ms, 100) <> 0 AND frame_idx % greatest(1, CAST(floor(1000 / (10.0 * coalesce(nullif(duration_ms, 0), 100))) AS INTEGER)) = 0 QUALIFY sample_no <= 3),
  worst AS (SELECT attachment_id, score AS image_score, CAST(count(*) OVER (PARTITION BY attachment_id) AS INTEGER) AS frames_scored FROM sampled
      QUALIFY row_number() OVER (PARTITION BY attachment_id ORDER BY coalesce(score, 0) DESC, frame_idx, l_partkey, l_suppkey, l_extendedprice) = 1),
  verdicts AS (SELECT *, CASE WHEN image_score <= 50 THEN 'pass' WHEN image_score <= 70 THEN 'review' WHEN image_score IS NULL THEN 'review' ELSE 'block' END AS image_action FROM worst)"""


@query(
    "d10_score_likelihood",
    f"""WITH {FRAMES_SQL} SELECT attachment_id, frame_idx, l_partkey, l_suppkey, coalesce(score, 55) AS score,
        CASE WHEN coalesce(score, 55) <= 50 THEN 'pass' WHEN coalesce(score, 55) <= 70 THEN 'review' ELSE 'block' END AS action FROM scored""",
)
def d10(spark, sf):
    score = L.score_likelihood("likelihood")
    return frames(Tables(spark, sf)).select(
        "attachment_id", "frame_idx", "l_partkey", "l_suppkey", score.alias("score"), L.score_action(score).alias("action")
    )


@query("d11_sample_frames", f"WITH {FRAMES_SQL} SELECT attachment_id, frame_idx, duration_ms, l_partkey, sample_no FROM sampled")
def d11(spark, sf):
    out = M.sample_frames(frames(Tables(spark, sf)), 10, 3, order=_ORDER)
    return out.select("attachment_id", "frame_idx", "duration_ms", "l_partkey", "sample_no")


def worst_frames(t):
    return M.worst_frame(M.sample_frames(frames(t), 10, 3, order=_ORDER), order=_ORDER)


@query("d12_worst_frame", f"WITH {FRAMES_SQL} SELECT * FROM verdicts")
def d12(spark, sf):
    return worst_frames(Tables(spark, sf))


WORST_SQL = FRAMES_SQL + """, images AS (SELECT o_custkey, o_orderkey AS image_idx, image_score, image_action, frames_scored FROM verdicts JOIN orders ON o_orderkey = attachment_id),
  worst_image AS (SELECT * FROM images QUALIFY row_number() OVER (PARTITION BY o_custkey
      ORDER BY CASE image_action WHEN 'block' THEN 2 WHEN 'review' THEN 1 ELSE 0 END DESC, image_idx) = 1)"""


def worst_images(t):
    orders = t.orders.select("o_custkey", F.col("o_orderkey").alias("image_idx"))
    images = worst_frames(t).withColumnRenamed("attachment_id", "image_idx").join(orders, "image_idx")
    return M.worst_image(images, "o_custkey")


@query("d13_worst_image", f"WITH {WORST_SQL} SELECT * FROM worst_image")
def d13(spark, sf):
    return worst_images(Tables(spark, sf))


DECISION_SQL = TEXT_SQL + ", " + WORST_SQL + """, decided AS (SELECT t.*, image_score, image_action, CASE WHEN image_action IS NOT NULL THEN 'jpeg' END AS image_format, frames_scored,
    CASE WHEN text_result IN ('true_positive', 'flagged_fallback') OR image_action = 'block' THEN 'block' WHEN image_action = 'review' THEN 'review' ELSE 'pass' END AS final_action
    FROM texts t LEFT JOIN worst_image w ON w.o_custkey = t.doc_id AND t.doc_id % 3 = 0),
  cased AS (SELECT *, sha256('case:' || message_name) AS h, CASE WHEN final_action <> 'pass' THEN
      h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] END AS case_id FROM decided)"""


def decided(t):
    images = worst_images(t).where(F.col("o_custkey") % 3 == 0).withColumn("image_format", F.lit("jpeg"))
    named = images.join(messages(t).select("doc_id", "message_name"), F.col("o_custkey") == F.col("doc_id")).drop("doc_id")
    return M.with_case_id(M.decisions(texts(t), named, model="screener-1"))


@query("d14_combine_actions", f"WITH {DECISION_SQL} SELECT doc_id, text_result, image_action, final_action FROM decided")
def d14(spark, sf):
    return decided(Tables(spark, sf)).select("doc_id", "text_result", "image_action", "final_action")


@query(
    "d15_decisions",
    f"""WITH {DECISION_SQL} SELECT message_name, space_name, sender_email, text_result, array_to_string(matched_terms, ',') AS matched_terms, rationale,
        image_score, image_action, image_format, frames_scored, final_action, case_id, '1.0' AS engine_version,
        CASE WHEN rationale IS NOT NULL THEN 'screener-1' END AS model, 'cloud_vision' AS backend FROM cased""",
)
def d15(spark, sf):
    return decided(Tables(spark, sf)).select(
        "message_name", "space_name", "sender_email", "text_result", F.array_join("matched_terms", ",").alias("matched_terms"),
        "rationale", "image_score", "image_action", "image_format", "frames_scored", "final_action", "case_id",
        "engine_version", "model", "backend",
    )


_CASES_SQL = """cases AS (SELECT case_id, 'MOD-' || strftime(received_at, '%Y%m%d') || '-' || upper(case_id[1:8]) AS case_code,
    'Message in ' || space_name || ': ' || final_action AS title, sender_email AS subject_ref, 'open' AS disposition,
    CASE final_action WHEN 'block' THEN 'high' ELSE 'medium' END AS severity, CASE final_action WHEN 'block' THEN 80 ELSE 55 END AS confidence_score,
    CASE final_action WHEN 'block' THEN 'strong' ELSE 'mixed' END AS confidence_band,
    'message=' || message_name || ' action=' || final_action AS notes, sender_email
    FROM cased WHERE final_action <> 'pass')"""


@query("d16_open_cases", f"WITH {DECISION_SQL}, {_CASES_SQL} SELECT * FROM cases")
def d16(spark, sf):
    return M.open_cases(decided(Tables(spark, sf)), "received_at").drop("opened_at_utc")


_EVIDENCE_SQL = """payload AS (SELECT case_id, received_at, 'chat_moderation:text:' || message_name AS query,
    '{"message_name": ' || CAST(to_json(message_name) AS VARCHAR) || ', "space_name": ' || CAST(to_json(space_name) AS VARCHAR) || ', "sender_email": ' || CAST(to_json(sender_email) AS VARCHAR)
    || ', "text": ' || CAST(to_json(text) AS VARCHAR) || ', "text_verdict": ' || CAST(to_json(text_result) AS VARCHAR) || ', "matched_terms": [' ||
    array_to_string(list_transform(matched_terms, lambda m: '"' || m || '"'), ', ') || '], "llm_rationale": ' || coalesce(CAST(to_json(rationale) AS VARCHAR), 'null') || '}' AS body,
    'application/json' AS mime_type FROM cased WHERE case_id IS NOT NULL AND text <> ''
    UNION ALL SELECT case_id, received_at, 'chat_moderation:image:' || message_name || ':attachment_0', 'pixels of ' || doc_id, 'image/png' FROM cased
      WHERE case_id IS NOT NULL AND image_action IS NOT NULL),
  items AS (SELECT *, sha256(case_id || ':' || query) AS h FROM payload)"""


@query(
    "d17_case_evidence",
    f"""WITH {DECISION_SQL}, {_EVIDENCE_SQL} SELECT h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS artefact_id,
        case_id, query, CAST(octet_length(encode(body)) AS BIGINT) AS bytes, sha256(body) AS sha256, mime_type, strftime(received_at, '%Y-%m-%d %H:%M:%S') AS collected_at_utc,
        'moderation://' || case_id || '/' || artefact_id || '.manifest.json' AS manifest_uri, 'moderation_pipeline_v1' AS signing_key_id, 1 AS manifest_version FROM items""",
)
def d17(spark, sf):
    out = decided(Tables(spark, sf))
    images = out.where(F.col("image_action").isNotNull()).select(
        "message_name",
        F.lit(0).alias("image_idx"),
        F.lit("image/png").alias("mime_type"),
        F.encode(F.concat(F.lit("pixels of "), F.col("doc_id").cast("string")), "UTF-8").alias("content"),
    )
    rows = M.case_evidence(out, images, F.col("received_at"))
    shown = ["artefact_id", "case_id", "query", "bytes", "sha256", "mime_type", "manifest_uri", "signing_key_id", "manifest_version"]
    return rows.select(*shown, F.date_format("collected_at_utc", "yyyy-MM-dd HH:mm:ss").alias("collected_at_utc"))


def _blob(pad):
    block = KEY.ljust(64, b"\0")
    return "'" + "".join(f"\\x{b ^ pad:02X}" for b in block) + "'::BLOB"


_DISPO_SQL = f"""ev AS (SELECT c.case_id, l.doc_id AS event_id, l.doc_id % 50 AS happened,
    CASE WHEN l.doc_id % 11 = 0 THEN 'maybe' WHEN quality = 1 THEN 'true_positive' ELSE 'false_positive' END AS disposition
    FROM labels l JOIN cased c ON c.doc_id = l.doc_id AND c.case_id IS NOT NULL
    UNION ALL SELECT case_id, doc_id + 1000000, doc_id % 50 + 1, 'inconclusive' FROM cased WHERE case_id IS NOT NULL AND doc_id % 4 = 0
    UNION ALL SELECT 'case-' || doc_id, doc_id + 2000000, 0, 'true_positive' FROM labels),
  signed AS (SELECT *, sha256({_blob(0x5C)} || unhex(sha256({_blob(0x36)} || encode(case_id || ':' || CASE WHEN event_id % 5 = 0 THEN 'forged' ELSE disposition END)))) AS token,
     sha256({_blob(0x5C)} || unhex(sha256({_blob(0x36)} || encode(case_id || ':' || disposition)))) AS good FROM ev),
  checked AS (SELECT *, CASE WHEN disposition NOT IN ('true_positive', 'false_positive', 'inconclusive') THEN 'invalid_request' WHEN token <> good THEN 'invalid_token'
     WHEN case_id LIKE 'case-%' THEN 'unknown_case' END AS reject_reason FROM signed),
  last AS (SELECT case_id, disposition FROM checked WHERE reject_reason IS NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY happened DESC, event_id DESC) = 1)"""


def disposition_events(t, out):
    cased = out.where(F.col("case_id").isNotNull()).select("doc_id", "case_id")
    word = F.when(F.col("doc_id") % 11 == 0, "maybe").when(F.col("quality") == 1, "true_positive").otherwise("false_positive")
    a = t.labels.join(cased, "doc_id").select(
        "case_id", F.col("doc_id").alias("event_id"), (F.col("doc_id") % 50).alias("at"), word.alias("disposition")
    )
    b = cased.where(F.col("doc_id") % 4 == 0).select(
        "case_id", (F.col("doc_id") + 1000000).alias("event_id"), (F.col("doc_id") % 50 + 1).alias("at"),
        F.lit("inconclusive").alias("disposition"),
    )
    c = t.labels.select(
        F.concat(F.lit("case-"), F.col("doc_id").cast("string")).alias("case_id"),
        (F.col("doc_id") + 2000000).alias("event_id"), F.lit(0).cast("bigint").alias("at"), F.lit("true_positive").alias("disposition"),
    )
    said = F.when(F.col("event_id") % 5 == 0, "forged").otherwise(F.col("disposition"))
    return a.unionByName(b).unionByName(c).withColumn("token", M.disposition_token(F.col("case_id"), said, KEY))


@query(
    "d18_apply_dispositions",
    f"""WITH {DECISION_SQL}, {_DISPO_SQL} SELECT c.case_id, coalesce(l.disposition, 'open') AS disposition FROM cased c LEFT JOIN last l USING (case_id)
        WHERE c.case_id IS NOT NULL""",
)
def d18(spark, sf):
    t = Tables(spark, sf)
    out = decided(t)
    cases, _ = M.apply_dispositions(M.open_cases(out, "received_at"), disposition_events(t, out), KEY)
    return cases.select("case_id", "disposition")


@query("d18_rejected_dispositions", f"WITH {DECISION_SQL}, {_DISPO_SQL} SELECT event_id, case_id, reject_reason FROM checked WHERE reject_reason IS NOT NULL")
def d18_bad(spark, sf):
    t = Tables(spark, sf)
    out = decided(t)
    _, bad = M.apply_dispositions(M.open_cases(out, "received_at"), disposition_events(t, out), KEY)
    return bad.select("event_id", "case_id", "reject_reason")


@query(
    "d19_tombstone",
    f"""WITH {DECISION_SQL}, {_DISPO_SQL} SELECT message_name, final_action = 'block' OR coalesce(l.disposition = 'true_positive', false) AS removed,
        CASE WHEN final_action = 'block' OR l.disposition = 'true_positive' THEN '{TOMBSTONE}' ELSE text END AS text,
        CASE WHEN final_action = 'block' OR l.disposition = 'true_positive' OR image_action IS NULL THEN '' ELSE 'image-' || doc_id END AS attachments
        FROM cased c LEFT JOIN last l USING (case_id)""",
)
def d19(spark, sf):
    t = Tables(spark, sf)
    out = decided(t)
    cases, _ = M.apply_dispositions(M.open_cases(out, "received_at"), disposition_events(t, out), KEY)
    image = F.array_compact(F.array(F.when(F.col("image_action").isNotNull(), F.concat(F.lit("image-"), F.col("doc_id").cast("string")))))
    left = M.tombstone(out.withColumn("attachments", image), cases, "attachments")
    return left.withColumn("attachments", F.array_join("attachments", ","))


@query(
    "d20_reviewer_alerts",
    f"""WITH {DECISION_SQL} SELECT message_name, sender_email, space_name, strftime(received_at, '%Y-%m-%d %H:%M:%S UTC') AS time, upper(final_action) AS action,
        CASE WHEN text_result IN ('true_positive', 'flagged_fallback') THEN text_result || ' — ' || array_to_string(matched_terms[1:10], ', ') END AS text_flag,
        CASE WHEN text_result IN ('true_positive', 'flagged_fallback') THEN rationale END AS rationale,
        CASE WHEN image_action <> 'pass' THEN 'score=' || coalesce(CAST(image_score AS VARCHAR), 'N/A') || ', action=' || image_action || ', format=' || image_format END AS image_flag,
        CASE WHEN text_result IN ('true_positive', 'flagged_fallback') THEN array_to_string(matched_terms, ', ') END AS all_terms,
        case_id FROM cased WHERE final_action <> 'pass'""",
)
def d20(spark, sf):
    time = F.concat(F.date_format("received_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    return M.reviewer_alerts(decided(Tables(spark, sf)), time)


_REPORT = ", ".join(
    [f"count(*) FILTER (final_action = '{a}') AS {a}" for a in ("pass", "review", "block")]
    + [f"count(*) FILTER (text_result = '{r}') AS {r}" for r in ("true_positive", "false_positive", "flagged_fallback")]
)


@query("d21_report_by_space", f"WITH {DECISION_SQL} SELECT space_name, count(*) AS messages, {_REPORT} FROM decided GROUP BY 1")
def d21(spark, sf):
    return M.moderation_report(decided(Tables(spark, sf)), "space_name")


@query("d21_report_by_sender", f"WITH {DECISION_SQL} SELECT sender_email, count(*) AS messages, {_REPORT} FROM decided GROUP BY 1")
def d21_sender(spark, sf):
    return M.moderation_report(decided(Tables(spark, sf)), "sender_email")


@query(
    "d22_promotion_gate",
    """WITH c AS (SELECT lang, CASE WHEN quality = 1 THEN 'true_positive' WHEN quality = 0 THEN 'false_positive' END AS d,
                  CASE WHEN doc_id % 6 = 0 THEN NULL WHEN toxic = 1 THEN 'false_positive' ELSE 'true_positive' END AS v FROM documents LEFT JOIN labels USING (doc_id)),
       g AS (SELECT lang, count(*) FILTER (d IS NOT NULL) AS labelled, avg(CAST(d = v AS INTEGER)) AS accuracy,
             avg(CAST(d = 'false_positive' AS INTEGER)) AS false_positive_rate FROM c GROUP BY lang)
       SELECT lang, labelled, round(accuracy, 9) AS accuracy, round(false_positive_rate, 9) AS false_positive_rate,
              coalesce(labelled >= 20 AND g.accuracy >= 0.3 AND g.false_positive_rate <= 0.9, false) AS ready FROM g""",
)
def d22(spark, sf):
    t = Tables(spark, sf)
    c = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").select(
        "lang",
        F.when(F.col("quality") == 1, "true_positive").when(F.col("quality") == 0, "false_positive").alias("d"),
        F.when(F.col("doc_id") % 6 == 0, None).when(F.col("toxic") == 1, "false_positive").otherwise("true_positive").alias("v"),
    )
    out = M.promotion_gate(c, "lang", "d", "v", 20, 0.3, 0.9)
    return out.withColumns({c: F.round(c, 9) for c in ("accuracy", "false_positive_rate")})
