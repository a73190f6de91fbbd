"""The operators as queries over the test tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from watchfold.llm import alignment, chat, decontam, embedding_dedup, exact_dedup, ngram_join, packing, pii, quality, sharding, spelling, toxicity, urlrules

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(plan):
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan

    return register


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_ngram_jaccard_join", """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
classes AS (SELECT min(doc_id) AS c, any_value(s) AS s, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
post AS (SELECT c, n, unnest(s) AS g FROM classes),
shared AS (SELECT g FROM post GROUP BY g HAVING count(*) > 1),
few AS (SELECT p.* FROM post p JOIN shared USING (g)),
links AS (SELECT a.c AS a, b.c AS b FROM few a JOIN few b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT c AS node, c AS low FROM classes UNION SELECT e.v, r.low FROM reach r JOIN edges e ON e.u = r.node),
label AS (SELECT node, min(low) AS low FROM reach GROUP BY node),
keyed AS (SELECT doc_id, s, list_sort(s) AS k FROM sets)
SELECT k.doc_id, CAST(len(k.s) AS BIGINT) AS n_shingles, CASE WHEN len(k.s) = 0 THEN k.doc_id ELSE l.low END AS component_id
FROM keyed k LEFT JOIN (SELECT list_sort(s) AS k, c FROM classes) c ON c.k = k.k AND len(k.s) > 0 LEFT JOIN label l ON l.node = c.c""")
def op1(spark, folder):
    return ngram_join.jaccard_components(spark, table(spark, folder, "documents"))


@query("op8_exact_dedup", """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS n FROM documents),
r AS (SELECT *, sha256(n) AS text_sha256 FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM r WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(t) DESC, doc_id)""")
def op8(spark, folder):
    return exact_dedup.deduplicate(spark, table(spark, folder, "documents"), exact_dedup.fresh_index(spark))


@query("op5_benchmark_decontamination", """
WITH norm AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT k, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
  FROM norm),
win AS (SELECT DISTINCT id AS item, p, len(string_split(p, ' ')) AS l FROM (
  SELECT id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i+12], ' '))) AS p
  FROM words WHERE k = 'b' AND len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
grams AS (SELECT id, l, unnest(range(1, len(w) - l + 2)) AS i, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i+l-1], ' '))) AS p
  FROM words, lens WHERE k = 'd' AND len(w) >= l),
occ AS (SELECT id, i, g.l, item FROM grams g JOIN win ON g.p = win.p),
hit AS (SELECT id, count(DISTINCT i) AS n_hit FROM (SELECT id, unnest(range(i, i + l)) AS i FROM (SELECT DISTINCT id, i, l FROM occ)) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS s FROM occ) GROUP BY id)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hit USING (id) LEFT JOIN items USING (id) WHERE k = 'd'""")
def op5(spark, folder):
    return decontam.contamination(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op4_harmonic_packing")
def op4(spark, folder):
    packed = packing.pack(spark, table(spark, folder, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


RULES = [  # fixed values: the contract's rules
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


@query("op3_url_range_join", """
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
q AS (SELECT page_id, CASE WHEN contains(u, '://') THEN substr(u, instr(u, '://') + 3) ELSE '' END AS r FROM p),
s AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM q),
rules(rh, rp, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM s JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM s LEFT JOIN fit USING (page_id)""")
def op3(spark, folder):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlrules.judge(spark, table(spark, folder, "pages").select("page_id", "url"), rules).drop("url")


@query("op7_bounded_load_ring")
def op7(spark, folder):
    placed = sharding.shard_documents(spark, table(spark, folder, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_reply_tree_chat", r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS t,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS l,
  sum(4 + length(role) + 2 + length(text) + 9) AS fixed,
  sum(length(regexp_replace(role || text, '[^\\#<:]', '', 'g'))) AS escaped
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(t) AS turns_sha256, length(l) AS loss_chars, sha256(l) AS loss_sha256,
  CAST(fixed + escaped AS BIGINT) AS formatted_chars FROM a""")
def op10(spark, folder):
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"  # fixed value: the contract's conversation
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], given.schema)
    tree = chat.chain(given.union(extra))
    return chat.digest(chat.conversations(spark, tree))


@query("op9_kneser_ney_quality")
def op9(spark, folder):
    trusted = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return quality.judge(spark, table(spark, folder, "documents"), trusted)


@query("op2_weak_supervision_pii")
def op2(spark, folder):
    return pii.digest(pii.detect(spark, table(spark, folder, "documents")))


@query("op6_crf_toxicity")
def op6(spark, folder):
    docs = table(spark, folder, "documents")
    field = toxicity.train(spark, docs, table(spark, folder, "labels"))
    return toxicity.score(spark, docs, field).select("doc_id", "held_out", "score", "predicted")


@query("op12_cross_tokenizer_alignment")
def op12(spark, folder):
    return alignment.align(spark, table(spark, folder, "documents"))


@query("op11_spelling_variants", r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END), i)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
seen AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (SELECT w, n, xor(4294967295, list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295)) AS h
  FROM (SELECT w, n, hex(encode(doc_id || ':' || w)) AS h FROM seen), crc),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, c.word, c.n FROM words a JOIN cuts c ON c.rest = a.word
  UNION SELECT c.word, a.word, a.n FROM words a JOIN cuts c ON c.rest = a.word),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS b, max(n) AS bn FROM pairs GROUP BY a),
f AS (SELECT w.word, w.n, CASE WHEN bn >= 10 * w.n THEN b END AS form, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * w.n THEN bn END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, form AS far FROM f WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form FROM walk w JOIN f ON f.word = w.far WHERE f.form IS NOT NULL),
last AS (SELECT walk.word, far AS root FROM walk JOIN f ON f.word = far WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN last USING (word)""")
def op11(spark, folder):
    return spelling.group_variants(spark, table(spark, folder, "documents"))


@query("op13_embedding_near_dedup")
def op13(spark, folder):
    return embedding_dedup.near_copies(spark, table(spark, folder, "embeddings"))
