"""C: URL scanning over the pages' own URLs and the links inside them."""

from pyspark.sql import functions as F

from watchfold.operators import urlscan as U
from watchfold.plans.ledger_queries import uuid_sql
from watchfold.plans.registry import Tables, query
from watchfold.session import shared_dir

PATTERNS = [
    ("spam", r"spam-farm"),
    ("tracking", r"[?&]UTM_"),
    ("paging", r"[?&]page=\d+"),
    ("archive", r"/en/\d+\.html"),
    ("mobile", r"//m\."),
    ("anchor", r"#top"),
]


def _name_sql(col):
    cases = " ".join(f"WHEN regexp_matches({col}, '(?i){r}') THEN '{n}'" for n, r in PATTERNS)
    return f"CASE {cases} END"


@query("c1_first_match", f"SELECT page_id, url, {_name_sql('url')} AS pattern_name FROM pages WHERE pattern_name IS NOT NULL")
def c1(spark, sf):
    return U.first_match(Tables(spark, sf).pages.select("page_id", "url"), "url", PATTERNS)


ACCOUNT_SQL = """acct AS (SELECT page_id, url, CASE WHEN page_id % 6 = 5 THEN NULL ELSE c_name || '@' || CASE WHEN page_id % 3 = 0 THEN 'Corp.Example' ELSE 'corp.example' END
    || CASE WHEN page_id % 4 = 1 THEN '.org' ELSE '' END END AS email FROM pages LEFT JOIN customer ON c_custkey = page_id)"""


def accounts(t):
    domain = F.when(F.col("page_id") % 3 == 0, "Corp.Example").otherwise("corp.example")
    tail = F.when(F.col("page_id") % 4 == 1, ".org").otherwise("")
    email = F.when(F.col("page_id") % 6 != 5, F.concat("c_name", F.lit("@"), domain, tail))
    people = t.customer.select(F.col("c_custkey").alias("page_id"), "c_name")
    return t.pages.select("page_id", "url").join(people, "page_id", "left").select("page_id", "url", email.alias("email"))


@query("c3_corporate_only", f"WITH {ACCOUNT_SQL} SELECT page_id, email FROM acct WHERE lower(email) LIKE '%@corp.example'")
def c3(spark, sf):
    return U.corporate_only(accounts(Tables(spark, sf)), "email", "corp.example").select("page_id", "email")


def profiles(t):
    """A bookmark tree per page: its URL one folder deep, its links two and three deep."""
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))
    host = F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1)

    def leaf(url, title):
        return F.struct(F.lit("url").alias("type"), url.alias("url"), title.alias("name"))

    base = t.pages.select("page_id", "url", host.alias("host"), links.alias("links"))
    full = F.transform("links", lambda x: leaf(F.concat("host", x, F.lit("#top")), x))
    deep = F.struct(F.lit("folder").alias("type"), F.lit("deep").alias("name"), full.alias("children"))
    middle = F.struct(F.lit("folder").alias("type"), F.lit("middle").alias("name"), F.array(deep).alias("children"))
    bar = F.struct(F.lit("folder").alias("type"), F.array(leaf(F.col("url"), F.lit(""))).alias("children"))
    other = F.struct(F.lit("folder").alias("type"), F.array(middle).alias("children"))
    tree = F.to_json(F.struct(F.struct(bar.alias("bookmark_bar"), other.alias("other")).alias("roots")))
    prefs = F.to_json(
        F.struct(
            F.array(F.struct(F.col("email"))).alias("account_info"),
            F.col("url").alias("homepage"),
            F.when(F.col("page_id") % 2 == 0, False).when(F.col("page_id") % 5 == 1, True).alias("homepage_is_newtabpage"),
        )
    )
    who = accounts(t).select("page_id", "email")
    return base.join(who, "page_id").select(
        F.concat(F.lit("host"), (F.col("page_id") % 10).cast("string")).alias("hostname"),
        F.concat(F.lit("os"), F.col("page_id").cast("string")).alias("os_username"),
        F.concat(F.lit("Profile "), F.col("page_id").cast("string")).alias("profile_dir"),
        tree.alias("bookmarks_json"),
        prefs.alias("preferences_json"),
    )


LEAVES_SQL = ACCOUNT_SQL + """, link AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS host, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS x FROM pages),
  leaves AS (SELECT page_id, 'bookmark_bar' AS root, 1 AS depth, url, NULL AS title FROM pages
             UNION ALL SELECT page_id, 'other', 3, host || x || '#top', nullif(x, '') FROM link)"""


@query(
    "c2_flatten_tree",
    f"WITH {LEAVES_SQL} SELECT 'Profile ' || page_id AS profile_dir, root, depth, url, title FROM leaves JOIN acct USING (page_id)".replace(
        "root, depth, url, title FROM leaves JOIN acct USING (page_id)",
        "root, depth, leaves.url AS url, title FROM leaves JOIN acct USING (page_id)",
    ),
)
def c2(spark, sf):
    trees = profiles(Tables(spark, sf)).select("profile_dir", "bookmarks_json")
    return U.flatten_tree(trees, "bookmarks_json")


HOMES_SQL = f"""homes AS (SELECT page_id, url, 'Homepage' AS title, {_name_sql('url')} AS pattern_name, 'homepage' AS item_type, email FROM acct WHERE page_id % 2 = 0 AND pattern_name IS NOT NULL)"""


@query("c4_scan_homepages", f"WITH {ACCOUNT_SQL}, {HOMES_SQL} SELECT 'Profile ' || page_id AS profile_dir, url, title, pattern_name, item_type FROM homes")
def c4(spark, sf):
    prefs = profiles(Tables(spark, sf)).select("profile_dir", "preferences_json")
    return U.scan_homepages(prefs, "preferences_json", PATTERNS).drop("preferences_json")


MATCHES_SQL = LEAVES_SQL + f", {HOMES_SQL}" + f""", matches AS (
   SELECT l.page_id, l.url, l.title, {_name_sql('l.url')} AS pattern_name, 'bookmark' AS item_type, email FROM leaves l JOIN acct USING (page_id)
     WHERE lower(email) LIKE '%@corp.example' AND pattern_name IS NOT NULL
   UNION ALL SELECT page_id, url, title, pattern_name, item_type, email FROM homes WHERE lower(email) LIKE '%@corp.example'),
  found AS (SELECT 'host' || (page_id % 10) AS hostname, 'os' || page_id AS os_username, 'Profile ' || page_id AS profile_dir, email AS chrome_email, url, title, item_type, pattern_name FROM matches),
  outcomes AS (SELECT *, CASE WHEN length(url) % 7 <> 0 THEN 'removed' ELSE 'failed' END AS action_taken,
     CASE WHEN length(url) % 7 = 0 THEN CASE item_type WHEN 'homepage' THEN 'homepage is another by now' ELSE 'no such bookmark any more' END END AS action_error FROM found)"""


def found(t):
    return U.scan_profiles(profiles(t), PATTERNS, "corp.example")


@query("c4_scan_profiles", f"WITH {MATCHES_SQL} SELECT * FROM found")
def c4_all(spark, sf):
    return found(Tables(spark, sf))


@query(
    "c5_prune",
    f"""WITH {LEAVES_SQL} SELECT 'kept' AS part, page_id, leaves.url AS url FROM leaves WHERE {_name_sql('leaves.url')} IS NULL AND leaves.url NOT IN (SELECT url FROM pages WHERE page_id % 5 = 0)
        UNION ALL SELECT 'removed', page_id, leaves.url FROM leaves WHERE {_name_sql('leaves.url')} IS NOT NULL OR leaves.url IN (SELECT url FROM pages WHERE page_id % 5 = 0)""",
)
def c5(spark, sf):
    t = Tables(spark, sf)
    leaves = t.pages.select("page_id", "url").unionByName(
        t.pages.select(
            "page_id",
            F.explode(
                F.transform(
                    F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)),
                    lambda x: F.concat(F.regexp_extract("url", r"^([a-z]+://[^/?#]+)", 1), x, F.lit("#top")),
                )
            ).alias("url"),
        )
    )
    listed = t.pages.where(F.col("page_id") % 5 == 0).select("url")
    left, gone = U.prune(leaves, listed, "url", PATTERNS)
    return left.withColumn("part", F.lit("kept")).unionByName(gone.withColumn("part", F.lit("removed")))


def outcomes(t):
    matches = found(t)
    keys = ["profile_dir", "url", "item_type"]
    removed = matches.where(F.length("url") % 7 != 0).select(*keys)
    return U.removal_outcome(matches, removed, keys)


@query("c6_removal_outcome", f"WITH {MATCHES_SQL} SELECT * FROM outcomes")
def c6(spark, sf):
    return outcomes(Tables(spark, sf))


@query(
    "c6_removal_dry_run",
    f"WITH {MATCHES_SQL} SELECT profile_dir, url, item_type, 'skipped' AS action_taken, CAST(NULL AS VARCHAR) AS action_error FROM found",
)
def c6_dry(spark, sf):
    matches = found(Tables(spark, sf)).select("profile_dir", "url", "item_type")
    return U.removal_outcome(matches, matches, ["url"], dry_run=True)


@query(
    "c7_by_profile",
    f"""WITH {MATCHES_SQL} SELECT hostname, profile_dir, count(*) FILTER (item_type = 'bookmark') AS bookmarks, count(*) FILTER (item_type = 'homepage') AS homepages
        FROM found GROUP BY 1, 2""",
)
def c7(spark, sf):
    return U.by_profile(found(Tables(spark, sf)))


_CASE_SQL = """viol AS (SELECT event_id, 'host' || (user_id % 20) AS hostname, 'os' || user_id AS os_username, ts FROM events),
  coded AS (SELECT *, 'BG-' || hostname || '-' || strftime(ts, '%Y-%m-%d') AS case_code FROM viol),
  known AS (SELECT DISTINCT case_code, 'existing-' || case_code AS case_id FROM coded WHERE case_code LIKE '%5'),
  want AS (SELECT c.case_code, min(hostname) AS hostname, min(os_username) AS os_username, min(k.case_id) AS known FROM coded c LEFT JOIN known k USING (case_code) GROUP BY 1),
  res AS (SELECT *, sha256(case_code) AS h, coalesce(known, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]) AS case_id FROM want)"""


def _daily(t):
    viol = t.events.select(
        "event_id",
        F.concat(F.lit("host"), (F.col("user_id") % 20).cast("string")).alias("hostname"),
        F.concat(F.lit("os"), F.col("user_id").cast("string")).alias("os_username"),
        "ts",
    )
    code = F.concat(F.lit("BG-"), F.col("hostname"), F.lit("-"), F.date_format("ts", "yyyy-MM-dd"))
    cases = viol.select(code.alias("case_code")).distinct().where(F.col("case_code").endswith("5"))
    cases = cases.withColumn("case_id", F.concat(F.lit("existing-"), F.col("case_code")))
    return U.assign_daily_case(viol, cases, "hostname", "ts", "os_username")


@query("c8_assign_daily_case", f"WITH {_CASE_SQL} SELECT event_id, case_code, case_id FROM coded JOIN res USING (case_code)")
def c8(spark, sf):
    return _daily(Tables(spark, sf))[0].select("event_id", "case_code", "case_id")


@query(
    "c8_new_daily_cases",
    f"""WITH {_CASE_SQL} SELECT case_id, case_code, 'Listed URLs on ' || hostname AS title, os_username AS subject_ref, 'low' AS severity
        FROM res WHERE known IS NULL""",
)
def c8_new(spark, sf):
    return _daily(Tables(spark, sf))[1]


_DIGEST_SQL = MATCHES_SQL + """, lines AS (SELECT chrome_email, '- ' || coalesce(title, url) || CASE action_taken WHEN 'removed' THEN '' ELSE ' (not removed)' END || E'\\n  ' || url AS line,
     count(*) OVER (PARTITION BY chrome_email) AS count FROM outcomes),
  parts AS (SELECT *, CAST(ceil(count / 4) AS BIGINT) AS parts, CAST((row_number() OVER (PARTITION BY chrome_email ORDER BY sha256('0:' || line)) - 1) // 4 + 1 AS BIGINT) AS part FROM lines)"""


@query(
    "c9_notification_digest",
    f"""WITH {_DIGEST_SQL} SELECT chrome_email, count, parts, part, array_to_string(list_sort(list(line)), E'\\n') AS item_list,
        upper(split_part(chrome_email, '@', 1)[1]) || lower(split_part(chrome_email, '@', 1)[2:]) AS display_name FROM parts GROUP BY ALL""",
)
def c9(spark, sf):
    return U.notification_digest(outcomes(Tables(spark, sf)), "chrome_email", 4)[0]


@query(
    "c9_without_email",
    f"WITH {ACCOUNT_SQL} SELECT page_id, url FROM acct WHERE email IS NULL",
)
def c9_none(spark, sf):
    acct = accounts(Tables(spark, sf)).withColumns({"title": F.lit(None).cast("string"), "action_taken": F.lit("removed")})
    return U.notification_digest(acct, "email")[1].select("page_id", "url")


@query(
    "c10_outcome_summary",
    f"""WITH {MATCHES_SQL} SELECT pattern_name, count(*) AS violations, count(*) FILTER (action_taken = 'removed') AS removed,
        count(*) FILTER (action_taken = 'failed') AS failed, count(*) FILTER (action_taken = 'skipped') AS skipped FROM outcomes GROUP BY 1""",
)
def c10(spark, sf):
    return U.outcome_summary(outcomes(Tables(spark, sf)), ["pattern_name"])


# --- the whole run -----------------------------------------------------------------------

_RUN_DAY = "2024-05-06"


def guard(t, dry_run=False):
    people = profiles(t)
    keys = ["hostname", "os_username", "profile_dir", "url", "item_type"]
    gone = U.scan_profiles(people, PATTERNS, "corp.example").where(F.length("url") % 7 != 0).select(*keys)
    cases = t.region.select(
        F.concat(F.lit("BG-host"), F.col("r_regionkey").cast("string"), F.lit(f"-{_RUN_DAY}")).alias("case_code"), F.col("r_name").alias("case_id")
    )
    folder = None if dry_run else shared_dir(t.spark, "guard")
    return U.guard_run(people, PATTERNS, "corp.example", gone, cases, f"{_RUN_DAY}T10:00:00Z", "s3://vault", "k1", dry_run, folder=folder)


# An id is a UUID only where the run opened the case itself; a snapshot for another case breaks the manifest's rule.
GUARD_SQL = MATCHES_SQL + f""", cased AS (SELECT o.*, 'BG-' || hostname || '-{_RUN_DAY}' AS case_code, sha256(case_code) AS h, coalesce(r_name, {uuid_sql("h")}) AS case_id, r_name IS NULL AS opened,
     sha256('artefact:' || coalesce(r_name, {uuid_sql("h")}) || ':' || hostname || '|' || os_username || '|' || profile_dir) AS a FROM outcomes o LEFT JOIN region ON hostname = 'host' || r_regionkey)"""


@query(
    "c_guard_run",
    f"""WITH {GUARD_SQL} SELECT hostname, os_username, profile_dir, url, item_type, action_taken, case_code, case_id,
        CASE WHEN item_type = 'bookmark' AND opened THEN {uuid_sql("a")} END AS evidence_artefact_id FROM cased""",
)
def c_guard(spark, sf):
    out = guard(Tables(spark, sf)).violations
    return out.select("hostname", "os_username", "profile_dir", "url", "item_type", "action_taken", "case_code", "case_id", "evidence_artefact_id")


@query(
    "c_guard_evidence",
    f"""WITH {GUARD_SQL} SELECT DISTINCT case_id, {uuid_sql("a")} AS artefact_id, 'bookmarks before removal: profile=' || profile_dir || ' host=' || hostname AS query,
        'bookmark_guard:responder:' || os_username AS collector_principal FROM cased WHERE item_type = 'bookmark' AND opened""",
)
def c_guard_evidence(spark, sf):
    return guard(Tables(spark, sf)).evidence.items.select("case_id", "artefact_id", "query", "collector_principal")


@query("c_guard_dry_run", f"WITH {MATCHES_SQL} SELECT profile_dir, url, item_type, 'skipped' AS action_taken, CAST(NULL AS VARCHAR) AS case_id FROM found")
def c_guard_dry(spark, sf):
    return guard(Tables(spark, sf), dry_run=True).violations.select("profile_dir", "url", "item_type", "action_taken", "case_id")
