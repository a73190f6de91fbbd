"""Sensitive-URL scanning of bookmark trees, homepages and any table of URLs."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from watchfold import constants as K
from watchfold.functions.hashing import sha256
from watchfold.functions.jsontext import uuid_form
from watchfold.functions.text import display_name
from watchfold.operators.ledger import Recorded, artefact_of, kept_in, record_evidence
from watchfold.scale import hash_rank

Patterns = Sequence[tuple[str, str]]


def pattern_name(url: Column | str, patterns: Patterns) -> Column:
    """Name of the first pattern found in the URL, case aside; null if none is."""
    u = F.col(url) if isinstance(url, str) else url
    out = None
    for name, regex in patterns:
        hit = u.rlike(f"(?iu){regex}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out if out is not None else F.lit(None).cast("string")


def first_match(df: DataFrame, url: str, patterns: Patterns) -> DataFrame:
    """Rows whose URL matches, with ``pattern_name`` of the first match."""
    named = df.withColumn("pattern_name", pattern_name(url, patterns))
    return named.where(F.col("pattern_name").isNotNull())


def flatten_tree(df: DataFrame, json_col: str, roots: Sequence[str] = K.TREE_ROOTS) -> DataFrame:
    """URL leaves of bookmark trees, one row each: root, depth, url, title.

    The tree is a VARIANT, opened one level of folders per step inside its own
    row, so nothing is shuffled and trees of any depth come out whole: a tree has
    no more levels than its text names ``children``.  Anything else than a url
    or a folder is passed over.
    """
    nodes, leaves = "array<struct<root: string, node: variant>>", "array<struct<root: string, depth: int, url: string, title: string>>"
    keep = [c for c in df.columns if c != json_col]

    def text(node: Column, path: str) -> Column:
        return F.try_variant_get(node, path, "string")

    def children(n: Column) -> Column:
        under = F.coalesce(F.try_variant_get(n["node"], "$.children", "array<variant>"), F.array().cast("array<variant>"))
        return F.transform(under, lambda c: F.struct(n["root"].alias("root"), c.alias("node")))

    def step(acc: Column, depth: Column) -> Column:
        here = F.filter(acc["open"], lambda n: text(n["node"], "$.type") == "url")
        found = F.transform(
            here,
            lambda n: F.struct(
                n["root"].alias("root"),
                depth.alias("depth"),
                F.coalesce(text(n["node"], "$.url"), F.lit("")).alias("url"),
                F.nullif(text(n["node"], "$.name"), F.lit("")).alias("title"),
            ),
        )
        folders = F.filter(acc["open"], lambda n: text(n["node"], "$.type") == "folder")
        return F.when(F.size(acc["open"]) == 0, acc).otherwise(
            F.struct(
                F.flatten(F.transform(folders, children)).cast(nodes).alias("open"),
                F.concat(acc["found"], found).cast(leaves).alias("found"),
            )
        )

    starts = F.filter(
        F.array(*[F.struct(F.lit(r).alias("root"), F.try_variant_get(F.col("__tree"), f"$.roots.{r}", "variant").alias("node")) for r in roots]),
        lambda n: n["node"].isNotNull(),
    )
    zero = F.struct(starts.cast(nodes).alias("open"), F.array().cast(leaves).alias("found"))
    levels = F.sequence(F.lit(0), F.regexp_count(json_col, F.lit('"children"')))
    walked = F.aggregate(levels, zero, step, lambda acc: acc["found"])
    return df.withColumn("__tree", F.try_parse_json(json_col)).select(*keep, F.inline(walked))


def account_email(prefs: Column | str) -> Column:
    """First account's e-mail from a preferences JSON text; null if there is none."""
    p = F.col(prefs) if isinstance(prefs, str) else prefs
    email = F.try_variant_get(F.try_parse_json(p), "$.account_info[0].email", "string")
    return F.nullif(email, F.lit(""))


def corporate_only(df: DataFrame, email: str, domain: str) -> DataFrame:
    """Rows signed in with an address of the domain; no address, no row."""
    return df.where(F.endswith(F.lower(email), F.lit(f"@{domain}")))


def scan_homepages(df: DataFrame, prefs: str, patterns: Patterns) -> DataFrame:
    """Homepages that match, unless the new-tab page is shown (the default) or none is set."""
    doc = F.try_parse_json(prefs)
    newtab = F.coalesce(F.try_variant_get(doc, "$.homepage_is_newtabpage", "boolean"), F.lit(True))
    page = F.try_variant_get(doc, "$.homepage", "string")
    pages = df.where(~newtab).withColumn("url", page).where(F.coalesce(F.length("url"), F.lit(0)) > 0)
    return first_match(pages, "url", patterns).withColumns(
        {"title": F.lit("Homepage"), "item_type": F.lit("homepage")}
    )


def scan_profiles(profiles: DataFrame, patterns: Patterns, domain: str) -> DataFrame:
    """Bookmarks and homepages that match, of profiles of the domain."""
    mine = corporate_only(profiles.withColumn("chrome_email", account_email("preferences_json")), "chrome_email", domain)
    cols = ["hostname", "os_username", "profile_dir", "chrome_email"]
    leaves = flatten_tree(mine.select(*cols, "bookmarks_json"), "bookmarks_json")
    marks = first_match(leaves, "url", patterns).withColumn("item_type", F.lit("bookmark"))
    homes = scan_homepages(mine.select(*cols, "preferences_json"), "preferences_json", patterns)
    out = [*cols, "url", "title", "item_type", "pattern_name"]
    return marks.select(*out).unionByName(homes.select(*out))


def prune(df: DataFrame, matches: DataFrame, url: str, patterns: Patterns, on: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows left, rows removed): removed if listed in ``matches`` or matching any pattern."""
    listed = matches.select(*on, url).distinct().withColumn("__listed", F.lit(True))
    marked = df.join(listed, [*on, url], "left").withColumn(
        "__gone", F.col("__listed").isNotNull() | F.coalesce(pattern_name(url, patterns).isNotNull(), F.lit(False))
    )
    left = marked.where(~F.col("__gone")).select(*df.columns)
    return left, marked.where(F.col("__gone")).select(*df.columns)


def removal_outcome(matches: DataFrame, removed: DataFrame, on: Sequence[str], dry_run: bool = False) -> DataFrame:
    """Adds ``action_taken`` and ``action_error`` to matches, given what was removed."""
    if dry_run:
        return matches.withColumns({"action_taken": F.lit("skipped"), "action_error": F.lit(None).cast("string")})
    gone = removed.select(*on).distinct().withColumn("__gone", F.lit(True))
    done = F.col("__gone").isNotNull()
    home = F.col("item_type") == "homepage"
    reason = F.when(home, "homepage is another by now").otherwise("no such bookmark any more")
    return matches.join(gone, list(on), "left").withColumns(
        {"action_taken": F.when(done, "removed").otherwise("failed"), "action_error": F.when(~done, reason)}
    ).drop("__gone")


def by_profile(matches: DataFrame, keys: Sequence[str] = ("hostname", "profile_dir")) -> DataFrame:
    return matches.groupBy(*keys).agg(
        F.count_if(F.col("item_type") == "bookmark").alias("bookmarks"),
        F.count_if(F.col("item_type") == "homepage").alias("homepages"),
    )


def assign_daily_case(violations: DataFrame, cases: DataFrame, host: str, day: str, user: str) -> tuple[DataFrame, DataFrame]:
    """(violations with case_id, cases to create): one case per host and day, reused if there."""
    code = F.concat(F.lit("BG-"), F.col(host), F.lit("-"), F.date_format(day, "yyyy-MM-dd"))
    coded = violations.withColumn("case_code", code)
    # one row per code before anything is joined
    wanted = coded.groupBy("case_code").agg(F.min_by(F.struct(host, user), F.struct(user)).alias("w"))
    known = cases.select("case_code", F.col("case_id").alias("__known")).groupBy("case_code").agg(F.min("__known").alias("__known"))
    resolved = wanted.join(known, "case_code", "left").withColumn(
        "case_id", F.coalesce("__known", uuid_form(sha256(F.col("case_code"))))
    )
    created = resolved.where(F.col("__known").isNull()).select(
        "case_id",
        "case_code",
        F.concat(F.lit("Listed URLs on "), F.col(f"w.{host}")).alias("title"),
        F.col(f"w.{user}").alias("subject_ref"),
        F.lit("low").alias("severity"),
    )
    return coded.join(resolved.select("case_code", "case_id"), "case_code"), created


def digest_line(title: str = "title", url: str = "url", action: str = "action_taken") -> Column:
    """How one outcome reads in a recipient's notice."""
    failed = F.when(F.col(action) == "removed", "").otherwise(" (not removed)")
    return F.concat(F.lit("- "), F.coalesce(title, url), failed, F.lit("\n  "), F.col(url))


def notification_digest(outcomes: DataFrame, email: str, per_notice: int = 200) -> tuple[DataFrame, DataFrame]:
    """(notices, outcomes without an e-mail).

    A recipient's lines are numbered exactly, in hash order, and cut into notices of
    ``per_notice`` lines: every notice but the last is full, none is longer, and no
    recipient is gathered in one task.  Equal lines are lines of their own.
    """
    sent = outcomes.where(F.coalesce(F.length(email), F.lit(0)) > 0)
    placed = hash_rank(sent.withColumn("__line", digest_line()), "__line", [email])
    notices = (
        placed.withColumns(
            {
                "count": F.col("total"),
                "parts": F.ceil(F.col("total") / per_notice).cast("bigint"),
                "part": (F.floor(F.col("rank") / per_notice) + 1).cast("bigint"),
            }
        )
        .groupBy(email, "count", "parts", "part")
        .agg(F.array_join(F.sort_array(F.collect_list("__line")), "\n").alias("item_list"))
        .withColumn("display_name", display_name(email))
    )
    return notices, outcomes.where(F.coalesce(F.length(email), F.lit(0)) == 0)


def outcome_summary(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts = [F.count_if(F.col("action_taken") == a).alias(a) for a in ("removed", "failed", "skipped")]
    return outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("violations"), *counts)


# --- the whole run -----------------------------------------------------------------


class GuardRun(NamedTuple):
    """What one run over all profiles leaves behind."""

    violations: DataFrame  # every match with its outcome, case and the snapshot that preceded it
    new_cases: DataFrame
    evidence: Recorded | None  # snapshots of the bookmark trees; none in a dry run
    notices: DataFrame
    unsent: DataFrame  # outcomes whose profile has no e-mail
    summary: DataFrame


_PROFILE = ("hostname", "os_username", "profile_dir")


def guard_run(
    profiles: DataFrame, patterns: Patterns, domain: str, removed: DataFrame, cases: DataFrame, at: str, vault: str, signing_key_id: str,
    dry_run: bool = False, retention_class: str = "standard_7y", folder: str | None = None,
) -> GuardRun:
    """Detect, preserve, respond and notify in one run at the ISO time ``at``.

    profiles: one row per (hostname, os_username, profile_dir) with bookmarks_json and preferences_json; ``removed``: the same three,
    url and item_type of what was taken out.  Every match has a case, one per host and day.  The bookmark tree of each profile
    with a matching bookmark is recorded as evidence, and the profile's bookmark violations carry its ``evidence_artefact_id``;
    homepages carry none, nor do bookmarks whose snapshot was rejected.  A dry run takes out, opens and records
    nothing: all outcomes are ``skipped``, case and artefact are null.

    With a ``folder`` the outcomes and the recorded requests are written there once and shared by all results.
    """
    keys = [*_PROFILE, "url", "item_type"]
    outcomes = removal_outcome(scan_profiles(profiles, patterns, domain), removed, keys, dry_run)
    none = F.lit(None).cast("string")
    if dry_run:
        outcomes = kept_in(outcomes, folder and f"{folder}/outcomes")
        notices, unsent = notification_digest(outcomes, "chrome_email")
        skipped = outcomes.withColumns({"case_code": none, "case_id": none, "evidence_artefact_id": none})
        opened = skipped.where(F.lit(False)).select("case_id", "case_code", F.col("title"), none.alias("subject_ref"), none.alias("severity"))
        return GuardRun(skipped, opened, None, notices, unsent, outcome_summary(outcomes))
    dated = outcomes.withColumn("__day", F.to_timestamp(F.lit(at)))
    cased, opened = assign_daily_case(dated, cases, "hostname", "__day", "os_username")
    cased = kept_in(cased.drop("__day"), folder and f"{folder}/outcomes")
    request = F.concat_ws("|", *_PROFILE)
    shown = cased.where(F.col("item_type") == "bookmark").select(*_PROFILE, "case_id").distinct()
    snapshots = profiles.select(*_PROFILE, F.col("bookmarks_json").alias("content")).join(shown, list(_PROFILE)).select(
        request.alias("request_id"),
        "case_id",
        "content",
        F.lit("bookmark_guard.chrome").alias("source_system"),
        F.lit("manual").alias("collection_method"),
        F.concat(F.lit("bookmarks before removal: profile="), "profile_dir", F.lit(" host="), "hostname").alias("query"),
        F.concat(F.lit("bookmark_guard:responder:"), "os_username").alias("collector_principal"),
        F.lit(at).alias("collected_at_utc"),
        F.lit("+00:00").alias("original_tz"),
        F.lit("application/json").alias("mime_type"),
        F.array(F.lit("browser_bookmark"), F.lit("pii_url")).alias("pii_tags"),
        F.lit(retention_class).alias("retention_class"),
        F.col("hostname").alias("host"),
    )
    evidence = record_evidence(snapshots, shown.select("case_id"), vault, signing_key_id, folder=folder and f"{folder}/evidence")
    taken = evidence.items.select("artefact_id", F.col("artefact_id").alias("evidence_artefact_id"))
    of = F.when(F.col("item_type") == "bookmark", artefact_of("case_id", request))
    violations = cased.withColumn("artefact_id", of).join(taken, "artefact_id", "left").drop("artefact_id")
    notices, unsent = notification_digest(cased, "chrome_email")
    return GuardRun(violations, opened, evidence, notices, unsent, outcome_summary(cased))
