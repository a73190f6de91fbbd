"""Correlate, detect, score and report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from watchfold.functions import levels as L
from watchfold.functions.hashing import sha256
from watchfold.functions.text import redact_email
from watchfold.scale import count_near, pairs_near, trailing_totals

# --- correlation -----------------------------------------------------------------------


HITS_PER_BLOCK = 2_000_000
ASSETS_IN_A_LIST = 10_000


def entity_hits(events: DataFrame, users: DataFrame, assets: DataFrame, privileged: DataFrame) -> DataFrame:
    """One row per (event, entity): known users, and assets met by host or address.

    events: event_id, source_system, user, host, ip; users: user; assets:
    asset, host, ip, critical; privileged: user.

    There are as many hits as the answer has, which is events times the assets behind one host or address.  So each is made
    once, by the last join, and none is shuffled: listings are merged for each (host, ip) that occurs, not for each event, and
    the events of one (host, ip) are spread over as many tasks as their hits need.
    """
    base = events.select("event_id", "source_system", "user", "host", "ip").distinct()
    one = ["event_id", "source_system"]
    rows = base.groupBy(*one).agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct("user", "host", "ip")).alias("__r"))
    single = rows.where(F.col("__n") == 1).select(*one, "__r.*")
    special = privileged.select("user").distinct().withColumn("__p", F.lit(True))
    people = users.select("user").distinct().join(special, "user", "left")

    def by_user(some: DataFrame) -> DataFrame:
        return some.join(people, "user").select(
            *one, F.lit("user").alias("entity_type"), F.col("user").alias("entity_id"),
            F.col("__p").isNotNull().alias("is_privileged"), F.lit(False).alias("is_asset_critical"),
        )

    # an asset met both ways, or listed twice, is one hit; critical if any listing says so
    places = base.groupBy("host", "ip").agg(F.count(F.lit(1)).alias("__n"))

    def listed(way: str) -> DataFrame:
        known = assets.where(F.col(way).isNotNull()).groupBy(way, "asset").agg(F.max("critical").alias("critical"))
        return places.join(known, way).select("host", "ip", "asset", "critical")

    met = listed("host").unionByName(listed("ip")).groupBy("host", "ip", "asset").agg(F.max("critical").alias("critical"))
    # nulls meet here, since a place may lack one of the two
    at = F.struct(*[F.struct(F.col(c).isNull(), F.coalesce(c, F.lit(""))) for c in ("host", "ip")]).alias("__at")
    met = met.select(at, "asset", "critical")
    # a place's events are dealt into blocks of some HITS_PER_BLOCK hits, and its assets go to each of them
    sizes = met.groupBy("__at").agg(F.count(F.lit(1)).alias("__a")).join(places.select(at, "__n"), "__at")
    share = F.greatest(F.col("__a"), F.ceil(F.lit(HITS_PER_BLOCK) / F.col("__a")))
    sizes = sizes.select("__at", "__a", F.ceil(F.col("__n") / share).cast("int").alias("__k"))
    tasks = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an event meets a few lists of assets, not each asset as a row of the join; a list holds some ASSETS_IN_A_LIST
    part = F.pmod(F.xxhash64("asset"), F.ceil(F.col("__a") / ASSETS_IN_A_LIST)).alias("__c")
    lists = met.join(sizes, "__at").groupBy("__at", "__k", part).agg(F.collect_list(F.struct("asset", "critical")).alias("__l"))
    dealt = lists.withColumn("__b", F.explode(F.sequence(F.lit(0), F.col("__k") - 1))).drop("__k", "__c")
    # by number: the step that would merge small partitions does not see how many hits they make
    dealt = dealt.repartition(tasks, "__at", "__b")

    def by_asset(some: DataFrame) -> DataFrame:
        asks = some.select(*one, at).join(sizes.drop("__a"), "__at")
        asks = asks.withColumn("__b", F.pmod(F.xxhash64(*one), F.col("__k")).cast("int")).drop("__k")
        return asks.repartition(tasks, "__at", "__b").join(dealt, ["__at", "__b"]).select(*one, F.inline("__l")).select(
            *one, F.lit("asset").alias("entity_type"), F.col("asset").alias("entity_id"),
            F.lit(False).alias("is_privileged"), F.col("critical").alias("is_asset_critical"),
        )

    # events that come with several users, hosts or addresses may meet an entity by more than one of their rows
    many = rows.where(F.col("__n") > 1).select(*[F.col(c).alias(f"__{c}") for c in one])
    several = base.join(many, F.col("event_id").eqNullSafe(F.col("__event_id")) & F.col("source_system").eqNullSafe(F.col("__source_system")), "left_semi")
    key = [*one, "entity_type", "entity_id", "is_privileged"]
    again = by_user(several).unionByName(by_asset(several)).groupBy(*key).agg(F.max("is_asset_critical").alias("is_asset_critical"))
    return by_user(single).unionByName(by_asset(single)).unionByName(again)


def corroborate(
    hits: DataFrame, events: DataFrame, hit_id: str, key: str, micros: str, source: str,
    sources: Sequence[str], window_seconds: float = 900,
) -> DataFrame:
    """Adds ``matches`` (events of another listed source within the window centred on the hit)
    and ``single_source``.  Counts without forming pairs (see ``scale.count_near``)."""
    near = count_near(hits, events, hit_id, key, micros, source, sources, window_seconds / 2)
    joined = hits.join(near, hit_id, "left")
    n = F.coalesce("near", F.lit(0)).cast("bigint")
    return joined.withColumns({"matches": n, "single_source": n == 0}).drop("near")


def corroborating_events(
    hits: DataFrame, events: DataFrame, hit_id: str, event_id: str, key: str, micros: str, source: str,
    sources: Sequence[str], window_seconds: float = 900,
) -> DataFrame:
    """(hit_id, event_id) of the events that ``corroborate`` counts: another listed source, same key, inside the window."""
    facts = events.where(F.col(source).isin(*sources)).select(key, micros, source, event_id)
    asks = hits.select(key, micros, source, hit_id)
    other = ~F.col("l")[source].eqNullSafe(F.col("r")[source])
    pairs = pairs_near(asks, facts, key, micros, window_seconds / 2, other)
    return pairs.select(F.col("l")[hit_id].alias(hit_id), F.col("r")[event_id].alias("corroborating_id"))


def evidence_links(finding_hits: DataFrame, corroborating: DataFrame, hit_id: str) -> DataFrame:
    """(finding_id, artefact_id, role): each finding's own hits and the events that corroborate them, once each.

    ``finding_hits`` has finding_id and ``hit_id``; an event that is both is a hit.
    """
    own = finding_hits.select("finding_id", F.col(hit_id).alias("artefact_id"), F.lit(0).alias("r"))
    others = finding_hits.join(corroborating, hit_id).select("finding_id", F.col("corroborating_id").alias("artefact_id"), F.lit(1).alias("r"))
    role = F.when(F.min("r") == 0, "hit").otherwise("corroborating")
    return own.union(others).groupBy("finding_id", "artefact_id").agg(role.alias("role"))


# --- rules -----------------------------------------------------------------------------


def threshold_rule(
    events: DataFrame, where: Column, key: str, ts: str, window: str, n: int, allow: DataFrame | None = None
) -> DataFrame:
    """Keys with more than n selected events in a window, but for those on the allow list.

    The count is combined before the shuffle, the allow list is applied to the few
    rows that pass.
    """
    counted = events.where(where).groupBy(F.col(key), F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    hot = counted.where(F.col("n") > n).select(
        key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n"
    )
    return hot if allow is None else hot.join(allow.select(key), key, "left_anti")


class Rule(NamedTuple):
    """More than ``n`` events selected by ``where`` for one ``key`` in a window of ``seconds`` are a finding."""

    rule_id: str
    where: Column
    key: Column
    seconds: int
    n: int
    trailing: bool = False  # the window ends at an event, (t - seconds, t], and does not stand on the clock


def tagged_events(events: DataFrame, rules: Sequence[Rule], micros: str, since: Mapping[str, int] | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """(rule_id, key, us, seconds, n, trailing, columns) for every rule and every event it selects, from one scan.

    ``since`` (rule_id to microseconds) is each rule's watermark: it reads what came at or after it.  An event that
    no rule selects ends at the scan; a null key is selected by no rule.
    """
    us = F.col(micros).cast("bigint")

    def tag(r: Rule) -> Column:
        chosen = r.where & r.key.isNotNull()
        if since and r.rule_id in since:
            chosen = chosen & (us >= F.lit(since[r.rule_id]))
        own = F.struct(F.lit(r.rule_id).alias("rule_id"), r.key.cast("string").alias("key"), F.lit(r.seconds).alias("seconds"), F.lit(r.n).cast("bigint").alias("limit"), F.lit(r.trailing).alias("trailing"))
        return F.when(chosen, own)

    tags = F.array_compact(F.array(*[tag(r) for r in rules]))
    return events.select(us.alias("us"), *columns, F.explode(tags).alias("t")).select("t.*", "us", *columns)


def run_rules(events: DataFrame, rules: Sequence[Rule], micros: str, since: Mapping[str, int] | None = None, allow: DataFrame | None = None) -> DataFrame:
    """Findings of many rules: rule_id, key, window_start_us, window_end_us, n.

    However many rules there are, windows on the clock are one scan and one aggregation, combined before the shuffle, and
    trailing ones are one scan and one call of ``trailing_totals``, which splits a busy key by time.  ``allow`` (rule_id, key) names what is not reported.
    """
    if len({r.rule_id for r in rules}) < len(rules):
        raise ValueError("two rules have one id")
    if not rules:
        raise ValueError("no rules")
    fixed, moving, parts = [r for r in rules if not r.trailing], [r for r in rules if r.trailing], []
    if fixed:
        tagged = tagged_events(events, fixed, micros, since)
        step = F.col("seconds").cast("bigint") * 1_000_000
        counted = tagged.groupBy("rule_id", "key", "seconds", "limit", (F.col("us") - F.pmod("us", step)).alias("window_start_us")).agg(F.count(F.lit(1)).alias("n"))
        hot = counted.where(F.col("n") > F.col("limit"))
        parts.append(hot.select("rule_id", "key", "window_start_us", (F.col("window_start_us") + step).alias("window_end_us"), "n"))
    if moving:
        # One pass per window length; the rules of a length share it.
        tagged = tagged_events(events, moving, micros, since).withColumn("who", F.struct("rule_id", "key"))
        spans = sorted({r.seconds for r in moving})
        totals = trailing_totals(tagged, "who", "us", {f"w{s}": s for s in spans}, inclusive=True)
        n = F.coalesce(*[F.when(F.col("seconds") == s, F.col(f"count_w{s}")) for s in spans])
        hot = totals.withColumn("n", n).where(F.col("n") > F.col("limit"))
        start = F.col("us") - F.col("seconds").cast("bigint") * 1_000_000
        parts.append(hot.select("rule_id", "key", start.alias("window_start_us"), F.col("us").alias("window_end_us"), "n"))
    found = reduce(DataFrame.union, parts)
    if allow is not None:
        found = found.join(allow.select("rule_id", F.col("key").cast("string").alias("key")), ["rule_id", "key"], "left_anti")
    return found


def next_watermarks(events: DataFrame, rules: Sequence[Rule], micros: str, now_us: int) -> DataFrame:
    """(rule_id, last_event_us, last_run_us) to store after a run: the newest event each rule selected, if any."""
    newest = tagged_events(events, rules, micros).groupBy("rule_id").agg(F.max("us").alias("last_event_us"))
    all_rules = events.sparkSession.createDataFrame([(r.rule_id,) for r in rules], "rule_id string")
    return all_rules.join(newest, "rule_id", "left").withColumn("last_run_us", F.lit(now_us).cast("bigint"))


def threshold_trailing(
    events: DataFrame, where: Column, key: str, micros: str, seconds: int, n: int, allow: DataFrame | None = None
) -> DataFrame:
    """Events that are the last of more than n within the trailing time (t - w, t]."""
    chosen = events.where(where)
    if allow is not None:
        chosen = chosen.join(allow.select(key), key, "left_anti")
    counted = trailing_totals(chosen, key, micros, {"n": seconds}, inclusive=True)
    return counted.where(F.col("count_n") > n).withColumnRenamed("count_n", "n")


def confidence(
    df: DataFrame, base: int = 55, corroboration_bonus: int = 30, single_source_penalty: int = -10,
    privileged_bonus: int = 10, critical_bonus: int = 10,
) -> DataFrame:
    """Adds ``terms`` (each contribution), ``confidence_score`` within 1..100 and its band.

    Reads single_source, is_privileged and is_asset_critical.
    """
    terms = F.struct(
        F.lit(base).alias("base"),
        F.when(F.col("single_source"), single_source_penalty).otherwise(corroboration_bonus).alias("corroboration"),
        F.when(F.col("is_privileged"), privileged_bonus).otherwise(0).alias("privileged"),
        F.when(F.col("is_asset_critical"), critical_bonus).otherwise(0).alias("critical"),
    )
    total = F.col("terms.base") + F.col("terms.corroboration") + F.col("terms.privileged") + F.col("terms.critical")
    scored = df.withColumn("terms", terms).withColumn(
        "confidence_score", F.greatest(F.lit(1), F.least(F.lit(100), total))
    )
    return scored.withColumn("confidence_band", L.confidence_band("confidence_score"))


def finding_id(rule: Column, window_start: Column, key: Column) -> Column:
    """The same finding has the same id at every run."""
    return sha256(F.concat(rule, window_start, key))


def rule_windows(state: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """What each rule has to read: from its last run, less its timeframe (5 min at least) and window."""
    lookback = F.greatest(F.col("timeframe_s"), F.lit(300)) + F.col("corroboration_s")
    return rules.join(state.select("rule_id", "last_run_at"), "rule_id", "left").select(
        "rule_id",
        lookback.cast("int").alias("lookback_s"),
        F.timestamp_add("SECOND", -lookback.cast("int"), F.coalesce("last_run_at", now)).alias("read_from"),
        now.alias("read_to"),
    )


def finding_links(findings: DataFrame, events: DataFrame, key: str, ts: str, window: str) -> DataFrame:
    """Each finding with every artefact of its key and window, once."""
    placed = events.select(F.col(key), F.window(ts, window)["start"].alias("window_start"), "artefact_id")
    return placed.join(findings.select(key, "window_start", "finding_id"), [key, "window_start"]).select(
        "finding_id", "artefact_id"
    ).distinct()


def detection_run(
    events: DataFrame, rule: str, where: Column, key: str, ts: str, window: str, n: int, entities: DataFrame, sources: Sequence[str],
    known: DataFrame | None = None, allow: DataFrame | None = None, source: str = "source_system",
) -> tuple[DataFrame, DataFrame]:
    """(new findings, their evidence links) of one rule over a batch of events.

    A key with more than ``n`` selected events in a window is a finding; it is corroborated if the window also holds events of
    the key from a listed source that the rule did not select.  ``entities`` (key, is_privileged, is_asset_critical) adds to
    its confidence.  Findings whose id ``known`` has are left out.  ``events`` needs artefact_id and the source column.
    """
    hot = threshold_rule(events, where, key, ts, window, n, allow)
    other = events.where(F.col(source).isin(*sources) & ~F.coalesce(where, F.lit(False)))
    seen = other.groupBy(key, F.window(ts, window)["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("matches"))
    about = entities.groupBy(key).agg(F.max("is_privileged").alias("is_privileged"), F.max("is_asset_critical").alias("is_asset_critical"))
    found = hot.join(seen, [key, "window_start"], "left").join(about, key, "left").withColumns(
        {
            "rule": F.lit(rule),
            "matches": F.coalesce("matches", F.lit(0).cast("bigint")),
            "is_privileged": F.coalesce("is_privileged", F.lit(False)),
            "is_asset_critical": F.coalesce("is_asset_critical", F.lit(False)),
            "finding_id": finding_id(F.lit(rule), F.unix_micros(F.col("window_start").cast("timestamp")).cast("string"), F.col(key).cast("string")),
        }
    )
    scored = confidence(found.withColumn("single_source", F.col("matches") == 0)).drop("terms")
    if known is not None:
        scored = scored.join(known.select("finding_id").distinct(), "finding_id", "left_anti")
    return scored, finding_links(scored, events.where(where), key, ts, window)


def rule_precision(findings: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Per rule: true and false positives closed in the trailing days, and their ratio."""
    recent = findings.where(
        (F.col("closed_at") >= as_of - F.make_dt_interval(F.lit(days))) & (F.col("closed_at") < as_of)
    )
    tp = F.count_if(F.col("disposition") == "true_positive")
    fp = F.count_if(F.col("disposition") == "false_positive")
    out = recent.groupBy("rule_id").agg(tp.alias("tp"), fp.alias("fp"))
    return out.withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")))


# --- report ------------------------------------------------------------------------------


def case_report(
    case_id: str, cases: DataFrame, findings: DataFrame, links: DataFrame, items: DataFrame, custody: DataFrame
) -> dict[str, DataFrame]:
    """The tables of a case report, each a flat table sorted for reading.

    findings: finding_id, case_id, single_source, ...; links: finding_id,
    artefact_id; items: artefact_id, case_id, ...; custody: artefact_id, ...
    """
    mine = findings.where(F.col("case_id") == case_id)
    held = items.where(F.col("case_id") == case_id)
    events = custody.groupBy("artefact_id").agg(F.count(F.lit(1)).alias("custody_events"))
    inventory = held.join(events, "artefact_id", "left").withColumn(
        "custody_events", F.coalesce("custody_events", F.lit(0).cast("bigint"))
    )
    evidence = mine.select("finding_id").join(links, "finding_id").join(held.drop("case_id"), "artefact_id")
    return {
        "header": cases.where(F.col("case_id") == case_id),
        "timeline": evidence.drop("finding_id").distinct().orderBy("collected_at_utc", "artefact_id"),
        "findings": mine.where(~F.col("single_source")).orderBy("finding_id"),
        "finding_evidence": evidence.select("finding_id", "artefact_id", "sha256").orderBy("finding_id", "artefact_id"),
        "inventory": inventory.orderBy("artefact_id"),
        "custody": custody.join(held.select("artefact_id"), "artefact_id", "left_semi").orderBy("artefact_id", "event_time_utc"),
        "suppressed": mine.where(F.col("single_source")).orderBy("finding_id"),
    }


# What each distribution class does to a tagged column: keep, mask or drop.
REDACTION = {
    "internal_ir_only": {"contact": "keep", "network": "keep", "demographic": "drop"},
    "hr_handover": {"contact": "mask", "network": "drop", "demographic": "drop"},
    "legal_counsel": {"contact": "mask", "network": "drop", "demographic": "drop"},
    "external_regulator": {"contact": "drop", "network": "drop", "demographic": "drop"},
}


def redact(
    df: DataFrame, distribution: str, tags: Mapping[str, str], subject: str | None = None,
    subject_ref: str = "subject_ref", policy: Mapping[str, Mapping[str, str]] = REDACTION,
) -> DataFrame:
    """Tagged columns kept, masked or nulled for a class; the subject always becomes its reference."""
    if distribution not in policy:
        raise ValueError(f"unknown distribution class {distribution!r}")
    rules, changes = policy[distribution], {}
    for col, tag in tags.items():
        how = rules.get(tag, "drop")
        if how == "mask":
            value = F.col(col)
            changes[col] = F.when(value.isNull(), None).when(F.contains(value, F.lit("@")), redact_email(value)).otherwise(F.mask(value))
        elif how == "drop":
            changes[col] = F.lit(None).cast(df.schema[col].dataType)
    if subject:
        changes[subject] = F.col(subject_ref)
    return df.withColumns(changes) if changes else df
