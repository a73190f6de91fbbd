"""Everything known about one user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from watchfold.functions.text import redact_email

__all__ = ["lookup_violations", "lookup_hits", "timeline", "lookup_counts", "redact_email"]


def lookup_violations(violations: DataFrame, username: str | None = None, email: str | None = None) -> DataFrame:
    """Violations of a user name or (case aside) an e-mail, oldest first; neither given, none."""
    hit: Column = F.lit(False)
    if username:
        hit = hit | (F.col("os_username") == username)
    if email:
        hit = hit | F.col("chrome_email").ilike(email)
    return violations.where(hit).orderBy("detected_at_utc", "violation_id")


def lookup_hits(hits: DataFrame, runs: DataFrame, username: str | None) -> DataFrame:
    """The user's entity hits with stage, status and window of their run, oldest first."""
    mine = hits.where((F.col("entity_id") == F.lit(username)) & (F.col("entity_type") == "user"))
    run = runs.select(
        "run_id", F.col("stage").alias("pipeline_stage"), F.col("status").alias("pipeline_status"), "watermark_start", "watermark_end"
    )
    return mine.join(run, "run_id").orderBy("matched_at_utc", "event_id")


def timeline(violations: DataFrame, hits: DataFrame) -> DataFrame:
    """Both kinds of row under one another in order of time, each with its label."""
    v = violations.select(
        F.col("detected_at_utc").alias("at"),
        F.lit("bookmark_violations").alias("source"),
        F.format_string("BOOKMARK_VIOLATION  pattern=%s  action=%s  host=%s", "pattern_name", "action_taken", "hostname").alias("label"),
    )
    h = hits.select(
        F.col("matched_at_utc").alias("at"),
        F.lit("entity_hits").alias("source"),
        F.format_string("ENTITY_HIT  source=%s  event_id=%s  stage=%s", "source_system", "event_id", "pipeline_stage").alias("label"),
    )
    both = v.unionByName(h).withColumn("ts", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return both.orderBy("at", "source", "label")


def lookup_counts(violations: DataFrame, hits: DataFrame) -> DataFrame:
    """One row with the number of rows of each kind, for the audit entry."""
    n = hits.agg(F.count(F.lit(1))).scalar()
    return violations.agg(F.count(F.lit(1)).alias("violations")).withColumn("entity_hits", n)
