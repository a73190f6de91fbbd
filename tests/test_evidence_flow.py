"""Evidence from request to verified access, and the bookmark run that preserves before it removes."""

import hashlib
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from watchfold.constants import ZERO_HASH
from watchfold.operators import ledger as E, urlscan as U

CASE = "11111111-2222-3333-4444-555555555555"
AT = "2024-05-06T07:08:09Z"
SCHEMA = """request_id STRING, case_id STRING, source_system STRING, collection_method STRING, query STRING, collector_principal STRING,
    collected_at_utc STRING, original_tz STRING, content STRING, mime_type STRING, retention_class STRING"""


def requests(spark, rows):
    full = [(i, c, "doc.store", "api", "q", "svc", at, "UTC", body, "text/plain", kind) for i, c, at, body, kind in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(CASE,), (CASE,), (None,)], "case_id STRING")


def test_every_request_is_recorded_or_rejected_at_its_first_fault(spark, cases):
    rows = [
        ("a", CASE, AT, "text", "standard_7y"),
        ("b", CASE, AT, None, "legal_hold"),
        ("c", None, "bad", "x", "none"),
        ("d", "other", AT, "x", "standard_7y"),
        ("e", CASE, "bad", "x", "none"),
        ("f", CASE, "bad", "x", "demo_24h"),
        ("g", CASE, None, "x", None),
    ]
    r = E.record_evidence(requests(spark, rows), cases, "s3://v", "k1")
    items = {i.bytes: i for i in r.items.collect()}
    assert {b: i.sha256 for b, i in items.items()} == {4: hashlib.sha256(b"text").hexdigest(), 0: hashlib.sha256(b"").hexdigest()}
    assert items[4].s3_uri == f"s3://v/artefacts/{CASE}/{items[4].artefact_id}" and items[4].signing_key_id == "k1"
    got = {x.request_id: (x.stage, x.reason) for x in r.rejected.collect()}
    assert got == {
        "c": ("case", "case_id:known"), "d": ("case", "case_id:known"), "e": ("retention", "retention_class:known"),
        "f": ("manifest", "collected_at_utc:iso"), "g": ("retention", "retention_class:known"),
    }
    assert {x.target for x in r.audit.collect()} == {i.artefact_id for i in items.values()}


def test_manifest_digest_is_that_of_sorted_json_without_nulls(spark, cases):
    item = E.record_evidence(requests(spark, [("a", CASE, AT, 'é "/', "standard_7y")]), cases, "s3://v", "k1").items.collect()[0].asDict()
    said = item.pop("manifest_sha256")
    told = {k: v for k, v in item.items() if v is not None and k not in ("manifest_uri", "signing_key_id")}
    text = json.dumps(told, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert hashlib.sha256(text.encode()).hexdigest() == said


def test_repeated_batch_and_folder_give_the_same_rows(spark, cases):
    asked = requests(spark, [(str(i), CASE, AT, "same" if i % 3 == 0 else f"text {i}", "standard_7y") for i in range(300)])
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/requests"
    one, two = E.record_evidence(asked, cases, "s3://v", "k1"), E.record_evidence(asked, cases, "s3://v", "k1", folder=folder)
    for a, b in zip(one, two):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert one.items.select("artefact_id").distinct().count() == 300


def test_recorded_verified_read_and_tampered(spark, cases):
    asked = requests(spark, [("a", CASE, AT, "good", "standard_7y"), ("b", CASE, AT, "bad", "standard_7y")])
    r = E.record_evidence(asked, cases, "s3://v", "k1")
    blobs = r.items.select("artefact_id", F.when(F.col("bytes") == 4, "good").otherwise("bed").alias("content"))
    twice = r.items.crossJoin(spark.createDataFrame([("x", "2024-06-02T00:00:00Z"), ("y", "2024-06-01T00:00:00Z")], "request_id STRING, accessed_at_utc STRING"))
    reads = twice.select("artefact_id", "request_id", "accessed_at_utc", F.lit("reader").alias("accessor"), F.lit("audit").alias("purpose"))
    signed = r.items.select("artefact_id", "sha256", F.lit(True).alias("signature_ok"))
    report = E.verify_evidence(reads, r.items, blobs, signed, E.replay_chain(r.events))
    events, audit = E.record_access(report, E.chain_tips(r.events, r.items))
    assert sorted(x.outcome for x in audit.collect()) == ["fail", "fail", "ok", "ok"]
    chain = r.events.unionByName(events)
    replay = {x.artefact_id: x for x in E.replay_chain(chain).collect()}
    assert sorted((x.events, x.ok) for x in replay.values()) == [(1, True), (3, True)]
    assert [x.prev_event_hash for x in chain.where("event_type = 'collected'").collect()] == [ZERO_HASH] * 2
    assert [x.artefact_id for x in E.tampered(r.items, blobs).collect()] == [k for k, x in replay.items() if x.events == 1]


def test_no_requests_no_rows(spark, cases):
    assert [df.count() for df in E.record_evidence(requests(spark, []), cases, "s3://v", "k1")] == [0, 0, 0, 0]


PATTERNS = [("spam", "spam")]


def profile(host, name, email, marks, home=None):
    tree = {"roots": {"bookmark_bar": {"type": "folder", "children": [{"type": "url", "url": u, "name": "n"} for u in marks]}}}
    prefs = {"account_info": [{"email": email}], "homepage_is_newtabpage": home is None, "homepage": home or ""}
    return (host, "os", name, json.dumps(tree), json.dumps(prefs))


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        profile("h1", "p1", "a@corp.example", ["http://spam/1", "http://fine", "http://spam/2"], "http://spam/home"),
        profile("h1", "p2", "b@corp.example", ["http://fine"], "http://spam/home"),
        profile("h2", "p1", "c@else.example", ["http://spam/1"]),
        profile("h2", "p2", "d@corp.example", [f"http://spam/{i}" for i in range(500)]),
        ("h3", "os", "p1", None, None),
    ]
    return spark.createDataFrame(rows, "hostname STRING, os_username STRING, profile_dir STRING, bookmarks_json STRING, preferences_json STRING")


def run(spark, people, **more):
    gone = [("h1", "os", "p1", "http://spam/1", "bookmark"), ("h1", "os", "p2", "http://spam/home", "homepage")]
    removed = spark.createDataFrame(gone, "hostname STRING, os_username STRING, profile_dir STRING, url STRING, item_type STRING")
    none = spark.createDataFrame([], "case_code STRING, case_id STRING")
    return U.guard_run(people, PATTERNS, "corp.example", removed, none, AT, "s3://v", "k1", **more)


def test_guard_run_preserves_profiles_with_bookmarks(spark, people):
    out = run(spark, people, folder=tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    rows = out.violations.collect()
    assert len(rows) == 504 and {r.case_code for r in rows} == {"BG-h1-2024-05-06", "BG-h2-2024-05-06"}
    items = {i.artefact_id: i for i in out.evidence.items.collect()}
    assert len(items) == 2 and out.evidence.rejected.count() == 0 and out.new_cases.count() == 2
    by_text = {hashlib.sha256(p.bookmarks_json.encode()).hexdigest(): (p.hostname, p.profile_dir) for p in people.collect() if p.bookmarks_json}
    for r in rows:
        if r.item_type == "bookmark":
            item = items[r.evidence_artefact_id]
            assert by_text[item.sha256] == (r.hostname, r.profile_dir) and item.case_id == r.case_id
        else:
            assert r.evidence_artefact_id is None
    assert sorted((r.hostname, r.profile_dir, r.url) for r in rows if r.action_taken == "removed") == [
        ("h1", "p1", "http://spam/1"), ("h1", "p2", "http://spam/home"),
    ]
    assert sum(n["count"] for n in out.notices.where("part = 1").collect()) == 504
    assert out.summary.collect()[0].asDict() == {"violations": 504, "removed": 2, "failed": 502, "skipped": 0}


def test_guard_dry_run_records_nothing(spark, people):
    out = run(spark, people, dry_run=True)
    assert out.evidence is None and out.new_cases.count() == 0
    assert {(r.action_taken, r.case_id, r.evidence_artefact_id) for r in out.violations.collect()} == {("skipped", None, None)}


def test_guard_run_over_no_profiles(spark, people):
    out = run(spark, people.limit(0))
    assert out.violations.count() == out.evidence.items.count() == out.notices.count() == 0
