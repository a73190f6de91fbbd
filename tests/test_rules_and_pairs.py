"""Interval pairs and rule sets against plain Python, with one key that holds a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from watchfold import scale as S
from watchfold.operators import detection as D


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(4_000_000_000), rng.choice("abcd")) for i in range(900)]
    out += [(900 + i, "hot", 2_000_000_000 + i % 3, "a" if i % 2 else "b") for i in range(60)]  # a burst, and ties
    return out + [(2000, None, 5, "a"), (2001, "hot", None, "b"), (2002, "hot", 0, None)]


@pytest.fixture(scope="module")
def events(spark, rows):
    return spark.createDataFrame(rows, "id INT, k STRING, us BIGINT, kind STRING").repartition(4)


@pytest.mark.parametrize("limit", [10_000, 20, 3])
def test_pairs_near(events, rows, limit):
    got = sorted((r.l.id, r.r.id) for r in S.pairs_near(events, events.where("kind <> 'd'"), "k", "us", 30, rows=limit).collect())
    known = [(i, k, t) for i, k, t, _ in rows if k is not None and t is not None]
    right = {i for i, *_, kind in rows if kind is not None and kind != "d"}
    assert got == sorted((i, j) for i, k, t in known for j, q, u in known if j in right and k == q and abs(t - u) <= 30_000_000)


def test_pairs_count_as_many_as_corroboration(events):
    sources = ["a", "b", "c"]
    pairs = D.corroborating_events(events, events, "id", "id", "k", "us", "kind", sources, 60)
    counted = {r.id: r.matches for r in D.corroborate(events.where("kind is not null"), events, "id", "k", "us", "kind", sources, 60).collect() if r.matches}
    assert {r.id: r["count"] for r in pairs.join(events.where("kind is not null"), "id").groupBy("id").count().collect()} == counted
    assert len(counted) > 50


def test_evidence_links_name_each_artefact_once(spark):
    own = spark.createDataFrame([("f1", 1), ("f1", 2), ("f2", 3)], "finding_id STRING, event_id INT")
    pairs = spark.createDataFrame([(1, 2), (1, 9), (2, 9), (3, 9), (7, 8)], "event_id INT, corroborating_id INT")
    got = sorted(tuple(r) for r in D.evidence_links(own, pairs, "event_id").collect())
    assert got == [("f1", 1, "hit"), ("f1", 2, "hit"), ("f1", 9, "corroborating"), ("f2", 3, "hit"), ("f2", 9, "corroborating")]


def brute(rows, rules, since=None):
    out = []
    for name, chosen, seconds, n, trailing in rules:
        own = [(k, t) for _, k, t, kind in rows if k is not None and t is not None and kind and kind in chosen and t >= (since or {}).get(name, 0)]
        step = seconds * 1_000_000
        if trailing:
            for k, t in own:
                c = sum(q == k and t - step < u <= t for q, u in own)
                if c > n:
                    out.append((name, k, t - step, t, c))
        else:
            for k, w in {(k, t - t % step) for k, t in own}:
                c = sum(q == k and u - u % step == w for q, u in own)
                if c > n:
                    out.append((name, k, w, w + step, c))
    return sorted(out)


RULES = [("r1", "ab", 600, 3, False), ("r2", "abcd", 60, 2, False), ("r3", "c", 600, 1, True), ("r4", "abcd", 1200, 12, True), ("r5", "z", 60, 0, False)]


def rules():
    return [D.Rule(name, F.col("kind").isin(list(chosen)), F.col("k"), s, n, trailing) for name, chosen, s, n, trailing in RULES]


def test_rule_set_equals_each_rule(spark, events, rows):
    known = events.where("us is not null")
    assert sorted(tuple(r) for r in D.run_rules(known, rules(), "us").collect()) == brute(rows, RULES)
    since = {"r1": 1_500_000_000, "r4": 3_000_000_000}
    assert sorted(tuple(r) for r in D.run_rules(known, rules(), "us", since).collect()) == brute(rows, RULES, since)
    allow = spark.createDataFrame([("r1", "hot"), ("r4", "hot")], "rule_id STRING, key STRING")
    want = [x for x in brute(rows, RULES) if (x[0], x[1]) not in {("r1", "hot"), ("r4", "hot")}]
    assert sorted(tuple(r) for r in D.run_rules(known, rules(), "us", allow=allow).collect()) == want
    assert D.run_rules(known.limit(0), rules(), "us").collect() == []


def test_fifty_rules_are_one_scan(spark, tmp_path, events):
    events.where("us is not null").write.parquet(str(tmp_path / "events"))
    stored = spark.read.parquet(str(tmp_path / "events"))
    many = [D.Rule(f"r{i}", F.col("id") % 50 == i, F.col("k"), 60 * (i + 1), 1) for i in range(50)]
    plan = D.run_rules(stored, many, "us")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_watermarks_are_each_rules_own(events, rows):
    got = {r.rule_id: r.last_event_us for r in D.next_watermarks(events.where("us is not null"), rules(), "us", 7).collect()}
    for name, chosen, *_ in RULES:
        own = [t for _, k, t, kind in rows if k is not None and t is not None and kind and kind in chosen]
        assert got[name] == (max(own) if own else None)
    with pytest.raises(ValueError):
        D.run_rules(events, rules() + rules(), "us")
