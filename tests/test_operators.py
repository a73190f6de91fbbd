"""Boundary tables, golden outcomes and invariants."""

import hashlib
import hmac
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from watchfold import constants as K
from watchfold.functions import hashing as H, levels as L, text as T
from watchfold.operators import evaluation as V, features as X, ledger as E, moderation as M, urlscan as U
from watchfold.operators.moderation import Term
from watchfold.sources.sink import append_new


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(col.alias("x")).first().x


@pytest.mark.parametrize(
    "score,action",
    [(0, "pass"), (25, "pass"), (50, "pass"), (51, "review"), (60, "review"), (70, "review"), (71, "block"), (80, "block"), (95, "block"), (100, "block")],
)
def test_score_action(spark, score, action):
    assert one(spark, L.score_action("s"), s=score) == action


@pytest.mark.parametrize(
    "name,score,action",
    [("VERY_UNLIKELY", 10, "pass"), ("UNLIKELY", 30, "pass"), ("POSSIBLE", 60, "review"), ("LIKELY", 80, "block"), ("VERY_LIKELY", 95, "block"), ("UNKNOWN", 55, "review"), ("else", 55, "review")],
)
def test_likelihood(spark, name, score, action):
    s = L.score_likelihood("n")
    assert one(spark, F.struct(s.alias("s"), L.score_action(s).alias("a")), n=name) == (score, action)


@pytest.mark.parametrize(
    "text,image,final",
    [("pass", None, "pass"), ("false_positive", None, "pass"), ("true_positive", None, "block"), ("flagged_fallback", None, "block"),
     ("pass", "review", "review"), ("pass", "block", "block"), ("true_positive", "review", "block"), ("false_positive", "pass", "pass")],
)
def test_combine(spark, text, image, final):
    df = spark.createDataFrame([(text, image)], "t STRING, i STRING")
    assert df.select(M.combine_actions("t", "i").alias("x")).first().x == final


@pytest.mark.parametrize(
    "raw,verdict,rationale",
    [('{"verdict": "TRUE_POSITIVE", "rationale": "r"}', "TRUE_POSITIVE", "r"), ('{"verdict": "false_positive"}', "FALSE_POSITIVE", ""),
     ("not json", "TRUE_POSITIVE", None), ('{"verdict": "UNSURE"}', "TRUE_POSITIVE", None), ('["x"]', "TRUE_POSITIVE", None)],
)
def test_parse_verdict(spark, raw, verdict, rationale):
    row = M.parse_verdict(spark.createDataFrame([(raw,)], "raw STRING"), "raw").first()
    assert row.verdict == verdict
    assert row.rationale == rationale if rationale is not None else row.rationale.startswith("unreadable")


def test_bands_and_severity(spark):
    bands = {39: "weak", 40: "mixed", 69: "mixed", 70: "strong", 89: "strong", 90: "multi_source"}
    for score, band in bands.items():
        assert one(spark, L.confidence_band("s"), s=score) == band
    assert one(spark, L.severity(F.lit("critical"), [(F.lit(True), 1)])) == "critical"
    assert one(spark, L.severity(F.lit("low"), [(F.lit(True), -1), (F.lit(True), 2), (F.lit(False), 1)])) == "high"
    assert one(spark, L.decision_tier("p", 0.116), p=0.2) == "block"


GOLDEN = [
    ("clean", "nothing here", None, "pass", "pass"),
    ("research", "a talk about phish kits", "FALSE_POSITIVE", "false_positive", "pass"),
    ("offer", "fresh dumps for sale", None, "true_positive", "block"),
    ("victim", "I was a phish victim", "FALSE_POSITIVE", "false_positive", "pass"),
    ("unsure", "Phish!", None, "flagged_fallback", "block"),
    ("sold", "phish pages sold", "TRUE_POSITIVE", "true_positive", "block"),
    ("empty", "", None, "pass", "pass"),
    ("blank", " \n\t ", None, "pass", "pass"),
    ("null", None, None, "pass", "pass"),
    ("inside", "phishing and phish_er", None, "pass", "pass"),
]


def test_golden_messages(spark):
    msgs = spark.createDataFrame([g[:2] for g in GOLDEN], "message_name STRING, text STRING")
    verdicts = spark.createDataFrame([(g[0], g[2], "why") for g in GOLDEN if g[2]], "message_name STRING, verdict STRING, rationale STRING")
    terms = [Term("hard", "dumps for sale", "phrase"), Term("soft", "phish", "word")]
    out = M.decisions(M.text_verdict(M.keyword_scan(msgs, "text", terms, "message_name"), "text", verdicts))
    got = {r.message_name: (r.text_result, r.final_action) for r in out.collect()}
    assert got == {g[0]: g[3:] for g in GOLDEN}


WORDS = ["ab", "c++", "c#", "#tag", "été", "_x", "n1", "a.b", "x"]
PHRASES = ["d e", "f ", "g h i j"]
TEXTS = [
    "ab c++x c++ c#y #tag x#tag été l'été1 _x n1 a.b axb x", "AB d e", "f", "f g h i j", "xx abc ab_", "c++", "", "ÉTÉ; x-a.b.c",
    "c#", "c# d", "1#tag", "g h i", "d  e", "é x é",
]


def python_scan(text, words, phrases):
    low = text.lower()
    found = [w for w in words if re.search(r"\b" + re.escape(w) + r"\b", low, re.I)]
    return found + [p for p in phrases if p in low]


@pytest.mark.parametrize("large", [False, True])
def test_keyword_scan_equals_word_boundaries(spark, large):
    terms = [("hard", i, w, "word") for i, w in enumerate(WORDS)] + [("hard", 100 + i, p, "phrase") for i, p in enumerate(PHRASES)]
    terms += [("soft", 200, "ab", "word")]
    table = spark.createDataFrame(terms, "tier STRING, ord BIGINT, term STRING, kind STRING")
    msgs = spark.createDataFrame(list(enumerate(TEXTS)), "id INT, text STRING")
    out = M.keyword_scan(msgs, "text", table if large else [Term(tier, term, kind) for tier, _, term, kind in terms], "id")
    for r in out.collect():
        assert list(r.hard_terms) == python_scan(TEXTS[r.id], WORDS, PHRASES), TEXTS[r.id]
        assert list(r.soft_terms) == python_scan(TEXTS[r.id], ["ab"], [])
        assert list(r.all_terms) == list(dict.fromkeys([*r.hard_terms, *r.soft_terms]))


def test_long_term_table(spark):
    table = spark.range(2_005).select(
        F.lit("soft").alias("tier"), F.col("id").alias("ord"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("term"), F.lit("word").alias("kind")
    )
    msgs = spark.createDataFrame([(1, "t7 and T2003"), (2, "none"), (3, None)], "id INT, text STRING")
    got = {r.id: list(r.soft_terms) for r in M.keyword_scan(msgs, "text", table, "id").collect()}
    assert got == {1: ["t7", "t2003"], 2: [], 3: []}


@pytest.mark.parametrize("size", [1, 3, 40, 400])
def test_terms_that_begin_alike_meet_few_texts(spark, size):
    """Any number of terms with one beginning and hard texts of the same letters, against plain search."""
    rng = random.Random(size)
    heads = ["the offer ", "the offer-", "the c+", "é🙂"]
    terms = sorted({rng.choice(heads) + "".join(rng.choice("xyz +") for _ in range(rng.randrange(1, 4))) for _ in range(size)} | {"z", "yx", "+ "})
    kinds = [("soft" if i % 2 else "hard", i, t, "phrase" if i % 3 else "word") for i, t in enumerate(terms)]
    texts = ["".join(rng.choice(["the offer ", "The Offer-", "x", "y", "z", " ", "+", "the c+", "É🙂"]) for _ in range(rng.randrange(0, 14))) for _ in range(150)] + ["the offer x" * 30] * 75
    msgs = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING").repartition(3)
    table = spark.createDataFrame(kinds, "tier STRING, ord BIGINT, term STRING, kind STRING")
    for r in M.keyword_scan(msgs, "text", table, "id").collect():
        for tier, got in (("hard", r.hard_terms), ("soft", r.soft_terms)):
            words = [t for x, _, t, k in kinds if x == tier and k == "word"]
            assert list(got) == python_scan(texts[r.id], words, [t for x, _, t, k in kinds if x == tier and k == "phrase"]), texts[r.id]
    low = msgs.select(F.lower("text").alias("low"))
    lows = [t.lower() for t in texts]
    for r in M.rarest_pieces(low, "low", table, one_in=1).collect():
        if r.re is not None:
            held = lambda p: sum(p in t for t in lows)
            runs = [r.term[i : i + 3] for i in range(len(r.term) - 2)] or [r.term]
            assert held(r.piece) == min(map(held, runs))


def test_the_scan_is_one_plan_at_every_size(spark):
    msgs = spark.createDataFrame([(1, "a b c")], "id INT, text STRING")

    def shape(n):
        table = spark.range(n).select(F.lit("soft").alias("tier"), F.col("id").alias("ord"), F.col("id").cast("string").alias("term"), F.lit("word").alias("kind"))
        plan = M.keyword_scan(msgs, "text", table, "id")._jdf.queryExecution().analyzed().toString()
        return [re.match(r"\W*(\w+)", line)[1] for line in plan.splitlines()]

    assert shape(1) == shape(100_000)


def test_canonical_json_and_hmac(spark):
    payload = {"b": "ü \" \\ / \n\t\x1f\x0b \\u001F", "a": None, "c": "x"}
    df = spark.createDataFrame([(payload["b"], payload["a"], payload["c"])], "b STRING, a STRING, c STRING")
    row = df.select(H.canonical_json(["b", "a", "c"]).alias("j"), H.payload_sha256(["c", "a", "b"]).alias("h"), H.hmac_sha256(b"key" * 40, "c").alias("m")).first()
    want = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert row.j == want
    assert row.h == hashlib.sha256(want.encode()).hexdigest()
    assert row.m == hmac.new(b"key" * 40, b"x", hashlib.sha256).hexdigest()


@pytest.mark.parametrize("email,masked", [("ab@x.y", "**@x.y"), ("abc@x.y", "a*c@x.y"), ("", ""), (None, ""), ("a", "*@"), ("alice.b@c@d", "a*****b@c@d")])
def test_redact_email(spark, email, masked):
    df = spark.createDataFrame([(email,)], "e STRING")
    assert df.select(T.redact_email("e").alias("x")).first().x == masked


def test_display_name(spark):
    for email, name in (("jane.van-dyke@x", "Jane Van-Dyke"), ("o'neil3rd@x", "O'Neil3Rd"), ("ÉLAN.x@y", "Élan X")):
        assert one(spark, T.display_name("e"), e=email) == name


def custody_rows(spark, n):
    rows = [(f"e{i:04d}", f"a{i % 3 if i % 2 else 0}", "accessed", "me", None, "h", f"p{i} ü", f"2024-01-01T{i // 60:02d}:{i % 60:02d}:00.000+00:00") for i in range(n)]
    return spark.createDataFrame(rows, "event_id STRING, artefact_id STRING, event_type STRING, actor STRING, actor_ip STRING, host STRING, purpose STRING, event_time_utc STRING").repartition(7)


def test_chain_replays_and_a_flipped_byte_is_found(spark):
    events = custody_rows(spark, 300)
    chain = E.build_chain(events)
    rows = chain.collect()
    chain = spark.createDataFrame(rows, chain.schema).repartition(4)
    assert all(r.ok for r in E.replay_chain(chain).collect())
    per_key = sorted((r for r in rows if r.artefact_id == "a0"), key=lambda r: r.event_id)
    prev = K.ZERO_HASH
    for r in per_key:
        body = {k: r[k] for k in ("event_id", "artefact_id", "event_type", "actor", "actor_ip", "host", "purpose", "event_time_utc")}
        text = json.dumps({**body, "prev_event_hash": prev}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert (r.prev_event_hash, r.this_event_hash) == (prev, hashlib.sha256(text.encode()).hexdigest())
        prev = r.this_event_hash
    victim = per_key[40].event_id
    changed = chain.withColumn("purpose", F.when(F.col("event_id") == victim, "x").otherwise(F.col("purpose")))
    bad = [r for r in E.replay_chain(changed).collect() if not r.ok]
    assert [(r.artefact_id, r.first_break, r.break_kind) for r in bad] == [("a0", victim, "hash")]
    gone = chain.where(F.col("event_id") != victim)
    bad = [r for r in E.replay_chain(gone).collect() if not r.ok]
    assert [(r.artefact_id, r.break_kind) for r in bad] == [("a0", "link")]


def test_append_twice_adds_nothing(spark):
    df = spark.createDataFrame([(f"d{i % 50}", i) for i in range(200)], "doc_id STRING, at INT")
    fresh, counts = append_new(df, None, "doc_id", "at")
    assert counts.first().asDict() == {"records_in": 200, "created": 50, "duplicates": 150}
    again, counts = append_new(df, fresh, "doc_id", "at")
    assert again.count() == 0 and counts.first().duplicates == 200


def test_split_is_whole_and_exact(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = V.stratified_split(df, "id", "y", {"train": 0.7, "calibrate": 0.1, "test": 0.2})
    assert {(r.split, r.y): r["count"] for r in got.groupBy("split", "y").count().collect()} == {
        ("train", 0): 630, ("train", 1): 70, ("calibrate", 0): 90, ("calibrate", 1): 10, ("test", 0): 180, ("test", 1): 20,
    }


def test_psi_of_itself_is_zero_and_few_edges_give_zero(spark):
    df = spark.range(500).select((F.col("id") % 97).cast("double").alias("a"), F.lit(1.0).alias("b"))
    got = {r.feature: r.psi for r in V.psi(df, df, ["a", "b"]).collect()}
    assert got == {"a": 0.0, "b": 0.0}


def test_capacity_falls_back_to_the_cheapest(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 1.0), (0, 0.2), (0, 1.0)], "y INT, p DOUBLE")
    curve = V.cost_curve(df, "y", "p", days=1.0)
    assert [r.threshold for r in curve.orderBy("threshold", "closing").collect()] == [0.2, 0.9, 1.0, 1.0]
    fits = V.capacity_threshold(curve, 2).first()
    assert (fits.threshold, fits.flagged, fits.within_capacity) == (1.0, 2, True)
    none = V.capacity_threshold(curve, 1).first()
    best = V.cheapest_threshold(curve).first()
    assert (none.threshold, none.within_capacity) == (best.threshold, False) == (0.9, False)
    closing = curve.where("closing = 1").first()
    assert (closing.precision, closing.recall, closing.flagged, closing.fn, closing.cost) == (1.0, 0.0, 2, 1, 426.0)


def test_worst_frame_fallbacks(spark):
    rows = [("a", 0, None), ("a", 1, "UNLIKELY"), ("a", 2, "UNLIKELY"), ("b", 0, None), ("b", 1, None)]
    frames = spark.createDataFrame(rows, "attachment_id STRING, frame_idx INT, likelihood STRING")
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "attachment_id STRING")
    got = {r.attachment_id: (r.image_score, r.image_action, r.frames_scored) for r in M.worst_frame(frames, fallback="block", attachments=listed).collect()}
    assert got == {"a": (30, "pass", 3), "b": (None, "block", 2), "c": (None, "block", 0)}


def test_tree_of_any_depth(spark):
    def nest(depth):
        leaf = {"type": "url", "url": f"http://d{depth}", "name": ""}
        if depth == 0:
            return leaf
        return {"type": "folder", "name": "f", "children": [leaf, "junk", {"type": "other"}, nest(depth - 1)]}

    tree = json.dumps({"roots": {"other": nest(120), "unknown": nest(2), "synced": "x"}})
    df = spark.createDataFrame([(1, tree), (2, "not json"), (3, None), (4, "{}")], "id INT, j STRING")
    got = U.flatten_tree(df, "j").collect()
    assert sorted(r.url for r in got) == sorted([f"http://d{d}" for d in range(121)])
    assert {r.root for r in got} == {"other"} and max(r.depth for r in got) == 120 and all(r.title is None for r in got)


def test_digest_keeps_every_line(spark):
    rows = [("big@x.y", f"http://{i}", "t", "removed") for i in range(500)] + [("a.b@x.y", "http://z", None, "failed"), (None, "u", "t", "removed")]
    out = spark.createDataFrame(rows, "email STRING, url STRING, title STRING, action_taken STRING")
    notices, rest = U.notification_digest(out, "email", 100)
    got = notices.collect()
    big = [r for r in got if r.email == "big@x.y"]
    assert len(big) == 5 and sum(r.item_list.count("http://") for r in big) == 500
    small = [r for r in got if r.email == "a.b@x.y"]
    assert [(r.item_list, r.display_name) for r in small] == [("- http://z (not removed)\n  http://z", "A B")]
    assert rest.count() == 1


def test_missing_product_is_not_risky(spark):
    df = spark.createDataFrame([(None, 600.0, "S"), (3.0, 600.0, "S"), (3.0, 600.0, None), (6.9, 500.0, "S")], "age DOUBLE, amount DOUBLE, product STRING")
    got = [(r.new_acct_flag, r.new_acct_highval_express, r.addr_age_days) for r in X.interactions(df, "age", "amount", "product").collect()]
    assert got == [(0, 0, 365.0), (1, 1, 3.0), (1, 0, 3.0), (1, 0, 6.9)]


def test_many_words_are_cut_into_tokens(spark):
    words = WORDS + [f"filler{i}" for i in range(64)]
    msgs = spark.createDataFrame(list(enumerate(TEXTS)), "id INT, text STRING").withColumn("low", F.lower("text"))
    for r in msgs.select("id", M.scan_words(F.col("low"), words).alias("x")).collect():
        assert list(r.x) == python_scan(TEXTS[r.id], words, [])


def test_canonical_document(spark):
    docs = [{"b": [1, {"z": None, "a": "ü\n"}], "a": {"y": True, "x": "/"}, "": -7}, [], {"k": "A"}]
    df = spark.createDataFrame([(i, json.dumps(d, indent=2)) for i, d in enumerate(docs)] + [(9, "{no")], "i INT, j STRING")
    got = {r.i: r.x for r in df.select("i", H.canonical_document("j").alias("x")).collect()}
    assert got.pop(9) is None
    assert got == {i: json.dumps(d, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for i, d in enumerate(docs)}


def test_moderate_sends_broken_payloads_aside(spark):
    def body(i, text):
        return json.dumps({"message": {"name": f"spaces/s/messages/{i}", "text": text, "sender": {"name": f"users/{i}"}}})

    kind = K.MESSAGE_CREATED
    rows = [(kind, body(1, "all fine")), (kind, body(2, "bad word")), ("other", body(3, "bad word")), (kind, "{oops"), (kind, body(5, ""))]
    pushed = spark.createDataFrame(rows, "kind STRING, body STRING")
    people = spark.createDataFrame([("2", "two@x.y")], "user_id STRING, email STRING")
    full = spark.createDataFrame([("spaces/s/messages/5", "users/9", "bad too")], "message_name STRING, sender STRING, text STRING")
    done, dead = M.moderate(pushed, "kind", "body", [Term("hard", "bad", "word")], F.current_timestamp(), people, full=full)
    got = {r.message_name[-1]: (r.sender_email, r.final_action, r.case_id is not None) for r in done.collect()}
    assert got == {"1": ("users/1", "pass", False), "2": ("two@x.y", "block", True), "5": ("users/5", "block", True)}
    assert [r.body for r in dead.collect()] == ["{oops"]


def test_worker_functions_need_no_installed_package(tmp_path):
    """A Python worker that cannot import this package still gets the function."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from watchfold.streaming import flows

    for thing in (E._fold, flows._Velocity({"1h": 3600}, 60), flows._Corroboration(5)):
        code = "import sys; from pyspark import cloudpickle; cloudpickle.loads(sys.stdin.buffer.read()); assert 'watchfold' not in sys.modules"
        done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(thing), cwd=tmp_path, capture_output=True, env={"PATH": "/usr/bin:/bin"})
        assert done.returncode == 0, done.stderr.decode()[-500:]
