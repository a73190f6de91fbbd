"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward rows."""

import hashlib
import itertools
import os
import random
import re
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import oracle  # noqa: E402
from watchfold.llm import chat, decontam, exact_dedup, ngram_join, packing, pii, quality, sharding, toxicity, urlrules  # noqa: E402
from watchfold.llm.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CLASH = "doc_id bigint, text string, lang string, id string, norm string, label int, shard int, class int, n int"


def documents(spark, rows):
    """Rows (doc_id, text) with a language and columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", None, 7, 3, 9, None) for i, t in rows], CLASH)


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(ORACLES))
def test_equals_sql(spark, con, name):
    assert oracle.compare(QUERIES[name](spark, FOLDER), ORACLES[name], con) == []


# n-gram Jaccard join


def shingles(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components_of(rows):
    sets, low = [shingles(t) for _, t in rows], [i for i, _ in rows]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return sorted((i, len(s), c) for (i, _), s, c in zip(rows, sets, low))


def near_copies(seed, groups=4, size=30):
    """Copies of a base text with 0 to 5 words changed, so that many are alike only through the base or a chain."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((12, 60, 150)))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
            rows.append((len(rows) * 3 + 1, " ".join(words)))
    return rows


def test_ngram_join_is_exact_on_hard_groups(spark):
    rows = near_copies(1)
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One two"), (1004, "one  TWO"), (1005, "two one"), (1006, "É é"), (1007, "é é")]
    rows += [(1010, rows[0][1].upper()), (1011, " ".join(f"u{k}" for k in range(30_000))), (1012, " ".join(f"u{k}" for k in range(28_000)))]
    got = ngram_join.jaccard_components(spark, documents(spark, rows).repartition(5))
    assert sorted(map(tuple, got.collect())) == components_of(rows)


def test_ngram_join_packs_shingles_of_many_batches_together(spark):
    rows = [(i, " ".join(f"v{i}_{k}" for k in range(30))) for i in range(400)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10")
    try:
        pieces = ngram_join._pieces(documents(spark, rows).coalesce(2), "text", 5, 6).collect()
    finally:
        spark.conf.set(key, before)
    assert len(pieces) <= 2 * 6  # not 6 for each batch of 10 texts
    assert sum(len(p["keys"]) // 6 for p in pieces) == 400 * 26 and {len(p["counts"]) for p in pieces} == {len(p["sizes"]) for p in pieces}


def test_ngram_join_compares_no_copy_that_is_too_far_with_a_large_group():
    # one list: 3,000 copies in one component that meet there among their first few shingles, 1,000 others that meet there too late for any
    n = np.full(4000, 396)
    labels = np.append(np.zeros(3000, np.int64), np.arange(1, 1001))
    place = np.append(np.full(3000, 20), np.full(1000, 60))
    limits = (n - place) * 7 // 3 - n
    one = np.zeros(1, np.int64), np.array([4000])
    assert sum(len(i) for i, _ in ngram_join._across(*one, n, limits, labels, None, 3, 4)) == 0
    # those that may be alike are all met, also beyond what is held at once
    limits[3990:] = 396
    got = {(min(x, y), max(x, y)) for i, j in ngram_join._across(*one, n, limits, labels, None, 3, 4) for x, y in zip(i.tolist(), j.tolist())}
    assert got == {(x, y) for x in range(3000) for y in range(3990, 4000)} | {(x, y) for x in range(3990, 4000) for y in range(x + 1, 4000)}


@pytest.mark.parametrize("seed", [3, 4])
def test_ngram_join_is_exact_among_copies_of_uneven_lengths(spark, seed):
    rng, rows = random.Random(seed), []
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    for i in range(150):  # cut at either end, with words of their own, some of them shared by a few
        words = base[rng.randrange(12) : 120 - rng.randrange(25)]
        for _ in range(rng.randrange(9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    got = ngram_join.jaccard_components(spark, documents(spark, rows).repartition(3))
    want = components_of(rows)
    assert len({c for _, _, c in want}) > 5
    assert sorted(map(tuple, got.collect())) == want


def test_ngram_join_keeps_repeated_and_nameless_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (7, "q r")]
    got = {tuple(r) for r in ngram_join.jaccard_components(spark, documents(spark, rows)).collect()}
    assert got == {(5, 2, 5), (None, 2, 5), (None, 1, None), (7, 1, 7)}
    assert ngram_join.jaccard_components(spark, documents(spark, [])).collect() == []
    kept = ngram_join.keep_one(spark, documents(spark, [(1, "a b c"), (2, "a b c"), (3, None), (4, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4] and kept.columns == documents(spark, []).columns


# exact deduplication


def test_exact_dedup_over_two_batches(spark):
    index = exact_dedup.fresh_index(spark)
    first = documents(spark, [(4, "a b"), (2, "ab"), (9, "a  b"), (3, None), (1, ""), (8, "É"), (8, "É")])
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(spark, first, index).collect()}
    assert got == {(4, 9, 3, False), (2, 9, 3, False), (9, 9, 3, True), (3, 1, 2, False), (1, 1, 2, True), (8, 8, 2, True), (8, 8, 2, False)}  # of equal rows one stays
    second = documents(spark, [(1, "AB"), (6, "a\nb   "), (5, "new")])
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.deduplicate(spark, second, index).collect()}
    assert got == {(1, 1, True), (6, 9, False), (5, 5, True)}
    assert index.read().count() == 5
    plan = index.new(exact_dedup.groups(exact_dedup.digests(second)))._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.lower()
    assert exact_dedup.deduplicate(spark, documents(spark, []), index).collect() == []
    assert index.read().count() == 5


# decontamination


def test_decontamination_on_hard_texts(spark):
    long = " ".join(f"k{n}" for n in range(40))
    tests = spark.createDataFrame([(1, long), (2, "Tiny item"), (10, None), (3, "..."), (4, long.upper()), (5, "tiny")], "item_id bigint, text string")
    docs = documents(spark, [
        (1, "before " + long.replace(" ", ", ") + " after"), (2, "a tiny, ITEM here"), (3, None), (4, ""), (5, " ".join(long.split()[:12])),
        (6, "pad " * 400 + " ".join(long.split()[5:18])), (7, "É tiny"), (8, "tiny tiny item"),
    ])
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination(spark, docs, tests).collect()}
    assert got == {
        1: (42, 40, 2, True), 2: (4, 2, 2, True), 3: (0, 0, 0, False), 4: (0, 0, 0, False), 5: (12, 0, 0, False),
        6: (413, 13, 2, False), 7: (2, 1, 1, True), 8: (3, 3, 2, True),
    }
    assert decontam.contamination(spark, documents(spark, []), tests).collect() == []
    assert [r.n_hit for r in decontam.contamination(spark, docs.limit(1), tests.where("item_id > 99")).collect()] == [0]
    sha = {r.doc_id: r.items_sha256 for r in decontam.contamination(spark, docs, tests).collect()}
    assert sha[1] == hashlib.sha256(b"1,4").hexdigest() and sha[3] == hashlib.sha256(b"").hexdigest()


def test_decontamination_of_repeated_ids(spark):
    phrase = [f"w{n}" for n in range(13)]
    tests = spark.createDataFrame([(1, " ".join(phrase)), (2, "lone")], "item_id bigint, text string")
    dirty = (1, "before " + " ".join(phrase))
    # w0 is the rarest term, w1 the next: both texts of id 5 have w1 alone at its place.
    rows = [dirty, dirty, (2, "lone"), (2, "lone"), (5, "a w1 b"), (5, "c w1 d"), (6, " ".join(phrase)), (6, "other words"), (9, " ".join(phrase[2:] * 3))]
    rows += [(10 + n, "w1") for n in range(2)]
    docs = documents(spark, rows)
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination(spark, docs, tests).collect() if r.doc_id < 9)
    assert got == [
        (1, 14, 13, 1, True), (1, 14, 13, 1, True), (2, 1, 1, 1, True), (2, 1, 1, 1, True), (5, 3, 0, 0, False), (5, 3, 0, 0, False), (6, 2, 13, 1, True), (6, 13, 13, 1, True),
    ]
    assert {r.doc_id for r in decontam.keep_clean(spark, docs, tests).collect()} == {5, 9, 10, 11}


def test_proximity(spark):
    tokens = decontam.token_store(spark, documents(spark, [(1, "a x b y c"), (2, "a x x x x b c"), (3, "c b a"), (4, None)]))
    wanted = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c")], "query string, term string")
    got = decontam.proximity_matches(tokens, wanted, 4).collect()
    assert {r.id for r in got} == {1, 3}


# packing


def test_packing_round_trip(spark):
    rng = random.Random(2)
    rows = [(n, " ".join(rng.choice(("alpha", "Beta,", "ça", "don't", "42", "été.", "<|", "zyx")) for _ in range(rng.randrange(900)))) for n in range(120)]
    rows += [(500, None), (501, ""), (502, "É" * 3000), (502, "twice"), (None, "nameless"), (503, "a\x1cb Σας <|endoftext|> x")]
    got = [r.asDict() for r in packing.pack(spark, documents(spark, rows).repartition(6)).collect()]
    encode = packing.WordPieces(packing.tokenizer_path()).whole.encode
    want = {}
    for name, text in rows:
        want.setdefault(name, []).append(encode(text or "", add_special_tokens=False).ids + [1])
    for name, docs in want.items():
        own = sorted((r for r in got if r["doc_id"] == name), key=lambda r: (r["doc_tokens"], r["start"]))
        assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == [x for d in sorted(docs, key=len) for x in d]
        assert all(len(r["ids"]) == 4 * r["length"] for r in own)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    used = sum(length for p in sequences.values() for _, length in p)
    assert len(sequences) * packing.CAPACITY < 1.05 * used + packing.CAPACITY
    assert packing.pack(spark, documents(spark, [])).collect() == []


@pytest.mark.parametrize("length", [1, 2, 31, 1000, 1024, 1025, 2047, 2048, 2049, 10_000])
def test_cuts_fill_reciprocal_classes(length):
    cut = packing.cuts(length)
    assert sum(n for n, _ in cut) == length
    assert all(n * k <= 2048 and (2048 // k - n) * packing.WASTE <= 2048 // k for n, k in cut)


def test_fast_ids_equal_the_tokenizer():
    rng, pieces = random.Random(1), packing.WordPieces(packing.tokenizer_path())
    letters = "abcdefgÉéßüÜñç0123456789'.,!?-_@#%|&*()<>/\\ \n\t😀中文\u0301\u200bª²Ⅷ—…“”sStTrRvVeEmMlLdD \x1c\x85Σ"
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert np.frombuffer(pieces.ids(text), "<u4").tolist() == pieces.whole.encode(text, add_special_tokens=False).ids


# sharding


@pytest.mark.parametrize("n, shards", [(0, 16), (5, 16), (1000, 16), (1003, 7), (300, 1)])
def test_bounded_loads(spark, n, shards):
    got = sharding.assign(spark, documents(spark, [(k, "t") for k in range(n)]), shards, nodes=8, cells=256).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert len(got) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_overflow_walks_clockwise():
    rng = random.Random(4)
    owners = [rng.randrange(4) for _ in range(32)]
    counts = {c: rng.randrange(9) for c in range(32)}
    limits = sharding.bounds(sum(counts.values()), 4)
    room, want = list(limits), {}
    for first in (True, False):  # key by key
        for cell in range(32):
            for rank in range(counts[cell]):
                if (cell, rank) in want:
                    continue
                at = cell
                while not first and not room[owners[at]]:
                    at = (at + 1) % 32
                if room[owners[at]]:
                    room[owners[at]] -= 1
                    want[cell, rank] = owners[at]
    runs = sharding.walk(counts, owners, limits)
    got = {}
    for cell, n in counts.items():
        for rank in range(n):
            got[cell, rank] = max((r for r in runs if r.cell == cell and r.lo <= rank), key=lambda r: r.lo).shard
    assert got == want


def test_sharding_moves_little_and_takes_odd_rows(spark):
    rows = [(k, None if k % 3 else "é") for k in range(2000)] + [(None, "x")] * 3 + [(7, "x")] * 5
    a = {r.doc_id: r for r in sharding.shard_documents(spark, documents(spark, rows), 16).collect() if r.doc_id is not None}
    b = {r.doc_id: r for r in sharding.shard_documents(spark, documents(spark, rows), 17).collect() if r.doc_id is not None}
    assert sum(a[k].shard != b[k].shard for k in a) < 0.5 * len(a)
    assert a[3].size == 3 and a[3].text_crc32 == zlib.crc32("é".encode()) and a[1].size == 1 and a[1].text_crc32 == 0


# URL rules


def test_url_rules_against_every_rule(spark):
    rng = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "org", "x.org", "A.Com:80"]
    rules = list({(rng.choice(hosts[:6]), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(4))), rng.choice(("allow", "block"))) for _ in range(60)})
    urls = [f"h://{rng.choice(hosts)}/{''.join(rng.choice('ab/?#') for _ in range(rng.randrange(7)))}" for _ in range(300)]
    urls += [None, "", "no scheme", "x://", "http://a.com", "http://a.com?/b", "//a.com/", "a://b://a.com/ab", "x" * 100_000, "h://" + "a." * 5_000 + "com/" + "b" * 50_000]
    verdicts = {}
    for h, p, v in rules:
        verdicts[h, p] = max(v, verdicts.get((h, p), v))

    def brute(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.lower()
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in verdicts.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    table = spark.createDataFrame([(n, u, "old") for n, u in enumerate(urls)], "page_id int, url string, verdict string")
    given = spark.createDataFrame(rules, "host string, path string, verdict string")
    for block in (1000, 7):  # one block, and many
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(spark, table, given, block=block).collect()}
        assert got == {n: brute(u) for n, u in enumerate(urls)}
    assert {r.verdict for r in urlrules.judge(spark, table, given.limit(0), default="block").collect()} == {"block"}
    assert urlrules.judge(spark, table.limit(0), given).collect() == []


# personal data


def test_base_spans_are_the_contracts():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(text):
        for kind, pattern in patterns.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m[0])
                if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "card" and not (12 <= len(digits) <= 19 and pii.luhn(digits))) or (kind == "phone" and not 9 <= len(digits) <= 15):
                    continue
                yield kind, *m.span()

    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@+ -()23%_4/5.0\né") for _ in range(rng.randrange(50)))
        assert sorted(pii.base_spans(text)) == sorted(brute(text))
    assert [k for k, *_ in pii.base_spans("x" * 10**6 + "1" * 10**6 + "a@b.c")] == ["email"]


def test_labelers_agree_on_reliabilities():
    """Votes of four labelers of known skill: posteriors find the labels better than any labeler alone."""
    rng, patterns, truth = random.Random(5), {}, []
    for _ in range(20_000):
        y = rng.random() < 0.4
        vote = tuple((1 if y else -1) if rng.random() < skill else (-1 if y else 1) for skill in (0.95, 0.7, 0.65, 0.6))
        truth.append((y, (2, vote)))
        patterns[2, vote] = patterns.get((2, vote), 0) + 1
    post, table = pii.reliabilities(patterns)
    assert np.mean([(post[k] > 0.5) == y for y, k in truth]) >= 0.94
    assert abs(table[1, 1, 2] - 0.7) < 0.05


def test_pii_rows(spark):
    text = "Mail a.b@c.org or bob [at] site [dot] com, ip 10.0.0.1, card 4111 1111 1111 1111, call +1 (303) 555-1234. é x@y.de"
    rows = documents(spark, [(1, text), (2, None), (3, ""), (1, text)])
    got = {r.doc_id: r for r in pii.digest(pii.detect(spark, rows)).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (2, 1, 1, 1) and got[2].spans == got[3].spans == ""
    for span in got[1].spans.split(","):
        kind, a, b = span.split(":")
        assert kind in pii.KINDS and text[int(a) : int(b)].strip() == text[int(a) : int(b)]
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.detect(spark, documents(spark, [])).collect() == []


# toxicity


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(1)
    for length in (1, 2, 5, 7):
        for _ in range(20):
            bias, moves = rng.normal(), rng.normal(size=(2, 2))
            at = np.sort(rng.choice(length, rng.integers(1, length + 1), replace=False))
            score = rng.normal(size=len(at)) * 2
            node = np.full(length, bias)
            node[at] = score
            weight, share = 0.0, np.zeros(length)
            for path in itertools.product((0, 1), repeat=length):
                w = np.exp(sum(node[k] for k, s in enumerate(path) if s) + sum(moves[a, b] for a, b in zip(path, path[1:])))
                weight += w
                share += w * np.array(path)
            assert np.allclose(toxicity.marginals(at, score, length, bias, moves), (share / weight)[at])


def test_toxicity_on_unseen_documents(spark):
    rng = random.Random(6)
    plain = [f"word{chr(97 + n % 26)}{chr(97 + n // 26)}" for n in range(300)]
    rows, labels = [], []
    for n in range(900):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        if n % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = "Vile" + rng.choice(("st", "ness", "ly"))
        rows.append((n, " ".join(words)))
        labels.append((n, int(n % 5 == 0)))
    rows += [(2000, None), (2001, ""), (2002, "12 34"), (2003, "vilest " * 5000), (2003, "vilest " * 5000)]
    docs = documents(spark, rows)
    field = toxicity.train(spark, docs, spark.createDataFrame(labels + [(None, 1), (1, None)], "doc_id bigint, toxic int"))
    got = toxicity.score(spark, docs, field).collect()
    scored = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    unseen = [n for n, _ in labels if zlib.crc32(str(n).encode()) % 3 == 1]
    assert all(scored[n].held_out for n in unseen)
    assert np.mean([scored[n].predicted == (n % 5 == 0) for n in unseen]) > 0.97
    assert scored[2000].predicted == scored[2001].predicted == scored[2002].predicted == 0 and scored[2003].predicted == 1
    text = dict(rows)
    assert all(text[r.doc_id][s.start : s.end].lower().startswith("vile") for r in got for s in r.spans)
    assert toxicity.score(spark, documents(spark, []), field).collect() == []


def test_toxicity_scale_does_not_depend_on_the_cap(spark, monkeypatch):
    docs = documents(spark, [(n, "plain words only") for n in range(600)])
    labels = spark.createDataFrame([(n, int(n % 6 == 0)) for n in range(600)], "doc_id bigint, toxic int")
    whole = toxicity.train(spark, docs, labels)
    for most in (150, 20):  # cuts the clean class; cuts both
        monkeypatch.setattr(toxicity, "SAMPLE", most)
        cut = toxicity.train(spark, docs, labels)
        assert np.allclose(cut.scale, whole.scale, atol=1e-3) and abs(cut.bias - whole.bias) < 0.05
    known = [int(n % 6 == 0) for n in range(600) if zlib.crc32(str(n).encode()) % 3 != 1]
    assert abs(1 / (1 + np.exp(-whole.scale[0])) - np.mean(known)) < 0.01


# quality


def brute_kneser_ney(texts):
    """P of every n-gram by the textbook recursion over dictionaries."""
    size, counts = 257, {}
    for t in texts:
        symbols = (0,) * (quality.ORDER - 1) + tuple(b + 1 for b in t.encode())
        for k in range(len(symbols) - quality.ORDER + 1):
            gram = symbols[k : k + quality.ORDER]
            counts[gram] = counts.get(gram, 0) + 1
    levels = {quality.ORDER: counts}
    for order in range(quality.ORDER - 1, 0, -1):
        levels[order] = {}
        for gram in levels[order + 1]:
            levels[order][gram[1:]] = levels[order].get(gram[1:], 0) + 1

    def discount(order):
        n = [sum(v == k for v in levels[order].values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        return [0] + [min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1)]

    discounts = {order: discount(order) for order in levels}

    def p(gram):
        order = len(gram)
        if not order:
            return 1 / size
        own = {g: n for g, n in levels[order].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total, d = sum(own.values()), discounts[order]
        rest = sum(d[min(n, 3)] for n in own.values()) / total
        n = own.get(gram, 0)
        return (n - d[min(n, 3)]) / total + rest * p(gram[1:]) if n else rest * p(gram[1:])

    return p


@pytest.mark.parametrize("block, shard_rows, turn", [(8 << 20, 200_000, 256), (40, 1, 1)])
def test_kneser_ney_equals_the_recursion(spark, monkeypatch, block, shard_rows, turn):
    """Perplexities of whole texts, in one block and in many, against dictionaries."""
    for name, value in (("BLOCK", block), ("SHARD_ROWS", shard_rows), ("TURN", turn)):
        monkeypatch.setattr(quality, name, value)
    texts = ["the cat. The mat", "a cat, a hat!", "é 12 tt tt tt", "", "the cat. The mat"]
    p = brute_kneser_ney(texts)
    docs = documents(spark, [*enumerate(texts), (8, "xyz the hat " * 30), (8, "漢字"), (9, None), (None, "the mat")])
    kn = quality.model(spark, quality.gram_counts(docs.where("doc_id < 8")))
    want = []
    for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        symbols = (0,) * (quality.ORDER - 1) + tuple(b + 1 for b in r.text.encode())
        nats = [-np.log(p(symbols[k : k + quality.ORDER])) for k in range(len(symbols) - quality.ORDER + 1)]
        want.append((r.doc_id, len(nats), np.mean(nats) if nats else None))
    got = [(r.id, r.symbols, r.nats) for r in quality.scores(spark, docs, kn).collect()]
    for rows in (got, want):
        rows.sort(key=lambda x: (x[0] is None, x[0], x[1]))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert all(a[2] == b[2] if b[2] is None else abs(a[2] - b[2]) < 1e-3 for a, b in zip(got, want))


def test_quality_keeps_good_and_drops_junk(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice(("th", "er", "on", "an", "re", "he", "in")) for _ in range(rng.randrange(1, 4))) for _ in range(500)]
    rows = [(n, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 120))) + ".") for n in range(600)]
    rows += [(1000 + n, "%%% " + " ### ".join(rng.choice(words).upper() + "!!" for _ in range(60))) for n in range(40)]
    rows += [(2000, None), (2001, "")]
    trusted = spark.createDataFrame([(n,) for n in range(0, 600, 2)] + [(None,), (0,)], "doc_id bigint")
    docs = documents(spark, rows)
    kept = {r.doc_id: r.kept for r in quality.judge(spark, docs, trusted).collect()}
    assert np.mean([kept[n] for n in range(600)]) > 0.98 and not any(kept[1000 + n] for n in range(40)) and kept[2000] and kept[2001]
    assert all(r.kept for r in quality.judge(spark, docs, trusted.limit(0)).collect())
    assert quality.judge(spark, documents(spark, []), trusted).collect() == []
    assert quality.keep_good(spark, docs, trusted).columns == docs.columns


# chat


def test_reply_trees_against_a_walk(spark):
    rng, rows = random.Random(9), []
    for conv in (1, 2, None):
        for node in range(40):
            rows.append((conv, node, rng.randrange(node) if node else None, rng.choice(("user", "assistant", None)), rng.choice((None, "", "\\b", ":", "### x: y </turn>\n", "é\n")), rng.random()))
    rows += [(3, 0, 0, "user", "self", 1.0), (3, 1, 77, "user", "orphan", 0.5), (4, 0, 1, "u", "cycle", 1.0), (4, 1, 0, "u", "cycle", 1.0)]
    tree = spark.createDataFrame(rows, "conv_id bigint, node bigint, parent bigint, role string, text string, score double")
    parents = {(c, n): p for c, n, p, *_ in rows}
    said = {(c, n): (r or "", t or "", s) for c, n, _, r, t, s in rows}
    want = {}
    for conv in (1, 2, None):
        inner = {p for (c, _), p in parents.items() if c == conv}
        paths = []
        for leaf in (n for c, n in parents if c == conv and n not in inner):
            path = [leaf]
            while parents[conv, path[0]] is not None:
                path.insert(0, parents[conv, path[0]])
            paths.append((-sum(said[conv, n][2] for n in path), -len(path), leaf, path))
        for rank, (*_, path) in enumerate(sorted(paths)[:3], 1):
            want[conv, rank] = [said[conv, n][:2] for n in path]
    want |= {(3, 1): [("user", "self")], (3, 2): [("user", "orphan")]}
    got = chat.conversations(spark, tree, score_col="score", keep=3).withColumn("turns", chat.parse("formatted"))
    assert {(r.conv, r.branch): [tuple(t) for t in r.turns] for r in got.collect()} == want
    assert chat.conversations(spark, tree.limit(0)).collect() == []


def test_long_chain_is_one_conversation(spark):
    turns = spark.createDataFrame([(1, n, "user" if n % 2 == 0 else "assistant", f"t{n}") for n in range(300)] + [(2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "assistant", None)], "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.conversations(spark, chat.chain(turns))).collect()}
    assert (got[1].n_turns, got[2].n_turns, got[2].loss_chars) == (300, 3, 0)
    assert got[1].loss_sha256 == hashlib.sha256("".join(f"t{n}" for n in range(1, 300, 2)).encode()).hexdigest()


# the pipeline


def test_pipeline(spark):
    """Every stage against a plainer version of its rule; documents keep their columns until they are packed."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, left = docs.columns, docs
    trusted = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").select("doc_id")
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r.text for r in left.collect()}
        out = stage(spark, left, FOLDER)
        if name == "packing":
            tokens = {r.doc_id: r.doc_tokens for r in out.collect()}
            assert set(tokens) == set(rows)
            continue
        assert out.columns == columns
        out = spark.createDataFrame(out.collect(), out.schema)
        kept = {r.doc_id for r in out.collect()}
        if name == "quality classifier":
            assert kept == {r.doc_id for r in quality.judge(spark, left, trusted).collect() if r.kept} and len(kept) > 0.7 * len(rows)
        elif name == "exact dedup":
            best = {}
            for i, t in rows.items():
                key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
                best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i)) if key in best else (-len(t or ""), i)
            assert kept == {i for _, i in best.values()}
        elif name == "n-gram jaccard join":
            assert kept == {i for i, _, c in components_of(sorted(rows.items())) if i == c}
        else:
            words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
            windows = set()
            for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
                w = words(r.text)
                windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} if w else set()
            dirty = set()
            for i, t in rows.items():
                w = words(t)
                hit = {x for n in {len(q) for q in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for x in range(k, k + n)}
                if hit and 20 * len(hit) >= len(w):
                    dirty.add(i)
            assert kept == set(rows) - dirty
        left = out


def test_all_queries_give_rows(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, FOLDER).count() > 0
