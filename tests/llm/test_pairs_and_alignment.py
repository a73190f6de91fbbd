"""Spelling variants, token alignment and embedding near copies against brute force, and on awkward rows."""

import collections
import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from watchfold.llm import alignment, embedding_dedup, spelling  # noqa: E402

CLASH = "doc_id bigint, text string, word string, n int, row int, best string, pairs int"


def documents(spark, pairs):
    """Rows with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "w", 1, 2, "b", 3) for i, t in pairs], CLASH)


# spelling variants


def edits(a, b):
    """Whether two words are one inserted, deleted or replaced letter apart."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows, noise=31):
    import re

    n = collections.Counter()
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if edits(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def spelling_rows():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randrange(6, 11))) for _ in range(60)]

    def bent(w):
        at, how = rng.randrange(len(w)), rng.randrange(3)
        return w[:at] + ("" if how == 0 else rng.choice("abcéÿ×")) + w[at + (how < 2) :]

    chain = ["abcdefgh", "abcdefgx", "abcdefyx"]  # each ten times rarer than the one before
    words = [bent(rng.choice(base)) if rng.random() < 0.4 else rng.choice(base) for _ in range(2500)]
    words += ["hotword"] * 1500 + ["hotwort"] * 150 + [chain[0]] * 500 + [chain[1]] * 50 + [chain[2]] * 5 + ["aaaaaaaa", "aaaaaaab"] * 2
    rows = [(i, " ".join(w.upper() if i % 5 == 0 else w for w in words[k::40])) for i, k in enumerate(range(40))]
    return rows + [(900, None), (901, ""), (902, "x" * 30_000 + " " + "x" * 30_001), (903, "x" * 30_000 + ". " + "x" * 30_001), (None, "hotword HOTWORD"), (3, rows[3][1])]


@pytest.mark.parametrize("sample, cell, block", [(100_000, 400_000, 4), (500, 300, 4), (500, 300, 0.05)])
def test_spelling_variants_equal_brute_force(spark, sample, cell, block):
    """In one cell, in many, and with every cell split into blocks."""
    rows = spelling_rows()
    for noise in (31, 2):
        got = spelling.group_variants(spark, documents(spark, rows), noise=noise, sample=sample, cell=cell, block=block)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in got.collect()) == variants(rows, noise)
    assert spelling.group_variants(spark, documents(spark, [])).collect() == []


def test_one_edit():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(n)) for n in (7, 8) for _ in range(60)]
    for a in (7, 8):
        one, two = [w for w in words if len(w) == a], [w for w in words if len(w) == 8]
        pairs = [(x, y) for x in one for y in two]
        met = spelling.one_edit(spelling.letters([x for x, _ in pairs]), spelling.letters([y for _, y in pairs]))
        assert met.tolist() == [edits(x, y) for x, y in pairs]


# alignment


def test_galloping_equals_a_set_intersection():
    rng = random.Random(9)
    for size in (0, 1, 5, 300):
        for other in (0, 1, 7, 2000):
            a, b = sorted(rng.sample(range(3000), size)), sorted(rng.sample(range(3000), other))
            assert alignment.common_ends(a, b) == [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]


def aligned(rows, tool):
    out, links_of, df = [], [], collections.Counter()
    for i, text in rows:
        said, links, digest = " " + (text or ""), [], ""
        ids_a, ids_b = tool.a.encode(said, add_special_tokens=False).ids if text else [], tool.b.encode(text) if text else []
        a, b = [tool.bytes_a[x] for x in ids_a], [tool.bytes_b[x] for x in ids_b]
        n_groups = 0
        if not text or b"".join(a) != said.encode() or b"".join(b) != said.encode():
            ids_a = ids_b = []
        else:
            ends_a, ends_b = np.cumsum([len(x) for x in a]).tolist(), np.cumsum([len(x) for x in b]).tolist()
            links = [(ids_a[x], ids_b[y]) for x in range(len(a)) for y in range(len(b)) if ends_a[x] - len(a[x]) < ends_b[y] and ends_b[y] - len(b[y]) < ends_a[x]]
            shown, before = [], 0
            for end in sorted(set(ends_a) & set(ends_b)):
                side = lambda ids, ends: ",".join(str(x) for x, e in zip(ids, ends) if before < e <= end)  # noqa: B023, E731
                shown.append(side(ids_a, ends_a) + "|" + side(ids_b, ends_b))
                before = end
            n_groups, digest = len(shown), hashlib.sha256(";".join(shown).encode()).hexdigest()
        out.append([i, len(ids_a), len(ids_b), n_groups, len(links), digest])
        links_of.append(links)
        df.update(set(links))
    top = collections.defaultdict(int)
    for (x, _), n in df.items():
        top[x] = max(top[x], n)
    return [(*o[:5], sum(df[p] == top[p[0]] for p in links), sum(df[p] for p in links), o[5]) for o, links in zip(out, links_of)]


def test_alignment_equals_brute_force(spark, monkeypatch):
    import public_tokenizers

    tool = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    parts = [*"abcTHE    \n\t.,'s0123²ßéñ漢字🙂\x1c\x85 　​▁<|>e", "<|endoftext|>", "<s>", "  ", "'re", "don't", "\r\n", "the ", "tion ", "́", "\x00", "\x01", "<0x41>", "᠎", "﻿", "한국", "नमस्ते"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(50)))) for i in range(250)]
    rows += [(500, None), (501, ""), (502, " "), (503, "a "), (505, "a  b"), (7, "rep"), (7, "rep"), (None, "x"), (506, "the cat " * 800), (507, "Donaudampfschiff" * 100)]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    want = sorted(aligned(rows, tool), key=key)
    for hot in (1 << 18, 5, 0):
        got = alignment.align(spark, documents(spark, rows), hot=hot)
        assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert alignment.align(spark, documents(spark, [])).collect() == []


def test_remembered_cuts_change_nothing(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(alignment, "_CUTS", 3)
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    few, tool = alignment.Aligner(*paths), alignment.Aligner(*paths)
    for text in ("one two three four five", "two three", "five six. seven", "one two three four five"):
        a, b = few.align(text), aligned([(1, text)], tool)[0]
        assert tuple(a[0]) == b[1:5] and hashlib.sha256(a[1]).hexdigest() == b[7]


# embedding near copies


def linked(ids, vectors, cosine=0.9):
    known = [x is not None and len(x) > 0 and None not in x and bool(np.isfinite(np.array(x, float)).all()) and any(x) for x in vectors]
    links = {i: set() for i in range(len(ids))}
    for dim in {len(vectors[i]) for i in links if known[i]}:
        at = [i for i in links if known[i] and len(vectors[i]) == dim]
        unit = np.array([vectors[i] for i in at], np.float64)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        for p, q in zip(*np.nonzero(unit @ unit.T >= cosine)):
            if p != q:
                links[at[p]].add(at[q])
    low = list(range(len(ids)))
    for i in links:
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low[i] = min(ids[j] for j in seen)
    return sorted((ids[i], len(links[i]), low[i], ids[i] == low[i]) for i in links)


def vectors():
    """Pairs away from the cosine on either side, a crowd, a third of the rows equal, and vectors that link with nothing."""
    rng = np.random.default_rng(1)
    out = [list(x) for x in rng.standard_normal((150, 16))]
    for i in range(40):
        c, unit, side = rng.choice([0.8, 0.86, 0.93, 0.99]), np.array(out[i]) / np.linalg.norm(out[i]), rng.standard_normal(16)
        side -= side @ unit * unit
        out.append(list(3 * (c * unit + np.sqrt(1 - c * c) * side / np.linalg.norm(side))))
    out += [out[0]] * 150 + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1e-30] * 16, [1e30] * 16, [2.0] * 8, [1.0] * 8, [-0.0] + [1.0] * 15, [0.0] + [1.0] * 15]
    centre = rng.standard_normal(16)
    out += [list(centre + 0.1 * rng.standard_normal(16)) for _ in range(80)]
    return [None if x is None else [None if y is None else float(np.float32(y)) for y in x] for x in out]


@pytest.mark.parametrize("options", [{}, {"cell": 32, "crowd": 20, "unit": 40}, {"cell": 32, "crowd": 10**9, "unit": 16}])
def test_near_copies_equal_brute_force(spark, options):
    """Alone, with crowds, and with crowded cells cut into units; every link is far enough from the threshold to be found."""
    values = vectors()
    df = spark.createDataFrame([(i, x, 1, "c", 2) for i, x in enumerate(values)], "vec_id bigint, embedding array<float>, label int, class string, row int").repartition(3)
    got = embedding_dedup.near_copies(spark, df, **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == linked(list(range(len(values))), values)


def test_near_copies_recall_at_the_cosine(spark):
    """Of pairs at 0.9 to 0.92, in many cells, at least 95 % are found, and nothing below 0.9."""
    rng, rows = np.random.default_rng(6), []
    for _ in range(400):
        a, b = rng.standard_normal((2, 24))
        a /= np.linalg.norm(a)
        b -= b @ a * a
        c = rng.uniform(0.9001, 0.92)
        rows += [a, c * a + np.sqrt(1 - c * c) * b / np.linalg.norm(b)]
    rows = [[float(x) for x in r] for r in rows]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_copies(spark, df, cell=64).collect()}
    want = {i: n for i, n, *_ in linked(list(range(len(rows))), rows)}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.95 * sum(want.values())
    assert embedding_dedup.near_copies(spark, df.limit(0)).collect() == []


def test_counts_are_calibrated():
    p = 0.98758  # of a normal deviation within 2.5
    rng = np.random.default_rng(0)
    least = embedding_dedup.least_count(32)
    assert (rng.binomial(32, p, 200_000) >= least).mean() >= 0.9985 and (rng.binomial(32, p, 200_000) >= least + 1).mean() < 0.999
    for n in (10, 10_000, 10**7):
        size, count = embedding_dedup.bundles(n)
        near = embedding_dedup._same_interval(embedding_dedup.WIDTH) ** size
        assert 1 - (1 - near) ** count >= embedding_dedup.MEET
