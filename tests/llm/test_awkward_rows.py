"""Rows on which operators were once wrong."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from watchfold.llm import chat, exact_dedup, packing, pii, toxicity  # noqa: E402


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id bigint, text string")


def test_a_batch_run_twice_gives_the_same_rows(spark):
    index = exact_dedup.fresh_index(spark)
    batch = rows(spark, [(1, "a b"), (2, "c"), (3, "ab"), (4, None)])
    first = sorted(r.doc_id for r in exact_dedup.keep_first(spark, batch, index).collect())
    assert first == [1, 2, 4] and sorted(r.doc_id for r in exact_dedup.keep_first(spark, batch, index).collect()) == first
    assert index.read().count() == 3
    later = rows(spark, [(9, "c"), (8, "new"), (7, "c")])
    assert [r.doc_id for r in exact_dedup.keep_first(spark, later, index).collect()] == [8]


def test_rows_that_share_an_id_are_judged_each(spark):
    def kept(pairs):
        return sorted(((r.doc_id, r.text) for r in exact_dedup.keep_first(spark, rows(spark, pairs)).collect()), key=str)

    assert kept([(7, "ab"), (7, "only here"), (3, "a b")]) == [(3, "a b"), (7, "only here")]
    assert kept([(9, "q"), (9, "q"), (None, "z"), (None, "z"), (None, "z")]) == [(9, "q"), (None, "z")]
    assert kept([(5, "x")] * 40 + [(6, "x")] * 20 + [(n, f"t{n}") for n in range(60, 70)]) == sorted([(5, "x"), *((n, f"t{n}") for n in range(60, 70))], key=str)
    assert kept([]) == []


def test_the_query_joins_the_index(spark):
    index = exact_dedup.fresh_index(spark)
    index.prepare("bigint")
    plan = index.new(exact_dedup.groups(exact_dedup.digests(rows(spark, [(1, "a")]))), "b")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


def test_leaves_below_a_cycle_are_on_no_path(spark):
    tree = spark.createDataFrame(
        [(1, 1, 2, "user", "a"), (1, 2, 1, "user", "b"), (1, 3, 1, "user", "c"), (1, 4, 3, "user", "d"), (1, 5, None, "user", "e"), (1, 6, 5, "assistant", "f")],
        "conv_id bigint, node bigint, parent bigint, role string, text string",
    )
    assert sorted((r.leaf, r.node) for r in chat.paths(spark, tree).collect()) == [(6, 5), (6, 6)]


def test_ip_parts_with_many_zeros():
    long = "0" * 30 + "4"
    assert ("ip", 0, 6 + len(long)) in pii.base_spans(f"1.2.3.{long}") and ("ip", 0, 7) in pii.base_spans("0.0.0.0")
    assert not any(k == "ip" for k, *_ in pii.base_spans("1.2.3." + "9" * 30)) and not any(k == "ip" for k, *_ in pii.base_spans("1.2.3.0000256"))


@pytest.mark.parametrize("length", [10, 4096, 70_000, 200_001])
def test_span_ends_of_long_tokens(length):
    gap = np.zeros(256, bool)
    gap[32] = True
    text = np.frombuffer(b"a " + b"x" * length + b" b", np.uint8)
    assert toxicity._token_end(text, 2, gap) == 2 + length and toxicity._token_end(text, len(text) - 1, gap) == len(text)


def test_packing_ids_of_every_code_point():
    words = packing.WordPieces(packing.tokenizer_path())
    points = [chr(c) for c in [*range(0x20000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    for use in ("{0}", "a{0}b {0}", "T{0}. 1{0}2 {0}{0}, '{0}s"):
        texts = [use.format(c) for c in points]
        whole = words.whole.encode_batch(texts, add_special_tokens=False)
        bad = [hex(ord(c)) for c, t, w in zip(points, texts, whole) if words.ids(t) != np.array(w.ids, "<u4").tobytes()]
        assert bad == []
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(chr(rng.choice([rng.randrange(0x250), rng.randrange(33, 127), 32])) for _ in range(30))
        assert words.ids(text) == np.array(words.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), ascii(text)


def test_rows_reach_workers_in_batches_of_bounded_bytes(spark):
    """Finding "pipeline": all long texts of a partition came as one Arrow batch, twice in an executor's memory."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from watchfold.llm import quality
    from watchfold.llm.common import BATCH

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    key, text = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20
    docs = spark.range(0, 24, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), text // 3).alias("text"), F.lit("en").alias("lang"))
    trusted = spark.range(3).select(F.col("id").alias("doc_id"))
    for operator in (lambda: quality.judge(spark, docs, trusted), lambda: packing.pack(spark, docs.limit(1))):
        spark.conf.unset(key)
        try:
            operator()
            assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= BATCH + 2 * text
            spark.conf.set(key, "1m")  # the session's own choice stays
            operator()
            assert spark.conf.get(key) == "1m"
        finally:
            spark.conf.unset(key)
