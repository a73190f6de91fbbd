"""The skew-proof building blocks against brute force, with one key holding a third or more."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfold import scale as S

rng = random.Random(7)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.fixture(scope="module")
def timed(spark):
    rows = []
    for i in range(900):
        key = "hot" if i % 2 else (None if i % 17 == 0 else f"k{i % 23}")
        # few distinct seconds: many rows of the same instant, some before 1970
        rows.append((i, key, (rng.randrange(-4000, 90_000) // 7) * 7 * 1_000_000 + (i % 2), float(rng.randrange(1000)) / 8))
    return rows


def brute_trailing(rows, seconds, inclusive):
    out = {}
    for i, k, t, _ in rows:
        w = seconds * 1_000_000
        hits = [v for _, k2, u, v in rows if k2 == k and (t - w < u <= t if inclusive else t - w <= u < t)]
        out[i] = (len(hits), sum(hits)) if k is not None else (None, None)
    return out


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("bucket", [600, 60, 7])
def test_trailing_totals(spark, timed, inclusive, bucket):
    df = frame(spark, timed, "id INT, k STRING, us BIGINT, v DOUBLE")
    windows = {"a": 3600, "b": 86400} if bucket != 7 else {"a": 21, "b": 70}
    got = S.trailing_totals(df, "k", "us", windows, "v", inclusive, bucket).collect()
    assert len(got) == len(timed)
    for label, seconds in windows.items():
        want = brute_trailing(timed, seconds, inclusive)
        for r in got:
            n, v = want[r.id]
            assert r[f"count_{label}"] == n
            assert r[f"value_{label}"] == (None if v is None else pytest.approx(v))


def test_count_near(spark, timed):
    rows = [(i, k, t, "abc"[i % 3]) for i, k, t, _ in timed]
    df = frame(spark, rows, "id INT, k STRING, us BIGINT, kind STRING")
    got = {r.id: r.near for r in S.count_near(df, df, "id", "k", "us", "kind", ["a", "b"], 450).collect()}
    for i, k, t, kind in rows:
        if k is None:
            assert i not in got
            continue
        near = sum(1 for _, k2, u, s in rows if k2 == k and s in "ab" and s != kind and abs(u - t) <= 450_000_000)
        assert got[i] == near


def test_prefix_sum_with_keys(spark):
    values = [("a" if i % 3 else "b", float(i * 37 % 500) / 3) for i in range(500)]
    rows = [(k, v, i % 5) for i, (k, v) in enumerate(sorted(set(values)))]
    df = frame(spark, rows, "k STRING, v DOUBLE, n INT")
    for buckets in (1, 4, 64, 300):
        got = S.prefix_sum(df, "v", ["n"], ["k"], buckets).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.cum_n == sum(n for k, v, n in rows if k == r.k and v <= r.v)
            assert r.total_n == sum(n for k, _, n in rows if k == r.k)


def test_quantiles_equal_numpy(spark):
    heavy = [5.0] * 400 + [float(x) for x in range(200)] + [None] * 10
    df = frame(spark, [(v, "g") for v in heavy] + [(1.5, "one"), (None, "none")], "v DOUBLE, g STRING")
    ps = {f"q{i}": i / 20 for i in range(21)}
    got = {r.g: r for r in S.exact_quantiles(df, "v", ps, ["g"]).collect()}
    want = np.percentile([v for v in heavy if v is not None], [p * 100 for p in ps.values()])
    assert [got["g"][n] for n in ps] == pytest.approx(list(want))
    assert got["one"].q0 == got["one"].q20 == 1.5
    assert "none" not in got


@pytest.mark.parametrize("kind", ["DOUBLE", "BIGINT", "DECIMAL(38, 2)", "TIMESTAMP"])
def test_selection_is_exact_on_hot_and_odd_values(spark, kind):
    """A third of the rows share one value; more rows than the sketch keeps; ranks beside the hot value."""
    n = 60_000
    value = F.when(F.col("id") % 3 == 0, F.lit(7_000)).otherwise(F.pmod(F.xxhash64("id"), F.lit(50_000)))
    group = F.when(F.col("id") % 9 < 8, "hot").otherwise("rest")
    df = spark.range(0, n, 1, 6).select(group.alias("g"), value.cast("bigint").cast(kind).alias("v"))
    ps = {f"q{i}": p for i, p in enumerate([0, 0.001, 0.1, 0.25, 1 / 3, 0.4, 0.5, 0.75, 0.9, 0.9999, 1])}
    number = F.unix_micros("v").alias("v") if kind == "TIMESTAMP" else F.col("v").cast("double").alias("v")
    rows = df.select("g", number).collect()
    if kind == "TIMESTAMP":
        df = df.select("g", F.unix_micros("v").alias("v"))
    for by in ([], ["g"]):
        for r in S.exact_quantiles(df, "v", ps, by, groups=5).collect():
            own = [x.v for x in rows if not by or x.g == r.g]
            assert [r[c] for c in ps] == pytest.approx(list(np.percentile(own, [100 * p for p in ps.values()])), rel=1e-12)


def test_selection_with_not_a_number_and_infinity(spark):
    odd = [float("nan")] * 3000 + [float("inf")] * 3000 + [float("-inf")] * 3000 + [float(x) for x in range(12_000)]
    df = frame(spark, [(v,) for v in odd], "v DOUBLE").repartition(5)
    order = sorted(odd, key=lambda v: (v != v, v if v == v else 0))
    got = S.exact_quantiles(df, "v", {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0}).first()
    assert got.a == float("-inf") and got.b == (order[10_499] + order[10_500]) / 2
    assert got.c != got.c and got.d != got.d  # 18,899.1: NaN comes after infinity


def test_selection_shuffles_no_raw_values(spark):
    df = spark.range(0, 200_000, 1, 4).select((F.xxhash64("id") % 10**9).cast("double").alias("v"))
    cells = S.selection_cells(df, F.col("v"), F.col("v"), [0.25, 0.5])
    assert cells.count() < 200_000 * 0.004 and cells.agg(F.sum("n")).first()[0] == 200_000
    with pytest.raises(Exception, match="more than 3 groups"):
        S.exact_quantiles(df.withColumn("g", F.col("v") % 7), "v", {"q": 0.5}, ["g"], groups=3).collect()
    assert S.exact_quantiles(df.limit(0), "v", {"q": 0.5}).first().q is None


def test_hash_cuts_equal_ranks(spark):
    df = spark.range(0, 40_000, 1, 5).select("id", F.when(F.col("id") % 97 == 0, "few").when(F.col("id") % 89 != 0, "hot").alias("k"))
    edges = [0.1, 0.8, 0.95]
    cut = S.hash_cuts(df, "id", edges, ["k"], 7, out="c")
    ranked = {r.id: sum(r.rank >= int(r.total * e + 0.5) for e in edges) for r in S.hash_rank(df, "id", ["k"], 7).collect()}
    assert {r.id: r.c for r in cut.collect()} == ranked
    assert S.hash_cuts(df.limit(0), "id", edges, ["k"], 7).collect() == []


def test_hash_rank_is_whole_and_stable(spark):
    df = frame(spark, [(i, "big" if i % 10 else "small") for i in range(1000)], "id INT, k STRING")
    a = {r.id: (r.k, r.rank, r.total) for r in S.hash_rank(df, "id", ["k"]).collect()}
    b = {r.id: (r.k, r.rank, r.total) for r in S.hash_rank(df.repartition(3), "id", ["k"], digits=1).collect()}
    assert a == b
    for key, n in (("big", 900), ("small", 100)):
        assert sorted(rank for k, rank, _ in a.values() if k == key) == list(range(n))
        assert {t for k, _, t in a.values() if k == key} == {n}


def test_previous_in_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 13 % 997, f"h{i}") for i in range(600)]
    df = frame(spark, rows, "k STRING, t INT, h STRING")
    got = S.previous_in_key(df, "k", ["t"], F.floor(F.col("t") / 50), "h", "before").collect()
    for r in got:
        earlier = [(t, h) for k, t, h in rows if k == r.k and t < r.t]
        assert r.before == (max(earlier)[1] if earlier else None)


def test_attach_by_key_keeps_every_row(spark):
    rows = [(i, None if i % 5 == 0 else "hot" if i % 2 else f"k{i}") for i in range(400)]
    df = frame(spark, rows, "id INT, k STRING")
    counts = df.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = {r.id: r.n for r in S.attach_by_key(df, counts, "k", "n", limit=3).collect()}
    for i, k in rows:
        assert got[i] == (None if k is None else sum(1 for _, x in rows if x == k))
    assert len(got) == len(rows)


def test_hot_key_is_spread(spark):
    """A key with all the rows reaches many tasks, not one."""
    df = spark.range(20_000).select(
        F.lit("hot").alias("k"), (F.col("id") * 10_000_000).alias("us"), F.lit(1.0).alias("v"), "id"
    )
    out = S.trailing_totals(df, "k", "us", {"h": 3600}, "v").withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 4 and max(sizes) < 20_000 / 2


def test_rows_without_a_group_are_kept(spark):
    rows = [(i, None if i % 4 == 0 else "k", float(i)) for i in range(200)]
    df = frame(spark, rows, "id INT, k STRING, v DOUBLE")
    ranked = S.hash_rank(df, "id", ["k"]).collect()
    assert sorted(r.rank for r in ranked if r.k is None) == list(range(50)) and len(ranked) == 200
    ones = df.withColumn("n", F.lit(1))
    assert {(r.k, r.v): r.cum_n for r in S.prefix_sum(ones, "v", ["n"], ["k"]).collect()}[(None, 196.0)] == 50
