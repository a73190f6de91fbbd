"""Skew-proof building blocks.

Each of these replaces a window or a collection that would put one key, or the
whole table, into a single task.  All are plain lazy plans: nothing is sampled
with a random seed, persisted or checkpointed, so a recomputed task sees the same
layout as the first one did.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

MICROS = 1_000_000
_FANOUT = 16


def _groups(keys: Sequence[str]) -> dict[str, Column]:
    """Stand-ins for grouping keys that are never null, so that a join on them keeps
    rows without a key and needs no other layout than the window's."""
    return {f"__g{i}": F.coalesce(F.col(k).cast("string"), F.lit("\0")) for i, k in enumerate(keys)}


def default_buckets(df: DataFrame) -> int:
    """Ranges to cut an ordering into: one per shuffle partition, 64 at least."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def splitters(df: DataFrame, order: str, others: Sequence[str] = (), buckets: int = 64) -> Column:
    """Cut points for ``order`` as a scalar subquery, ``buckets - 1`` values at most.

    The points are the values of the rows with the smallest hashes: a uniform
    sample whose choice depends on the data alone.  Holds a coarse level beside
    the full list so that looking a value up costs two short scans.  ``others``
    go into the hash; naming all columns of an aggregated ``df`` lets its shuffle
    be shared with the query that uses the points.
    """
    picks = (
        df.select(F.col(order).alias("v"), F.xxhash64(order, *others).alias("h"))
        .orderBy("h", "v")
        .limit(max(1, buckets - 1))
        .agg(F.sort_array(F.collect_list("v")).alias("fine"))
    )
    coarse = F.filter("fine", lambda _, i: i % _FANOUT == _FANOUT - 1)
    return picks.select(F.struct(coarse.alias("coarse"), F.col("fine"))).scalar()


def bucket_of(points: Column, value: Column) -> Column:
    """Number of cut points that are <= value."""
    hi = F.size(F.filter(points["coarse"], lambda x: x <= value)) * _FANOUT
    near = F.slice(points["fine"], hi + 1, F.lit(_FANOUT))
    at = hi + F.size(F.filter(near, lambda x: x <= value))
    # never null, and declared so: a join on it then needs no null check further down
    return F.coalesce(at, F.lit(0))


def prefix_sum(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    keys: Sequence[str] = (),
    buckets: int | None = None,
) -> DataFrame:
    """Running totals of ``sums`` in ``order`` within ``keys``, distributed.

    Adds ``cum_<s>`` (up to and including the row) and ``total_<s>``.  Rows must
    be unique on keys + order; the order must not be null.  The order is cut into
    ranges; each range is summed in its own task and shifted by the total of the
    ranges before it.  The only window wider than a range runs over one row per
    (key, range).
    """
    groups = _groups(keys)
    g = list(groups)
    buckets = buckets or default_buckets(df)
    cut = df.withColumn("__points", splitters(df, order, [*keys, *sums], buckets))
    tagged = cut.withColumns({"__b": bucket_of(F.col("__points"), F.col(order)), **groups}).drop("__points")
    before = Window.partitionBy(*g).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    parts = tagged.groupBy(*g, "__b").agg(*[F.sum(s).alias(f"__s_{s}") for s in sums])
    shifts = parts.select(
        *g,
        "__b",
        *[F.coalesce(F.sum(f"__s_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums],
        *[F.sum(f"__s_{s}").over(whole).alias(f"total_{s}") for s in sums],
    )
    inside = Window.partitionBy(*g, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.select("*", *[F.sum(s).over(inside).alias(f"__c_{s}") for s in sums])
    out = local.join(shifts, [*g, "__b"])
    return out.select(
        *df.columns,
        *[(F.col(f"__c_{s}") + F.col(f"__o_{s}")).alias(f"cum_{s}") for s in sums],
        *[F.col(f"total_{s}") for s in sums],
    )


def _as_double(df: DataFrame, col: str) -> Column:
    """The column as a double that never falls as the column rises; NaN is beyond infinity."""
    kind = df.schema[col].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(col).cast("double")
    return F.col(col).cast("double")


def selection_cells(
    df: DataFrame, near: Column, value: Column, shares: Sequence[float], by: Sequence[str] = (), groups: int = 10_000, accuracy: int = 10_000
) -> DataFrame:
    """What is needed to find the values at some ranks, in two scans: (by, s, v, n, sure).

    The first scan makes a sketch per group and takes from it an interval of values around each
    wanted share of the rows; the sketch's error is 1 / ``accuracy`` of the rows, the intervals are
    four times as wide on either side.  The second scan counts: rows inside an interval by ``value``, all others only by the gap
    between intervals they lie in (``v`` is null).  ``s``, then ``v``, order the cells as ``value`` does; ``sure``
    is false where a wanted rank would mean that an interval missed it.

    ``near`` is a double that never falls as ``value`` rises.  ``groups`` bounds the number of groups, whose intervals go to
    every task; with more the query fails.
    """
    by, edge = list(by), 4 / accuracy
    at = df.select(*by, near.alias("__d"), value.alias("__v")).where(F.col("__v").isNotNull())
    for key in by:
        at = at.where(F.col(key).isNotNull())
    d = F.when(F.isnan("__d"), F.lit(float("inf"))).otherwise(F.col("__d"))
    inner = sorted({x for p in shares for x in (p - edge, p + edge) if 0 < x < 1})
    place = {x: i for i, x in enumerate(inner)}
    spans = at.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min(d).alias("__a"), F.max(d).alias("__z"), *([F.percentile_approx(d, inner, accuracy).alias("__q")] if inner else []))
    pick = lambda x: F.col("__a") if x <= 0 else F.col("__z") if x >= 1 else F.col("__q")[place[x]]
    few = F.col("__n") <= accuracy  # a rank is less than an interval's slack only among more rows
    lower = [F.when(few, F.col("__a")).otherwise(pick(p - edge)) for p in sorted(shares)]
    upper = [F.when(few, F.col("__z")).otherwise(pick(p + edge)) for p in sorted(shares)]
    upper = [F.when(x == float("inf"), F.lit(float("nan"))).otherwise(x) for x in upper]
    both = F.struct(F.array(*lower).alias("lo"), F.array(*upper).alias("hi"))
    if by:
        pairs = F.collect_list(F.struct(F.struct(*by).alias("key"), both.alias("span")))
        known = F.when(F.count(F.lit(1)) <= groups, F.map_from_entries(pairs)).otherwise(F.raise_error(F.lit(f"more than {groups} groups")))
        # No more than ``groups`` rows get as far as the list.
        span = F.try_element_at(spans.limit(groups + 1).agg(known).scalar(), F.struct(*by))
    else:
        span = spans.select(both).scalar()
    placed = at.withColumn("__span", span)
    k = F.size(F.filter(F.col("__span.lo"), lambda x: x <= F.col("__d")))
    j = F.size(F.filter(F.col("__span.hi"), lambda x: x < F.col("__d")))
    placed = placed.select(*by, "__v", k.alias("__k"), j.alias("__j"))
    inside = F.col("__k") > F.col("__j")
    cells = placed.select(*by, (F.col("__k") + F.col("__j")).alias("s"), F.when(inside, F.col("__v")).alias("v"), inside.alias("sure"))
    return cells.groupBy(*by, "s", "v", "sure").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(
    df: DataFrame,
    col: str,
    probabilities: Mapping[str, float],
    by: Sequence[str] = (),
    buckets: int | None = None,
    groups: int | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    ``probabilities`` maps output names to probabilities.  Nulls in ``col`` are left out, and so are rows with a null in ``by``.

    A sketch narrows each quantile down to a few values first (``selection_cells``), so that only those are shuffled and
    ranked, by prefix sum.  With ``by`` that needs a bound on the number of ``groups``; without one, equal values are
    counted and all of them are ranked.  No task ever holds a whole group (as the built-in exact percentile does).
    """
    by = list(by)
    if by and groups is None:
        seen = df.where(F.col(col).isNotNull())
        for key in by:
            seen = seen.where(F.col(key).isNotNull())
        counted = seen.groupBy(*by, F.col(col).alias("o")).agg(F.count(F.lit(1)).alias("n")).withColumn("sure", F.lit(True))
        shown = F.col("o")
    else:
        cells = selection_cells(df, _as_double(df, col), F.col(col), list(probabilities.values()), by, groups or 1)
        counted = cells.select(*by, F.struct("s", "v").alias("o"), "sure", "n")
        shown = F.col("o.v")
    ranked = prefix_sum(counted, "o", ["n"], by, buckets)
    first, last, total = F.col("cum_n") - F.col("n"), F.col("cum_n"), F.col("total_n")
    positions = [F.lit(float(p)) * (total - 1) for p in probabilities.values()]
    # Only the values at or beside a wanted position go on: two per quantile and group.
    beside = [(first <= F.ceil(pos)) & (F.floor(pos) < last) for pos in positions]
    missed = F.raise_error(F.lit("a sketch missed its quantile; ask for more accuracy"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), pos.alias("pos")) for i, pos in enumerate(positions)])
    near = ranked.where(reduce(or_, beside)).select(
        *by, F.when(F.col("sure"), shown).otherwise(missed).alias("__v"), first.alias("__a"), last.alias("__z"), F.inline(wanted)
    )

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("__a") <= index) & (index < F.col("__z")), F.col("__v")))

    pos = F.col("pos")
    ends = near.groupBy(*by, "i").agg(at(F.floor(pos)).alias("lo"), at(F.ceil(pos)).alias("hi"), F.max("pos").alias("pos"))
    between = F.col("lo") + (pos - F.floor(pos)) * (F.col("hi") - F.col("lo"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("double")).otherwise(between.cast("double"))  # also of infinities
    found = ends.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", value))).alias("m"))
    return found.select(*by, *[F.try_element_at("m", F.lit(i)).alias(n) for i, n in enumerate(probabilities)])


def time_bucket(micros: Column, step_us: int) -> Column:
    """Number of the time bucket, in whole numbers throughout."""
    step = F.lit(step_us).cast("bigint")
    return ((micros - F.pmod(micros, step)) / step).cast("bigint")


def hash_order(id_col: str, seed: int = 0) -> Column:
    """A hash to order rows by at random but always alike."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256)


def hash_cuts(df: DataFrame, id_col: str, edges: Sequence[float], keys: Sequence[str] = (), seed: int = 0, groups: int = 10_000, out: str = "cuts") -> DataFrame:
    """Adds the number of cuts at or before each row, when the rows of a key are put in hash order.

    Cut ``i`` stands before the row of rank ``floor(total * edges[i] + 0.5)``.  Only the hashes near a cut are ranked; every row
    then compares its own with the cuts, so no row is shuffled.  ``groups`` bounds the number of keys.
    """
    g = _groups(keys)
    hashed = df.select(hash_order(id_col, seed).alias("h"), F.col(id_col).alias("i"), *[c.alias(n) for n, c in g.items()])
    hashed = hashed.withColumns({"d": F.conv(F.substring("h", 1, 13), 16, 10).cast("double"), "o": F.struct(F.coalesce("h", F.lit("")).alias("h"), F.col("i"))})
    by = list(g) or ["all"]
    hashed = hashed if g else hashed.withColumn("all", F.lit(0))
    cells = selection_cells(hashed.withColumn("d", F.coalesce("d", F.lit(-1.0))), F.col("d"), F.col("o"), list(edges), by, groups)
    ranked = prefix_sum(cells.select(*by, F.struct("s", "v").alias("p"), "sure", "n"), "p", ["n"], by)
    cuts = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col("total_n") * F.lit(round(e, 10)) + 0.5).alias("at")) for i, e in enumerate(edges)])
    first = F.col("cum_n") - F.col("n")
    met = ranked.select(*by, F.col("p.v").alias("v"), "sure", "n", first.alias("first"), F.explode(cuts).alias("cut"))
    met = met.where((F.col("first") <= F.col("cut.at")) & (F.col("cut.at") < F.col("first") + F.col("n")))
    missed = F.raise_error(F.lit("a sketch missed its cut"))
    # (h, id) is unique unless rows repeat an id: these stay together, on the side of the cut where the first of them is.
    cut = F.struct(F.col("cut.i").alias("i"), F.when(F.col("sure"), F.col("v")).otherwise(missed).alias("v"))
    table = met.groupBy(*by).agg(F.sort_array(F.collect_list(cut)).alias("cuts"))
    found = table.agg(F.map_from_entries(F.collect_list(F.struct(F.struct(*by), "cuts")))).scalar()
    own = F.struct(F.coalesce(hash_order(id_col, seed), F.lit("")).alias("h"), F.col(id_col).alias("i"))
    key = F.struct(*[c.alias(n) for n, c in g.items()]) if g else F.struct(F.lit(0).alias("all"))
    met = df.withColumn("__cuts", F.try_element_at(found, key))
    return met.select(*df.columns, F.greatest(F.lit(0), F.size(F.filter("__cuts", lambda c: c["v"] <= own))).alias(out))


def hash_rank(
    df: DataFrame, id_col: str, keys: Sequence[str] = (), seed: int = 0, digits: int = 3
) -> DataFrame:
    """Exact 0-based ``rank`` of each row in hash order within ``keys``, plus ``total``.

    A key holding nearly all rows is no problem: rows are ranked within one of
    16**digits slices of the hash and shifted by the sizes of the slices before.
    """
    groups = _groups(keys)
    g = list(groups)
    h = hash_order(id_col, seed)
    hashed = df.withColumns({"__h": h, "__s": F.coalesce(F.substring(h, 1, digits), F.lit("")), **groups})
    before = Window.partitionBy(*g).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    sizes = hashed.groupBy(*g, "__s").agg(F.count(F.lit(1)).alias("__n"))
    shifts = sizes.select(
        *g,
        "__s",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"),
        F.sum("__n").over(Window.partitionBy(*g)).alias("total"),
    )
    inside = Window.partitionBy(*g, "__s").orderBy("__h", id_col)
    local = hashed.withColumn("__r", F.row_number().over(inside))
    return local.join(shifts, [*g, "__s"]).select(
        *df.columns, (F.col("__o") + F.col("__r") - 1).alias("rank"), "total"
    )


def trailing_totals(
    df: DataFrame,
    key: str,
    micros: str,
    windows: Mapping[str, int],
    value: str | None = None,
    inclusive: bool = False,
    bucket_seconds: int = 3600,
) -> DataFrame:
    """Count (and sum of ``value``) of a key's rows in each trailing time window.

    ``windows`` maps a label to its length in seconds.  Default frame is
    ``[t - w, t)``: rows of the same instant are left out; ``inclusive`` makes it
    ``(t - w, t]``.  Adds ``count_<label>`` and ``value_<label>``; both are null
    where the key is null.

    A key is never one group.  Time is cut into buckets that divide every window,
    and a window is the part of its first bucket still inside it, the whole
    buckets between, and the part of its last bucket up to the row.  Each row is
    sent to its own bucket and, per window, to the bucket in which it drops out,
    so both partial buckets are running totals in a (key, bucket) group; whole
    buckets are pre-aggregated before the shuffle.
    """
    seconds = list(windows.values())
    step = math.gcd(bucket_seconds, *seconds)
    step_us = step * MICROS
    spans = {label: w // step for label, w in windows.items()}
    labels = list(windows)
    payload = df.columns
    amount = F.coalesce(F.col(value), F.lit(0.0)).cast("double") if value else F.lit(0.0)

    base = df.select(
        F.struct(*payload).alias("__row"),
        F.col(key).alias("__k"),
        F.col(micros).cast("bigint").alias("__t"),
        amount.alias("__v"),
    ).withColumn("__b", time_bucket(F.col("__t"), step_us))

    roles = [F.struct(F.lit(0).alias("role"), F.lit(0).cast("bigint").alias("shift"))]
    roles += [
        F.struct(F.lit(i + 1).alias("role"), F.lit(spans[label]).cast("bigint").alias("shift"))
        for i, label in enumerate(labels)
    ]
    # Rows without a key belong to no window; spread them rather than group them.
    loose = F.pmod(F.xxhash64("__t"), F.lit(4096))
    sent = base.withColumn(
        "__to", F.explode(F.when(F.col("__k").isNull(), F.array(roles[0])).otherwise(F.array(*roles)))
    ).select(
        F.when(F.col("__to.role") == 0, F.col("__row")).alias("__row"),
        "__k",
        "__v",
        F.col("__to.role").alias("__role"),
        F.when(F.col("__k").isNull(), loose).otherwise(F.col("__b") + F.col("__to.shift")).alias("__b"),
        (F.col("__t") + F.col("__to.shift") * step_us).alias("__o"),
    )

    edge = 0 if inclusive else -1
    group = Window.partitionBy("__k", "__b").orderBy("__o")
    upto = group.rangeBetween(Window.unboundedPreceding, edge)
    whole = group.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def tally(role: int, frame) -> tuple[Column, Column]:
        mine = F.col("__role") == role
        n = F.count(F.when(mine, 1)).over(frame)
        v = F.coalesce(F.sum(F.when(mine, F.col("__v"))).over(frame), F.lit(0.0))
        return n, v

    # One sort serves all: what has come so far, and of the rows that drop out in
    # this bucket those that have not dropped out yet.
    head_n, head_v = tally(0, upto)
    cols = [head_n.alias("__hn"), head_v.alias("__hv")]
    for i, label in enumerate(labels):
        (all_n, all_v), (out_n, out_v) = tally(i + 1, whole), tally(i + 1, upto)
        cols += [(all_n - out_n).alias(f"__tn_{label}"), (all_v - out_v).alias(f"__tv_{label}")]
    homes = sent.select("*", *cols).where(F.col("__role") == 0)

    totals = (
        base.where(F.col("__k").isNotNull())
        .groupBy("__k", "__b")
        .agg(F.count(F.lit(1)).alias("__n"), F.sum("__v").alias("__s"))
    )
    by_time = Window.partitionBy("__k").orderBy("__b")
    mids = []
    for label in labels:
        if spans[label] == 1:
            mids += [F.lit(0).alias(f"__mn_{label}"), F.lit(0.0).alias(f"__mv_{label}")]
            continue
        frame = by_time.rangeBetween(-(spans[label] - 1), -1)
        mids += [
            F.coalesce(F.sum("__n").over(frame), F.lit(0)).alias(f"__mn_{label}"),
            F.coalesce(F.sum("__s").over(frame), F.lit(0.0)).alias(f"__mv_{label}"),
        ]
    joined = homes.join(totals.select("__k", "__b", *mids), ["__k", "__b"], "left")
    out = [F.col("__row.*")]
    for label in labels:
        n = F.col("__hn") + F.col(f"__mn_{label}") + F.col(f"__tn_{label}")
        tail = F.when(F.col(f"__tn_{label}") > 0, F.col(f"__tv_{label}")).otherwise(F.lit(0.0))
        v = F.col("__hv") + F.col(f"__mv_{label}") + tail
        known = F.col("__k").isNotNull()
        out.append(F.when(known, n).cast("bigint").alias(f"count_{label}"))
        if value:
            out.append(F.when(known, v).alias(f"value_{label}"))
    return joined.select(*out)


def count_near(
    hits: DataFrame,
    events: DataFrame,
    hit_id: str,
    key: str,
    micros: str,
    kind: str,
    kinds: Sequence[str],
    half_seconds: float,
    bucket_seconds: int = 900,
) -> DataFrame:
    """For each hit, the rows of every other kind within +-half_seconds, same key.

    Counting needs no pairs: a hit asks for the number of events up to the end of
    its window and up to just before its start, and takes the difference.  Both
    questions are answered by a running count inside a (key, time bucket) group
    plus the count of the key's earlier buckets.  Returns ``hit_id, near``.
    """
    half = int(half_seconds * MICROS)
    step = bucket_seconds * MICROS
    kinds = list(kinds)
    ones = [F.when(F.col(kind) == k, 1).otherwise(0).alias(f"__k{i}") for i, k in enumerate(kinds)]
    none = [F.lit(0).alias(f"__k{i}") for i in range(len(kinds))]
    facts = events.where(F.col(kind).isin(kinds) & F.col(key).isNotNull()).select(
        F.lit(None).cast(hits.schema[hit_id].dataType).alias("__id"),
        F.col(key).alias("__key"),
        F.col(micros).cast("bigint").alias("__t"),
        F.lit(0).alias("__sign"),
        F.lit(None).cast("string").alias("__own"),
        *ones,
    )
    asks = (
        hits.where(F.col(key).isNotNull())
        .select(
            F.col(hit_id).alias("__id"),
            F.col(key).alias("__key"),
            F.explode(
                F.array(
                    F.struct((F.col(micros) + half).cast("bigint").alias("t"), F.lit(1).alias("sign")),
                    F.struct((F.col(micros) - half - 1).cast("bigint").alias("t"), F.lit(-1).alias("sign")),
                )
            ).alias("__ask"),
            F.col(kind).cast("string").alias("__own"),
        )
        .select("__id", "__key", F.col("__ask.t").alias("__t"), F.col("__ask.sign").alias("__sign"), "__own", *none)
    )
    both = facts.unionByName(asks).withColumn("__b", time_bucket(F.col("__t"), step))
    group = Window.partitionBy("__key", "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    inside = both.select(
        "__id", "__key", "__b", "__sign", "__own",
        *[F.sum(f"__k{i}").over(group).alias(f"__r{i}") for i in range(len(kinds))],
    ).where(F.col("__sign") != 0)
    earlier = Window.partitionBy("__key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy("__key", "__b").agg(*[F.sum(f"__k{i}").alias(f"__s{i}") for i in range(len(kinds))])
    blocks = blocks.select(
        "__key", "__b",
        *[F.coalesce(F.sum(f"__s{i}").over(earlier), F.lit(0)).alias(f"__p{i}") for i in range(len(kinds))],
    )
    answered = inside.join(blocks, ["__key", "__b"])
    upto = sum(
        (
            F.when(F.col("__own") == k, 0).otherwise(F.col(f"__r{i}") + F.col(f"__p{i}"))
            for i, k in enumerate(kinds)
        ),
        F.lit(0),
    )
    return answered.groupBy(F.col("__id").alias(hit_id)).agg(
        F.sum(F.col("__sign") * upto).cast("bigint").alias("near")
    )


def pairs_near(left: DataFrame, right: DataFrame, key: str, micros: str, half_seconds: float, where: Column | None = None, rows: int = 10_000) -> DataFrame:
    """All pairs of a left and a right row with the same key whose times differ by at most ``half_seconds``.

    The pair's columns are the structs ``l`` and ``r``; ``where`` may narrow the pairs further.  Time is cut into buckets of the
    window's reach: a left row goes to its own bucket, a right row to its own and both its neighbours, so a pair
    meets in exactly one (key, bucket) cell.  Where a cell holds more than ``rows`` left or right rows, both sides are dealt into that
    many blocks and every block of one side meets every block of the other, so no task gets a whole hot cell.
    Rows without a key or a time are in no pair.  There are as many rows as pairs; ``count_near`` counts without making them.
    """
    half = int(half_seconds * MICROS)
    step = max(1, half)

    def placed(df: DataFrame, name: str, shifts: Sequence[int]) -> DataFrame:
        known = df.where(F.col(key).isNotNull() & F.col(micros).isNotNull())
        own = time_bucket(F.col(micros).cast("bigint"), step)
        to = F.explode(F.array(*[own + F.lit(x) for x in shifts])) if len(shifts) > 1 else own
        return known.select(F.col(key).alias("__k"), F.struct(*df.columns).alias(name), F.xxhash64(*df.columns).alias("__h"), to.alias("__b"))

    a, b = placed(left, "l", [0]), placed(right, "r", [-1, 0, 1])
    n = lambda df, name: df.groupBy("__k", "__b").agg(F.count(F.lit(1)).alias(name))
    parts = lambda c: F.ceil(F.col(c) / rows).cast("int")
    # Only hot cells are listed; all others are one block.
    crowded = n(a, "__n").join(n(b, "__m"), ["__k", "__b"]).where((F.col("__n") > rows) | (F.col("__m") > rows))
    crowded = crowded.select("__k", "__b", parts("__n").alias("__x"), parts("__m").alias("__y"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("__s"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        met = df.withColumn("__s", F.pmod("__h", F.lit(64)).cast("int")).join(crowded, ["__k", "__b", "__s"], "left")
        mine = F.pmod(F.shiftright("__h", 6), F.coalesce(F.col(own), F.lit(1))).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        return met.withColumns({f"__p{own}": mine}).withColumn(f"__p{other}", theirs).drop("__x", "__y", "__h", "__s")

    met = dealt(a, "__x", "__y").join(dealt(b, "__y", "__x"), ["__k", "__b", "__p__x", "__p__y"])
    near = met.where(F.abs(F.col(f"l.{micros}").cast("bigint") - F.col(f"r.{micros}").cast("bigint")) <= half)
    return (near if where is None else near.where(where)).select("l", "r")


def previous_in_key(
    df: DataFrame, key: str, order: Sequence[str], bucket: Column, col: str, out: str
) -> DataFrame:
    """``lag(col)`` within a key without putting a key into one task.

    ``bucket`` must not fall as ``order`` rises, and must not be null.  Rows look back within their
    (key, bucket); the first row of a bucket takes the last value of the key's
    bucket before, found among one row per (key, bucket).
    """
    order = list(order)
    tagged = df.withColumns({"__b": bucket, **_groups([key])})
    tails = tagged.groupBy("__g0", "__b").agg(F.max_by(col, F.struct(*order)).alias("__last"))
    carried = tails.select(
        "__g0", "__b", F.lag("__last").over(Window.partitionBy("__g0").orderBy("__b")).alias("__carry")
    )
    inside = Window.partitionBy("__g0", "__b").orderBy(*order)
    local = tagged.select(
        "*", F.lag(col).over(inside).alias("__lag"), F.row_number().over(inside).alias("__n")
    )
    return local.join(carried, ["__g0", "__b"]).select(
        *df.columns, F.when(F.col("__n") == 1, F.col("__carry")).otherwise(F.col("__lag")).alias(out)
    )


def hottest(counts: DataFrame, keys: Sequence[str], n: str = "n", limit: int = 1000) -> DataFrame:
    """The ``limit`` most frequent keys.  Any key left out holds under 1/limit of the rows."""
    return counts.orderBy(F.desc(n), *keys).limit(limit)


def attach_by_key(df: DataFrame, counts: DataFrame, key: str, n: str, limit: int = 1000) -> DataFrame:
    """Left-join one row per key onto ``df`` when some keys hold a large share of it.

    ``counts`` has one row per key with its frequency in ``n``.  The hottest keys
    (``limit`` rows, hence the broadcast) are looked up in place; their rows and
    those without a key are then spread over the shuffle by a salt no lookup row
    carries, so only the even rest meets the full table.
    """
    hot = hottest(counts.where(F.col(key).isNotNull()), [key], n, limit).select(
        F.col(key).alias("__hk"), F.col(n).alias("__hn")
    )
    marked = df.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left")
    done = F.col("__hk").isNotNull() | F.col(key).isNull()
    salted = marked.withColumn(
        "__salt", F.when(done, 1 + F.pmod(F.xxhash64(*df.columns), F.lit(8191))).otherwise(F.lit(0))
    )
    # the lookup rows' salt is 0, but not a constant: Spark would put that into the condition and join on the key alone
    rest = counts.select(F.col(key).alias("__ck"), F.col(n).alias("__cn"), F.pmod(F.xxhash64(key), F.lit(1)).alias("__cs"))
    joined = salted.join(rest, (F.col(key) == F.col("__ck")) & (F.col("__salt") == F.col("__cs")), "left")
    return joined.select(*df.columns, F.coalesce("__hn", "__cn").alias(n))
