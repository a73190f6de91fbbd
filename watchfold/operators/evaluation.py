"""Thresholds, costs, drift, queues and labels: everything after a score exists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from watchfold import constants as K
from watchfold.functions.levels import psi_band
from watchfold.scale import exact_quantiles, hash_cuts, hash_order, hash_rank, prefix_sum


# --- splits and weights --------------------------------------------------------


def stratified_split(
    df: DataFrame, id_col: str, label: str, fractions: Mapping[str, float], seed: int = 42
) -> DataFrame:
    """Adds ``split``: exact shares of every class, decided by the hash of the id.

    Only hashes near a cut are ranked (see ``scale.hash_cuts``); rows that repeat an id go together.
    """
    names, edges, edge = list(fractions), [], 0.0
    for name in names[:-1]:
        edge += fractions[name]
        edges.append(edge)
    if not edges:
        return df.withColumn("split", F.lit(names[-1]))
    passed = hash_cuts(df, id_col, edges, [label], seed, out="__passed")
    return passed.withColumn("split", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__passed") + 1)).drop("__passed")


def stratified_folds(df: DataFrame, id_col: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..k-1 with every class dealt out evenly."""
    ranked = hash_rank(df, id_col, [label], seed)
    return ranked.withColumn("fold", (F.col("rank") % k).cast("int")).drop("rank", "total")


def class_weight(df: DataFrame, label: str, rounded: bool = False) -> DataFrame:
    """One row: negatives, positives and the positive-class weight neg / pos."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives")
    )
    weight = F.try_divide(F.col("negatives"), F.col("positives"))
    return counts.withColumn("weight", F.bround(weight, 0) if rounded else weight)


# --- precision and recall ------------------------------------------------------


def score_table(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: rows and positives at it, at or above it, and in all."""
    by = list(by)
    at = df.groupBy(*by, F.col(p).cast("double").alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("bigint")).alias("pos")
    )
    ranked = prefix_sum(at, "threshold", ["n", "pos"], by)
    return ranked.select(
        *by,
        "threshold",
        "n",
        "pos",
        (F.col("total_n") - F.col("cum_n") + F.col("n")).alias("flagged"),
        (F.col("total_pos") - F.col("cum_pos") + F.col("pos")).alias("tp"),
        "total_n",
        "total_pos",
    )


def pr_curve(df: DataFrame, y: str, p: str) -> DataFrame:
    """Precision and recall at every distinct score, plus the closing point (1, 0).

    The closing row sits at threshold 1 and still counts the scores of 1 and more
    in ``flagged``, ``fp`` and ``fn``.
    """
    s = score_table(df, y, p)
    main = s.select(
        "threshold",
        (F.col("tp") / F.col("flagged")).alias("precision"),
        F.coalesce(F.try_divide("tp", "total_pos"), F.lit(1.0)).alias("recall"),
        "flagged",
        (F.col("flagged") - F.col("tp")).alias("fp"),
        (F.col("total_pos") - F.col("tp")).alias("fn"),
        F.lit(0).alias("closing"),
    )
    top = F.col(p) >= 1.0
    hit = F.col(y) == 1
    end = df.agg(
        F.lit(1.0).alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.count_if(top).alias("flagged"),
        F.count_if(top & ~hit).alias("fp"),
        F.count_if(~top & hit).alias("fn"),
        F.lit(1).alias("closing"),
    )
    return main.unionByName(end)


def average_precision(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Step sum of precision over recall gained, per group."""
    by = list(by)
    gain = F.try_divide("pos", "total_pos") * (F.col("tp") / F.col("flagged"))
    return score_table(df, y, p, by).groupBy(*by).agg(
        F.coalesce(F.sum(gain), F.lit(0.0)).alias("average_precision")
    )


def classification_report(
    df: DataFrame, y: str, p: str, threshold: float | Column, beta: float = 2.0, by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts, precision, recall and F-beta at a threshold; empty ratios are 0."""
    flag, hit = F.col(p) >= threshold, F.col(y) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(flag & hit).alias("tp"),
        F.count_if(flag & ~hit).alias("fp"),
        F.count_if(~flag & hit).alias("fn"),
        F.count_if(~flag & ~hit).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    b2 = beta * beta

    def ratio(num: Column, den: Column) -> Column:
        return F.coalesce(F.try_divide(num, den), F.lit(0.0))

    return counts.withColumns(
        {
            "precision": ratio(tp, tp + fp),
            "recall": ratio(tp, tp + fn),
            "f_beta": ratio(tp * (1 + b2), tp * (1 + b2) + fn * b2 + fp),
        }
    )


# --- thresholds by cost and capacity ---------------------------------------------


def cost_curve(
    df: DataFrame,
    y: str,
    p: str,
    missed: float = K.COST_MISSED,
    false_alarm: float = K.COST_FALSE_ALARM,
    days: float = K.CURVE_DAYS,
) -> DataFrame:
    """The curve with the cost and the daily number of flags at each threshold."""
    return pr_curve(df, y, p).withColumns(
        {
            "cost": F.col("fn") * missed + F.col("fp") * false_alarm,
            "flagged_per_day": F.col("flagged") / days,
        }
    )


def cheapest_threshold(curve: DataFrame) -> DataFrame:
    """The curve's row of least cost, lowest threshold on ties."""
    return _first(curve, F.struct("cost", "threshold", "closing"))


def _first(curve: DataFrame, order: Column, when: Column | None = None) -> DataFrame:
    keep = ["threshold", "precision", "recall", "cost", "flagged", "flagged_per_day"]
    row = F.struct(*keep)
    best = F.min_by(row, order) if when is None else F.min_by(F.when(when, row), F.when(when, order))
    return curve.agg(best.alias("r")).select("r.*")


def capacity_threshold(curve: DataFrame, capacity: float = K.REVIEW_CAPACITY) -> DataFrame:
    """Lowest threshold whose daily flags fit the capacity; the cheapest where none does."""
    keep = ["threshold", "precision", "recall", "cost", "flagged", "flagged_per_day"]
    fits = F.col("flagged_per_day") <= capacity
    row = F.struct(*keep)
    picked = curve.agg(
        F.min_by(row, F.when(fits, F.struct("threshold", "closing"))).alias("a"),
        F.min_by(row, F.struct("cost", "threshold", "closing")).alias("b"),
        F.count_if(fits).alias("n"),
    )
    chosen = F.when(F.col("n") > 0, F.col("a")).otherwise(F.col("b"))
    return picked.select(chosen.alias("r"), (F.col("n") > 0).alias("within_capacity")).select("r.*", "within_capacity")


def review_queue(
    df: DataFrame, amount: str, p: str, tie: str, k: int = 5, floor: float = K.QUEUE_MIN_PROBABILITY
) -> DataFrame:
    """The k rows of highest amount x probability among those above ``floor``."""
    loss = F.coalesce(F.col(amount), F.lit(0.0)) * F.col(p)
    return (
        df.where(F.col(p) > floor)
        .withColumn("expected_loss", loss)
        .orderBy(F.desc("expected_loss"), tie)
        .limit(k)
    )


# --- drift -----------------------------------------------------------------------


def apply_evasion(
    df: DataFrame, id_col: str, label: str, caps: Mapping[str, float],
    share: float = K.EVASION_SHARE, seed: int = 42,
) -> DataFrame:
    """Cap the given columns on every positive and on a hashed share of the negatives."""
    draw = F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("bigint") % 1000
    moved = (F.col(label) == 1) | (draw < int(share * 1000))
    present = {c: cap for c, cap in caps.items() if c in df.columns}
    return df.withColumn("shifted", moved).withColumns(
        {c: F.when(F.col("shifted"), F.least(F.col(c), F.lit(float(cap)))).otherwise(F.col(c)) for c, cap in present.items()}
    )


def drift_impact(before: DataFrame, after: DataFrame, y: str, p: str, threshold: float) -> DataFrame:
    """One row: recall at a fixed threshold and average precision, before, after, and the drops."""
    both = before.select(F.lit("before").alias("phase"), y, p).unionByName(
        after.select(F.lit("after").alias("phase"), y, p)
    )
    report = classification_report(both, y, p, threshold, by=["phase"]).select("phase", "recall")
    joined = report.join(average_precision(both, y, p, ["phase"]), "phase")

    def of(phase: str, col: str) -> Column:
        return F.max(F.when(F.col("phase") == phase, F.col(col)))

    out = joined.agg(
        of("before", "recall").alias("recall_before"),
        of("after", "recall").alias("recall_after"),
        of("before", "average_precision").alias("ap_before"),
        of("after", "average_precision").alias("ap_after"),
    )
    drop = F.col("recall_before") - F.col("recall_after")
    return out.withColumns(
        {
            "recall_drop": drop,
            "recall_drop_relative": F.try_divide(drop, F.col("recall_before")),
            "ap_drop": F.col("ap_before") - F.col("ap_after"),
        }
    )


def _long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(F.inline(pairs)).where(F.col("v").isNotNull())


def psi_baseline(baseline: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Per feature: distinct bin edges, rows, and counts per bin, to compare others with."""
    long = _long(baseline, cols)
    names = {f"e{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(long, "v", names, ["feature"], groups=len(cols)).select(
        "feature", F.struct(F.array_sort(F.array_distinct(F.array(*names))).alias("edges")).alias("b")
    )
    return _bin_counts(long, _lookup(edges)).select("feature", "b.edges", "rows", "counts")


def _lookup(per_feature: DataFrame) -> Column:
    """A table of (feature, struct b) as one map; it has an entry per column, no more."""
    return per_feature.agg(F.map_from_entries(F.collect_list(F.struct("feature", "b")))).scalar()


def _bin_counts(long: DataFrame, table: Column) -> DataFrame:
    """Counts per bin; the last bin is closed, values outside count only in ``rows``."""
    e = F.col("b.edges")
    below = F.size(F.filter(e, lambda x: x <= F.col("v")))
    last = F.size(e) - 1
    slot = F.when(F.col("v") == F.element_at(e, -1), last).otherwise(below)
    binned = (
        long.withColumn("b", F.try_element_at(table, F.col("feature")))
        .where(F.col("b").isNotNull())
        .select("feature", F.when(slot.between(1, last), slot).otherwise(F.lit(0)).alias("slot"))
        .groupBy("feature", "slot")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    summed = binned.groupBy("feature").agg(
        F.sum("n").alias("rows"), F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("counts")
    )
    return summed.withColumn("b", F.try_element_at(table, F.col("feature")))


def psi(baseline: DataFrame, current: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability index per column against the baseline's quantile bins."""
    return psi_against(psi_baseline(baseline, cols, bins), current, cols)


def psi_against(fixed: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PSI of ``current`` against the output of ``psi_baseline``."""
    table = _lookup(fixed.select("feature", F.struct("edges", "rows", "counts").alias("b")))
    now = _bin_counts(_long(current, cols), table)

    def share(counts: Column, rows: Column, slot: Column) -> Column:
        return (F.coalesce(F.try_element_at(counts, slot), F.lit(0)) + F.lit(1e-6)) / rows

    def term(slot: Column) -> Column:
        then = share(F.col("b.counts"), F.col("b.rows"), slot)
        today = share(F.col("counts"), F.col("rows"), slot)
        return (today - then) * F.log(today / then)

    edges = F.size("b.edges")
    terms = F.transform(F.sequence(F.lit(1), edges - 1), term)
    value = F.when(edges < 3, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x))
    found = now.select("feature", F.col("rows").alias("current_rows"), value.alias("psi"))
    # a feature without any value now is the strongest drift there is: no rows, no index, a band of its own
    out = fixed.select("feature", F.col("rows").alias("baseline_rows")).join(found, "feature", "left")
    out = out.select("feature", "baseline_rows", F.coalesce("current_rows", F.lit(0).cast("bigint")).alias("current_rows"), "psi")
    return out.withColumn("band", F.when(F.col("psi").isNull(), "no values").otherwise(psi_band("psi")))


# --- explanation -----------------------------------------------------------------


def explain_sample(df: DataFrame, label: str, order: str, n: int = 500) -> DataFrame:
    """First n rows of each class.  The rank filter is applied before the shuffle as well."""
    w = Window.partitionBy(label).orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def linear_contributions(df: DataFrame, coefficients: Mapping[str, float], suffix: str = "_contribution") -> DataFrame:
    """coefficient x (value - mean) per feature: the exact additive shares of a linear score."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in coefficients]).alias("m")).scalar()
    return df.withColumns(
        {f"{c}{suffix}": F.lit(float(w)) * (F.col(c) - means[c]) for c, w in coefficients.items()}
    )


def reason_codes(df: DataFrame, id_col: str, features: Sequence[str], k: int = 5, suffix: str = "_contribution") -> DataFrame:
    """The k features of largest absolute contribution per row, one row each.

    Works inside the row: no shuffle, k output rows at most per input row.
    """
    entries = F.array(
        *[
            F.struct(
                (-F.abs(F.col(f"{c}{suffix}"))).alias("o"),
                F.lit(i).alias("i"),
                F.lit(c).alias("feature"),
                F.col(c).cast("double").alias("value"),
                F.col(f"{c}{suffix}").alias("contribution"),
            )
            for i, c in enumerate(features)
        ]
    )
    top = F.slice(F.array_sort(entries), 1, k)
    return df.select(id_col, F.posexplode(top).alias("pos", "e")).select(
        id_col,
        (F.col("pos") + 1).alias("reason_rank"),
        "e.feature",
        F.round("e.value", 4).alias("value"),
        F.round("e.contribution", 4).alias("contribution"),
    )


def key_features(df: DataFrame, cols: Sequence[str], out: str = "key_features") -> DataFrame:
    """Adds a map of the listed columns that exist, rounded to 4 decimals."""
    present = [c for c in cols if c in df.columns]
    values = F.array(*[F.round(F.col(c).cast("double"), 4) for c in present])
    return df.withColumn(out, F.map_from_arrays(F.array(*[F.lit(c) for c in present]), values))


# --- search and comparison -------------------------------------------------------


def search_progress(trials: DataFrame) -> DataFrame:
    """Best score so far per method, trial by trial (a method has one row per trial)."""
    w = Window.partitionBy("method").orderBy("trial").rowsBetween(Window.unboundedPreceding, 0)
    return trials.withColumn("best_so_far", F.max("score").over(w))


def search_summary(trials: DataFrame) -> DataFrame:
    """Per method: best score, first trial at 95 % of it, best trial; and the winner."""
    whole = Window.partitionBy("method")
    p = search_progress(trials).withColumn("final_best", F.max("score").over(whole))
    near = F.col("best_so_far") >= F.lit(0.95) * F.col("final_best")
    out = p.groupBy("method").agg(
        F.max("final_best").alias("best_score"),
        F.min(F.when(near, F.col("trial"))).alias("trials_to_95pct"),
        F.min_by("trial", F.struct(-F.col("score"), F.col("trial"))).alias("best_trial"),
        F.count(F.lit(1)).alias("trials"),
    )
    leader = out.agg(F.min_by("method", F.struct(-F.col("best_score"), F.col("method")))).scalar()
    return out.withColumn("winner", F.col("method") == leader)


def compare_configs(
    df: DataFrame, config: str, y: str, p: str, threshold: float = 0.5,
    missed: float = K.COST_MISSED, false_alarm: float = K.COST_FALSE_ALARM, days: float = K.CURVE_DAYS,
) -> DataFrame:
    """Per configuration: average precision, F2 and daily cost; the best precision ships."""
    report = classification_report(df, y, p, threshold, 2.0, [config])
    cost = (F.col("fn") * missed + F.col("fp") * false_alarm) / days
    out = average_precision(df, y, p, [config]).join(
        report.select(config, F.col("f_beta").alias("f2"), cost.alias("cost_per_day")), config
    )
    best = out.agg(F.min_by(config, F.struct(-F.col("average_precision"), F.col(config)))).scalar()
    return out.withColumn("ships", F.col(config) == best)


# --- labels ----------------------------------------------------------------------


def mature_only(df: DataFrame, ts: str, as_of: str, days: int = 90) -> DataFrame:
    """Rows whose label has had ``days`` days to arrive by ``as_of``."""
    return df.where(F.col(ts) < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: agreement of two reviewers beyond chance."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col(a).alias("label"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb"),
                    F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0).alias("same"),
                ),
                F.struct(
                    F.col(b).alias("label"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb"),
                    F.lit(0).cast("bigint").alias("same"),
                ),
            )
        )
    )
    margins = sides.groupBy("label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.sum("same").alias("same"))
    n = F.sum("na")
    out = margins.agg(
        n.alias("rated"),
        (F.sum("same") / n).alias("observed"),
        (F.sum(F.col("na").cast("double") * F.col("nb")) / (n.cast("double") * n)).alias("expected"),
    )
    kappa = F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected"))
    return out.withColumn("kappa", kappa)


def disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))


def resolve_labels(df: DataFrame, key: str, label: str, source: str, priority: Sequence[str]) -> DataFrame:
    """One label per key from the source that ranks first; unlisted sources come last."""
    ranks = F.array_position(F.array(*[F.lit(s) for s in priority]), F.col(source))
    rank = F.when(ranks > 0, ranks).otherwise(len(priority) + 1)
    return df.groupBy(key).agg(F.min_by(F.struct(source, label), F.struct(rank, F.col(label))).alias("r")).select(
        key, F.col(f"r.{source}").alias(source), F.col(f"r.{label}").alias(label)
    )
