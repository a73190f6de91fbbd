"""J2-J5, J20, J21: models on event features.

The fitted trees have no SQL twin; what surrounds them has: which rows are predicted and
whether the model beats chance, the isotonic fit, precision per fold, the search's bounds.
"""

from pyspark.sql import functions as F

from watchfold.operators import evaluation as V, features as X, modelling as T
from watchfold.plans.evaluation_queries import SCORED_SQL, rounded, scored
from watchfold.plans.feature_queries import WINDOWS
from watchfold.plans.registry import EVENTS_SQL, query

FEATURES = ["value", "k", "hour", "velocity_count_1h", "velocity_value_1h", "velocity_count_24h", "velocity_value_24h", "linked"]
SMALL = {"max_iter": 4, "max_depth": 3, "step_size": 0.2}


def featured(spark, sf):
    ev = scored(spark, sf).withColumn("hour", F.hour("ts")).select("event_id", "user_id", "us", "y", "value", "k", "hour")
    v = X.velocity(ev, "user_id", "us", "value", WINDOWS)
    # a signal to learn: some errors cost more
    v = v.withColumn("y", F.when((F.col("value") > 100) & (F.col("k") % 3 == 0), 1).otherwise(F.col("y")))
    return X.linkage_count(v, "k", "linked")


def fitted(spark, sf):
    parts = T.written(
        V.stratified_split(featured(spark, sf), "event_id", "y", {"train": 0.7, "calibrate": 0.1, "test": 0.2}), "features"
    )
    train, cal = (parts.where(F.col("split") == s) for s in ("train", "calibrate"))
    return T.fit_scorer(train, cal, FEATURES, "y", SMALL), parts.where(F.col("split") == "test")


@query("j3_train_predict")
def j3(spark, sf):
    scorer, test = fitted(spark, sf)
    return T.predictions(scorer, test, "event_id", "y", ["value", "velocity_count_24h"])


_TEST_SQL = f"""{EVENTS_SQL}, lab AS (SELECT event_id, CASE WHEN (value > 100 AND k % 3 = 0) OR event_type = 'error' THEN 1 ELSE 0 END AS y FROM ev),
  rk AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY sha256('42:' || event_id), event_id) - 1 AS r, count(*) OVER (PARTITION BY y) AS total FROM lab),
  test AS (SELECT event_id, CAST(y AS INTEGER) AS y FROM rk WHERE r >= floor(total * CAST(0.8 AS DOUBLE) + 0.5))"""


@query("j5_predicted_rows", f"WITH {_TEST_SQL} SELECT event_id, y, true AS is_probability FROM test")
def j5(spark, sf):
    """The test rows of the split, each with a probability."""
    scorer, test = fitted(spark, sf)
    p = T.predictions(scorer, test, "event_id", "y", [])
    return p.select("event_id", F.col("y").cast("int").alias("y"), F.coalesce(F.col("y_prob").between(0, 1), F.lit(False)).alias("is_probability"))


@query("j3_beats_chance", f"WITH {_TEST_SQL} SELECT count(*) AS rows, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 9) AS base_rate, true AS beats_base_rate, true AS in_range FROM test")
def j3_better(spark, sf):
    """The test rows, their base rate, and whether the model's average precision is above it."""
    scorer, test = fitted(spark, sf)
    p = T.predictions(scorer, test, "event_id", "y", [])
    known = p.agg(F.count(F.lit(1)).alias("rows"), F.sum("y").cast("bigint").alias("positives"), F.avg("y").alias("base_rate"))
    met = V.average_precision(p, "y", "y_prob").join(F.broadcast(known))  # a row each
    beats = (F.col("average_precision") > F.col("base_rate")).alias("beats_base_rate")
    return met.select("rows", "positives", F.round("base_rate", 9).alias("base_rate"), beats, F.col("average_precision").between(0, 1).alias("in_range"))


@query(
    "j4_isotonic_fit",
    f"""WITH {SCORED_SQL}, pt AS (SELECT round(CAST(k % 50 AS DOUBLE) / 50, 4) AS x, sum(y + CAST(k % 50 > 30 AND event_id % 3 = 0 AS INTEGER)) AS s, count(*) AS w FROM scored GROUP BY 1),
      cum AS (SELECT x, sum(s) OVER (ORDER BY x) AS cs, sum(w) OVER (ORDER BY x) AS cw, s, w FROM pt),
      blk AS (SELECT a.x AS lo, b.x AS hi, (b.cs - a.cs + a.s) / CAST(b.cw - a.cw + a.w AS DOUBLE) AS mean FROM cum a JOIN cum b ON a.x <= b.x),
      low AS (SELECT p.x, lo, min(mean) AS m FROM pt p JOIN blk ON lo <= p.x AND hi >= p.x GROUP BY 1, 2)
    SELECT x, round(max(m), 9) AS y_prob FROM low GROUP BY x""",
)
def j4_fit(spark, sf):
    """Pooled adjacent violators against the max-min formula."""
    x = F.round((F.col("k") % 50).cast("double") / 50, 4)
    y = F.col("y") + ((F.col("k") % 50 > 30) & (F.col("event_id") % 3 == 0)).cast("int")
    points = scored(spark, sf).select(x.alias("x0"), y.alias("label"))
    model = T.fit_calibrator(points, "x0", "label")
    return rounded(T.calibrate(model, points.select("x0").distinct(), "x0").select(F.col("x0").alias("x"), "y_prob"))


@query(
    "j20_precision_per_fold",
    f"""WITH {SCORED_SQL}, rk AS (SELECT y, p, CAST((row_number() OVER (PARTITION BY y ORDER BY sha256('42:' || event_id), event_id) - 1) % 3 AS INTEGER) AS fold FROM scored),
      sc AS (SELECT fold, p, sum(y) AS pos, count(*) AS n FROM rk GROUP BY 1, 2),
      cum AS (SELECT fold, p, pos, sum(pos) OVER (PARTITION BY fold ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY fold ORDER BY p DESC) AS flagged, sum(pos) OVER (PARTITION BY fold) AS t FROM sc)
    SELECT fold, round(CAST(sum(pos / t * (tp / flagged)) AS DOUBLE), 9) AS average_precision FROM cum GROUP BY 1""",
)
def j20_precision(spark, sf):
    folds = V.stratified_folds(scored(spark, sf).select("event_id", "y", "p"), "event_id", "y", 3)
    return rounded(V.average_precision(folds, "y", "p", ["fold"]))


@query("j4_calibration_quality")
def j4(spark, sf):
    scorer, test = fitted(spark, sf)
    p = T.predictions(scorer, test, "event_id", "y", [])
    return V.average_precision(p, "y", "y_prob").withColumn("base_rate", p.agg(F.avg("y")).scalar())


@query("j20_cv_scores")
def j20(spark, sf):
    folds = T.written(V.stratified_folds(featured(spark, sf), "event_id", "y", 3), "folds")
    return T.cv_scores(folds, FEATURES, "y", params=SMALL)


@query("j21_random_search")
def j21(spark, sf):
    trials = T.random_search(featured(spark, sf), "event_id", FEATURES, "y", trials=2, iterations=2)
    return V.search_summary(trials)
