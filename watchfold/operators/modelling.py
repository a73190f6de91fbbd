"""Training, calibration and search with MLlib."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, functions as F

from watchfold.operators.evaluation import average_precision, class_weight, stratified_folds
from watchfold.scale import hash_rank
from watchfold.session import shared_dir

# --- fixed values: default configuration and search space ---------------------------
DEFAULTS = {"max_iter": 500, "max_depth": 6, "step_size": 0.05}
SEARCH_SPACE = {
    "max_depth": (3, 10, "int"),
    "step_size": (0.01, 0.3, "log"),
    "min_instances": (1, 10, "int"),
    "subsample": (0.5, 1.0, "uniform"),
    "feature_share": (0.5, 1.0, "uniform"),
    "min_gain": (0.0, 5.0, "uniform"),
}
SEARCH_TRIALS = 25
SEARCH_FOLDS = 3
SEARCH_ROWS = 60_000
SEARCH_ITERATIONS = 200
# -------------------------------------------------------------------------------------


def written(df: DataFrame, name: str = "stage") -> DataFrame:
    """The frame as a table in the shared folder: read many times, computed once."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def train_scorer(
    train: DataFrame, valid: DataFrame | None, features: Sequence[str], label: str,
    params: Mapping[str, float] | None = None, weight: float | None = None, seed: int = 42,
) -> PipelineModel:
    """Boosted trees with class weight; stops when the validation rows no longer gain.

    Nulls are filled with the training median first.  Without ``weight`` the
    positive class weighs negatives / positives.
    """
    p = {**DEFAULTS, **(params or {})}
    if weight is None:
        weight = class_weight(train, label).first()["weight"] or 1.0
    rows = train.withColumn("__valid", F.lit(False))
    if valid is not None:
        rows = rows.unionByName(valid.withColumn("__valid", F.lit(True)))
    rows = rows.select(
        *[F.col(c).cast("double").alias(c) for c in features],
        F.col(label).cast("double").alias("__y"),
        F.when(F.col(label) == 1, float(weight)).otherwise(1.0).alias("__w"),
        "__valid",
    )
    filled = [f"__f_{c}" for c in features]
    trees = GBTClassifier(
        featuresCol="__x", labelCol="__y", weightCol="__w", predictionCol="__p",
        maxIter=int(p["max_iter"]), maxDepth=int(p["max_depth"]), stepSize=float(p["step_size"]),
        minInstancesPerNode=int(p.get("min_instances", 1)), subsamplingRate=float(p.get("subsample", 1.0)),
        featureSubsetStrategy=str(p.get("feature_share", "all")), minInfoGain=float(p.get("min_gain", 0.0)), seed=seed,
    )
    if valid is not None:
        trees = trees.setValidationIndicatorCol("__valid")
    stages = [
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="__x", handleInvalid="keep"),
        trees,
    ]
    return Pipeline(stages=stages).fit(rows)


def raw_scores(model: PipelineModel, df: DataFrame, features: Sequence[str], out: str = "raw") -> DataFrame:
    """Adds the uncalibrated probability of the positive class."""
    typed = df.withColumns({c: F.col(c).cast("double") for c in features})
    scored = model.transform(typed).withColumn(out, vector_to_array("probability")[1])
    return scored.select(*df.columns, out)


def fit_calibrator(df: DataFrame, raw: str, label: str, digits: int | None = None) -> IsotonicRegressionModel:
    """Isotonic regression of the label on the score (a probability).

    Rows of equal score are one weighted point, combined before any shuffle.  Points are pooled in each partition of the
    ordered scores first; what is left, the steps of a rising function, is pooled on the driver.  ``digits`` rounds the
    scores before that, which bounds the steps by ``10**digits + 1`` but blurs cuts at small probabilities.
    """
    x = F.col(raw) if digits is None else F.round(raw, digits)
    points = df.groupBy(x.alias("x")).agg(
        F.avg(F.col(label).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight")
    )
    return IsotonicRegression(featuresCol="x", labelCol="label", weightCol="weight", predictionCol="__cal").fit(points)


def calibrate(model: IsotonicRegressionModel, df: DataFrame, raw: str, out: str = "y_prob") -> DataFrame:
    """Adds the calibrated probability; scores outside the fitted range take its ends."""
    ready = df.withColumn("x", F.col(raw))
    return model.transform(ready).withColumn(out, F.col("__cal")).select(*df.columns, out)


class Scorer(NamedTuple):
    trees: PipelineModel
    calibrator: IsotonicRegressionModel
    features: tuple[str, ...]


def fit_scorer(
    train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, params: Mapping[str, float] | None = None
) -> Scorer:
    trees = train_scorer(train, valid, features, label, params)
    return Scorer(trees, fit_calibrator(raw_scores(trees, valid, features), "raw", label), tuple(features))


def predictions(scorer: Scorer, df: DataFrame, id_col: str, label: str, shown: Sequence[str]) -> DataFrame:
    """id, label, the shown features that exist, and ``y_prob``."""
    scored = calibrate(scorer.calibrator, raw_scores(scorer.trees, df, scorer.features), "raw")
    keep = [c for c in shown if c in df.columns and c not in (id_col, label)]
    return scored.select(id_col, label, *keep, "y_prob")


def cv_scores(
    df: DataFrame, features: Sequence[str], label: str, fold: str = "fold", folds: int = SEARCH_FOLDS,
    params: Mapping[str, float] | None = None,
) -> DataFrame:
    """Average precision of each fold by a model of the others."""
    weight = class_weight(df, label).first()["weight"] or 1.0
    scored = None
    for k in range(folds):
        model = train_scorer(df.where(F.col(fold) != k), None, features, label, params, weight)
        part = raw_scores(model, df.where(F.col(fold) == k), features).select(fold, label, "raw")
        scored = part if scored is None else scored.unionByName(part)
    return average_precision(scored, label, "raw", [fold])


def draw_params(rng: np.random.Generator, space: Mapping[str, tuple] = SEARCH_SPACE) -> dict[str, float]:
    out: dict[str, float] = {}
    for name, (lo, hi, kind) in space.items():
        if kind == "log":
            out[name] = float(np.exp(rng.uniform(np.log(lo), np.log(hi))))
        elif kind == "int":
            out[name] = int(rng.integers(lo, hi + 1))
        else:
            out[name] = float(rng.uniform(lo, hi))
    return out


def search_sample(df: DataFrame, id_col: str, rows: int = SEARCH_ROWS, seed: int = 42) -> DataFrame:
    """The search's working set: exactly ``rows`` rows (all, if fewer), by hash."""
    return hash_rank(df, id_col, (), seed).where(F.col("rank") < rows).drop("rank", "total")


def random_search(
    df: DataFrame, id_col: str, features: Sequence[str], label: str, trials: int = SEARCH_TRIALS,
    folds: int = SEARCH_FOLDS, rows: int = SEARCH_ROWS, iterations: int = SEARCH_ITERATIONS, parallelism: int = 2, seed: int = 42,
) -> DataFrame:
    """Trials (method, trial, score, params) of random configurations by cross-validation.

    The draws and the order are the driver's; every fit and evaluation is a Spark
    job over the sample, which is written once.
    """
    spark = df.sparkSession
    needed = df.select(id_col, label, *features)
    sample = written(stratified_folds(search_sample(needed, id_col, rows, seed), id_col, label, folds), "search")
    rng = np.random.default_rng(seed)
    draws = [draw_params(rng) for _ in range(trials)]

    def run(i: int) -> tuple[str, int, float, str]:
        per_fold = cv_scores(sample, features, label, "fold", folds, {**draws[i], "max_iter": iterations})
        score = per_fold.agg(F.avg("average_precision").alias("s")).first()["s"]
        return "random_search", i, float(score), str(sorted(draws[i].items()))

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        done = list(pool.map(run, range(trials)))
    return spark.createDataFrame(done, "method STRING, trial INT, score DOUBLE, params STRING")
