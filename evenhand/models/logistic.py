"""L2 logistic regression on stored vectors, with expanding-window grid search."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.models import gridfit
from evenhand.models.folds import expanding_folds
from evenhand.models.gridfit import Candidate, Fit
from evenhand.workspace import gather


def fit(
    train: DataFrame, c: float, rows: int | None = None, label: str = "radiant_win", features: str = "features",
    max_iter: int = 2000, tol: float = 1e-6,
) -> LogisticRegressionModel:
    """Minimise half the squared norm of the weights plus `c` times the summed loss.

    Spark minimises mean loss plus regParam times half the squared norm, so regParam is
    1 / (c * rows), with the row count of this very fit. Features keep their scale, as the penalty
    is meant for the raw signed columns; the intercept is not penalised. Warns if the iterations ran out.

    Wide models (over `gridfit.WIDE` columns) are fitted by the descent of the search, from packed rows: `tol` then
    bounds the largest slope of the mean objective (at most 1e-8), and the rows are never held in memory.
    """
    rows = train.count() if rows is None else rows
    size = width(train, features)
    if size > gridfit.WIDE:
        return _wide_fit(train, c, rows, size, label, features, max_iter, min(tol, 1e-8))
    model = LogisticRegression(
        featuresCol=features, labelCol=label, regParam=1.0 / (c * rows), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=tol,
    ).fit(gather(train, rows))
    if model.summary.totalIterations >= max_iter:
        warnings.warn(f"the fit with c={c} stopped at {max_iter} iterations", stacklevel=2)
    return model


def width(rows: DataFrame, features: str = "features") -> int:
    """Elements of the vectors, from any one of them; 0 if there is none."""
    vector = F.unwrap_udt(features)
    first = rows.select(F.coalesce(vector["size"], F.size(vector["values"]))).first()
    return first[0] if first and first[0] else 0


def _wide_fit(train, c, rows, size, label, features, max_iter, tol) -> LogisticRegressionModel:
    (found,) = gridfit.fit_all(
        gather(train, rows), size, [Candidate(c, 0)], F.lit(0), label, features, tol, max_iter)
    if not found.converged:
        warnings.warn(f"the fit with c={c} stopped after {found.rounds} rounds at a slope of {found.largest_slope:.1e}", stacklevel=3)
    context = train.sparkSession.sparkContext
    model = LogisticRegressionModel(context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        LogisticRegression().uid, _py2java(context, DenseVector(found.weights)), found.intercept))
    return model.setFeaturesCol(features)


def predict(model, rows: DataFrame, name: str, label: str = "radiant_win", trial: str = "match_id") -> DataFrame:
    """Predictions as (trial, model, p, y) rows."""
    scored = model.transform(rows)
    return scored.select(
        trial, F.lit(name).alias("model"), vector_to_array("probability")[1].alias("p"), F.col(label).cast("int").alias("y")
    )


def fold_fits(
    train: DataFrame, grid: Sequence[float], k: int, label: str = "radiant_win", order: str = "match_id",
    features: str = "features", tol: float = 1e-6, max_iter: int = 2000,
) -> list[list[Fit]]:
    """Fits of every C (outer) on every expanding fold (inner), all from the same scans."""
    folds = expanding_folds(train, k, order)
    block = reduce(lambda a, b: a + b, [(~earlier).cast("int") for earlier, _, _ in folds])
    rows = gather(train, folds[-1][2] if folds else 0)
    candidates = [Candidate(c, i) for c in grid for i in range(k)]
    fits = gridfit.fit_all(rows, width(train, features), candidates, block, label, features, tol, max_iter)
    return [fits[g * k:(g + 1) * k] for g in range(len(grid))]


def mean_scores(fits: Sequence[Sequence[Fit]]) -> list[tuple[float, float]]:
    """(C, mean negative log loss) over the folds with test rows; a value without any scores minus infinity."""
    def mean(folds: Sequence[Fit]) -> float:
        losses = [f.next_loss for f in folds if f.next_loss is not None]
        return -sum(losses) / len(losses) if losses else -math.inf

    return [(folds[0].candidate.c, mean(folds)) for folds in fits]


def search(
    train: DataFrame, grid: Sequence[float], k: int, label: str = "radiant_win", order: str = "match_id", **options
) -> tuple[float, list[tuple[float, float]]]:
    """The first best value of C by mean negative log loss over expanding folds, and all scores."""
    means = mean_scores(fold_fits(train, grid, k, label, order, **options))
    return max(means, key=lambda m: m[1])[0], means


def fold_table(train: DataFrame, fits: Sequence[Sequence[Fit]]) -> DataFrame:
    """One row per C and fold: rows, score, rounds, whether it converged, and whether its C is the best."""
    best = max(mean_scores(fits), key=lambda m: m[1])[0]
    rows = [
        (f.candidate.c, i, f.train_rows, f.next_rows, None if f.next_loss is None else -f.next_loss, f.rounds, f.converged,
         f.candidate.c == best) for folds in fits for i, f in enumerate(folds)]
    return train.sparkSession.createDataFrame(
        rows, "C double, fold int, train_rows long, test_rows long, neg_log_loss double, rounds int, converged boolean, best boolean")


def search_and_fit(
    train: DataFrame, grid: Sequence[float], k: int, label: str = "radiant_win", order: str = "match_id", **options
) -> tuple[LogisticRegressionModel, float, list[tuple[float, float]]]:
    """Grid search, then a fit on all training rows with the best value."""
    best, scores = search(train, grid, k, label, order, **options)
    return fit(train, best, label=label, **options), best, scores


def optimality_gap(
    model: LogisticRegressionModel, vectors: DataFrame, encoded: DataFrame, c: float, label: str = "radiant_win",
    trial: str = "match_id",
) -> DataFrame:
    """How far a fit on `vectors` is from the optimum of its objective: one row.

    At the optimum every weight equals minus `c` times its column's summed error, and the errors
    add up to zero. `encoded` holds the same trials as (col, val) terms.
    """
    error = predict(model, vectors, "fit", label, trial).select(trial, (F.col("p") - F.col("y")).alias("error"))
    slopes = (
        encoded.select(trial, F.inline("terms")).join(error, trial)
        .groupBy("col").agg(F.sum(F.col("val") * F.col("error")).alias("slope"))
    )
    weights = vectors.sparkSession.createDataFrame(
        [(i, float(w)) for i, w in enumerate(model.coefficients.toArray())], "col int, weight double")
    gaps = weights.join(slopes, "col", "left").select(
        F.abs(F.col("weight") + c * F.coalesce("slope", F.lit(0.0))).alias("gap"))
    return gaps.agg(F.count(F.lit(1)).alias("columns"), F.max("gap").alias("largest_gap")).withColumn(
        "summed_error", error.agg(F.sum("error")).scalar())


def weight_table(model: LogisticRegressionModel, index: DataFrame, entity: str = "hero_id") -> DataFrame:
    """Coefficient of each indexed entity. The model itself is a driver object of that length."""
    spark = index.sparkSession
    coefficients = spark.createDataFrame(
        [(i, float(w)) for i, w in enumerate(model.coefficients.toArray())], "col long, weight double"
    )
    return index.select(entity, F.col("col").cast("long").alias("col")).join(coefficients, "col").select(entity, "weight")
