"""The one-pass grid search against single fits, and its odd cases."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from evenhand.models import gridfit, logistic
from evenhand.models.evaluation import log_loss
from evenhand.models.folds import expanding_folds
from evenhand.plans import training


@pytest.fixture(scope="module")
def vectors(spark, sf):
    from checks import fixtures as fx
    return training.prepare(fx.trials(spark, sf)).train_vectors


@pytest.mark.parametrize("fan", [gridfit.FAN, 1])
def test_every_fold_is_the_single_fit(vectors, monkeypatch, fan):
    monkeypatch.setattr(gridfit, "FAN", fan)
    monkeypatch.setattr(logistic, "gather", lambda df, rows: df.repartition(3))
    grid, k = (0.01, 1.0), 2
    fits = logistic.fold_fits(vectors, grid, k, tol=1e-9)
    for i, (earlier, block, rows) in enumerate(expanding_folds(vectors, k)):
        for folds, c in zip(fits, grid):
            model = logistic.fit(vectors.filter(earlier), c, rows, tol=1e-12)
            tested = logistic.predict(model, vectors.filter(block), "m")
            loss = tested.agg(F.avg(log_loss(F.col("p"), F.col("y")))).first()[0]
            assert folds[i].converged and folds[i].train_rows == rows and folds[i].next_rows == tested.count()
            assert np.abs(folds[i].weights - model.coefficients.toArray()).max() < 1e-5
            assert folds[i].intercept == pytest.approx(model.intercept, abs=1e-5)
            assert folds[i].next_loss == pytest.approx(loss, abs=1e-6)


def test_odd_rows_and_empty_tables(spark):
    rows = [(1, 1, Vectors.sparse(3, [], [])), (2, 0, Vectors.sparse(3, [0, 2], [1.0, -1.0])), (3, 1, Vectors.dense([1.0, 0.5, 0.0])),
            (4, None, Vectors.dense([9.0, 9.0, 9.0])), (5, 1, None), (6, 0, Vectors.dense([0.0, 1.0, 1.0]))]
    df = spark.createDataFrame(rows, ["match_id", "radiant_win", "features"])
    used = [gridfit.Candidate(0.5, 0)]
    (fit,) = gridfit.fit_all(df, 3, used, F.lit(0))
    x = np.array([[0, 0, 0], [1, 0, -1], [1, 0.5, 0], [0, 1, 1]])
    error = 1 / (1 + np.exp(-(x @ fit.weights + fit.intercept))) - np.array([1, 0, 1, 0])
    assert fit.converged and fit.train_rows == 4 and fit.next_loss is None
    assert np.abs(fit.weights + 0.5 * x.T @ error).max() < 1e-5 and abs(error.sum()) < 1e-5
    (none,) = gridfit.fit_all(df.limit(0), 3, used, F.lit(0))
    assert not none.converged and none.train_rows == 0 and not none.weights.any()
    (cut,) = gridfit.fit_all(df, 3, used, F.lit(0), max_rounds=1)
    assert not cut.converged


def test_packed_rows_keep_every_element_and_later_blocks_cost_nothing():
    import pyarrow as pa
    cols, vals = [[0, 2], [], [1], [0, 1]], [[1.0, -1.0], [], [0.5], [2.0, 1.0]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(cols, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float64())), pa.array([0, 2, 1, 0], pa.int32()),
         pa.array([1.0, 0.0, 1.0, 0.0])], ["cols", "vals", "block", "y"])
    found = {block: [a.tolist() for a in arrays] for block, *arrays in gridfit._unpack(gridfit._pack([batch]))}
    assert found == {0: [[0, 2, 0, 1], [1.0, -1.0, 2.0, 1.0], [2, 2], [1.0, 0.0]], 1: [[1], [0.5], [1], [1.0]], 2: [[], [], [0], [0.0]]}
    out = np.zeros((1, gridfit._HEAD + 4))
    for block, *arrays in gridfit._unpack(gridfit._pack([batch])):
        for piece in gridfit._pieces(*arrays):
            gridfit._add_sums(out, block, *piece, np.zeros((1, 4)), [0], False)
    # Two training rows, one row in the next block, none of the block after it.
    assert out[0, 1] == 2 and out[0, 3] == 1 and out[0, gridfit._HEAD:].tolist() == [0.5, 0.5, 0.5, 0.0]
