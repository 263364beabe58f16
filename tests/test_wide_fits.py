"""Wide models: steered descents against the stated optimum, and their packed rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from evenhand.models import gridfit, logistic
from evenhand.workspace import fresh_path

SIZE = 1200


@pytest.fixture(scope="module")
def wide(spark):
    """3,000 rows of 1,200 columns, of which neighbours mostly occur together."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        first = rng.choice(SIZE // 2, 6, replace=False) * 2
        cols = np.sort(np.concatenate([first, (first + 1)[rng.random(6) < 0.9]]))
        vals = rng.choice([-1.0, 1.0], len(cols))
        rows.append((i, int(rng.random() < 1 / (1 + np.exp(-vals.sum() / 3))), Vectors.sparse(SIZE, cols, vals)))
    rows += [(3000, None, rows[0][2]), (3001, 1, None)]
    return spark.createDataFrame(rows, ["match_id", "radiant_win", "features"]).repartition(2).cache()


def gap(rows, weights, intercept, c):
    x = np.stack([r.features.toArray() for r in rows])
    error = 1 / (1 + np.exp(-(x @ weights + intercept))) - np.array([r.radiant_win for r in rows])
    return np.abs(weights + c * x.T @ error).max(), abs(error.sum())


@pytest.mark.parametrize("part", [200_000, 1400])
def test_steered_fits_reach_the_optimum_of_all_rows_in_few_rounds(wide, monkeypatch, part):
    monkeypatch.setattr(gridfit, "STEERING_ROWS", part)
    used = [gridfit.Candidate(1.0, 0), gridfit.Candidate(3.0, 1)]
    fits = gridfit.fit_all(wide, SIZE, used, (F.col("match_id") >= 1500).cast("int") + (F.col("match_id") >= 2400).cast("int"), tol=1e-7, max_rounds=60)
    rows = [r for r in wide.collect() if r.features is not None and r.radiant_win is not None]
    for fit, until in zip(fits, (1500, 2400)):
        assert fit.converged and fit.train_rows == until and fit.rounds <= 40
        assert max(gap([r for r in rows if r.match_id < until], fit.weights, fit.intercept, fit.candidate.c)) < 1e-7 * until * 4
    assert (fits[0].next_rows, fits[1].next_rows) == (900, 600)


def test_a_wide_model_is_a_spark_model_at_its_optimum(wide, monkeypatch):
    monkeypatch.setattr(logistic.LogisticRegression, "fit", lambda *_: pytest.fail("rows were held in memory"))
    clean = wide.dropna()
    model = logistic.fit(clean, 0.5)
    assert max(gap(clean.collect(), model.coefficients.toArray(), model.intercept, 0.5)) < 1e-4
    path = fresh_path(clean.sparkSession, "wide")
    model.write().save(path)
    again = logistic.predict(logistic.LogisticRegressionModel.load(path), clean, "again").collect()
    assert sorted(again) == sorted(logistic.predict(model, clean, "again").collect()) and len(again) == 3000
    with pytest.warns(UserWarning, match="stopped after 1 rounds"):
        logistic.fit(clean, 0.5, max_iter=1)


def test_signs_take_a_bit_and_every_share_is_kept():
    rng = np.random.default_rng(2)
    cols = [sorted(rng.choice(300, 8, replace=False).tolist()) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(cols, pa.list_(pa.int32())), pa.array([rng.choice([-1.0, 1.0], 8).tolist() for _ in cols]),
         pa.array([0] * 600 + [1] * 400, pa.int32()), pa.array(rng.integers(0, 2, 1000).astype(float))], ["cols", "vals", "block", "y"])
    packed = list(gridfit._pack([batch]))
    assert [len(p.column("cols")[0].as_py()) for p in packed] == [9600, 6400] and [len(p.column("vals")[0].as_py()) for p in packed] == [600, 400]
    unpacked = list(gridfit._unpack(packed))
    assert np.concatenate([u[1] for u in unpacked]).tolist() == sum(cols, [])
    assert np.concatenate([u[2] for u in unpacked]).tolist() == batch.column("vals").flatten().to_pylist()
    parts = list(gridfit._thin(packed, [0.5, 0.25]))
    rows = {(p.column("block")[0].as_py(), p.column("upto")[0].as_py()): p.column("rows")[0].as_py() for p in parts}
    assert set(rows) == {(0, 0), (0, 1), (1, 1)}
    assert rows[0, 1] == pytest.approx(150, abs=3) and rows[0, 0] == pytest.approx(150, abs=3) and rows[1, 1] == pytest.approx(100, abs=3)
