"""Registered model queries run the functions they stand for at their defaults."""

from types import SimpleNamespace

import pytest
from pyspark.sql import DataFrame

from checks import model_checks


class Stop(Exception):
    pass


@pytest.mark.parametrize("query,owner,function", [
    (model_checks.m5, model_checks.boosting, "fit"), (model_checks.m6, model_checks.training, "reduced_pairwise_report"),
    (model_checks.m7, model_checks.training, "low_rank_report"), (model_checks.m7_error, model_checks.lowrank, "fit"),
    (model_checks.m13, model_checks.training, "all_predictions")])
def test_model_queries_set_no_smaller_job(monkeypatch, query, owner, function):
    def called(*args: DataFrame, **options):
        assert not options
        raise Stop
    monkeypatch.setattr(owner, function, called)
    monkeypatch.setattr(model_checks, "prepared", lambda spark, sf: SimpleNamespace(train=None, train_vectors=None, n=0))
    monkeypatch.setattr(model_checks.lowrank, "with_sides", lambda encoded: encoded)
    with pytest.raises(Stop):
        query(None, "")


def test_leaf_limited_boosting_makes_all_its_trees(monkeypatch):
    def called(train: DataFrame, n: int, **options):
        assert not options
        raise Stop
    monkeypatch.setattr(model_checks.leafwise, "fit", called)
    monkeypatch.setattr(model_checks, "prepared", lambda spark, sf: SimpleNamespace(train=None, n=0))
    with pytest.raises(Stop):
        model_checks.m5_leaf_limited(None, "")


def test_thresholds_with_the_same_columns_are_fitted_once(spark, monkeypatch):
    from checks import fixtures as fx
    from evenhand.models import logistic
    from evenhand.plans import training
    data = training.prepare(fx.trials(spark, "/root/testdata/sf0.001"))
    sizes = []
    monkeypatch.setattr(logistic, "search_and_fit", lambda train, grid, k: (
        sizes.append(logistic.width(train)), (logistic.fit(train, 0.01), 0.01, None))[1])
    rows = {r.model: r for r in training.reduced_pairwise_report(data, (6, 300, 400)).collect()}
    assert len(rows) == 3 and len(sizes) == 2 and sizes[0] > sizes[1] == data.n
    a, b = rows["pairwise_thresh_300"], rows["pairwise_thresh_400"]
    assert (a.roc_auc, a.n_features, a.best_C) == (b.roc_auc, b.n_features, b.best_C)
