"""The written training run: searched settings reach predictions, report and bundle."""

from pyspark.sql import functions as F

from evenhand.models import logistic
from evenhand.plans import training
from evenhand.sources.readers import read_model, read_report
from evenhand.workspace import fresh_path


def test_searched_settings_reach_all_outputs(spark, sf):
    from checks import fixtures as fx
    data = training.prepare(fx.trials(spark, sf))
    grid = (0.003, 0.3, 30.0)
    run = training.train_all(data, logistic_grid=grid, pairwise_grid=(0.003,), boosting_iterations=3)
    best = logistic.search(data.train_vectors, grid, 4)[0]
    assert run.settings == {training.BASE: best, "logreg_pairwise": 0.003}
    path = fresh_path(spark, "run")
    training.write_training(run, path)
    report = read_report(spark, f"{path}/report").first()
    assert report.n_trials == data.trials.count() and report.n_test == data.test.count()
    by_model = {r.model: r for r in report.results}
    assert by_model[training.BASE].best_C == best and by_model[training.BASE].p_value is None
    loaded, _ = read_model(spark, f"{path}/bundle")
    again = logistic.predict(loaded, data.test_vectors, training.BASE).select("match_id", F.col("p").alias("q"))
    written = spark.read.parquet(f"{path}/predictions").filter(F.col("model") == training.BASE)
    assert written.join(again, "match_id").filter("abs(p - q) > 1e-12").count() == 0
    assert report.determinism.n == report.n_test
    single = training.evaluation.metrics(logistic.predict(logistic.fit(data.train_vectors, best), data.test_vectors, "x")).first()
    assert abs(single.log_loss - by_model[training.BASE].log_loss) < 1e-9
