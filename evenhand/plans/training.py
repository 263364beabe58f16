"""How much of the outcome the line-up explains: baselines, models, comparison, reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.models import boosting, encoding, evaluation, folds, logistic, lowrank, scoring
from evenhand.sources.readers import read_model
from evenhand.sources.sinks import write_model, write_report, write_table
from evenhand.workspace import concurrently, fresh_path, settle

LOGISTIC_GRID = (0.01, 0.03, 0.1, 0.3, 1.0, 3.0)
PAIRWISE_GRID = (0.0003, 0.001, 0.003, 0.01)
REDUCED_GRID = (0.003, 0.01, 0.03, 0.1, 0.3)
BASE = "logistic_regression"


@dataclass
class Prepared:
    """Stored trials, their entity index, the split in time, and vectors of the entity block."""

    trials: DataFrame
    index: DataFrame
    n: int
    train: DataFrame
    test: DataFrame
    vectors: DataFrame
    train_vectors: DataFrame
    test_vectors: DataFrame
    cut: int | None

    def split(self, table: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Split another table of the same trials at the same trial id."""
        return folds.split_at(table, self.cut)


def prepare(trials: DataFrame, test_fraction: float = 0.2) -> Prepared:
    """Store trials and entity terms once; every fit and metric starts from these tables.

    `trials` must be valid and hold each trial id once.
    """
    columns = ("match_id", "radiant_win", "bracket", "radiant_team", "dire_team")
    index = settle(encoding.entity_index(trials), "index")
    n = index.count()
    encoded = settle(encoding.encode(trials, index, carry=columns[1:]), "encoded")
    cut = folds.first_test_id(encoded, test_fraction=test_fraction)
    vectors = encoding.as_vectors(encoded, n, columns[:3])
    return Prepared(
        encoded.select(*columns), index, n, *folds.split_at(encoded, cut), vectors, *folds.split_at(vectors, cut), cut)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def majority_class(train: DataFrame, test: DataFrame, label: str = "radiant_win") -> DataFrame:
    """Every test trial gets the training rate."""
    prior = train.agg(F.avg(label)).scalar()
    return test.select("match_id", F.lit("majority_class").alias("model"), prior.alias("p"),
                       F.col(label).cast("int").alias("y"))


def solo_rate_sum(data: Prepared) -> DataFrame:
    """Difference of summed entity rates, turned into a probability by a one-column logistic fit."""
    rates = settle(scoring.shrunk_rates(data.train, data.index), "solo")
    as_column = VectorAssembler(inputCols=["score"], outputCol="features")
    train, test = (
        as_column.transform(scoring.with_side_difference(part, rates).select("match_id", "radiant_win", "score"))
        for part in (data.train, data.test)
    )
    return logistic.predict(logistic.fit(settle(train, "scores"), 1.0), test, "hero_winrate_sum")


def logistic_report(data: Prepared, grid: Sequence[float] = LOGISTIC_GRID, k: int = 4) -> DataFrame:
    """Held-out metrics of the searched logistic model, with the chosen C and every mean fold score."""
    model, best, scores = logistic.search_and_fit(data.train_vectors, grid, k)
    table = F.array(*[F.struct(F.lit(c).alias("C"), F.lit(s).alias("neg_log_loss")) for c, s in scores])
    return evaluation.metrics(logistic.predict(model, data.test_vectors, BASE)).select(
        "*", F.lit(best).alias("best_C"), table.alias("search"))


def _pairwise_vectors(data: Prepared) -> tuple[DataFrame, int]:
    encoded = data.train.unionByName(data.test)
    size = data.n + 2 * encoding.pair_count(data.n)
    return encoding.as_vectors(encoding.with_pairs(encoded, data.n), size), size


def pairwise_report(data: Prepared, grid: Sequence[float] = PAIRWISE_GRID, k: int = 3) -> DataFrame:
    """Held-out metrics of the logistic model over all three blocks."""
    vectors, size = _pairwise_vectors(data)
    train, test = data.split(vectors)
    model, best, _ = logistic.search_and_fit(train, grid, k)
    return evaluation.metrics(logistic.predict(model, test, "logreg_pairwise")).select(
        "*", F.lit(best).alias("best_C"), F.lit(size).alias("n_features"))


def reduced_pairwise_report(
    data: Prepared, thresholds: Sequence[int] = (10, 30, 100, 300), grid: Sequence[float] = REDUCED_GRID, k: int = 3,
    baseline_aucs: Sequence[float] = (),
) -> DataFrame:
    """Metrics per occurrence threshold, counted on training trials; the best by AUC is marked.

    A higher threshold keeps a part of the columns of a lower one, so thresholds that keep as many columns keep the
    same ones: they have one search and fit. With baseline AUCs, the best row says whether it beats all of them.
    """
    counts = settle(encoding.pair_occurrences(data.train, data.n), "counts")
    paired = settle(encoding.with_pairs(data.train.unionByName(data.test), data.n), "paired")
    parts, fitted = [], {}
    for threshold in thresholds:
        kept = encoding.kept_columns(counts, data.n, threshold)
        size = kept.count()
        if size not in fitted:
            train, test = data.split(encoding.as_vectors(encoding.trim(paired, kept), size))
            fitted[size] = *logistic.search_and_fit(train, grid, k)[:2], test
        model, best, test = fitted[size]
        name = f"pairwise_thresh_{threshold}"
        parts.append(evaluation.metrics(logistic.predict(model, test, name)).select(
            "*", F.lit(best).alias("best_C"), F.lit(size).alias("n_features")))
    table = settle(_union(parts), "reduced")
    winner = table.agg(F.max_by("model", "roc_auc")).scalar()
    marked = table.withColumn("is_best", F.col("model") == winner)
    if not baseline_aucs:
        return marked
    return marked.withColumn("verdict", F.when(F.col("is_best"), F.when(
        F.col("roc_auc") > max(baseline_aucs), "beats all baselines").otherwise("does not beat all baselines")))


def low_rank_report(data: Prepared, ranks: Sequence[int] = (2, 4, 8), steps: int = 60) -> DataFrame:
    """Held-out metrics of the low-rank model at several ranks."""
    train, test = lowrank.with_sides(data.train), lowrank.with_sides(data.test)
    def one(rank: int) -> DataFrame:
        return lowrank.predict(lowrank.fit(train, data.n, rank, steps=steps), test, f"low_rank_{rank}")

    return evaluation.metrics(_union(
        concurrently(train.sparkSession, [partial(one, rank) for rank in ranks])))


def ceiling(data: Prepared, c: float = 100.0) -> DataFrame:
    """In-sample predictions of a nearly unpenalised fit on all trials."""
    return logistic.predict(logistic.fit(data.vectors, c), data.vectors, "ceiling")


def determinism_report(data: Prepared, model: LogisticRegressionModel, meaningful: float = 0.05) -> DataFrame:
    """One row: held-out metrics, distance to the ceiling, and the spread of held-out probabilities."""
    held_out = settle(logistic.predict(model, data.test_vectors, "held_out"), "held_out")
    both = evaluation.metrics(held_out.unionByName(ceiling(data)))

    def one(which: str, metric: str) -> F.Column:
        return F.max(F.when(F.col("model") == which, F.col(metric)))

    scores = both.agg(
        one("held_out", "accuracy").alias("held_out_accuracy"), one("held_out", "roc_auc").alias("held_out_auc"),
        one("ceiling", "accuracy").alias("ceiling_accuracy"), one("ceiling", "roc_auc").alias("ceiling_auc"),
    ).withColumn("gap_to_ceiling_pp", (F.col("ceiling_accuracy") - F.col("held_out_accuracy")) * 100)
    spread = evaluation.probability_spread(held_out, meaningful=meaningful)
    return scores.withColumn("_s", spread.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")


@dataclass
class TrainingRun:
    """All models of one split: stored held-out predictions, the fitted base model, and the settings used."""

    data: Prepared
    predictions: DataFrame
    model: LogisticRegressionModel
    settings: dict[str, float]


def train_all(
    data: Prepared, logistic_grid: Sequence[float] = LOGISTIC_GRID, pairwise_grid: Sequence[float] = PAIRWISE_GRID,
    boosting_iterations: int = 400,
) -> TrainingRun:
    """Search, fit and predict every model once; the searched C is the one behind the predictions.

    A grid of one value needs no search.
    """
    def searched(train: DataFrame, grid: Sequence[float], k: int) -> tuple[LogisticRegressionModel, float]:
        c = grid[0] if len(grid) == 1 else logistic.search(train, grid, k)[0]
        return logistic.fit(train, c), c

    def linear():
        model, c = searched(data.train_vectors, logistic_grid, 4)
        return logistic.predict(model, data.test_vectors, BASE), model, c

    def pairwise():
        train, test = data.split(_pairwise_vectors(data)[0])
        model, c = searched(train, pairwise_grid, 3)
        return logistic.predict(model, test, "logreg_pairwise"), model, c

    def boosted() -> DataFrame:
        model = boosting.fit(data.train_vectors, boosting_iterations)
        return logistic.predict(model, data.test_vectors, "gradient_boosting")

    trees, (pairs, _, pair_c), (base, model, c), solo = concurrently(
        data.vectors.sparkSession, [boosted, pairwise, linear, partial(solo_rate_sum, data)])
    predictions = settle(_union([majority_class(data.train, data.test), trees, pairs, base, solo]), "predictions")
    return TrainingRun(data, predictions, model, {BASE: c, "logreg_pairwise": pair_c})


def all_predictions(data: Prepared, **options) -> DataFrame:
    """Held-out predictions of all models as one stored table; options as for `train_all`."""
    return train_all(data, **options).predictions


def training_report(run: TrainingRun, label: str = "radiant_win") -> DataFrame:
    """One row: sizes and rates of the split, every model's scores, C and test against the base model,
    calibration of the base model, and how decided the trials are at all.

    The nested lists have one element a model or bin.
    """
    data = run.data
    chosen = F.create_map(*[F.lit(x) for name, c in run.settings.items() for x in (name, float(c))])
    scores = comparison(run.predictions).withColumn("best_C", F.try_element_at(chosen, "model"))
    bins = evaluation.calibration(run.predictions.filter(F.col("model") == BASE))
    train, test = (part.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("rate")) for part in (data.train, data.test))

    def listed(table: DataFrame):
        return table.agg(F.array_sort(F.collect_list(F.struct("*")))).scalar()

    return train.select(
        F.col("n").alias("n_train"), test.select("n").scalar().alias("n_test"), F.lit(data.n).alias("n_entities"),
        F.col("rate").alias("rate_train"), test.select("rate").scalar().alias("rate_test"),
        listed(settle(scores.select("model", *[c for c in scores.columns if c != "model"]), "scores")).alias("results"),
        listed(settle(bins, "bins")).alias("calibration"),
        settle(determinism_report(data, run.model), "determinism").select(F.struct("*")).scalar().alias("determinism"),
    ).withColumn("n_trials", F.col("n_train") + F.col("n_test"))


def write_training(run: TrainingRun, path: str) -> None:
    """Write report, predictions and the base model's bundle below `path`."""
    write_report(training_report(run), f"{path}/report")
    write_table(run.predictions, f"{path}/predictions")
    save_and_load(run.model, run.data, run.data.vectors.sparkSession, f"{path}/bundle")


def comparison(predictions: DataFrame, base: str = BASE) -> DataFrame:
    """Metrics per model, the best log loss marked, and McNemar's test of `base` against each other."""
    scores = settle(evaluation.metrics(predictions), "scores")
    others = [r[0] for r in scores.select("model").filter(F.col("model") != base).collect()]
    tests = evaluation.with_mcnemar(_union([evaluation.paired_correctness(predictions, base, o) for o in others]))
    best = scores.agg(F.min("log_loss")).scalar()
    return (
        scores.join(tests.withColumnRenamed("compared_with", "model"), "model", "left")
        .withColumn("best_log_loss", F.col("log_loss") - best < 1e-12)
    )


def stratum_report(data: Prepared, c: float = 0.01, stratum: str = "bracket") -> DataFrame:
    """Accuracy and other metrics of one model per stratum, each split at the common trial id.

    Strata are few (a parameter of the audit). One without training rows of both outcomes or without
    test rows has no model and no row; `strata_without_data` names it.
    """
    lacking = {r[0] for r in strata_without_data(data, stratum).collect()}
    strata = [r[0] for r in data.vectors.select(stratum).distinct().orderBy(stratum).collect() if r[0] not in lacking]
    if not strata:
        return evaluation.metrics(logistic.predict(logistic.fit(data.train_vectors, c), data.test_vectors.limit(0), stratum))

    def one(s) -> DataFrame:
        here = F.col(stratum).eqNullSafe(F.lit(s))
        model = logistic.fit(data.train_vectors.filter(here), c)
        return logistic.predict(model, data.test_vectors.filter(here), f"{stratum}_{s}")

    parts = concurrently(data.vectors.sparkSession, [partial(one, s) for s in strata])
    return evaluation.metrics(_union(parts))


def strata_without_data(data: Prepared, stratum: str = "bracket", won: str = "radiant_win") -> DataFrame:
    """Strata in which no model can be fitted or judged."""
    part = data.train_vectors.select(stratum, won, F.lit(True).alias("_train")).unionByName(
        data.test_vectors.select(stratum, won, F.lit(False).alias("_train")))
    seen = part.groupBy(stratum).agg(
        F.countDistinct(F.when(F.col("_train"), F.col(won))).alias("outcomes"), F.count_if(~F.col("_train")).alias("tests"))
    return seen.filter("outcomes < 2 OR tests = 0").select(stratum)


def learning_curve(data: Prepared, c: float = 0.01, fractions: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Held-out metrics after training on growing earliest parts of the training trials."""
    def one(fraction: float) -> DataFrame:
        rows = folds.with_row_fraction(data.train_vectors, fraction)
        return logistic.predict(logistic.fit(rows, c), data.test_vectors, f"fraction_{fraction}")

    parts = concurrently(data.vectors.sparkSession, [partial(one, f) for f in fractions])
    return evaluation.metrics(_union(parts))


def save_and_load(
    model: LogisticRegressionModel, data: Prepared, spark: SparkSession, path: str | None = None
) -> tuple[LogisticRegressionModel, DataFrame]:
    """Write the model bundle and read model and weights back."""
    path = path or fresh_path(spark, "bundle")
    write_model(model, {
        "index": data.index,
        "weights": logistic.weight_table(model, data.index),
        "solo_rates": scoring.shrunk_rates(data.train, data.index),
    }, path)
    loaded, tables = read_model(spark, path)
    return loaded, tables["weights"]


def strongest_weights(weights: DataFrame, dimension: DataFrame, k: int = 15, entity: str = "hero_id") -> DataFrame:
    """The k smallest and k largest weights with names; ids without a name show the id."""
    lowest = weights.orderBy(F.col("weight").asc(), entity).limit(k)
    highest = weights.orderBy(F.col("weight").desc(), entity).limit(k)
    return (
        lowest.unionByName(highest).join(dimension.select(entity, "name"), entity, "left")
        .select(entity, F.coalesce("name", F.col(entity).cast("string")).alias("name"), "weight")
    )
