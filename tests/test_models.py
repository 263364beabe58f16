"""Encoding properties, the penalty of the logistic fit, the low-rank model, folds and scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.models import encoding, folds, logistic, lowrank, scoring
from evenhand.plans import training

IDS = [1, 2, 5, 8, 14, 20, 26, 35, 42, 74, 84, 101]
FIRST, SECOND = [1, 2, 5, 8, 14], [20, 26, 35, 42, 74]


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame([(h, i) for i, h in enumerate(IDS)], "hero_id int, col long")


@pytest.fixture(scope="module")
def drafts(spark):
    return spark.createDataFrame(
        [(1, FIRST, SECOND, 1), (2, SECOND, [1, 2, 5, 8, 84], 0)],
        "match_id long, radiant_team array<int>, dire_team array<int>, radiant_win int")


def terms(df):
    return {r.match_id: {t.col: t.val for t in r.terms} for r in df.collect()}


def test_index_is_contiguous(drafts):
    cols = sorted(r.col for r in encoding.entity_index(drafts).collect())
    assert cols == list(range(11))


@pytest.mark.parametrize("max_id", [encoding.MAX_DENSE_ID, 0])
def test_five_per_side_and_antisymmetric(drafts, index, max_id):
    one = terms(encoding.encode(drafts, index, max_id=max_id))
    other = terms(encoding.encode(drafts, index, max_id=max_id, team_a="dire_team", team_b="radiant_team"))
    for trial, row in one.items():
        assert sorted(row.values()) == [-1.0] * 5 + [1.0] * 5
        assert {c: -v for c, v in row.items()} == other[trial]


def test_pairwise_blocks(drafts, index):
    n = len(IDS)
    rows = terms(encoding.encode_pairwise(drafts, index, n))
    mirrored = terms(encoding.encode_pairwise(drafts, index, n, team_a="dire_team", team_b="radiant_team"))
    pairs = encoding.pair_count(n)
    for trial, row in rows.items():
        blocks = [sum(lo <= c < hi for c in row) for lo, hi in ((0, n), (n, n + pairs), (n + pairs, n + 2 * pairs))]
        assert blocks == [10, 20, 25]
        assert {c: -v for c, v in row.items()} == mirrored[trial]


def test_pair_positions_follow_row_order(spark):
    n = 7
    expected = {(i, j): k for k, (i, j) in enumerate((i, j) for i in range(n) for j in range(i + 1, n))}
    df = spark.createDataFrame(list(expected), "i int, j int")
    got = df.select("i", "j", encoding.pair_position(F.col("i"), F.col("j"), n).alias("k")).collect()
    assert {(r.i, r.j): r.k for r in got} == expected


def test_unknown_entity_is_ignored(spark, index):
    row = spark.createDataFrame([(1, [1, 2, 5, 8, 999], SECOND, 1)],
                                "match_id long, radiant_team array<int>, dire_team array<int>, radiant_win int")
    for max_id in (encoding.MAX_DENSE_ID, 0):
        values = list(terms(encoding.encode(row, index, max_id=max_id))[1].values())
        assert (values.count(1.0), values.count(-1.0)) == (4, 5)


@pytest.fixture(scope="module")
def data(spark, sf):
    from checks import fixtures as fx
    return training.prepare(fx.trials(spark, sf))


def test_fit_is_the_optimum_of_the_stated_objective(data):
    c = 0.1
    rows = data.train_vectors.toPandas()
    x = np.stack([v.toArray() for v in rows["features"]])
    y = rows["radiant_win"].to_numpy(float)
    model = logistic.fit(data.train_vectors, c, tol=1e-12, max_iter=500)
    w, b = model.coefficients.toArray(), model.intercept
    error = 1 / (1 + np.exp(-(x @ w + b))) - y
    assert np.abs(w + c * x.T @ error).max() < 1e-5
    assert abs(error.sum()) < 1e-4


def test_mirrored_logits_add_up_to_twice_the_intercept(data):
    model = logistic.fit(data.train_vectors, 0.1)
    weights = logistic.weight_table(model, data.index)
    scored = scoring.score_line_ups(data.trials, weights, model.intercept)
    mirrored = scoring.score_line_ups(
        data.trials.select("match_id", F.col("dire_team").alias("radiant_team"), F.col("radiant_team").alias("dire_team")),
        weights, model.intercept).select("match_id", F.col("logit").alias("other"))
    worst = scored.join(mirrored, "match_id").agg(F.max(F.abs(F.col("logit") + F.col("other") - 2 * model.intercept))).first()[0]
    assert worst < 1e-12
    same = logistic.predict(model, data.vectors, "m").join(scored.select("match_id", F.col("p").alias("q")), "match_id")
    assert same.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-12


def test_saved_model_predicts_the_same(spark, data):
    model = logistic.fit(data.train_vectors, 0.1)
    loaded, weights = training.save_and_load(model, data, spark)
    assert np.array_equal(loaded.coefficients.toArray(), model.coefficients.toArray())
    assert weights.count() == data.n


def test_train_rows_are_older_than_test_rows(data):
    newest = data.train.agg(F.max("match_id")).first()[0]
    oldest = data.test.agg(F.min("match_id")).first()[0]
    n = data.trials.count()
    assert newest < oldest and data.train.count() == int(n * (1 - 0.2))


def test_folds_expand(spark):
    rows = spark.range(103).select((F.col("id") * 3).alias("match_id"))
    sizes = [(rows.filter(a).count(), rows.filter(b).count(), n) for a, b, n in folds.expanding_folds(rows, 4)]
    assert sizes == [(23, 20, 23), (43, 20, 43), (63, 20, 63), (83, 20, 83)]


def test_low_rank_gradient_and_antisymmetry():
    rng = np.random.default_rng(1)
    n, rank = 9, 3
    params = lowrank.LowRank.from_flat(rng.normal(size=n * (3 * rank + 1) + 1), n, rank)
    teams = np.array([rng.permutation(n)[:6] for _ in range(20)])
    a, d, y = teams[:, :3], teams[:, 3:], rng.integers(0, 2, 20)

    def loss(x):
        z = lowrank.LowRank.from_flat(x, n, rank).logit(a, d)
        return float(np.sum(np.log1p(np.exp(z)) - y * z))

    x = params.flat()
    grad = params.gradient(a, d, 1 / (1 + np.exp(-params.logit(a, d))) - y)
    for i in range(x.size):
        step = np.zeros_like(x)
        step[i] = 1e-5
        assert grad[i] == pytest.approx((loss(x + step) - loss(x - step)) / 2e-5, rel=1e-4, abs=1e-5)
    assert np.abs(params.logit(a, d) + params.logit(d, a) - 2 * params.b).max() < 1e-9


def test_low_rank_fit_improves_and_is_antisymmetric(data):
    sides = lowrank.with_sides(data.train)
    params = lowrank.fit(sides, data.n, rank=2, steps=4)
    assert np.abs(params.w).max() > 0
    assert lowrank.antisymmetry_error(params, sides).first().max_error < 1e-9


def test_scores_by_literal_and_by_join_agree(data):
    weights = scoring.shrunk_rates(data.train, data.index)
    a = scoring.with_side_difference(data.trials, weights)
    b = scoring.with_side_difference(data.trials, weights, "other", max_id=0).select("match_id", "other")
    assert a.join(b, "match_id").filter("abs(score - other) > 1e-12").count() == 0


def test_line_up_status(spark, index):
    weights = index.select("hero_id", F.lit(0.1).alias("weight"))
    rows = [(1, FIRST, SECOND), (2, FIRST[:4], SECOND), (3, [1, 2, 5, 8, 20], SECOND), (4, [1, 2, 5, 8, None], SECOND), (5, None, SECOND)]
    df = spark.createDataFrame(rows, "match_id long, radiant_team array<int>, dire_team array<int>")
    got = {r.match_id: r for r in scoring.score_line_ups(df, weights, 0.2).collect()}
    assert [got[i].status for i in range(1, 6)] == ["ok", "incomplete", "duplicate", "incomplete", "incomplete"]
    assert got[1].p == pytest.approx(1 / (1 + np.exp(-0.2))) and got[3].p is None


@pytest.mark.parametrize("max_id", [encoding.MAX_DENSE_ID, 0])
def test_lookups_agree_on_odd_ids_and_repeated_trials(spark, max_id):
    from evenhand.models import scoring
    teams = [(1, [1, 2, 2**32 + 5], [3]), (1, [1, 2, 2**32 + 5], [3]), (1, [2], [1])]
    rows = spark.createDataFrame(teams, "match_id long, radiant_team array<bigint>, dire_team array<bigint>")
    weights = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 0.25)], "hero_id int, weight double")
    scored = scoring.with_side_difference(rows, weights, max_id=max_id).collect()
    assert sorted(r["score"] for r in scored) == [0.5, 1.25, 1.25]
    index = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "hero_id int, col int")
    terms = [[(t["col"], t["val"]) for t in r["terms"]] for r in encoding.encode(rows, index, carry=(), max_id=max_id).collect()]
    assert sorted(terms) == [[(0, -1.0), (1, 1.0)], [(0, 1.0), (1, 1.0), (2, -1.0)], [(0, 1.0), (1, 1.0), (2, -1.0)]]


def test_row_fractions_are_whole(spark):
    from evenhand.models import folds
    df = spark.range(100).withColumnRenamed("id", "match_id")
    assert [folds.with_row_fraction(df, f).count() for f in (0.1, 0.29, 0.5, 1.0)] == [10, 29, 50, 100]


def test_families_without_a_name(spark):
    from evenhand.operators.significance import adjust_false_discovery
    rows = [(None, 0.01), (None, 0.04), ("a", 0.01), ("a", None)]
    got = adjust_false_discovery(spark.createDataFrame(rows, "f string, p_value double"), family=["f"]).collect()
    assert sorted((r["f"] or "", r["p_value"] or 9, r["q_value"]) for r in got) == [("", 0.01, 0.02), ("", 0.04, 0.04), ("a", 0.01, 0.01), ("a", 9, None)]


def test_effects_without_entities(spark):
    from evenhand.operators.sizing import effect_table
    from evenhand.plans.figures import power_curve
    none = spark.createDataFrame([], "games long")
    assert [r["heroes_with_enough"] for r in effect_table(none).collect()] == [0] * 5
    assert power_curve(none, points=7).count() == 7


def test_latest_snapshot_is_dated_by_its_file(spark, tmp_path):
    from evenhand.sources.readers import read_latest_snapshot
    for day in ("2026-07-01", "2026-08-01"):
        folder = tmp_path / "run_2027-01-01"
        folder.mkdir(exist_ok=True)
        (folder / f"live_{day}.csv").write_text("hero_id,name,picks,wins,win_rate\n1,a,2,1,0.5\n")
    rows = read_latest_snapshot(spark, f"{tmp_path}/*/*.csv").collect()
    assert [r["snapshot_date"] for r in rows] == ["2026-08-01"]


def test_lookup_paths_agree_on_repeats_nulls_and_nan(spark):
    nan = float("nan")
    teams = [(1, FIRST, SECOND), (1, FIRST, SECOND), (2, None, SECOND), (3, FIRST, None), (4, FIRST, [None, 26, 35, 42, 999])]
    rows = spark.createDataFrame(teams, "match_id long, radiant_team array<int>, dire_team array<int>")
    table = [(h, 0.1 * i) for i, h in enumerate(IDS)]
    table[1], table[3], table[6] = (2, nan), (8, None), (26, float("inf"))
    weights = spark.createDataFrame(table, "hero_id int, weight double")
    index = spark.createDataFrame([(h, i) for i, h in enumerate(IDS)], "hero_id int, col int")

    def both(run):
        literal, joined = (sorted(map(str, run(m).collect())) for m in (encoding.MAX_DENSE_ID, 0))
        assert literal == joined
        return literal

    both(lambda m: encoding.encode(rows, index, carry=(), max_id=m))
    scores = both(lambda m: scoring.with_side_difference(rows, weights.fillna(0.0), max_id=m).select("match_id", "score"))
    assert sum("None" in r for r in scores) == 2
    places = both(lambda m: scoring.contributions(rows, weights, max_id=m))
    assert len(places) == 18 and sum("place=9" in r and "hero_id=2," in r for r in places) == 2
    both(lambda m: scoring.score_line_ups(rows, index.select("hero_id", F.lit(0.5).alias("weight")), 0.1, max_id=m))
