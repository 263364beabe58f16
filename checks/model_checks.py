"""Registered queries of features, splits, models, metrics and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.ctes import strength
from checks.registry import check
from evenhand.models import boosting, encoding, evaluation, folds, leafwise, logistic, lowrank, scoring
from evenhand.plans import training
from evenhand.sources.colocated import store_bucketed
from evenhand.sources.readers import read_report
from evenhand.workspace import dealt, fresh_path, settle

N_TRAIN = "CAST(floor((SELECT COUNT(*) FROM trials) * (1 - CAST(0.2 AS DOUBLE))) AS BIGINT)"
ORDERED = "SELECT *, row_number() OVER (ORDER BY match_id) - 1 AS pos FROM trials"

SIGNED = """SELECT match_id, col, CASE side WHEN 'radiant' THEN 1 ELSE -1 END AS val FROM facts JOIN ids USING (hero_id)"""
# Pairs of a line-up by a self-join on the trial, an independent route to the array form.
PAIRS = f"""signed AS ({SIGNED}), n AS (SELECT COUNT(*) AS n FROM ids),
    paired AS MATERIALIZED (SELECT a.match_id, a.val, a.val = b.val AS together, a.col AS i, b.col AS j,
        n + CASE WHEN a.val = b.val THEN 0 ELSE n * (n - 1) // 2 END + a.col * (2 * n - a.col - 1) // 2 + b.col - a.col - 1 AS col
        FROM signed a JOIN signed b ON a.match_id = b.match_id AND a.col < b.col, n)"""


def encoded(spark, sf, **options):
    trials = settle(fx.trials(spark, sf), "trials")
    index = encoding.entity_index(trials)
    return encoding.encode(trials, index, **options), index


def r9(*names: str):
    return [F.round(n, 9).alias(n) for n in names]


# --- encoding ------------------------------------------------------------------------------


@check("e1_a14_u2_entity_index", "SELECT hero_id, col FROM ids")
def e1(spark, sf):
    return encoding.entity_index(fx.trials(spark, sf))


@check("e3_e2_j5_signed_terms", f"""
    SELECT match_id, CAST(col AS INT) AS col, CAST(val AS DOUBLE) AS val FROM ({SIGNED}) WHERE col % 2 = 0""")
def e3(spark, sf):
    trials = settle(fx.trials(spark, sf), "trials")
    known = encoding.entity_index(trials).filter(F.col("col") % 2 == 0)
    return encoding.long_form(encoding.encode(trials, known))


@check("e3_signed_terms_by_join", f"SELECT match_id, CAST(col AS INT) AS col, CAST(val AS DOUBLE) AS val FROM ({SIGNED})")
def e3_join(spark, sf):
    return encoding.long_form(encoded(spark, sf, max_id=0)[0])


@check("e4_single_line_up", f"""
    SELECT match_id, CAST(col AS INT) AS col, CAST(val AS DOUBLE) AS val FROM ({SIGNED})
    WHERE match_id = (SELECT min(match_id) FROM trials)""")
def e4(spark, sf):
    trials = settle(fx.trials(spark, sf), "trials")
    one = trials.filter(F.col("match_id") == trials.agg(F.min("match_id")).scalar())
    return encoding.long_form(encoding.encode(one, encoding.entity_index(trials)))


# All terms of a trial as one digest: a row per term is too much to compare for some clients.
def per_trial(long):
    """Number and digest of the terms of each trial, from (match_id, col, val) rows.

    Rows unpacked from `dealt` line-ups are not shuffled again.
    """
    terms = long.select("match_id", "col", F.concat_ws(":", "col", F.col("val").cast("int")).alias("t"))
    ordered = F.expr("listagg(t, ' ') WITHIN GROUP (ORDER BY col, t)")
    return terms.groupBy("match_id").agg(F.count(F.lit(1)).alias("terms"), F.md5(ordered).alias("digest"))


PER_TRIAL = "SELECT match_id, COUNT(*) AS terms, md5(string_agg(col || ':' || CAST(val AS INT), ' ' ORDER BY col)) AS digest"


@check("e5_e6_j9_pair_terms", f"""WITH {PAIRS}
    {PER_TRIAL} FROM (SELECT match_id, col, val FROM paired UNION ALL SELECT match_id, col, val FROM signed) GROUP BY 1""")
def e6(spark, sf):
    enc, index = encoded(spark, sf)
    stored = settle(enc, "encoded")
    return per_trial(encoding.pairwise_rows(dealt(stored, "match_id", stored.count()), index.count()))


@check("e7_kept_columns", f"""WITH {PAIRS}, c AS (SELECT col FROM paired GROUP BY col HAVING COUNT(*) >= 30
        UNION ALL SELECT col FROM ids)
    SELECT CAST(col AS INT) AS col, row_number() OVER (ORDER BY col) - 1 AS new_col FROM c""")
def e7(spark, sf):
    enc, index = encoded(spark, sf)
    n = index.count()
    return encoding.kept_columns(encoding.pair_occurrences(enc, n), n, 30)


@check("e7_trimmed_terms", f"""WITH {PAIRS}, c AS (SELECT col FROM paired GROUP BY col HAVING COUNT(*) >= 30
        UNION ALL SELECT col FROM ids), k AS (SELECT col AS old, row_number() OVER (ORDER BY col) - 1 AS col FROM c)
    {PER_TRIAL} FROM (SELECT match_id, k.col, val FROM
        (SELECT match_id, col AS old, val FROM paired UNION ALL SELECT match_id, col, val FROM signed) JOIN k USING (old)) GROUP BY 1""")
def e7_terms(spark, sf):
    enc, index = encoded(spark, sf)
    n = index.count()
    enc = settle(enc, "encoded")
    kept = encoding.kept_columns(encoding.pair_occurrences(enc, n), n, 30)
    trimmed = encoding.trim(encoding.with_pairs(enc, n), kept).select("match_id", "terms")
    return per_trial(encoding.long_form(dealt(trimmed, "match_id", enc.count())))


@check("e8_antisymmetry", f"""WITH {PAIRS}
    SELECT (SELECT COUNT(*) FROM paired) + (SELECT COUNT(*) FROM signed) AS terms, CAST(0 AS BIGINT) AS violations""")
def e8(spark, sf):
    trials = settle(fx.trials(spark, sf), "trials")
    index = encoding.entity_index(trials)
    n = index.count()
    rows = trials.count()
    as_is = encoding.encode_pairwise(trials, index, n)
    swapped = encoding.encode_pairwise(trials, index, n, team_a="dire_team", team_b="radiant_team")
    both = reduce(DataFrame.unionByName, [
        encoding.long_form(dealt(side.select("match_id", "terms"), "match_id", rows)) for side in (as_is, swapped)])
    sums = both.groupBy("match_id", "col").agg(F.sum("val").alias("s"))
    return sums.agg(F.count(F.lit(1)).alias("terms"), F.count_if(F.col("s") != 0).alias("violations"))


@check("a12_pair_occurrences", f"""WITH {PAIRS}, seen AS (SELECT col, COUNT(*) AS k FROM paired GROUP BY col)
    SELECT CAST(u.col AS INT) AS col, CASE WHEN u.col < n + n * (n - 1) // 2 THEN 'synergy' ELSE 'counter' END AS kind,
        coalesce(k, 0) AS n
    FROM (SELECT n, unnest(generate_series(n, n + n * (n - 1) - 1)) AS col FROM n) u LEFT JOIN seen USING (col)""")
def a12(spark, sf):
    enc, index = encoded(spark, sf)
    return encoding.pair_occurrences(enc, index.count())


@check("a13_occurrence_classes", f"""WITH {PAIRS}, seen AS (SELECT col, COUNT(*) AS k FROM paired GROUP BY col)
    SELECT n * (n - 1) - (SELECT COUNT(*) FROM seen) AS never,
        (SELECT COUNT(*) FROM seen WHERE k < 10) AS "1_to_9", (SELECT COUNT(*) FROM seen WHERE k BETWEEN 10 AND 29) AS "10_to_29",
        (SELECT COUNT(*) FROM seen WHERE k >= 30) AS at_least_30, (SELECT COUNT(*) FROM seen WHERE k >= 100) AS at_least_100,
        n * (n - 1) AS total_columns FROM n""")
def a13(spark, sf):
    enc, index = encoded(spark, sf)
    return encoding.occurrence_classes(encoding.pair_occurrences(enc, index.count()))


# --- order -----------------------------------------------------------------------------------


@check("w2_chronological_split", f"""
    SELECT match_id, CASE WHEN pos < {N_TRAIN} THEN 'train' ELSE 'test' END AS part FROM ({ORDERED})""")
def w2(spark, sf):
    train, test = folds.chronological_split(settle(fx.trials(spark, sf), "trials"))
    return train.select("match_id", F.lit("train").alias("part")).unionByName(
        test.select("match_id", F.lit("test").alias("part")))


@check("w3_expanding_folds", f"""
    WITH o AS ({ORDERED}), n AS (SELECT COUNT(*) AS n, COUNT(*) // 5 AS size FROM trials)
    SELECT i AS fold, COUNT(*) FILTER (pos < n - (4 - i) * size) AS train_rows,
        COUNT(*) FILTER (pos >= n - (4 - i) * size AND pos < n - (3 - i) * size) AS test_rows,
        min(match_id) FILTER (pos >= n - (4 - i) * size) AS first_test
    FROM o, n, (SELECT CAST(unnest([0, 1, 2, 3]) AS INT) AS i) GROUP BY i""")
def w3(spark, sf):
    trials = settle(fx.trials(spark, sf), "trials")
    parts = [
        trials.agg(F.count_if(train).alias("train_rows"), F.count_if(test).alias("test_rows"),
                   F.min(F.when(test, F.col("match_id"))).alias("first_test")).withColumn("fold", F.lit(i))
        for i, (train, test, _) in enumerate(folds.expanding_folds(trials, 4))
    ]
    return fx.union_all(parts)


@check("row_index", f"SELECT match_id, pos AS row_index FROM ({ORDERED})")
def row_index(spark, sf):
    from evenhand.operators.ranking import with_global_index
    return with_global_index(fx.trials(spark, sf).select("match_id"), "match_id", rows_per_range=1500)


@check("a9_exact_quantiles", """
    SELECT round(quantile_cont(p, 0.01), 9) AS p1, round(quantile_cont(p, 0.5), 9) AS median,
        round(quantile_cont(p, 0.99), 9) AS p99, quantile_cont(match_id, 0.25) AS id_quarter
    FROM predictions WHERE model = 'full'""")
def a9(spark, sf):
    from evenhand.operators.ranking import exact_quantiles
    full = settle(fx.predictions(spark, sf).filter(F.col("model") == "full"), "predictions")
    p1, median, p99 = exact_quantiles(full, "p", [0.01, 0.5, 0.99])
    (quarter,) = exact_quantiles(full, "match_id", [0.25])
    # One row, whose numbers come from the whole table.
    return full.agg(F.lit(round(p1, 9)).alias("p1"), F.lit(round(median, 9)).alias("median"),
                    F.lit(round(p99, 9)).alias("p99"), F.lit(float(quarter)).alias("id_quarter"))


# --- metrics on closed-form predictions --------------------------------------------------------

AUC = """SELECT model, sum(y * (below + same / 2.0)) / (sum(y) * CAST(sum(1 - y) AS DOUBLE)) AS roc_auc FROM
    (SELECT *, coalesce(sum(1 - y) OVER (PARTITION BY model ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
        - sum(1 - y) OVER (PARTITION BY model, p) AS below, sum(1 - y) OVER (PARTITION BY model, p) AS same FROM
        predictions) GROUP BY model"""


@check("m10_metrics", f"""
    SELECT model, COUNT(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
        round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 9) AS log_loss, round(avg((p - y) * (p - y)), 9) AS brier,
        round(any_value(roc_auc), 8) AS roc_auc FROM predictions JOIN ({AUC}) USING (model) GROUP BY model""")
def m10(spark, sf):
    predictions = settle(fx.predictions(spark, sf), "predictions")
    return evaluation.metrics(predictions, rows_per_range=4000).select(
        "model", "n", *r9("accuracy", "log_loss", "brier"), F.round("roc_auc", 8).alias("roc_auc"))


@check("m11_calibration", """
    WITH f AS (SELECT * FROM predictions WHERE model = 'full'),
    e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM f)
    SELECT CAST(len([x for x in edges if x < p]) AS INT) AS bin, COUNT(*) AS n, round(avg(y), 9) AS prob_true,
        round(avg(p), 9) AS prob_pred FROM f, e GROUP BY 1""")
def m11(spark, sf):
    full = settle(fx.predictions(spark, sf).filter(F.col("model") == "full"), "predictions")
    return evaluation.calibration(full).select("bin", "n", *r9("prob_true", "prob_pred"))


@check("a10_probability_spread", """
    SELECT COUNT(*) AS n, round(min(p), 9) AS min, round(max(p), 9) AS max, round(quantile_cont(p, 0.01), 9) AS p1,
        round(quantile_cont(p, 0.99), 9) AS p99, round(stddev_pop(p) * 100, 7) AS sd_pp,
        round(avg(CASE WHEN abs(p - 0.5) > 0.05 THEN 1.0 ELSE 0.0 END), 9) AS share_meaningfully_decided,
        round(median(abs(p - 0.5)) * 100, 7) AS median_edge_pp FROM predictions WHERE model = 'full'""")
def a10(spark, sf):
    full = settle(fx.predictions(spark, sf).filter(F.col("model") == "full"), "predictions")
    return evaluation.probability_spread(full).select(
        "n", *r9("min", "max", "p1", "p99"), F.round("sd_pp", 7).alias("sd_pp"),
        *r9("share_meaningfully_decided"), F.round("median_edge_pp", 7).alias("median_edge_pp"))


@check("a18_probability_histogram", """
    WITH f AS (SELECT p FROM predictions WHERE model = 'half'),
    r AS (SELECT min(p) AS lo, (max(p) - min(p)) / 60 AS w FROM f)
    SELECT CAST(least(floor((p - lo) / w), 59) AS INT) AS bin, COUNT(*) AS n FROM f, r GROUP BY 1""")
def a18(spark, sf):
    half = settle(fx.predictions(spark, sf).filter(F.col("model") == "half"), "predictions")
    return evaluation.histogram(half).select("bin", "n")


@check("a16_t13_mcnemar", """
    WITH c AS (SELECT match_id, model, (p >= 0.5) = (y = 1) AS ok FROM predictions),
    t AS (SELECT b.model AS compared_with, COUNT(*) FILTER (a.ok AND b.ok) AS both_right, COUNT(*) FILTER (a.ok AND NOT b.ok) AS only_base,
        COUNT(*) FILTER (NOT a.ok AND b.ok) AS only_other, COUNT(*) FILTER (NOT a.ok AND NOT b.ok) AS both_wrong
        FROM c a JOIN c b USING (match_id) WHERE a.model = 'full' AND b.model <> 'full' GROUP BY 1),
    s AS (SELECT *, pow(abs(only_base - only_other) - 1, 2) / CAST(only_base + only_other AS DOUBLE) AS statistic FROM t)
    SELECT *, CASE WHEN statistic > 3.841458820694124 THEN 'significant' ELSE 'no significant difference' END AS verdict
    FROM (SELECT * REPLACE (round(statistic, 8) AS statistic), round(1 - 2 / sqrt(pi()) * exp(-statistic / 2)
        * (SELECT sum(exp(k * ln(2.0) + (2 * k + 1) * ln(sqrt(statistic / 2)) - (lgamma(2 * k + 2.0) - k * ln(2.0) - lgamma(k + 1.0))))
           FROM unnest(generate_series(0, 5000)) AS g(k)), 8) AS p_value FROM s)""")
def t13(spark, sf):
    predictions = settle(fx.predictions(spark, sf), "predictions")
    tables = fx.union_all([evaluation.paired_correctness(predictions, "full", other) for other in ("half", "const")])
    return evaluation.with_mcnemar(tables).withColumns(
        {"statistic": F.round("statistic", 8), "p_value": F.round("p_value", 8)})


# --- baselines and scoring -----------------------------------------------------------------------

SOLO = f"""o AS ({ORDERED}), train AS (SELECT * FROM o WHERE pos < {N_TRAIN}),
    prior AS (SELECT avg(radiant_win) AS prior FROM train),
    solo AS (SELECT i.hero_id, COUNT(t.match_id) AS games, CAST(coalesce(SUM(f.won) FILTER (t.match_id IS NOT NULL), 0) AS BIGINT) AS wins
        FROM ids i LEFT JOIN facts f USING (hero_id) LEFT JOIN train t ON t.match_id = f.match_id GROUP BY 1),
    shrunk AS (SELECT hero_id, games, wins, (wins + 25 * prior) / (games + 25) AS weight FROM solo, prior)"""


def solo_rates(spark, sf):
    trials = settle(fx.trials(spark, sf), "trials")
    train, test = folds.chronological_split(trials)
    return scoring.shrunk_rates(train, encoding.entity_index(trials)), train, test


@check("a11_shrunk_rates", f"WITH {SOLO} SELECT hero_id, games, wins, round(weight, 9) AS weight FROM shrunk")
def a11(spark, sf):
    return solo_rates(spark, sf)[0].select("hero_id", "games", "wins", *r9("weight"))


SIGNED_SUM = """SELECT f.match_id, sum(CASE side WHEN 'radiant' THEN weight ELSE -weight END) AS score
    FROM facts f JOIN shrunk USING (hero_id) GROUP BY 1"""


@check("m2_j6_solo_scores", f"WITH {SOLO} SELECT match_id, round(score, 8) AS score FROM ({SIGNED_SUM}) WHERE match_id NOT IN (SELECT match_id FROM train)")
def m2_scores(spark, sf):
    rates, _, test = solo_rates(spark, sf)
    return scoring.with_side_difference(test, rates).select("match_id", F.round("score", 8).alias("score"))


@check("m2_solo_scores_by_join", f"WITH {SOLO} SELECT match_id, round(score, 8) AS score FROM ({SIGNED_SUM})")
def m2_join(spark, sf):
    rates, train, test = solo_rates(spark, sf)
    return scoring.with_side_difference(train.unionByName(test), rates, max_id=0).select(
        "match_id", F.round("score", 8).alias("score"))


@check("m1_majority_class", f"""
    WITH o AS ({ORDERED}), prior AS (SELECT avg(radiant_win) AS p FROM o WHERE pos < {N_TRAIN})
    SELECT 'majority_class' AS model, COUNT(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (radiant_win = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
        round(avg(-ln(CASE WHEN radiant_win = 1 THEN p ELSE 1 - p END)), 9) AS log_loss,
        round(avg((p - radiant_win) * (p - radiant_win)), 9) AS brier, CAST(0.5 AS DOUBLE) AS roc_auc
    FROM o, prior WHERE pos >= {N_TRAIN}""")
def m1(spark, sf):
    train, test = folds.chronological_split(settle(fx.trials(spark, sf), "trials"))
    return evaluation.metrics(training.majority_class(train, test)).select(
        "model", "n", *r9("accuracy", "log_loss", "brier"), "roc_auc")


# Every 11th line-up repeats an entity, every 50th is incomplete already.
LINE_UPS = f"""SELECT match_id, r, CASE WHEN match_id % 11 = 0 THEN list_concat([r[1]], d[2:]) ELSE d END AS d FROM listed"""


def line_ups(spark, sf):
    repeated = F.concat(F.slice("radiant_team", 1, 1), F.slice("dire_team", 2, 4))
    return fx.arrays(spark, sf).select(
        "match_id", "radiant_team", F.when(F.col("match_id") % 11 == 0, repeated).otherwise(F.col("dire_team")).alias("dire_team"))


def known_weights(spark, sf):
    return settle(fx.weights(spark, sf).filter("hero_id % 10 <> 9"), "weights")


W = f"CAST(0.24 AS DOUBLE) * {strength('h')} / CAST(63.0 AS DOUBLE)"


@check("m12_scored_line_ups", f"""
    WITH l AS ({LINE_UPS}), s AS (SELECT match_id, CASE WHEN list_contains(list_concat(r, d), 0) THEN 'incomplete'
        WHEN len(list_distinct(list_concat(r, d))) < 10 THEN 'duplicate' ELSE 'ok' END AS status,
        0.11 + coalesce(list_sum([{W} for h in r if h % 10 <> 9]), 0) - coalesce(list_sum([{W} for h in d if h % 10 <> 9]), 0) AS z FROM l),
    p AS (SELECT match_id, status, CASE WHEN status = 'ok' THEN z END AS logit FROM s)
    SELECT match_id, status, round(logit, 8) AS logit, round(1 / (1 + exp(-logit)), 8) AS p,
        round(abs(1 / (1 + exp(-logit)) - 0.5) * 100, 6) AS edge_pp,
        CASE WHEN abs(1 / (1 + exp(-logit)) - 0.5) * 100 > 5.15 THEN 'more lopsided' WHEN logit IS NOT NULL THEN 'less lopsided' END AS comparison
    FROM p""")
def m12(spark, sf):
    scored = scoring.score_line_ups(line_ups(spark, sf), known_weights(spark, sf), fx.INTERCEPT, 5.15)
    return scored.select("match_id", "status", F.round("logit", 8).alias("logit"), F.round("p", 8).alias("p"),
                         F.round("edge_pp", 6).alias("edge_pp"), "comparison")


CONTRIBUTIONS = f"""
    WITH l AS ({LINE_UPS}), ok AS (SELECT * FROM l WHERE NOT list_contains(list_concat(r, d), 0)
        AND len(list_distinct(list_concat(r, d))) = 10),
    c AS (SELECT match_id, 'radiant' AS side, unnest(r) AS h, 1 AS s FROM ok UNION ALL SELECT match_id, 'dire', unnest(d), -1 FROM ok)
    SELECT match_id, side, h AS hero_id, round(s * {W}, 9) AS log_odds,
        CAST(row_number() OVER (PARTITION BY match_id ORDER BY abs(s * {W}) DESC, h) AS INT) AS place
    FROM c WHERE h % 10 <> 9"""


@check("m12_k6_contributions", CONTRIBUTIONS)
def m12_parts(spark, sf):
    return scoring.contributions(line_ups(spark, sf), known_weights(spark, sf)).withColumn("log_odds", F.round("log_odds", 9))


@check("m12_contributions_by_join", CONTRIBUTIONS)
def m12_join(spark, sf):
    parts = scoring.contributions(line_ups(spark, sf), known_weights(spark, sf), max_id=0)
    return parts.withColumn("log_odds", F.round("log_odds", 9))


@check("s9_colocated_join", """SELECT hero_id, COUNT(*) AS n, round(avg(p), 9) AS mean_p, round(avg(y), 9) AS mean_y
    FROM facts JOIN predictions USING (match_id) WHERE model = 'full' GROUP BY 1""")
def s9_colocated(spark, sf):
    """Facts and predictions stored by trial id; their join has no exchange of its own."""
    facts = store_bucketed(fx.facts(spark, sf).select("match_id", "hero_id"), "match_id", 16, "facts")
    full = fx.predictions(spark, sf).filter(F.col("model") == "full").select("match_id", "p", "y")
    joined = facts.join(store_bucketed(full, "match_id", 16, "predictions"), "match_id")
    return joined.groupBy("hero_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 9).alias("mean_p"), F.round(F.avg("y"), 9).alias("mean_y"))


# --- fitted models: properties and metrics only ----------------------------------------------------


def prepared(spark, sf):
    return training.prepare(fx.trials(spark, sf))


@check("m2_solo_rate_sum")
def m2(spark, sf):
    data = prepared(spark, sf)
    return evaluation.metrics(training.solo_rate_sum(data))


@check("m3_m16_logistic_search")
def m3(spark, sf):
    return training.logistic_report(prepared(spark, sf))


# Every fit of the search: its rows by plain counting, one best value, slopes within the tolerance.
@check("m16_fold_fits", f"""
    WITH n AS (SELECT COUNT(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY match_id) - 1 AS pos FROM trials) WHERE pos < {N_TRAIN})
    SELECT C, fold, n - (4 - fold) * (n // 5) AS train_rows, n // 5 AS test_rows, true AS converged, CAST(1 AS BIGINT) AS best_values
    FROM n, (SELECT CAST(unnest([0, 1, 2, 3]) AS INT) AS fold), (SELECT unnest([0.01, 0.03, 0.1, 0.3, 1.0, 3.0])::DOUBLE AS C)""")
def m16(spark, sf):
    data = prepared(spark, sf)
    table = logistic.fold_table(data.train_vectors, logistic.fold_fits(data.train_vectors, training.LOGISTIC_GRID, 4))
    best = table.filter("best").agg(F.countDistinct("C")).scalar()
    return table.select("C", "fold", "train_rows", "test_rows", "converged", best.alias("best_values"))


@check("m3_optimality", "SELECT COUNT(*) AS columns, true AS at_optimum FROM ids")
def m3_optimality(spark, sf):
    data = prepared(spark, sf)
    model = logistic.fit(data.vectors, 0.1, tol=1e-12, max_iter=500)
    return at_optimum(logistic.optimality_gap(model, data.vectors, data.train.unionByName(data.test), 0.1))


@check("m4_optimality", "SELECT COUNT(*) * COUNT(*) AS columns, true AS at_optimum FROM ids")
def m4_optimality(spark, sf):
    data = prepared(spark, sf)
    paired = settle(encoding.with_pairs(data.train.unionByName(data.test), data.n), "paired")
    vectors = encoding.as_vectors(paired, data.n + 2 * encoding.pair_count(data.n))
    model = logistic.fit(vectors, 0.003, tol=1e-12, max_iter=500)
    return at_optimum(logistic.optimality_gap(model, vectors, paired, 0.003))


def at_optimum(gap):
    good = (F.col("largest_gap") < 1e-4) & (F.abs("summed_error") < 1e-2)
    return gap.select("columns", good.alias("at_optimum"))


@check("m8_in_sample_mean", "SELECT COUNT(*) AS n, round(avg(radiant_win), 5) AS mean_p FROM trials")
def m8_mean(spark, sf):
    """The unpenalised intercept makes the mean prediction equal the observed rate."""
    data = prepared(spark, sf)
    fitted = logistic.predict(logistic.fit(data.vectors, 100.0, tol=1e-12, max_iter=500), data.vectors, "ceiling")
    return fitted.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 5).alias("mean_p"))


@check("m8_ceiling")
def m8(spark, sf):
    return evaluation.metrics(training.ceiling(prepared(spark, sf)))


@check("m9_determinism_report")
def m9(spark, sf):
    data = prepared(spark, sf)
    model = logistic.fit(data.train_vectors, 0.01)
    return training.determinism_report(data, model)


@check("k5_s8_strongest_weights")
def k5(spark, sf):
    data = prepared(spark, sf)
    model = logistic.fit(data.train_vectors, 0.01)
    return training.strongest_weights(training.save_and_load(model, data, spark)[1], fx.heroes(spark, sf), 15)


@check("m4_pairwise_logistic")
def m4(spark, sf):
    return training.pairwise_report(prepared(spark, sf))


@check("m6_k7_reduced_pairwise")
def m6(spark, sf):
    return training.reduced_pairwise_report(prepared(spark, sf))


@check("m5_gradient_boosting")
def m5(spark, sf):
    data = prepared(spark, sf)
    model = boosting.fit(data.train_vectors)
    return evaluation.metrics(logistic.predict(model, data.test_vectors, "gradient_boosting"))

# The first tree grown best first in SQL: every step picks the split with the largest gain over all leaves.
SPLITS = 30
FIRST_MARGIN = "CAST((SELECT avg(radiant_win) FROM trials) AS DOUBLE)"


def _gains(leaves: str) -> str:
    """Gains of all (leaf, column, threshold) whose sides hold 20 rows and a curvature of 0.001."""
    score = "pow({0} * p - {1}, 2) / ({0} * p * (1 - p) + 1)"
    gain = f"{score.format('nl', 'yl')} + {score.format('(n - nl)', '(y - yl)')} - {score.format('n', 'y')}"
    return f"""SELECT leaf, col, upper, nl, yl, n, y, round({gain}, 9) AS gain FROM
        (SELECT leaf, col, unnest([0, 1]) AS upper, unnest([nm, n - np]) AS nl, unnest([ym, y - yp]) AS yl, n, y, p FROM
            (SELECT leaf, col, COUNT(*) FILTER (val < 0) AS nm, coalesce(SUM(won) FILTER (val < 0), 0) AS ym,
                COUNT(*) FILTER (val > 0) AS np, coalesce(SUM(won) FILTER (val > 0), 0) AS yp
             FROM signed JOIN {leaves} USING (match_id) GROUP BY 1, 2)
            JOIN (SELECT leaf, COUNT(*) AS n, SUM(won) AS y FROM {leaves} GROUP BY 1) USING (leaf),
            (SELECT {FIRST_MARGIN} AS p))
        WHERE nl >= 20 AND n - nl >= 20 AND nl * p * (1 - p) >= 0.001 AND (n - nl) * p * (1 - p) >= 0.001"""


def _steps(k: int) -> str:
    return ",\n".join([f"signed AS MATERIALIZED ({SIGNED})",
        "l0 AS MATERIALIZED (SELECT match_id, radiant_win AS won, CAST(0 AS BIGINT) AS leaf FROM trials)"] + [
        f"""b{i} AS MATERIALIZED (SELECT * FROM ({_gains(f'l{i - 1}')}) WHERE gain > 0 ORDER BY gain DESC, leaf, col, upper LIMIT 1),
    l{i} AS MATERIALIZED (SELECT l.match_id, l.won, CASE WHEN b.leaf = l.leaf AND coalesce(s.val, 0) >= b.upper THEN {i} ELSE l.leaf END AS leaf
        FROM l{i - 1} l LEFT JOIN b{i} b ON true LEFT JOIN signed s ON s.match_id = l.match_id AND s.col = b.col)""" for i in range(1, k + 1)])


@check("m5_first_splits", f"WITH {_steps(SPLITS)} " + " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS step, leaf, col, CAST(upper AS BIGINT) AS upper, nl AS n_left, n - nl AS n_right, round(gain, 6) AS gain FROM b{i}" for i in range(1, SPLITS + 1)))
def m5_splits(spark, sf):
    enc, index = encoded(spark, sf, carry=("radiant_win",))
    _, splits = leafwise.first_tree(enc, index.count())
    label, rows = {0: 0}, []
    for step, (node, split, children) in enumerate(splits, 1):
        rows.append((step, label[node], split.col, split.upper, round(split.left[2]), round(split.right[2]), round(split.gain, 6)))
        label[children[0]], label[children[1]] = label[node], step
    return spark.createDataFrame(rows, "step long, leaf long, col long, upper long, n_left long, n_right long, gain double")


@check("m5_first_tree", f"""WITH {_steps(SPLITS)}, v AS (SELECT leaf, COUNT(*) AS n, SUM(won) AS y, any_value(p) AS p FROM l{SPLITS},
        (SELECT {FIRST_MARGIN} AS p) GROUP BY 1)
    SELECT match_id, l.won AS y, round(1 / (1 + exp(-(ln(p / (1 - p)) - CAST(0.06 AS DOUBLE) * (n * p - v.y) / (n * p * (1 - p) + 1)))), 9) AS p
    FROM l{SPLITS} l JOIN v USING (leaf)""")
def m5_tree(spark, sf):
    enc, index = encoded(spark, sf, carry=("radiant_win",))
    model, _ = leafwise.first_tree(enc, index.count())
    return leafwise.predict(model, enc, "first").select("match_id", "y", F.round("p", 9).alias("p"))


@check("m5_leaf_limited_boosting")
def m5_leaf_limited(spark, sf):
    data = prepared(spark, sf)
    model = leafwise.fit(data.train, data.n)
    return evaluation.metrics(leafwise.predict(model, data.test, "leaf_limited")).withColumn("trees", F.lit(len(model.trees)))


@check("m7_low_rank")
def m7(spark, sf):
    return training.low_rank_report(prepared(spark, sf))


@check("m7_low_rank_batches", "SELECT COUNT(*) AS n, true AS antisymmetric FROM (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY match_id) - 1 AS pos FROM trials) WHERE pos < "
       + N_TRAIN + ")")
def m7_batches(spark, sf):
    """Ten passes over eight stored batches."""
    data = prepared(spark, sf)
    sides = lowrank.with_sides(data.train)
    params = lowrank.fit(sides, data.n, steps=80, batches=8)
    error = lowrank.antisymmetry_error(params, sides)
    return error.select("n", (F.col("max_error") < 1e-9).alias("antisymmetric"))


@check("m7_low_rank_antisymmetry", f"SELECT {N_TRAIN} AS n, true AS antisymmetric")
def m7_error(spark, sf):
    data = prepared(spark, sf)
    sides = lowrank.with_sides(data.train)
    params = lowrank.fit(sides, data.n)
    error = lowrank.antisymmetry_error(params, sides)
    return error.select("n", (F.col("max_error") < 1e-9).alias("antisymmetric"))


@check("m13_model_comparison")
def m13(spark, sf):
    return training.comparison(training.all_predictions(prepared(spark, sf)))


# The written run read back: its sizes by plain counting, its lists against themselves.
@check("m13_m9_s8_training_report", f"""
    WITH o AS ({ORDERED}), n AS (SELECT COUNT(*) FILTER (pos < {N_TRAIN}) AS n_train, COUNT(*) FILTER (pos >= {N_TRAIN}) AS n_test,
        avg(radiant_win) FILTER (pos < {N_TRAIN}) AS tr, avg(radiant_win) FILTER (pos >= {N_TRAIN}) AS te FROM o)
    SELECT n_train + n_test AS n_trials, n_train, n_test, (SELECT COUNT(*) FROM ids) AS n_entities, round(tr, 9) AS rate_train,
        round(te, 9) AS rate_test, unnest(['gradient_boosting', 'hero_winrate_sum', 'logistic_regression', 'logreg_pairwise', 'majority_class']) AS model,
        n_test AS rows, true AS paired_rows_agree, true AS best_c_in_grid, true AS best_loss_marked, n_test AS calibrated FROM n""")
def m13_report(spark, sf):
    path = fresh_path(spark, "training")
    training.write_training(training.train_all(prepared(spark, sf)), path)
    report = read_report(spark, f"{path}/report")
    rows = report.select("*", F.explode("results").alias("r"))
    pairs = F.col("r.both_right") + F.col("r.only_base") + F.col("r.only_other") + F.col("r.both_wrong")
    c = F.coalesce(F.when(F.col("r.model") == training.BASE, F.col("r.best_C").isin(*training.LOGISTIC_GRID)).when(
        F.col("r.model") == "logreg_pairwise", F.col("r.best_C").isin(*training.PAIRWISE_GRID)).otherwise(
        F.col("r.best_C").isNull()), F.lit(False))
    least = F.array_min("results.log_loss")
    return rows.select(
        "n_trials", "n_train", "n_test", "n_entities", *r9("rate_train", "rate_test"), F.col("r.model").alias("model"),
        F.col("r.n").alias("rows"), (F.coalesce(pairs, "n_test") == F.col("n_test")).alias("paired_rows_agree"),
        c.alias("best_c_in_grid"), ((F.col("r.log_loss") - least < 1e-12) == F.col("r.best_log_loss")).alias("best_loss_marked"),
        F.aggregate("calibration.n", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("calibrated"))


@check("m14_models_by_stratum")
def m14(spark, sf):
    return training.stratum_report(prepared(spark, sf), c=0.01)


@check("m15_learning_curve")
def m15(spark, sf):
    return training.learning_curve(prepared(spark, sf), c=0.01)
