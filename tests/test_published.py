"""Published numbers of the audit, recomputed from games and wins per entity."""

import pytest
from pyspark.sql import functions as F

from evenhand.functions.proportions import games_per_group, normal_quantile
from evenhand.functions.special import correlation_p
from evenhand.models.evaluation import with_mcnemar
from evenhand.operators import followup as fu
from evenhand.operators import rates as ra
from evenhand.operators import significance as sg
from evenhand.operators import sizing as sz
from evenhand.operators.ranking import exact_quantiles
from evenhand.workspace import settle

# Fixed values: (games, wins) of the 126 entities tested, in rising order, out of 53,802 trials.
GAMES_AND_WINS = [
    (514, 262), (692, 309), (837, 391), (857, 428), (865, 443), (981, 473), (1037, 522), (1057, 511),
    (1147, 565), (1178, 522), (1214, 577), (1300, 644), (1415, 597), (1424, 735), (1524, 760), (1543, 759),
    (1573, 731), (1575, 837), (1669, 729), (1706, 859), (1730, 802), (1782, 917), (1810, 844), (1881, 872),
    (1890, 919), (1912, 865), (1963, 989), (2017, 909), (2064, 981), (2068, 934), (2122, 1056), (2156, 1056),
    (2164, 1091), (2187, 1107), (2225, 1076), (2226, 1118), (2244, 1015), (2265, 1212), (2292, 1094),
    (2297, 1144), (2299, 1088), (2304, 1161), (2305, 1196), (2327, 1117), (2396, 1173), (2407, 1065),
    (2465, 1223), (2492, 1266), (2589, 1254), (2626, 1251), (2683, 1247), (2719, 1173), (2724, 1337),
    (2751, 1392), (2755, 1394), (2774, 1241), (2783, 1353), (2886, 1440), (2911, 1310), (2987, 1447),
    (2999, 1582), (3082, 1519), (3084, 1382), (3103, 1622), (3120, 1579), (3175, 1665), (3182, 1488),
    (3293, 1535), (3438, 1705), (3478, 1789), (3568, 1661), (3718, 1834), (3770, 1989), (3801, 1851),
    (3848, 1823), (3896, 1826), (3903, 2007), (3989, 1993), (3996, 2043), (4137, 1944), (4164, 2128),
    (4189, 2110), (4482, 2184), (4502, 2306), (4662, 1993), (4883, 2400), (4981, 2283), (5171, 2712),
    (5207, 2616), (5271, 2583), (5579, 2798), (5664, 2718), (5673, 2658), (5733, 2907), (5858, 3086),
    (6028, 3058), (6135, 3214), (6381, 3468), (6392, 3056), (6815, 3401), (6884, 3627), (6989, 3818),
    (7052, 3692), (7231, 3645), (7316, 3421), (7357, 3826), (7865, 3809), (8014, 4078), (8033, 4101),
    (8300, 4364), (8502, 4471), (8670, 4457), (8715, 4566), (8926, 4660), (8994, 4522), (9194, 4766),
    (9326, 4643), (9819, 5128), (9934, 4851), (10492, 5099), (10724, 5658), (11117, 6027), (11190, 5588),
    (11271, 5753), (14234, 6985), (15669, 8049),
]
TRIALS = 53_802


@pytest.fixture(scope="module")
def rates(spark):
    rows = [(i, f"entity {i}", g, w) for i, (g, w) in enumerate(GAMES_AND_WINS)]
    df = spark.createDataFrame(rows, "hero_id int, name string, games long, wins long")
    return settle(df.withColumns({"win_rate": ra.rate(), "pick_rate": F.col("games") / TRIALS}))


@pytest.fixture(scope="module")
def tests(rates):
    return settle(sg.audit_entities(rates))


def test_counts_of_flagged_entities(tests):
    row = sg.verdict_summary(tests).first()
    assert (row.heroes_tested, row.significant_uncorrected, row.significant_after_bh) == (126, 63, 59)
    assert (row.outside_tolerance, len(row.nerf_candidates), len(row.buff_candidates)) == (18, 3, 15)
    assert row.expected_false_positives == pytest.approx(6.3)


def test_long_lists_become_rows(tests):
    row = sg.verdict_summary(tests, names=False).first()
    assert (row.outside_tolerance, row.nerf_candidates) == (18, None)
    assert sg.flagged_names(tests).count() == 18


def test_one_entity_in_full(tests):
    row = tests.filter("games = 1415 and wins = 597").first()
    assert row.p_value == pytest.approx(4.627626520746419e-09, rel=1e-9)
    assert row.q_value == pytest.approx(8.329727737343554e-08, rel=1e-9)
    assert row.ci_low == pytest.approx(0.3964213267091927, abs=1e-12)
    assert row.ci_high == pytest.approx(0.4478177892074724, abs=1e-12)
    assert row.action == "buff candidate"


def test_roster_spread(rates):
    row = ra.roster_spread(rates).first()
    assert row.spread * 100 == pytest.approx(12.437889525539125)
    assert row.sd * 100 == pytest.approx(2.6314822759740513)


def test_side(spark):
    sides = spark.createDataFrame([(TRIALS, 28_505, 28_505 / TRIALS)], "matches long, radiant_wins long, radiant_win_rate double")
    row = sg.audit_sides(sides).first()
    assert row.p_value == pytest.approx(1.6760220948940577e-43, rel=1e-9)
    assert (row.ci_low, row.ci_high) == (pytest.approx(0.5255936328250378), pytest.approx(0.5340281463911684))
    assert row.advantage_pp == pytest.approx(2.981301810341619)


def test_correlation_p_value(spark):
    row = spark.range(1).select(correlation_p(F.lit(0.29877734960790747), F.lit(82)).alias("p")).first()
    assert row.p == pytest.approx(0.006399302592801017, rel=1e-9)


def test_sizing(rates):
    table = {round(r.effect_pp, 3): r.hero_games_per_period for r in sz.effect_table(rates).collect()}
    assert table == {0.5: 156_973, 1.0: 39_240, 2.0: 9_806, 3.0: 4_356, 5.0: 1_565}
    sized = settle(sz.trials_needed(rates))
    most, least = (sized.orderBy(F.col("pick_rate") * s).first() for s in (-1, 1))
    assert (most.matches_needed, least.matches_needed) == (33_671, 1_026_425)
    assert most.mde_at_current_n == pytest.approx(1.5825892055465238)
    assert int(exact_quantiles(sized, "matches_needed", [0.5])[0]) == 170_547
    assert exact_quantiles(sized, "mde_at_current_n", [0.5])[0] == pytest.approx(3.5617654365434994)


def test_rounding_before_dividing_differs(rates):
    n = games_per_group(F.lit(0.5), F.lit(0.52), F.lit(normal_quantile(0.975)), F.lit(normal_quantile(0.8)))
    plan = sz.plan_changes(rates, [2.0]).select("hero_id", "matches")
    other = rates.select("hero_id", F.ceil(n / F.col("pick_rate")).alias("unrounded"))
    assert plan.join(other, "hero_id").filter("matches <> unrounded").count() == 4


@pytest.mark.parametrize("b, c, statistic, p", [
    (1947, 1658, 23.008044382801664, 1.6132493956334375e-06),
    (243, 239, 0.01867219917012448, 0.8913104127155931),
    (691, 750, 2.3344899375433728, 0.12653643146884758),
    (1066, 1045, 0.18948365703458075, 0.6633467131061527),
    (595, 619, 0.4357495881383855, 0.5091811149420449),
])
def test_mcnemar(spark, b, c, statistic, p):
    table = spark.createDataFrame([(0, b, c, 0)], "both_right long, only_base long, only_other long, both_wrong long")
    row = with_mcnemar(table).first()
    assert (row.statistic, row.p_value) == (pytest.approx(statistic, rel=1e-12), pytest.approx(p, rel=1e-9))


@pytest.mark.parametrize("hits, p", [(13, 0.0963), (7, 0.4807)])
def test_direction_hits(spark, hits, p):
    rows = spark.range(18).select((F.col("id") < hits).alias("hit"))
    row = fu.hit_test(rows, "hit").first()
    assert (row.n, row.hits) == (18, hits)
    assert row.p_value == pytest.approx(p, abs=5e-5)
