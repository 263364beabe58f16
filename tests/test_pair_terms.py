"""All terms of a line-up: against brute force, computed once, and grouped by trial without moving single terms."""

import re
from itertools import combinations

import pytest

from checks.model_checks import per_trial
from evenhand.models import encoding
from evenhand.workspace import dealt

N = 9
TERMS = "match_id long, terms array<struct<col:int,val:double>>"
LINE_UPS = [
    (1, [(0, 1.0), (3, -1.0), (4, -1.0), (8, 1.0)]), (2, None), (3, []), (4, [(7, -1.0)]), (None, [(2, 1.0), (5, 1.0)]),
    (1, [(0, -1.0), (1, 1.0), (2, 1.0), (8, 1.0)]), (6, [(0, 1.0), (1, -1.0), (2, -1.0), (3, 1.0), (8, -1.0)]),
]


def by_hand(terms):
    place = {pair: k for k, pair in enumerate(combinations(range(N), 2))}
    pairs = [(N + place[i, j] + (0 if a == b else len(place)), a) for (i, a), (j, b) in combinations(terms, 2)]
    return sorted(terms + pairs)


@pytest.fixture
def line_ups(spark):
    return spark.createDataFrame(LINE_UPS, TERMS).coalesce(1)


def shuffles(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_line_ups_of_any_size(line_ups):
    got = encoding.with_pairs(line_ups, N)
    assert got.dtypes == line_ups.dtypes
    rows = [(r.match_id, r.terms if r.terms is None else [tuple(t) for t in r.terms]) for r in got.collect()]
    assert rows == [(m, t if t is None else by_hand(t)) for m, t in LINE_UPS]
    long = sorted(map(str, encoding.long_form(got).collect()))
    assert long == sorted(f"Row(match_id={m}, col={c}, val={v})" for m, t in LINE_UPS for c, v in by_hand(t or []))
    pairs = [(r.col, r.val) for r in encoding.pair_rows(line_ups, N).collect()]
    assert sorted(pairs) == sorted(t for _, terms in LINE_UPS for t in by_hand(terms or []) if t[0] >= N)


def test_long_form_computes_the_terms_once(spark, sf):
    from checks import fixtures as fx
    trials = fx.trials(spark, sf)
    index = encoding.entity_index(trials)
    for rows in (encoding.long_form(encoding.encode(trials, index)), encoding.pair_rows(encoding.encode(trials, index), 127)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.split("== Initial Plan")[0].count("sort_array") == 1


def test_dealt_line_ups_are_grouped_where_they_lie(spark, line_ups):
    for rows, most in ((7, 8), (20, 10)):
        assert dealt(line_ups, "match_id", rows, 2).rdd.getNumPartitions() == most
    long = encoding.long_form(dealt(line_ups, "match_id", 7))
    digests = per_trial(long)
    both = long.unionByName(long).groupBy("match_id", "col").sum("val")
    for df in (digests, both):
        assert shuffles(df) and all(re.fullmatch(r"match_id#\d+L, 8", keys) for keys in shuffles(df))
    assert {r.match_id: r.terms for r in digests.collect()} == {1: 8, 4: 1, None: 2, 6: 5}


def test_antisymmetry_moves_no_single_terms(spark, sf):
    from checks.registry import QUERIES
    for name in ("e8_antisymmetry", "e7_trimmed_terms", "e5_e6_j9_pair_terms"):
        found = shuffles(QUERIES[name](spark, sf))
        assert found and not [keys for keys in found if "col#" in keys], name
        assert len(found) == (1 if name == "e7_trimmed_terms" else 2), name
