"""Leaf-limited trees against a plain search, stored batches, bucketed tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.models import leafwise, lowrank
from evenhand.sources.colocated import store_bucketed

N = 7
TERMS = "match_id long, terms array<struct<col:int,val:double>>, radiant_win int"


def line_ups(rows=400, seed=3):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(rows):
        cols = rng.permutation(N)[:4]
        signs = [1.0, 1.0, -1.0, -1.0]
        edge = sum(s * (c - 3) for c, s in zip(cols, signs))
        out.append((i, [(int(c), s) for c, s in zip(cols, signs)], int(rng.random() < 1 / (1 + np.exp(-edge / 2)))))
    return out


def plain_tree(rows, limits, rate):
    """Best-first splits by trying every leaf, column and threshold on the rows themselves."""
    x = np.zeros((len(rows), N))
    for k, (_, terms, _) in enumerate(rows):
        for c, v in terms:
            x[k, c] = v
    y = np.array([r[2] for r in rows], float)
    p = y.mean()
    leaf = np.zeros(len(rows), int)
    made = []

    def score(m):
        return (p - y[m]).sum() ** 2 / (m.sum() * p * (1 - p) + limits.l2)

    while len(made) + 1 < limits.max_leaves:
        best = None
        for at in range(len(made) + 1):
            here = leaf == at
            for c in range(N):
                for upper in (0, 1):
                    left, right = here & (x[:, c] < upper), here & (x[:, c] >= upper)
                    if min(left.sum(), right.sum()) < limits.min_rows:
                        continue
                    gain = round(score(left) + score(right) - score(here), 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = gain, c, upper, right
        if best is None:
            break
        made.append(best[:3])
        leaf[best[3]] = len(made)
    value = {k: -rate * (p - y[leaf == k]).sum() / ((leaf == k).sum() * p * (1 - p) + limits.l2) for k in set(leaf)}
    return made, np.array([value[k] for k in leaf]) + np.log(p / (1 - p))


@pytest.mark.parametrize("limits", [leafwise.Limits(max_leaves=6), leafwise.Limits(max_leaves=40, min_rows=5, l2=3.0), leafwise.Limits(max_leaves=1)])
def test_first_tree_equals_a_plain_search(spark, limits):
    rows = line_ups()
    model, splits = leafwise.first_tree(spark.createDataFrame(rows, TERMS).repartition(5), N, 0.1, limits)
    made, margins = plain_tree(rows, limits, 0.1)
    assert [(s.col, s.upper) for _, s, _ in splits] == [m[1:] for m in made]
    assert [s.gain for _, s, _ in splits] == pytest.approx([m[0] for m in made])
    got = spark.createDataFrame(rows, TERMS).select("match_id", leafwise.margin_column(model).alias("z")).collect()
    assert [r.z for r in sorted(got)] == pytest.approx(list(margins))


def test_boosting_lowers_the_loss_across_stored_margins(spark, monkeypatch):
    monkeypatch.setattr(leafwise, "_STORED_AFTER", 2)
    monkeypatch.setattr(leafwise, "_CELLS", 300)  # few rows and few leaves at a time
    table = spark.createDataFrame(line_ups(), TERMS).repartition(3)
    model = leafwise.fit(table, N, 5, 0.3, leafwise.Limits(max_leaves=4, min_rows=10))
    assert len(model.trees) == 5 and model.losses == sorted(model.losses, reverse=True)
    # The last loss known is the one before the last tree.
    held = table.filter(F.pmod(F.xxhash64("match_id", F.lit(42)), F.lit(10_000)) < 1500)
    model.trees.pop()
    z = np.array([(r.z, r.radiant_win) for r in held.select(leafwise.margin_column(model).alias("z"), "radiant_win").collect()])
    assert np.mean(np.logaddexp(0, np.where(z[:, 1] == 1, -z[:, 0], z[:, 0]))) == pytest.approx(model.losses[-1])


def test_odd_rows(spark):
    rows = line_ups(60) + [(900, None, 1), (901, [], 0), (902, [(1, 1.0)], None)]
    table = spark.createDataFrame(rows, TERMS)
    model = leafwise.fit(table, N, 2)
    got = {r.match_id: r.p for r in leafwise.predict(model, table, "x").collect()}
    assert len(got) == 63 and all(0 < p < 1 for p in got.values()) and got[900] == got[901]
    for outcomes in (table.limit(0), table.filter("radiant_win = 1")):
        with pytest.raises(ValueError, match="both outcomes"):
            leafwise.fit(outcomes, N, 2)


def test_low_rank_batches(spark, monkeypatch):
    rng = np.random.default_rng(1)
    teams = [rng.permutation(8) for _ in range(300)]
    rows = [(i, [int(c) for c in t[:2]], [int(c) for c in t[2:4]], int(t[0] + t[1] > t[2] + t[3])) for i, t in enumerate(teams)]
    table = spark.createDataFrame(rows, "match_id long, cols_a array<int>, cols_b array<int>, radiant_win int")
    read = []
    plain = lowrank._step
    monkeypatch.setattr(lowrank, "_step", lambda df, *rest: (read.append(sorted(r[0] for r in df.select("match_id").collect())), plain(df, *rest))[1])
    params = lowrank.fit(table, 8, 2, lr=0.1, steps=8, batches=4)
    held = set(range(270, 300))
    one_pass = [set(ids) - held for ids in read[:4]]
    assert set().union(*one_pass) == set(range(270)) and sum(map(len, one_pass)) == 270
    assert [held <= set(ids) for ids in read] == [True, False, False, False] * 2 + [True]
    assert params.w[7] > params.w[0]
    with pytest.raises(ValueError, match="both outcomes"):
        lowrank.fit(table.filter("radiant_win = 1"), 8, 2, steps=2, batches=3)


def test_bucketed_tables_join_without_an_exchange(spark):
    a = spark.range(500).select((F.col("id") % 90).alias("k"), "id")
    b = spark.range(100).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    left, right = store_bucketed(a, "k", 4, "left"), store_bucketed(b, "k", 4, "right")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = left.join(right, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        expected = a.join(b, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"))
        assert sorted(joined.collect()) == sorted(expected.collect())
        assert store_bucketed(b.limit(0), "k", 4).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_foreseen_splits_save_scans_and_wrong_ones_are_given_up(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        cols = rng.permutation(40)[:6]
        edge = sum(s * (c - 20) / 20 for c, s in zip(cols, [1, 1, 1, -1, -1, -1]))
        rows.append((i, [(int(c), s) for c, s in zip(cols, [1.0, 1.0, 1.0, -1.0, -1.0, -1.0])], int(rng.random() < 1 / (1 + np.exp(-edge)))))
    table = spark.createDataFrame(rows, TERMS).repartition(2)
    scans = []
    count = leafwise._count
    monkeypatch.setattr(leafwise, "_count", lambda *a: (scans.append(len(a[4])), count(*a))[1])
    limits = leafwise.Limits(max_leaves=20)

    def splits():
        scans.clear()
        return [(s.col, s.upper, round(s.gain, 6), round(s.left[2]), round(s.right[2])) for _, s, _ in leafwise.first_tree(table, 40, 0.1, limits)[1]]

    found = splits()
    assert len(found) == 19 and len(scans) < 15
    plain = leafwise._guessed
    monkeypatch.setattr(leafwise, "_guessed", lambda node, split: tuple(
        leafwise.Node(x.sums, np.roll(x.histogram, 7, axis=2), guessed=True) for x in plain(node, split)))
    assert splits() == found and len(scans) <= 20
