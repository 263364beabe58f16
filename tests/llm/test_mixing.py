import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evenhand.llm import mixing


def fill(children, budget):
    """Water filling by repetition: children {name: (cap, weight)}."""
    got, open_ = {}, dict(children)
    left = budget
    while open_:
        share = sum(w for _, w in open_.values())
        full = [n for n, (cap, w) in open_.items() if cap * share <= left * w]
        if not full:
            return got | {n: left * w // share for n, (_, w) in open_.items()}
        name = min(full, key=lambda n: open_[n][0] / open_[n][1])
        got[name] = open_.pop(name)[0]
        left -= got[name]
    return got


@pytest.mark.parametrize("seed", range(4))
def test_quotas_against_repeated_filling(spark, seed):
    rnd = random.Random(seed)
    leaves = [(f"d{d}", f"l{k}", f"s{s}", rnd.choice([0, 5, 50, 1000])) for d in range(3) for k in range(2) for s in range(rnd.randrange(1, 4))]
    weights = {"domain": {"d0": 5}, "lang": {"l1": 3}, "source": {"s0": 2}}
    total = sum(x[3] for x in leaves)
    budget = total * rnd.choice([3, 9, 15]) // 10
    got = {tuple(r[:3]): r["quota"] for r in mixing.leaf_quotas(
        spark.createDataFrame(leaves, "domain string, lang string, source string, total long"), ["domain", "lang", "source"], weights, F.lit(budget), 2).select("domain", "lang", "source", "quota").collect()}

    def weight(level, name):
        return weights[level].get(name, 1)

    caps = defaultdict(int)
    for d, k, s, n in leaves:
        for path in ((d,), (d, k), (d, k, s)):
            caps[path] += 2 * n
    allotted = {(): budget}
    for depth, level in enumerate(("domain", "lang", "source")):
        for parent in [p for p in allotted if len(p) == depth]:
            children = {p: (c, weight(level, p[-1])) for p, c in caps.items() if len(p) == depth + 1 and p[:-1] == parent}
            allotted |= fill(children, allotted[parent])
    assert got == {p: q for p, q in allotted.items() if len(p) == 3}
    assert sum(got.values()) <= budget and (budget <= 2 * total) <= (sum(got.values()) >= min(budget, 2 * total) - 40)


def test_prefixes_do_not_depend_on_the_cut(spark, monkeypatch):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("source"), (F.col("id") % 17).alias("n"))
    tree = {"lang": F.col("lang"), "source": F.col("source")}

    def run(digits):
        monkeypatch.setattr(mixing, "BUCKET_DIGITS", digits)
        return sorted((r["doc_id"], r["copies"]) for r in mixing.mix(docs, tree, {"source": {"cold": 9}}, F.col("n"), budget=F.expr("total * 8 div 10"), max_epochs=2).collect())
    one = run(0)
    assert one == run(1) == run(3)
    taken = defaultdict(int)
    for i, c in one:
        taken["hot" if i % 3 else "cold"] += c * (i % 17)
    total = sum(k % 17 for k in range(2000))
    assert total * 8 // 10 - 40 <= sum(taken.values()) <= total * 8 // 10


def test_odd_rows(spark, make, odd_rows):
    docs = make(odd_rows)
    tree = {"lang": F.col("lang"), "source": F.col("source")}
    count = mixing.word_count(F.coalesce("text", F.lit("")))
    everything = mixing.mix(docs, tree, {}, count)
    with_words = [r for r in odd_rows if (r[1] or "").split()]
    assert everything.filter("mix.tokens > 0").count() == len(with_words)
    assert mixing.mix(docs.limit(0), tree, {}, count).count() == 0
    with pytest.raises(ValueError):
        mixing.weight_of("lang", {"en": 0})
