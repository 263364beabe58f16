import collections
import math
import random
import re

import numpy as np
import pytest

from evenhand.llm import lexical as lx

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOW) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def ranked_by_hand(docs, items, k=10):
    said = [(key, collections.Counter(terms(t)), len(terms(t))) for key, t in docs]
    said = [d for d in said if d[2]]
    total, length = len(said), sum(d[2] for d in said)
    df = collections.Counter(t for _, c, _ in said for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for key, c, n in said:
            m = 10 + (90 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, key is not None, key or 0))
        out += [(item, r + 1, key if known else None, -s) for r, (s, known, key) in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r["item_id"], r["rank"], r["doc_id"], r["score"])) for r in df.collect())


def corpus(seed, n_docs=400):
    rnd = random.Random(seed)
    words = ["Ä", "ä", "b2", "the", "THE", "x_y", "漢", "nbsp in", "q", "r", "s", "t-u"] + [f"w{k}" for k in range(60)]
    docs = [(k, rnd.choice([" ", ", ", "\n"]).join(rnd.choices(words, k=rnd.randrange(0, 40)))) for k in range(n_docs)]
    docs += [(k + 5000, docs[k % 40][1]) for k in range(300)]  # ties over tiles and tasks
    items = [(k, " ".join(rnd.choices(words, k=rnd.randrange(1, 25)))) for k in range(25)]
    return docs, items


@pytest.mark.parametrize("seed", range(2))
def test_by_brute_force(spark, seed, monkeypatch):
    docs, items = corpus(seed)
    frames = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    assert found(lx.rank_documents(*frames)) == ranked_by_hand(docs, items)
    monkeypatch.setattr(lx, "ITEMS_PER_BLOCK", 7)
    assert found(lx.rank_documents(*frames, k=3)) == ranked_by_hand(docs, items, 3)


@pytest.mark.parametrize("width, depth", [(1, 1), (5, 7), (64, 2000)])
def test_tiles_give_the_same_scores(width, depth, monkeypatch):
    """Any tile sizes; weights so large that the bound on partial sums narrows the tiles by itself."""
    monkeypatch.setattr(lx, "VOCABULARY_TILE", width)
    rnd = np.random.default_rng(width)
    terms_of_items = [np.sort(rnd.choice(90, rnd.integers(0, 50), replace=False)) for _ in range(12)]
    items = lx.Items(None, {}, terms_of_items)
    for high in (30_000, 1 << 32):
        weight = rnd.integers(0, high, 90)
        tiles = lx.vocabulary_tiles(items, weight)
        assert max(t.high - t.low for t in tiles) * int(weight.max()) * lx.MOST_IMPACT < lx.EXACT or max(t.high - t.low for t in tiles) == 1
        doc, place = np.nonzero(rnd.random((depth, 90)) < 0.2)
        times, sizes = rnd.integers(1, 9, len(doc)), rnd.integers(9, 99, depth)
        got = lx.score_tile(tiles, 12, sizes, doc, place, times, 1000, 50_000)
        want = np.zeros((12, depth), object)
        for d, p, tf in zip(doc.tolist(), place.tolist(), times.tolist()):
            v = (10**9 * tf) // (1000 * tf + 8 * (10 + (90 * int(sizes[d]) * 1000) // 50_000))
            for i, t in enumerate(terms_of_items):
                want[i, d] += int(weight[p]) * v if p in t else 0
        assert (got == want.astype(np.int64)).all()


def test_ties_keep_the_smaller_key():
    best = lx.Best(1, 3)
    best.add(np.array([[5, 5, 5, 5, 9]]), [40, 30, 20, None, 50])
    best.add(np.array([[5, 5, 0]]), [10, 60, 1])
    assert [(key, -minus) for minus, _, key in best.kept[0]] == [(50, 9), (None, 5), (10, 5)]


def test_odd_rows(spark, make, odd_rows):
    docs = make(odd_rows)
    items = [(1, "two ONE"), (1, "two ONE"), (2, None), (3, ""), (None, "w5x3 zürich"), (4, "nowhere"), (5, "one")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert found(lx.rank_documents(docs, frame)) == ranked_by_hand([r[:2] for r in odd_rows], items)
    assert lx.rank_documents(docs.limit(0), frame).count() == 0
    assert lx.rank_documents(docs, frame.limit(0)).count() == 0
