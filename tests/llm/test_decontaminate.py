import random
import re

import pytest

from evenhand.llm.decontaminate import contaminated


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[k:k + 5]) for k in range(len(w) - 4)}


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, make, odd_rows, seed):
    rnd = random.Random(seed)
    items = [" ".join(rnd.choice(["a", "b", "c", "dd", "ee", "f1"]) for _ in range(n)) for n in (3, 5, 6, 9, 17, 31, 64, 100)]
    docs = []
    for k in range(40):
        words = [rnd.choice(["a", "b", "x", "y"]) for _ in range(rnd.randrange(0, 80))]
        item = rnd.choice(items).split()
        for _ in range(rnd.randrange(0, 4)):  # some edits
            item[rnd.randrange(len(item))] = "zz"
        at = rnd.randrange(len(words) + 1)
        docs.append((300 + k, ", ".join(words[:at]) + " " + " ".join(item).upper() + "\n" + " ".join(words[at:]), "en", "s"))
    docs += odd_rows
    bench = [(n, t) for n, t in enumerate(items)] + [(0, items[0]), (3, items[3]), (90, None), (91, "")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["matched"]) for r in contaminated(make(docs), table).collect())
    want = []
    for i, t, _, _ in docs:
        for n, item in set(bench):
            s = shingles(item)
            both = len(s & shingles(t))
            if s and both >= 0.8 * len(s) - 1e-9:
                want.append((i, n, both))
    assert got == sorted(want) and want
    assert contaminated(make(docs).limit(0), table).count() == 0
    assert contaminated(make(docs), table.limit(0)).count() == 0
