import collections
import random
import re
import zlib

import numpy as np
import pytest

from evenhand.llm import spelling as sp

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_by_hand(rows, slip=31):
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def variants_by_hand(n):
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def result(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_by_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(sp.op12(spark, sf)) == variants_by_hand(words_by_hand(docs))


def crowded(seed, size, letters="abé", least=7, most=10):
    """Few letters: many anagrams, many near words, ties in n, and chains of forms."""
    rnd = random.Random(seed)
    words = {"".join(rnd.choice(letters) for _ in range(rnd.randrange(least, most))) for _ in range(size)}
    return {w: rnd.choice([2, 2, 3, 25, 300, 4000]) for w in sorted(words)}


@pytest.mark.parametrize("leaf_words, leaf_chars", [(40, 1 << 19), (40, 300), (1 << 14, 1 << 19)])
def test_trees_and_blocks_lose_nothing(spark, monkeypatch, leaf_words, leaf_chars):
    n = crowded(1, 500)
    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    got = {r["word"]: (r["n_near"], r["best_word"], r["best_n"]) for r in sp.near_words(words, leaf_words, leaf_chars).collect()}
    want = variants_by_hand(n)
    assert {w: v[0] for w, v in got.items()} == {w: v[3] for w, v in want.items() if v[3]}
    assert all(best == min((x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)), key=lambda x: (-n[x], x)) and best_n == n[best] for w, (_, best, best_n) in got.items())


def test_forms_and_chains(spark):
    n = crowded(2, 300) | {"a" * 7: 50_000, "a" * 8: 5000, "a" * 9: 500, "a" * 10: 50, "a" * 11: 5}
    got = result(sp.group_variants(spark.createDataFrame(list(n.items()), "word string, n long")).select("word", "form", "root", "n", "n_near", "form_n"))
    assert got == variants_by_hand(n)
    assert got["a" * 11][1] == "a" * 7


@pytest.mark.parametrize("seed", range(4))
def test_search_by_brute_force(seed):
    n = crowded(seed, 700, "abcd" if seed % 2 else "aü", 7, 12)
    for length in range(7, 12):
        points = [w for w in n if len(w) == length]
        queries = [w for w in n if abs(len(w) - length) < 2]
        if points:
            found, best = sp.search(points, np.array([n[w] for w in points]), queries, leaf=5)
            for q, f, b in zip(queries, found, best):
                near = [w for w in points if one_edit(w, q)]
                assert f == len(near) and (points[b] if b >= 0 else None) == min(near, key=lambda x: (-n[x], x), default=None)


def test_odd_rows(spark, make, odd_rows):
    long_word = "ab" * 20_000
    rows = [*odd_rows, (20, f"{long_word} {long_word} {long_word}a {long_word}a Straßenbahn straßenbahn", "de", "a"),
            (None, "Strassenbahn strassenbahn x-straßenbahñ straßenbahñ ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ àÀÀÀÀÀÀ àÀÀÀÀÀÀ", None, None)]
    for slip in (31, None):
        got = result(sp.spelling_variants(make(rows), slip=slip))
        assert got == variants_by_hand(words_by_hand([r[:2] for r in rows], slip))
        assert slip or got[long_word][3] == 1 and got["ÀÀÀÀÀÀÀ"][3] == 1
    assert sp.spelling_variants(make(odd_rows).limit(0)).count() == 0
    assert sp.spelling_variants(make([(1, "no long words", None, None)])).count() == 0
