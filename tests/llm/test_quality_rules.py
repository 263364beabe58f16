import random
import re

import pytest
from pyspark.sql import functions as F

from evenhand.llm.quality_rules import RULES, Rule, apply_rules, op11


def counts_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    again = {i for i, r in enumerate(runs) if runs.count(r) > 1}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len({i + j for i in again for j in range(8)}),
    }


def random_text(rnd):
    n, words = rnd.randrange(0, 120), ["the", "a|b", "Ünï", "漢字", "x", "#tag", "of", "🙂"]
    parts = []
    while len(parts) < n:
        parts += rnd.choices(words, k=rnd.randrange(1, 6)) if rnd.random() < 0.7 or len(parts) < 12 else parts[2:12]
        parts.append(rnd.choice([" ", "\n", "\n\n", "\t", "\x0b", ""]))
    return rnd.choice(["", " ", "\n"]) + "".join(p + rnd.choice([" ", "  ", "\n"]) for p in parts)


@pytest.mark.parametrize("seed", range(3))
def test_counts_by_brute_force(spark, seed):
    rnd = random.Random(seed)
    texts = [random_text(rnd) for _ in range(150)] + ["\n", "a\na", "a \na", "x " * 9, " ".join("abcdefgh") + " " + " ".join("abcdefgh")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r.asDict() for r in apply_rules(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = counts_by_hand(text)
        assert {k: got[i][k] for k in want} == want, text
        base = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert got[i]["base_failed"] == base
        assert got[i]["kept"] == (not base and got[i]["failed_rules"] == "")


def test_equal_hashes_do_not_count_as_repeats(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *cols: F.lit(7).cast("long"))  # every run collides
    docs = spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(40))), (1, " ".join(f"w{k % 9}" for k in range(40)))], "doc_id long, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in apply_rules(docs).collect()} == {0: 0, 1: 40}


def test_odd_rows(spark, make, odd_rows):
    rows = apply_rules(make(odd_rows)).collect()
    assert sorted((r["doc_id"] or -1) for r in rows) == sorted((i or -1) for i, *_ in odd_rows)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["n_words"] < 20)
    assert {r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert {(r["n_words"], r["n_repeat_words"]) for r in rows if r["doc_id"] in (6, 7)} == {(30_000, 0)}
    assert apply_rules(make(odd_rows).limit(0)).count() == 0


def test_table_of_rules(spark):
    text = " ".join(["the word and"] * 2 + [f"w{k}" for k in range(30)])
    docs = spark.createDataFrame([(1, text), (2, "| " * 30 + text), (3, "")], "doc_id long, text string")
    strict = (*RULES, Rule("words", "n_words", most=36), Rule("lines", "n_lines", least=1))
    got = {r["doc_id"]: r["failed_rules"] for r in apply_rules(docs, rules=strict).collect()}
    assert got == {1: "", 2: "word_length,symbols,letter_words,words", 3: "word_length,stop_words,letter_words,lines"}
    assert {r["failed_rules"] for r in apply_rules(docs, rules=()).collect()} == {""}


def test_one_projection_without_user_functions(spark, sf):
    plan = op11(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
