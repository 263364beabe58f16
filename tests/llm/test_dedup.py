"""Stream dedup, substring dedup and SimHash against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from evenhand.llm import simhash, stream_dedup, substring_dedup
from evenhand.llm.components import components


def test_stream_keeps_its_state_over_batches_and_calls(spark, make, odd_rows, tmp_path):
    src, folder = str(tmp_path / "docs"), str(tmp_path / "state")
    make(odd_rows).write.parquet(src)
    first = stream_dedup.dedup(spark, src, folder, bytes_per_batch=1).collect()  # one file a batch
    assert len(first) == len(odd_rows) and sum(r["kept"] for r in first) == len({t or "" for _, t, _, _ in odd_rows})
    size = Counter(t or "" for _, t, _, _ in odd_rows)
    digest = {hashlib.sha256(t.encode()).hexdigest(): t for t in size}
    for r in first:
        text = digest[r["text_sha256"]]
        assert r["group_size"] == size[text]
        assert r["keep_id"] == max((i for i, t, _, _ in odd_rows if (t or "") == text and i is not None), default=None)
    make([(100, "one two", "en", "a"), (101, "new", "en", "a")]).write.mode("append").parquet(src)
    later = {(r["doc_id"], r["keep_id"], r["kept"]) for r in stream_dedup.dedup(spark, src, folder).collect()}
    assert (100, 100, True) in later and (4, 100, False) in later and (101, 101, True) in later


def test_colliding_digests_are_told_apart(spark, make, odd_rows, tmp_path):
    src = str(tmp_path / "docs")
    make(odd_rows).write.parquet(src)
    weak = stream_dedup.dedup(spark, src, digest=lambda text: F.pmod(F.length(text), F.lit(2)).cast("string"))
    exact = stream_dedup.dedup(spark, src).select("doc_id", "keep_id", "group_size", "kept")
    assert Counter(map(tuple, weak.collect())) == Counter(map(tuple, exact.collect()))


def test_stream_of_an_empty_table(spark, make, tmp_path):
    src = str(tmp_path / "docs")
    make([(1, "a", "en", "a")]).limit(0).write.parquet(src)
    assert stream_dedup.dedup(spark, src).count() == 0


def cut_by_brute_force(rows, window):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k:k + window]) for _, w in docs for k in range(len(w) - window + 1))
    out = []
    for i, w in docs:
        gone = {x for k in range(len(w) - window + 1) if seen[tuple(w[k:k + window])] > 1 for x in range(k, k + window)}
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("hot, listed", [(50_000, 1 << 20), (1, 1 << 20), (4, 1 << 20), (1, 0)])
@pytest.mark.parametrize("seed", range(2))
def test_substrings_against_brute_force(spark, make, odd_rows, monkeypatch, seed, hot, listed):
    monkeypatch.setattr(substring_dedup, "MOST_LISTED", listed)
    rnd = random.Random(seed)
    passages = [[rnd.choice("abcdef") for _ in range(rnd.randrange(5, 40))] for _ in range(4)]
    rows = [(200 + k, " ".join(sum(([*rnd.choice(passages), *[rnd.choice("abcxyz") for _ in range(rnd.randrange(0, 9))]] for _ in range(rnd.randrange(0, 5))), [])), "en", "s") for k in range(25)]
    rows += [(500, "z " * 60, "en", "s"), (501, "p q " * 40, "en", "s"), *odd_rows]
    got = substring_dedup.remove_repeats(make(rows), window=9, mmer=3, hot=hot).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept_text"])) for r in got) == cut_by_brute_force([(i, t) for i, t, _, _ in rows], 9)


def test_substring_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {i: (n, r, hashlib.sha256(kept).hexdigest()) for i, n, r, kept in cut_by_brute_force(docs, 35)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.op6(spark, sf).collect()}
    assert got == want and sum(r for _, r, _ in want.values())


def test_substrings_of_an_empty_table(spark, make):
    assert substring_dedup.remove_repeats(make([(1, "a", "en", "a")]).limit(0)).count() == 0


def test_buckets_in_small_chunks(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 1)
    rows = [(m, m, d, 0, b"a b c d e" if d else b"x a b c d e") for m in range(5) for d in range(3)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k:k + 2])], names=["minimiser", "k1", "k2", "start", "packed"]) for k in range(0, len(rows), 2)]
    out = pa.Table.from_batches(list(substring_dedup._count(iter(batches), 5))).to_pylist()
    assert sorted((r["k1"], r["k2"], r["from_word"], r["to_word"]) for r in out) == sorted((m, d, 0 if d else 1, 5 if d else 6) for m in range(5) for d in range(3))


def bits_by_brute_force(text, n=3):
    words = (text or "").encode().translate(simhash.LOWER).split()
    if not words:
        return 0
    parts = [b" ".join(words[k:k + n]) for k in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(values, budget):
    above = list(range(len(values)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x
    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= budget:
                above[max(top(a), top(b))] = min(top(a), top(b))
    return [top(k) for k in range(len(values))]


@pytest.mark.parametrize("leaf,budget", [(1 << 17, 2), (16, 3), (4, 2)])
def test_trie_links_against_all_pairs(spark, leaf, budget):
    rnd = random.Random(leaf)
    values = {0, 2 ** 64 - 1, 1 << 63}
    for _ in range(40):  # crowded prefixes, chains of near values
        x = rnd.getrandbits(64) if rnd.random() < 0.5 else rnd.getrandbits(12) << 50 if leaf > 4 else rnd.getrandbits(14) << 6
        for _ in range(rnd.randrange(1, 6)):
            values.add(x)
            x ^= 1 << rnd.randrange(64)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.trie_links(spark.createDataFrame([(v,) for v in signed], "fp long"), budget, leaf)
    rows = links.collect()
    assert all(((r["a"] ^ r["b"]) & (2 ** 64 - 1)).bit_count() <= budget for r in rows)
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    mine = [roots.get(v, v) for v in signed]
    want = grouped(values, budget)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


@pytest.mark.parametrize("limit", [10, 1 << 19])
def test_joint_walk_in_pieces(monkeypatch, limit):
    monkeypatch.setattr(simhash, "FRONTIER", limit)
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 1 << 14, 300).astype(np.uint64))
    i, j = simhash.joint_walk(a, a, 0, 0, 2, True)
    want = {(x, y) for x in range(len(a)) for y in range(x + 1, len(a)) if int(a[x] ^ a[y]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_near_duplicates_against_brute_force(spark, make, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None] + [(20, "The END of it all", "en", "a"), (21, "the end of  it ALL", "en", "a")]
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(make(rows)).collect())
    bits = [bits_by_brute_force(t) for _, t, _, _ in sorted(rows, key=lambda r: r[0])]
    ids = sorted(r[0] for r in rows)
    assert got == sorted((i, f"{b:016x}", ids[g]) for i, b, g in zip(ids, bits, grouped(bits, 2)))
    assert simhash.near_duplicates(make(odd_rows).limit(0)).count() == 0


def test_simhash_query_against_brute_force(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    bits = [bits_by_brute_force(d["text"]) for d in docs]
    want = [(d["doc_id"], f"{b:016x}", docs[g]["doc_id"]) for d, b, g in zip(docs, bits, grouped(bits, 2))]
    assert sorted(map(tuple, simhash.op9(spark, sf).select("doc_id", "fingerprint", "component_id").collect())) == want


def test_components_of_chains_stars_and_loops(spark):
    chain = [(k, k + 1) for k in range(60)]
    star = [(100, 101 + k) for k in range(40)]
    edges = spark.createDataFrame(chain + star + [(7, 7), (3, 2), (500, 499), (600, 600)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert roots == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 141)}, 499: 499, 500: 499}
