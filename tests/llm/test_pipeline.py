"""The stages on a small corpus with planted cases; each one is judged on its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evenhand.llm import stages
from tests.llm.test_dedup import bits_by_brute_force, grouped


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Ordinary documents, toxic ones, exact copies and leaks, with the folder of their side tables."""
    rnd, folder = random.Random(4), str(tmp_path_factory.mktemp("corpus"))
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randrange(2, 8))) for _ in range(600)]

    def prose(n):
        return [rnd.choice(words) for _ in range(n)]
    rows, labels = [], []
    for k in range(400):
        text, toxic = prose(rnd.randrange(20, 120)), k % 4 == 0
        if toxic:
            for _ in range(6):
                text.insert(rnd.randrange(len(text)), rnd.choice(["qwzzkx", "jjvvkk", "xxqqww"]))
        rows.append((k, " ".join(text), rnd.choice(["en", "de"]), f"src{k % 5}"))
        labels.append((k, int(toxic), 1))
    items = [(n, " ".join(prose(30))) for n in range(5)]
    rows += [(1000 + n, " ".join(prose(40)) + " " + t + " " + " ".join(prose(40)), "en", "src0") for n, t in items]
    rows += [(2000 + k, rows[4 * k + 1][1], "en", "src0") for k in range(30)]
    rows += [(3000, None, None, None), (3001, "", "en", "src1"), (3001, "", "en", "src1"), (None, "lone text", "en", "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("clash"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    rows = docs.collect()

    left = stages.drop_toxic(spark, docs, corpus)
    assert left.columns == docs.columns
    kept = {r["doc_id"] for r in left.collect()}
    toxic = {k for k in range(0, 400, 4)}
    assert len(toxic - kept) >= 95 and len({r["doc_id"] for r in rows} - toxic - kept) <= 6

    left = stages.drop_near_copies(spark, docs, corpus)
    assert left.columns == docs.columns
    known = sorted({(r["doc_id"], r["text"] or "") for r in rows if r["doc_id"] is not None})
    groups = grouped([bits_by_brute_force(t) for _, t in known], 2)
    want = sorted(known[g][0] for g in set(groups))
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == want
    assert left.filter("doc_id is null").count() == 1

    left = stages.drop_contaminated(spark, docs, corpus)
    assert left.columns == docs.columns and left.count() == len(rows) - 5
    assert not left.filter("doc_id between 1000 and 1999").count()

    left = stages.mix_sources(spark, docs, corpus)
    total = sum(len((r["text"] or "").split()) for r in rows)
    taken = sum(len((r["text"] or "").split()) for r in left.collect())
    assert left.columns == docs.columns and 0.8 * total - 130 * 20 <= taken <= 0.8 * total

    left = stages.put_in_shards(spark, docs, corpus)
    assert left.count() == len(rows) and set(left.columns) == {"doc_id", "text", "lang", "source", "old_shard", "shard", "slot"}


def test_rows_of_one_identifier_are_told_apart(spark):
    """Two texts under one identifier: a copy of one takes only that one along, and both may stay."""
    rnd = random.Random(3)
    one, other, third = (" ".join(f"{c}{rnd.randrange(999)}" for _ in range(40)) for c in "abc")
    rows = [(1, one), (2, one.upper()), (2, other), (3, other + " "), (4, third), (4, one + "\n"), (5, third), (6, "lone"), (6, "alone"), (6, "lone"), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("k1", "k2", "row", "fp", "row_key", "component_id")})
    left = stages.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns
    got = sorted((tuple(r[:2]) for r in left.collect()), key=str)
    assert got == sorted([(1, one), (2, other), (4, third), (6, "lone"), (6, "alone"), (None, one)], key=str)


def test_run(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and not {1000, 1001, 2000} & set(ids) and len(ids) > 150


def test_empty_documents(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0
