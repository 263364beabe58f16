import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.llm import quality, toxicity
from evenhand.llm.labels import training_sample


def held_out(spark, query, label, sf):
    rows = query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    return rows["score"].to_numpy(), rows[label].to_numpy(), rows["predicted"].to_numpy()


def area(score, y):
    return (score[y == 1][:, None] > score[y == 0]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0]).mean()


@pytest.mark.parametrize("query,label,least", [(toxicity.op4, "toxic", 0.75), (quality.op8, "quality", 0.95)])
def test_held_out(spark, query, label, least):
    score, y, predicted = held_out(spark, query, label, "/root/testdata/sf0.01")
    assert area(score, y) >= least and ((score >= 0) & (score <= 1)).all()
    assert (predicted[y == 1 - (label == "toxic")] == 1 - (label == "toxic")).mean() >= 0.9


def test_windows_cover_the_text():
    for text in (b"", b"a", b"word " * 100, b"x" * 1000, b" " * 300, b"a" * 99 + b" " + b"b" * 150):
        pieces = toxicity.windows(text)
        assert sum(map(len, pieces)) >= len(text) - len(pieces) and b"".join(pieces).replace(b" ", b"") == text.replace(b" ", b"")
        assert all(len(p) <= 2 * toxicity.WINDOW for p in pieces)


def test_machine_scores_equal_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.BUCKETS + quality.STATISTICS), rng.normal(size=(quality.BUCKETS + quality.STATISTICS, quality.RANK)),
                        np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    parts = [quality.features(t, None, quality._Buckets()) for t in (b"", b"one two two", b"Three | four! five")]
    z, _ = quality.raw_scores(m, quality.block(parts, m.mean, m.spread))
    for k, p in enumerate(parts):
        x = np.zeros(quality.BUCKETS + quality.STATISTICS)
        np.add.at(x, p[0], p[1])
        x[quality.BUCKETS:] = np.clip(p[2], -5, 5) / 4
        v = m.factors * x[:, None]
        on = np.flatnonzero(x)
        pairs = sum(v[i] @ v[j] for a, i in enumerate(on) for j in on[:a])
        assert z[k] == pytest.approx(m.bias + m.linear @ x + pairs)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, make, odd_rows, module):
    docs = make(odd_rows, extra=False).withColumn("n_chars", F.lit(None).cast("long"))
    name = "toxic" if module is toxicity else "quality"
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)] + [(1, 1, 1), (None, 1, 0), (77, None, None)], "doc_id long, toxic int, quality int")
    for some in (labels, labels.limit(0), labels.filter(f"{name} = 1")):
        rows = module.score(docs, module.fit(docs, some), ["doc_id"]).collect()
        assert len(rows) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in rows)
        assert module.score(docs.limit(0), module.fit(docs.limit(0), some), ["doc_id"]).count() == 0


def test_sample_is_bounded_and_leaves_the_held_out_fold(spark):
    docs = spark.range(1000).withColumnRenamed("id", "doc_id")
    labels = docs.withColumn("toxic", (F.col("doc_id") % 3 == 0).cast("int"))
    sample, sizes = training_sample(docs, labels, "toxic", 50)
    rows = sample.withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).collect()
    assert len(rows) == 100 and all(r["fold"] for r in rows) and sum(sizes.values()) > 700
