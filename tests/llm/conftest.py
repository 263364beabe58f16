import pytest
from pyspark.sql import functions as F

CLASHES = ["mix", "tokens", "quota", "copies", "size", "at", "block", "rank", "slot", "shard", "host", "rule", "digest", "fp", "k1", "words", "hash", "score", "runs"]


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with clashing extra columns, in several partitions."""
    def build(rows, extra=True):
        df = spark.createDataFrame([(i, t, lang, src) for i, t, lang, src in rows], "doc_id long, text string, lang string, source string")
        if extra:
            df = df.withColumns({c: F.lit("clash") for c in CLASHES})
        return df.repartition(3)
    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, copies, repeated rows."""
    long_text = " ".join(f"w{k % 977}x{k // 977}" for k in range(30_000))
    return [
        (1, None, "en", "a"), (2, "", None, None), (3, " \t\n", "en", "a"), (4, "one two", "de", "b"), (5, "one two", "de", "b"),
        (5, "one two", "de", "b"), (6, long_text, "en", "a"), (7, long_text, "fr", "a"), (None, "one two", "en", "c"), (9, "Zürich ñ 漢字 🙂 end", "es", "a"),
    ]
