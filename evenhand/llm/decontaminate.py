"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.registry import query, table, text_of
from evenhand.workspace import settle

SHINGLE = 5
CONTAINMENT = 0.8
TOKEN = r"[\p{L}\p{N}]+"
NULL_KEY = -(1 << 63)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def over_shingles(words: str, shingle: int, make) -> Column:
    """`make` of the words of every run of `shingle`, as an array; shorter texts have none.

    Words are fetched one by one: slicing would copy the whole array for every run.
    """
    many = F.size(words) >= shingle
    places = F.when(many, F.sequence(F.lit(0), F.size(words) - shingle)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: make(*[F.get(F.col(words), i + k) for k in range(shingle)]))


def joined(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def hashed_shingles(words: str, shingle: int) -> Column:
    return over_shingles(words, shingle, F.xxhash64)


def needed(items: Column | str, containment: float) -> Column:
    """Shingles that an item of that many must share. The small term keeps whole products whole."""
    return F.ceil(F.col(items) * containment - 1e-9) if isinstance(items, str) else F.ceil(items * containment - 1e-9)


def sketches(benchmark: DataFrame, item: str, text: str, shingle: int, containment: float) -> DataFrame:
    """Items with their distinct shingles and the MinHash sketch of their size partition.

    A partition holds the items of up to twice its least size. Its sketch length k is the number of
    shingles that its largest item may miss, plus one: a document that contains enough of an item
    holds at least one of its k smallest hashes, so the search loses nothing.
    """
    words = benchmark.select(F.col(item).alias("item_id"), tokens(text_of(text)).alias("words")).filter(F.size("words") >= shingle)
    sized = words.select(
        "item_id", F.array_distinct(over_shingles("words", shingle, joined)).alias("shingles"),
        F.array_distinct(hashed_shingles("words", shingle)).alias("hashes")).distinct()
    part = F.floor(F.log2("items")).cast("int")
    largest = F.pow(F.lit(2), F.col("part") + 1) - 1
    length = F.floor(largest - F.ceil(largest * containment - 1e-9)).cast("int") + 1
    return (
        sized.withColumn("items", F.size("shingles"))
        .withColumn("part", part).withColumn("need", needed("items", containment).cast("int"))
        .withColumn("sketch", F.slice(F.sort_array("hashes"), 1, length))
        .select("item_id", F.xxhash64("item_id", "shingles").alias("item_key"), "shingles", "items", "need", "part", "sketch")
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    shingle: int = SHINGLE, containment: float = CONTAINMENT,
) -> DataFrame:
    """Pairs (k1, k2, key, item_id, item_shingles, matched, containment) of documents and the items inside them.

    Words are lower-cased runs of letters and digits. An item is inside a document if at least
    `containment` of its distinct shingles of `shingle` words occur there. Documents' shingles meet
    the sketches in an equi-join (broadcast only if the planner sees that the written sketch table is
    small), each size partition only with documents of enough shingles; pairs found are verified on
    the shingles themselves. Items or documents with fewer words than a shingle match nothing. Null
    texts are empty; equal rows of `docs` all match; repeated items count once. Empty tables give no
    rows; other columns play no part. (k1, k2) identify a document row: `row_keys`.
    """
    items = settle(sketches(benchmark, item, item_text, shingle, containment), "benchmark-sketches")
    index = settle(items.select("item_key", "need", F.explode("sketch").alias("hash")), "benchmark-index")
    keyed = docs.select(F.col(key).alias("key"), *row_keys(key, text), text_of(text).alias("text"))
    found = (
        keyed.select("k1", "k2", tokens(F.col("text")).alias("words"))
        # Exploding a named column would push a filter on it below, and the words into every lambda call.
        .select("k1", "k2", (F.size("words") - shingle + 1).alias("windows"), F.explode(hashed_shingles("words", shingle)).alias("hash"))
        .join(index, "hash").filter("windows >= need")
        .select("k1", "k2", "item_key").distinct()
    )
    pairs = settle(found, "benchmark-candidates")
    matched = F.size(F.array_intersect("shingles", "held"))
    return (
        keyed.join(pairs, ["k1", "k2"])
        .select("key", "k1", "k2", "item_key", tokens(F.col("text")).alias("words"))
        .select("key", "k1", "k2", "item_key", over_shingles("words", shingle, joined).alias("held"))
        .join(items.select("item_key", "item_id", "shingles", "items", "need"), "item_key")
        .withColumn("matched", matched).filter("matched >= need")
        .select(F.col("key").alias(key), "k1", "k2", "item_id", F.col("items").cast("long").alias("item_shingles"),
                F.col("matched").cast("long").alias("matched"), (F.col("matched") / F.col("items")).alias("containment"))
    )


def row_keys(key: str, text: str) -> list[Column]:
    return [F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("k1"), F.xxhash64(text_of(text)).alias("k2")]


@query("op3_decontaminate", rf"""
WITH said AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') AS words FROM documents
  UNION ALL SELECT 'b', item_id, regexp_extract_all(lower(coalesce(text, '')), '{TOKEN}') FROM benchmark),
shingles AS (
  SELECT DISTINCT kind, id, array_to_string(words[i:i+{SHINGLE - 1}], ' ') AS shingle
  FROM (SELECT kind, id, words, unnest(range(1, len(words) - {SHINGLE - 2})) AS i FROM said)),
sizes AS (SELECT id AS item_id, count(*) AS item_shingles FROM shingles WHERE kind = 'b' GROUP BY id),
shared AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS matched
  FROM shingles d JOIN shingles b ON d.shingle = b.shingle AND d.kind = 'd' AND b.kind = 'b' GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, matched, matched::DOUBLE / item_shingles AS containment
FROM shared JOIN sizes USING (item_id) WHERE matched >= ceil(item_shingles * {CONTAINMENT} - 1e-9)
""")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    found = contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "item_shingles", "matched", "containment")
