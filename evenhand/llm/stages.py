"""Operators as stages of a corpus pipeline: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm import decontaminate, mixing, sharding, simhash, toxicity
from evenhand.llm.registry import table, text_of
from evenhand.workspace import settle

TOXIC_FROM = 0.5
SCORE = "toxicity_score__"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC_FROM by a model fitted on the labelled ones among them.

    Null and empty texts are scored like any other, equal rows get equal scores and so stay or go
    together, an empty table gives no rows, and all columns of `docs` travel along unchanged.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns, name=SCORE).filter(F.col(SCORE) < TOXIC_FROM).drop(SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of `simhash.near_duplicates`, at the contract's shingle and distance.

    The document with the smallest identifier stays; rows are told apart by identifier and text hash,
    so rows that share only the identifier are documents of their own, and of equal rows any one is
    kept. Documents without an identifier stay, nulls and empty texts count as texts without words
    (all of one group), an empty table gives no rows, and other columns, whatever their names, travel
    along in one struct.
    """
    # With the hash as second part of the key, the smallest key of a group is one row of its smallest identifier.
    keyed = docs.filter("doc_id is not null").select(F.struct("doc_id", F.xxhash64(text_of()).alias("k2")).alias("row_key"), "text")
    groups = settle(simhash.near_duplicates(keyed, "row_key"), "simhash-groups")
    dropped = groups.filter("row_key <> component_id").select(F.col("row_key.doc_id").alias("k1"), "row_key.k2").distinct()
    packed = docs.select(F.col("doc_id").alias("k1"), F.xxhash64(text_of()).alias("k2"), F.struct("*").alias("row"))
    left = packed.join(dropped, ["k1", "k2"], "left_anti")
    if groups.filter("row_key = component_id").groupBy("row_key").count().filter("count > 1").isEmpty():
        return left.select("row.*")
    named = left.filter("k1 is not null").groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return named.select("row.*").unionByName(left.filter("k1 is null").select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none and stay. Rows are known by identifier and text hash, so copies
    go together and rows that share only the identifier are judged on their own. An empty table gives
    no rows; all columns travel along in one struct, whatever their names.
    """
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("k1", "k2").distinct()
    packed = docs.select(F.struct("*").alias("row"), *decontaminate.row_keys("doc_id", "text"))
    return packed.join(found, ["k1", "k2"], "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, by the target weights, each document at most once.

    Null and empty texts have no tokens. Within a source rows come in seeded order, ties by
    identifier; repeated rows are documents of their own. Null sources and languages are leaves like
    any other. An empty table gives no rows; all columns travel along in one struct.
    """
    row = F.struct("*").alias("row")
    levels = {"domain": mixing.domain_of(F.col("row.source")), "lang": F.col("row.lang"), "source": F.col("row.source")}
    mixed = mixing.mix(docs.select("doc_id", row), levels, mixing.WEIGHTS, mixing.word_count(text_of("row.text")), budget=F.expr("total * 4 div 5"))
    return mixed.select("row.*")


def put_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their new shard and slot, near-equal in bytes.

    Null texts count as empty, repeated rows take a slot each, of equal hashes identifier and size
    decide. An empty table gives no rows. Columns named old_shard, old_slot, shard or slot are
    replaced, all others travel along in one struct.
    """
    packed = docs.select("doc_id", F.struct("*").alias("row"), sharding.source_shard().alias("home"), sharding.text_bytes().alias("bytes"))
    rows = sharding.reshard(packed, F.col("home"), F.col("bytes"), sharding.SHARDS).rows
    taken = {"old_shard", "old_slot", "shard", "slot"}
    return rows.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in taken], "old_shard", "shard", "slot")
