"""Exact deduplication as a stream: keyed state on disk, without expiry, and full bytes checked on hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.registry import query, text_of
from evenhand.workspace import fresh_path, settle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: For the time of a start. Without preallocation a store takes the disk of what it holds, not 4 MB each;
#: a stream that goes on needs its last versions only.
STATE_SETTINGS = {
    PROVIDER: ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(frame: DataFrame, key: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digest, identifier and the place of every row: file and row number within it."""
    place = F.struct(F.col(key).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return frame.select(digest(text_of()).alias("digest"), place.alias("place"), text_of().alias("text"))


def run_stream(
    spark: SparkSession, source: str, folder: str, key: str = "doc_id", digest: Callable[[Column], Column] = sha256_hex,
    bytes_per_batch: int = 64 << 30,
) -> DataFrame:
    """Take in all files of `source` that `folder` has not seen yet; return its state per digest.

    The state of a digest holds the row that stays (largest identifier, then file and row number) and
    the number of rows. It lives in RocksDB under the stream's checkpoint and never expires, so a copy
    is found however much later it comes. Every micro-batch writes the states that it changed into a
    folder of its own, overwriting it if the batch is repeated. A later call with the same folder goes
    on where this one ended.
    """
    source = source.rstrip("/")
    schema = spark.read.parquet(source).schema
    # A stream reads a folder or a pattern; the pattern below is this one file or folder.
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(f"{source[:-1]}[{source[-1]}]")
    states = _located(stream, key, digest).groupBy("digest").agg(F.max("place").alias("keeper"), F.count("*").alias("group_size"))

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        running = (
            states.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    running.awaitTermination()
    changes = spark.read.schema(states.schema).parquet(f"{folder}/changes")
    return changes.groupBy("digest").agg(F.max_by("keeper", "group_size").alias("keeper"), F.max("group_size").alias("group_size"))


def decide(spark: SparkSession, source: str, states: DataFrame, key: str = "doc_id", digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per row of `source`: digest, place, keeper, group_size.

    Rows of groups with more than one member are hits: each is compared byte for byte with the row
    that its state keeps. Where a digest turns out to stand for different texts, its rows are grouped
    again by the text itself.
    """
    rows = _located(spark.read.parquet(source), key, digest)
    states = settle(states, "dedup-states")
    decided = rows.drop("text").join(states, "digest")
    hits = settle(rows.join(states.filter("group_size > 1"), "digest"), "dedup-hits")
    kept = hits.filter("place = keeper").select("digest", F.col("text").alias("kept_text"))
    collided = settle(hits.join(kept, "digest").filter("text <> kept_text").select("digest").distinct(), "dedup-collided")
    if collided.isEmpty():
        return decided
    again = hits.select("digest", "place", "text").join(collided, "digest", "left_semi")
    groups = again.groupBy("digest", "text").agg(F.max("place").alias("keeper"), F.count("*").alias("group_size"))
    return decided.join(collided, "digest", "left_anti").unionByName(again.join(groups, ["digest", "text"]).drop("text"))


def dedup(spark: SparkSession, source: str, folder: str | None = None, key: str = "doc_id", digest: Callable[[Column], Column] = sha256_hex, bytes_per_batch: int = 64 << 30) -> DataFrame:
    """Every row of `source` with `keep_id`, `group_size`, `kept` and the SHA-256 of its text.

    `source` is a Parquet file or folder with a `text` column. Null text counts as empty. Of equal texts the row with the
    largest identifier stays, of equal identifiers the one latest by file and row number; a null
    identifier is the smallest. Repeated rows are copies like any other. Other columns play no part.
    An empty table gives no rows. Without `folder` the state is kept for this call only.
    """
    states = run_stream(spark, source, folder or fresh_path(spark, "dedup"), key, digest, bytes_per_batch)
    kept = (F.col("place.file") == F.col("keeper.file")) & (F.col("place.row") == F.col("keeper.row"))
    out = decide(spark, source, states, key, digest)
    plain = digest is sha256_hex
    return out.select(
        F.col("place.id").alias(key), F.col("keeper.id").alias("keep_id"), "group_size", kept.alias("kept"),
        *([F.col("digest").alias("text_sha256")] if plain else []),
    )


@query("op10_stream_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return dedup(spark, f"{sf}/documents.parquet")
