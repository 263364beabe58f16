"""Incremental ingest of landed trial files, and running rates over what was ingested."""

from __future__ import annotations

from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evenhand import schemas
from evenhand.operators.rates import count_outcomes
from evenhand.operators.ranking import order_statistics
from evenhand.operators.significance import with_interval, with_verdict
from evenhand.operators.trials import entity_facts, first_per_trial, in_mode, valid_trials, with_strata


def landing_stream(spark: SparkSession, landing: str, files_per_batch: int = 1000) -> DataFrame:
    """New JSON files of a landing folder; the checkpoint remembers which were read."""
    return (
        spark.readStream.schema(schemas.TRIAL_LANDING)
        .option("maxFilesPerTrigger", files_per_batch).json(landing)
    )


def accept(landing: DataFrame) -> DataFrame:
    """Valid trials in table form: outcome as 0/1, strata, and the day they started."""
    shaped = valid_trials(landing).withColumn(
        "radiant_win", F.coalesce(F.col("radiant_win"), F.lit(False)).cast("int"))
    # The UTC day, whatever the session's time zone.
    return with_strata(shaped).withColumn("day", F.expr("date_from_unix_date(CAST(start_time div 86400 AS INT))"))


def newest(trials: DataFrame, target: int, before: int | None = None, trial: str = "match_id") -> DataFrame:
    """At most `target` trials with the highest ids, optionally only ids below a cursor.

    The lowest kept id is an exact order statistic, so no task sorts the kept rows. Ids must be
    unique.
    """
    pool = trials if before is None else trials.filter(F.col(trial) < before)
    surplus = pool.count() - target
    if surplus <= 0:
        return pool
    lowest = order_statistics(pool, trial, [surplus])[surplus]
    return pool.filter(F.col(trial) >= lowest)


ID_RANGE = 1 << 20  # ids of one folder


def ingest(stream: DataFrame, table: str, checkpoint: str, id_range: int = ID_RANGE) -> StreamingQuery:
    """Append new valid trials to a Parquet table, each trial id once; stops when caught up.

    Within a batch copies are removed by `first_per_trial`, which keeps one row per task before its
    shuffle, so a much-copied trial is no hot key. Rows are stored by range of ids, and a batch is
    compared with the stored rows of the ranges it holds: copies share the id, so none is missed,
    whatever their start time, and one late copy opens one more range, not all between. A batch owns the
    folder `source=<streaming query>/batch=<id>`, so neither a repeated batch nor a new checkpoint
    replaces rows of others; a batch that was written whole is not written again. All runs on one table
    use the same `id_range`.
    """
    spark = stream.sparkSession
    source: Future = Future()  # known once the query has started
    spark.createDataFrame([], STORED).write.mode("append").partitionBy("source", "batch", "ids").parquet(table)

    def write(batch: DataFrame, batch_id: int) -> None:
        folder = f"{table}/source={source.result()}/batch={batch_id}"
        if _written(spark, folder):
            return
        unique = first_per_trial(accept(batch)).withColumn("ids", F.expr(f"match_id div {id_range}L")).persist()
        held = [r["ids"] for r in unique.select("ids").distinct().collect()]  # at most the span of ids over id_range
        own = (F.col("source") == source.result()) & (F.col("batch") == batch_id)
        stored = stored_trials(batch.sparkSession, table).filter(F.col("ids").isin(held) & ~own)
        fresh = unique.join(stored.select("ids", "match_id"), ["ids", "match_id"], "left_anti")
        laid_out = fresh.repartitionByRange("match_id").sortWithinPartitions("match_id")
        laid_out.write.mode("overwrite").partitionBy("ids").parquet(folder)
        unique.unpersist()

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    source.set_result(query.id)
    return query


STORED = (
    "match_id long, start_time long, duration int, lobby_type int, game_mode int, avg_rank_tier int, "
    "radiant_win int, radiant_team array<int>, dire_team array<int>, started_at timestamp, bracket long, "
    "day date, source string, batch int, ids long"
)


def _written(spark: SparkSession, folder: str) -> bool:
    """Whether Spark's writer has finished this folder."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def stored_trials(spark: SparkSession, table: str) -> DataFrame:
    """The table written by `ingest`, partitioned by streaming query, batch and range of ids."""
    return spark.read.schema(STORED).parquet(table)


def unique_within(stream: DataFrame, delay: str = "7 days", trial: str = "match_id") -> DataFrame:
    """Stream-to-stream alternative: drop copies that arrive within a delay of each other.

    The watermark runs on the time of arrival, so no first arrival is ever late. State holds the ids
    of that delay only. A copy that arrives later comes through again, and all copies of one id meet
    in one task; use `ingest` where an id may be copied very often.
    """
    arrived = stream.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", delay)
    return arrived.dropDuplicatesWithinWatermark([trial]).drop("_arrived")


def running_rates(
    spark: SparkSession, table: str, output: str, checkpoint: str, mode: int | None = 22, tolerance: float = 0.02
) -> StreamingQuery:
    """Entity rates, intervals and verdicts over all trials ingested so far.

    Counts combine map-side and the state is one row per entity. Every batch writes the whole
    small table to its own folder `batch=<id>`. A finished batch of `ingest` is never written again,
    so its files count once; files of an `ingest` that broke off while it moved them into place are
    replaced when it goes on, so start this after `ingest` has caught up.
    """
    trials = in_mode(spark.readStream.schema(STORED).parquet(table), mode)
    counts = count_outcomes(entity_facts(trials), ["hero_id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        rated = batch.withColumn("win_rate", F.col("wins") / F.col("games"))
        with_verdict(with_interval(rated), tolerance).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_rates(spark: SparkSession, output: str) -> DataFrame:
    """The newest table written by `running_rates`."""
    table = spark.read.parquet(output)
    return table.filter(F.col("batch") == table.agg(F.max("batch")).scalar()).drop("batch")
