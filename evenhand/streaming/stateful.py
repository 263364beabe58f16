"""Ingest with keyed state: each trial id once, and a table of what was turned away and why."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from evenhand import schemas
from evenhand.operators.trials import with_reject_reason
from evenhand.streaming.ingest import accept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COPY, NO_ID = "copy", "missing id"
_ROW = "key long, start long, payload string, reject_reason string, copies long"
_COLUMNS = ["key", "start", "payload", "reject_reason", "copies"]
BUCKETS = 1 << 12  # a call and a state value of Python serve all ids of a bucket; fixed for the life of a checkpoint
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # a store takes what it holds, not 4 MB at least
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",  # timers alone start no batch, so a run ends when caught up
}


def _firsts(valid: pd.DataFrame) -> pd.DataFrame:
    """The first row of each id by start time, then content, in order of id, with the summed copies."""
    some = valid.sort_values(["key", "start", "payload"], kind="stable")
    return some.drop_duplicates("key").assign(copies=some.groupby("key")["copies"].sum().to_numpy())


def _cut_copies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Valid rows of one id in one batch of rows become one, with their number; rejected rows stay."""
    for rows in batches:
        valid = rows["reject_reason"].isna()
        yield pd.concat([_firsts(rows[valid]), rows[~valid]])[rows.columns]


class FirstArrivals(StatefulProcessor):
    """State of a bucket of ids: how often each has come. The first valid row of an id passes, later ones are counted as copies."""

    def __init__(self, forget_after_ms: int | None) -> None:
        self.forget_after_ms = forget_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "ids array<long>, times array<long>, until array<long>")

    def _known(self) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in (self.seen.get() if self.seen.exists() else ([], [], []))]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = None
        for part in rows:
            part = part[_COLUMNS]
            valid = part["reject_reason"].isna()
            if not valid.all():
                yield part[~valid]
            if valid.any():
                kept = _firsts(part[valid] if kept is None else pd.concat([kept, part[valid]]))
        if kept is None:
            return
        ids, times, until = self._known()
        order = np.argsort(ids, kind="stable")
        new_ids, come = kept["key"].to_numpy(np.int64), kept["copies"].to_numpy(np.int64)
        at = np.searchsorted(ids, new_ids, sorter=order)
        at = order[np.minimum(at, len(ids) - 1)] if len(ids) else at
        before = ids[at] == new_ids if len(ids) else np.zeros(len(new_ids), bool)
        times[at[before]] += come[before]
        if not before.all():
            expires = -1
            if self.forget_after_ms is not None:
                expires = timerValues.getCurrentProcessingTimeInMs() + self.forget_after_ms
                self.handle.registerTimer(expires)
            ids, times = np.append(ids, new_ids[~before]), np.append(times, come[~before])
            until = np.append(until, np.full((~before).sum(), expires))
            yield kept[~before].assign(copies=1)
        self.seen.update((ids.tolist(), times.tolist(), until.tolist()))
        again = np.where(before, come, come - 1)
        if again.any():
            yield kept[again > 0].assign(reject_reason=COPY, copies=again[again > 0])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ids, times, until = self._known()
        stay = until > expiredTimerInfo.getExpiryTimeInMs()
        if stay.any():
            self.seen.update((ids[stay].tolist(), times[stay].tolist(), until[stay].tolist()))
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def stateful_ingest(
    stream: DataFrame, accepted: str, rejected: str, checkpoint: str, forget_after_ms: int | None = None,
) -> StreamingQuery:
    """Each valid trial id once into `accepted`, everything else with its reason into `rejected`.

    The state holds one number per id, in RocksDB, hashed into buckets so that one call judges many ids, and lives
    with the checkpoint: the two tables belong to one checkpoint. A batch writes folders of its own number, so a repeated batch replaces
    itself. Copies are cut per batch of rows before the shuffle, so a much-copied id is no hot key, and are
    reported as one row of reason `copy` with their number; of copies in one batch the first by
    start time (missing ones first), then by content, passes. Invalid rows touch no state and are spread by content; an
    id that is null is the reason `missing id`. With `forget_after_ms` an id is forgotten that long
    after it came, at the next batch; a copy that comes later passes again. Fields outside the landing
    schema are not read.
    """
    spark = stream.sparkSession
    columns = [c for c in schemas.TRIAL_LANDING.names if c in stream.columns]
    reasoned = with_reject_reason(stream.select(*columns)).select(
        "match_id", "start_time", F.to_json(F.struct(*columns)).alias("payload"),
        F.when(F.col("match_id").isNull(), NO_ID).otherwise(F.col("reject_reason")).alias("reject_reason"))
    rows = reasoned.select(
        F.when(F.col("reject_reason").isNull(), F.col("match_id")).otherwise(F.xxhash64("payload")).alias("key"),
        F.coalesce("start_time", F.lit(-(2**63))).alias("start"), "payload", "reject_reason", F.lit(1).cast("long").alias("copies"))
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
    judged = rows.mapInPandas(_cut_copies, _ROW).withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        FirstArrivals(forget_after_ms), outputStructType=_ROW, outputMode="Append",
        timeMode="None" if forget_after_ms is None else "ProcessingTime")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("trial", F.from_json("payload", schemas.TRIAL_LANDING)).persist()
        accept(batch.filter("reject_reason IS NULL").select("trial.*")).write.mode("overwrite").parquet(f"{accepted}/batch={batch_id}")
        (batch.filter("reject_reason IS NOT NULL").select("trial.*", "reject_reason", "copies")
         .write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}"))
        batch.unpersist()

    before = {name: spark.conf.get(name, None) for name in _STATE}
    try:
        for name, value in _STATE.items():
            spark.conf.set(name, value)
        return (
            judged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
    finally:  # a query keeps the settings it was started with
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def seen_trials(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a checkpoint as a table: trial id and how often it has come (read between runs)."""
    state = spark.read.format("statestore").option("stateVarName", "seen").load(checkpoint)
    return state.select(F.inline(F.arrays_zip("value.ids", "value.times")).alias("match_id", "times"))
