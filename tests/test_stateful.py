"""Ingest with keyed state over several runs."""

import pytest
from pyspark.sql import functions as F

from evenhand.operators import trials as tr
from evenhand.streaming import ingest as st
from evenhand.streaming import stateful
from evenhand.workspace import fresh_path


@pytest.fixture
def api(spark, sf):
    from checks import fixtures as fx
    return fx.arrays(spark, sf).filter("match_id < 300").drop("reject_reason").withColumn("radiant_win", F.col("radiant_win") == 1)


class Ingest:
    def __init__(self, spark, **options):
        self.spark, self.options = spark, options
        self.landing, self.accepted, self.rejected, self.progress = (fresh_path(spark, x) for x in "lars")
        self.runs = 0

    def run(self, rows):
        self.runs += 1
        rows.write.json(f"{self.landing}/{self.runs}")
        stateful.stateful_ingest(
            st.landing_stream(self.spark, f"{self.landing}/*"), self.accepted, self.rejected, self.progress, **self.options,
        ).awaitTermination()

    def ids(self):
        return sorted(r.match_id for r in self.spark.read.parquet(self.accepted).select("match_id").collect())


def test_runs_share_their_state(spark, api):
    job = Ingest(spark)
    # One valid trial makes up half of the first delivery; its earliest row has no start time.
    hot = tr.valid_trials(api).filter("match_id % 2 = 0").agg(F.min("match_id")).first()[0]
    is_hot = F.col("match_id") == hot
    crowd = api.filter(is_hot).select("*", F.explode(F.sequence(F.lit(1), F.lit(250))).alias("k"))
    crowd = crowd.withColumn("start_time", F.when(F.col("k") != 7, F.col("start_time"))).drop("k")
    job.run(api.filter((F.col("match_id") % 2 == 0) & ~is_hot).unionByName(crowd).repartition(3))
    job.run(api.withColumn("start_time", F.col("start_time") - 99).unionByName(api.limit(1).withColumn("match_id", F.lit(None).cast("long"))))
    valid = sorted(r.match_id for r in tr.valid_trials(api).select("match_id").collect())
    assert job.ids() == valid
    assert spark.read.parquet(job.accepted).filter(is_hot).first().start_time is None

    away = spark.read.parquet(job.rejected)
    by_rule = tr.with_reject_reason(api).filter("reject_reason IS NOT NULL").select("match_id", "reject_reason")
    twice = by_rule.filter("match_id % 2 = 0")
    got = away.filter("reject_reason NOT IN ('copy', 'missing id')").select("match_id", "reject_reason")
    assert sorted(got.collect()) == sorted(by_rule.collect() + twice.collect())
    assert away.filter("reject_reason = 'missing id'").count() == 1
    copies = {r.match_id: r.n for r in away.filter("reject_reason = 'copy'").groupBy("match_id").agg(F.sum("copies").alias("n")).collect()}
    assert copies == {i: 250 if i == hot else 1 for i in valid if i % 2 == 0}
    assert {r.match_id: r.times for r in stateful.seen_trials(spark, job.progress).collect()} == {
        i: 251 if i == hot else 2 if i % 2 == 0 else 1 for i in valid}


def test_forgetting_and_empty_deliveries(spark, api):
    some = tr.valid_trials(api).filter("match_id < 60")
    job = Ingest(spark, forget_after_ms=0)
    job.run(some)
    job.run(api.filter("match_id < 0"))
    job.run(some)
    job.run(some)
    ids = sorted(r.match_id for r in some.select("match_id").collect())
    # Forgotten at the start of a later batch, so an id passes again.
    assert set(job.ids()) == set(ids) and len(job.ids()) > len(ids)


def test_ids_of_a_bucket_are_told_apart(spark, api, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 2)
    valid = tr.valid_trials(api)
    job = Ingest(spark)
    job.run(valid.filter("match_id % 3 = 0"))
    job.run(valid.unionByName(valid.filter("match_id % 2 = 0")))
    ids = [r.match_id for r in valid.select("match_id").collect()]
    assert job.ids() == sorted(ids)
    times = {i: 1 + (i % 3 == 0) + (i % 2 == 0) for i in ids}
    assert {r.match_id: r.times for r in stateful.seen_trials(spark, job.progress).collect()} == times
    copies = spark.read.parquet(job.rejected).groupBy("match_id").agg(F.sum("copies").alias("n")).collect()
    assert {r.match_id: r.n for r in copies} == {i: n - 1 for i, n in times.items() if n > 1}
    state = spark.read.format("statestore").option("stateVarName", "seen").load(job.progress)
    assert state.count() <= 2  # a value a bucket, not an id
