"""Ingest over several runs equals the batch result; a repeated batch does no harm."""

import pytest
from pyspark.sql import functions as F

from evenhand.operators import trials as tr
from evenhand.operators.rates import count_outcomes
from evenhand.streaming import ingest as st
from evenhand.workspace import fresh_path


@pytest.fixture
def api(spark, sf):
    from checks import fixtures as fx
    return fx.arrays(spark, sf).drop("reject_reason").withColumn("radiant_win", F.col("radiant_win") == 1)


def run(spark, landing, table, progress):
    st.ingest(st.landing_stream(spark, f"{landing}/*", 1), table, progress).awaitTermination()


def test_stream_equals_batch(spark, api):
    landing, table, progress = (fresh_path(spark, x) for x in ("landing", "table", "progress"))
    half = F.col("match_id") % 2 == 0
    api.filter(half).coalesce(1).write.json(f"{landing}/1")
    # One trial makes up a third of the first delivery.
    api.filter("match_id = 10").select("*", F.explode(F.sequence(F.lit(1), F.lit(250))).alias("k")).drop("k").write.json(f"{landing}/2")
    run(spark, landing, table, progress)
    api.coalesce(1).write.json(f"{landing}/3")
    run(spark, landing, table, progress)

    batch = tr.valid_trials(api).select("match_id")
    stored = st.stored_trials(spark, table)
    assert stored.count() == stored.select("match_id").distinct().count() == batch.count()
    assert stored.select("match_id").exceptAll(batch).count() == 0

    out, marks = fresh_path(spark, "rates"), fresh_path(spark, "progress")
    st.running_rates(spark, table, out, marks).awaitTermination()
    now = st.latest_rates(spark, out).select("hero_id", "games", "wins")
    trials = tr.in_mode(st.stored_trials(spark, table))
    again = count_outcomes(tr.entity_facts(trials), ["hero_id"])
    assert now.exceptAll(again).count() == again.exceptAll(now).count() == 0


def test_new_checkpoints_lose_and_repeat_nothing(spark, api):
    table = fresh_path(spark, "table")
    some = api.filter("match_id < 400")
    deliveries = [some.filter("match_id % 2 = 0"), some, some.withColumn("start_time", F.lit(None).cast("long"))]
    for df in deliveries:
        landing = fresh_path(spark, "landing")
        df.coalesce(1).write.json(f"{landing}/1")
        run(spark, landing, table, fresh_path(spark, "progress"))
    ids = sorted(r.match_id for r in st.stored_trials(spark, table).select("match_id").collect())
    assert ids == sorted(r.match_id for r in tr.valid_trials(some).select("match_id").collect())


def test_a_late_copy_opens_its_own_range_only(spark, api):
    table = fresh_path(spark, "table")
    some = api.filter("match_id < 1500")
    late = some.filter("match_id IN (1, 2) OR match_id >= 1400")
    for df in (some.filter("match_id < 1400"), late, some):
        landing = fresh_path(spark, "landing")
        df.coalesce(1).write.json(f"{landing}/1")
        st.ingest(st.landing_stream(spark, f"{landing}/*", 1), table, fresh_path(spark, "progress"), id_range=100).awaitTermination()
    stored = st.stored_trials(spark, table)
    assert sorted(r.match_id for r in stored.select("match_id").collect()) == sorted(r.match_id for r in tr.valid_trials(some).select("match_id").collect())
    assert stored.filter("ids <> match_id div 100").isEmpty()
    pruned = stored.filter(F.col("ids").isin([0, 14])).select("match_id")
    assert "PartitionFilters: [ids" in pruned._jdf.queryExecution().executedPlan().toString()
    folders = {r[0].split("/ids=")[1].split("/")[0] for r in pruned.select("_metadata.file_path").distinct().collect()}
    assert folders == {"0", "14"}


def test_newest(spark):
    df = spark.range(100).withColumnRenamed("id", "match_id")
    assert sorted(r.match_id for r in st.newest(df, 5, before=50).collect()) == [45, 46, 47, 48, 49]
    assert st.newest(df, 500).count() == 100
