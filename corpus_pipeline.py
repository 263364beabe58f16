"""From raw documents to shards: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenhand.llm import stages
from evenhand.workspace import fresh_path

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("SimHash near-dedup", stages.drop_near_copies),
    ("decontamination", stages.drop_contaminated),
    ("mixing", stages.mix_sources),
    ("sharding", stages.put_in_shards),
]

#: Fitted scores and fingerprint groups have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
