"""File sources, all with explicit schemas."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand import schemas


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and double-quoted fields; `.gz` is read transparently.

    A gzip file is a single split, so land it as Parquet (`sinks.write_table`) before heavy work.
    """
    return spark.read.schema(schema).options(header=True, quote='"', escape='"').csv(path)


def read_trial_export(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.TRIAL_EXPORT)


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.ENTITY_DIMENSION)


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Raw API objects, one JSON object per line."""
    return spark.read.schema(schemas.TRIAL_LANDING).json(path)


def read_latest_snapshot(
    spark: SparkSession,
    path_glob: str,
    schema: T.StructType = schemas.ENTITY_SNAPSHOT,
    date_pattern: str = r"(\d{4}-\d{2}-\d{2})",
) -> DataFrame:
    """Rows of the files with the latest date, with that date as `snapshot_date`.

    A file's date is the last one in its path, so dated parent folders play no part. Only the chosen
    files are read.
    """
    def dated(path):
        return F.element_at(F.regexp_extract_all(path, F.lit(date_pattern), F.lit(1)), -1)

    files = spark.read.format("binaryFile").load(path_glob).select("path").withColumn("date", F.try_element_at(
        F.regexp_extract_all("path", F.lit(date_pattern), F.lit(1)), F.lit(-1))).filter("date is not null")
    latest = files.agg(F.max("date")).scalar()
    paths = [r["path"] for r in files.filter(F.col("date") == latest).collect()]  # the files of one snapshot
    return read_csv(spark, paths or path_glob, schema).withColumn("snapshot_date", dated(F.col("_metadata.file_path")))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A nested JSON report as a one-row DataFrame (schema inferred; the file is one record)."""
    return spark.read.option("multiLine", True).json(path)


def read_model(
    spark: SparkSession, path: str, side_tables: tuple[str, ...] = ("index", "weights", "solo_rates")
) -> tuple[LogisticRegressionModel, dict[str, DataFrame]]:
    """A model written by `sinks.write_model`, with its side tables."""
    model = LogisticRegressionModel.load(f"{path}/model")
    return model, {name: spark.read.parquet(f"{path}/{name}") for name in side_tables}
