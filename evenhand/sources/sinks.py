"""File sinks."""

from __future__ import annotations

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """Write rows as Parquet or CSV (with a header), optionally partitioned by columns."""
    if partition_by:
        # Tasks of even size with few values each: no task sorts a large share of the rows by those columns.
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        # Quotes inside a field are doubled, as other CSV readers expect.
        writer = writer.options(header=True, quote='"', escape='"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_report(report: DataFrame, path: str) -> None:
    """Write a one-row report of nested structs as one JSON record."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_model(model: MLWritable, side_tables: dict[str, DataFrame], path: str) -> None:
    """Save a fitted model with the tables needed to apply it (index, weights, solo rates)."""
    model.write().overwrite().save(f"{path}/model")
    for name, table in side_tables.items():
        write_table(table, f"{path}/{name}")
