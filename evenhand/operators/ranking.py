"""Global order without a global sort: ranks, running totals, exact order statistics.

An unpartitioned window would move every row to one task. Here rows are range-partitioned on the
key, each range becomes a window partition of its own, and per-range totals are carried across
ranges. Order statistics need no sort at all: repeated histograms narrow the value range around
each wanted rank, and only bucket summaries leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.workspace import settle

ROWS_PER_RANGE = 1_000_000


def with_range(
    df: DataFrame, keys: Sequence[str], rows_per_range: int = ROWS_PER_RANGE, at_most: int | None = None
) -> DataFrame:
    """Add `_range`, a number that rises with `keys`; about `rows_per_range` rows share a value.

    The range number is the partition id of a range shuffle, so the result is written before use:
    every later job then sees the same ranges. Results built on them are exact for any limits.
    A known bound on the number of rows, `at_most`, saves the count where one range is enough.
    """
    if at_most is not None and at_most <= rows_per_range:
        return df.withColumn("_range", F.lit(0))
    table = settle(df, "keys")
    ranges = math.ceil(table.count() / rows_per_range)
    if ranges <= 1:
        return table.withColumn("_range", F.lit(0))
    return settle(
        table.repartitionByRange(ranges, *keys).withColumn("_range", F.spark_partition_id()), "ranges"
    )


def running(
    df: DataFrame,
    key: str,
    value: Column,
    name: str,
    by: Sequence[str] = (),
    how: str = "sum",
    descending: bool = False,
) -> DataFrame:
    """Add `name`: the inclusive running sum or minimum of `value` along `key`, within `by`.

    `df` comes from `with_range` over `by` and `key`. `key` must be unique within `by` (aggregate
    ties before calling) and `by` not null. No group is held in one task, however many rows it has:
    each (group, range) is one.
    """
    fold = {"sum": F.sum, "min": F.min}[how]
    ordered = df.withColumn("_value", value)

    def along(column: str) -> Column:
        return F.col(column).desc() if descending else F.col(column).asc()

    inside = Window.partitionBy(*by, "_range").orderBy(along(key)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*by).orderBy(along("_range")).rowsBetween(Window.unboundedPreceding, -1)
    local = ordered.withColumn("_local", fold("_value").over(inside))
    if "_range" not in df.columns:
        raise ValueError("running needs the ranges of with_range")
    carry = (
        ordered.groupBy(*by, "_range").agg(fold("_value").alias("_total"))
        .select(*by, "_range", fold("_total").over(before).alias("_carry"))
    )
    joined = local.join(carry, [*by, "_range"])
    if how == "sum":
        total = F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0))
    else:
        total = F.least("_local", "_carry")
    return joined.withColumn(name, total).select(*df.columns, name)


def with_global_index(
    df: DataFrame, key: str, name: str = "row_index", rows_per_range: int = ROWS_PER_RANGE
) -> DataFrame:
    """Add a contiguous index from 0 along a unique key."""
    numbered = running(with_range(df, [key], rows_per_range), key, F.lit(1).cast("bigint"), name)
    return numbered.withColumn(name, F.col(name) - 1).drop("_range")


def order_statistics(
    df: DataFrame, column: str, ranks: Sequence[int] | Callable[[int], Sequence[int]], buckets: int = 2048
) -> dict[int, float | int]:
    """The exact values at the given 0-based ranks of a numeric column (nulls left out).

    `ranks` may be a function of the row count. Ranks beyond the rows are absent from the result.

    Each pass counts a histogram over the value ranges still open and collects at most
    `len(ranks) * buckets` summary rows. A range closes once it holds a single distinct value, so
    a value shared by any number of rows costs nothing extra.
    """
    values = df.select(F.col(column).alias("x")).filter(F.col("x").isNotNull())
    x = F.col("x")
    real = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    # -inf, inf and NaN (in this order last) are counted, and ranked without a search.
    ends = [F.count_if(x == -math.inf), F.count_if(x == math.inf), F.count_if(F.isnan(x))] if real else [F.lit(0)] * 3
    finite = (F.abs(x) < math.inf) if real else F.lit(True)
    low, high, rows, below, above, odd = values.agg(
        F.min(F.when(finite, x)), F.max(F.when(finite, x)), F.count("x"), *ends).first()
    values = values.filter(finite)
    wanted = sorted({r for r in (ranks(rows) if callable(ranks) else ranks) if 0 <= r < rows})
    last = rows - above - odd
    found: dict[int, float | int] = {
        r: -math.inf if r < below else math.inf if r < last + above else math.nan for r in wanted if not below <= r < last}
    wanted = [r for r in wanted if r not in found]
    # Open ranges: (low, high, rank of the first row in the range, wanted ranks inside).
    open_ranges = [(low, high, below, wanted)] if wanted else []
    while open_ranges:
        still_open = []
        for lo, hi, start, inside in open_ranges:
            if lo == hi:
                found.update(dict.fromkeys(inside, lo))
            else:
                still_open.append((lo, hi, start, inside))
        if not still_open:
            break
        label, slot = F.lit(None).cast("int"), F.lit(None).cast("double")
        for i, (lo, hi, _, _) in enumerate(still_open):
            here = x.between(F.lit(lo), F.lit(hi))
            share = _share(x, lo, hi, real)
            label = F.when(here, F.lit(i)).otherwise(label)
            slot = F.when(here, F.floor(share * (buckets - 1)).cast("double")).otherwise(slot)
        summary = (
            values.select(label.alias("i"), slot.alias("b"), "x").filter(F.col("i").isNotNull())
            .groupBy("i", "b").agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
            .collect()
        )
        open_ranges = []
        for i, (_, _, start, inside) in enumerate(still_open):
            seen = start
            for row in sorted((r for r in summary if r["i"] == i), key=lambda r: r["lo"]):
                hit = [r for r in inside if seen <= r < seen + row["n"]]
                if hit:
                    open_ranges.append((row["lo"], row["hi"], seen, hit))
                seen += row["n"]
    return found


def _share(x: Column, lo, hi, real: bool) -> Column:
    """Where x lies between lo (0) and hi (1), for limits that are any distance apart."""
    if not real:  # whole numbers: their difference may need one bit more than they have
        wide = "decimal(38,0)"
        return (x.cast(wide) - F.lit(lo).cast(wide)).cast("double") / F.lit(float(hi - lo))
    if math.isinf(hi - lo):
        return (x / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
    return (x - F.lit(lo)).cast("double") / F.lit(float(hi - lo))


def exact_quantiles(df: DataFrame, column: str, points: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation between neighbouring ranks."""
    at: list[float] = []

    def ranks(rows: int) -> list[int]:
        at.extend(q * (rows - 1) for q in points)
        return [f(h) for h in at for f in (math.floor, math.ceil)]

    values = order_statistics(df, column, ranks)
    if not values:
        return [math.nan] * len(points)
    out = []
    for h in at:
        lo, hi, part = values[math.floor(h)], values[math.ceil(h)], h - math.floor(h)
        out.append(lo if lo == hi or not part else lo * (1 - part) + hi * part if math.isinf(hi - lo) else lo + (hi - lo) * part)
    return out
