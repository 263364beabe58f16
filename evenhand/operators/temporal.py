"""Joins in time: the row in force at a moment, and the periods that hold a moment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.operators.ranking import ROWS_PER_RANGE, with_range
from evenhand.workspace import settle

LEVELS = 56  # of dyadic buckets: enough for moments below 2^62 at 2^8 a bucket


def as_of_join(
    left: DataFrame,
    right: DataFrame,
    at: str,
    since: str,
    by: Sequence[str] = (),
    within: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Every row of `left` with the columns of the latest row of `right` not after it, or nulls.

    A row of `right` holds from its `since` on, that moment included, until the next one of the same
    `by`. `within` limits its age (in units of the columns, which are numbers). Of rows of `right` with
    equal `by` and `since` the one with the largest other columns holds. Rows of `left` whose `by` or
    `at` is null stay and match nothing; such rows of `right` are left out. Names other than `by` must
    differ between the two sides.

    Both sides are one table in ranges of (by, moment). The last row is taken within a range and
    carried over ranges as one row each, so that neither a long history nor a hot key has to fit one
    task, and nothing is broadcast or multiplied.
    """
    clash = (set(left.columns) & set(right.columns)) - set(by)
    if clash or since in by or at in by:
        raise ValueError(f"columns on both sides: {sorted(clash) or [since, at]}")
    brought = [since, *(c for c in right.columns if c not in by and c != since)]
    note = F.struct(*brought)
    keys = [F.col(b).alias(f"_by{i}") for i, b in enumerate(by)]
    known = F.lit(True)
    for column in [*by, since]:
        known = known & F.col(column).isNotNull()
    moment = T.DoubleType() if any(isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) for df, c in ((left, at), (right, since))) else T.LongType()
    empty_note = F.lit(None).cast(right.select(note.alias("n")).schema["n"].dataType)
    empty_row = F.lit(None).cast(left.select(F.struct("*").alias("r")).schema["r"].dataType)
    notes = right.filter(known).select(*keys, F.col(since).cast(moment).alias("_at"), F.lit(0).alias("_side"), note.alias("_note"), empty_row.alias("_row"))
    rows = left.select(*keys, F.col(at).cast(moment).alias("_at"), F.lit(1).alias("_side"), empty_note.alias("_note"), F.struct("*").alias("_row"))
    names = [f"_by{i}" for i in range(len(by))]
    both = with_range(notes.unionByName(rows), [*names, "_at", "_side"], rows_per_range)

    inside = Window.partitionBy(*names, "_range").orderBy("_at", "_side", "_note").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = both.withColumn("_local", F.last("_note", ignorenulls=True).over(inside)).filter("_side = 1")
    before = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    newest = both.groupBy(*names, "_range").agg(F.max(F.when(F.col("_side") == 0, F.struct("_at", "_note"))).alias("_newest"))
    carry = newest.select(*[F.col(n).alias(f"{n}c") for n in names], F.col("_range").alias("_rangec"), F.last("_newest._note", ignorenulls=True).over(before).alias("_carry"))
    same = F.col("_range") == F.col("_rangec")
    for n in names:
        same = same & (F.col(n) == F.col(f"{n}c"))
    joined = local.join(carry.filter("_carry is not null"), same, "left")
    found = F.when(F.col("_at").isNotNull(), F.coalesce("_local", "_carry"))
    if within is not None:
        joined = joined.withColumn("_found", found)
        found = F.when(F.col("_at") - F.col(f"_found.`{since}`") <= within, F.col("_found"))
    return joined.withColumn("_match", found).select("_row.*", *[F.col(f"_match.`{c}`").alias(c) for c in brought])


def _halved(value: Column, times: Column | int) -> Column:
    """floor(value / 2^times) of a whole number."""
    return F.call_function("shiftright", value, times if isinstance(times, Column) else F.lit(times))


def dyadic_cover(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """The few dyadic buckets (level, bucket) that hold the buckets `low` to `high` exactly once.

    Level k joins 2^k buckets. On the way up, a lower end that is odd and an upper end that is even
    have no parent inside the interval, so they are taken: at most two for each level.
    """
    def at_level(k: Column) -> Column:
        first, last = -_halved(-low, k), _halved(high + 1, k) - 1
        taken = lambda end, odd: F.when((first <= last) & (F.pmod(end, F.lit(2)) == odd), F.struct(k.alias("level"), end.alias("bucket")))
        return F.array(taken(first, 1), taken(last, 0))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at_level)))


def interval_join(
    left: DataFrame, spans: DataFrame, at: str, begin: str, end: str, by: Sequence[str] = (), bits: int = 8,
) -> DataFrame:
    """Pairs of rows with `begin` <= `at` < `end` and equal `by`: the columns of both.

    Moments are numbers below 2^62. A span is cut into dyadic buckets of 2^`bits` and more, at most
    two for each doubling of its length; a moment lies in one bucket of each level that occurs. They
    meet in an equi-join, so each pair is found once, and the exact limits decide at the ends. Long
    and short spans may be mixed. Spans that are empty or lack a limit and rows whose moment or `by`
    is null match nothing; repeated rows match each. Names other than `by` must differ.
    """
    clash = (set(left.columns) & set(spans.columns)) - set(by)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    whole = lambda c: F.floor(F.col(c)).cast("long")
    cover = dyadic_cover(_halved(whole(begin), bits), _halved(whole(end), bits))
    cut = settle(
        spans.filter(F.col(begin) < F.col(end)).select("*", F.explode(cover).alias("_cell")).select("*", "_cell.*").drop("_cell")
        .withColumnsRenamed({"level": "_level", "bucket": "_bucket"}), "span-buckets")
    levels = sorted(r["_level"] for r in cut.select("_level").distinct().collect())  # at most LEVELS
    cells = F.array(*[F.struct(F.lit(k).alias("_level"), _halved(whole(at), bits + k).alias("_bucket")) for k in levels]) if levels else (
        F.array().cast("array<struct<_level:int,_bucket:bigint>>"))
    placed = left.filter(F.col(at).isNotNull()).select("*", F.inline(cells))
    inside = (F.col(begin) <= F.col(at)) & (F.col(at) < F.col(end))
    return placed.join(cut, [*by, "_level", "_bucket"]).filter(inside).select(*left.columns, *[c for c in spans.columns if c not in by])
