"""Splits in time order. Cut points are exact order statistics of the trial id, so a split is a
filter on a column and reaches the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.operators.ranking import order_statistics


def _before(order: str, cut) -> Column:
    return F.lit(True) if cut is None else F.col(order) < F.lit(cut)


def first_test_id(rows: DataFrame, order: str = "match_id", test_fraction: float = 0.2):
    """The id at row int(n * (1 - test_fraction)), or None if no row is left for testing."""
    found = order_statistics(rows, order, lambda n: [int(n * (1 - test_fraction))])
    return next(iter(found.values()), None)


def split_at(rows: DataFrame, cut, order: str = "match_id") -> tuple[DataFrame, DataFrame]:
    """Rows before a cut id, and the rest."""
    return rows.filter(_before(order, cut)), rows.filter(~_before(order, cut))


def chronological_split(
    rows: DataFrame, order: str = "match_id", test_fraction: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """The first int(n * (1 - test_fraction)) rows, and the rest. `order` must be unique."""
    return split_at(rows, first_test_id(rows, order, test_fraction), order)


def expanding_folds(rows: DataFrame, k: int, order: str = "match_id") -> list[tuple[Column, Column, int]]:
    """k of (train condition, test condition, train rows): equal test blocks at the end, each
    trained on all earlier rows."""
    def starts(n: int) -> list[int]:
        return [n - (k - i) * (n // (k + 1)) for i in range(k)]

    cuts = sorted(order_statistics(rows, order, starts).items())
    ends = [cut for _, cut in cuts[1:]] + [None]
    return [
        (_before(order, cut), ~_before(order, cut) & _before(order, end), start)
        for (start, cut), end in zip(cuts, ends)
    ]


def with_row_fraction(rows: DataFrame, fraction: float, order: str = "match_id") -> DataFrame:
    """The earliest int(n * fraction) rows, for learning curves."""
    found = order_statistics(rows, order, lambda n: [int(n * fraction + 1e-9)])
    return rows.filter(_before(order, next(iter(found.values()), None)))
