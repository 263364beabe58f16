"""Line-up columns: text to array and back, and predicates on arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_team(cell: Column | str) -> Column:
    """`'14 42 18'` to `[14, 42, 18]`; any run of white space separates, empty text gives `[]`."""
    text = F.col(cell) if isinstance(cell, str) else cell
    # Splitting on one plain character avoids the regular-expression engine.
    words = F.split(F.translate(text, "\t\n\r\f\v", "     "), " ")
    return F.array_remove(words, "").cast("array<int>")


def format_team(team: Column | str) -> Column:
    """`[14, 42, 18]` to `'14 42 18'`."""
    return F.array_join(F.col(team) if isinstance(team, str) else team, " ")


def has_null_or_zero(team: Column) -> Column:
    return F.exists(team, lambda x: x.isNull() | (x == 0))


def all_distinct(team: Column) -> Column:
    return F.size(F.array_distinct(team)) == F.size(team)
