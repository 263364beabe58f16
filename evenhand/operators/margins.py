"""Margins of a table of line-ups: all grouping sets, with distinct trials, in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cube(dims: Sequence[str]) -> list[tuple[str, ...]]:
    """All grouping sets over `dims`, the finest first."""
    return [s for n in range(len(dims), -1, -1) for s in combinations(dims, n)]


def grouping_id(kept: Sequence[str], dims: Sequence[str]) -> int:
    """As SQL's GROUPING_ID: one bit for each of `dims`, set where it is left out; the last is bit 0."""
    return sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in kept)


def members_of(trials: DataFrame, trial: str, context: Sequence[str], sides: Sequence[tuple[str, str, Column]], entity: str = "hero_id") -> DataFrame:
    """One row a trial with `members`: entity, side, won (long) and the columns `context`.

    `sides` lists (name, column of entity ids, whether it won).
    """
    def listed(name: str, team: Column, won: Column) -> Column:
        return F.transform(team, lambda e: F.struct(
            e.alias(entity), F.lit(name).alias("side"), won.cast("long").alias("won"), *[F.col(c).alias(c) for c in context]))

    lists = [listed(*side) for side in sides]
    return trials.select(trial, F.concat(*lists).alias("members"))


def margins(rows: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]] | None = None, members: str = "members") -> DataFrame:
    """Per grouping set and group: grouping_id, the dims (null where left out), games, wins, trials.

    `rows` has one row a trial whose array `members` holds structs with the `dims` and `won`. Games are
    members, wins those that won, trials the distinct trials with such a member. Within its row each member
    is marked once a grouping set if it is the first of its group, so a trial is counted once for each of
    its groups without a shuffle by trial; members combine map-side into cells of all `dims`, and every
    grouping set is added up from those cells. A null value of a dim is a group of its own, told
    from a margin by grouping_id. Null or empty `members` count nowhere; repeated rows are trials of
    their own.
    """
    sets = [tuple(s) for s in (cube(dims) if sets is None else sets)]

    dims = list(dims)

    def key(kept: tuple[str, ...]):
        # A constant field keeps the struct of the grand total from being empty.
        return lambda m: F.struct(F.lit(0).alias("_"), *[m[d].alias(d) for d in kept])

    def opens(keys: str):
        """Whether no earlier member of the row has the same key."""
        return lambda k, at: (F.array_position(keys, k) == at + 1).cast("long")

    keys = F.struct(*[F.transform(members, key(s)).alias(f"k{i}") for i, s in enumerate(sets)])
    marks = [F.transform(f"_keys.k{i}", opens(f"_keys.k{i}")).alias(f"o{i}") for i in range(len(sets))]
    numbered = rows.select(F.col(members).alias("_members"), keys.alias("_keys")).select(
        F.inline(F.arrays_zip(F.col("_members").alias("m"), *marks)))
    cells = numbered.select("m.*", *[f"o{i}" for i in range(len(sets))]).groupBy(*dims).agg(
        F.count(F.lit(1)).alias("games"), F.sum(F.coalesce("won", F.lit(0))).alias("wins"),
        *[F.sum(f"o{i}").alias(f"o{i}") for i in range(len(sets))])
    listed = F.array(*[F.struct(
        F.lit(grouping_id(s, dims)).alias("grouping_id"),
        *[(F.col(d) if d in s else F.lit(None).cast(rows.schema[members].dataType.elementType[d].dataType)).alias(d) for d in dims],
        F.col("games"), F.col("wins"), F.col(f"o{i}").alias("trials")) for i, s in enumerate(sets)])
    return cells.select(F.inline(listed)).groupBy("grouping_id", *dims).agg(
        F.sum("games").alias("games"), F.sum("wins").alias("wins"), F.sum("trials").alias("trials"))
