"""Compare a published table with a recomputed one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(
    published: DataFrame, computed: DataFrame, keys: Sequence[str], tolerance: dict[str, float]
) -> DataFrame:
    """Keys on one side only, or whose values differ by more than the column's relative tolerance.

    `tolerance` names the compared columns; 0 asks for equality. Empty means up to date.
    """
    p, c = published.alias("p"), computed.alias("c")
    matched = reduce(lambda a, b: a & b, [F.col(f"p.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])

    def differs(column: str, allowed: float) -> Column:
        left, right = F.col(f"p.{column}"), F.col(f"c.{column}")
        if allowed == 0:
            return ~left.eqNullSafe(right)
        near = F.abs(left - right) <= allowed * F.greatest(F.abs(left), F.abs(right))
        return ~F.coalesce(near, left.isNull() & right.isNull())

    both = p.withColumn("_p", F.lit(True)).alias("p").join(
        c.withColumn("_c", F.lit(True)).alias("c"), matched, "full"
    )
    changed = F.filter(
        F.array(*[F.when(differs(col, tol), F.lit(col)) for col, tol in tolerance.items()]),
        lambda name: name.isNotNull(),
    )
    status = (
        F.when(F.col("p._p").isNull(), "only computed")
        .when(F.col("c._c").isNull(), "only published")
        .when(F.size(changed) > 0, F.concat(F.lit("differs: "), F.array_join(changed, ", ")))
    )
    return both.select(
        *[F.coalesce(f"p.{k}", f"c.{k}").alias(k) for k in keys], status.alias("status")
    ).filter(F.col("status").isNotNull())


def digests(table: DataFrame, keys: Sequence[str], columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows and an order-free digest of `columns` per group: sums of the halves of two row hashes.

    Every copy of a row counts. Different groups of rows have equal digests with a chance of about 2^-128.
    """
    row = [F.col(c) for c in [*keys, *columns]]
    hashes = [F.xxhash64(*row), F.xxhash64(F.lit("second"), *row, *[c.isNull() for c in row])]
    halves = [half for h in hashes for half in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))]
    return table.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *[
        F.sum(half.cast("decimal(20,0)")).alias(f"sum_{i}") for i, half in enumerate(halves)])


def differences_by_digest(
    published: DataFrame, computed: DataFrame, keys: Sequence[str], tolerance: dict[str, float], groups: int = 1024,
) -> DataFrame:
    """`differences` of two large tables, comparing rows only in groups of keys whose digests differ.

    Each table is scanned once for its digests, which combine map-side into `groups` rows a side; equal
    tables need nothing more. Key groups are hashes of the keys under the common type of both sides, so
    null keys have one, too. Columns outside `keys` and `tolerance` play no part.
    """
    columns = list(tolerance)
    sides = [t.select(F.lit(i).alias("_side"), *keys, *columns) for i, t in enumerate((published, computed))]
    both = sides[0].unionByName(sides[1]).withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups)))
    found = digests(both, keys, columns, ["_group", "_side"])
    parts = [c for c in found.columns if c not in ("_group", "_side")]
    seen = found.groupBy("_group").agg(F.count(F.lit(1)).alias("sides"), F.countDistinct(F.struct(*parts)).alias("kinds"))
    differing = [r["_group"] for r in seen.filter("sides < 2 OR kinds > 1").collect()]  # at most `groups` numbers
    rest = both.filter(F.col("_group").isin(differing) if differing else F.lit(False))
    left, right = (rest.filter(F.col("_side") == i).drop("_side", "_group") for i in (0, 1))
    return differences(left, right, keys, tolerance)


def assert_current(published: DataFrame, computed: DataFrame, keys: Sequence[str], tolerance: dict[str, float]) -> None:
    """Raise if the published table is out of date."""
    stale = differences(published, computed, keys, tolerance).limit(5).collect()
    if stale:
        raise ValueError(f"published table is out of date, for example {stale}")
