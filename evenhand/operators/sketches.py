"""Stored sketches of counts and quantiles: merged upwards, without going back to the facts.

Distinct counts use HyperLogLog sketches of 2^12 registers, quantiles KLL sketches of k = 200; both
merge without further loss. Their sizes are bounded by these parameters, not by the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_REGISTERS, K = 12, 200
#: Bounds that hold with over 99 %: three standard errors of a merged distinct count (1.04 / 2^6 each;
#: the merged estimator has no history to be better), and the rank error of a KLL sketch of k = 200.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_REGISTERS / 2), 0.0133 * 2


def sketch_cells(facts: DataFrame, by: Sequence[str], distinct: str, value: str) -> DataFrame:
    """Per group of `by`: rows `n`, `distinct_sketch` of one column and `value_sketch` of another.

    Null values of either column are in neither sketch; `n` counts all rows. One pass, combined
    map-side: a hot group costs each task one sketch.
    """
    return facts.groupBy(*by).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(F.col(distinct), F.lit(LG_REGISTERS)).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(K)).alias("value_sketch"))


def roll_up_sketches(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Coarser cells from finer ones; the facts are not read."""
    return cells.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_double("value_sketch").alias("value_sketch"))


def estimated_distinct(cells: str = "distinct_sketch") -> Column:
    return F.hll_sketch_estimate(cells)


def estimated_quantile(point: float, cells: str = "value_sketch") -> Column:
    """The value at `point` of the ranks; null where the sketch holds no value."""
    return F.when(F.kll_sketch_get_n_double(cells) > 0, F.kll_sketch_get_quantile_double(F.col(cells), F.lit(point)))
