"""Did flagged entities move as predicted, and by more than reversion to the mean explains?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.special import binomial_p
from evenhand.operators.significance import OVER, UNDER, WITHIN, regress

UNTOUCHED = "untouched"


def unmatched(left: DataFrame, right: DataFrame, key: str = "hero_id") -> DataFrame:
    """Keys of `left` without a row in `right`."""
    return left.join(right, key, "left_anti").select(key)


def assert_complete(left: DataFrame, right: DataFrame, key: str = "hero_id") -> None:
    missing = unmatched(left, right, key).limit(5).collect()
    if missing:
        raise ValueError(f"entities missing from the second snapshot, for example {missing}")


def merge_snapshots(audited: DataFrame, live: DataFrame, key: str = "hero_id") -> DataFrame:
    """Inner join on the entity; columns present in both get the suffixes `_mine` and `_live`."""
    shared = [c for c in audited.columns if c in live.columns and c != key]
    mine = audited.withColumnsRenamed({c: f"{c}_mine" for c in shared})
    theirs = live.withColumnsRenamed({c: f"{c}_live" for c in shared})
    return mine.join(theirs, key)


def with_change_notes(
    merged: DataFrame, notes: DataFrame, key: str = "name_mine", note_key: str = "name"
) -> DataFrame:
    """Direction of the noted change per entity; entities without a note are `untouched`."""
    looked_up = notes.select(F.col(note_key).alias(key), F.col("direction").alias("patch_touched"))
    return merged.join(looked_up, key, "left").withColumn(
        "patch_touched", F.coalesce("patch_touched", F.lit(UNTOUCHED))
    )


def with_movement(merged: DataFrame, before: str = "win_rate_mine", after: str = "win_rate_live") -> DataFrame:
    """Change and starting offset in points, predicted and actual direction, and whether they
    agree (null where nothing was predicted)."""
    predicted = F.when(F.col("action") == OVER, -1).when(F.col("action") == UNDER, 1).otherwise(0)
    moved = merged.withColumns({
        "delta_pp": (F.col(after) - F.col(before)) * 100,
        "mine_offset_pp": (F.col(before) - 0.5) * 100,
        "predicted_dir": predicted,
    }).withColumn("actual_dir", F.signum("delta_pp").cast("int"))
    return moved.withColumn(
        "matches_prediction",
        F.when(F.col("predicted_dir") != 0, F.col("actual_dir") == F.col("predicted_dir")),
    )


def flagged(moved: DataFrame) -> DataFrame:
    return moved.filter(F.col("action") != WITHIN)


def hit_test(df: DataFrame, hit: str) -> DataFrame:
    """Number of rows, number of hits, and the binomial p-value of the hits."""
    counted = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    return counted.withColumn("p_value", binomial_p(F.col("hits"), F.col("n")))


def reversion(moved: DataFrame) -> DataFrame:
    """The reversion line over all entities."""
    return regress(moved, "mine_offset_pp", "delta_pp")


def null_residuals(moved: DataFrame) -> DataFrame:
    """Flagged entities against the line fitted on unflagged ones.

    `residual_beats_null` is true when the residual lies in the predicted direction. The line is
    one row of two numbers and enters as a scalar.
    """
    line = (
        moved.filter(F.col("action") == WITHIN)
        .agg(F.struct(F.regr_slope("delta_pp", "mine_offset_pp").alias("slope"),
                      F.regr_intercept("delta_pp", "mine_offset_pp").alias("intercept")).alias("line"))
        .scalar()
    )

    def beats(residual: Column) -> Column:
        return F.when(F.col("predicted_dir") == 1, residual > 0).when(F.col("predicted_dir") == -1, residual < 0)

    return (
        flagged(moved).withColumn("_line", line)
        .withColumn("null_predicted_delta",
                    F.col("_line.intercept") + F.col("_line.slope") * F.col("mine_offset_pp"))
        .withColumn("residual_vs_null", F.col("delta_pp") - F.col("null_predicted_delta"))
        .withColumn("residual_beats_null", beats(F.col("residual_vs_null")))
        .drop("_line")
    )


def control_counts(moved: DataFrame) -> DataFrame:
    """Flagged entities with and without a noted change."""
    touched = F.col("patch_touched") != UNTOUCHED
    return flagged(moved).agg(
        F.count(F.lit(1)).alias("n_flagged"),
        F.count_if(touched).alias("n_touched"),
        F.count_if(~touched).alias("n_untouched"),
    )
