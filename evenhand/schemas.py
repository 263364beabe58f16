"""Explicit schemas of every table read from or written to files."""

from pyspark.sql import types as T

TRIAL_EXPORT = T.StructType([
    T.StructField("match_id", T.LongType()),
    T.StructField("start_time", T.LongType()),
    T.StructField("duration", T.IntegerType()),
    T.StructField("lobby_type", T.IntegerType()),
    T.StructField("game_mode", T.IntegerType()),
    T.StructField("avg_rank_tier", T.IntegerType()),
    T.StructField("radiant_win", T.IntegerType()),
    T.StructField("radiant_team", T.StringType()),
    T.StructField("dire_team", T.StringType()),
])

# One API object per line; teams are lists and any field may be missing.
TRIAL_LANDING = T.StructType([
    T.StructField("match_id", T.LongType()),
    T.StructField("start_time", T.LongType()),
    T.StructField("duration", T.IntegerType()),
    T.StructField("lobby_type", T.IntegerType()),
    T.StructField("game_mode", T.IntegerType()),
    T.StructField("avg_rank_tier", T.IntegerType()),
    T.StructField("radiant_win", T.BooleanType()),
    T.StructField("radiant_team", T.ArrayType(T.IntegerType())),
    T.StructField("dire_team", T.ArrayType(T.IntegerType())),
])

ENTITY_DIMENSION = T.StructType([
    T.StructField("hero_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("primary_attr", T.StringType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("roles", T.StringType()),
])

ENTITY_SNAPSHOT = T.StructType([
    T.StructField("hero_id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("picks", T.LongType()),
    T.StructField("wins", T.LongType()),
    T.StructField("win_rate", T.DoubleType()),
])

CHANGE_NOTES = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("detail", T.StringType()),
])

PREDICTIONS = T.StructType([
    T.StructField("match_id", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("p", T.DoubleType()),
    T.StructField("y", T.IntegerType()),
])
