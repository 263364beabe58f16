"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.workspace import settle


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """`node` and `root`, the smallest node of its component, for every node of `edges` (a, b: long).

    Large-star ties a node's larger neighbours to its smallest one, small-star its smaller ones; the
    two alternate, each over a written table, until every component is a star. Both are a grouped
    minimum and one join, so a node with very many links is combined map-side and split as a skewed
    join key. Loops and repeated edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession
    ends = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    stars = settle(edges.filter("a <> b").select(*ends).distinct(), label)
    seen = None
    while True:
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = small.select("e.u", F.col("e.m").alias("v")).filter("u <> v").distinct()
        stars = settle(small, label)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
