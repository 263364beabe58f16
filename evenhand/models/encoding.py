"""Line-ups as signed features.

Every feature flips its sign when the two sides are swapped. There are three blocks: one column per
entity, one per pair on the same side (synergy), one per pair on opposite sides (counter). Rows
must be valid trials: a line-up then has a fixed number of entities, each once, and so 10 entity
terms and 45 pair terms; they are built from the two arrays without a join or a shuffle. Grouping
their rows by trial needs none either if `workspace.dealt` has placed the arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.operators.ranking import with_global_index
from evenhand.workspace import settle

# Ids up to this bound are looked up in an array literal inside the scan stage; beyond it, the
# same functions join and regroup by row. The plan changes, the result does not.
MAX_DENSE_ID = 65_536


def vocabulary(
    trials: DataFrame, team_a: str = "radiant_team", team_b: str = "dire_team", entity: str = "hero_id"
) -> DataFrame:
    """Distinct entities of both sides."""
    return trials.select(F.explode(F.concat(team_a, team_b)).alias(entity)).distinct()


def entity_index(trials: DataFrame, entity: str = "hero_id", **teams) -> DataFrame:
    """Contiguous column number `col` over the sorted distinct entities."""
    return with_global_index(vocabulary(trials, entity=entity, **teams), entity, "col")


def dense_lookup(
    table: DataFrame, key: str, value: str, kind: str, max_id: int = MAX_DENSE_ID
) -> Callable[[Column], Column] | None:
    """A function from id to value over an array indexed by id, or None if ids exceed `max_id`.

    Ids of any integer type that the table does not hold give null.

    `key` must be unique, so a table that fits has at most `max_id` + 1 rows; no more than one row
    beyond that comes to the driver. The array travels as one text literal that the optimizer folds.
    """
    rows = table.select(key, value).limit(max_id + 2).collect() if max_id > 0 else []
    rows = [(k, v) for k, v in rows if k is not None and v is not None]
    if not rows or len(rows) > max_id + 1 or any(not 0 <= key <= max_id for key, _ in rows):
        return None
    slots = ["-"] * (int(max(key for key, _ in rows)) + 1)
    for key, value in rows:
        slots[int(key)] = repr(value)
    array = F.split(F.lit(",".join(slots)), ",").try_cast(f"array<{kind}>")
    return lambda ids: F.get(array, ids.try_cast("int"))  # null outside the array


def signed_ids(team_a: str = "radiant_team", team_b: str = "dire_team") -> Column:
    """Array of (id, sign): +1 for side A, -1 for side B."""
    def side(team: str, sign: float) -> Column:
        return F.transform(team, lambda h: F.struct(h.alias("id"), F.lit(sign).alias("val")))

    return F.concat(side(team_a, 1.0), side(team_b, -1.0))


ROW_KEY = "_row"


def with_row_key(df: DataFrame) -> DataFrame:
    """A stored copy of `df` whose rows are numbered by `ROW_KEY`, so that equal rows stay apart.

    The numbers are written with the rows: a lost executor cannot renumber them.
    """
    return settle(df.withColumn(ROW_KEY, F.monotonically_increasing_id()), "keyed")


def no_terms() -> Column:
    return F.array().cast("array<struct<col:int,val:double>>")


def translate(
    df: DataFrame, terms: Column, mapping: DataFrame, key: str, value: str,
    carry: Sequence[str], trial: str = "match_id", name: str = "terms", max_id: int = MAX_DENSE_ID,
    id_field: str = "id",
) -> DataFrame:
    """Replace the ids, in field `id_field`, of (id, val) terms by the mapping's integers, giving sorted (col, val) terms.

    Ids outside the mapping are dropped, and a row whose terms are null has none. Returns `trial`,
    the `carry` columns and the terms, one row for each row of `df`, repeated ones included.
    """
    keep = [trial, *[c for c in carry if c != trial]]
    lookup = dense_lookup(mapping, key, value, "int", max_id)
    if lookup is not None:
        mapped = F.transform(terms, lambda t: F.struct(lookup(t[id_field]).alias("col"), t["val"].alias("val")))
        known = F.sort_array(F.filter(mapped, lambda t: t["col"].isNotNull()))
        return df.select(*keep, F.coalesce(known, no_terms()).alias(name))
    rows = with_row_key(df.select(*keep, terms.alias("_terms")))
    known = mapping.select(key, F.col(value).cast("int").alias("col")).filter("col is not null")
    long = rows.select(ROW_KEY, F.inline("_terms")).select(ROW_KEY, F.col(id_field).alias(key), "val")
    per_row = long.join(known, key).groupBy(ROW_KEY).agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias(name))
    return rows.join(per_row, ROW_KEY, "left").select(*keep, F.coalesce(name, no_terms()).alias(name))


def encode(
    trials: DataFrame, index: DataFrame, carry: Sequence[str] = ("radiant_win",), entity: str = "hero_id",
    trial: str = "match_id", team_a: str = "radiant_team", team_b: str = "dire_team", max_id: int = MAX_DENSE_ID,
) -> DataFrame:
    """Entity block: `terms` of (col, ±1) per trial. Unknown entities are ignored."""
    return translate(trials, signed_ids(team_a, team_b), index, entity, "col", carry, trial, max_id=max_id)


def pair_position(i: Column, j: Column, n: int) -> Column:
    """Position of the unordered pair i < j among all pairs of n columns, row by row."""
    return (i * (2 * n - i - 1) / 2).cast("int") + (j - i - 1)


def pair_count(n: int) -> int:
    return n * (n - 1) // 2


def all_terms(n: int) -> Callable[[Column], Column]:
    """A function from the sorted entity terms of line-ups to all their terms, sorted by column.

    Column numbers follow the entity block: n + position for synergy, n + pairs + position for
    counter. A counter term is +1 if the lower column stands on side A. Entity terms are sorted by
    column, so each pair is met once, as lower before higher. Line-ups of one size are worked on
    together as a matrix; nested array functions take several times as long.
    """
    pairs = pair_count(n)

    def blocks(terms: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = terms.flatten()
        col, val = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        first = np.cumsum(sizes) - sizes
        ends = np.concatenate([[0], np.cumsum(sizes + sizes * (sizes - 1) // 2)])
        cols, vals = np.empty(ends[-1], np.int32), np.empty(ends[-1])
        for size in np.unique(sizes[sizes > 0]):
            rows = np.flatnonzero(sizes == size)
            at = first[rows, None] + np.arange(size)
            c, v = col[at].astype(np.int64), val[at]
            low, high = np.triu_indices(size, 1)
            i, j = c[:, low], c[:, high]
            base = np.where(v[:, low] == v[:, high], n, n + pairs)
            c = np.concatenate([c, base + i * (2 * n - i - 1) // 2 + j - i - 1], axis=1)
            v = np.concatenate([v, v[:, low]], axis=1)
            order = np.argsort(c, axis=1, kind="stable")
            sorted_c = np.take_along_axis(c, order, axis=1)
            if (sorted_c[:, 1:] == sorted_c[:, :-1]).any():
                order = np.lexsort((v, c), axis=1)
            to = ends[rows, None] + np.arange(c.shape[1])
            cols[to], vals[to] = sorted_c, np.take_along_axis(v, order, axis=1)
        return pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(cols), pa.array(vals)], ["col", "val"]),
            mask=terms.is_null())

    return F.arrow_udf(blocks, "array<struct<col:int,val:double>>")


def with_pairs(encoded: DataFrame, n: int) -> DataFrame:
    """Append the pair terms to `terms`, sorted by column."""
    return encoded.withColumn("terms", all_terms(n)("terms"))


def encode_pairwise(trials: DataFrame, index: DataFrame, n: int, **columns) -> DataFrame:
    """All three blocks: `terms` of (col, value) per trial over n + 2 * n(n-1)/2 columns."""
    return with_pairs(encode(trials, index, **columns), n)


def long_form(encoded: DataFrame, trial: str = "match_id") -> DataFrame:
    """One row per trial and non-zero column.

    The outer generator leaves the terms to be computed once: for the inner one the optimizer adds a filter on
    their size, which computes them again.
    """
    return encoded.select(trial, F.inline_outer("terms")).filter(F.col("col").isNotNull())


def pair_rows(encoded: DataFrame, n: int, keep: Sequence[str] = ("match_id",)) -> DataFrame:
    """One row per trial and pair column: the pair terms of `all_terms` as rows.

    Two generators, so the whole step is compiled; the first is an outer one as in `long_form`.
    """
    low = encoded.select(*keep, "terms", F.posexplode_outer("terms").alias("at", "low"))
    pairs = low.select(*keep, "low", F.explode(F.slice("terms", F.col("at") + 2, F.size("terms"))).alias("high"))
    together = F.col("low.val") == F.col("high.val")
    base = F.when(together, F.lit(n)).otherwise(F.lit(n + pair_count(n)))
    return pairs.select(
        *keep, (base + pair_position(F.col("low.col"), F.col("high.col"), n)).alias("col"), F.col("low.val").alias("val"))


def pairwise_rows(encoded: DataFrame, n: int, trial: str = "match_id") -> DataFrame:
    """All three blocks in long form. Pass a stored table; it is read for each part."""
    return long_form(encoded, trial).unionByName(pair_rows(encoded, n, (trial,)))


def pair_occurrences(encoded: DataFrame, n: int) -> DataFrame:
    """Trials in which each pair column is non-zero, zero counts included.

    The pair rows combine map-side into at most n(n-1) counts.
    """
    seen = pair_rows(encoded, n, ()).groupBy("col").agg(F.count(F.lit(1)).alias("n"))
    spark = encoded.sparkSession
    universe = spark.range(n, n + 2 * pair_count(n)).select(F.col("id").cast("int").alias("col"))
    return universe.join(seen, "col", "left").select(
        "col", F.when(F.col("col") < n + pair_count(n), "synergy").otherwise("counter").alias("kind"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def occurrence_classes(counts: DataFrame) -> DataFrame:
    """How many pair columns are never, rarely or often seen; the last two classes overlap."""
    n = F.col("n")
    return counts.agg(
        F.count_if(n == 0).alias("never"),
        F.count_if((n >= 1) & (n < 10)).alias("1_to_9"),
        F.count_if((n >= 10) & (n < 30)).alias("10_to_29"),
        F.count_if(n >= 30).alias("at_least_30"),
        F.count_if(n >= 100).alias("at_least_100"),
        F.count(F.lit(1)).alias("total_columns"),
    )


def kept_columns(counts: DataFrame, n: int, min_occurrences: int) -> DataFrame:
    """All entity columns and the pair columns seen often enough, renumbered without gaps."""
    spark = counts.sparkSession
    entities = spark.range(n).select(F.col("id").cast("int").alias("col"))
    pairs = counts.filter(F.col("n") >= min_occurrences).select("col")
    return with_global_index(entities.unionByName(pairs), "col", "new_col")


def trim(encoded: DataFrame, kept: DataFrame, carry: Sequence[str] = ("radiant_win",), trial: str = "match_id",
         max_id: int = MAX_DENSE_ID) -> DataFrame:
    """Keep and renumber the columns of `kept`."""
    return translate(encoded, F.col("terms"), kept, "col", "new_col", carry, trial, max_id=max_id, id_field="col")


def as_vectors(encoded: DataFrame, size: int, carry: Sequence[str] = ("match_id", "radiant_win"), name: str = "features") -> DataFrame:
    """Store the terms as ML sparse vectors and read them back.

    The stored struct has the layout of a sparse vector, so reading it with the vector type needs
    no per-row conversion, and repeated fits start from a written table.
    """
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"),
        F.transform("terms", lambda t: t["col"]).alias("indices"),
        F.transform("terms", lambda t: t["val"]).alias("values"),
    )
    stored = encoded.select(*carry, vector.alias(name))
    fields = [stored.schema[c] for c in carry] + [T.StructField(name, VectorUDT())]
    return settle(stored, "vectors", T.StructType(fields))
