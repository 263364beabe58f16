"""Bounded, labelled samples for the classifiers, and the folds of their queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo FOLDS; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % FOLDS


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """At most `per_class` documents of each label, outside fold 0, and the labelled rows of each class.

    Identifiers are chosen by their hash. Rows of `labels` without an identifier or label are left
    out, repeated identifiers count once. The chosen identifiers, at most twice `per_class`, are
    broadcast to the scan of `docs`.
    """
    known = (
        labels.select(key, F.col(label).alias("label")).filter(F.col(key).isNotNull() & F.col("label").isin(0, 1) & (fold(key) != 0))
        .groupBy(key).agg(F.max("label").cast("int").alias("label"))
    )
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = None
    for value in (0, 1):
        some = known.filter(F.col("label") == value).orderBy(F.xxhash64(key), key).limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    return docs.join(F.broadcast(chosen), key), sizes


def class_weights(sizes: dict[int, int], seen: dict[int, int], lift: float = 1.0) -> dict[int, float]:
    """Weights that restore the shares of the classes in a sample; `lift` favours label 1."""
    return {c: sizes[c] / max(seen.get(c, 0), 1) * (lift if c else 1.0) for c in sizes}
