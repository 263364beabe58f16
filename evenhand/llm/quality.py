"""Quality by a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from evenhand.llm.labels import class_weights, fold, training_sample
from evenhand.llm.registry import query, table, text_of

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

BUCKETS = 1 << 13
RANK = 8
SAMPLE = 2_000  # training documents of each class
EPOCHS, BATCH, STEP, DECAY, SEED = 30, 128, 0.02, 1e-4, 11
CACHED_WORDS = 1 << 19
LOG_RANGE = 20.0  # logarithms of sizes are divided by this

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:?!"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
STATISTICS = 14


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxh64_intdigest(word) % BUCKETS
        return value


def structure(text: bytes, words: list[bytes], declared: int | None) -> list[float]:
    """Shares and sizes between 0 and about 1. `declared` is the length that the metadata state."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    letters, spaces = counts[_LETTER].sum(), counts[_SPACE].sum()
    solid = max(n - spaces, 1)
    stops, digits = counts[_STOP].sum(), counts[_DIGIT].sum()
    lines = text.split(b"\n")
    distinct = len(set(words)) / max(len(words), 1)
    repeated = 1 - len(set(lines)) / len(lines)
    shouting = counts[_UPPER].sum() / max(letters, 1)
    symbols = (solid - letters - stops - digits) / solid
    chars = n if declared is None else max(declared, 0)
    return [
        float(np.log1p(n) / LOG_RANGE), float(np.log1p(len(words)) / LOG_RANGE), solid / max(len(words), 1) / 20, distinct, shouting,
        symbols, digits / solid, stops / solid, counts[ord("!")] / solid, counts[ord("|")] / solid, counts[128:].sum() / solid,
        repeated, float(np.log1p(n / len(lines)) / LOG_RANGE), float(np.log1p(chars) / LOG_RANGE),
    ]


def features(text: bytes, declared: int | None, buckets: _Buckets) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets with values of unit length, and the structure statistics, of the whole text."""
    words = text.split()
    found, times = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), return_counts=True)
    value = np.log1p(times)
    return found, value / max(float(np.sqrt((value ** 2).sum())), 1e-9), structure(text, words, declared)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # BUCKETS word weights, then STATISTICS
    factors: np.ndarray  # (BUCKETS + STATISTICS, RANK)
    mean: np.ndarray
    spread: np.ndarray
    constant: float | None = None


@dataclass
class Block:
    """Documents as one sparse matrix: row, column and value of every entry."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    n: int


def block(parts: list[tuple[np.ndarray, np.ndarray, list[float]]], mean: np.ndarray, spread: np.ndarray) -> Block:
    sizes = np.array([len(p[0]) for p in parts], np.int64)
    stats = (np.array([p[2] for p in parts]).reshape(-1, STATISTICS) - mean) / spread
    n = len(parts)
    return Block(
        np.concatenate([np.repeat(np.arange(n), sizes), np.repeat(np.arange(n), STATISTICS)]),
        np.concatenate([*[p[0] for p in parts], np.tile(np.arange(BUCKETS, BUCKETS + STATISTICS), n)]).astype(np.int64),
        np.concatenate([*[p[1] for p in parts], np.clip(stats, -5, 5).ravel() / 4]), n)


def raw_scores(m: Machine, x: Block) -> tuple[np.ndarray, np.ndarray]:
    """Linear terms plus all pairwise ones: half of (sum of v x) squared minus the sum of (v x) squared, per factor."""
    z = m.bias + np.bincount(x.rows, m.linear[x.columns] * x.values, minlength=x.n)
    sums = np.empty((x.n, m.factors.shape[1]))
    for f in range(m.factors.shape[1]):
        vx = m.factors[x.columns, f] * x.values
        sums[:, f] = np.bincount(x.rows, vx, minlength=x.n)
        z += 0.5 * (sums[:, f] ** 2 - np.bincount(x.rows, vx * vx, minlength=x.n))
    return z, sums


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_machine(parts: list, y: np.ndarray, importance: np.ndarray) -> Machine:
    """Adam on the weighted log loss, in small batches of a fixed order."""
    stats = np.array([p[2] for p in parts])
    rng, width = np.random.default_rng(SEED), BUCKETS + STATISTICS
    m = Machine(0.0, np.zeros(width), rng.normal(0, 0.02, (width, RANK)), stats.mean(axis=0), stats.std(axis=0) + 1e-6)
    share = importance / importance.mean()
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), m.linear, m.factors)]
    turn = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(parts))
        for start in range(0, len(order), BATCH):
            ids = order[start:start + BATCH]
            x = block([parts[i] for i in ids], m.mean, m.spread)
            z, sums = raw_scores(m, x)
            slope = share[ids] * (sigmoid(z) - y[ids]) / len(ids)
            each = slope[x.rows] * x.values
            grads = [np.array([slope.sum()]), np.bincount(x.columns, each, minlength=width) + DECAY * m.linear, DECAY * m.factors]
            for f in range(RANK):
                grads[2][:, f] += np.bincount(x.columns, each * (sums[x.rows, f] - m.factors[x.columns, f] * x.values), minlength=width)
            turn += 1
            steps = []
            for g, s in zip(grads, state):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.999 * s[1] + 0.001 * g * g
                steps.append(STEP * (s[0] / (1 - 0.9 ** turn)) / (np.sqrt(s[1] / (1 - 0.999 ** turn)) + 1e-8))
            m.bias -= float(steps[0][0])
            m.linear -= steps[1]
            m.factors -= steps[2]
    return m


def prepared(docs: DataFrame, keep: list[str], text: str, chars: str | None) -> DataFrame:
    declared = F.col(chars).cast("long") if chars else F.lit(None).cast("long")
    return docs.select(*keep, text_of(text).cast("binary").alias("quality_body"), declared.alias("quality_chars"))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", chars: str | None = "n_chars", label: str = "quality", per_class: int = SAMPLE) -> Machine:
    """Fit on at most `per_class` labelled documents of each class outside fold 0.

    A document reaches the driver as at most BUCKETS hashed counts and its statistics. Without
    documents of both classes the score is 1 if label 1 occurs, else 0.
    """
    plain = prepared(docs, [key], text, chars)
    sample, sizes = training_sample(plain, labels, label, per_class, key)
    if not sizes.get(0) or not sizes.get(1):
        return Machine(0.0, np.zeros(0), np.zeros((0, RANK)), np.zeros(STATISTICS), np.ones(STATISTICS), float(sizes.get(1, 0) > 0))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for batch in batches:
            rows = [features(b.as_py(), c.as_py(), known) for b, c in zip(batch.column("quality_body"), batch.column("quality_chars"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("label"), pa.array([r[0].astype(np.int32).tobytes() for r in rows], pa.binary()),
                 pa.array([r[1].astype(np.float32).tobytes() for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))],
                names=["id", "label", "buckets", "values", "stats"])

    kind = dict(docs.dtypes)[key]
    rows = sample.select(key, "label", "quality_body", "quality_chars").mapInArrow(
        measure, f"id {kind}, label int, buckets binary, values binary, stats array<double>").collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["buckets"])))
    y = np.array([r["label"] for r in rows], dtype=float)
    seen = {int(v): int((y == v).sum()) for v in (0, 1)}
    if not all(seen.values()):
        return Machine(0.0, np.zeros(0), np.zeros((0, RANK)), np.zeros(STATISTICS), np.ones(STATISTICS), sizes[1] / (sizes[0] + sizes[1]))
    weight = class_weights(sizes, seen)
    parts = [(np.frombuffer(r["buckets"], np.int32).astype(np.int64), np.frombuffer(r["values"], np.float32).astype(float), r["stats"]) for r in rows]
    return fit_machine(parts, y, np.array([weight[int(v)] for v in y]))


def score(docs: DataFrame, machine: Machine, keep: list[str], text: str = "text", chars: str | None = "n_chars", name: str = "score") -> DataFrame:
    """The columns `keep` of `docs` with the quality `score` (0 to 1) of every whole text.

    Scoring takes time linear in the entries of a document. Null texts are empty and score by their
    statistics; a null length counts as the text's own. Repeated rows score alike; an empty table
    gives no rows. `keep` must not name the result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets()
        for batch in batches:
            if machine.constant is not None or not batch.num_rows:
                scores = [machine.constant or 0.0] * batch.num_rows
            else:
                rows = [features(b.as_py(), c.as_py(), known) for b, c in zip(batch.column("quality_body"), batch.column("quality_chars"))]
                scores = sigmoid(raw_scores(machine, block(rows, machine.mean, machine.spread))[0])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(scores, pa.float64())], names=[*keep, name])

    kinds = dict(docs.dtypes)
    return prepared(docs, keep, text, chars).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], f"`{name}` double"]))


@query("op8_quality")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    machine = fit(docs, table(spark, sf, "labels"))
    done = score(docs, machine, ["doc_id"])
    return done.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
