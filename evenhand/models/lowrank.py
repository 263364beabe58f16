"""Low-rank interaction model: linear weights plus factorised synergy and counter terms.

logit = b + w(A) - w(B) + S(A) - S(B) + P(A)·Q(B) - P(B)·Q(A), where S(T) is the sum of v_i·v_j over
the pairs of a side and P, Q are sums over it. Swapping the sides negates everything but b.

Each step is one Spark job: every task computes the gradient of its rows in numpy and emits one
array, and the arrays are added up in two levels. Rows never leave the executors. The
optimiser state on the driver has n * (3 * rank + 1) + 1 numbers.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.models.folds import chronological_split
from evenhand.models.gridfit import PART, as_batch, in_two_levels
from evenhand.workspace import fresh_path, gather, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class LowRank:
    """Parameters: linear weights, synergy factors, counter factors (attack, defence), intercept."""

    w: np.ndarray
    v: np.ndarray
    p: np.ndarray
    q: np.ndarray
    b: float

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w, self.v.ravel(), self.p.ravel(), self.q.ravel(), [self.b]])

    @staticmethod
    def from_flat(x: np.ndarray, n: int, rank: int) -> LowRank:
        w, v, p, q, b = np.split(x, np.cumsum([n, n * rank, n * rank, n * rank]))
        return LowRank(w, v.reshape(n, rank), p.reshape(n, rank), q.reshape(n, rank), float(b[0]))

    def sums(self, side: np.ndarray) -> tuple[np.ndarray, ...]:
        """Summed v, p, q, w and squares of v over each side, from one table read position by position."""
        rank = self.v.shape[1]
        table = np.column_stack([self.v, self.p, self.q, self.w, (self.v**2).sum(1)])
        total = np.zeros((len(side), table.shape[1]))
        for at in range(side.shape[1]):
            total += table[side[:, at]]
        return total[:, :rank], total[:, rank:2 * rank], total[:, 2 * rank:3 * rank], total[:, -2], total[:, -1]

    def logit(self, a: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Logits of line-ups given as (rows, side size) arrays of column numbers."""
        va, pa, qa, wa, squares_a = self.sums(a)
        vd, pd_, qd, wd, squares_d = self.sums(d)
        # The sum over pairs is half of the squared sum minus the summed squares.
        synergy = 0.5 * ((va**2).sum(1) - squares_a - ((vd**2).sum(1) - squares_d))
        counter = (pa * qd).sum(1) - (pd_ * qa).sum(1)
        return wa - wd + synergy + counter + self.b

    def gradient(self, a: np.ndarray, d: np.ndarray, error: np.ndarray) -> np.ndarray:
        """Gradient of the summed loss, where error is prediction minus outcome per row."""
        va, pa, qa, _, _ = self.sums(a)
        vd, pd_, qd, _, _ = self.sums(d)
        e = error[:, None]
        cuts = 1 + self.v.shape[1] * np.arange(3)
        w_a, v_a, p_a, q_a = np.split(self.indicator(a).T @ (e * np.column_stack([np.ones(len(a)), va, qd, pd_])), cuts, axis=1)
        w_d, v_d, p_d, q_d = np.split(self.indicator(d).T @ (e * np.column_stack([np.ones(len(d)), vd, qa, pa])), cuts, axis=1)
        # d synergy / d v_i is the side's sum without v_i itself.
        return LowRank((w_a - w_d)[:, 0], v_a - v_d - (w_a - w_d) * self.v, p_a - p_d, q_d - q_a, float(error.sum())).flat()

    def indicator(self, side: np.ndarray) -> np.ndarray:
        out = np.zeros((len(side), len(self.w)))
        out[np.arange(len(side))[:, None], side] = 1.0
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def with_sides(encoded: DataFrame) -> DataFrame:
    """Column numbers of each side as arrays, from signed terms."""
    def side(positive: bool) -> Column:
        return F.transform(
            F.filter("terms", lambda t: (t["val"] > 0) == F.lit(positive)), lambda t: t["col"])

    return encoded.withColumns({"cols_a": side(True), "cols_b": side(False)})


_ROWS_PER_FILE = 1_000_000
_INDICATOR_CELLS = 131_072  # rows are handled in pieces whose indicator stays in a core's cache


def _matrix(sides: pa.Array) -> np.ndarray:
    """Lists of equal length as (rows, length), without a Python object a row."""
    lengths = sides.value_lengths().to_numpy()
    if (lengths != lengths[0]).any():
        raise ValueError("the sides of all line-ups must have the same size")
    return sides.flatten().to_numpy().reshape(len(sides), lengths[0])


def _step(rows: DataFrame, params: LowRank, label: str, tasks: int) -> np.ndarray:
    """Gradient over training rows, then log loss and number of validation rows, in one job.

    Every task adds up its rows in one array; the arrays are summed in two levels.
    """
    chunk = max(1, _INDICATOR_CELLS // len(params.w))
    size = params.flat().size

    def partial(batches):
        total = np.zeros((1, size + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            all_a, all_d = _matrix(batch.column("cols_a")), _matrix(batch.column("cols_b"))
            all_y = batch.column(label).to_numpy(zero_copy_only=False).astype(float)
            held_out = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for at in range(0, batch.num_rows, chunk):
                a, d, y, val = (x[at:at + chunk] for x in (all_a, all_d, all_y, held_out))
                prob = _sigmoid(params.logit(a, d))
                clipped = np.clip(prob[val], 1e-6, 1 - 1e-6)
                total[0, size] -= float(np.where(y[val] == 1, np.log(clipped), np.log1p(-clipped)).sum())
                total[0, size + 1] += val.sum()
                total[0, :size] += params.gradient(a[~val], d[~val], (prob - y)[~val])
        yield as_batch(total)

    parts = rows.select("cols_a", "cols_b", label, "held_out").mapInArrow(partial, PART)
    return in_two_levels(parts, (1, size + 2), tasks)[0]


class _Batches:
    """Training rows by seeded batch number, each batch a folder, validation rows in folder -1."""

    def __init__(self, marked: DataFrame, train_rows: int, batches: int, seed: int, trial: str) -> None:
        self.known: dict[tuple[int, bool], tuple[DataFrame, int]] = {}
        self.per_batch = train_rows // batches
        if batches == 1:
            self.rows, self.counts = marked, {0: train_rows}
            return
        spark = marked.sparkSession
        # A batch is cut into tasks by another hash, so that a large one is many files.
        tasks = max(1, -(-self.per_batch // _ROWS_PER_FILE))
        number = F.when(F.col("held_out"), -1).otherwise(F.pmod(F.xxhash64(trial, F.lit(seed)), F.lit(batches)).cast("int"))
        cut = F.pmod(F.xxhash64(trial, F.lit(seed + 1)), F.lit(tasks))
        path = fresh_path(spark, "batches")
        marked.withColumn("batch", number).repartition(F.col("batch"), cut).write.partitionBy("batch").parquet(path)
        self.rows = spark.read.schema(T.StructType([*marked.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(path)
        self.counts = {r["batch"]: r["count"] for r in self.rows.groupBy("batch").count().collect()}  # one row a batch

    def of(self, number: int, validate: bool) -> tuple[DataFrame, int, int]:
        """Rows of a batch, with the validation rows if asked for, their tasks, and the training rows among them."""
        key = (number, validate)
        if key not in self.known:
            rows = self.rows
            if "batch" in rows.columns:
                rows = rows.filter(F.col("batch").isin([number, -1] if validate else [number]))
            rows = gather(rows, self.per_batch)
            self.known[key] = rows, rows.rdd.getNumPartitions()
        return *self.known[key], self.counts.get(number, 0)


def fit(
    encoded: DataFrame, n: int, rank: int = 6, l2: float = 3e-3, lr: float = 0.02, steps: int = 60,
    validation: float = 0.1, seed: int = 0, label: str = "radiant_win", trial: str = "match_id", batches: int = 1,
) -> LowRank:
    """Adam on the gradient of one batch a step; the last part in time validates and the best step is kept.

    With one batch every step reads all training rows. With more, seeded batch numbers are stored
    with the rows, a step reads the folder of its batch only, each pass takes the batches in a new
    order, and validation runs once a pass. Batches count, not rows: a batch grows with the table and
    keeps many tasks busy. Without validation rows the last step is kept.
    """
    rows = encoded.select(trial, "cols_a", "cols_b", label)
    _, held_out = chronological_split(rows, trial, validation)
    cut = held_out.agg(F.min(trial)).first()[0]
    marked = settle(rows.withColumn("held_out", F.col(trial) >= F.lit(cut) if cut is not None else F.lit(False)), "lineups")
    train_rows, rate = marked.filter(~F.col("held_out")).agg(F.count(F.lit(1)), F.avg(label)).first()
    if rate in (None, 0.0, 1.0):
        raise ValueError("a fit needs training rows of both outcomes")
    parts = _Batches(marked, train_rows, batches, seed, trial)

    rng = np.random.default_rng(seed)
    start = LowRank(np.zeros(n), *(rng.normal(0, 0.01, (n, rank)) for _ in range(3)), math.log(rate / (1 - rate)))
    x = start.flat()
    penalised = np.ones_like(x)
    penalised[-1] = 0.0
    m, s = np.zeros_like(x), np.zeros_like(x)
    best_loss, best, order = math.inf, None, np.arange(batches)
    for t in range(1, steps + 2):
        at = (t - 1) % batches
        if at == 0 and batches > 1:
            order = rng.permutation(batches)
        last = t > steps
        rows, tasks, count = parts.of(int(order[at]), validate=at == 0 or last)
        sums = _step(rows, LowRank.from_flat(x, n, rank), label, tasks)
        if sums[-1] and sums[-2] / sums[-1] < best_loss:
            best_loss, best = sums[-2] / sums[-1], x
        if last:
            break
        grad = sums[:-2] / max(count, 1)
        grad += l2 * penalised * x
        m = 0.9 * m + 0.1 * grad
        s = 0.999 * s + 0.001 * grad * grad
        x = x - lr * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return LowRank.from_flat(x if best is None else best, n, rank)


def logit_column(params: LowRank, cols_a: str = "cols_a", cols_b: str = "cols_b") -> Column:
    @F.pandas_udf(T.DoubleType())
    def logit(a: pd.Series, d: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=float)
        return pd.Series(params.logit(np.stack(a), np.stack(d)))

    return logit(cols_a, cols_b)


def predict(params: LowRank, rows: DataFrame, name: str, label: str = "radiant_win", trial: str = "match_id") -> DataFrame:
    """Predictions as (trial, model, p, y) rows."""
    return rows.select(
        trial, F.lit(name).alias("model"), (1 / (1 + F.exp(-logit_column(params)))).alias("p"),
        F.col(label).cast("int").alias("y"),
    )


def antisymmetry_error(params: LowRank, rows: DataFrame) -> DataFrame:
    """Largest deviation of logit(A, B) + logit(B, A) from twice the intercept, over all rows."""
    both = F.abs(logit_column(params) + logit_column(params, "cols_b", "cols_a") - 2 * params.b)
    return rows.agg(F.max(both).alias("max_error"), F.count(F.lit(1)).alias("n"))
