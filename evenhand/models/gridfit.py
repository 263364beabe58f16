"""Many L2 logistic fits at once: every round is one scan that serves all candidates.

A candidate is a value of C and a number of time blocks to train on. The driver runs one quasi-Newton
descent per candidate and holds vectors as long as the model, as any fit does; a round sends the
current points to the tasks and adds up their losses and slopes. Candidates that converged drop out.

Wide models (over `WIDE` columns) are steered: the direction of a descent is solved with the curvature of
a bounded part of the training rows, one task a candidate, so that a fit takes a few scans of the table
instead of hundreds. Losses, slopes and the test of convergence are always those of all rows.
"""

from __future__ import annotations

import sys
from collections import deque
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.workspace import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installation of this package

FAN = 32  # a round hands at most this many partial sums to the driver
_HEAD = 4  # loss and rows of the training blocks, then of the block after them
_MOST = 36.04365338911715  # logit at which the log loss is cut off, as in `evaluation.log_loss`
WIDE = 1024  # columns beyond which a descent is steered
STEERING_ROWS = 200_000  # most rows behind the curvature of one candidate; it is held in a task
_SOLVED, _MOST_STEPS = 0.03, 200  # residual and steps at which a direction is good enough


@dataclass(frozen=True)
class Candidate:
    """Train with `c` on all rows whose block number is at most `last_block`."""

    c: float
    last_block: int


@dataclass
class Fit:
    """One fitted candidate. `next_loss` is the mean log loss on the block after its training rows."""

    candidate: Candidate
    weights: np.ndarray
    intercept: float
    train_rows: int
    next_rows: int
    next_loss: float | None
    rounds: int
    largest_slope: float
    converged: bool


@dataclass(frozen=True)
class Ask:
    """What a descent needs next: the sums at a point, or inverse curvature there times a slope."""

    at: np.ndarray
    slope: np.ndarray | None = None
    ridge: float = 0.0
    rows: float = 0.0


def _ascending(first: Callable, pairs: deque, slope: np.ndarray) -> Generator[Ask, np.ndarray, np.ndarray]:
    """Inverse curvature times slope: two-loop recursion over the recent (step, change) pairs."""
    out, used = slope.copy(), []
    for step, change in reversed(pairs):
        share = step @ out / (step @ change)
        out -= share * change
        used.append(share)
    out = yield from first(out)
    for (step, change), share in zip(pairs, reversed(used)):
        out += step * (share - change @ out / (step @ change))
    return out


def descend(
    candidate: Candidate, size: int, tol: float, max_rounds: int, memory: int = 10, steered: bool = False,
) -> Generator[Ask, np.ndarray, Fit]:
    """Yields what it asks for, takes the sums of `_round` or the direction of `_steer`, and returns the fit.

    The objective is the mean loss plus 1 / (2 c rows) times the squared weights; the intercept, the
    last element, is not penalised. The diagonal of the curvature at zero scales the descent if it is not steered.
    """
    x = np.zeros(size + 1)
    sums = yield Ask(x)
    rows = sums[1]
    if not rows:
        return Fit(candidate, x[:-1], 0.0, 0, int(sums[3]), None, 1, 0.0, False)
    ridge = np.append(np.full(size, 1.0 / (candidate.c * rows)), 0.0)
    diagonal = np.maximum(sums[_HEAD + size + 1:] / rows + ridge, 1e-12)

    def value(at: np.ndarray, s: np.ndarray) -> tuple[float, np.ndarray]:
        return s[0] / rows + 0.5 * float(ridge @ (at * at)), s[_HEAD:_HEAD + size + 1] / rows + ridge * at

    def first(out: np.ndarray) -> Generator[Ask, np.ndarray, np.ndarray]:
        found = (yield Ask(x, out, ridge[0], rows)) if steered else None
        return found if found is not None and found @ out > 0 else out / diagonal

    loss, slope = value(x, sums)
    pairs: deque = deque(maxlen=3 * memory if steered else memory)
    rounds, stuck = 1, False
    while np.abs(slope).max() > tol and rounds < max_rounds and not stuck:
        way = -(yield from _ascending(first, pairs, slope))
        fall = float(way @ slope)
        step = 1.0
        while True:
            there = x + step * way
            tried = yield Ask(there)
            rounds += 1
            there_loss, there_slope = value(there, tried)
            if there_loss <= loss + 1e-4 * step * fall + 1e-15 * abs(loss):
                break
            if steered and there_loss <= loss + 1e-12 * abs(loss) and abs(way @ there_slope) <= abs(fall):
                break  # the loss no longer tells, the slope does
            step /= 2
            stuck = step < 1e-9
            if stuck or rounds >= max_rounds:
                there, there_loss, there_slope, tried = x, loss, slope, sums
                break
        if (there - x) @ (there_slope - slope) > 0:
            pairs.append((there - x, there_slope - slope))
        x, loss, slope, sums = there, there_loss, there_slope, tried
    gap = float(np.abs(slope).max())
    return Fit(candidate, x[:-1], float(x[-1]), int(rows), int(sums[3]), float(sums[2] / sums[3]) if sums[3] else None,
               rounds, gap, gap <= tol)


PACKED = "block int, rows int, kind int, cols binary, vals binary, lengths binary, y binary"
_CELLS = 131_072  # elements handled at a time, so that the work arrays stay in a core's cache
_SIGNS, _BYTES, _DOUBLES = 0, 1, 8  # a bit, a byte or a double for each value


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes as they need."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 256 else np.uint16 if most < 65_536 else np.int32)


def _wide(buffer, count: int) -> np.ndarray:
    return np.frombuffer(buffer, {1: np.uint8, 2: np.uint16}.get(len(buffer) // max(count, 1), np.int32))


def _record(block: int, cols: np.ndarray, vals: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Rows of one time block as plain arrays; signs take a bit each, small whole numbers a byte."""
    small = vals.astype(np.int8) if np.all(np.abs(vals) <= 100) else vals
    if np.all(np.abs(vals) == 1):
        kind, packed = _SIGNS, np.packbits(vals > 0)
    elif np.array_equal(small, vals):
        kind, packed = _BYTES, small.astype(np.int8)
    else:
        kind, packed = _DOUBLES, vals.astype(float)
    parts = [_narrow(cols), packed, _narrow(lengths), y.astype(float)]
    numbers = [pa.array([x], pa.int32()) for x in (block, len(lengths), kind)]
    return pa.RecordBatch.from_arrays(
        numbers + [pa.array([x.tobytes()], pa.binary()) for x in parts],
        ["block", "rows", "kind", "cols", "vals", "lengths", "y"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one batch and time block as one record."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block, y = batch.column("block").to_numpy(), batch.column("y").to_numpy()
        lengths = batch.column("cols").value_lengths().to_numpy()
        cols, vals = batch.column("cols").flatten().to_numpy(), batch.column("vals").flatten().to_numpy()
        row_block = np.repeat(block, lengths)
        for at in np.unique(block):
            here, own = block == at, row_block == at
            yield _record(at, cols[own], vals[own], lengths[here], y[here])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The block number and arrays of each record."""
    for batch in batches:
        numbers = zip(*(batch.column(name).to_pylist() for name in ("block", "rows", "kind")))
        for at, (block, rows, kind) in enumerate(numbers):
            cols, vals, lengths, y = (batch.column(name)[at].as_buffer() for name in ("cols", "vals", "lengths", "y"))
            lengths = _wide(lengths, rows)
            count = int(lengths.sum(dtype=np.int64))
            if kind == _SIGNS:
                vals = np.unpackbits(np.frombuffer(vals, np.uint8), count=count).view(np.int8) * np.int8(2) - np.int8(1)
            else:
                vals = np.frombuffer(vals, np.int8 if kind == _BYTES else float)
            yield block, _wide(cols, count), vals, lengths.astype(np.int32), np.frombuffer(y, float)


PART_ROWS = PACKED + ", upto int"


def _thin(batches: Iterator[pa.RecordBatch], shares: Sequence[float]) -> Iterator[pa.RecordBatch]:
    """Evenly spread rows of each record. Candidates that train up to block k use a share `shares[k]` of each block: the
    records of blocks up to k under numbers `upto` from k."""
    for block, cols, vals, lengths, y in _unpack(batches):
        place = np.arange(len(lengths)) * 0.6180339887498949 % 1.0
        for k in range(block, len(shares)):
            here = (place < shares[k]) & (place >= (shares[k + 1] if k + 1 < len(shares) else 0.0))
            if here.any():
                own = np.repeat(here, lengths)
                yield _record(block, cols[own], vals[own], lengths[here], y[here]).append_column("upto", pa.array([k], pa.int32()))


def _pieces(cols: np.ndarray, vals: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
    """Runs of rows with about `_CELLS` elements, index and value arrays in the types numpy works with."""
    ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    at = 0
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + _CELLS, "right")) - 1)
        own = slice(ends[at], ends[end])
        yield cols[own].astype(np.intp), vals[own].astype(float), lengths[at:end], y[at:end]
        at = end


class Rows:
    """Rows with their work arrays: sums of point elements by row, and of row numbers by column."""

    def __init__(self, cols: np.ndarray, vals: np.ndarray, lengths: np.ndarray):
        self.cols, self.vals, self.count = cols, vals, len(lengths)
        self.width = int(lengths[0])
        self.even = self.width > 0 and bool((lengths == self.width).all())
        if not self.even:
            self.filled = lengths > 0
            self.starts = (np.cumsum(lengths) - lengths)[self.filled]
            self.row_of = np.repeat(np.arange(self.count), lengths)

    def margin(self, point: np.ndarray, products: np.ndarray) -> np.ndarray:
        np.take(point, self.cols, out=products, mode="clip")
        np.multiply(products, self.vals, out=products)
        if self.even:
            return products.reshape(self.count, self.width).sum(1) + point[-1]
        margin = np.full(self.count, point[-1])
        if len(self.starts):
            margin[self.filled] += np.add.reduceat(products, self.starts)
        return margin

    def spread(self, stat: np.ndarray, on: np.ndarray, size: int, products: np.ndarray) -> np.ndarray:
        if self.even:
            shape = self.count, self.width
            np.multiply(on.reshape(shape), stat[:, None], out=products.reshape(shape))
        else:
            np.multiply(on, stat[self.row_of], out=products)
        return np.bincount(self.cols, products, size)


def _add_sums(out, block, cols, vals, lengths, y, points, last_blocks, curvature: bool) -> None:
    """Adds losses, row counts and slopes (and curvatures, if asked for) of the points over rows of one time block.

    A candidate takes no part in blocks beyond its next one, and only its loss is needed there.
    """
    size = points.shape[1] - 1
    rows, products = Rows(cols, vals, lengths), np.empty(len(cols))
    for k, (point, last) in enumerate(zip(points, last_blocks)):
        if block > last + 1:
            continue
        margin = rows.margin(point, products)
        loss = np.logaddexp(0.0, np.where(y == 1, -margin, margin))
        if block == last + 1:
            out[k, 2:_HEAD] += np.minimum(loss, _MOST).sum(), rows.count
            continue
        p = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
        error = p - y
        out[k, :2] += loss.sum(), rows.count
        out[k, _HEAD:_HEAD + size] += rows.spread(error, vals, size, products)
        out[k, _HEAD + size] += error.sum()
        if curvature:
            bend = p * (1 - p)
            out[k, _HEAD + size + 1:-1] += rows.spread(bend, vals * vals, size, products)
            out[k, -1] += bend.sum()


def _solve(pieces: list[tuple], ask: Ask) -> np.ndarray:
    """Inverse curvature times slope by conjugate gradients; the curvature is the mean over the pieces, at one point.

    If the pieces are not all rows, the curvature leans towards its diagonal, the more so the fewer they are for the
    columns: what few rows do not bend at all is not flat.
    """
    at, slope, ridge = ask.at, ask.slope, ask.ridge
    size, total = len(at) - 1, sum(rows.count for rows, _ in pieces)
    lean = min(0.5, size / total) if total < ask.rows else 0.0
    work = np.empty(max(len(rows.cols) for rows, _ in pieces))
    penalty = np.append(np.full(size, ridge), 0.0)
    bends, diagonal = [], np.zeros(size + 1)
    for rows, vals in pieces:
        products = work[:len(rows.cols)]
        p = 1.0 / (1.0 + np.exp(-np.clip(rows.margin(at, products), -700, 700)))
        bends.append(p * (1 - p) / total)
        diagonal += np.append(rows.spread(bends[-1], vals * vals, size, products), bends[-1].sum())
    penalty += lean * diagonal
    diagonal = np.maximum((1 - lean) * diagonal + penalty, 1e-12)
    bends = [bend * (1 - lean) for bend in bends]
    out, rest = np.zeros(size + 1), slope.copy()
    scaled = rest / diagonal
    way, power = scaled, rest @ scaled
    enough = _SOLVED ** 2 * power
    for _ in range(_MOST_STEPS):
        bent = penalty * way
        for (rows, vals), bend in zip(pieces, bends):
            products = work[:len(rows.cols)]
            stat = rows.margin(way, products) * bend
            bent[:-1] += rows.spread(stat, vals, size, products)
            bent[-1] += stat.sum()
        against = way @ bent
        if not against > 0:
            break
        out = out + power / against * way
        rest = rest - power / against * bent
        scaled = rest / diagonal
        power, before = rest @ scaled, power
        if power <= enough:
            break
        way = scaled + power / before * way
    return out


PART = "task int, k int, sums array<double>"


def as_batch(total: np.ndarray, numbers: Sequence[int] | None = None) -> pa.RecordBatch:
    """One record per candidate, under the number of this task; `numbers` names the candidates if they are not all."""
    k, width = total.shape
    sums = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * width, pa.int32()), pa.array(total.ravel()))
    task = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array([task] * k, pa.int32()), pa.array(numbers[:k] if numbers else range(k), pa.int32()), sums], ["task", "k", "sums"])


def add_up(batches: Iterator[pa.RecordBatch], shape: tuple[int, int]) -> np.ndarray:
    total = np.zeros(shape)
    for batch in batches:
        parts = batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, shape[1])
        for k, part in zip(batch.column("k").to_pylist(), parts):
            total[k] += part
    return total


def in_two_levels(parts: DataFrame, shape: tuple[int, int], tasks: int) -> np.ndarray:
    """The sum of the batches of all `tasks` tasks; beyond `FAN` of them, tasks add up groups of them first."""
    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield as_batch(add_up(batches, shape))

    if tasks > FAN:
        parts = parts.repartition(FAN, F.col("task") % FAN).mapInArrow(merged, PART)
    return add_up(iter(parts.toArrow().to_batches()), shape)


def _round(rows: DataFrame, points: np.ndarray, last_blocks: Sequence[int], curvature: bool, tasks: int) -> np.ndarray:
    """The sums at every point, in one job: one partial result a task, added up in two levels."""
    shape = (len(points), _HEAD + (2 if curvature else 1) * points.shape[1])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for block, *arrays in _unpack(batches):
            for piece in _pieces(*arrays):
                _add_sums(total, block, *piece, points, last_blocks, curvature)
        yield as_batch(total)

    return in_two_levels(rows.mapInArrow(partial, PART), shape, tasks)


def _steer(part: DataFrame, asks: Sequence[Ask], last_blocks: Sequence[int]) -> np.ndarray:
    """The directions asked for, one task each; a task holds the part's rows of its candidate's training blocks."""
    shape = len(asks), len(asks[0].at)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, mine = [], None
        for batch in batches:
            mine = batch.column("k")[0].as_py() if batch.num_rows else mine
            for _, *arrays in _unpack([batch]):
                for cols, vals, lengths, _ in _pieces(*arrays):
                    pieces.append((Rows(cols, vals, lengths), vals))
        total = np.zeros(shape)
        if pieces:
            total[mine] = _solve(pieces, asks[mine])
        yield as_batch(total[[mine]] if pieces else total[:0], [mine])

    takers = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(last).alias("last")) for k, last in enumerate(last_blocks)])
    copies = part.withColumn("_to", F.explode(F.filter(takers, lambda t: t["last"].between(F.col("block"), F.col("upto")))))
    copies = copies.select(F.col("_to.k").alias("k"), *part.columns).repartitionById(len(asks), F.col("k"))
    return add_up(iter(copies.mapInArrow(solved, PART).toArrow().to_batches()), shape)


def fit_all(
    rows: DataFrame, size: int, candidates: Sequence[Candidate], block: Column, label: str = "radiant_win",
    features: str = "features", tol: float = 1e-6, max_rounds: int = 2000,
) -> list[Fit]:
    """Fit every candidate on `rows`, a stored table whose vectors have `size` elements.

    `block` numbers the time blocks of the rows from 0. `tol` bounds the largest slope of the mean
    objective. Rows without a vector or an outcome take no part; without training rows there is no fit
    (`converged` is false, the weights are zero). The rows are packed into arrays once and stored, so that a
    round decodes no rows. A wide model's directions come from a part of them, its losses and slopes from all.
    """
    vector = F.unwrap_udt(features)
    dense = F.sequence(F.lit(0), F.size(vector["values"]) - 1)
    ready = rows.filter(F.col(features).isNotNull() & F.col(label).isNotNull()).select(
        F.coalesce(vector["indices"], dense).alias("cols"), vector["values"].alias("vals"),
        block.cast("int").alias("block"), F.col(label).cast("double").alias("y"))
    ready = settle(ready.mapInArrow(_pack, PACKED), "packed")
    tasks = ready.rdd.getNumPartitions()
    steered = size > WIDE
    last_blocks = [c.last_block for c in candidates]
    part = _part(ready, max(last_blocks, default=0)) if steered else None
    descents = [descend(c, size, tol, max_rounds, steered=steered) for c in candidates]
    asks = {k: next(d) for k, d in enumerate(descents)}
    fits: dict[int, Fit] = {}
    curvature = True
    while asks:
        turned = [k for k, ask in asks.items() if ask.slope is not None]
        if turned:
            found = dict(zip(turned, _steer(part, [asks[k] for k in turned], [last_blocks[k] for k in turned])))
        else:
            turned = list(asks)
            points = np.stack([asks[k].at for k in turned])
            found = dict(zip(turned, _round(ready, points, [last_blocks[k] for k in turned], curvature, tasks)))
            curvature = False
        for k in turned:
            try:
                asks[k] = descents[k].send(found[k])
            except StopIteration as done:
                fits[k] = done.value
                del asks[k]
    return [fits[k] for k in range(len(candidates))]


def _part(ready: DataFrame, last_block: int) -> DataFrame:
    """For each number of training blocks, at most about `STEERING_ROWS` rows of them, stored."""
    found = dict(ready.filter(F.col("block") <= last_block).groupBy("block").agg(F.sum("rows")).collect())
    rows = np.cumsum([found.get(k, 0) for k in range(last_block + 1)])
    shares = [float(min(1.0, STEERING_ROWS / max(r, 1))) for r in rows]
    thinned = ready.filter(F.col("block") <= last_block).mapInArrow(lambda batches: _thin(batches, shares), PART_ROWS)
    return settle(thinned, "steering")
