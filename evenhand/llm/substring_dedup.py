"""Repeated passages: super-k-mers of word windows meet in the bucket of their minimiser."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from evenhand.llm.registry import query, table, text_of
from evenhand.workspace import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

WINDOW = 35
MMER = 8
HOT_OCCURRENCES = 50_000  # beyond this, a minimiser's strings are split by a longer one
MOST_LISTED = 1 << 20  # hot minimisers that travel with the tasks, 8 MB; beyond that they are joined
CHUNK_WORDS = 1 << 18
CACHED_WORDS = 1 << 19

NULL_KEY = -(1 << 63)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = value = xxh64_intdigest(word)
        return value


class _WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = len(self)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def mmer_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` word hashes."""
    factor = np.uint64(0xD6E8FEB86659FD93)
    out = words[:len(words) - length + 1].copy()
    for k in range(1, length):
        out = out * factor + words[k:len(words) - length + 1 + k]
    return _mixed(out)


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest of every `width` consecutive values."""
    at, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        reach += step
    return at


def super_kmers(words: np.ndarray, sizes: np.ndarray, window: int, mmer: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: minimiser, document (by position), first window, windows.

    `words` holds the word hashes of documents laid end to end, `sizes` their lengths. A minimiser is
    a place, the leftmost smallest m-mer of the window; equal windows have it at the same offset, so
    two equal windows never lie in one run.
    """
    if len(words) < window:
        empty = np.array([], np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    hashes = mmer_hashes(words, mmer)
    place = leftmost_minima(hashes, window - mmer + 1)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    inside = doc[:len(place)] == doc[window - 1:]
    starts = np.flatnonzero(inside)
    if not len(starts):
        empty = np.array([], np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    p, d = place[starts], doc[starts]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])])
    run = np.flatnonzero(new)
    count = np.diff(np.concatenate([run, [len(starts)]]))
    return hashes[p[run]], d[run], starts[run] - first[d[run]], count


def _chunks(batches: Iterator[pa.RecordBatch], window: int, mmer: int) -> Iterator[tuple]:
    """Keys and words of some documents at a time, with their super-k-mers (see `super_kmers`)."""
    known = _WordHashes()

    def chunk(k1: list, k2: list, words: list) -> tuple:
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        flat = np.fromiter((known[w] for found in words for w in found), np.uint64, sizes.sum())
        return k1, k2, words, *super_kmers(flat, sizes, window, mmer)

    for batch in batches:
        k1, k2, words, held = [], [], [], 0
        for a, b, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("passage_text")):
            found = text.as_py().split()
            if len(found) < window:
                continue
            k1.append(a)
            k2.append(b)
            words.append(found)
            held += len(found)
            if held >= CHUNK_WORDS:
                yield chunk(k1, k2, words)
                k1, k2, words, held = [], [], [], 0
        if words:
            yield chunk(k1, k2, words)


def _find(batches: Iterator[pa.RecordBatch], window: int, mmer: int) -> Iterator[pa.RecordBatch]:
    for k1, k2, _, low, doc, start, count in _chunks(batches, window, mmer):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(k1, dtype=np.int64)[doc]), pa.array(np.array(k2, dtype=np.int64)[doc]),
             pa.array(low.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
            names=["k1", "k2", "minimiser", "start", "windows"])


PACKED = "k1 long, k2 long, minimiser long, start int, packed binary"


def _packed_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED as batches of bounded bytes."""
    names = [f.split()[0] for f in PACKED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) + 64
        if size > 1 << 24:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _pack(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for a, b, text, runs in zip(*[batch.column(c) for c in ("k1", "k2", "passage_text", "runs")]):
                words, key = text.as_py().split(), (a.as_py(), b.as_py())
                for run in runs.as_py():
                    start = run["start"]
                    yield *key, run["minimiser"], start, b" ".join(words[start:start + run["windows"] + window - 1])

    return _packed_batches(rows())


def _pack_listed(batches: Iterator[pa.RecordBatch], window: int, mmer: int, listed: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of the sorted minimisers `listed`, packed while the texts are read."""
    def rows() -> Iterator[tuple]:
        for k1, k2, words, low, doc, start, count in _chunks(batches, window, mmer):
            low = low.view(np.int64)
            at = np.minimum(np.searchsorted(listed, low), len(listed) - 1)
            for i in np.flatnonzero(listed[at] == low).tolist():
                d, s = doc[i], int(start[i])
                yield k1[d], k2[d], int(low[i]), s, b" ".join(words[d][s:s + count[i] + window - 1])

    return _packed_batches(rows())


def _split_finer(batches: Iterator[pa.RecordBatch], window: int, mmer: int) -> Iterator[pa.RecordBatch]:
    """Packed strings cut into super-k-mers of longer minimisers."""
    known = _WordHashes()

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for k1, k2, start, packed in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "start", "packed")]):
                words = packed.split()
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                low, _, first, count = super_kmers(hashes, np.array([len(words)]), window, mmer)
                for m, f, n in zip(low.view(np.int64).tolist(), first.tolist(), count.tolist()):
                    yield k1, k2, m, start + f, b" ".join(words[f:f + n + window - 1])

    return _packed_batches(rows())


def repeated_windows(packed: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and offset of every window that occurs more than once among the packed strings.

    Windows are compared exactly: words get numbers, and sorting pairs of the ranks of runs of 1, 2,
    4, … words ranks runs of twice the length, up to the window.
    """
    ids = _WordIds()
    split = [p.split() for p in packed]
    sizes = np.array([len(s) for s in split])
    rank = np.fromiter((ids[w] for s in split for w in s), np.int64, sizes.sum())
    length = 1
    while length < window:
        step = min(length, window - length)
        left, right = rank[:len(rank) - step], rank[step:]
        pair = left * (rank.max() + 1) + right
        _, rank = np.unique(pair, return_inverse=True)
        length += step
    row = np.repeat(np.arange(len(sizes)), sizes)
    offset = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.flatnonzero((offset + window <= sizes[row])[:len(rank)])
    _, code, times = np.unique(rank[whole], return_inverse=True, return_counts=True)
    again = whole[times[code] > 1]
    return row[again], offset[again]


def _count(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by minimiser; whole minimisers are counted together, some at a time."""
    def settle_rows(k1: np.ndarray, k2: np.ndarray, start: np.ndarray, packed: list[bytes]) -> pa.RecordBatch:
        row, offset = repeated_windows(packed, window)
        if len(row):  # neighbouring windows become one interval
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)])
            head = np.flatnonzero(new)
            last = np.concatenate([head[1:], [len(row)]]) - 1
        else:
            head = last = np.array([], np.int64)
        doc = row[head]
        return pa.RecordBatch.from_arrays(
            [pa.array(k1[doc]), pa.array(k2[doc]), pa.array((start[doc] + offset[head]).astype(np.int32)),
             pa.array((start[doc] + offset[last] + window).astype(np.int32))], names=["k1", "k2", "from_word", "to_word"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < 6 * CHUNK_WORDS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        low = rows.column("minimiser").to_numpy()
        cut = int(np.searchsorted(low, low[-1]))  # the last minimiser may go on in the next batch
        if cut:
            done = rows.slice(0, cut)
            yield settle_rows(*[done.column(c).to_numpy() for c in ("k1", "k2", "start")], done.column("packed").to_pylist())
        rest = rows.slice(cut)
        held, size = rest.to_batches(), rest.nbytes if cut else 0
    if held:
        rows = pa.Table.from_batches(held)
        if rows.num_rows:
            yield settle_rows(*[rows.column(c).to_numpy() for c in ("k1", "k2", "start")], rows.column("packed").to_pylist())


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Every window as a row, a batch of bounded bytes at a time."""
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["k1", "k2", "from_word", "words"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for k1, k2, start, packed in zip(*[batch.column(c).to_pylist() for c in ("k1", "k2", "start", "packed")]):
            words = packed.split()
            for i in range(len(words) - window + 1):
                held.append((k1, k2, start + i, b" ".join(words[i:i + window])))
                size += len(held[-1][3]) + 64
                if size > 1 << 24:
                    yield batch_of(held)
                    held, size = [], 0
    if held:
        yield batch_of(held)


def _cut(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept_text = [], [], []
        for text, spans in zip(batch.column("passage_text"), batch.column("spans").to_pylist()):
            words = text.as_py().split()
            if spans:
                covered = np.zeros(len(words) + 1, np.int32)
                np.add.at(covered, [s["from_word"] for s in spans], 1)
                np.add.at(covered, [s["to_word"] for s in spans], -1)
                left = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
                kept = [words[i] for i in left]
            else:
                kept = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            kept_text.append(b" ".join(kept))
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in keep], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary())],
            names=[*keep, "n_words", "n_removed", "kept_text"])


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, mmer: int = MMER, hot: int = HOT_OCCURRENCES,
) -> DataFrame:
    """One row per row of `docs`: key, `n_words`, `n_removed`, `kept_text` (words joined by a space).

    Words are runs outside ASCII white space, unchanged. Every word goes that is covered by a window
    of `window` words whose sequence also starts anywhere else, in another row or the same one.

    Minimisers are counted first: a window can only recur if its minimiser does, so only super-k-mers
    of recurring minimisers travel on, as packed strings. Each bucket of whole minimisers sorts its
    windows exactly. Where a minimiser has over `hot` occurrences, its strings are split again by a
    longer one and bucketed by that; equal windows share both. What is hot even then consists of
    windows that are much alike: they are counted as rows, combined before the shuffle. Intervals
    return to their texts, which are dealt by key once for all steps. Equal rows (key and text) are
    copies of each other. Null text counts as empty; shorter texts than a window keep all words. An
    empty table gives no rows; other columns play no part.
    """
    prepared = docs.select(
        key, text_of(text).cast("binary").alias("passage_text"),
        F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("k1"), F.xxhash64(text_of(text)).alias("k2"))
    runs = settle(
        prepared.select("k1", "k2", "passage_text")
        .mapInArrow(lambda batches: _find(batches, window, mmer), "k1 long, k2 long, minimiser long, start int, windows int"), "super-kmers")

    def recurring(places: DataFrame, label: str) -> DataFrame:
        return settle(places.groupBy("minimiser").agg(F.count("*").alias("times")).filter("times > 1"), label)

    def packed(minimisers: DataFrame) -> DataFrame:
        listed = runs.join(minimisers.select("minimiser"), "minimiser").groupBy("k1", "k2").agg(
            F.collect_set(F.struct("start", "windows", "minimiser")).alias("runs"))
        return prepared.join(listed, ["k1", "k2"]).mapInArrow(lambda batches: _pack(batches, window), PACKED)

    is_hot = F.col("times") > hot
    counted = recurring(runs, "recurring-minimisers")
    bucketed, loose = packed(counted.filter(~is_hot)), None
    if not counted.filter(is_hot).isEmpty():
        finer_mmer = (mmer + window) // 2
        # At most the places divided by `hot`; while they are few, a second reading spares a shuffle of the texts.
        few = counted.filter(is_hot).select("minimiser").limit(MOST_LISTED + 1).collect()
        if len(few) <= MOST_LISTED:
            listed = np.sort(np.array([r["minimiser"] for r in few], dtype=np.int64))
            strings = prepared.select("k1", "k2", "passage_text").mapInArrow(lambda batches: _pack_listed(batches, window, mmer, listed), PACKED)
        else:
            strings = packed(counted.filter(is_hot))
        finer = settle(strings.mapInArrow(lambda batches: _split_finer(batches, window, finer_mmer), PACKED), "finer-super-kmers")
        counted = recurring(finer, "recurring-finer-minimisers")
        bucketed = bucketed.unionByName(finer.join(counted.filter(~is_hot).select("minimiser"), "minimiser"))
        if not counted.filter(is_hot).isEmpty():
            loose = finer.join(counted.filter(is_hot).select("minimiser"), "minimiser").mapInArrow(
                lambda batches: _windows(batches, window), "k1 long, k2 long, from_word int, words binary")
    spans = (
        bucketed.repartition("minimiser").sortWithinPartitions("minimiser").select("minimiser", "k1", "k2", "start", "packed")
        .mapInArrow(lambda batches: _count(batches, window), "k1 long, k2 long, from_word int, to_word int")
    )
    if loose is not None:
        again = loose.groupBy("words").agg(F.count("*").alias("times")).filter("times > 1")
        spans = spans.unionByName(loose.join(again, "words").select("k1", "k2", "from_word", (F.col("from_word") + window).alias("to_word")))
    marks = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("from_word", "to_word")).alias("spans"))
    kind = dict(docs.dtypes)[key]
    return prepared.join(marks, ["k1", "k2"], "left").mapInArrow(
        lambda batches: _cut(batches, [key]), f"`{key}` {kind}, n_words long, n_removed long, kept_text binary")


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    done = remove_repeats(table(spark, sf, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
