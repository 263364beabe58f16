"""Spelling variants: k-d trees over letter-count vectors find the words one edit apart.

One inserted, deleted or replaced letter moves a word's vector of letter counts by at most two in L1
distance: by one letter up, one down, or one of each. Words of one length share a tree; a range search
of every word runs per pair of lengths, prunes boxes that lie too far, and the order of the letters
decides on what is left.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm.registry import ascii_lower, query, table, text_of
from evenhand.workspace import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

LETTERS = r"[A-Za-zÀ-ÿ]"
DIMS = 26 + 64  # a-z and U+00C0 to U+00FF
SAMPLE = 1 << 16  # words that shape the upper trees, at most; every word is indexed by them
SAMPLED_CHARS = 64  # longer words share one leaf for each length
LEAF_WORDS, LEAF_CHARS = 1 << 14, 1 << 19  # of one cell's points and of its queries
LOCAL_LEAF = 64
FRONTIER = 1 << 17  # pairs of node and query, or of words, held at once
FAR = 1 << 30


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Counts per letter of equally long words given as rows of code points."""
    n, length = codes.shape
    letter = np.where(codes >= 0xC0, codes - (0xC0 - 26), codes - 97).astype(np.int64)
    flat = (np.arange(n, dtype=np.int64)[:, None] * DIMS + letter).ravel()
    return np.bincount(flat, minlength=n * DIMS).reshape(n, DIMS).astype(np.int16 if length < 1 << 14 else np.int32)


def code_points(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).reshape(len(words), length)


def sketches(counts: np.ndarray) -> np.ndarray:
    """64 bits: every copy of a letter flips one of them, so near vectors differ in few."""
    out = np.zeros(len(counts), np.uint64)
    for k in range(min(8, int(counts.max(initial=0)))):
        bit = np.uint64(1) << ((np.arange(DIMS) + 26 * k) % 64).astype(np.uint64)
        out ^= np.bitwise_xor.reduce(np.where(counts > k, bit, np.uint64(0)), axis=1)
    return out


@dataclass
class Tree:
    """Nodes in arrays. A child stands at `left` or `left + 1`; -1: a leaf of points `low` to `high`.

    A child's range in its parent's letter replaces the range that the path had there before.
    """

    letter: np.ndarray
    left: np.ndarray
    before: np.ndarray  # per node: the range of its own letter (low, high) on the path so far
    after: np.ndarray  # per node: the range of the parent's letter within it
    low: np.ndarray
    high: np.ndarray
    order: np.ndarray  # points in the order of the leaves
    cut: np.ndarray


def _best_split(counts: np.ndarray) -> tuple[int, int] | None:
    """The letter and highest count to the left that halve the rows best; None if all rows are equal."""
    low, high = counts.min(axis=0), counts.max(axis=0)
    if (low == high).all():
        return None
    best, found = len(counts), None
    for value in range(int(low.min()), min(int(high.max()), int(low.min()) + 6)):
        left = (counts <= value).sum(axis=0)
        off = np.abs(2 * left - len(counts))
        letter = int(np.argmin(off))
        if 0 < left[letter] < len(counts) and off[letter] < best:
            best, found = int(off[letter]), (letter, value)
    if found is None:
        letter = int(np.argmax(high.astype(np.int64) - low))
        found = letter, (int(low[letter]) + int(high[letter])) // 2
    return found


def build_tree(counts: np.ndarray, leaf: int) -> Tree:
    letter, left, before, after, low, high, cut = ([] for _ in range(7))
    order = np.arange(len(counts))

    def new(lo: int, hi: int, range_in_parent: tuple[int, int]) -> int:
        for column, value in ((letter, 0), (left, -1), (before, (-FAR, FAR)), (after, range_in_parent), (low, lo), (high, hi), (cut, 0)):
            column.append(value)
        return len(letter) - 1

    waiting = [(new(0, len(counts), (-FAR, FAR)), {})]
    while waiting:
        node, ranges = waiting.pop()
        lo, hi = low[node], high[node]
        mine = order[lo:hi]
        split = _best_split(counts[mine]) if hi - lo > leaf else None
        if split is None:
            continue
        d, value = split
        column = counts[mine, d]
        goes_left = column <= value
        order[lo:hi] = np.concatenate([mine[goes_left], mine[~goes_left]])
        middle = lo + int(goes_left.sum())
        letter[node], cut[node], before[node] = d, value, ranges.get(d, (-FAR, FAR))
        # The cut bounds a side, not the points seen: a tree shaped by a sample has to place any word.
        outer = before[node]
        parts = [(lo, middle, (outer[0], value)), (middle, hi, (value + 1, outer[1]))]
        left[node] = len(letter)
        children = [new(a, b, r) for a, b, r in parts]
        waiting += [(child, ranges | {d: r}) for child, (_, _, r) in zip(children, parts)]
    return Tree(np.array(letter), np.array(left), np.array(before), np.array(after), np.array(low), np.array(high), order, np.array(cut))


def leaf_of(tree: Tree, counts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(counts), np.int64)
    while True:
        inner = tree.left[node] >= 0
        if not inner.any():
            return node
        at = node[inner]
        node[inner] = tree.left[at] + (counts[inner, tree.letter[at]] > tree.cut[at])


def leaves_near(tree: Tree, counts: np.ndarray, more: int, less: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of `counts`, leaf node) wherever the box may hold a vector with `more` letters added and `less` taken."""
    waiting = [(np.zeros(len(counts), np.int64), np.arange(len(counts)), np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64))]
    while waiting:
        node, row, up, down = waiting.pop()
        if len(node) > FRONTIER:
            half = len(node) // 2
            waiting += [tuple(x[half:] for x in (node, row, up, down)), tuple(x[:half] for x in (node, row, up, down))]
            continue
        inner = tree.left[node] >= 0
        if not inner.all():
            yield row[~inner], node[~inner]
            node, row, up, down = (x[inner] for x in (node, row, up, down))
        if not len(node):
            continue
        value = counts[row, tree.letter[node]].astype(np.int64)
        was_up = np.maximum(tree.before[node, 0] - value, 0)
        was_down = np.maximum(value - tree.before[node, 1], 0)
        next_level = []
        for side in (0, 1):
            child = tree.left[node] + side
            ups = up - was_up + np.maximum(tree.after[child, 0] - value, 0)
            downs = down - was_down + np.maximum(value - tree.after[child, 1], 0)
            alive = (ups <= more) & (downs <= less)
            next_level.append(tuple(x[alive] for x in (child, row, ups, downs)))
        waiting.append(tuple(np.concatenate(x) for x in zip(*next_level)))


def one_edit(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For rows of code points side by side: is exactly one letter inserted, deleted or replaced?"""
    if points.shape[1] == queries.shape[1]:
        return (points != queries).sum(axis=1) == 1
    longer, shorter = (points, queries) if points.shape[1] > queries.shape[1] else (queries, points)
    same_head = np.logical_and.accumulate(longer[:, :-1] == shorter, axis=1).sum(axis=1)
    same_tail = np.logical_and.accumulate((longer[:, 1:] == shorter)[:, ::-1], axis=1).sum(axis=1)
    return same_head + same_tail >= shorter.shape[1]


def search(points: list[str], point_n: np.ndarray, queries: list[str], leaf: int = LOCAL_LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Per query: how many of `points` (all of one length) are near, and the best one's index or -1.

    The best has the largest `point_n`, of equal ones the smallest word.
    """
    length = len(points[0])
    rank_order = np.array(sorted(range(len(points)), key=lambda i: (-int(point_n[i]), points[i])))
    rank = np.empty(len(points), np.int64)
    rank[rank_order] = np.arange(len(points))
    codes = code_points(points, length)
    counts = letter_counts(codes)
    tree = build_tree(counts, leaf)
    marks = sketches(counts)[tree.order]
    found, best = np.zeros(len(queries), np.int64), np.full(len(queries), len(points))
    by_length = defaultdict(list)
    for i, word in enumerate(queries):
        by_length[len(word)].append(i)
    for other, chosen in by_length.items():
        if abs(other - length) > 1:
            continue
        more, less = {0: (1, 1), 1: (1, 0), -1: (0, 1)}[length - other]
        chosen = np.array(chosen)
        q_codes = code_points([queries[i] for i in chosen], other)
        q_counts = letter_counts(q_codes)
        q_marks = sketches(q_counts)
        step = max(1, FRONTIER // length)
        for row, node in leaves_near(tree, q_counts, more, less):
            sizes = tree.high[node] - tree.low[node]
            ends = np.cumsum(sizes)
            start = 0
            while start < len(row):  # some leaves at a time
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + FRONTIER, "right")))
                n, low = sizes[start:stop], tree.low[node[start:stop]]
                place = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)  # in the order of the leaves
                close = np.flatnonzero(np.bitwise_count(marks[place] ^ np.repeat(q_marks[row[start:stop]], n)) <= more + less)
                p, q = tree.order[place[close]], row[start + np.searchsorted(np.cumsum(n), close, "right")]
                for at in range(0, len(close), step):
                    some_p, some_q = p[at:at + step], q[at:at + step]
                    near = one_edit(codes[some_p], q_codes[some_q])
                    pairs_p, pairs_q = some_p[near], chosen[some_q[near]]
                    np.add.at(found, pairs_q, 1)
                    np.minimum.at(best, pairs_q, rank[pairs_p])
                start = stop
    return found, np.where(best < len(points), rank_order[np.minimum(best, len(points) - 1)], -1)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 7, least_times: int = 2, slip: int | None = 31) -> DataFrame:
    """`word` and `n` of all words of at least `least_chars` letters and `least_times` occurrences.

    With `slip`, an occurrence loses one letter where slip divides crc32 of `key:word`; the letter's
    place is that number modulo the length. A null key counts as the empty text there.
    """
    # A shorter run can't reach `least_chars`, so the pattern leaves those out at once.
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"),
        F.explode(F.regexp_extract_all(text_of(text), F.lit(f"{LETTERS}{{{least_chars},}}"), F.lit(0))).alias("run"))
    word = F.when(F.col("run").rlike("[A-Z]"), ascii_lower(F.col("run"))).otherwise(F.col("run"))
    runs = runs.select("key", word.alias("word"))
    if slip:
        hit = F.crc32(F.concat("key", F.lit(":"), "word").cast("binary"))
        at = (F.col("hit") % F.length("word")).cast("int")
        shorter = F.concat(F.expr("substring(word, 1, cast(hit % length(word) as int))"), F.col("word").substr(at + 2, F.length("word")))
        runs = runs.withColumn("hit", hit).select(F.when(F.col("hit") % slip == 0, shorter).otherwise(F.col("word")).alias("word"))
        runs = runs.filter(F.length("word") >= least_chars)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_times)


def upper_trees(words: DataFrame, total: int, leaf_words: int) -> dict[int, Tree]:
    """A tree per length whose leaves hold about `leaf_words` words, shaped by at most SAMPLE of them."""
    if total <= leaf_words:
        return {}
    part = F.pmod(F.xxhash64("word"), F.lit(max(1, 2 * total // SAMPLE))) == 0  # half of SAMPLE or less, as a rule
    some = words.select("word").filter(part & (F.length("word") <= SAMPLED_CHARS)).limit(SAMPLE).collect()
    by_length = defaultdict(list)
    for r in some:
        by_length[len(r["word"])].append(r["word"])
    # Leaves are never smaller than 16 words of the sample, so they tell halves apart.
    leaf = max(16, leaf_words * len(some) // total)
    return {n: build_tree(letter_counts(code_points(w, n)), leaf) for n, w in by_length.items() if len(w) > leaf}


ROUTED = "length int, leaf int, is_point boolean, word string, n long"


def _route(batches: Iterator[pa.RecordBatch], trees: dict[int, Tree]) -> Iterator[pa.RecordBatch]:
    """Every word as a point of its own leaf and as a query of all leaves near it, of three lengths."""
    for batch in batches:
        words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        sizes = np.array([len(w) for w in words])
        for length in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == length)
            counts = letter_counts(code_points([words[i] for i in mine], length))
            for target, more, less in ((length, 1, 1), (length + 1, 1, 0), (length - 1, 0, 1)):
                tree = trees.get(target)
                near = leaves_near(tree, counts, more, less) if tree else [(np.arange(len(mine)), np.zeros(len(mine), np.int64))]
                parts = [(r, leaf, False) for r, leaf in near]
                if target == length:
                    parts.append((np.arange(len(mine)), leaf_of(tree, counts) if tree else np.zeros(len(mine), np.int64), True))
                for rows, leaf, is_point in parts:
                    at = mine[rows]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), target), pa.int32()), pa.array(leaf, pa.int32()), pa.array(np.full(len(at), is_point)),
                        batch.column("word").take(pa.array(at)), pa.array(n[at])], names=["length", "leaf", "is_point", "word", "n"])


def near_words(words: DataFrame, leaf_words: int = LEAF_WORDS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """For each word of `words` (word, n; distinct) with a near one: `n_near`, `best_n`, `best_word`.

    Each ordered pair of words meets in one place, the leaf of the one as a point. A leaf with more
    words or letters than one task should hold, such as one of many anagrams, is dealt into blocks of
    points times blocks of queries; nothing is left out. Each cell answers with one row a query.
    """
    trees = upper_trees(words, words.count(), leaf_words)
    routed = settle(words.select("word", "n").mapInArrow(lambda batches: _route(batches, trees), ROUTED), "spelling-routes")
    blocks = lambda of: F.greatest(
        F.lit(1), F.ceil(F.count_if(of) / leaf_words), F.ceil(F.coalesce(F.sum(F.when(of, F.length("word"))), F.lit(0)) / leaf_chars)).cast("int")
    is_point = F.col("is_point")
    grid = routed.groupBy("length", "leaf").agg(
        blocks(is_point).alias("point_blocks"), blocks(~is_point).alias("query_blocks"), F.count_if(is_point).alias("points")).filter("points > 0").drop("points")
    hashed = F.xxhash64("word")
    own = F.when(is_point, F.pmod(hashed, "point_blocks")).otherwise(F.pmod(hashed, "query_blocks")).cast("int")
    others = F.sequence(F.lit(0), F.when(is_point, F.col("query_blocks")).otherwise(F.col("point_blocks")) - 1)
    dealt = (
        routed.join(grid, ["length", "leaf"]).withColumn("own", own).withColumn("other", F.explode(others))
        .select("length", "leaf", F.when(is_point, F.col("own")).otherwise(F.col("other")).alias("i"),
                F.when(is_point, F.col("other")).otherwise(F.col("own")).alias("j"), "is_point", "word", "n")
    )

    def answer(rows: pa.Table) -> pa.Table:
        side = rows.column("is_point")
        points, queries = rows.filter(side), rows.filter(pc.invert(side)).column("word").to_pylist()
        words, n = points.column("word").to_pylist(), points.column("n").to_numpy()
        found, best = search(words, n, queries) if words and queries else (np.zeros(len(queries), np.int64), None)
        hit = np.flatnonzero(found)
        return pa.table([
            pa.array([queries[i] for i in hit], pa.string()), pa.array(found[hit], pa.int64()),
            pa.array([n[best[i]] for i in hit], pa.int64()), pa.array([words[best[i]] for i in hit], pa.string())], names=["word", "n_near", "best_n", "best_word"])

    cells = dealt.groupBy("length", "leaf", "i", "j").applyInArrow(answer, "word string, n_near long, best_n long, best_word string")
    first = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best_word").alias("word")))
    return cells.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("best")).select(
        "word", "n_near", (-F.col("best.minus")).alias("best_n"), F.col("best.word").alias("best_word"))


def roots_of(forms: DataFrame) -> DataFrame:
    """`word` and `root`, the last of the forms reached from it, for `forms` (word, form).

    Only words that are a form and have one themselves are followed, by doubling; a form is at least
    `ratio` times as frequent, so chains are as short as the logarithm of the counts.
    """
    inner = settle(forms.join(forms.select(F.col("form").alias("word")).distinct(), "word", "left_semi").select("word", F.col("form").alias("root")), "spelling-inner")
    while True:
        step = inner.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = settle(inner.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-inner")
        inner = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    known = inner.select(F.col("word").alias("form"), F.col("root").alias("last"))
    return forms.join(known, "form", "left").select("word", F.coalesce("last", "form").alias("root"))


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """`words` (word, n; distinct) with `form`, `root`, `n_near` and `form_n`.

    A word's form is its most frequent near word (ties: smallest in code-point order) if that occurs
    at least `ratio` times as often, else null; its root is the last form in the chain, or itself. No
    words give no rows.
    """
    words = settle(words, "spelling-words")
    near = near_words(words)
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = settle(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("best_word")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = roots_of(found.filter("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int | None = None) -> DataFrame:
    """One row per word of all whole texts: word, form, root, n, n_near, form_n (see `group_variants`).

    Words are runs of Latin letters, A-Z lower-cased, of at least seven letters and two occurrences.
    Null and empty texts have no words, repeated rows count each, very long texts and words are read
    whole, an empty table gives no rows, and other columns play no part.
    """
    return group_variants(vocabulary(docs, key, text, slip=slip)).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_spelling")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return spelling_variants(table(spark, sf, "documents"), slip=31)
