"""SimHash near-duplicates: fingerprints, and a self-join of their binary trie."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from evenhand.llm.components import components
from evenhand.llm.registry import query, table, text_of
from evenhand.workspace import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
PIECE = 1 << 17  # shingles hashed at once
STEP_BITS = 1
LEAF_ROWS = 1 << 17
FRONTIER = 1 << 19  # node pairs walked at once


def simhash(text: bytes, shingle: int, seed: int) -> int:
    """64 bits; a bit is set if it is set in over half the shingles' hashes. No words: 0."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles, count = iter([b" ".join(words)]), 1
    else:
        shingles, count = map(b" ".join, zip(*[words[k:] for k in range(shingle)])), len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, count, PIECE):
        here = min(PIECE, count - start)
        hashes = np.fromiter(map(xxh64_intdigest, islice(shingles, here), repeat(seed)), np.uint64, here)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(here, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count, bitorder="little").tobytes(), "little", signed=True)


def with_fingerprints(docs: DataFrame, text: Column, keep: list[str], shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """The columns `keep` of `docs` and one fingerprint (long) per seed: fp_0, fp_1, …"""
    prepared = docs.select(*keep, text.cast("binary").alias("simhash_text"))
    names = [f"fp_{k}" for k in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("simhash_text")
            columns = [batch.column(c) for c in keep]
            for seed in seeds:
                columns.append(pa.array([simhash(t.as_py(), shingle, seed) for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in prepared.dtypes if c in keep], *[f"{n} long" for n in names]])
    return prepared.mapInArrow(run, schema)


def joint_walk(a: np.ndarray, b: np.ndarray, depth: int, spent: int, budget: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of `a` and `b` (sorted, distinct uint64) at most `budget` bits apart.

    Both tries are walked together from `depth`: a frontier holds pairs of nodes, as ranges of the
    sorted values, with the bits in which their paths differ. A pair goes once that exceeds the
    budget; when few values are left under a pair they are compared directly.
    """
    ones = [_ones_before(x) for x in ((a,) if same else (a, b))]
    ones_a, ones_b = ones[0], ones[-1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    start = tuple(np.array([x]) for x in (0, len(a), 0, len(b), spent))
    waiting = [(depth, start)]
    while waiting:
        bit, nodes = waiting.pop()
        if len(nodes[0]) > FRONTIER:  # go on with one half; the other waits
            half = len(nodes[0]) // 2
            waiting += [(bit, tuple(x[half:] for x in nodes)), (bit, tuple(x[:half] for x in nodes))]
            continue
        al, ah, bl, bh, bits = nodes
        few = ((ah - al) * (bh - bl) <= 16) | (bit == 64)
        if few.any():
            i0, j0, wide, high = al[few], bl[few], (bh - bl)[few], (ah - al)[few]
            n = wide * high
            which = np.repeat(np.arange(len(n)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = i0[which] + at // wide[which], j0[which] + at % wide[which]
            near = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                near &= i < j
            found.append((i[near], j[near]))
            al, ah, bl, bh, bits = (x[~few] for x in nodes)
        if not len(al):
            continue
        am, bm = ah - (ones_a(bit)[ah] - ones_a(bit)[al]), bh - (ones_b(bit)[bh] - ones_b(bit)[bl])
        mirrored = (al == bl) & (ah == bh) & same
        parts = [(al, am, bl, bm, bits), (am, ah, bm, bh, bits), (al, am, bm, bh, bits + 1),
                 (am, np.where(mirrored, am, ah), bl, bm, bits + 1)]
        al, ah, bl, bh, bits = (np.concatenate(x) for x in zip(*parts))
        alive = (ah > al) & (bh > bl) & (bits <= budget)
        waiting.append((bit + 1, tuple(x[alive] for x in (al, ah, bl, bh, bits))))
    if not found:
        return np.array([], np.int64), np.array([], np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _ones_before(values: np.ndarray):
    """For a bit (0 is the highest): how many of the first n values have it set, for every n."""
    kept: dict[int, np.ndarray] = {}

    def at(bit: int) -> np.ndarray:
        if bit not in kept:
            set_bits = (values >> np.uint64(63 - bit) & np.uint64(1)).astype(np.int32)
            kept[bit] = np.concatenate([[0], np.cumsum(set_bits, dtype=np.int32)])
        return kept[bit]

    return at


def _prefix(depth: int) -> Column:
    # The root's prefix is computed, too: a constant would turn the joins on it into products.
    return F.shiftrightunsigned("fp", 64 - depth) if depth else F.col("fp").bitwiseAND(F.lit(0).cast("long"))


def node_pairs(fingerprints: DataFrame, budget: int, leaf_rows: int) -> list[tuple[int, DataFrame]]:
    """Pairs of trie nodes that may hold near values, by depth, each node of at most `leaf_rows` values.

    Starts from the pair (root, root). Each round replaces the pairs that still have a large node by
    the pairs of their children, STEP_BITS deeper, whose differing bits stay within the budget. Only
    node counts are handled here.
    """
    spark = fingerprints.sparkSession
    pairs = spark.createDataFrame([(0, 0, 0)], "a long, b long, spent int")
    out: list[tuple[int, DataFrame]] = []
    for depth in range(0, 65, STEP_BITS):
        nodes = fingerprints.groupBy(_prefix(depth).alias("node")).agg(F.count("*").alias("n"))
        counted = settle(
            pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b"), "trie-pairs")
        large = (F.col("n_a") > leaf_rows) | (F.col("n_b") > leaf_rows)
        ready, wide = counted.filter(~large), counted.filter(large)
        state = counted.agg(F.count_if(~large).alias("ready"), F.count_if(large).alias("wide")).first()
        if state["ready"]:
            out.append((depth, ready.select("a", "b", "spent")))
        if not state["wide"] or depth == 64:
            break
        below = fingerprints.select(_prefix(depth + STEP_BITS).alias("child")).distinct()
        parent = F.shiftrightunsigned("child", STEP_BITS)
        left = below.select(parent.alias("a"), F.col("child").alias("child_a"))
        right = below.select(parent.alias("b"), F.col("child").alias("child_b"))
        spent = F.col("spent") + F.bit_count(F.col("child_a").bitwiseXOR(F.col("child_b")).bitwiseAND(F.lit((1 << STEP_BITS) - 1)))
        pairs = settle(
            wide.join(left, "a").join(right, "b").withColumn("spent", spent.cast("int"))
            .filter((F.col("spent") <= budget) & ((F.col("a") != F.col("b")) | (F.col("child_a") <= F.col("child_b"))))
            .select(F.col("child_a").alias("a"), F.col("child_b").alias("b"), "spent"), "trie-children")
    return out


def trie_links(fingerprints: DataFrame, budget: int = 2, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Links (a, b) between the distinct values `fp` that keep all components at `budget` bits.

    The upper trie is expanded as tables of node counts (`node_pairs`), so a crowded prefix is split
    like any other; each pair of small nodes is then walked by one task. A task that finds more links
    than it has values returns a spanning forest of them, which connects the same values.
    """
    parts = []
    for depth, pairs in node_pairs(fingerprints, budget, leaf_rows):
        pairs = pairs.withColumn("pair", F.xxhash64("a", "b", F.lit(depth)))
        placed = fingerprints.select("fp", _prefix(depth).alias("node"))
        sides = pairs.select("a", "b", "spent", F.explode(
            F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node"))))
            .otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("node")), F.struct(F.lit(1).alias("side"), F.col("b").alias("node"))))
        ).alias("at")).select("a", "b", "spent", "at.side", "at.node")
        parts.append(placed.join(sides, "node").select("a", "b", F.lit(depth).alias("depth"), "spent", "side", "fp"))
    if not parts:
        return fingerprints.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    routed = parts[0]
    for more in parts[1:]:
        routed = routed.unionByName(more)

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        values = [np.sort(rows.loc[rows["side"] == s, "fp"].to_numpy(np.int64).view(np.uint64)) for s in (0, 1)]
        same = rows["a"].iat[0] == rows["b"].iat[0]
        a, b = values[0], values[0] if same else values[1]
        i, j = joint_walk(a, b, int(rows["depth"].iat[0]), int(rows["spent"].iat[0]), budget, same)
        if len(i) > len(rows):
            i, j = _forest(i, j + (0 if same else len(a)))
            both = a if same else np.concatenate([a, b])
            return pd.DataFrame({"a": both[i].view(np.int64), "b": both[j].view(np.int64)})
        return pd.DataFrame({"a": a[i].view(np.int64), "b": b[j].view(np.int64)})

    return routed.groupBy("a", "b", "depth").applyInPandas(walk, "a long, b long")


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while above.get(x, x) != x:
            above[x] = above.get(above[x], above[x])
            x = above[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
        p, q = top(x), top(y)
        if p != q:
            above[max(p, q)] = min(p, q)
            kept.append(k)
    return i[kept], j[kept]


def components_of(marked: DataFrame, key: str, budget: int = 2) -> DataFrame:
    """`fp` and `component_id`, the smallest key reachable over links of at most `budget` bits."""
    classes = settle(marked.groupBy(F.col("fp_0").alias("fp")).agg(F.min(key).alias("least")), "simhash-classes")
    links = settle(trie_links(classes.select("fp"), budget), "simhash-links")
    roots = components(links, "simhash-stars").withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = 2, shingle: int = 3) -> DataFrame:
    """One row per row of `docs`: key, `fingerprint` (16 hex digits), `component_id`.

    Letters A-Z are lower-cased, words are runs outside ASCII white space, shingles are counted with
    repeats; a text of fewer words is one shingle, a text without words (null, empty) has fingerprint
    zero and links like any other. Copies share a fingerprint and are joined once as a class. Null
    keys are never the smallest unless alone. An empty table gives no rows; other columns play no part.
    """
    marked = settle(with_fingerprints(docs, text_of(text), [key], shingle), "simhash-fingerprints")
    found = components_of(marked, key, budget)
    return marked.withColumnRenamed("fp_0", "fp").join(found, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_simhash")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))
