"""Ranked lexical search: item vocabulary tiles times document impact tiles, exact in float64.

The items are the query set; their terms alone form the vocabulary. Documents become sparse vectors
of it once. A tile of documents is laid out densely per tile of the vocabulary and multiplied by the
items' weights with BLAS. All factors are whole numbers and a tile is as wide as keeps every partial
sum below 2^53, so products and sums are exact; tiles are added as 64-bit integers.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evenhand.llm.registry import query, table, text_of
from evenhand.workspace import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package

#: Terms: digits, letters and everything outside ASCII; A-Z become lower case, the rest parts terms.
TERM_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
EXACT = 1 << 53
MOST_IMPACT = 10**6  # (10^9 tf) div (1000 tf + 8 m) stays below
VOCABULARY_TILE, DOCUMENT_TILE = 1024, 1024
ITEMS_PER_BLOCK, ITEM_BYTES_PER_BLOCK = 2048, 4 << 20
MERGE_PARTS = 32


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


@dataclass
class Items:
    """A block of items: the place of every term, and each item's terms as places."""

    keys: pa.Array
    places: dict[bytes, int]
    terms: list[np.ndarray]


def read_items(block: DataFrame, key: str) -> Items:
    """Terms shared by most items stand first, so that the other tiles concern few items each."""
    rows = block.select(key, F.col("item_text").cast("binary").alias("item_text")).toArrow()
    found = [list(dict.fromkeys(terms_of(t.as_py()))) for t in rows.column("item_text")]
    shared = Counter(t for terms in found for t in terms)
    first = dict.fromkeys(t for terms in found for t in terms)
    places = {t: i for i, t in enumerate(sorted(first, key=lambda t: -shared[t]))}
    return Items(rows.column(key).combine_chunks(), places, [np.array(sorted(places[t] for t in terms), np.int64) for terms in found])


def vectors(docs: DataFrame, key: str, places: dict[bytes, int]) -> DataFrame:
    """Per document with a term: key, `n` (all its terms, with repeats), places and counts of known terms."""
    prepared = docs.select(F.col(key).alias("key"), text_of().cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, n, at, times = [], [], [], []
            for i, text in enumerate(batch.column("body")):
                terms = terms_of(text.as_py())
                if terms:
                    known = [(places[t], c) for t, c in Counter(terms).items() if t in places]
                    rows.append(i)
                    n.append(len(terms))
                    at.append([p for p, _ in known])
                    times.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))],
                names=["key", "n", "places", "times"])

    return prepared.mapInArrow(run, f"key {dict(prepared.dtypes)['key']}, n long, places array<int>, times array<long>")


def weights(n_docs: int, holders: dict[int, int], size: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) per place; 0 where no document holds the term."""
    out = np.zeros(size, np.int64)
    for place, df in holders.items():
        out[place] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    return out


@dataclass
class Tile:
    """Places `low` to `high` of the vocabulary, and the weights of the items that have any of them."""

    low: int
    high: int
    items: np.ndarray
    weights: np.ndarray


def vocabulary_tiles(items: Items, weight: np.ndarray) -> list[Tile]:
    width = max(1, min(VOCABULARY_TILE, (EXACT - 1) // (MOST_IMPACT * max(1, int(weight.max(initial=0))))))
    tiles = []
    for low in range(0, len(weight), width):
        high = min(low + width, len(weight))
        inside = [(i, t[np.searchsorted(t, low):np.searchsorted(t, high)]) for i, t in enumerate(items.terms)]
        inside = [(i, t) for i, t in inside if len(t)]
        dense = np.zeros((len(inside), high - low))
        for row, (_, t) in enumerate(inside):
            dense[row, t - low] = weight[t]
        tiles.append(Tile(low, high, np.array([i for i, _ in inside], np.int64), dense))
    return tiles


def score_tile(tiles: list[Tile], n_items: int, sizes: np.ndarray, doc: np.ndarray, place: np.ndarray, times: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """Scores (items x documents, int64) of a tile of documents, given as (doc, place, times) triples."""
    m = 10 + (90 * sizes * total_docs) // total_terms
    impact = (1_000_000_000 * times) // (1000 * times + 8 * m[doc])
    scores = np.zeros((n_items, len(sizes)), np.int64)
    order = np.argsort(place, kind="stable")
    doc, place, impact = doc[order], place[order], impact[order]
    for tile in tiles:
        a, b = np.searchsorted(place, [tile.low, tile.high])
        if a == b:
            continue
        held, column = np.unique(place[a:b], return_inverse=True)  # columns that occur in these documents
        dense = np.zeros((len(held), len(sizes)))
        dense[column, doc[a:b]] = impact[a:b]
        scores[tile.items] += (tile.weights[:, held - tile.low] @ dense).astype(np.int64)
    return scores


class Best:
    """The `k` best documents of every item seen so far: higher score first, then smaller key."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.kept: list[list[tuple]] = [[] for _ in range(n_items)]
        self.bar = np.ones(n_items, np.int64)  # a score below can't enter; equal ones may, by their key

    def add(self, scores: np.ndarray, keys: list) -> None:
        bar = self.bar.copy()
        if scores.shape[1] > self.k:
            bar = np.maximum(bar, np.partition(scores, -self.k, axis=1)[:, -self.k])
        item, doc = np.nonzero(scores >= bar[:, None])
        value = scores[item, doc]
        cuts = np.searchsorted(item, np.arange(len(scores) + 1))
        for i in np.unique(item).tolist():
            a, b = cuts[i], cuts[i + 1]
            new = [(-s, keys[d] is not None, keys[d]) for s, d in zip(value[a:b].tolist(), doc[a:b].tolist())]
            self.kept[i] = sorted(self.kept[i] + new, key=lambda x: x[:2] + ((x[2],) if x[1] else ()))[:self.k]
            if len(self.kept[i]) == self.k:
                self.bar[i] = max(1, -self.kept[i][-1][0])


def _score(batches: Iterator[pa.RecordBatch], items: Items, weight: np.ndarray, k: int, total_docs: int, total_terms: int) -> Iterator[pa.RecordBatch]:
    tiles, best, kind = vocabulary_tiles(items, weight), Best(len(items.terms), k), None
    for batch in batches:
        kind = batch.schema.field("key").type
        for start in range(0, batch.num_rows, DOCUMENT_TILE):
            part = batch.slice(start, DOCUMENT_TILE)
            places, times = part.column("places"), part.column("times")
            doc = np.repeat(np.arange(part.num_rows), places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            scores = score_tile(tiles, len(items.terms), part.column("n").to_numpy(), doc, places.flatten().to_numpy(), times.flatten().to_numpy(), total_docs, total_terms)
            best.add(scores, part.column("key").to_pylist())
    rows = [(i, key, -minus) for i, kept in enumerate(best.kept) for minus, _, key in kept]
    if rows:
        item, key, score = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), items.keys.take(pa.array(item, pa.int32())), pa.array(key, kind), pa.array(score, pa.int64())],
            names=["item", "item_key", "key", "score"])


def search_block(docs: DataFrame, block: DataFrame, key: str, item_key: str, k: int) -> DataFrame:
    items = read_items(block, item_key)
    vectored = settle(vectors(docs, key, items.places), "lexical-vectors")
    total = vectored.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    # At most one row per term of the block, whose bytes are bounded.
    holders = {r["place"]: r["count"] for r in vectored.select(F.explode("places").alias("place")).groupBy("place").count().collect()}
    weight = weights(total["docs"], holders, len(items.places))
    kinds = dict(docs.dtypes)[key], dict(block.dtypes)[item_key]
    found = vectored.filter(F.size("places") > 0).mapInArrow(
        lambda batches: _score(batches, items, weight, k, total["docs"], total["terms"]), f"item int, item_key {kinds[1]}, key {kinds[0]}, score long")
    # First among parts of each item's candidates, then among what they leave.
    order = [F.desc("score"), F.asc("key")]
    part = Window.partitionBy("item", F.pmod(F.xxhash64("key", "score"), F.lit(MERGE_PARTS))).orderBy(*order)
    few = found.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)
    return few.select(F.col("item_key").alias(item_key), "rank", F.col("key").alias(key), "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """The `k` best documents of every item with a score above 0: item_key, rank, key, score.

    Each document and item is read whole; statistics cover all documents with a term. Items that are
    equal in identifier and text count once. They are taken in blocks bounded in number and bytes, and
    every block meets all documents. Null texts have no terms: such documents are not counted, such
    items have no rows. Of equal scores the smaller key comes first, a null key before all others;
    repeated documents are ranked each. Empty tables give no rows; other columns play no part.
    """
    asked = items.select(F.col(item_key), text_of(text).alias("item_text")).distinct()
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0)).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // ITEMS_PER_BLOCK), -(-size["bytes"] // ITEM_BYTES_PER_BLOCK))
    docs = docs.select(key, F.col(text).alias("text"))
    found = None
    for b in range(blocks):
        block = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(item_key, "item_text"), F.lit(blocks)) == b)
        part = search_block(docs, block, key, item_key, k)
        found = part if found is None else found.unionByName(part)
    return found


TERMS_SQL = r"unnest(regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"


@query("op13_lexical_search", f"""
WITH said AS (SELECT r, doc_id, {TERMS_SQL.format("coalesce(text, '')")} AS term FROM (SELECT row_number() OVER () AS r, * FROM documents)),
sizes AS (SELECT r, doc_id, count(*) AS n FROM said GROUP BY ALL),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (SELECT DISTINCT item_id, text, {TERMS_SQL.format("coalesce(text, '')")} AS term FROM benchmark),
held AS (SELECT r, term, count(*) AS tf FROM said WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY term),
impact AS (SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)) AS v FROM held JOIN sizes USING (r), total),
scored AS (SELECT item_id, text, doc_id, r, sum(w * v)::BIGINT AS score FROM asked JOIN w USING (term) JOIN impact USING (term) GROUP BY ALL HAVING sum(w * v) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST))::INT AS rank, doc_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) <= 10
""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
