"""Resharding by minimum-cost flow: the fewest bytes move from old shards into new capacities."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evenhand.llm.registry import query, table, text_of
from evenhand.workspace import fresh_path, settle

ROWS_PER_BLOCK, BYTES_PER_BLOCK = 50_000, 64 << 20  # a block of an old shard holds a fraction of these


def move_cost(old: int, new: int) -> int:
    return int(old != new)


def min_cost_transfers(old: Mapping[int, int], capacities: Sequence[int], cost=move_cost) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one, at the least total of bytes times cost.

    Shards are few (a parameter, not data). Successive shortest paths over the bipartite graph:
    each round sends as much as fits along the cheapest path with room, undoing earlier transfers
    where that is cheaper.
    """
    if sum(old.values()) > sum(capacities):
        raise ValueError("capacities are smaller than the data")
    flow: dict[tuple[int, int], int] = defaultdict(int)
    supply, room = dict(old), dict(enumerate(capacities))
    while any(supply.values()):
        dist = {("old", i): 0 for i, s in supply.items() if s}
        came: dict[tuple[str, int], tuple[str, int]] = {}
        changed = True
        while changed:
            changed = False
            for i in old:
                for j in room:
                    there, c = ("old", i), cost(i, j)
                    here = ("new", j)
                    if there in dist and dist[there] + c < dist.get(here, float("inf")):
                        dist[here], came[here], changed = dist[there] + c, there, True
                    if flow[i, j] and here in dist and dist[here] - c < dist.get(there, float("inf")):
                        dist[there], came[there], changed = dist[here] - c, here, True
        end = min((("new", j) for j in room if room[j] and ("new", j) in dist), key=lambda n: (dist[n], n[1]))
        path = [end]
        while path[-1] in came:
            path.append(came[path[-1]])
        path.reverse()
        steps = list(zip(path, path[1:]))
        back = [flow[b[1], a[1]] for a, b in steps if a[0] == "new"]
        sent = min([supply[path[0][1]], room[end[1]], *back])
        for a, b in steps:
            if a[0] == "old":
                flow[a[1], b[1]] += sent
            else:
                flow[b[1], a[1]] -= sent
        supply[path[0][1]] -= sent
        room[end[1]] -= sent
    return {pair: n for pair, n in sorted(flow.items()) if n}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


@dataclass
class Resharding:
    """What `reshard` found.

    `rows`: the input with `old_shard`, `old_slot`, `shard` and `slot`; `transfers`: bytes planned per
    pair of shards; `affected`: shards that keep or get rows and whose rows change; `emptied`: old
    shards left without rows.
    """

    rows: DataFrame
    transfers: dict[tuple[int, int], int]
    affected: list[int]
    emptied: list[int]


def reshard(
    docs: DataFrame, old_shard: Column, size: Column, capacities: Sequence[int] | int, key: str = "doc_id", cost=move_cost, spread: Sequence[str] = (),
) -> Resharding:
    """Assign every row of `docs` to a new shard so that the fewest bytes leave their old one.

    `old_shard` is a whole number from a bounded range, `size` the bytes of a row; `capacities` are
    bytes per new shard, or a number of shards to make equal. Old shards are laid out in blocks by a
    hash of the key, the size and the columns `spread` (which keep many rows of one key, such as null,
    apart); their byte ranges are cut by the planned transfers, and a row goes where its
    first byte lies, so a shard misses its capacity by less than one row per transfer. Slots count
    from 0 in each shard without gaps. Only sums per shard reach the driver; running sums are taken
    over blocks, and within a block of at most about ROWS_PER_BLOCK rows and BYTES_PER_BLOCK bytes. A null key hashes like any other;
    rows equal in all of these are interchangeable. An old shard's order doesn't depend on the
    capacities, so a shard that is not affected keeps its slots. An empty table gives no rows. Columns
    named old_shard, old_slot, shard or slot are replaced.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in ("old_shard", "old_slot", "shard", "slot")]
    laid = docs.withColumns({"old_shard": old_shard.cast("int"), "at": F.struct(size.cast("long").alias("size"), F.xxhash64(key, size.cast("long"), *spread).alias("hash"))}).select(*rest, "old_shard", "at")
    narrow = laid.select("old_shard", F.col(key), "at")
    totals = {r["old_shard"]: (r["bytes"], r["rows"]) for r in narrow.groupBy("old_shard").agg(F.sum("at.size").alias("bytes"), F.count("*").alias("rows")).collect()}
    total_bytes, total_rows = (sum(t[k] for t in totals.values()) for k in (0, 1))
    if isinstance(capacities, int):
        capacities = equal_capacities(total_bytes, capacities)
    transfers = min_cost_transfers({i: b for i, (b, _) in sorted(totals.items())}, capacities, cost)

    blocks = max(1, -(-total_rows // ROWS_PER_BLOCK), -(-total_bytes // BYTES_PER_BLOCK))
    block = F.pmod("at.hash", F.lit(blocks))
    starts = W.partitionBy("old_shard").orderBy("block")
    sums = settle(
        narrow.groupBy("old_shard", block.alias("block")).agg(F.sum("at.size").alias("bytes"), F.count("*").alias("rows"))
        .select("old_shard", "block", (F.sum("bytes").over(starts) - F.col("bytes")).alias("bytes_before"), (F.sum("rows").over(starts) - F.col("rows")).alias("rows_before")),
        "shard-blocks",
    )
    inside = W.partitionBy("old_shard", "block").orderBy("at.hash", key, "at.size").rowsBetween(W.unboundedPreceding, W.currentRow)
    first_byte = F.col("bytes_before") + F.sum("at.size").over(inside) - F.col("at.size")
    rank = F.col("rows_before") + F.count("*").over(inside) - 1
    target = F.lit(None).cast("int")
    for i in sorted(totals, reverse=True):
        low = 0
        lane = F.lit(None).cast("int")
        cuts = []
        for j in sorted((j for k, j in transfers if k == i), key=lambda j: (cost(i, j), j)):
            low += transfers[i, j]
            cuts.append((low, j))
        for high, j in reversed(cuts):
            lane = F.when(F.col("first_byte") < high, j).otherwise(lane)
        target = F.when(F.col("old_shard") == i, lane).otherwise(target)

    def assigned(df: DataFrame) -> DataFrame:
        return (
            df.withColumn("block", block).join(sums, ["old_shard", "block"])
            .withColumns({"first_byte": first_byte, "rank": rank}).withColumn("shard", target.cast("int"))
            .drop("block", "bytes_before", "rows_before", "first_byte", "at")
        )

    # One row per transfer: where each run of ranks starts in its new shard.
    runs = assigned(narrow).groupBy("old_shard", "shard").agg(F.min("rank").alias("first"), F.count("*").alias("rows")).collect()
    base, filled = [], defaultdict(int)
    for r in sorted(runs, key=lambda r: (r["old_shard"], r["shard"])):
        base.append((r["old_shard"], r["shard"], filled[r["shard"]] - r["first"]))
        filled[r["shard"]] += r["rows"]
    shift = F.lit(None).cast("long")
    for i, j, by in base:
        shift = F.when((F.col("old_shard") == i) & (F.col("shard") == j), F.lit(by)).otherwise(shift)
    rows = assigned(laid).withColumn("slot", (F.col("rank") + shift).cast("long")).withColumnRenamed("rank", "old_slot")
    moved, left = {x for i, j, _ in base if i != j for x in (i, j)}, {j for _, j, _ in base}
    return Resharding(rows, transfers, sorted(moved & left), sorted({i for i, _, _ in base} - left))


def write_layout(rows: DataFrame, path: str) -> None:
    """Write all shards of `rows` under `path`, one folder a shard."""
    rows.write.partitionBy("shard").parquet(path)


def rewrite_affected(done: Resharding, path: str, columns: Sequence[str] | None = None) -> None:
    """Bring the shards under `path` from the old layout to the new one, rewriting affected ones only.

    `path` has a folder per shard, as `write_layout` makes them. New files of the affected shards are
    all written before they take the place of the old ones; then the folders of emptied shards go.
    The other shards keep their files. `columns` are those of the files (default: all of the rows).
    """
    rows = done.rows.select(*(columns or done.rows.columns)).filter(F.col("shard").isin(done.affected))
    if done.affected:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    spark = done.rows.sparkSession
    for shard in done.emptied:  # a number of shards, not of rows
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shard={shard}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


SHARDS = 16


def source_shard() -> Column:
    """The old layout: documents lie with their source, sources are dealt by name."""
    return (F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % SHARDS).cast("int")


def text_bytes() -> Column:
    return F.octet_length(text_of()) + 1


@query("op2_reshard")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id", text_bytes().cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), source_shard().alias("home"))
    done = reshard(settle(docs, "shard-sizes"), F.col("home"), F.col("size"), SHARDS, spread=["text_crc32"])
    path, kept = fresh_path(spark, "shards"), ["doc_id", "size", "text_crc32", "old_shard"]
    write_layout(done.rows.select(*kept, F.col("old_shard").alias("shard"), F.col("old_slot").alias("slot")), path)
    rewrite_affected(done, path, [*kept, "shard", "slot"])
    rows = spark.read.parquet(path)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
