"""Resharding by minimum-cost flow: the fewest bytes move from the old shards to new capacities.

Rows fall into blocks (old shard, hash range of the text), so equal texts of an old shard share a block. Block
sizes are one aggregation; the driver sees shards x blocks_per_shard numbers, a bound that does not grow with the
data. A block of more than half a new shard is divided by further bits of the text hash, so that only a text that
is so large by itself stays so. Old shard sizes and new capacities make a small transport problem (moving costs a
byte's price, staying nothing), solved by successive shortest paths; whole blocks then carry the flow, largest
first. Rows follow their block.

Slots are gapless without a single-task sort: a block is dealt over hash lanes of about ROWS_PER_LANE rows, so a
text with a third of the rows spreads over many tasks, rows are numbered in their lane, and a table of one row for
each lane says where it begins. `rewrite` writes only the shards that lose or gain rows, to a new folder.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh

OLD_SHARDS, NEW_SHARDS, BLOCKS_PER_SHARD = 16, 24, 512
ROWS_PER_LANE = 1 << 18
#: Bytes a row takes besides its text.
ROW_BYTES = 8
#: Lanes up to this number are broadcast with their first slot; beyond it they meet the rows in a shuffle join.
BROADCAST_LANES = 500_000


def capacities(total: int, shards: int) -> list[int]:
    """Equal shares of the bytes, one byte apart at most."""
    return [total // shards + (i < total % shards) for i in range(shards)]


def level_capacities(blocks: dict[tuple, int], shards: int) -> list[int]:
    """As `capacities`, but a block of more than an equal share has a shard to itself, its own old one if there
    is one, and the others share the rest evenly."""
    fixed, rest = {}, sum(blocks.values())
    for key, size in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
        free = [j for j in range(shards) if j not in fixed]
        if len(free) == 1 or size * len(free) <= rest:
            break
        fixed[key[0] if key[0] in free else free[-1]] = size
        rest -= size
    even = iter(capacities(rest, shards - len(fixed)))
    return [fixed[j] if j in fixed else next(even) for j in range(shards)]


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes from each old shard to each new one at the least total cost(old, new); capacities must suffice.

    Successive shortest paths with potentials over the bipartite graph of shards; few shards, so a small graph."""
    n, m = len(supply), len(capacity)
    s, t = n + m, n + m + 1
    edges: list[list[int]] = []  # to, left, cost
    out: list[list[int]] = [[] for _ in range(n + m + 2)]

    def link(a: int, b: int, room: int, price: int) -> int:
        out[a].append(len(edges))
        edges.append([b, room, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])
        return len(edges) - 2

    for i, x in enumerate(supply):
        link(s, i, x, 0)
    for j, x in enumerate(capacity):
        link(n + j, t, x, 0)
    pair = {(i, j): link(i, n + j, supply[i], cost(i, j)) for i in range(n) for j in range(m)}
    height = [0] * (n + m + 2)
    while True:
        far, back, todo = {s: 0}, {}, [(0, s)]
        while todo:
            d, a = heapq.heappop(todo)
            if d > far[a]:
                continue
            for e in out[a]:
                b, room, price = edges[e]
                if room and (x := d + price + height[a] - height[b]) < far.get(b, 1 << 62):
                    far[b], back[b] = x, e
                    heapq.heappush(todo, (x, b))
        if t not in far:
            break
        for a, d in far.items():
            height[a] += d
        path, a = [], t
        while a != s:
            path.append(back[a])
            a = edges[back[a] ^ 1][0]
        room = min(edges[e][1] for e in path)
        for e in path:
            edges[e][1] -= room
            edges[e ^ 1][1] += room
    return {k: edges[e ^ 1][1] for k, e in pair.items() if edges[e ^ 1][1]}


def place_blocks(blocks: dict[tuple, int], flow: dict[tuple[int, int], int], capacity: list[int]) -> dict[tuple, int]:
    """New shard of each block, whose key begins with its old shard: largest first to the shard that still
    awaits most of the old shard's flow, or has most room if none awaits any. Blocks are whole, so sizes differ
    from the capacities by about the size of a small block."""
    left = dict(flow)
    room = list(capacity)
    placed = {}
    for key, size in sorted(blocks.items(), key=lambda x: (-x[1], x[0])):
        old = key[0]
        due = [(min(left.get((old, j), 0), room[j]), room[j], old == j, -j) for j in range(len(room))]
        best = max(due)
        if best[0] < size / 2:  # the flow of this old shard is spent
            best = max(due, key=lambda x: (x[1], x[2], x[3]))
        j = -best[3]
        placed[key] = j
        room[j] -= size
        left[old, j] = left.get((old, j), 0) - size
    return placed


def reshard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, old_shard: Column | None = None, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS, shares: list[float] | None = None, blocks: int = BLOCKS_PER_SHARD, rows_per_lane: int = ROWS_PER_LANE, move_cost=None) -> DataFrame:
    """`docs` with size (UTF-8 bytes + 8), old_shard, shard, moved and slot (gapless from 0 in a shard) at the end.

    `old_shard`: where a row lies now (default: by the hash of its text); `shares`: relative capacities of the
    new shards (default equal); a null old shard counts as 0. Sizes come as near to the capacities as whole
    blocks allow; equal texts of one old shard always stay together, however large their group is. Null texts
    have size 8 and are equal to the empty text. Null and repeated ids are rows like any other. An empty table
    gives no rows; columns with one of the new names are replaced, except id and text."""
    new = ("size", "old_shard", "shard", "moved", "slot")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in new and c not in (id_col, text_col)))
    spark = docs.sparkSession
    block, part, lane, first = (fresh([*docs.columns, *new], f"_{x}") for x in ("block", "part", "lane", "first"))
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(
        "*",
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        (F.pmod(h, F.lit(old_shards)).cast("int") if old_shard is None else F.coalesce(old_shard.cast("int"), F.lit(0))).alias("old_shard"),
        F.pmod(F.shiftright(h, 20), F.lit(blocks)).cast("int").alias(block),
        F.pmod(F.shiftright(h, 40), F.lit(blocks)).cast("int").alias(part),
    )
    # at most old_shards x blocks numbers, whatever the data
    sums = (F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    whole = {(x["old_shard"], x[block]): (x["bytes"], x["n"]) for x in rows.groupBy("old_shard", block).agg(*sums).collect()}
    total, share = sum(b for b, _ in whole.values()), shares or [1.0] * new_shards
    capacity = capacities(total, new_shards) if shares is None else [int(-(-total * s // sum(share))) for s in share]
    # at most two blocks for each new shard are so large
    large = [k for k, (b, _) in whole.items() if 2 * b > min(capacity)]
    found = {(*k, -1): x for k, x in whole.items() if k not in set(large)}
    if large:
        wide = rows.join(F.broadcast(spark.createDataFrame(large, f"old_shard int, {block} int")), ["old_shard", block])
        found |= {(x["old_shard"], x[block], x[part]): (x["bytes"], x["n"]) for x in wide.groupBy("old_shard", block, part).agg(*sums).collect()}
    supply = [0] * old_shards
    for (old, *_), (b, _) in found.items():
        supply[old] += b
    sizes = {k: b for k, (b, _) in found.items()}
    if shares is None:
        capacity = level_capacities(sizes, new_shards)
    flow = min_cost_flow(supply, capacity, move_cost or (lambda i, j: int(i != j)))
    placed = place_blocks(sizes, flow, capacity)
    target = [(*k, j, -(-found[k][1] // rows_per_lane)) for k, j in placed.items()]
    target = F.broadcast(spark.createDataFrame(target, "o int, b int, p int, shard int, lanes int"))
    of_block = (F.col("old_shard") == F.col("o")) & (F.col(block) == F.col("b")) & (F.col("p").isin(-1) | (F.col("p") == F.col(part)))
    rows = rows.join(target, of_block).select(*docs.columns, "size", "old_shard", "shard", block, F.col("p").alias(part), F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.col("lanes")).cast("int").alias(lane))
    # one row for each lane: the blocks and a row for every rows_per_lane rows
    keys = ["shard", "old_shard", block, part, lane]
    order = Window.partitionBy("shard").orderBy(*keys[1:])
    lanes = cut(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    starts = lanes.select(*keys, (F.sum("n").over(order) - F.col("n")).alias(first))
    numbered = rows.withColumn("slot", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(id_col))).cast("long") - 1)
    joined = numbered.join(F.broadcast(starts) if lanes.count() <= BROADCAST_LANES else starts, keys)
    return joined.select(*docs.columns, "size", "old_shard", "shard", (F.col("shard") != F.col("old_shard")).alias("moved"), (F.col("slot") + F.col(first)).alias("slot"))


def rewrite(resharded: DataFrame, folder: str, old_folder: str, *, rows_per_file: int = 1_000_000) -> DataFrame:
    """Write the shards that lose or gain rows below the new `folder`, each by as many tasks as its rows ask for;
    return the layout (shard, path, rows, bytes), also kept at <folder>/layout.

    `old_folder` holds the old layout as shard=N. Nothing in it is changed: shards that no row leaves or enters
    are not read or copied, and the layout names their old path. Readers change over when they take the new
    layout (`load`), so a run that is lost half-way loses nothing and can be started again with another folder."""
    spark = resharded.sparkSession
    sums = resharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), F.max("moved").alias("gains"), F.collect_set(F.when(F.col("moved"), F.col("old_shard"))).alias("losers"))
    sums = sums.collect()  # a row for each shard
    touched = {x["shard"] for x in sums if x["gains"]} | {old for x in sums for old in x["losers"]}
    rows = resharded.filter(F.col("shard").isin(*touched)) if touched else resharded.filter("false")
    spread = (F.col("slot") / rows_per_file).cast("int")
    rows.repartition(F.col("shard"), spread).write.partitionBy("shard").parquet(f"{folder}/shards")
    layout = [(x["shard"], f"{folder}/shards/shard={x['shard']}" if x["shard"] in touched else f"{old_folder}/shard={x['shard']}", x["rows"], x["bytes"]) for x in sums]
    spark.createDataFrame(layout, "shard int, path string, rows long, bytes long").coalesce(1).write.parquet(f"{folder}/layout")
    return spark.read.parquet(f"{folder}/layout")


def load(layout: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns of all shards of a layout, with shard."""
    spark = layout.sparkSession
    parts = [spark.read.parquet(x["path"]).select(*columns, F.lit(x["shard"]).alias("shard")) for x in layout.collect()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
