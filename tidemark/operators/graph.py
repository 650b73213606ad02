"""Set-overlap graphs and their components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import cut, discard, written
from .ranks import numbered

#: Edges of one node that one task may join; a node of more is dealt over lanes.
LANE = 1000
#: Sets of one block, sets of it that are compared at once, and products of the matrices that cost as much as one pair
#: that meets in the index.
BLOCK, STRIP, PAIR_COST = 16384, 1024, 40_000


def _sets(pairs: DataFrame, node: str, item: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(n, items from the rarest on) of the nodes with at least `least` items, and (i, f): how many nodes hold an item."""
    d = pairs.select(F.col(node).alias("n"), F.col(item).alias("i")).filter(F.col("i").isNotNull() & F.col("n").isNotNull()).distinct()
    often = cut(d.groupBy("i").agg(F.count(F.lit(1)).alias("f")))
    items = F.transform(F.array_sort(F.collect_list(F.struct("f", "i"))), lambda x: x.i)
    return cut(d.join(often, "i").groupBy("n").agg(items.alias("items")).filter(F.size("items") >= least)), often


def _rarest(sets: DataFrame, least: int) -> DataFrame:
    """Of two sets that share `least` items, each holds one of the shared items among its size - least + 1 rarest."""
    return sets.select("n", F.explode(F.slice("items", F.lit(1), F.size("items") - (max(least, 1) - 1))).alias("i"))


def _by_index(sets: DataFrame, least: int) -> DataFrame:
    """Only sets that meet in the index of their rarest items are verified on the whole."""
    rarest = _rarest(sets, least)
    met = rarest.alias("x").join(rarest.alias("y"), (F.col("x.i") == F.col("y.i")) & (F.col("x.n") < F.col("y.n"))).select(F.col("x.n").alias("a"), F.col("y.n").alias("b")).distinct()
    both = met.join(sets.select(F.col("n").alias("a"), F.col("items").alias("p")), "a").join(sets.select(F.col("n").alias("b"), F.col("items").alias("q")), "b")
    common = F.size(F.array_intersect("p", "q"))
    return both.select("a", "b", common.cast("bigint").alias("common"), (F.size("p") + F.size("q")).cast("bigint").alias("sum")).filter(F.col("common") >= least)


def _counts(p: pa.StructArray, q: pa.StructArray, kind: str, strip: int, columns: int = 512):
    """(first row of p, sizes of p and q, how many items each of `strip` rows of p shares with each row of q)."""

    def entries(rows):
        size = pc.binary_length(rows.field("at")).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
        column = np.frombuffer(b"".join(rows.field("at").to_pylist()), kind).astype(np.int64)
        return size, np.repeat(np.arange(len(size)), size), column

    (sp, rp, cp), (sq, rq, cq) = entries(p), entries(q)
    order = np.argsort(cq, kind="stable")
    rq, cq = rq[order], cq[order]
    shared = np.intersect1d(cp, cq)
    for first in range(0, len(sp), strip):
        n = min(strip, len(sp) - first)
        inside = slice(*np.searchsorted(rp, [first, first + n]))
        total = np.zeros((n, len(sq)), np.float32)
        for at in range(0, len(shared), columns):
            some = shared[at : at + columns]
            x, y = np.zeros((n, len(some)), np.float32), np.zeros((len(sq), len(some)), np.float32)
            own = np.isin(cp[inside], some)
            x[rp[inside][own] - first, np.searchsorted(some, cp[inside][own])] = 1
            near = slice(*np.searchsorted(cq, [some[0], some[-1] + 1]))
            held = np.isin(cq[near], some)
            y[rq[near][held], np.searchsorted(some, cq[near][held])] = 1
            total += x @ y.T
        yield first, sp, sq, total


def _joined(found: np.ndarray, mark: np.ndarray, first: int, offset: int) -> None:
    """Gives the row and all it is linked with one mark, the least of theirs."""
    for row in np.flatnonzero(found.any(axis=1)):
        marks = np.unique(np.append(mark[offset + np.flatnonzero(found[row])], mark[first + row]))
        if len(marks) > 1:
            mark[np.isin(mark, marks)] = marks[0]


def _by_blocks(sets: DataFrame, often: DataFrame, count: int, width: int, least: int, whole: bool, block: int, strip: int) -> DataFrame:
    """Every two blocks of some `block` sets are compared by one task, `strip` sets of one with all of the other, as
    products of 0/1 matrices (exact: counts are below 2^24). A set is shipped once for each block, no pair ever is.

    whole: (a, b, common, sum) of all pairs with `least` items in common. Else (a, b): links that join what the pairs
    of these two blocks join, at most one for each set."""
    node, blocks = sets.schema["n"].dataType, max(1, -(-count // block))
    kind = np.min_scalar_type(width).str
    packed = F.pandas_udf(lambda v: v.map(lambda x: np.asarray(x, kind).tobytes()), "binary")
    places = numbered(often.select("i"), [], [F.col("i")], "place")
    rows = sets.select("n", F.explode("items").alias("i")).join(places, "i").groupBy("n").agg(F.sort_array(F.collect_list(F.col("place") - 1)).alias("at"))
    rows = rows.select("n", packed("at").alias("at"), F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int").alias("x"))
    dealt = cut(rows.groupBy("x").agg(F.collect_list(F.struct("n", "at")).alias("p")))
    left = dealt.select("x", "p", F.explode(F.sequence("x", F.lit(blocks - 1))).alias("y"))
    pairs = left.join(dealt.select(F.col("x").alias("y"), F.col("p").alias("q")), "y").repartition(blocks * (blocks + 1) // 2, "x", "y")

    def compare(batches):
        for batch in batches:
            for x, y, p, q in zip(*(batch.column(c) for c in ("x", "y", "p", "q")), strict=True):
                p, q, same = p.values, q.values, x.as_py() == y.as_py()
                offset = 0 if same else len(p)
                mark = np.arange(len(p) if same else len(p) + len(q))
                for first, sp, sq, total in _counts(p, q, kind, strip):
                    found = total >= least
                    if same:  # each pair once, no set with itself
                        found &= np.arange(len(sq)) > first + np.arange(len(total))[:, None]
                    if not whole:
                        _joined(found, mark, first, offset)
                        continue
                    a, b = np.nonzero(found)
                    ends = [p.field("n").take(pa.array(a + first)), q.field("n").take(pa.array(b))]
                    yield pa.RecordBatch.from_arrays([*ends, pa.array(total[a, b].astype(np.int64)), pa.array((sp[a + first] + sq[b]).astype(np.int64))], ["a", "b", "common", "sum"])
                if not whole:
                    names = p.field("n") if same else pa.concat_arrays([p.field("n"), q.field("n")])
                    moved = np.flatnonzero(mark != np.arange(len(mark)))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(mark[moved]))], ["a", "b"])

    ends = [StructField("a", node), StructField("b", node)]
    counts = [StructField("common", LongType()), StructField("sum", LongType())]
    out = pairs.select("x", "y", "p", "q").mapInArrow(compare, StructType(ends + counts if whole else ends))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *(("common", "sum") if whole else ()))


def _met(pairs: DataFrame, node: str, item: str, least: int, whole: bool, blocks: bool | None, block: int, strip: int) -> DataFrame:
    sets, often = _sets(pairs, node, item, least)
    count, width = sets.count(), often.count()
    if blocks is None:
        f = _rarest(sets, least).groupBy("i").agg(F.count(F.lit(1)).cast("double").alias("f"))
        meets = f.agg(F.sum(F.col("f") * (F.col("f") - 1) / 2)).first()[0] or 0.0
        blocks = float(count) * count * width < PAIR_COST * meets
    return _by_blocks(sets, often, count, width, least, whole, block, strip) if blocks and count else _by_index(sets, least)


def overlap(pairs: DataFrame, node: str, item: str, least: int, *, blocks: bool | None = None, block: int = BLOCK, strip: int = STRIP) -> DataFrame:
    """(a, b, common, jaccard): nodes that share at least `least` items.

    Where items are rare, sets meet in an index of their rarest items and are verified on the whole sets. Where most
    sets would meet there, listing the pairs that meet takes far more room than those that remain; then all sets are
    compared block by block (`_by_blocks`). `blocks` chooses; without it the number of pairs that the index would
    list decides."""
    found = _met(pairs, node, item, max(least, 1), True, blocks, block, strip)
    return found.select("a", "b", "common", (F.col("common") / (F.col("sum") - F.col("common"))).alias("jaccard"))


def overlap_links(pairs: DataFrame, node: str, item: str, least: int, *, blocks: bool | None = None, block: int = BLOCK, strip: int = STRIP) -> DataFrame:
    """(a, b): links whose components are those of all pairs of `overlap`, but no more than one for each set and two
    blocks, however many pairs there are."""
    return _met(pairs, node, item, max(least, 1), False, blocks, block, strip).select("a", "b")


def components(edges: DataFrame, a: str = "a", b: str = "b", lane: int = LANE) -> DataFrame:
    """(node, component) for every node of the edges: component is the smallest node reachable.

    Alternating large and small stars: each round hangs every node nearer to its component's smallest node, so
    rounds grow with the logarithm of the longest path, and ids may be of any type that has an order. It is done when
    every node is its component's smallest or has that one alone as neighbour. Only aggregates (combined before the
    shuffle) and equal joins run; a node with more than `lane` edges is dealt over several lanes of the joins, so no
    task holds all edges of a hub. A null at either end makes no edge; an edge of a node with itself makes a node."""
    named = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    links = cut(named.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.col("u").isNull() | F.col("v").isNull()).toDF("u", "v", "no").filter("not no").drop("no").distinct())
    alone = links.filter("u = v").select("u", F.col("u").alias("m"))
    links, path = links.filter("u > v"), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("edges")))
        if least.filter("m <> u and edges > 1").isEmpty():
            break
        large = with_lanes(both, least, "u", "v", lane).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("edges")))
        # every node hangs on its least neighbour, and its other smaller neighbours do too
        small = with_lanes(large, least, "u", "v", lane).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links, new = written(small.distinct(), "links")
        if path:
            discard(edges.sparkSession, path)
        path = new
    if path:
        discard(edges.sparkSession, path)
    found = least.select("u", "m")
    return found.unionByName(alone.join(found, "u", "left_anti")).select(F.col("u").alias("node"), F.col("m").alias("component"))


def with_lanes(rows: DataFrame, facts: DataFrame, key: str, spread: str, lane: int = LANE) -> DataFrame:
    """`rows` joined on `key` with `facts`, which has one row for each key and in `edges` how many rows it has.

    Rows of a key with more than `lane` are dealt over lanes by the hash of `spread`, and its facts are repeated
    once for each lane. Such keys are fewer than rows / `lane`; their numbers of lanes are broadcast while Spark
    finds that table small enough, and joined else."""
    hubs = facts.filter(F.col("edges") > lane).select(key, F.ceil(F.col("edges") / lane).cast("int").alias("_lanes"))
    if hubs.isEmpty():
        return rows.join(facts.drop("edges"), key)
    dealt = rows.join(hubs, key, "left").withColumn("_lane", F.pmod(F.xxhash64(spread), F.coalesce("_lanes", F.lit(1))).cast("int")).drop("_lanes")
    lanes = F.ceil(F.greatest(F.col("edges"), F.lit(1)) / lane).cast("int")
    return dealt.join(facts.withColumn("_lane", F.explode(F.sequence(F.lit(0), lanes - 1))).drop("edges"), [key, "_lane"]).drop("_lane")


def sized(labels: DataFrame) -> DataFrame:
    """Adds size and rank (1 = the largest component; equal sizes by the smaller label)."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    ranked = numbered(sizes, [], [-F.col("size"), F.col("component")], "rank")
    return labels.join(ranked, "component")
