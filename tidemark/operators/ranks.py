"""Ranks and cumulative sums over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def ranged(df: DataFrame, by: list[str], order: list[str], partitions: int | None = None) -> DataFrame:
    """Rows dealt by range of (key, order), with _p, the range."""
    n = partitions or max(1, df.sparkSession.sparkContext.defaultParallelism)
    return cut(df.repartitionByRange(n, *by, *order).withColumn("_p", F.spark_partition_id()))


def carried(dealt: DataFrame, by: list[str], sums: dict[str, Column], combine=F.sum) -> DataFrame:
    """Adds the columns of `sums`: each combined (summed) over the rows of the same key in earlier ranges, 0 if none.

    Only a range's first key can lie in earlier ranges too, so the table that is broadcast has one row for each
    range at most, however many keys there are. Keys are compared null-safe."""
    ends = dealt.groupBy("_p", *by).agg(*(F.coalesce(c, F.lit(0)).alias(f"_t_{name}") for name, c in sums.items()))
    along = Window.partitionBy(*by).orderBy("_p")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    keys = [f"_b{i}" for i in range(len(by))]
    later = ends.withColumn("_n", F.row_number().over(along)).select(F.col("_p").alias("_q"), *(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), *(combine(f"_t_{name}").over(before).alias(name) for name in sums), "_n").filter("_n > 1").drop("_n")
    same = F.col("_p") == F.col("_q")
    for b, k in zip(by, keys, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(k))
    return dealt.join(F.broadcast(later), same, "left").drop("_q", *keys).na.fill(0, list(sums))


def cumulative(df: DataFrame, by: list[str], value: str, sums: list[str], partitions: int | None = None) -> DataFrame:
    """Adds below_<c> for each column c: its sum over the rows of the same key that have a smaller `value`.

    Rows are dealt by range of (key, value); each range is summed, and a window runs inside each range alone. A null
    key is a key like any other; null values come before all others, NaN after them."""
    dealt = carried(ranged(df, by, [value], partitions), by, {f"_o_{c}": F.sum(c) for c in sums})
    inside = Window.partitionBy("_p", *by).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("_p", *by, value)
    # a whole sum of nulls alone counts as none
    below = [(F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) - F.coalesce(F.sum(c).over(same), F.lit(0))).alias(f"below_{c}") for c in sums]
    return dealt.select(*df.columns, *below)


def midranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, ties, midrank): a row for each distinct value."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    ranked = cumulative(counts, by, value, ["ties"])
    return ranked.select(*by, value, "ties", (F.col("below_ties") + (F.col("ties") + 1) / 2.0).alias("midrank"))


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """Adds `name`: the row's number, from 1, among the rows of its key in the given order (ties: any order).

    As `cumulative`: rows are dealt by range, counted by range, and numbered inside each range alone; a null key is a
    key like any other."""
    keys = [f"_k{i}" for i in range(len(order))]
    dealt = ranged(df.withColumns(dict(zip(keys, order, strict=True))), by, keys, partitions)
    dealt = carried(dealt, by, {"_o": F.count(F.lit(1))})
    inside = F.row_number().over(Window.partitionBy("_p", *by).orderBy(*keys))
    return dealt.select(*df.columns, (F.col("_o") + inside).alias(name))
