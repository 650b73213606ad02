"""Gaps, tokens, windows and states along the events of an account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quantiles import quantiles

#: Lower bounds (minutes) of the pause symbols a .. g.
PAUSES = ((10080.0, "g"), (1440.0, "f"), (480.0, "e"), (60.0, "d"), (10.0, "c"), (1.0, "b"), (0.0, "a"))


def order(by: list[str], tie: str = "event_id"):
    return Window.partitionBy(*by).orderBy("ts", tie)


def gaps(events: DataFrame, by: list[str]) -> DataFrame:
    """gap (minutes, the first 0), completed (whole minutes) and the conservative bounds lo, hi."""
    seconds = F.coalesce(F.col("ts") - F.lag("ts").over(order(by)), F.lit(0))
    done = F.expr("_seconds div 60")
    rows = events.withColumn("_seconds", seconds.cast("bigint"))
    lower = F.greatest(done - 1, F.lit(0))
    return rows.select("*", (F.col("_seconds") / 60.0).alias("gap"), done.alias("completed"), F.when(lower == 0, 1e-3).otherwise(lower.cast("double")).alias("lo"), (done + 1).cast("double").alias("hi")).drop("_seconds")


def edges_below(edges: Column, x: Column) -> Column:
    return F.size(F.filter(edges, lambda e: e <= x))


TENTHS = [k / 10 for k in range(1, 10)]


def decile_edges(gapped: DataFrame, by: list[str]) -> DataFrame:
    """(by, edges): the nine deciles of the gaps, equal ones merged."""
    return quantiles(gapped, by, "gap", TENTHS, "edges").withColumn("edges", F.array_distinct("edges"))


def tokenize(gapped: DataFrame, edges: DataFrame, on: list[str]) -> DataFrame:
    """token = action * 10 + gap bin; `edges` has one row for each platform or population."""
    bin_ = F.least(edges_below(F.col("edges"), F.col("gap")), F.lit(9))
    return gapped.join(F.broadcast(edges), on).withColumn("token", (F.col("action") * 10 + bin_).cast("int")).drop("edges")


def positions(events: DataFrame, by: list[str]) -> DataFrame:
    """pos (from 0) and n (events of the key)."""
    return events.withColumn("pos", F.row_number().over(order(by)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))


def fixed_windows(placed: DataFrame, width: int) -> DataFrame:
    """Full windows of `width` events; a shorter sequence is one window. Adds window, offset."""
    inside = (F.col("n") < width) | (F.col("pos") < F.col("n") - F.col("n") % width)
    return placed.filter(inside).withColumns({"window": F.floor(F.col("pos") / width).cast("long"), "offset": (F.col("pos") % width).cast("long")})


def symbols(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, text): a pause symbol and an action symbol for each event, in order."""
    g = gaps(events, by)
    pause = F.lit("")
    for bound, sign in reversed(PAUSES):
        pause = F.when(F.col("gap") >= bound, sign).otherwise(pause)
    first = F.row_number().over(order(by)) == 1
    sign = F.element_at(F.array(F.lit("T"), F.lit("p"), F.lit("r")), (F.col("action") + 1).cast("int"))
    coded = g.select(*by, "ts", "event_id", F.concat(F.when(first, "").otherwise(pause), sign).alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "s"))), lambda x: x.s), "")
    return coded.groupBy(*by).agg(joined.alias("text"))


def grams(text: Column, sizes: tuple[int, ...] = (1, 2)) -> Column:
    """All character n-grams of the sizes, in order."""
    n = F.length(text)
    one = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*map(one, sizes))


def time_split(placed: DataFrame) -> DataFrame:
    """part: the first 60 % of a sequence train, to 80 % val, the rest test."""
    p, n = F.col("pos"), F.col("n")
    return placed.withColumn("part", F.when(p < F.floor(n * F.lit(0.6)), "train").when(p < F.floor(n * F.lit(0.8)), "val").otherwise("test"))


def log_bin(x: Column, bins: int = 32, top: float = 12.0) -> Column:
    """Equal bins of log1p(x) on 0 .. top; the last bin is open."""
    return F.least(F.floor(F.log1p(x) / (top / bins)), F.lit(bins - 1)).cast("int")


def transitions(events: DataFrame, by: list[str], state: str, action: str) -> DataFrame:
    """(by, state, action, p): row-normalised counts of the next event's action."""
    nxt = F.lead(action).over(order(by))
    pairs = events.select(*by, F.col(state).alias("s"), nxt.alias("a")).filter(F.col("a").isNotNull())
    counts = pairs.groupBy(*by, "s", "a").agg(F.count(F.lit(1)).alias("k"))
    return counts.select(*by, "s", "a", (F.col("k") / F.sum("k").over(Window.partitionBy(*by, "s"))).alias("p"))
