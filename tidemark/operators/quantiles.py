"""Exact quantiles of many groups at once, in bounded memory.

Values are counted first; the distinct ones are ranked by ranges, and each wanted rank is read off where it lies. No
task holds the values of a group, however large it is, and all groups and levels share one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import cumulative


def quantiles(df: DataFrame, by: list[str], value: str, levels: list[float], name: str = "q") -> DataFrame:
    """(by, name): the quantiles of `value` at `levels`, interpolated between neighbours as `percentile` does.

    Null values do not count; a key of nothing else has no row, but without keys there is always one (of nulls then).
    A null key is a key like any other; NaN is greater than any number."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_ties"))
    return of_counts(counts, by, value, "_ties", levels, name)


def of_counts(counts: DataFrame, by: list[str], value: str, ties: str, levels: list[float], name: str = "q") -> DataFrame:
    """As `quantiles`, of rows that stand for `ties` equal values each (one row for each key and value)."""
    c = counts.select(*by, F.col(value).cast("double").alias("_v"), F.col(ties).cast("long").alias("_t")).filter(F.col("_t") > 0)
    ranked = cumulative(c, by, "_v", ["_t"])
    keys = [f"_g{i}" for i in range(len(by))]
    total = c.groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True))).agg(F.sum("_t").alias("_n"))
    same = F.lit(True)
    for b, k in zip(by, keys, strict=True):
        same = same & F.col(b).eqNullSafe(F.col(k))
    ranked = ranked.join(total if by else F.broadcast(total), same).drop(*keys)
    place = [F.lit(float(p)) * (F.col("_n") - 1) for p in levels]
    holds = lambda rank: (F.col("below__t") <= rank) & (rank < F.col("below__t") + F.col("_t"))
    at = [F.max(F.when(holds(f(p)), F.col("_v"))).alias(f"_{side}{i}") for i, p in enumerate(place) for side, f in (("lo", F.floor), ("hi", F.ceil))]
    found = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), *at)

    def between(i: int):
        lo, hi, p = F.col(f"_lo{i}"), F.col(f"_hi{i}"), place[i]
        return F.when(lo == hi, lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    return found.select(*by, F.array(*(between(i) for i in range(len(levels)))).alias(name))


def without_each_fold(df: DataFrame, by: list[str], value: str, fold: str, levels: list[float], folds: int, name: str = "q") -> DataFrame:
    """(by, fold, name): for each fold from 0 the quantiles of the rows that are in the other folds.

    A fold's counts are taken from those of all rows, so no row is copied to its training sets."""
    own = df.filter(F.col(value).isNotNull()).groupBy(*by, fold, value).agg(F.count(F.lit(1)).alias("_own"))
    w = own.groupBy(*by, value).agg(F.sum("_own").alias("_all"), F.map_from_entries(F.collect_list(F.struct(fold, "_own"))).alias("_in"))  # an entry for each fold
    rest = w.withColumn(fold, F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rest = rest.withColumn("_ties", F.col("_all") - F.coalesce(F.try_element_at("_in", F.col(fold)), F.lit(0)))
    return of_counts(rest, [*by, fold], value, "_ties", levels, name)
