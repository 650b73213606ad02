"""Rescaled times from interval-censored gaps, and likelihood matrices of populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sampling import draw
from .sequences import gaps, log_bin, order


def contexts(events: DataFrame, by: list[str]) -> DataFrame:
    """Gap rows with d (completed minutes) and ctx (bin of the gap before; -1 for the first gap)."""
    g = gaps(events, by).withColumn("_pos", F.row_number().over(order(by))).filter(F.col("_pos") > 1)
    before = F.lag("completed").over(order(by))
    return g.withColumns({"d": F.col("completed"), "ctx": F.when(before.isNull(), -1).otherwise(log_bin(before.cast("double"), 8))}).drop("_pos")


def baseline(rows: DataFrame, on: list[str], reference: Column | None = None) -> DataFrame:
    """(on, ctx, d, below, c, n): empirical law of the completed minutes in each context.

    With `reference` (boolean) only those rows make the law; the minutes of the others stand in it with c = 0."""
    counted = F.count(F.lit(1)) if reference is None else F.count(F.when(reference, 1))
    c = rows.groupBy(*on, "ctx", "d").agg(counted.alias("c"))
    w = Window.partitionBy(*on, "ctx")
    upto = F.sum("c").over(w.orderBy("d"))
    return c.select(*on, "ctx", "d", (upto - F.col("c")).alias("below"), "c", F.sum("c").over(w).alias("n"))


def rescaled(rows: DataFrame, law: DataFrame, on: list[str], key: str = "event_id", seed: str = "pit") -> DataFrame:
    """u = F(a) + r (F(b) - F(a)) with add-one ends and a hash-drawn r; tau = -log1p(-u)."""
    r = (draw(seed, F.col(key)) + 0.5) / F.lit(4294967296.0)
    u = (F.col("below") + 0.5 + r * F.col("c")) / (F.col("n") + 1.0)
    j = rows.join(law, [*on, "ctx", "d"])  # grows with the time span, so its measured size decides how it is joined
    return j.withColumn("u", F.least(F.greatest(u, F.lit(1e-9)), F.lit(1 - 1e-9))).withColumn("tau", -F.log1p(-F.col("u"))).drop("below", "c", "n")


def tau_bin(tau: Column) -> Column:
    return F.least(F.floor(tau * 4), F.lit(7)).cast("int")


def densities(taus: DataFrame, pop: str) -> DataFrame:
    """(pop, rate): the exponential law of mean tau, in closed form."""
    return taus.groupBy(pop).agg((1 / F.avg("tau")).alias("rate"))


def log_normal_densities(taus: DataFrame, pop: str, by: list[str]) -> DataFrame:
    """(pop, bin, n, mu, sigma): the log-normal law of a rescaled time given the bin of the one before it in the
    same account (-1 for the first), in closed form."""
    before = F.lag("tau").over(order(by))
    t = taus.withColumns({"bin": F.when(before.isNull(), -1).otherwise(tau_bin(before)), "_l": F.log(F.greatest("tau", F.lit(1e-8)))})
    return t.groupBy(pop, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("_l").alias("mu"), F.stddev_pop("_l").alias("sigma"))


def account_llr(taus: DataFrame, pop: str, positive: str) -> DataFrame:
    """(user, pop, llr): mean log-likelihood ratio of an account's times, the positive population's law over the
    unit law."""
    rate = taus.filter(F.col(pop) == positive).agg((1 / F.avg("tau")).alias("_rate"))
    m = taus.groupBy("user", pop).agg(F.avg("tau").alias("_m")).join(F.broadcast(rate))
    return m.select("user", pop, (F.col("_m") - nll(F.col("_m"), F.col("_rate"))).alias("llr"))


def nll(tau: Column, rate: Column) -> Column:
    return rate * tau - F.log(rate)


def excess_matrix(taus: DataFrame, pop: str) -> DataFrame:
    """(a, b, excess): mean NLL of a's times under b's law less under its own, and under the unit law.

    Sums of each population meet the laws: populations x populations rows, whatever the events."""
    sums = taus.groupBy(pop).agg(F.avg("tau").alias("m")).select(F.col(pop).alias("a"), "m")
    laws = sums.select(F.col("a").alias("b"), (1 / F.col("m")).alias("rate"))
    unit = laws.sparkSession.createDataFrame([("Exp(1) null", 1.0)], laws.schema)
    own = nll(F.col("m"), 1 / F.col("m"))
    return sums.crossJoin(F.broadcast(laws.unionByName(unit))).select("a", "b", (nll(F.col("m"), F.col("rate")) - own).alias("excess"))
