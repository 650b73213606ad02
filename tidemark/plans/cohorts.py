"""Cohort operators: loaders, allow-lists, matched controls, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.quantiles import quantiles
from ..operators.ranks import carried, numbered, ranged
from ..operators.sampling import digest, draw
from ..session import cut


def load_accounts(events: DataFrame, members: DataFrame, window: tuple[int, int], least: int) -> DataFrame:
    """Events of members inside the window (both ends), of accounts with at least `least` of them."""
    e = events.filter(F.col("ts").between(*window)).join(members, "user", "left_semi")
    return e.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user"))).filter(F.col("_n") >= least).drop("_n")


def distinct_seconds(events: DataFrame, least: int) -> DataFrame:
    """(user, ts): distinct seconds of accounts that have at least `least`."""
    d = events.select("user", "ts").distinct()
    return d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user"))).filter(F.col("_n") >= least).drop("_n")


def allow_only(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows of the allowed labels; the job fails if one of them is missing."""
    kept = df.filter(F.col(column).isin(*allowed))
    seen = kept.agg(F.count_distinct(column).alias("_seen"))
    return kept.join(F.broadcast(seen)).filter(F.assert_true(F.col("_seen") == len(allowed), F.lit("a required label is missing")).isNull()).drop("_seen")


def agreement(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: the correlation of each column of two versions of a table, and the shared keys."""
    j = old.alias("o").join(new.alias("n"), key)
    return j.agg(*(F.corr(F.col(f"o.{c}").cast("double"), F.col(f"n.{c}").cast("double")).alias(f"r_{c}") for c in columns), F.count(F.lit(1)).alias("accounts"))


def decile_matched(v: DataFrame, group: str, case: str, control: str, key: str, volume: str, sets: int, seed: str) -> DataFrame:
    """(set_id, member, control): a control of the member's volume decile, or of the whole pool if it has none."""
    edges = quantiles(v, [], volume, [k / 10 for k in range(1, 10)])
    x = v.join(F.broadcast(edges)).withColumn("dec", F.size(F.filter("q", lambda z: z <= F.col(volume))))
    pool = x.filter(F.col(group) == control)
    by_bin = numbered(pool.select("dec", F.col(key).alias("control")), ["dec"], [F.col("control")], "slot").withColumn("slot", F.col("slot") - 1)
    sizes = by_bin.groupBy("dec").agg(F.count(F.lit(1)).alias("own"))  # eleven rows at most
    members = x.filter(F.col(group) == case).join(F.broadcast(sizes), "dec", "left")
    drawn = members.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sets - 1).cast("long"))).alias("set_id"), F.col(key).alias("member"), "dec", "own").withColumn("r", draw(seed, F.col("set_id"), F.col("member")))
    within = drawn.filter("own is not null").withColumn("slot", F.pmod("r", "own")).join(by_bin, ["dec", "slot"])
    # the whole pool is numbered bin by bin, so no single task holds it
    starts = sizes.select("dec", (F.sum("own").over(Window.orderBy("dec")) - F.col("own")).alias("first"), F.sum("own").over(Window.partitionBy()).alias("whole"))
    anywhere = by_bin.join(F.broadcast(starts), "dec").select("control", (F.col("first") + F.col("slot")).alias("slot"))
    whole = F.broadcast(sizes.agg(F.sum("own").alias("whole")))
    rest = drawn.filter("own is null").join(whole).withColumn("slot", F.pmod("r", "whole")).join(anywhere, "slot")
    return within.select("set_id", "member", "control").unionByName(rest.select("set_id", "member", "control"))


def length_pairs(v: DataFrame, group: str, case: str, control: str, key: str, length: str, runs: int) -> DataFrame:
    """(run, member, control, length): each member's own control, at least as long where one is left, cut to its length.

    All accounts stand in one line by falling length, controls before members of the same length, further ties by a
    hash of the run. A member takes the first control before it that is still free, like a closing parenthesis; who
    finds none takes the longest that nobody took. So no account is used twice, and no member goes without while
    controls last. Free controls at a place are counted by sums and least sums along the line, both carried from
    range to range; nothing is walked through in one task. A null length counts as 0."""
    each = v.filter(F.col(group).isin(case, control)).select(F.col(key).alias("key"), F.coalesce(F.col(length), F.lit(0)).alias("length"), (F.col(group) == case).cast("int").alias("m"))
    each = each.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(runs - 1).cast("long"))))
    line = each.select("*", (-F.col("length")).alias("_l"), digest(F.col("run"), F.col("key")).alias("_h"))
    keys = ["_l", "m", "_h", "key"]
    line = carried(ranged(line, ["run"], keys), ["run"], {"_c": F.sum(1 - F.col("m")), "_m": F.sum("m")})
    along = Window.partitionBy("_p", "run").orderBy(*keys)
    upto, before = along.rowsBetween(Window.unboundedPreceding, Window.currentRow), along.rowsBetween(Window.unboundedPreceding, -1)
    line = line.withColumns({"_c": F.col("_c") + F.sum(1 - F.col("m")).over(upto), "_m": F.col("_m") + F.sum("m").over(upto)}).withColumn("_d", F.col("_c") - F.col("_m"))
    line = carried(cut(line), ["run"], {"_low": F.min("_d")}, F.min)
    line = line.withColumn("_low", F.least(F.lit(0), F.col("_low"), F.min("_d").over(before)))
    line = cut(line.withColumn("short", (F.col("m") == 1) & (F.col("_d") < F.col("_low"))).withColumn("without", -F.least("_low", "_d")))
    served = line.groupBy("run").agg((F.max("_m") - F.max("without")).alias("served"))  # a row for each run
    members = line.filter("m = 1").join(F.broadcast(served), "run")
    members = members.select("run", F.col("key").alias("member"), F.col("length").alias("la"), F.when(F.col("short"), F.col("served") + F.col("without")).otherwise(F.col("_m") - F.col("without")).alias("k"))
    controls = line.filter("m = 0").select("run", F.col("key").alias("control"), F.col("length").alias("lb"), F.col("_c").alias("k"))
    return members.join(controls, ["run", "k"]).select("run", "member", "control", F.least("la", "lb").alias("length"))
