"""Account profiles that are kept up to date from batches of events.

An account's state is one row: its first and last second, its distinct seconds and active days, counts by hour, action
and kind of day, and how often each gap between its events occurs. States of two stretches of time are joined without
their events; the gap between the stretches is the one from the last second to the first. So a batch costs its own
events and one pass over the states, and the profile of the joined states is that of all events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.profile import _features, timed
from ..session import discard


def states(events: DataFrame, by: list[str], tie: str = "event_id") -> DataFrame:
    """One state for each `by` key of events (ts in seconds, action 0, 1 or 2)."""
    order = Window.partitionBy(*by).orderBy("ts", tie)
    at = timed(F.col("ts"))
    e = events.withColumns({"_gap": F.col("ts") - F.lag("ts").over(order), "_day": F.to_date(at), "_hour": F.hour(at), "_wd": F.weekday(at)})
    e = e.withColumn("_new_day", F.coalesce((F.col("_day") != F.lag("_day").over(order)).cast("long"), F.lit(1)))
    # counted by gap first, so an account's row holds each different gap once
    count = lambda c: F.sum(c.cast("long"))
    part = e.groupBy(*by, "_gap").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("_new_day").alias("days"),
        F.array(*(count(F.col("_hour") == h) for h in range(24))).alias("hours"), F.array(*(count(F.col("action") == a) for a in range(3))).alias("actions"),
        F.array(count(F.col("_wd") < 5), count(F.col("_wd") >= 5)).alias("week"),
    )
    total = lambda c, k: F.array(*(F.sum(F.col(c)[i]) for i in range(k))).alias(c)
    gaps = F.map_from_entries(F.collect_list(F.when(F.col("_gap").isNotNull(), F.struct("_gap", "n")))).alias("gaps")
    seconds = F.sum(F.when(F.col("_gap").isNull() | (F.col("_gap") > 0), F.col("n")).otherwise(0)).alias("seconds")
    return part.groupBy(*by).agg(F.min("first").alias("first"), F.max("last").alias("last"), seconds, F.sum("days").alias("days"), total("hours", 24), total("actions", 3), total("week", 2), gaps)


def fold(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """The states of both; an account's new stretch must not begin before its old one ends, else the job fails."""
    a, b = (df.select(*by, F.struct(*(c for c in df.columns if c not in by)).alias(name)) for df, name in ((old, "a"), (new, "b")))
    x = a.join(b, by, "full_outer")
    plus = lambda name: F.zip_with(F.col(f"a.{name}"), F.col(f"b.{name}"), lambda p, q: p + q).alias(name)
    between = F.col("b.first") - F.col("a.last")
    day = lambda c: F.to_date(timed(F.col(c)))
    add = lambda m, n: F.map_zip_with(m, n, lambda _, p, q: F.coalesce(p, F.lit(0)) + F.coalesce(q, F.lit(0)))
    both = F.struct(
        F.col("a.first").alias("first"), F.greatest("a.last", "b.last").alias("last"),
        (F.col("a.seconds") + F.col("b.seconds") - (between == 0).cast("long")).alias("seconds"),
        (F.col("a.days") + F.col("b.days") - (day("a.last") == day("b.first")).cast("long")).alias("days"),
        plus("hours"), plus("actions"), plus("week"), add(add(F.col("a.gaps"), F.col("b.gaps")), F.create_map(between, F.lit(1).cast("long"))).alias("gaps"),
    )
    in_order = F.assert_true(F.coalesce(between >= 0, F.lit(True)), F.lit("a batch holds events older than an account's state"))
    state = F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull(), F.col("b")).otherwise(both)
    return x.filter(in_order.isNull()).select(*by, state.alias("s")).select(*by, "s.*")


def profile_of(state: DataFrame, by: list[str]) -> DataFrame:
    """The 41 features of each state, as `profile` gives them of all its events."""
    gap = state.select(*by, F.explode("gaps").alias("g", "n")).withColumn("g", F.col("g") / 60.0)
    weighted = lambda v: F.sum(v * F.col("n")) / F.sum("n")
    spread = gap.groupBy(*by).agg(F.percentile("g", F.array(F.lit(0.5), F.lit(0.9)), F.col("n")).alias("_q"), weighted(F.col("g")).alias("_mu"), weighted((F.col("g") < 1).cast("double")).alias("_fast"))
    squares = gap.join(spread.select(*by, "_mu"), by).groupBy(*by).agg(F.sqrt(weighted((F.col("g") - F.col("_mu")) * (F.col("g") - F.col("_mu")))).alias("_sd"))
    n: Column = F.aggregate("actions", F.lit(0).cast("long"), lambda s, v: s + v)
    g = state.withColumn("n_events", n).join(spread, by, "left").join(squares, by, "left")
    share = lambda c, i, name: (F.col(c)[i] / F.col("n_events")).alias(name)
    g = g.select(
        *by, "n_events", *(share("actions", i, c) for i, c in enumerate(("frac_B", "frac_R", "frac_A"))), *(share("hours", h, f"hour_{h}") for h in range(24)),
        F.col("week")[0].cast("double").alias("_week"), F.col("week")[1].cast("double").alias("_end"), "_q", "_mu", "_sd", "_fast",
        F.col("days").alias("_days"), F.date_diff(F.to_date(timed(F.col("last"))), F.to_date(timed(F.col("first")))).alias("_span"), F.col("seconds").alias("n_distinct_ts"),
    )
    return _features(g, by)


def keep_up(spark: SparkSession, stream: DataFrame, by: list[str], out: str, checkpoint: str) -> DataFrame:
    """Fold a stream of events (`by`, ts, action, event_id) into the states below `out`, until what is there is read.

    Each batch writes all states to a folder of its own, which a retry overwrites, and drops the one before the last;
    so there are never small files to merge, and a rerun takes up where the last one ended. Returns the states."""

    def add(batch: DataFrame, batch_id: int) -> None:
        new = states(batch, by)
        before = _version(spark, out, batch_id)
        if before is not None:
            new = fold(spark.read.parquet(f"{out}/upto={before}"), new, by)
        new.write.mode("overwrite").parquet(f"{out}/upto={batch_id}")
        if before is not None and (oldest := _version(spark, out, before)) is not None:
            discard(spark, f"{out}/upto={oldest}")

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/upto={_version(spark, out, 1 << 62)}")


def _version(spark: SparkSession, out: str, below: int) -> int | None:
    """The last finished batch before `below`."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/upto=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return max((n for f in found if (n := int(f.getPath().getParent().getName().removeprefix("upto="))) < below), default=None)
