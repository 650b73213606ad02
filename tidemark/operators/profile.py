"""The account profile and its parts: where, when and how fast an account acts.

One window (previous event of the account) and one aggregation over the same key, so one shuffle serves all 41
features. Distinct days and seconds are counted as changes along the sorted events, not by COUNT DISTINCT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-9
#: Inclusive hour ranges (UTC) of the three masses.
MASSES = {"moscow_mass": (6, 15), "night_mass": (0, 5), "evening_mass": (15, 20)}
#: Feature groups for ablation.
GROUPS = {
    "G0": ["frac_B", "frac_R", "frac_A"],
    "G1": [*(f"hour_{h}" for h in range(24)), *MASSES, "hour_entropy", "top6h_mass"],
    "G2": ["weekday_ratio", "day_density", "per_day"],
    "G3": ["median_gap_min", "p90_gap_min", "burstiness", "frac_gap_under_1min"],
    "G4": ["n_events", "n_distinct_ts"],
}


def timed(ts: Column) -> Column:
    return F.timestamp_seconds(ts)


def entropy(shares: list[Column]) -> Column:
    """Natural log with EPS inside; a share of 0 adds 0."""
    total = F.lit(0.0)
    for p in shares:
        total = total - p * F.log(p + EPS)
    return total


def top_mass(shares: list[Column], k: int = 6) -> Column:
    return F.aggregate(F.slice(F.sort_array(F.array(*shares), asc=False), 1, k), F.lit(0.0), lambda s, x: s + x)


def profile(events: DataFrame, by: list[str], tie: str = "event_id") -> DataFrame:
    """One row for each `by` key of events (ts in seconds, action 0, 1 or 2): the 41 features."""
    order = Window.partitionBy(*by).orderBy("ts", tie)
    at = timed(F.col("ts"))
    e = events.withColumns({"_gap": (F.col("ts") - F.lag("ts").over(order)) / 60.0, "_day": F.to_date(at), "_hour": F.hour(at), "_wd": F.weekday(at)})
    e = e.withColumn("_new_day", F.coalesce((F.col("_day") != F.lag("_day").over(order)).cast("long"), F.lit(1)))
    one = lambda c: F.sum(c.cast("long")).cast("double")
    n = F.count(F.lit(1)).cast("double")
    gap = F.col("_gap")
    quantiles = F.percentile(gap, F.array(F.lit(0.5), F.lit(0.9)))
    g = e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"),
        *((one(F.col("action") == a) / n).alias(c) for a, c in ((0, "frac_B"), (1, "frac_R"), (2, "frac_A"))),
        *((one(F.col("_hour") == h) / n).alias(f"hour_{h}") for h in range(24)),
        one(F.col("_wd") < 5).alias("_week"), one(F.col("_wd") >= 5).alias("_end"),
        quantiles.alias("_q"), F.avg(gap).alias("_mu"), F.stddev_pop(gap).alias("_sd"),
        F.avg((gap < 1).cast("double")).alias("_fast"),
        F.sum("_new_day").alias("_days"), F.date_diff(F.max("_day"), F.min("_day")).alias("_span"),
        F.sum(F.coalesce((gap > 0).cast("long"), F.lit(1))).alias("n_distinct_ts"),
    )
    return _features(g, by)


def _features(g: DataFrame, by: list[str]) -> DataFrame:
    """The 41 features from an account's shares, counts and gap statistics."""
    hours = [F.col(f"hour_{h}") for h in range(24)]
    within = lambda lo, hi: sum((hours[h] for h in range(lo, hi + 1)), F.lit(0.0))
    weekday = F.when(F.col("_end") == 0, 5.0).otherwise(F.least(F.lit(5.0), (F.col("_week") / 5) / (F.col("_end") / 2 + EPS)))
    return g.select(
        *by, "frac_B", "frac_R", "frac_A", *hours,
        *(within(lo, hi).alias(name) for name, (lo, hi) in MASSES.items()),
        entropy(hours).alias("hour_entropy"), top_mass(hours).alias("top6h_mass"), weekday.alias("weekday_ratio"),
        F.coalesce(F.col("_q")[0], F.lit(0.0)).alias("median_gap_min"), F.coalesce(F.col("_q")[1], F.lit(0.0)).alias("p90_gap_min"),
        F.coalesce((F.col("_sd") - F.col("_mu")) / (F.col("_sd") + F.col("_mu") + EPS), F.lit(0.0)).alias("burstiness"),
        F.coalesce(F.col("_fast"), F.lit(0.0)).alias("frac_gap_under_1min"),
        (F.col("_days") / (F.col("_span") + 1)).alias("day_density"), (F.col("n_events") / F.col("_days")).alias("per_day"),
        F.col("n_events").cast("long"), F.col("n_distinct_ts").cast("long"),
    )


def hour_shares(events: DataFrame, by: list[str]) -> DataFrame:
    """(by, hour, p): the share of each hour that occurs."""
    counts = events.groupBy(*by, F.hour(timed(F.col("ts"))).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*by, "hour", (F.col("n") / F.sum("n").over(Window.partitionBy(*by))).alias("p"))


def centroid(shares: DataFrame, cohort: str, account: str) -> DataFrame:
    """(cohort, hour, p): each account weighs the same, an hour that it lacks counts as 0."""
    accounts = shares.groupBy(cohort).agg(F.count_distinct(account).alias("accounts"))
    sums = shares.groupBy(cohort, "hour").agg(F.sum("p").alias("s"))
    return sums.join(F.broadcast(accounts), cohort).select(cohort, "hour", (F.col("s") / F.col("accounts")).alias("p"))


def design(df: DataFrame, columns: list[str], logged: list[str]) -> DataFrame:
    """log1p of the `logged` columns, null and NaN as 0."""
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return df.select(*(c for c in df.columns if c not in columns), *((F.log1p(value(c)) if c in logged else value(c)).alias(c) for c in columns))


def degenerate(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, degenerate): a column without two distinct values, or of zeros and nulls alone."""
    stats = df.agg(*(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns))
    entry = lambda c: F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(f"{c}.lo") == F.col(f"{c}.hi"), F.lit(True)).alias("degenerate"))
    return stats.select(F.explode(F.array(*map(entry, columns))).alias("x")).select("x.*")
