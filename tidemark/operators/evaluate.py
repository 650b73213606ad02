"""Exact AUC, bootstrap intervals, rank and distribution tests."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..session import ROWS_A_TASK, cut, spread
from .quantiles import of_counts, quantiles
from .ranks import cumulative, midranks, numbered
from .sampling import draw, draws_along

#: Slim rows that a join of picks may broadcast.
BROADCAST_ROWS = 1_000_000
#: Picks that are drawn at once.
PICKS = 16_384


def auc(scored: DataFrame, by: list[str], score: str = "score", label: str = "y", weight: Column | None = None) -> DataFrame:
    """(by, auc): ties count half. Rows are first summed by score, so the ranking sees distinct scores."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    sums = scored.groupBy(*by, score).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("q"))
    ranked = cumulative(sums, by, score, ["q"])
    area = F.sum(F.col("p") * (F.col("below_q") + 0.5 * F.col("q")))
    return ranked.groupBy(*by).agg((area / F.nullif(F.sum("p") * F.sum("q"), F.lit(0)).cast("double")).alias("auc"))


def bootstrap_picks(accounts: DataFrame, key: str, label: str, draws: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """(b, label, slot), draws x accounts rows, each a slot picked by hash, and (key, label, slot): the numbers, from
    0, of the accounts of a label. The same draws for every scorer."""
    slots = numbered(accounts.select(key, label), [label], [F.col(key)], "slot").withColumn("slot", F.col("slot") - 1)
    n = F.broadcast(accounts.groupBy(label).agg(F.count(F.lit(1)).alias("n")))  # a row for each label
    # slots are few and slim, so adaptive execution would let one task draw all their picks
    dealt = slots.repartition(max(1, accounts.sparkSession.sparkContext.defaultParallelism), label, "slot")
    picks = dealt.join(n, label).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return picks.select("b", label, F.pmod(draw(seed, F.col("b"), F.col(label), F.col("slot")), F.col("n")).alias("slot")), slots


def all_picks(spark: SparkSession, n: int, draws: int, seed: str) -> DataFrame:
    """(b, slot), draws x n rows: each of n slots from 0 picks a slot by hash in each draw. Draws are dealt to as many
    tasks as keep each to some ROWS_A_TASK picks, and at least to the session's parallelism."""
    parts = min(draws, max(spark.sparkContext.defaultParallelism, -(-n * draws // ROWS_A_TASK)))

    def drawn(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                for first in range(0, n, PICKS):
                    slot = draws_along(f"{seed}|{b}|", first, min(n, first + PICKS)) % n
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), b, np.int32)), pa.array(slot)], ["b", "slot"])

    return spark.range(0, draws, 1, parts).mapInArrow(drawn, "b int, slot long")


def bootstrap_median(facts: DataFrame, key: str, value: str, draws: int, seed: str) -> DataFrame:
    """(b, m): the median of `value` over as many rows as there are, drawn with replacement; null values do not count,
    and a draw of nothing else has no row. `key` tells the rows apart.

    Picks are counted by value as they are drawn, and drawn once: the counts are kept before they are ranked."""
    slots = numbered(facts.select(key, value), [], [F.col(key)], "slot").select((F.col("slot") - 1).alias("slot"), F.col(value).alias("x"))
    found = picked(all_picks(facts.sparkSession, slots.count(), draws, seed), slots, ["slot"])
    counts = cut(found.filter("x is not null").groupBy("b", "x").agg(F.count(F.lit(1)).alias("w")))
    return of_counts(counts, ["b"], "x", "w", [0.5]).select("b", F.col("q")[0].alias("m"))


def picked(picks: DataFrame, facts: DataFrame, on: list[str], most: int = BROADCAST_ROWS) -> DataFrame:
    """Each pick with the facts of its slot. Picks stream past a hash table and are never sorted: of all facts, where
    these are `most` slim rows at most, else of the shuffle partition's."""
    return picks.join(F.broadcast(facts) if most and facts.count() <= most else facts.hint("shuffle_hash"), on)


def bootstrap_weights(accounts: DataFrame, key: str, label: str, draws: int, seed: str) -> DataFrame:
    """(b, key, w): accounts drawn with replacement within each label; the same draws for every scorer.

    Accounts of a label are numbered, and each slot of a draw picks a number by hash: draws x accounts rows,
    summed to weights before anything meets a score, in as many tasks as keep each to some ROWS_A_TASK of them."""
    picks, slots = bootstrap_picks(accounts, key, label, draws, seed)
    dealt = spread(picks, slots.count() * draws, label, "slot")
    weights = dealt.groupBy("b", label, "slot").agg(F.count(F.lit(1)).alias("w"))
    return picked(weights, slots, [label, "slot"], 0).select("b", key, "w")


def bootstrap_auc(scored: DataFrame, by: list[str], key: str, draws: int, seed: str, score: str = "score", label: str = "y") -> DataFrame:
    """(by, b, auc) under shared account draws. Picks are counted by score as they are drawn."""
    picks, slots = bootstrap_picks(scored.select(key, label).distinct(), key, label, draws, seed)
    facts = cut(scored.select(*by, key, label, score).join(slots, [key, label]).select(*by, label, "slot", score))
    drawn = picked(picks, facts, [label, "slot"]).groupBy(*by, "b", score, label).agg(F.count(F.lit(1)).alias("w"))
    return auc(drawn, [*by, "b"], score, label, F.col("w"))


def cohort_draws(scored: DataFrame, by: list[str], key: str, cohorts: dict[str, Column], draws: int, seed: str, score: str = "score", label: str = "y") -> DataFrame:
    """(cohort, by, b, auc) under shared account draws, for each cohort that a condition on the rows of `scored` makes.

    An account's weights in all draws are one vector, so a row is shipped once to its place along the scores and not once
    for each draw and cohort that has it. Rows are dealt by range of (by, score); a task walks its range in order and
    keeps sums of vectors: weights of both labels and the area inside the range. What lies in earlier ranges comes to
    that from a row for each range, cohort and draw."""
    picks, slots = bootstrap_picks(scored.select(key, label).distinct(), key, label, draws, seed)
    dealt = spread(picks, slots.count() * draws, label, "slot")
    lists = dealt.groupBy(label, "slot").agg(F.collect_list(F.col("b").cast("int")).alias("b"))  # some `draws` entries for each account

    def packed(batches):
        for batch in batches:
            b = batch.column(2)
            row = np.repeat(np.arange(len(b)), b.value_lengths().to_numpy(zero_copy_only=False))
            w = np.bincount(row * draws + b.flatten().to_numpy(zero_copy_only=False), minlength=len(b) * draws).reshape(len(b), draws)
            kind = "<u2" if w.max(initial=0) < 1 << 16 else "<u8"
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in w.astype(kind)], pa.binary())], [label, "slot", "w"])

    names = list(cohorts)
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(cohorts.values())), F.lit(0))
    weights = cut(lists.mapInArrow(packed, StructType([picks.schema[label], picks.schema["slot"], StructField("w", BinaryType())])).join(slots, [label, "slot"]).select(key, "w"))
    rows = scored.select(*by, key, F.col(score).cast("double").alias("_s"), (F.col(label) == 1).alias("_y"), mask.alias("_in")).join(weights, key).drop(key)
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, 1)
    rows = rows.repartitionByRange(parts, *by, "_s").sortWithinPartitions(*by, "_s").select(*by, "_s", "_y", "_in", "w")

    def areas(batches):
        at, first, last, below, area, total, ties = None, None, None, None, None, None, None

        def ended():  # the last ties of a range count, and its sums go out
            a = area + ties[0] * (2 * below + ties[1])
            p, q = total[0] + ties[0], below + ties[1]
            n = len(names) * draws
            columns = [pa.array([x] * n) for x in at] + [pa.array([first] * n), pa.array(np.repeat(names, draws).tolist()), pa.array(np.tile(np.arange(draws, dtype=np.int32), len(names)))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array(x.ravel()) for x in (p, q, a))], [*by, "first", "cohort", "b", "p", "q", "a"])

        for batch in batches:
            values = [batch.column(k).to_pylist() for k in range(len(by))]
            s, y, of = (batch.column(len(by) + k).to_numpy(zero_copy_only=False) for k in range(3))
            w = np.stack([np.frombuffer(x, "<u2" if len(x) == 2 * draws else "<u8") for x in batch.column(len(by) + 3).to_pylist()]).astype(np.int64)
            keys = list(zip(*values, strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(edges, edges[1:], strict=False):
                if keys[i] != at:
                    if at is not None:
                        yield ended()
                    at, first, last = keys[i], float(s[i]), s[i]
                    below, area, total, ties = (np.zeros(x, np.int64) for x in ((len(names), draws), (len(names), draws), (1, len(names), draws), (2, len(names), draws)))
                starts = np.flatnonzero(np.r_[True, s[i + 1 : j] != s[i : j - 1]])
                here = (of[i:j, None] >> np.arange(len(names)) & 1).astype(np.int64)
                for c in range(len(names)):
                    mine = w[i:j] * here[:, c, None]
                    p, q = (np.add.reduceat(np.where((y[i:j] == one)[:, None], mine, 0), starts, axis=0) for one in (True, False))
                    if s[i] == last:
                        p[0] += ties[0, c]
                        q[0] += ties[1, c]
                    else:
                        p, q = np.vstack([ties[0, c], p]), np.vstack([ties[1, c], q])
                    before = below[c] + np.cumsum(q, axis=0) - q
                    area[c] += (p[:-1] * (2 * before[:-1] + q[:-1])).sum(axis=0)
                    total[0, c] += p[:-1].sum(axis=0)
                    below[c] = before[-1]
                    ties[0, c], ties[1, c] = p[-1], q[-1]
                last = s[j - 1]
        if at is not None:
            yield ended()

    out = [*(rows.schema[c] for c in by), StructField("first", DoubleType()), StructField("cohort", StringType()), StructField("b", IntegerType()), *(StructField(c, LongType()) for c in "pqa")]
    sums = rows.mapInArrow(areas, StructType(out))
    keys = [*by, "cohort", "b"]
    earlier = F.coalesce(F.sum("q").over(Window.partitionBy(*keys).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = F.sum(F.col("a") / 2 + F.col("p") * F.col("_q"))
    drawn = sums.withColumn("_q", earlier).groupBy("cohort", *by, "b").agg(F.sum("p").alias("p"), F.sum("q").alias("q"), area.alias("a"))
    return drawn.filter("p > 0 or q > 0").select("cohort", *by, "b", (F.col("a") / F.nullif(F.col("p") * F.col("q"), F.lit(0)).cast("double")).alias("auc"))


def interval(x: str = "auc", level: float = 0.95) -> list[Column]:
    lo = (1 - level) / 2
    return [F.percentile(x, F.lit(lo)).alias("lo"), F.percentile(x, F.lit(1 - lo)).alias("hi")]


def recall_at_fpr(scored: DataFrame, rates: list[float], score: str = "score", label: str = "y") -> DataFrame:
    """(fpr, threshold, recall, flagged): the threshold is the negatives' 1 - fpr quantile; score >= threshold."""
    cuts = quantiles(scored.filter(F.col(label) == 0), [], score, [1 - r for r in rates])
    cuts = cuts.select(F.explode(F.arrays_zip(F.array(*map(F.lit, rates)).alias("fpr"), F.col("q").alias("threshold"))).alias("x")).select(F.col("x.fpr").alias("fpr"), F.col("x.threshold").alias("threshold"))
    over = (F.col(score) >= F.col("threshold")).cast("double")
    return scored.join(F.broadcast(cuts)).groupBy("fpr", "threshold").agg(F.avg(F.when(F.col(label) == 1, over)).alias("recall"), F.avg(F.when(F.col(label) == 0, over)).alias("flagged"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda s, v: s + v)


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + eps)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, rho): Pearson correlation of midranks."""
    rx = midranks(df, by, x).select(*by, x, F.col("midrank").alias("_rx"))
    ry = midranks(df, by, y).select(*by, y, F.col("midrank").alias("_ry"))
    return df.join(rx, [*by, x]).join(ry, [*by, y]).groupBy(*by).agg(F.corr("_rx", "_ry").alias("rho"))


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26 on erf; absolute error below 1e-7."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return 0.5 * (1 + F.signum(x) * erf)


def log_normal_density(x: Column, mu: Column, sigma: Column) -> Column:
    """Log density of a positive value."""
    z = (F.log(x) - mu) / sigma
    return -F.log(x) - F.log(sigma) - F.lit(0.9189385332046727) - z * z / 2


def mann_whitney(df: DataFrame, by: list[str], value: str, group: str) -> DataFrame:
    """(by, u, effect, p): group 1 against 0; tie-corrected normal p with continuity."""
    r = midranks(df, by, value)
    rows = df.join(r, [*by, value])
    m = rows.groupBy(*by).agg(F.sum((F.col(group) == 1).cast("double")).alias("m"), F.sum((F.col(group) == 0).cast("double")).alias("k"), F.sum(F.when(F.col(group) == 1, F.col("midrank"))).alias("r"))
    ties = r.groupBy(*by).agg(F.sum(F.pow(F.col("ties").cast("double"), F.lit(3.0)) - F.col("ties")).alias("t"))
    s = (m.join(ties, by) if by else m.join(F.broadcast(ties))).withColumn("u", F.col("r") - F.col("m") * (F.col("m") + 1) / 2)
    n = F.col("m") + F.col("k")
    sd = F.sqrt(F.col("m") * F.col("k") / 12 * ((n + 1) - F.col("t") / (n * (n - 1))))
    z = (F.abs(F.col("u") - F.col("m") * F.col("k") / 2) - 0.5) / sd
    return s.select(*by, "u", (2 * F.col("u") / (F.col("m") * F.col("k")) - 1).alias("effect"), F.least(F.lit(1.0), 2 * (1 - normal_cdf(z))).alias("p"))


def ks_uniform(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, ks): one-sample distance to the uniform law on 0 .. 1."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    r = cumulative(counts, by, value, ["c"])
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    r = r.join(F.broadcast(n), by) if by else r.join(F.broadcast(n))
    gap = F.greatest((F.col("below_c") + F.col("c")) / F.col("n") - F.col(value), F.col(value) - F.col("below_c") / F.col("n"))
    return r.groupBy(*by).agg(F.max(gap).alias("ks"))


def macro_f1(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """(by, macro_f1): a class that never occurs and is never predicted counts 0."""
    cells = (F.sum(((F.col(truth) == a) & (F.col(predicted) == b)).cast("double")).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1))
    c = df.groupBy(*(by or [])).agg(*cells)
    f1 = lambda tp, fp, fn: F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0.0)), F.lit(0.0))
    return c.select(*(by or []), ((f1(c.c11, c.c01, c.c10) + f1(c.c00, c.c10, c.c01)) / 2).alias("macro_f1"))


def guard(one: DataFrame, two: DataFrame, keys: list[str], value: str, tolerance: float = 5e-5) -> DataFrame:
    """(keys, gap, agrees): cells of two matrices; a cell that one of them lacks has no gap and does not agree."""
    both = one.select(*keys, F.col(value).alias("_x")).join(two.select(*keys, F.col(value).alias("_z")), keys, "full_outer")
    gap = F.abs(F.col("_x") - F.col("_z"))
    return both.select(*keys, gap.alias("gap"), F.coalesce(gap < tolerance, F.lit(False)).alias("agrees"))
