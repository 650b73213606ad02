"""Mixtures of log-normal laws: distribution function, log density, and their fit to interval-censored gaps.

A law is three arrays, weight, mu and sigma, with an entry for each component. The fit is expectation maximisation
over counted intervals: what an interval adds to a component is its number of events times the component's share of
the interval and the first two moments of the logarithm inside it. Those are sums over counts, so events meet the
laws only as a row for each distinct interval of their group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Fixed values of the rational form of the normal tail by Hart (algorithm 5666), for |z| below 5 sqrt 2: numerator
#: and denominator by falling powers.
TAIL_OVER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_UNDER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
ROOT = math.sqrt(2 * math.pi)
#: Least scale of a component and least probability of an interval.
LEAST_SIGMA, LEAST = 1e-3, 1e-300


def _bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once; formulas that name it often stay small."""
    return F.transform(F.array(value), use)[0]


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0; the relative error is near 1e-14 up to 5 and below 1e-8 beyond."""

    def poly(c, z: Column) -> Column:
        out = F.lit(c[0])
        for k in c[1:]:
            out = out * z + k
        return out

    def tail(z: Column) -> Column:
        far = z + 0.65
        for k in (4, 3, 2, 1):
            far = z + F.lit(float(k)) / far
        e = F.exp(-z * z / 2)
        return F.when(z > 37, 0.0).when(z < 7.07106781186547, e * poly(TAIL_OVER, z) / poly(TAIL_UNDER, z)).otherwise(e / far / ROOT)

    return _bind(z, tail)


def normal_cdf(z: Column) -> Column:
    return _bind(z, lambda z: _bind(normal_tail(F.abs(z)), lambda t: F.when(z > 0, 1 - t).otherwise(t)))


def normal_between(a: Column, b: Column) -> Column:
    """P(a < Z <= b), both taken in the same tail, so that small differences keep their digits."""
    ends = F.struct(a.alias("a"), b.alias("b"))
    both = lambda x: F.struct(x.a.alias("a"), x.b.alias("b"), normal_tail(F.abs(x.a)).alias("s"), normal_tail(F.abs(x.b)).alias("t"))
    between = lambda x: F.when(x.a >= 0, x.s - x.t).when(x.b <= 0, x.t - x.s).otherwise(1 - x.s - x.t)
    return _bind(ends, lambda x: _bind(both(x), between))


def _laws(weight: Column, mu: Column, sigma: Column, of) -> Column:
    """`of` (weight, mu, sigma) for each component, as an array."""
    return F.transform(F.arrays_zip(weight.alias("w"), mu.alias("m"), sigma.alias("s")), lambda c: of(c.w, c.m, c.s))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def mixture_cdf(weight: Column, mu: Column, sigma: Column, x: Column) -> Column:
    """P(X <= x); 0 for x <= 0."""
    z = F.log(F.greatest(x.cast("double"), F.lit(1e-6)))
    return F.when(x <= 0, 0.0).otherwise(_sum(_laws(weight, mu, sigma, lambda w, m, s: w * normal_cdf((z - m) / s))))


def mixture_between(weight: Column, mu: Column, sigma: Column, lo: Column, hi: Column) -> Column:
    """P(lo < X <= hi), at least LEAST."""
    a, b = (F.log(F.greatest(x.cast("double"), F.lit(1e-6))) for x in (lo, hi))
    return F.greatest(_sum(_laws(weight, mu, sigma, lambda w, m, s: w * normal_between((a - m) / s, (b - m) / s))), F.lit(LEAST))


def mixture_log_density(weight: Column, mu: Column, sigma: Column, x: Column) -> Column:
    """log of the density at x > 0 (taken as 1e-8 below that), by the greatest component's logarithm."""
    z = F.log(F.greatest(x.cast("double"), F.lit(1e-8)))
    each = _laws(weight, mu, sigma, lambda w, m, s: F.log(w) - math.log(ROOT) - F.log(s) - z - (z - m) * (z - m) / (s * s) / 2)
    total = lambda v: F.array_max(v) + F.log(_sum(F.transform(v, lambda c: F.exp(c - F.array_max(v)))))
    return F.transform(F.array(each), total)[0]


def starts(counts: DataFrame, by: list[str], components: int) -> DataFrame:
    """(by, weight, mu, sigma): equal weights, means spread evenly over two deviations on each side of the group's
    mean logarithm, one deviation each."""
    middle = F.log((F.greatest("lo", F.lit(1e-6)) + F.col("hi")) / 2)
    n = F.sum("n")
    g = counts.withColumn("_z", middle).groupBy(*by).agg((F.sum(F.col("n") * F.col("_z")) / n).alias("_m"), (F.sum(F.col("n") * F.col("_z") * F.col("_z")) / n).alias("_q"))
    sd = F.greatest(F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0))), F.lit(0.1))
    at = [(-1 + 2 * k / (components - 1) if components > 1 else 0.0) for k in range(components)]
    return g.select(*by, F.array(*(F.lit(1.0 / components) for _ in at)).alias("weight"), F.array(*(F.col("_m") + a * sd for a in at)).alias("mu"), F.array(*(sd for _ in at)).alias("sigma"))


def _shares() -> Column:
    """What an interval says of each component, as an array<struct>."""
    a, b = F.col("_a"), F.col("_b")
    density = lambda z: F.exp(-z * z / 2) / ROOT

    def moments(x: Column) -> Column:
        """Mean and mean square of the standard variable inside (lo, hi), of probability p; beyond the law's digits
        an interval counts as its nearer end."""
        near = F.when(x.lo > 0, x.lo).otherwise(x.hi)
        first = (density(x.lo) - density(x.hi)) / x.p
        second = 1 + (x.lo * density(x.lo) - x.hi * density(x.hi)) / x.p
        lost = x.p < 1e-250
        return F.struct(x.p.alias("p"), F.when(lost, near).otherwise(first).alias("u"), F.when(lost, near * near).otherwise(second).alias("v"))

    def share(w: Column, m: Column, s: Column) -> Column:
        """The component's probability of the interval, and mean and mean square of the logarithm inside it."""
        ends = F.struct(((a - m) / s).alias("lo"), ((b - m) / s).alias("hi"))
        sized = lambda x: F.struct(x.lo.alias("lo"), x.hi.alias("hi"), F.greatest(normal_between(x.lo, x.hi), F.lit(LEAST)).alias("p"))
        whole = lambda x: F.struct((w * x.p).alias("p"), (m + s * x.u).alias("x"), (m * m + 2 * m * s * x.u + s * s * x.v).alias("xx"), m.alias("m"), s.alias("s"))
        return _bind(ends, lambda e: _bind(sized(e), lambda x: _bind(moments(x), whole)))

    return _laws(F.col("weight"), F.col("mu"), F.col("sigma"), share)


def step(counts: DataFrame, laws: DataFrame, by: list[str], shares: Column | None = None) -> DataFrame:
    """(by, weight, mu, sigma, log_likelihood): one step; the likelihood is that of the laws it began with."""
    # by position of the component, so all of a group's components are summed in one row
    x = counts.join(laws.select(*by, "weight", "mu", "sigma"), by)
    x = x.withColumns({name: F.log(F.greatest(F.col(c).cast("double"), F.lit(1e-6))) for name, c in (("_a", "lo"), ("_b", "hi"))})
    x = x.select(*by, "n", (_shares() if shares is None else shares).alias("c")).withColumn("p", F.greatest(_sum(F.transform("c", lambda c: c.p)), F.lit(LEAST)))
    each = x.select(*by, "n", "p", F.posexplode("c").alias("k", "c")).withColumn("r", F.col("n") * F.col("c.p") / F.col("p"))
    sums = each.groupBy(*by, "k").agg(
        F.sum("r").alias("r"), F.sum(F.col("r") * F.col("c.x")).alias("x"), F.sum(F.col("r") * F.col("c.xx")).alias("xx"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.log("p")).alias("ll"), F.first("c.m").alias("m"), F.first("c.s").alias("s"),
    )
    empty = F.col("r") < 1e-9
    mean = F.when(empty, F.col("m")).otherwise(F.col("x") / F.col("r"))
    spread = F.when(empty, F.col("s")).otherwise(F.sqrt(F.greatest(F.col("xx") / F.col("r") - mean * mean, F.lit(LEAST_SIGMA**2))))
    law = F.array_sort(F.collect_list(F.struct("k", (F.col("r") / F.col("n")).alias("w"), mean.alias("m"), spread.alias("s"))))  # an entry for each component
    found = sums.groupBy(*by).agg(law.alias("law"), F.max("ll").alias("log_likelihood"))
    part = lambda f: F.transform("law", lambda c: c[f])
    return found.select(*by, part("w").alias("weight"), part("m").alias("mu"), part("s").alias("sigma"), "log_likelihood")


def fit(counts: DataFrame, by: list[str], components: int = 2, steps: int = 30) -> DataFrame:
    """(by, weight, mu, sigma, log_likelihood) of every group of `counts` (by, lo, hi, n), all fitted side by side.

    The number of steps is fixed, so a group's law does not depend on the other groups; log_likelihood is that of
    the laws before the last step, which never lowers it. Intervals may overlap; hi is greater than lo."""
    laws, shares = starts(counts, by, components), _shares()
    for _ in range(steps):
        laws = cut(step(counts, laws, by, shares))  # a row for each group
    return laws


def minute_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, lo, hi, n): gaps counted by their censoring interval."""
    return cut(rows.groupBy(*by, "lo", "hi").agg(F.count(F.lit(1)).alias("n")))
