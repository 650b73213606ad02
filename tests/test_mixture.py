"""Mixtures of log-normal laws: functions against the standard library, the fit against numpy and planted laws."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import mixture as L
from tidemark.plans.policies import QUERIES


def test_normal_tail(spark):
    z = [0.0, 1e-9, 0.3, 1.0, 2.5, 5.0, 7.0, 7.08, 9.0, 20.0, 36.0, 40.0]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(z)], "i int, z double").orderBy("i").select(L.normal_tail(F.col("z"))).collect()]
    for x, p in zip(z, got, strict=True):
        assert p == pytest.approx(0.5 * math.erfc(x / math.sqrt(2)), rel=1e-8, abs=1e-300)
    both = spark.range(1).select(L.normal_between(F.lit(6.0), F.lit(6.1)), L.normal_between(F.lit(-6.1), F.lit(-6.0)), L.normal_between(F.lit(-1.0), F.lit(2.0))).first()
    expected = 0.5 * (math.erfc(6 / math.sqrt(2)) - math.erfc(6.1 / math.sqrt(2)))
    assert both[0] == pytest.approx(expected, rel=1e-8) and both[1] == pytest.approx(expected, rel=1e-8) and both[2] == pytest.approx(0.8185946141203637)


LAW = ((0.25, 0.75), (0.5, 3.0), (0.4, 0.6))


def plain_cdf(law, x):
    return sum(w * 0.5 * math.erfc(-(math.log(x) - m) / s / math.sqrt(2)) for w, m, s in zip(*law, strict=True))


def test_distribution_and_density(spark):
    law = [F.array(*map(F.lit, v)) for v in LAW]
    xs = [1e-3, 0.5, 1.0, 3.0, 20.0, 400.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in d.select("x", L.mixture_cdf(*law, F.col("x")).alias("p"), L.mixture_log_density(*law, F.col("x")).alias("l"), L.mixture_between(*law, F.col("x"), 2 * F.col("x")).alias("b")).collect():
        assert r.p == pytest.approx(plain_cdf(LAW, r.x), rel=1e-9, abs=1e-14)
        assert r.b == pytest.approx(plain_cdf(LAW, 2 * r.x) - plain_cdf(LAW, r.x), rel=1e-7, abs=1e-12)
        h = r.x * 1e-5
        if r.p > 1e-6 and 1 - r.p > 1e-6:
            assert math.exp(r.l) == pytest.approx((plain_cdf(LAW, r.x + h) - plain_cdf(LAW, r.x - h)) / (2 * h), rel=1e-4)
    assert spark.range(1).select(L.mixture_cdf(*law, F.lit(0.0))).first()[0] == 0


@pytest.fixture(scope="module")
def counts(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g, (w, m, s) in (("a", LAW), ("b", ((0.6, 0.4), (1.5, 4.5), (0.3, 0.5)))):
        k = rng.random(60_000) < w[0]
        minutes = np.floor(np.exp(np.where(k, rng.normal(m[0], s[0], len(k)), rng.normal(m[1], s[1], len(k)))) * 4) / 4
        v, n = np.unique(minutes, return_counts=True)
        rows += [(g, float(max(x, 1e-3)), float(x + 0.25), int(c)) for x, c in zip(v, n, strict=True)]
    return spark.createDataFrame(rows, "g string, lo double, hi double, n long").cache()


def plain_step(rows, w, m, s):
    """One step in numpy, by integrating each interval on a fine grid of the logarithm."""
    n = np.array([r.n for r in rows], float)
    edges = [(math.log(r.lo), math.log(r.hi)) for r in rows]
    r0, r1, r2 = np.zeros(len(w)), np.zeros(len(w)), np.zeros(len(w))
    ll = 0.0
    for (a, b), c in zip(edges, n, strict=True):
        z = np.linspace(a, b, 4001)
        z, h = (z[1:] + z[:-1]) / 2, (b - a) / 4000
        f = np.array([wk * np.exp(-(((z - mk) / sk) ** 2) / 2) / (sk * math.sqrt(2 * math.pi)) for wk, mk, sk in zip(w, m, s, strict=True)]) * h
        p = f.sum()
        r0, r1, r2 = r0 + c * f.sum(1) / p, r1 + c * (f * z).sum(1) / p, r2 + c * (f * z * z).sum(1) / p
        ll += c * math.log(p)
    return r0 / n.sum(), r1 / r0, np.sqrt(r2 / r0 - (r1 / r0) ** 2), ll


def test_a_step_equals_integration(spark, counts):
    few = counts.filter("g = 'a' and n > 150")
    laws = L.starts(few, ["g"], 2)
    was = laws.first()
    got = L.step(few, laws, ["g"]).first()
    w, m, s, ll = plain_step(few.collect(), was.weight, was.mu, was.sigma)
    assert got.weight == pytest.approx(w.tolist(), rel=1e-5) and got.mu == pytest.approx(m.tolist(), rel=1e-5) and got.sigma == pytest.approx(s.tolist(), rel=1e-4)
    assert got.log_likelihood == pytest.approx(ll, rel=1e-7)


def test_planted_laws_are_found_and_the_likelihood_rises(counts):
    laws, seen = L.starts(counts, ["g"], 2), []
    for i in range(5):
        laws = L.cut(L.step(counts, laws, ["g"]))
        seen.append({r.g: r.log_likelihood for r in laws.collect()})
    for g in "ab":
        assert all(y[g] >= x[g] - 1e-6 for x, y in zip(seen, seen[1:], strict=False))
    found = {r.g: r for r in L.fit(counts, ["g"], 2, 25).collect()}
    for g, law in (("a", LAW), ("b", ((0.6, 0.4), (1.5, 4.5), (0.3, 0.5)))):
        order = np.argsort(found[g].mu)
        for mine, true, close in zip((found[g].weight, found[g].mu, found[g].sigma), law, (0.02, 0.05, 0.05), strict=True):
            assert np.array(mine)[order] == pytest.approx(np.array(true), abs=close)


def test_mixture_queries(spark):
    sf = "/root/testdata/sf0.001"
    laws = QUERIES["p2c_mixture_baseline"](spark, sf).toPandas()
    assert np.allclose(laws.groupby(["platform", "ctx"]).weight.sum(), 1) and (laws.sigma > 0).all()
    taus = QUERIES["p3c_mixture_times"](spark, sf).toPandas()
    assert taus.u.between(0, 1).all() and 0.4 < taus.u.mean() < 0.6
    gain = QUERIES["p5c_mixture_gain"](spark, sf).toPandas()
    assert (gain.two >= gain.one - 0.02).all()
