"""Quantiles against `percentile`, fold quantiles against each training set, one-to-one pairs against a walk."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantiles import quantiles, without_each_fold
from tidemark.plans.cohorts import length_pairs

LEVELS = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 1.0]


@pytest.mark.parametrize("by", [[], ["k"]])
def test_quantiles_equal_percentile(spark, by):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.choice([None, r.random(), float(r.randint(0, 3))])) for _ in range(300)] + [("one", 2.5), ("none", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    expected = d.filter("v is not null").groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, LEVELS))).alias("q"))
    assert sorted(map(str, quantiles(d, by, "v", LEVELS).collect())) == sorted(map(str, expected.collect()))
    assert [x.q for x in quantiles(d.filter("false"), by, "v", LEVELS).collect()] == ([] if by else [[None] * len(LEVELS)])


def test_a_million_distinct_values_stay_in_ranges(spark):
    d = spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_003).cast("double").alias("v"))
    got = quantiles(d, [], "v", [0.5, 0.99]).first().q
    assert got == d.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.99)))).first()[0]
    plan = quantiles(d, [], "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan.lower()


def test_quantiles_of_the_other_folds(spark):
    r = random.Random(4)
    rows = [(r.choice("ab"), r.randrange(3), float(r.randint(0, 9))) for _ in range(200)]
    d = spark.createDataFrame(rows, "k string, fold int, v double")
    got = {(x.k, x.fold): x.q for x in without_each_fold(d, ["k"], "v", "fold", [0.1, 0.5], 3).collect()}
    for k in "ab":
        for f in range(3):
            rest = d.filter((F.col("k") == k) & (F.col("fold") != f)).agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5)))).first()[0]
            assert got[k, f] == rest


def walked(rows, runs):
    """The same pairs by a walk along the line of accounts."""
    out = []
    for run in range(runs):
        line = sorted(rows, key=lambda x: (-x[2], x[1] == "op", hashlib.md5(f"{run}|{x[0]}".encode()).hexdigest(), x[0]))
        free, late = [], []
        for user, pop, n in line:
            if pop != "op":
                free.append((user, n))
            elif free:
                out.append((run, user, *free.pop(0), n))
            else:
                late.append((user, n))
        out += [(run, user, *f, n) for (user, n), f in zip(late, free, strict=False)]
    return sorted((run, m, c, min(a, b)) for run, m, c, a, b in out)


@pytest.mark.parametrize(("members", "controls", "longest"), [(30, 60, 9), (40, 25, 30), (20, 20, 3), (10, 0, 5), (0, 9, 5)])
def test_pairs_lose_no_member_while_controls_last(spark, members, controls, longest):
    r = random.Random(members)
    rows = [(i, "op" if i < members else "organic", r.randint(1, longest)) for i in range(members + controls)]
    v = spark.createDataFrame([*rows, (999, "other", 5)], "user long, pop string, n long")
    got = sorted(map(tuple, length_pairs(v, "pop", "op", "organic", "user", "n", 3).collect()))
    assert got == walked(rows, 3)
    for run in range(3):
        mine = [x for x in got if x[0] == run]
        assert len({x[1] for x in mine}) == len({x[2] for x in mine}) == len(mine) == min(members, controls)
