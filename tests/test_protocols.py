"""Post features, side-by-side fits, guards and fold policies against hand values."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as V
from tidemark.operators import markov as K
from tidemark.operators import models as M
from tidemark.operators import posts as B


@pytest.fixture(scope="module")
def block(spark):
    text = "Hello WORLD again! #one @two http://www.nytimes.com/a?b=1 http://redd.it/x 42"
    rows = [(1, 1, text, 1704067200, 1), (2, 0, "", 1704067200 + 86400 * 5 + 3600 * 13, 0)]  # a Monday; a Saturday, 13 h
    ready = B.prepared(spark.createDataFrame(rows, "id int, y int, text string, ts long, is_reply int"))
    words = B.vocabulary(B.top_terms(B.class_counts(ready)))
    return {r["id"]: r.asDict() for r in B.features(ready, words, ["id"]).collect()}


def test_there_are_61_features(block):
    assert len(B.FEATURES) == len(set(B.FEATURES)) == 61
    assert set(block[1]) == {"id", *B.FEATURES}


def test_features_of_a_post(block):
    f = block[1]
    assert (f["words"], f["urls"], f["hashes"], f["ats"], f["bangs"], f["questions"], f["has_url"], f["is_reply"]) == (6, 2, 1, 1, 1, 1, 1, 1)
    assert f["word_length"] == pytest.approx((5 + 5 + 6 + 4 + 4 + 2) / 6)
    assert f["upper"] == pytest.approx(6 / 77) and f["digits"] == pytest.approx(3 / 77)
    assert (f["news"], f["social"], f["platform"], f["other"], f["tld_com"], f["top_domain_1"], f["top_domain_0"]) == (1, 0, 0, 0, 1, 1, 0)
    assert f["top_words_1"] == 1 and f["top_words_0"] == 0
    assert f["hour_0"] == 1 and f["weekday_0"] == 1 and sum(f[h] for h in B.HOURS) == sum(f[d] for d in B.WEEKDAYS) == 1


def test_features_of_an_empty_post(block):
    f = block[2]
    assert {k for k, v in f.items() if v and k != "id"} == {"hour_13", "weekday_5"}


def test_fits_side_by_side(spark):
    rows = spark.range(60).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.rand(1) / 2).alias("x"))
    train, test = rows.filter("id < 40"), rows.filter("id >= 40")
    s = M.fit_scores({("a", 1): (train, test, ["x"], "lr"), ("b", 2): (train, test, ["x"], "rf")}, ["name", "n"], "id")
    assert s.columns == ["name", "n", "id", "y", "score"]
    assert {(r["name"], r["n"], r["auc"]) for r in V.auc(s, ["name", "n"]).collect()} == {("a", 1, 1.0), ("b", 2, 1.0)}


def test_macro_f1_by_key(spark):
    d = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("b", 1, 0), ("b", 0, 0)], "k string, y int, f int")
    assert {r["k"]: round(r["macro_f1"], 6) for r in V.macro_f1(d, "y", "f", ["k"]).collect()} == {"a": 1.0, "b": round((0 + 2 / 3) / 2, 6)}


def test_guard_names_cells_that_differ_or_lack(spark):
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    two = spark.createDataFrame([("a", 1.00001), ("b", 2.1)], "k string, v double")
    assert {r["k"]: r["agrees"] for r in V.guard(one, two, ["k"], "v").collect()} == {"a": True, "b": False, "c": False}


def test_fold_policies_leave_their_fold_out(spark):
    moves = [("op", 1, 0, 4), ("op", 2, 1, 2), ("organic", 3, 0, 3), ("organic", 4, 1, 5)]
    rows = [(0, f, p, u, "0", int(p == "op"), n) for p, u, f, n in moves]
    counts = spark.createDataFrame(rows, "repeat int, fold int, pop string, user int, prev string, next int, n long")
    got = {r["user"]: r["llr"] for r in K.fold_ratios(counts, "pop", "op", "organic", 2, 2).collect()}
    # fold 0 is judged by fold 1's counts: op 2 of token 1, organic 5 of token 0
    assert got[1] == pytest.approx(math.log(3 / 4) - math.log(1 / 7))
    assert got[3] == pytest.approx(math.log(1 / 4) - math.log(6 / 7))


def test_sequences_cut_in_runs_match_sequences_repeated_for_runs(spark):
    from tidemark.operators import sequences as Q
    from tidemark.plans import protocols as R

    rows = [(u, 100 * u + k, (k * 7) % 11, (u * k + k // 2) % 3) for u in range(12) for k in range(1 + (u * 5) % 9)]
    placed = Q.positions(spark.createDataFrame(rows, "user long, event_id long, ts long, action long"), ["user"])
    chosen = spark.createDataFrame([(r, u, (u + r) % 2, (u * r) % 10) for r in range(4) for u in range(12) if (u + r) % 5], "run long, user long, y int, length long")
    inside = placed.drop("n").join(chosen, "user").filter((F.col("y") == 1) | (F.col("pos") < F.col("length")))
    expected = R.action_vectors(inside, ["run", "user", "y"])
    got = R.cut_vectors(placed, chosen)
    read = lambda d: sorted(tuple(r) for r in d.select("run", "user", "y", *R.CELLS).collect())
    assert read(got) == read(expected) and got.count() > 20
    # runs meet an account's list, not its events
    assert [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in x and "run" in x] == []


def test_draws_of_cohorts_match_weights_joined_to_every_row(spark):
    rows = [(f, m, u, u % 2, ((u * 7 + len(f) * 3) % 9) / 8.0 + (0.01 * u if m == "lr" else 0)) for f in ("one", "three") for m in ("lr", "gbt") for u in range(60)]
    scored = spark.createDataFrame(rows, "features string, model string, user long, y int, score double")
    cohorts = {"all": F.col("user") >= 0, "few": F.col("user") % 5 < 2, "none": F.col("user") < 0}
    got = V.cohort_draws(scored, ["features", "model"], "user", cohorts, 7, "t")
    # what is shipped along the scores has a row for each score, not for each draw
    weights = V.bootstrap_weights(scored.select("user", "y").distinct(), "user", "y", 7, "t")
    expected = {}
    for name, condition in cohorts.items():
        for r in V.auc(scored.filter(condition).join(weights, "user"), ["features", "model", "b"], weight=F.col("w")).collect():
            expected[name, r["features"], r["model"], r["b"]] = r["auc"]
    assert {tuple(r[c] for c in ("cohort", "features", "model", "b")): r["auc"] for r in got.collect()} == expected and len(expected) == 56
