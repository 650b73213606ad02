"""Sparse term features and the model queries."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as V
from tidemark.operators import markov as K
from tidemark.operators import models as M
from tidemark.operators import topics as Z
from tidemark.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def terms(spark):
    rows = [("a", "x", 1), ("a", "y", 4), ("b", "x", 2), ("c", "z", 1), ("d", "new", 3), ("d", "x", 1), ("e", "new", 1), ("a", None, 1)]
    return spark.createDataFrame(rows, "user string, g string, n long")


def test_vocabulary_and_vectors_come_from_the_training_accounts(spark, terms):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "user string")
    words = M.vocabulary(terms, train, "user", "g")
    idf = {"x": math.log(4 / 3) + 1, "y": math.log(4 / 2) + 1, "z": math.log(4 / 2) + 1}
    got = {r.g: (r.place, r.idf) for r in words.collect()}
    assert {g: p for g, (p, _) in got.items()} == {"x": 0, "y": 1, "z": 2}
    assert {g: v for g, (_, v) in got.items()} == pytest.approx(idf)
    test = spark.createDataFrame([("d",), ("e",), ("f",), ("a",)], "user string")
    v = {r.user: r.features for r in M.sparse_features(terms, test, words, "user", "g", "n").collect()}
    assert {u: x.size for u, x in v.items()} == {"d": 3, "e": 3, "f": 3, "a": 3}
    assert v["d"].toArray().tolist() == [1.0, 0.0, 0.0] and v["e"].numNonzeros() == v["f"].numNonzeros() == 0  # terms unknown to the fit
    x, y = idf["x"], (1 + math.log(4)) * idf["y"]
    assert v["a"].toArray().tolist() == pytest.approx([x / math.hypot(x, y), y / math.hypot(x, y), 0.0])


def test_the_sparse_scorer_separates_planted_terms(spark):
    rows = [(u, f"t{(u * 7 + k) % 30}", 1 + k % 3) for u in range(120) for k in range(8)] + [(u, "mark", 2) for u in range(120) if u % 3 == 0]
    t = spark.createDataFrame(rows, "user long, g string, n long")
    a = spark.range(120).select(F.col("id").alias("user"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    s = M.sparse_fit_score(t, a.filter("user < 80"), a.filter("user >= 80"), "user", "g", "n")
    assert V.auc(s, []).first().auc > 0.95


@pytest.mark.parametrize("name", ["m1_logistic_profile", "m2_boosted_profile", "m3_forest_profile", "m7b_symbol_scorer", "m9_content_classifier", "m10_vector_classifier"])
def test_scores_of_a_model_query(spark, name):
    s = QUERIES[name](spark, SF).toPandas()
    assert len(s) and s.score.between(0, 1).all() and s.y.isin([0, 1]).all() and not s.duplicated(s.columns[0]).any()


def test_summaries_of_model_queries(spark):
    """Held-out figures lie in their ranges and in order; topic shares are a distribution of each document."""
    r = QUERIES["m5_in_platform_auc"](spark, SF).first()
    assert 0 <= r.lo <= r.auc <= r.hi <= 1
    r = QUERIES["m18_vector_cross_validation"](spark, SF).first()
    assert 0 <= r["mean"] <= 1 and r.sd >= 0
    rows = QUERIES["m8_topic_shares"](spark, SF).collect()
    assert len({x.doc_id for x in rows}) == len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for x in rows:  # a text without a known term has no share
        assert min(x.topics) >= 0 and (abs(sum(x.topics) - 1) < 1e-6 or sum(x.topics) == 0)


def test_fingerprints_equal_hashlib(spark):
    import hashlib

    for x in QUERIES["a13_fingerprints"](spark, SF).collect():
        with open(f"{SF}/{x.file}", "rb") as f:
            whole = f.read()
        assert (x.bytes, x.sha256) == (len(whole), hashlib.sha256(whole).hexdigest())


def test_refit_on_other_accounts(spark):
    s = QUERIES["m17c_refit_symbol_scorer"](spark, "/root/testdata/sf0.01").toPandas()
    assert set(zip(s.fit, s.target, strict=True)) == {(a, b) for a in "AB" for b in "AB"} and s.auc.between(0, 1).all()


def plain_tree(train, held, depth, symbols):
    """{(suffix, next): p} and the kept suffixes, by recursion over counted sequences."""
    from collections import Counter

    n, v = Counter(), Counter()
    for which, seqs in ((n, train), (v, held)):
        for s in seqs:
            for i, x in enumerate(s):
                for d in range(min(depth, i) + 1):
                    which[tuple(s[i - d : i]), x] += 1
    total, kinds = Counter(), Counter()
    for (s, _), c in n.items():
        total[s] += c
        kinds[s] += 1
    kept = set()

    def p(s, x):
        up = p(s[1:], x) if s else 1 / symbols
        return (n[s, x] + kinds[s] * up) / (total[s] + kinds[s]) if s in kept else up

    for d in range(depth + 1):
        for s in sorted({s for s, _ in [*n, *v] if len(s) == d}):
            if total[s] and (not s or s[1:] in kept):
                gain = 0.0
                for (t, x), c in v.items():
                    if t == s and s:
                        up = p(s[1:], x)
                        gain += c * (math.log((n[s, x] + kinds[s] * up) / (total[s] + kinds[s])) - math.log(up))
                if not s or not held or gain > 0:
                    kept.add(s)
    return kept, p


@pytest.mark.parametrize("grown", [False, True])
def test_context_tree_matches_recursion(spark, grown):
    import random

    r = random.Random(5)

    def sequence():
        s = []
        for _ in range(r.randint(1, 40)):
            s.append((s[-1] + s[-2]) % 3 if len(s) > 1 and r.random() < 0.8 else r.randrange(3))
        return s

    train, held, test = ([sequence() for _ in range(n)] for n in (12, 8 if grown else 0, 5))
    rows = [(f"{w}{i}", k, x, w) for w, seqs in (("train", train), ("held", held), ("test", test)) for i, s in enumerate(seqs) for k, x in enumerate(s)]
    d = spark.createDataFrame(rows, "user string, ts int, token int, kind string").withColumn("event_id", F.col("ts"))
    c = K.suffixes(d, ["user"], 3).cache()
    tree = K.context_tree(c.filter("kind <> 'test'"), [], 3, 4, F.col("kind") == "held" if grown else None)
    kept, p = plain_tree(train, held, 3, 4)
    mine = {tuple(map(int, filter(None, x.suffix.split(",")))) for t in tree for x in t.filter("kept").select("suffix").distinct().collect()}
    assert mine == kept
    got = K.context_score(c.filter("kind = 'test'"), tree, [], 4, "lp").groupBy("user").agg(F.avg("lp").alias("m")).collect()
    for x in got:
        s = test[int(x.user[4:])]
        assert x.m == pytest.approx(sum(math.log(p(tuple(s[max(0, i - 3) : i]), v)) for i, v in enumerate(s)) / len(s))


def test_scores_from_the_tables_match_scores_of_rows(spark):
    rows = [(f"{w}{i}", "a" if i % 2 else "b", k, (k * (i % 5 + 2) + i // 3) % 3, w) for w, n in (("train", 9), ("held", 6), ("test", 7)) for i in range(n) for k in range(1 + (i * 5) % 13)]
    d = spark.createDataFrame([*rows, ("rare", "b", 0, 2, "test"), ("alone", "c", 0, 1, "train")], "user string, pop string, ts int, token int, kind string").withColumn("event_id", F.col("ts"))
    c = K.suffixes(d, ["user"], 3).cache()
    got = {r["pop"]: r for r in K.nats(K.context_tree(c, ["pop"], 3, 4, F.col("kind") == "held", F.col("kind") == "test"), ["pop"], (1, 0)).collect()}
    x, train = c.filter("kind = 'test'"), c.filter("kind = 'train'")
    laws = {"tree": K.context_tree(c.filter("kind <> 'test'"), ["pop"], 3, 4, F.col("kind") == "held"), "order_1": K.context_tree(train, ["pop"], 1, 4), "order_0": K.context_tree(train, ["pop"], 0, 4)}
    for name, law in laws.items():
        x = K.context_score(x, law, ["pop"], 4, name)
    expected = x.groupBy("pop").agg(*((-F.avg(n)).alias(n) for n in laws)).collect()
    assert set(got) == {r["pop"] for r in expected} == {"a", "b"}
    for r in expected:
        assert [got[r["pop"]][n] for n in laws] == pytest.approx([r[n] for n in laws])


def test_the_tree_is_no_worse_than_order_one(spark):
    s = QUERIES["m19b_context_tree"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(s) == 2 and (s.tree <= s.order_0 + 0.05).all() and (s.tree <= s.order_1 + 0.05).all()


def plain_digamma(x: float) -> float:
    below = 0.0
    while x < 60:
        below, x = below + 1 / x, x + 1
    return math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - below


def plain_mixture(doc, law, prior):
    """The weights of one document {term: count} by loops, and its share in the terms' weights."""
    g = [1.0] * len(prior)
    while True:
        t = [math.exp(plain_digamma(x) - plain_digamma(sum(g))) for x in g]
        r = {w: c / sum(a * b for a, b in zip(t, law[w], strict=True)) for w, c in doc.items()}
        new = [t[z] * sum(x * law[w][z] for w, x in r.items()) + prior[z] for z in range(len(prior))]
        moved, g = sum(abs(a - b) for a, b in zip(new, g, strict=True)) / len(g), new
        if moved < 1e-3:
            t = [math.exp(plain_digamma(x)) for x in g]
            return g, {w: [t[z] * law[w][z] * c / sum(a * b for a, b in zip(t, law[w], strict=True)) for z in range(len(prior))] for w, c in doc.items()}


def test_topics_match_loops_over_every_document(spark):
    import random

    import numpy as np
    from pyspark.ml.linalg import Vectors, VectorUDT

    r, k, width, batches = random.Random(3), 3, 8, 4
    docs = {i: {w: float(r.randint(1, 4)) for w in range(width) if r.random() < (0.8 if w % 2 == i % 2 else 0.1)} for i in range(23)} | {23: {}}
    one = F.udf(lambda i: Vectors.sparse(width, docs[i]), VectorUDT())
    counts = Z.dealt(spark.range(24).repartition(3).select(F.col("id").alias("doc_id"), one("id").alias("features")), "doc_id", batches)
    of = {x.doc_id: x.batch for x in counts.select("doc_id", "batch").collect()}
    assert len(of) == 24 and set(of.values()) == set(range(batches))
    got = Z.fit(counts, width, k, 2, batches, seed=4)
    terms, prior = np.random.default_rng(4).gamma(100.0, 0.01, (width, k)), np.full(k, 1 / k)
    for step in range(2 * batches):
        law = [[math.exp(plain_digamma(terms[w, z]) - plain_digamma(terms[:, z].sum())) for z in range(k)] for w in range(width)]
        mine = [docs[i] for i in docs if of[i] == step % batches]
        found = [plain_mixture(d, law, prior) for d in mine if d]
        rate, total = (1024 + step + 1) ** -0.51, np.zeros((width, k))
        for _, shares in found:
            for w, s in shares.items():
                total[w] += s
        terms = (1 - rate) * terms + rate * (total * 24 / len(mine) + 1 / k)
        mean = np.mean([[plain_digamma(x) - plain_digamma(sum(g)) for x in g] for g, _ in found], axis=0)
        prior = Z.learned(prior, mean, len(found), rate)
    assert got.terms == pytest.approx(terms, rel=1e-6) and got.prior == pytest.approx(prior, rel=1e-6) and got.prior.std() > 0
    law = [[math.exp(plain_digamma(terms[w, z]) - plain_digamma(terms[:, z].sum())) for z in range(k)] for w in range(width)]
    for x in Z.shares(got, counts, ["doc_id"]).collect():
        g = plain_mixture(docs[x.doc_id], law, prior)[0] if docs[x.doc_id] else [0.0] * k
        assert x.topics == pytest.approx([a / (sum(g) or 1) for a in g], abs=1e-6)


def test_a_document_settles_alike_alone_and_among_others():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    laws, prior = rng.gamma(1.0, 0.01, (50, 4)), np.array([0.1, 0.2, 0.3, 0.4])
    docs = [sorted(rng.choice(50, n, replace=False)) for n in (1, 40, 0, 3, 17, 17, 50, 2)]
    vectors = lambda some: pa.array([{"indices": list(map(int, d)), "values": [1.0 + i % 3 for i in range(len(d))]} for d in some])
    every = Z.mixtures(vectors(docs), laws, prior)
    assert [w.tolist() for w in every] == [pytest.approx(Z.mixtures(vectors([d]), laws, prior)[0].tolist(), rel=1e-9) for d in docs]
    assert not every[2].any() and every[[0, 1, 3]].sum(axis=1) == pytest.approx([1 + prior.sum(), 79 + prior.sum(), 6 + prior.sum()])


def test_every_document_has_its_part_in_the_topics(spark, tmp_path):
    names = "alpha bravo charlie delta echo foxtrot golf hotel".split()
    rows = [(i, " ".join(w for j, w in enumerate(names) for _ in range((8 - j) * (1 + (i * 7 + j * j) % 5)))) for i in range(120)]
    found = []
    for which, more in (("one", ""), ("other", " alpha" * 50)):
        table = [(i, text + (more if i == 7 else "")) for i, text in rows]
        spark.createDataFrame(table, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{which}/documents.parquet")
        found.append({x.doc_id: x.topics for x in QUERIES["m8_topic_shares"](spark, f"{tmp_path}/{which}").collect()})
    one, other = found
    assert all(max(abs(a - b) for a, b in zip(one[i], other[i], strict=True)) > 1e-9 for i in range(120))
