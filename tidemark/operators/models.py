"""Account classifiers on pyspark.ml."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ranks import numbered


def standardised(df: DataFrame, columns: list[str], reference: DataFrame) -> DataFrame:
    """Columns less the reference's mean over its population deviation; constants become 0."""
    stats = reference.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    z = lambda c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0)
    return df.join(F.broadcast(stats)).select(*(c for c in df.columns if c not in columns), *(z(c).alias(c) for c in columns))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """weight = n / (2 n_c)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return df.join(F.broadcast(n), label).join(F.broadcast(total)).withColumn("weight", F.col("_n") / (2.0 * F.col("_nc"))).drop("_nc", "_n")


def estimator(kind: str, rows: int, seed: int = 1):
    if kind == "lr":
        return LogisticRegression(weightCol="weight", regParam=1.0 / max(1, rows), standardization=False, maxIter=50)
    if kind == "gbt":
        return GBTClassifier(weightCol="weight", maxIter=20, maxDepth=3, stepSize=0.1, seed=seed)
    return RandomForestClassifier(weightCol="weight", numTrees=50, featureSubsetStrategy="sqrt", seed=seed)


def fit_score(train: DataFrame, test: DataFrame, columns: list[str], kind: str, key: str, label: str = "y") -> DataFrame:
    """(key, y, score): fit on one set of accounts, score another; scaling comes from the first."""
    both = [balanced(standardised(train, columns, train), label), standardised(test, columns, train)]
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    fitted = assembler.transform(both[0]).select("features", F.col(label).cast("double").alias("label"), "weight")
    fitted = cut(fitted)  # the fit reads it once a step
    model = estimator(kind, fitted.count()).fit(fitted)
    out = model.transform(assembler.transform(both[1]))
    return out.select(key, F.col(label).alias("y"), vector_to_array("probability")[1].alias("score"))


def fit_scores(fits: dict[tuple, tuple], names: list[str], key: str, label: str = "y", at_once: int = 8) -> DataFrame:
    """(names, key, y, score) of many fits (train, test, columns, kind); the driver only starts them side by side."""
    spark = next(iter(fits.values()))[0].sparkSession

    def one(item):
        values, (train, test, columns, kind) = item
        scored = fit_score(train, test, columns, kind, key, label)
        return cut(scored.select(*(F.lit(v).alias(n) for n, v in zip(names, values, strict=True)), *scored.columns))

    with ThreadPool(at_once) as pool:
        done = pool.map(inheritable_thread_target(spark)(one), fits.items(), chunksize=1)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def vectors(df: DataFrame, array_col: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(array_col, lambda x: x.cast("double"))))


# ---- sparse term features
def vocabulary(terms: DataFrame, accounts: DataFrame, key: str, term: str) -> DataFrame:
    """(term, place, idf) of the terms of the given accounts: places from 0 by falling number of accounts, equal ones
    by term; idf = ln((1 + accounts) / (1 + accounts with the term)) + 1."""
    ids = accounts.select(key).distinct()
    total = ids.agg(F.count(F.lit(1)).alias("_all"))
    df = terms.join(ids, key, "left_semi").groupBy(term).agg(F.count_distinct(key).alias("_df")).filter(F.col(term).isNotNull())
    placed = numbered(df, [], [-F.col("_df"), F.col(term)], "place").join(F.broadcast(total))
    return cut(placed.select(term, (F.col("place") - 1).cast("int").alias("place"), (F.log((1 + F.col("_all")) / (1 + F.col("_df")).cast("double")) + 1).alias("idf")))


def sparse_features(terms: DataFrame, accounts: DataFrame, words: DataFrame, key: str, term: str, count: str) -> DataFrame:
    """`accounts` with `features`: (1 + ln count) * idf of the terms in the vocabulary `words`, of length one; other
    terms are left out, and an account with none of them has the zero vector."""
    width = words.count()
    known = terms.join(words, term).select(key, "place", ((1 + F.log(F.col(count).cast("double"))) * F.col("idf")).alias("v"))
    rows = known.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "v"))).alias("t"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    rows = rows.select(key, F.transform("t", lambda x: x.place).alias("at"), F.transform("t", lambda x: x.v / F.col("norm")).alias("x"))
    packed = F.udf(lambda at, x: Vectors.sparse(width, at or [], x or []), VectorUDT())
    return accounts.join(rows, key, "left").withColumn("features", packed("at", "x")).drop("at", "x")


def sparse_fit_score(terms: DataFrame, train: DataFrame, test: DataFrame, key: str, term: str, count: str, label: str = "y") -> DataFrame:
    """(key, y, score): a balanced logistic law on sparse term features, vocabulary and idf of the training accounts
    alone; `terms` (key, term, count) holds both sets' terms. Fitted and applied without a column for each term."""
    words = vocabulary(terms, train, key, term)
    fitted = cut(sparse_features(terms, balanced(train, label), words, key, term, count).select("features", F.col(label).cast("double").alias("label"), "weight"))
    model = estimator("lr", fitted.count()).fit(fitted)
    out = model.transform(sparse_features(terms, test, words, key, term, count))
    return out.select(key, F.col(label).alias("y"), vector_to_array("probability")[1].alias("score"))
