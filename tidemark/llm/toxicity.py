"""Toxicity scores by a linear model over character n-grams scaled by naive Bayes log-count ratios.

A feature is whether a text holds a character n-gram (hashed to 2^HASH_BITS buckets). Class-wise document
counts of all buckets are a Spark aggregation over a bounded, hash-chosen sample of labelled rows; the buckets
of the largest chi-square stay, each scaled by its naive Bayes log-count ratio, and a logistic regression of
pyspark.ml is fitted to them, weighted back to the labelled rows' class shares. Scoring reads every whole text
once, beside a broadcast of `features` weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import Stream, groups
from .common import cut, fresh, unit_hash

ORDERS = (4, 5)
HASH_BITS = 22
FEATURES = 1 << 14
#: Bound of the fit: expected labelled rows of each class.
ROWS_PER_CLASS = 3000
#: Buckets in fewer sampled texts are no features; the ratio's smoothing; the regression's penalty and steps.
MIN_TEXTS, SMOOTHING, PENALTY, STEPS = 5, 1.0, 1e-4, 60
THRESHOLD = 0.3


@dataclass
class Model:
    buckets: np.ndarray  # sorted int64
    weights: np.ndarray  # of each bucket, ratio included
    intercept: float


def _buckets(stream: Stream) -> Iterator[np.ndarray]:
    for n in ORDERS:
        yield ((stream.hashes(n) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _present(texts: list[str], slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs; slot: by bucket, its feature or -1."""
    stream = Stream(texts, max(ORDERS))
    width = int(slot.max(initial=0)) + 1
    pairs = []
    for b in _buckets(stream):
        f = slot[b]
        on = f >= 0
        pairs.append(np.unique(stream.doc[on] * width + f[on]))
    pairs = np.unique(np.concatenate(pairs))
    return pairs // width, pairs % width


def _slots(buckets: np.ndarray) -> np.ndarray:
    slot = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    slot[buckets] = np.arange(len(buckets))
    return slot


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows_per_class: int) -> DataFrame:
    """(text, label, weight): expected `rows_per_class` rows of each class, weighted back to all labelled rows.

    The labels are thinned by the hash of their id before they meet a text, so what is broadcast is bounded."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1))
    counts = F.broadcast(known.groupBy("label").agg(F.count(F.lit(1)).alias("n")))  # two rows
    share = F.least(F.lit(1.0), F.lit(float(rows_per_class)) / F.col("n"))
    few = known.join(counts, "label").filter(unit_hash(F.col("id")) < share).select("id", "label", (1 / share).alias("weight"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), "id").select("text", "label", "weight")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, rows_per_class: int = ROWS_PER_CLASS, features: int = FEATURES) -> Model:
    """Fit on the texts of `docs` that `labels` marks 0 or 1 (other values and null ids are left out; a text that
    has several marks counts once for each).

    With one class only, or none, the model is the class share alone (a half without any row)."""
    rows = cut(sample(docs, labels, id_col, text_col, label_col, rows_per_class))
    classes = {x["label"]: (x["n"], x["w"]) for x in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).collect()}
    empty = Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    if len(classes) < 2:
        empty.intercept = {0: -7.0, 1: 7.0}[next(iter(classes))] if classes else 0.0
        return empty
    n0, n1 = classes[0][0], classes[1][0]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, 0):
            label = np.array(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
            stream = Stream(texts, max(ORDERS))
            pairs = np.unique(np.concatenate([(stream.doc << HASH_BITS) | b for b in _buckets(stream)]))
            bucket, toxic = pairs & ((1 << HASH_BITS) - 1), label[pairs >> HASH_BITS]
            kinds, where = np.unique(bucket, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.bincount(where, weights=toxic).astype(np.int64)), pa.array(np.bincount(where, weights=1 - toxic).astype(np.int64))], names=["bucket", "ones", "zeros"])

    counted = rows.select("text", "label").mapInArrow(grams, "bucket bigint, ones bigint, zeros bigint").groupBy("bucket").agg(F.sum("ones").cast("double").alias("a"), F.sum("zeros").cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    cross = a * (n0 - b) - b * (n1 - a)
    chi = cross * cross / ((a + b) * (n0 + n1 - a - b + 1))
    kept = counted.filter(a + b >= MIN_TEXTS).orderBy(chi.desc(), "bucket").limit(features).toArrow()
    if not kept.num_rows:
        empty.intercept = float(np.log(classes[1][1] / classes[0][1]))
        return empty
    kept = kept.sort_by("bucket")
    buckets, ones, zeros = (kept.column(c).to_numpy() for c in ("bucket", "a", "b"))
    p, q = ones + SMOOTHING, zeros + SMOOTHING
    ratio = np.log((p / (n1 + 2 * SMOOTHING)) / (q / (n0 + 2 * SMOOTHING)))
    shared = rows.sparkSession.sparkContext.broadcast(buckets)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = _slots(shared.value)
        for batch, texts in groups(batches, 0):
            doc, feature = _present(texts, slot)
            split = np.searchsorted(doc, np.arange(1, len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([x.astype(str).tolist() for x in np.split(feature, split)], pa.list_(pa.string()))], names=["label", "weight", "tokens"])

    tokens = rows.mapInArrow(present, "label int, weight double, tokens array<string>")
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(buckets))], inputCol="tokens", outputCol="raw")
    vectors = vectors.setBinary(True).setMinTF(0.0).transform(tokens)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(ratio), inputCol="raw", outputCol="features").transform(vectors)
    mean_weight = (classes[0][1] + classes[1][1]) / (n0 + n1)
    train = cut(scaled.select(F.col("label").cast("double").alias("label"), (F.col("weight") / mean_weight).alias("weight"), "features"))
    found = LogisticRegression(weightCol="weight", standardization=False, regParam=PENALTY, maxIter=STEPS).fit(train)
    return Model(buckets, found.coefficients.toArray() * ratio, float(found.intercept))


def score(docs: DataFrame, model: Model, text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score (0 to 1, higher: more likely toxic) and predicted (1 if score >= threshold) at the end.

    Null counts as the empty text, which gets the score of a text without any feature. Very long texts are
    read whole. An empty table gives no rows. Columns that bear one of the two names are replaced, except the
    text itself."""
    new = ("score", "predicted")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in new and c != text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = len(docs.columns)
    frame = docs.withColumn(fresh([*docs.columns, *new], "_text"), F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        slot = _slots(m.buckets)
        for batch, texts in groups(batches, width):
            margin = np.full(len(texts), m.intercept)
            if len(m.buckets):
                doc, feature = _present(texts, slot)
                margin += np.bincount(doc, weights=m.weights[feature], minlength=len(texts))
            s = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names[:width], *new])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return frame.mapInArrow(run, schema)
