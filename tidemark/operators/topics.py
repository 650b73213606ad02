"""Topics of documents by online variational Bayes, with the steps and rates of pyspark.ml's LDA, over all documents.

The built-in fit draws each step's documents with replacement, whatever its rate, so it learns from a sample; here the
documents are dealt to batches, and each batch has its step in every pass."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..session import scratch

#: A document's mixture has settled when its k numbers change by less than this on average.
SETTLED = 1e-3
#: Numbers of padded documents that are worked on at once.
BLOCK = 1_000_000
#: Rows of the sums that are no terms: of the mixtures' logarithms, of their number, of the number of documents.
LOGS, KNOWN, ALL = -1, -2, -3


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, to 1e-10."""
    y, below = x + 6, 1 / x
    for i in range(1, 6):
        below = below + 1 / (x + i)
    z = 1 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - below


def trigamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, to 1e-9."""
    y, below = x + 6, sum(1 / (x + i) ** 2 for i in range(6))
    z = 1 / (y * y)
    return 1 / y + z / 2 + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z * (1 / 30 - z * 5 / 66)))) + below


def logs(x: np.ndarray) -> np.ndarray:
    """The expected logarithms under Dirichlet laws, one in each row."""
    return digamma(x) - digamma(x.sum(axis=-1, keepdims=True))


def lifted(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)) of positive numbers, to 1e-8 of its size: by its series at x + 6, less six terms of 1 / (x + i)."""
    y, u = x + 5.5, x * (x + 5)
    z = 1 / (y * y)
    series = y * (1 + z * (1 / 24 - z * (37 / 5760 - z * (10313 / 2903040 - z * (5509121 / 1393459200)))))
    return series * np.exp((2 * x + 5) * (u * (-3 * u - 20) - 24) / (u * (u + 4) * (u + 6)))


@dataclass
class Topics:
    """Weights of terms (terms x k) and the prior of a document's mixture (k)."""

    terms: np.ndarray
    prior: np.ndarray

    def laws(self) -> np.ndarray:
        return np.ascontiguousarray(np.exp(logs(self.terms.T)).T)


def settle(e: np.ndarray, c: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """The mixtures' weights (documents x k) of padded documents: e their terms' laws, c the counts."""
    out, at = np.empty((len(c), len(prior))), np.arange(len(c))
    g, moves, n = np.ones_like(out), np.ones(len(c), bool), len(c)
    while n:
        t = lifted(g)  # a common factor cancels below
        new = t * np.matmul((c / (np.matmul(e, t[:, :, None])[:, :, 0] + 1e-100))[:, None, :], e)[:, 0, :] + prior
        if n < len(moves):  # a settled document stays, whatever stands beside it
            new = np.where(moves[:, None], new, g)
        moves &= np.abs(new - g).sum(axis=1) >= SETTLED * len(prior)
        g, n = new, np.count_nonzero(moves)
        if 4 * n <= 3 * len(moves):
            out[at] = g
            at, g, e, c, moves = at[moves], g[moves], e[moves], c[moves], moves[moves]
    return out


def mixtures(vectors: pa.StructArray, laws: np.ndarray, prior: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """The mixtures' weights of sparse count vectors, none (zeros) for those without a term. With `sums` (terms x k), each
    document's share in the terms' weights is added there. A document's result does not depend on the others."""
    k = len(prior)
    places, values = vectors.field("indices"), vectors.field("values")
    size = places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    places, values = (x.flatten().to_numpy(zero_copy_only=False) for x in (places, values))
    end = np.cumsum(size)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    weights, i = np.zeros((len(size), k)), 0
    while i < len(order):  # documents of about one length fill a block
        j = i + 1
        while j < len(order) and (j + 1 - i) * size[order[j]] * k <= BLOCK:
            j += 1
        rows, n = order[i:j], int(size[order[j - 1]])
        inside = np.arange(n) < size[rows][:, None]
        at = np.where(inside, (end - size)[rows][:, None] + np.arange(n), 0)
        ids, counts = np.where(inside, places[at], 0), np.where(inside, values[at], 0.0)
        e = laws[ids]
        weights[rows] = g = settle(e, counts, prior)
        if sums is not None:
            t = lifted(g)
            r = counts / (np.matmul(e, t[:, :, None])[:, :, 0] + 1e-100)
            known = ids[inside]
            for z in range(k):
                sums[:, z] += np.bincount(known, (r * t[:, z : z + 1])[inside], len(sums))
        i = j
    return weights


def dealt(counts: DataFrame, key: str, batches: int = 20) -> DataFrame:
    """The rows with `batch`, from 0, by hash of the key: a table in a folder for each batch, so a step reads its own alone."""
    path = scratch(counts.sparkSession, "topics")
    rows = counts.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int"))
    rows.write.partitionBy("batch").parquet(path)
    return counts.sparkSession.read.schema(rows.schema).parquet(path)


def fit(counts: DataFrame, width: int, k: int, passes: int, batches: int = 20, seed: int = 1, offset: float = 1024.0, decay: float = 0.51) -> Topics:
    """Topics of the sparse vectors `features` (of `width` terms) of a `dealt` table; priors of 1 / k, that of the mixtures
    is learned. Every document takes part once in each pass.

    A step settles the documents of its batch under the present laws, in tasks, and sums the terms' weights, a row for each
    term and task; the driver moves the laws towards the sums, as those of all documents, at the rate (offset + step) ** -decay."""
    spark, every = counts.sparkSession, counts.count()
    rng = np.random.default_rng(seed)
    topics = Topics(rng.gamma(100.0, 0.01, (width, k)), np.full(k, 1.0 / k))
    names = [f"s{z}" for z in range(k)]
    fields = StructType([StructField("place", IntegerType()), *(StructField(s, DoubleType()) for s in names)])
    for step in range(passes * batches):
        shared = spark.sparkContext.broadcast((topics.laws(), topics.prior))

        def summed(docs: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            laws, prior = shared.value
            sums, tail = np.zeros_like(laws), np.zeros((3, k))
            for batch in docs:
                g = mixtures(batch.column(0), laws, prior, sums)
                known = g[g[:, 0] > 0]
                tail += [logs(known).sum(axis=0), np.full(k, float(len(known))), np.full(k, float(len(g)))]
            some = np.flatnonzero(sums.any(axis=1))
            rows = np.vstack([sums[some] * laws[some], tail])
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, LOGS, KNOWN, ALL].astype(np.int32)), *(pa.array(x) for x in rows.T.copy())], ["place", *names])

        mine = counts.filter(F.col("batch") == step % batches).select("features")
        found = mine.mapInArrow(summed, fields).groupBy("place").agg(*(F.sum(s).alias(s) for s in names)).toArrow()
        shared.destroy()
        place, rows = found.column(0).to_numpy(), np.array([c.to_numpy() for c in found.columns[1:]]).T
        mean, known, here = (rows[place == x].sum(axis=0) for x in (LOGS, KNOWN, ALL))
        if known[0] == 0:  # no document with a term in this batch
            continue
        rate, total = (offset + step + 1) ** -decay, np.zeros_like(topics.terms)
        total[place[place >= 0]] = rows[place >= 0]
        topics = Topics((1 - rate) * topics.terms + rate * (total * every / here[0] + 1.0 / k), learned(topics.prior, mean / known, known[0], rate))
    return topics


def learned(prior: np.ndarray, mean: np.ndarray, n: float, rate: float) -> np.ndarray:
    """The prior after a part of Newton's step towards that under which mixtures have the given mean logarithms, unless it
    would leave the positive numbers."""
    slope = n * (mean - logs(prior))
    bend = -n * trigamma(prior)
    shift = (slope / bend).sum() / (1 / (n * trigamma(np.array([prior.sum()]))[0]) + (1 / bend).sum())
    new = prior - rate * (slope - shift) / bend
    return new if (new > 0).all() else prior


def shares(topics: Topics, counts: DataFrame, keep: list[str], name: str = "topics") -> DataFrame:
    """`keep` and the topic shares of each document of `features`, zeros for one without a term."""
    shared = counts.sparkSession.sparkContext.broadcast((topics.laws(), topics.prior))

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        laws, prior = shared.value
        for batch in batches:
            g = mixtures(batch.column(len(keep)), laws, prior)
            g /= np.maximum(g.sum(axis=1, keepdims=True), 1e-300)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, g.size + 1, g.shape[1], dtype=np.int32)), pa.array(g.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), lists], [*keep, name])

    return counts.select(*keep, "features").mapInArrow(given, StructType([*(counts.schema[c] for c in keep), StructField(name, ArrayType(DoubleType()))]))
