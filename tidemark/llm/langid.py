"""Language identification by interpolated Kneser-Ney character models.

One model a language, all in one set of sorted hash arrays: for each order the sorted 64-bit hashes of the
n-grams that any language has seen, beside a log probability for each language, and the sorted hashes of
their contexts beside the back-off weights. Counting is a Spark job over a bounded, hash-chosen sample of
labelled rows (`rows_per_language`); a disjoint sample calibrates the confidence and the rejection. A text goes
to the language of the lowest cross-entropy per character; it is rejected if that lies further above what the
language's own texts of such a length show than any calibration text did, with a margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import PLACES, Stream, groups
from .common import fresh, unit_hash

ORDER = 5
#: Bounds of the fit: expected rows for each language, for counting and for calibration.
ROWS_PER_LANGUAGE, CALIBRATION_ROWS = 1000, 300
#: Unseen characters share the last back-off evenly over this many code points.
CODE_POINTS = 1 << 16
#: Margin over the worst calibration text, and the least deviation, in standard deviations, that rejects.
MARGIN, LEAST = 1.5, 8.0
NO_LANGUAGE = "und"


@dataclass
class Model:
    languages: list[str]
    order: int
    keys: list[np.ndarray]  # by order - 1: sorted hashes of n-grams
    logp: list[np.ndarray]  # float32, a column for each language
    context_keys: list[np.ndarray]  # by order - 1: sorted hashes of the n - 1 characters before
    log_backoff: list[np.ndarray]
    log_floor: np.ndarray
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None  # by language: variance = spread[0] + spread[1] / characters
    limit: float = np.inf
    temperature: float = 1.0

    def log_probabilities(self, stream: Stream) -> np.ndarray:
        """float32, (scored places, languages)."""
        out = np.zeros((len(stream.scored), len(self.languages)), dtype=np.float32)
        todo = np.arange(len(out))
        for n in range(self.order, 0, -1):
            if not len(todo):
                return out
            found, at = _find(self.keys[n - 1], stream.hashes(n)[todo])
            out[todo[found]] += self.logp[n - 1][at[found]]
            todo = todo[~found]
            found, at = _find(self.context_keys[n - 1], stream.hashes(n, skip=1)[todo])
            out[todo[found]] += self.log_backoff[n - 1][at[found]]
        out[todo] += self.log_floor
        return out

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a character for each text and language, and the number of scored characters."""
        stream = Stream(texts, self.order)
        n = np.bincount(stream.doc, minlength=len(texts))
        return -stream.sums(self.log_probabilities(stream)) / np.maximum(n, 1)[:, None], n

    def confidences(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(n)[:, None] / self.temperature
        return 1 / np.exp(-gap).sum(axis=1)

    def deviations(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        best = entropy.argmin(axis=1)
        sd = np.sqrt(self.spread[best, 0] + self.spread[best, 1] / np.maximum(n, 1))
        return (entropy.min(axis=1) - self.mean[best]) / sd


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return (keys[at] == wanted if len(keys) else np.zeros(len(wanted), dtype=bool)), at


def _sampled(docs: DataFrame, text_col: str, lang_col: str, key: Column, low: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose hash falls in the share for `rows` expected rows of their language after the first `low`."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), unit_hash(key).alias("u"))
    share = F.broadcast(known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("lang", "language"))  # a row for each language
    held = known.join(share, F.col("lang") == F.col("language"))
    # a language of few rows gives a quarter of them to calibration
    first = F.least(F.lit(float(low)) / F.col("n"), F.lit(0.75))
    total = F.least(F.lit(float(low + rows)) / F.col("n"), F.lit(1.0))
    return held.filter(F.col("u") < first).select("lang", "text"), held.filter((F.col("u") >= first) & (F.col("u") < total)).select("lang", "text")


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): how often each n-gram of `order` characters occurs; \\0 stands for a run of other characters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, 1):
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lang in dict.fromkeys(langs):
                stream = Stream([t for t, x in zip(texts, langs, strict=True) if x == lang], order)
                _, first, n = np.unique(stream.hashes(order), return_index=True, return_counts=True)
                at = stream.scored[first]
                points = np.stack([stream.code[at - k] for k in range(order - 1, -1, -1)], axis=1).astype(np.uint32) if len(at) else np.zeros((0, order), np.uint32)
                text = points.tobytes().decode("utf-32-le", "surrogatepass")
                grams = [text[i : i + order] for i in range(0, len(text), order)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return rows.mapInArrow(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _model(counts: pa.Table, order: int) -> Model:
    """Interpolated Kneser-Ney over the counts of the highest order; lower orders use continuation counts."""
    names = np.array(counts.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(names))
    if not languages:
        return Model([], order, [], [], [], [], np.zeros(0, np.float32))
    grams = counts.column("gram").to_pylist()
    points = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, order).astype(np.uint64)
    lang = np.searchsorted(languages, names)
    n_langs = len(languages)
    levels = []  # by order: (points, language, count), a row for each n-gram of a language
    count = counts.column("n").to_numpy().astype(np.float64)
    for n in range(order, 0, -1):
        levels.append((points, lang, count))
        tail = points[:, 1:]
        if n > 1:  # distinct left extensions
            _, first, number = np.unique(_hash(tail) * np.uint64(n_langs * 2 + 1) + lang.astype(np.uint64), return_index=True, return_counts=True)
            points, lang, count = tail[first], lang[first], number.astype(np.float64)
    levels.reverse()
    keys, logp, context_keys, log_backoff = [], [], [], []
    lower = None
    floor = np.zeros(n_langs)
    for n, (points, lang, count) in enumerate(levels, 1):
        gram, context = _hash(points), _hash(points, skip=1)
        once, twice = (np.bincount(lang[count == k], minlength=n_langs) for k in (1, 2))
        discount = np.where(once > 0, np.clip(once / np.maximum(once + 2 * twice, 1), 0.05, 0.95), 0.5)  # by language
        kinds, where = np.unique(context, return_inverse=True)
        total, types = np.zeros((len(kinds), n_langs)), np.zeros((len(kinds), n_langs))
        np.add.at(total, (where, lang), count)
        np.add.at(types, (where, lang), 1)
        backoff = np.where(total > 0, discount * types / np.maximum(total, 1), 1.0)
        key, first, at = np.unique(gram, return_index=True, return_inverse=True)
        own = np.zeros((len(key), n_langs))
        np.add.at(own, (at, lang), np.maximum(count - discount[lang], 0))
        home = where[first]
        below = np.full((len(key), n_langs), 1 / CODE_POINTS) if lower is None else lower(points[first])
        p = own / np.maximum(total[home], 1) + backoff[home] * below
        if n == 1:
            floor = np.log(backoff[0] / CODE_POINTS)
        keys.append(key)
        logp.append(np.log(p).astype(np.float32))
        context_keys.append(kinds)
        log_backoff.append(np.log(backoff).astype(np.float32))

        def lower(points: np.ndarray, key=key, p=p) -> np.ndarray:
            return p[np.searchsorted(key, _hash(points[:, 1:]))]  # each n-gram's tail has been counted one order below

    # the empty context is not looked up again: its weight is in the floor
    context_keys[0], log_backoff[0] = context_keys[0][:0], log_backoff[0][:0]
    return Model(languages, order, keys, logp, context_keys, log_backoff, floor.astype(np.float32))


def _hash(points: np.ndarray, skip: int = 0) -> np.ndarray:
    """As Stream.hashes: place 0 is the last character."""
    out = np.zeros(len(points), dtype=np.uint64)
    for k in range(skip, points.shape[1]):
        out += points[:, points.shape[1] - 1 - k] * PLACES[k]
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", *, key: Column | None = None, order: int = ORDER, rows_per_language: int = ROWS_PER_LANGUAGE, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Fit on the rows of `docs` that have text and language, chosen by the hash of `key` (default: the text)."""
    key = F.col(text_col) if key is None else key
    rows, calibration = _sampled(docs, text_col, lang_col, key, rows_per_language, calibration_rows)
    model = _model(gram_counts(rows, order).toArrow(), order)
    if not model.languages:
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups(batches, 1):
            entropy, n = shared.value.cross_entropies(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(list(entropy), pa.list_(pa.float64()))], names=["lang", "n", "entropy"])

    # a bounded number of rows: calibration_rows for each language
    seen = calibration.mapInArrow(measure, "lang string, n bigint, entropy array<double>").filter("n > 0").toArrow().to_pylist()
    _calibrate(model, [(x["lang"], x["n"], x["entropy"]) for x in seen])
    return model


def _calibrate(model: Model, seen: list[tuple]) -> None:
    """Mean and spread of each language's own texts by length, the rejection limit and the temperature."""
    size = len(model.languages)
    model.mean, model.spread = np.zeros(size), np.tile([0.05, 5.0], (size, 1))
    if not seen:
        model.mean += np.log(CODE_POINTS)
        return
    n = np.array([x[1] for x in seen], dtype=np.float64)
    entropy = np.array([x[2] for x in seen])
    truth = np.array([model.languages.index(x[0]) if x[0] in model.languages else -1 for x in seen])
    for j in range(size):
        mine = (truth == j) & (entropy.argmin(axis=1) == j)
        if mine.sum() < 3:
            model.mean[j] = entropy[:, j].mean() + 1.0
            continue
        e, w = entropy[mine, j], n[mine]
        model.mean[j] = mean = np.average(e, weights=np.minimum(w, 2000))
        design = np.stack([np.ones_like(w), 1 / w], axis=1)
        a, b = np.linalg.lstsq(design, (e - mean) ** 2, rcond=None)[0]
        model.spread[j] = max(a, 1e-3), max(b, 0.5)
    own = entropy.argmin(axis=1) == truth
    if own.any():
        model.limit = max(LEAST, MARGIN * model.deviations(entropy[own], n[own]).max())
    right = np.maximum(truth, 0)

    def loss(t: float) -> float:
        gap = -(entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt(n)[:, None] / t
        return -np.mean(gap[np.arange(len(n)), right] - np.log(np.exp(gap).sum(axis=1)))

    model.temperature = min((0.3, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred, score (0 to 1), cross_entropy (nats a character) and rejected after its columns.

    Null texts and texts without a letter are `und` with score 0 and rejected, as is everything if the model
    has no language. Other texts always get a language; `rejected` tells that it is none of them. Very long
    texts are read whole. An empty table gives no rows. Columns that bear one of the four names are replaced,
    except the text itself."""
    new = ("lang_pred", "score", "cross_entropy", "rejected")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in new and c != text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = fresh([*docs.columns, *new], "_text")
    width = len(docs.columns)
    frame = docs.withColumn(text, F.col(text_col).cast("string"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in groups(batches, width):
            if m.languages:
                entropy, n = m.cross_entropies(texts)
                some = n > 0
                best = np.array(m.languages, dtype=object)[entropy.argmin(axis=1)]
                confidence = np.where(some, m.confidences(entropy, n), 0.0)
                lowest = entropy.min(axis=1)
                off = m.deviations(entropy, n) > m.limit
            else:
                some = np.zeros(len(texts), dtype=bool)
                best, confidence, lowest, off = np.full(len(texts), NO_LANGUAGE, dtype=object), np.zeros(len(texts)), np.zeros(len(texts)), ~some
            out = [pa.array(np.where(some, best, NO_LANGUAGE), pa.string()), pa.array(confidence, pa.float64()), pa.array(np.where(some, lowest, 0.0), pa.float64()), pa.array(off | ~some, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(width)), *out], names=[*batch.schema.names[:width], *new])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return frame.mapInArrow(score, schema)
