"""Embedding whitening by spectrum slicing.

The covariance of the distinct vectors is summed by Spark in whole numbers, so it is exact before it is rounded once
to doubles. Its leading eigenvalues are found one by one on that matrix (dimensions squared, whatever the number of
rows): a symmetric factorisation LDL' of the covariance minus a shift has as many positive pivots as there are
eigenvalues above the shift (Sylvester's law of inertia), so halving isolates the k-th eigenvalue; from the isolated
interval Rayleigh quotient iteration converges cubically; and counts just above and below the result certify that it
is number k. Vectors are projected, and their whitened covariance is summed again over all of them, by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release_memory

COMPONENTS = 16
#: Entries become floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries whose scaled value is not below this are no usable numbers.
LARGEST = float(1 << 52)
#: Rows multiplied at once.
BLOCK = 4096
_EPS = float(np.finfo(float).eps)


# ---- eigenvalues of one symmetric matrix ----


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric `a` lie above `shift`: the positive pivots of LDL' of a - shift I, with
    the diagonal pivoting of Bunch and Kaufman (pivots of one or two rows), so that the factors stay bounded."""
    m = np.array(a, dtype=float)
    m[np.diag_indices_from(m)] -= shift
    n, k, above = len(m), 0, 0
    tiny = _EPS * _EPS * (np.abs(m).max(initial=0.0) or 1.0)
    alpha = (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]

    while k < n:
        two = False
        if k + 1 < n:
            column = np.abs(m[k + 1 :, k])
            r = k + 1 + int(column.argmax())
            most = column.max()
            if abs(m[k, k]) < alpha * most:
                row = np.abs(m[r, k:])
                row[r - k] = 0.0
                if abs(m[k, k]) * row.max() >= alpha * most * most:
                    pass
                elif abs(m[r, r]) >= alpha * row.max():
                    swap(k, r)
                else:
                    two = True
                    swap(k + 1, r)
        if two:
            # the off-diagonal entry leads such a block: one eigenvalue of each sign
            b, rest = m[k : k + 2, k : k + 2], m[k + 2 :, k : k + 2]
            det = b[0, 0] * b[1, 1] - b[0, 1] * b[1, 0]
            above += 1 if det < 0 else 2 if b[0, 0] + b[1, 1] > 0 else 0
            inverse = np.array([[b[1, 1], -b[0, 1]], [-b[1, 0], b[0, 0]]]) / det
            m[k + 2 :, k + 2 :] -= rest @ inverse @ rest.T
            k += 2
        else:
            pivot = m[k, k] if abs(m[k, k]) > tiny else -tiny
            above += pivot > 0
            if k + 1 < n and pivot != -tiny:
                m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k] / pivot, m[k + 1 :, k])
            k += 1
    return above


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the symmetric, non-negative `v`: `most` of them, or as
    many as lie above rounding error."""
    d = len(v)
    bound = float(np.abs(v).sum(axis=1).max(initial=0.0))
    floor = bound * _EPS * max(d, 16)
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = inertia(v, shift)
        return counts[shift]

    if bound == 0.0:
        return np.zeros(0), np.zeros((d, 0))
    found = min(most, above(floor))
    values, vectors = np.zeros(found), np.zeros((d, found))
    top = bound * (1 + 4 * _EPS) + floor
    for k in range(found):
        low, high = _isolate(above, k + 1, floor, top, counts)
        values[k], vectors[:, k] = _iterate(v, above, k + 1, low, high, vectors[:, :k], floor)
    return values, vectors


def _isolate(above, k: int, low: float, high: float, counts: dict[float, int]) -> tuple[float, float]:
    """An interval that holds eigenvalue k and no other, or is as narrow as rounding allows; starts from the counts
    that other eigenvalues have paid for."""
    low = max([s for s, c in counts.items() if c >= k], default=low)
    high = min([s for s, c in counts.items() if c < k], default=high)
    counts.setdefault(high, 0)
    while counts[low] - counts[high] > 1 and high - low > 4 * _EPS * max(abs(high), abs(low)):
        mid = (low + high) / 2
        if above(mid) >= k:
            low = mid
        else:
            high = mid
    return low, high


def _iterate(v: np.ndarray, above, k: int, low: float, high: float, done: np.ndarray, floor: float) -> tuple[float, np.ndarray]:
    """Eigenvalue k in [low, high] and its vector, orthogonal to those that are done.

    Inverse iteration at the interval's middle gives the start, Rayleigh quotients the rest. If the quotient leaves
    the interval or the counts beside it do not say k, the interval is halved and the iteration begins anew."""
    d, eye = len(v), np.eye(len(v))
    clear = lambda x: x - done @ (done.T @ x)
    for attempt in range(200):
        rng = np.random.default_rng(attempt)
        x = clear(rng.standard_normal(d))
        x /= np.linalg.norm(x)
        rho, least = (low + high) / 2, np.inf
        for turn in range(60):
            try:
                y = np.linalg.solve(v - rho * eye, x)
            except np.linalg.LinAlgError:
                y = np.linalg.solve(v - (rho + floor) * eye, x)
            y = clear(y / np.linalg.norm(y))
            y /= np.linalg.norm(y)
            y = clear(y)
            y /= np.linalg.norm(y)
            quotient = float(y @ v @ y)
            error = float(np.linalg.norm(clear(v @ y - quotient * y)))
            if turn > 3 and error > least / 2:
                break  # rounding error is reached
            x, r, least = y, quotient, error
            if turn >= 2:  # the first solves use the middle of the interval
                rho = r
        slack = 16 * floor
        if low - slack <= r <= high + slack and above(r - slack) >= k and above(r + slack) <= k - 1:
            return r, x
        if high - low <= 4 * _EPS * max(abs(high), abs(low)):
            return r, x  # eigenvalues that rounding cannot tell apart: any basis of theirs is right
        mid = (low + high) / 2
        low, high = (mid, high) if above(mid) >= k else (low, mid)
    raise ArithmeticError(f"eigenvalue {k} could not be certified")


# ---- vectors ----


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors, their sum, the leading eigenvalues and vectors of their covariance, and its trace."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n x - total, exact: in longs where they fit, else in Python's integers."""
        if len(x) == 0 or (int(np.abs(x).max()) * self.n + max(map(abs, self.total)) < 1 << 62):
            return x * self.n - np.array(self.total, dtype=np.int64)
        return x.astype(object) * self.n - np.array(self.total, dtype=object)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        """Whitened coordinates of n x - total."""
        return (deviations.astype(float) / self.n) @ (self.vectors / np.sqrt(self.values))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls, each of `width` entries, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def usable(df: DataFrame, vector_col: str) -> DataFrame:
    """Adds x (array<bigint>) and drops rows whose vector is null or holds entries that are null, not finite, or too
    large to be scaled."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) * SCALE >= F.lit(LARGEST))
    c = F.transform(vector_col, lambda e: e.cast("double"))
    df = df.withColumn("x", F.when(~F.exists(c, bad), c)).filter("x is not null")
    return df.withColumn("x", F.transform("x", lambda e: F.floor(e * SCALE).cast("bigint") + OFFSET))


def _sums(fit_list: DataFrame, width: int, centre: list[int]) -> tuple[int, list[int], np.ndarray]:
    """(rows, sum of x - centre, sum of their products), exact: products are multiplied in doubles while they stay
    below 2^53, then added as integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.array(centre, dtype=np.int64)
        rows, total, products = 0, np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        part, room = np.zeros((width, width), dtype=np.int64), 1 << 62
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for at in range(0, len(x), BLOCK):
                y = x[at : at + BLOCK] - shift
                largest = int(np.abs(y).max(initial=0))
                rows += len(y)
                if largest * largest * BLOCK < 1 << 53:
                    total += y.sum(axis=0)
                    if room < largest * largest * BLOCK:
                        products += part
                        part[:], room = 0, 1 << 62
                    z = y.astype(float)
                    part += (z.T @ z).astype(np.int64)
                    room -= largest * largest * BLOCK
                else:
                    z = y.astype(object)
                    total += z.sum(axis=0)
                    products += z.T @ z
        products += part
        if rows:
            i, j = np.triu_indices(width)
            text = [str(rows), *map(str, total), *map(str, products[i, j])]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(text))), pa.array(text)], names=["place", "v"])
        release_memory()

    # one row for each place of the upper triangle and task, summed to one for each place
    parts = fit_list.select("x").mapInArrow(run, "place long, v string")
    got = {r["place"]: int(r["v"]) for r in parts.groupBy("place").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v")).collect()}
    i, j = np.triu_indices(width)
    products = np.zeros((width, width), dtype=object)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        products[a, b] = products[b, a] = got.get(1 + width + k, 0)
    return got.get(0, 0), [got.get(1 + k, 0) for k in range(width)], products


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From the distinct vectors x (array<bigint> of one length); None if there are none."""
    first = fit_list.select("x").first()
    if first is None:
        return None
    width = len(first["x"])
    centre = [int(c) for c in first["x"]]  # any vector near the mean keeps products small; it is corrected exactly
    means = fit_list.agg(*(F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(width))).first() if width <= 256 else None
    if means is not None:
        centre = [round(m) for m in means]
    n, shifted, products = _sums(fit_list, width, centre)
    v = np.array([[float_ratio(n * products[i, j] - shifted[i] * shifted[j], n * n) for j in range(width)] for i in range(width)]).reshape(width, width)
    values, vectors = leading(v, min(components, width))
    trace = float_ratio(sum(n * products[i, i] - shifted[i] * shifted[i] for i in range(width)), n * n)
    return Whitening(n, [s + n * c for s, c in zip(shifted, centre, strict=True)], values, vectors, trace)


def float_ratio(a: int, b: int) -> float:
    """The double nearest to a / b."""
    return int(a) / int(b)


def identity_error(fit_list: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity, summed over all."""
    k = len(model.values)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, seen = np.zeros(k), np.zeros((k, k)), False
        for batch in batches:
            x = _matrix(batch.column(0), len(model.total))
            for at in range(0, len(x), BLOCK):
                w = model.project(model.deviations(x[at : at + BLOCK]))
                first += w.sum(axis=0)
                second += w.T @ w
                seen = True
        if seen:
            flat = np.concatenate([first, second.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "v"])
        release_memory()

    sums = fit_list.select("x").mapInArrow(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(k + k * k)
    for r in sums:
        flat[r["place"]] = r["v"]
    mean = flat[:k] / model.n
    return float(np.abs(flat[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, components: int = COMPONENTS) -> DataFrame:
    """(<id_col>, component, n, deviation, whitened, explained, identity_error): a row for each usable row of `df` and
    each component, up to `components`.

    Rows whose vector is null or holds a null, a value that is not finite or one of 2^46 or more are dropped, and so
    are those of another length than most usable vectors have (of equally frequent lengths the greater one counts).
    Entries become x = floor(64 c) + 1000000; each distinct x is fitted once, so repeated vectors weigh nothing extra.
    Components whose eigenvalue is zero but for rounding cannot be whitened and give no rows: fewer than two distinct
    vectors give none at all, as does an empty table. deviation is null where it does not fit a decimal of 38 digits.
    Null and repeated ids are rows like any other; columns that are not named are not read."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = usable(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("c")), "c").select("id", "x")
    lengths = rows.groupBy(F.size("x").alias("len")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("len")).first()
    width = lengths["len"] if lengths else 0
    rows = rows.filter(F.size("x") == width)
    fit_list = cut(rows.select("x").distinct()) if width else None
    model = fit(fit_list, components) if fit_list is not None else None
    names = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], names).withColumnRenamed("id", id_col)
    error = identity_error(fit_list, model)
    k = len(model.values)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            for at in range(0, len(x), BLOCK):
                d = model.deviations(x[at : at + BLOCK])
                if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * width >= 1 << 63:
                    d = d.astype(object)
                square = (d * d).sum(axis=1)
                deviation = [int(s) if int(s) < 10**38 else None for s in square] if d.dtype == object else square
                deviation = pa.array(deviation, pa.decimal128(38, 0)) if d.dtype == object else pa.array(square).cast(pa.decimal128(38, 0))
                m = len(d)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, m).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        deviation.take(each), pa.array(model.project(d).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                    ],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
        release_memory()

    return rows.mapInArrow(run, names).withColumnRenamed("id", id_col)
