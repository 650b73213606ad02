"""Exact deduplication by two-pass Bloom filtering.

Pass 1 reads 64-bit text hashes and marks, in a sliced Bloom filter with two planes, what was seen and what was
seen again: each worker fills its own planes, and planes meet slice by slice (seen again = either's `again`, or
both's `seen`). A repeated text has all its bits in `again`, so pass 2 finds every text that may repeat by
probing that plane; only those rows shuffle, and all others pass straight through as groups of one.

What repeats is settled by SHA-256 over the whole text, so the filter's false positives cost a shuffled row and
never a wrong answer. The filter takes `bits_per_row` bits a row up to `max_filter_bytes`, which bounds what is
broadcast; beyond that more rows shuffle, and results stay the same. Groups with more than 1/HOT_SHARE of all
rows are at most HOT_SHARE; they are joined by broadcast, so that a text held by a third of the rows loads no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, parallelism

SLICE_BITS = 1 << 16
BITS_PER_ROW = 16
MAX_FILTER_BYTES = 64 << 20
HOT_SHARE = 4096
#: In-slice bit positions come from these shifts of the hash; the slice comes from the 16 bits above them.
SHIFTS = (0, 16, 32)


def filter_slices(rows: int, bits_per_row: int = BITS_PER_ROW, max_filter_bytes: int = MAX_FILTER_BYTES) -> int:
    """A power of two, so that a slice is a few bits of the hash."""
    wanted = max(1, rows * bits_per_row // SLICE_BITS)
    return 1 << min((wanted - 1).bit_length(), (max_filter_bytes * 8 // SLICE_BITS).bit_length() - 1)


def _slice_of(h: str, slices: int) -> str:
    return f"cast(shiftrightunsigned({h}, 48) & {slices - 1} as int)"


def repeated_filter(hashes: DataFrame, slices: int, workers: int) -> DataFrame:
    """(slice int, words array<long>): the `again` plane over the one column `h` of 64-bit hashes."""
    words = SLICE_BITS // 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(slices * words, dtype=np.uint64)
        again = np.zeros(slices * words, dtype=np.uint64)

        def cells(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
            base = ((h >> np.uint64(48)) & np.uint64(slices - 1)) * np.uint64(words)
            at = [(h >> np.uint64(s)) & np.uint64(SLICE_BITS - 1) for s in SHIFTS]
            return [((base + (p >> np.uint64(6))).astype(np.int64), np.uint64(1) << (p & np.uint64(63))) for p in at]

        for batch in batches:
            h, n = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            bits = cells(h)
            old = np.ones(len(h), dtype=bool)
            for i, m in bits:
                old &= (seen[i] & m) != 0
            old |= n > 1
            for i, m in bits:
                np.bitwise_or.at(seen, i, m)
                np.bitwise_or.at(again, i[old], m[old])
        for k in range(slices):
            part = seen[k * words : (k + 1) * words]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary()), pa.array([again[k * words : (k + 1) * words].tobytes()], pa.binary())], names=["slice", "seen", "again"])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(words, dtype=np.uint64)
        again = np.zeros(words, dtype=np.uint64)
        for s, a in zip(rows["seen"], rows["again"], strict=True):
            s, a = np.frombuffer(s, np.uint64), np.frombuffer(a, np.uint64)
            again |= a | (seen & s)
            seen |= s
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "words": [again.view(np.int64).tolist()]})

    planes = hashes.coalesce(workers).mapInArrow(mark, "slice int, seen binary, again binary")
    return planes.groupBy("slice").applyInPandas(meet, "slice int, words array<bigint>")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits_per_row: int = BITS_PER_ROW, max_filter_bytes: int = MAX_FILTER_BYTES, workers: int | None = None) -> DataFrame:
    """`docs` with keep_id, group_size (long), kept (boolean) and text_sha256 (lowercase hex) after its columns.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id stays; a
    null id is smaller than any other. Rows that repeat both id and text count in group_size and are all kept
    if that id is the kept one (tell them apart by another id column to drop them). An empty table gives no
    rows. Columns of `docs` that bear one of the four names are replaced."""
    new = ("keep_id", "group_size", "kept", "text_sha256")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in new and c not in (id_col, text_col)))
    spark, taken = docs.sparkSession, [*docs.columns, *new]
    h, sha, maybe, key, hot_n, hot_id = (fresh(taken, f"_{x}") for x in ("h", "sha", "maybe", "key", "hot_n", "hot_id"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.count()
    slices = filter_slices(rows, bits_per_row, max_filter_bytes)
    planes = repeated_filter(docs.select(F.xxhash64(text).alias("h")), slices, workers or 2 * parallelism(spark))
    again = F.broadcast(cut(planes).select(F.col("slice").alias(f"{h}_slice"), F.col("words").alias(f"{h}_words")))

    hashed = docs.withColumn(h, F.xxhash64(text))
    probed = hashed.join(again, F.expr(f"{_slice_of(h, slices)} = {h}_slice"), "left")
    bits = " and ".join(f"getbit({h}_words[cast(shiftrightunsigned({h}, {s + 6}) & {SLICE_BITS // 64 - 1} as int)], cast(shiftrightunsigned({h}, {s}) & 63 as int)) = 1" for s in SHIFTS)
    probed = probed.withColumn(maybe, F.coalesce(F.expr(bits), F.lit(False))).drop(h, f"{h}_slice", f"{h}_words")

    some = probed.filter(F.col(maybe)).withColumn(sha, F.sha2(text.cast("binary"), 256))
    groups = cut(some.groupBy(sha).agg(F.max(id_col).alias("k"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    limit = max(64, rows // HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col("n") > limit).select(F.col(sha).alias("hot_sha"), F.col("k").alias(hot_id), F.col("n").alias(hot_n)))
    cold = groups.filter(F.col("n") <= limit).select(F.col(sha).alias(key), F.col("k").alias(f"{key}_k"), F.col("n").alias(f"{key}_n"))

    # a row of a hot group has its answer already; its key is its own, so that it lands anywhere
    some = some.join(hot, F.col(sha) == F.col("hot_sha"), "left")
    side = F.when(F.col(hot_n).isNull(), F.col(sha)).otherwise(F.concat(F.lit("-"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    some = some.withColumn(f"{key}_side", side).join(cold, F.col(f"{key}_side") == F.col(key), "left")
    grouped = F.coalesce(F.col(hot_n), F.col(f"{key}_n"))
    keep = F.when(F.col(hot_n).isNotNull(), F.col(hot_id)).when(F.col(f"{key}_n").isNotNull(), F.col(f"{key}_k")).otherwise(F.col(id_col))
    columns = [F.col(c) for c in docs.columns]
    some = some.select(*columns, keep.alias("keep_id"), F.coalesce(grouped, F.lit(1)).cast("long").alias("group_size"), F.col(id_col).eqNullSafe(keep).alias("kept"), F.col(sha).alias("text_sha256"))
    alone = probed.filter(~F.col(maybe)).select(*columns, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    return alone.unionByName(some)
