"""Draws, splits, folds and matching keyed by md5, so that they do not depend on the cluster's layout."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranks import numbered

#: Order in which volume bins are searched from a positive's own.
SEARCH = (0, 1, -1, 2, -2, 3, -3, 4, -4)


def digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)).cast("binary"))


def draw(*parts) -> Column:
    """An integer below 2^32."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")


#: The constants, turns and word numbers of md5's 64 steps.
STEPS = [(math.floor(abs(math.sin(i + 1)) * 2**32), (7, 12, 17, 22, 5, 9, 14, 20, 4, 11, 16, 23, 6, 10, 15, 21)[i // 16 * 4 + i % 4], (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16) for i in range(64)]


def draws_along(start: str, first: int, end: int) -> np.ndarray:
    """As `draw` of the texts `start` + number, for the numbers from `first` to `end` - 1, all at once. Texts of up to
    55 bytes, which are one block of md5; so a start may have 36."""
    head, parts = start.encode(), []
    if len(head) > 36:
        raise ValueError("more than one block of md5")
    while first < end:  # numbers of equally many digits
        digits = len(str(first))
        last = min(end, 10**digits)
        left, size = np.arange(first, last), len(head) + digits
        block = np.zeros((last - first, size // 4 * 4 + 4), np.uint8)
        block[:, : len(head)] = np.frombuffer(head, np.uint8)
        for k in range(size - 1, len(head) - 1, -1):
            left, block[:, k] = left // 10, left % 10 + 48
        block[:, size] = 128
        known = len(head) // 4  # whole words that all texts share, as the zeros and the length do
        words = [np.uint32(int.from_bytes(head[4 * k : 4 * k + 4], "little")) for k in range(known)]
        words += list(np.ascontiguousarray(block.view("<u4").T[known:].astype(np.uint32)))
        words += [np.uint32(0)] * (14 - len(words)) + [np.uint32(8 * size), np.uint32(0)]
        parts.append(_first_word(words, last - first))
        first = last
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _first_word(words: list, n: int) -> np.ndarray:
    start = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
    a, b, c, d = (np.full(n, x, np.uint32) for x in start)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i, (constant, turn, word) in enumerate(STEPS[:61]):  # the last three steps do not change the first word
        if i < 16:
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            np.bitwise_xor(f, c, out=f)
        f += a
        if isinstance(words[word], np.ndarray):
            f += words[word]
            f += np.uint32(constant)
        else:
            f += np.uint32((constant + int(words[word])) % 2**32)
        np.left_shift(f, np.uint32(turn), out=g)
        np.right_shift(f, np.uint32(32 - turn), out=f)
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    b += np.uint32(start[0])
    return b.byteswap().astype(np.int64)


def first_by_hash(df: DataFrame, by: list[str], key: str, seed: str, cap: int) -> DataFrame:
    """`cap` rows for each key by least hash: a reservoir that does not depend on arrival."""
    w = Window.partitionBy(*by).orderBy(digest(seed, F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")


def holdout(accounts: DataFrame, by: str, key: str, seed: str, share: float = 0.3) -> DataFrame:
    """split: `bround(share * n)` accounts of each population by least hash are test."""
    n = F.broadcast(accounts.groupBy(F.col(by).alias("_by")).agg(F.count(F.lit(1)).alias("_n")))  # a row for each population
    ranked = numbered(accounts, [by], [digest(seed, F.col(key)), F.col(key)], "_r").join(n, F.col(by).eqNullSafe(F.col("_by")))
    return ranked.withColumn("split", F.when(F.col("_r") <= F.bround(F.lit(share) * F.col("_n"), 0), "test").otherwise("train")).drop("_r", "_n", "_by")


def folds(accounts: DataFrame, label: str, key: str, k: int, repeats: int) -> DataFrame:
    """(…, repeat, fold): stratified folds that differ by one account a class at most."""
    each = accounts.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = numbered(each, ["repeat", label], [digest(F.col("repeat"), F.col(key)), F.col(key)], "_r")
    return ranked.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def volume_bin(volume: Column) -> Column:
    """Edges 0.5, 0.75, .., 6.25 at or below log10 of the volume."""
    return F.greatest(F.lit(0), F.least(F.lit(24), F.floor((F.log10(F.greatest(volume, F.lit(1)).cast("double")) - 0.5) / 0.25 + 1))).cast("int")


def volume_matched(positives: DataFrame, controls: DataFrame, key: str, volume: str, draws: int = 5, seed: str = "vm") -> DataFrame:
    """Controls drawn for the positives from the nearest bin that has any; the set of all draws."""
    c = controls.withColumn("bin", volume_bin(F.col(volume)))
    c = numbered(c, ["bin"], [F.col(key)], "slot").withColumn("slot", F.col("slot") - 1)
    sizes = c.groupBy("bin").agg(F.count(F.lit(1)).alias("size"))  # one row for each of 25 bins
    shifts = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(s).alias("shift")) for i, s in enumerate(SEARCH)))
    p = positives.select(F.col(key).alias("pos"), volume_bin(F.col(volume)).alias("own"), F.explode(shifts).alias("s"))
    p = p.withColumn("bin", F.col("own") + F.col("s.shift")).join(F.broadcast(sizes), "bin")
    best = p.groupBy("pos").agg(F.min(F.struct(F.col("s.rank").alias("rank"), "bin", "size")).alias("b"))
    drawn = best.select("pos", "b.bin", "b.size", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("d"))
    drawn = drawn.withColumn("slot", F.pmod(draw(seed, F.col("pos"), F.col("d")), F.col("size")))
    return drawn.join(c, ["bin", "slot"]).select(F.col(key)).distinct()
