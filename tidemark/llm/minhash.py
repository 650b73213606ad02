"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

Texts become sets of hashed word shingles. Two permutations of the 32-bit space make all signature places: the
first scatters the shingles, the second, circularly shifted by k, gives place k. Signatures are cut into bands.

Documents of equal sets are one class and go on as one representative. Representatives that share a band are
candidates; whatever candidates connect is a cluster, and each representative's whole set is sent once to its
cluster, where intersections are counted over an inverted index and only links that join two parts are emitted,
never all pairs. A cluster of more shingles than a task should hold is cut into blocks by size class and hash,
and every pair of blocks whose sizes allow a link is a task of its own, so large clusters lose nothing. There
are so many bands that a pair just at the threshold misses all of them with a probability of MISS at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, release_memory
from .graph import components

WORDS, THRESHOLD = 5, 80  # the default: five words, a similarity of 0.80
ROWS, MISS = 6, 1e-7
#: Shingles that a block of a large cluster holds, about; bytes of text hashed at once.
BLOCK_SHINGLES, GROUP_BYTES = 300_000, 1 << 20
#: Candidate ids up to this number are broadcast to the texts; beyond it they meet in a shuffle join.
BROADCAST_IDS = 250_000

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U64(_BASE))[_LOWER]
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, GROUP_BYTES)
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size, base, dtype=np.uint64)]).cumprod(dtype=np.uint64) for base in (_BASE, _BASE_INVERSE)]
    return _powers[0], _powers[1]


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Of each text its sorted distinct shingle hashes (uint64): lower-cased A-Z, words between the six ASCII
    white-space characters, `words` words a shingle; a shorter sequence is one shingle, none for no word."""
    n, at = len(texts), 0
    if not n:
        return
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP_BYTES, "right")) - 1)
        yield from _sets(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], words)
        at = end


def _sets(b: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    word = ~_SPACE[b]
    fence = np.zeros(len(b) + 1, dtype=bool)
    fence[offsets] = True
    before, after = np.ones(len(b), bool), np.ones(len(b), bool)
    before[1:], after[:-1] = ~word[:-1], ~word[1:]
    starts = np.flatnonzero(word & (before | fence[:-1]))
    ends = np.flatnonzero(word & (after | fence[1:])) + 1
    power, inverse = _power_tables(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    h = _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    rolled = np.zeros(len(h), dtype=np.uint64)
    for k in range(words):
        rolled[: len(h) - k] = _mix(rolled[: len(h) - k] * _U64(_BASE) + h[k:]) if k < len(h) else rolled[:0]
    for i in range(len(offsets) - 1):
        a, z = first[i], first[i + 1]
        if z - a >= words:
            s = np.sort(rolled[a : z - words + 1])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif z > a:
            yield np.frombuffer(blake2b(h[a:z].tobytes(), digest_size=8).digest(), dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


def _permute(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A bijection of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(15)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


def signature(shingles: np.ndarray, places: int) -> np.ndarray:
    """Circulant MinHash: place k is the least pi(sigma(x) - k mod 2^32) over the set."""
    x = _permute((shingles ^ (shingles >> _U64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    shift = np.arange(1, places + 1, dtype=np.uint32)[:, None]
    out = np.full(places, 0xFFFFFFFF, dtype=np.uint32)
    step = max(1, (1 << 16) // places)  # keeps the work in cache
    for i in range(0, len(x), step):
        np.minimum(out, _permute(x[None, i : i + step] - shift, 0x21F0AAAD, 0x735A2D97).min(axis=1), out=out)
    return out


def bands_for(threshold: int, rows: int = ROWS, miss: float = MISS) -> int:
    """(1 - t^rows)^bands <= miss."""
    t = min(threshold / 100, 0.999999)
    return math.ceil(math.log(miss) / math.log1p(-(t**rows)))


def sketches(docs: DataFrame, id_col: str, text_col: str, *, words: int, bands: int, rows: int = ROWS) -> DataFrame:
    """(id, n, set_key, bands): set size, 16-byte digest of the set (null if empty) and a hash for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, hashes = [], [], []
            for s in shingle_sets(batch.column(1), words):
                n.append(len(s))
                keys.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    part = signature(s, bands * rows).reshape(bands, rows).astype(np.uint64)
                    h = np.arange(bands, dtype=np.uint64)
                    for k in range(rows):
                        h = _mix(h * _U64(_BASE) + part[:, k])
                    hashes.append(h.view(np.int64))
                else:
                    hashes.append(np.zeros(0, np.int64))
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "n", "set_key", "bands"])
        release_memory()

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def _spanning_links(sets: list[np.ndarray], side: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links (positions) that join two parts, of pairs with 100 * intersection >= threshold * union; between
    the two sides only if there are two."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    order = np.argsort(code, kind="stable")
    posting, begin = owner[order], np.searchsorted(code[order], np.arange(len(values) + 1))
    held = np.bincount(code, minlength=len(values))
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links, at = [], 0
    two = side.min() != side.max()
    for i, s in enumerate(sets):
        mine = code[at : at + len(s)]
        at += len(s)
        mine = mine[held[mine] > 1]
        if not len(mine) or (two and side[i]):
            continue
        hits = np.concatenate([posting[begin[c] : begin[c + 1]] for c in mine])
        common = np.bincount(hits, minlength=len(sets))
        if two:
            common[side == 0] = 0
        else:
            common[: i + 1] = 0
        for j in np.flatnonzero(100 * common >= threshold * (size[i] + size - common)):
            a, b = root(i), root(int(j))
            if a != b and common[j]:
                parent[a] = b
                links.append((i, int(j)))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, threshold: int = THRESHOLD, bands: int | None = None, rows: int = ROWS, block_shingles: int = BLOCK_SHINGLES, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(<id_col>, n_shingles, component_id, kept), a row for each row of `docs`.

    Texts are linked if 100 * |intersection| >= threshold * |union| of their shingle sets; component_id is the
    smallest id that links reach, kept is whether it is the row's own. Null texts, empty ones and those of
    white space alone have the empty set and are linked with nothing. Rows of a null id are linked with nothing
    either: their component is null and they are kept. Rows that repeat an id share its fate. Very long texts
    count whole; an empty table gives no rows; further columns are not read."""
    bands = bands or bands_for(threshold, rows)
    sketch = cut(sketches(docs, id_col, text_col, words=words, bands=bands, rows=rows))
    classes = sketch.filter("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes)

    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = cut(banded.groupBy("bucket").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1").select("bucket", "first"))
    clusters = cut(components(banded.join(shared, "bucket").filter("rep <> first").select("first", "rep"), "first", "rep").withColumnsRenamed({"node": "rep", "component": "cluster"}))

    # where each representative's set goes: one task for a small cluster, pairs of blocks for a large one
    members = clusters.join(classes.select("rep", "set_key", "n"), "rep")
    step = -math.log(threshold / 100)
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    totals = members.groupBy("cluster").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("members"))
    large = cut(totals.filter(F.col("shingles") > block_shingles).select("cluster"))
    parts = members.join(large, "cluster").groupBy("cluster", size_class.alias("c")).agg(F.ceil(F.sum("n") / F.lit(float(block_shingles))).cast("int").alias("blocks"))
    sides = parts.groupBy("cluster").agg(F.map_from_entries(F.collect_list(F.struct("c", "blocks"))).alias("blocks"))  # an entry for each size class
    placed = members.withColumn("c", size_class).join(sides, "cluster", "left")
    here = F.coalesce(F.try_element_at("blocks", F.col("c")), F.lit(1))
    block = F.pmod(F.xxhash64("rep"), here).cast("int")
    task = lambda lo, i, hi, j, side: F.struct(lo.alias("lo"), i.alias("i"), hi.alias("hi"), j.alias("j"), side.alias("side"))
    count = lambda c: F.coalesce(F.try_element_at("blocks", c), F.lit(0))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    c, mine = F.col("c"), F.col("block")
    within = F.transform(upto(here), lambda j: task(c, F.least(mine, j), c, F.greatest(mine, j), (mine > j).cast("int")))
    above = F.transform(upto(count(c + 1)), lambda j: task(c, mine, c + 1, j, F.lit(0)))
    below = F.transform(upto(count(c - 1)), lambda j: task(c - 1, j, c, mine, F.lit(1)))
    only = F.array(task(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(0)))
    tasks = F.when(F.col("blocks").isNull(), only).otherwise(F.concat(within, above, below))
    placed = cut(placed.withColumn("block", block).select("rep", "set_key", "cluster", tasks.alias("tasks")))

    # the candidates' texts are read again; each set is shipped to its tasks
    ids = placed.select("rep").count()
    wanted = placed.select(F.col("rep").alias("rep_"), "set_key", "cluster", "tasks")
    wanted = F.broadcast(wanted) if ids <= broadcast_ids else wanted
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(wanted, F.col("id") == F.col("rep_")).select("id", "text", "set_key", "cluster", "tasks")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1), words))
            # a repeated id may stand for other texts too
            same = [i for i, s in enumerate(found) if len(s) and blake2b(s.tobytes(), digest_size=16).digest() == batch.column(2)[i].as_py()]
            rest = batch.take(pa.array(same, pa.int64()))
            yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(3), rest.column(4), pa.array([found[i].tobytes() for i in same], pa.binary())], names=["id", "cluster", "tasks", "shingles"])
        release_memory()

    kind = docs.schema[id_col].dataType.simpleString()
    task_type = placed.schema["tasks"].dataType.simpleString()
    shipped = texts.mapInArrow(sets, f"id {kind}, cluster {kind}, tasks {task_type}, shingles binary")
    shipped = shipped.select("id", "cluster", F.explode("tasks").alias("t"), "shingles").select("id", "cluster", "t.*", "shingles")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("id")
        found = [np.frombuffer(s, dtype=np.uint64) for s in group["shingles"]]
        links = _spanning_links(found, group["side"].to_numpy(), threshold) if len(found) > 1 else []
        ids = group["id"].to_numpy()
        return pd.DataFrame({"a": ids[[i for i, _ in links]], "b": ids[[j for _, j in links]]})

    links = shipped.groupBy("cluster", "lo", "i", "hi", "j").applyInPandas(verify, f"a {kind}, b {kind}")
    linked = components(links, "a", "b").withColumnsRenamed({"node": "rep"})

    found = cut(classes.select("set_key", "rep").join(linked, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component")))
    out = sketch.select("id", "n", "set_key").join(found, "set_key", "left")
    component = F.when(F.col("set_key").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` without the rows that `near_duplicates` does not keep; null ids stay."""
    lost = near_duplicates(docs, id_col, text_col, **options).filter("not kept").select(F.col(id_col).alias(name := fresh(docs.columns, "_lost"))).distinct()
    return docs.join(lost, F.col(id_col) == F.col(name), "left_anti")
