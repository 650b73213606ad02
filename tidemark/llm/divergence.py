"""Source divergence audit by one-hot level products.

Each source of a language is a distribution over the language's kept terms. What two sources differ by depends only
on the pair of counts a term has in them, so it is priced from joint tables: how many terms have count c in one
source and c' in the other. One-hot indicator columns for every (source, count level), level 0 included, with a row
for each term, multiplied by their own transpose hold every joint table of a language at once. The product is summed
over blocks of terms; a block is dealt to one task, has a bounded number of terms and of cells, and is multiplied in
tiles of bounded width, in doubles whose sums stay below 2^53, so each entry is exact.

Texts are counted inside the scan's tasks, so only (language, source, term) sums are shuffled, and a hot source is as
many rows as it has terms. All prices are whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, release_memory

#: A term's share is priced in units of one part of this.
UNIT = 1_000_000_000
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
#: Counters of a scan task are handed on once they hold this many entries.
ENTRIES = 400_000
#: Cells (terms by sources) of a block, terms of a block at most, and indicator columns of a tile.
BLOCK_CELLS, BLOCK_TERMS, TILE = 1 << 18, 2048, 1024

#: ASCII letters and all bytes of characters beyond ASCII; bytes.lower() lowers A-Z alone.
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows of each term, as partial sums of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, rows) in held.items():
                terms = list(times)
                n = np.fromiter(times.values(), np.int64, len(terms))
                d = np.fromiter((rows[t] for t in times), np.int64, len(terms))
                same = lambda v, k=len(terms): pa.DictionaryArray.from_arrays(pa.array(np.zeros(k, np.int32)), pa.array([v])).dictionary_decode()
                whole = pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(d)], names=["lang", "source", "term", "n", "docs"])
                for at in range(0, len(terms), 50_000):
                    yield whole.slice(at, 50_000)
            held.clear()

        entries = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.large_binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                times, rows = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(times)
                found = _TERM.findall((text.as_py() or b"").lower())
                times.update(found)
                rows.update(set(found))
                entries += len(times) - before
                if entries > ENTRIES:
                    yield from flush()
                    entries = 0
        yield from flush()
        release_memory()

    return docs.select(_text(lang_col).alias("lang"), _text(source_col).alias("source"), _text(text_col).alias("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)), in decimals, so that no product overflows."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide(count + 1) * F.lit(UNIT).cast("decimal(11,0)"), wide(total + terms))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most UNIT + 1, so the square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def levels_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-hot indicators of a block: counts is terms by sources. Returns (column of each cell, the source and the
    count that each column stands for); columns are ordered by source, then count."""
    column = np.empty(counts.shape, dtype=np.int64)
    source, level, at = [], [], 0
    for g in range(counts.shape[1]):
        values, column[:, g] = np.unique(counts[:, g], return_inverse=True)
        column[:, g] += at
        source.append(np.full(len(values), g))
        level.append(values)
        at += len(values)
    return column, np.concatenate(source), np.concatenate(level)


def products(counts: np.ndarray, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The joint tables of a block, tile by tile: (source, level, other source, other level, terms) of every pair of
    indicator columns that share a term, from the product of the indicators with their transpose."""
    column, source, level = levels_of(counts)
    width, rows = len(source), np.arange(counts.shape[0])[:, None]

    def indicator(lo: int, hi: int) -> np.ndarray:
        z = np.zeros((counts.shape[0], hi - lo))
        t, g = np.nonzero((column >= lo) & (column < hi))
        z[rows[t, 0], column[t, g] - lo] = 1.0
        return z

    for a in range(0, width, tile):
        left = indicator(a, min(a + tile, width)).T
        for b in range(0, width, tile):
            joint = left @ indicator(b, min(b + tile, width))
            i, j = np.nonzero(joint)
            yield source[a + i], level[a + i], source[b + j], level[b + j], joint[i, j].astype(np.int64)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", *, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS, block_cells: int = BLOCK_CELLS, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's terms are from those of its language.

    Terms are runs of ASCII letters (A-Z lowered) and characters beyond ASCII; a language keeps those of at least
    `least_documents` rows. A source's share of a term is 1 + floor(10^9 (count + 1) / (N + V)). Part `pair` has the
    other sources of the language (value: the sum over kept terms of floor((p - q)^2 / q)), part `term` the kept
    terms a source uses more than its language, up to rank `top_terms`; ranks fall by value, equal values by item.

    Null text, language or source count as ''. A group without terms has rows in part `pair` only; a language that
    keeps no term has pairs of value 0; a language of one source has no pairs. Rows that repeat count each; very
    long texts count whole; an empty table gives no rows; columns that are not named are not read."""
    counted = term_counts(docs, lang_col, source_col, text_col)
    # dealt by term, so that the sums of a source and those of the language need one shuffle
    of_term = Window.partitionBy("lang", "term")
    sums = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = sums.withColumn("d", F.sum("docs").over(of_term)).filter(F.col("d") >= least_documents)
    cells = cut(cells.select("lang", "source", "term", "n", F.sum("n").over(of_term).alias("all"), (F.min("source").over(of_term) == F.col("source")).cast("long").alias("once"), F.xxhash64("term").alias("h")))

    # a row for each group and each language; what follows broadcasts them only while they are small
    groups = docs.select(_text(lang_col).alias("lang"), _text(source_col).alias("source")).distinct()
    per_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("once").alias("once"))
    known = cut(groups.join(per_group, ["lang", "source"], "left").na.fill(0))
    langs = known.groupBy("lang").agg(F.sum("once").alias("terms"), F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("sources"))
    known = known.join(langs, "lang")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    known = cut(known.select("lang", "source", "total", "terms", "lang_total", "sources", place.alias("place")))

    return _terms(cells, known, top_terms).unionByName(_pairs(cells, known, block_cells, tile))


def _terms(cells: DataFrame, known: DataFrame, top: int) -> DataFrame:
    """A rank limit, so that each task hands on at most `top` rows of a group."""
    x = cells.join(known, ["lang", "source"])
    x = x.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q")).filter("p > q")
    x = x.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)


def _pairs(cells: DataFrame, known: DataFrame, block_cells: int, tile: int) -> DataFrame:
    """The values of all ordered pairs of a language's sources, summed over blocks of terms."""
    placed = cells.join(known.select("lang", "source", "place", "terms", "sources", "total"), ["lang", "source"])
    # terms of like counts share a block, so a block has few levels; its number of terms is bounded by its share
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TERMS), F.floor(F.lit(block_cells) / F.col("sources"))))
    block = F.pmod(F.col("h"), F.ceil(F.col("terms") / room)).cast("long")
    placed = placed.select("lang", F.floor(F.log2("all") / 2).cast("int").alias("size"), block.alias("block"), "h", "term", "place", "n")
    sides = known.groupBy("lang").agg(F.first("terms").alias("terms"), F.sort_array(F.collect_list(F.struct("place", "total"))).alias("totals"))
    # only the first row of a block carries the totals of its language
    lead = placed.groupBy("lang", "size", "block").agg(F.count(F.lit(1)).alias("rows")).join(sides, "lang")
    lead = lead.select("lang", "size", "block", F.lit(None).cast("string").alias("term"), F.lit(-1).alias("place"), F.col("terms").alias("n"), F.col("totals.total").alias("totals"))
    rows = placed.select("lang", "size", "block", "term", "place", "n", F.lit(None).cast("array<bigint>").alias("totals")).unionByName(lead)

    def price(block: pd.DataFrame) -> pd.DataFrame:
        head = block["place"].to_numpy() < 0
        terms, totals = int(block["n"][head].iloc[0]), [int(t) for t in block["totals"][head].iloc[0]]
        body = block[~head]
        row, names = pd.factorize(body["term"])
        counts = np.zeros((len(names), len(totals)), dtype=np.int64)
        counts[row, body["place"].to_numpy()] = body["n"].to_numpy()
        n = len(totals)
        values = np.zeros(n * n, dtype=np.int64)
        memo: dict[tuple[int, int], int] = {}

        def shares(source: np.ndarray, level: np.ndarray) -> np.ndarray:
            pair, back = np.unique(np.stack([source, level]), axis=1, return_inverse=True)
            for g, c in pair.T.tolist():
                if (g, c) not in memo:
                    memo[g, c] = 1 + UNIT * (c + 1) // (totals[g] + terms)
            return np.array([memo[g, c] for g, c in pair.T.tolist()], dtype=np.int64)[back.reshape(-1)]

        for a, la, b, lb, times in products(counts, tile):
            if len(a):
                p, q = shares(a, la), shares(b, lb)
                np.add.at(values, a * n + b, times * ((p - q) * (p - q) // q))
        a, b = np.divmod(np.arange(n * n), n)
        other = a != b
        return pd.DataFrame({"lang": block["lang"].iloc[0], "a": a[other], "b": b[other], "value": values[other]})

    priced = rows.groupBy("lang", "size", "block").applyInPandas(price, "lang string, a int, b int, value long")
    priced = priced.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = known.select("lang", "source", F.col("place").alias("a"))
    two = known.select("lang", F.col("source").alias("item"), F.col("place").alias("b"))
    pairs = one.join(two, "lang").filter("a <> b").join(priced, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def joint_tables(counts: dict[str, dict[str, int]], tile: int = TILE) -> Counter:
    """{(source, level, other source, other level): terms} of a small table {term: {source: count}}, by `products`."""
    names = sorted({s for row in counts.values() for s in row})
    block = np.array([[row.get(s, 0) for s in names] for row in counts.values()], dtype=np.int64).reshape(len(counts), len(names))
    out: Counter = Counter()
    for a, la, b, lb, n in products(block, tile):
        for key in zip(a.tolist(), la.tolist(), b.tolist(), lb.tolist(), n.tolist(), strict=True):
            out[names[key[0]], key[1], names[key[2]], key[3]] += key[4]
    return out
