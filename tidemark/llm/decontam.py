"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Everything is DataFrame functions. Texts become words (lower-cased runs of letters and digits) and shingles of
them; a window has as many shingles as a benchmark item. A window of similarity t must hold 2t / (1 + t) of its
places in shingles that some item of its size has, so those places (a join with the set of item shingles, whose
number is checked before it is broadcast) tell, without loss, at which starts a window can match any item; all of
those, and only those, are laid. Each window gets a 63-bit SimHash of its shingles. Fingerprints are cut into
RADIUS + 1 blocks; two of them within the radius agree in one block at least, so the join on (item size, block
number, block) finds every item within the radius of a window. What it finds is verified by the exact weighted
Jaccard similarity of the shingle bags (a shingle weighs as often as it occurs).

Two bags of one size at the threshold 0.8 differ in a bit with a probability of 0.15, so a pair lies beyond RADIUS 20
of 63 bits with a probability of 2e-4, and less the more alike it is; 0.3 % of unrelated pairs lie within.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

WORDS, THRESHOLD = 5, 0.8
RADIUS, LANES = 20, 21
BITS = 3 * LANES
#: Item shingles up to this number are broadcast.
BROADCAST_SHINGLES = 1_000_000
#: Documents with windows to test are broadcast, as ids and starts, up to this number of documents and starts.
BROADCAST_DOCS, BROADCAST_STARTS = 200_000, 4_000_000
#: Starts a stretch: a document's windows are cut from stretches, so that no row holds them all.
STRETCH = 256


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def shingles_of(words: Column, width: int) -> Column:
    """Hash of each run of `width` words in order; none if there are fewer words."""
    last = F.size(words) - width
    one = lambda i: F.xxhash64(*(words[i + k] for k in range(width)))
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<bigint>"))


def shingled(text: Column, width: int) -> Column:
    """The shingles of a text; the words are bound once, wherever the optimizer moves the expression."""
    return F.transform(F.array(words_of(text)), lambda w: shingles_of(w, width))[0]


def simhash(hashes: Column) -> Column:
    """Bit b is set if more than half of the hashes have it. Three bits are counted in each of LANES longs, in
    fields of LANES bits, so up to two million hashes are counted without an overflow."""
    field = (1 << LANES) - 1
    ones = F.lit(sum(1 << (LANES * f) for f in range(3))).cast("bigint")
    zero = F.struct(*(F.lit(0).cast("bigint").alias(f"c{k}") for k in range(LANES)))
    count = lambda s, x: F.struct(*((s[f"c{k}"] + F.shiftrightunsigned(x, k).bitwiseAND(ones)).alias(f"c{k}") for k in range(LANES)))

    def finish(s: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for k in range(LANES):
            for f in range(3):
                set_ = 2 * F.shiftrightunsigned(s[f"c{k}"], LANES * f).bitwiseAND(F.lit(field).cast("bigint")) > F.size(hashes)
                out = out + F.when(set_, F.lit(1 << (k + LANES * f)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        return out

    return F.aggregate(hashes, zero, count, finish)


def block_edges(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the radius + 1 blocks."""
    n = radius + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def blocks_of(fingerprint: Column, radius: int) -> Column:
    """array<struct<no, value>> of the fingerprint's blocks."""
    cut_out = lambda a, n: F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << n) - 1).cast("bigint"))
    return F.array(*(F.struct(F.lit(k).alias("no"), cut_out(a, n).alias("value")) for k, (a, n) in enumerate(block_edges(radius))))


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the lesser over sum of the greater number of occurrences."""
    times = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    repeated = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(times(a, x), times(b, x)))
    common = F.when(plain, F.size(F.array_intersect(a, b))).otherwise(repeated)
    return F.transform(F.array(common), lambda c: c.cast("double") / (F.size(a) + F.size(b) - c).cast("double"))[0]


def _starts(places: Column, length: Column, threshold: float) -> Column:
    """array<struct<base, starts>>: where a window of `length` shingles can be as similar as the threshold, by
    stretches of STRETCH starts.

    `places` (sorted, distinct) hold a shingle of an item of that length. Of two bags of n one shares at least
    2t / (1 + t) n; the i-th place is the first of a window with `least` places at the starts after the place
    before it, up to itself, from which the window reaches the last of those places. A document that is shorter
    than the item is one window at 0, which needs t n places."""
    least = F.greatest(F.lit(1), F.ceil(2 * threshold / (1 + threshold) * length - 1e-9).cast("int"))
    whole = F.ceil(threshold * length - 1e-9)

    def of(i: Column) -> Column:
        low = F.greatest(F.lit(0), F.coalesce(F.get(places, i - 1) + 1, F.lit(0)), F.get(places, i + least - 1) - length + 1)
        high = F.get(places, i)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    none = F.array().cast("array<int>")
    inner = F.when(F.size(places) >= least, F.flatten(F.transform(F.sequence(F.lit(0), F.size(places) - least), of))).otherwise(none)
    first = F.when(F.size(F.filter(places, lambda p: p < length)) >= whole, F.array(F.lit(0))).otherwise(none)
    base = lambda s: s - s % STRETCH
    stretches = lambda starts: F.transform(F.array_distinct(F.transform(starts, base)), lambda b: F.struct(b.alias("base"), F.filter(starts, lambda s: base(s) == b).alias("starts")))
    return F.transform(F.array(F.array_union(first, inner)), stretches)[0]


def _matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, words: int, threshold: float, radius: int, broadcast_shingles: int, broadcast_docs: int) -> DataFrame:
    """(doc, txt, item, start, size, similarity): every verified window of a document row; txt is the text's hash."""
    items = cut(benchmark.select(F.col(item_col).alias("item"), shingled(F.col(item_text_col), words).alias("bag"))).filter(F.size("bag") > 0)
    items = cut(items.select("item", F.size("bag").alias("len"), "bag", simhash(F.col("bag")).alias("fingerprint")))
    known = cut(items.select("len", F.explode("bag").alias("shingle")).groupBy("shingle").agg(F.collect_set("len").alias("lens")))
    small = known.count() <= broadcast_shingles

    # the shingles go alone through the join, without their text; posexplode_outer: the inner one infers a
    # filter that would shingle every text a second time
    key = (F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("txt"))
    shingles = docs.select(*key, F.posexplode_outer(shingled(F.col(text_col), words)).alias("p", "shingle"))
    hits = shingles.join(F.broadcast(known) if small else known, "shingle").select("doc", "txt", "p", F.explode("lens").alias("len"))
    placed = hits.groupBy("doc", "txt", "len").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    placed = placed.select("doc", "txt", F.struct("len", _starts(F.col("ps"), F.col("len"), threshold).alias("stretches")).alias("w")).filter(F.size("w.stretches") > 0)
    near = cut(placed.groupBy("doc", "txt").agg(F.collect_list("w").alias("at")))
    starts = F.aggregate("at", F.lit(0).cast("bigint"), lambda n, w: n + F.aggregate(w.stretches, F.lit(0).cast("bigint"), lambda m, s: m + F.size(s.starts)))
    size = near.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(starts), F.lit(0)).alias("starts")).first()
    near = near.select(F.col("doc").alias("doc_"), F.col("txt").alias("txt_"), "at")
    if size["docs"] <= broadcast_docs and size["starts"] <= BROADCAST_STARTS:
        near = F.broadcast(near)

    # only documents with such starts are read for windows
    def stretches_of(h: Column) -> Column:
        one = lambda w, s: F.struct(w.len.alias("len"), s.base.alias("base"), F.filter(s.starts, lambda x: x <= F.greatest(F.lit(0), F.size(h) - w.len)).alias("starts"), F.slice(h, s.base + 1, w.len + STRETCH).alias("h"))
        return F.flatten(F.transform(F.col("at"), lambda w: F.transform(w.stretches, lambda s: one(w, s))))

    rows = docs.select(*key, F.col(text_col).alias("text")).join(near, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("txt") == F.col("txt_")))
    rows = rows.select("doc", "txt", F.explode_outer(F.transform(F.array(shingled(F.col("text"), words)), stretches_of)[0]).alias("s"))
    rows = rows.select("doc", "txt", "s.len", "s.base", "s.h", F.explode_outer("s.starts").alias("start")).filter("start is not null")
    windows = rows.select("doc", "txt", "len", "start", F.slice("h", F.col("start") - F.col("base") + 1, F.col("len")).alias("window"))
    windows = windows.withColumn("print", simhash(F.col("window")))

    blocks = lambda x: F.explode(blocks_of(F.col(x), radius)).alias("b")
    index = items.select("item", "len", "bag", "fingerprint", blocks("fingerprint")).select("item", "len", "bag", "fingerprint", "b.no", "b.value")
    probes = windows.select("*", blocks("print")).select("doc", "txt", "len", "start", "window", "print", "b.no", "b.value")
    within = F.bit_count(F.col("print").bitwiseXOR(F.col("fingerprint"))) <= radius
    # of the blocks that agree the first one speaks for the pair
    first = F.lit(None).cast("int")
    for k, (a, n) in reversed(list(enumerate(block_edges(radius)))):
        agree = F.shiftrightunsigned(F.col("print").bitwiseXOR(F.col("fingerprint")), a).bitwiseAND(F.lit((1 << n) - 1).cast("bigint")) == 0
        first = F.when(agree, F.lit(k)).otherwise(first)
    found = probes.join(F.broadcast(index) if small else index, ["len", "no", "value"]).filter(within).filter(F.col("no") == first)
    found = found.select("doc", "txt", "item", "start", F.size("window").alias("size"), weighted_jaccard(F.col("window"), F.col("bag")).alias("similarity"))
    return found.filter(F.col("similarity") >= threshold)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, words: int = WORDS, threshold: float = THRESHOLD, radius: int = RADIUS, broadcast_shingles: int = BROADCAST_SHINGLES, broadcast_docs: int = BROADCAST_DOCS) -> DataFrame:
    """(<id_col>, <item_col>, start_word, n_words, similarity): for each document and item that have a window of
    weighted similarity >= threshold, the best such window, the first of equals.

    Null texts and texts and items of fewer than `words` words match nothing; a document that is shorter than
    an item is one window. Rows that repeat an id are found under that id, null ids under null, null items
    under null. Very long texts are read whole; an empty side gives no rows; further columns are not read."""
    found = _matches(docs, benchmark, id_col, text_col, item_col, item_text_col, words, threshold, radius, broadcast_shingles, broadcast_docs)
    best = found.groupBy("doc", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("b"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), (-F.col("b.back")).cast("long").alias("start_word"), (F.col("b.size") + words - 1).cast("long").alias("n_words"), F.col("b.similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, words: int = WORDS, threshold: float = THRESHOLD, radius: int = RADIUS, broadcast_shingles: int = BROADCAST_SHINGLES, broadcast_docs: int = BROADCAST_DOCS) -> DataFrame:
    """`docs` without the rows in which `contamination` finds an item. Rows are judged by id and text, so a null
    id saves none, and a clean text that shares its id with another one stays."""
    hit = _matches(docs, benchmark, id_col, text_col, item_col, item_text_col, words, threshold, radius, broadcast_shingles, broadcast_docs)
    name, txt = fresh(docs.columns, "_hit"), fresh(docs.columns, "_txt")
    hit = hit.select(F.col("doc").alias(name), F.col("txt").alias(txt)).distinct()
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col(name)) & (F.xxhash64(text_col) == F.col(txt)), "left_anti")
