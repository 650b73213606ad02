"""Quality rules: base limits, then robust multivariate outliers of each language and source.

Everything is DataFrame functions. Each text gives four transformed statistics: the logarithm of its mean word
length, the logarithm of 1 + SYMBOL_WEIGHT symbols a word, the share of repeated lines and the share of words in
repeated three-word windows. Of the rows of a language and source that pass the base limits, the half with the least
covariance determinant is found by concentration steps from several fixed starts; a row is rejected if its squared
Mahalanobis distance from that half is beyond the chi-square quantile of LEVEL.

Most of these statistics are zero for most texts, so the plain determinant would be zero. As in the regularised form
of the estimator (Boudt, Rousseeuw, Vanduffel, Verdonck 2020), the scatter is target + factor * covariance of the
half, and the target's deviations (TOLERANCE) say how far a statistic may differ without being a fault; steps never
raise its determinant. Length is limited by the base rule alone: a long clean text is no outlier.

Statistics lie on a grid of 1 / GRID. So a group is counted once into cells of equal statistics, steps run over cells
with their counts and not over rows, sums are whole numbers, and results do not depend on the cluster's layout. In a
step, cells are summed by fine classes of distance, and the classes up to the one that completes the half make the
next half; one task holds some hundreds of classes of a group, never its rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import written
from .common import cut, fresh

LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
STATISTICS = ("word_length", "symbols", "repeated_lines", "repeated_words")
#: Deviations that are no fault, in the order of STATISTICS, and the weight of a symbol a word.
TOLERANCE, SYMBOL_WEIGHT = (0.10, 0.25, 0.15, 0.10), 20
#: Statistics are whole multiples of 1 / GRID.
GRID = 1024
LEVEL = 0.9999
#: Groups of fewer rows are pooled with the other small groups of their language, then of the table.
LEAST_ROWS = 40
#: Classes of distance for each doubling, and steps at most.
CLASSES, STEPS = 32, 40

P = len(STATISTICS)
_LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


def chi_square_cdf(x: float, degrees: int) -> float:
    """For an even number of degrees: 1 - exp(-x/2) * sum of (x/2)^k / k! below degrees / 2."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi_square_quantile(level: float, degrees: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, degrees) < level else (lo, mid)
    return hi


#: Makes the covariance of the inner half of normal data that of all of it.
CONSISTENCY = 0.5 / chi_square_cdf(chi_square_quantile(0.5, P), P + 2)


def _bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), use)[0]


def _repeated(w: Column) -> Column:
    """Words in windows of three that occur twice or more, the first occurrence included."""
    places = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(h: Column) -> Column:
        # by hash, then the words themselves, so equal windows are neighbours
        rows = F.sort_array(F.transform(places, lambda i: F.struct(h[i].alias("h"), w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i"))))
        same = lambda x, y: F.coalesce((x.h == y.h) & (x.a == y.a) & (x.b == y.b) & (x.c == y.c), F.lit(False))
        twice = lambda s: F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        at = _bind(rows, lambda s: F.sort_array(F.transform(twice(s), lambda x: x.i)))
        none = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(at, none, lambda s, i: F.struct((s.n + F.least(F.lit(3), i - s.last)).alias("n"), i.alias("last")), lambda s: s.n)

    # most texts repeat nothing: then the hashes differ, and so do the windows
    some = _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(some)


def base_statistics(text: Column) -> Column:
    """struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines> (long) of a whole text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    count = lambda chars: F.regexp_count(text, F.lit(chars))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)
    counted = _bind(words, lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("repeated")))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    lines = _bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    long = lambda c, name: c.cast("long").alias(name)
    return F.struct(
        long(counted.n, "n_words"), long(F.length(text) - count(r"[\x20\x09-\x0D]"), "word_chars"), long(count(r"[#*$%&|<>]"), "n_symbols"),
        long(lines.again, "n_dup_lines"), long(counted.repeated, "n_repeat_words"), long(lines.n, "n_lines"),
    )


def base_failed(s: Column) -> Column:
    return (s.n_words < LEAST_WORDS) | (100 * s.n_repeat_words > MOST_REPEATED_PERCENT * s.n_words)


def vector(s: Column) -> Column:
    """The transformed statistics on the grid, array<long>; null without a word."""
    n = F.when(s.n_words > 0, s.n_words.cast("double"))
    values = (F.log(s.word_chars / n), F.log1p(SYMBOL_WEIGHT * s.n_symbols / n), s.n_dup_lines / F.greatest(s.n_lines, F.lit(1)), s.n_repeat_words / n)
    return F.when(s.n_words > 0, F.array(*(F.round(v * GRID).cast("long") for v in values)))


def group_of(lang: Column, source: Column) -> Column:
    """A string for each language and source; null is a value of its own."""
    return F.to_json(F.struct(lang.cast("string").alias("l"), source.cast("string").alias("s")))


def statistics(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(id, lang_key, group, the base statistics, base_failed, z), a row for each row of `docs`."""
    s = docs.select(F.col(id_col).alias("id"), F.to_json(F.struct(F.col(lang_col).cast("string").alias("l"))).alias("lang_key"), group_of(F.col(lang_col), F.col(source_col)).alias("group"), base_statistics(F.col(text_col)).alias("s"))
    return s.select("id", "lang_key", "group", "s.*", base_failed(F.col("s")).alias("base_failed"), vector(F.col("s")).alias("z"))


def pools(sizes: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(group, pool): the group itself, or where it has too few rows the pool of its language's small groups, or where
    that is too small too the pool of all that is left."""
    own = F.col("rows") >= least_rows
    left = F.sum(F.when(own, 0).otherwise(F.col("rows"))).over(Window.partitionBy("lang_key"))
    pool = F.when(own, F.concat(F.lit("group "), "group")).when(left >= least_rows, F.concat(F.lit("language "), "lang_key")).otherwise(F.lit("all"))
    return sizes.select("group", pool.alias("pool"))


def _factor(c: DataFrame, keep: list[str]) -> DataFrame:
    """From mean m0.. and scatter s_ij: the inverse of the Cholesky factor (i_ij) and the determinant's logarithm."""
    for i, j in _LOWER:
        rest = F.col(f"s_{i}{j}") - sum((F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}") for k in range(j)), F.lit(0.0))
        c = c.withColumn(f"l_{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l_{j}{j}"))
    for i, j in _LOWER:
        known = sum((F.col(f"l_{i}{k}") * F.col(f"i_{k}{j}") for k in range(j, i)), F.lit(0.0))
        c = c.withColumn(f"i_{i}{j}", (1.0 if i == j else -known) / F.col(f"l_{i}{i}"))
    log_det = 2 * sum((F.log(F.col(f"l_{i}{i}")) for i in range(P)), F.lit(0.0))
    return c.select(*keep, *(f"m{i}" for i in range(P)), *(f"i_{i}{j}" for i, j in _LOWER), log_det.alias("log_det"))


def distance(z: list[Column]) -> Column:
    """Squared Mahalanobis distance of the statistics from the mean and factor in the same row."""
    y = [z[i] / float(GRID) - F.col(f"m{i}") for i in range(P)]
    parts = [sum((F.col(f"i_{i}{j}") * y[j] for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((x * x for x in parts), F.lit(0.0))


def _moments(weight: Column) -> list[Column]:
    sums = [F.sum(weight).alias("n"), *(F.sum(weight * F.col(f"z{i}")).alias(f"t{i}") for i in range(P))]
    return sums + [F.sum(weight * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"t_{i}{j}") for i, j in _LOWER]


def _scatter(c: DataFrame, keep: list[str], factor: float) -> DataFrame:
    """Mean and target + factor * covariance from sums of whole numbers."""
    n, wide = F.col("n").cast("decimal(38,0)"), lambda x: F.col(x).cast("decimal(38,0)")
    means = [(F.col(f"t{i}") / F.col("n") / float(GRID)).alias(f"m{i}") for i in range(P)]
    # n sum(xy) - sum(x) sum(y) is a whole number; only then it becomes a double
    cov = lambda i, j: (n * wide(f"t_{i}{j}") - wide(f"t{i}") * wide(f"t{j}")).cast("double") / (F.col("n").cast("double") * F.col("n") * float(GRID * GRID))
    return c.select(*keep, *means, *((F.lit(TOLERANCE[i] ** 2 if i == j else 0.0) + factor * cov(i, j)).alias(f"s_{i}{j}") for i, j in _LOWER))


def _medians(cells: DataFrame, values: list[Column], names: list[str]) -> DataFrame:
    """(pool, names): the least grid value that half of the rows do not exceed, of each of the values."""
    each = cells.select("pool", "rows", F.posexplode(F.array(*values)).alias("k", "v")).groupBy("pool", "k", "v").agg(F.sum("rows").alias("rows"))
    w = Window.partitionBy("pool", "k")
    below = F.sum("rows").over(w.orderBy("v"))
    half = each.withColumn("below", below).withColumn("all", F.sum("rows").over(w)).filter(2 * F.col("below") >= F.col("all"))
    return half.groupBy("pool").agg(*(F.min(F.when(F.col("k") == k, F.col("v"))).alias(name) for k, name in enumerate(names)))


def fit(stats: DataFrame, *, least_rows: int = LEAST_ROWS, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """((group, pool), estimates of each pool) from the rows of `statistics` that pass the base limits.

    The starts are mean and covariance of all rows, the medians with the target, and the medians with the target
    and the squared median deviations; the start of the least determinant wins, the first of equals."""
    z = [F.col("z")[i].alias(f"z{i}") for i in range(P)]
    counted = cut(stats.filter("not base_failed").select("group", "lang_key", *z).groupBy("group", "lang_key", *(f"z{i}" for i in range(P))).agg(F.count(F.lit(1)).alias("rows")))
    pooled = cut(pools(counted.groupBy("group", "lang_key").agg(F.sum("rows").alias("rows")), least_rows))
    cells = counted.join(pooled, "group").groupBy("pool", *(f"z{i}" for i in range(P))).agg(F.sum("rows").alias("rows"))
    sizes = cells.groupBy("pool").agg(F.sum("rows").alias("all")).filter(F.col("all") >= least_rows)
    cells = cut(cells.join(sizes, "pool"))

    middle = cut(_medians(cells, [F.col(f"z{i}") for i in range(P)], [f"c{i}" for i in range(P)]))
    apart = _medians(cells.join(middle, "pool"), [F.abs(F.col(f"z{i}") - F.col(f"c{i}")) for i in range(P)], [f"d{i}" for i in range(P)])
    centre = [(F.col(f"c{i}") / float(GRID)).alias(f"m{i}") for i in range(P)]

    def diagonal(spread) -> list[Column]:
        return [(F.lit(TOLERANCE[i] ** 2) + spread(i) if i == j else F.lit(0.0)).alias(f"s_{i}{j}") for i, j in _LOWER]

    starts = _scatter(cells.groupBy("pool").agg(*_moments(F.col("rows"))), ["pool"], 1.0).withColumn("start", F.lit(0))
    starts = starts.unionByName(middle.select("pool", *centre, *diagonal(lambda i: F.lit(0.0))).withColumn("start", F.lit(1)))
    deviation = lambda i: F.pow(F.col(f"d{i}") * (1.4826 / GRID), 2)
    starts = starts.unionByName(middle.join(apart, "pool").select("pool", *centre, *diagonal(deviation)).withColumn("start", F.lit(2)))
    # a step that gives an estimate back, or the one before it, would do so for ever: what the last step gives is known
    # then, and its cells meet no further steps
    found = _factor(starts, ["pool", "start"])
    names = [c for c in found.columns if c not in ("pool", "start")]
    now, none = F.struct(*names), F.lit(None)
    found = cut(found.withColumns({"still": F.lit(True), "before": F.when(none.cast("boolean"), now)}))
    for k in range(1, steps + 1):
        going = found.filter("still")
        was = going.select("pool", "start", now.alias("_now"), F.col("before").alias("_before"))
        new = _step(cells, going.drop("still", "before")).select("pool", "start", now.alias("_new")).join(was, ["pool", "start"])
        same, turns = F.col("_new").eqNullSafe(F.col("_now")), F.col("_new").eqNullSafe(F.col("_before"))
        moved = F.abs(F.col("_new.log_det") - F.col("_now.log_det"))
        last = F.col("_new") if (steps - k) % 2 == 0 else F.when(turns, F.col("_now")).otherwise(F.col("_new"))
        new = new.select("pool", "start", last.alias("_last"), (~same & ~turns).alias("still"), F.col("_now").alias("before"), moved.alias("moved"))
        new = new.select("pool", "start", *(F.col(f"_last.{c}").alias(c) for c in names), "still", "before", "moved")
        # from a table of known size: a checkpoint's estimate, which joins multiply, would have every cell shuffled for it
        found = written(found.filter("not still").withColumn("moved", F.lit(0.0)).unionByName(new), "estimates")[0]
        moved = found.filter("still").agg(F.max("moved")).first()[0]
        found = found.drop("moved")
        if moved is None or moved < 1e-9:
            break
    best = found.withColumn("_r", F.row_number().over(Window.partitionBy("pool").orderBy(F.round("log_det", 6), "start"))).filter("_r = 1").drop("_r", "start", "log_det", "still", "before")
    return pooled, cut(best)


def _step(cells: DataFrame, found: DataFrame) -> DataFrame:
    """One concentration step of every pool and start."""
    x = cells.join(found, "pool").withColumn("class", F.floor(CLASSES * F.log2(1 + GRID * distance([F.col(f"z{i}") for i in range(P)]))))
    by_class = x.groupBy("pool", "start", "all", "class").agg(*_moments(F.col("rows")))
    w = Window.partitionBy("pool", "start").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    half = F.floor((F.col("all") + P + 1) / 2)
    inner = by_class.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).filter(F.col("before") < half)
    names = ["n", *(f"t{i}" for i in range(P)), *(f"t_{i}{j}" for i, j in _LOWER)]
    # whole numbers may outgrow a long once classes are added
    summed = inner.groupBy("pool", "start").agg(*(F.sum(F.col(c).cast("decimal(28,0)")).cast("decimal(38,0)").alias(c) for c in names))
    return _factor(_scatter(summed.withColumn("n", F.col("n").cast("long")), ["pool", "start"], CONSISTENCY), ["pool", "start"])


def _verdicts(rows: DataFrame, model: tuple[DataFrame, DataFrame], level: float) -> DataFrame:
    pooled, estimates = model
    x = rows.join(pooled, "group", "left").join(estimates, "pool", "left")
    far = distance([F.col("z")[i] for i in range(P)])
    return x.withColumn("distance", F.when(~F.col("base_failed"), far)).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square_quantile(level, P), F.lit(True)))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, level: float = LEVEL, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(<id_col>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance), a row for
    each row of `docs`.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows of three. The rest is kept
    if its squared distance from its language and source's estimate is within the quantile; distance is null where
    there is no estimate (base_failed, or fewer than `least_rows` rows even when all small groups are pooled; such
    rows are kept). Null texts count as empty and fail the base limits; a null language or source is a value of its
    own; rows of a null or repeated id are rows like any other; equal rows get equal results; very long texts count
    whole; an empty table gives no rows; columns that are not named are not read."""
    stats = cut(statistics(docs, id_col, text_col, lang_col, source_col))
    found = _verdicts(stats, fit(stats, least_rows=least_rows), level)
    return found.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def drop_low_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *, level: float = LEVEL, least_rows: int = LEAST_ROWS) -> DataFrame:
    """`docs` without the rows that `quality_rules` does not keep; texts are read twice and never shuffled."""
    model = fit(statistics(docs.withColumn(name := fresh(docs.columns, "_id"), F.lit(0)), name, text_col, lang_col, source_col), least_rows=least_rows)
    names = docs.columns
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), group_of(F.col(lang_col), F.col(source_col)).alias("group"), base_statistics(F.col(text_col)).alias("s"))
    row = row.select("row", "group", base_failed(F.col("s")).alias("base_failed"), vector(F.col("s")).alias("z"))
    return _verdicts(row, model, level).filter("kept").select("row.*")
