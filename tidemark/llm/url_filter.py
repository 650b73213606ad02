"""URL verdicts: rules first, then gradient-boosted trees on lexical features.

Features are expressions over the URL alone: lengths, depth, digit ratio, entropy, parameter counts, and what
the labelled URLs show of its suffix (the last two labels of the host). Counts, rates and the bins of the features
come from all labelled URLs, and the trees are fitted by pyspark.ml on all of them, distributed; judging is one narrow
pass inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import inf, log1p

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import of_counts
from .common import cut, fresh

#: Suffixes that get statistics of their own: the commonest; others take the base rate.
SUFFIXES = 200
TREES, DEPTH, BINS = 12, 4, 32
BLOCK_AT = 0.5
FEATURES = ("url_chars", "host_chars", "path_chars", "query_chars", "host_labels", "depth", "digits", "hyphens", "host_digits", "parameters", "entropy", "host_entropy", "longest_label", "suffix_rate", "suffix_log_count", "has_fragment", "secure")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty if there is no ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the (verdict, host, path) rules that fits, else nulls.

    A rule fits its host and all its subdomains if the path starts with the rule's. Rules are configuration:
    a list of bounded length, tested one by one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters a-z, 0-9 and the commonest signs; others count as one kind."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    signs = "abcdefghijklmnopqrstuvwxyz0123456789-./"
    counts = [(F.length(text) - F.length(F.translate(text, c, ""))).cast("double") for c in signs]
    rest = F.length(F.translate(text, signs, "")).cast("double")
    total = F.lit(0.0)
    for c in [*counts, rest]:
        total = total + F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0)
    return total


def _count(text: Column, sign: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))).cast("double")


def lexical(urls: DataFrame, url_col: str, suffixes: dict[str, tuple[float, float]], base_rate: float) -> tuple[DataFrame, list[str]]:
    """`urls` with the features after its columns, and the names of theirs; see FEATURES."""
    url = F.lower(F.coalesce(F.col(url_col), F.lit("")))
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    digits = lambda t: F.length(F.regexp_replace(t, "[^0-9]", "")).cast("double")
    known = F.create_map(*(x for k, (rate, n) in suffixes.items() for x in (F.lit(k), F.array(F.lit(rate), F.lit(n))))) if suffixes else None
    stats = F.try_element_at(known, suffix_of(host)) if suffixes else F.lit(None).cast("array<double>")
    values = (
        size, F.length(host).cast("double"), F.length(path).cast("double"), F.length(query).cast("double"),
        F.size(F.split(host, r"\.")).cast("double"), _count(path, "/"), digits(url) / size, _count(url, "-"), digits(host),
        F.when(F.length(query) > 0, _count(query, "&") + 1).otherwise(0.0), _entropy(url), _entropy(host),
        F.array_max(F.transform(F.split(host, r"\."), F.length)).cast("double"),
        F.coalesce(stats[0], F.lit(base_rate)), F.coalesce(stats[1], F.lit(0.0)),
        url.contains("#").cast("double"), url.startswith("https").cast("double"),
    )
    names = [fresh(urls.columns, f"_{f}") for f in FEATURES]
    return urls.select("*", *(v.alias(n) for n, v in zip(names, values, strict=True))), names


def assembled(frame: DataFrame, names: list[str], bins: list[list[float]]) -> DataFrame:
    """The named features replaced by the vector `features` of their bins' numbers."""
    inside = [fresh(frame.columns, f"{n}_bin") for n in names]
    splits = [[-inf, *(starts or [0.0]), inf] for starts in bins]
    frame = Bucketizer(splitsArray=splits, inputCols=names, outputCols=inside, handleInvalid="keep").transform(frame)
    return VectorAssembler(inputCols=inside, outputCol="features", handleInvalid="keep").transform(frame).drop(*names, *inside)


@dataclass
class Model:
    trees: GBTClassificationModel | None
    suffixes: dict[str, tuple[float, float]]
    base_rate: float
    bins: list[list[float]]


def _bins(frame: DataFrame, names: list[str]) -> list[list[float]]:
    """For each feature the values at which its bins begin: each distinct value where these are BINS at most, else
    exact quantiles over all rows. A bin of the values below the first comes before them."""
    each = frame.select(F.posexplode(F.array(*names)).alias("k", "v")).groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    each = cut(each)
    few = {x["k"] for x in each.groupBy("k").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") <= BINS).collect()}
    starts: list[set[float]] = [set() for _ in names]
    for x in each.filter(F.col("k").isin(*few)).collect() if few else []:  # BINS rows a feature at most
        starts[x["k"]].add(x["v"])
    many = each.filter(~F.col("k").isin(*few)) if few else each
    for x in of_counts(many, ["k"], "v", "n", [i / BINS for i in range(1, BINS)]).collect():  # a row for each feature
        starts[x["k"]].update(x["q"])
    return [sorted(s) for s in starts]


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", *, suffixes: int = SUFFIXES) -> Model:
    """Fit on all labelled URLs (1: unwanted, 0: wanted; other labels and null URLs are left out).

    With one class only, or none, there are no trees and the verdict is that class (allow without any row)."""
    known = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("url").isNotNull())
    rows = cut(known)
    by_class = {x["label"]: x["n"] for x in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(by_class.values())
    rate = by_class.get(1, 0) / total if total else 0.0
    if len(by_class) < 2:
        return Model(None, {}, rate, [])
    stats = rows.groupBy(suffix_of(host_of(F.col("url"))).alias("suffix")).agg(F.count(F.lit(1)).alias("w"), F.sum("label").alias("bad"))
    stats = stats.orderBy(F.col("w").desc(), "suffix").limit(suffixes).collect()
    smooth = 20.0  # weight of the base rate in a suffix's rate
    table = {x["suffix"]: ((x["bad"] + smooth * rate) / (x["w"] + smooth), log1p(x["w"])) for x in stats}
    frame, names = lexical(rows, "url", table, rate)
    frame = cut(frame)
    bins = _bins(frame, names)
    train = cut(assembled(frame, names, bins).select("features", F.col("label").cast("double").alias("label")))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=2 * BINS, stepSize=0.3, seed=1).fit(train)
    return Model(trees, table, rate, bins)


def judge(urls: DataFrame, model: Model, rules: list[tuple[str, str, str]], url_col: str = "url", *, block_at: float = BLOCK_AT) -> DataFrame:
    """`urls` with host, path, rule, unwanted (probability, also where a rule decides) and verdict at the end.

    A null URL and one without :// has an empty host and path, fits no rule and is judged on its text alone.
    Rows are kept as they are, repeated ones too; an empty table gives no rows. Columns that bear one of the
    new names are replaced, except the URL itself."""
    new = ("host", "path", "rule", "unwanted", "verdict", "features", "rawprediction", "probability", "prediction")
    urls = urls.drop(*(c for c in urls.columns if c.lower() in new and c != url_col))
    source = fresh([*urls.columns, *new], "_url")
    kept = [c for c in urls.columns]
    frame = urls.select(F.struct(*(F.col(c) for c in kept)).alias("row"), F.col(url_col).cast("string").alias(source))
    if model.trees is None:
        frame = frame.withColumn("unwanted", F.lit(float(model.base_rate)))
    else:
        frame = assembled(*lexical(frame, source, model.suffixes, model.base_rate), model.bins)
        frame = model.trees.transform(frame).withColumn("unwanted", vector_to_array("probability")[1])
    host, path = host_of(F.col(source)), path_of(F.col(source))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    frame = frame.select("row", host.alias("host"), path.alias("path"), "unwanted")
    own = F.when(F.col("unwanted") >= block_at, "block").otherwise("allow")
    frame = frame.select("row", "host", "path", rule.alias("rule"), "unwanted", F.coalesce(verdict, own).alias("verdict"))
    return frame.select("row.*", "host", "path", "rule", "unwanted", "verdict")
