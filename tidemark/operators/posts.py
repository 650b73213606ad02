"""Posts: vocabularies of two classes and the block of scalar features of a post."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .profile import timed

HOURS = [f"hour_{h}" for h in range(24)]
WEEKDAYS = [f"weekday_{d}" for d in range(7)]
COUNTS = ["words", "chars", "urls", "hashes", "ats", "bangs", "questions", "upper", "digits", "word_length", "has_url", "is_reply"]
SHARES = ["top_words_1", "top_words_0", "top_bigrams_1", "top_bigrams_0"]
DOMAINS = ["news", "social", "platform", "other", "top_domain_1", "top_domain_0"]
#: The 61 features in their order.
FEATURES = [*COUNTS, *SHARES, *DOMAINS, *(f"tld_{t}" for t in X.TOP_LEVELS), *HOURS, *WEEKDAYS]


def prepared(posts: DataFrame) -> DataFrame:
    """Adds tokens, bigrams, the URLs and the first URL's domain (empty without one) to rows with `text`."""
    found = posts.withColumns({"_tokens": X.tokens(F.col("text")), "_urls": X.urls_of(F.col("text"))})
    domain = F.when(F.size("_urls") > 0, X.domain_of(F.col("_urls")[0])).otherwise("")
    return found.withColumns({"_bigrams": X.bigrams(F.col("_tokens")), "_domain": domain})


def class_counts(ready: DataFrame, label: str = "y") -> DataFrame:
    """(y, kind, term, n): words, bigrams and domains of each class."""
    kinds = F.array(
        F.struct(F.lit("word").alias("kind"), F.col("_tokens").alias("terms")),
        F.struct(F.lit("bigram").alias("kind"), F.col("_bigrams").alias("terms")),
        F.struct(F.lit("domain").alias("kind"), F.filter(F.array("_domain"), lambda d: d != "").alias("terms")),
    )
    each = ready.select(F.col(label).alias("y"), F.explode(kinds).alias("k"))
    return each.select("y", "k.kind", F.explode("k.terms").alias("term")).groupBy("y", "kind", "term").agg(F.count(F.lit(1)).alias("n"))


def top_terms(counts: DataFrame, k: int = 25) -> DataFrame:
    """(y, kind, term, n): the k commonest of each class and kind, ties in the term's order."""
    rank = F.row_number().over(Window.partitionBy("y", "kind").orderBy(F.desc("n"), "term"))
    return counts.withColumn("_r", rank).filter(F.col("_r") <= k).drop("_r")


def vocabulary(top: DataFrame) -> DataFrame:
    """One row of six lists of at most k terms each, such as word_1."""
    lists = [(kind, y) for kind in ("word", "bigram", "domain") for y in (1, 0)]
    return top.agg(*(F.collect_list(F.when((F.col("kind") == kind) & (F.col("y") == y), F.col("term"))).alias(f"{kind}_{y}") for kind, y in lists))


def features(ready: DataFrame, words: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and the 61 features; rows need `ts` and `is_reply`, `words` is the one row of `vocabulary`."""
    t = F.col("text")
    plain = F.regexp_replace(t, r"https?://\S+", " ")
    n_words = F.regexp_count(plain, F.lit(r"\S+"))
    # six lists of at most k terms: as constants a word is looked up by its hash, not compared with each term
    known = words.first()
    letters = F.length(F.regexp_replace(plain, r"\s+", ""))
    flag = lambda c: F.coalesce(c.cast("int"), F.lit(0))

    def named() -> dict[str, Column]:
        out = {"words": n_words, "chars": F.length(t), "urls": F.size("_urls"), "has_url": flag(F.size("_urls") > 0), "is_reply": F.col("is_reply")}
        out |= {n: X.count_of(t, s) for n, s in (("hashes", "#"), ("ats", "@"), ("bangs", "!"), ("questions", "?"))}
        out |= {"upper": X.ratio_of(t, r"\p{Lu}"), "digits": X.ratio_of(t, r"\p{Nd}"), "word_length": F.coalesce(letters / F.nullif(n_words, F.lit(0)), F.lit(0.0))}
        for y in (1, 0):
            out |= {f"top_words_{y}": X.share_in(F.col("_tokens"), known[f"word_{y}"]), f"top_bigrams_{y}": X.share_in(F.col("_bigrams"), known[f"bigram_{y}"])}
            out[f"top_domain_{y}"] = flag(F.col("_domain").isin(known[f"domain_{y}"]))
        out |= X.domain_classes(F.col("_domain"))
        out |= {h: flag(F.hour(timed(F.col("ts"))) == i) for i, h in enumerate(HOURS)}
        return out | {d: flag(F.weekday(timed(F.col("ts"))) == i) for i, d in enumerate(WEEKDAYS)}

    every = named()
    return ready.select(*keep, *(every[f].cast("double").alias(f) for f in FEATURES))
