"""Text, URL and list-literal functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domain classes and top-level domains of the post features; stop words of the tokeniser.
TLDS = ("com", "org", "net", "edu", "gov", "co", "ru", "uk")
STOP = tuple("a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its just like more my no not of on one or our out so some than that the their them then there these they this to up was we were what when which who will with would you your".split())


def urls_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(https?://\S+)"), 1)


def domain_of(url: Column) -> Column:
    """Host in lower case without a leading www.; port and user info stay."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")


def tokens(text: Column) -> Column:
    """Words of two or more letters and apostrophes in lower case, without URLs and stop words."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(text, r"https?://\S+", " ")), F.lit("([a-z][a-z']+)"), 1)
    return F.filter(words, lambda w: ~w.isin(*STOP))


def bigrams(words: Column) -> Column:
    def pairs(w: Column) -> Column:
        n = F.size(w)
        return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.concat_ws(" ", w[i], w[i + 1]))).otherwise(F.array().cast("array<string>"))

    return F.transform(F.array(words), pairs)[0]  # the words are bound once, wherever the expression is moved


def parse_list(literal: Column) -> Column:
    """The items of a list literal such as ['a', 'b']."""
    parts = F.split(F.regexp_replace(F.lower(literal), r"[\[\]']", ""), ",")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def count_of(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def ratio_of(text: Column, kind: str) -> Column:
    """Share of the characters of a class, 0 for the empty text."""
    return F.coalesce((F.length(text) - F.length(F.regexp_replace(text, f"[{kind}]", ""))) / F.nullif(F.length(text), F.lit(0)).cast("double"), F.lit(0.0))


def share_in(words: Column, vocabulary: Column | list[str]) -> Column:
    """Share of the words that a vocabulary has; a list, unlike a column, is looked up by hash."""
    return F.size(F.filter(words, lambda w: w.isin(vocabulary) if isinstance(vocabulary, list) else F.array_contains(vocabulary, w))) / F.greatest(F.size(words), F.lit(1)).cast("double")


#: The domain classes of the post features, and the flagged top-level domains.
NEWS_SITES = (
    "nytimes.com", "washingtonpost.com", "cnn.com", "foxnews.com", "bbc.com", "bbc.co.uk", "reuters.com", "apnews.com",
    "theguardian.com", "wsj.com", "usatoday.com", "nbcnews.com", "abcnews.go.com", "cbsnews.com", "politico.com",
    "thehill.com", "huffpost.com", "huffingtonpost.com", "breitbart.com", "dailycaller.com", "nypost.com",
    "latimes.com", "chicagotribune.com", "bloomberg.com", "time.com", "newsweek.com", "buzzfeednews.com",
    "buzzfeed.com", "vox.com", "salon.com", "slate.com", "theatlantic.com", "npr.org", "rt.com", "sputniknews.com",
    "dailymail.co.uk", "independent.co.uk", "telegraph.co.uk", "aljazeera.com", "msnbc.com", "cnbc.com", "yahoo.com",
    "news.yahoo.com", "infowars.com", "truthfeed.com", "washingtontimes.com", "thegatewaypundit.com", "rawstory.com",
    "motherjones.com", "theblaze.com",
)
SOCIAL_SITES = (
    "twitter.com", "t.co", "facebook.com", "fb.me", "youtube.com", "youtu.be", "instagram.com", "reddit.com",
    "redd.it", "imgur.com", "i.redd.it", "v.redd.it", "i.imgur.com", "vk.com", "tumblr.com", "pinterest.com",
    "linkedin.com", "twitch.tv", "gfycat.com", "giphy.com",
)
PLATFORM_SITES = (
    "twitter.com", "t.co", "reddit.com", "redd.it", "i.redd.it", "v.redd.it",
)
TOP_LEVELS = (
    "com", "org", "net", "ru", "uk", "info", "co", "us",
)


def domain_classes(domain: Column) -> dict[str, Column]:
    """0/1 flags of a domain: news, social, platform, other (named but neither news nor social) and tld_<name>."""
    news, social = domain.isin(*NEWS_SITES), domain.isin(*SOCIAL_SITES)
    last = F.element_at(F.split(domain, r"\."), -1)
    flags = {"news": news, "social": social, "platform": domain.isin(*PLATFORM_SITES), "other": (domain != "") & ~news & ~social}
    return {k: c.cast("int") for k, c in (flags | {f"tld_{t}": last == t for t in TOP_LEVELS}).items()}
