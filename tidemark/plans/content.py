"""Queries: posts of accounts, their vocabularies, the feature block and the content classifier (D18, D20, M9)."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import models as M
from ..operators import posts as B
from ..operators import sampling as S
from ..session import cut
from .base import DRAW_SQL, events, rounded, sql, table
from .scores import _FLAGS, DOM, TOK

QUERIES, ORACLE_SQL = {}, {}


def query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return put


# A document is the post of the event with its number, with the URL of the page of that number.
POSTS = (
    '(SELECT d.doc_id, e."user", (e.pop = \'op\')::INT AS y, e.ts, (e.action = 1)::INT AS is_reply, '
    f"{DRAW_SQL.format(chr(39) + 'post|' + chr(39) + ' || e.' + chr(34) + 'user' + chr(34))} % 10 >= 3 AS train, "
    "CASE WHEN p.url IS NULL THEN d.text ELSE d.text || ' ' || p.url END AS text "
    "FROM documents d JOIN $EV e ON e.event_id = d.doc_id LEFT JOIN pages p ON p.page_id = d.doc_id WHERE d.text IS NOT NULL)"
)
BIGRAMS = "list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1])"
READY = (
    f"(SELECT *, {BIGRAMS} AS bg, CASE WHEN len(ul) > 0 THEN {DOM.replace('(url,', '(ul[1],')} ELSE '' END AS dom FROM "
    f"(SELECT *, {TOK} AS tk, regexp_extract_all(text, 'https?://\\S+') AS ul, regexp_replace(text, 'https?://\\S+', ' ', 'g') AS plain FROM {POSTS}))"
)
TERMS = (
    f"(SELECT y, kind, term, count(*) AS n FROM (SELECT y, 'word' AS kind, unnest(tk) AS term FROM {READY} WHERE train "
    f"UNION ALL SELECT y, 'bigram', unnest(bg) FROM {READY} WHERE train UNION ALL SELECT y, 'domain', dom FROM {READY} WHERE train AND dom <> '') GROUP BY ALL)"
)
TOP = f"(SELECT y, kind, term, n FROM {TERMS} QUALIFY row_number() OVER (PARTITION BY y, kind ORDER BY n DESC, term) <= 25)"


def posts(spark, sf):
    e = events(spark, sf).select(F.col("event_id").alias("doc_id"), "user", (F.col("pop") == "op").cast("int").alias("y"), "ts", (F.col("action") == 1).cast("int").alias("is_reply"))
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", "text").join(e, "doc_id")
    p = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    text = F.when(F.col("url").isNull(), F.col("text")).otherwise(F.concat("text", F.lit(" "), "url"))
    train = F.pmod(S.draw("post", F.col("user")), F.lit(10)) >= 3
    return B.prepared(d.join(p, "doc_id", "left").withColumns({"text": text, "train": train}).drop("url"))


@query("d18b_class_terms", f"SELECT y, kind, term, n FROM {TERMS}")
def d18b(spark, sf):
    """Words, bigrams and domains of the two classes over the posts of training accounts."""
    return B.class_counts(posts(spark, sf).filter("train"))


@query("f2b_top_terms", f"SELECT y, kind, term, n FROM {TOP}")
def f2b(spark, sf):
    return B.top_terms(B.class_counts(posts(spark, sf).filter("train")))


def block(spark, sf):
    ready = posts(spark, sf)
    top = B.vocabulary(B.top_terms(B.class_counts(ready.filter("train"))))
    return B.features(ready, top, ["doc_id", "user", "y", "train", "text"])


_share = lambda xs, kind, y: f"len(list_filter({xs}, lambda z: list_contains({kind}_{y}, z))) / greatest(len({xs}), 1)::DOUBLE"
_minus = lambda c: f"length(text) - length(replace(text, '{c}', ''))"
_ratio = lambda c: f"(length(text) - length(regexp_replace(text, '{c}', '', 'g'))) / greatest(length(text), 1)::DOUBLE"
_SQL = {
    "words": "len(regexp_extract_all(plain, '\\S+'))",
    "chars": "length(text)",
    "urls": "len(ul)",
    "hashes": _minus("#"),
    "ats": _minus("@"),
    "bangs": _minus("!"),
    "questions": _minus("?"),
    "upper": _ratio("\\p{Lu}"),
    "digits": _ratio("\\p{Nd}"),
    "word_length": "coalesce(length(regexp_replace(plain, '\\s+', '', 'g')) / nullif(len(regexp_extract_all(plain, '\\S+')), 0)::DOUBLE, 0)",
    "has_url": "(len(ul) > 0)::INT",
    "is_reply": "is_reply",
    "top_words_1": _share("tk", "word", 1),
    "top_words_0": _share("tk", "word", 0),
    "top_bigrams_1": _share("bg", "bigram", 1),
    "top_bigrams_0": _share("bg", "bigram", 0),
    "top_domain_1": "list_contains(domain_1, dom)::INT",
    "top_domain_0": "list_contains(domain_0, dom)::INT",
}
_SQL |= {k: f"coalesce(({c.replace('d ', 'dom ', 1) if c.startswith('d ') else c.replace('(d,', '(dom,')})::INT, 0)" for k, c in _FLAGS.items()}
_SQL["other"] = "(dom <> '' AND NOT (" + _FLAGS["news"].replace("d IN", "dom IN") + ") AND NOT (" + _FLAGS["social"].replace("d IN", "dom IN") + "))::INT"
_SQL |= {h: f"(hour(make_timestamp(ts * 1000000)) = {i})::INT" for i, h in enumerate(B.HOURS)}
_SQL |= {d: f"(isodow(make_timestamp(ts * 1000000)) = {i + 1})::INT" for i, d in enumerate(B.WEEKDAYS)}
_LISTS = ", ".join(f"coalesce(list(term) FILTER (kind = '{k}' AND y = {y}), []) AS {k}_{y}" for k in ("word", "bigram", "domain") for y in (1, 0))


@query(
    "d20b_post_block",
    f"WITH v AS (SELECT {_LISTS} FROM {TOP}) SELECT doc_id, \"user\", y, " + ", ".join(f"round(({_SQL[f]})::DOUBLE, 6) AS {f}" for f in B.FEATURES) + f" FROM {READY}, v",
)
def d20b(spark, sf):
    """The 61 scalar features of every post."""
    return rounded(block(spark, sf).drop("train", "text"))


TOPICS = 20


def with_topics(rows):
    """Adds TOPICS topic shares, learned from the training posts' words, and drops the text: words become counts once, which
    the steps of the fit read."""
    words = rows.withColumn("w", X.tokens(F.col("text")))
    counter = CountVectorizer(inputCol="w", outputCol="counts", vocabSize=5000, minDF=5.0).fit(words.filter("train"))
    counted = cut(counter.transform(words).drop("w", "text"))
    lda = LDA(k=TOPICS, optimizer="online", maxIter=5, seed=1, featuresCol="counts").fit(counted.filter("train").select("counts"))
    shares = vector_to_array("topicDistribution")
    return lda.transform(counted).select("*", *(shares[i].alias(f"topic_{i}") for i in range(TOPICS))).drop("counts", "topicDistribution")


@query("m9_content_classifier")
def m9(spark, sf):
    """Feature block and topics, a forest on the posts of training accounts, at most two organic posts for each other
    one; the mean score of each held-out account."""
    rows = cut(with_topics(block(spark, sf)))
    train = rows.filter("train")
    n = train.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    share = F.least(F.lit(1.0), 2.0 * F.col("p") / F.nullif(F.col("q"), F.lit(0)))
    ratio = train.join(F.broadcast(n)).filter((F.col("y") == 1) | (S.draw("ratio", F.col("doc_id")) < share * 2.0**32)).drop("p", "q")
    columns = [*B.FEATURES, *(f"topic_{i}" for i in range(TOPICS))]
    s = M.fit_score(ratio, rows.filter(~F.col("train")), columns, "rf", "doc_id").drop("y")
    return s.join(rows.select("doc_id", "user", "y"), "doc_id").groupBy("user", "y").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("posts"))
