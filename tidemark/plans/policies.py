"""Queries: policies, rescaled times, synchrony, graphs, text models, sources, streaming (groups A, M, N, P, S, X)."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import evaluate as V
from ..operators import graph as N
from ..operators import markov as K
from ..operators import mixture as L
from ..operators import models as M
from ..operators import profile as P
from ..operators import rescale as R
from ..operators import sampling as S
from ..operators import sequences as Q
from ..operators import sync as Y
from ..operators import topics as Z
from ..session import cut, scratch
from ..sources import readers as A
from ..streaming import profiles as kept
from ..streaming.ingest import daily_counts
from .base import DRAW_SQL, events, rounded, sql, table
from .profiles import CENTROID, DEC, ERA_COLUMNS, ORDERS_SQL, PAIR, orders, profile_sql
from .scores import SYMBOLS, TENTHS, TOK, TOKENS, auc_sql, tokens

QUERIES, ORACLE_SQL = {}, {}


def query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return put


# ---- Markov policies
STEPS = f'(SELECT *, token AS next, lag(token) OVER (PARTITION BY "user" ORDER BY ts, event_id) AS prev FROM {TOKENS})'


def llr_sql(steps: str, symbols: int, extra: str = "", a: str = "pop = 'op'", b: str = "pop = 'organic'") -> str:
    """llr and nll of each account; `extra` keys (with a trailing comma) split the fits."""
    def law(cond):
        return f"(SELECT *, sum(n) OVER (PARTITION BY {extra}prev) AS t FROM (SELECT {extra}prev, next, count(*) AS n FROM {steps} WHERE prev IS NOT NULL AND {cond} GROUP BY ALL))"

    join = lambda k: " AND ".join(f"s.{c.strip()} = {k}.{c.strip()}" for c in [*(extra.split(",")[:-1]), "prev", "next"])
    state = lambda k: " AND ".join(f"s.{c.strip()} = {k}.{c.strip()}" for c in [*(extra.split(",")[:-1]), "prev"])
    tot = lambda cond: f"(SELECT {extra}prev, count(*) AS t FROM {steps} WHERE prev IS NOT NULL AND {cond} GROUP BY ALL)"
    keys = "".join(f"s.{c.strip()}, " for c in extra.split(",")[:-1])
    la, lb = (f"ln((coalesce({k}n, 0) + 1.0::DOUBLE) / (coalesce({k}t, 0) + {symbols}))" for k in "ab")
    return f"""SELECT {extra}"user", pop, round(avg({la}) - avg({lb}), 6) + 0.0 AS llr, round(-avg({la}), 6) AS nll_a FROM (SELECT {keys}s."user", s.pop, a.n AS an, b.n AS bn, aa.t AS "at", bb.t AS bt
        FROM {steps} s LEFT JOIN {law(a)} a ON {join('a')} LEFT JOIN {law(b)} b ON {join('b')} LEFT JOIN {tot(a)} aa ON {state('aa')} LEFT JOIN {tot(b)} bb ON {state('bb')} WHERE s.prev IS NOT NULL) GROUP BY ALL""".replace("coalesce(at, 0)", 'coalesce("at", 0)')


def policy_scores(rows, symbols: int, lags: int = 1, token: str = "token"):
    """Accounts scored by the ratio of the two populations' policies."""
    pairs = K.steps(rows, ["user"], token, lags)
    a, b = (K.fit(pairs.filter(F.col("pop") == p), [], symbols) for p in ("op", "organic"))
    return K.ratio(pairs, ["user", "pop"], a, b, symbols)


@query("m11_token_policy", llr_sql(STEPS, 30))
def m11(spark, sf):
    return rounded(policy_scores(tokens(spark, sf), 30))


@query("m11_policy_auc", f"SELECT round(auc, 5) AS auc FROM ({auc_sql('(SELECT llr AS score, (pop = ' + chr(39) + 'op' + chr(39) + ')::INT AS y FROM (' + llr_sql(STEPS, 30) + '))')})")
def m11_auc(spark, sf):
    s = rounded(policy_scores(tokens(spark, sf), 30)).select(F.col("llr").alias("score"), (F.col("pop") == "op").cast("int").alias("y"))
    return rounded(V.auc(s, []), 5)


POOLED = f"(SELECT g.*, action * 10 + least(len(list_filter(q, lambda z: z <= sec / 60.0::DOUBLE)), 9) AS token FROM (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY \"user\" ORDER BY ts, event_id), 0) AS sec FROM $EV) g, (SELECT list_sort(list_distinct(quantile_cont(sec / 60.0::DOUBLE, {TENTHS}))) AS q FROM (SELECT platform, coalesce(ts - lag(ts) OVER (PARTITION BY \"user\" ORDER BY ts, event_id), 0) AS sec FROM $EV) WHERE platform = 'A'))"
FROZEN = f'(SELECT *, token AS next, lag(token) OVER (PARTITION BY "user" ORDER BY ts, event_id) AS prev FROM {POOLED})'


@query("m12_frozen_quantiser", llr_sql(FROZEN, 30))
def m12(spark, sf):
    g = Q.gaps(events(spark, sf), ["user"])
    edges = Q.decile_edges(g.filter("platform = 'A'"), ["platform"]).select("edges")
    bin_ = F.least(Q.edges_below(F.col("edges"), F.col("gap")), F.lit(9))
    rows = g.join(F.broadcast(edges)).withColumn("token", (F.col("action") * 10 + bin_).cast("int"))
    return rounded(policy_scores(rows, 30))


@query("m13_policy_by_platform", llr_sql(STEPS, 30, "platform, "))
def m13(spark, sf):
    rows = tokens(spark, sf)
    parts = [policy_scores(rows.filter(F.col("platform") == p), 30).withColumn("platform", F.lit(p)) for p in ("A", "B")]
    return rounded(parts[0].unionByName(parts[1]))


SECOND = "(SELECT *, action AS next, lag(action, 2) OVER w || ',' || lag(action, 1) OVER w AS prev FROM $EV WINDOW w AS (PARTITION BY \"user\" ORDER BY ts, event_id))"


@query("m14_action_policy", llr_sql(SECOND, 3))
def m14(spark, sf):
    return rounded(policy_scores(events(spark, sf), 3, 2, "action"))


@query("m17_refit_other_source", llr_sql(STEPS, 30, "", "platform = 'A' AND pop = 'op'", "platform = 'A' AND pop = 'organic'"))
def m17(spark, sf):
    pairs = K.steps(tokens(spark, sf), ["user"])
    a, b = (K.fit(pairs.filter((F.col("platform") == "A") & (F.col("pop") == p)), [], 30) for p in ("op", "organic"))
    return rounded(K.ratio(pairs, ["user", "pop"], a, b, 30))


@query("m17b_refit_action_policy", llr_sql(SECOND, 3, "", "platform = 'A' AND pop = 'op'", "platform = 'A' AND pop = 'organic'"))
def m17b(spark, sf):
    pairs = K.steps(events(spark, sf), ["user"], "action", 2)
    a, b = (K.fit(pairs.filter((F.col("platform") == "A") & (F.col("pop") == p)), [], 3) for p in ("op", "organic"))
    return rounded(K.ratio(pairs, ["user", "pop"], a, b, 3))


@query("m19_cross_entropy", f"SELECT pop, round(-avg(ln((n + 1.0::DOUBLE) / (t + 30))), 6) AS nats, round(exp(-avg(ln((n + 1.0::DOUBLE) / (t + 30)))), 5) AS perplexity FROM (SELECT pop, count(*) OVER (PARTITION BY pop, prev, next) AS n, count(*) OVER (PARTITION BY pop, prev) AS t FROM {STEPS} WHERE prev IS NOT NULL) GROUP BY pop")
def m19(spark, sf):
    pairs = K.steps(tokens(spark, sf), ["user"])
    law = K.fit(pairs, ["pop"], 30)
    j = pairs.join(F.broadcast(law), ["pop", "prev", "next"]).groupBy("pop").agg((-F.avg("logp")).alias("nats"))
    return j.select("pop", (F.round("nats", 6) + 0.0).alias("nats"), (F.round(F.exp("nats"), 5) + 0.0).alias("perplexity"))


GRAMS = f"(SELECT \"user\", unnest(list_concat(list_transform(range(1, length(text) + 1), lambda i: text[i:i]), list_transform(range(1, length(text)), lambda i: text[i:i+1]))) AS g FROM {SYMBOLS})"
TFIDF = f"(SELECT \"user\", g, (1 + ln(count(*))) * (ln((1 + (SELECT count(DISTINCT \"user\") FROM $EV)::DOUBLE) / (1 + count(*) OVER (PARTITION BY g))) + 1) AS v FROM {GRAMS} GROUP BY \"user\", g)"


def tfidf(spark, sf):
    g = Q.symbols(events(spark, sf), ["user"]).select("user", F.explode(Q.grams(F.col("text"))).alias("g"))
    tf = g.groupBy("user", "g").agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    n = tf.agg(F.count_distinct("user").alias("users"))
    v = (1 + F.log(F.col("n").cast("double"))) * (F.log((1 + F.col("users")) / (1 + F.col("df")).cast("double")) + 1)
    rows = tf.join(df, "g").join(F.broadcast(n)).select("user", "g", v.alias("v"))
    return rows.select("user", "g", (F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("user")))).alias("x"))


@query("m7_symbol_tfidf", f'SELECT "user", g, round(v / sqrt(sum(v * v) OVER (PARTITION BY "user")), 6) AS x FROM {TFIDF}')
def m7(spark, sf):
    return rounded(tfidf(spark, sf))


# ---- classifiers (fits: rows only)
def profiled(spark, sf):
    p = P.profile(events(spark, sf), ["pop", "user"])
    return cut(S.holdout(p.withColumn("y", (F.col("pop") == "op").cast("int")), "pop", "user", "split"))


def split_scores(spark, sf, kind, columns):
    p = profiled(spark, sf)
    return M.fit_score(p.filter("split = 'train'"), p.filter("split = 'test'"), columns, kind, "user")


ALL = [c for g in P.GROUPS.values() for c in g]
for _id, _kind in (("m1_logistic_profile", "lr"), ("m2_boosted_profile", "gbt"), ("m3_forest_profile", "rf")):
    query(_id)(lambda spark, sf, k=_kind: split_scores(spark, sf, k, ALL))


@query("m5_in_platform_auc")
def m5(spark, sf):
    s = split_scores(spark, sf, "lr", ALL)
    return V.auc(s, []).join(F.broadcast(V.bootstrap_auc(s, [], "user", 100, "m5").agg(*V.interval())))


@query("m10_vector_classifier")
def m10(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding"), (F.col("label") == 0).cast("int").alias("y"))
    names = [f"x{i}" for i in range(64)]
    e = e.select("vec_id", "y", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)))
    held = F.pmod(S.draw("m10", F.col("vec_id")), F.lit(10)) < 3
    return M.fit_score(e.filter(~held), e.filter(held), names, "lr", "vec_id")


@query("m8_topic_shares")
def m8(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", X.tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    # words become counts once, which the steps of the fit read
    words = CountVectorizer(inputCol="w", outputCol="features", vocabSize=5000, minDF=5.0).fit(d)
    counts = Z.dealt(words.transform(d).select("doc_id", "features"), "doc_id")
    return Z.shares(Z.fit(counts, len(words.vocabulary), 20, 5), counts, ["doc_id"])


# ---- post text
@query("d18_class_counts", f"SELECT y, w, count(*) AS n FROM (SELECT toxic AS y, unnest({TOK}) AS w FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL) GROUP BY ALL")
def d18(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").join(table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    return d.select("y", F.explode(X.tokens(F.col("text"))).alias("w")).groupBy("y", "w").agg(F.count(F.lit(1)).alias("n"))


@query("d20_post_features", f"SELECT conv_id, turn, length(text)::BIGINT AS chars, len({TOK})::BIGINT AS words, round(len(list_distinct({TOK})) / greatest(len({TOK}), 1)::DOUBLE, 6) AS distinct_share, (length(text) - length(replace(text, '?', '')))::BIGINT AS questions, round((length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::DOUBLE / greatest(length(text), 1), 6) AS upper FROM conversations WHERE text IS NOT NULL")
def d20(spark, sf):
    c = table(spark, sf, "conversations").filter("text is not null").select("conv_id", "turn", "text", F.transform(F.array(X.tokens(F.col("text"))), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))[0].alias("w"))
    return rounded(c.select("conv_id", "turn", F.length("text").cast("long").alias("chars"), F.col("w.n").cast("long").alias("words"), (F.col("w.d") / F.greatest(F.col("w.n"), F.lit(1))).alias("distinct_share"), X.count_of(F.col("text"), "?").cast("long").alias("questions"), X.ratio_of(F.col("text"), "A-Z").alias("upper")))


@query("f2_top_words", f"SELECT lang, w, n FROM (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest({TOK}) AS w FROM documents WHERE text IS NOT NULL) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) <= 25")
def f2w(spark, sf):
    w = table(spark, sf, "documents").filter("text is not null").select("lang", F.explode(X.tokens(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    return w.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).filter("r <= 25").drop("r")


# ---- rescaled time
CTX = """(SELECT *, CASE WHEN pd IS NULL THEN -1 ELSE least(floor(ln(1 + pd::DOUBLE) / 1.5), 7)::INT END AS ctx FROM (SELECT *, lag(d) OVER (PARTITION BY "user" ORDER BY ts, event_id) AS pd FROM (SELECT *, (ts - lag(ts) OVER w) // 60 AS d, row_number() OVER w AS rn FROM $EV WINDOW w AS (PARTITION BY "user" ORDER BY ts, event_id)) WHERE rn > 1))"""
LAW = f"(SELECT platform, ctx, d, sum(count(*)) OVER (PARTITION BY platform, ctx ORDER BY d) - count(*) AS below, count(*) AS c, sum(count(*)) OVER (PARTITION BY platform, ctx) AS n FROM {CTX} GROUP BY platform, ctx, d)"
U = f"(SELECT x.event_id, x.ts, x.\"user\", x.pop, x.platform, least(greatest((below + 0.5::DOUBLE + ({DRAW_SQL.format(chr(39) + 'pit|' + chr(39) + ' || x.event_id')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE * c) / (n + 1.0::DOUBLE), 1e-9), 1 - 1e-9) AS u FROM {CTX} x JOIN {LAW} l USING (platform, ctx, d))"


def taus(spark, sf):
    rows = R.contexts(events(spark, sf), ["user"])
    return R.rescaled(rows, R.baseline(rows, ["platform"]), ["platform"])


@query("p2_gap_baseline", f"SELECT platform, ctx, d, below::BIGINT AS below, c, n::BIGINT AS n FROM {LAW}")
def p2(spark, sf):
    return R.baseline(R.contexts(events(spark, sf), ["user"]), ["platform"])


@query("p3_rescaled_times", f"SELECT event_id, round(u, 6) AS u, round(-ln(1 - u), 5) AS tau FROM {U}")
def p3(spark, sf):
    t = taus(spark, sf)
    return t.select("event_id", F.round("u", 6).alias("u"), (F.round("tau", 5) + 0.0).alias("tau"))


@query("p4_calibration", f"SELECT platform, round(max(greatest(upto / n::DOUBLE - u, u - (upto - c) / n::DOUBLE)), 6) AS ks FROM (SELECT platform, u, count(*) AS c, sum(count(*)) OVER (PARTITION BY platform ORDER BY u) AS upto, sum(count(*)) OVER (PARTITION BY platform) AS n FROM (SELECT platform, round(u, 9) AS u FROM {U}) GROUP BY platform, u) GROUP BY platform")
def p4(spark, sf):
    return rounded(V.ks_uniform(taus(spark, sf).select("platform", F.round("u", 9).alias("u")), ["platform"], "u"))


@query("p5_densities", f"SELECT pop, round(1 / avg(-ln(1 - u)), 6) AS rate FROM {U} GROUP BY pop")
def p5(spark, sf):
    return rounded(R.densities(taus(spark, sf), "pop"))


@query("p6_excess_matrix", f"WITH m AS (SELECT pop AS a, avg(-ln(1 - u)) AS m FROM {U} GROUP BY pop), l AS (SELECT a AS b, 1 / m AS rate FROM m UNION ALL SELECT 'Exp(1) null', 1.0) SELECT a, b, round((rate * m - ln(rate)) - (1 - ln(1 / m)), 6) + 0.0 AS excess FROM m, l")
def p6(spark, sf):
    return rounded(R.excess_matrix(taus(spark, sf), "pop"))


@query("p7_account_llr", f"WITH r AS (SELECT 1 / avg(-ln(1 - u)) AS rate FROM {U} WHERE pop = 'op') SELECT \"user\", round(avg(-ln(1 - u)) - (any_value(rate) * avg(-ln(1 - u)) - ln(any_value(rate))), 6) + 0.0 AS llr FROM {U}, r GROUP BY \"user\"")
def p7(spark, sf):
    t = taus(spark, sf)
    rate = t.filter("pop = 'op'").agg((1 / F.avg("tau")).alias("rate"))
    m = t.groupBy("user").agg(F.avg("tau").alias("m")).join(F.broadcast(rate))
    return rounded(m.select("user", (F.col("m") - R.nll(F.col("m"), F.col("rate"))).alias("llr")))


MEAN = f"(SELECT platform, \"user\", (pop = 'op')::INT AS y, round(avg(-ln(1 - u)), 6) AS score FROM {U} GROUP BY ALL)"


@query("p8_zero_shot", f"SELECT platform, round(auc, 5) AS auc FROM ({auc_sql(MEAN, 'platform')})")
def p8(spark, sf):
    m = taus(spark, sf).groupBy("platform", "pop", "user").agg(F.round(F.avg("tau"), 6).alias("score")).withColumn("y", (F.col("pop") == "op").cast("int"))
    return rounded(V.auc(m, ["platform"]), 5)


@query(
    "p5b_log_normal_by_bin",
    "SELECT pop, bin, count(*) AS n, round(avg(l), 4) + 0.0 AS mu, round(stddev_pop(l), 4) + 0.0 AS sigma FROM ("
    "SELECT pop, ln(greatest(tau, 1e-8)) AS l, CASE WHEN before IS NULL THEN -1 ELSE least(floor(before * 4), 7)::INT END AS bin FROM ("
    f'SELECT *, lag(tau) OVER (PARTITION BY "user" ORDER BY ts, event_id) AS before FROM (SELECT *, -ln(1 - u) AS tau FROM {U}))) GROUP BY pop, bin',
)
def p5b(spark, sf):
    return rounded(R.log_normal_densities(taus(spark, sf), "pop", ["user"]), 4)


# ---- mixtures of log-normal laws
def _tail_sql(z: str) -> str:
    poly = lambda c: "(" * (len(c) - 1) + f"{c[0]!r}::DOUBLE" + "".join(f" * abs({z}) + {k!r}::DOUBLE)" for k in c[1:])
    far = f"(abs({z}) + 0.65::DOUBLE)"
    for k in (4, 3, 2, 1):
        far = f"(abs({z}) + {k} / {far})"
    e = f"exp(-{z} * {z} / 2)"
    return f"(CASE WHEN abs({z}) > 37 THEN 0 WHEN abs({z}) < 7.07106781186547 THEN {e} * {poly(L.TAIL_OVER)} / {poly(L.TAIL_UNDER)} ELSE {e} / {far} / {L.ROOT!r}::DOUBLE END)"


#: A law of two components, for the functions' own query.
WEIGHTS, MUS, SIGMAS = (0.3, 0.7), (2.5, 4.0), (0.5, 0.25)
_CDF_SQL = " + ".join(f"{w} * (CASE WHEN z{k} > 0 THEN 1 - {_tail_sql(f'z{k}')} ELSE {_tail_sql(f'z{k}')} END)" for k, w in enumerate(WEIGHTS))
_DENSITY_SQL = " + ".join(f"{w} / ({L.ROOT!r}::DOUBLE * {s} * x) * exp(-z{k} * z{k} / 2)" for k, (w, s) in enumerate(zip(WEIGHTS, SIGMAS, strict=True)))


@query(
    "h12c_mixture_law",
    f"SELECT event_id, round({_CDF_SQL}, 9) AS cdf, round(ln({_DENSITY_SQL}), 6) AS log_density FROM (SELECT event_id, x, "
    + ", ".join(f"(ln(x) - {m}::DOUBLE) / {s}::DOUBLE AS z{k}" for k, (m, s) in enumerate(zip(MUS, SIGMAS, strict=True)))
    + " FROM (SELECT event_id, value::DOUBLE AS x FROM $EV WHERE value > 1))",
)
def h12c(spark, sf):
    """Distribution function and log density of a mixture of log-normal laws."""
    law = [F.array(*map(F.lit, v)) for v in (WEIGHTS, MUS, SIGMAS)]
    e = events(spark, sf).filter("value > 1")
    return e.select("event_id", F.round(L.mixture_cdf(*law, F.col("value")), 9).alias("cdf"), F.round(L.mixture_log_density(*law, F.col("value")), 6).alias("log_density"))


def mixture_laws(rows, components: int = 2, steps: int = 20):
    """A mixture for each platform and context, fitted to the gaps' censoring intervals."""
    return L.fit(L.minute_counts(rows, ["platform", "ctx"]), ["platform", "ctx"], components, steps)


@query("p2c_mixture_baseline")
def p2c(spark, sf):
    """The platforms' laws of a gap in each context as mixtures, a row for each component."""
    laws = mixture_laws(R.contexts(events(spark, sf), ["user"]))
    each = laws.select("platform", "ctx", "log_likelihood", F.posexplode(F.arrays_zip("weight", "mu", "sigma")).alias("component", "c"))
    return each.select("platform", "ctx", "component", "c.*", "log_likelihood")


@query("p3c_mixture_times")
def p3c(spark, sf):
    """Rescaled times under the mixtures: u between the law's values at both ends of the censoring interval."""
    rows = R.contexts(events(spark, sf), ["user"])
    law = [F.col(c) for c in ("weight", "mu", "sigma")]
    r = (S.draw("pit", F.col("event_id")) + 0.5) / F.lit(4294967296.0)
    low = L.mixture_cdf(*law, F.col("lo"))
    u = F.least(F.greatest(low + r * L.mixture_between(*law, F.col("lo"), F.col("hi")), F.lit(1e-9)), F.lit(1 - 1e-9))
    t = rows.join(mixture_laws(rows), ["platform", "ctx"]).select("event_id", "user", "pop", "platform", u.alias("u"))
    return t.withColumn("tau", -F.log1p(-F.col("u")))


@query("p5c_mixture_gain")
def p5c(spark, sf):
    """(platform, gaps, one, two): mean log-likelihood a gap with one component and with two."""
    rows = R.contexts(events(spark, sf), ["user"])
    counts = L.minute_counts(rows, ["platform", "ctx"])
    total = counts.groupBy("platform").agg(F.sum("n").alias("gaps"))
    for k, name in ((1, "one"), (2, "two")):
        ll = L.fit(counts, ["platform", "ctx"], k, 20).groupBy("platform").agg(F.sum("log_likelihood").alias("ll"))
        total = total.join(ll, "platform").withColumn(name, F.col("ll") / F.col("gaps")).drop("ll")
    return total


LLR = (
    f"(WITH r AS (SELECT 1 / avg(-ln(1 - u)) AS rate FROM {U} WHERE pop = 'op') SELECT (pop = 'op')::INT AS y, "
    f'round(avg(-ln(1 - u)) - (any_value(rate) * avg(-ln(1 - u)) - ln(any_value(rate))), 6) AS score FROM {U}, r GROUP BY "user", pop)'
)


@query("p7b_llr_auc", f"SELECT round(auc, 5) AS auc FROM ({auc_sql(LLR)})")
def p7b(spark, sf):
    found = R.account_llr(taus(spark, sf), "pop", "op").select("user", (F.col("pop") == "op").cast("int").alias("y"), F.round("llr", 6).alias("score"))
    return rounded(V.auc(found, []), 5)


@query("p8b_zero_shot_medians", f"SELECT platform, y, count(*) AS accounts, round(median(score), 5) AS median FROM {MEAN} GROUP BY platform, y")
def p8b(spark, sf):
    """The model-free readout on each platform: medians of the accounts' mean rescaled times."""
    m = taus(spark, sf).groupBy("platform", "pop", "user").agg(F.round(F.avg("tau"), 6).alias("score")).withColumn("y", (F.col("pop") == "op").cast("int"))
    return rounded(m.groupBy("platform", "y").agg(F.count(F.lit(1)).alias("accounts"), F.median("score").alias("median")), 5)


EXCESS = (
    f"(WITH m AS (SELECT pop || '/' || platform AS p, avg(-ln(1 - u)) AS m FROM {U} GROUP BY ALL), "
    "x AS (SELECT a.p AS a, b.p AS b, (a.m / b.m - ln(1 / b.m)) - (1 - ln(1 / a.m)) AS e FROM m a, m b) "
    "SELECT x.a, x.b, exp(-(x.e + y.e) / 2) AS s FROM x JOIN x y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b)"
)


@query(
    "g22b_excess_similarity",
    f"SELECT a, b, round(s, 5) AS similarity, round(min(s) OVER (PARTITION BY a), 5) AS lowest, round(max(s) OVER (PARTITION BY a), 5) AS highest FROM {EXCESS}",
)
def g22b(spark, sf):
    """exp(-mean excess of both directions) of populations, with its range over the others; populations are few."""
    t = taus(spark, sf).withColumn("p", F.concat_ws("/", "pop", "platform"))
    x = R.excess_matrix(t, "p")
    back = x.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("excess").alias("other"))
    s = x.join(F.broadcast(back), ["a", "b"]).filter("a < b").withColumn("similarity", F.exp(-(F.col("excess") + F.col("other")) / 2))
    of = Window.partitionBy("a")
    return rounded(s.select("a", "b", "similarity", F.min("similarity").over(of).alias("lowest"), F.max("similarity").over(of).alias("highest")), 5)


# ---- synchrony and graph
START, WIDTH, NB, PERIOD, REPS = 1704067200, 3600, 720, 24, 20
BINS = f"(SELECT pop, \"user\", (ts - {START}) // {WIDTH} AS bin, count(*) AS c FROM $EV WHERE ts >= {START} AND ts < {START + WIDTH * NB} GROUP BY ALL)"


def bins(spark, sf):
    e = events(spark, sf).filter((F.col("ts") >= START) & (F.col("ts") < START + WIDTH * NB))
    return Y.binned(e, ["pop", "user"], WIDTH, START)


@query("d16_pooled_variance", f"SELECT pop, round(sum(c * c) / {NB} - (sum(c) / {NB}) ** 2, 6) AS variance FROM (SELECT pop, bin, sum(c)::DOUBLE AS c FROM {BINS} GROUP BY ALL) GROUP BY pop")
def d16(spark, sf):
    return rounded(Y.variance(bins(spark, sf), ["pop"], NB))


SHIFT = f"(SELECT rep, pop, (bin + (1 + {DRAW_SQL.format(chr(39) + 'sync|' + chr(39) + ' || rep || ' + chr(39) + '|' + chr(39) + ' || \"user\"')} % {NB // PERIOD - 1}) * {PERIOD}) % {NB} AS bin, c FROM {BINS}, range({REPS}) t(rep))"


@query("e13_circular_shift", f"SELECT rep, pop, bin, sum(c)::BIGINT AS c FROM {SHIFT} GROUP BY ALL")
def e13(spark, sf):
    b = bins(spark, sf)
    s = Y.pooled(b, b.select("pop", "user").distinct(), "pop", "user", NB, PERIOD, REPS)
    return s.filter("rep >= 0").select(F.col("rep").cast("long").alias("rep"), "pop", "bin", "c")


@query("g13_synchrony", f"WITH o AS (SELECT pop, sum(c * c) / {NB} - (sum(c) / {NB}) ** 2 AS v FROM (SELECT pop, bin, sum(c)::DOUBLE AS c FROM {BINS} GROUP BY ALL) GROUP BY pop), n AS (SELECT pop, avg(v) AS mu, stddev_pop(v) AS sd FROM (SELECT pop, rep, sum(c * c) / {NB} - (sum(c) / {NB}) ** 2 AS v FROM (SELECT pop, rep, bin, sum(c)::DOUBLE AS c FROM {SHIFT} GROUP BY ALL) GROUP BY pop, rep) GROUP BY pop) SELECT pop, round(v / mu, 5) AS ratio, round((v - mu) / (sd + 1e-12), 4) + 0.0 AS z FROM o JOIN n USING (pop)")
def g13(spark, sf):
    b = bins(spark, sf)
    y = Y.synchrony(b, b.select("pop", "user").distinct(), "pop", "user", NB, PERIOD, REPS)
    return y.select("pop", F.round("ratio", 5).alias("ratio"), (F.round("z", 4) + 0.0).alias("z"))


@query("g14_matched_synchrony")
def g14(spark, sf):
    """Synchrony of decile-matched control sets, the members' own beside them as set -1."""
    from .cohorts import decile_matched

    v = events(spark, sf).groupBy("pop", "user").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sets = decile_matched(v, "pop", "op", "organic", "user", "n", 10, "g14").select("set_id", F.col("control").alias("user"))
    sets = sets.unionByName(v.filter("pop = 'op'").select(F.lit(-1).cast("long").alias("set_id"), "user")).distinct()
    return Y.synchrony(bins(spark, sf), sets, "set_id", "user", NB, PERIOD, REPS)


REACH = f"WITH RECURSIVE p AS ({PAIR}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"


@query("n1_components", REACH + " SELECT a AS node, min(b) AS component FROM r GROUP BY a")
def n1(spark, sf):
    return N.components(N.overlap_links(events(spark, sf), "user", "k", 38))


@query("f3_component_ranks", REACH + ", c AS (SELECT a AS node, min(b) AS component FROM r GROUP BY a), s AS (SELECT component, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, component) AS rank FROM c GROUP BY component) SELECT node, component, size, rank FROM c JOIN s USING (component)")
def f3(spark, sf):
    s = N.sized(N.components(N.overlap_links(events(spark, sf), "user", "k", 38)))
    return s.select("node", "component", "size", F.col("rank").cast("long").alias("rank"))


@query("c9_cross_scoring", "WITH s AS (SELECT pop, avg((action = 2)::INT::DOUBLE) AS r FROM $EV GROUP BY pop), u AS (SELECT \"user\", sum((action = 2)::INT)::DOUBLE AS k, count(*)::DOUBLE AS n FROM $EV GROUP BY ALL) SELECT u.\"user\", s.pop AS policy, round((k * ln(r) + (n - k) * ln(1 - r)) / n, 6) AS loglik FROM u, s")
def c9(spark, sf):
    e = events(spark, sf)
    laws = e.groupBy("pop").agg(F.avg((F.col("action") == 2).cast("double")).alias("r"))
    u = e.groupBy("user").agg(F.sum((F.col("action") == 2).cast("double")).alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    return rounded(u.crossJoin(F.broadcast(laws)).select("user", F.col("pop").alias("policy"), F.expr("(k * ln(r) + (n - k) * ln(1 - r)) / n").alias("loglik")))


# ---- summaries
@query("x1_cohort_summary", f"WITH c AS {CENTROID}, f AS ({profile_sql('$EV', 'pop, \"user\"', ['median_gap_min', 'burstiness'], 12)}) SELECT f.pop, count(*) AS accounts, round(median(median_gap_min), 6) AS gap, round(median(burstiness), 6) + 0.0 AS burst, round((SELECT sum(a.p * b.p) / (sqrt(sum(a.p * a.p)) * sqrt(sum(b.p * b.p)) + 1e-12) FROM c a JOIN c b USING (hour) WHERE a.pop = 'op' AND b.pop = 'organic'), 6) AS cosine FROM f GROUP BY f.pop")
def x1(spark, sf):
    e = events(spark, sf)
    f = P.profile(e, ["pop", "user"]).groupBy("pop").agg(F.count(F.lit(1)).alias("accounts"), F.median("median_gap_min").alias("gap"), F.median("burstiness").alias("burst"))
    c = P.centroid(P.hour_shares(e, ["pop", "user"]), "pop", "user")
    pair = c.groupBy("hour").agg(F.sum(F.when(F.col("pop") == "op", F.col("p"))).alias("a"), F.sum(F.when(F.col("pop") == "organic", F.col("p"))).alias("b")).na.fill(0.0)
    cos = pair.agg((F.sum(F.expr("a * b")) / (F.sqrt(F.sum(F.expr("a * a"))) * F.sqrt(F.sum(F.expr("b * b"))) + 1e-12)).alias("cosine"))
    return rounded(f.join(F.broadcast(cos)))


@query("x2_era_summary", f"SELECT era, count(*) AS accounts, round(median(median_gap_min), 6) AS gap, round(median(day_density), 6) AS density FROM ({profile_sql(ORDERS_SQL, 'era, \"user\"', ERA_COLUMNS, 12)}) GROUP BY era")
def x2(spark, sf):
    f = P.profile(orders(spark, sf), ["era", "user"])
    return rounded(f.groupBy("era").agg(F.count(F.lit(1)).alias("accounts"), F.median("median_gap_min").alias("gap"), F.median("day_density").alias("density")))


HALF = 1705276800  # the middle of January 2024
HOURS_BY_HALF = (
    "(SELECT half, hour, sum(p) / any_value(k) AS p FROM (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY half, \"user\") AS p, "
    "max(r) OVER (PARTITION BY half) AS k FROM (SELECT *, dense_rank() OVER (PARTITION BY half ORDER BY \"user\") AS r FROM ("
    f"SELECT CASE WHEN ts < {HALF} THEN 'first' ELSE 'second' END AS half, \"user\", hour(make_timestamp(ts * 1000000)) AS hour, count(*) AS n FROM $EV GROUP BY ALL))) GROUP BY half, hour)"
)


@query(
    "x2b_era_hour_cosine",
    f"SELECT a.half AS a, b.half AS b, round(sum(a.p * b.p) / (sqrt(any_value(x.s)) * sqrt(any_value(y.s)) + 1e-12), 6) AS cosine FROM {HOURS_BY_HALF} a JOIN {HOURS_BY_HALF} b USING (hour) "
    f"JOIN (SELECT half, sum(p * p) AS s FROM {HOURS_BY_HALF} GROUP BY half) x ON x.half = a.half JOIN (SELECT half, sum(p * p) AS s FROM {HOURS_BY_HALF} GROUP BY half) y ON y.half = b.half "
    "WHERE a.half < b.half GROUP BY a.half, b.half",
)
def x2b(spark, sf):
    """Cosine of the hour centroids of each pair of eras; eras are few."""
    e = events(spark, sf).withColumn("half", F.when(F.col("ts") < HALF, "first").otherwise("second"))
    c = P.centroid(P.hour_shares(e, ["half", "user"]), "half", "user")
    norm = c.groupBy("half").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("norm"))
    c = c.join(F.broadcast(norm), "half")
    pairs = c.alias("x").join(c.alias("y"), (F.col("x.hour") == F.col("y.hour")) & (F.col("x.half") < F.col("y.half")))
    pairs = pairs.groupBy(F.col("x.half").alias("a"), F.col("y.half").alias("b"))
    return rounded(pairs.agg((F.sum(F.col("x.p") * F.col("y.p")) / (F.first("x.norm") * F.first("y.norm") + 1e-12)).alias("cosine")))


@query("x3_recompute_guard", "SELECT 0.0::DOUBLE AS largest_gap")
def x3(spark, sf):
    """Two computations of one matrix must agree within 5e-5, else the job fails."""
    e = events(spark, sf)
    one = Q.transitions(e, ["pop", "user"], "action", "action").groupBy("pop", "s", "a").agg(F.avg("p").alias("x"))
    two = Q.transitions(e.repartition(5, "event_id"), ["user", "pop"], "action", "action").groupBy("pop", "s", "a").agg(F.avg("p").alias("z"))
    gap = one.join(two, ["pop", "s", "a"], "full_outer").agg(F.max(F.abs(F.coalesce(F.col("x") - F.col("z"), F.lit(1.0)))).alias("gap"))
    return gap.filter(F.assert_true(F.col("gap") < 5e-5, F.lit("the matrices differ")).isNull()).select((F.round("gap", 6) + 0.0).alias("largest_gap"))


SHARES = '(SELECT pop, "user", s, a, n::DOUBLE / sum(n) OVER (PARTITION BY "user", s) AS p FROM (SELECT pop, "user", action AS s, nxt AS a, count(*) AS n FROM (SELECT *, lead(action) OVER (PARTITION BY "user" ORDER BY ts, event_id) AS nxt FROM $EV) WHERE nxt IS NOT NULL GROUP BY ALL))'


@query(
    "x3b_cells_that_agree",
    f"SELECT pop, s, a, round(abs(x - z), 6) AS gap, coalesce(abs(x - z) < 0.002, false) AS agrees FROM (SELECT pop, s, a, avg(p) AS x FROM {SHARES} GROUP BY ALL) FULL JOIN (SELECT pop, s, a, avg(p) AS z FROM {SHARES} WHERE \"user\" % 7 > 0 GROUP BY ALL) USING (pop, s, a)",
)
def x3b(spark, sf):
    """Transition shares of all accounts against those without every seventh one, cell by cell."""
    p = Q.transitions(events(spark, sf), ["pop", "user"], "action", "action")
    mean = lambda rows: rows.groupBy("pop", "s", "a").agg(F.avg("p").alias("x"))
    return rounded(V.guard(mean(p), mean(p.filter(F.col("user") % 7 > 0)), ["pop", "s", "a"], "x", 0.002))


# ---- sources: files that Spark writes from the tables and reads again
@query("a1_sequence_csv", 'SELECT "user"::VARCHAR AS "user", ts, action::INT AS action FROM $EV WHERE event_id % 10 <> 9')
def a1(spark, sf):
    at = F.when(F.col("event_id") % 10 == 9, "not a time").when(F.col("event_id") % 2 == 0, F.col("ts").cast("string")).otherwise(F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm:ss"))
    path = scratch(spark, "a1")
    events(spark, sf).select(F.col("user").cast("string"), at.alias("ts"), F.col("action").cast("string")).write.option("header", True).csv(path)
    return A.read_sequences(spark, path)


@query("a2_epoch_seconds", "SELECT event_id, ts FROM $EV")
def a2(spark, sf):
    return events(spark, sf).select("event_id", "ts")


@query(
    "a2b_parsed_times",
    "SELECT event_id, CASE event_id % 5 WHEN 3 THEN 0 WHEN 4 THEN ts - 7200 ELSE ts END AS ts, event_id % 5 <> 3 AS valid FROM $EV",
)
def a2b(spark, sf):
    """Times written in four ways and as no time at all, parsed, with the mask of the valid ones (0 elsewhere)."""
    at = F.timestamp_seconds("ts")
    texts = [F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.col("ts").cast("string"), F.lit("no time")]
    texts.append(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    e = events(spark, sf).select("event_id", F.element_at(F.array(*texts), (F.col("event_id") % 5).cast("int") + 1).alias("text"))
    at = A.epoch_seconds(F.col("text"))
    return e.select("event_id", F.coalesce(at, F.lit(0)).alias("ts"), at.isNotNull().alias("valid"))


@query("a4_archive_scan", "SELECT lower('User' || \"user\") AS \"user\", ts // 60 * 60 AS ts, CASE WHEN k % 5 = 0 THEN 1 WHEN action = 2 OR k % 7 = 0 THEN 2 ELSE 0 END AS action FROM $EV QUALIFY count(*) OVER (PARTITION BY \"user\") >= 60")
def a4(spark, sf):
    e = events(spark, sf)
    path = scratch(spark, "a4")
    e.select(
        F.concat(F.lit("User"), F.col("user").cast("string")).alias("user_screen_name"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm").alias("tweet_time"),
        F.lit('a "quoted", text').alias("tweet_text"), F.lit("['a', 'b']").alias("hashtags"), F.lit("[]").alias("urls"),
        F.when(F.col("action") == 2, "TRUE").otherwise("false").alias("is_retweet"), F.when(F.col("k") % 5 == 0, F.col("k").cast("string")).alias("in_reply_to_tweetid"),
        F.when(F.col("k") % 7 == 0, F.col("k").cast("string")).alias("quoted_tweet_tweetid"),
    ).write.option("header", True).option("escape", '"').csv(path)
    return A.read_archive(spark, path, 60)


@query("a7_timelines", "SELECT \"user\"::VARCHAR AS \"user\", ts, 'post ' || event_id AS text, (k % 2 = 0)::INT AS is_reply FROM $EV WHERE pop = 'op'")
def a7(spark, sf):
    e = events(spark, sf)
    path = scratch(spark, "a7")
    line = e.select(
        F.struct(F.col("user").cast("string").alias("id_str")).alias("user"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("post "), "event_id")).alias("full_text"),
        F.concat(F.lit("post "), "event_id").alias("text"), F.date_format(F.timestamp_seconds("ts"), "EEE MMM dd HH:mm:ss Z yyyy").alias("created_at"),
        F.when(F.col("k") % 2 == 0, F.col("k")).alias("in_reply_to_status_id"),
    )
    line.write.option("compression", "bzip2").json(path)
    members = e.filter("pop = 'op'").select(F.col("user").cast("string").alias("user")).distinct()
    return A.read_timelines(spark, path, members).select("user", "ts", "text", "is_reply")


@query("a8_account_folders", 'SELECT \'src=\' || lower(pop) AS "user", event_id, event_type FROM $EV')
def a8(spark, sf):
    path = scratch(spark, "a8")
    events(spark, sf).select("event_id", "event_type", F.col("pop").alias("src")).write.option("header", True).partitionBy("src").csv(path)
    found = A.read_folders(spark, path, "event_id bigint, event_type string")
    return found.select("user", "event_id", "event_type")


@query("a11_stage_table", "SELECT pop, count(*) AS n FROM $EV GROUP BY pop")
def a11(spark, sf):
    path = scratch(spark, "a11")
    A.stage(events(spark, sf), path, ["pop"])
    return A.stage(events(spark, sf).limit(0), path, ["pop"]).groupBy("pop").agg(F.count(F.lit(1)).alias("n"))


@query("a12_result_sinks", "SELECT pop, n FROM (SELECT pop, count(*) AS n FROM $EV GROUP BY pop), range(3)")
def a12(spark, sf):
    out = events(spark, sf).groupBy("pop").agg(F.count(F.lit(1)).alias("n"))
    schema = T.StructType([T.StructField("pop", T.StringType()), T.StructField("n", T.LongType())])
    back = None
    for kind in ("parquet", "json", "csv"):
        path = scratch(spark, f"a12-{kind}")
        out.write.format(kind).save(path)
        read = spark.read.format(kind).schema(schema).load(path)
        back = read if back is None else back.unionByName(read)
    return back


@query("a13_fingerprints")
def a13(spark, sf):
    return A.fingerprints(spark, f"{sf}/events.parquet")


@query("s1_stream_ingest", "SELECT strftime(make_timestamp(ts * 1000000), '%Y-%m-%d') AS day, \"user\", action::INT AS action, hour(make_timestamp(ts * 1000000))::INT AS hour, count(*) AS n FROM $EV GROUP BY ALL")
def s1(spark, sf):
    base = scratch(spark, "s1")
    t = table(spark, sf, "events")
    t.repartition(4).write.parquet(f"{base}/in")
    t.limit(100).write.mode("append").parquet(f"{base}/in")  # repeated events must not count twice
    return daily_counts(spark, f"{base}/in", t.schema, f"{base}/out", f"{base}/state").withColumn("day", F.col("day").cast("string"))


@query("s2_profiles_from_batches", profile_sql("$EV", 'pop, "user"'))
def s2(spark, sf):
    """The account profile kept up to date from a stream of four stretches of time."""
    base = scratch(spark, "s2")
    e = events(spark, sf).select("pop", "user", "ts", "action", "event_id")
    week = F.least(F.floor((F.col("ts") - START) / (7 * 86400)), F.lit(3))
    for i in range(4):
        e.filter(week == i).coalesce(1).write.mode("append").parquet(f"{base}/in")  # one file a stretch, in order
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return rounded(kept.profile_of(kept.keep_up(spark, stream, ["pop", "user"], f"{base}/out", f"{base}/state"), ["pop", "user"]))


# ---- further sources, populations and protocols
@query("a3_sequence_csv_unfiltered", 'SELECT "user"::VARCHAR AS "user", CASE WHEN event_id % 4 = 0 THEN -ts ELSE ts END AS ts FROM $EV')
def a3(spark, sf):
    """Numeric times are never dropped for their sign."""
    path = scratch(spark, "a3")
    ts = F.when(F.col("event_id") % 4 == 0, -F.col("ts")).otherwise(F.col("ts"))
    events(spark, sf).select(F.col("user").cast("string"), ts.cast("string").alias("ts"), F.col("action").cast("string")).write.option("header", True).csv(path)
    return A.read_sequences(spark, path, positive_only=False).select("user", "ts")


def archived(spark, sf, name):
    """Events written as an archive of posts, two of each tenth second for names in two cases."""
    path = scratch(spark, name)
    e = events(spark, sf)
    who = F.concat(F.when(F.col("event_id") % 2 == 0, "Name").otherwise("nAME"), F.col("user").cast("string"))
    columns = [who.alias("user_screen_name"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd HH:mm").alias("tweet_time"), F.concat(F.lit("post "), "event_type", F.lit(" http://www.x"), (F.col("k") % 5).cast("string"), F.lit(".org/a")).alias("tweet_text")]
    columns += [F.lit("[]").alias(c) for c in ("hashtags", "urls")] + [F.lit("false").alias("is_retweet"), F.when(F.col("k") % 5 == 0, "1").alias("in_reply_to_tweetid"), F.lit(None).cast("string").alias("quoted_tweet_tweetid")]
    e.select(*columns).write.option("header", True).csv(path)
    return path


@query("a5_archive_distinct_times", "SELECT \"user\", ts FROM (SELECT DISTINCT 'name' || \"user\" AS \"user\", ts // 60 * 60 AS ts FROM $EV) QUALIFY count(*) OVER (PARTITION BY \"user\") >= 50")
def a5(spark, sf):
    from .cohorts import distinct_seconds

    return distinct_seconds(A.read_archive(spark, archived(spark, sf, "a5")), 50)


@query("a6_archive_with_duplicates", "SELECT 'name' || \"user\" AS \"user\", ts // 60 * 60 AS ts, count(*) AS n FROM $EV GROUP BY ALL")
def a6(spark, sf):
    return A.read_archive(spark, archived(spark, sf, "a6")).groupBy("user", "ts").agg(F.count(F.lit(1)).alias("n"))


@query("a9_archive_posts", "SELECT 'name' || \"user\" AS \"user\", ts // 60 * 60 AS ts, 'http://www.x' || (k % 5) || '.org/a' AS url, (k % 5 = 0)::INT AS is_reply FROM $EV WHERE pop = 'op'")
def a9(spark, sf):
    members = events(spark, sf).filter("pop = 'op'").select(F.concat(F.lit("name"), F.col("user").cast("string")).alias("user")).distinct()
    return A.read_posts(spark, archived(spark, sf, "a9"), members).select("user", "ts", F.explode("urls").alias("url"), "is_reply")


@query("a10_label_dimension", "SELECT e.event_type, count(*) AS n FROM $EV e JOIN (SELECT DISTINCT event_type FROM events WHERE event_type LIKE '%i%') d USING (event_type) GROUP BY ALL")
def a10(spark, sf):
    path = scratch(spark, "a10")
    e = events(spark, sf)
    e.select("event_type").distinct().filter("event_type like '%i%'").write.option("header", True).csv(path)
    labels = spark.read.schema("event_type string").option("header", True).csv(path)
    return e.join(F.broadcast(labels), "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("g21_feature_agreement", "SELECT round(corr(a.n, b.n), 6) AS r_n, round(corr(a.v, b.v), 6) + 0.0 AS r_v, count(*) AS accounts FROM (SELECT \"user\", count(*) AS n, avg(value) AS v FROM $EV GROUP BY ALL) a JOIN (SELECT \"user\", count(*) AS n, avg(value) AS v FROM $EV WHERE event_id % 3 > 0 GROUP BY ALL) b USING (\"user\")")
def g21(spark, sf):
    from .cohorts import agreement

    e = events(spark, sf)
    make = lambda d: d.groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("v"))
    return rounded(agreement(make(e), make(e.filter("event_id % 3 > 0")), "user", ["n", "v"]))


@query("p1_populations", "SELECT pop, count(DISTINCT acc) AS accounts, count(*) AS events FROM (SELECT platform || ':' || pop AS pop, \"user\" AS acc FROM $EV UNION ALL SELECT 'O:' || CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'urgent' WHEN o_orderpriority LIKE '%HIGH%' THEN 'high' ELSE 'other' END, o_custkey FROM orders) GROUP BY pop")
def p1(spark, sf):
    e = events(spark, sf).select(F.concat_ws(":", "platform", "pop").alias("pop"), F.col("user").alias("acc"))
    text = F.lower("o_orderpriority")
    actor = F.when(text.contains("urgent"), "urgent").when(text.contains("high"), "high").otherwise("other")
    o = table(spark, sf, "orders").select(F.concat(F.lit("O:"), actor).alias("pop"), F.col("o_custkey").alias("acc"))
    return e.unionByName(o).groupBy("pop").agg(F.count_distinct("acc").alias("accounts"), F.count(F.lit(1)).alias("events"))


def action_vectors(spark, sf):
    """Nine transition shares of each account, absent ones 0."""
    p = Q.transitions(events(spark, sf), ["pop", "user"], "action", "action").withColumn("cell", F.concat(F.lit("t"), F.col("s").cast("string"), F.col("a").cast("string")))
    cells = [f"t{s}{a}" for s in range(3) for a in range(3)]
    return p.groupBy("pop", "user").pivot("cell", cells).agg(F.first("p")).na.fill(0.0), cells


@query("m15_action_vectors", 'SELECT "user", ' + ", ".join(f"round(coalesce(max(CASE WHEN s = {s} AND a = {a} THEN p END), 0), 6) AS t{s}{a}" for s in range(3) for a in range(3)) + ' FROM (SELECT "user", s, a, n::DOUBLE / sum(n) OVER (PARTITION BY "user", s) AS p FROM (SELECT "user", action AS s, nxt AS a, count(*) AS n FROM (SELECT *, lead(action) OVER (PARTITION BY "user" ORDER BY ts, event_id) AS nxt FROM $EV) WHERE nxt IS NOT NULL GROUP BY ALL)) GROUP BY "user"')
def m15(spark, sf):
    v, _ = action_vectors(spark, sf)
    return rounded(v.drop("pop"))
