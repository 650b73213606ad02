"""Queries: sequences, ranks, tests, bootstrap, text functions (groups E, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import evaluate as V
from ..operators import profile as P
from ..operators import sampling as S
from ..operators import sequences as Q
from ..operators.ranks import cumulative, midranks
from .base import DRAW_SQL, events, rounded, sql, table

QUERIES, ORACLE_SQL = {}, {}


def query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return put


G = '(SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY "user" ORDER BY ts, event_id), 0) AS sec, row_number() OVER (PARTITION BY "user" ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY "user") AS n FROM $EV)'


@query("e1_gap_minutes", f"SELECT event_id, round(sec / 60.0::DOUBLE, 6) AS gap FROM {G}")
def e1(spark, sf):
    return rounded(Q.gaps(events(spark, sf), ["user"]).select("event_id", "gap"))


@query("e2_completed_minutes", f"SELECT event_id, sec // 60 AS completed FROM {G}")
def e2(spark, sf):
    return Q.gaps(events(spark, sf), ["user"]).select("event_id", "completed")


@query("e3_censor_bounds", f"SELECT event_id, CASE WHEN greatest(sec // 60 - 1, 0) = 0 THEN 0.001::DOUBLE ELSE (sec // 60 - 1)::DOUBLE END AS lo, (sec // 60 + 1)::DOUBLE AS hi FROM {G}")
def e3(spark, sf):
    return Q.gaps(events(spark, sf), ["user"]).select("event_id", "lo", "hi")


TENTHS = "[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]"
EDGES = f"(SELECT platform, list_sort(list_distinct(quantile_cont(sec / 60.0::DOUBLE, {TENTHS}))) AS q FROM {G} GROUP BY platform)"
TOKENS = f'(SELECT g.*, action * 10 + least(len(list_filter(q, lambda z: z <= sec / 60.0::DOUBLE)), 9) AS token FROM {G} g JOIN {EDGES} USING (platform))'


def tokens(spark, sf):
    g = Q.gaps(events(spark, sf), ["user"])
    return Q.tokenize(g, Q.decile_edges(g, ["platform"]), ["platform"])


@query("e4_action_gap_tokens", f"SELECT event_id, token FROM {TOKENS}")
def e4(spark, sf):
    return tokens(spark, sf).select("event_id", F.col("token").cast("long").alias("token"))


@query("e5_decile_edges", f"SELECT platform, unnest(range(len(q))) AS i, round(unnest(q), 6) AS edge FROM {EDGES}")
def e5(spark, sf):
    e = Q.decile_edges(Q.gaps(events(spark, sf), ["user"]), ["platform"])
    return rounded(e.select("platform", F.posexplode("edges").alias("i", "edge")).withColumn("i", F.col("i").cast("long")))


@query("e6_fixed_windows", f'SELECT "user", event_id, pos // 16 AS "window", pos % 16 AS "offset" FROM {G} WHERE n < 16 OR pos < n - n % 16')
def e6(spark, sf):
    return Q.fixed_windows(Q.positions(events(spark, sf), ["user"]), 16).select("user", "event_id", "window", "offset")


@query("e7_thread_state", f'SELECT event_id, row_number() OVER (PARTITION BY "user", k ORDER BY ts, event_id) = 1 AS first_touch, lead(action) OVER (PARTITION BY "user" ORDER BY ts, event_id) AS next_action FROM {G}')
def e7(spark, sf):
    e = events(spark, sf)
    first = F.row_number().over(Q.order(["user", "k"])) == 1
    return e.select("event_id", first.alias("first_touch"), F.lead("action").over(Q.order(["user"])).alias("next_action"))


PAUSE = "CASE WHEN pos = 0 THEN '' WHEN sec >= 604800 THEN 'g' WHEN sec >= 86400 THEN 'f' WHEN sec >= 28800 THEN 'e' WHEN sec >= 3600 THEN 'd' WHEN sec >= 600 THEN 'c' WHEN sec >= 60 THEN 'b' ELSE 'a' END || ['T', 'p', 'r'][action + 1]"
SYMBOLS = f"(SELECT pop, \"user\", string_agg({PAUSE}, '' ORDER BY pos) AS text FROM {G} GROUP BY ALL)"


@query("e8_symbol_string", f'SELECT "user", text FROM {SYMBOLS}')
def e8(spark, sf):
    return Q.symbols(events(spark, sf), ["user"])


@query("e9_global_ranks", "SELECT k, count(*) AS ties, sum(count(*)) OVER (ORDER BY k) - count(*) + (count(*) + 1) / 2.0::DOUBLE AS midrank FROM $EV GROUP BY k")
def e9(spark, sf):
    return midranks(events(spark, sf), [], "k")


@query("e9b_cumulative_sum", "SELECT o_orderkey, (coalesce(sum(c) OVER (ORDER BY o_totalprice RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(c) OVER (PARTITION BY o_totalprice))::BIGINT AS below_c FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 7 AS c FROM orders)")
def e9b(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 7).alias("c"))
    return cumulative(o, [], "o_totalprice", ["c"]).select("o_orderkey", F.col("below_c").cast("long"))


@query("e10_time_split", f"SELECT event_id, CASE WHEN pos < floor(n * 0.6::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.8::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM {G}")
def e10(spark, sf):
    return Q.time_split(Q.positions(events(spark, sf), ["user"])).select("event_id", "part")


@query("e11_tail", f'SELECT "user", event_id FROM {G} WHERE pos >= floor(n * 0.8::DOUBLE)')
def e11(spark, sf):
    return Q.time_split(Q.positions(events(spark, sf), ["user"])).filter("part = 'test'").select("user", "event_id")


@query("e12_scoring_cap", f'SELECT "user", count(*) AS n FROM {G} WHERE pos < 60 GROUP BY "user"')
def e12(spark, sf):
    return Q.positions(events(spark, sf), ["user"]).filter("pos < 60").groupBy("user").agg(F.count(F.lit(1)).alias("n"))


@query("e14_log_bins", f"SELECT event_id, least(floor(ln(1 + sec / 60.0::DOUBLE) / 0.375), 31)::BIGINT AS bin FROM {G}")
def e14(spark, sf):
    return Q.gaps(events(spark, sf), ["user"]).select("event_id", Q.log_bin(F.col("gap")).cast("long").alias("bin"))


# ---- scores: y = account of population op
SC = "(SELECT \"user\", (pop = 'op')::INT AS y, round(avg((action = 2)::INT::DOUBLE), 3) AS score, round(avg(value), 3) AS other FROM $EV GROUP BY ALL)"


def scored(spark, sf):
    g = events(spark, sf).groupBy("pop", "user").agg(F.round(F.avg((F.col("action") == 2).cast("double")), 3).alias("score"), F.round(F.avg("value"), 3).alias("other"))
    return g.select("user", (F.col("pop") == "op").cast("int").alias("y"), "score", "other")


def auc_sql(src: str, by: str = "", w: str = "1") -> str:
    """Rank AUC of the columns y and score, by key, with weights."""
    keys, part, group = (f"{by}, ", f"PARTITION BY {by} ", f"GROUP BY {by}") if by else ("", "", "")
    return f"SELECT {keys}sum(p * (below + 0.5::DOUBLE * q)) / (sum(p) * sum(q)) AS auc FROM (SELECT {keys}p, q, sum(q) OVER ({part}ORDER BY score) - q AS below FROM (SELECT {keys}score, coalesce(sum(CASE WHEN y = 1 THEN {w} END), 0)::DOUBLE AS p, coalesce(sum(CASE WHEN y = 0 THEN {w} END), 0)::DOUBLE AS q FROM {src} GROUP BY {keys}score)) {group}"


@query("g1_auc", f"SELECT round(auc, 6) AS auc FROM ({auc_sql(SC)})")
def g1(spark, sf):
    return rounded(V.auc(scored(spark, sf), []))


DRAWS = 200
WEIGHTS = f"""(SELECT b, s."user", count(*) AS w FROM (SELECT b, y, {DRAW_SQL.format("'boot|' || b || '|' || y || '|' || slot")} % n AS slot FROM (SELECT y, row_number() OVER (PARTITION BY y ORDER BY "user") - 1 AS slot, count(*) OVER (PARTITION BY y) AS n FROM {SC}), range({DRAWS}) t(b)) d
    JOIN (SELECT "user", y, row_number() OVER (PARTITION BY y ORDER BY "user") - 1 AS slot FROM {SC}) s ON d.y = s.y AND d.slot = s.slot GROUP BY ALL)"""
BOOT = auc_sql(f'(SELECT b, y, score, w FROM {SC} JOIN {WEIGHTS} USING ("user"))', "b", "w")


@query("g2_bootstrap_auc", f"SELECT round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi FROM ({BOOT})")
def g2(spark, sf):
    return rounded(V.bootstrap_auc(scored(spark, sf), [], "user", DRAWS, "boot").agg(*V.interval()))


LONG = f"(SELECT \"user\", y, 'score' AS scorer, score FROM {SC} UNION ALL SELECT \"user\", y, 'other', other FROM {SC})"
PAIRED = auc_sql(f'(SELECT scorer, b, y, score, w FROM {LONG} JOIN {WEIGHTS} USING ("user"))', "scorer, b", "w")


@query("g3_paired_delta", f"SELECT round(quantile_cont(d, 0.025), 6) + 0.0 AS lo, round(quantile_cont(d, 0.975), 6) + 0.0 AS hi, quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0 AS excludes_zero FROM (SELECT b, sum(CASE WHEN scorer = 'score' THEN auc ELSE -auc END) AS d FROM ({PAIRED}) GROUP BY b)")
def g3(spark, sf):
    s = scored(spark, sf)
    long = s.select("user", "y", F.lit("score").alias("scorer"), "score").unionByName(s.select("user", "y", F.lit("other").alias("scorer"), F.col("other").alias("score")))
    a = V.bootstrap_auc(long, ["scorer"], "user", DRAWS, "boot")
    d = a.groupBy("b").agg(F.sum(F.when(F.col("scorer") == "score", F.col("auc")).otherwise(-F.col("auc"))).alias("d"))
    lo, hi = V.interval("d")
    return rounded(d.agg(lo, hi).withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0)))


MEDIANS = f"""(SELECT b, median(x) AS m FROM (SELECT b, d.x FROM (SELECT b, {DRAW_SQL.format("'med|' || b || '|' || slot")} % n AS pick FROM (SELECT row_number() OVER (ORDER BY "user") - 1 AS slot, count(*) OVER () AS n FROM {SC}), range(2000) t(b)) p JOIN (SELECT score AS x, row_number() OVER (ORDER BY "user") - 1 AS slot FROM {SC}) d ON p.pick = d.slot) GROUP BY b)"""


@query("g4_bootstrap_median", f"SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM {MEDIANS}")
def g4(spark, sf):
    m = V.bootstrap_median(scored(spark, sf), "user", "score", 2000, "med")
    return rounded(m.agg(*V.interval("m")))


SH = '(SELECT "user", hour, n::DOUBLE / sum(n) OVER (PARTITION BY "user") AS p FROM (SELECT "user", hour(make_timestamp(ts * 1000000)) AS hour, count(*) AS n FROM $EV GROUP BY ALL))'
COS = f"""(SELECT b, sum(p1 * p0) / (sqrt(sum(p1 * p1)) * sqrt(sum(p0 * p0)) + 1e-12) AS c FROM (SELECT b, hour, sum(CASE WHEN y = 1 THEN w * p ELSE 0 END) AS p1, sum(CASE WHEN y = 0 THEN w * p ELSE 0 END) AS p0 FROM {WEIGHTS} JOIN {SH} USING ("user") JOIN (SELECT "user", y FROM {SC}) USING ("user") GROUP BY ALL) GROUP BY b)"""


@query("g5_centroid_bootstrap", f"SELECT round(quantile_cont(c, 0.025), 6) AS lo, round(quantile_cont(c, 0.975), 6) AS hi, round(avg(c), 6) AS mean FROM {COS}")
def g5(spark, sf):
    s = scored(spark, sf).select("user", "y")
    picks, slots = V.bootstrap_picks(s, "user", "y", DRAWS, "boot")
    hours = [F.sum(F.when(F.col("hour") == h, F.col("p")).otherwise(0.0)).alias(f"h{h}") for h in range(24)]
    shares = P.hour_shares(events(spark, sf), ["user"]).groupBy("user").agg(*hours).join(slots, "user").drop("user")
    sums = V.picked(picks, shares, ["y", "slot"], 0).groupBy("b", "y").agg(*(F.sum(f"h{h}").alias(f"h{h}") for h in range(24)))  # a row for each draw and label
    each = sums.select("b", "y", F.posexplode(F.array(*(f"h{h}" for h in range(24)))).alias("hour", "s"))
    side = lambda v: F.sum(F.when(F.col("y") == v, F.col("s")).otherwise(0.0)).alias(f"p{v}")
    c = each.groupBy("b", "hour").agg(side(1), side(0)).groupBy("b")
    cos = F.sum(F.expr("p1 * p0")) / (F.sqrt(F.sum(F.expr("p1 * p1"))) * F.sqrt(F.sum(F.expr("p0 * p0"))) + 1e-12)
    return rounded(c.agg(cos.alias("c")).agg(*V.interval("c"), F.avg("c").alias("mean")))


@query("g6_recall_at_fpr", f"WITH s AS (SELECT * FROM {SC}), t AS (SELECT unnest([0.05, 0.01])::DOUBLE AS fpr, unnest(quantile_cont(score, [0.95, 0.99])) AS threshold FROM s WHERE y = 0) SELECT fpr, round(threshold, 6) AS threshold, round(avg(CASE WHEN y = 1 THEN (score >= threshold)::INT::DOUBLE END), 6) AS recall, round(avg(CASE WHEN y = 0 THEN (score >= threshold)::INT::DOUBLE END), 6) AS flagged FROM s, t GROUP BY ALL")
def g6(spark, sf):
    return rounded(V.recall_at_fpr(scored(spark, sf), [0.05, 0.01]))


@query("g7_cosine", "WITH c AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, embedding::DOUBLE[] AS u FROM embeddings) SELECT vec_id, round(list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)) + 1e-12), 5) + 0.0 AS cosine FROM e, c")
def g7(spark, sf):
    e = table(spark, sf, "embeddings")
    one = F.broadcast(e.filter("vec_id = 0").select(F.col("embedding").cast("array<double>").alias("v")))  # the id is unique
    return rounded(e.join(one).select("vec_id", V.cosine(F.col("embedding").cast("array<double>"), F.col("v")).alias("cosine")), 5)


ERF = "(1 - (1 / (1 + 0.3275911 * {z}) * (0.254829592 + 1 / (1 + 0.3275911 * {z}) * (-0.284496736 + 1 / (1 + 0.3275911 * {z}) * (1.421413741 + 1 / (1 + 0.3275911 * {z}) * (-1.453152027 + 1 / (1 + 0.3275911 * {z}) * 1.061405429::DOUBLE))))) * exp(-{z} * {z}))"
MW = f"""WITH s AS (SELECT y, score FROM {SC}), r AS (SELECT score, count(*) AS c, sum(count(*)) OVER (ORDER BY score) - count(*) + (count(*) + 1) / 2.0::DOUBLE AS mr FROM s GROUP BY score),
    a AS (SELECT count(*) FILTER (y = 1)::DOUBLE AS m, count(*) FILTER (y = 0)::DOUBLE AS k, sum(mr) FILTER (y = 1) AS rs FROM s JOIN r USING (score)), t AS (SELECT sum(c::DOUBLE ** 3 - c) AS t FROM r),
    u AS (SELECT m, k, rs - m * (m + 1) / 2 AS u, sqrt(m * k / 12 * ((m + k + 1) - t / ((m + k) * (m + k - 1)))) AS sd FROM a, t), z AS (SELECT *, (abs(u - m * k / 2) - 0.5) / sd / sqrt(2.0::DOUBLE) AS z FROM u)"""


@query("g8_mann_whitney", MW + f" SELECT u, round(2 * u / (m * k) - 1, 6) + 0.0 AS effect, round(least(1.0::DOUBLE, 2 * (1 - 0.5 * (1 + sign(z) * {ERF.format(z='abs(z)')}))), 6) AS p FROM z")
def g8(spark, sf):
    return rounded(V.mann_whitney(scored(spark, sf), [], "score", "y"))


@query("g9_ks_uniform", "WITH v AS (SELECT round(k / 100.0::DOUBLE, 6) AS u FROM $EV), c AS (SELECT u, count(*) AS c, sum(count(*)) OVER (ORDER BY u) AS upto, (SELECT count(*) FROM v) AS n FROM v GROUP BY u) SELECT round(max(greatest(upto / n::DOUBLE - u, u - (upto - c) / n::DOUBLE)), 6) AS ks FROM c")
def g9(spark, sf):
    return rounded(V.ks_uniform(events(spark, sf).select(F.round(F.col("k") / 100.0, 6).alias("u")), [], "u"))


MAT = "(SELECT s AS a, nxt AS b, count(*)::DOUBLE AS m1, sum((k % 3)::DOUBLE) AS m2 FROM (SELECT event_type AS s, lead(event_type) OVER (PARTITION BY \"user\" ORDER BY ts, event_id) AS nxt, k FROM $EV) WHERE nxt IS NOT NULL GROUP BY ALL)"
SYM = f"(SELECT x.a, x.b, (x.m1 + y.m1) / 2 AS m1, (x.m2 + y.m2) / 2 AS m2 FROM {MAT} x JOIN {MAT} y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b)"


def matrix(spark, sf):
    """Symmetric (a, b, m1, m2) over unordered pairs of event types."""
    e = events(spark, sf).select(F.col("event_type").alias("a"), F.lead("event_type").over(Q.order(["user"])).alias("b"), "k").filter("b is not null")
    m = e.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("m1"), F.sum((F.col("k") % 3).cast("double")).alias("m2"))
    t = m.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("m1").alias("t1"), F.col("m2").alias("t2"))
    return m.join(t, ["a", "b"]).filter("a < b").select("a", "b", F.expr("(m1 + t1) / 2").alias("m1"), F.expr("(m2 + t2) / 2").alias("m2"))


RANKED = "(SELECT *, (SELECT count(*) FROM s t WHERE t.m1 < s.m1) + ((SELECT count(*) FROM s t WHERE t.m1 = s.m1) + 1) / 2.0::DOUBLE AS r1, (SELECT count(*) FROM s t WHERE t.m2 < s.m2) + ((SELECT count(*) FROM s t WHERE t.m2 = s.m2) + 1) / 2.0::DOUBLE AS r2 FROM s)"


@query("g10_matrix_agreement", f"WITH s AS (SELECT * FROM {SYM}) SELECT round(corr(m1, m2), 6) AS pearson, round(corr(r1, r2), 6) AS spearman FROM {RANKED}")
def g10(spark, sf):
    m = matrix(spark, sf)
    rho = V.spearman(m, [], "m1", "m2").withColumnRenamed("rho", "spearman")
    return rounded(m.agg(F.corr("m1", "m2").alias("pearson")).join(F.broadcast(rho)))


@query("g11_spearman", f"WITH s AS (SELECT score AS m1, other AS m2 FROM {SC}) SELECT round(corr(r1, r2), 6) + 0.0 AS rho FROM {RANKED}")
def g11(spark, sf):
    return rounded(V.spearman(scored(spark, sf), [], "score", "other"))


@query("g12_macro_f1", f"WITH c AS (SELECT count(*) FILTER (y = 1 AND f) AS tp, count(*) FILTER (y = 0 AND f) AS fp, count(*) FILTER (y = 1 AND NOT f) AS fn, count(*) FILTER (y = 0 AND NOT f) AS tn FROM (SELECT y, score >= 0.2 AS f FROM {SC})) SELECT round((2 * tp / (2 * tp + fp + fn)::DOUBLE + 2 * tn / (2 * tn + fp + fn)::DOUBLE) / 2, 6) AS macro_f1 FROM c")
def g12(spark, sf):
    return rounded(V.macro_f1(scored(spark, sf).withColumn("f", (F.col("score") >= 0.2).cast("int")), "y", "f"))


@query("g15_holdout", "SELECT pop, \"user\", CASE WHEN row_number() OVER (PARTITION BY pop ORDER BY md5('split|' || \"user\"), \"user\") <= round_even(0.3::DOUBLE * count(*) OVER (PARTITION BY pop), 0) THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT pop, \"user\" FROM $EV)")
def g15(spark, sf):
    return S.holdout(events(spark, sf).select("pop", "user").distinct(), "pop", "user", "split")


FOLDS = "(SELECT r::INT AS repeat, pop, \"user\", ((row_number() OVER (PARTITION BY r, pop ORDER BY md5(r || '|' || \"user\"), \"user\") - 1) % 5)::INT AS fold FROM (SELECT DISTINCT pop, \"user\" FROM $EV), range(3) t(r))"


@query("g16_folds", f"SELECT repeat, pop, \"user\", fold FROM {FOLDS}")
def g16(spark, sf):
    return S.folds(events(spark, sf).select("pop", "user").distinct(), "pop", "user", 5, 3).select("repeat", "pop", "user", "fold")


@query("g17_population_holdout", """WITH a AS (SELECT pop, "user", count(*) OVER (PARTITION BY pop) AS n, row_number() OVER (PARTITION BY pop ORDER BY md5('hold|' || "user"), "user") AS r FROM (SELECT DISTINCT event_type AS pop, "user" FROM $EV))
    SELECT pop, "user", CASE WHEN n < 10 THEN 'time' WHEN r <= greatest(1, n // 5) THEN 'test' ELSE 'train' END AS part FROM a""")
def g17(spark, sf):
    a = events(spark, sf).select(F.col("event_type").alias("pop"), "user").distinct()
    n = F.broadcast(a.groupBy("pop").agg(F.count(F.lit(1)).alias("n")))  # a row for each population
    a = numbered(a, ["pop"], [S.digest("hold", F.col("user")), F.col("user")], "r").join(n, "pop")
    return a.select("pop", "user", F.when(F.col("n") < 10, "time").when(F.col("r") <= F.greatest(F.lit(1), F.expr("n div 5")), "test").otherwise("train").alias("part"))


FOLDED = f'(SELECT repeat, fold, s.y, s.score FROM {FOLDS} f JOIN {SC} s USING ("user"))'


@query("g18_fold_auc", f"SELECT repeat, fold, round(auc, 6) AS auc FROM ({auc_sql(FOLDED, 'repeat, fold')})")
def g18(spark, sf):
    f = S.folds(events(spark, sf).select("pop", "user").distinct(), "pop", "user", 5, 3).select("repeat", "user", "fold")
    return rounded(V.auc(f.join(scored(spark, sf), "user"), ["repeat", "fold"]))


CENTRED = f'(SELECT f.repeat, f.fold, s."user", s.y, s.score FROM {FOLDS} f JOIN {SC} s USING ("user"))'


@query("g19_fold_centering", f"""WITH x AS (SELECT * FROM {CENTRED}), st AS (SELECT a.repeat, a.fold, avg(x.score) AS mu, stddev_pop(x.score) AS sd FROM (SELECT DISTINCT repeat, fold FROM x) a JOIN x ON x.repeat = a.repeat AND x.fold <> a.fold AND x.y = 0 GROUP BY ALL)
    SELECT x.repeat, x.fold, x."user", round((x.score - mu) / (sd + 1e-9), 5) + 0.0 AS z FROM x JOIN st USING (repeat, fold)""")
def g19(spark, sf):
    f = S.folds(events(spark, sf).select("pop", "user").distinct(), "pop", "user", 5, 3).select("repeat", "user", "fold")
    x = f.join(scored(spark, sf), "user")
    refs = x.filter("y = 0").select("repeat", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: k != F.col("fold"))).alias("fold"), "score")
    st = refs.groupBy("repeat", "fold").agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sd"))
    return rounded(x.join(F.broadcast(st), ["repeat", "fold"]).select("repeat", "fold", "user", F.expr("(score - mu) / (sd + 1e-9)").alias("z")), 5)


CELLS = auc_sql(f"(SELECT scorer, platform, y, score FROM {LONG} JOIN (SELECT DISTINCT \"user\", platform FROM $EV) USING (\"user\"))", "scorer, platform")


@query("g20_cell_matrix", f"SELECT scorer, platform, round(auc, 6) AS auc FROM ({CELLS})")
def g20(spark, sf):
    s = scored(spark, sf)
    long = s.select("user", "y", F.lit("score").alias("scorer"), "score").unionByName(s.select("user", "y", F.lit("other").alias("scorer"), F.col("other").alias("score")))
    return rounded(V.auc(long.join(events(spark, sf).select("user", "platform").distinct(), "user"), ["scorer", "platform"]))


@query("g22_similarity", f"SELECT a, b, round(exp(-(m1 / (SELECT max(m1) FROM {SYM}))), 6) AS similarity FROM {SYM}")
def g22(spark, sf):
    m = matrix(spark, sf)
    top = F.broadcast(m.agg(F.max("m1").alias("top")))
    return rounded(m.join(top).select("a", "b", F.exp(-F.col("m1") / F.col("top")).alias("similarity")))


# ---- scalar functions over documents, pages and events
DOCP = "(SELECT p.page_id, concat(left(coalesce(d.text, ''), 200), ' ', p.url) AS t, p.url FROM pages p JOIN documents d ON d.doc_id = p.page_id)"


def linked(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), "text")
    return table(spark, sf, "pages").select("page_id", "url").join(d, "page_id").select("page_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), "url").alias("t"), "url")


@query("h1_urls", "SELECT page_id, unnest(regexp_extract_all(concat(coalesce(d.text, ''), ' ', p.url), 'https?://\\S+')) AS url FROM pages p JOIN documents d ON d.doc_id = p.page_id")
def h1(spark, sf):
    return linked(spark, sf).select("page_id", F.explode(T.urls_of(F.col("t"))).alias("url"))


DOM = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"


@query("h2_domain", f"SELECT page_id, {DOM} AS domain FROM pages")
def h2(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.domain_of(F.col("url")).alias("domain"))


_IN = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"


@query("h3_domain_flags", f"SELECT page_id, string_split({DOM}, '.')[-1] AS tld, {DOM} IN {_IN(T.SOCIAL_SITES)} AS social FROM pages")
def h3(spark, sf):
    d = T.domain_of(F.col("url"))
    return table(spark, sf, "pages").select("page_id", F.element_at(F.split(d, r"\."), -1).alias("tld"), d.isin(*T.SOCIAL_SITES).alias("social"))


_FLAGS = {
    "news": f"d IN {_IN(T.NEWS_SITES)}",
    "social": f"d IN {_IN(T.SOCIAL_SITES)}",
    "platform": f"d IN {_IN(T.PLATFORM_SITES)}",
    "other": f"d <> '' AND d NOT IN {_IN(T.NEWS_SITES + T.SOCIAL_SITES)}",
} | {f"tld_{t}": f"string_split(d, '.')[-1] = '{t}'" for t in T.TOP_LEVELS}


@query(
    "h3b_domain_classes",
    "SELECT page_id, " + ", ".join(f"({c})::INT AS {k}" for k, c in _FLAGS.items())
    # every third page gets a domain of the lists, since the table has none
    + f" FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'nytimes.com' WHEN 3 THEN 'redd.it' ELSE coalesce({DOM}, '') END AS d FROM pages)",
)
def h3b(spark, sf):
    listed = F.when(F.col("page_id") % 6 == 0, "nytimes.com").when(F.col("page_id") % 6 == 3, "redd.it")
    d = table(spark, sf, "pages").select("page_id", F.coalesce(listed, T.domain_of(F.col("url")), F.lit("")).alias("d"))
    return d.select("page_id", *(c.alias(k) for k, c in T.domain_classes(F.col("d")).items()))


TOK = "list_filter(regexp_extract_all(lower(regexp_replace(text, 'https?://\\S+', ' ', 'g')), '[a-z][a-z'']+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in T.STOP) + "))"


@query("h4_tokens", f"SELECT doc_id, len({TOK})::BIGINT AS n, md5(array_to_string({TOK}, ' ')) AS digest FROM documents WHERE text IS NOT NULL")
def h4(spark, sf):
    t = table(spark, sf, "documents").filter("text is not null").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query("h5_text_counts", "SELECT doc_id, len(string_split(text, ' '))::BIGINT AS words, length(text)::BIGINT AS chars, (length(text) - length(replace(text, '#', '')))::BIGINT AS hashes, (length(text) - length(replace(text, '!', '')))::BIGINT AS bangs, round((length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::DOUBLE / length(text), 6) AS upper, round((length(text) - length(regexp_replace(text, '[0-9]', '', 'g')))::DOUBLE / length(text), 6) AS digits FROM documents WHERE length(text) > 0")
def h5(spark, sf):
    t = F.col("text")
    d = table(spark, sf, "documents").filter(F.length("text") > 0)
    return rounded(d.select("doc_id", F.size(F.split(t, " ")).cast("long").alias("words"), F.length(t).cast("long").alias("chars"), T.count_of(t, "#").cast("long").alias("hashes"), T.count_of(t, "!").cast("long").alias("bangs"), T.ratio_of(t, "A-Z").alias("upper"), T.ratio_of(t, "0-9").alias("digits")))


@query("h6_bigrams", f"SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM (SELECT {TOK} AS w FROM documents WHERE text IS NOT NULL)) GROUP BY g HAVING count(*) >= 3")
def h6(spark, sf):
    w = table(spark, sf, "documents").filter("text is not null").select(F.explode(T.bigrams(T.tokens(F.col("text")))).alias("g"))
    return w.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")


@query("h7_list_literal", "SELECT event_id, 't' || k AS tag FROM $EV UNION ALL SELECT event_id, event_type FROM $EV")
def h7(spark, sf):
    lit = F.concat(F.lit("['T"), F.col("k").cast("string"), F.lit("', '"), "event_type", F.lit("']"))
    return events(spark, sf).select("event_id", F.explode(T.parse_list(lit)).alias("tag"))


TOPV = f"(SELECT list(w ORDER BY n DESC, w)[1:25] AS v FROM (SELECT w, count(*) AS n FROM (SELECT unnest({TOK}) AS w FROM documents WHERE text IS NOT NULL) GROUP BY w))"


@query("h8_vocabulary_share", f"SELECT doc_id, round(len(list_filter(w, lambda x: list_contains(v, x))) / greatest(len(w), 1)::DOUBLE, 6) AS share FROM (SELECT doc_id, {TOK} AS w FROM documents WHERE text IS NOT NULL), {TOPV}")
def h8(spark, sf):
    w = table(spark, sf, "documents").filter("text is not null").select("doc_id", T.tokens(F.col("text")).alias("w"))
    top = w.select(F.explode("w").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "x").limit(25).agg(F.collect_list("x").alias("v"))
    return rounded(w.join(F.broadcast(top)).select("doc_id", T.share_in(F.col("w"), F.col("v")).alias("share")))


@query("h9_time_parts", "SELECT event_id, hour(make_timestamp(ts * 1000000)) AS hour, isodow(make_timestamp(ts * 1000000)) - 1 AS weekday, year(make_timestamp(ts * 1000000)) AS year FROM $EV")
def h9(spark, sf):
    at = P.timed(F.col("ts"))
    return events(spark, sf).select("event_id", F.hour(at).cast("long").alias("hour"), F.weekday(at).cast("long").alias("weekday"), F.year(at).cast("long").alias("year"))


@query("h10_log_design", "SELECT event_id, round(ln(1 + coalesce(value, 0)), 6) AS value, coalesce(k, 0)::DOUBLE AS k FROM $EV")
def h10(spark, sf):
    return rounded(P.design(events(spark, sf).select("event_id", "value", "k"), ["value", "k"], ["value"]))


@query("h11_char_grams", f"SELECT g, count(*) AS n FROM (SELECT unnest(list_concat(list_transform(range(1, length(text) + 1), lambda i: text[i:i]), list_transform(range(1, length(text)), lambda i: text[i:i+1]))) AS g FROM {SYMBOLS}) GROUP BY g")
def h11(spark, sf):
    g = Q.symbols(events(spark, sf), ["user"]).select(F.explode(Q.grams(F.col("text"))).alias("g"))
    return g.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("h12_normal_cdf", f"SELECT event_id, round(0.5 * (1 + sign(x) * {ERF.format(z='(abs(x) / sqrt(2.0::DOUBLE))')}), 6) AS p FROM (SELECT event_id, (value - 50) / 25 AS x FROM $EV WHERE value IS NOT NULL)")
def h12(spark, sf):
    return rounded(events(spark, sf).filter("value is not null").select("event_id", V.normal_cdf((F.col("value") - 50) / 25).alias("p")))


@query("h13_json_field", "SELECT event_id, k FROM $EV")
def h13(spark, sf):
    return events(spark, sf).select("event_id", "k")


@query("h14_code_map", "SELECT event_id, CASE k % 4 WHEN 0 THEN '-' WHEN 2 THEN '+' ELSE '~' END AS sign FROM $EV")
def h14(spark, sf):
    codes = F.create_map(F.lit(0), F.lit("-"), F.lit(1), F.lit("~"), F.lit(2), F.lit("+"))
    return events(spark, sf).select("event_id", F.coalesce(F.try_element_at(codes, (F.col("k") % 4).cast("int")), F.lit("~")).alias("sign"))


@query(
    "h12b_log_normal_density",
    "SELECT event_id, round(-ln(x) - ln(0.5::DOUBLE) - 0.9189385332046727::DOUBLE - pow((ln(x) - 3.5) / 0.5, 2) / 2, 5) AS log_density"
    " FROM (SELECT event_id, value::DOUBLE AS x FROM $EV WHERE value > 0)",
)
def h12b(spark, sf):
    x = F.col("value").cast("double")
    return rounded(events(spark, sf).filter("value > 0").select("event_id", V.log_normal_density(x, F.lit(3.5), F.lit(0.5)).alias("log_density")), 5)
