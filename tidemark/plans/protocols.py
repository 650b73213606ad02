"""Queries: protocols over many fits (ablation, repeated validation, matched runs, policy folds, cell matrix, matched synchrony)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evaluate as V
from ..operators import markov as K
from ..operators import models as M
from ..operators import profile as P
from ..operators import rescale as R
from ..operators import sampling as S
from ..operators import sequences as Q
from ..operators import sync as Y
from ..operators.quantiles import without_each_fold
from ..session import cut, discard, scratch, spread
from .base import DRAW_SQL, events, rounded, sql, table
from .cohorts import decile_matched, length_pairs
from .policies import CTX, START, WIDTH
from .profiles import MATCH
from .scores import FOLDS, TENTHS, TOKENS, G, auc_sql, tokens

QUERIES, ORACLE_SQL = {}, {}


def is_op():
    return (F.col("pop") == "op").cast("int")


def query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return put


# ---- classifiers: fits run side by side, their scores are one long table
#: Fixed values of the protocol: the feature groups of the ablation and the pairs that are compared.
HOURS = [f"hour_{h}" for h in range(24)]
PHASE = [*HOURS, *P.MASSES]
SCHEDULE = ["weekday_ratio", "top6h_mass", "hour_entropy", "day_density"]
TEMPO = ["median_gap_min", "p90_gap_min", "burstiness", "frac_gap_under_1min"]
MIX = ["frac_B", "frac_R", "frac_A"]
ABLATION = {
    "volume": ["per_day"],
    "phase": PHASE,
    "schedule": SCHEDULE,
    "tempo": TEMPO,
    "mix": MIX,
    "phase_schedule": PHASE + SCHEDULE,
    "phase_schedule_tempo": PHASE + SCHEDULE + TEMPO,
    "full": PHASE + SCHEDULE + TEMPO + MIX,
    "zone_free": SCHEDULE + TEMPO + MIX,
}
CONTRASTS = [("phase_schedule", "tempo"), ("phase", "tempo"), ("full", "phase_schedule"), ("phase_schedule", "volume"), ("phase_schedule_tempo", "phase_schedule")]
LOGGED = ["median_gap_min", "p90_gap_min", "per_day"]


def designed(p):
    """Profiles as doubles, volumes and gaps as log1p; `n_events` and `n_distinct_ts` stay as they are."""
    return P.design(p, ABLATION["full"] + ABLATION["volume"], LOGGED)


@query("m4_group_ablation")
def m4(spark, sf, draws: int = 200):
    """Nine feature groups by two models, trained on platform A and scored on B, in four cohorts of B: all or
    volume-matched controls, of all accounts or those of 30 (op) and 50 (organic) distinct seconds. AUC of each with
    its bootstrap interval, and five paired differences of groups under the same draws."""
    p = cut(designed(P.profile(events(spark, sf), ["pop", "platform", "user"])).withColumn("y", is_op()))
    train, target = p.filter("platform = 'A'"), p.filter("platform = 'B'")
    scores = M.fit_scores({(g, m): (train, target, columns, m) for g, columns in ABLATION.items() for m in ("lr", "gbt")}, ["features", "model"], "user")
    who = target.select("user", "y", "n_events", "n_distinct_ts")
    strict = who.filter((F.col("n_distinct_ts") >= 30) & ((F.col("y") == 1) | (F.col("n_distinct_ts") >= 50)))
    cohorts = None
    for name, rows in (("all", who), ("strict", strict)):
        positive, control = rows.filter("y = 1"), rows.filter("y = 0")
        matched = S.volume_matched(positive, control, "user", "n_events", seed=name)
        for cohort, chosen in ((f"{name}", control.select("user")), (f"{name}_matched", matched)):
            one = positive.select("user").unionByName(chosen).select(F.lit(cohort).alias("cohort"), "user")
            cohorts = one if cohorts is None else cohorts.unionByName(one)
    long = cut(scores.join(cohorts, "user"))
    by = ["cohort", "features", "model"]
    # an account's scores once, however many cohorts have it
    own = scores.join(cohorts.groupBy("user").agg(F.collect_set("cohort").alias("of")), "user")
    conditions = {f"{c}{m}": F.array_contains("of", f"{c}{m}") for c in ("all", "strict") for m in ("", "_matched")}
    drawn = cut(V.cohort_draws(cut(own), ["features", "model"], "user", conditions, draws, "m4"))
    point = V.auc(long, by)
    out = point.join(drawn.groupBy(*by).agg(*V.interval()), by).select("cohort", "model", F.col("features").alias("quantity"), F.col("auc").alias("value"), "lo", "hi")
    pairs = spark.createDataFrame(CONTRASTS, "a string, b string")  # five rows

    def differences(auc, keys):
        named = lambda s: auc.select(*keys, F.col("features").alias(s), F.col("auc").alias(f"auc_{s}"))
        d = named("a").join(F.broadcast(pairs), "a").join(named("b"), [*keys, "b"])
        return d.select(*keys, F.concat_ws(" - ", "a", "b").alias("quantity"), (F.col("auc_a") - F.col("auc_b")).alias("value"))

    key = ["cohort", "model", "quantity"]
    drawn = drawn.withColumnRenamed("b", "draw")
    spread = differences(drawn, ["cohort", "model", "draw"]).groupBy(*key).agg(*V.interval("value"))
    return out.unionByName(differences(point, ["cohort", "model"]).join(spread, key))


def action_states(spark, sf):
    """The events of each account with their positions."""
    return Q.positions(events(spark, sf), ["user"])


CELLS = [f"t{s}{a}" for s in range(3) for a in range(3)]


def action_vectors(placed, by):
    """Nine transition shares for each key, absent ones 0."""
    p = Q.transitions(placed, by, "action", "action").withColumn("cell", F.concat(F.lit("t"), F.col("s").cast("string"), F.col("a").cast("string")))
    return p.groupBy(*by).pivot("cell", CELLS).agg(F.first("p")).na.fill(0.0)


def cut_vectors(placed, chosen):
    """(run, user, y, nine transition shares) of sequences cut in each run: `chosen` (run, user, y, length) names
    members (y = 1), whose sequences stay whole, and controls, who keep their first `length` events; without a
    transition there is no row.

    Events are not repeated for the runs: an account's transitions are counted along its events once, and each run
    reads its counts at the event where it cuts."""
    along = Q.order(["user"]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = placed.select("user", "ts", "event_id", "pos", "n", "action", F.lag("action").over(Q.order(["user"])).alias("_s"))
    counts = [F.count_if((F.col("_s") == s) & (F.col("action") == a)).over(along).alias(f"t{s}{a}") for s in range(3) for a in range(3)]
    at = F.when(F.col("y") == 1, F.lit(2**62)).otherwise(F.col("length") - 1)
    of = chosen.groupBy("user").agg(F.collect_list(F.struct("run", "y", at.cast("long").alias("at"))).alias("_of"))  # an entry for each run
    here = F.filter("_of", lambda x: F.col("pos") == F.least(x.at, F.col("n") - 1))
    each = moved.select("user", "pos", "n", *counts).join(of, "user").select("user", *CELLS, F.explode(here).alias("x")).select("x.run", "user", "x.y", *CELLS)
    sums = {s: F.col(f"t{s}0") + F.col(f"t{s}1") + F.col(f"t{s}2") for s in range(3)}
    share = lambda c: F.coalesce(F.col(c) / F.nullif(sums[int(c[1])], F.lit(0)), F.lit(0.0)).alias(c)
    return each.filter(sum(sums.values()) > 0).select("run", "user", "y", *map(share, CELLS))


@query("m6_cross_validated")
def m6(spark, sf, repeats: int = 2, k: int = 5):
    """Repeated stratified folds shared by six representations and models; the mean, deviation and range over repeats
    of the AUC pooled over a repeat's folds. Accounts without a transition have no policy vector and are left out
    where that is the representation."""
    p = designed(P.profile(events(spark, sf), ["pop", "user"])).withColumn("y", is_op())
    f = cut(S.folds(p, "y", "user", k, repeats))
    v = cut(f.select("repeat", "fold", "user", "y").join(action_vectors(action_states(spark, sf), ["user"]), "user"))
    kinds = {("full", "lr"): (f, ABLATION["full"]), ("full", "gbt"): (f, ABLATION["full"]), ("phase_schedule", "lr"): (f, ABLATION["phase_schedule"])}
    kinds |= {("phase_schedule", "gbt"): (f, ABLATION["phase_schedule"]), ("policy", "rf"): (v, CELLS), ("policy", "lr"): (v, CELLS)}
    fits = {}
    for (name, model), (rows, columns) in kinds.items():
        for r in range(repeats):
            of = rows.filter(F.col("repeat") == r)
            fits |= {(name, model, r, i): (of.filter(F.col("fold") != i), of.filter(F.col("fold") == i), columns, model) for i in range(k)}
    auc = V.auc(M.fit_scores(fits, ["features", "model", "repeat", "fold"], "user"), ["features", "model", "repeat"])
    return auc.groupBy("features", "model").agg(F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("sd"), F.min("auc").alias("lowest"), F.max("auc").alias("highest"))


@query("m16_length_matched_runs")
def m16(spark, sf, runs: int = 25, k: int = 3):
    """In each run every member is paired with a control whose sequence is cut to the pair's length; a forest on the
    policy vectors of both is validated over k folds. Median, 5th and 95th percentile over runs of macro-F1 and AUC."""
    placed = action_states(spark, sf)
    n = placed.groupBy("pop", "user").agg(F.count(F.lit(1)).alias("n"))
    pairs = length_pairs(n, "pop", "op", "organic", "user", "n", runs)
    chosen = pairs.select("run", F.explode(F.array(*(F.struct(F.col(c).alias("user"), F.lit(y).alias("y"), F.col("length")) for c, y in (("member", 1), ("control", 0))))).alias("x"))
    chosen = cut(chosen.select("run", "x.*"))
    v = cut_vectors(placed, chosen)
    folded = S.folds(v.withColumn("class", F.concat_ws("/", "run", "y")), "class", "user", k, 1)
    # a folder for each run: its fits read its rows alone
    path = scratch(spark, "runs")
    folded.write.partitionBy("run").parquet(path)
    fits = {}
    for r in range(runs):
        of = spark.read.schema(folded.drop("run").schema).parquet(f"{path}/run={r}")
        fits |= {(r, i): (of.filter(F.col("fold") != i), of.filter(F.col("fold") == i), CELLS, "rf") for i in range(k)}
    s = cut(M.fit_scores(fits, ["run", "fold"], "user").withColumn("f", (F.col("score") >= 0.5).cast("int")))
    discard(spark, path)
    measures = V.auc(s, ["run"]).join(V.macro_f1(s, "y", "f", ["run"]), "run")
    at = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    q = measures.agg(F.count(F.lit(1)).alias("runs"), *(F.percentile(c, at).alias(c) for c in ("macro_f1", "auc")))
    return q.select("runs", *(F.col(c)[i].alias(f"{c}_{name}") for c in ("macro_f1", "auc") for i, name in enumerate(("p5", "median", "p95"))))


@query("m18_vector_cross_validation")
def m18(spark, sf, k: int = 5):
    """Mean and deviation of the fold AUCs of the vector classifier."""
    names = [f"x{i}" for i in range(64)]
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") == 0).cast("int").alias("y"), *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)))
    f = cut(S.folds(e, "y", "vec_id", k, 1))
    fits = {(i,): (f.filter(F.col("fold") != i), f.filter(F.col("fold") == i), names, "lr") for i in range(k)}
    return V.auc(M.fit_scores(fits, ["fold"], "vec_id"), ["fold"]).agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("sd"))


# ---- policies over contexts of variable length
DEPTH = 2


def _context_sql() -> str:
    rows = 'SELECT "user", pop, token AS next, \'\' AS c0, ' + ", ".join(
        "CASE WHEN lag(token, {d}) OVER w IS NOT NULL THEN ".format(d=d) + " || ',' || ".join(f"lag(token, {k}) OVER w" for k in range(d, 0, -1)) + f" END::VARCHAR AS c{d}" for d in range(1, DEPTH + 1)
    ) + f' FROM {TOKENS} WINDOW w AS (PARTITION BY "user" ORDER BY ts, event_id)'
    parts, joins, p = [f"r AS ({rows})"], "", {"op": "(1.0::DOUBLE / 30)", "organic": "(1.0::DOUBLE / 30)"}
    for d in range(DEPTH + 1):
        parts.append(f"n{d} AS (SELECT pop, c{d} AS s, next, count(*) AS n FROM r WHERE c{d} IS NOT NULL GROUP BY ALL)")
        parts.append(f"t{d} AS (SELECT pop, s, sum(n) AS total, count(*) AS kinds FROM n{d} GROUP BY ALL)")
        for law in p:
            t, n = f"t{d}{law}", f"n{d}{law}"
            joins += f" LEFT JOIN t{d} {t} ON {t}.pop = '{law}' AND {t}.s = r.c{d} LEFT JOIN n{d} {n} ON {n}.pop = '{law}' AND {n}.s = r.c{d} AND {n}.next = r.next"
            p[law] = f"(CASE WHEN {t}.total IS NULL THEN {p[law]} ELSE (coalesce({n}.n, 0) + {t}.kinds * {p[law]}) / ({t}.total + {t}.kinds) END)"
    return f"WITH {', '.join(parts)} SELECT r.\"user\", r.pop, round(avg(ln({p['op']})) - avg(ln({p['organic']})), 6) + 0.0 AS llr FROM r{joins} GROUP BY ALL"


@query("m11b_context_policy", _context_sql())
def m11b(spark, sf):
    """Each account's mean log ratio of two policies over the last two tokens, which escape to shorter contexts."""
    rows = cut(K.suffixes(tokens(spark, sf), ["user"], DEPTH).select("user", "pop", "next", *(f"c{d}" for d in range(DEPTH + 1))))
    tree = K.context_tree(rows, ["pop"], DEPTH, 30)
    of = lambda law: [t.filter(F.col("pop") == law).drop("pop") for t in tree]
    s = K.context_score(K.context_score(rows, of("op"), [], 30, "la"), of("organic"), [], 30, "lb")
    return rounded(s.groupBy("user", "pop").agg((F.avg("la") - F.avg("lb")).alias("llr")))


@query("m19b_context_tree")
def m19b(spark, sf, depth: int = 4):
    """(pop, contexts, longest, tree, order_1, order_0): nats a token of accounts that no count has seen, under trees
    grown on other accounts where a second set of them gains."""
    a = events(spark, sf).select("user").distinct()
    third = F.pmod(S.draw("tree", F.col("user")), F.lit(3))
    rows = K.suffixes(tokens(spark, sf), ["user"], depth).join(a.select("user", third.alias("third")), "user")
    # the last third's tokens have rows in the tables too, so none of them meets a law in a join
    tree = K.context_tree(rows, ["pop"], depth, 30, F.col("third") == 1, F.col("third") == 2)
    nats = K.nats(tree, ["pop"], (1, 0))
    kept = None
    for d, t in enumerate(tree):
        n = t.filter("kept").select("pop", "suffix").distinct().withColumn("d", F.lit(d))
        kept = n if kept is None else kept.unionByName(n)
    return kept.groupBy("pop").agg(F.count(F.lit(1)).alias("contexts"), F.max("d").alias("longest")).join(nats, "pop")


# ---- symbol n-grams as sparse features
def symbol_terms(spark, sf):
    """(user, g, n): how often an account's symbol string has each n-gram."""
    g = Q.symbols(events(spark, sf), ["user"]).select("user", F.explode(Q.grams(F.col("text"))).alias("g"))
    return cut(g.groupBy("user", "g").agg(F.count(F.lit(1)).alias("n")))


@query("m7b_symbol_scorer")
def m7b(spark, sf):
    """Held-out accounts scored by a linear law on TF-IDF of symbol n-grams; terms and weights of terms are learned
    from the training accounts alone."""
    a = events(spark, sf).select("user", "pop").distinct().withColumn("y", is_op())
    a = cut(S.holdout(a, "pop", "user", "m7"))
    return M.sparse_fit_score(symbol_terms(spark, sf), a.filter("split = 'train'"), a.filter("split = 'test'"), "user", "g", "n")


@query("m17c_refit_symbol_scorer")
def m17c(spark, sf):
    """(fit, target, accounts, auc): the symbol scorer fitted on each platform's accounts, and its AUC on the accounts
    of both platforms that no fit has seen."""
    a = events(spark, sf).select("user", "pop", "platform").distinct().withColumn("y", is_op())
    a = cut(S.holdout(a, "pop", "user", "m17"))
    terms, out = symbol_terms(spark, sf), None
    for fit in ("A", "B"):
        train = a.filter((F.col("split") == "train") & (F.col("platform") == fit))
        s = M.sparse_fit_score(terms, train, a.filter("split = 'test'"), "user", "g", "n").withColumn("fit", F.lit(fit))
        out = s if out is None else out.unionByName(s)
    s = cut(out.join(a.select("user", F.col("platform").alias("target")), "user"))
    n = s.groupBy("fit", "target").agg(F.count(F.lit(1)).alias("accounts"))
    return n.join(V.auc(s, ["fit", "target"]), ["fit", "target"])


# ---- policies in folds
MOVES = f'(SELECT pop, "user", prev, token AS next, count(*) AS n FROM (SELECT *, lag(token) OVER (PARTITION BY "user" ORDER BY ts, event_id) AS prev FROM {TOKENS}) WHERE prev IS NOT NULL GROUP BY ALL)'
FOLD_LLR = f"""(WITH m AS (SELECT f.repeat, f.fold, m.* FROM {MOVES} m JOIN {FOLDS} f USING ("user")),
    g AS (SELECT DISTINCT repeat, fold FROM m),
    c AS (SELECT g.repeat, g.fold, prev, next, coalesce(sum(n) FILTER (pop = 'op'), 0) AS a, coalesce(sum(n) FILTER (pop = 'organic'), 0) AS b FROM g JOIN m ON m.repeat = g.repeat AND m.fold <> g.fold GROUP BY ALL),
    t AS (SELECT repeat, fold, prev, sum(a) AS ta, sum(b) AS tb FROM c GROUP BY ALL),
    l AS (SELECT m.repeat, g.fold AS law, m.fold, m.pop, m."user", sum(m.n * (ln((coalesce(a, 0) + 1.0::DOUBLE) / (coalesce(ta, 0) + 30)) - ln((coalesce(b, 0) + 1.0::DOUBLE) / (coalesce(tb, 0) + 30)))) / sum(m.n) AS llr
        FROM m JOIN g ON g.repeat = m.repeat LEFT JOIN c ON c.repeat = m.repeat AND c.fold = g.fold AND c.prev = m.prev AND c.next = m.next LEFT JOIN t ON t.repeat = m.repeat AND t.fold = g.fold AND t.prev = m.prev GROUP BY ALL),
    s AS (SELECT repeat, law, avg(llr) AS mu, stddev_pop(llr) AS sd FROM l WHERE fold <> law AND pop = 'organic' GROUP BY ALL)
    SELECT l.repeat, l.fold, l."user", (pop = 'op')::INT AS y, round(llr, 6) + 0.0 AS llr, round((llr - mu) / (sd + 1e-9), 4) + 0.0 AS z FROM l JOIN s ON s.repeat = l.repeat AND s.law = l.fold WHERE l.law = l.fold)"""


def fold_llr(spark, sf):
    counts = K.moves(K.steps(tokens(spark, sf), ["user"]), ["pop", "user"])
    folds = S.folds(events(spark, sf).select("pop", "user").distinct(), "pop", "user", 5, 3).drop("pop")
    s = K.fold_ratios(cut(counts.join(folds, "user")), "pop", "op", "organic", 30, 5)
    return s.select("repeat", "fold", "user", is_op().alias("y"), (F.round("llr", 6) + 0.0).alias("llr"), (F.round("z", 4) + 0.0).alias("z"))


OWN_DECILES = f"""(WITH f AS (SELECT * FROM {FOLDS} WHERE repeat = 0), g AS (SELECT x.*, f.fold FROM {G} x JOIN f USING ("user")), l AS (SELECT unnest(range(5)) AS law),
    e AS (SELECT law, platform, list_sort(list_distinct(quantile_cont(sec / 60.0::DOUBLE, {TENTHS}))) AS q FROM g JOIN l ON g.fold <> l.law WHERE pop = 'organic' GROUP BY ALL),
    t AS (SELECT law, fold, pop, "user", ts, event_id, action * 10 + least(len(list_filter(q, lambda z: z <= sec / 60.0::DOUBLE)), 9) AS token FROM g JOIN e USING (platform)),
    m AS (SELECT law, fold, pop, "user", prev, token AS next, count(*) AS n FROM (SELECT *, lag(token) OVER (PARTITION BY law, "user" ORDER BY ts, event_id) AS prev FROM t) WHERE prev IS NOT NULL GROUP BY ALL),
    c AS (SELECT law, prev, next, coalesce(sum(n) FILTER (pop = 'op'), 0) AS a, coalesce(sum(n) FILTER (pop = 'organic'), 0) AS b FROM m WHERE fold <> law GROUP BY ALL),
    tt AS (SELECT law, prev, sum(a) AS ta, sum(b) AS tb FROM c GROUP BY ALL),
    s AS (SELECT m.law, m.fold, pop, "user", sum(n * (ln((coalesce(a, 0) + 1.0::DOUBLE) / (coalesce(ta, 0) + 30)) - ln((coalesce(b, 0) + 1.0::DOUBLE) / (coalesce(tb, 0) + 30)))) / sum(n) AS llr FROM m LEFT JOIN c USING (law, prev, next) LEFT JOIN tt USING (law, prev) GROUP BY ALL),
    r AS (SELECT law, avg(llr) AS mu, stddev_pop(llr) AS sd FROM s WHERE fold <> law AND pop = 'organic' GROUP BY law)
    SELECT s.law AS fold, "user", (pop = 'op')::INT AS y, round(llr, 6) + 0.0 AS llr, round((llr - mu) / (sd + 1e-9), 4) + 0.0 AS z FROM s JOIN r USING (law) WHERE s.fold = s.law)"""


def own_decile_llr(spark, sf, k: int = 5):
    """Held-out ratios whose tokens take the gap deciles of each fold's own training controls."""
    folds = S.folds(events(spark, sf).select("pop", "user").distinct(), "pop", "user", k, 1).select("user", "fold")
    g = cut(Q.gaps(events(spark, sf), ["user"]).join(folds, "user"))
    edges = without_each_fold(g.filter("pop = 'organic'"), ["platform"], "gap", "fold", Q.TENTHS, k, "edges")
    edges = cut(edges.select("platform", F.col("fold").alias("law"), F.array_distinct("edges").alias("edges")))
    # all rows under each law: sorted and counted by as many tasks as they need
    token = spread(Q.tokenize(g, edges, ["platform"]).select("law", "fold", "pop", "user", "ts", "event_id", "token"), g.count() * k, "law", "user")
    moved = K.moves(K.steps(token, ["law", "user"]), ["law", "fold", "pop", "user"])
    s = K.law_ratios(cut(moved), "pop", "op", "organic", 30)
    return s.select("fold", "user", is_op().alias("y"), (F.round("llr", 6) + 0.0).alias("llr"), (F.round("z", 4) + 0.0).alias("z"))


@query("m13d_own_deciles", f"SELECT * FROM {OWN_DECILES}")
def m13d(spark, sf):
    return own_decile_llr(spark, sf)


@query(
    "m13e_own_and_frozen_auc",
    f"WITH o AS {OWN_DECILES}, z AS (SELECT * FROM {FOLD_LLR} WHERE repeat = 0), s AS (SELECT 'own' AS deciles, y, llr, z FROM o UNION ALL SELECT 'frozen', y, llr, z FROM z) "
    f"SELECT a.deciles, round(a.auc, 5) AS raw, round(b.auc, 5) AS centred FROM ({auc_sql('(SELECT deciles, y, llr AS score FROM s)', 'deciles')}) a JOIN ({auc_sql('(SELECT deciles, y, z AS score FROM s)', 'deciles')}) b USING (deciles)",
)
def m13e(spark, sf):
    """AUC over all folds of one repeat with each fold's own deciles and with the platforms' frozen ones."""
    s = own_decile_llr(spark, sf).withColumn("deciles", F.lit("own")).select("deciles", "y", "llr", "z")
    s = cut(s.unionByName(fold_llr(spark, sf).filter("repeat = 0").withColumn("deciles", F.lit("frozen")).select("deciles", "y", "llr", "z")))
    raw, centred = (V.auc(s.withColumnRenamed(c, "score"), ["deciles"]).select("deciles", F.round("auc", 5).alias(name)) for c, name in (("llr", "raw"), ("z", "centred")))
    return raw.join(centred, "deciles")


@query("m13b_policy_folds", f"SELECT * FROM {FOLD_LLR}")
def m13b(spark, sf):
    """Held-out ratios of two policies in 3 x 5 folds, and the same centred by the training controls."""
    return fold_llr(spark, sf)


@query(
    "m13c_policy_fold_auc",
    f"WITH s AS {FOLD_LLR} SELECT a.repeat, round(a.auc, 5) AS raw, round(b.auc, 5) AS centred FROM ({auc_sql('(SELECT repeat, y, llr AS score FROM s)', 'repeat')}) a JOIN ({auc_sql('(SELECT repeat, y, z AS score FROM s)', 'repeat')}) b USING (repeat)",
)
def m13c(spark, sf):
    """AUC pooled over the folds of each repeat, raw and centred."""
    s = cut(fold_llr(spark, sf))
    raw, centred = (V.auc(s, ["repeat"], score=c).withColumnRenamed("auc", n) for c, n in (("llr", "raw"), ("z", "centred")))
    return rounded(raw.join(centred, "repeat"), 5)


# ---- one policy for each population, every cell of frozen, specific and pairwise comparisons
TRAINED, REFERENCE = ("p0", "p1", "p2", "p3"), "ref"
#: (kind, a, b, base, positive, negative): the score is ll under a less ll under base.
MATRIX = [("frozen", a, b, REFERENCE, b, REFERENCE) for a in TRAINED for b in TRAINED]
MATRIX += [("specific", a, b, REFERENCE, a, b) for a in TRAINED for b in TRAINED if a != b]
MATRIX += [("pairwise", a, b, b, a, b) for a in TRAINED for b in TRAINED if a != b]
_P = f"(SELECT \"user\", CASE WHEN \"user\" % 5 = 4 THEN 'ref' ELSE 'p' || (\"user\" % 5) END AS p, {DRAW_SQL.format(chr(39) + 'g20|' + chr(39) + ' || ' + chr(34) + 'user' + chr(34))} % 10 < 3 AS test, prev, next, n FROM {MOVES})"
_VALUES = ", ".join(str(c) for c in MATRIX)


@query(
    "g20b_frozen_specific_pairwise",
    f"""WITH m AS {_P}, c AS (SELECT p, prev, next, sum(n) AS n FROM m WHERE NOT test GROUP BY ALL), t AS (SELECT p, prev, sum(n) AS t FROM c GROUP BY ALL), q AS (SELECT DISTINCT p FROM m),
    l AS (SELECT m."user", m.p, q.p AS law, sum(m.n * ln((coalesce(c.n, 0) + 1.0::DOUBLE) / (coalesce(t.t, 0) + 30))) / sum(m.n) AS ll FROM m JOIN q ON true LEFT JOIN c ON c.p = q.p AND c.prev = m.prev AND c.next = m.next LEFT JOIN t ON t.p = q.p AND t.prev = m.prev WHERE m.test GROUP BY ALL),
    x AS (SELECT * FROM (VALUES {_VALUES}) v(kind, a, b, base, pos, neg)),
    s AS (SELECT kind, a, b, (l.p = pos)::INT AS y, round(l.ll - k.ll, 6) AS score FROM x JOIN l ON l.law = x.a AND l.p IN (pos, neg) JOIN l k ON k.law = x.base AND k."user" = l."user")
    SELECT kind, a, b, round(auc, 5) AS auc FROM ({auc_sql('s', 'kind, a, b')})""",
)
def g20b(spark, sf):
    """AUC of every cell on held-out accounts of five populations; the cells are a small table."""
    u = F.col("user")
    name = F.when(u % 5 == 4, REFERENCE).otherwise(F.concat(F.lit("p"), (u % 5).cast("string")))
    m = cut(K.moves(K.steps(tokens(spark, sf), ["user"]), ["user"])).withColumns({"p": name, "test": F.pmod(S.draw("g20", u), F.lit(10)) < 3})
    l = cut(K.log_likelihoods(m.filter("test"), m.filter(~F.col("test")), "p", [*TRAINED, REFERENCE], ["user", "p"], 30))
    cells = spark.createDataFrame(MATRIX, "kind string, a string, b string, base string, pos string, neg string")
    base = l.select("user", F.col("law").alias("base"), F.col("ll").alias("other"))
    s = l.join(F.broadcast(cells), F.col("law") == F.col("a")).filter(F.col("p").isin(F.col("pos"), F.col("neg"))).join(base, ["user", "base"])
    s = s.select("kind", "a", "b", (F.col("p") == F.col("pos")).cast("int").alias("y"), F.round(F.col("ll") - F.col("other"), 6).alias("score"))
    return rounded(V.auc(s, ["kind", "a", "b"]), 5)


# ---- synchrony against matched control sets
SETS, SHIFTS = 100, 20
#: name, first bin, bins, bins of a turn: whole weeks of the month; whole days of its second half, which has two weeks.
SPANS = [("month", 0, 672, 168), ("half", 360, 360, 24)]
_SETS = f"""(SELECT DISTINCT set_id, control AS "user" FROM ({MATCH.replace('range(5)', f'range({SETS})').replace("'dec|'", "'g14|'")}) UNION SELECT DISTINCT -1, "user" FROM $EV WHERE pop = 'op')"""


def _span_sql(name, first, count, turn):
    at = f"{DRAW_SQL.format(chr(39) + 'sync|' + chr(39) + ' || rep || ' + chr(39) + '|' + chr(39) + ' || b.' + chr(34) + 'user' + chr(34))}"
    own = f'(SELECT "user", (ts - {START + first * WIDTH}) // {WIDTH} AS bin, count(*) AS c FROM $EV WHERE ts >= {START + first * WIDTH} AND ts < {START + (first + count) * WIDTH} GROUP BY ALL)'
    var = f"sum(c * c) / {count} - (sum(c) / {count}) ** 2"
    return f"""SELECT '{name}' AS span, set_id, v / mu AS ratio FROM (SELECT set_id, {var} AS v FROM (SELECT set_id, bin, sum(c)::DOUBLE AS c FROM {own} b JOIN sets USING ("user") GROUP BY ALL) GROUP BY set_id)
        JOIN (SELECT set_id, avg(v) AS mu FROM (SELECT set_id, rep, {var} AS v FROM (SELECT set_id, rep, bin, sum(c)::DOUBLE AS c FROM (SELECT set_id, rep, (bin + (1 + {at} % {max(1, count // turn - 1)}) * {turn}) % {count} AS bin, c FROM {own} b JOIN sets USING ("user"), range({SHIFTS}) t(rep)) GROUP BY ALL) GROUP BY set_id, rep) GROUP BY set_id) USING (set_id)"""


@query(
    "g14b_synchrony_of_matched_sets",
    f"WITH sets AS {_SETS}, r AS ({' UNION ALL '.join(_span_sql(*s) for s in SPANS)}) SELECT span, count(*) FILTER (set_id >= 0) AS n_sets, round(max(ratio) FILTER (set_id < 0), 4) AS observed, round(avg(ratio) FILTER (set_id >= 0), 4) AS mean, round(stddev_pop(ratio) FILTER (set_id >= 0), 4) AS sd, round((max(ratio) FILTER (set_id < 0) - avg(ratio) FILTER (set_id >= 0)) / greatest(stddev_pop(ratio) FILTER (set_id >= 0), 1e-9), 2) AS z FROM r GROUP BY span",
)
def g14b(spark, sf):
    """The members' synchrony against that of 100 decile-matched control sets, over the month and its second half."""
    e = events(spark, sf)
    v = e.groupBy("pop", "user").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sets = decile_matched(v, "pop", "op", "organic", "user", "n", SETS, "g14").select("set_id", F.col("control").alias("user"))
    sets = cut(sets.unionByName(v.filter("pop = 'op'").select(F.lit(-1).cast("long").alias("set_id"), "user")).distinct())
    out = None
    for name, first, count, turn in SPANS:
        start = START + first * WIDTH
        own = Y.binned(e.filter((F.col("ts") >= start) & (F.col("ts") < start + count * WIDTH)), ["user"], WIDTH, start)
        r = Y.synchrony(own, sets, "set_id", "user", count, turn, SHIFTS).select(F.lit(name).alias("span"), "set_id", "ratio")
        out = r if out is None else out.unionByName(r)
    control = F.when(F.col("set_id") >= 0, F.col("ratio"))
    s = out.groupBy("span").agg(F.count(control).alias("n_sets"), F.max(F.when(F.col("set_id") < 0, F.col("ratio"))).alias("observed"), F.avg(control).alias("mean"), F.stddev_pop(control).alias("sd"))
    z = (F.col("observed") - F.col("mean")) / F.greatest(F.col("sd"), F.lit(1e-9))
    return s.select("span", "n_sets", *(F.round(c, 4).alias(c) for c in ("observed", "mean", "sd")), F.round(z, 2).alias("z"))


# ---- variants of the rescaled-time study: other accounts and another reference population
@dataclass(frozen=True)
class Variant:
    """Accounts of least to most events; the reference population's gaps make each platform's law."""

    name: str
    reference: str
    least: int = 1
    most: int = 2**31


VARIANTS = (Variant("all", "organic"), Variant("capped", "organic", 50, 70), Variant("reversed", "op", 50))


def _variant_sql(v):
    own = f'(SELECT x.* FROM {CTX} x SEMI JOIN (SELECT "user" FROM $EV GROUP BY "user" HAVING count(*) BETWEEN {v.least} AND {v.most}) k USING ("user"))'
    u = f"least(greatest((below + 0.5::DOUBLE + ({DRAW_SQL.format(chr(39) + 'pit|' + chr(39) + ' || x.event_id')} + 0.5::DOUBLE) / 4294967296.0::DOUBLE * c) / (n + 1.0::DOUBLE), 1e-9), 1 - 1e-9)"
    return f"""SELECT '{v.name}' AS variant, platform, pop, accounts, m, max(CASE WHEN pop = '{v.reference}' THEN m END) OVER (PARTITION BY platform) AS base FROM (
        SELECT x.platform, x.pop, count(DISTINCT x."user") AS accounts, avg(-ln(1 - {u})) AS m FROM {own} x JOIN (SELECT platform, ctx, d, c, sum(c) OVER (PARTITION BY platform, ctx ORDER BY d) - c AS below, sum(c) OVER (PARTITION BY platform, ctx) AS n
        FROM (SELECT platform, ctx, d, count(*) FILTER (pop = '{v.reference}') AS c FROM {own} GROUP BY ALL)) l USING (platform, ctx, d) GROUP BY ALL)"""


@query(
    "p9_variants",
    f"SELECT variant, platform, pop, accounts, round(m, 5) AS mean_tau, round((m / base - ln(1 / base)) - (1 - ln(1 / m)), 5) + 0.0 AS excess FROM ({' UNION ALL '.join(map(_variant_sql, VARIANTS))})",
)
def p9(spark, sf):
    """Mean rescaled time of every population under each variant, and its excess likelihood under the reference's law."""
    e, out = events(spark, sf), None
    size = e.groupBy("user").agg(F.count(F.lit(1)).alias("_n"))
    rows = cut(R.contexts(e, ["user"]).join(size, "user"))
    for v in VARIANTS:
        own = rows.filter(F.col("_n").between(v.least, v.most))
        t = R.rescaled(own, R.baseline(own, ["platform"], F.col("pop") == v.reference), ["platform"])
        m = t.groupBy("platform", "pop").agg(F.count_distinct("user").alias("accounts"), F.avg("tau").alias("m"))
        base = m.filter(F.col("pop") == v.reference).select("platform", F.col("m").alias("base"))  # a row for each platform
        excess = R.nll(F.col("m"), 1 / F.col("base")) - R.nll(F.col("m"), 1 / F.col("m"))
        one = m.join(F.broadcast(base), "platform", "left").select(F.lit(v.name).alias("variant"), "platform", "pop", "accounts", F.col("m").alias("mean_tau"), excess.alias("excess"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 5)
