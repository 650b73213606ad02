"""Queries: filters, cohorts, joins and account profiles (groups B, C, D, F)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import profile as P
from ..operators import quantiles as E
from ..operators import sampling as S
from ..operators import sequences as Q
from ..operators.ranks import numbered
from ..session import cut
from .base import DRAW_SQL, events, rounded, sql, table

QUERIES, ORACLE_SQL = {}, {}


def query(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = sql(oracle)
        return f

    return put


HOURS = ", ".join(f"avg((hour(make_timestamp(ts * 1000000)) = {h})::INT::DOUBLE) AS hour_{h}" for h in range(24))
HN = [f"hour_{h}" for h in range(24)]
#: The profile of {by} over the event relation {src}, all 41 features.
PROFILE = (
    "WITH e AS (SELECT *, (ts - lag(ts) OVER w) / 60.0::DOUBLE AS gap, make_timestamp(ts * 1000000)::DATE AS d, lag(make_timestamp(ts * 1000000)::DATE) OVER w AS pd FROM {src} WINDOW w AS (PARTITION BY {by} ORDER BY ts, event_id)),"
    " g AS (SELECT {by}, count(*) AS n_events, avg((action = 0)::INT::DOUBLE) AS frac_b, avg((action = 1)::INT::DOUBLE) AS frac_r, avg((action = 2)::INT::DOUBLE) AS frac_a, " + HOURS + ","
    " sum((isodow(d) < 6)::INT)::DOUBLE AS wk, sum((isodow(d) >= 6)::INT)::DOUBLE AS we, quantile_cont(gap, 0.5) AS med, quantile_cont(gap, 0.9) AS p90, avg(gap) AS mu, stddev_pop(gap) AS sd,"
    " avg((gap < 1)::INT::DOUBLE) AS fast, count(DISTINCT d) AS days, date_diff('day', min(d), max(d)) AS span, count(DISTINCT ts) AS nts FROM e GROUP BY {by})"
    ' SELECT {by}, frac_b AS "frac_B", frac_r AS "frac_R", frac_a AS "frac_A", ' + ", ".join(HN) + ","
    " " + " + ".join(HN[6:16]) + " AS moscow_mass, " + " + ".join(HN[0:6]) + " AS night_mass, " + " + ".join(HN[15:21]) + " AS evening_mass,"
    " -(" + " + ".join(f"{h} * ln({h} + 1e-9)" for h in HN) + ") AS hour_entropy, list_sum(list_sort([" + ", ".join(HN) + "], 'DESC')[1:6]) AS top6h_mass,"
    " CASE WHEN we = 0 THEN 5.0::DOUBLE ELSE least(5.0::DOUBLE, (wk / 5) / (we / 2 + 1e-9)) END AS weekday_ratio, coalesce(med, 0) AS median_gap_min, coalesce(p90, 0) AS p90_gap_min,"
    " coalesce((sd - mu) / (sd + mu + 1e-9), 0) AS burstiness, coalesce(fast, 0) AS frac_gap_under_1min, days::DOUBLE / (span + 1) AS day_density, n_events::DOUBLE / days AS per_day, n_events, nts AS n_distinct_ts FROM g"
)


def profile_sql(src: str, by: str, columns: list[str] | None = None, digits: int = 6) -> str:
    names = columns or ["frac_B", "frac_R", "frac_A", *HN, *P.MASSES, "hour_entropy", "top6h_mass", "weekday_ratio", "median_gap_min", "p90_gap_min", "burstiness", "frac_gap_under_1min", "day_density", "per_day"]
    shown = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in names)
    tail = "" if columns else ", n_events, n_distinct_ts"
    return f"SELECT {by}, {shown}{tail} FROM (" + PROFILE.format(src=src, by=by) + ")"


@query("d1_profile", profile_sql("$EV", 'pop, "user"'))
def d1(spark, sf):
    return rounded(P.profile(events(spark, sf), ["pop", "user"]))


@query("d2_population_profile", profile_sql("(SELECT * FROM $EV WHERE pop = 'op' AND ts BETWEEN 1704153600 AND 1705968000 QUALIFY count(*) OVER (PARTITION BY \"user\") >= 10)", '"user"'))
def d2(spark, sf):
    e = events(spark, sf).filter("pop = 'op'").filter(F.col("ts").between(1704153600, 1705968000))
    e = e.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user"))).filter("n >= 10")
    return rounded(P.profile(e, ["user"]))


@query("d3_hour_histogram", 'SELECT "user", hour, round(n::DOUBLE / sum(n) OVER (PARTITION BY "user"), 6) AS p FROM (SELECT "user", hour(make_timestamp(ts * 1000000)) AS hour, count(*) AS n FROM $EV GROUP BY ALL)')
def d3(spark, sf):
    return rounded(P.hour_shares(events(spark, sf), ["user"])).withColumn("hour", F.col("hour").cast("long"))


for _name, _cols in (("d4_top_hours_mass", ["top6h_mass"]), ("d5_hour_entropy", ["hour_entropy"]), ("d6_weekday_ratio", ["weekday_ratio"]), ("d7_gap_tempo", ["median_gap_min", "p90_gap_min", "burstiness", "frac_gap_under_1min"]), ("d8_day_density", ["day_density", "per_day"])):
    query(_name, profile_sql("$EV", '"user"', _cols))(lambda spark, sf, c=_cols: rounded(P.profile(events(spark, sf), ["user"]).select("user", *c)))

ERA = "CASE WHEN o.y <= 1997 THEN 'le1997' ELSE o.y::VARCHAR END"
ORDERS_SQL = "(SELECT o_orderkey AS event_id, o_custkey AS \"user\", epoch_us(o_orderdate::TIMESTAMP) // 1000000 AS ts, 0::BIGINT AS action, CASE WHEN year(o_orderdate) <= 1997 THEN 'le1997' ELSE year(o_orderdate)::VARCHAR END AS era FROM orders WHERE year(o_orderdate) <= 2000)"


def orders(spark, sf):
    t = table(spark, sf, "orders")
    y = F.year("o_orderdate")
    era = F.when(y <= 1997, "le1997").otherwise(y.cast("string"))
    ts = F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000000")
    return t.filter(y <= 2000).select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("user"), ts.alias("ts"), F.lit(0).cast("long").alias("action"), era.alias("era"))


ERA_COLUMNS = ["top6h_mass", "weekday_ratio", "median_gap_min", "p90_gap_min", "burstiness", "day_density", "per_day"]


@query("d9_era_features", profile_sql(f"(SELECT * FROM {ORDERS_SQL} QUALIFY count(*) OVER (PARTITION BY era, \"user\") >= 5)", 'era, "user"', ERA_COLUMNS))
def d9(spark, sf):
    o = orders(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("era", "user"))).filter("n >= 5")
    return rounded(P.profile(o, ["era", "user"]).select("era", "user", *ERA_COLUMNS))


@query("d10_channel_features", profile_sql('(SELECT event_id, k, ts, 0 AS action FROM $EV)', "k", ["hour_entropy", "top6h_mass", "median_gap_min", "burstiness", "day_density", "per_day"]))
def d10(spark, sf):
    e = events(spark, sf).withColumn("action", F.lit(0))
    return rounded(P.profile(e, ["k"]).select("k", "hour_entropy", "top6h_mass", "median_gap_min", "burstiness", "day_density", "per_day"))


SHARES = '(SELECT pop, "user", hour, n::DOUBLE / sum(n) OVER (PARTITION BY "user") AS p FROM (SELECT pop, "user", hour(make_timestamp(ts * 1000000)) AS hour, count(*) AS n FROM $EV GROUP BY ALL))'
CENTROID = f'(SELECT pop, hour, sum(p) / any_value(a.n) AS p FROM {SHARES} JOIN (SELECT pop, count(DISTINCT "user") AS n FROM $EV GROUP BY pop) a USING (pop) GROUP BY pop, hour)'


@query("d11_hour_centroid", f"SELECT pop, hour, round(p, 6) AS p FROM {CENTROID}")
def d11(spark, sf):
    shares = P.hour_shares(events(spark, sf), ["pop", "user"])
    return rounded(P.centroid(shares, "pop", "user")).withColumn("hour", F.col("hour").cast("long"))


PERIODS = """WITH o AS (SELECT "user", era, count(*)::DOUBLE AS n FROM $OR WHERE era IN ('1998', '1999') GROUP BY ALL),
    j AS (SELECT coalesce(a."user", b."user") AS "user", a.n AS n0, b.n AS n1, CASE WHEN a.n IS NULL THEN 'entrant' WHEN b.n IS NULL THEN 'leaver' ELSE 'stayer' END AS status
          FROM (SELECT * FROM o WHERE era = '1998') a FULL JOIN (SELECT * FROM o WHERE era = '1999') b ON a."user" = b."user")""".replace("$OR", ORDERS_SQL)


def periods(spark, sf):
    """(user, n0, n1, status): accounts of two periods as stayers, leavers and entrants."""
    o = orders(spark, sf).filter("era in ('1998', '1999')").groupBy("user", "era").agg(F.count(F.lit(1)).cast("double").alias("n"))
    a, b = (o.filter(F.col("era") == e).select("user", F.col("n").alias(n)) for e, n in (("1998", "n0"), ("1999", "n1")))
    status = F.when(F.col("n0").isNull(), "entrant").when(F.col("n1").isNull(), "leaver").otherwise("stayer")
    return a.join(b, "user", "full_outer").withColumn("status", status)


@query("c7_stayers_leavers", PERIODS + " SELECT * FROM j")
def c7(spark, sf):
    return periods(spark, sf)


@query("d12_period_medians", PERIODS + " SELECT status, count(*) AS n, median(n0) AS before, median(n1) AS after, median(n1 - n0) AS delta, avg((n1 > n0)::INT::DOUBLE) AS increased FROM j GROUP BY status")
def d12(spark, sf):
    j = cut(periods(spark, sf))
    each = j.select("status", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), x.alias("v")) for k, x in enumerate((F.col("n0"), F.col("n1"), F.col("n1") - F.col("n0")))))).alias("x")).select("status", "x.*")
    medians = E.quantiles(each, ["status", "k"], "v", [0.5]).groupBy("status").agg(*(F.max(F.when(F.col("k") == k, F.col("q")[0])).alias(name) for k, name in enumerate(("before", "after", "delta"))))
    counts = j.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("n1") > F.col("n0")).cast("double")).alias("increased"))
    return counts.join(medians, "status", "left").select("status", "n", "before", "after", "delta", "increased")


@query("d13_without_top_decile", PERIODS + " SELECT count(*) AS n, median(n1 - n0) AS delta FROM j WHERE status = 'stayer' AND n0 <= (SELECT quantile_cont(n0, 0.9) FROM j WHERE status = 'stayer')")
def d13(spark, sf):
    s = cut(periods(spark, sf).filter("status = 'stayer'"))
    edge = E.quantiles(s, [], "n0", [0.9]).select(F.col("q")[0].alias("edge"))
    kept = cut(s.join(F.broadcast(edge)).filter("n0 <= edge").withColumn("delta", F.expr("n1 - n0")))
    return kept.agg(F.count(F.lit(1)).alias("n")).join(E.quantiles(kept, [], "delta", [0.5]).select(F.col("q")[0].alias("delta")), how="left")


FLAGS = 'WITH s AS (SELECT pop, "user", count(*) AS n, avg((action = 2)::INT::DOUBLE) AS share FROM $EV GROUP BY ALL), t AS (SELECT quantile_cont(share, 0.9) AS edge FROM s WHERE pop = \'organic\')'


@query("d14_flagged_medians", FLAGS + " SELECT pop, share >= edge AS flagged, count(*) AS accounts, median(n) AS median_events, round(median(share), 6) AS median_share FROM s, t GROUP BY ALL")
def d14(spark, sf):
    s = events(spark, sf).groupBy("pop", "user").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("action") == 2).cast("double")).alias("share"))
    s = cut(s)
    edge = E.quantiles(s.filter("pop = 'organic'"), [], "share", [0.9]).select(F.col("q")[0].alias("edge"))
    out = cut(s.join(F.broadcast(edge)).withColumn("flagged", F.col("share") >= F.col("edge")))
    by = ["pop", "flagged"]
    counts = out.groupBy(*by).agg(F.count(F.lit(1)).alias("accounts"))
    for c in ("n", "share"):
        counts = counts.join(E.quantiles(out, by, c, [0.5]).select(*by, F.col("q")[0].alias("median_events" if c == "n" else "median_share")), by)
    return rounded(counts)


@query("d15_transition_matrix", 'SELECT "user", s, a, round(n::DOUBLE / sum(n) OVER (PARTITION BY "user", s), 6) AS p FROM (SELECT "user", action AS s, nxt AS a, count(*) AS n FROM (SELECT *, lead(action) OVER (PARTITION BY "user" ORDER BY ts, event_id) AS nxt FROM $EV) WHERE nxt IS NOT NULL GROUP BY ALL)')
def d15(spark, sf):
    return rounded(Q.transitions(events(spark, sf), ["user"], "action", "action"))


@query("d17_account_mean", 'SELECT source AS account, round(avg(toxic::DOUBLE), 6) AS score, count(*) AS posts FROM documents JOIN labels USING (doc_id) GROUP BY source')
def d17(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")
    return rounded(d.groupBy(F.col("source").alias("account")).agg(F.avg(F.col("toxic").cast("double")).alias("score"), F.count(F.lit(1)).alias("posts")))


VECTOR = "SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY ALL"


@query("d19_mean_vectors", f"WITH m AS ({VECTOR}) SELECT label, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) + 0.0 AS x FROM m")
def d19(spark, sf):
    v = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    m = v.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label")))
    return rounded(m.select("label", F.col("pos").cast("long").alias("pos"), (F.col("m") / norm).alias("x")), 5)


@query("d21_degenerate_columns", "SELECT feature, lo = hi AS degenerate FROM (SELECT unnest([{'feature': 'action', 'lo': min(action)::DOUBLE, 'hi': max(action)::DOUBLE}, {'feature': 'value', 'lo': min(value), 'hi': max(value)}, {'feature': 'zero', 'lo': min(0)::DOUBLE, 'hi': max(0)::DOUBLE}], recursive := true) FROM $EV)")
def d21(spark, sf):
    e = events(spark, sf).select(F.col("action").cast("double").alias("action"), "value", F.lit(0.0).alias("zero"))
    return P.degenerate(e, ["action", "value", "zero"])


# ---- filters and cohorts
@query("b1_coarse_action", "SELECT event_id, action FROM $EV")
def b1(spark, sf):
    return events(spark, sf).select("event_id", "action")


@query("b2_account_loader", 'SELECT "user", ts, action, event_id FROM $EV WHERE pop = \'op\' AND ts BETWEEN 1704153600 AND 1705968000 QUALIFY count(*) OVER (PARTITION BY "user") >= 20')
def b2(spark, sf):
    from .cohorts import load_accounts

    e = events(spark, sf)
    members = e.filter("pop = 'op'").select("user").distinct()
    return load_accounts(e, members, (1704153600, 1705968000), 20).select("user", "ts", "action", "event_id")


@query("b3_distinct_seconds", 'SELECT "user", ts FROM (SELECT DISTINCT "user", ts FROM $EV) QUALIFY count(*) OVER (PARTITION BY "user") >= 60')
def b3(spark, sf):
    from .cohorts import distinct_seconds

    return distinct_seconds(events(spark, sf), 60)


@query("b4_volume_cap", 'SELECT "user", count(*) AS n FROM $EV GROUP BY "user" HAVING count(*) BETWEEN 50 AND 70')
def b4(spark, sf):
    return events(spark, sf).groupBy("user").agg(F.count(F.lit(1)).alias("n")).filter("n between 50 and 70")


@query("b5_eligibility_funnel", 'SELECT pop, count(*) AS accounts, count_if(n >= 60)::BIGINT AS cohort_a, count_if(n >= 70)::BIGINT AS cohort_b FROM (SELECT pop, "user", count(DISTINCT ts) AS n FROM $EV GROUP BY ALL) GROUP BY pop')
def b5(spark, sf):
    n = events(spark, sf).select("pop", "user", "ts").distinct().groupBy("pop", "user").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("pop").agg(F.count(F.lit(1)).alias("accounts"), F.count_if(F.col("n") >= 60).alias("cohort_a"), F.count_if(F.col("n") >= 70).alias("cohort_b"))


@query("b6_keyword_category", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), 'password') THEN 'secret' WHEN contains(lower(text), 'http') THEN 'link' ELSE 'other' END AS category FROM documents")
def b6(spark, sf):
    t = F.lower("text")
    category = F.when(t.contains("license"), "legal").when(t.contains("password"), "secret").when(t.contains("http"), "link").otherwise("other")
    return table(spark, sf, "documents").select("doc_id", category.alias("category"))


@query("b7_regex_membership", "SELECT doc_id FROM documents WHERE regexp_matches(concat_ws(' ', source, text), '(?i)\\b(license|password|src3)\\b')")
def b7(spark, sf):
    return table(spark, sf, "documents").filter(F.concat_ws(" ", "source", "text").rlike(r"(?i)\b(license|password|src3)\b")).select("doc_id")


@query("b8_without_reposts", "SELECT doc_id, source FROM documents WHERE NOT regexp_matches(text, '^\\s*The ') QUALIFY count(*) OVER (PARTITION BY source) >= 3")
def b8(spark, sf):
    d = table(spark, sf, "documents").filter(~F.col("text").rlike(r"^\s*The ")).select("doc_id", "source")
    return d.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("source"))).filter("n >= 3").drop("n")


@query("b9_valid_text", "SELECT conv_id, turn FROM conversations WHERE length(text) >= 5 AND text NOT IN ('[deleted]', '[removed]')")
def b9(spark, sf):
    return table(spark, sf, "conversations").filter((F.length("text") >= 5) & ~F.col("text").isin("[deleted]", "[removed]")).select("conv_id", "turn")


@query("b10_first_n", 'SELECT "user", event_id FROM $EV QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY ts, event_id) <= 20')
def b10(spark, sf):
    e = events(spark, sf).withColumn("r", F.row_number().over(Q.order(["user"])))
    return e.filter("r <= 20").select("user", "event_id")


@query("b11_reservoir", 'SELECT "user", event_id FROM $EV QUALIFY row_number() OVER (PARTITION BY "user" ORDER BY md5(\'res|\' || event_id), event_id) <= 15')
def b11(spark, sf):
    return S.first_by_hash(events(spark, sf), ["user"], "event_id", "res", 15).select("user", "event_id")


@query("b12_class_sample", "WITH a AS (SELECT DISTINCT pop, \"user\" FROM $EV), n AS (SELECT count(*) AS n FROM a WHERE pop = 'op') SELECT pop, \"user\" FROM a, n WHERE pop = 'op' OR 1 = 1 QUALIFY pop = 'op' OR row_number() OVER (PARTITION BY pop ORDER BY md5('cls|' || \"user\"), \"user\") <= 2 * n.n")
def b12(spark, sf):
    a = events(spark, sf).select("pop", "user").distinct()
    n = a.filter("pop = 'op'").agg(F.count(F.lit(1)).alias("n"))
    r = numbered(a, ["pop"], [S.digest("cls", F.col("user")), F.col("user")], "r")
    return r.join(F.broadcast(n)).filter("pop = 'op' or r <= 2 * n").select("pop", "user")


@query("b13_tag_cohort", 'SELECT "user", count(*) AS posts, round(avg((k % 10 IN (1, 2))::INT::DOUBLE), 6) AS share FROM $EV GROUP BY "user" HAVING count(*) >= 50 AND avg((k % 10 IN (1, 2))::INT::DOUBLE) >= 0.1')
def b13(spark, sf):
    from ..functions.text import parse_list

    tags = parse_list(F.concat(F.lit("['t"), (F.col("k") % 10).cast("string"), F.lit("', 'x']")))
    hit = F.arrays_overlap(tags, F.array(F.lit("t1"), F.lit("t2"))).cast("double")
    g = events(spark, sf).groupBy("user").agg(F.count(F.lit(1)).alias("posts"), F.avg(hit).alias("share"))
    return rounded(g.filter("posts >= 50 and share >= 0.1"))


@query("b14_share_cohort", "SELECT source, round(avg((lang = 'en')::INT::DOUBLE), 6) AS share FROM documents GROUP BY source HAVING avg((lang = 'en')::INT::DOUBLE) >= 0.6")
def b14(spark, sf):
    return rounded(table(spark, sf, "documents").groupBy("source").agg(F.avg((F.col("lang") == "en").cast("double")).alias("share")).filter("share >= 0.6"))


@query("b15_metadata_groups", "SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'verified' WHEN n.n_name IN ('FRANCE', 'GERMANY') THEN 'listed' ELSE 'rest' END AS grp FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1995)")
def b15(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    early = table(spark, sf, "orders").filter(F.year("o_orderdate") == 1995).select(F.col("o_custkey").alias("c_custkey"))
    c = c.join(early, "c_custkey", "left_anti").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select("c_custkey", F.when(F.col("c_acctbal") >= 5000, "verified").when(F.col("n_name").isin("FRANCE", "GERMANY"), "listed").otherwise("rest").alias("grp"))


@query("b16_era_cells", f'SELECT era, "user", count(*) AS n FROM {ORDERS_SQL} GROUP BY ALL HAVING count(*) >= 5')
def b16(spark, sf):
    return orders(spark, sf).groupBy("era", "user").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query("b17_allow_list", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def b17(spark, sf):
    from .cohorts import allow_only

    return allow_only(events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_type", ["click", "view"])


# ---- joins and sets
ACC = 'SELECT "user", count(*) AS n, avg(value) AS mean_value FROM $EV GROUP BY "user"'


def accounts(spark, sf):
    return events(spark, sf).groupBy("user").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def shares(spark, sf):
    return events(spark, sf).groupBy("user").agg(F.avg((F.col("action") == 1).cast("double")).alias("share"))


SHARE = 'SELECT "user", avg((action = 1)::INT::DOUBLE) AS share FROM $EV GROUP BY "user"'


@query("c1_score_feature_join", f'SELECT "user", n, round(mean_value, 6) + 0.0 AS mean_value, round(share, 6) AS share FROM ({ACC}) JOIN ({SHARE}) USING ("user")')
def c1(spark, sf):
    return rounded(accounts(spark, sf).join(shares(spark, sf), "user"))


@query("c2_old_new_agreement", f'SELECT round(corr(a.n, b.n), 6) + 0.0 AS r_n, count(*) AS accounts FROM ({ACC}) a JOIN (SELECT "user", count(*) AS n FROM $EV WHERE event_id % 2 = 0 GROUP BY ALL) b USING ("user")')
def c2(spark, sf):
    from .cohorts import agreement

    old = accounts(spark, sf).select("user", "n")
    new = events(spark, sf).filter("event_id % 2 = 0").groupBy("user").agg(F.count(F.lit(1)).alias("n"))
    return rounded(agreement(old, new, "user", ["n"]))


@query("c3_folded_key_join", "SELECT c.c_name AS name, n.n_name AS nation FROM customer c JOIN nation n ON lower('K' || c.c_nationkey) = lower('k' || n.n_nationkey) WHERE c.c_acctbal IS NOT NULL")
def c3(spark, sf):
    c = table(spark, sf, "customer").withColumn("key", F.lower(F.concat(F.lit("K"), "c_nationkey")))
    n = table(spark, sf, "nation").withColumn("key", F.lower(F.concat(F.lit("k"), "n_nationkey")))
    return c.na.drop(subset=["c_acctbal"]).join(n, "key").select(F.col("c_name").alias("name"), F.col("n_name").alias("nation"))


@query("c4_default_join", "SELECT doc_id, coalesce(toxic, 0)::BIGINT AS toxic FROM documents LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)")
def c4(spark, sf):
    lab = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return table(spark, sf, "documents").select("doc_id").join(lab, "doc_id", "left").select("doc_id", F.coalesce("toxic", F.lit(0)).cast("long").alias("toxic"))


@query("c5_membership", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def c5(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("c6_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def c6(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


PAIR = 'SELECT a."user" AS a, b."user" AS b, count(*) AS common FROM (SELECT DISTINCT "user", k FROM $EV) a JOIN (SELECT DISTINCT "user", k FROM $EV) b USING (k) WHERE a."user" < b."user" GROUP BY ALL HAVING count(*) >= 38'


@query("c8_set_overlap", f'WITH d AS (SELECT "user", count(DISTINCT k) AS n FROM $EV GROUP BY "user") SELECT a, b, common, round(common::DOUBLE / (x.n + y.n - common), 6) AS jaccard FROM ({PAIR}) JOIN d x ON a = x."user" JOIN d y ON b = y."user"')
def c8(spark, sf):
    from ..operators.graph import overlap

    return rounded(overlap(events(spark, sf), "user", "k", 38))


VB = "greatest(0, least(24, floor((log10(greatest({}, 1)::DOUBLE) - 0.5) / 0.25 + 1)))::INT"


@query("c10_volume_match", f"""WITH v AS (SELECT c_custkey AS "user", c_nationkey = 7 AS pos, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    c AS (SELECT "user", {VB.format('n')} AS bin, row_number() OVER (PARTITION BY {VB.format('n')} ORDER BY "user") - 1 AS slot FROM v WHERE NOT pos), s AS (SELECT bin, count(*) AS size FROM c GROUP BY bin),
    sh AS (SELECT unnest(range(9)) AS rank, unnest([0, 1, -1, 2, -2, 3, -3, 4, -4]) AS shift),
    b AS (SELECT v."user" AS pos, s.bin, s.size FROM v, sh JOIN s ON s.bin = {VB.format('v.n')} + sh.shift WHERE v.pos QUALIFY row_number() OVER (PARTITION BY v."user" ORDER BY rank) = 1),
    d AS (SELECT b.bin, {DRAW_SQL.format("'vm|' || b.pos || '|' || i")} % b.size AS slot FROM b, range(5) t(i))
    SELECT DISTINCT c."user" FROM d JOIN c USING (bin, slot)""")
def c10(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user")).agg(F.count(F.lit(1)).alias("n"))
    v = table(spark, sf, "customer").select(F.col("c_custkey").alias("user"), "c_nationkey").join(o, "user", "left").na.fill(0, ["n"])
    return S.volume_matched(v.filter("c_nationkey = 7").select("user", "n"), v.filter("c_nationkey <> 7").select("user", "n"), "user", "n")


DEC = 'WITH v AS (SELECT pop, "user", count(*)::DOUBLE AS n FROM $EV GROUP BY ALL), e AS (SELECT quantile_cont(n, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM v), x AS (SELECT pop, "user", len(list_filter(q, lambda z: z <= n)) AS dec FROM v, e)'
MATCH = DEC + f""", c AS (SELECT "user", dec, row_number() OVER (PARTITION BY dec ORDER BY "user") - 1 AS slot, row_number() OVER (ORDER BY dec, "user") - 1 AS any_slot FROM x WHERE pop = 'organic'),
    s AS (SELECT dec, count(*) AS size FROM c GROUP BY dec), w AS (SELECT count(*) AS size FROM c),
    d AS (SELECT i AS set_id, x."user" AS member, x.dec, s.size AS own, w.size AS whole, {DRAW_SQL.format("'dec|' || i || '|' || x.\"user\"")} AS r FROM x LEFT JOIN s USING (dec), w, range(5) t(i) WHERE pop = 'op')
    SELECT d.set_id, d.member, c."user" AS control FROM d JOIN c ON CASE WHEN d.own IS NULL THEN c.any_slot = d.r % d.whole ELSE c.dec = d.dec AND c.slot = d.r % d.own END"""


@query("c11_decile_match", MATCH)
def c11(spark, sf):
    from .cohorts import decile_matched

    v = events(spark, sf).groupBy("pop", "user").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return decile_matched(v, "pop", "op", "organic", "user", "n", 5, "dec")


@query("c12_length_pairs", """WITH v AS (SELECT pop, "user", count(*) AS n FROM $EV GROUP BY ALL),
    r AS (SELECT i AS run, "user", n, (pop = 'op')::INT AS m, sum((pop <> 'op')::INT) OVER w AS c, sum((pop = 'op')::INT) OVER w AS s, row_number() OVER w AS t FROM v, range(3) t(i) WINDOW w AS (PARTITION BY i ORDER BY n DESC, (pop = 'op')::INT, md5(i || '|' || "user"), "user")),
    q AS (SELECT *, least(0, coalesce(min(c - s) OVER (PARTITION BY run ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM r),
    u AS (SELECT *, m = 1 AND c - s < low AS short, -least(low, c - s) AS without FROM q), e AS (SELECT run, max(s) - max(without) AS served FROM u GROUP BY run),
    k AS (SELECT u.*, CASE WHEN m = 0 THEN c WHEN short THEN served + without ELSE s - without END AS k FROM u JOIN e USING (run))
    SELECT a.run, a."user" AS member, b."user" AS control, least(a.n, b.n) AS length FROM k a JOIN k b ON a.run = b.run AND a.k = b.k AND a.m = 1 AND b.m = 0""")
def c12(spark, sf):
    from .cohorts import length_pairs

    v = events(spark, sf).groupBy("pop", "user").agg(F.count(F.lit(1)).alias("n"))
    return length_pairs(v, "pop", "op", "organic", "user", "n", 3)


@query("f2_top_values", "SELECT event_type, k, n FROM (SELECT event_type, k, count(*) AS n FROM $EV GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, k) <= 25")
def f2(spark, sf):
    c = events(spark, sf).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "k"))).filter("r <= 25").drop("r")


@query("f1_stable_order", 'SELECT "user", event_id, row_number() OVER (PARTITION BY "user" ORDER BY ts, event_id) - 1 AS pos FROM $EV')
def f1(spark, sf):
    return Q.positions(events(spark, sf), ["user"]).select("user", "event_id", F.col("pos").cast("long").alias("pos"))


@query("f4_union_populations", "SELECT pop, count(*) AS n FROM (SELECT 'X:op' AS pop FROM $EV WHERE pop = 'op' UNION ALL SELECT 'X:organic' FROM $EV WHERE pop = 'organic' UNION ALL SELECT 'O:orders' FROM orders) GROUP BY pop")
def f4(spark, sf):
    e = events(spark, sf)
    parts = [e.filter("pop = 'op'").select(F.lit("X:op").alias("pop")), e.filter("pop = 'organic'").select(F.lit("X:organic").alias("pop")), table(spark, sf, "orders").select(F.lit("O:orders").alias("pop"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("pop").agg(F.count(F.lit(1)).alias("n"))


@query("f5_set_operations", """WITH a AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE year(o_orderdate) = 1997)
    SELECT 'union' AS op, count(*) AS n FROM (SELECT c FROM a UNION SELECT c FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c FROM a INTERSECT SELECT c FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT c FROM a EXCEPT SELECT c FROM b)""")
def f5(spark, sf):
    a, b = (table(spark, sf, "orders").filter(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("c")).distinct() for y in (1996, 1997))
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.exceptAll(b)}
    counted = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("op"), "n") for k, d in ops.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("f6_distinct_seconds", 'SELECT DISTINCT "user", ts FROM $EV')
def f6(spark, sf):
    return events(spark, sf).select("user", "ts").dropDuplicates()
