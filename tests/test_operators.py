"""Hand vectors, invariants and plan shapes."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import evaluate as V
from tidemark.operators import graph as N
from tidemark.operators import profile as P
from tidemark.operators import sampling as S
from tidemark.operators import sequences as Q
from tidemark.operators.ranks import cumulative, midranks
from tidemark.plans.base import events
from tidemark.sources import readers as A

SF = "/root/testdata/sf0.001"


def test_completed_minutes_and_bounds(spark):
    e = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 30, 90, 209, 329])], "user long, ts long, event_id long")
    assert [r.completed for r in Q.gaps(e, ["user"]).orderBy("event_id").collect()] == [0, 0, 1, 1, 2]
    d = spark.createDataFrame([(u, t, u) for u, m in enumerate([0, 1, 2, 10]) for t in (0, 60 * m)], "user long, ts long, event_id long").withColumn("event_id", F.col("ts"))
    rows = {(r.user, r.ts): r for r in Q.gaps(d, ["user"]).collect() if r.ts or r.user}
    got = [(rows[u, 60 * m].lo, rows[u, 60 * m].hi) for u, m in ((1, 1), (2, 2), (3, 10))]
    assert got == [(1e-3, 2.0), (1.0, 3.0), (9.0, 11.0)]


def test_midranks(spark):
    d = spark.createDataFrame([(x,) for x in (3, 1, 1, 5)], "x int")
    assert {r.x: r.midrank for r in midranks(d, [], "x").collect()} == {3: 3.0, 1: 1.5, 5: 4.0}


@pytest.mark.parametrize("n", [1, 7])
def test_cumulative_does_not_depend_on_the_layout(spark, n):
    d = spark.range(200).select((F.col("id") * 37 % 50).alias("v"), (F.col("id") % 3).alias("k"), F.lit(2).alias("w"))
    got = sorted(map(tuple, cumulative(d, ["k"], "v", ["w"], n).collect()))
    rows = d.collect()
    assert got == sorted((r.v, r.k, r.w, sum(2 for s in rows if s.k == r.k and s.v < r.v)) for r in rows)


def test_auc_of_the_negated_score(spark):
    s = events(spark, SF).groupBy("user", "pop").agg(F.avg("value").alias("score")).withColumn("y", (F.col("pop") == "op").cast("int"))
    a = V.auc(s, []).first().auc
    b = V.auc(s.withColumn("score", -F.col("score")), []).first().auc
    assert a + b == pytest.approx(1.0)


def test_profile_needs_one_shuffle_and_its_shares_sum_to_one(spark):
    p = P.profile(events(spark, SF), ["user"])
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    hours = sum(F.col(f"hour_{h}") for h in range(24))
    assert p.filter(F.abs(hours - 1) > 1e-9).count() == 0


def test_folds_and_holdout(spark):
    a = spark.range(53).select(F.col("id").alias("user"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    counts = S.folds(a, "y", "user", 5, 2).groupBy("repeat", "y", "fold").count().groupBy("repeat", "y").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r.d <= 1 for r in counts.collect())
    assert S.holdout(a, "y", "user", "s").filter("split = 'test'").groupBy("y").count().orderBy("y").collect()[1]["count"] == 4  # bround(4.2)


def test_draws_do_not_depend_on_partitions(spark):
    a = spark.range(100).select(F.col("id").alias("user"), (F.col("id") % 2).cast("int").alias("y"))
    one = V.bootstrap_weights(a.repartition(1), "user", "y", 5, "t")
    many = V.bootstrap_weights(a.repartition(9), "user", "y", 5, "t")
    assert sorted(one.collect()) == sorted(many.collect())
    assert {r.s for r in one.groupBy("b").agg(F.sum("w").alias("s")).collect()} == {100}


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.component) for r in N.components(e).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_volume_bins(spark):
    v = spark.createDataFrame([(x,) for x in (0, 1, 3, 4, 10, 10**7)], "v long")
    assert [r[0] for r in v.select(S.volume_bin(F.col("v"))).collect()] == [0, 0, 0, 1, 3, 24]


def test_text_functions(spark):
    d = spark.createDataFrame([("See https://www.Ex.org:80/a?b it's THE cats",)], "t string")
    r = d.select(X.urls_of(F.col("t"))[0], X.domain_of(X.urls_of(F.col("t"))[0]), X.tokens(F.col("t")), X.bigrams(X.tokens(F.col("t"))), X.parse_list(F.lit("['A', 'b']"))).first()
    assert list(r) == ["https://www.Ex.org:80/a?b", "ex.org:80", ["see", "it's", "cats"], ["see it's", "it's cats"], ["a", "b"]]


def test_archive_reader_repairs_and_prefers_replies(spark, tmp_path):
    head = "user_screen_name,tweet_time,tweet_text,hashtags,urls,is_retweet,in_reply_to_tweetid,quoted_tweet_tweetid\n"
    rows = ['AbC,2017-03-01 14:05,"a, ""b""",[],[],true,12,', "abc,2017-03-01 14:06,x,[],[],true,,", "abc,2017-03-01 14:07,x,[],[],false,,9", "abc,no time,x,[],[],false,,", "abc,2017-03-01 14:08,x,[],[],false,,"]
    (tmp_path / "a.csv").write_text(head + "\n".join(rows) + "\n")
    got = A.read_archive(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.user, r.action) for r in got] == [("abc", 1), ("abc", 2), ("abc", 2), ("abc", 0)]


def test_timelines_skip_corrupt_lines(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"user":{"id_str":"7"},"text":"hello","created_at":"Wed Mar 01 14:05:00 +0000 2017","entities":{"urls":[{"expanded_url":"http://x.org"}]}}\n{bad\n{"text":"hello"}\n{"user":{"id_str":"7"},"text":"hi","created_at":"Wed Mar 01 14:05:00 +0000 2017"}\n')
    got = A.read_timelines(spark, str(tmp_path)).collect()
    assert [(r.user, r.ts, r.urls, r.is_reply) for r in got] == [("7", 1488377100, ["http://x.org"], 0)]


def test_sequence_reader(spark, tmp_path):
    (tmp_path / "s.csv").write_text("user,ts,action\n01,-5,0\n01,1969-12-31T00:00:00,1\n01,2017-03-01 00:00:00,2\n01,junk,0\n")
    assert sorted(r.ts for r in A.read_sequences(spark, str(tmp_path)).collect()) == [-5, 1488326400]


HEAD = "user_screen_name,tweet_time,tweet_text,hashtags,urls,is_retweet,in_reply_to_tweetid,quoted_tweet_tweetid".split(",")


def test_archives_are_read_by_header(spark, tmp_path):
    """Further, reordered and missing columns, a quoted line break, a folder with several headers, an absent one."""
    row = {"user_screen_name": "Abc", "tweet_time": "2017-03-01 14:05", "tweet_text": '"two\nlines, ""x"""', "hashtags": "[]", "urls": "[]", "is_retweet": "true"}
    for name, head in {"a": ["tweetid", *HEAD, "like_count"], "b": HEAD[::-1], "c": [h for h in HEAD if h != "quoted_tweet_tweetid"], "d e": HEAD}.items():
        (tmp_path / f"{name}.csv").write_text(",".join(head) + "\n" + ",".join(row.get(h, "") for h in head) + "\n")
    got = A.read_archive(spark, str(tmp_path)).collect()
    assert [(r.user, r.ts, r.action) for r in got] == [("abc", 1488377100, 2)] * 4
    assert {r.text for r in A.read_posts(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/none.csv"], spark.createDataFrame([("abc",)], "user string")).collect()} == {'two\nlines, "x"'}
    assert A.read_archive(spark, f"{tmp_path}/absent").count() == 0


def test_folders_and_sequences_are_read_by_header(spark, tmp_path):
    schema = "created_utc long, link_id string, body string"
    for name, text in {"Ann": "body,created_utc\nhi,5\n", "bob": "created_utc,link_id,body,x\n7,l1,yo,1\nbad,l2,z,2\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "c.csv").write_text(text)
    (tmp_path / "carl").mkdir()
    got = A.read_folders(spark, f"{tmp_path}/*/c.csv", schema).collect()
    assert sorted((r.user, r.created_utc or 0, r.link_id or "", r.body) for r in got) == [("ann", 5, "", "hi"), ("bob", 0, "l2", "z"), ("bob", 7, "l1", "yo")]
    assert A.read_folders(spark, f"{tmp_path}/*/none.csv", schema).count() == 0
    (tmp_path / "s.csv").write_text("action,extra,user,ts\n1,x,007,1488377100\n2,x,007,2017-03-01T14:05:00\n")
    assert sorted((r.user, r.ts, r.action) for r in A.read_sequences(spark, f"{tmp_path}/s.csv").collect()) == [("007", 1488377100, 1), ("007", 1488377100, 2)]


def test_overlap_meets_every_pair_with_enough_in_common(spark):
    import random

    r = random.Random(6)
    sets = {n: {r.choice(range(40)) if r.random() < 0.5 else 1000 + r.randrange(6) for _ in range(r.randint(1, 30))} for n in range(80)}
    d = spark.createDataFrame([(n, i) for n, s in sets.items() for i in s] + [(5, None), (3, next(iter(sets[3])))], "n long, i long")
    for least in (1, 4, 9):
        expected = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}
        got = {(x.a, x.b): (x.common, x.jaccard) for x in N.overlap(d, "n", "i", least).collect()}
        assert {k: v[0] for k, v in got.items()} == expected
        assert all(v[1] == pytest.approx(len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for (a, b), v in got.items())


@pytest.mark.parametrize("kind", ["long", "string"])
def test_blocks_of_sets_find_every_pair_and_every_component(spark, kind):
    import random

    r = random.Random(7)
    sets = {n: {r.randrange(700 if n % 2 else 30) for _ in range(r.randint(1, 25))} for n in range(90)}
    sets |= {n: sets[4] for n in range(90, 99)}  # copies
    d = spark.createDataFrame([(n, i) for n, s in sets.items() for i in s] + [(5, None), (None, 3)], "n long, i long").select(F.col("n").cast(kind).alias("n"), "i")
    name = int if kind == "long" else str
    for least in (1, 12):
        pairs = {tuple(sorted((name(a), name(b)))): len(sets[a] & sets[b]) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least}
        for blocks, block in ((True, 1000), (True, 20)) if least > 1 else ((True, 60), (False, 60)):
            got = N.overlap(d, "n", "i", least, blocks=blocks, block=block, strip=7).collect()
            assert {(x.a, x.b): x.common for x in got} == pairs and len(got) == len(pairs)
    links = N.overlap_links(d, "n", "i", 12, blocks=True, block=20, strip=7)
    every = spark.createDataFrame(list(pairs), f"a {kind}, b {kind}")
    assert sorted(map(tuple, N.components(links).collect())) == sorted(map(tuple, N.components(every).collect()))


def test_sets_that_nearly_all_meet_are_compared_in_blocks(spark):
    d = spark.range(400).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("i")).filter(F.xxhash64("n", "i") % 2 == 0)
    plan = N.overlap(d, "n", "i", 14)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan  # an index would list nearly all 80,000 pairs with both sets


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_do_not_depend_on_the_layout(spark, parts):
    from tidemark.operators.ranks import numbered

    d = spark.range(100).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 37 % 101).alias("v"))
    got = {(r.k, r.v): r.no for r in numbered(d, ["k"], [-F.col("v")], "no", parts).collect()}
    rows = d.collect()
    assert got == {(r.k, r.v): 1 + sum(s.k == r.k and s.v > r.v for s in rows) for r in rows}
    assert sorted(r.no for r in numbered(d, [], [F.col("v")], "no", parts).collect()) == list(range(1, 101))


@pytest.mark.parametrize("parts", [1, 7])
def test_null_keys_and_values_lose_no_row(spark, parts):
    """Null keys, null values and NaN in numbers, sums and midranks."""
    from tidemark.operators.ranks import numbered

    nan = float("nan")
    rows = [(None if i % 3 == 0 else f"k{i % 3}", None if i % 5 == 0 else nan if i % 7 == 0 else float(i % 11), i) for i in range(60)]
    d = spark.createDataFrame(rows, "k string, v double, id long")
    order = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    got = {r.id: r.no for r in numbered(d, ["k"], [F.col("v"), F.col("id")], "no", parts).collect()}
    assert got == {i: 1 + sum(k == k2 and (order(v2), j) < (order(v), i) for k2, v2, j in rows) for k, v, i in rows}
    low = {r.id: r.below_id for r in cumulative(d, ["k"], "v", ["id"], parts).collect()}
    assert low == {i: sum(j for k2, v2, j in rows if k == k2 and order(v2) < order(v)) for k, v, i in rows}
    assert sum(r.ties for r in midranks(d, ["k"], "v").collect()) == 60


def test_null_populations_are_split_matched_and_scored(spark):
    a = spark.createDataFrame([(i, None if i % 2 else "p", 1 + i % 9) for i in range(40)], "user long, pop string, volume long")
    split = S.holdout(a, "pop", "user", "s").groupBy("pop", "split").count().collect()
    assert {(r.pop, r.split): r["count"] for r in split} == {(p, s): n for p in (None, "p") for s, n in (("test", 6), ("train", 14))}
    assert S.folds(a, "pop", "user", 5, 2).groupBy("repeat", "pop", "fold").count().filter("count <> 4").count() == 0
    b = a.withColumn("volume", F.when(F.col("user") % 4 > 0, F.col("volume")))
    matched = S.volume_matched(b.filter("user < 8"), b.filter("user >= 8"), "user", "volume")
    assert matched.count() > 0 and matched.filter("user < 8 or user is null").count() == 0
    w = V.bootstrap_weights(a.withColumn("y", F.col("user").isNotNull().cast("int")), "user", "y", 3, "t")
    assert {r.s for r in w.groupBy("b").agg(F.sum("w").alias("s")).collect()} == {40}


@pytest.mark.parametrize("kind", ["string", "negative", "huge"])
def test_components_of_any_id(spark, kind):
    name = {"string": lambda i: f"n{i:03d}", "negative": lambda i: -1000 + i, "huge": lambda i: 9_000_000_000_000_000_000 + i}[kind]
    links = [(i, i + 1) for i in range(30)] + [(40, 41), (42, 41), (50, 50), (3, 3)]
    e = spark.createDataFrame([(name(a), name(b)) for a, b in links] + [(None, name(1)), (name(60), None)], f"a {'string' if kind == 'string' else 'long'}, b {'string' if kind == 'string' else 'long'}")
    expected = {(name(i), name(0)) for i in range(31)} | {(name(i), name(40)) for i in (40, 41, 42)} | {(name(50), name(50))}
    assert {(r.node, r.component) for r in N.components(e).collect()} == expected


def test_components_of_a_large_star_and_a_long_chain(spark):
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert [(r.component, r["count"]) for r in N.components(star).groupBy("component").count().collect()] == [(0, 100_001)]
    chain = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert [(r.component, r["count"]) for r in N.components(chain).groupBy("component").count().collect()] == [(0, 10_001)]


def test_lanes_bound_the_rows_of_a_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, F.lit("hub")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.max("id").alias("most"), F.count(F.lit(1)).alias("edges"))
    got = N.with_lanes(rows, facts, "k", "id", 100)
    assert sorted(map(tuple, got.select("k", "id", "most").collect())) == sorted(map(tuple, rows.join(facts, "k").select("k", "id", "most").collect()))
    lanes = rows.filter("k = 'hub'").groupBy(F.pmod(F.xxhash64("id"), F.lit(40))).count()
    assert lanes.agg(F.max("count")).first()[0] < 200
    assert "_lane" in got._jdf.queryExecution().optimizedPlan().toString()


def test_picks_stream_past_a_hash_table_and_tasks_keep_their_size(spark):
    from tidemark.session import ROWS_A_TASK, spread

    a = spark.range(60).select(F.col("id").alias("user"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 7 / 7.0).alias("score"))
    picks, slots = V.bootstrap_picks(a, "user", "y", 5, "t")
    plan = V.picked(picks, slots, ["y", "slot"], 0)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    by_weights = V.auc(a.join(V.bootstrap_weights(a, "user", "y", 5, "t"), "user"), ["b"], weight=F.col("w"))
    assert sorted(V.bootstrap_auc(a, [], "user", 5, "t").collect()) == sorted(by_weights.collect())
    assert spread(a, 60, "user").rdd.getNumPartitions() == 4 and spread(a, 9 * ROWS_A_TASK, "user").rdd.getNumPartitions() == 9


def test_all_tasks_draw_the_picks_of_a_median_and_once(spark, monkeypatch):
    from tidemark.operators.quantiles import of_counts
    from tidemark.plans.registry import QUERIES

    seen, plain = {}, V.picked
    monkeypatch.setattr(V, "picked", lambda picks, *rest: seen.setdefault("found", plain(seen.setdefault("picks", picks), *rest)))
    for place in ("tidemark.operators.evaluate.of_counts", "tidemark.plans.scores.of_counts"):
        monkeypatch.setattr(place, lambda counts, *rest: of_counts(seen.setdefault("counts", counts), *rest), raising=False)
    QUERIES["g4_bootstrap_median"](spark, SF)
    by_task = seen["picks"].groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(by_task) >= 4 and max(r["count"] for r in by_task) <= 2 * min(r["count"] for r in by_task)
    assert sum(r["count"] for r in by_task) == 2000 * 15
    assert "Join" not in seen["counts"]._jdf.queryExecution().optimizedPlan().toString()  # kept, so what ranks and sums them does not draw again


def test_draws_along_numbers_equal_those_of_rows(spark):
    import hashlib

    for start in ("", "a", "ab|", "med|", "med|7|", "é|", "x" * 36):
        for first, end in ((0, 1200), (99_990, 100_010), (7, 7), (2**40, 2**40 + 5), (10**18 - 3, 10**18 + 3)):
            assert S.draws_along(start, first, end).tolist() == [int(hashlib.md5(f"{start}{i}".encode()).hexdigest()[:8], 16) for i in range(first, end)]
    rows = spark.range(95, 105).select(S.draw("med", F.lit(3), F.col("id")).alias("d")).collect()
    assert S.draws_along("med|3|", 95, 105).tolist() == [r.d for r in rows]
    with pytest.raises(ValueError):
        S.draws_along("x" * 37, 0, 1)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_bootstrap_median_of_hashed_picks(spark, monkeypatch, most):
    import statistics

    plain = V.picked
    monkeypatch.setattr(V, "picked", lambda picks, facts, on: plain(picks, facts, on, most))
    rows = [(u, None if u % 4 == 0 else float(u * 7 % 11)) for u in range(30)]
    for some in (rows, [(1, None), (2, None)], []):
        d = spark.createDataFrame(some, "user long, score double").repartition(5)
        got = {r.b: r.m for r in V.bootstrap_median(d, "user", "score", 9, "t").collect()}
        want = {}
        for b in range(9 if some else 0):
            x = [some[p][1] for p in (S.draws_along(f"t|{b}|", 0, len(some)) % len(some)).tolist()]
            if x := [v for v in x if v is not None]:
                want[b] = statistics.median(x)
        assert got == want
