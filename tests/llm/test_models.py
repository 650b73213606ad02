"""Language ID, toxicity and URL filter: held-out accuracy and edge cases."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, toxicity, url_filter
from tidemark.llm.queries import QUERIES, URL_RULES

SF = "/root/testdata/sf0.01"


def test_language_id_held_out(spark):
    got = QUERIES["op4_kneser_ney_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    r = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.sum(F.col("rejected").cast("int")).alias("x"), F.min("score"), F.max("score")).first()
    assert r.a > 0.97 and r.x == 0 and 0 <= r[2] <= r[3] <= 1


def test_language_id_edges(messy, empty, spark):
    model = langid.fit(messy)
    assert model.languages == ["de", "en"]
    got = {(r.n_chars): r for r in langid.identify(messy, model).collect()}
    assert len(got) == messy.count()
    for r in got.values():
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in model.languages and 0 < r.score <= 1
    assert langid.identify(empty, model).count() == 0
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(messy, none).collect()} == {"und"}


def test_unknown_script_is_rejected_and_known_texts_are_not(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(1, "Η γρήγορη αλεπού πηδάει πάνω από το τεμπέλικο σκυλί " * 4), (2, "быстрая лиса прыгает через ленивую собаку " * 4)], "doc_id long, text string")
    assert {r.rejected for r in langid.identify(odd, model).collect()} == {True}
    assert langid.identify(docs, model).filter("rejected").count() == 0


def test_kneser_ney_is_a_distribution():
    """The probabilities of all seen continuations and the unseen rest sum to one."""
    import numpy as np
    import pyarrow as pa

    text = "\0\0abracadabra\0"
    grams = [text[i : i + 3] for i in range(len(text) - 2)]
    counts = pa.table({"lang": ["x"] * len(set(grams)), "gram": sorted(set(grams)), "n": [grams.count(g) for g in sorted(set(grams))]})
    m = langid._model(counts, 3)
    from tidemark.llm.chars import Stream

    total = 0.0
    for c in [chr(i) for i in range(97, 123)]:
        s = Stream(["abra"[:2] + c], 3)
        total += float(np.exp(m.log_probabilities(s)[2, 0]))
    s = Stream(["ab"], 3)
    total += float(np.exp(m.log_probabilities(s)[2, 0]))  # the end of the word
    rest = float(np.exp(m.log_probabilities(Stream(["ab\u0436"], 3))[2, 0])) * (langid.CODE_POINTS - 27)
    assert total + rest == pytest.approx(1.0, abs=1e-4)


def test_kneser_ney_equals_plain_python():
    """Two languages of unlike size against the textbook recursion over dictionaries."""
    import math
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    order, texts = 3, {"a": "the cat sat on the mat and the dog sat on the cat", "b": "la casa"}
    pad = lambda t: "\0" * (order - 1) + "".join(c if c.isalpha() else "\0" for c in t) + "\0"
    rows = [(x, g, n) for x, t in texts.items() for g, n in Counter(pad(t)[i : i + order] for i in range(len(t) + 1)).items()]
    model = langid._model(pa.table({"lang": [r[0] for r in rows], "gram": [r[1] for r in rows], "n": [r[2] for r in rows]}), order)

    def logp(lang, context, char):
        levels = [Counter({g: n for x, g, n in rows if x == lang})]
        for _ in range(order - 1):
            levels.append(Counter(g[1:] for g in levels[-1]))  # distinct left extensions
        p = 1 / langid.CODE_POINTS
        for n in range(1, order + 1):
            counts = levels[order - n]
            once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
            d = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
            h = context[len(context) - n + 1 :]
            seen = {g: c for g, c in counts.items() if g[:-1] == h}
            if seen:
                total = sum(seen.values())
                p = max(seen.get(h + char, 0) - d, 0) / total + d * len(seen) / total * p
        return math.log(p)

    for text in ("the cat", "casa la zoo", "dog"):
        entropy, n = model.cross_entropies([text])
        s = pad(text)
        for j, lang in enumerate(model.languages):
            expected = -sum(logp(lang, s[i - 2 : i], s[i]) for i in range(2, len(s))) / n[0]
            assert entropy[0, j] == pytest.approx(expected, rel=1e-4)


def test_url_filter_on_hosts_that_no_label_has(spark):
    """Hosts are split by hash: the trees learn the form of a URL, not its host."""
    from tidemark.llm.queries import weak_url_labels

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    side = F.pmod(F.xxhash64(url_filter.host_of(F.col("url"))), F.lit(3)) == 0
    model = url_filter.fit(weak_url_labels(pages.filter(~side)))
    truth = weak_url_labels(pages.filter(side)).withColumnRenamed("label", "truth").distinct()
    got = url_filter.judge(pages.filter(side), model, []).join(truth, "url").select("truth", (F.col("verdict") == "block").cast("int").alias("blocked")).collect()
    assert got and sum(r.truth == r.blocked for r in got) / len(got) > 0.9


def test_toxicity_held_out(spark):
    got = QUERIES["op2_nb_char_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out")
    r = got.agg(F.avg((F.col("toxic") == F.col("predicted")).cast("double")).alias("a"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert r.a > 0.85 and 0 <= r.lo <= r.hi <= 1


def test_toxicity_edges(spark, messy, empty):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(100, 140)] + [(None, 1), (101, None), (102, 7)], "doc_id long, toxic int")
    model = toxicity.fit(messy, labels)
    got = toxicity.score(messy, model)
    assert got.count() == messy.count() and got.filter("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty, model).count() == 0
    one = toxicity.fit(messy, labels.filter("toxic = 1"))
    assert toxicity.score(messy, one).filter("predicted = 0").count() == 0
    none = toxicity.fit(empty, labels)
    assert {r.score for r in toxicity.score(messy, none).collect()} == {0.5}


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, None)


def test_url_filter_against_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "https://x.example.net/en/1?q#f", "http://example.com/de/", "http://notexample.com/de/x", "http://b.org/fr/", "http://B.ORG/FR/", "http://u@h.net:80/p?x=://y", "a://b://c.net/"]
    odd = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labelled = spark.createDataFrame([(f"http://good{i}.com/a{i}", 0) for i in range(60)] + [(f"http://win-cash-{i}9{i}.biz/x?a=1&b=2", 1) for i in range(60)] + [(None, 1), ("http://z", None)], "url string, label int")
    model = url_filter.fit(labelled)
    for r in url_filter.judge(odd, model, URL_RULES).collect():
        host, path, rule, verdict = brute_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.unwanted >= 0.5 else "allow"))
    fresh = spark.createDataFrame([("http://good999.com/a5",), ("http://win-cash-797.biz/x?a=1&b=2",)], "url string")
    assert [r.verdict for r in url_filter.judge(fresh, model, []).collect()] == ["allow", "block"]
    assert url_filter.judge(odd.filter("false"), model, URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(fresh, url_filter.fit(labelled.filter("false")), []).collect()} == {"allow"}


def plain_buckets(text):
    """Buckets of a text's character n-grams in plain Python: letters in lower case, a run of anything else one 0."""
    from tidemark.llm.chars import PLACES

    longest, code = max(toxicity.ORDERS), []
    for c in (text or "").lower() + "\n":
        if c.isalpha():
            code.append(ord(c))
        elif not code or code[-1] != 0:
            code.append(0)
    if code[0] == 0:
        scored = range(1, len(code))  # what leads a text is no place of its own
    else:
        scored = range(len(code))
    lead = [0] * (longest - 1)
    code = lead + code if code[0] != 0 else lead + code[1:]
    out = set()
    for i in range(longest - 1, len(code)):
        for n in toxicity.ORDERS:
            h = sum(code[i - k] * int(PLACES[k]) for k in range(n)) % (1 << 64)
            out.add(((h * 0xD6E8FEB86659FD93) % (1 << 64)) >> (64 - toxicity.HASH_BITS))
    return out if len(scored) else set()


def test_toxicity_matches_plain_python(spark):
    """Features, log-count ratios, the fit's optimum and the scores, recomputed for every text."""
    import math
    import random

    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    words = [word() for _ in range(60)]
    rows = []
    for i in range(300):
        y = int(r.random() < 0.3)
        text = [r.choice(words[: 40 if y else 60]) for _ in range(r.randint(3, 25))] + (["blight"] if y and r.random() < 0.8 else [])
        r.shuffle(text)
        rows.append((i, r.choice([" ", "  ", ", ", "\n"]).join(text).title(), y))
    docs, labels = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, features=200)
    found = {i: plain_buckets(t) for i, t, _ in rows}
    ones, zeros = sum(y for *_, y in rows), sum(1 - y for *_, y in rows)
    count = {b: [sum(b in found[i] and y == k for i, _, y in rows) for k in (0, 1)] for b in model.buckets.tolist()}
    assert len(model.buckets) == 200 and all(sum(c) >= toxicity.MIN_TEXTS for c in count.values())
    ratio = {b: math.log(((c[1] + 1) / (ones + 2)) / ((c[0] + 1) / (zeros + 2))) for b, c in count.items()}
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
    p = {i: 1 / (1 + math.exp(-model.intercept - sum(w for b, w in weight.items() if b in found[i]))) for i, *_ in rows}
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert got == pytest.approx(p, rel=1e-9)
    # the penalised loss is flat in every scaled feature: its slope is that of the loss plus the penalty's
    for b, w in weight.items():
        if abs(ratio[b]) > 0.05:
            slope = sum((p[i] - y) * ratio[b] for i, _, y in rows if b in found[i]) / len(rows) + toxicity.PENALTY * w / ratio[b]
            assert abs(slope) < 2e-3
    assert abs(sum(p[i] - y for i, _, y in rows) / len(rows)) < 2e-3


def test_url_filter_counts_and_bins_every_labelled_url(spark):
    from math import log1p

    n = 9001
    d = spark.range(n).select(F.concat(F.lit("http://h"), (F.col("id") % 5).cast("string"), F.lit(".example.com/"), F.col("id").cast("string")).alias("url"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    model = url_filter.fit(d)
    bad = (n + 4) // 5
    assert model.base_rate == bad / n
    rate, weight = model.suffixes["example.com"]
    assert rate == pytest.approx((bad + 20 * bad / n) / (n + 20)) and weight == pytest.approx(log1p(n))
    chars = sorted(len(f"http://h0.example.com/{i}") for i in range(n))
    assert model.bins[url_filter.FEATURES.index("url_chars")] == sorted({float(c) for c in chars})  # also the ten shortest
