"""Whitening, source divergence and quality rules against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import divergence, quality, whitening

# ---- whitening ----


def spectrum(kind, d, rng):
    return {
        "spread": lambda: rng.uniform(1, 100, d), "equal": lambda: np.repeat([5.0, 3.0], [d // 2, d - d // 2]), "close": lambda: 100 + 1e-9 * np.arange(d),
        "low rank": lambda: np.r_[[3.0, 2.0, 1.0], np.zeros(d - 3)], "steep": lambda: np.logspace(6, -4, d),
    }[kind]()


@pytest.mark.parametrize("kind", ["spread", "equal", "close", "low rank", "steep"])
@pytest.mark.parametrize("d", [3, 40])
def test_leading_eigenvalues(kind, d):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = spectrum(kind, d, rng)
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, vectors = whitening.leading(v, 16)
    scale = max(e)
    assert len(values) == min(16, d, int((e > scale * 1e-12).sum()))
    assert np.abs(values - np.sort(e)[::-1][: len(values)]).max() < 1e-12 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * scale


def test_inertia_counts_eigenvalues_above_a_shift():
    rng = np.random.default_rng(4)
    for d in (1, 2, 7, 30):
        a = rng.standard_normal((d, d))
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        for shift in [*rng.uniform(-8, 8, 20), -100.0, 100.0]:
            assert whitening.inertia(a, shift) == (e > shift).sum()
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # needs a pivot of two rows


def test_whitening_matches_a_plain_decomposition(spark):
    rng = np.random.default_rng(1)
    base = (rng.standard_normal((120, 20)) @ rng.standard_normal((20, 20))).round(3)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(base)] + [(500, base[3].tolist(), "copy"), (None, base[4].tolist(), None), (7, base[9].tolist(), None)]
    bad = [(900, None, "x"), (901, [None] * 20, "x"), (902, [*base[0][:19].tolist(), float("nan")], "x"), (903, [*base[0][:19].tolist(), float("-inf")], "x"), (904, [1.0, 2.0], "x"), (905, [], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, component string")
    got = whitening.whiten(df).collect()
    x = np.floor(64 * base).astype(np.int64) + 1_000_000
    n, total = len(np.unique(x, axis=0)), np.unique(x, axis=0).sum(axis=0)
    centred = np.unique(x, axis=0) - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == {*range(120), 500, None} and len(by[7]) == 32 and {len(v) for k, v in by.items() if k != 7} == {16}
    signs = None
    for i in [*range(7), *range(8, 120)]:
        r = sorted(by[i], key=lambda r: r.component)
        whole = [int(n * a - b) for a, b in zip(x[i], total, strict=True)]
        assert {q.deviation for q in r} == {sum(w * w for w in whole)} and {q.n for q in r} == {n}
        expected = (x[i] - total / n) @ vectors / np.sqrt(values)
        mine = np.array([q.whitened for q in r])
        signs = np.sign(mine * expected) if signs is None else signs
        assert np.abs(mine - signs * expected).max() < 1e-8
        assert np.abs(np.array([q.explained for q in r]) - values / np.trace(centred.T @ centred / n)).max() < 1e-12
    assert [r.whitened for r in by[500]] == [r.whitened for r in by[3]]
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_whitening_of_few_equal_and_large_vectors(spark):
    of = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(of([])).count() == 0
    assert whitening.whiten(of([(1, None)])).count() == 0
    assert whitening.whiten(of([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    two = whitening.whiten(of([(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert sorted(round(r.whitened, 9) for r in two) == [-1.0, 1.0] and {r.component for r in two} == {1}
    large = whitening.whiten(of([(1, [2.0**40, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 3.0]), (4, [2.0**46, 1.0])]), components=1).collect()
    assert {r.vec_id for r in large} == {1, 2, 3} and max(r.identity_error for r in large) < 1e-9
    x = [(64 * 2**40, 0), (0, 64), (0, 192)]
    total = [sum(c) for c in zip(*x, strict=True)]
    assert {r.vec_id: int(r.deviation) for r in large} == {i + 1: sum((3 * a - t) ** 2 for a, t in zip(v, total, strict=True)) for i, v in enumerate(x)}


# ---- source divergence ----


def brute_audit(rows, least=3, top=200):
    docs = [(r.lang or "", r.source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for d in mine for t in set(d[2])).items() if n >= least}
        counts = {}
        for _, s, terms in mine:
            counts.setdefault(s, Counter()).update(t for t in terms if t in kept)
        whole = sum(counts.values(), Counter())
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))  # noqa: E731, B023
        p = {s: {t: share(c[t], c.total()) for t in kept} for s, c in counts.items()}
        q = {t: share(whole[t], whole.total()) for t in kept}
        for s in counts:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            order = lambda x: (-x[0], x[1].encode())
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(sorted(pairs, key=order))]
            out += [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(sorted(terms, key=order)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("cells", "tile", "top"), [(1 << 18, 1024, 200), (40, 7, 3)])
def test_divergence_matches_brute_force(spark, messy, cells, tile, top):
    r = random.Random(2)
    words = ["straße", "Été", "don't", "a", "A", "x1y", "日本", "𝒳", *(f"w{chr(97 + i)}" for i in range(20))]
    extra = [(1000 + i, " ".join(r.choice(words) for _ in range(r.randint(0, 40))), r.choice(["en", "de", None]), r.choice(["s", "hot", None, "t"]), i, "k", 0.5, 1) for i in range(120)]
    lonely = [(2000, "only once", "xx", "one", 0, "k", 0.5, 1), (2001, "", "xx", "two", 0, "k", 0.5, 1), (2002, "...", "en", "no terms", 0, "k", 0.5, 1), (2003, "z z z", "yy", "alone", 0, "k", 0.5, 1)]
    docs = messy.unionByName(spark.createDataFrame(extra + lonely, messy.schema)).repartition(3)
    got = sorted(map(tuple, divergence.audit(docs, block_cells=cells, tile=tile, top_terms=top).collect()))
    assert got == brute_audit(docs.collect(), top=top)


def test_divergence_of_an_empty_table(empty):
    assert divergence.audit(empty).count() == 0


def test_joint_tables_are_those_of_the_terms():
    r = random.Random(8)
    counts = {f"t{i}": {s: r.randint(0, 4) for s in "abc" if r.random() < 0.8} for i in range(90)}
    expected = Counter((s, row.get(s, 0), o, row.get(o, 0)) for row in counts.values() for s in "abc" for o in "abc")
    for tile in (1, 4, 1024):
        assert divergence.joint_tables(counts, tile) == expected


# ---- quality rules ----


def plain_statistics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if times[x] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines)


TEXTS = [
    None, "", " \n\t ", "a", "a b", "a a a", "a a a a", "x y z x y z", "x y z q x y z", "a\na\n\n a\nb\na", "1 2 3\n1 2 3", "#*$ a%b &|<> $$", "é 日本 𝒳𝒳\x0bv w x", "one\r\ntwo\r\none\r\n",
    "p q r p q r s p q r p", "the the the end the the end the the",
]


def test_base_statistics_match_plain_python(spark, messy):
    r = random.Random(9)
    texts = TEXTS + [" ".join(r.choice("abc") for _ in range(r.randint(0, 30))) + r.choice(["", "\n", " # "]) for _ in range(200)] + [x.text for x in messy.collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in df.select("i", quality.base_statistics(df.t).alias("s")).collect():
        assert tuple(row.s) == plain_statistics(texts[row.i]), texts[row.i]


def plain_fit(z):
    """Concentration steps over rows in numpy: the same classes of distance, starts and target, another way round."""
    z, target = np.asarray(z, dtype=float) / quality.GRID, np.diag(np.square(quality.TOLERANCE))
    n, p = z.shape
    half = (n + p + 1) // 2
    low_median = lambda v: np.sort(v, axis=0)[(n + 1) // 2 - 1]
    centre = low_median(z)
    spread = low_median(np.abs(z - centre)) * 1.4826
    best = None
    for mean, scatter in ((z.mean(0), target + np.cov(z.T, bias=True)), (centre, target), (centre, target + np.diag(spread**2))):
        det = None
        for _ in range(60):
            far = np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(scatter), z - mean)
            classes = np.floor(quality.CLASSES * np.log2(1 + quality.GRID * far))
            inner = z[classes <= np.sort(classes)[half - 1]]
            mean, scatter = inner.mean(0), target + quality.CONSISTENCY * np.cov(inner.T, bias=True)
            before, det = det, np.linalg.slogdet(scatter)[1]
            if before is not None and abs(before - det) < 1e-9:
                break
        if best is None or round(det, 6) < best[0]:
            best = (round(det, 6), mean, scatter)
    return best[1], best[2]


@pytest.fixture(scope="module")
def graded(spark):
    """Documents of three groups, clean and with planted symbols, long words and repeats; small groups; nulls."""
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for i in range(420):
        size = {"en": 5, "de": 7, None: 4}[lang := r.choice(["en", "en", "de", None])]
        text = [word(max(1, int(r.gauss(size, 2)))) for _ in range(r.randint(30, 220))]
        kind = "clean"
        if i % 7 == 3:
            kind, text = "symbols", [w + "$$%" if r.random() < 0.6 else w for w in text]
        elif i % 29 == 1:
            kind, text = "long", [word(24) for _ in text]
        elif i % 41 == 2:
            kind, text = "repeats", text[:20] * 6
        rows.append((i, " ".join(text), lang, "hot" if i % 3 else "small" if i % 60 else "tiny", kind))
    rows += [(None, None, "en", "hot", "clean"), (1000, "", None, None, "clean"), (1001, " ".join(word(5) for _ in range(20_000)), "en", "hot", "clean"), (7, rows[7][1], rows[7][2], rows[7][3], "copy")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")


def test_quality_rules_match_numpy(graded):
    got = {(r.doc_id, r.n_words): r for r in quality.quality_rules(graded).collect()}
    rows = graded.collect()
    groups = {}
    for r in rows:
        n, chars, symbols, again, repeated, lines = plain_statistics(r.text)
        g = got[r.doc_id, n]
        failed = n < 50 or 100 * repeated > 50 * n
        assert (g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == (chars, symbols, again, repeated, failed)
        if not failed:
            z = [round(quality.GRID * v) for v in (math.log(chars / n), math.log1p(quality.SYMBOL_WEIGHT * symbols / n), again / max(lines, 1), repeated / n)]
            groups.setdefault((r.lang, r.source), []).append((r, g, z))
        else:
            assert not g.kept and g.distance is None
    small = {k: v for k, v in groups.items() if len(v) < quality.LEAST_ROWS}
    pools, left = {k: v for k, v in groups.items() if k not in small}, []
    for lang in {k[0] for k in small}:
        together = [x for k, v in small.items() if k[0] == lang for x in v]
        if len(together) >= quality.LEAST_ROWS:
            pools["pool", lang] = together
        else:
            left += together
    assert len(pools) >= 4 and left
    if len(left) >= quality.LEAST_ROWS:
        pools["all"] = left
    else:
        assert all(g.kept and g.distance is None for _, g, _ in left)
    for members in pools.values():
        mean, scatter = plain_fit([z for *_, z in members])
        for r, g, z in members:
            y = np.array(z) / quality.GRID - mean
            assert g.distance == pytest.approx(y @ np.linalg.inv(scatter) @ y, rel=1e-6, abs=1e-9)
            assert g.kept == (g.distance <= 23.5127)
            if r.kept == "symbols":
                assert not g.kept
            elif r.kept in ("clean", "copy"):
                assert g.kept


def test_drop_low_quality_keeps_columns_and_rows(graded, messy, empty):
    kept = quality.drop_low_quality(graded)
    assert kept.columns == graded.columns
    verdicts = [r for r in quality.quality_rules(graded).collect() if r.kept]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in verdicts)
    assert quality.quality_rules(messy).count() == messy.count()
    assert quality.quality_rules(empty).count() == 0 and quality.drop_low_quality(empty).count() == 0


def test_chi_square():
    assert quality.chi_square_quantile(0.95, 4) == pytest.approx(9.487729, abs=1e-5)
    assert quality.chi_square_quantile(0.9999, 4) == pytest.approx(23.5127, abs=1e-3)


def test_quality_runs_no_python_worker(graded):
    plan = quality.quality_rules(graded)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_settled_estimates_of_quality_meet_no_further_steps(spark, monkeypatch):
    from tidemark.llm import quality as Q

    met, step = [], Q._step
    monkeypatch.setattr(Q, "_step", lambda cells, found: met.append(found.count()) or step(cells, found))
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    Q.fit(Q.statistics(d, "doc_id", "text", "lang", "source").cache())
    assert met[-1] < met[0] and sum(met) < met[0] * len(met) and len(met) < Q.STEPS
