"""Exact and near duplicates against brute force."""

import hashlib
import re

import numpy as np
import pytest

from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.graph import components
from tidemark.llm.minhash import drop_near_duplicates, near_duplicates, shingle_sets, signature


def test_exact_dedup_matches_brute_force(messy):
    got = exact_dedup(messy).collect()
    rows = messy.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.text or "", []).append(r.doc_id)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = sorted((str(r.doc_id), str(best[r.text or ""]), len(groups[r.text or ""]), r.doc_id == best[r.text or ""], hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == expected


def test_exact_dedup_with_a_filter_that_is_far_too_small(messy):
    whole = exact_dedup(messy).select("doc_id", "keep_id", "group_size").collect()
    tiny = exact_dedup(messy, bits_per_row=1, max_filter_bytes=8192, workers=1).select("doc_id", "keep_id", "group_size").collect()
    assert sorted(map(str, whole)) == sorted(map(str, tiny))


def test_empty_tables(empty):
    assert exact_dedup(empty).count() == 0
    assert near_duplicates(empty).count() == 0


def brute(rows, words, threshold):
    """Component of each id over all pairs."""
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        s = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets.setdefault(r.doc_id, []).append(s)
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and 100 * len(x & y) >= threshold * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return sets, {i: root(i) for i in ids}


@pytest.mark.parametrize(("width", "threshold", "block"), [(3, 85, 300_000), (5, 80, 300_000), (3, 85, 40)])
def test_near_duplicates_match_brute_force(messy, width, threshold, block):
    sets, component = brute(messy.collect(), width, threshold)
    single = messy.filter("doc_id is null or doc_id <> 10")  # an id of two texts shares both texts' fate
    for r in near_duplicates(single, words=width, threshold=threshold, block_shingles=block).collect():
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (component[r.doc_id], r.doc_id == component[r.doc_id])
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def test_blocks_of_a_large_cluster_lose_no_link(spark):
    """A chain: each text shares most words with the next, the ends share nothing."""
    rows = [(i, " ".join(f"w{k}" for k in range(4 * i, 4 * i + 80))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (300_000, 500):
        assert {r.component_id for r in near_duplicates(docs, words=3, threshold=85, block_shingles=block).collect()} == {0}
    assert drop_near_duplicates(docs, words=3, threshold=85).count() == 1


def test_shingles_and_signatures():
    import pyarrow as pa

    a, b, c, d = shingle_sets(pa.array(["A b c d", "a  B\nc d ", None, "a b"]), 3)
    assert len(a) == 2 and np.array_equal(a, b) and len(c) == 0 and len(d) == 1
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 400, dtype=np.uint64)
    both = signature(x, 512) == signature(np.concatenate([x[:300], rng.integers(0, 2**63, 100, dtype=np.uint64)]), 512)
    assert abs(both.mean() - 300 / 500) < 0.08


def test_components(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(50)] + [(90, 91), (95, 95)], "a long, b long")
    assert {(r.node, r.component) for r in components(e, "a", "b").collect()} == {(i, 0) for i in range(51)} | {(90, 90), (91, 90)}


def test_no_task_holds_a_hub(spark):
    """A star and a chain of hubs, dealt over lanes of ten edges."""
    star = [(0, i) for i in range(1, 400)] + [(i, 1000 + i) for i in range(300, 400)] + [(399, 2000 + i) for i in range(60)]
    e = spark.createDataFrame(star, "a long, b long")
    got = {(r.node, r.component) for r in components(e, "a", "b", lane=10).collect()}
    assert got == {(i, 0) for pair in star for i in pair}
