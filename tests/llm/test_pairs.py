"""Top-k search, near-duplicate vectors, n-gram Jaccard join, components."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from cadentia.llm import jaccard_join, neardup_vectors, topk
from cadentia.llm.components import connected_components
from cadentia.llm.shingles import shingle_sets


def smallest_reachable(nodes, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for n in sorted(nodes):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += near[x]
    return out


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(120)] + [(500, 500), (7, 7)]
    found = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest_reachable({x for l in links for x in l}, links)
    assert all(found.get(n, n) == c for n, c in want.items())
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 12))
    near = np.concatenate([base[i] + rng.normal(scale=0.25, size=(40, 12)) for i in range(3)])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate((base, near, base[:9] * 5)))]
    rows += [(1000 + i, base[5].tolist()) for i in range(60)]
    rows += [(2000, None), (2020, [1.0, None] + [0.0] * 10), (2040, [float("nan")] * 12), (2060, [float("inf")] + [0.0] * 11), (2080, [0.0] * 12), (2100, []), (None, base[5].tolist()), (2120, [1.0, 2.0])]
    return rows


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def test_near_duplicate_vectors(spark):
    rows = vectors()
    rows.append(rows[0])
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows], "vec_id long, embedding array<double>, label int, cell double").repartition(3)
    found = neardup_vectors.near_duplicate_vectors(spark, docs).collect()
    live = [(i, np.array(v + [0.0] * (12 - len(v)))) for i, v in rows if i is not None and usable(v) and any(v)]
    u = np.array([v / np.linalg.norm(v) for _, v in live])
    a, b = np.nonzero(u @ u.T >= 0.9)
    counts, links = defaultdict(int), []
    for i, j in zip(a, b, strict=True):
        if i != j:
            counts[i] += 1
            links.append((live[i][0], live[j][0]))
    want_links = defaultdict(set)
    for i, (n, _) in enumerate(live):
        want_links[n].add(counts[i])
    component = smallest_reachable({r[0] for r in rows if r[0] is not None}, links)
    assert len(found) == len(rows)
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert r.n_links in want_links.get(r.vec_id, {0}) and r.component_id == component[r.vec_id] and r.kept == (r.vec_id == r.component_id)
    assert neardup_vectors.near_duplicate_vectors(spark, docs.where("1 = 0")).count() == 0


def test_trees_against_all_pairs():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(30, 6)), *[c + rng.normal(scale=s, size=(25, 6)) for c in rng.normal(size=(4, 6)) * 2 for s in (0.05, 0.3)]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = rng.integers(1, 4, len(x)).astype(float)
    tree = neardup_vectors.CoverTree(np.arange(len(x)), x, w, neardup_vectors.nested_nets(x))
    links = neardup_vectors.Links()
    links.compare(tree, tree, 0.9, True)
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert [links.counts.get(i, 0) for i in range(len(x))] == (near @ w).astype(int).tolist()
    other = neardup_vectors.Links()
    half = len(x) // 2
    trees = [neardup_vectors.CoverTree(i, x[i], w[i], neardup_vectors.nested_nets(x[i])) for i in (np.arange(half), np.arange(half, len(x)))]
    other.compare(*trees, 0.9, False)
    cross = near.copy()
    cross[:half, :half] = cross[half:, half:] = False
    assert [other.counts.get(i, 0) for i in range(len(x))] == (cross @ w).astype(int).tolist()


@pytest.mark.parametrize("block", [7, 2048])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    rows = vectors()
    rows.append(rows[3])
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, block string").repartition(3)
    found = defaultdict(list)
    for r in topk.top_inner_products(spark, docs).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    live = {i: [int(np.floor(64 * x)) for x in v] + [0] * (12 - len(v)) for i, v in rows if i is not None and usable(v)}
    assert set(found) == {i for i in live if i % 20 == 0}
    for q, got in found.items():
        scores = sorted((-sum(a * b for a, b in zip(live[q], v, strict=True)), i) for i, v in live.items() if i != q)[:20]
        assert sorted(got) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert topk.top_inner_products(spark, docs.where("1 = 0")).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (20, [2.0]), (21, [1e300])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in topk.top_inner_products(spark, few).collect()) == [(0, 1, 21), (0, 2, 20), (20, 1, 21), (20, 2, 0)]


def test_rows_of_block_pairs_are_those_that_meet(spark):
    """Descriptors grow with the pairs that meet, not with all pairs: ten times the blocks of separate cells give ten times the rows."""
    for blocks in (1, 2, 7, 40, 400):
        cell = [b // 4 for b in range(blocks)]
        near = [(c, c) for c in sorted(set(cell))] + [(0, 1), (1, 0)] * (blocks > 4)
        found = neardup_vectors.near_blocks(spark.createDataFrame(list(enumerate(cell)), "b int, cell int"), spark.createDataFrame(near, "a_cell int, b_cell int"), blocks).collect()
        want = {frozenset((a, b)) for a in range(blocks) for b in range(blocks) if (cell[a], cell[b]) in near}
        assert len(found) == len(want) == len({frozenset((r.a, r.b)) for r in found}) and {frozenset((r.a, r.b)) for r in found} == want
        assert len(found) <= 3 * blocks + 16 and all(r.step == (r.b - r.a) % blocks for r in found)
    lengths, needs = [9.0, 7.0, 7.0, 2.0, 0.0], [(5, 8.0), (6, 7.0), (9, float("-inf")), (11, 100.0)]
    met = topk.reached_pairs(spark.createDataFrame(list(enumerate(lengths)), "block int, length double"), spark.createDataFrame(needs, "block int, needed double"), 2).collect()
    assert sorted((r.block, r.q) for r in met) == sorted((b, q) for b, length in enumerate(lengths) for q, need in needs if need <= length) and all(r.stripe == r.block % 2 for r in met)


def test_moved_blocks_grow_with_blocks(spark):
    """All blocks near each other: a block moves once for each group, and each pair is compared once."""
    for blocks in (1, 5, 40, 120):
        size = neardup_vectors.group_size(blocks, 64)
        tiles = neardup_vectors.near_blocks(spark.range(blocks).selectExpr("int(id) as b", "0 as cell"), spark.createDataFrame([(0, 0)], "a_cell int, b_cell int"), blocks)
        held, shown = (t.collect() for t in neardup_vectors.grouped_tiles(tiles, size))
        assert len(held) + len(shown) <= (neardup_vectors.GROUPS + 1) * blocks
        pairs = [(other, r.own) for r in shown for other in r.others]
        assert sorted(pairs) == [(a, b) for a in range(blocks) for b in range(a, blocks)]
        there = {(r.left, r.right, r.own) for r in held}
        assert all((r.left, r.right, other) in there for r in shown for other in r.others)
    assert neardup_vectors.group_size(10_000, 64) == 64 and neardup_vectors.group_size(10_000, 100_000) == 1


def test_top_k_needs_no_short_blocks(spark, monkeypatch):
    """With lengths far apart, the bars of the longest vectors rule out most blocks; results stay exact."""
    monkeypatch.setattr(topk, "BLOCK", 32)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 8)) * np.exp(-np.arange(1500) / 120)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    whole = np.floor(64 * x).astype(np.int64)
    search = topk.Search(np.array([0]), whole[:1].astype(float), topk.Rotation(whole.astype(float)), 5)
    search.take(np.arange(32), whole[:32].astype(float))
    lengths = np.sqrt((whole * whole).sum(1))
    assert lengths[-1] < search.needed() < lengths[:32].max()
    # What is too short for the bar cannot be among the best.
    scores = whole[1:] @ whole[0]
    assert (np.sort(scores)[-5:] >= search.bar[0] - 1e-6).all() and (scores[lengths[1:] < search.needed()] < search.bar[0]).all()
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_inner_products(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5).collect())
    want = []
    for q in range(0, 1500, 20):
        best = sorted((-int(whole[q] @ whole[i]), i) for i in range(1500) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want


def word_sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(width, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute_components(rows, width, thousandths):
    sets = [(i, word_sets(t, width)) for i, t in rows if i is not None]
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a and b and 1000 * len(a & b) >= thousandths * len(a | b)]
    return smallest_reachable({i for i, _ in sets}, links)


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(300)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(60)]
    for i in range(140):
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90)))))
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(140, 260):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words[: rng.randint(100, 120)])))
    for i in range(260, 320):
        rows.append((i, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(2, 90))])))
    return rows + [(400 + i, rows[150][1].upper() + " \n") for i in range(30)]


@pytest.mark.parametrize(("width", "threshold", "block"), [(3, 0.9, 2048), (5, 0.8, 16), (2, 0.5, 2048)])
def test_jaccard_components(spark, monkeypatch, width, threshold, block):
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x", 3) for r in rows], "doc_id long, text string, n int, shingle string, hub long").repartition(4)
    want = brute_components(rows, width, round(1000 * threshold))
    sizes = {i: len(word_sets(t, width)) for i, t in rows}
    found = jaccard_join.jaccard_components(spark, docs, width, threshold).collect()
    assert {r.doc_id: r.component_id for r in found} == want and all(r.n_shingles == sizes[r.doc_id] for r in found)


def test_jaccard_odd(spark, odd_docs, odd_rows, no_docs):
    found = jaccard_join.jaccard_components(spark, odd_docs, 3, 0.9).collect()
    want = brute_components([(r[0], r[1]) for r in odd_rows], 3, 900)
    assert len(found) == len(odd_rows) and all(r.component_id == want.get(r.doc_id) for r in found)
    assert jaccard_join.jaccard_components(spark, no_docs, 3, 0.9).count() == 0
    kept = jaccard_join.one_of_each_group(spark, odd_docs, 3, 0.9)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {None} | {i for i, c in want.items() if i == c}


def test_ids_with_several_texts_keep_all_links(spark):
    rng = random.Random(6)
    a, b, c = ([f"w{rng.randint(0, 400)}" for _ in range(60)] for _ in range(3))
    near = [" ".join(w[:-1] + ["end"]) for w in (a, b, c)]
    rows = [(3, a), (5, a), (5, b), (7, c), (12, c), (12, a), (20, None)]
    rows = [(i, w and " ".join(w)) for i, w in rows] + [(9, near[1]), (9, near[1]), (8, near[2]), (20, near[0]), (20, "other text of it"), (30, "x y"), (30, "x z"), (31, "x z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = jaccard_join.jaccard_components(spark, docs, 3, 0.9).collect()
    want = brute_components(rows, 3, 900)
    assert len(found) == len(rows) and want[9] == 3 and want[31] == 30
    assert all(r.component_id == want[r.doc_id] for r in found)


def test_prefixes_keep_all_matches():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        counts = rng.integers(0, 50, jaccard_join.BUCKETS)
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate((rng.choice(a, max(1, int(len(a) * 0.93)), replace=False), rng.integers(0, 2**63, int(rng.integers(0, 5))).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        maps = jaccard_join.Bitmaps([jaccard_join.parity_bitmap(s) for s in (a, b)], np.array([len(a), len(b)]))
        most = int(maps.common(np.array([0]), np.array([1]))[0])
        assert most >= common
        bits = jaccard_join.alike(most, len(a), len(b), 800)
        if jaccard_join.alike(common, len(a), len(b), 800):
            (pa_, ma), (pb, mb) = (jaccard_join.prefix(s, counts, float(rng.integers(0, 50)), 800) for s in (a, b))
            assert bits and len(np.intersect1d(pa_, pb)) >= min(ma, mb)


def test_shingles_are_those_of_words():
    texts = ["x y", "Y  x y\tz", None, "", " \n ", "É é É e", "a b c d e f g a b c"]
    assert [len(s) for s in shingle_sets(texts, 3)] == [len(word_sets(t, 3)) for t in texts]
    assert shingle_sets(["A b  C"], 3)[0].tolist() == shingle_sets(["a B\nc"], 3)[0].tolist()
