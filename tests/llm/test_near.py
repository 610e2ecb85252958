"""The metric join and the Jaccard join against all pairs."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import grouping, lsh_forest, metric_join


def components(n, pairs):
    low = list(range(n))

    def find(x):
        while low[x] != x:
            low[x] = low[low[x]]
            x = low[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        low[b] = a
    return [find(k) for k in range(n)]


def linked_vectors(v, label):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    return (u @ u.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(v), dtype=bool)


@pytest.mark.parametrize("cell, again, numbers", [(512, 8192, 1 << 17), (40, 16, 200), (9, 60, 1 << 17)])
def test_vectors(spark, monkeypatch, cell, again, numbers):
    monkeypatch.setattr(metric_join, "CELL", cell)
    monkeypatch.setattr(metric_join, "AGAIN", again)
    monkeypatch.setattr(metric_join, "BLOCK_NUMBERS", numbers)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 6))
    v[50:110] = v[50] + rng.normal(size=(60, 6)) * 0.12
    v[200:210] = v[200]
    v[210] = v[200] * 3
    label = rng.integers(0, 2, 400)
    label[50:110] = label[200:211] = 0
    link = linked_vectors(v, label)
    comp = components(400, np.argwhere(link))
    got = metric_join.range_join(spark.createDataFrame([(k, x.tolist(), int(y)) for k, (x, y) in enumerate(zip(v, label, strict=True))], "vec_id long, embedding array<double>, label int"))
    got = {r.vec_id: r for r in got.collect()}
    assert len(got) == 400 and link.sum() > 500
    for k in range(400):
        assert (got[k].n_links, got[k].component_id, got[k].kept) == (link[k].sum(), comp[k], comp[k] == k)


@pytest.mark.parametrize("kind", ["clustered", "uniform"])
def test_cells_hold_every_link_once(spark, kind):
    """Vectors of one label through cells of the production size; how often each is copied."""
    rng = np.random.default_rng(6)
    n, dim = 6000, 16 if kind == "clustered" else 64
    centres = rng.normal(size=(60, dim))
    v = centres[rng.integers(0, 60, n)] + rng.normal(size=(n, dim)) * 0.1 if kind == "clustered" else rng.normal(size=(n, dim))
    v[1:51] = v[51:101] * 2 + rng.normal(size=(50, dim)) * 0.01
    label = np.zeros(n, int)
    link = linked_vectors(v, label)
    d = spark.createDataFrame([(k, x.tolist(), 0) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in metric_join.range_join(d).collect()}
    assert [got[k] for k in range(n)] == link.sum(1).tolist() and link.sum() >= 100
    rows = spark.createDataFrame([(0, k, 1, x.tolist(), True) for k, x in enumerate(v)], "cell long, rep long, mult long, unit array<double>, home boolean")
    sizes = metric_join.cells(rows, np.sqrt(2 - 2 * 0.98)).groupBy("cell").agg({"home": "count"}).count()
    copies = metric_join.cells(rows, np.sqrt(2 - 2 * 0.98)).count() / n
    print(kind, "cells", sizes, "rows a vector", copies)
    assert sizes > 3 and (copies < 3 if kind == "clustered" else copies < sizes)


def test_copies_go_one_way():
    for k in range(1, 12):
        m = metric_join.receives(k)
        assert (m ^ m.T ^ np.eye(k, dtype=bool)).all() and m.sum(0).max() <= k // 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [1.0, None], 1), (6, [1.0, nan], 1), (14, [1.0, inf], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 2), (9, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (11, [1e308, 1e308], 3), (12, [1.0, 1.0], 3), (13, [], 1)]
    d = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, label int, rep string").withColumn("n_links", F.lit("x")).withColumn("component_id", F.lit(0)).withColumn("kept", F.lit(1)).withColumn("cell", F.lit(1))
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in metric_join.range_join(d).collect())
    alone = [(str(k), 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 13, 14)]
    assert got == sorted([("1", 3, 1, True), ("2", 3, 1, False), ("2", 3, 1, False), ("None", 3, 1, False), ("11", 1, 11, True), ("12", 1, 11, False), *alone])
    assert metric_join.range_join(d.limit(0)).count() == 0


def plain_jaccard(docs, threshold=0.8):
    words = [(t or "").lower().split() for _, t in docs]
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    by = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            by[g].append(k)
    links, pairs = Counter(), []
    for k, s in enumerate(sets):
        for j in {j for g in s for j in by[g]} - {k}:
            if len(s & sets[j]) / len(s | sets[j]) >= threshold:
                links[k] += 1
                pairs.append((k, j))
    comp = components(len(docs), pairs)
    least = {}
    for k, c in enumerate(comp):
        i = docs[k][0]
        if i is not None:
            least[c] = min(least.get(c, i), i)
    return [(docs[k][0], least.get(c), links[k]) for k, c in enumerate(comp)]


@pytest.fixture(scope="module")
def copies():
    """Groups of near copies around the threshold, exact copies, and a shared passage."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    shared = [word() for _ in range(40)]
    rows = []
    for g in range(12):
        base = [word() for _ in range(120)]
        for _ in range(rng.choice((1, 2, 5, 30))):
            w = list(base)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(120)] = word()
            rows.append(" ".join(w) if g % 2 else " ".join([*w, *shared]))
        rows += [rows[-1]] * (g % 4)
    return [(k, t) for k, t in enumerate(rows)]


@pytest.mark.parametrize("block, shingles, screened", [(1024, 1 << 19, 2048), (8, 1 << 19, 5), (1024, 900, 3), (1024, 50, 2048)])
def test_near_copies(spark, copies, monkeypatch, block, shingles, screened):
    monkeypatch.setattr(lsh_forest, "BLOCK", block)
    monkeypatch.setattr(lsh_forest, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(lsh_forest, "SCREENED", screened)
    d = spark.createDataFrame(copies, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in lsh_forest.jaccard_join(d).collect())
    want = sorted(plain_jaccard(copies))
    assert got == want and sum(n for _, _, n in want) > 100
    kept = lsh_forest.drop_near_copies(d)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in want})


def test_near_copies_of_odd_rows(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in lsh_forest.jaccard_join(odd_docs).collect()), key=str)
    assert got == sorted(plain_jaccard(docs), key=str)
    kept = lsh_forest.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and sorted(map(str, ids)) == sorted(map(str, [1, 3, 4, 5, 6, 7, 9, None] + [8] * (8 in ids)))
    assert lsh_forest.jaccard_join(no_docs).count() == 0 and lsh_forest.drop_near_copies(no_docs).count() == 0


def test_repeated_and_null_ids(spark, copies):
    """One id for many texts, and rows without an id: every text stays what it is."""
    docs = [(None if k % 3 == 0 else k % 4, t) for k, t in copies] + [(None, copies[0][1])] * 40 + [(2, copies[5][1])] * 40
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in lsh_forest.jaccard_join(d).collect()), key=str)
    want = plain_jaccard(docs)
    assert got == sorted(want, key=str)
    left = [(r.doc_id, r.text) for r in lsh_forest.drop_near_copies(d).collect()]
    comps = components(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if near(docs[i][1], docs[j][1])])
    assert len(left) == len(set(comps)) and len(set(left)) == len(left)


def near(a, b):
    a, b = (frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b) >= 0.8


def test_recall_on_the_documents(spark):
    """Every pair of sf0.01 that all pairs compared give, and no other."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = [tuple(r) for r in d.collect()]
    want = sorted(plain_jaccard(docs))
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in lsh_forest.jaccard_join(d).collect()) == want and sum(n for *_, n in want) > 100


def test_prefix_depth():
    depth = lsh_forest.prefix_depth()
    found = lambda d: 1 - (1 - lsh_forest.THRESHOLD**d) ** lsh_forest.TREES
    assert found(depth) >= lsh_forest.RECALL > found(depth + 1)


@pytest.mark.parametrize("similar, extra", [(1.0, 2), (0.97, 2), (0.8, 0)])
def test_the_prefix_is_shortened_as_far_as_the_pairs_need(spark, similar, extra):
    root = lsh_forest._Root(0.8, lsh_forest.prefix_depth())
    root.count(np.array([[1.0, similar], [similar, 1.0]]))
    rows = [(None, None, level, root.pairs.tolist()[level], root.missed.tolist()[level]) for level in range(3)]
    edges = spark.createDataFrame([*rows, (1, 2, 0, None, None)], lsh_forest.EDGES)
    assert lsh_forest._matched(edges) == extra
    assert lsh_forest._matched(edges.limit(0)) == 0


def test_walk_of_a_trie():
    """Edges join the classes that share a prefix of each length, whatever the blocks."""
    rng = np.random.default_rng(8)
    roots = lsh_forest.prefix_depth()
    width = lsh_forest.TREES * (roots + lsh_forest.EXTRA)
    kinds = rng.integers(0, 2, (4, width)).astype(np.uint8)
    n = 90
    bits = kinds[rng.integers(0, 4, n)] ^ (rng.random((n, width)) < 0.02)
    tail = np.sort(rng.integers(0, 2, n) << 16 | rng.integers(0, 2, n))
    rows = [bytes(b) for b in np.packbits(bits, axis=1)]
    signs = bits.astype(float) * 2 - 1
    near = signs @ signs.T / width >= lsh_forest._Root(0.8, roots).near
    for size in (90, 20, 7):
        root = lsh_forest._Root(0.8, roots)
        for k in range(0, n, size):
            root.add({"rep": np.arange(k, min(k + size, n)), "tail": tail[k : k + size], "bits": rows[k : k + size]})
        edges, _, _ = root.rows()
        for level in range(lsh_forest.EXTRA + 1):
            shared = tail >> 16 * (lsh_forest.EXTRA - level)
            want = components(n, np.argwhere(near & (shared[:, None] == shared[None])))
            assert components(n, edges[edges[:, 2] >= level, :2]) == want


def test_groups_cut_by_batches():
    import pyarrow as pa

    rng = random.Random(3)
    jobs = sorted(rng.randrange(40) for _ in range(300))
    whole = pa.RecordBatch.from_arrays([pa.array(jobs, pa.int64()), pa.array(range(300), pa.int64())], names=["job", "rep"])
    cuts = sorted(rng.sample(range(301), 30))
    parts = [whole.slice(a, b - a) for a, b in zip([0, *cuts], [*cuts, 300], strict=True)]
    got = [g["rep"].tolist() for gs in grouping.grouped(iter(parts)) for g in gs]
    want = defaultdict(list)
    for k, j in enumerate(jobs):
        want[j].append(k)
    assert got == list(want.values())
    for size in (3, 7, 100):
        got = list(grouping.blocks(iter(parts), size))
        assert all(len(g["rep"]) <= size for _, g in got)
        rows = defaultdict(list)
        for j, g in got:
            rows[j] += g["rep"].tolist()
        assert dict(rows) == {j: r for j, r in want.items() if len(r) > 1}
    linked = np.zeros((3, 3), bool)
    linked[0, 1] = True
    assert grouping.forest(linked, np.array([5, 6, 7]), np.array([5, 6, 7])).tolist() == [[6, 5]]
