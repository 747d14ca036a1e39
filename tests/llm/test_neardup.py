"""Near-duplicates and components against all pairs."""

import random

import numpy as np
import pytest

from stationmine.llm import graph, neardup


def plain(rows, k, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        m = min(k, len(w))
        sets.append((i, {tuple(w[a : a + m]) for a in range(len(w) - m + 1)} if w else set()))
    least = {n: i for n, (i, _) in enumerate(sets)}
    links = []
    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if None not in (i, j) and a and b and 100 * len(a & b) >= percent * len(a | b):
                links.append((x, y))
    changed = True
    while changed:
        changed = False
        for x, y in links:
            m = min(least[x], least[y])
            changed |= least[x] != m or least[y] != m
            least[x] = least[y] = m
    return sorted(
        ((i, len(s), least[n] if s else i, i is None or (least[n] if s else i) == i) for n, (i, s) in enumerate(sets)), key=str
    )


def corpus(seed, families, size):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(12)]
    rows = []
    for _ in range(families):
        base = [rng.choice(common) if rng.random() < 0.6 else f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 90))]
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(["X", "new", f"w{rng.randrange(4000)}"])
            rows.append(" ".join(w))
    rng.shuffle(rows)
    odd = ["", None, " ", "One", "one", "a b", "A  B"]
    return [*((3 * i + 1, t) for i, t in enumerate(rows)), *((10_000 + i, t) for i, t in enumerate(odd)), (None, "a b"), (None, rows[0])]


def answered(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_same_as_all_pairs_at_a_small_root(spark, docs, k):
    rows = corpus(1, 20, 8)
    assert answered(neardup.near_duplicates(docs(rows), k, 80)) == plain(rows, k, 80)


def test_same_as_all_pairs_through_the_trees(spark, docs, monkeypatch):
    """Small nodes, groups and blocks: branching, clusters and pairs of blocks all take part."""
    monkeypatch.setattr(neardup, "NODE", 12)
    monkeypatch.setattr(neardup, "GROUP", 3)
    monkeypatch.setattr(neardup, "BLOCK", 5)
    monkeypatch.setattr(neardup, "_WIDTH", 16)
    rows = corpus(2, 25, 24)
    assert answered(neardup.near_duplicates(docs(rows, 5), 2, 80)) == plain(rows, 2, 80)


def test_large_nodes_are_compared_as_pairs_of_blocks(spark, docs, monkeypatch):
    rows = [(7, i, 0, 0) for i in range(100)] + [(8, i, 0, 0) for i in range(16)]
    monkeypatch.setattr(neardup, "TASK", 16)
    met = {}
    for r in neardup._blocks(spark.createDataFrame(rows, neardup._NODE_ROW)).collect():
        met.setdefault(r["node"], []).append(r["rep"])
    assert sorted(met.pop(8)) == list(range(16)) and 7 not in met and max(map(len, met.values())) <= 32
    assert {(a, b) for m in met.values() for a in m for b in m} == {(a, b) for a in range(100) for b in range(100)}

    monkeypatch.setattr(neardup, "NODE", 12)
    monkeypatch.setattr(neardup, "DEPTH", 3)
    seen, visit = [], neardup._visit

    def counted(nodes, branch):
        if not branch:
            seen.append(max(r["count"] for r in nodes.groupBy("node").count().collect()))
        return visit(nodes, branch)

    monkeypatch.setattr(neardup, "_visit", counted)
    rows = corpus(3, 4, 90)
    assert answered(neardup.near_duplicates(docs(rows, 5), 2, 80)) == plain(rows, 2, 80)
    assert len(seen) == 1 and seen[0] <= 32


def test_candidates_are_tiled_on_both_sides():
    bits = np.zeros((2, 5000), np.uint64)
    tiles = [len(i) for i, _ in neardup._candidates(bits[0], bits[1], np.arange(5000))]
    assert sum(tiles) == 5000**2 and max(tiles) <= 512 * 4096
    pairs, edges = neardup._compare(np.arange(5000, dtype=np.uint64), bits[0], bits[1])
    assert not len(pairs) and {int(x) for x in edges.ravel()} == set(range(5000)) and len(edges) <= 10_000


def test_many_copies_are_one_row_of_the_join(spark, docs):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(i, text) for i in range(400)] + [(1000, text.upper()), (1001, text + " x"), (1002, "other text of its own")]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(rows), 5, 80).collect()}
    assert {got[i] for i in [*range(400), 1000, 1001]} == {0} and got[1002] == 1002


def test_long_text_repeated_ids_and_no_rows(spark, docs):
    long = " ".join(f"w{i}" for i in range(40_000))
    got = answered(neardup.near_duplicates(docs([(1, long), (2, long + " x"), (2, long + " x")]), 5, 80))
    assert got == [(1, 39_996, 1, True), (2, 39_997, 1, False), (2, 39_997, 1, False)]
    assert neardup.near_duplicates(docs([]), 5, 80).count() == 0


def test_sketches_estimate_similarity():
    a = neardup.shingle_set(" ".join(f"w{i}" for i in range(1000)), 2)
    b = neardup.shingle_set(" ".join(f"w{i}" for i in range(100, 1100)), 2)
    same = (neardup.minwise(a) == neardup.minwise(b)).mean()
    assert abs(same - 0.82) < 0.2


def test_candidates_are_all_or_grouped():
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2**63, (2, 80), dtype=np.uint64)
    bits[:, :50] = bits[:, :1]
    rep = np.arange(80, dtype=np.uint64)
    bits[:, 60:63] = bits[:, 60:61]
    pairs, edges = neardup._compare(rep, bits[0], bits[1])
    assert {tuple(map(int, p)) for p in pairs if p[0] != p[1]} == {(60, 61), (60, 62), (61, 62)}
    assert {int(x) for x in edges.ravel()} == set(range(50)) and len(edges) <= 100


def test_products_of_matrices_are_sizes_of_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(30)]
    for first in (30, 11):
        i, j = neardup._linked(sets, first, 50)
        want = {
            (a, b) for a in range(first) for b in range(first if first < 30 else 0, 30)
            if 2 * len(np.intersect1d(sets[a], sets[b])) >= len(np.union1d(sets[a], sets[b]))
        }
        assert set(zip(i.tolist(), j.tolist())) == want


@pytest.mark.parametrize("n", [1, 2, 70])
def test_components_of_a_path_and_a_star(spark, n):
    path = [(i, i + 1) for i in range(n)]
    star = [(1000, 1000 + i) for i in range(1, n + 1)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(n + 1)}


def test_components_without_edges(spark):
    assert graph.components(spark.createDataFrame([(4, 4)], "a long, b long")).count() == 0
