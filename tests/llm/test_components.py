import random

import numpy as np
import pytest

from tessera.llm import components as C
from tessera.llm import shingles as S


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b and None not in (a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty"])
def test_components(spark, kind):
    r = random.Random(1)
    edges = {"chain": [(k, k + 1) for k in range(40)] + [(90, 80), (5, 5)], "star": [(500, k) for k in range(300)] + [(k, 1000 + k) for k in range(50)], "random": [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1, 1), (None, 4)], "empty": []}[kind]
    got = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.root for x in got} == brute(edges) and len(got) == len({x.node for x in got})


def links_of(sets, threshold=0.8):
    return [(i, j) for i in range(len(sets)) for j in range(i) if max(S.similarity(sets[i], sets[j])) >= threshold - 1e-12]


def families(seed, n):
    """Weighted sets of a few families with a phrase that all have, near the threshold."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        own = {r.randrange(10**6) + 100: r.choice([1, 1, 1, 5, 30]) if len(out) % 3 else 1 for _ in range(r.randint(1, 40))} | dict.fromkeys(range(9), 1)
        for _ in range(r.choice([1, 2, 9])):
            out.append(np.unique(np.array([x for e, m in own.items() if r.random() > 0.06 for x in [e] * m] or [len(out)], np.uint64), return_counts=True))
    return out[:n]


@pytest.mark.parametrize("n", [2, 5, 7, 40, 120])
def test_forest_joins_what_links_join(n):
    for seed in range(6):
        sets = families(seed, n)
        weights = [None if len(w) == w.sum() else w for _, w in sets]
        got = C.forest([x for x, _ in sets], weights, list(range(n)), 0.8)
        want = brute(links_of(sets))
        assert brute(got) == want and len(got) == len(want) - len(set(want.values()))
        roots = [want.get(k, k) for k in range(n)]
        assert C.forest([x for x, _ in sets], weights, roots, 0.8) == []


def test_common_counts_in_slices(monkeypatch):
    sets = families(3, 30)
    for columns in (1, 7, 4096):
        monkeypatch.setattr(C, "COLUMNS", columns)
        owner = np.repeat(np.arange(30), [len(x) for x, _ in sets])
        _, column, count = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True, return_counts=True)
        got = C.common(owner, column, count, np.concatenate([w for _, w in sets]), 30)
        assert all(got[i, j] == sets[i][1][np.isin(sets[i][0], sets[j][0])].sum() for i in range(30) for j in range(30))


def frames(spark, sets, buckets):
    """(buckets, contents) of weighted sets and lists of their places by bucket."""
    rows = [(str(k).encode(), x.tobytes(), None if len(w) == w.sum() else w.tobytes()) for k, (x, w) in enumerate(sets)]
    data = spark.createDataFrame(rows, "key binary, elements binary, weights binary").repartition(3)
    members = spark.createDataFrame([(str(k).encode(), len(sets[k][0]), b) for b, ks in enumerate(buckets) for k in set(ks)], "key binary, size long, bucket long")
    return members, lambda keys: data.join(keys, "key", "left_semi")


@pytest.mark.parametrize("block", [4, 256])
def test_linked_as_all_pairs_of_buckets(spark, monkeypatch, block):
    """Buckets over the size of a block, of strangers, families and both; some with the same members."""
    monkeypatch.setattr(C, "BLOCK", block)
    r = random.Random(block)
    sets = families(9, 150)
    buckets = [list(range(150)), list(range(60)), list(range(60)), [0], [], *[[r.randrange(150) for _ in range(r.choice([2, 5, 20]))] for _ in range(30)]]
    got = {x.node: x.root for x in C.linked(*frames(spark, sets, buckets)).collect()}
    want = brute([(i, j) for i, j in links_of(sets) if any(i in b and j in b for b in buckets)])
    groups = lambda root: sorted(sorted(k for k in root if root[k] == x) for x in set(root.values()))
    assert groups({int(k): int(x) for k, x in got.items()}) == groups(want)


def test_versions_of_one_bucket_are_one_component(spark, monkeypatch):
    """Successive versions, each like those near it and not like the far ones; two strangers that are alike come last."""
    monkeypatch.setattr(C, "BLOCK", 8)
    words = np.arange(10, 2000, dtype=np.uint64)
    sets = [(words[3 * k : 3 * k + 60], np.ones(60, np.int64)) for k in range(50)] + [(words[1500:1560], np.ones(60, np.int64)), (words[1501:1561], np.ones(60, np.int64))]
    got = {int(x.node): int(x.root) for x in C.linked(*frames(spark, sets, [range(52)])).collect()}
    assert len({got[k] for k in range(50)}) == 1 and got[50] == got[51] != got[0]


def test_similar_sets_share_an_element_of_their_prefixes():
    for seed in range(4):
        sets = families(seed, 120)
        for counts in (np.zeros(C.SLOTS, np.int64), np.random.default_rng(seed).integers(0, 9, C.SLOTS)):
            of = [set(C.prefix(x, None if len(w) == w.sum() else w, counts, 0.8).tolist()) for x, w in sets]
            assert all(of[i] & of[j] for i, j in links_of(sets))


@pytest.mark.parametrize("rows", [0, 10**9])
def test_linked_by_blocks_and_by_prefixes(spark, monkeypatch, rows):
    monkeypatch.setattr(C, "BLOCK", 4)
    monkeypatch.setattr(C, "PREFIX_ROWS", rows)
    sets = families(5, 120)
    buckets = [list(range(120)), list(range(0, 120, 2))]
    root = {int(x.node): int(x.root) for x in C.linked(*frames(spark, sets, buckets)).collect()}
    groups = lambda root: sorted(sorted(k for k in root if root[k] == x) for x in set(root.values()))
    assert groups(root) == groups(brute(links_of(sets)))


def test_rows_of_a_large_bucket_of_strangers_grow_with_its_members(spark, monkeypatch):
    """Strangers that have much in common, but each its own elements; the last two are alike, and in different blocks."""
    monkeypatch.setattr(C, "BLOCK", 4)
    sent, whole = [], C.in_cells
    monkeypatch.setattr(C, "in_cells", lambda rows, cell, *how: ("i" in cell and sent.append(rows.count())) or whole(rows, cell, *how))
    for n in (40, 160):
        sent.clear()
        sets = [(np.concatenate([np.arange(10), 1000 * (k + 1) + np.arange(12)]).astype(np.uint64), np.ones(22, np.int64)) for k in range(n)]
        sets.append((np.concatenate([sets[-1][0][:-1], [10**6 + 7]]).astype(np.uint64), np.ones(22, np.int64)))
        got = {int(x.node): int(x.root) for x in C.linked(*frames(spark, sets, [range(n + 1)])).collect()}
        assert {k for k in got if list(got.values()).count(got[k]) > 1} == {n - 1, n}
        assert sum(sent) <= 6 * (n + 1)


def test_no_buckets(spark):
    assert C.linked(*frames(spark, families(1, 3), [[0], [1], [2]])).count() == 0
