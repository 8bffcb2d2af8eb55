import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import components as C
from tessera.llm import near_dedup as N
from tessera.llm import shingles as S
from tessera.llm.common import words_of
from tests.llm.test_decontaminate import words


def weights(t, n=5):
    w = words(t)
    return Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def brute_similarity(a, b):
    if not a or not b:
        return 0.0
    jp = sum(1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a.keys() | b.keys()) for x in a.keys() & b.keys())
    return max(len(a.keys() & b.keys()) / len(a.keys() | b.keys()), jp)


def brute_classes(rows):
    sets = [weights(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and find(i) != find(j) and (rows[i][1] == rows[j][1] or brute_similarity(sets[i], sets[j]) >= 0.8):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(25):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 30, 120, 400]))]
        out.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 4, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(r.choice([" ", ", "]).join(copy))
    out += ["at " * 300, "at " * 500 + "b", "AT " * 300, "same text here", "same text here", None, None, "", "...", "x", "long word " * 20_000]
    r.shuffle(out)
    return list(enumerate(out))


def test_similarity():
    for seed in range(20):
        r = random.Random(seed)
        a, b = (" ".join(r.choice("abc") for _ in range(r.randint(1, 40))) for _ in range(2))
        assert max(S.similarity(S.weighted(a.encode()), S.weighted(b.encode()))) == pytest.approx(brute_similarity(weights(a), weights(b)))


def test_signatures_estimate_probability_jaccard():
    r = random.Random(1)
    for _ in range(5):
        a, b = ([r.choice(range(30)) for _ in range(60)] for _ in range(2))
        x, y = (np.unique(S.mix(np.array(v, np.uint64)), return_counts=True) for v in (a, b))
        got = np.mean(np.equal(*S.signatures([x, y], 4000)))
        assert got == pytest.approx(S.similarity(x, y)[1], abs=0.04)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_classes_as_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(N, "BROADCAST_ROWS", broadcast)
    rows = corpus(3)
    frame = spark.createDataFrame([(i, t, "c", i) for i, t in rows], "doc_id long, text string, key string, class_id long").repartition(4)
    got = N.classes(frame).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for r in got:
        groups[r.class_id].append(r.id)
        assert r.class_id <= r.id
    assert sorted(sorted(map(str, g)) for g in groups.values()) == brute_classes(rows)
    kept = N.keep_one(frame)
    assert kept.schema == frame.schema
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_awkward_ids(spark):
    t = "one two three four five six"
    rows = [(1, t), (1, t), (None, t), (2, None), (2, None), (2, "other words"), (None, "a lone text"), (None, "a lone text"), (3, "b"), (3, "c")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, N.keep_one(frame).collect()), key=str) == sorted([(1, t), (2, None), (2, None), (2, "other words"), (None, "a lone text"), (3, "b"), (3, "c")], key=str)
    assert N.classes(frame.limit(0)).count() == 0 and N.keep_one(frame.limit(0)).count() == 0


def test_word_hashes_of_pieces(monkeypatch):
    """Every word has its hash, whatever the pieces; a word longer than a piece is whole; equal words alone have equal hashes."""
    text = b"aa  Bb,c " + b"z" * 300 + b" aa bb c " + b"z" * 299 + b"," + "ü-Wort ".encode() * 40
    words = words_of(text)
    whole = S.word_hashes(text)
    assert len(whole) == len(words)
    assert len(set(whole.tolist())) == len(set(words)) == len(set(zip(words, whole.tolist())))
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(S, "PIECE", size)
        assert (S.word_hashes(text) == whole).all()
    assert [len(S.word_hashes(x)) for x in (None, b"", b" .,", b"a", b" a ")] == [0, 0, 0, 1, 1]


def test_sets_are_sent_to_their_cells_once(spark, monkeypatch):
    """Where no join is a broadcast, as on large tables, sets are sent only to their cells; they are stored for members of large buckets with several components alone."""
    plans, tags, whole, keep = [], [], C.in_cells, C.stored
    monkeypatch.setattr(C, "in_cells", lambda rows, *how: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or whole(rows, *how))
    monkeypatch.setattr(C, "stored", lambda df, tag: tags.append(tag) or keep(df, tag))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = corpus(5)
        got = N.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    groups = defaultdict(list)
    for r in got:
        groups[r.class_id].append(r.id)
    assert sorted(sorted(map(str, g)) for g in groups.values()) == brute_classes(rows)
    assert len(plans) == 1 and "MapInArrow" in plans[0] and "Exchange" not in plans[0].split("MapInArrow")[0]
    assert "sets" not in tags
