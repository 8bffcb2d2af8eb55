import random

import numpy as np
import pytest

from tessera.llm import shingles as S
from tessera.llm import substrings as D
from tests.llm.test_decontaminate import words


def test_anchors_follow_their_definition():
    r = np.random.default_rng(1)
    for _ in range(30):
        sizes = r.integers(1, 60, 5)
        parts = [r.integers(0, 50, n).astype(np.uint64) for n in sizes]
        grams = np.concatenate([np.concatenate([p, np.full(6, D.LAST)]) for p in parts])
        want, begin = set(), 0
        for p in parts:
            for k in range(max(1, len(p) - 6)):
                w = p[k : k + 7]
                want |= {begin + k + j for j in range(len(w)) if w[j] == w.min()}
            begin += len(p) + 6
        assert set(D.anchors(grams, sizes, 7)) == want


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijé") for _ in range(r.randint(2, 7)))
    fresh = lambda n: [word() for _ in range(n)]
    passages = [fresh(n) for n in (51, 60, 90, 200)]
    line = fresh(13)
    rows = [[*fresh(r.randint(0, 80)), *line, *fresh(r.randint(5, 300))] for _ in range(30)]
    has = {}
    for k in range(20):
        p = passages[k % 4]
        doc = [*fresh(r.randint(0, 60)), *p, *fresh(r.randint(0, 60))]
        has[len(rows)] = (k % 4, words(" ".join(doc)))
        rows.append(doc)
    return [(i, r.choice([" ", ", "]).join(w)) for i, w in enumerate(rows)], [words(" ".join(p)) for p in passages], has


@pytest.mark.parametrize("size", [64 << 20, 0])
def test_planted_passages(spark, size):
    rows, passages, has = corpus(5)
    more = [(100, None), (101, ""), (102, "of few words"), (103, "la " * 500), (104, rows[3][1]), (104, rows[3][1]), (None, "null " + rows[4][1])]
    frame = spark.createDataFrame([(i, t, "c", len(t or "")) for i, t in rows + more], "doc_id long, text string, spans string, n_chars long").repartition(3)
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in D.report(frame, broadcast_bytes=size).collect()}
    first = {}
    for i, (p, _) in sorted(has.items()):
        first.setdefault(p, i)
    for i, (p, w) in has.items():
        if first[p] == i:
            assert got[i] == []
        else:
            a = next(k for k in range(len(w)) if w[k : k + len(passages[p])] == passages[p])
            assert got[i] and all(s >= a - D.WINDOW // 4 and e <= a + len(passages[p]) + D.WINDOW // 4 for s, e in got[i]), (i, got[i], a)
    # document 3 has a copy, and the null id comes first
    clean = set(range(30)) - {4}
    assert all(got[i] == [] for i in clean | {100, 101, 102, 103})
    assert sum(e - s for s, e in got[104]) > 0.5 * len(words(rows[3][1])) - 48
    assert got[4]
    if not size:
        return
    out = {r.doc_id: r for r in D.remove_repeats(frame).collect()}
    for i, t in rows:
        w = words(t)
        left = [x for k, x in enumerate(w) if not any(s <= k < e for s, e in got[i])]
        assert words(out[i].text) == left and out[i].n_chars == len(out[i].text)
    assert D.report(frame.limit(0)).count() == 0


def test_near_copies_of_passages(spark):
    r = random.Random(2)
    rows = []
    for k in range(40):
        p = [f"{k}w{j}" for j in range(120)]
        q = list(p)
        q[60] = "changed"
        rows += [(2 * k, " ".join(p)), (2 * k + 1, " ".join([*(f"x{k}y{j}" for j in range(r.randint(1, 40))), *q]))]
    got = {x.doc_id: x.n_removed for x in D.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == 0 and got[2 * k + 1] > 40 for k in range(40))


def test_bands_are_tuned():
    assert D.N_BANDS == 4 and 1 - (1 - S.THRESHOLD**D.ROWS) ** D.N_BANDS >= D.RECALL


def test_query_names_both_documents(spark, tmp_path):
    from tessera.llm.queries import op8_substring_dedup

    rows, _, has = corpus(6)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first = {}
    for i, (p, _) in sorted(has.items()):
        first.setdefault(p, i)
    rows_ = op8_substring_dedup(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows_) == [i for i, _ in rows] and all(r.repeats == bool(r.kept_in) == bool(r.n_spans) for r in rows_)
    got = {r.doc_id: r.kept_in for r in rows_ if r.repeats}
    assert got.keys() == {i for i, (p, _) in has.items() if first[p] != i}
    for i, kept in got.items():
        # paragraphs over a passage's edge can have another first document, of the same passage
        assert first[has[i][0]] in kept and all(has[k][0] == has[i][0] and k < i for k in kept)


def test_windows_of_other_words_are_not_thinned():
    """Neighbours a word apart whose bands are equal, as of ordinary text, hold other words; only equal ones are left out."""
    words = np.arange(40, dtype=np.uint64)
    rows = np.stack([words[:26], words[1:27], words[1:27], words[2:28]])
    assert D.thinned(np.zeros(4, np.int64), np.arange(4), rows).tolist() == [True, True, False, True]
    r = random.Random(3)
    for _ in range(300):
        text = " ".join(str(r.randrange(10**6)) for _ in range(120)).encode()
        grams, at = S.word_hashes(text), D.paragraphs([text], False)[1]
        x = S.mix(grams * D.U(3) + np.roll(grams, -1) * D.U(0x9E3779B97F4A7C15) + np.roll(grams, -2) * D.U(0xD6E8FEB86659FD93))
        x = np.concatenate([np.minimum(x, D.LAST - D.U(1))[: 120 - D.WINDOW + 1], np.full(D.WINDOW - 1, D.LAST)])
        assert at.tolist() == D.anchors(x, np.array([120 - D.WINDOW + 1]), D.WINDOW).tolist()
