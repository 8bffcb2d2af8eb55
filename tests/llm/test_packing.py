import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as P
from tests.llm.data import docs


def test_placements(spark):
    frame, rows = docs(spark, ["İstanbul ΣΑΣ don't 12½ a b c <|endoftext|> é ́x", "\x00\x01 ​ ﻿", "日本語 テスト " * 50, "x" * 5000])
    t = Tokenizer.from_file(P.vocabulary_path(P.VOCABULARY))
    out = P.pack(frame.repartition(5), capacity=512).collect()
    by_doc = defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    want = defaultdict(list)
    for x in rows:
        ids = t.encode(x[1] or "", add_special_tokens=False).ids + [1]
        for n, a in enumerate(range(0, len(ids), 512)):
            own = ids[a : a + 512]
            want[x[0]].append((n, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert {k: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    check_sequences([(r.sequence_id, r.offset, r.length) for r in out], 512)


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for s, o, n in rows:
        by[s].append((o, n))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [(g, k) for k, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit)[1]] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_as_good_as_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = 1000
    lengths = {0: lambda: r.randint(1, 1000), 1: lambda: r.choice([1, 2, 3, 700]), 2: lambda: min(1000, int(r.expovariate(1 / 120)) + 1), 3: lambda: 501, 4: lambda: r.randint(200, 520), 5: lambda: 1}[seed]
    rows = [lengths() for _ in range(1500)]
    counts = {n: rows.count(n) for n in set(rows)}
    plan = P.Plan(counts, capacity)
    placed = [(int(s), int(o), n) for n, c in counts.items() for s, o in zip(*plan.place(n, np.arange(c)))]
    n = check_sequences(placed, capacity)
    assert n == plan.sequences and n * capacity - sum(rows) == plan.gap_tokens
    assert n <= best_fit_decreasing(rows, capacity) * 1.02 + 1, (n, best_fit_decreasing(rows, capacity), plan.rounds)


def test_empty(spark):
    frame, _ = docs(spark)
    assert P.pack(frame.limit(0)).count() == 0
