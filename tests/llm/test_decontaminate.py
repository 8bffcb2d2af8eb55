import hashlib
import random
import re

import pytest

from tessera.llm import decontaminate as D
from tests.llm.data import docs, texts

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(doc_rows, items, window=10):
    out = []
    for i, t in doc_rows:
        w, hit, ids, best = words(t), set(), set(), None
        for k, s in items:
            v = words(s)
            n = min(window, len(v))
            grams = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if n else set()
            for a in range(len(w) - n + 1):
                if n and tuple(w[a : a + n]) in grams:
                    hit |= set(range(a, a + n))
                    ids |= {str(k)} - {"None"}
        # The longest match that holds a window of the item from its first word on.
        for k, s in items if len(w) < 100 else ():
            v = words(s)
            n = min(window, len(v))
            for a in range(len(w)) if n else ():
                for b in range(len(v)):
                    m = 0
                    while a + m < len(w) and b + m < len(v) and w[a + m] == v[b + m]:
                        m += 1
                    if m >= n:
                        best = min(best or (1,), (-m, a, k is None, str(k), b))
        out.append((i, len(w), len(hit), tuple(sorted(ids)), best and (-best[0], best[1], None if best[2] else best[3], best[4])))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(r.longest) if r.longest else None) for r in df.collect()), key=str)


@pytest.mark.parametrize(("seed", "shard", "block"), [(1, 1 << 20, 1 << 20), (2, 50, 1 << 20), (3, 200, 2000), (1, 200, 900)])
def test_as_brute_force(spark, seed, shard, block):
    r = random.Random(seed)
    items = [(k, t) for k, t in enumerate(texts(seed + 10, 12))] + [(90, None), (91, "..."), (92, "zed Ten\nif"), (93, "ABSENT"), (None, "go go go"), (92, "we we if no go"), (4, texts(seed + 10, 12)[4])]
    planted = [f"before {WORD.sub(lambda m: m[0], t or '')} after" for _, t in items] + [" ".join(words(texts(seed + 10, 12)[k])[r.randrange(20) :][:25]) for k in range(12)]
    frame, rows = docs(spark, planted, seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_matches(frame.repartition(3), bench, shard_words=shard, block_bytes=block)
    want = brute([(x[0], x[1]) for x in rows], items)
    assert [x if x[1] < 100 else x[:4] for x in found(got)] == [x if x[1] < 100 else x[:4] for x in want]
    kept = D.remove_contaminated(frame, bench, shard_words=shard, block_bytes=block)
    assert kept.schema == frame.schema
    bad = {w[0] for w in want if w[2]}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in rows if x[0] not in bad)


def test_empty_tables(spark):
    frame, rows = docs(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in D.find_matches(frame, none).collect()} == {0}
    assert D.remove_contaminated(frame, none).count() == len(rows)
    assert D.find_matches(frame.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_digest_columns(spark, tmp_path):
    from tessera.llm.queries import op1_decontaminate

    frame, rows = docs(spark)
    items = [(2, "the of ten"), (10, "x"), (1, "no such words here")]
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op1_decontaminate(spark, str(tmp_path)).collect()}
    assert got == {(i, n, h, len(s), hashlib.sha256(",".join(s).encode()).hexdigest(), h > 0) for i, n, h, s, _ in brute([(x[0], x[1]) for x in rows], items)}
