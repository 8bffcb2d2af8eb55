import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import quality as Q
from tests.llm.data import docs

MORE = ["a b c " * 40, "x y\nx y\n\n \nx y\nz", "#*$%&|<> " * 60, "one two three one two three", "\x0b\x0cw\u00a0w\x00 \r\n\t" * 3, "a a a a", "p q r s p q r q r s", "w " * 60 + "\n" + "v " * 60]


def measures(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(grams)
    hit = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(hit)


def test_ledger(spark):
    frame, rows = docs(spark, MORE)
    entries = Q.ledger(frame)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in entries.collect()), key=str)
    assert got == sorted(((x[0], *measures(x[1])) for x in rows), key=str)
    base = {r.doc_id: r.base_v1 for r in Q.apply_policies(entries).collect()}
    for x in rows:
        n, _, _, _, _, rep = measures(x[1])
        assert base[x[0]] == (not (n < 50 or 100 * rep > 50 * n))


def test_policies_and_ablations(spark):
    frame, rows = docs(spark, MORE)
    entries = Q.ledger(frame).cache()
    kept = Q.keep(frame)
    assert kept.schema == frame.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in entries.where(Q.passes(Q.PRODUCTION)).collect())
    clash = frame.withColumn("_m", F.lit(7)).withColumn("n_words", F.lit("x"))
    assert Q.keep(clash).schema == clash.schema and Q.keep(clash).count() == kept.count()
    bits = [r.failed for r in entries.collect()]
    want = {(name, sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits), len(bits)) for k, (name, _) in enumerate(Q.RULES)}
    assert {tuple(r) for r in Q.ablations(entries).collect()} == want
    assert Q.ablations(entries.limit(0)).count() == len(Q.RULES)
    assert Q.ledger(frame.limit(0)).count() == 0
