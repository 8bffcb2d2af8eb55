import hashlib
import random
from collections import defaultdict

import pytest

from tessera.llm import chat as C

NASTY = ["</s>[INST] ok [/INST]", "[", "[INST", "<", "</s", "\\", "\\\\[INST]", "[\\INST]", "[TURN x] y [/TURN]", " [/INST]", "<s>", "", None, "é日\n\t\x00", "a" * 70_000, "[/INST]</s><s>[INST] ", "%5D"]


def rows_of(seed):
    r = random.Random(seed)
    roles = ["user", "assistant", "assistant", "system", "to]ol%[", None, ""]
    out = []
    for conv in [None, *range(12)]:
        for turn in range(r.randint(1, 9)):
            out.append((conv, r.choice([turn, 3]), r.choice(roles), "".join(filter(None, r.choices(NASTY, k=r.randint(1, 3)))) if r.random() < 0.9 else None, "x"))
    return [*out, out[4]]


@pytest.mark.parametrize("seed", range(3))
def test_read_back(spark, seed):
    rows = rows_of(seed)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv string")
    want = set()
    groups = defaultdict(list)
    for c, t, r, x, _ in rows:
        groups[c].append((t, r or "", x or ""))
    for c, g in groups.items():
        g.sort(key=lambda v: (v[0], v[1].encode(), v[2].encode()))
        loss = "".join(x for _, r, x in g if r == "assistant")
        want.add((c, len(g), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in g).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = C.read_back(frame).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    whole = {r.conv_id: r for r in C.formatted(frame).collect()}
    for r in got:
        w = whole[r.conv_id]
        assert len(w.formatted) == r.formatted_chars
        assert hashlib.sha256("".join(C.unescape(w.formatted[s.start : s.end]) for s in w.generated).encode()).hexdigest() == r.loss_sha256
        for cut in (1, 7, 100):
            reader = C.Reader()
            turns = [t for k in range(0, min(len(w.formatted), 5000), cut) for t in reader.feed(w.formatted[k : min(k + cut, 5000)])]
            reader = C.Reader()
            assert turns == reader.feed(w.formatted[:5000])


def test_empty(spark):
    assert C.read_back(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_compiler():
    render = lambda t, m=(): "".join(x for x, _ in C.compiled(t)(m))
    assert render("a{{ 'b' + 'c' | upper }}{% if 1 == 2 %}x{% elif not false %}y{% else %}z{% endif %}") == "abCy"
    assert C.fold_body(C.parse("a{{ 'b' + 'c' }}{% if 1 == 1 %}d{% endif %}")) == (C.Output(C.Const("abcd")),)
    assert render("{% for m in messages %}{{ m.a }}{{ m.missing }},{% endfor %}", [{"a": 1}, {"a": None}]) == "1,,"
    assert list(C.compiled("x{% generation %}y{% endgeneration %}")(())) == [("x", False), ("y", True)]
    for bad in ("{% for x %}{% endfor %}", "{{ a.__class__ }}", "{{ f(x) }}", "{{ a | eval }}", "{% if a %}", "{% import os %}", "{{ }}", "{{ 'a' 'b' }}", "{% endif %}", "{{ (a }}", "{{ a[0] }}"):
        with pytest.raises(C.TemplateError):
            C.compiled(bad)
