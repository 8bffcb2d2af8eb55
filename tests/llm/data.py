"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, spans int, _id int, failed string"


def texts(seed: int = 7, n: int = 60) -> list[str]:
    r = random.Random(seed)
    vocabulary = ["the", "of", "Ñandú", "été", "a1", "über", "Zed", "x", "ten", "to", "日本", "no", "if", "we", "go"]
    out = []
    for k in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 5, 12, 60, 200]))]
        out.append("".join(w + r.choice([" ", "  ", "\n", ", ", ".\n", "-"]) for w in words))
    return out


def docs(spark, more: list[str | None] = (), seed: int = 7, n: int = 60):
    ts = [*texts(seed, n), *more, None, "", " \n\t ", "one", "one", "long " * 30_000]
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else "s", len(t or ""), "x", k, k, None) for k, t in enumerate(ts)]
    rows += [rows[3], (None, "null id of a text", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS), rows
