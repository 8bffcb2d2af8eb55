import pytest

from tessera.llm import urls as U

URLS = [
    "http://a.Example.COM/en/7?x=1", "https://example.com/en/8", "http://notexample.com/en/1", "http://com/en/", "ftp://example.net/de/81#x", "http://x.example.net/de/9", "https://x.org/es/a", "https://org/fr",
    "no scheme", "", None, "http://", "://h/p", "http://h?q", "http://u@h:80/a/?b=2&a=1&utm_source=z", "https://www.h2.io/a/#f", "x://a://b/c", "http://É.com/en/x\ny", "http://ÉA.com/en/x\ny", "http://dup.io/1", "http://dup.io/1",
]


def parse(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fit = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_judge(spark, limit):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)] + [(None, "http://dup.io/1", None)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("https://dup.io/1/?ref=a",), ("http://h/a?a=1&b=2",), ("https://u@h/a?a=1&b=2",), ("http://h2.io/a",), (None,), ("",), ("http://example.com/en/8",)], "url string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, listed, broadcast_bytes=limit).collect()}
    blocked = {14, 15, 19, 20, None}
    want = set()
    for k, u in [*enumerate(URLS), (None, "http://dup.io/1")]:
        h, p = parse(u)
        r, v = rule(h, p)
        # the port keeps its user name, so only the listed URL with u@ matches
        want.add((k, h, p, r, v or ("block" if k in blocked else "allow")))
    assert got == want


def test_filter_has_no_false_negatives_and_exact_join(spark):
    pages = spark.range(20_000).selectExpr("id AS page_id", "concat('http://s', id % 50, '.io/p/', id) AS url")
    out = U.judge(pages, pages.where("page_id % 7 = 0"), per_block=200)  # too full a filter: many false positives
    assert out.count() == 20_000
    assert out.where("(verdict = 'block') <> (page_id % 7 = 0)").count() == 0


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a/b")], "page_id long, url string")
    assert [r.verdict for r in U.judge(pages, pages.limit(0)).collect()] == ["allow"]
    assert U.judge(pages.limit(0), pages).count() == 0
