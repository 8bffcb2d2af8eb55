"""URL filters: rules by host and path, and a blocked Bloom filter in front of an exact join, in built-in functions only.

The filter is a table of blocks of eight longs. Every listed URL sets one bit in each long of its block; a page's URL
is a possible hit when all of its eight bits are set. Possible hits alone go on to a hash join with the list, which
removes false positives; all others are decided by the filter. The filter is broadcast only while its size,
known from the count of the list, stays under ``broadcast_bytes``; beyond that pages are joined with it by block.

Cases: null and malformed URLs (no ``://``) have an empty host and path, fit no rule and are never listed; an empty
list lists nothing; repeated pages and repeated entries of the list give one row per page; other columns of the pages are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Host and path prefix, and what they say; the longest that fits wins.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
WORDS = 8
#: Listed URLs for each block of 512 bits; 32 gives about 16 bits a URL.
PER_BLOCK = 32
BROADCAST_BYTES = 64 << 20
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)="


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), "^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default ports, path without a last slash, and the query sorted, without tracking; null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^www\\.", ""), ":(80|443)$", "")
    query = F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), "^[^?#]*\\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    tail = F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/+$", ""), tail))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; nulls where none fits."""
    text = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(v)).otherwise(verdict)
    return text, verdict



def hashed(df: DataFrame, blocks: int) -> DataFrame:
    return df.withColumns({"_block": F.pmod(F.xxhash64("_url"), F.lit(blocks)), "_g": F.xxhash64("_url", F.lit(1))})


def bloom_blocks(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7) of the URLs in column ``_url``; blocks without any are missing."""
    return hashed(listed, blocks).groupBy("_block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_g, {6 * k}) & 63 as int))")).alias(f"_w{k}") for k in range(WORDS)])


def judge(pages: DataFrame, listed: DataFrame, *, page_id: str = "page_id", url: str = "url", listed_url: str = "url", rules=RULES, per_block: int = PER_BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: its id, host, path, rule, ``listed`` (by the exact join) and verdict: the rule's, else block for listed URLs and allow for others."""
    named = listed.select(canonical(F.col(listed_url)).alias("_url")).where("_url IS NOT NULL").distinct()
    blocks = max(1, -(-named.count() // per_block))
    bloom = bloom_blocks(named, blocks)
    small = blocks * 8 * (WORDS + 1) <= broadcast_bytes
    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_raw"))
    rows = rows.select("_id", host_of(F.col("_raw")).alias("host"), path_of(F.col("_raw")).alias("path"), canonical(F.col("_raw")).alias("_url"))
    rows = hashed(rows, blocks).join(F.broadcast(bloom) if small else bloom, "_block", "left")
    hit = F.lit(True)
    for k in range(WORDS):
        hit = hit & F.expr(f"shiftrightunsigned(_w{k}, cast(shiftrightunsigned(_g, {6 * k}) & 63 as int)) & 1 = 1")
    rows = rows.withColumn("_maybe", F.coalesce(hit & F.col("_url").isNotNull(), F.lit(False))).select("_id", "host", "path", "_url", "_maybe")
    sure = rows.where(~F.col("_maybe")).select("_id", "host", "path", F.lit(False).alias("listed"))
    exact = rows.where("_maybe").join(named.select("_url", F.lit(True).alias("_in")), "_url", "left").select("_id", "host", "path", F.coalesce("_in", F.lit(False)).alias("listed"))
    text, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return sure.unionByName(exact).select(F.col("_id").alias(page_id), "host", "path", text.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise("allow")).alias("verdict"), "listed")
