"""Sharding by extendible hashing, in built-in functions.

A shard is a prefix of the hash bits of the document's id. Bytes are summed once by a prefix that is long enough for most
shards; the directory takes, for each of those prefixes, the shortest one whose documents fit the limit. Only what is still too large
is split on further bits, of the id's hash and then of a second hash that tells rows of one id apart, so a
repeated id can't hold a shard above its limit. The directory grows with bytes over limit and is joined as a table.

Cases: a null text has no bytes; null and repeated ids hash alike and are split by the second hash; a document above the limit gets a shard of its
own, marked oversized; an empty table has an empty result; only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SHARD_BYTES = 16 << 20
#: Bits that a round looks at after the first.
STEP = 8


def bits_at(offset: Column, n: int) -> Column:
    """``n`` bits of the two hashes from a bit offset, a multiple of 8, on."""
    return F.when(offset < 64, F.expr(f"shiftrightunsigned(shiftleft(h1, cast(offset as int)), {64 - n})")).otherwise(F.expr(f"shiftrightunsigned(shiftleft(h2, cast(offset - 64 as int)), {64 - n})"))


def bit_string(value: str, n: str) -> Column:
    return F.expr(f"CASE WHEN {n} = 0 THEN '' ELSE lpad(bin({value}), cast({n} AS int), '0') END")


def assign(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: its id, bytes, shard (a string of bits), depth, the shard's bytes and documents, and oversized."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("bytes"), F.xxhash64(F.col(doc_id)).alias("h1"), F.xxhash64(F.monotonically_increasing_id(), F.lit(2)).alias("h2"))
    rows = stored(rows, "rows")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    n = min(24, 8 * math.ceil((math.log2(max(1, total / shard_bytes)) + 4) / 8))
    todo, least, done = rows.select("*", F.lit("").alias("label"), F.lit(0).alias("offset")), 0, []
    while True:
        todo = todo.withColumn("p", bits_at(F.col("offset"), n))
        counts = todo.groupBy("label", "offset", "p").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"), F.min("h1").alias("low"), F.max("h1").alias("high"))
        counts = stored(counts, "counts")
        tree = counts.select("label", "offset", "bytes", "docs", F.explode(F.sequence(F.lit(least), F.lit(n))).alias("d"), "p").withColumn("q", F.expr(f"CASE WHEN d = 0 THEN 0L ELSE shiftright(p, {n} - d) END"))
        fit = tree.groupBy("label", "offset", "d", "q").agg(F.sum("bytes").alias("b"), F.sum("docs").alias("k")).where(f"b <= {shard_bytes} OR k = 1 OR (offset + d >= 128)")
        fit = stored(fit.select("label", "d", "q"), "fit")
        # The shards are what fits while the prefix that is a bit shorter doesn't; each counted prefix lies in one at most.
        above = fit.select("label", (F.col("d") + 1).alias("d"), F.col("q").alias("_q"))
        on = (fit["label"] == above["label"]) & (fit["d"] == above["d"]) & (F.shiftright(fit["q"], 1) == above["_q"])
        shards = stored(fit.join(above, on, "left_anti"), "shards")
        # Only between their least and greatest depth prefixes are looked up, so no key has more of them than lie below a shard of the least depth.
        low, high = shards.agg(F.min("d"), F.max("d")).first()
        fit = tree.where(F.col("d").between(low, high) if low is not None else F.lit(False)).join(shards, ["label", "d", "q"]).select("label", "p", "d")
        directory = stored(counts.join(fit, ["label", "p"], "left").select("label", "p", "d", "low", "high"), "directory")
        found = todo.join(directory, ["label", "p"])
        shard = F.concat("label", bit_string(f"CASE WHEN d = 0 THEN 0L ELSE shiftright(p, {n} - d) END", "d"))
        done.append(found.where("d IS NOT NULL").select("id", "bytes", shard.alias("shard")))
        if directory.where("d IS NULL").isEmpty():
            break
        # Where all hashes of a bucket are one, its other bits split nothing: go on with the second hash.
        same = (F.col("low") == F.col("high")) & (F.col("offset") < 64)
        rest = found.where("d IS NULL").withColumn("same", same)
        label = F.when(F.col("same"), F.concat(F.expr("substring(label, 1, 0)"), F.lpad(F.expr("bin(h1)"), 64, "0"))).otherwise(F.concat("label", bit_string("p", str(n))))
        todo = stored(rest.select("id", "bytes", "h1", "h2", label.alias("label"), F.when(F.col("same"), F.lit(64)).otherwise(F.col("offset") + n).alias("offset")), "todo")
        n, least = STEP, 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    out = stored(out, "assigned")
    sizes = stored(out.groupBy("shard").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_docs")), "sizes")
    return out.join(sizes, "shard").select(F.col("id").alias(doc_id), "bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > shard_bytes).alias("oversized"))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of the documents has."""
    while name.lower() in map(str.lower, docs.columns):
        name = f"_{name}"
    return name


def write_shards(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes a folder ``shard=<bits>`` for each shard, for documents with ids that are unique; returns the assignment. A task takes whole shards, each within its limit.
    Where the documents have a column ``shard`` the folders are named ``_shard=<bits>``."""
    placed = stored(assign(docs, doc_id=doc_id, text=text, shard_bytes=shard_bytes), "placed")
    own, shard = free_name(docs, "placed_id"), free_name(docs, "shard")
    where = placed.select(F.col(doc_id).alias(own), F.concat(F.lit("s"), "shard").alias(shard))
    out = docs.join(where, docs[doc_id].eqNullSafe(where[own])).drop(own)
    out.repartition(shard).sortWithinPartitions(shard).write.partitionBy(shard).parquet(path)
    return placed
