import struct
from collections import defaultdict

import pytest
import xxhash

from tessera.llm import sharding as H
from tests.llm.data import docs


def check(rows, want, limit):
    assert sorted((str(r.doc_id), r.bytes) for r in rows) == sorted((str(i), len((t or "").encode())) for i, t in want)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    names = sorted(shards)
    for a, b in zip(names, names[1:]):
        assert not b.startswith(a)  # no shard is part of another
    total = defaultdict(int)
    for name, own in shards.items():
        size = sum(r.bytes for r in own)
        assert {(r.shard_bytes, r.shard_docs, r.depth, r.oversized) for r in own} == {(size, len(own), len(name), size > limit)}
        assert size <= limit or len(own) == 1
        for k in range(len(name)):
            total[name[:k]] += size
    assert all(size > limit for size in total.values())  # only what was too large is split


@pytest.mark.parametrize("limit", [300, 5_000, 200_000, 1 << 30])
def test_shards(spark, limit):
    frame, rows = docs(spark)
    check(H.assign(frame.repartition(3), shard_bytes=limit).collect(), [(x[0], x[1]) for x in rows], limit)


def test_hot_id(spark):
    rows = [(1, "x" * 10)] * 300 + [(None, "y" * 10)] * 50 + [(k, "z" * 10) for k in range(2, 300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    check(H.assign(frame, shard_bytes=100).collect(), rows, 100)


@pytest.mark.parametrize("limit", [40, 700, 20_000])
def test_assignment_as_brute_force(spark, limit):
    """Unique ids: the directory splits a prefix of the id's hash while its documents are above the limit."""
    rows = [(k * k, "x" * (k % 37)) for k in range(400)]

    def split(own, depth):
        if sum(n for _, _, n in own) <= limit or len(own) <= 1:
            return {i: (bits[:depth], depth) for i, bits, _ in own}
        return split([x for x in own if x[1][depth] == "0"], depth + 1) | split([x for x in own if x[1][depth] == "1"], depth + 1)

    want = split([(i, f"{xxhash.xxh64(struct.pack('<q', i), seed=42).intdigest():064b}", len(t)) for i, t in rows], 0)
    got = H.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), shard_bytes=limit).collect()
    assert {r.doc_id: (r.shard, r.depth) for r in got} == want


def test_written_with_clashing_columns(spark, tmp_path):
    rows = [(k, "x" * 50, k, "a") for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard long, placed_id string")
    placed = H.write_shards(frame, f"{tmp_path}/out", shard_bytes=400)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select("doc_id", "text", "shard", "placed_id").collect())) == rows
    assert {(r.doc_id, r["_shard"]) for r in back.collect()} == {(r.doc_id, f"s{r.shard}") for r in placed.collect()}


def test_written(spark, tmp_path):
    frame, rows = docs(spark)
    frame = frame.dropDuplicates(["doc_id"])
    placed = H.write_shards(frame, f"{tmp_path}/out", shard_bytes=5_000)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == frame.count() and back.select("shard").distinct().count() == placed.select("shard").distinct().count()
    assert H.assign(frame.limit(0)).count() == 0
