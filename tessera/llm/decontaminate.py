"""Benchmark decontamination with suffix arrays over shards of the training texts.

Every task turns its documents into shards of about ``SHARD_WORDS`` words. A shard's suffix array holds the
word positions that can begin a match at all (their first words begin some test window; the others share
less than a window with every test text, so leaving them out loses nothing). Every test window is binary-searched in that
array; the equal ranges give all its occurrences, and the longest verbatim match at each occurrence comes
from the sorted test suffixes. There is no shuffle: a document never leaves its task. Test texts beyond ``BLOCK_BYTES`` are searched
block by block, with the same results.

A window is ``window`` consecutive words of an item, or the whole item when that is shorter. Cases: null and
empty texts have no words and no hits; items without words have no window; repeated items and repeated
documents give a row each, items are listed once by id (a null id marks words but is not listed); of equally long
matches the first in the document counts, then the one of the least id, null last; very long texts are a shard of their own; empty
tables give empty results; other columns of the inputs are not looked at, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stored, words_of

WINDOW = 10
#: Words after which a shard is closed; a longer document is a shard of its own.
SHARD_WORDS = 1 << 20
#: Bytes of test texts that are indexed and sent to the executors at once; more are searched in blocks.
BLOCK_BYTES = 32 << 20

HITS = "n_words long, n_hit long, spans array<struct<start:long,end:long>>, items array<string>, longest struct<length:long,position:long,item:string,item_position:long>"


class TestIndex:
    """Word ids, windows and sorted suffixes of one block of test texts."""

    __test__ = False

    def __init__(self, items: list[tuple[object, bytes | None]], window: int):
        texts = [(None if i is None else str(i), w) for i, t in items if (w := words_of(t))]
        self.window = window
        self.vocabulary = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for _, ws in texts for w in ws))}
        self.bits = max(2, len(self.vocabulary).bit_length())
        self.pack = max(1, min(window, 62 // self.bits))
        self.names = [i for i, _ in texts]
        self.ids = np.zeros(sum(len(ws) + 1 for _, ws in texts), np.int64)
        owner, place, size = (np.zeros(len(self.ids), np.int64) for _ in range(3))
        at = 0
        for k, (_, ws) in enumerate(texts):
            s = slice(at, at + len(ws))
            self.ids[s], owner[s], place[s], size[s] = [self.vocabulary[w] for w in ws], k, np.arange(len(ws)), len(ws)
            at += len(ws) + 1
        self.owner, self.place = owner, place
        self.depth = max((len(ws) for _, ws in texts), default=0)
        self.keys = packed(self.ids, self.bits, self.pack)
        starts = np.flatnonzero((self.ids > 0) & ((place + window <= size) | (place == 0)))
        lengths = np.minimum(window, size[starts])
        #: By window length: one start for each different window, and the items that have it.
        self.windows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.filters: list[tuple[int, np.ndarray, np.ndarray]] = []
        for length in np.unique(lengths):
            own = starts[lengths == length]
            rows = np.stack([self.ids[own + k] for k in range(length)], 1)
            _, first, kind = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([kind.reshape(-1), owner[own]], 1), axis=0)
            self.windows.append((int(length), own[first], np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), pairs[:, 1]))
            n = min(int(length), self.pack)
            keys = np.unique(self.keys[own[first]] >> np.int64(self.bits * (self.pack - n)))
            seen = np.zeros(1 << 20, bool)
            seen[slot(keys)] = True
            self.filters.append((n, keys, seen))
        self.suffixes = suffix_order(self.keys, np.flatnonzero(self.ids > 0), self.bits, self.pack, self.depth)


def packed(ids: np.ndarray, bits: int, pack: int) -> np.ndarray:
    """``pack`` word ids from each position on in one integer that orders like them; a zero ends each text."""
    keys, padded, alive = np.zeros(len(ids), np.int64), np.concatenate([ids, np.zeros(pack, ids.dtype)]), np.ones(len(ids), bool)
    for k in range(pack):
        step = padded[k : k + len(ids)]
        alive &= step > 0
        keys = (keys << bits) | np.where(alive, step, 0)
    return keys


def slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def at(keys: np.ndarray, position: np.ndarray) -> np.ndarray:
    return np.where(position < len(keys), keys[np.minimum(position, len(keys) - 1)], 0) if len(keys) else np.zeros(len(position), np.int64)


def suffix_order(keys: np.ndarray, starts: np.ndarray, bits: int, pack: int, depth: int) -> np.ndarray:
    """``starts`` sorted by their suffixes' first ``depth`` words: blocks of words at a time, each for what still ties."""
    order = starts[np.argsort(keys[starts], kind="stable")]
    group = np.concatenate([[0], np.cumsum(np.diff(keys[order]) != 0)]) if len(order) else np.zeros(0, np.int64)
    last = np.int64((1 << bits) - 1)  # of a key, its last word
    for done in range(pack, depth, pack):
        if not len(order):
            break
        tied = np.flatnonzero((np.bincount(group)[group] > 1) & (at(keys, order + done - pack) & last > 0))
        if not len(tied):
            break
        k = at(keys, order[tied] + done)
        by = np.lexsort((k, group[tied]))
        order[tied], k = order[tied][by], k[by]
        fresh = np.zeros(len(order), bool)
        fresh[tied[1:]] = (np.diff(k) != 0) & (np.diff(group[tied]) == 0)
        group = np.cumsum(np.concatenate([[False], np.diff(group) != 0]) | fresh)
    return order


def compare(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, bits: int, pack: int, length: int) -> np.ndarray:
    """Sign of suffix i of a against suffix j of b, by their first ``length`` words."""
    sign, open_ = np.zeros(len(i), np.int8), np.arange(len(i))
    for done in range(0, length, pack):
        x, y = at(a, i[open_] + done), at(b, j[open_] + done)
        if length - done < pack:
            x, y = x >> np.int64(bits * (pack - length + done)), y >> np.int64(bits * (pack - length + done))
        sign[open_] = np.sign(x - y)
        open_ = open_[(x == y) & (x & np.int64((1 << bits) - 1) > 0)]
        if not len(open_):
            break
    return sign


def search(keys: np.ndarray, order: np.ndarray, test_keys: np.ndarray, test: np.ndarray, bits: int, pack: int, length: int, after: bool) -> np.ndarray:
    """Binary search of each test suffix in the suffix array, by ``length`` words: the first entry not below it, or ``after`` its equals."""
    low, high = np.zeros(len(test), np.int64), np.full(len(test), len(order), np.int64)
    while (go := np.flatnonzero(low < high)).size:
        mid = (low[go] + high[go]) // 2
        sign = compare(keys, order[mid], test_keys, test[go], bits, pack, length)
        right = sign <= 0 if after else sign < 0
        low[go] = np.where(right, mid + 1, low[go])
        high[go] = np.where(right, high[go], mid)
    return low


def shared_length(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, depth: int) -> np.ndarray:
    out, open_ = np.zeros(len(i), np.int64), np.arange(len(i))
    for k in range(depth):
        x = at(a, i[open_] + k)
        open_ = open_[(x > 0) & (x == at(b, j[open_] + k))]
        if not len(open_):
            break
        out[open_] += 1
    return out


def shard_hits(test: TestIndex, ids: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict[int, dict]]:
    """Of a shard of documents that begin at ``first``: the words that are hit, and by document its spans, items and longest match."""
    hit = np.zeros(len(ids), bool)
    found: dict[int, dict] = {}
    if not test.windows or not len(ids):
        return hit, found
    keys = packed(ids, test.bits, test.pack)
    some = np.zeros(len(ids), bool)
    for n, known, seen in test.filters:
        k = keys >> np.int64(test.bits * (test.pack - n))
        maybe = np.flatnonzero(seen[slot(k)])
        some[maybe[known[np.minimum(np.searchsorted(known, k[maybe]), len(known) - 1)] == k[maybe]]] = True
    order = suffix_order(keys, np.flatnonzero(some), test.bits, test.pack, test.depth)
    cover = np.zeros(len(ids) + 1, np.int64)
    pairs, whole, short = [], [], []
    for length, own, bounds, items in test.windows:
        low = search(keys, order, test.keys, own, test.bits, test.pack, length, False)
        high = search(keys, order, test.keys, own, test.bits, test.pack, length, True)
        n = high - low
        kind = np.repeat(np.arange(len(own)), n)
        p = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        np.add.at(cover, p, 1)
        np.add.at(cover, p + length, -1)
        whole.append(p if length == test.window else p[:0])
        if length < test.window:
            short.append(np.stack([np.full(len(p), length), p, kind], 1))
        seen_in = np.unique(np.stack([np.searchsorted(first, p, "right") - 1, kind], 1), axis=0)
        m = bounds[seen_in[:, 1] + 1] - bounds[seen_in[:, 1]]
        which = items[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(bounds[seen_in[:, 1]], m)]
        pairs.append(np.stack([np.repeat(seen_in[:, 0], m), which], 1))
    hit = np.cumsum(cover[:-1]) > 0
    if not hit.any():
        return hit, found
    # The longest match of an item that has a window there. From a whole window on, it is the better neighbour of its place among the sorted
    # test suffixes; an item below a window matches with all its words. So it doesn't matter which items make up a block.
    p = np.unique(np.concatenate(whole))
    where = search(test.keys, test.suffixes, keys, p, test.bits, test.pack, test.depth, False)
    best, near_ = np.zeros(len(p), np.int64), where
    for near in (where - 1, where):
        at_ = np.clip(near, 0, len(test.suffixes) - 1)
        n = shared_length(ids, p, test.ids, test.suffixes[at_], test.depth)
        near_, best = np.where(n > best, at_, near_), np.maximum(n, best)
    few = np.concatenate([*short, np.zeros((0, 3), np.int64)])
    p, best = np.concatenate([p, few[:, 1]]), np.concatenate([best, few[:, 0]])
    kind = np.concatenate([np.full(len(near_), -1), few[:, 2]])
    near_ = np.concatenate([near_, np.zeros(len(few), np.int64)])
    document = np.searchsorted(first, p, "right") - 1
    lead = np.lexsort((p, -best, document))
    lead = lead[np.concatenate([[True], np.diff(document[lead]) != 0])]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    span_of = np.searchsorted(first, edges[::2], "right") - 1
    pairs = np.unique(np.concatenate(pairs), axis=0)
    for k in lead:
        d = int(document[k])
        a, b = np.searchsorted(span_of, [d, d + 1])
        i, j = np.searchsorted(pairs[:, 0], [d, d + 1])
        found[d] = {
            "spans": [{"start": int(x - first[d]), "end": int(y - first[d])} for x, y in zip(edges[::2][a:b], edges[1::2][a:b])],
            "items": sorted({n for t in pairs[i:j, 1] if (n := test.names[t]) is not None}),
            "longest": {"length": int(best[k]), "position": int(p[k] - first[d])} | source(test, ids, int(p[k]), int(best[k]), int(near_[k]), int(kind[k])),
        }
    return hit, found


def source(test: TestIndex, ids: np.ndarray, p: int, length: int, near: int, kind: int) -> dict:
    """Of the items that match ``length`` words from p on, the one with the least id (null last), and the least place in it."""
    if kind >= 0:
        _, _, bounds, items = next(w for w in test.windows if w[0] == length)
        return {"item": least(test.names[k] for k in items[bounds[kind] : bounds[kind + 1]]), "item_position": 0}
    same = lambda k: shared_length(ids, np.array([p]), test.ids, test.suffixes[k : k + 1], length)[0] == length
    low = high = near
    while low > 0 and same(low - 1):
        low -= 1
    while high + 1 < len(test.suffixes) and same(high + 1):
        high += 1
    found = [(test.names[test.owner[s]], int(test.place[s])) for s in test.suffixes[low : high + 1]]
    name = least(x for x, _ in found)
    return {"item": name, "item_position": min(at for x, at in found if x == name)}


def least(names: Iterator[str | None]) -> str | None:
    return min(names, key=lambda x: (x is None, x))


def scanned(batches: Iterator[pa.RecordBatch], test: TestIndex, text: str, shard_words: int) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    """Each batch with a dict of HITS for each of its rows; batches wait until their shard is full."""
    get = test.vocabulary.get
    waiting: list[pa.RecordBatch] = []
    parts: list[np.ndarray] = []
    total = 0

    def flush():
        sizes = np.array([len(x) - 1 for x in parts], np.int64)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        hit, found = shard_hits(test, ids, first, sizes)
        n_hit = np.add.reduceat(hit, first) if len(ids) else sizes
        rows = [{"n_words": int(n), "n_hit": int(h), **found.get(k, {"spans": [], "items": [], "longest": None})} for k, (n, h) in enumerate(zip(sizes, n_hit.astype(np.int64)))]
        done = 0
        for b in waiting:
            yield b, rows[done : done + b.num_rows]
            done += b.num_rows

    for batch in batches:
        waiting.append(batch)
        for data in batch.column(text).cast(pa.binary()).to_pylist():
            ws = words_of(data)
            ids = np.zeros(len(ws) + 1, np.int64)
            ids[:-1] = [get(w, 0) for w in ws]
            parts.append(ids)
            total += len(ws)
        if total >= shard_words:
            yield from flush()
            waiting, parts, total = [], [], 0
    if waiting:
        yield from flush()


def test_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> list[TestIndex]:
    """The test texts as indexes of at most about ``block_bytes`` of text each; their number follows from the summed size."""
    items = benchmark.select(F.col(item_id).alias("i"), F.encode(F.col(text), "utf-8").alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    if n == 1:
        return [TestIndex([(r.i, bytes(r.t)) for r in items.collect()], window)]
    dealt = items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    return (TestIndex([(r.i, bytes(r.t)) for r in dealt.where(F.col("b") == k).collect()], window) for k in range(n))


def find_matches(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its id, n_words, n_hit, spans of hit words, items with occurring windows, and the longest verbatim match with its places."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = None
    blocks = test_blocks(benchmark, item_id, item_text, window, block_bytes)
    for k, block in enumerate(blocks):
        sent = spark.sparkContext.broadcast(block)
        out = rows.mapInArrow(lambda it, sent=sent: hit_rows(it, sent.value, shard_words, False), f"id {kind}, {HITS}") if k == 0 and isinstance(blocks, list) else stored(
            (rows if k == 0 else out).mapInArrow(lambda it, sent=sent, k=k: hit_rows(it, sent.value, shard_words, True, k > 0), f"id {kind}, text string, {HITS}"), "decontaminate")
    return out.drop("text").withColumnRenamed("id", doc_id)


def hit_rows(batches: Iterator[pa.RecordBatch], test: TestIndex, shard_words: int, keep_text: bool, merge: bool = False) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    longest = pa.struct([("length", pa.int64()), ("position", pa.int64()), ("item", pa.string()), ("item_position", pa.int64())])
    for batch, rows in scanned(batches, test, "text", shard_words):
        if merge:
            rows = [merged(a, b) for a, b in zip(batch.select(["n_words", "n_hit", "spans", "items", "longest"]).to_pylist(), rows)]
        columns = {"id": batch.column("id")} | ({"text": batch.column("text")} if keep_text else {})
        for name, t in (("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", span), ("items", pa.list_(pa.string())), ("longest", longest)):
            columns[name] = pa.array([r[name] for r in rows], t)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def merged(a: dict, b: dict) -> dict:
    """What two blocks of test texts found in one document."""
    spans: list[dict] = []
    for s in sorted(a["spans"] + b["spans"], key=lambda s: (s["start"], s["end"])):
        if spans and s["start"] <= spans[-1]["end"]:
            spans[-1] = {"start": spans[-1]["start"], "end": max(spans[-1]["end"], s["end"])}
        else:
            spans.append(s)
    rank = lambda x: (-x["length"], x["position"], x["item"] is None, x["item"], x["item_position"])
    longest = min((x["longest"] for x in (a, b) if x["longest"]), key=rank, default=None)
    return {"n_words": a["n_words"], "n_hit": sum(s["end"] - s["start"] for s in spans), "spans": spans, "items": sorted({*a["items"], *b["items"]}), "longest": longest}


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with no hit word, all their columns as they were."""
    spark = docs.sparkSession
    bound_batches(spark)
    out = docs
    for test in test_blocks(benchmark, item_id, item_text, window, block_bytes):
        sent = spark.sparkContext.broadcast(test)

        def clean(batches, sent=sent):
            for batch, rows in scanned(batches, sent.value, text, shard_words):
                yield batch.filter(pa.array([not r["n_hit"] for r in rows], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
