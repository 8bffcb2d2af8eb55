"""Substring dedup: paragraphs that many documents share, found by MinHash bands, verified, clustered and removed.

Shared passages need not begin at a line, so paragraphs are cut by content: of every ``WINDOW`` places the one with the
least hash of its next words begins a paragraph of ``WINDOW`` words. Two documents that share 2 * WINDOW - 1 words or more
so share a paragraph, wherever the passage stands. Paragraphs with a band in common are verified by the exact Jaccard
of their 5-word shingles (0.8 or more) and clustered by components; of each cluster that spans documents the first
document keeps its text, in all others those words are repeats.

First the buckets alone are counted, pre-aggregated; a Bloom filter of those that span documents (sent to the executors up to a size
limit, left out beyond it) then leaves few paragraphs to shuffle with their contents. Equal paragraphs are one node.

Cases: null texts and texts of fewer than WINDOW words have no paragraphs; very long texts are cut whole; a
document is its id and text, so repeated rows are one document and none is a repeat of the other; ties go to the least id;
empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .common import bound_batches, step, stored
from .components import linked
from .urls import BROADCAST_BYTES

WINDOW = 26
ROWS = 2
RECALL = 0.98
N_BANDS = S.tuned_bands(ROWS, S.THRESHOLD, RECALL)
U = S.U
LAST = U(0xFFFFFFFFFFFFFFFF)


def sliding(x: np.ndarray, n: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each n neighbours from each place on."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = pick(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(grams: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Places that are the least of some ``window`` neighbours; ``grams`` holds texts of ``sizes`` places with window - 1 pads of LAST after each."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    low = sliding(grams, window, np.minimum)
    # Windows inside one text; a shorter text is one window.
    begin = np.cumsum(sizes + window - 1) - sizes - window + 1
    inside = np.zeros(len(low) + 1, np.int64)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + np.maximum(1, sizes - window + 1), -1)
    low = np.where(np.cumsum(inside)[: len(low)] > 0, low, U(0))
    best = sliding(np.concatenate([np.zeros(window - 1, U), low, np.zeros(window - 1, U)]), window, np.maximum)
    return np.flatnonzero((best[: len(grams)] == grams) & (grams != LAST))


def paragraphs(texts: list[bytes | None], contents: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, bands, key, shingles) of the paragraphs of a batch; key and shingles are of 16 bytes and of 32-bit hashes."""
    words = [S.word_hashes(t) for t in texts]
    sizes = np.array([max(0, len(w) - WINDOW + 1) for w in words], np.int64)
    n = WINDOW - S.SHINGLE + 1
    full = [k for k in range(len(words)) if sizes[k]]
    if not full:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros((0, N_BANDS), np.int64), np.zeros((0, 16), np.uint8), np.zeros((0, n), np.int32)
    # Texts one after the other: a text's places, then pads up to its last words.
    whole = np.concatenate([words[k] for k in full])
    grams = S.mix(whole * U(3) + np.roll(whole, -1) * U(0x9E3779B97F4A7C15) + np.roll(whole, -2) * U(0xD6E8FEB86659FD93))
    grams = np.minimum(grams, LAST - U(1))
    length = np.array([len(words[k]) for k in full])
    begin = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(full)), length)
    place = np.arange(len(whole)) - begin[owner]
    grams[place >= sizes[full][owner]] = LAST
    at = anchors(grams, sizes[full], WINDOW)
    shingles = np.zeros(len(whole), U)
    for k in range(S.SHINGLE):
        shingles = shingles * U(0x9E3779B97F4A7C15) + np.roll(whole, -k)
    sets = S.mix(shingles)[at[:, None] + np.arange(n)]
    low = np.stack([(sets * U(2 * k + 3) + S.mix(np.array([k + 1], U))).min(1) for k in range(ROWS * N_BANDS)], 1) if len(at) else np.zeros((0, ROWS * N_BANDS), U)
    bands = S.bands(low, ROWS)
    text, place_ = owner[at], place[at]
    keep = thinned(text, place_, whole[at[:, None] + np.arange(WINDOW)])
    at, text, place_, bands, sets = at[keep], text[keep], place_[keep], bands[keep], sets[keep]
    key = np.zeros((len(at), 2), U)
    if contents:
        for k in range(WINDOW):
            w = whole[at + k]
            key[:, 0], key[:, 1] = S.mix(key[:, 0] * U(0x9E3779B97F4A7C15) + w), S.mix(key[:, 1] * U(0xD6E8FEB86659FD93) + w + U(1))
    return np.array(full)[text], place_, bands, key.view(np.uint8).reshape(-1, 16), (sets >> U(32)).astype(np.uint32).view(np.int32)


def thinned(text: np.ndarray, at: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of neighbours with equal words in one text, as in "la la la", those that begin another WINDOW words of their run: they cover the same words."""
    if not len(at):
        return np.zeros(0, bool)
    same = np.concatenate([[False], (np.diff(text) == 0) & (words[1:] == words[:-1]).all(1)])
    begin = at[np.maximum.accumulate(np.where(same, 0, np.arange(len(at))))]
    step = (at - begin) // WINDOW
    return ~same | np.concatenate([[True], step[1:] != step[:-1]])


BANDS = [f"b{k}" for k in range(N_BANDS)]
#: Keys that a task remembers to have sent with their contents.
SENT_KEYS = 1 << 20


def cut(docs: DataFrame) -> DataFrame:
    """(uid, b0..) of each paragraph of (id, uid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, _, buckets, _, _ = paragraphs(b.column("text").cast(pa.binary()).to_pylist(), False)
            yield pa.RecordBatch.from_arrays([b.column("uid").take(pa.array(text)), *band_arrays(buckets)], names=["uid", *BANDS])

    return docs.mapInArrow(run, f"uid long, {', '.join(f'{n} long' for n in BANDS)}")


def band_arrays(buckets: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(buckets[:, k])) for k in range(N_BANDS)]


class Bloom:
    """A Bloom filter of buckets in words of 64 bits, four bits for each in its word; without words it lets all pass."""

    def __init__(self, words: np.ndarray | None):
        self.words = words

    @staticmethod
    def mask_sql(bucket: str) -> str:
        return " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({bucket}, {6 * k}) & 63 as int))" for k in range(4))

    def maybe(self, buckets: np.ndarray) -> np.ndarray:
        if self.words is None:
            return np.ones(buckets.shape, bool)
        h = buckets.view(U)
        mask = np.zeros(buckets.shape, U)
        for k in range(4):
            mask |= U(1) << ((h >> U(6 * k)) & U(63))
        return (self.words[((h >> U(24)) % U(len(self.words))).astype(np.int64)] & mask) == mask


def bloom_of(buckets: DataFrame, broadcast_bytes: int) -> Bloom:
    """Built by words on the executors; it goes to them whole while its size, known from the count, is within the limit."""
    n = max(1, buckets.count() // 4)
    if n * 8 > broadcast_bytes:
        return Bloom(None)
    words = buckets.groupBy(F.pmod(F.shiftrightunsigned("bucket", 24), F.lit(n)).alias("w")).agg(F.bit_or(F.expr(Bloom.mask_sql("bucket"))).alias("m")).toArrow()
    out = np.zeros(n, U)
    out[words.column("w").to_numpy()] = words.column("m").to_numpy().view(U)
    return Bloom(out)


def cut_shared(docs: DataFrame, bloom: Bloom) -> DataFrame:
    """(id, uid, at, key) of the paragraphs that may share a bucket; with bands and shingles where the task sends a key for the first time."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            text, at, buckets, key, sets = paragraphs(b.column("text").cast(pa.binary()).to_pylist(), True)
            keep = sent.value.maybe(buckets).any(1) if len(at) else np.zeros(0, bool)
            text, at, buckets, key, sets = text[keep], at[keep], buckets[keep], key[keep], sets[keep]
            data = key.tobytes()
            keys = [data[k : k + 16] for k in range(0, len(data), 16)]
            again = np.zeros(len(keys), bool)
            for k, x in enumerate(keys):
                again[k] = x in seen
                seen.add(x)
            if len(seen) > SENT_KEYS:
                seen.clear()
            take, none = pa.array(text), pa.array(again)
            columns = [b.column("id").take(take), b.column("uid").take(take), pa.array(at), pa.array(keys, pa.binary())]
            columns += [pa.compute.if_else(none, None, x) for x in band_arrays(buckets)]
            columns.append(pa.array([None if a else x for a, x in zip(again, distinct(sets))], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "uid", "at", "key", *BANDS, "shingles"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, uid long, at long, key binary, {', '.join(f'{n} long' for n in BANDS)}, shingles binary")


def distinct(sets: np.ndarray) -> Iterator[bytes]:
    """Of each row of 32-bit hashes the sorted distinct ones."""
    rows = np.sort(sets.view(np.uint32), axis=1)
    single = (np.diff(rows, axis=1) != 0).all(1)
    for x, one in zip(rows, single):
        yield x.tobytes() if one else np.unique(x).tobytes()


@step
def repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: float = S.THRESHOLD, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(id, uid, spans, kept_in) of the documents with repeated words: ordered, disjoint spans (start, end) of words that earlier documents have, and the ids of those."""
    bound_batches(docs.sparkSession)
    named = docs.select(F.col(doc_id).alias("id"), uid_of(docs, doc_id, text).alias("uid"), F.col(text).alias("text"))
    counted = cut(named).select("uid", F.explode(F.array(*BANDS)).alias("bucket")).groupBy("bucket").agg(F.min("uid").alias("low"), F.max("uid").alias("high"))
    shared = stored(counted.where("low < high").select("bucket"), "shared")
    found = stored(cut_shared(named, bloom_of(shared, broadcast_bytes)), "paragraphs")
    nodes = stored(found.where("shingles IS NOT NULL").groupBy("key").agg(F.first("shingles").alias("shingles"), *[F.first(b).alias(b) for b in BANDS]), "nodes")
    size = (F.octet_length("shingles") / 4).cast("long").alias("size")
    buckets = nodes.select("key", size, F.explode(F.array_distinct(F.array(*BANDS))).alias("bucket"))

    def contents(keys: DataFrame) -> DataFrame:
        return nodes.select("key", F.col("shingles").alias("elements"), F.lit(None).cast("binary").alias("weights")).join(keys, "key")

    labels = linked(buckets, contents, threshold=threshold, width=4)
    placed = found.select("id", "uid", "at", "key").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("key", F.coalesce("root", "key")).drop("root")
    placed = stored(placed, "placed")
    first = placed.groupBy("key").agg(F.min(F.struct("id", "uid")).alias("first"), F.min("uid").alias("low"), F.max("uid").alias("high")).where("low < high")
    again = placed.join(stored(first.select("key", F.col("first.uid").alias("own"), F.col("first.id").alias("own_id")), "first"), "key").where("uid <> own")
    spans = again.groupBy("id", "uid").agg(F.array_sort(F.collect_set("at")).alias("at"), F.array_sort(F.collect_set("own_id")).alias("kept_in"))
    return spans.select("id", "uid", merged("at").alias("spans"), "kept_in")


def uid_of(docs: DataFrame, doc_id: str, text: str) -> Column:
    return F.xxhash64(docs[doc_id], docs[text])


def merged(at: str) -> Column:
    """Spans of WINDOW words from the sorted places, joined where they touch: a span begins where the place before is too far, and ends where the next is."""
    begins = F.filter(at, lambda x, k: (k == 0) | (x > F.get(F.col(at), k - 1) + WINDOW))
    ends = F.filter(at, lambda x, k: F.coalesce(F.get(F.col(at), k + 1) > x + WINDOW, F.lit(True)))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b + WINDOW).alias("end")))


def report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: its id, its spans of repeated words (none is an empty array), the ids of the documents that keep them, and the number of the words."""
    found = repeats(docs, doc_id=doc_id, text=text, **how).select(F.col("uid").alias("_uid"), F.col("spans").alias("_spans"), F.col("kept_in").alias("_kept"))
    rows = docs.select(F.col(doc_id).alias("_id"), uid_of(docs, doc_id, text).alias("_uid")).join(found, "_uid", "left")
    spans = F.coalesce("_spans", F.array().cast(found.schema["_spans"].dataType))
    kept = F.coalesce("_kept", F.array().cast(found.schema["_kept"].dataType))
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s.end - s.start)
    return rows.select(F.col("_id").alias(doc_id), spans.alias("spans"), kept.alias("kept_in"), removed.alias("n_removed"))


WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")


def without(text: str, spans: list[dict]) -> str:
    """The text without the spans' words and what stands between them."""
    words = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : words[s["start"]][0]])
        at = words[s["end"] - 1][1]
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars", **how) -> DataFrame:
    """The documents with repeated passages cut out of their texts; ``length``, where there is such a column, follows."""
    found = repeats(docs, doc_id=doc_id, text=text, **how).select(F.col("uid").alias("__uid"), F.col("spans").alias("__spans"))
    rows = docs.withColumn("__uid", uid_of(docs, doc_id, text)).join(found, "__uid", "left").drop("__uid").select(*[docs[c] for c in docs.columns], "__spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(text).to_pylist()
            new = [without(t, s) if s else t for t, s in zip(old, b.column("__spans").to_pylist())]
            columns = {n: b.column(n) for n in b.schema.names if n != "__spans"} | {text: pa.array(new, pa.string())}
            if length in columns:
                columns[length] = pa.array([len(y) if y != x else n for x, y, n in zip(old, new, columns[length].to_pylist())], columns[length].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return rows.mapInArrow(run, docs.schema)
