"""Best-fit packing of tokenized documents into sequences, in bulk-synchronous rounds.

Documents are tokenized once and cut into pieces of at most ``capacity`` tokens. Pieces are range-sorted by length;
each gets its rank among the pieces of its length (its place in its partition plus the counts of the partitions
before). Lengths lie in 1..capacity, so pieces and gaps are runs of equal size: at most ``capacity`` of each, however
many documents there are. A round sorts the runs of pieces and gaps by size, sweeps them so that each piece meets its
successor, the closest gap that holds it, settles conflicts by rank within a run, updates the gaps and repeats;
when no piece fits a gap, new sequences are opened. The plan says for ranges of ranks where they go, and every task places
its own pieces by it. So the rows are shuffled once, by (length, id, piece), which no hot length can skew.

Cases: a null text is an empty text, which is the end token alone; very long texts are cut, and only they are;
equal documents are placed each on their own; empty tables give empty results; only the named id and text columns are read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stored
from .secrets import vocabulary_path

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Parts of texts whose ids a worker keeps in a generation of its store, and the letters of one that is kept.
CACHE_PARTS, CACHE_LETTERS = 200_000, 64
ROWS_PER_TASK = 200_000


#: Runs of Latin letters that stand before white space or what the tokenizer splits them from, and the rest up to white space.
PARTS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+(?![^\\s!-&(-/:-@])|\\S+")
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: White space of ``\\s`` that the tokenizer takes for symbols.
SEPARATORS = re.compile("[\x1c-\x1f]")


class Store:
    """What ``make`` gives for many strings at once. The ones used last are kept: a generation of about ``limit``, and the one before, from which used ones come back."""

    def __init__(self, limit: int, make):
        self.limit, self.make = limit, make
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.long: list[str] = []

    def of(self, wanted: set[str]) -> dict[str, bytes]:
        """A dict that has all wanted strings, good until the next call; long strings are not kept beyond it."""
        for x in self.long:
            del self.now[x]
        if len(self.now) > self.limit:
            self.before, self.now = self.now, {}
        fresh = wanted.difference(self.now)
        known = {x: self.before[x] for x in fresh if x in self.before}
        fresh.difference_update(known)
        self.now.update(known)
        new = list(fresh)
        self.now.update(zip(new, self.make(new)))
        self.long = [x for x in new if len(x) > CACHE_LETTERS]
        return self.now


class WordIds:
    """Ids of texts, put together from those of their parts as little-endian 32-bit integers.

    The tokenizer drops white space and joins nothing across it or across the end of a run of letters, so a text's ids are those of its
    parts. It lower-cases, which texts in Latin-1 are before, as there are fewer parts then. New parts are tokenized together, the others looked up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)

        def tokenized(parts: list[str]) -> Iterator[bytes]:
            # Runs of letters are one word each of the tokenizer's, so many make up one text, whose ids fall to its words.
            out: dict[str, bytes] = {}
            lone = [p for p in parts if not LETTERS.fullmatch(p)]
            runs = [p for p in parts if LETTERS.fullmatch(p)]
            for k in range(0, len(runs), 256):
                some = runs[k : k + 256]
                e = tokenizer.encode(" ".join(some), add_special_tokens=False)
                word = np.array(e.word_ids, np.int64)
                cuts = np.searchsorted(word, np.arange(len(some) + 1)) * 4
                if len(word) == 0 or word[-1] != len(some) - 1 or (np.diff(cuts) == 0).any():
                    lone += some
                    continue
                data = np.array(e.ids, "<u4").tobytes()
                out.update((p, data[i:j]) for p, i, j in zip(some, cuts[:-1].tolist(), cuts[1:].tolist()))
            for k in range(0, len(lone), 4096):
                for p, e in zip(lone[k : k + 4096], tokenizer.encode_batch_fast(lone[k : k + 4096], add_special_tokens=False)):
                    out[p] = np.array(e.ids, "<u4").tobytes()
            return map(out.__getitem__, parts)

        self.parts = Store(CACHE_PARTS, tokenized)

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text and the end token."""
        end = struct.pack("<I", END)
        split = [parts_of(t) if t else [] for t in texts]
        known = self.parts.of(set().union(*split))
        for parts in split:
            yield b"".join(map(known.__getitem__, parts)) + end


def parts_of(text: str) -> list[str]:
    if SEPARATORS.search(text):
        return [x for x in text.translate(ASCII_SPACE).split(" ") if x]
    try:
        text.isascii() or text.encode("latin-1")
    except UnicodeEncodeError:
        return PARTS.findall(text)
    return PARTS.findall(text.lower())


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


ASCII_SPACE = str.maketrans("\t\n\x0b\x0c\r", "     ")


def pieces(docs: DataFrame, *, doc_id: str, text: str, vocabulary: str, capacity: int) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(vocabulary)
        for b in batches:
            take, out = [], []
            for k, data in enumerate(ids.texts(b.column("text").to_pylist())):
                for n, a in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[a : a + 4 * capacity]
                    take.append(k)
                    out.append((n, a // 4, len(part) // 4, zlib.crc32(part)))
            columns = [b.column("id").take(pa.array(take, pa.int64()))]
            for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64())):
                columns.append(pa.array([x[k] for x in out], kind))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's place among the rows of its length, as rows come sorted by length."""
    from pyspark import TaskContext

    part, last, seen = TaskContext.get().partitionId(), -1, 0
    for b in batches:
        lengths = b.column("length").to_numpy(zero_copy_only=False)
        places = np.empty(len(lengths), np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(lengths)) + 1, [len(lengths)]]) if len(lengths) else []
        for i, j in zip(cuts[:-1], cuts[1:]):
            seen = seen if lengths[i] == last else 0
            places[i:j] = np.arange(seen, seen + j - i)
            last, seen = lengths[i], seen + j - i
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(lengths), part, np.int32)), pa.array(places)], names=[*b.schema.names, "part", "place"])


class Plan:
    """Ranges of ranks by length: where each begins, its first sequence, how many of its pieces each sequence takes, and their first offset."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences, self.rounds, self.gap_tokens = capacity, 0, 0, 0
        left = {n: c for n, c in counts.items() if c}
        used = dict.fromkeys(left, 0)
        runs: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in left}
        gaps: dict[int, list[tuple[int, int]]] = {}  # by size, ranges (first sequence, how many)

        def give(length: int, size: int, first: int, n: int, each: int) -> None:
            """``each`` pieces to every one of n sequences with gaps of ``size``."""
            runs[length].append((used[length], first, each, capacity - size))
            used[length] += n * each
            left[length] -= n * each
            if not left[length]:
                del left[length]
            if size - length * each:
                fresh.setdefault(size - length * each, []).append((first, n))

        while left:
            self.rounds += 1
            fresh: dict[int, list[tuple[int, int]]] = {}
            open_: list[int] = []  # runs of pieces that wait for a gap, shortest first
            waiting = sorted(left)
            k = matched = 0
            for size in sorted(gaps):
                while k < len(waiting) and waiting[k] <= size:
                    open_.append(waiting[k])
                    k += 1
                ranges = gaps[size]
                while ranges and open_:
                    length = open_[-1]
                    first, n = ranges.pop()
                    each = max(1, min(size // length, left[length] // n))
                    take = min(n, left[length] // each)
                    give(length, size, first, take, each)
                    matched += take
                    if take < n:
                        ranges.append((first + take, n - take))
                    if length not in left:
                        open_.pop()
                if ranges:
                    fresh.setdefault(size, []).extend(ranges)
            least = min(left, default=0)
            self.gap_tokens += sum(size * n for size, r in fresh.items() if size < least or not left for _, n in r)
            gaps = {size: r for size, r in fresh.items() if left and size >= least}
            if not matched and left:
                # Nothing fits: open an eighth of the sequences that the rest needs at least, for the longest pieces.
                want = -(-sum(n * c for n, c in left.items()) // (8 * capacity))
                fresh = gaps
                for length in sorted(left, reverse=True):
                    each = min(capacity // length, left[length])
                    n = left[length] // each
                    give(length, capacity, self.sequences, n, each)
                    self.sequences += n
                    want -= n
                    if want <= 0:
                        break
        self.runs = {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in runs.items()}
        self.gap_tokens += sum(size * n for size, r in gaps.items() for _, n in r)

    def place(self, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, first, each, offset = self.runs[length]
        k = np.searchsorted(start, rank, "right") - 1
        own = rank - start[k]
        return first[k] + own // each[k], offset[k] + own % each[k] * length


def pack(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the document's id, piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    bound_batches(spark)
    cut = stored(pieces(docs, doc_id=doc_id, text=text, vocabulary=vocabulary or vocabulary_path(VOCABULARY), capacity=capacity), "pieces")
    tasks = max(spark.sparkContext.defaultParallelism, -(-cut.count() // ROWS_PER_TASK))
    ordered = cut.repartitionByRange(tasks, "length", "id", "piece", "ids_crc32").sortWithinPartitions("length")
    kind = cut.schema["id"].dataType.simpleString()
    ranked = stored(ordered.mapInArrow(numbered, f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long"), "ranked")
    # Sorted by length, a task holds few lengths: at most capacity + tasks pairs.
    offsets: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for r in sorted(ranked.groupBy("part", "length").count().collect()):
        offsets[r.part, r.length] = counts.get(r.length, 0)
        counts[r.length] = offsets[r.part, r.length] + r["count"]
    sent = spark.sparkContext.broadcast((Plan(counts, capacity), offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, before = sent.value
        for b in batches:
            part, length, own = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "length", "place"))
            sequence, offset = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            both, inverse = np.unique(np.stack([part, length]), axis=1, return_inverse=True)
            for k, (p, n) in enumerate(both.T.tolist()):
                at = np.flatnonzero(inverse.reshape(-1) == k)
                sequence[at], offset[at] = plan.place(n, own[at] + before[p, n])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", doc_id)
